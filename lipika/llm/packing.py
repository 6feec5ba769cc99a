"""Packing of tokenized documents into fixed-length sequences: harmonic packing.

A document's ids are cut into pieces.  Whole sequences come first; the rest, ``r`` ids, is cut by reciprocal capacities:
the piece goes to class ``k = floor(capacity / r)`` whose slots hold ``floor(capacity / k)`` ids, and if the slot would
leave more than ``slack`` ids empty, exactly the slot of class ``k + 1`` is cut off and the remainder goes on the same
way, at most ``max_cuts`` times.  A bin of class ``k`` closes once it holds ``k`` pieces.  Every worker fills bins of its
own, with no exchange of rows.  What a worker has left in open bins at its end is laid end to end, cut at the
capacity, and its last stretch into powers of two, which need no padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F


#: Words, and runs within words, whose ids are remembered in each worker; beyond it the memory starts anew (a speed setting, not a limit).
MEMO_WORDS = 400_000
#: Rows of a batch that a worker gives back; a row has at most a sequence's ids.
OUT_ROWS = 2_000

OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_length", pa.int64()),
    ]
)
OUT_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


#: What str.split() takes for white space and the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(r"(?:(?![\x1c-\x1f])\s)+")
#: Words cut into pieces here: printable ASCII without apostrophes (they start contractions) and lower-case Latin-1 letters.
PLAIN = re.compile("[\x21-\x26\x28-\x7eà-öø-ÿÀ-ÖØ-Þ]+")
PIECE = re.compile("[a-zà-öø-ÿ]+|[0-9]|[^a-z0-9à-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """Byte to letter of a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes, remembered by word.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are those of its
    white-space separated words in order.  Plain words are cut into runs of letters, digits and the rest as it does, and
    only the runs go through its BPE model; all other words, and those with an added token's string, go through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.split() != [t] for t in self.added):
            raise ValueError("an added token has white space, over which ids are not those of single words")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word) or any(t in word for t in self.added):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = []
        for piece in PIECE.findall(word.lower()):
            if (ids := self.pieces.get(piece)) is None:
                if len(self.pieces) > MEMO_WORDS:
                    self.pieces.clear()
                letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        words = SPACE.split(text) if any(c in text for c in SEPARATORS) else text.split()
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in words:
            if word not in memo:
                memo[word] = self.learn(word)
        return b"".join(map(memo.__getitem__, words))


@lru_cache(maxsize=4)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def cut(tokens: int, capacity: int, slack: int, max_cuts: int) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of ``tokens`` ids, in order."""
    out = [(1, capacity)] * (tokens // capacity)
    rest, cuts = tokens % capacity, 0
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= slack or cuts >= max_cuts:
            out.append((k, rest))
            break
        take = capacity // (k + 1)
        out.append((k + 1, take))
        rest, cuts = rest - take, cuts + 1
    return out


class Packer:
    """The bins of one worker: pieces go in, rows of closed bins come out."""

    def __init__(self, capacity: int, first_id: int, slack: int, max_cuts: int):
        self.capacity, self.next_id, self.slack, self.max_cuts = capacity, first_id, slack, max_cuts
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, start = len(ids) // 4, 0
        for k, n in cut(tokens, self.capacity, self.slack, self.max_cuts):
            piece = (doc_id, start, n, ids[4 * start : 4 * (start + n)], tokens)
            start += n
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self.close(self.open.pop(k))

    def close(self, pieces: list[tuple]) -> None:
        total, offset = sum(p[2] for p in pieces), 0
        length = total if total & (total - 1) == 0 else self.capacity
        for doc_id, start, n, ids, tokens in pieces:
            self.rows.append((doc_id, start, n, ids, tokens, self.next_id, offset, length))
            offset += n
        self.next_id += 1

    def finish(self) -> None:
        """Open bins, end to end: full sequences, then the binary digits of what is left."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(p[2] for p in pieces)
        held: list[tuple] = []
        room = 0
        for doc_id, start, n, ids, tokens in pieces:
            while n:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(n, room)
                held.append((doc_id, start, take, ids[: 4 * take], tokens))
                start, n, ids = start + take, n - take, ids[4 * take :]
                room, left = room - take, left - take
                if not room:
                    self.close(held)
                    held = []

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(OUT), OUT.types)], schema=OUT)


def pack_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 2048,
    end_id: int = 1,
    slack: int = 4,
    max_cuts: int = 3,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    A document's ids are the tokenizer's without special tokens, then ``end_id``.  Returns for each piece its document's
    key as ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``
    and ``sequence_length`` (what the sequence is padded to: ``capacity``, or its own length if that is a power of two).

    A null or empty text has just ``end_id``; a null key stays null; repeated rows are packed each; a text of any length
    is cut, never shortened; an empty table gives an empty result; other columns are ignored, whatever their names.
    Sequence ids are unique: the partition's number above 40 bits, the worker's own count below.  The work of a
    partition depends on its rows alone, so a retried task gives the same pieces and ids.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(tokenizer_file), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, slack, max_cuts)
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, ids(t.as_py() or "") + end)
                if len(packer.rows) >= OUT_ROWS:
                    yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, OUT_DDL)


def pack(docs: DataFrame, tokenizer_file: str, **settings) -> DataFrame:
    """``pack_pieces`` with each piece's ``ids_crc32`` in place of its ids."""
    pieces = pack_pieces(docs, tokenizer_file, **settings)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
