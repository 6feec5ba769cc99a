"""Substring dedup with suffix automata of reference shards.

A window is a run of ``WINDOW`` words.  A word goes if a window that covers it also starts in a document with a smaller key.  The reference
is the corpus itself, which no executor can hold, so it is cut into shards by content and each shard's automaton is built where
its documents' passages arrive, in place of broadcasting the automata:

1. A window's shard is the smallest hash of the ``GRAM``-word runs in it, so equal windows meet in one shard.  Shards that only one document
   reaches hold nothing to compare; they are found by a partial sum over (shard, key), and a bitmap of the others, of bounded size, is
   broadcast.  It may let through others, which costs time, never a match.
2. Runs of windows with the same shard become passages.  Equal passages are one, with its smallest key.
3. Each shard streams its passages in order of key through a suffix automaton of those before: where the longest match has
   ``WINDOW`` words, the automaton's state has the first key of that window; what is new is added.  Passages of a shard with over
   ``HOT_WORDS`` words are cut into single windows, dealt by their own hash.
4. First keys go back to the passages' documents, and covered words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lipika.llm.common import broadcast_if_small, materialize, partitions

WINDOW, GRAM = 13, 5
#: Words of a shard's distinct passages, from which they are dealt as single windows.
HOT_WORDS = 100_000
#: Bits of the bitmap, as a power of two: at least, and at most (32 MB).
BITMAP = (16, 28)
#: Words remembered in each worker; beyond it the memory starts anew.
MEMO_WORDS = 300_000
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(GRAM)], dtype=np.uint64)


class WordHashes:
    """64-bit hashes of a document's words."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in words:
            if word not in memo:
                memo[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def window_shards(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The shard of each window: the smallest hash of its runs of ``GRAM`` words."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = np.zeros(len(hashes) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        g += hashes[k : k + len(g)] * _FACTORS[k]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    width, span = window - GRAM + 1, 1
    while span * 2 <= width:
        g = np.minimum(g[: len(g) - span], g[span:])
        span *= 2
    return np.minimum(g[:n], g[width - span : width - span + n])


class Automaton:
    """A suffix automaton over words; each state has the key of the first passage with its words."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, moves: dict[bytes, int], link: int, length: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes], key: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state({}, 0, self.length[last] + 1, key), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def first_keys(self, words: list[bytes], window: int) -> list[int | None]:
        """For each window its first key, None if it is new: matching statistics, cut at the window's length."""
        out: list[int | None] = []
        v = n = 0
        for i, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if (to := self.next[v].get(word)) is not None:
                v, n = to, n + 1
            if n >= window:
                n = window
                while self.length[self.link[v]] >= n:
                    v = self.link[v]
            if i >= window - 1:
                out.append(self.first[v] if n >= window else None)
        return out


def stream_shard(passages: list[tuple[bytes, int]], window: int = WINDOW) -> list[list[int]]:
    """The first key of each window of the passages (words, key), which are in order of key."""
    if len(passages) == 1:
        words, key = passages[0]
        return [[key] * (words.count(b" ") + 2 - window)]
    automaton, out = Automaton(), []
    for raw, key in passages:
        words = raw.split(b" ")
        firsts = automaton.first_keys(words, window)
        at = 0
        while at < len(firsts):
            if firsts[at] is not None:
                at += 1
                continue
            end = at
            while end < len(firsts) and firsts[end] is None:
                firsts[end] = key
                end += 1
            automaton.add(words[at : end + window - 1], key)
            at = end
        out.append(firsts)
    return out


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, key): the shards that each document reaches."""
    hashes = WordHashes()
    for batch in batches:
        shards, keys = [], []
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.unique(window_shards(hashes((raw.as_py() or b"").split())))
            shards.append(found)
            keys.append(np.full(len(found), key, dtype=np.int64))
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards).view(np.int64)), pa.array(np.concatenate(keys))], ["shard", "key"])


def shared_bitmap(shared: DataFrame) -> np.ndarray:
    """A bitmap of the shards in ``shared`` by their low bits; only its words that aren't zero come to the driver."""
    n = shared.count()
    bits = min(max(BITMAP[0], (16 * max(n, 1)).bit_length()), BITMAP[1])
    low = F.col("shard").bitwiseAND(F.lit((1 << bits) - 1))
    words = shared.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(shard & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) >> 6, dtype=np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, shards: np.ndarray) -> np.ndarray:
    low = shards & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) != 0


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, kept, removed) of every row, windows judged on the input.

    Words are runs of anything but ASCII white space, unchanged; ``kept`` is the kept words joined by one space, ``removed`` the spans of the others:
    their first word's number from 0 and how many they are, in order.  A null text has no words; a document with fewer words than a window loses none; rows with equal keys are no earlier than each other;
    a row with a null key loses nothing and takes nothing from others; a text of any length is read whole; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), raw.cast("binary").alias("t"), F.xxhash64(raw).alias("mark"))
    keyed = rows.where("key IS NOT NULL")
    once = not keyed.groupBy("key").count().where("count > 1").limit(1).count()

    shared = materialize(
        keyed.select("key", "t").mapInArrow(_reached, "shard long, key long").groupBy("shard").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("shard"),
        "shards",
    )
    bitmap = spark.sparkContext.broadcast(shared_bitmap(shared))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for k, t, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = (t.as_py() or b"").split()
                shards = window_shards(hashes(words))
                if not len(shards):
                    continue
                cuts = np.concatenate(([0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]))
                for i in np.flatnonzero(in_bitmap(bitmap.value, shards[cuts[:-1]])).tolist():
                    a, b = int(cuts[i]), int(cuts[i + 1])
                    out.append((int(shards[a].astype(np.int64)), k, mark, a, b" ".join(words[a : b + WINDOW - 1])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "key", "mark", "at", "words"])

    found = materialize(keyed.mapInArrow(passages, "shard long, key long, mark long, at long, words binary"), "passages")
    distinct = materialize(found.groupBy("shard", "words").agg(F.min("key").alias("key"), F.max("key").alias("last")), "distinct")
    # a shard is held in one list: passages count by their words
    held = F.sum(F.size(F.split(F.col("words").cast("string"), " ")))
    hot = materialize(distinct.groupBy("shard").agg(held.alias("n")).where(F.col("n") > HOT_WORDS).select("shard"), "hot")
    hot = broadcast_if_small(hot)

    def cut(df: DataFrame) -> DataFrame:
        """The windows of hot shards' passages, ``at`` moved on; shard: the window's own hash."""
        split = F.split(F.col("words").cast("string"), " ")
        slices = F.transform(
            F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("__w", i + 1, WINDOW), " ").cast("binary").alias("words"))
        )
        pieces = df.join(hot, "shard", "left_semi").withColumn("__w", split).withColumn("__p", F.explode(slices)).withColumn("words", F.col("__p.words"))
        return pieces.withColumn("shard", F.xxhash64("words")).drop("__w")

    cool = distinct.join(hot, "shard", "left_anti").select("shard", "words", "key", "last")
    windows = cut(distinct).groupBy("shard", "words").agg(F.min("key").alias("key"), F.max("last").alias("last"))

    def shard_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.list_(pa.int64())]

        def result(group: list[tuple]) -> Iterator[tuple]:
            for (words, key, last), firsts in zip(group, stream_shard([(w, k) for w, k, _ in group])):
                if last > key or min(firsts) < key:
                    yield words, firsts

        held, shard = [], None
        for batch in batches:
            out: list[tuple] = []
            for s, w, k, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s != shard and held:
                    out.extend(result(held))
                    held = []
                shard = s
                held.append((w, k, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["words", "firsts"])
        if held and (out := list(result(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["words", "firsts"])

    marks = [F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2")]
    firsts = (
        cool.union(windows)
        .repartition(partitions(spark), "shard")
        .sortWithinPartitions("shard", "key")
        .mapInArrow(shard_results, "words binary, firsts array<long>")
        .select(*marks, "firsts")
    )
    firsts = materialize(firsts, "firsts")
    # rows with equal key and text have the same places
    places = found if once else found.dropDuplicates(["key", "mark", "at"])
    places = (
        places.join(hot, "shard", "left_anti")
        .select("key", "mark", "at", *marks)
        .union(cut(places).select("key", "mark", (F.col("at") + F.col("__p.i")).alias("at"), *marks))
    )
    gone = F.filter(
        F.transform("firsts", lambda f, i: F.when(f < F.col("key"), (F.col("at") + i).cast("int"))), lambda x: x.isNotNull()
    )
    spans = (
        places.join(firsts, ["h1", "h2"])
        .select("key", "mark", gone.alias("gone"))
        .where(F.size("gone") > 0)
        .groupBy("key", "mark")
        .agg(F.flatten(F.collect_list("gone")).alias("gone"))
    )

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, kept = [], [], []
            for t, starts in zip(batch.column(1), batch.column(2)):
                words = (t.as_py() or b"").split()
                n_words.append(len(words))
                spans.append([])
                if starts.is_valid:
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                    cover[at] += 1
                    np.add.at(cover, at + WINDOW, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    spans[-1] = [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()]
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, SPANS)], ["doc_id", "n_words", "kept", "removed"]
            )

    return (
        rows.join(materialize(spans, "spans"), ["key", "mark"], "left")
        .select("key", "t", "gone")
        .mapInArrow(removed, "doc_id long, n_words long, kept binary, removed array<struct<start: long, length: long>>")
        .withColumn("kept", F.col("kept").cast("string"))
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): ``cut_repeats`` with the number of removed words and the digest of the kept text, in UTF-8."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["length"])
    return cut_repeats(docs, key, text).select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
