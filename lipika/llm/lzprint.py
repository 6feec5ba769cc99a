"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases as LZ78 does: each phrase is the shortest prefix of the rest that is no earlier phrase.  The
set of phrases, hashed, is the document's dictionary; the ``SKETCH`` smallest hash values are its minimum-hash signature.  The
share of common values among the smallest of two signatures' union estimates how much of the dictionaries is common, a
likeness close to what compressing one text with the other's dictionary shows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lipika.llm.common import partitions

#: Values in a signature; estimates have a standard error of at most 1 / (2 * sqrt(SKETCH)).
SKETCH = 64
#: Code points hashed at once.
BLOCK = 1 << 16
#: Odd multiplier of the rolling hash, so that its powers have inverses modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS, INVERSES = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def parse(text: str, at: int, seen: set[str], ends: list[int]) -> bool:
    """LZ78 phrases of ``text`` from ``at``: their ends go to ``ends``, they themselves to ``seen``.

    True if the text's end made the last phrase an earlier one again.  Phrases' prefixes are phrases, so the length of the
    longest match can be searched up or down from a likely one, here that of the previous phrase or so.
    """
    n, add, put, size = len(text), seen.add, ends.append, 3
    while at < n:
        stop = at + size
        if (phrase := text[at:stop]) in seen:
            stop += 1
            while (phrase := text[at:stop]) in seen:
                if stop >= n:
                    put(n)
                    return True
                stop += 1
            if stop - at > size + 1:
                size += 1
        else:
            while stop - at > 1 and (shorter := text[at : stop - 1]) not in seen:
                stop, phrase = stop - 1, shorter
            if stop > n:
                stop = n
            if stop - at < size - 1:
                size -= 1
        add(phrase)
        put(stop)
        at = stop
    return False


def hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """64-bit hashes of the phrases of ``text`` from ``start`` that end at ``ends``, by their code points."""
    out, first, i = [], start, 0
    stops = np.array(ends, dtype=np.int64)
    while i < len(ends):
        j = max(int(np.searchsorted(stops, first + BLOCK, side="right")), i + 1)
        e = stops[i:j]
        if e[-1] - first > BLOCK:  # one phrase longer than a block
            digest = hashlib.blake2b(text[first : e[-1]].encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out.append(np.frombuffer(digest, dtype=np.uint64))
        else:
            codes = np.frombuffer(text[first : e[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            sums = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum((codes + np.uint64(1)) * POWERS[: len(codes)], out=sums[1:])
            b = e - first
            a = np.concatenate(([0], b[:-1]))
            h = (sums[b] - sums[a]) * INVERSES[a]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            out.append(h)
        first, i = int(e[-1]), j
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def signature(values: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The ``size`` smallest distinct 32-bit values, in order."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    if len(short) > 4 * size:
        least = np.unique(short[short <= np.partition(short, 2 * size)[2 * size]])
        if len(least) >= size:
            return least[:size]
    return np.unique(short)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common phrases, 0 to 1; two empty signatures are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    union = sorted(x | y)[:size]
    last = union[-1]
    return sum(v <= last for v in x & y) / len(union)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def fingerprint(text: str) -> str:
    ends: list[int] = []
    parse(text, 0, set(), ends)
    return as_text(signature(hashes(text, 0, ends)))


class Document:
    """A parsed text, from which the parse of an edited text goes on where both still agree."""

    def __init__(self, text: str):
        self.text, self.seen, self.ends = text, set(), []
        self.again = parse(text, 0, self.seen, self.ends)
        self.hashes = hashes(text, 0, self.ends)
        self.signature = signature(self.hashes)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by the start of the following one, and that text's signature.

        Uses up the phrases: they become the edited text's.
        """
        m = len(self.text) // 4
        keep = len(self.text) - m
        text, old, seen = self.text[:keep] + following[:m], self.text, self.seen
        # phrases that end before the last kept character are the same in both; those after it are taken back
        shared = bisect_right(self.ends, keep - 1)
        at = begin = self.ends[shared - 1] if shared else 0
        for stop in self.ends[shared : len(self.ends) - self.again]:
            seen.discard(old[begin:stop])
            begin = stop
        ends: list[int] = []
        parse(text, at, seen, ends)
        return text, signature(np.concatenate([self.hashes[:shared], hashes(text, at, ends)]))


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc: Document, following: Document | None) -> tuple:
    """A result row without its key."""
    if following is None:
        return len(doc.text), None, as_text(doc.signature), None, None, None
    near_next = likeness(doc.signature, following.signature)
    text, sig = doc.edited(following.text)
    return (
        len(doc.text),
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        as_text(doc.signature),
        as_text(sig),
        likeness(doc.signature, sig),
        near_next,
    )


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that none follows."""
    for batch in batches:
        rows = [(k, *_row(Document(t.as_py() or ""), None)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT.types)], schema=OUT)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (guard, key, text); a guard row is only the follower of the last own row.

    Equal texts that follow each other are worked out once.
    """
    key, before, twins = None, None, None
    rows: list[tuple] = []
    guarded = False
    for batch in batches:
        for doc_id, text, guard in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            if guard and (guarded or before is None):
                continue
            text = text.as_py() or ""
            if before is not None and text == before.text:
                twins = twins or _row(Document(text), before)
                rows.append((key, *twins))
            else:
                doc = Document(text)
                if before is not None:
                    rows.append((key, *_row(before, doc)))
                before, twins = doc, None
            key, guarded = doc_id, guard
            if guard:
                before = None
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT.types)], schema=OUT)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT.types)], schema=OUT)


def cuts(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """Where up to ``n`` ranges of (k, beginning) with about equally many rows start, all but the first.

    Quantiles of the keys; a key that several of them fall on is cut by quantiles of its texts' beginnings.  Two small rows of numbers for each range
    come to the driver.
    """
    shares = [i / n for i in range(1, n)]
    if not shares:
        return []
    found = rows.agg(F.percentile_approx("k", shares, 100 * n).alias("q")).first()["q"] or []
    out = {(k, -1) for k in found}
    repeats = {k: found.count(k) for k in set(found)}
    if hot := [k for k, m in repeats.items() if m > 1]:
        within = rows.where(F.col("k").isin(hot)).groupBy("k").agg(F.percentile_approx("beginning", shares, 100 * n).alias("q"))
        for r in within.collect():
            m = repeats[r["k"]]
            out |= {(r["k"], r["q"][len(r["q"]) * j // (m + 1)]) for j in range(1, m + 1)} | ({(r["k"] + 1, -1)} if r["k"] < (1 << 63) - 1 else set())
    return sorted(out)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, t, guard) of the rows with a key, partitioned by ranges of (key, text) and sorted, each range followed by the first row of the next.

    Ranges have about equally many rows wherever the keys lie (``cuts``), and a key that many rows have spans several.  The last range is followed by the first.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # the first seven bytes as a number, in the order of the texts
    beginning = F.conv(F.rpad(F.hex(F.substring(whole.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("k"), whole.alias("t"), beginning.alias("beginning")).where("k IS NOT NULL")
    starts = cuts(rows, partitions(spark))
    at = F.struct("k", "beginning")
    part = F.lit(0)
    if starts:
        marks = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(b).cast("long").alias("beginning")) for k, b in starts])
        part = F.size(F.filter(marks, lambda c: c <= at))
    rows = rows.withColumn("p", part)
    first = {r["p"]: r["k"] for r in rows.groupBy("p").agg(F.min("k").alias("k")).collect()}
    if not first:
        return rows.select("k", "t", F.lit(False).alias("guard"))
    # of a key that starts several ranges, only the rows with the range's least beginning are handed on
    shared = {k for k, b in starts if b >= 0}
    least = {(r["p"], r["k"]): r["b"] for r in rows.where(F.col("k").isin(list(shared))).groupBy("p", "k").agg(F.min("beginning").alias("b")).collect()} if shared else {}
    order = sorted(first)
    before = dict(zip(order, [order[-1], *order]))
    table = [(first[p], least.get((p, first[p]), -1), before[p]) if p in first else (None, -1, None) for p in range(order[-1] + 1)]
    own = F.element_at(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(b).cast("long").alias("b"), F.lit(q).cast("int").alias("q")) for k, b, q in table]), F.col("p") + 1)
    stay = F.struct(F.col("p"), F.lit(False).alias("guard"))
    handed = (F.col("k") == own["k"]) & ((own["b"] < 0) | (F.col("beginning") == own["b"]))
    places = F.when(handed, F.array(stay, F.struct(own["q"].alias("p"), F.lit(True).alias("guard")))).otherwise(F.array(stay))
    return (
        rows.select("k", "t", F.explode(places).alias("to"))
        .select("k", "t", F.col("to.guard").alias("guard"), F.col("to.p").alias("p"))
        .repartitionById(order[-1] + 1, "p")
        .sortWithinPartitions("guard", "k", "t")
        .select("k", "t", "guard")
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they and the next document are.

    The edited text has the last ``floor(n_chars / 4)`` code points replaced by the first as many (or all) of the next
    document in ascending key order, after the last the first; a single document follows itself.  Equal texts have equal
    fingerprints (hexadecimal signature; empty for an empty text).

    A null text counts as empty.  Rows with a null key are fingerprinted but have no next document and are none (null edited
    columns); rows with equal keys follow each other in order of their texts; an empty table gives an empty result;
    other columns are ignored, whatever their names.  A text of any length is parsed whole, and hashed in blocks.
    """
    alone = docs.where(F.col(key).cast("long").isNull()).select(F.col(key).cast("long"), F.col(text).cast("string"))
    return with_next(docs, key, text).mapInArrow(_run, OUT_DDL).union(alone.mapInArrow(_alone, OUT_DDL))
