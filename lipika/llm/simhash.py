"""Near-duplicate detection with SimHash: exact comparison in tiles with numpy's exclusive-or and bit counts.

A document's fingerprint has a bit set where over half of its shingles' hashes have it.  Two layouts bring fingerprints
that can be linked into the same tile:

* ``block_rows`` for small radii: fingerprints at ``radius`` or fewer differing bits agree in one of ``radius + 1`` blocks of bits, so
  rows are dealt by (block, its bits);
* ``similar_links`` for wide radii: documents are dealt by the least of their shingles' hashes under each of ``PROBES`` orders, which two
  documents have in common with a chance of their similarity each time, and large groups by their number of shingles.

Groups over ``TILE`` rows are split into tiles by class (for blocks: the population count) and hash; a pair of tiles is made
only if their classes are near enough (population counts within the radius), and each pair is a task's unit of work
of bounded size.  A unit returns a spanning forest of its links, never all pairs; ``components`` joins the forests.

Near copies are linked by the exact Jaccard similarity of their shingles.  A first comparison of fingerprints finds candidates, with so much slack
that none is missed; a second one runs in each component of candidates, whose rows carry their shingles' hashes, and checks a pair
before it can join two trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lipika.llm.common import broadcast_if_small, free_name, materialize, partitions

SEED = 42
#: Rows of a tile; a pair of tiles is one unit of work.
TILE = 16_384
#: Groups up to this size are compared by shifting whole batches, larger ones as blocks of a matrix.
SMALL = 24
#: Shape of the blocks of a matrix that numpy works on at once, small enough for the CPU's cache.
STRIP, SPAN = 16, 4096
#: Shingles whose bits are summed at once.
CHUNK = 1 << 15
#: Rows of a tile of wide fingerprints, and of one where rows carry their shingles' hashes.
WIDE_TILE, SET_TILE = 4096, 1024
#: Orders under which documents' least shingles are compared: of links at similarity s a share of (1 - s) ** PROBES is lost, one in 10 ** 7 at 0.8.
PROBES = 10
#: Standard deviations that candidates' differing bits may lie above the number expected at the similarity asked for.
DEVIATIONS = 5
#: Common shingles up to which the expected share of differing bits is counted out; it falls to its limit from above.
COUNTED = 64


# ---- fingerprints

def shingle_hashes(raw: bytes, size: int) -> list[int]:
    """XXH64 of the runs of ``size`` words (bytes between ASCII white space), ASCII letters lower-cased, joined by a space.

    With fewer words, the whole sequence is the one shingle; without words there is none.
    """
    words = raw.lower().split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def simhash(values: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint of hash values, in ``words`` 64-bit words; later words take the bits of remixed hashes."""
    counts = np.zeros((words, 64), dtype=np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        for w in range(words):
            h = part
            if w:
                h = (part + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(32))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((counts * 2 > len(values)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprint over all shingles, repeats included; 0 for a null or wordless text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, raw in enumerate(batch.column(1)):
                if found := shingle_hashes(raw.as_py() or b"", shingle):
                    out[i] = simhash(np.array(found, dtype=np.uint64))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def least_hashes(values: np.ndarray) -> np.ndarray:
    """The least hash under each of ``PROBES`` orders (multiplications by odd numbers, modulo 2 ** 64)."""
    out = np.zeros(PROBES, dtype=np.uint64)
    for i in range(PROBES if len(values) else 0):
        factor = pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)
        out[i] = (values * np.uint64(factor)).min()
    return out


def shingle_set(raw: bytes, size: int) -> tuple[np.ndarray, bytes]:
    """The distinct shingles' hashes in order, and their digest."""
    values = np.unique(np.array(shingle_hashes(raw, size), dtype=np.uint64))
    return values, xxhash.xxh3_128_digest(values.astype("<u8").tobytes())


def wide_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, words: int = 8) -> DataFrame:
    """(doc_id, fp, n, digest, probes): ``64 * words``-bit fingerprint over the distinct shingles, as bytes, how many they are, the set's digest,
    and its ``least_hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, digests, least = [], [], [], []
            for raw in batch.column(1):
                values, digest = shingle_set(raw.as_py() or b"", shingle)
                fps.append(simhash(values, words).astype("<u8").tobytes())
                sizes.append(len(values))
                digests.append(digest)
                least.append(least_hashes(values).view(np.int64))
            columns = [pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fp", "n", "digest", "probes"])

    columns = docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary"))
    return columns.mapInArrow(run, "doc_id long, fp binary, n long, digest binary, probes array<long>")


def shingle_sets(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """(digest, shingles): the distinct shingles' hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(raw.as_py() or b"", shingle) for raw in batch.column(0)]
            sets = [values.astype("<u8").tobytes() for values, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([d for _, d in found], pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    return docs.select(F.col(text).cast("string").cast("binary")).mapInArrow(run, "digest binary, shingles binary")


def differing_shares(similarity: float) -> np.ndarray:
    """By the smaller set's size (the last entry is for all larger ones): the largest share of bits in which fingerprints of sets at ``similarity``
    or more are expected to differ.

    The limit is arccos(2 s / (1 + s)) / pi.  Small sets are above it, and for them every case is counted out: a bit is the majority of
    fair coins, of which the two sets have the common ones together and toss the others on their own.
    """
    limit = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    out = np.zeros(COUNTED + 1)

    def chances(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n

    def set_given(common: int, own: int) -> np.ndarray:
        """Chance of a set bit for each number of common shingles that have it."""
        p = chances(own)
        return np.array([p[max(0, (common + own) // 2 + 1 - c) :].sum() for c in range(common + 1)])

    for common in range(1, COUNTED + 1):
        most = int(common * (1 / similarity - 1) + 1e-9)
        given = [set_given(common, own) for own in range(most + 1)]
        for x in range(most + 1):
            for y in range(x, most + 1 - x):
                share = float((chances(common) * (given[x] * (1 - given[y]) + given[y] * (1 - given[x]))).sum())
                at = min(common + x, COUNTED)
                out[at] = max(out[at], share)
    out[COUNTED] = max(out[COUNTED], limit)
    return np.maximum.accumulate(out[::-1])[::-1]


def bits_within(share: np.ndarray, bits: int) -> np.ndarray:
    """The differing bits of ``bits`` that a share stays within, by ``DEVIATIONS``."""
    return np.ceil(bits * share + DEVIATIONS * (bits * share * (1 - share)) ** 0.5).astype(np.int64)


# ---- tiles

def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``label`` (each entry's root, roots lowest) along the edges (a, b)."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Comparer:
    """Links within units of work: at most ``near`` differing bits in the first word, ``two`` (if given) in the first two, and ``radius`` in all.

    ``ratio`` tells what ``order`` holds: None for population counts (links differ by ``near`` at most), else sizes, of which linked ones
    have at least this ratio; ``near`` is then by the smaller size, the last entry for all larger ones.  With sets, links have that Jaccard similarity too.
    """

    def __init__(self, radius: int, near: int | np.ndarray, ratio: float | None, two: int | None = None):
        self.radius, self.ratio, self.two = radius, ratio, two
        self.nears = np.atleast_1d(near)
        self.near = int(self.nears.max())
        self.x = np.empty((STRIP, SPAN), dtype=np.uint64)
        self.n = np.empty((STRIP, SPAN), dtype=np.uint8)
        self.hit = np.empty((STRIP, SPAN), dtype=bool)
        self.sets: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def hold(self, sets: list[np.ndarray]) -> None:
        """The sets of the rows that ``forest`` is called with next."""
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        values, members = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = members, np.concatenate(([0], np.cumsum(sizes))), np.zeros(len(values), dtype=bool)

    def alike(self, a: int, b: np.ndarray) -> np.ndarray:
        """Which of the rows ``b`` have the similarity to row ``a``, exactly."""
        members, ends, mark = self.sets
        own = members[ends[a] : ends[a + 1]]
        sizes = ends[b + 1] - ends[b]
        starts = np.cumsum(sizes) - sizes
        mark[own] = True
        hits = mark[members[np.repeat(ends[b] - starts, sizes) + np.arange(sizes.sum())]]
        mark[own] = False
        common = np.diff(np.concatenate(([0], np.cumsum(hits)))[np.append(starts, len(hits))])
        return common >= self.ratio * np.maximum(len(own) + sizes - common, 1) - 1e-9

    def link(self, fp: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        """Join the trees of the pairs (a, b) that pass; ``rows`` are their places among the held sets."""
        a, b = self.verify(fp, a, b)
        if self.sets is None:
            return merge(label, a, b)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for part in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1) if len(a) else []:
            part = part[label[a[part]] != label[b[part]]]
            while len(part):  # a few first: once they are linked, others may be too
                now, part = part[:64], part[64:]
                i = int(a[now[0]])
                now = now[self.alike(int(rows[i]), rows[b[now]])]
                merge(label, a[now], b[now])
                part = part[label[a[part]] != label[b[part]]]

    def verify(self, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if fp.shape[1] == 1 or not len(a):
            return a, b
        if self.two is not None:
            keep = np.bitwise_count(fp[a, 0] ^ fp[b, 0]) + np.bitwise_count(fp[a, 1] ^ fp[b, 1]) <= self.two
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= self.radius
        return a[keep], b[keep]

    def shifted(self, fp: np.ndarray, group: np.ndarray, side: np.ndarray | None, most: int, label: np.ndarray, rows: np.ndarray) -> None:
        """All pairs in groups of at most ``most`` rows, the rows being sorted by group."""
        for d in range(1, most):
            hit = group[d:] == group[:-d]
            if side is not None:
                hit &= side[d:] != side[:-d]
            hit &= np.bitwise_count(fp[d:, 0] ^ fp[:-d, 0]) <= self.near
            a = np.flatnonzero(hit)
            self.link(fp, a, a + d, label, rows)

    def matrix(self, fp: np.ndarray, order: np.ndarray, split: int | None, label: np.ndarray, rows: np.ndarray) -> None:
        """All pairs of rows sorted by ``order``; with ``split`` the pairs across it, both parts being sorted."""
        first, count = fp[:, 0], len(fp)
        base, end = split or 0, split or count
        columns, keys = first[base:], order[base:]
        for i in range(0, end, STRIP):
            strip, o = first[i : min(i + STRIP, end)], order[i : min(i + STRIP, end)]
            least, most = (o[0] - self.near, o[-1] + self.near) if self.ratio is None else (o[0] * self.ratio - 1e-6, o[-1] / self.ratio + 1e-6)
            near = self.near if self.ratio is None else self.nears[min(max(int(least), 0), len(self.nears) - 1)]
            low, high = int(np.searchsorted(keys, least)), int(np.searchsorted(keys, most, side="right"))
            if split is None:
                low = max(low, i)
            for j in range(low, high, SPAN):
                part = columns[j : min(j + SPAN, high)]
                at = np.s_[: len(strip), : len(part)]
                np.bitwise_xor(strip[:, None], part[None, :], out=self.x[at])
                np.bitwise_count(self.x[at], out=self.n[at])
                np.less_equal(self.n[at], near, out=self.hit[at])
                if self.hit[at].any():
                    a, b = np.nonzero(self.hit[at])
                    a, b = a + i, b + (j + base)
                    keep = label[a] != label[b]
                    self.link(fp, a[keep], b[keep], label, rows)

    def forest(self, unit: np.ndarray, side: np.ndarray, order: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Each row's root in the links of its unit; rows sorted by unit, side and order."""
        label = np.arange(len(unit))
        cuts = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]))
        sizes = np.diff(cuts)
        few = np.repeat(sizes <= SMALL, sizes)
        cross = np.repeat(np.add.reduceat(side, cuts[:-1]) > 0, sizes)
        for mixed in (False, True):
            at = np.flatnonzero(few & (cross == mixed))
            if len(at) > 1:
                own = np.arange(len(at))
                self.shifted(fp[at], unit[at], side[at] if mixed else None, int(sizes[sizes <= SMALL].max()), own, at)
                label[at] = at[own]
        for start, size in zip(cuts[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            ones = int(side[start : start + size].sum())
            if ones < size:
                own = np.arange(size)
                self.matrix(fp[start : start + size], order[start : start + size], size - ones if ones else None, own, np.arange(start, start + size))
                label[start : start + size] = own + start
        return label


def compare_units(units: DataFrame, radius: int, near: int | np.ndarray, words: int, ratio: float | None = None, two: int | None = None, sets: bool = False) -> DataFrame:
    """(u, v): spanning forests of the links in every unit of work.

    ``units`` has bucket and pair (long; together they name a unit), side (int), order (long), node (long), fp (long or bytes).  Rows of
    side 1 are compared with those of side 0; in a unit with side 0 alone, all with each other.  With ``sets``, fp goes on with the row's shingles, and links
    have at least ``ratio`` as their exact Jaccard similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(radius, near, ratio, two)

        def links(bucket, pair, side, order, node, fp) -> pa.RecordBatch:
            unit = np.concatenate(([0], np.cumsum((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1]))))
            if sets:
                comparer.hold([np.frombuffer(x, dtype="<u8", offset=8 * words) for x in fp])
                fp = np.frombuffer(b"".join(x[: 8 * words] for x in fp), dtype="<u8").reshape(-1, words)
            label = comparer.forest(unit, side, order, fp)
            child = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]])], ["u", "v"])

        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(5)
            if sets:
                fp = np.array(fp.to_pylist(), dtype=object)
            else:
                fp = np.asarray(fp).view(np.uint64).reshape(-1, 1) if words == 1 else np.frombuffer(b"".join(fp.to_pylist()), dtype="<u8").reshape(-1, words)
            new = [np.asarray(batch.column(i)).astype(np.int64) for i in range(5)] + [fp]
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
            others = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]))
            if len(others):  # the last unit may go on in the next batch
                last = int(others[-1]) + 1
                yield links(*[x[:last] for x in kept])
                kept = [x[last:] for x in kept]
        if kept is not None:
            yield links(*kept)

    # units with sets are few and heavy: more partitions than usual, so that few meet in one
    return (
        units.repartition(partitions(units.sparkSession) * (4 if sets else 1), "bucket", "pair")
        .sortWithinPartitions("bucket", "pair", "side", "order")
        .select("bucket", "pair", "side", "order", "node", "fp")
        .mapInArrow(run, "u long, v long")
    )


def split_units(rows: DataFrame, reach: int, tile: int) -> DataFrame:
    """Units of work from rows with bucket, class, order, node and fp: rows of a bucket whose classes are at most ``reach`` apart meet.

    A bucket of up to ``tile`` rows is one unit.  A larger one is cut into tiles of one class (and hash, where a class is larger),
    and each pair of tiles with near classes is a unit, to which the rows of both are sent.  The table of large buckets has
    at most ``1 / tile`` of the rows for each class.
    """
    sizes = rows.groupBy("bucket", "class").count()
    large = materialize(
        sizes.groupBy("bucket")
        .agg(F.sum("count").alias("total"), F.collect_list(F.struct("class", F.ceil(F.col("count") / tile).cast("int").alias("n"))).alias("classes"))
        .where(F.col("total") > tile)
        .drop("total"),
        "buckets",
    )
    own = F.element_at(F.filter("classes", lambda c: c["class"] == F.col("class")), 1)["n"]
    mine = (F.col("class") * (1 << 20) + F.pmod(F.xxhash64("node"), own)).cast("long")

    def unit(other: Column) -> Column:
        return F.struct(
            (F.least(mine, other) * F.lit(1 << 31) + F.greatest(mine, other)).alias("pair"), (mine > other).cast("int").alias("side")
        )

    pairs = F.transform(
        F.flatten(
            F.transform(
                F.filter("classes", lambda c: F.abs(c["class"] - F.col("class")) <= reach),
                lambda c: F.transform(F.sequence(F.lit(0), c["n"] - 1), lambda i: (c["class"] * (1 << 20) + i).cast("long")),
            )
        ),
        unit,
    )
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("pair"), F.lit(0).alias("side")))
    return (
        rows.join(broadcast_if_small(large), "bucket", "left")
        .withColumn("to", F.explode(F.when(F.col("classes").isNull(), whole).otherwise(pairs)))
        .select("bucket", F.col("to.pair").alias("pair"), F.col("to.side").alias("side"), "order", "node", "fp")
    )


def block_rows(fps: DataFrame, radius: int) -> DataFrame:
    """Rows of ``split_units`` for 64-bit fingerprints (column fp): one for each of ``radius + 1`` blocks of bits."""
    n = radius + 1
    bounds = [64 * i // n for i in range(n + 1)]
    keys = [
        F.lit(i << 56).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:]))
    ]
    return fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp").select(
        "bucket", F.bit_count("fp").alias("class"), F.bit_count("fp").cast("long").alias("order"), F.col("fp").alias("node"), "fp"
    )


# ---- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node with an edge and the least node it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stay the same.  Every step's edges are
    written to the shared folder; only their number and checksum come to the driver.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def least_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, least): for nodes (node, doc_id), the least doc_id of each one's component; null if it has none."""
    roots = components(edges)
    known = materialize(nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "roots")
    least = known.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("least"))
    return known.join(least, "root", "left").select("node", F.coalesce("least", "doc_id").alias("least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint as 16 hexadecimal digits, and the smallest key reachable over
    links between fingerprints at ``radius`` or fewer differing bits.

    Equal fingerprints are compared once.  A null or wordless text has fingerprint zero, linked like any other; a null key
    is no smallest key (its row has its component's, null if that has none); repeated rows stay; a text of any length is
    read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    units = split_units(block_rows(fps, radius), radius, TILE)
    least = least_reachable(fps.withColumnRenamed("fp", "node"), compare_units(units, radius, radius, 1))
    return rows.join(least.withColumnRenamed("node", "fp"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def similar_links(nodes: DataFrame, sets_of, similarity: float, words: int) -> DataFrame:
    """(u, v): a spanning forest of the nodes (node, doc_id, n, fp, digest, probes) whose shingles have at least this Jaccard similarity.

    ``sets_of`` gives (digest, shingles) for nodes; only those with a candidate are asked for.
    """
    shares = differing_shares(similarity)
    radius, near, two = int(bits_within(shares, 64 * words).max()), bits_within(shares, 64), int(bits_within(shares, 128).max())
    width = -np.log(similarity)

    def classed(df: DataFrame, bucket: Column, fp: Column) -> DataFrame:
        size = F.log(F.greatest("n", F.lit(1)).cast("double")) / float(width)
        return df.select(bucket.cast("long").alias("bucket"), F.floor(size).cast("int").alias("class"), F.col("n").alias("order"), "node", fp.alias("fp"))

    probes = F.posexplode("probes").alias("probe", "value")
    dealt = nodes.where("n > 0").select("node", "n", "fp", probes)
    near_by = compare_units(split_units(classed(dealt, F.xxhash64("probe", "value"), F.col("fp")), 1, WIDE_TILE), radius, near, words, similarity, two)
    groups = components(near_by)
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(nodes.join(groups, "node"), "candidates")
    found = materialize(members.join(sets_of(members), "digest").select("root", "node", "n", F.concat("fp", "shingles").alias("fp")), "sets")
    units = split_units(classed(found, F.col("root"), F.col("fp")), 1, SET_TILE)
    return compare_units(units, radius, near, words, similarity, two, sets=True)


def keep_one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 8
) -> DataFrame:
    """``docs`` without all but one document (the smallest key) of each group of near-duplicates.

    Documents are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more, counted exactly.
    Candidates are pairs whose fingerprints of ``64 * words`` bits differ in at most the share of bits expected at that similarity
    and ``DEVIATIONS`` standard deviations more, of documents that have one of ``PROBES`` least shingles in common.

    A null or wordless text is a document without shingles, alike to all of that kind.  Rows are kept by key: all rows with a kept key stay, repeated ones
    too, and rows with a null key stay if some group has no other key.  An empty table stays empty; all columns come back as they were.
    """
    rows = materialize(wide_fingerprints(docs, key, text, shingle, words), "fingerprints")
    nodes = materialize(
        rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("fp").alias("fp"), F.first("probes").alias("probes")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )

    def sets_of(members: DataFrame) -> DataFrame:
        wanted = broadcast_if_small(materialize(members.select("doc_id").distinct(), "wanted"))
        some = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(wanted, F.col("k").eqNullSafe(F.col("doc_id")), "left_semi")
        return shingle_sets(some, "t", shingle).groupBy("digest").agg(F.first("shingles").alias("shingles"))

    least = least_reachable(nodes.select("node", "doc_id"), similar_links(nodes, sets_of, similarity, words))
    by_set = nodes.select("node", "digest").join(least, "node").select("digest", "least")
    keep = rows.select("doc_id", "digest").join(by_set, "digest").where("doc_id <=> least").select("doc_id").distinct()
    kept = free_name(docs, "kept")
    return docs.join(keep.withColumnRenamed("doc_id", kept), F.col(key).cast("long").eqNullSafe(F.col(kept)), "left_semi")
