"""Sharding by jump consistent hashing [native].

A stable key and the number of shards decide the shard; there is no ring table.  Each step draws one uniform number from
the hash of (key, current bucket) and jumps to the next bucket count at which the key would move, as in Lamping and
Veach's jump consistent hash, with Spark's ``xxhash64`` in place of their linear congruential generator (their wrapping
64-bit product is not expressible under ANSI arithmetic).  The jumps of a key do not depend on the number of shards, so
appending a shard moves rows only into that shard, about one in ``n + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lipika.llm.common import materialize, partitions

#: A key makes about ln(n) jumps; so many are tried before the exact long loop.
SHORT = 48


def _jumps(key: Column, shards: int, steps: int, start: Column) -> Column:
    def step(acc: Column, _: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, acc["j"]), 11) + F.lit(1)) / F.lit(float(1 << 53))
        leap = F.least(F.floor((acc["j"] + F.lit(1)) / draw), F.lit(shards)).cast("long")
        return F.when(acc["j"] >= shards, acc).otherwise(F.struct(acc["j"].alias("b"), leap.alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard in ``[0, shards)`` of a key.

    A null key has a defined shard like any other value.  Exact for any number of shards: the short loop covers all but
    a vanishing share of keys, the rest take the loop with one step for each shard (evaluated lazily).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    short = _jumps(key, shards, min(shards + 1, SHORT), start)
    if shards >= SHORT:
        short = F.when(short["j"] >= shards, short).otherwise(_jumps(key, shards, shards + 1, start))
    return short["b"].cast("int")


def assign_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16, buckets: int | None = None
) -> DataFrame:
    """Shard, slot and size of every row.

    Returns ``key``, ``size`` (UTF-8 bytes of the text, 0 if null, plus ``overhead``), ``text_crc32`` (unsigned, of the
    UTF-8 bytes; 0 for a null text), ``law`` ("key"), ``shard``, ``slot`` (gapless from 0 in a shard, by sub-bucket, then
    key, then checksum) and ``grown_shard`` (the shard with one more shard).

    A null key is a key like any other; equal keys share a shard; repeated rows get slots of their own; other columns are
    ignored, whatever their names; an empty table gives an empty result.

    Slots need no shard in one task: each row gets a sub-bucket from a row number of its own (so equal rows spread too), is
    numbered within (shard, sub-bucket), and the sub-buckets' counts, a table of ``shards * buckets`` rows whatever the
    input, give each its first slot.  The row numbers are written to the shared folder once, so that both uses see the
    same ones after a lost executor.
    """
    n = buckets or max(8, partitions(docs.sparkSession) // 4)
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    slim = materialize(
        docs.select(
            F.col(key),
            (F.octet_length(raw).cast("long") + overhead).alias("size"),
            F.crc32(raw).alias("text_crc32"),
            jump_hash(F.col(key), shards).alias("shard"),
            jump_hash(F.col(key), shards + 1).alias("grown_shard"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("_sub"),
        ),
        "shards",
    )
    order = Window.partitionBy("shard", "_sub").orderBy(key, "text_crc32", "size")
    counts = slim.groupBy("shard", "_sub").count()
    first = counts.withColumn(
        "_first",
        F.coalesce(
            F.sum("count").over(Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).drop("count")
    return (
        slim.withColumn("_rank", F.row_number().over(order) - 1)
        .join(F.broadcast(first), ["shard", "_sub"])
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_first") + F.col("_rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
