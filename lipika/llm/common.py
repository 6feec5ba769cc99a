"""Session helpers shared by the operators: inputs, the shared folder, cutting lineage, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A side is broadcast only when its counted bytes stay within this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of sessions whose setting is unset, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one where it is unset on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lipika-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lipika/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files every executor can reread, so a lost executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted_bytes(df: DataFrame) -> int:
    """Bytes of a table's values in memory, counted: numbers as eight bytes, strings and binaries by their length, arrays by their elements."""

    def size(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
        if isinstance(kind, T.ArrayType):
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(24).cast("long"), lambda n, x: n + size(x, kind.elementType))
        if isinstance(kind, T.StructType):
            total = F.lit(8).cast("long")
            for f in kind.fields:
                total = total + size(c[f.name], f.dataType)
            return total
        return F.lit(8).cast("long")

    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        total = total + size(F.col(f"`{f.name}`"), f.dataType)
    return df.agg(F.sum(total)).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its ``counted_bytes`` are within ``limit``; unchanged (a shuffled join) beyond it.

    ``df`` should be a materialized table: it is read for the count.
    """
    return F.broadcast(df) if counted_bytes(df) <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (column names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch between Spark and Python: whole texts make Spark's default of 10,000 rows tens of megabytes, several times over.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> SparkSession:
    """The session with ``spark.sql.execution.arrow.maxRecordsPerBatch`` at ``BATCH_ROWS`` or less.

    For the registered queries and the pipeline, whose sessions are theirs; operators themselves leave the caller's settings alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
