"""What the operators of this subpackage share: folds, shared storage, blocks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: About as many bytes of text go to one block (one group of one Python call), unless
#: spark.derivant.blockBytes says otherwise. A worker holds a block and its hashes several
#: times over; each block exchanges a row with each bucket, so large corpora want the largest
#: blocks that workers have memory for.
BLOCK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="derivant-")
        context.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    with contextlib.suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``materialize`` made and that nothing reads any more."""
    for df in frames:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0


def blocks_for(df: DataFrame, column: str) -> int:
    """A number of hash blocks such that one holds about BLOCK_BYTES of text."""
    size = int(df.sparkSession.conf.get("spark.derivant.blockBytes", str(BLOCK_BYTES)))
    return max(1, partitions(df.sparkSession), -(-text_bytes(df, column) // size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
