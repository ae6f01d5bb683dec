"""What the training-data operators share: words, staging and split hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, and the word between.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder (tests); a
    cluster must name one, since its machines do not share local disks.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that outlive executors. The files go when the
    session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _file(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*staged: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once all that reads it is itself written."""
    for df in staged:
        where, system = _file(df.sparkSession, df._staged)
        system.delete(where, True)


def split_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def text_bytes(text_col: str) -> Column:
    """The text's UTF-8 bytes, empty where it is null."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def merged_runs(runs: Column, first: str, last: str, kind: str = "bigint") -> Column:
    """Disjoint, sorted runs of the integers that an array of inclusive runs holds."""
    empty = F.array().cast(f"array<struct<{first}:{kind},{last}:{kind}>>")

    def step(out: Column, x: Column) -> Column:
        top = F.try_element_at(out, F.lit(-1))
        wider = F.struct(top[first].alias(first), F.greatest(top[last], x[last]).alias(last))
        joins = (F.size(out) > 0) & (top[last] + 1 >= x[first])
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(out, F.array(F.struct(x[first].alias(first), x[last].alias(last)))))

    return F.aggregate(F.sort_array(runs), empty, step)
