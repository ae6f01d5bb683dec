"""A durable log of epochs: written aside, made visible by one rename.

An epoch's rows go to a folder of their own under a name nobody else uses; then a
small manifest, written aside too, is renamed to ``_manifests/<epoch>.json``.
Readers see the folders that manifests name, so a run that stops at any point
leaves either a whole epoch or none. Committing an epoch that is there does
nothing, and its rows are not computed: a repeated batch, a stream's or a run's,
is known by its number and the log is never read to find out. One driver writes
a log at a time; tasks may be lost and repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, system = _file(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def committed(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of a log, one small object per epoch, in order."""
    names = [n for n in _names(spark, f"{path}/_manifests") if n.endswith(".json") and not n.startswith("_")]
    if not names:
        return []
    rows = spark.read.text([f"{path}/_manifests/{n}" for n in names], wholetext=True).collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["epoch"])


def commit(rows: DataFrame, path: str, epoch: int, counts: dict[str, Column] | None = None) -> bool:
    """Write ``rows`` as ``epoch``; False where it is there already.

    ``counts`` are aggregates observed while the rows are written, so they cost no
    second pass; they are kept in the manifest.
    """
    spark = rows.sparkSession
    manifest, system = _file(spark, f"{path}/_manifests/{epoch}.json")
    if system.exists(manifest):
        return False
    folder = f"epoch-{epoch}-{uuid.uuid4().hex}"
    seen = Observation()
    wanted = {"rows": F.count(F.lit(1)), **(counts or {})}
    rows.observe(seen, *[c.alias(n) for n, c in wanted.items()]).write.parquet(f"{path}/{folder}")
    held = {"epoch": epoch, "folder": folder, "schema": json.loads(rows.schema.json()), "counts": seen.get}
    aside, _ = _file(spark, f"{path}/_manifests/_{epoch}-{uuid.uuid4().hex}")
    out = system.create(aside, True)
    try:
        out.write(bytearray(json.dumps(held).encode()))
    finally:
        out.close()
    if system.exists(manifest) or not system.rename(aside, manifest):
        system.delete(aside, False)
        return False
    return True


def _folders(spark: SparkSession, path: str, manifests: list[dict], schema: T.StructType) -> DataFrame:
    if not manifests:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{m['folder']}" for m in manifests])


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all committed epochs; ``schema`` is the latest epoch's where none is given."""
    held = committed(spark, path)
    if schema is None:
        if not held:
            raise ValueError(f"no epoch at {path}")
        schema = T.StructType.fromJson(held[-1]["schema"])
    return _folders(spark, path, held, schema)


def once(rows: DataFrame, path: str, epoch: int) -> DataFrame:
    """The rows of one epoch, which are computed only if it is not committed yet."""
    spark = rows.sparkSession
    commit(rows, path, epoch)
    held = [m for m in committed(spark, path) if m["epoch"] == epoch]
    return _folders(spark, path, held, T.StructType.fromJson(held[0]["schema"]))


def sink(path: str, counts: Callable[[], dict[str, Column]] | None = None) -> Callable[[DataFrame, int], None]:
    """A stream's sink: a batch is the epoch of its number, once however often it is sent."""

    def write(batch: DataFrame, number: int) -> None:
        commit(batch, path, number, counts() if counts else None)

    return write


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what stopped runs left unnamed; how many folders that were. Not while the log is written."""
    named = {m["folder"] for m in committed(spark, path)}
    lost = [n for n in _names(spark, path) if n.startswith("epoch-") and n not in named]
    for n in lost:
        remove(spark, f"{path}/{n}")
    return len(lost)


def remove(spark: SparkSession, path: str) -> None:
    where, system = _file(spark, path)
    system.delete(where, True)
