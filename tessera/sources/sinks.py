"""Sinks: distributed JSON lines, single-array exports at the edge, logs and their end."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..plans import registry
from .records import any_log, exists, json_array, json_lines, log_end


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """One small file, over what was there; folders are made."""
    where, system = _path(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def write_object(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows to a log folder of JSON lines."""
    rows.write.mode("append").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_lines(rows: DataFrame, path: str) -> None:
    """JSON lines over a folder that stays whole until the new one is written: the old one steps aside before the rename and goes after it."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").json(f"{path}.new")
    swap(spark, f"{path}.new", path)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts a finished file or folder in the place of an old one, which is never deleted first."""
    source, system = _path(spark, new)
    place, old = _path(spark, path)[0], _path(spark, f"{path}.old")[0]
    if system.exists(place):
        system.delete(old, True)
        system.rename(place, old)
    if not system.rename(source, place):
        raise OSError(f"could not rename {new}")
    system.delete(old, True)


def write_joined(rows: DataFrame, path: str, head: str, tail: str, order: str | None = None) -> None:
    """One file of ``head``, a line of JSON for each row with commas between, and ``tail``.

    Tasks write the lines, in ranges where an order is given, as parts below
    ``path`` with a comma ahead of every row but the first. The parts are then
    appended to one another as bytes by the file system's own copy, with a buffer
    of fixed size: no row is sent to the driver.
    """
    spark = rows.sparkSession
    parts, system = _path(spark, f"{path}.parts")
    rows = rows.orderBy(order) if order else rows
    rows.select(F.concat(F.lit(","), F.to_json(F.struct("*"))).alias("value")).write.mode("overwrite").text(f"{path}.parts", compression="none")
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = system.create(_path(spark, path)[0], True)
    try:
        out.write(bytearray(head.encode()))
        first = True
        for part in sorted((x for x in system.listStatus(parts) if x.getLen() and x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName()):
            held = system.open(part.getPath())
            try:
                if first:
                    held.seek(1)  # its comma
                    out.write(bytearray(b"\n"))
                    first = False
                copy(held, out, 1 << 20, False)
            finally:
                held.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    system.delete(parts, True)


def export_array(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON array file, an element a line."""
    write_joined(rows, path, "[", "]\n", order)


def write_samples(rows: DataFrame, base: str, domain: str, dataset: str, order: str | None = None) -> str:
    """A drawn sample in its place below ``base``; returns the file's path."""
    path = f"{base}/{domain}/train/data/{dataset}_samples.json"
    export_array(rows, path, order)
    return path


def write_enriched(records: DataFrame, folder: str, dataset: str, order: str | None = None, suffix: str = "_train_enhanced.json") -> str:
    """Enriched records under the name their reader looks for; returns the file's path."""
    path = f"{folder}/{registry.enhanced_name(dataset, suffix)}"
    export_array(records, path, order)
    return path


def _write_log(rows: DataFrame, path: str, summary: dict) -> None:
    """A finished log over what was there, a result a line."""
    write_joined(rows, f"{path}.part", '{"scaffolding_results": [', f'], "statistics": {json.dumps(summary)}, "is_complete": true}}')
    swap(rows.sparkSession, f"{path}.part", path)


def write_meta(rows: DataFrame, path: str, complete: bool = False) -> None:
    """The small file beside a log: its statistics and whether the run is complete."""
    summary = stats.case_statistics(rows).first().asDict()
    write_object(rows.sparkSession, path.removesuffix(".json") + "_meta.json", {"statistics": summary, "is_complete": complete})


def finalise(spark: SparkSession, path: str, state: DataFrame | None = None) -> str:
    """End a run: the line log becomes the final log and goes with its meta file;
    without one, the final log's statistics are renewed; without either, ``state``
    is written, or no result where there is none.

    Returns which of the three it was. Counters are recomputed from rows with
    distinct ids, so a line written twice counts once.
    """
    lines = path.removesuffix(".json") + ".jsonl"
    if exists(spark, lines):
        kind, rows = "lines", json_lines(spark, lines)
    elif exists(spark, path):
        kind, rows = "final", any_log(spark, path)
    else:
        kind, rows = "state", spark.createDataFrame([], registry.RESULT) if state is None else state
    _write_log(rows, path, stats.case_statistics(rows).first().asDict())
    if kind == "lines":
        for one in (lines, path.removesuffix(".json") + "_meta.json"):
            where, system = _path(spark, one)
            system.delete(where, True)
    return kind


def finished(spark: SparkSession, path: str, training: str) -> bool:
    """Whether a run has nothing left to do: both results are there, no line log, and it is marked complete."""
    if exists(spark, path.removesuffix(".json") + ".jsonl") or not (exists(spark, path) and exists(spark, training)):
        return False
    return log_end(spark, path) == "true"


def evaluations(rows: DataFrame, path: str) -> None:
    """Evaluation results as one file per run, written once for a batch and not after every question."""
    export_array(rows, path, "question_id")


def prior_evaluations(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """Results of an earlier evaluation, to be resumed; none where there is no file."""
    return json_array(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema).withColumn("pos", F.lit(0))
