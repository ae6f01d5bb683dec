"""Scans: JSON arrays with stable positions, JSONL logs, older logs, design files."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import choices, ground_truth
from ..functions.text import text
from ..operators.stats import renamed_case
from ..plans import registry


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where it is missing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def _in_lines(spark: SparkSession, path: str, schema: T.StructType, head: str, tail: str) -> DataFrame | None:
    """Elements ``r`` of files that have one a line, with ``file`` and their order ``at``; None where a file is laid out otherwise.

    Such a file is a first line like ``head``, elements with a comma between two,
    and a last line that ends the JSON which ``tail`` (a text ahead of it) begins.
    It is read in as many tasks as it has blocks.
    """
    spec = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    lines = lines.where("value <> ''").withColumns({"body": F.trim("value", F.lit(", \t\r")), "at": F.monotonically_increasing_id()})
    lines = lines.withColumn("r", F.when(F.col("body").startswith("{") & F.col("body").endswith("}"), F.from_json("body", spec, {"columnNameOfCorruptRecord": "_bad"})))
    element = F.col("r").isNotNull() & F.col("r._bad").isNull()
    kind = F.when(element, "element").when(F.col("value").rlike(head), "head").when(F.get_json_object(F.concat(F.lit(tail), "value"), "$.r") == "[]", "tail").otherwise("other")
    comma = lambda at: F.count_if(element & at)
    per = lines.groupBy("file").agg(
        (F.count_if(~element) == 2).alias("two"),
        ((F.min_by(kind, "at") == "head") & (F.max_by(kind, "at") == "tail")).alias("ends"),
        (comma(F.col("value").startswith(",")) + comma(F.col("value").endswith(",")) == F.count_if(element) - 1).alias("commas"),
    )
    if not per.agg(F.bool_and(F.col("two") & F.col("ends") & F.col("commas"))).first()[0]:
        return None
    return lines.where(F.col("body").startswith("{") & F.col("body").endswith("}")).select("file", F.col("r").dropFields("_bad").alias("r"), "at")


def json_array(spark: SparkSession, path: str, schema: T.StructType = registry.RECORD, position: str = "pos") -> DataFrame:
    """Elements of files that each hold one JSON array, with their 0-based position.

    The schema is given: inference would drop a column that is always empty. Files
    with an element a line are read in parts, others whole.
    """
    held = _in_lines(spark, path, schema, r"^\[$", '{"r": [') if "_bad" not in schema.names else None
    if held is None:
        whole = spark.read.text(path, wholetext=True)
        parsed = F.from_json("value", T.ArrayType(schema))
        return whole.select(F.posexplode(parsed).alias(position, "r")).select(position, "r.*")
    held = held.drop("at").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    # Blocks of a file are read in its order; each begins where those before it end.
    parts = held.groupBy("file", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("file").alias("__file"), F.col("__part").alias("__block"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__base"))
    placed = held.join(parts, (F.col("file") == F.col("__file")) & (F.col("__part") == F.col("__block")))
    return placed.select((F.col("__at") + F.col("__base")).cast("int").alias(position), "r.*")


_OLD = T.StructField("phase1_correct", T.BooleanType())


def _parsed_as(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, _OLD]) if "scaffolding_correct" in schema.names else schema


def _current(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of either form as the current one: the verdict's new name, the cases' new names."""
    if "scaffolding_correct" not in schema.names:
        return rows
    correct = F.coalesce(F.col("scaffolding_correct") | F.col("phase1_correct"), "scaffolding_correct", "phase1_correct")
    return rows.withColumns({"sft_case": renamed_case(F.col("sft_case"), correct), "scaffolding_correct": correct}).select(*schema.names)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = registry.RESULT) -> DataFrame:
    """Parsable lines of a log; blank ones are passed over, malformed ones are for :func:`rejected`."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return accepted(checked(spark.read.text(path), schema), schema)


def checked(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Each line that is not blank with its parsed row ``r``, null where it is malformed; works on a stream too."""
    spec = T.StructType([*_parsed_as(schema).fields, T.StructField("_bad", T.StringType())])
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", spec, {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.withColumn("r", F.when(F.col("r._bad").isNull(), F.col("r").dropFields("_bad")))


def accepted(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The good rows of :func:`checked` lines."""
    return _current(lines.where("r is not null").select("r.*"), schema)


def rejected(lines: DataFrame) -> DataFrame:
    """The malformed ones of :func:`checked` lines, as they are."""
    return lines.where("r is null").drop("r")


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file, the block of it that a task read, and their place (from 0) in that block."""
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("__at"))
    first = lines.groupBy(F.col("file").alias("__f"), F.col("block").alias("__b")).agg(F.min("__at").alias("__first"))
    met = lines.join(first, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")))
    return met.select("value", "file", "block", (F.col("__at") - F.col("__first")).alias("line"))


_LOG_HEAD = r'^\{"(scaffolding|phase1)_results": ?\[$'


def json_log(spark: SparkSession, path: str, schema: T.StructType = registry.RESULT) -> DataFrame:
    """Rows of a finished log: its results, or those of the older form under their current names.

    A log with a result a line is read in parts, any other whole.
    """
    kind = _parsed_as(schema)
    held = T.StructType([T.StructField("scaffolding_results", T.ArrayType(kind)), T.StructField("phase1_results", T.ArrayType(kind))])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = _in_lines(spark, path, kind, _LOG_HEAD, '{"r": [')
    if rows is None:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", held).alias("r"))
        rows = whole.select(F.explode(F.coalesce("r.scaffolding_results", "r.phase1_results")).alias("r"))
    return _current(rows.select("r.*"), schema)


def log_end(spark: SparkSession, path: str) -> str | None:
    """What a finished log says of its completeness, from its last line where it has a result a line."""
    if _in_lines(spark, path, T.StructType([T.StructField("id", T.StringType())]), _LOG_HEAD, '{"r": [') is None:
        said = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.is_complete").alias("c"))
    else:
        last = F.concat(F.lit('{"r": ['), F.trim("value"))
        said = spark.read.text(path).where(F.trim("value").startswith("]")).select(F.get_json_object(last, "$.is_complete").alias("c"))
    row = said.first()
    return row and row["c"]


def any_log(spark: SparkSession, path: str, schema: T.StructType = registry.RESULT) -> DataFrame:
    """The line log beside ``path`` if there is one, else the finished log."""
    lines = path.removesuffix(".json") + ".jsonl"
    return json_lines(spark, lines, schema) if exists(spark, lines) else json_log(spark, path, schema)


def questions(records: DataFrame, dataset: str, split: str, position: str = "pos") -> DataFrame:
    """Records as questions: id from the position, truth, choices; missing fields are empty."""
    output = text(F.col("output"))
    return records.select(
        F.lit(dataset).alias("dataset"),
        F.concat(F.lit(f"{dataset}_{split}_"), F.col(position).cast("string")).alias("question_id"),
        text(F.col("instruction")).alias("instruction"),
        text(F.col("input")).alias("question"),
        F.lit(registry.answer_type(registry.domain_of(dataset) or "math", dataset)).alias("answer_type"),
        ground_truth(output).alias("ground_truth"),
        output.alias("ground_truth_formatted"),
        choices(text(F.col("input"))).alias("choices"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.col(position).alias("pos"),
    )


def load(
    spark: SparkSession, path: str, dataset: str, split: str, limit: int | None = None, shuffle_seed: int | None = None
) -> DataFrame:
    """Questions of a file: shuffled if a seed is given, then limited (0 or None: all)."""
    allowed = {n for d in registry.DOMAINS.values() for n in (d.train if split == "train" else d.evaluate)}
    if dataset not in allowed:
        raise ValueError(f"unknown {split} dataset: {dataset}")
    got = questions(json_array(spark, path), dataset, split)
    order = F.col("pos") if shuffle_seed is None else F.md5(F.concat(F.lit(f"{shuffle_seed}:"), F.col("question_id")))
    if shuffle_seed is None and not limit:
        return got  # ``pos`` has the order
    return got.orderBy(order).limit(limit) if limit else got.orderBy(order)


def projected(questions: DataFrame) -> DataFrame:
    """What a run takes of each question; the whole output where metadata has it, else the truth."""
    full = F.try_element_at("metadata", F.lit("full_output"))
    return questions.select(
        F.col("question_id").alias("id"),
        F.coalesce(F.try_element_at("metadata", F.lit("instruction")), F.lit("")).alias("instruction"),
        F.col("question").alias("input"),
        F.coalesce(full, "ground_truth_formatted").alias("output"),
    )


def load_split(spark: SparkSession, base: str, domain: str, split: str, dataset: str | None = None, limit: int | None = None) -> DataFrame:
    """Train needs a dataset; test takes the domain's first evaluation set unless told."""
    if split == "train" and dataset is None:
        raise ValueError("training data needs a dataset")
    name = dataset or next(iter(registry.DOMAINS[domain].evaluate))
    return load(spark, f"{base}/{domain}/{split}/data/{name}_{split}.json", name, split, limit)


def enhanced_files(spark: SparkSession, base: str, dataset: str | None = None, suffix: str = "_train_enhanced.json") -> DataFrame:
    """Enriched files below a folder, by dataset."""
    wanted = registry.enhanced_name(dataset or "*", suffix)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).load(base)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", F.left(name, F.length(name) - len(suffix)).alias("dataset"))


def load_enhanced(spark: SparkSession, path: str, dataset: str, limit: int | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """Questions of an enriched file, whose metadata carries the design constants."""
    return load(spark, path, dataset, "train", limit, shuffle_seed)


def design(spark: SparkSession, path: str) -> dict | None:
    """A one-object design file; None where it is missing or unreadable."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except Exception:  # noqa: BLE001  a lookup that must not fail
        return None


def instructional_goal(spark: SparkSession, path: str) -> str | None:
    held = design(spark, path) or {}
    return none_or(held.get("instructional_goal"))


def none_or(value: object) -> str | None:
    return str(value) if value else None


def records_per_file(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("n"))


def stem(path: str) -> str:
    return PurePosixPath(path).stem


def raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A raw dataset as given locally, Parquet or JSON by its ending."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not path.endswith(".jsonl"))
