"""The corpus pipeline: quality rules, language, near copies, repeats, packing.

Each stage takes what its predecessor kept, is written as Parquet and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, line_rules, packing, simhash, suffix_dedup
from tessera.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failed lines.

    Null, empty and wordless texts fail; repeated rows and ties are judged each alike.
    """
    return line_rules.clean(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with calibrated confidence.

    Null texts and those without a letter go; repeated rows are judged alike; of
    equal scores the first label in order wins; without a labelled row none stays.
    """
    model = langid.fit(docs)
    row = docs.select(F.struct("*").alias("__row"), "doc_id", "text")
    got = langid.predict(row, model, carried={"__row": F.col("__row")})
    return got.where("accepted").select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the one with the least id and text hash.

    Fingerprints are of five-word shingles and link at 5 or fewer differing bits
    of 64, which is what texts of a similarity of 0.8 or more mostly are apart.
    Rows without an id come after those with one. Of rows with one id and one
    text one stays; rows that share an id and differ in text are documents of
    their own. Texts without a word are one class; an empty table stays empty.
    """
    nameless = F.col("doc_id").isNull()
    key = F.struct(nameless.alias("nameless"), F.when(~nameless, F.col("doc_id")).otherwise(0).alias("id"), F.xxhash64("text").alias("text"))
    rows = docs.withColumn("__key", key)
    classes = simhash.near_duplicates(rows, id_col="__key", width=5, radius=5)
    kept = classes.where("__key = component_id").select("__key").distinct()
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


#: A repeated passage: so many words or more, which take no fewer bytes than this.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that occur twice.

    Stretches covered by strings of 200 bytes that occur elsewhere, in this or
    another document, are narrowed to whole words and go where 50 words remain;
    all occurrences go, the first included. Fifty words of fewer bytes, under 4 a
    word with its space, are not looked for. Every row stays: null and short
    texts as they are, repeated rows without what they repeat.
    """
    return suffix_dedup.clean(docs, PASSAGE_BYTES, least_words=PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place.

    A null text is one piece of one id; repeated rows are packed one by one; of
    pieces of one length, which are alike to the packing, the input's order decides.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality rules", quality),
    ("language id", language),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("best-fit packing", pack),
]

#: Fingerprints, embeddings and fitted patterns have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
