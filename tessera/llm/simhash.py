"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

A text's fingerprint has a bit set where over half of its shingles' XXH64
values do. For radius r every bit position gets a non-zero vector of r + 1 bits;
table v, for each of the 2^(r+1) - 1 non-zero vectors v, keeps the positions
whose vector has odd overlap with v. Up to r differing positions span at most r
dimensions, so some v is orthogonal to all of them, and in that table the two
fingerprints collide: every pair within the radius meets, none is missed.

Equal fingerprints are one row from the start. A bucket with over ``bucket``
distinct fingerprints is covered a second time by the positions that its table
leaves free; then at most 2^12 can agree (for 64 bits and radius 2; 2^16 for
radius 5), so no task gathers an unbounded group, and nothing is capped. Within a bucket, distances
are compared in numpy blocks and one link to the least member of each connected
part comes out, never all pairs.

Defined cases: a null text counts as empty; one without a word has fingerprint
zero and is linked like any other; very long texts are hashed whole, one at a
time; a bit set in exactly half of the shingles is not set, and fingerprints that
tie are one; a null id takes the class of its fingerprint
but never names one (a class of null ids alone has a null id); repeated rows
share a class; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes
from .components import connected

BITS = 64
SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(data: bytes, width: int) -> Iterator[bytes]:
    """Lower-cased word shingles, repeats included; fewer words make one."""
    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < width:
        yield joined
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    for s, e in zip(starts, (ends[width - 1 :] - 1).tolist()):
        yield joined[s:e]


def fingerprint(data: bytes, width: int = 3) -> int:
    digest = xxhash.xxh64_intdigest
    hashes = [digest(s, SEED) for s in shingles(data, width)]
    if not hashes:
        return 0
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        counts = np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS
        out |= int(np.packbits(2 * counts > len(hashes), bitorder="little")[0]) << (8 * k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col), text_bytes(text_col).alias("__text"))
    schema = rows.select(id_col).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=schema.names)

    return rows.mapInArrow(run, schema)


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are all outside some mask."""
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        mask = 0
        for k, position in enumerate(positions):
            if bin((k % n + 1) & v).count("1") & 1:
                mask |= 1 << position
        masks.append(mask)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """``fp, t, k``: every fingerprint under every mask."""
    each = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(each).alias("__k")).select("fp", "__k.t", "__k.k")


def _inner_keys(masks: list[int], radius: int):
    """``fp, t, k`` of crowded buckets under the masks of what table ``t`` leaves free: adds ``t2, k2``."""
    table = np.array([covering_masks(radius, [p for p in range(BITS) if not m >> p & 1]) for m in masks], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = table.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp, t, k = (batch.column(i).slice(at, 4096).to_numpy() for i in range(3))
                k2 = fp.view(np.uint64)[:, None] & table[t]
                t2 = np.tile(np.arange(n, dtype=np.int32), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(fp, n), np.repeat(t, n), np.repeat(k, n), t2, k2.ravel().view(np.int64))], names=["fp", "t", "k", "t2", "k2"])

    return run


def _linked(values: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """For each value the least index connected to it by distances up to ``radius``."""
    label = np.arange(len(values))
    while True:
        before = label.copy()
        for k in range(0, len(values), block):
            near = np.bitwise_count(values[k : k + block, None] ^ values[None, :]) <= radius
            label[k : k + block] = np.where(near, label[None, :], len(values)).min(axis=1)
        if (label == before).all():
            return label


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for held in batch.column(0):
                values = np.sort(held.values.to_numpy())
                label = _linked(values.view(np.uint64), radius)
                linked = label != np.arange(len(values))
                a.append(values[linked])
                b.append(values[label[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [np.zeros(0, np.int64)])), pa.array(np.concatenate(b or [np.zeros(0, np.int64)]))], names=["a", "b"])

    return run


def _links(fps: DataFrame, radius: int, bucket: int) -> DataFrame:
    masks = covering_masks(radius, list(range(BITS)))
    # Fingerprints are few bytes and their keys many: so many tasks make them, and by
    # the size before the explode the planner would send all keys through the driver.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(fps.select("fp").repartition(parts, "fp"), masks)
    sizes = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.hint("merge").join(sizes.hint("merge"), ["t", "k"])
    small = met.where(F.col("n") <= bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("v")).select("v")
    large = met.where(F.col("n") > bucket).select("fp", "t", "k").mapInArrow(_inner_keys(masks, radius), "fp long, t int, k long, t2 int, k2 long")
    large = large.groupBy("t", "k", "t2", "k2").agg(F.collect_list("fp").alias("v")).where(F.size("v") > 1).select("v")
    return small.union(large).mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, bucket: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, hex fingerprint, and the least id of its class."""
    found = materialize(fingerprints(docs, id_col, text_col, width).withColumnRenamed(id_col, "__id"), "simhash")
    fps = found.groupBy("fp").agg(F.min("__id").alias("least"))
    classes = connected(_links(fps, radius, bucket))
    named = fps.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    # Written first: else the count of a large class and its join share a stage, and one of its tasks.
    names = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-names")
    by_fp = materialize(named.join(names, "label").select("fp", "component_id"), "simhash-classes")
    return found.join(by_fp, "fp").select(
        F.col("__id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
