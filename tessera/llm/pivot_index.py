"""Near-duplicate vectors through a pivot-permutation index (Amato and Savino, 2008).

Each vector is described by its ``near`` nearest of up to ``max_pivots``
reference vectors, in order. Vectors that nearly coincide order the pivots
nearly alike, so the index retrieves pairs of one label that share at least
``share`` of their pivots, or have the nearest one in common, through inverted
lists of pivots, and verifies each by cosine in double precision. The index is
approximate only in that count: README.md has the measured recall.

A pair that shares ``share`` of ``near`` pivots shares one among the first
``near - share + 1`` of them in any fixed order (rarest first here), so a vector
is posted under those only, and a pair is counted in the list of its first
common one alone. Long lists are cut into blocks of at most about ``block``
vectors and each pair of blocks is a group of its own; inside, counts and cosines
are matrix products, and what comes out is each vector's number of links and one
link to the least member of its connected part, never all pairs. Pairs that
share fewer pivots, but the nearest, are counted in a list of that one.

Equal vectors of one label are one row with a multiplicity from the start. The
reference vectors are spread out: of a sample of bounded size, drawn by a hash of
the vector for each length of vector apart, the one farthest from those taken is
next, until all are within a cosine of ``spread`` of one. So a group of near
copies, however large, holds one or two of them, and its members meet in their
list. Every vector is indexed.

Defined cases: a vector that is null, empty or zero, or holds a null or
non-finite component, or has a null label, links with nothing and is its own
class, as is one of another length than any other; repeated rows link with each
other; rows with a null id link but never name a class that has another id; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import connected


def pivot_count(n: int, least: int = 64, most: int = 1024) -> int:
    """About the square root of the number of vectors, a power of two."""
    return min(most, max(least, 1 << math.ceil(math.log2(max(1, math.isqrt(n))))))


def spread_out(x: np.ndarray, most: int, spread: float) -> np.ndarray:
    """At most ``most`` of the unit vectors, each the farthest from those before it."""
    taken, close = [0], x @ x[0]
    while len(taken) < min(most, len(x)):
        k = int(close.argmin())
        if close[k] >= spread:
            break
        taken.append(k)
        close = np.maximum(close, x @ x[k])
    return x[taken]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Binary rows of doubles as unit vectors."""
    if not len(column):
        return np.zeros((0, dim))
    x = np.frombuffer(b"".join(v.as_py() for v in column), "<f8").reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(rows: DataFrame, vector_col: str) -> DataFrame:
    """``__vec``: the vector scaled by its largest component, as bytes; null where unusable."""
    names = rows.drop(vector_col).columns
    schema = rows.drop(vector_col).schema.add("__vec", "binary").add("__dim", "integer")
    double = rows.select(*names, F.col(vector_col).cast("array<double>").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors: list[bytes | None] = []
            dims: list[int | None] = []
            for value in batch.column(len(names)):
                one = None
                if value.is_valid and len(value.values) and value.values.null_count == 0:
                    x = value.values.to_numpy()
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        one = x / top + 0.0  # no squared component over- or underflows; no negative zero
                vectors.append(None if one is None else one.astype("<f8").tobytes())
                dims.append(None if one is None else len(one))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(vectors, pa.binary()), pa.array(dims, pa.int32())], names=schema.names)

    return double.mapInArrow(run, schema)


def _described(reps: DataFrame, pivots: dict[int, np.ndarray], near: int) -> DataFrame:
    """Adds ``near``, the numbers of the nearest pivots of the vector's length, in order."""
    shipped = reps.sparkSession.sparkContext.broadcast(pivots)
    names = reps.columns
    schema = T.StructType([*reps.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
    at, dim_at = names.index("__vec"), names.index("__dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(dim_at).to_numpy()
            out: list[list[int]] = [[] for _ in range(len(dims))]
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for k in range(0, len(rows), 4096):
                    some = rows[k : k + 4096]
                    close = _matrix(batch.column(at).take(pa.array(some)), dim) @ shipped.value[int(dim)].T
                    order = np.argsort(-close, axis=1, kind="stable")[:, :near]
                    for i, o in zip(some, order.tolist()):
                        out[i] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return reps.mapInArrow(run, schema)


def _compare(threshold: float, share: int):
    """Counts and links of one pair of blocks of one list."""
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rid")
        one = lambda name: table.column(name).combine_chunks() if table.num_rows else pa.array([])
        if table.num_rows < 2:
            return schema.empty_table()
        rid, side, weight = (table.column(c).to_numpy() for c in ("rid", "side", "weight"))
        unit = _matrix(one("__vec"), int(table.column("__dim")[0].as_py()))
        ranked = np.array(table.column("order").to_pylist(), np.int64)
        place, pivot = int(table.column("place")[0].as_py()), np.unique(ranked)
        member = np.zeros((len(rid), len(pivot)), np.float32)
        np.put_along_axis(member, np.searchsorted(pivot, ranked), 1.0, axis=1)
        # Prefix pivots ahead of this list's: a pair with one in common is counted there.
        prefix = ranked[:, : max(1, ranked.shape[1] - share + 1)]
        earlier = np.zeros_like(member)
        ahead = prefix < place
        rows = np.repeat(np.arange(len(rid)), prefix.shape[1])[ahead.ravel()]
        earlier[rows, np.searchsorted(pivot, prefix.ravel()[ahead.ravel()])] = 1.0
        same = bool(table.column("bi")[0].as_py() == table.column("bj")[0].as_py())
        enough = member @ member.T >= min(share, ranked.shape[1])
        # Negative places are the lists of nearest pivots.
        linked = enough & (earlier @ earlier.T == 0) if place >= 0 else ~enough
        linked &= unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if not same:
            linked &= side[:, None] != side[None, :]
        links = linked @ weight
        label = np.arange(len(rid))
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], len(rid)).min(axis=1))
            if (least == label).all():
                break
            label = least
        found = np.flatnonzero(links)
        return pa.table([pa.array(rid[found]), pa.array(links[found].astype(np.int64)), pa.array(rid[label[found]])], schema=schema)

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    near: int = 8,
    share: int = 4,
    max_pivots: int = 1024,
    block: int = 1500,
    sampled: int = 8,
    spread: float = 0.7,
) -> DataFrame:
    """One row per row of ``vectors``: id, number of links, least id of its class, kept."""
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).alias("__v"))
    rows = materialize(_packed(rows, "__v"), "vectors")
    usable = F.col("__vec").isNotNull() & F.col("__label").isNotNull()
    reps = rows.where(usable).groupBy("__label", "__dim", "__vec").agg(F.count("*").alias("weight"), F.min("__id").alias("least"))
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "vector-reps")

    pivots: dict[int, np.ndarray] = {}
    for row in reps.groupBy("__dim").count().orderBy("__dim").collect():
        most = pivot_count(row["count"], most=max_pivots)
        sample = reps.where(F.col("__dim") == row["__dim"]).orderBy(F.xxhash64("__vec"), "rid").limit(sampled * most).select("__vec").collect()
        x = np.frombuffer(b"".join(bytes(r[0]) for r in sample), "<f8").reshape(len(sample), -1)
        pivots[row["__dim"]] = spread_out(x / np.linalg.norm(x, axis=1, keepdims=True), most, spread)
    described = materialize(_described(reps, pivots, near), "vector-pivots")

    # Rarest first; at most max_pivots counts for each vector length.
    counts = described.select("__dim", F.explode("near").alias("p")).groupBy("__dim", "p").count().collect()
    rank: dict[int, dict[int, int]] = {}
    for row in sorted(counts, key=lambda r: (r["__dim"], r["count"], r["p"])):
        held = rank.setdefault(row["__dim"], {})
        held[row["p"]] = len(held)
    shipped = described.sparkSession.sparkContext.broadcast(rank)

    @F.pandas_udf("array<int>")
    def by_rarity(dims, pivots_of):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([sorted(shipped.value[d][p] for p in ps) for d, ps in zip(dims, pivots_of)])

    posted = described.select("rid", "__label", "__dim", "__vec", "weight", "near", by_rarity("__dim", "near").alias("order"))
    prefix = F.slice("order", F.lit(1), F.greatest(F.size("order") - (share - 1), F.lit(1)))
    places = F.explode(F.concat(prefix, F.array(-1 - F.get("near", F.lit(0))))).alias("place")
    lists = posted.select("__label", "__dim", places)
    posted = posted.select("rid", "__label", "__dim", "__vec", "weight", "order", places)
    lists = lists.groupBy("__label", "__dim", "place").agg(F.count("*").alias("n")).where("n > 1").select("*", F.ceil(F.col("n") / block).cast("int").alias("blocks")).drop("n")
    posted = posted.join(lists, ["__label", "__dim", "place"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    paired = posted.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "*", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.col("own").alias("side")
    )
    grouped = paired.select("rid", "__label", "__dim", "__vec", "weight", "order", "place", "bi", "bj", "side").groupBy("__label", "__dim", "place", "bi", "bj")
    found = materialize(grouped.applyInArrow(_compare(threshold, share), "rid long, links long, root long"), "vector-links")

    direct = found.groupBy("rid").agg(F.sum("links").alias("direct"))
    classes = connected(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    named = reps.join(direct, "rid", "left").join(classes, F.col("rid") == F.col("node"), "left").select(
        "__label", "__dim", "__vec", "least", (F.coalesce("direct", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rid").alias("label")
    )
    named = materialize(named, "vector-classes")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(names, "label").select("__label", "__dim", "__vec", "n_links", "component_id")
    out = rows.where(usable).join(named, ["__label", "__dim", "__vec"]).select("__id", "n_links", "component_id")
    alone = rows.where(~usable).select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    return out.union(alone).select(F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True)).alias("kept"))
