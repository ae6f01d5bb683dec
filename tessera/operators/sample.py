"""Representative samples: random, by length thirds, and by strata.

Draws are ordered by md5 of a seed and the id, so that they are the same on any
partitioning and can be checked in SQL. Quotas and strata follow the counts:
``k // m`` each and one more for the first ``k % m``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import none_if_empty
from ..session import work_path

POOL = 60


def draw(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def quota(rank: Column, k: Column | int, m: Column | int) -> Column:
    """The share of group ``rank`` (from 0) of ``m`` in ``k``."""
    k, m = (F.lit(x) if isinstance(x, int) else x for x in (k, m))
    return F.floor(k / m) + F.when(rank < F.pmod(k, m), 1).otherwise(0)


def random_sample(rows: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``k`` rows, or all of fewer."""
    return rows.orderBy(draw(id_col, seed), id_col).limit(k)


def thirds(rows: DataFrame, length: Column, by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """``third`` (0 short, 1 medium, 2 long): n // 3, n // 3 and the rest, by length.

    With ``by`` the thirds are of each group. Without it ranks are over all rows,
    which only bounded pools should be given; see :func:`global_thirds`.
    """
    keys = by or [F.lit(0)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(length, id_col)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("third", F.least(F.floor(place / F.greatest(F.floor(n / 3), F.lit(1))), F.lit(2)).cast("int")).withColumn(
        "third", F.when(n < 3, 2).otherwise(F.col("third"))
    )


def global_thirds(rows: DataFrame, length: Column, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """The same over any number of rows, of groups of any size: from :func:`places`."""
    placed = places(rows.withColumn("__len", length), "__len", id_col, by, "__of")
    cut = F.floor(F.col("__of") / 3)
    third = F.when(F.col("place") < cut, 0).when(F.col("place") < 2 * cut, 1).otherwise(2)
    return placed.withColumn("third", third.cast("int")).select(*rows.columns, "third")


def places(rows: DataFrame, length_col: str, id_col: str, by: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """``place``: the position (from 0) by length, then id, in its group, of any number of rows.

    The rows are sorted in ranges over group, length and id, and written to the
    shared folder; counts per group and range give each range its offset, so
    neither a group nor a length that a third of all rows share is in one task.
    Ids may be numbers or texts; nulls come first. ``total`` names a column for the
    group's size.
    """
    spark = rows.sparkSession
    order = [*by, length_col, id_col]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    path = work_path(spark, "places")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    keys = [f"__by{i}" for i in range(len(by))]
    parts = placed.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("__part").alias("__range")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "__range", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__base"), F.sum("__n").over(group).alias("__total"))
    same = F.col("__part") == F.col("__range")
    for c, k in zip(by, keys, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    more = [F.col("__total").alias(total)] if total else []
    return placed.join(parts, same).select(*rows.columns, (F.col("__at") + F.col("__base")).alias("place"), *more)


def bottom(rows: DataFrame, keys: list[str], order: list[Column], k: int, parts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group, and ``__rank`` (from 1).

    First of each of ``parts`` parts of a group, then of what those keep, so a
    group that holds a third of all rows is never in one task; the parts' first
    rows are cut before the shuffle where Spark's limit on window groups allows.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    cut = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    cut = cut.withColumn("__rank", first(*keys, "__part")).where(F.col("__rank") <= k).drop("__part")
    return cut.withColumn("__rank", first(*keys)).where(F.col("__rank") <= k)


def diverse_sample(rows: DataFrame, k: int, length: Column, id_col: str = "id", seed: int = 42, pool: int = POOL) -> DataFrame:
    """Shares of ``k`` from the length thirds of a random pool; a short third is not topped up."""
    held = thirds(random_sample(rows, pool, id_col, seed), length, None, id_col)
    rank = F.row_number().over(Window.partitionBy("third").orderBy(draw(id_col, seed + 1), id_col))
    return held.withColumn("__r", rank).where(F.col("__r") <= quota(F.col("third"), k, 3)).drop("__r")


def stratified_sample(
    rows: DataFrame, k: int, primary: Column, secondary: Column, length: Column, id_col: str = "id", seed: int = 42
) -> DataFrame:
    """Shares of ``k`` by sorted primary value.

    Within one: where there are two secondary values or more, one row of each
    first and then any, else length thirds topped up. With fewer than two
    primary values it is a :func:`diverse_sample`. What can be drawn is cut to a
    few times ``k`` rows a stratum by :func:`bottom` before strata are ranked, so
    the size of a stratum is nowhere in one task. An id is drawn once.
    """
    rows = rows.withColumn("__p", none_if_empty(primary)).withColumn("__s", none_if_empty(secondary))
    strata = rows.where("__p is not null").groupBy("__p").agg(F.count_distinct("__s").alias("__levels"))
    strata = strata.withColumn("__m", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("__quota", quota(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__p")) - 1, k, F.col("__m")))
    if strata.limit(2).count() < 2:
        return diverse_sample(rows.drop("__p", "__s"), k, length, id_col, seed)
    held = rows.join(strata, "__p").withColumn("__draw", draw(id_col, seed))
    shuffled = [F.col("__draw"), F.col(id_col)]

    levels = held.where("__levels >= 2")
    lead = bottom(levels.where("__s is not null"), ["__p", "__s"], shuffled, 1).drop("__rank")
    first = bottom(lead, ["__p"], shuffled, k).drop("__rank")
    even = global_thirds(held.where("__levels < 2"), length, id_col, ("__p",))
    share = bottom(even, ["__p", "third"], shuffled, k).where(F.col("__rank") <= quota(F.col("third"), F.col("__quota"), 3))
    chosen = first.unionByName(share.drop("__rank", "third")).withColumn("__first", F.lit(0))
    # Twice k of a stratum hold k that were not chosen, if there are so many.
    rest = bottom(held, ["__p"], shuffled, 2 * k).drop("__rank")
    taken = chosen.select(F.col("__p").alias("__tp"), F.col(id_col).alias("__id"))
    rest = rest.join(taken, (F.col("__p") == F.col("__tp")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    both = chosen.unionByName(rest.withColumn("__first", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__first", *shuffled))
    return both.withColumn("__place", place).where("__place <= __quota").select(*[c for c in rows.columns if c not in ("__p", "__s")])


def extract_samples(rows: DataFrame, k: int, strategy: str, length: Column, primary: Column, secondary: Column, id_col: str = "id", use_stratified: bool = True, seed: int = 42) -> DataFrame:
    """``random`` beats the stratified flag; the flag beats ``diverse``."""
    if strategy == "random":
        return random_sample(rows, k, id_col, seed)
    if use_stratified:
        return stratified_sample(rows, k, primary, secondary, length, id_col, seed)
    return diverse_sample(rows, k, length, id_col, seed)


def extract_all(tables: dict[str, DataFrame | None], **options) -> dict[str, DataFrame | None]:  # noqa: ANN003
    """Samples of every dataset; one that is missing stays missing."""
    return {name: None if rows is None else extract_samples(rows, **options) for name, rows in tables.items()}
