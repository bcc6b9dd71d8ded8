"""Ranks, best rows and limits per key.

``row_number() <= n`` becomes a WindowGroupLimit, so each task keeps at most n
rows per key before the shuffle; ``ranks`` numbers groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierspark.session import as_cols, durable

#: Groups up to this many rows may be sorted by one task.
GROUP_ROWS = 100_000


def top_n(df: DataFrame, keys, order, n: int, rank: str = "rank", remainder: str | None = None) -> DataFrame:
    """First n rows per key under a total order; ``remainder`` counts the rows not shown."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    if remainder:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        top = (
            top.join(sizes, list(keys))
            .withColumn(remainder, F.greatest(F.lit(0).cast("long"), F.col("_size") - n))
            .drop("_size")
        )
    return top


def best_row(df: DataFrame, keys, order) -> DataFrame:
    return top_n(df, keys, order, 1, rank="_best").drop("_best")


def prefer_variant(df: DataFrame, keys, variant: str, preference, then) -> DataFrame:
    """One row per key: variants in the given preference, then the remaining order."""
    place = F.lit(len(preference))
    for i, v in reversed(list(enumerate(preference))):
        place = F.when(F.col(variant) == v, F.lit(i)).otherwise(place)
    return best_row(df, keys, [place.asc(), *then])


def cap_per_key(df: DataFrame, query, secondary, order, m: int | Column, k: int, rank: str = "rank",
                max_m: int | None = None) -> DataFrame:
    """At most m rows per secondary key inside each query, then the first k of the query.

    ``m`` may be a column (a per-row cap); ``max_m`` is then its upper bound.
    """
    bound = m if isinstance(m, int) else max_m
    kept = top_n(df, [*query, *secondary], order, bound, rank="_in_key")
    if not isinstance(m, int):
        kept = kept.filter(F.col("_in_key") <= m)
    return top_n(kept.drop("_in_key"), query, order, k, rank=rank)


def running(df: DataFrame, keys, order, totals: dict[str, Column]) -> DataFrame:
    """``df`` with running sums per key, without bringing a group into one task.

    Rows are range-sorted by (keys, order) into slices, written once; a slice sums its own rows per key, and the sums of
    earlier slices are added as an offset. A sum of ones is a row number.
    """
    keys, names = list(keys), list(totals)
    placed = durable(
        df.withColumns({f"_t_{n}": c for n, c in totals.items()}).repartitionByRange(*as_cols(keys), *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = placed.groupBy("_slice", *keys).agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_slice", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in names]
    )
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_row_{n}": F.sum(f"_t_{n}").over(inside) for n in names})
    match = (F.col("a._slice") == F.col("b._slice"))
    for k in keys:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return (
        summed.alias("a")
        .join(offsets.alias("b"), match)
        .select("a.*", *[F.col(f"b._offset_{n}") for n in names])
        .withColumns({n: F.col(f"_row_{n}") + F.col(f"_offset_{n}") for n in names})
        .drop("_slice", *[f"{p}{n}" for n in names for p in ("_t_", "_row_", "_offset_")])
    )


def ranked(df: DataFrame, keys, order, rank: str = "rank") -> DataFrame:
    """Full row numbers per key without bringing a large group into one task, see ``ranks``."""
    return ranks(df, keys, {rank: order})


def ranks(df: DataFrame, keys, orders: dict, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Row numbers per key for several orders (name: order) from one written copy of ``df``.

    Groups of at most ``group_rows`` rows are numbered by windows that share one shuffle by key, however many orders there are.
    Larger groups, and a number over all rows, are numbered by range-sorted slices, see ``running``.
    """
    keys = list(keys)

    def sliced(rows):
        for name, order in orders.items():
            rows = running(rows, keys, order, {name: F.lit(1)})
        return rows

    if not keys:
        return sliced(df)
    rows = durable(df)
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_rows).select(*keys)
    large = durable(large)
    names = {n: F.row_number().over(Window.partitionBy(*keys).orderBy(*o)).cast("long") for n, o in orders.items()}
    if large.isEmpty():
        return rows.withColumns(names)
    same = None
    for k in keys:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = one if same is None else same & one
    part = lambda how: rows.alias("a").join(large.alias("b"), same, how)
    return part("left_anti").withColumns(names).unionByName(sliced(part("left_semi")))


def sequence_ids(df: DataFrame, order, prefix: str, width: int = 6, name: str = "seq_id") -> DataFrame:
    """Dense ids after a global sort, such as ``claim_000001``."""
    numbered = ranked(df, [], order, rank="_seq")
    return numbered.withColumn(
        name, F.concat(F.lit(prefix), F.lpad(F.col("_seq").cast("string"), width, "0"))
    ).drop("_seq")


def two_pool_pick(df: DataFrame, profile: str, pool: str, code: str, order, per_pool: int = 5,
                  total: int = 10, rank: str = "rank") -> DataFrame:
    """First pool picks ``per_pool`` distinct codes; the second may not repeat a picked one."""
    one_per_code = best_row(df, [profile, pool, code], order)
    first = top_n(one_per_code.filter(F.col(pool) == 1), [profile], order, per_pool, "_pos")
    taken = first.select(profile, code)
    second = top_n(
        one_per_code.filter(F.col(pool) == 2).join(taken, [profile, code], "left_anti"),
        [profile], order, per_pool, "_pos",
    )
    return top_n(first.unionByName(second), [profile], [F.col(pool), F.col("_pos")], total, rank).drop("_pos")


def rank_decay(rank: Column, start: float = 0.96, step: float = 0.025, floor: float = 0.72) -> Column:
    return F.greatest(F.lit(floor), F.lit(start) - F.lit(step) * (rank - 1))


def sort_by_priority(df: DataFrame, priority, seq) -> DataFrame:
    """Global descending sort by a priority tuple; ``seq`` keeps equal rows in input order."""
    return df.orderBy(*[p.desc_nulls_last() for p in priority], *[s.asc_nulls_last() for s in as_cols(seq)])


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def case_order(column: Column, values) -> Column:
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(column == v, F.lit(i)).otherwise(out)
    return out
