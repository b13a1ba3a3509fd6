"""Running sums, top rows and exact percentiles of groups of any size, none of which one task holds.

Rows are dealt by range of (group, order), so a large group spreads over as many tasks as its share of
the rows asks for; what a task needs to know of the others is one sum a (group, task). An order is a
list of columns, "-name" for a falling one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import keep


def _sorted(order: list[str]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _same(by: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]


def running(df: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """df and, by name, the sum of each column over the row's group up to and with the row.

    Rows are sorted by range partition and written once; sums within (group, partition) get those of
    the group's earlier partitions. Rows that tie lie in one partition, in no certain order, so an
    order that should be reproducible ends in a key. Nulls are a group, and order as Spark orders them.
    """
    marked = df.select("*", *(c.alias(f"_v{n}") for n, c in sums.items()))
    dealt = keep(marked.repartitionByRange(*(F.asc(c) for c in by), *_sorted(order)).withColumn("_p", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy(*by, "_p").agg(*(F.sum(f"_v{n}").alias(f"_t{n}") for n in sums))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a group's partitions, not its rows
    base = ends.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_p").alias("_q"), *(F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_b{n}") for n in sums))
    within = Window.partitionBy(*by, "_p").orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select(*df.columns, "_p", *(F.sum(f"_v{n}").over(within).alias(f"_s{n}") for n in sums))
    return local.join(base, [*_same(by), F.col("_p") == F.col("_q")]).select(*df.columns, *((F.col(f"_s{n}") + F.col(f"_b{n}")).alias(n) for n in sums))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df and the row's place in its group, from 1."""
    return running(df, by, order, **{name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))


def first_rows(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first so many rows of each group: of each part of it first, so the last step sees most x parts of them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*_sorted(order)))
    some = df.withColumn("_part", F.pmod(F.xxhash64(*(c.lstrip("-") for c in order)), F.lit(parts))).withColumn("_n", number(*by, "_part")).where(F.col("_n") <= most)
    return some.drop("_part").withColumn("_n", number(*by)).where(F.col("_n") <= most).drop("_n")


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by.., name..): the exact percentiles of value in each group, between two values in proportion; nulls don't count.

    Equal values are counted first. Of the running counts only the rows at the two ranks that a
    percentile lies between are taken on, so no list of a group's values is ever made.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = running(counts, by, [value], _c=F.col("_n"))
    total = counts.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by))).agg(F.sum("_n").alias("_all"))
    place = {n: p * (F.col("_all") - 1) for n, p in shares.items()}
    holds = lambda r: (F.col("_c") - F.col("_n") <= r) & (r < F.col("_c"))
    low, high = ({n: holds(f(r).cast("long")) for n, r in place.items()} for f in (F.floor, F.ceil))
    wanted = F.lit(False)
    for test in (*low.values(), *high.values()):
        wanted = wanted | test
    at = run.join(total, _same(by)).where(wanted) if by else run.crossJoin(F.broadcast(total)).where(wanted)  # without groups: one row
    ends = at.groupBy(*by).agg(F.max("_all").alias("_all"), *(F.max(F.when(t[n], F.col(value).cast("double"))).alias(f"_{s}{n}") for s, t in (("l", low), ("h", high)) for n in shares))
    share = lambda n, r: F.when(F.floor(r) == F.ceil(r), F.col(f"_l{n}")).otherwise((F.ceil(r) - r) * F.col(f"_l{n}") + (r - F.floor(r)) * F.col(f"_h{n}"))
    return ends.select(*by, *(share(n, r).alias(n) for n, r in place.items()))
