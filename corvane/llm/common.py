"""What several corpus operators share: tables, intermediate results, connected components."""

from __future__ import annotations

import atexit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import keep, shared_dir, table

__all__ = ["table", "keep", "shared_dir", "arrow_batches", "components", "join_by_class", "released", "without", "LETTERS_UP", "LETTERS_LOW", "words_of", "once", "alnum_words_of"]

LETTERS_UP, LETTERS_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def drop_at_exit(spark: SparkSession, name: str) -> None:
    """Drops a table in the warehouse when the application ends."""

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass

    atexit.register(drop)


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds an Arrow batch by rows and by bytes (16 MB), since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def released(run):
    """run, a function over Arrow batches; when a task's rows end, memory that its worker no longer uses goes back to the system, for workers wait for more tasks."""

    def released_(batches):
        yield from run(batches)
        import ctypes

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return released_


def once(column):
    """The column, evaluated once where it stands.

    Catalyst copies a deterministic expression into its readers, into lambdas too, where it would
    run once an element. spark_partition_id() is stable but counts as nondeterministic, so what
    holds it stays in its own projection.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def words_of(text):
    """Column: the maximal runs of [^\\x20\\x09-\\x0D], in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def alnum_words_of(text):
    """Column: A-Z lowered, then the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), LETTERS_UP, LETTERS_LOW)
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


#: A class that holds more than this share of the rows is joined by broadcast; there are fewer classes than its inverse.
HEAVY = 1 / 512


def join_by_class(rows: DataFrame, per: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with per, which has each key once and counts its rows in _n (left out of the result); total: at least the sum of _n.

    The rows of a heavy class stay where they are and meet their class by broadcast: at most
    1 / HEAVY rows of per, whatever the input. The others are joined by key, and no key among them
    is heavy, so no task is. per is written first, so that the plan has the first part only if there
    are heavy classes.
    """
    per = keep(per, "per_class")
    heavy = per.where(F.col("_n") > total * HEAVY).drop("_n")
    if heavy.isEmpty():
        return rows.join(per.drop("_n"), key)
    heavy = F.broadcast(heavy)
    light = rows.join(heavy.select(key), key, "left_anti").join(per.where(F.col("_n") <= total * HEAVY).drop("_n"), key)
    return light.unionByName(rows.join(heavy, key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating stars: edges (a, b) -> (node, root), root the smallest.

    Only nodes that some edge has appear. Each round writes its edges to the shared folder, so a
    lost executor costs a read; rounds go on until the edges no longer change. Nothing but two sums
    a round reaches the driver. Minima are aggregated before the shuffle, and the hub of a large
    star is joined by broadcast (join_by_class), so its edges spread over tasks.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = (e.count(), None)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("_n"))
        large = join_by_class(both.where("b > a"), low, "a", mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        e2 = join_by_class(large, low2, "a", mark[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = keep(e2.where("a <> b").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now


#: Rows of a key set that are broadcast at most; each takes some 100 bytes on an executor.
BROADCAST_ROWS = 300_000


def few(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df, which must be cheap to count, has few enough rows to be broadcast."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has few rows; else left to the planner, which shuffles both sides. The result is the same."""
    return F.broadcast(df) if few(df, rows) else df


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose (doc_id, xxhash64 of the text) is not among keys (_id, _th). Ids may be null; keys must be kept."""
    whole = docs.select(F.struct(*docs.columns).alias("_d"))  # so no column can clash
    same = F.col("_d.doc_id").eqNullSafe(keys["_id"]) & (F.xxhash64("_d.text") == keys["_th"])
    return whole.join(bounded(keys), same, "left_anti").select("_d.*")
