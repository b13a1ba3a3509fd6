"""Leave-one-disease-out rankers: ridge regression by moments, and runs of both rankers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.boosting import lambdamart_loo
from corvane.session import keep


#: Columns of a tile of a Gram matrix, and tiles that a task adds up at a time.
TILE, FAN = 512, 16


def _tiles(gram: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The upper triangle of a symmetric matrix in tiles."""
    for i in range(0, len(gram), TILE):
        for j in range(i, len(gram), TILE):
            yield i // TILE, j // TILE, np.ascontiguousarray(gram[i : i + TILE, j : j + TILE]).tobytes()


def _square(t: pa.Table, size: int) -> np.ndarray:
    """The matrix of its tiles (i, j, m)."""
    out = np.zeros((size, size))
    for i, j, m in zip(t.column("i").to_pylist(), t.column("j").to_pylist(), t.column("m").to_pylist(), strict=True):
        a, b = slice(i * TILE, min(size, (i + 1) * TILE)), slice(j * TILE, min(size, (j + 1) * TILE))
        out[a, b] = np.frombuffer(m).reshape(a.stop - a.start, -1)
        out[b, a] = out[a, b].T
    return out


def _added(tiles: DataFrame, parts: int, *by: str) -> DataFrame:
    """(by.., i, j, m) from (by.., part, i, j, m): tiles are added FAN at a time, so a task's memory does not grow with their number."""
    kinds = dict(tiles.dtypes)
    key = [*by, "i", "j"]

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(len(t.column("m")[0].as_py()) // 8)
        for m in t.column("m"):
            total += np.frombuffer(m.as_buffer())
        return pa.table({**{c: t.column(c).slice(0, 1) for c in [*key, "part"]}, "m": pa.array([total.tobytes()], pa.binary())})

    while parts > 1:
        parts = -(-parts // FAN)
        tiles = tiles.withColumn("part", F.expr(f"part div {FAN}").cast("int"))
        tiles = tiles.groupBy(*key, "part").applyInArrow(add, ", ".join(f"{c} {kinds[c]}" for c in [*key, "part"]) + ", m binary")
    return tiles.drop("part")


def _rows(y: pa.Array, x: pa.Array, size: int) -> np.ndarray:
    """Ones, features, labels: what a Gram matrix is of."""
    y, x = y.to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
    return np.column_stack([np.ones(len(y)), x.reshape(len(y), size - 2), y])


def ridge_loo(matrix: DataFrame, alpha: float = 1.0, column: str = "vector", most_rows: int | None = None) -> DataFrame:
    """(mesh, gene, score) from (mesh, gene, y, vector): each disease is scored by a ridge fitted on all others.

    With an intercept that isn't penalized; null diseases are one more disease, a vector may not hold
    nulls. The Gram matrix of all rows is summed a task, and over tasks tile by tile. Let P be the inverse
    of its centred part plus alpha. A disease of at most `most_rows` rows (as many as columns, if not
    given) is a correction of low rank to it: with Z its centred rows, H = 1/n + Z P Z' and e its
    residuals in the fit of all rows, its scores without itself are y - (I - H)^-1 e, one system of its own
    size. A larger one has more rows than the matrix has columns, so the tiles of its own Gram matrix,
    of parts of as many rows, are no more than the rows: they are added, taken from the total, and the
    solution is joined to its rows, which stay spread over tasks. Nothing held grows with the rows or tasks.
    """
    spark, kinds = matrix.sparkSession, dict(matrix.dtypes)
    mesh, gene = kinds["mesh"], kinds["gene"]
    data = keep(matrix.select("mesh", "gene", F.col("y").cast("double").alias("y"), F.transform(column, lambda x: x.cast("double")).alias("x")), "ridge")
    seen = data.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n")).first()
    if not seen["n"]:
        return data.select("mesh", "gene", F.lit(0.0).alias("score"))
    size, total_rows = seen["d"] + 2, seen["n"]
    most_rows = most_rows or max(64, size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gram = None
        for batch in batches:
            a = _rows(batch.column(0), batch.column(1), size)
            gram = a.T @ a if gram is None else np.add(gram, a.T @ a, out=gram)
        for i, j, m in _tiles(gram) if gram is not None else ():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([m], pa.binary())], ["part", "i", "j", "m"])

    def inverse(t: pa.Table) -> pa.Table:
        gram = _square(t, size)
        n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
        cov = gram[1:, 1:] - n * np.outer(mean, mean)
        p = np.linalg.inv(cov[:-1, :-1] + alpha * np.eye(size - 2))
        said = {"gram": gram, "p": p, "mean": mean, "b": p @ cov[:-1, -1]}
        return pa.table({"what": pa.array(list(said)), "m": pa.array([v.tobytes() for v in said.values()], pa.binary())})

    sums = data.select("y", "x").mapInArrow(partial, "part int, i int, j int, m binary")
    tiles = _added(sums, data.rdd.getNumPartitions())
    got = {r["what"]: np.frombuffer(r["m"]) for r in tiles.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(inverse, "what string, m binary").collect()}  # d x d numbers, whatever the rows
    held = spark.sparkContext.broadcast({"gram": got["gram"].reshape(size, size), "p": got["p"].reshape(size - 2, size - 2), "mean": got["mean"], "b": got["b"]})

    def own_size(t: pa.Table) -> pa.Table:
        fit, a = held.value, _rows(t.column("y").combine_chunks(), t.column("x").combine_chunks(), size)
        n, y = fit["gram"][0, 0], a[:, -1]
        if len(y) == total_rows:
            score = np.zeros(len(y))
        else:
            z = a[:, 1:-1] - fit["mean"][:-1]
            e = y - fit["mean"][-1] - z @ fit["b"]
            score = y - np.linalg.solve(np.eye(len(y)) - 1 / n - z @ fit["p"] @ z.T, e)
        return pa.table({"mesh": t.column("mesh"), "gene": t.column("gene"), "score": pa.array(score)})

    counts = keep(data.groupBy("mesh").agg(F.count("*").alias("rows")), "sizes")
    of = data.join(counts.withColumnRenamed("mesh", "_m"), F.col("mesh").eqNullSafe(F.col("_m"))).drop("_m")
    out = of.where(F.col("rows") <= most_rows).groupBy("mesh").applyInArrow(own_size, f"mesh {mesh}, gene {gene}, score double")
    largest = counts.agg(F.max("rows")).first()[0]
    if largest <= most_rows:
        return out

    def own_gram(t: pa.Table) -> pa.Table:
        a = _rows(t.column("y").combine_chunks(), t.column("x").combine_chunks(), size)
        lines = list(_tiles(a.T @ a))
        one = t.select(["mesh", "part"]).take([0] * len(lines))
        return pa.table({"mesh": one.column("mesh"), "part": one.column("part"), "i": pa.array([x[0] for x in lines], pa.int32()), "j": pa.array([x[1] for x in lines], pa.int32()), "m": pa.array([x[2] for x in lines], pa.binary())})

    def without(t: pa.Table) -> pa.Table:
        rest = held.value["gram"] - _square(t, size)
        n, d = rest[0, 0], size - 2
        if n < 0.5:
            base, slope = 0.0, np.zeros(d)
        else:
            mean = rest[0, 1:] / n
            cov = rest[1:, 1:] - n * np.outer(mean, mean)
            slope = np.linalg.solve(cov[:d, :d] + alpha * np.eye(d), cov[:d, d])
            base = float(mean[d] - mean[:d] @ slope)
        return pa.table({"mesh": t.column("mesh").slice(0, 1), "base": pa.array([base]), "slope": pa.array([slope.tolist()])})

    parts = -(-largest // most_rows)
    large = of.where(F.col("rows") > most_rows)
    dealt = large.withColumn("part", F.pmod(F.xxhash64("gene", "y"), F.ceil(F.col("rows") / most_rows)).cast("int")).drop("rows", "gene")
    grams = _added(dealt.groupBy("mesh", "part").applyInArrow(own_gram, f"mesh {mesh}, part int, i int, j int, m binary"), parts, "mesh")
    fit = keep(grams.groupBy("mesh").applyInArrow(without, f"mesh {mesh}, base double, slope array<double>"), "folds")
    dot = F.aggregate(F.zip_with("x", "slope", lambda x, b: x * b), F.col("base"), lambda a, x: a + x)
    return out.unionByName(large.join(fit.withColumnRenamed("mesh", "_mesh"), F.col("mesh").eqNullSafe(F.col("_mesh"))).select("mesh", "gene", dot.alias("score")))


def run_ridge(gold: DataFrame, evidence: DataFrame, vectors: DataFrame, alpha: float = 1.0, method: str = "ridge") -> tuple[DataFrame, DataFrame]:
    """Predictions of the pairs that have a vector, and their mean average precision and recall. Diseases without vectors drop out."""
    from corvane.operators.evidence import co_paper_gold, labelled
    from corvane.operators.metrics import mean_ap_recall

    out = ridge_loo(labelled(gold, evidence).join(vectors.select("mesh", "gene", "vector"), ["mesh", "gene"]), alpha).withColumn("method", F.lit(method))
    return out, mean_ap_recall(out, co_paper_gold(gold, evidence))


def run_lambdamart(gold: DataFrame, evidence: DataFrame, odds: DataFrame, vectors: DataFrame | None, dimension: int, method: str = "lambdamart", **options) -> tuple[DataFrame, DataFrame]:
    """Predictions from evidence features, scaled features and vectors, and their mean average precision and recall."""
    from corvane.operators.evidence import co_paper_gold, feature_matrix
    from corvane.operators.metrics import mean_ap_recall

    out = lambdamart_loo(feature_matrix(gold, evidence, odds, vectors, dimension), **options).withColumn("method", F.lit(method))
    return out, mean_ap_recall(out, co_paper_gold(gold, evidence))
