"""Embeddings: reduction, text to id, and pooled vectors of entity pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("triplet", "paper", "text")


def reduced(vector: Column, dimension: int) -> Column:
    """The first entries, scaled to length 1; a zero vector stays."""
    head = F.transform(F.slice(vector, 1, dimension), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(head, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def reduce_vectors(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, reduced(F.col(column), dimension))


def last_ids(meta: DataFrame) -> DataFrame:
    """(text, embedding_id, tokens): of a repeated text the last id counts."""
    return meta.groupBy("text").agg(F.max("embedding_id").alias("embedding_id"), F.max_by("tokens", "embedding_id").alias("tokens"))


def text_ids(pair_texts: DataFrame, meta: DataFrame) -> DataFrame:
    """(d, g, kind, pos, embedding_id, tokens): pair texts by embedding; texts without one are missing_texts()."""
    return pair_texts.join(last_ids(meta).select("text", "embedding_id"), "text").select("d", "g", "kind", "pos", "embedding_id", "tokens")


def missing_texts(pair_texts: DataFrame, meta: DataFrame) -> DataFrame:
    return pair_texts.join(meta.select("text").distinct(), "text", "left_anti").select("text").distinct()


def pair_texts(triplets: DataFrame, text: Column, tokens: Column, kind: str) -> DataFrame:
    """Flat (d, g, kind, pos, text, tokens) from any table with mesh and gene."""
    d = triplets.select(F.col("mesh").alias("d"), F.col("gene").alias("g"), F.lit(kind).alias("kind"), text.alias("text"), tokens.alias("tokens")).distinct()
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("d", "g", "kind").orderBy("text")) - 1)


def pooled(items: DataFrame, vectors: DataFrame, weights: dict[str, bool] | None = None) -> DataFrame:
    """(d, g, kind, vector): means per kind, weighted by tokens where weights says so, and kind "one", the first vector of "text".

    A kind without items gives no row; a weight sum of 0 gives nulls, not a division by zero; an item
    without a weight counts nothing. Whole vectors are added up a group in each partition, so a
    group sends one vector a task, however many items it has.
    """
    weights = weights or {"triplet": False, "paper": True, "text": True}
    w = F.lit(1.0)
    for kind, use in weights.items():
        w = F.when(F.col("kind") == kind, F.col("tokens").cast("double") if use else F.lit(1.0)).otherwise(w)
    d = items.join(vectors.select("embedding_id", "embedding"), "embedding_id").withColumn("_w", w)
    kinds = dict(d.dtypes)
    key = ", ".join(f"{c} {kinds[c]}" for c in ("d", "g", "kind"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, float]] = {}
        types = None

        def sent() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in sums], types[i]) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([w for _, w in sums.values()], pa.float64()), pa.array([v for v, _ in sums.values()], pa.list_(pa.float64()))], ["d", "g", "kind", "w", "s"])

        held = 0
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(3)]
            batch = batch.filter(pc.and_(batch.column(3).is_valid(), batch.column(4).is_valid()))
            if not batch.num_rows:
                continue
            places: dict[tuple, int] = {}
            at = np.array([places.setdefault(k, len(places)) for k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0)))
            w = batch.column(3).to_numpy()
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) * w[:, None]
            for k, v, total in zip(places, np.add.reduceat(x[order], first), np.add.reduceat(w[order], first), strict=True):
                if k in sums:
                    sums[k] = (sums[k][0] + v, sums[k][1] + total)
                else:
                    sums[k], held = (v, total), held + v.nbytes
            if held > 1 << 26:
                yield sent()
                sums, held = {}, 0
        if sums:
            yield sent()

    def added(t: pa.Table) -> pa.Table:
        total, w = sum(np.array(v.values) for v in t.column("s")), sum(t.column("w").to_pylist())
        vector = (total / w).tolist() if w else [None] * len(total)
        return pa.table({**{c: t.column(c).slice(0, 1) for c in ("d", "g", "kind")}, "vector": pa.array([vector], pa.list_(pa.float64()))})

    parts = d.select("d", "g", "kind", "_w", F.transform("embedding", lambda x: x.cast("double")).alias("x")).mapInArrow(partial, f"{key}, w double, s array<double>")
    means = parts.groupBy("d", "g", "kind").applyInArrow(added, f"{key}, vector array<double>")
    one = d.where("kind = 'text'").groupBy("d", "g").agg(F.min_by("embedding", "pos").alias("vector")).select("d", "g", F.lit("one").alias("kind"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    return means.unionByName(one)


def vectors_of(pooled_vectors: DataFrame, kind: str) -> DataFrame:
    """(mesh, gene, vector) of one kind, as the rankers take it."""
    return pooled_vectors.where(F.col("kind") == kind).select(F.col("d").alias("mesh"), F.col("g").alias("gene"), "vector")
