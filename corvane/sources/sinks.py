"""Sinks: JSON lines, positional arrays, vectors, CSV, class trees; and counts observed on the way."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corvane.session import importable
from corvane.sources.float64 import Float64


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def array_lines(df: DataFrame, path: str, columns: Iterable[str], append: bool = False) -> None:
    """One JSON array a line, its elements of different types."""
    cell = lambda c: F.expr(f"substring(to_json(struct(`{c}` as x), map('ignoreNullFields', 'false')), 6, length(to_json(struct(`{c}` as x), map('ignoreNullFields', 'false'))) - 6)")
    line = F.concat(F.lit("["), F.concat_ws(",", *(cell(c) for c in columns)), F.lit("]"))
    df.select(line.alias("value")).write.mode("append" if append else "overwrite").text(path)


def vectors(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def float64_bytes(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The vectors as little-endian float64 bytes, for exports to programs that want those."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, column, pa.array([None if x is None else np.asarray(x, "<f8").tobytes() for x in b.column(i).to_pylist()], pa.binary()))

    schema = ", ".join(f"`{c}` {'binary' if c == column else t}" for c, t in df.dtypes)
    return df.mapInArrow(pack, schema)


def float64_files(df: DataFrame, path: str, dimension: int, append: bool = False) -> None:
    """The column embedding as headerless float64 vectors, a file a partition, in the order of partitions and rows."""
    importable(df.sparkSession)
    df.sparkSession.dataSource.register(Float64)
    df.select("embedding").write.format("float64").mode("append" if append else "overwrite").option("path", path).option("dimension", dimension).save()


def predictions(df: DataFrame, path: str) -> None:
    """(method, mesh, gene, score), a folder a method."""
    df.write.mode("overwrite").partitionBy("method").parquet(path)


def ordered_csv(df: DataFrame, path: str, order: list[Column]) -> None:
    """One CSV with a header in the given order: a report of a few rows, hence one file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("quote", '"').option("escape", '"').csv(path)


def class_tree(samples: DataFrame, path: str) -> None:
    """samples of classes (operators.curation.class_samples), as full and concise CSV below main and sub class."""
    # The headings of the class files.
    cls = [F.concat_ws(" ", F.col("main_id").cast("string"), "main_name").alias("main"), F.concat_ws(" ", F.concat_ws(".", F.col("main_id").cast("string"), F.col("sub_id").cast("string")), "sub_name").alias("sub")]
    full = [F.col("token").alias("key token"), F.col("explanation").alias("key semantics"), F.col("label").alias("pair-in-clinvar"), F.col("mesh").alias("disease"), "gene", F.col("pmid").alias("PMID"), "triplet"]
    for name, columns in (("full", full), ("concise", [F.col("explanation").alias("key semantics"), F.col("pmid").alias("PMID"), "triplet"])):
        samples.select(*cls, *columns).write.mode("overwrite").partitionBy("main", "sub").option("header", True).csv(f"{path}/{name}")


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df and an Observation that holds the counts once an action has run: progress figures at no extra pass."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in counts.items())), seen
