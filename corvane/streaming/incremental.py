"""Structured Streaming: outputs as they arrive become matched triplets, merged by key, exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane import schemas
from corvane.operators import ore
from corvane.session import discard, exists, keep, remove


def output_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Model outputs appended to a folder of JSON lines."""
    return spark.readStream.schema(schemas.MODEL_OUTPUT).option("maxFilesPerTrigger", files).json(folder)


TRIPLET = ("head_pos", "choice", "pos", "h", "r", "t", "mesh_names", "gene_names", "is_match")


def matched_triplets(stream: DataFrame, papers: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Parses and matches each batch and merges it into the table below target, which latest() reads.

    The table has a row a (dgp_id, head), with all of its triplets, in buckets by hash of the key. A
    batch reads, merges and writes only the buckets that it has keys of, under its own number; then it
    notes which those are. Of a key the output that ended last stays, of those that ended at once the
    one that came last, so late ones change nothing and repeated ones replace. A batch that is run again
    starts from the notes before it and replaces what it wrote. Bucket versions that two later ones
    have replaced are removed.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        new = keep(_keyed(papers, df, buckets).withColumn("batch", F.lit(number).cast("bigint")), "batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most all buckets
        noted = _notes(spark, target, number)
        old = _read(spark, target, {b: noted[b][-1] for b in touched if b in noted}, new.schema)
        both = (old.unionByName(new) if old is not None else new).groupBy("bucket", "dgp_id", "head").agg(F.max_by(F.struct("ended", "batch", "triplets"), F.struct("ended", "batch")).alias("r"))
        both.select("bucket", "dgp_id", "head", "r.*").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/table/batch={number}")
        new.select("bucket").distinct().coalesce(1).write.mode("overwrite").json(f"{target}/notes/batch={number}")
        for b in touched:
            for version in noted.get(b, [])[:-1]:
                remove(spark, f"{target}/table/batch={version}/bucket={b}")
        discard(new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed(papers: DataFrame, outputs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, dgp_id, head, ended, triplets): a row a key of the outputs, those without triplets too."""
    rows = ore.parse(ore.raw(papers, outputs))
    ended = outputs.groupBy("dgp_id", "head").agg(F.max("request_end_time").alias("ended")).join(papers.select("dgp_id"), "dgp_id", "left_semi")
    got = ore.match(ore.facts(rows)).groupBy("dgp_id", "head").agg(F.array_sort(F.collect_list(F.struct(*TRIPLET))).alias("triplets"))
    bucket = F.pmod(F.xxhash64("dgp_id", "head"), F.lit(buckets)).cast("int").alias("bucket")
    return ended.join(got, ["dgp_id", "head"], "left").select(bucket, "dgp_id", "head", "ended", "triplets")


def _notes(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """Of each bucket the batches that wrote it, in order; one line a batch and bucket."""
    if not exists(spark, f"{target}/notes"):
        return {}
    d = spark.read.schema("bucket int, batch bigint").json(f"{target}/notes")
    d = d if before is None else d.where(F.col("batch") < before)
    return {r["bucket"]: r["b"] for r in d.groupBy("bucket").agg(F.sort_array(F.collect_set("batch")).alias("b")).collect()}


def _read(spark: SparkSession, target: str, versions: dict[int, int], shape) -> DataFrame | None:
    if not versions:
        return None
    paths = [f"{target}/table/batch={v}/bucket={b}" for b, v in versions.items()]
    inner = [f for f in shape if f.name != "bucket"]
    d = spark.read.schema(type(shape)(inner)).parquet(*paths)
    return d.withColumn("bucket", F.regexp_extract(F.col("_metadata.file_path"), "bucket=(\\d+)", 1).cast("int"))


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The triplets as they stand: of each (dgp_id, head) those of the output that ended last, none if it had none."""
    shape = spark.createDataFrame([], "bucket int, dgp_id bigint, head string, ended string, batch bigint, triplets array<struct<head_pos:int,choice:int,pos:int,h:string,r:string,t:string,mesh_names:array<string>,gene_names:array<string>,is_match:boolean>>")
    d = _read(spark, target, {b: v[-1] for b, v in _notes(spark, target).items()}, shape.schema)
    d = shape if d is None else d
    return d.select("dgp_id", "head", F.explode("triplets").alias("t")).select("dgp_id", "head", "t.*")


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Windowed counts and sums of an event stream, late rows dropped by watermark."""
    w = F.window("ts", size)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
