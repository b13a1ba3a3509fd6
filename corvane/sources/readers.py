"""Scans of the record formats: JSON objects, positional arrays and strings, CSV, float64 blocks, class folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.session import importable, keep
from corvane.sources.float64 import Float64


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def numbered(spark: SparkSession, path: str, first: int = 1, name: str = "line_no") -> DataFrame:
    """(name, value): the lines of text files in order, the files by their paths.

    A line's place is its split's, by file and offset, and its place within the split. The splits are
    counted first, a row a task; their prefix sums are sent to the second scan, which has the same splits.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
    splits = lines.groupBy("_f", "_b").agg(F.min("_n").alias("_at"), F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))  # over splits, not lines
    base = keep(splits.select("_f", "_b", (F.coalesce(before, F.lit(0)) - F.col("_at") + first).alias("_base")), "splits")
    return lines.join(F.broadcast(base), ["_f", "_b"]).select((F.col("_n") + F.col("_base")).alias(name), "value")


def numbered_objects(spark: SparkSession, path: str, schema: str, first: int = 1, name: str = "dgp_id") -> DataFrame:
    """JSON objects with their 1-based line number."""
    rows = numbered(spark, path, first, name)
    return rows.select(name, F.from_json("value", schema).alias("r")).select(name, "r.*")


def line_range(df: DataFrame, start: int, end: int, name: str = "dgp_id") -> DataFrame:
    return df.where(F.col(name).between(start, end))


def item(i: int) -> Column:
    """Element i of a line that holds a JSON array of mixed types, as JSON text."""
    return F.get_json_object("value", f"$[{i}]")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, mesh, gold array<string>, ann map<gene, map<feature, text>>) from [mesh, [gold], {gene: {feature: value}}] lines."""
    rows = numbered(spark, path)
    return rows.select("line_no", item(0).alias("mesh"), F.from_json(item(1), "array<string>").alias("gold"), F.from_json(item(2), "map<string,map<string,string>>").alias("ann"))


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, h, r, t, d, g, v, mesh, gene, names) from [pmid, [h, r, t], {id: {name: n}} x 3] lines.

    mesh and gene are the first ids in document order, which from_json keeps; names are all disease and gene names.
    """
    rows = spark.read.text(path)
    part = lambda i: F.from_json(item(i), schemas.NESTED)
    d = rows.select(item(0).alias("pmid"), F.from_json(item(1), "array<string>").alias("hrt"), part(2).alias("d"), part(3).alias("g"), part(4).alias("v"))
    return with_first_ids(d.select("pmid", F.col("hrt")[0].alias("h"), F.col("hrt")[1].alias("r"), F.col("hrt")[2].alias("t"), "d", "g", "v"))


def with_first_ids(d: DataFrame) -> DataFrame:
    names = lambda m: F.flatten(F.transform(F.map_values(m), F.map_keys))
    return d.withColumns({"mesh": F.get(F.map_keys("d"), F.lit(0)), "gene": F.get(F.map_keys("g"), F.lit(0)), "names": F.array_distinct(F.concat(names("d"), names("g")))})


def json_strings(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(text_id, text) from lines that are JSON strings."""
    rows = numbered(spark, path, first, "text_id")
    return rows.select("text_id", F.expr("variant_get(parse_json(value), '$', 'string')").alias("text"))


def delimited(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """CSV with doubled quotes; an empty field is the empty string, as it was written."""
    df = spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def annotation_log(spark: SparkSession, path: str) -> DataFrame:
    """(token, value, at) from CSV files without header, appended over time; at orders lines by when they came."""
    rows = spark.read.schema(schemas.TWO_COLUMNS).option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)
    at = F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return rows.select("token", F.coalesce("value", F.lit("")).alias("value"), at.alias("at"))


def float64_blocks(spark: SparkSession, path: str, dimension: int, first: int = 0, tail: str = "error", partition: int | None = None) -> DataFrame:
    """(embedding_id, embedding) from headerless little-endian float64 vectors, a file or a folder of files; tail says what becomes of bytes beyond whole vectors."""
    importable(spark)
    spark.dataSource.register(Float64)
    read = spark.read.format("float64").option("path", path).option("dimension", dimension).option("first", first).option("tail", tail)
    return (read if partition is None else read.option("partition", partition)).load()


def template(spark: SparkSession, path: str) -> str:
    """A prompt template; one small file, read where the driver is."""
    return spark.read.text(path, wholetext=True).first()[0]


def class_folder(spark: SparkSession, path: str) -> DataFrame:
    """(main_pos, main_id, main_name, sub_id, sub_name, pos, token, explanation) from files "N name.ext" of blocks.

    main_pos, sub_id and pos tell the order: files by name, blocks and lines as they come. A block is a [name] line and token,explanation lines (the first comma divides); blank lines end blocks.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.url_decode(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), "\\+", "%2B")), "^(.*)$", 1).alias("file"), "value")
    files = files.withColumn("main_pos", F.row_number().over(Window.orderBy("file")) - 1)  # a row a class file
    head = files.select("main_pos", F.regexp_extract("file", "^(\\d+)\\s", 1).alias("n"), F.regexp_extract("file", "^\\d+\\s(.*?)(?:\\.[^.]*)?$", 1).alias("main_name"), F.split(F.regexp_replace("value", "\r\n?", "\n"), "\\n[\\s]*\\n").alias("blocks"))
    whole = F.assert_true(F.col("n") != "", F.lit("a class file must be named: number, space, name"))
    block = head.select("main_pos", F.col("n"), "main_name", whole.alias("_1"), F.posexplode(F.filter("blocks", lambda b: F.trim(b) != "")).alias("i", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    block = block.select("main_pos", F.col("n").cast("int").alias("main_id"), "main_name", (F.col("i") + 1).alias("sub_id"), lines.alias("lines"), "_1")
    headed = F.assert_true(F.col("lines")[0].startswith("[") & F.col("lines")[0].endswith("]"), F.lit("a block must begin with [name]"))
    rows = block.select("main_pos", "main_id", "main_name", "sub_id", F.expr("substring(lines[0], 2, length(lines[0]) - 2)").alias("sub_name"), F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("pos", "line"), headed.alias("_2"), "_1")
    comma = F.assert_true(F.instr("line", ",") > 0, F.lit("a class line must be token,explanation"))
    out = rows.select("main_pos", "main_id", "main_name", "sub_id", "sub_name", "pos", F.substring_index("line", ",", 1).alias("token"), F.expr("substring(line, instr(line, ',') + 1)").alias("explanation"), comma.alias("_3"), "_1", "_2")
    return out.where("_1 is null and _2 is null and _3 is null").drop("_1", "_2", "_3")
