"""Readers of nested documents: feature collections, paged responses and hourly weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>,exceededTransferLimit:boolean>"


def geojson_features(docs: DataFrame, column: str = "content") -> DataFrame:
    """The other columns and each feature's place, geometry type, coordinates as JSON, and properties.

    Documents that are null, malformed or hold no features give no rows.
    """
    parsed = docs.withColumn("_doc", F.from_json(F.col(column).cast("string"), FEATURES, {"mode": "PERMISSIVE"}))
    rows = parsed.select(*[c for c in docs.columns if c != column], F.posexplode("_doc.features").alias("feature_no", "_f"))
    return rows.select("*", F.col("_f.geometry.type").alias("geometry_type"), F.col("_f.geometry.coordinates").alias("coordinates"), F.col("_f.properties").alias("properties")).drop("_f")


def paged_documents(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Stored pages of a paged source: path, length, sha256 and content, one row a page."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return pages.select("path", "length", F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("content"))


def pagination_report(pages: DataFrame) -> DataFrame:
    """Pages, features, and whether the last page says that more would follow."""
    parsed = pages.select("path", F.from_json("content", FEATURES).alias("d")).select("path", F.coalesce(F.size("d.features"), F.lit(0)).alias("n"), F.coalesce("d.exceededTransferLimit", F.lit(False)).alias("more"))
    return parsed.agg(F.count("*").alias("pages"), F.sum("n").alias("features"), F.bool_or("more").alias("any_exceeded"), F.max_by("more", "path").alias("last_exceeded"))


def hourly_weather(docs: DataFrame, column: str, variables: list[str]) -> DataFrame:
    """Rows of hours from a document with parallel arrays: the other columns, ``time`` and each variable."""
    schema = f"struct<hourly:struct<time:array<string>,{','.join(f'{v}:array<double>' for v in variables)}>>"
    parsed = docs.withColumn("_h", F.from_json(column, schema)["hourly"])
    zipped = F.arrays_zip(*[F.col(f"_h.{c}").alias(c) for c in ("time", *variables)])
    rows = parsed.select(*[c for c in docs.columns if c != column], F.explode(zipped).alias("_r"))
    return rows.select(*[c for c in docs.columns if c != column], *[F.col(f"_r.{c}").alias(c) for c in ("time", *variables)])


def paged_features(pages: DataFrame, source: str, offset: str, page_size: int, max_pages: int) -> DataFrame:
    """Features of paged responses (source, offset, content): pages up to the first short one that announces no more.

    A page at or beyond ``max_pages`` is not read, which ``capped`` says of its source.
    """
    parsed = pages.withColumn("_doc", F.from_json("content", FEATURES))
    n = F.coalesce(F.size("_doc.features"), F.lit(0))
    ends = (n < page_size) & ~F.coalesce(F.col("_doc.exceededTransferLimit"), F.lit(False))
    last = parsed.groupBy(source).agg(F.min(F.when(ends, F.col(offset))).alias("_last"))
    limit = F.lit(max_pages * page_size)
    kept = parsed.join(last, source, "left").filter((F.col(offset) <= F.coalesce("_last", limit)) & (F.col(offset) < limit))
    rows = kept.select(source, offset, F.coalesce(F.col("_last") >= limit, F.lit(True)).alias("capped"), F.posexplode("_doc.features").alias("feature_no", "_f"))
    return rows.select(source, offset, "feature_no", "capped", F.col("_f.geometry.coordinates").alias("coordinates"), F.col("_f.properties").alias("properties"))


#: Cells in a word of a packed row; the sign's bit stays free.
WORD = 63


def pack_rows(cells: DataFrame, row: list[str], col: str, flag: str) -> DataFrame:
    """Words of bits of raster rows of any width: which cells of a word are there, and which have the flag."""
    bit = F.expr(f"shiftleft(1L, CAST(pmod({col}, {WORD}) AS INT))")
    return cells.groupBy(*row, F.floor(F.col(col) / WORD).alias("word")).agg(F.bit_or(bit).alias("there"), F.bit_or(F.when(F.col(flag), bit).otherwise(F.lit(0).cast("long"))).alias("bits"))


def unpack_rows(packed: DataFrame, row: list[str], col: str, flag: str) -> DataFrame:
    """The cells of packed raster rows."""
    cells = packed.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).filter("(shiftright(there, _bit) & 1) = 1")
    return cells.select(*row, (F.col("word") * WORD + F.col("_bit")).alias(col), F.expr("(shiftright(bits, _bit) & 1) = 1").alias(flag))


def stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of :func:`driftline.sources.sinks.write_documents` as bytes: key, length, sha256 and content."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).filter("length > 0").withColumn("_line", F.expr("instr(CAST(content AS STRING), '\\n')"))
    # the key's line and the line end that the writer adds are no part of a document
    size, content = F.col("length") - F.col("_line") - 1, F.expr("substring(content, _line + 1, length(content) - _line - 1)")
    return read.select(F.expr("nullif(url_decode(CAST(substring(content, 1, _line - 1) AS STRING)), '')").alias("key"), size.alias("length"), F.sha2(content, 256).alias("sha256"), content.alias("content"))
