"""Records out of files whose format isn't told: CSV with any usual delimiter, JSON arrays, JSON lines.

The format is that of a file, by its lines: an array begins with `[`, lines of objects with `{`, and all of them have to be objects;
anything else is CSV, with the delimiter that its first line has most of. Files of one format (and, for CSV, one header)
are read together by Spark's readers. Values are texts, nulls stay null; empty files have no records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = [",", "\t", ";", "|"]
# Fields that tell the kind of a record when two or more are there, and those that come first in its text.
TYPE_HINTS = {
    "Issue": ["status", "priority", "assignee", "severity"], "Person": ["first_name", "last_name", "email", "phone"], "Product": ["price", "sku", "category", "inventory"],
    "Event": ["start_date", "end_date", "location", "attendees"], "Task": ["due_date", "assignee", "status", "priority"],
}
FIRST = ["name", "title", "label", "id"]
RECORD = "map<string,string>"


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, delimiter, header): one row a file that has anything in it; delimiter and header of CSV only."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    lines = lines.filter(F.trim("value") != "")
    json = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    whole = lines.groupBy("file").agg(F.min_by("value", "n").alias("head"), F.bool_and(json).alias("objects"))
    counts = F.array(*[F.length("head") - F.length(F.replace("head", F.lit(d), F.lit(""))) for d in DELIMITERS])
    best = F.element_at(F.array(*map(F.lit, DELIMITERS)), F.array_position(counts, F.array_max(counts)).cast("int"))
    kind = F.when(F.trim("head").startswith("["), "json_array").when(F.col("objects"), "jsonl").otherwise("csv")
    out = whole.select("file", kind.alias("format"), best.alias("delimiter"), F.col("head").alias("header"))
    return out.withColumns({c: F.when(F.col("format") == "csv", F.col(c)) for c in ("delimiter", "header")})


def record_type(fields: Column) -> Column:
    """The kind with the most of its fields there, two at least; the first of equals; else empty."""
    low = F.transform(fields, F.lower)
    scores = F.array(*[F.size(F.array_intersect(low, F.array(*map(F.lit, hints)))) for hints in TYPE_HINTS.values()])
    best = F.element_at(F.array(*map(F.lit, TYPE_HINTS)), F.array_position(scores, F.array_max(scores)).cast("int"))
    return F.when(F.array_max(scores) >= 2, best).otherwise("")


def record_text(record: Column) -> Column:
    """`key: value` of all fields, names and ids first."""
    entries = F.map_entries(record)
    early = lambda e: F.lower(e["key"]).isin(FIRST)
    shown = lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))
    return F.array_join(F.concat(F.transform(F.filter(entries, early), shown), F.transform(F.filter(entries, lambda e: ~early(e)), shown)), "; ")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, record, record_type, content) of all records below a path."""
    kinds = sniffed(spark, path).groupBy("format", "delimiter", "header").agg(F.collect_list("file").alias("files")).collect()  # names of files, as Spark's own listing has them
    parts = []
    for kind in kinds:
        name = F.col("_metadata.file_path").alias("file")
        if kind["format"] == "jsonl":
            rows = spark.read.text(kind["files"]).select(name, F.from_json("value", RECORD).alias("record")).filter(F.col("record").isNotNull())
        elif kind["format"] == "json_array":
            rows = spark.read.text(kind["files"], wholetext=True).select(name, F.explode(F.from_json("value", f"array<{RECORD}>")).alias("record"))
        else:
            df = spark.read.csv(kind["files"], sep=kind["delimiter"], header=True, multiLine=True)
            pairs = [x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))]
            rows = df.select(name, F.create_map(*pairs).cast(RECORD).alias("record"))
        parts.append(rows.withColumn("format", F.lit(kind["format"])))
    if not parts:
        return spark.createDataFrame([], f"file string, format string, record {RECORD}, record_type string, content string")
    every = reduce(DataFrame.unionByName, parts)
    return every.select("file", "format", "record", record_type(F.map_keys("record")).alias("record_type"), record_text(F.col("record")).alias("content"))
