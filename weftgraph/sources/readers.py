"""Files and tables to DataFrames, and graph interchange formats to nodes and edges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, encoding: str = "UTF-8", skip_rows: int = 0, schema: str | None = None) -> DataFrame:
    """skip_rows leaves out the first lines of each file, by their place in it."""
    options = {"sep": delimiter, "header": str(header).lower(), "encoding": encoding}
    if not skip_rows:
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).csv(path)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), F.input_file_name().alias("f"))
    first = lines.groupBy("f").agg(F.min("n").alias("first"))
    kept = lines.join(first, "f").filter(F.col("n") - F.col("first") >= skip_rows + (1 if header else 0))
    names = schema or ", ".join(f"`{c}` STRING" for c in _header(lines, skip_rows, delimiter, header))
    return kept.select(F.from_csv("value", F.lit(names), {"sep": delimiter}).alias("r")).select("r.*")


def _header(lines: DataFrame, skip_rows: int, delimiter: str, header: bool) -> list[str]:
    row = lines.orderBy("f", "n").limit(skip_rows + 1).collect()[-1]["value"].split(delimiter)
    return row if header else [f"_c{k}" for k in range(len(row))]


def read_json(spark: SparkSession, path: str, at: str | None = None, array: bool = False, flat: bool = False, schema: str | None = None) -> DataFrame:
    """at: a dotted path to an array of records in it; flat: structs become columns."""
    reader = spark.read.option("multiLine", str(array or bool(at)).lower())
    df = (reader.schema(schema) if schema else reader).json(path)
    if at:
        df = df.select(F.explode(F.col(at)).alias("r")).select("r.*")
    return flattened(df) if flat else df


def flattened(df: DataFrame) -> DataFrame:
    """Struct fields as columns parent_child, however deep."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df


def read_xml(spark: SparkSession, path: str, row: str) -> DataFrame:
    return spark.read.option("rowTag", row).xml(path)


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of all text files below a folder."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_jdbc(spark: SparkSession, connection: str, query: str | None = None, table: str | None = None, batch_size: int = 1000) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", connection).option("fetchsize", batch_size)
    return reader.option("query", query).load() if query else reader.option("dbtable", table).load()


def load(spark: SparkSession, kind: str, path: str, options: dict) -> DataFrame:
    """What a LOAD statement reads."""
    if kind == "CSV":
        return read_csv(spark, path, options.get("delimiter", ","), options.get("header", True), options.get("encoding", "UTF-8"), int(options.get("skip_rows", 0)))
    if kind == "JSON":
        return read_json(spark, path, options.get("path"), bool(options.get("array_mode", False)), bool(options.get("flatten", False)))
    if kind == "XML":
        return read_xml(spark, path, options.get("root_path", "row"))
    if kind in ("FOLDER", "DOCUMENT"):
        return read_folder(spark, path, options.get("filter", "*"))
    if kind == "SQL":
        return read_jdbc(spark, path, options.get("query"), options.get("table"), int(options.get("batch_size", 1000)))
    if kind == "API":
        from weftgraph.sources.pages import read_pages

        starts = json.loads(path) if path.startswith("[") else [path]
        named = {k: str(options[k]) for k in ("items", "next", "method", "headers", "params") if k in options}
        return read_pages(spark, starts, options.get("schema"), paged=str(options.get("pagination", True)).lower(), **named)
    if kind == "RECORDS":
        from weftgraph.sources.records import read_records

        return read_records(spark, path)
    if kind in ("PARQUET", "ORC"):
        return spark.read.format(kind.lower()).load(path)
    raise ValueError(f"no reader for {kind}")


def parse_records(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines (column value) to records; unreadable lines give null columns."""
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def turns(chats: DataFrame, messages: str = "messages", chat: str = "chat_id") -> DataFrame:
    """(chat, turn, role, text) from rows with an array of (role, text)."""
    return chats.select(F.col(chat), F.posexplode(messages).alias("turn", "m")).select(chat, "turn", "m.role", "m.text")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, data), (source, target, data) of a GraphML file; data maps keys to texts."""
    data = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())]))
    node = T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", data)])
    edge = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), T.StructField("data", data)])
    as_map = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data")
    nodes = spark.read.option("rowTag", "node").schema(node).xml(path).select(F.col("_id").alias("id"), as_map)
    edges = spark.read.option("rowTag", "edge").schema(edge).xml(path).select(F.col("_source").alias("source"), F.col("_target").alias("target"), as_map)
    return nodes, edges


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, literal) of N-Triples lines."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:\S+)|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
    part = lambda k: F.regexp_extract("value", pattern, k)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    df = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return df.select(bare(part(1)).alias("subject"), part(2).alias("predicate"), F.when(part(3) != "", bare(part(3))).alias("object"), F.when(part(3) == "", part(4)).alias("literal"))


def jsonld(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object): links by @id of the records of a JSON-LD array."""
    rows = spark.read.text(path, wholetext=True)
    records = rows.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("r"))
    flat = records.select(F.col("r")["@id"].alias("subject"), F.explode("r").alias("predicate", "v")).filter(~F.col("predicate").startswith("@"))
    return flat.select("subject", "predicate", F.coalesce(F.get_json_object("v", "$.@id"), "v").alias("object"))


def write_graph(graph, folder: str) -> None:
    """Nodes and edges as Parquet, a directory for each label and type."""
    for label, df in graph.nodes.items():
        df.write.mode("overwrite").parquet(f"{folder}/nodes/label={label}")
    for kind, e in graph.edges.items():
        e.df.write.mode("overwrite").parquet(f"{folder}/edges/type={kind}")


def latest_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert of time series: the row with the largest order for each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")
