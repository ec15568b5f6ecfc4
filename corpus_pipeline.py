"""Five stages from raw documents to token ids; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftgraph.llm import bpe, mixing, nearcopies, pii, quality
from weftgraph.llm.queries_mixing import with_tree
from weftgraph.llm.queries_pii import KEY
from weftgraph.llm.shared import shared_folder, written

#: Tokens to draw against those there are; leaves that are short of their share repeat up to EPOCHS times.
SHARE, EPOCHS, SEED = (1, 1), 4, 11
#: A tree with equal weights; a deployment passes its own.
WEIGHTS: dict[tuple, int] = {}


def _keyed(docs):
    """(row, _row, ...): each row whole beside its columns that a stage needs, so that names of other columns don't
    matter, with a key: its file and place there, as they are read from Parquet."""
    needed = [F.struct("*").alias("row"), *[F.col(c) for c in ("doc_id", "text", "lang", "source") if c in docs.columns]]
    place = F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("_row")
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*needed, place)
        except AnalysisException:  # a DataFrame of another kind has no files
            pass
    return written(docs.select(*needed, F.monotonically_increasing_id().cast("string").alias("_row")), "keyed")  # writing fixes the numbers


def quality_rules(spark, docs, sf_dir):
    """Documents that the adaptive rules reject go.

    The rows are written once with their metrics, as thresholds and verdicts both read them; then a verdict needs
    only the few fences beside it, and no text is shuffled.

    A null or empty text goes; null languages and sources are groups of their own; ties with a fence stay; repeated
    rows share a verdict; a very long text is handled in its row; an empty table stays empty; other columns pass
    through whatever their names.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    measured = written(quality.rates(quality.with_metrics(rows)).drop("text"), "quality")
    limits = written(quality.thresholds(measured), "fences")
    return quality.judged(measured, limits).filter("kept").select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates, by five-word shingles, one document with the smallest id stays.

    Texts without words (null, empty) are duplicates of each other; null ids are larger than all others; of equal ids
    in a group the first in its file stays, so one of repeated rows does; a very long text is handled alone; an empty
    table stays empty; other columns pass through whatever their names.
    """
    rows = _keyed(docs)
    marked = written(nearcopies.marked(rows), "marked")
    groups = written(nearcopies.groups(marked, rows), "groups").hint("merge")
    rooted = marked.join(groups, marked["key"] == groups["node"], "left").withColumn("root", F.coalesce("root", "key"))
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_stays")).select("_stays")
    stays = written(stays, "stays").hint("merge")  # a row a document left: it grows with the corpus and is never broadcast
    return rows.join(stays, rows["_row"] == stays["_stays"], "left_semi").select("row.*")


def pseudonyms(spark, docs, sf_dir):
    """Personal data gets pseudonyms; no document goes.

    Null and empty texts stay as they are; equal values get equal pseudonyms in all rows, repeated ones too; where two
    kinds could be read at a place, the first of pii.KINDS wins; a very long text is handled alone; an empty table
    stays empty; other columns pass through whatever their names.
    """
    spans = "pii_spans"
    while spans in docs.columns:
        spans += "_"
    return pii.pseudonymised(docs, KEY, spans=spans).select(*docs.columns)


def mix(spark, docs, sf_dir):
    """Documents as often as the budgets of their leaves take them.

    Null and empty texts have no tokens and are never taken; null languages and sources are leaves of their own; rows
    with equal ids, and repeated rows, are taken each for itself, ties going by a digest; a very long text is one
    document; an empty table stays empty; other columns pass through whatever their names.
    """
    rows = _keyed(docs)
    tree = written(with_tree(rows.select("doc_id", "_row", "text", "lang", "source")).drop("text"), "tree")
    chosen = mixing.mixed(tree, SHARE, WEIGHTS, SEED, EPOCHS)
    times = written(chosen.select(F.col("_row").alias("_taken")), "taken").hint("merge")
    return rows.join(times, rows["_row"] == times["_taken"]).select("row.*")


def encode(spark, docs, sf_dir):
    """Token ids of every text, beside what tells where they come from.

    Null and empty texts have no ids; equal texts have equal ids, and rows come as often as they were; null ids, languages
    and sources stay null; a very long text is handled alone; an empty table gives no rows; other columns are left out.
    """
    import public_tokenizers as P

    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixing", mix), ("byte-level BPE", encode)]
#: Fingerprints, pseudonyms and BPE are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_folder(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs.withColumn("ids", F.array_join("ids", " "))
