"""License scan by diagonal voting.

Every run of K words of a text is hashed and joined to the places at which the templates have it. A hit
votes for its diagonal, place in the text minus place in the template; an undisturbed copy puts all its
votes on one. Diagonals that lie within SLACK of each other (words put in or left out) are merged, and a
merged span is verified: the share of the template's runs that it holds must reach COVERAGE. The three base
phrases are templates of one run each, so each of their hits is a place.

Defined results: a null or empty text has no words and no labels; null and repeated ids are allowed, as rows
are told apart by `key`, which must be unique; equal texts get equal results, and of spans with equal scores it
doesn't matter which is best; an empty table gives no rows; columns pass through marked() whatever their names, but
for n_words and candidates, which are replaced. A very long text is cut in its row, and only its hits leave it.
DataFrame expressions only; the templates are a fixed list, a few hundred rows, and only hits are shuffled, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
SLACK = 4
COVERAGE = 0.6
#: Template places that are sent to all executors at most, some 100 bytes each.
MOST_PLACES = 20_000

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages of public licenses and the usual notices, as words.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions""",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis""",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-header": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later version""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of conditions
        and the following disclaimer""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}


def words(text: Column) -> Column:
    """lower() also lowers letters beyond ASCII; all those are word characters before and after, and none of
    the templates' letters can come of one but k, so places and counts are those of lowering A to Z."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def runs(array: str, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    none = F.expr("CAST(array() AS array<bigint>)")
    some = F.transform(F.sequence(F.lit(1), F.size(array) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(array, i + j) for j in range(k)]))
    return F.when(F.size(array) < k, none).otherwise(some)


def template_places(spark: SparkSession) -> DataFrame:
    """(h, template, place, runs, k): a row for each run of each template."""
    rows = [(f"={label}", phrase.split(), len(phrase.split())) for phrase, label in PHRASES.items()]
    rows += [(label, text.split(), K) for label, text in TEMPLATES.items()]
    flat = [(name, i, len(w) - k + 1, k, *(w[i : i + k] + [None] * (3 - k))) for name, w, k in rows for i in range(len(w) - k + 1)]
    if len(flat) > MOST_PLACES:
        raise ValueError("too many template places to broadcast")
    df = spark.createDataFrame(flat, "template string, place int, runs int, k int, a string, b string, c string")
    return df.select(F.when(F.col("k") == 2, F.xxhash64("a", "b")).otherwise(F.xxhash64("a", "b", "c")).alias("h"), "template", "place", "runs", "k")


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words and candidates: place and hash of the runs whose hash some template has.

    The words of a text are cut once. Runs of two words matter only for two of the phrases, both of which end
    in license; texts without that string have none.
    """
    known = [r.h for r in template_places(docs.sparkSession).select("h").distinct().collect()]  # bounded by MOST_PLACES
    none = F.expr("CAST(array() AS array<bigint>)")
    df = docs.select(F.struct("*").alias("row"), words(F.col(text)).alias("w"), F.lower(F.col(text)).contains("license").alias("l"))
    df = df.select("row", F.size("w").cast("long").alias("n"), runs("w", 3).alias("a"), F.when(F.col("l"), runs("w", 2)).otherwise(none).alias("b"))
    found = [F.filter(F.transform(c, lambda h, i: F.struct(i.alias("start"), h.alias("h"))), lambda x: x["h"].isin(known)) for c in ("a", "b")]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "candidates")]
    return df.select(*kept, F.col("n").alias("n_words"), F.concat(*found).alias("candidates"))


def hits(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, template, at, runs, k) for every run of a text that a template has; rows are those of marked()."""
    places = F.broadcast(template_places(rows.sparkSession))  # a fixed list of this module: its size is checked there
    runs_of = rows.select(F.col(key).alias("key"), F.explode("candidates").alias("c")).select("key", "c.start", "c.h")
    return runs_of.join(places, "h").select("key", "start", "template", F.col("place").alias("at"), "runs", "k")


def spans(found: DataFrame, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """(key, template, first, last, share, votes): verified spans, in words of the text; votes are distinct runs."""
    votes = found.groupBy("key", "template", "runs", "k", (F.col("start") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("start").alias("first"), F.max("start").alias("last")
    )
    near = W.partitionBy("key", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > slack, F.lit(True)).cast("int")
    new = F.when(F.col("runs") == 1, 1).otherwise(new)  # each hit of a phrase is a place of its own
    merged = votes.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(near))
    out = merged.groupBy("key", "template", "runs", "k", "cluster").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.size("ats") / F.col("runs")
    return out.select("key", "template", "first", (F.col("last") + F.col("k") - 1).alias("last"), share.alias("share"), F.size("ats").alias("votes")).filter(F.col("share") >= coverage)


def by_row(found: DataFrame) -> DataFrame:
    """(key, n_base, first_word, last_word, base_labels, labels, score) of the rows that have spans.

    A span's score is its share of the template, less for few votes: one run makes half of it, each further
    run halves what is missing. A row has that of its best span.
    """
    is_base = F.col("template").startswith("=")
    label = F.when(is_base, F.substring("template", 2, 100)).otherwise(F.col("template"))
    base = F.when(is_base, label)
    return found.groupBy("key").agg(
        F.count(base).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
        F.max(F.col("share") * (1 - F.pow(F.lit(0.5), F.col("votes")))).alias("score"),
    )
