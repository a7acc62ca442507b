"""Operator 4: license scans by diagonal voting. DataFrame functions only.

Texts and templates become lower-case words. Every rolling GRAM-word gram of every text is joined
by hash (and then by its words) to the places of the templates' grams, a table of a few hundred
rows. A hit votes for the diagonal place in text - place in template; diagonals at most GAP apart
are merged, and a merged run counts if it covers COVERAGE of the template's grams within a span of
at most STRETCH times its length. Phrases, the short templates behind the base columns, count only
where all their grams lie on one diagonal, which is where their words stand consecutively.

Only hits are shuffled, by document. Nulls: null text is the empty text; very long texts are scanned whole. Rows with null or repeated
doc_id are scanned like any other; equal rows get equal results. Of overlapping spans all that tie for the highest coverage stay. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm._common import documents
from codequarry.llm.quality_rules import places

GRAM = 3
GAP = 2
COVERAGE = 0.7
STRETCH = 1.5
#: What separates words, once A-Z are small.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Opening sentences and usual notices of public licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
)


def lowered(text: Column) -> Column:
    """A-Z alone in lower case; '' for null."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAK), "")


def gram_hashes(words: Column) -> Column:
    return F.transform(places(F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(GRAM))))


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per place of a gram in a template."""
    rows = [(*p, True) for p in phrases] + [(*t, False) for t in templates]
    every = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.split(F.lit(text), " ").alias("words")) for k, (label, text, exact) in enumerate(rows)))
    own = spark.range(1).select(F.inline(every))
    out = own.select("template", "label", "exact", "words", F.posexplode(gram_hashes(F.col("words"))).alias("at", "hash"))
    return out.select("template", "label", "exact", F.size("words").alias("length"), (F.size("words") - (GRAM - 1)).alias("n_grams"), "at", F.slice("words", F.col("at") + 1, GRAM).alias("gram"), "hash")


def diagonals(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """By text key, template and diagonal: the distinct template places that voted, and first and last place in the text."""
    own = docs.select(*text_key(docs), text_words(docs["text"]).alias("words"))
    own = own.select("key", "key2", "words", F.posexplode(gram_hashes(F.col("words"))).alias("place", "hash"))
    same = [F.get("words", F.col("place") + k) == F.get("gram", F.lit(k)) for k in range(GRAM)]
    hits = own.join(F.broadcast(grams), "hash").where(same[0] & same[1] & same[2])  # grams are a few hundred rows
    by = ["key", "key2", "template", "label", "exact", "length", "n_grams"]
    hits = hits.select(*by, (F.col("place") - F.col("at")).alias("diagonal"), "at", "place")
    return hits.groupBy(*by, "diagonal").agg(F.collect_set("at").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))


def text_key(docs: DataFrame) -> list[Column]:
    """96 bits of a row's id and text."""
    both = docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit(""))
    return [F.xxhash64(*both).alias("key"), F.hash(*reversed(both)).alias("key2")]


def spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Verified spans by text key: template, label, exact, first and last word, coverage."""
    found = diagonals(docs, template_grams(docs.sparkSession, phrases, templates))
    own = Window.partitionBy("key", "key2", "template").orderBy("diagonal")
    apart = F.col("exact") | F.lag("diagonal").over(own).isNull() | (F.col("diagonal") - F.lag("diagonal").over(own) > GAP)
    runs = found.withColumn("run", F.sum(apart.cast("int")).over(own))
    merged = runs.groupBy("key", "key2", "template", "label", "exact", "length", "n_grams", "run").agg(
        F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("n_votes")
    )
    coverage = F.col("n_votes") / F.col("n_grams")
    short = F.col("last") - F.col("first") + 1 <= F.ceil(F.col("length") * STRETCH)
    good = merged.select("key", "key2", "template", "label", "exact", "first", "last", coverage.alias("coverage")).where(
        F.when(F.col("exact"), F.col("coverage") == 1.0).otherwise((F.col("coverage") >= COVERAGE) & short)
    )
    # of overlapping spans of templates, those with the highest coverage
    inside = Window.partitionBy("key", "key2", "exact").orderBy("first", "last", "template")
    begins = F.coalesce(F.col("first") > F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    grouped = good.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max("coverage").over(Window.partitionBy("key", "key2", "exact", "island"))
    return grouped.withColumn("best", best).where(F.col("coverage") == F.col("best")).drop("begins", "island", "best")


def licences(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: counts, places, labels and score."""
    exact, label = F.col("exact"), F.col("label")
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = spans(docs, phrases, templates).groupBy("key", "key2").agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("first"))).cast("long").alias("last_word"),
        listed(F.collect_set(F.when(exact, label))).alias("base_labels"),
        listed(F.collect_set(label)).alias("labels"),
        F.max("coverage").alias("score"),
    )
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *text_key(docs), F.regexp_count(lowered(docs["text"]), F.lit(WORD)).cast("long").alias("n_words"))
    return own.join(found, ["key", "key2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir))


QUERIES = {"op4_licenses": op4_licenses}


def _listed(rows, exact: str) -> str:
    return ", ".join(f"('{label}', '{text}', {exact})" for label, text in rows)


#: The same by lists and words in place of hashes: every gram of every text, joined by its words to the templates' grams.
_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS template, * FROM (VALUES {_listed(PHRASES, 'TRUE')}, {_listed(TEMPLATES, 'FALSE')}) v(label, text, exact)),
tw AS (SELECT *, string_split(text, ' ') AS w FROM t),
tg AS (SELECT template, label, exact, len(w) AS length, len(w) - 2 AS n_grams, i - 1 AS spot, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM tw)),
d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '{BREAK}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT k, i - 1 AS place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (SELECT k, place, spot, place - spot AS diagonal, template, label, exact, length, n_grams FROM g JOIN tg USING (gram)),
whole AS (SELECT k, template, label, TRUE AS exact, MIN(place) AS first, MAX(place) + 2 AS last, COUNT(DISTINCT spot) / MAX(n_grams) AS coverage FROM hit WHERE exact GROUP BY k, template, label, diagonal HAVING COUNT(DISTINCT spot) = MAX(n_grams)),
stepped AS (SELECT DISTINCT k, template, diagonal FROM hit WHERE NOT exact),
apart AS (SELECT *, CASE WHEN diagonal - LAG(diagonal) OVER (PARTITION BY k, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new FROM stepped),
run AS (SELECT *, SUM(new) OVER (PARTITION BY k, template ORDER BY diagonal) AS run FROM apart),
merged AS (SELECT h.k, h.template, h.label, MIN(place) AS first, MAX(place) + 2 AS last, COUNT(DISTINCT spot)::DOUBLE / MAX(n_grams) AS coverage, MAX(length) AS length FROM hit h JOIN run r ON r.k = h.k AND r.template = h.template AND r.diagonal = h.diagonal WHERE NOT h.exact GROUP BY h.k, h.template, h.label, r.run),
good AS (SELECT * FROM merged WHERE coverage >= {COVERAGE} AND last - first + 1 <= ceil(length * {STRETCH})),
begun AS (SELECT *, CASE WHEN first > MAX(last) OVER (PARTITION BY k ORDER BY first, last, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS FALSE THEN 0 ELSE 1 END AS new FROM good),
island AS (SELECT *, SUM(new) OVER (PARTITION BY k ORDER BY first, last, template) AS island FROM begun),
best AS (SELECT *, MAX(coverage) OVER (PARTITION BY k, island) AS most FROM island),
span AS (SELECT k, label, exact, first, coverage FROM whole UNION ALL SELECT k, label, FALSE, first, coverage FROM best WHERE coverage = most),
found AS (SELECT k, COUNT(CASE WHEN exact THEN 1 END) AS n_base, MIN(CASE WHEN exact THEN first END) AS first_word, MAX(CASE WHEN exact THEN first END) AS last_word, array_to_string(list_sort(array_agg(DISTINCT label) FILTER (exact)), ',') AS base_labels,
 array_to_string(list_sort(array_agg(DISTINCT label)), ',') AS labels, MAX(coverage) AS score FROM span GROUP BY k)
SELECT doc_id, len(w) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word, COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0.0) AS score FROM d LEFT JOIN found USING (k)
"""
ORACLE_SQL: dict[str, str] = {"op4_licenses": _SQL.strip()}
