"""Operator 12, license scans by diagonal voting.

Every run of k words of a text is hashed and joined with the places where the templates hold that run; k is a template's
`gram` (4 words), or all words of a shorter one. A hit at word p of the text and word q of the template votes for the
diagonal p - q: words that stand together in both vote for one diagonal. An inserted or lost word moves the rest
of a notice to a neighbouring diagonal, so the votes of diagonals up to `slack` apart are merged. What is merged is verified:
the join compares the words of a hit as well as their hash, and a span counts with the share of the template's
words that its hits cover.

Phrases must be covered whole, on one diagonal: each such diagonal is a place of the phrase. Notices need
`least` of their words. The templates are a parameter; their runs are broadcast, a row for each of their words.

Texts are lower-cased (A to Z); words are runs of digits, letters and all other characters beyond ASCII. Long texts
are cut into segments of 4,096 words that share what a run could cross, so no row grows with a text's runs. Votes
are summed before they are shuffled, by text and template; a template's words bound them on a diagonal. Rows of
one id and text are scanned alike. Null and empty texts have no words and no labels. A null id is an id. An empty
table gives none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT = 4096


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(NO_WORD, self.text.translate(str.maketrans(UPPER, LOWER))) if w]


# The phrases of the contract, and the opening words of licenses and their notices.
PHRASES = (
    Template("gpl", "gnu general public license", phrase=True),
    Template("apache", "apache license", phrase=True),
    Template("cc-by", "cc by", phrase=True),
    Template("mit", "mit license", phrase=True),
)
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NO_WORD), "")


def template_runs(templates: tuple[Template, ...], gram: int) -> list[tuple[int, int, int, str]]:
    """template, k, q, run: the runs of k words of every template, by the word they start at."""
    found = []
    for t, template in enumerate(templates):
        words = template.words
        k = min(gram, len(words))
        found += [(t, k, q, " ".join(words[q : q + k])) for q in range(len(words) - k + 1)]
    return found


def _hash(words: Column, i: Column, k: int) -> Column:
    """The hash of the k words from the ith (from 1) on."""
    return F.xxhash64(*[F.get(words, i + j - 1) for j in range(k)])


def hits(texts: DataFrame, templates: tuple[Template, ...], gram: int) -> DataFrame:
    """key, template, q, p of every run of a text that a template holds at its word q. texts: key, words.

    The hashes of all runs meet the templates' hashes where they are made: what is in their set is spelled out and joined.
    """
    known = template_runs(templates, gram)
    sizes = sorted({k for _, k, _, _ in known})
    spelled = texts.sparkSession.createDataFrame(known, "template int, k int, q int, known string").withColumn("words", F.split("known", " "))
    hashed = F.coalesce(*[F.when(F.col("k") == k, _hash(F.col("words"), F.lit(1), k)) for k in sizes])
    runs = spelled.select(hashed.alias("hash"), "k", "known", "template", "q")
    held = {k: [r.hash for r in runs.where(F.col("k") == k).select("hash").distinct().collect()] for k in sizes}
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / SEGMENT).cast("int"))
    cut = F.transform(starts, lambda s: F.struct((s * SEGMENT).alias("base"), F.slice("words", s * SEGMENT + 1, SEGMENT + sizes[-1] - 1).alias("words")))
    segments = texts.select("key", F.explode(cut).alias("s")).select("key", "s.*")
    words, places = F.col("words"), F.sequence(F.lit(1), F.greatest(F.least(F.size("words"), F.lit(SEGMENT)), F.lit(1)))

    def met(k: int) -> Column:
        at = F.filter(places, lambda i: (i + (k - 1) <= F.size(words)) & _hash(words, i, k).isin(held[k]))
        return F.transform(at, lambda i: F.struct((F.col("base") + i - 1).alias("p"), F.lit(k).alias("k"), _hash(words, i, k).alias("hash"), F.array_join(F.slice(words, i, k), " ").alias("run")))

    each = segments.select("key", F.explode(F.concat(*[met(k) for k in sizes])).alias("x")).select("key", "x.*")
    return each.join(F.broadcast(runs), ["hash", "k"]).where(F.col("run") == F.col("known")).select("key", "template", "q", "p")


def scans(texts: DataFrame, templates: tuple[Template, ...], gram: int = 4, slack: int = 8, least: float = 0.75) -> DataFrame:
    """key, n_places, first_word, last_word, phrase_labels, labels, score of every text that any template meets. texts: key, words."""
    spark = texts.sparkSession
    told = [(t, x.label, x.phrase, len(x.words), min(gram, len(x.words))) for t, x in enumerate(templates)]
    about = F.broadcast(spark.createDataFrame(told, "template int, label string, phrase boolean, n_words int, k int"))
    votes = hits(texts, templates, gram).groupBy("key", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"))
    near = W.partitionBy("key", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = votes.withColumn("near", F.array_distinct(F.flatten(F.collect_list("qs").over(near)))).join(about, "template")
    covered = lambda qs: F.size(F.array_distinct(F.flatten(F.transform(qs, lambda q: F.sequence(q, q + F.col("k") - 1)))))
    share = covered(F.when(F.col("phrase"), F.col("qs")).otherwise(F.col("near"))) / F.col("n_words")
    found = merged.withColumn("share", share).withColumn("whole", F.col("phrase") & (F.col("share") == 1.0))
    labels = lambda on: F.array_join(F.sort_array(F.collect_set(F.when(on, F.col("label")))), ",")
    return found.groupBy("key").agg(
        F.count_if("whole").alias("n_places"), F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first_word"), F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last_word"),
        labels(F.col("whole")).alias("phrase_labels"), labels(F.col("whole") | ~F.col("phrase") & (F.col("share") >= least)).alias("labels"), F.max("share").alias("score"),
    )


def license_scan(documents: DataFrame, doc_id: str = "doc_id", phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES, gram: int = 4, slack: int = 8, least: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), text).cast("binary")))
    docs = documents.select(doc_id, key.alias("key"), words_of(F.col("text")).alias("words"))
    found = scans(docs.select("key", "words"), (*phrases, *notices), gram, slack, least)
    return (
        docs.select(doc_id, "key", F.size("words").cast("long").alias("n_words"))
        .join(found, "key", "left")
        .select(
            doc_id, "n_words", F.coalesce("n_places", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
            F.coalesce("phrase_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_TOLD = [(t, x.label, x.phrase, len(x.words)) for t, x in enumerate((*PHRASES, *NOTICES))]
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NO_WORD}'), lambda x: x <> '') AS ws FROM documents),
runs(template, k, q, run) AS (VALUES {", ".join(f"({t}, {k}, {q}, '{run}')" for t, k, q, run in template_runs((*PHRASES, *NOTICES), 4))}),
about(template, label, phrase, n_words) AS (VALUES {", ".join(f"({t}, '{label}', {phrase}, {n})" for t, label, phrase, n in _TOLD)}),
g AS (SELECT rid, k, p, array_to_string(ws[p + 1:p + k], ' ') AS run FROM (SELECT rid, ws, k, unnest(generate_series(0, len(ws) - k)) AS p FROM d, (SELECT DISTINCT k FROM runs))),
v AS (SELECT rid, template, k, p - q AS diagonal, list(DISTINCT q) AS qs FROM g JOIN runs USING (k, run) GROUP BY ALL),
m AS (SELECT a.rid, a.template, a.k, a.diagonal, CASE WHEN phrase THEN a.qs ELSE flatten(list(b.qs)) END AS qs, label, phrase, n_words
  FROM v a JOIN v b ON a.rid = b.rid AND a.template = b.template AND b.diagonal BETWEEN a.diagonal - 8 AND a.diagonal + 8 JOIN about ON about.template = a.template GROUP BY a.rid, a.template, a.k, a.diagonal, a.qs, label, phrase, n_words),
s AS (SELECT rid, diagonal, label, phrase, len(list_distinct(flatten(list_transform(qs, lambda q: generate_series(q, q + k - 1))))) / n_words AS share FROM m),
f AS (SELECT rid, count(*) FILTER (phrase AND share = 1) AS n_base, min(diagonal) FILTER (phrase AND share = 1) AS first_word, max(diagonal) FILTER (phrase AND share = 1) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (phrase AND share = 1)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (CASE WHEN phrase THEN share = 1 ELSE share >= 0.75 END)), ',') AS labels, max(share) AS score FROM s GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN f USING (rid)
"""
