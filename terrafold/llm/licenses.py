"""Licence scan by a positional index of rare words. Built-in SQL functions only.

The index holds all words of short licence templates with their positions. How rare each is comes from all documents; a word that
is in all of them still weighs 1, so a notice is told however many documents hold it. A template names key phrases; texts where all
of them stand are looked up by all their licence words, however many notices they hold. Each such word votes for (template, place
where the template would start). Places are where the postings of several words meet; the share of the template's weight that meets
there is the evidence.

The word array of a text is made once; the index is a fixed table of some hundred postings, which is all that is broadcast."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.session import settle

# What counts as a word, and the phrases of the base labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, opening words by which a licence is told, and the phrases that must not be missing.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "binary forms")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
#: The share of a template's weight that must meet.
ENOUGH = 0.6
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def _literals(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _places(phrase: str) -> Column:
    """0-based places in ``_words`` where the words of ``phrase`` stand one after the other."""
    first, *rest = phrase.split()
    here = F.filter(F.transform("_words", lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    return F.filter(here, lambda i: F.slice("_words", i + 2, F.lit(len(rest))) == _literals(rest)) if rest else here


def _holds(phrase: str) -> Column:
    """A cheap test before the words are searched: the text has the letters of every word."""
    return _all(F.contains("_lower", F.lit(w)) for w in phrase.split())


def _stands(phrase: str) -> Column:
    """Whether the words of ``phrase`` stand in ``_lower`` one after the other."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    return F.col("_lower").rlike(f"(?:^|{gap})" + f"{gap}+".join(phrase.split()) + f"(?:$|{gap})")


def _worded(docs: DataFrame) -> DataFrame:
    # lower() also changes letters beyond A-Z. They are word characters before and after it, and of ASCII letters only k can come of
    # one (the Kelvin sign), which no phrase has; so words are counted and phrases found as with A-Z alone, many times faster.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("_lower"), F.xxhash64(text, F.length(text)).alias("_key"))
    return df.withColumn("_words", F.regexp_extract_all("_lower", F.lit(WORD), F.lit(0)))


def weights(docs: DataFrame) -> dict[str, float]:
    """1 and the inverse document frequency (natural log) of each licence word, over all documents; at most as many rows as templates have
    words."""
    seen = F.concat(F.array_intersect("_words", _literals(VOCABULARY)), _literals([""]))
    counts = {r["word"]: r["n"] for r in _worded(docs).select(F.explode(seen).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: 1 + math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in VOCABULARY}


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of ``docs`` (``doc_id``, ``text``).

    ``n_base``: places where a phrase of ``PHRASES`` stands; ``first_word`` and ``last_word``: the smallest and largest of them
    (words from 0), else null; ``base_labels``: their labels; ``labels``: with the templates found. ``score``: the largest share
    of a found template that stands together, at least one half with a base label, else 0. Null and empty texts have no words;
    null ids are passed on; repeated rows are scanned alike; other columns are not read. No rows give no rows."""
    spark = docs.sparkSession
    weight = weights(docs)
    postings = [(w, t, p, weight[w]) for t, (_, words, _) in enumerate(TEMPLATES) for p, w in enumerate(words.split())]
    whole = {t: sum(x for _, u, _, x in postings if u == t) for t in range(len(TEMPLATES))}

    df = _worded(docs)
    for k, (phrase, label) in enumerate(PHRASES.items()):
        df = df.withColumn(f"_at{k}", F.when(_holds(phrase), _places(phrase)).otherwise(F.array().cast("array<int>")))
    at = [F.col(f"_at{k}") for k in range(len(PHRASES))]
    base = F.filter(F.array(*(F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, PHRASES.values(), strict=True))), lambda x: x.isNotNull())
    told = F.filter(F.array(*(F.when(_all(_holds(p) & _stands(p) for p in phrases), F.lit(t)) for t, (_, _, phrases) in enumerate(TEMPLATES))), lambda x: x.isNotNull())
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(w.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
    df = df.withColumn("_all", F.concat(*at)).withColumn("_told", told)
    rows = settle(
        df.select(
            "doc_id", "_key", F.size("_words").cast("long").alias("n_words"), F.size("_all").cast("long").alias("n_base"), F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(base)).alias("_base"), F.when(F.size("_told") > 0, hits).alias("_hits"), "_told",
        )
    )
    index = spark.createDataFrame(postings, "word string, t int, p int, weight double")
    names = spark.createDataFrame([(t, label, whole[t]) for t, (label, _, _) in enumerate(TEMPLATES)], "t int, label string, whole double")
    hit = rows.filter("size(_hits) > 0").dropDuplicates(["doc_id", "_key"]).select("doc_id", "_key", "_told", F.explode("_hits").alias("hit"))
    # Words whose postings agree on the place where the template would start.
    votes = hit.select("doc_id", "_key", "_told", "hit.word", "hit.i").join(F.broadcast(index), "word").filter(F.array_contains("_told", F.col("t")))
    meet = votes.groupBy("doc_id", "_key", "t", (F.col("i") - F.col("p")).alias("start")).agg(F.sum("weight").alias("met"))
    best = meet.join(F.broadcast(names), "t").filter(F.col("met") >= ENOUGH * F.col("whole"))
    best = best.groupBy("doc_id", "_key").agg(F.collect_set("label").alias("_more"), F.max(F.least(F.col("met") / F.col("whole"), F.lit(1.0))).alias("_share"))
    best = best.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), "_more", "_share")
    out = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.round(F.greatest(F.coalesce("_share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)), 9)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _all(conditions) -> Column:
    return reduce(and_, conditions)
