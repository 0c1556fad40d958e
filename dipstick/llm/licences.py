"""Licence scans: word grams of all texts joined to template places, counted by diagonal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipstick.llm.common import lower_ascii, text_of

# What separates words, and the phrases that label a text wherever they stand.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Wording of public licence notices, already as words.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction",
    "apache-2": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "all-rights-reserved": "all rights reserved",
}
GRAM = 3
SLOTS = 2048  # of the table of lower bits that thins grams before their join


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def grams(words: Column, k: int) -> Column:
    """Rolling hashes of ``k`` neighbouring words; none if there are fewer."""
    places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def template_places(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str], k: int) -> DataFrame:
    """(gram, gram_text, template, label, phrase, place, places): a few rows for each fixed template."""
    rows = [(f"p:{label}", label, True, text) for label, text in phrases.items()]
    rows += [(f"t:{label}", label, False, text) for label, text in templates.items()]
    table = spark.createDataFrame(rows, "template string, label string, phrase boolean, wording string")
    words = F.split("wording", " ")
    placed = table.select(
        "template", "label", "phrase", words.alias("words"), (F.size(words) - k + 1).alias("places"),
        F.posexplode(grams(words, k)).alias("place", "gram"),
    )
    return placed.select(
        "gram", F.concat_ws(" ", F.slice("words", F.col("place") + 1, k)).alias("gram_text"),
        "template", "label", "phrase", "place", "places",
    )


def _candidates(words: Column, places: DataFrame, k: int) -> Column:
    """(at, gram, said) of the grams whose lower bits some template gram has, each with its own words only.

    Grams are thinned inside the array, so that no row holds a text's words besides one gram's: the work
    stays in proportion to the length of a text.
    """
    low = F.lit(SLOTS - 1).cast("bigint")
    used = {r[0] for r in places.select(F.col("gram").bitwiseAND(low)).distinct().collect()}  # of fixed templates
    yes, no = F.lit(True), F.lit(False)
    known = F.array(*[yes if i in used else no for i in range(SLOTS)])
    numbered = F.transform(grams(words, k), lambda g, i: F.struct(i.alias("at"), g.alias("gram")))
    left = F.filter(numbered, lambda x: F.get(known, x["gram"].bitwiseAND(low).cast("int")))
    return F.transform(left, lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram"), F.concat_ws(" ", F.slice(words, x["at"] + 1, k)).alias("said")))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, coverage: float = 0.7, drift: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    All rolling word grams of all texts are joined to the places of the templates; a gram's words are
    compared at once, so that equal hashes alone make no hit. Hits of a text vote for a template's
    offset diagonal (place in the text less place in the template). A diagonal with every place of a
    phrase is one place where the phrase stands. Diagonals of a longer template that lie within
    ``drift`` words of each other and adjoin are merged, which bridges inserted and lost words; the
    merged span is verified by the share of template places it holds, which must reach ``coverage``
    to give the label. ``score`` is the best share a text reaches for any template, 0 without hits.

    Built from SQL functions alone. The gram table is fixed by the arguments and therefore
    broadcast; hits are rare and keyed by text, so no group grows beyond one text's licence lines.
    NULL texts have no words. Repeated rows are answered row by row (votes are counted as sets), rows
    of equal id and different text apart; an empty table gives no rows.
    """
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    k = GRAM
    short = [t for t in (*phrases.values(), *templates.values()) if len(t.split()) < k]
    if short:
        raise ValueError(f"templates need {k} words: {short}")
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), words_of(text).alias("words"))
    places = template_places(spark, phrases, templates, k)
    placed = base.select("id", "digest", F.inline(_candidates(F.col("words"), places, k)))
    hits = (
        placed.join(F.broadcast(places), "gram")
        .where(F.col("said") == F.col("gram_text"))
        .select("id", "digest", "template", "label", "phrase", "places", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    )
    key = ["id", "digest"]
    diagonals = hits.groupBy(*key, "template", "label", "phrase", "places", "diagonal").agg(
        F.array_sort(F.collect_set("place")).alias("held")
    )
    first, last = F.element_at("held", 1) + F.col("diagonal"), F.element_at("held", -1) + F.col("diagonal") + k
    order = Window.partitionBy(*key, "template").orderBy("start", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > drift) | (
        F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + drift
    )
    spans = (
        diagonals.withColumns({"start": first, "end": last})
        .withColumn("new", F.when(F.coalesce(far, F.lit(True)) | F.col("phrase"), 1).otherwise(0))
        .withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "template", "label", "phrase", "places", "span")
        .agg(F.min("start").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n_held"))
        .withColumn("share", F.col("n_held") / F.col("places"))
    )
    whole = F.col("phrase") & (F.col("share") == 1)
    found = whole | (~F.col("phrase") & (F.col("share") >= coverage))
    summary = spans.groupBy(*key).agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    rows = base.select("id", "digest", F.size("words").cast("bigint").alias("n_words"))
    matched = rows.join(
        summary.withColumnRenamed("id", "of").withColumnRenamed("digest", "seen"),
        F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("seen")),
        "left",
    )
    return matched.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
