"""License mentions by diagonal voting: word k-grams of documents are joined to the positions of license templates.

A hit of document word p on template word q votes for the diagonal p - q. Votes are added up by document, template and
diagonal, diagonals that lie close together are merged (words put in or left out move a copy to a neighbouring diagonal),
and a merged span is verified by the share of the template that its votes cover.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegauge.llm.common import WordHashes, folded_words, gram_hashes

K = 2
SLACK = 4
COVERED = 0.8
# Templates of at most so many words are names, which must stand whole.
NAME_WORDS = 8
# Stands behind the last k-gram of each document, so that documents without a hit keep a row through the join. Were a k-gram
# to hash to it, it would only meet the row of template -1 once more.
_END = -(1 << 63) + 11


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


# Phrases and labels of the contract (fixed values).
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
# Labels of our own: versions, variants and opening passages of well-known public licenses.
NOTICES = (
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc 4 0"),
    Template("cc-by-sa", "cc by sa 4 0"),
    Template("cc-by-nd", "cc by nd 4 0"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc0", "cc0 1 0 universal public domain dedication"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
TEMPLATES = BASE + NOTICES


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES, k: int = K) -> DataFrame:
    """h, template, q: the k-grams of the templates; one row with template -1 meets the end mark of each document."""
    rows = [(_END, -1, 0)]
    for t, template in enumerate(templates):
        grams = gram_hashes(WordHashes().of(folded_words(template.text)), k).view(np.int64).tolist()
        if not grams:
            raise ValueError(f"a template needs at least {k} words: {template.text!r}")
        rows += [(h, t, q) for q, h in enumerate(grams)]
    return spark.createDataFrame(rows, "h bigint, template int, q int")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """uid, doc_id, n_words, p, h: a row for every word k-gram of every document, and one end mark each."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            counts, parts = [], []
            for text in batch["text"]:
                tokens = folded_words(text.as_py())
                counts.append(len(tokens))
                parts += [gram_hashes(cache.of(tokens), k).view(np.int64), np.array([_END])]
            sizes = [len(a) + 1 for a in parts[::2]]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate(parts or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["doc_id"], pa.array(counts, pa.int64()), lists], ["uid", "doc_id", "n_words", "hs"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = rows.mapInArrow(run, "uid bigint, doc_id bigint, n_words bigint, hs array<bigint>")
    return lists.select("uid", "doc_id", "n_words", F.posexplode("hs").alias("p", "h"))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, slack: int = SLACK) -> DataFrame:
    """uid, doc_id, n_words, template, start, end, covered: merged diagonals; template -1 and nulls once per document.

    ``start`` and ``end`` are word positions, end exclusive; ``covered`` is the share of the template's k-grams.
    The templates are constants of the program, so the broadcast side is bounded.
    """
    spark = docs.sparkSession
    grams = [len(folded_words(t.text)) - k + 1 for t in templates]
    hits = _grams(docs, k).join(F.broadcast(template_grams(spark, templates, k)), "h")
    own = ["uid", "doc_id", "n_words"]
    diagonal = F.when(F.col("template") >= 0, F.col("p") - F.col("q")).otherwise(0)
    votes = (
        hits.groupBy(*own, "template", diagonal.alias("diagonal"))
        .agg(F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("q").alias("qs"))
        .repartition("uid")
    )
    # The phrases must stand word for word, so their diagonals stay apart.
    exact = F.array(*[F.lit(i) for i, t in enumerate(templates) if t.base] or [F.lit(-2)])
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.array_contains(exact, F.col("template")) | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)
    merged = (
        votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("cluster", F.sum("new").over(along))
        .groupBy(*own, "template", "cluster")
        .agg(F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("votes"))
    )
    size = F.get(F.array(*[F.lit(g) for g in grams]), F.col("template"))
    real = F.col("template") >= 0
    return merged.select(
        *own, "template", F.when(real, F.col("start").cast("bigint")).alias("start"), F.when(real, F.col("end").cast("bigint")).alias("end"),
        F.when(real, F.col("votes") / size).alias("covered"),
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, covered: float = COVERED) -> DataFrame:
    """One row (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document.

    ``n_base`` counts the places where a base phrase stands, ``first_word`` and ``last_word`` are the smallest and largest
    word they start at (null without one). ``labels`` adds the templates of which a merged span covers at least the share
    ``covered``, names wholly. ``score`` is the largest share any span covers, 0 without one. Null texts are empty; null ids and repeated
    rows keep their rows; other columns are ignored; an empty table gives no rows.
    """
    found = spans(docs, templates)
    names = F.get(F.array(*[F.lit(t.label) for t in templates]), F.col("template"))
    is_base = F.get(F.array(*[F.lit(t.base) for t in templates]), F.col("template"))
    needed = F.get(F.array(*[F.lit(1.0 if len(folded_words(t.text)) <= NAME_WORDS else covered) for t in templates]), F.col("template"))
    real = F.col("template") >= 0
    marked = found.withColumn("label", F.when(real, names)).withColumn("base", F.when(real, is_base & (F.col("covered") == 1)).otherwise(False))
    joined = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        marked.groupBy("uid", "doc_id", "n_words")
        .agg(
            F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            joined(F.col("base")).alias("base_labels"),
            joined(F.col("base") | (~is_base & (F.col("covered") >= needed))).alias("labels"),
            F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        )
        .drop("uid")
    )
