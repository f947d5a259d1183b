"""License scans in DataFrame operations only: fixed phrases, and an exact set-similarity join with license notices.

A block is a stretch of a text's words, whatever its lines, a quarter longer than the notice it is compared with. A notice
is found in a block that holds at least the threshold's share of the notice's distinct words (containment), among them
those that tell it from its neighbours. Candidates are found in windows that overlap so far that every block of the
longest notice is inside one of them. The join orders words by their corpus-wide count, rarest first: a window that
contains enough of a notice must hold one of the notice's first few words (prefix filter), enough words of notices at all
(length filter), and enough of them from the shared one on, by its places in the ordered notice and in the ordered
window (positional filter). What is left is verified block by block.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise, whole_text

#: What separates words, and the phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Notices of public licenses and their labels; a parameter of the scan. A notice's words in square brackets tell it from
#: others, so a block without them doesn't hold the notice.
NOTICES = {
    "this work is licensed under the [gnu] [general] public license version [3]": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the [gnu] [general] public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the [gnu] [lesser] general public license as published by the free software foundation": "lgpl",
    "licensed under the [apache] license version [2] 0": "apache-2.0",
    "licensed under the [apache] license version [2] 0 the license you may not use this file except in compliance with the license": "apache-2.0",
    "[permission] is hereby granted free of charge to any person obtaining a copy of this [software] and associated documentation files the software to deal in the software without restriction": "mit",
    "released under the [mit] license": "mit",
    "[redistribution] and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "[permission] to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the [mozilla] public license v 2 0": "mpl-2.0",
    "licensed under [cc] [by] [nc] 4 0": "cc-by-nc-4.0",
    "this work is licensed under a [creative] [commons] [attribution] 4 0 international license": "cc-by-4.0",
}
THRESHOLD = 0.8
#: How much longer than its notice a block may be, in whole words rounded down.
STRETCH = 1.25


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def places_of(words: Column, phrase: str, label: str) -> Column:
    """Array of (at, label) of every place where the phrase's words stand consecutively."""

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for j, word in enumerate(phrase.split(" ")):
            ok = ok & F.coalesce(F.get(words, i + j) == word, F.lit(False))
        return ok

    at = F.filter(F.sequence(F.lit(0), F.size(words)), here)
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notice_lines.

    ``score`` is 1 where a phrase stands, else the greatest containment of a notice that reaches the threshold, else 0.
    ``notice_lines`` lists line:label of each notice found; the line is that of the block's first word of the notice. Null
    and empty texts have no words. Repeated rows are scanned as often as they occur; null ids are kept; further columns
    are not read; an empty table gives no rows.
    """
    plain = [re.sub(r"[\[\]]", "", text).split(" ") for text in notices]
    sets = [(sorted(set(words)), label) for words, label in zip(plain, notices.values())]
    telling = [sorted(set(re.findall(r"\[(.*?)\]", text))) for text in notices]
    spans = [math.floor(len(words) * STRETCH) for words in plain]
    vocabulary = sorted({w for words, _ in sets for w in words})
    need = [-(-int(round(len(words) * threshold * 1000)) // 1000) for words, _ in sets]
    # Counts of the notices' words over all texts order them; the driver gets one row for each of these words.
    every = docs.select(F.explode(F.split(lowered(whole_text(text_col)), SEPARATORS)).alias("w")).where(F.col("w").isin(vocabulary))
    counts = dict(every.groupBy("w").count().collect())
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows = []
    for i, (words, label) in enumerate(sets):
        ranked = sorted(order[w] for w in words)
        for p, w in enumerate(ranked[: len(words) - need[i] + 1]):
            rows.append((w, i, label, p, len(words), need[i], ranked, spans[i], [order[t] for t in telling[i]]))
    step = max(spans, default=1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_"), whole_text(text_col).alias("text_"))
    d = d.withColumn("low_", lowered(F.col("text_")))
    d = d.withColumn("all_", words_of(F.col("low_")))
    # Only texts with one of the notices' first words have windows, only texts in which some phrase can stand have places.
    prefix = {r[0] for r in rows}
    first = sorted(w for w in order if order[w] in prefix)
    begins = F.arrays_overlap("all_", F.array(*map(F.lit, first)).cast("array<string>"))
    gate = F.col("low_").rlike("|".join(p.replace(" ", SEPARATORS) for p in PHRASES))
    d = d.withColumn("words_", F.when(gate, F.col("all_")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("places", F.concat(*(places_of(F.col("words_"), p, label) for p, label in PHRASES.items())))
    d = materialise(d.select("doc_id", "row_", F.size(F.regexp_extract_all("text_", F.lit(WORD), 0)).cast("long").alias("n_words"), "places", F.when(begins, F.col("low_")).alias("low_")))
    index = docs.sparkSession.createDataFrame(rows, "rank int, notice int, label string, p int, size int, need int, ranked array<int>, span int, telling array<int>")
    # One row per word of a notice: its place, its line and its rank; windows k of two steps begin at every step.
    ranks = docs.sparkSession.createDataFrame(list(order.items()), "w string, rank int")
    lines = d.where(F.col("low_").isNotNull()).select("row_", F.split("low_", "\n").alias("lines_"))
    sizes = F.transform("lines_", words_of)
    flat = F.flatten(F.transform(sizes, lambda ws, i: F.transform(ws, lambda w: F.struct(i.alias("line"), w.alias("w")))))
    held = lines.select("row_", F.posexplode(flat).alias("at", "x")).select("row_", "at", "x.line", F.col("x.w").alias("w")).join(F.broadcast(ranks), "w")
    own = F.floor(F.col("at") / step)
    held = held.withColumn("k", F.explode(F.array(own - 1, own)))
    places = F.array_sort(F.collect_list(F.struct("at", "line", "rank"))).alias("places_")
    blocks = held.groupBy("row_", "k").agg(places, F.array_sort(F.collect_set("rank")).alias("words"))
    blocks = blocks.where(F.size("words") >= min(need, default=0)).select("row_", "k", "places_", "words", F.posexplode("words").alias("q", "rank"))
    # At most one row per word of the notices' prefixes is broadcast.
    reach = F.least("p", "q") + F.least(F.col("size") - F.col("p"), F.size("words") - F.col("q"))
    met = blocks.join(F.broadcast(index), "rank").where((reach >= F.col("need")) & (F.size(F.array_intersect("words", "ranked")) >= F.col("need")))

    def block(begin: Column) -> Column:
        """Distinct words of the notice in the block that begins at a place, and that place's line."""
        inside = lambda x: (x["at"] >= begin["at"]) & (x["at"] < begin["at"] + F.col("span")) & F.array_contains("ranked", x["rank"])
        return F.struct(begin["line"].alias("line"), F.array_distinct(F.transform(F.filter("places_", inside), lambda x: x["rank"])).alias("held"))

    # Blocks that begin in the window's first half are inside it; those of the second half are the next window's.
    begins = F.filter("places_", lambda x: (F.floor(x["at"] / step) == F.col("k")) & F.array_contains("ranked", x["rank"]))
    holds = lambda x: (F.size(x["held"]) >= F.col("need")) & (F.size(F.array_except(F.col("telling"), x["held"])) == 0)
    verified = F.filter(F.transform(begins, block), holds)
    found = met.select("row_", "k", "notice", "label", "size", verified.alias("v")).where(F.size("v") > 0).dropDuplicates(["row_", "k", "notice"])
    found = found.select("row_", F.struct(F.element_at("v", 1)["line"].alias("line"), "label").alias("hit"), (F.array_max(F.transform("v", lambda x: F.size(x["held"]))) / F.col("size")).alias("share"))
    found = found.groupBy("row_").agg(F.collect_set("hit").alias("found"), F.max("share").alias("most"))
    d = d.drop("low_").join(found, "row_", "left")
    base = F.transform("places", lambda x: x["label"])
    more = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at = F.transform("places", lambda x: x["at"])
    return d.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
        F.coalesce(F.array_join(F.transform(F.array_sort("found"), lambda x: F.concat_ws(":", x["line"], x["label"])), ","), F.lit("")).alias("notice_lines"),
    )
