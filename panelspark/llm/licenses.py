"""Licence notices by an exact set-similarity join between templates and blocks of text; DataFrame functions only.

A text is cut into blocks at every half block, so that any notice of up to half a block lies whole in one. A block has ``BLOCK`` words,
or twice the words of the longest template if that is more. A template is found in a block that holds at least ``threshold`` of its distinct words (containment). Words that no template has
can't count, so sets are taken over the templates' words, ordered by their number of places in all texts, rarest first. With need =
ceil(threshold * size): a block must hold one of a template's first (size - need + 1) words among its own first (held - need + 1) words
(prefix), hold at least need words (length), and the words from the meeting place on must suffice on both sides (positions). What is
left is counted exactly. The templates are a fixed list, so their index is broadcast.

Results depend on the text alone, so blocks are keyed by a digest of the text and copies are scanned as often as they occur but
labelled once. Null text counts as empty; repeated rows and null ids stay rows of their own; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import lower_ascii

BLOCK, THRESHOLD = 64, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public licence notices.
TEMPLATES = {
    "apache-notice": ["licensed under the apache license version 2 0", "licensed under the apache license you may not use this file except in compliance with the license"],
    "bsd-notice": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["this work is licensed under a creative commons attribution license", "licensed under cc by 4 0", "licensed under cc by sa 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "gpl-notice": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "isc-notice": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mit-notice": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
}


def words_of(text):
    """Words of the lower-cased text: runs of a-z, 0-9 and everything beyond ASCII."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _sql_array(items) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in items) + ")"


def notices(texts: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, words) -> (key, found, best): labels of the templates found in any block, and the largest containment."""
    named = [(label, sorted(set(t.split()))) for label, ts in (templates or TEMPLATES).items() for t in ts]
    known = sorted({w for _, ws in named for w in ws})
    inside = ", ".join(f"'{w}'" for w in known)
    counts = texts.select(F.explode(F.expr(f"filter(words, w -> w in ({inside}))")).alias("w")).groupBy("w").count().collect()  # at most the templates' words
    seen = {r.w: r["count"] for r in counts}
    order = sorted(known, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, prefix = [], set()
    for n, (label, ws) in enumerate(named):
        ranks = sorted(rank[w] for w in ws)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.append((r, n, label, i, len(ranks), need, ranks))
            prefix.add(order[r])
    least = min(x[5] for x in index)
    spark = texts.sparkSession
    probe = F.broadcast(spark.createDataFrame(index, "r int, template int, label string, i int, size int, need int, ranks array<int>"))

    maybe = texts.filter(F.expr(f"arrays_overlap(words, {_sql_array(sorted(prefix))})"))
    half = max(BLOCK // 2, *(len(t.split()) for ts in (templates or TEMPLATES).values() for t in ts))
    blocks = maybe.select("key", F.explode(F.expr(f"transform(sequence(0, greatest(size(words) - {half} - 1, 0) div {half}), k -> slice(words, cast(k as int) * {half} + 1, {2 * half}))")).alias("block"))
    held = blocks.select("key", F.expr(f"sort_array(transform(array_intersect(block, {_sql_array(order)}), w -> cast(array_position({_sql_array(order)}, w) as int) - 1))").alias("held")).filter(F.size("held") >= least)
    met = (
        held.select("key", "held", F.posexplode(F.expr(f"slice(held, 1, size(held) - {least} + 1)")).alias("j", "r"))
        .join(probe, "r")
        .filter("size(held) >= need and 1 + least(size - i - 1, size(held) - j - 1) >= need")
        .withColumn("both", F.expr("size(array_intersect(held, ranks))"))
        .filter("both >= need")
    )
    return met.groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("found"), F.max(F.col("both") / F.col("size")).alias("best"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row."""
    texts = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), words_of(F.col("text")).alias("words"))
    found = notices(texts, threshold)
    ends = sorted({p.split()[-1] for p in PHRASES})
    assert ends == ["license"], "phrases are looked up by their last word"
    cases = " ".join(f"when {' and '.join(f'''get(words, i - {len(ws) - 1 - k}) = '{w}\'''' for k, w in enumerate(ws[:-1]))} then struct(i - {len(ws) - 1} as at, '{label}' as label)" for ws, label in ((p.split(), x) for p, x in PHRASES.items()))
    places = F.expr(
        f"case when array_contains(words, '{ends[0]}') then filter(transform(filter(sequence(0, size(words) - 1), i -> words[i] = '{ends[0]}'), i -> case {cases} end), x -> x is not null) end"
    )
    base = texts.select("doc_id", "key", F.size("words").cast("bigint").alias("n_words"), places.alias("places"))
    out = base.join(found, "key", "left")
    base_labels = F.expr("array_sort(array_distinct(transform(coalesce(places, array()), x -> x.label)))")
    return out.select(
        "doc_id",
        "n_words",
        F.expr("cast(size(coalesce(places, array())) as bigint)").alias("n_base"),
        F.expr("cast(array_min(transform(places, x -> x.at)) as bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(places, x -> x.at)) as bigint)").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", F.expr("cast(array() as array<string>)")))), ",").alias("labels"),
        F.expr("case when size(coalesce(places, array())) > 0 then 1.0d else coalesce(best, 0.0d) end").alias("score"),
    )
