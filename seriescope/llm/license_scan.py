"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined with the hashed k-grams of the license templates (a fixed
table, so it can be broadcast). Each hit compares the words themselves and votes for a diagonal, the word offset between text
and template; votes are counted for each diagonal, and neighbouring diagonals (at most ``BAND`` apart: words put in or left
out shift the offset) are merged into one span. A span is verified: enough of the template's k-grams must be found in it.

One pass reads the texts. It gives each row a number of its own, and hands on the row's base phrases (in place -1, which
meets a row of its own in the template table) and its hits; all that follows works on these.

Defined cases: a null text is empty and has no words; null and repeated ids are kept, and each row has the labels of its own
text only; repeated rows are scanned each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, let, materialized, text_of, upto, words_of

#: What is no letter, digit or character beyond ASCII separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))

#: Label and text of the notices to look for: the usual short notices, and the openings of the usual headers.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under CC BY 4.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("reserved", "All rights reserved."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced without prior permission of the publisher."),
)
#: The hash that stands for a text as such.
ROW = -(2**63)
#: Words of a k-gram; diagonals this close are merged; the least share of a template's k-grams in a verified span.
GRAM, BAND, COVERAGE = 3, 3, 0.7
#: Templates of up to so many k-grams must be found whole: one word more or less makes them another licence (BY and BY-NC, 2.0 and 2.1).
SHORT = 8


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` changes other letters too, but makes an ASCII letter only of the Kelvin sign: that one is kept."""
    return F.when(F.contains(text, F.lit("\u212a")), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, grams (number), at (position of the k-gram), gram, hash; and the row that meets place -1 of each text."""
    rows = []
    for n, (label, text) in enumerate(TEMPLATES):
        words = [w for w in re.split(SEPARATORS, text.lower()) if w]
        grams = [" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)]
        rows += [(n, label, len(grams), i, g, *g.split(" ")) for i, g in enumerate(grams)]
    parts = [f"w{k}" for k in range(GRAM)]
    table = spark.createDataFrame(rows, f"template int, label string, grams int, at int, gram string, {', '.join(f'{p} string' for p in parts)}")
    own = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(0).alias("grams"), F.lit(0).alias("at"), F.lit("").alias("gram"), F.lit(ROW).alias("hash"))
    return table.select("template", "label", "grams", "at", "gram", F.xxhash64(*parts).alias("hash")).unionAll(own)


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, template, label, grams, at, pos: each k-gram of a text that stands in a template, compared word by word; and with
    template -1 one line per row of ``docs``, that has its doc_id and base phrases as ``said``."""
    low = lowered(text_of(text_col))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), low.alias("low"), words_of(low, SEPARATORS).alias("w"))
    likely = (F.contains("low", F.lit("cc")) & F.contains("low", F.lit("by"))) | F.contains("low", F.lit("public")) | F.contains("low", F.lit("rights"))
    none = F.array().cast("array<struct<at:int,label:string>>")
    said = F.struct("doc_id", F.size("w").alias("n_words"), F.when(likely, _phrases(F.col("w"))).otherwise(none).alias("p"))
    rolled = words.select("row", "w", said.alias("said")).select("row", "w", "said", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - GRAM, F.lit(-1)))).alias("pos"))
    gram = [F.get("w", F.col("pos") + k) for k in range(GRAM)]
    joined = rolled.withColumn("h", F.when(F.col("pos") >= 0, F.xxhash64(*gram)).otherwise(F.lit(ROW))).join(F.broadcast(templates(docs.sparkSession)), F.col("h") == F.col("hash"))
    same = F.when(F.col("pos") >= 0, F.concat_ws(" ", *gram) == F.col("gram")).otherwise(F.col("template") == -1)
    return joined.where(same & ((F.col("pos") < 0) | (F.col("template") >= 0))).select("row", "template", "label", "grams", "at", "pos", F.when(F.col("template") < 0, F.col("said")).alias("said"))


def spans(found: DataFrame) -> DataFrame:
    """row, label, first, last (words, inclusive), coverage: verified spans."""
    votes = found.groupBy("row", "template", "label", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("cells")
    )  # cells: at most one for each k-gram of the template
    # Places on near diagonals are near each other, as no place is further from its diagonal than the template is long.
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > BAND, F.lit(True))
    merged = votes.withColumn("group", F.sum(gap.cast("int")).over(near))
    whole = merged.groupBy("row", "template", "label", "grams", "group").agg(
        F.min("first").alias("first"), F.max("last").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("cells")))).alias("seen")
    )
    enough = F.when(F.col("grams") <= SHORT, F.col("grams")).otherwise(COVERAGE * F.col("grams"))
    return whole.where(F.col("seen") >= enough).select("row", "label", "first", (F.col("end") + GRAM - 1).alias("last"), (F.col("seen") / F.col("grams")).alias("coverage"))


def _phrases(words: Column) -> Column:
    """Places of the base phrases as (start, label), in order."""

    def label(i):
        out = None
        for name, phrase in PHRASES:
            here = F.get(words, i) == phrase[0]
            for k, w in enumerate(phrase[1:], 1):
                here = here & (F.get(words, i + k) == w)
            out = F.when(here, F.lit(name)) if out is None else out.when(here, F.lit(name))
        return out

    likely = F.filter(upto(F.size(words)), lambda i: F.get(words, i).isin(*[p[0] for _, p in PHRASES]))
    return F.filter(F.transform(likely, lambda i: F.named_struct(F.lit("at"), i, F.lit("label"), label(i))), lambda x: x["label"].isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, base phrases, labels and the best coverage of any template."""
    found = materialized(hits(docs, id_col, text_col), "license-hits")
    own = spans(found.where("template >= 0")).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    rows = found.where("template < 0").select("row", "said.*")
    base = rows.select(
        "row", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("p").cast("long").alias("n_base"), F.get("p", F.lit(0))["at"].cast("long").alias("first_word"),
        F.get("p", F.size("p") - 1)["at"].cast("long").alias("last_word"), F.array_distinct(F.transform("p", lambda x: x["label"])).alias("base"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(0.0))
    out = base.join(own, "row", "left")
    out = materialized(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score")), "licenses")
    discard(found)
    return out
