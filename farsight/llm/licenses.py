"""Licence scans by the Dice coefficient over word bigrams, with DataFrame operations only.

A text is normalised to lower-case words. Its units are the whole text, its paragraphs and its lines; a unit is
compared with licence templates by the Dice coefficient of their bags of word bigrams. With a least value t, a
unit of n bigrams can only match templates of t / (2 - t) n to (2 - t) / t n bigrams: units that no template's
size allows are never cut into bigrams. Templates are a fixed table, so broadcasting it is bounded.

Defined results: a null or empty text has no units; a unit of one word has no bigram and matches nothing; of equal
values the template first in the table is named; equal units of a text count once; rows that repeat a doc_id are
judged one by one, and fully equal rows get equal results; a null doc_id is kept; further columns of the input
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.llm.shared import documents, text_or_empty

LEAST = 0.8
#: Short notices by which texts name their licence. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of a lower-case text.
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def words_of(text):
    """The normalised words of a text column."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def bigrams_of(words):
    """The bigrams of an array of at least two words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))


def template_bigrams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, size, bigram, times): the bigrams of each template, numbered in order."""
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    words = table.select("template", "license", words_of(F.col("text")).alias("words")).where(F.size("words") > 1)
    terms = words.select("template", "license", (F.size("words") - 1).alias("size"), F.explode(bigrams_of(F.col("words"))).alias("bigram"))
    return terms.groupBy("template", "license", "size", "bigram").agg(F.count("*").alias("times"))


def scan(docs: DataFrame, *, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(doc_id, tie, unit, license, dice) for every unit that matches; docs: (doc_id, tie, text), tie tells rows with one doc_id apart."""
    known = template_bigrams(docs.sparkSession, templates)
    low, high = known.agg(F.min("size"), F.max("size")).first()  # of a fixed table
    ratio = least / (2 - least)
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n[ \t\r]*\n"), F.split("text", r"\r?\n")))
    cut = docs.select("doc_id", "tie", F.posexplode(units).alias("unit", "part"))
    cut = cut.select("doc_id", "tie", "unit", words_of(F.col("part")).alias("words")).withColumn("n", F.size("words") - 1)
    cut = cut.where((F.col("n") > 0) & F.col("n").between(ratio * low, high / ratio))
    terms = cut.select("doc_id", "tie", "unit", "n", F.posexplode(bigrams_of(F.col("words"))).alias("at", "bigram"))
    fits = F.col("n").between(F.lit(ratio) * F.col("size"), F.col("size") / F.lit(ratio))
    met = terms.join(F.broadcast(known), "bigram").where(fits).dropDuplicates(["doc_id", "tie", "unit", "template", "at"])
    by = ["doc_id", "tie", "unit", "n", "template", "license", "size"]
    shared = met.groupBy(*by, "bigram", "times").agg(F.count("*").alias("seen")).groupBy(*by).agg(F.sum(F.least("seen", "times")).alias("shared"))
    found = shared.withColumn("dice", F.lit(2.0) * F.col("shared") / (F.col("n") + F.col("size"))).where(F.col("dice") >= least)
    best = F.max_by(F.struct("license", "dice"), F.struct("dice", -F.col("template"))).alias("best")
    return found.groupBy("doc_id", "tie", "unit").agg(best).select("doc_id", "tie", "unit", "best.*")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """For every document: doc_id, n_units that match, licenses (distinct, in order, comma-joined) and the best dice (0 without)."""
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    by_row = scan(docs).groupBy(F.col("doc_id").alias("id_"), F.col("tie").alias("tie_")).agg(
        F.count("*").alias("n_units"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("dice")
    )
    on = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tie") == F.col("tie_"))
    return docs.select("doc_id", "tie").join(by_row, on, "left").select("doc_id", "n_units", "licenses", "dice").fillna({"n_units": 0, "licenses": "", "dice": 0.0})


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BIGRAMS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
ORACLE_SQL = f"""
WITH templates(template, license, text) AS (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))}),
tw AS (SELECT template, license, regexp_extract_all(lower(text), '{WORD}') AS w FROM templates),
tb AS (SELECT template, license, len(w) - 1 AS size, unnest({_BIGRAMS}) AS bigram FROM tw WHERE len(w) > 1),
tc AS (SELECT template, license, size, bigram, count(*) AS times FROM tb GROUP BY ALL),
units AS (SELECT DISTINCT doc_id, unnest(list_concat([coalesce(text, '')], regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n'), regexp_split_to_array(coalesce(text, ''), '\r?\n'))) AS part FROM documents),
uw AS (SELECT doc_id, part, regexp_extract_all(lower(part), '{WORD}') AS w FROM units),
ub AS (SELECT doc_id, part, len(w) - 1 AS n, unnest({_BIGRAMS}) AS bigram FROM uw WHERE len(w) BETWEEN 2 AND 200),
uc AS (SELECT doc_id, part, n, bigram, count(*) AS seen FROM ub GROUP BY ALL),
dice AS (SELECT doc_id, part, template, license, 2.0::double * sum(least(seen, times)) / (n + size) AS dice FROM uc JOIN tc USING (bigram) GROUP BY doc_id, part, n, template, license, size),
best AS (SELECT doc_id, part, arg_max(license, (dice, -template)) AS license, max(dice) AS dice FROM dice WHERE dice >= {LEAST} GROUP BY doc_id, part),
by_doc AS (SELECT doc_id, count(*) AS n_units, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses, coalesce(b.dice, 0.0::double) AS dice FROM documents LEFT JOIN by_doc b USING (doc_id)
"""
