"""Licence scans: TF-IDF cosine to templates, then inheritance along paths.

Every line of a file is a possible header. Lines that share a term with a template,
be it a number, are compared with the templates: sparse vectors of term frequency
times inverse document frequency, where the frequencies are those of these lines
of the corpus, and words that no template has count as the rarest. Equal lines are
compared once. A file has the licences of its lines.

A licence file speaks for its directory: files without a licence of their own
take it from the nearest directory above them that has one. Directories, not
files, look for their nearest ancestor, by joins of paths; then each file looks up
its own directory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.llm.tables import row_id, stored, text_of

#: Customary notices by SPDX identifier, to compare lines with.
NOTICES = {
    "MIT": ("Released under the MIT License.", "This software is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, version 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "ISC": ("Licensed under the ISC License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Words of the notices that other texts are full of, too. They have no weight.
COMMON = frozenset("""
    a an and any are as by copy except file for form free general hereby in into is may not obtaining of or person
    subject terms the this to under use version with without work you
""".split())
_TOKEN = r"[0-9]+(?:\.[0-9]+)?|[a-z][a-z0-9]*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]es?|copying|notice|unlicense)([.-][^/]*)?$"


def _terms(line: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({_TOKEN})"))


def templates(spark: SparkSession, notices: dict[str, tuple[str, ...]]) -> DataFrame:
    """(licence, notice, term, tf) of the given notices; as large as they are."""
    rows = [(name, i, text) for name, texts in notices.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "licence string, notice int, text string")
    return table.select("licence", "notice", F.explode(_terms("text")).alias("term")).where(~F.col("term").isin(*COMMON)) \
        .groupBy("licence", "notice", "term").agg(F.count(F.lit(1)).alias("tf"))


def matched_lines(files: DataFrame, notices: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """(line, licence, cosine) of every distinct line of ``files.line`` that is close to a
    template; of equally close ones the first by name."""
    spark = files.sparkSession
    own = templates(spark, notices)
    words = sorted(r["term"] for r in own.select("term").distinct().collect())
    # lines are told apart by a number from here on, so only numbers and words move
    lines = stored(files.groupBy("line").agg(F.count(F.lit(1)).alias("n")).select(row_id().alias("id"), "line", "n"), "lines")
    terms = lines.select("id", "n", F.explode(_terms("line")).alias("term")).where(~F.col("term").isin(*COMMON)) \
        .groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = float(lines.agg(F.sum("n")).first()[0] or 0)
    seen = {r["term"]: r["n"] for r in terms.where(F.col("term").isin(*words)).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rarest = F.lit(1 + total)
    weight = spark.createDataFrame([(w, float(seen.get(w, 0))) for w in words], "term string, df double").select(
        "term", (F.log(rarest / (1 + F.col("df"))) + 1).alias("idf"))
    square = F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.log(rarest) + 1), F.lit(2)))
    line_terms = terms.join(F.broadcast(weight), "term", "left")
    norms = line_terms.groupBy("id").agg(F.sqrt(square).alias("norm"))
    weighed = own.join(F.broadcast(weight), "term").select("licence", "notice", "term", (F.col("tf") * F.col("idf")).alias("w"))
    sizes = weighed.groupBy("licence", "notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = line_terms.where("idf IS NOT NULL").join(F.broadcast(weighed), "term") \
        .groupBy("id", "licence", "notice").agg(F.sum(F.col("tf") * F.col("idf") * F.col("w")).alias("dot"))
    close = dots.join(F.broadcast(sizes), ["licence", "notice"]).join(norms, "id").select(
        "id", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 9).alias("cosine")).where(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("less"), "licence"))
    told = close.groupBy("id").agg(best.alias("best"))
    return lines.join(told, "id").select("line", "best.licence", (-F.col("best.less")).alias("cosine"))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, down to the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def inherited(files: DataFrame) -> DataFrame:
    """(directory, licence, from_directory) for every directory of ``files`` (directory,
    licence, is_licence) that has a licence file or is below one that has."""
    spoken = files.where(F.col("is_licence") & F.col("licence").isNotNull()).groupBy("directory").agg(F.min("licence").alias("licence"))
    upward = files.select("directory").distinct().select("directory", F.posexplode(
        F.concat(F.array("directory"), F.when(F.col("directory") != "", ancestors(F.col("directory"))).otherwise(F.array().cast("array<string>")))
    ).alias("steps", "above"))
    reached = upward.join(spoken.withColumnRenamed("directory", "above"), "above")
    nearest = F.min(F.struct("steps", "licence", "above"))
    return reached.groupBy("directory").agg(nearest.alias("best")).select("directory", "best.licence", F.col("best.above").alias("from_directory"))


def scan(files: DataFrame, path: Column, is_licence: Column | None = None, least: float = 0.7,
         notices: dict[str, tuple[str, ...]] = NOTICES, spread: int = 32) -> DataFrame:
    """One row per row of ``files`` (doc_id, text, and ``path``): doc_id, path, licence,
    cosine, n_lines (close lines), licences (all, sorted), origin (own, inherited, none)
    and from_directory.

    ``is_licence`` tells licence files, by default by their names; a column named
    ``notice_share`` may be used in it, the share of a file's words that stand in close
    lines. A file with several licences is told by the closest. Null texts have no
    lines, null paths lie in the root. ``spread``: copies of each directory's licence,
    among which the files of a directory are dealt, however many they are.
    """
    rows = stored(files.select(row_id().alias("uid"), "doc_id", F.coalesce(path, F.lit("")).alias("path"), text_of(files).alias("text")).select(
        "uid", "doc_id", "path", F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"))).alias("n_words"),
        F.filter(F.split("text", r"\r?\n"), lambda line: F.lower(line).rlike(_anchor(notices))).alias("lines")), "files")
    each = rows.select("uid", F.explode("lines").alias("line"))
    found = matched_lines(each, notices, least)
    n_words = F.size(F.split(F.trim("line"), r"\s+"))
    own = each.join(found, "line").groupBy("uid").agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("best"), F.count(F.lit(1)).alias("n_lines"),
        F.sum(n_words).alias("words"), F.array_sort(F.collect_set("licence")).alias("licences"))
    named = rows.drop("lines").join(own, "uid", "left").select(
        "uid", "doc_id", "path", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("cosine"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        (F.coalesce("words", F.lit(0)) / F.greatest("n_words", F.lit(1))).alias("notice_share"),
        F.regexp_replace("path", r"/?[^/]*$", "").alias("directory"))
    named = stored(named.withColumn("is_licence", F.coalesce(is_licence if is_licence is not None else F.col("path").rlike(LICENCE_FILE), F.lit(False))), "named")
    above = inherited(named).select("directory", F.col("licence").alias("theirs"), "from_directory", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("deal"))
    dealt = named.withColumn("deal", F.pmod(F.xxhash64("uid"), F.lit(spread)).cast("int"))
    return dealt.join(above, ["directory", "deal"], "left").select(
        "doc_id", "path", F.coalesce("licence", "theirs").alias("licence"), "cosine", "n_lines", "licences",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("theirs").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("from_directory")).alias("from_directory"))


def _anchor(notices: dict[str, tuple[str, ...]]) -> str:
    """Pattern of lines that share a term with a notice. All others have cosine 0 to all notices; which of
    the terms could reach a threshold alone depends on the corpus, so none is left out.

    Terms begin behind any number, as in ``2mit``, and numbers end before any letter.
    """
    terms = {t for texts in notices.values() for text in texts for t in re.findall(_TOKEN, text.lower())} - COMMON
    words = "|".join(sorted(re.escape(t) for t in terms if t[0].isalpha()))
    numbers = "|".join(sorted(re.escape(t) for t in terms if t[0].isdigit()))
    sides = [f"(^|[^a-z])({words})([^a-z0-9]|$)"] * bool(words) + [f"(^|[^0-9])({numbers})([^0-9]|$)"] * bool(numbers)
    return "|".join(sides) or "(?!)"
