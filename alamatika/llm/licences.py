"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from ancestor folders.

The project has no table of files, so the operator is general: files are rows (path,
content). The licence texts of a file are its lines that speak of a licence; those lines
with the ``AROUND`` lines before and after each, which is the header they stand in; its
leading comment; and the whole, if its name is that of a licence file. Templates are
statements and usual headers, and the complete texts in ``licence_texts`` for Apache-2.0,
BSD-3-Clause, GPL-3.0, MIT and MPL-2.0; there is none for the CC licences, whose complete
texts stay without a licence. Distinct licence texts become sparse TF-IDF vectors, with
document frequencies over all of them and the templates, and are joined to the template
vectors term by term; the template of greatest cosine with any text of the file names its
licence if it reaches ``MIN_COSINE``. A file that declares an SPDX identifier has that
licence, at cosine 1. A file without one inherits from the nearest folder above it that has
a licence file: the folders of all files are expanded to their ancestors, joined on the
path, and the deepest wins.

Files are compared per distinct set of licence texts and folders per distinct folder, so
copies of a header, or a folder with a third of all files, are one row of these joins.

Cases: a null content is empty; of several SPDX identifiers the first counts; a null path has no folder and inherits nothing; ties take
the first licence by name, among licence files of one folder the greatest cosine, then the
first by name; repeated rows are rows of their own; an empty table stays empty; further
columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alamatika.plans.gazetteer import written

MIN_COSINE = 0.45
# Statements of common licences, words that mark a licence line, file names.
TEMPLATES = {
    "Apache-2.0": (
        "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
        "licensed under the apache license version 2.0",
    ),
    "BSD-3-Clause": (
        "redistribution and use in source and binary forms with or without modification are permitted bsd license",
        "released under the bsd 3 clause license",
    ),
    "CC-BY-4.0": ("licensed under cc by 4.0", "creative commons attribution 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"),
    "GPL-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3",
        "this work is licensed under the gnu general public license version 3",
    ),
    "MIT": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software mit license",
        "released under the mit license",
    ),
    "MPL-2.0": (
        "this source code form is subject to the terms of the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at https://mozilla.org/mpl/2.0/",
    ),
}
TEMPLATES["BSD-3-Clause"] += ("redistribution and use in source and binary forms with or without modification are permitted "
                              "provided that the following conditions are met",)

# Complete licence files are compared with complete texts (without copyright lines).
for _file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
    TEMPLATES[_file.stem] += (_file.read_text(encoding="utf-8"),)
LICENCE_LINE = r"(?i)licen[cs]e|copyright|spdx-|permission is hereby|all rights reserved|creative commons"
# Lines of a header: also words of the templates above that hardly stand elsewhere.
HEADER_LINE = LICENCE_LINE + r"|source and binary forms|free software|source code form|mozilla"
AROUND = 2
COMMENT_LINE = r"^\s*(#|//|/?\*|--|;|%|<!--|\"\"\")"
SPDX = r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
SPDX_SUFFIX = r"-(only|or-later)$|\+$"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![0-9])"), lambda t: t != "")


def licence_texts(path: Column, content: Column) -> Column:
    """Different licence texts of a file, none of them empty: lines that speak of a licence,
    their header, the leading comment, the whole of a licence file.
    """
    lines = F.split(content, "\n")

    def parts(lines: Column) -> Column:
        def cut(marks: Column) -> Column:
            near = lambda k: F.exists(
                F.sequence(k - AROUND, k + AROUND), lambda j: F.when(j >= 0, F.get(marks, j)).otherwise(False)
            )
            plain = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT_LINE)), False).cast("int")
            opening = F.slice(lines, F.lit(1), F.when(plain == 0, F.size(lines)).otherwise(plain - 1))
            return F.array(
                F.array_join(F.filter(lines, lambda x, k: F.get(marks, k)), "\n"),
                F.array_join(F.filter(lines, lambda x, k: near(k)), "\n"),
                F.array_join(opening, "\n"),
            )

        # Bound as variables, lines are cut and marked once.
        marks = F.transform(lines, lambda x: x.rlike(HEADER_LINE))
        return F.get(F.transform(F.array(marks), cut), F.lit(0))

    header = F.when(content.rlike(HEADER_LINE), F.get(F.transform(F.array(lines), parts), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )
    whole = F.when(path.rlike(LICENCE_FILE), F.array(content)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(header, whole)), lambda t: t != "")


def declared(content: Column) -> Column:
    """First SPDX identifier of a file, without the suffix for later versions; or null."""
    name = F.regexp_replace(F.regexp_extract(content, SPDX, 1), SPDX_SUFFIX, "")
    return F.when(content.contains("SPDX-License-Identifier:") & (name != ""), name)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _weighted(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, term, weight): TF-IDF; frequencies over ``documents``."""
    n = documents.select("key").distinct().count()
    frequency = documents.groupBy("term").agg(F.count_distinct("key").alias("df"))
    counts = texts.groupBy("key", "term").agg(F.count("*").alias("tf"))
    return counts.join(frequency, "term").select(
        "key", "term", (F.col("tf") * (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1)).alias("weight")
    )


def _norms(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def classify_texts(texts: DataFrame) -> DataFrame:
    """(key, licence, cosine) of sets of licence texts (key, texts) of which one is near a
    template.
    """
    spark = texts.sparkSession
    templates = spark.createDataFrame(
        [(f"{name}#{k}", name, t) for name, all_ in TEMPLATES.items() for k, t in enumerate(all_)],
        "key string, licence string, text string",
    )
    # Texts that sets share are weighed once.
    members = texts.select("key", F.explode("texts").alias("text")).withColumn("part", F.md5(F.encode("text", "UTF-8")))
    distinct = members.groupBy(F.col("part").alias("key")).agg(F.first("text").alias("text"))
    own = distinct.select("key", F.explode(terms_of(F.col("text"))).alias("term"))
    theirs = templates.select("key", F.explode(terms_of(F.col("text"))).alias("term"))
    both = own.unionByName(theirs)
    vectors, marks = written(_weighted(own, both), "vectors"), _weighted(theirs, both)
    # Templates are fixed, some twenty rows: one complete licence is most of their terms.
    wanted = marks.join(F.broadcast(_norms(marks)), "key").join(F.broadcast(templates.select("key", "licence")), "key").select(
        F.col("key").alias("template"), "licence", "term", (F.col("weight") / F.col("norm")).alias("theirs")
    )
    # Lengths meet the sums, one row a template, not the terms: a long text is no hot key.
    products = vectors.join(F.broadcast(wanted), "term").groupBy("key", "template", "licence").agg(
        F.sum(F.col("weight") * F.col("theirs")).alias("product")
    )
    close = products.join(_norms(vectors), "key").select(
        F.col("key").alias("part"), "template", "licence", (F.col("product") / F.col("norm")).alias("cosine")
    ).where(F.col("cosine") >= MIN_COSINE)
    best = members.select("key", "part").join(close, "part").groupBy("key").agg(
        F.min(F.struct((-F.round("cosine", 9)).alias("far"), "licence")).alias("best")
    )
    return best.select("key", "best.licence", (-F.col("best.far")).alias("cosine"))


def scan_licences(files: DataFrame) -> DataFrame:
    """(path, licence, cosine, inherited_from) of every file: its own licence, or that of the
    nearest folder above that has a licence file; null without any.
    """
    content = F.coalesce("content", F.lit(""))
    rows = files.select(
        "path", licence_texts(F.coalesce("path", F.lit("")), content).alias("texts"), declared(content).alias("spdx")
    ).select(
        "path", folder_of(F.col("path")).alias("folder"), "spdx",
        F.when(
            F.col("spdx").isNotNull() | (F.size("texts") > 0),
            F.md5(F.encode(F.concat_ws("\u0000", F.coalesce("spdx", F.lit("")), "texts"), "UTF-8")),
        ).alias("key"), "texts",
    )
    texts = written(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("texts").alias("texts"), F.first("spdx").alias("spdx")
    ), "licence_texts")
    classes = written(classify_texts(texts.where("spdx IS NULL")).unionByName(
        texts.where("spdx IS NOT NULL").select("key", F.col("spdx").alias("licence"), F.lit(1.0).alias("cosine"))
    ), "licences")
    # Files without a licence text are not dealt out by a key of nulls.
    with_text = rows.where("key IS NOT NULL").join(classes, "key", "left").select(
        "path", "folder", "licence", "cosine"
    )
    own = with_text.unionByName(
        rows.where("key IS NULL").select(
            "path", "folder", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("cosine")
        )
    )
    holders = with_text.where(F.col("licence").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("folder").agg(
        F.min(F.struct((-F.col("cosine")).alias("far"), "path", "licence")).alias("best")
    ).select(F.col("folder").alias("above"), F.col("best.licence").alias("given"))
    holders = written(holders, "holders")
    folders = rows.where("folder IS NOT NULL").select("folder").distinct()
    names = F.split("folder", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/")
    )
    nearest = written(
        folders.select("folder", F.posexplode(F.array_distinct(ancestors)).alias("depth", "above"))
        .join(holders, "above").groupBy("folder")
        .agg(F.max_by(F.struct("above", "given"), "depth").alias("near"))
        .select(F.col("folder").alias("of"), "near.above", "near.given"), "nearest",
    )
    missing = F.col("licence").isNull()
    return own.join(nearest, F.col("folder") == F.col("of"), "left").select(
        "path", F.coalesce("licence", "given").alias("licence"), "cosine",
        F.when(missing, F.col("above")).alias("inherited_from"),
    )
