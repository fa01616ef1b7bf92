"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A header is a line that speaks of licensing; of a licence file (by its name) the whole text counts too.  Lines are
scored against short notices, whole texts against notices and against the full texts of the licences.  Full texts have a
threshold of their own, as long texts share many common words; one that is reached decides before any notice.
Equal headers are scored once.  Inverse document frequencies are taken over all headers of the corpus; the
vectors are sparse: rows (header, term, weight) joined with those of the templates.  A file without a
licence of its own takes that of the nearest directory above it, its own included, that holds a licence file:
directories are exploded to their ancestors and joined with the directories of licence files.

Everything is a join or an aggregation; what moves are headers, terms and directories, never texts.

Defined cases: null texts have no headers; a null path stands for a file in the root; of templates that tie
the first by name wins, of licence files of one directory the best scored, then the first by licence name; rows that
share a path are scored each by its text; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast
from .common import stash, text_key

# Short public notices of common licences.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Full texts; older and other licences are there so that their files aren't taken for the nearest of the above.
#: AGPL-3.0 and CC-BY-NC-4.0 are made from GPL-3.0 and CC-BY-4.0 by the passages that differ.
TEXTS = [(x.stem, x.read_text("utf-8")) for x in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
HEADER = r"(?i)licen[cs]e|copyright|\bspdx\b|redistribution|permission is hereby"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


@dataclass(frozen=True)
class LicenseParams:
    min_score: float = 0.6
    #: For whole texts against full texts.
    min_text: float = 0.7


DEFAULT = LicenseParams()


def _terms(df: DataFrame, text: str, *keys: str | Column) -> DataFrame:
    """(keys, term, tf) of a text column."""
    t = df.select(*keys, F.explode(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")).alias("term"))
    return t.groupBy(*t.columns).agg(F.count("*").alias("tf"))


def _templates(spark: SparkSession) -> DataFrame:
    """n, license, whole and text; ``whole`` tells full texts from notices."""
    both = [(name, False, text) for name, text in TEMPLATES] + [(name, True, text) for name, text in TEXTS]
    rows = [F.struct(F.lit(i).alias("n"), F.lit(name).alias("license"), F.lit(whole).alias("whole"), F.lit(text).alias("text")) for i, (name, whole, text) in enumerate(both)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def scores(headers: DataFrame) -> DataFrame:
    """Best notice and best full text of each header: header, whole, full (of the template), license, score.

    ``headers`` has header, whole (a whole text, else a line) and n, its occurrences."""
    spark = headers.sparkSession
    headers = headers.withColumn("hid", F.sha2("header", 256))
    total = headers.agg(F.sum("n")).first()[0] or 0
    terms = stash(_terms(headers, "header", "hid", "whole", "n"), "license-terms")
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((1 + F.lit(float(total))) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weights = stash(terms.join(df, "term").select("hid", "whole", "term", (F.col("tf") * idf).alias("w")), "license-weights")
    norms = weights.groupBy("hid", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # the templates are a fixed list: broadcast
    t = _terms(_templates(spark), "text", "n", "license", F.col("whole").alias("full")).join(df, "term", "left").select("n", "license", "full", "term", (F.col("tf") * idf).alias("tw"))
    t = stash(t, "license-templates")
    tn = t.groupBy("n").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    # lines meet notices, whole texts meet both
    t = t.select("*", F.explode(F.when(F.col("full"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("whole"))
    dots = weights.join(F.broadcast(t), ["term", "whole"]).groupBy("hid", "whole", "n", "license", "full").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    s = dots.join(F.broadcast(tn), "n").join(norms, ["hid", "whole"]).select(
        "hid", "whole", "full", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9).alias("score"))
    best = s.groupBy("hid", "whole", "full", "score").agg(F.min("license").alias("license")).groupBy("hid", "whole", "full").agg(
        F.max("score").alias("score"), F.max_by("license", "score").alias("license"))
    return headers.select("hid", "header", "whole").join(best, ["hid", "whole"]).select("hid", "header", "whole", "full", "license", "score")


def score(headers: DataFrame) -> DataFrame:
    """Best notice of each distinct line: hid, license, score.  ``headers`` has header and n, its occurrences."""
    return scores(headers.withColumn("whole", F.lit(False))).select("hid", "license", "score")


def _units(texts: Column, whole: bool) -> Column:
    return F.transform(texts.cast("array<string>"), lambda x: F.struct(x.alias("header"), F.lit(whole).alias("whole")))


def scan(files: DataFrame, params: LicenseParams = DEFAULT, id_col: str = "id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, key, path, own_license and own_score (null: none), license, from_dir (null: its own or none) of every file."""
    f = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    f = f.withColumns({"key": text_key(F.col("text")), "dir": F.regexp_replace("path", r"/?[^/]*$", ""), "is_file": F.col("path").rlike(LICENCE_FILE)})
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADER))
    lines = F.transform(lines, lambda x: F.trim(x))
    units = f.where(F.col("is_file") | F.col("text").rlike(HEADER)).select(
        "id", "key", "path", "dir", "is_file", F.explode(F.concat(_units(lines, False), F.when(F.col("is_file"), _units(F.array("text"), True)).otherwise(_units(F.array(), True)))).alias("u")).select(
        "id", "key", "path", "dir", "is_file", "u.header", "u.whole")
    units = stash(units.withColumn("hid", F.sha2("header", 256)), "license-units")
    best = scores(units.groupBy("header", "whole").agg(F.count("*").alias("n"))).drop("header")
    best = stash(best, "license-scores").where(F.col("score") >= F.when(F.col("full"), params.min_text).otherwise(params.min_score))
    # a full text first, then by score
    rank = F.struct("full", "score", "license")
    own = units.select("id", "key", "path", "dir", "is_file", "hid", "whole").join(sized_broadcast(best, 200_000), ["hid", "whole"]).groupBy("id", "key", "path").agg(
        F.max_by("score", rank).alias("own_score"), F.max_by("license", rank).alias("own_license"), F.max("full").alias("full"),
        F.first("dir").alias("dir"), F.first("is_file").alias("is_file"))
    own = stash(own, "license-own")
    at = own.where("is_file").groupBy("dir").agg(F.min_by("own_license", F.struct(~F.col("full"), -F.col("own_score"), "own_license")).alias("dir_license"))
    at = at.select(F.col("dir").alias("from_dir"), "dir_license")
    dirs = f.select("dir").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).select(
        "dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("from_dir"))
    near = above.join(at, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license"), "depth").alias("near"))
    near = stash(near.select(F.col("dir").alias("ndir"), "near.from_dir", "near.dir_license"), "license-dirs")
    o = own.select(F.col("id").alias("oid"), F.col("key").alias("okey"), F.col("path").alias("opath"), "own_license", "own_score")
    out = f.select("id", "key", "path", "dir").join(o, F.col("id").eqNullSafe(F.col("oid")) & (F.col("key") == F.col("okey")) & (F.col("path") == F.col("opath")), "left")
    out = out.join(sized_broadcast(near, 500_000), F.col("dir") == F.col("ndir"), "left")
    return out.select("id", "key", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/thousand/doc_id.txt.  A document of under 400 words that opens with a notice is the
    LICENSE of its thousand, language or source, by the remainder of its id by 3."""
    opens = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*([^\n]*)", 1).rlike(HEADER) & (F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")) < 400)
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    top, lang, part = none("source"), none("lang"), F.coalesce(F.expr("cast(doc_id div 1000 as string)"), F.lit("(none)"))
    where = F.when(F.col("doc_id") % 3 == 2, top).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", top, lang)).otherwise(F.concat_ws("/", top, lang, part))
    path = F.when(opens, F.concat(where, F.lit("/LICENSE-"), none("doc_id"))).otherwise(F.concat(F.concat_ws("/", top, lang, part), F.lit("/"), none("doc_id"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")


def license_report(docs: DataFrame, params: LicenseParams = DEFAULT) -> DataFrame:
    s = scan(as_files(docs), params)
    return s.select(F.col("id").alias("doc_id"), "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "from_dir")
