"""Licence scan: a trained paragraph classifier, natively on DataFrames.

1. Texts are cut into paragraphs (runs of lines that are not blank), paragraphs into lower-cased words, and
   words into hashed bigrams. The features are the bigrams of the template notices that at most COMMON of all
   ordinary paragraphs use.
2. One logistic regression for each family, and one for "unknown" (licence-like wording of no known
   family), is fitted by gradient descent whose steps are joins and aggregations. It learns from the
   templates and from at most SAMPLE paragraphs of ``docs`` (the first in the order of a hash), whose
   equal feature sets count as one weighted example. The steps work on these bounded tables in one
   partition each; what grows with ``docs`` is never put together so.
3. The probability that counts is calibrated on what the regressions did not learn from: the cut lies
   midway between the median own family of the wordings in HELD_OUT and the strongest family among all
   paragraphs of no family.
4. A prediction holds if the paragraph also contains CONFIRM of the bigrams of a template of that family,
   has what tells that family from its relatives (NEEDS: name, version, clauses) and nothing of a relative or
   of a denial (RIVALS, DENIED); otherwise, where only "unknown" fires, and where a relative has that many bigrams, it counts as unknown.
   The BSD texts begin alike: without a number of clauses their wording counts as bsd-3-clause.

All rows are scanned; only paragraphs that hold some feature are shuffled. The features (a few hundred,
given by the templates) are broadcast. No Python runs on the executors.

Defined cases: null and empty texts have no paragraphs; rows that repeat an id are told apart by their
texts, and rows equal in both are judged alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize

SAMPLE, SAMPLE_DOCS, COMMON, CONFIRM = 2000, 200, 0.01, 0.6
STEPS, RATE, DECAY = 8, 4.0, 1e-3

# Usual wordings of licence notices, by family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "This file is released under the terms of the Apache License 2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Creative Commons CC BY-NC 4.0",
        "Released under the Creative Commons Attribution-NonCommercial 4.0 licence",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Creative Commons CC BY-SA 4.0",
        "Released under the Creative Commons Attribution-ShareAlike 4.0 licence",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3",
        "GNU General Public License, version 3 or later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "unknown": (
        "All rights reserved under the terms of the agreement.",
        "See the license file for the terms of use.",
        "Distributed under a proprietary license.",
        "Licensed under the terms of the vendor agreement.",
        "This work is licensed under a custom license.",
        "Use is subject to license terms.",
        "This software may not be copied or distributed without written permission of the owner.",
        "Licensed for internal use only.",
    ),
}
# Other wordings, on which the cut is calibrated and which no regression learns from.
HELD_OUT = {
    "apache-2.0": ("This project is licensed under the Apache License, Version 2.0, see the file LICENSE", "Distributed under the terms of the Apache License 2.0"),
    "bsd-3-clause": ("This code is licensed under the BSD 3-Clause License, found in the root directory", "Redistribution and use in source and binary forms are permitted"),
    "cc-by-nc-4.0": ("The text is available under CC BY-NC 4.0.", "This dataset is licensed under a Creative Commons Attribution-NonCommercial 4.0 license"),
    "cc-by-sa-4.0": ("The text is available under CC BY-SA 4.0.", "Content is licensed under a Creative Commons Attribution-ShareAlike 4.0 license"),
    "gpl-3.0": ("This library is licensed under the GNU General Public License, version 3 only", "distributed under the GNU General Public License version 3"),
    "mit": ("This project is released under the MIT License, see LICENSE", "Permission is granted, free of charge, to any person obtaining a copy of this package"),
}
# Patterns that all have to be there, in lower case, for a family, and those that speak for a relative.
NEEDS = {
    "apache-2.0": (r"\bapache\b", r"\b2\.0\b"),
    "bsd-3-clause": (r"\bbsd\b|\bredistribut|\bneither the name of\b",),
    "cc-by-nc-4.0": (r"\bnon-?commercial\b|\bby-nc\b", r"\b4\.0\b"),
    "cc-by-sa-4.0": (r"\bshare-?alike\b|\bby-sa\b", r"\b4\.0\b"),
    "gpl-3.0": (r"\bgeneral public licen[sc]e\b|\bgpl", r"\bversion 3\b|\bgpl-?v?3"),
    "mit": (r"\bmit\b|\bgranted, free of charge\b|\bthis permission notice shall be included\b",),
}
RIVALS = {
    "apache-2.0": r"\bversion 1\b|\b1\.[01]\b",
    "bsd-3-clause": r"\b([024]|two|four|zero)[- ]clause\b|\badvertising materials\b",
    "cc-by-nc-4.0": r"\b[123]\.[05]\b|\bshare-?alike\b|\bno-?deriv|\b(sa|nd)\b",
    "cc-by-sa-4.0": r"\b[123]\.[05]\b|\bnon-?commercial\b|\bno-?deriv|\b(nc|nd)\b",
    "gpl-3.0": r"\blesser\b|\blibrary general\b|\baffero\b|\b[la]gpl|\bversion [12]\b|\bgpl-?v?[12]",
    "mit": r"\bmit-0\b|\bno attribution\b",
}
DENIED = r"\b(not|never|neither|nor|no longer|isn't|aren't) (been |be |yet )?(re)?(licen[sc]ed|released|distributed|published|available|covered|governed)\b"
_PAR = ("id", "t", "par")
_UNIT = (*_PAR, "unit")
_BLANK = r"\n\s*\n"
_WORD = r"[\p{L}\p{N}]+([.-][\p{L}\p{N}]+)*"


def bigrams(text):
    """Hashes of the neighbouring word pairs of a paragraph."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))

    def pairs(w):
        ends = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))
        return F.transform(ends, lambda x: F.xxhash64(x["a"], x["b"]))

    # the words are bound to a variable, so that they are cut once
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the row's text), par, text of every run of lines that are not blank."""
    whole = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole).alias("t"), F.posexplode(F.split(whole, _BLANK)).alias("par", "text"))
    return runs.filter(F.col("text").rlike(r"\S"))


def units(pars: DataFrame) -> DataFrame:
    """id, t, par, unit, text: the whole paragraph (unit 0) and, where it has several lines, each of them, so
    that a notice of one line is judged without its neighbours as well."""
    lines = F.split("text", "\n")
    return pars.select(*_PAR, F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array("text"))).alias("unit", "text"))


def possible(text):
    """The families that a text's own words leave possible."""

    def fitting(low):
        fits = {f: reduce(and_, (low.rlike(p) for p in NEEDS[f])) & ~low.rlike(RIVALS[f]) & ~low.rlike(DENIED) for f in NEEDS}
        return F.array_compact(F.array(*(F.when(fit, F.lit(f)) for f, fit in fits.items())))

    # the text is bound to a variable, so that it is put in lower case once
    return F.get(F.transform(F.array(F.lower(text)), fitting), F.lit(0))


def templates(spark: SparkSession, of: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """template, family, gram."""
    rows = [F.struct(F.lit(f"{family}/{k}").alias("template"), F.lit(family).alias("family"), F.lit(text).alias("text")) for family, texts in of.items() for k, text in enumerate(texts)]
    listed = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    return listed.select("template", "family", F.explode(F.array_distinct(bigrams(F.col("text")))).alias("gram"))


def _sample(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ex, gram) of at most SAMPLE paragraphs; gram is null where a paragraph has none."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    # at most SAMPLE_DOCS ids are broadcast
    some = paragraphs(docs, id_col, text_col).join(F.broadcast(ids), "id", "left_semi").orderBy(F.xxhash64("id", "par"), *_PAR).limit(SAMPLE)
    return some.select(F.concat_ws("/", F.lit("text"), *(F.col(c).cast("string") for c in _PAR)).alias("ex"), F.explode_outer(F.array_distinct(bigrams(F.col("text")))).alias("gram"))


def _paragraph_sets(docs: DataFrame, every: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set, n): the template bigrams that a paragraph holds, and how many of all paragraphs hold just these."""
    all_of = F.broadcast(every.agg(F.collect_set("gram").alias("known")))
    sets = paragraphs(docs, id_col, text_col).crossJoin(all_of).select(F.array_sort(F.array_intersect(bigrams(F.col("text")), "known")).alias("set"))
    return materialize(sets.groupBy("set").agg(F.count(F.lit(1)).alias("n")), "licence-sets")


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table whose size the templates and SAMPLE bound, kept in one partition: steps over it need no shuffle."""
    return materialize(df.coalesce(1), name).coalesce(1)


class LicenceModel:
    """Small tables: weights (family, gram, w), bias (family, b), grams of templates; and the cut."""

    def __init__(self, weights: DataFrame, bias: DataFrame, grams: DataFrame, cut: float):
        self.weights, self.bias, self.grams, self.cut = weights, bias, grams, cut


def _probabilities(examples: DataFrame, features: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """(ex, family, y, n, p) from (ex, own, n), (ex, gram)."""
    sums = features.join(weights, "gram").groupBy("ex", "family").agg(F.sum("w").alias("z"))
    pairs = examples.withColumn("family", F.explode(F.array(*(F.lit(f) for f in TEMPLATES)))).join(F.broadcast(bias), "family")
    z = F.coalesce("z", F.lit(0.0)) + F.col("b")
    return pairs.join(sums, ["ex", "family"], "left").select("ex", "own", "family", "n", F.coalesce(F.col("own") == F.col("family"), F.lit(False)).cast("double").alias("y"), (1 / (1 + F.exp(-z))).alias("p"))


def fit(docs: DataFrame, id_col: str, text_col: str) -> LicenceModel:
    spark = docs.sparkSession
    sample = materialize(_sample(docs, id_col, text_col), "licence-sample")
    every = templates(spark)
    # sampled paragraphs that hold most of a template are notices themselves, and no examples of ordinary text
    sized = every.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("template")))
    notices = sample.join(sized, "gram").groupBy("ex", "template", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONFIRM * F.col("size")).select("ex").distinct()
    sample = materialize(sample.join(notices, "ex", "left_anti"), "licence-ordinary")
    every_set = _paragraph_sets(docs, every, id_col, text_col)
    held = every_set.select("set", F.explode("set").alias("gram")).join(sized, "gram").groupBy("set", "template", "size").agg(F.count(F.lit(1)).alias("k"))
    plain = materialize(every_set.join(held.filter(F.col("k") >= CONFIRM * F.col("size")).select("set").distinct(), "set", "left_anti"), "licence-plain")
    total = plain.agg(F.sum("n")).first()[0] or 0
    usual = plain.select("n", F.explode("set").alias("gram")).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > max(COMMON * total, 1)).select("gram")
    grams = every.join(usual, "gram", "left_anti")
    grams = _small(grams.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("template"))), "licence-grams")
    known = grams.select("gram").distinct()
    ordinary = sample.join(known.withColumn("known", F.lit(True)), "gram", "left")
    sets = ordinary.groupBy("ex").agg(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("gram")))).alias("set"))
    shared = sets.groupBy("set").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("ex", F.xxhash64("set").cast("string"))
    own = grams.groupBy("template", "family").agg(F.array_sort(F.collect_set("gram")).alias("set"))
    rows = own.select(F.col("template").alias("ex"), F.col("family").alias("own"), F.lit(20.0).alias("n"), "set").union(shared.select("ex", F.lit(None).cast("string"), "n", "set"))
    rows = _small(rows, "licence-examples")
    # a null gram stands for the bias: every example has it
    examples = rows.select("ex", "own", "n")
    features = rows.select("ex", F.explode(F.concat("set", F.array(F.lit(None).cast("long")))).alias("gram"))

    families = F.explode(F.array(*(F.lit(f) for f in TEMPLATES)))
    state = grams.select("gram").distinct().withColumn("w", F.lit(0.0)).union(spark.range(0, 1, 1, 1).select(F.lit(None).cast("long"), F.lit(-1.0))).withColumn("family", families)

    def split(state: DataFrame) -> tuple[DataFrame, DataFrame]:
        return state.filter("gram IS NOT NULL"), state.filter("gram IS NULL").select("family", F.col("w").alias("b"))

    for _ in range(STEPS):
        p = _probabilities(examples, features, *split(state))
        # an ordinary paragraph weighs less the more of them there are, so the families keep their say
        left = p.select("ex", "family", ((F.col("y") - F.col("p")) * F.least(F.col("n"), F.lit(20.0))).alias("r"))
        up = features.join(left, "ex").groupBy("gram", F.col("family").alias("of")).agg(F.sum("r").alias("g"))
        step = RATE * 0.25 * F.coalesce("g", F.lit(0.0))
        w = F.when(state["gram"].isNull(), F.col("w") + step / 200).otherwise(F.col("w") * (1 - DECAY) + step / 20)
        state = _small(state.join(up, state["gram"].eqNullSafe(up["gram"]) & (F.col("family") == F.col("of")), "left").select(state["gram"], w.alias("w"), "family"), "licence-weights")
    weights, bias = split(state)
    # the cut is that of all paragraphs and of wordings that were not learned
    all_of = F.broadcast(known.agg(F.collect_set("gram").alias("known")))
    plain_sets = plain.crossJoin(all_of).groupBy(F.array_sort(F.array_intersect("set", "known")).alias("set")).agg(F.sum("n").cast("double").alias("n"))
    unseen = templates(spark, HELD_OUT).join(known, "gram").groupBy("template", "family").agg(F.array_sort(F.collect_set("gram")).alias("set"))
    none = F.lit(None).cast("string")
    rows = unseen.select(F.concat(F.lit("held/"), "template").alias("ex"), F.col("family").alias("own"), F.lit(1.0).alias("n"), "set").union(plain_sets.select(F.concat_ws(",", F.col("set").cast("array<string>")), none, "n", "set"))
    rows = rows.union(own.filter("family = 'unknown'").select(F.col("template").alias("ex"), F.col("family").alias("own"), F.lit(1.0).alias("n"), "set"))
    rows = materialize(rows, "licence-calibration")
    p = _probabilities(rows.select("ex", "own", "n"), rows.select("ex", F.explode("set").alias("gram")), weights, bias)
    usual_own = F.median(F.when((F.col("y") == 1) & (F.col("own") != "unknown"), F.col("p")))
    strongest = F.max(F.when((F.col("family") != "unknown") & (F.col("own").isNull() | (F.col("own") == "unknown")), F.col("p")))
    low, high = p.agg(usual_own, strongest).first()
    cut = min(0.8, max(0.2, ((low or 0.5) + (high or 0.5)) / 2))
    return LicenceModel(weights, bias, grams, cut)


def classify(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t, par, family ("unknown" included), p, confirmed: one row per paragraph that is a notice and family
    of it. A family whose wording in the paragraph is part of what another one's wording covers is not
    another family of it."""
    held = materialize(model.grams.groupBy("gram").agg(F.collect_list(F.struct("template", "family", "size")).alias("held")), "licence-held")
    all_of = F.broadcast(held.agg(F.collect_set("gram").alias("known")))
    # one row for each text that holds some feature; only its words decide what is possible, once, and not for every bigram
    some = F.filter(F.array(F.array_intersect(bigrams(F.col("text")), F.col("known"))), lambda x: F.size(x) > 0)
    found = units(paragraphs(docs, id_col, text_col)).crossJoin(all_of).select(*_UNIT, "text", F.explode(some).alias("grams"))
    hits = materialize(found.select(*_UNIT, possible(F.regexp_replace("text", r"\s+", " ")).alias("possible"), "grams").distinct(), "licence-hits")
    each = hits.select(*_UNIT, "possible", F.explode("grams").alias("gram")).join(F.broadcast(held), "gram").select(*_UNIT, "possible", "gram", "held")
    z = each.join(F.broadcast(model.weights), "gram").groupBy(*_UNIT, "possible", "family").agg(F.sum("w").alias("z"))
    p = z.join(F.broadcast(model.bias), "family").select(*_UNIT, F.array_contains("possible", F.col("family")).alias("fits"), "family", (1 / (1 + F.exp(-(F.col("z") + F.col("b"))))).alias("p"))
    share = each.select(*_UNIT, "gram", F.explode("held").alias("of")).groupBy(*_UNIT, "of.family", "of.template", "of.size").agg(F.count(F.lit(1)).alias("n"), F.collect_set("gram").alias("grams"))
    share = share.groupBy(*_UNIT, "family").agg(F.max(F.col("n") / F.col("size")).alias("share"), F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    same = p["id"].eqNullSafe(share["id"]) & (p["t"] == share["t"]) & (p["par"] == share["par"]) & (p["unit"] == share["unit"]) & (p["family"] == share["family"])
    both = p.join(share, same, "left").select(p["id"], p["t"], p["par"], p["family"], "p", "fits", F.coalesce("share", F.lit(0.0)).alias("share"), "grams")
    sure = (F.col("family") != "unknown") & F.col("fits") & (F.col("p") >= model.cut) & (F.col("share") >= CONFIRM)
    refused = (F.col("family") != "unknown") & ~F.col("fits") & (F.col("share") >= CONFIRM)
    of_par = both.groupBy(*_PAR).agg(F.collect_list(F.when(sure, F.struct("p", "family", "grams"))).alias("sure"), F.max("p").alias("most"), F.max(refused).alias("refused"))

    def covers(y, x):
        within = F.size(F.array_except(x["grams"], y["grams"])) == 0
        more = F.size(y["grams"]) > F.size(x["grams"])
        first = (y["p"] > x["p"]) | ((y["p"] == x["p"]) & (y["family"] > x["family"]))
        return (y["family"] != x["family"]) & within & (more | first)

    own = F.filter("sure", lambda x: ~F.exists("sure", lambda y: covers(y, x)))
    own = of_par.filter((F.size("sure") > 0) | (F.col("most") >= model.cut) | F.col("refused")).select(*_PAR, "most", F.explode_outer(own).alias("x"))
    return own.groupBy(*_PAR, F.coalesce("x.family", F.lit("unknown")).alias("family")).agg(F.max(F.coalesce("x.p", "most")).alias("p"), F.max(F.col("x").isNotNull()).alias("confirmed"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, families (confirmed, in order), n_confirmed and n_unknown (paragraphs)."""
    found = classify(docs, fit(docs, id_col, text_col), id_col, text_col)
    by_row = found.groupBy("id", "t").agg(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"), F.size(F.collect_set(F.when(F.col("confirmed"), F.col("par")))).cast("long").alias("n_confirmed"), F.sum((~F.col("confirmed")).cast("long")).alias("n_unknown"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("of"))
    none = F.lit(0).cast("long")
    return rows.join(by_row.hint("merge"), rows["doc"].eqNullSafe(by_row["id"]) & (rows["of"] == by_row["t"]), "left").select(
        F.col("doc").alias(id_col), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_confirmed", none).alias("n_confirmed"), F.coalesce("n_unknown", none).alias("n_unknown")
    )
