"""Licence scans by sentence rules: known sentences get identifiers, sequences of identifiers meet ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Sentences of licence notices and texts, by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-short": "Released under the MIT License",
    "mit-under": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "ccbync-short": "Licensed under CC BY-NC 4.0",
    "ccby-short": "Licensed under CC BY 4.0",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
}
#: Rules in order: licence, identifiers that must follow each other in a document (others may stand between).
RULES = [
    ("Apache-2.0", ["apache-head", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-head", "apache-comply"]),
    ("Apache-2.0", ["apache-short"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-under"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("CC-BY-NC-4.0", ["ccbync-short"]),
    ("CC-BY-4.0", ["ccby-short"]),
    ("BSD", ["bsd-head", "bsd-source"]),
]
#: Fixed values, as above; the rules' numbers follow those of RULES.
MORE_SENTENCES = {
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-later": "either version 2 of the License, or (at your option) any later version",
    "lgpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-later": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc0-short": "Licensed under CC0 1.0",
    "ccbysa-short": "Licensed under CC BY-SA 4.0",
    "unlicense-head": "This is free and unencumbered software released into the public domain",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
MORE_RULES = [
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl2-later"]),
    ("LGPL-2.1-or-later", ["lgpl-redistribute", "lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("MPL-2.0", ["mpl-subject", "mpl2-copy"]),
    ("ISC", ["isc-grant"]),
    ("CC0-1.0", ["cc0-short"]),
    ("CC-BY-SA-4.0", ["ccbysa-short"]),
    ("Unlicense", ["unlicense-head"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
]
#: The public-licence families by their members: sentences and rules are made from these.
SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0 NCSA OFL-1.1 OSL-3.0 PostgreSQL
PSF-2.0 Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
#: Sentences of further licences; each tells its own.
SINGLE = {
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "GPL-2.0-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
}
#: Licences that are often offered together, and exceptions with the licences they are made to; expressions are made from these.
TOGETHER = ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "MPL-2.0", "Unlicense"]
EXCEPTIONS = {"Classpath-exception-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "GCC-exception-3.1": ["GPL-3.0-or-later"], "Linux-syscall-note": ["GPL-2.0-only", "GPL-2.0-or-later"], "LLVM-exception": ["Apache-2.0"]}


def catalogue() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """All sentences by identifier, and all rules in order."""
    sentences, rules = SENTENCES | MORE_SENTENCES, RULES + MORE_RULES

    def one(identifier: str, sentence: str, licence: str) -> None:
        if sentence not in sentences.values():
            sentences[identifier] = sentence
            rules.append((licence, [identifier]))

    for licence, sentence in SINGLE.items():
        one(f"single-{licence}", sentence, licence)
    for x in SPDX:
        one(f"spdx-{x}", f"SPDX-License-Identifier: {x}", x)
    for x, name in CREATIVE_COMMONS.items():
        for version, kind in (("4.0", "International"), ("3.0", "Unported")):
            one(f"cc-{x}-{version}", f"Licensed under CC {x} {version}", f"CC-{x}-{version}")
            one(f"cc-{x}-{version}-long", f"This work is licensed under a Creative Commons {name} {version} {kind} License", f"CC-{x}-{version}")
    for x, (name, version) in GNU.items():
        one(f"gnu-{x}", f"This work is licensed under the GNU {name} Public License, version {version}", f"{x}-only")
    # An expression of two licences gives both.
    for a in TOGETHER:
        for b in TOGETHER:
            for word in ("OR", "AND"):
                if a != b:
                    sentences[f"spdx-{a}-{word}-{b}"] = f"SPDX-License-Identifier: ({a} {word} {b})"
                    rules += [(x, [f"spdx-{a}-{word}-{b}"]) for x in (a, b)]
    for exception, licences in EXCEPTIONS.items():
        for x in licences:
            one(f"spdx-{x}-{exception}", f"SPDX-License-Identifier: {x} WITH {exception}", f"{x} WITH {exception}")
    return sentences, rules


SPLIT = r"[.!?;]+[ \t\r]+|[\r\n]+"
#: Comment marks at the beginning or end of a line; blank lines, but for one before an address; sentence ends within a paragraph, where a colon at a line's end and a list mark cut too.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
PARAGRAPHS = r"\n(?:[ \t\r]*\n)+(?![ \t]*https?://)"
WITHIN = r"[.!?;]+[ \t\r\n]+|:[ \t\r]*\n\s*|\n[ \t]*(?:[0-9]+[.)]|[-*\u2022]|\([a-z0-9]\))[ \t]+"


def normal(c: str) -> str:
    """SQL: lower case, all but a-z and 0-9 to single blanks."""
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' '))"


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def sentence_table(spark: SparkSession, sentences: dict[str, str]) -> DataFrame:
    """(sentence_id, sentence) as scan() takes it."""
    return spark.createDataFrame(list(sentences.items()), "sentence_id string, sentence string")


def rule_table(spark: SparkSession, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(rule, licence, sentence_ids) as scan() takes it."""
    return spark.createDataFrame([(i, licence, ids) for i, (licence, ids) in enumerate(rules)], "rule long, licence string, sentence_ids array<string>")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= shared.BROADCAST_ROWS else df


def identified(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, wrapped, part, at, sentence_id of the known sentences, in the order of (part, at); a sentence of two identifiers gives both.

    Texts are cut twice: into lines (wrapped is false, at the sentence's number), and into paragraphs without comment
    marks, whose single line ends are blanks (wrapped is true, part the paragraph, at the place in it).
    A paragraph's own lines count there as well, so that sentences of either form stand in one order.
    """
    known = sentences.selectExpr("sentence_id", f"{normal('sentence')} as sentence").where("sentence <> ''")
    texts = shared.texts(docs)
    lines = texts.select("doc_id", F.lit(False).alias("wrapped"), F.lit(0).alias("part"), F.posexplode_outer(F.split("text", SPLIT)).alias("at", "sentence")).withColumn("sentence", F.expr(normal("sentence")))
    parts = texts.select("doc_id", F.posexplode_outer(F.split(F.regexp_replace("text", MARKS, ""), PARAGRAPHS)).alias("part", "paragraph"))
    cuts = F.array_distinct(F.transform(F.concat(F.split("paragraph", WITHIN), F.split("paragraph", SPLIT)), _normal))
    # What isn't known by its hash goes before a paragraph's sentences become rows: a paragraph is as long as a text can be.
    hashes = F.array(*[F.lit(r[0]) for r in known.select(F.xxhash64("sentence")).distinct().collect()] or [F.lit(0)])  # as many as the catalogue has
    # The outer forms: for the others Spark pushes a test of the array's size down, and computes the array once more for it.
    some = F.transform(F.filter(cuts, lambda x: F.array_contains(hashes, F.xxhash64(x))), lambda x: F.struct(F.instr(_normal(F.col("paragraph")), x).alias("at"), x.alias("sentence")))
    joined = parts.select("doc_id", F.lit(True).alias("wrapped"), "part", F.explode_outer(some).alias("x")).where("x is not null").select("doc_id", "wrapped", "part", "x.at", "x.sentence")
    return lines.unionByName(joined).join(_small(known), "sentence").select("doc_id", "wrapped", "part", "at", "sentence_id")


def scan(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row per document and licence: doc_id, licence, rule (number of the first rule of the licence that is met), n_sentences (known ones in the document).

    sentences and rules are tables as of sentence_table and rule_table, the built-in catalogue if not given. A rule is met
    if its identifiers occur in its order, in the lines or in the paragraphs; others may stand between, and of several
    identifiers of one sentence, or equal ones at one place, each counts. A null or empty text has no sentence; sentences
    without letters or digits are none; repeated rows of a doc_id give one row. Documents without a known licence have no
    row. BSD-2-Clause is given where BSD-3-Clause isn't met.
    """
    spark = docs.sparkSession
    own_sentences, own_rules = catalogue()
    sentences = sentence_table(spark, own_sentences) if sentences is None else sentences
    rules = rule_table(spark, own_rules) if rules is None else rules
    found = identified(docs, sentences).groupBy("doc_id", "wrapped").agg(F.expr("transform(array_sort(collect_set(struct(part, at, sentence_id))), x -> x.sentence_id)").alias("ids"), F.countDistinct("part", "at", "sentence_id").alias("n_sentences"))
    # Both uses below would cut all texts anew; a row a document that has a known sentence is little.
    found = shared.written(found, "found")
    begin = found.select("doc_id", "ids", "n_sentences", F.explode(F.array_distinct("ids")).alias("first"))
    met = begin.join(_small(rules.withColumn("first", F.get("sentence_ids", F.lit(0)))), "first")
    # How many of the rule's identifiers have been met in order, along the document's.
    walked = F.aggregate("ids", F.lit(0), lambda k, x: F.when(F.get("sentence_ids", k) == x, k + 1).otherwise(k))
    met = met.where(walked == F.size("sentence_ids"))
    each = met.groupBy("doc_id", "licence").agg(F.min("rule").alias("rule"), F.max("n_sentences").alias("n_sentences"))
    every = found.groupBy("doc_id").agg(F.max("n_sentences").alias("n"))
    three = each.where("licence = 'BSD-3-Clause'").select("doc_id", F.lit("BSD-2-Clause").alias("licence"))
    out = each.drop("n_sentences").join(three, ["doc_id", "licence"], "left_anti").join(every, "doc_id")
    return out.select("doc_id", "licence", F.col("rule").cast("long").alias("rule"), F.col("n").cast("long").alias("n_sentences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """By containment in the whole normalised text instead of cutting it: sentences are looked for as runs of words, and rules are walked from place to place."""
    sentences, rules = catalogue()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    norm = "' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' '"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sentences.items())
    steps = ", ".join(f"({i}, {quote(licence)}, {k}, {quote(x)}, {len(ids)})" for i, (licence, ids) in enumerate(rules) for k, x in enumerate(ids))
    return f"""
WITH RECURSIVE known AS (SELECT id, {norm.format('s')} AS s FROM (VALUES {known}) v(id, s)),
step AS (SELECT * FROM (VALUES {steps}) v(rule, licence, k, id, n)),
d AS (SELECT doc_id, {norm.format("coalesce(text, '')")} AS t FROM documents WHERE doc_id IS NOT NULL),
hit AS (SELECT doc_id, id, t, s, (length(t) - length(replace(t, s, ' '))) // (length(s) - 1) AS times FROM d, known WHERE contains(t, s)),
walk AS (SELECT doc_id, rule, licence, 0 AS k, n, instr(t, s) AS pos FROM hit JOIN step USING (id) WHERE k = 0
UNION ALL SELECT w.doc_id, w.rule, w.licence, w.k + 1, w.n, w.pos + instr(substr(t, w.pos + 1), s) FROM walk w JOIN step x ON x.rule = w.rule AND x.k = w.k + 1 JOIN hit h ON h.doc_id = w.doc_id AND h.id = x.id WHERE instr(substr(t, w.pos + 1), s) > 0),
met AS (SELECT DISTINCT doc_id, licence, rule FROM walk WHERE k = n - 1)
SELECT doc_id, licence, CAST(min(rule) AS BIGINT) AS rule, CAST(any_value(n_sentences) AS BIGINT) AS n_sentences FROM met JOIN (SELECT doc_id, sum(times) AS n_sentences FROM hit GROUP BY 1) USING (doc_id)
WHERE licence <> 'BSD-2-Clause' OR doc_id NOT IN (SELECT doc_id FROM met WHERE licence = 'BSD-3-Clause') GROUP BY 1, 2
"""


ORACLE = _oracle()
