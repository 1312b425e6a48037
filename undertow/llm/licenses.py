"""License scans with a positional index of rare licence words, in DataFrame operations only.

Templates' words and their positions form the index. A first pass counts in how many of all files each of
their words stands. Each template is then looked up by its own words of highest IDF, so many that an alignment
with enough words in place must have two of them. Postings that agree on ``position in file - position in
template`` propose an alignment, and it stands if enough of the template's words are in place and its key
phrases are in the file in full. The base phrases are templates that need all their words in place.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.llm.common import Scratch

#: Phrases whose every place counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, phrases that must all be present, and template text, in public licence wording.
TEMPLATES = [
    ("mit", ["permission is hereby granted free of charge", "the software is provided as is"], """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", ["permission is hereby granted free of charge"], """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files"""),
    ("isc", ["permission to use copy modify and or distribute this software"], """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", ["redistribution and use in source and binary forms"], """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("bsd", ["redistribution and use in source and binary forms"], """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met"""),
    ("apache", ["apache license"], """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("apache", ["apache license"], "Licensed under the Apache License, Version 2.0"),
    ("gpl", ["gnu general public license"], """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl", ["gnu general public license"], "licensed under the GNU General Public License, version 3"),
    ("lgpl", ["lesser general public license"], """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version."""),
    ("lgpl", ["lesser general public license"], "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", ["affero general public license"], """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version."""),
    ("agpl", ["affero general public license"], "licensed under the GNU Affero General Public License, version 3"),
    ("mpl", ["mozilla public license"], """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", ["free and unencumbered software", "released into the public domain"], """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""),
    ("zlib", ["altered source versions must be plainly marked"], """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. 3. This notice may not be removed or altered from any source distribution."""),
    ("isc", ["the author disclaims all warranties"], """
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd", ["provided by the copyright holders and contributors as is"], """
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED."""),
    ("bsd", ["may be used to endorse or promote products derived from this software"], """
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission."""),
    ("apache", ["terms and conditions for use reproduction and distribution"], """
        Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
        DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as
        defined by Sections 1 through 9 of this document."""),
    ("apache", ["apache license version 2 0 january 2004"], "Apache License Version 2.0, January 2004"),
    ("gpl", ["gnu general public license"], """
        The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most
        software and other practical works are designed to take away your freedom to share and change the works."""),
    ("gpl", ["gnu general public license"], """
        The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General
        Public License is intended to guarantee your freedom to share and change free software"""),
    ("lgpl", ["lesser general public license"], """
        This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU
        General Public License, supplemented by the additional permissions listed below."""),
    ("agpl", ["affero general public license"], """
        The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically
        designed to ensure cooperation with the community in the case of network server software."""),
    ("mpl", ["mozilla public license version 2 0"], """
        Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
        contributes to the creation of, or owns Covered Software."""),
    ("epl", ["eclipse public license"], """
        THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION
        OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."""),
    ("epl", [], "Eclipse Public License - v 1.0"),
    ("epl", [], "Eclipse Public License - v 2.0"),
    ("cc0", [], "CC0 1.0 Universal"),
]
#: The parts of attribution licences, short and in full; their versions; tags of licence files with labels.
CC_PARTS = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
CC_KINDS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
TAGS = {
    "mit": ["mit"], "apache": ["apache 2 0"], "gpl": ["gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 3 0"], "mpl": ["mpl 2 0"], "epl": ["epl 1 0", "epl 2 0"],
    "bsd": ["bsd 2 clause", "bsd 3 clause"], "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"], "cc0": ["cc0 1 0"],
}
SHORT = 12  # templates of fewer words need all of them in place


def short_templates() -> list[tuple[str, list[str], str]]:
    """Names of attribution licences, short and in full, by kind and version, and tags that name a file's licence."""
    out = [(label, [], f"spdx license identifier {tag}") for label, tags in TAGS.items() for tag in tags]
    for kind in CC_KINDS:
        full = " ".join(CC_PARTS[p] for p in kind.split("-"))
        for version in CC_VERSIONS:
            out += [(f"cc-{kind}", [], f"cc {kind} {version}"), (f"cc-{kind}", [], f"{'creative commons ' if kind == 'by' else ''}{full} {version}")]
    return out


SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The least share of a template's words in place.
COVERAGE = 0.7


def template_rows(coverage: float = COVERAGE) -> list[tuple]:
    """tpl, label, base, words, keys, need: the words that must be in place."""
    words = lambda text: [w for w in re.split(SEPARATORS, text.lower()) if w]
    rows = [(i, label, True, words(phrase), [f" {phrase} "], len(words(phrase))) for i, (phrase, label) in enumerate(BASE.items())]
    for i, (label, keys, text) in enumerate([*TEMPLATES, *short_templates()]):
        own = words(text)
        rows.append((len(BASE) + i, label, False, own, [f" {k} " for k in keys], len(own) if len(own) < SHORT else -int(-len(own) * coverage // 1)))
    return rows


def words_column(text: str):
    """Words of a text, with A-Z lower-cased and nothing else."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase), SEPARATORS), "")


def rare_positions(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """tpl, need, size, token, tpos: each template's positions of highest IDF by which it is looked up.

    An alignment that stands lacks at most size - need of its words, so of any size - need + 2 of them it has two.
    The document frequency of a word counts all rows of ``docs``; a word that no row has comes first.
    """
    vocab = sorted({w for _, _, _, words, _, _ in template_rows() for w in words})
    own = F.array_distinct(F.filter(words_column(text), lambda w: w.isin(vocab)))
    df = docs.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("df"))  # a row a template word
    index = templates.select("tpl", "need", F.size("words").alias("size"), F.posexplode("words").alias("tpos", "token"))
    by_tpl = Window.partitionBy("tpl").orderBy(F.coalesce("df", F.lit(0)), "token", "tpos")  # least frequency: highest IDF
    ranked = index.join(F.broadcast(df), "token", "left").withColumn("rank", F.row_number().over(by_tpl))
    return ranked.where(F.col("rank") <= F.col("size") - F.col("need") + 2).drop("rank", "df")


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``labels`` has those of base phrases and of aligned templates; ``score`` is the best share of a template's
    words in place among those that stand, 0 without any. Null and empty texts have no words and no labels (empty
    strings); an empty table gives no rows. Rows repeated with one key and text get equal results, rows with one
    key and several texts each their own; null keys are matched as values. Other columns play no part.
    """
    spark: SparkSession = docs.sparkSession
    disk = Scratch(spark, "licences")
    schema = "tpl int, label string, base boolean, words array<string>, keys array<string>, need int"
    templates = F.broadcast(spark.createDataFrame(template_rows(coverage), schema))
    rare = disk.write(rare_positions(docs, templates, text))
    looked = [r.token for r in rare.select("token").distinct().orderBy("token").collect()]  # words of the templates
    twice = [r.token for r in rare.groupBy("tpl", "token").count().where("count > 1").select("token").distinct().orderBy("token").collect()]
    counted = docs.select(F.col(key).alias("_own"), F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"), words_column(text).alias("_w"))
    found = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("pos"), w.alias("token"))), lambda s: s["token"].isin(looked))
    # Two postings of a template are of two words, or of one that it is looked up by at two places.
    tokens = F.array_distinct(F.transform("occ", lambda o: o["token"]))
    may = (F.size(tokens) >= 2) | (F.exists(tokens, lambda t: t.isin(twice)) if twice else F.lit(False)) & (F.size("occ") >= 2)
    rows = disk.write(
        counted.withColumn("occ", found).withColumn("may", may).select(
            "_own", "_key", "_h", F.size("_w").cast("long").alias("n_words"), F.when(F.col("may"), F.col("occ")).alias("occ"), F.when(F.col("may"), F.col("_w")).alias("words")
        )
    )
    ids = ["_key", "_h"]
    files = rows.where("occ is not null")
    postings = files.select(*ids, F.explode("occ").alias("o")).select(*ids, "o.pos", "o.token").dropDuplicates([*ids, "pos"])
    at = (F.col("pos") - F.col("tpos")).alias("at")
    proposed = postings.join(F.broadcast(rare), "token").select(*ids, "tpl", at).groupBy(*ids, "tpl", "at").agg(F.count("*").alias("hit"))
    proposed = disk.write(proposed.where("hit >= 2").drop("hit"))
    texts = files.select(*ids, "words").join(proposed.select(*ids).distinct(), ids, "left_semi").dropDuplicates(ids)
    own = templates.select("tpl", "label", "base", "need", "keys", F.col("words").alias("t"))
    tried = texts.join(proposed, ids).join(F.broadcast(own), "tpl")
    in_place = F.size(F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("words", F.col("at") + i) == F.get("t", i)))
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    stands = tried.withColumn("hit", in_place).where("hit >= need").where(F.forall("keys", lambda k: F.contains(line, k)))
    base_at = F.when(F.col("base"), F.col("at"))
    per_doc = stands.groupBy(*ids).agg(
        F.count_if("base").alias("n_base"),
        F.min(base_at).cast("long").alias("first_word"),
        F.max(base_at).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(F.col("hit") / F.size("t")).alias("score"),
    )
    return rows.drop("occ", "words").join(per_doc, ids, "left").select(
        F.col("_own").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
