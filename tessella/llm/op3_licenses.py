"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at line ends and after `.`, `!`, `?` or `;` before white space. A sentence
is normalised: lower case, every run of other characters than a-z and 0-9 one space. Known licence
sentences have an identifier; the sentences of a text become a sequence of identifiers and unknowns. A
rule is a licence and an ordered sequence of identifiers; it matches where they follow each other.
A text is also cut as licences are published: line ends inside a paragraph are blanks, numbered items and
what follows a colon at a line's end are paragraphs, a version like "v. 2.0" has no sentence end, and pieces
without a letter are not counted. A rule that the first cut doesn't find in a text is reported from this
one, with its numbers of sentences. A match whose sentences are part of a longer rule's match in the same
cut is not reported: three clauses are not two.
A step of a rule at its place n votes for the match that starts n sentences before, and a match is a
start with a vote for every step, so a rule needs one join and one aggregation whatever its length.

Both tables are fixed: the sentences and rules below, broadcast. Nothing else is. Texts without any of a
few words, of which every known sentence has one, are not cut at all.

Nulls and odd input: null and empty texts have no sentences; null doc_ids are scanned and give null; texts
are told apart by their hash, so different texts under one doc_id or without one never make a match
together; repeated rows each match, and count together in `copies`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents

# Sentences of published licences and notices, normalised.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    6: "licensed under the apache license version 2 0",
    7: "licensed under the apache license version 2 0 the license",
    8: "you may not use this file except in compliance with the license",
    9: "you may obtain a copy of the license at",
    10: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    11: "this work is licensed under the gnu general public license version 3",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    13: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    14: "see the gnu general public license for more details",
    15: "licensed under cc by nc 4 0",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "this work is licensed under a creative commons attribution 4 0 international license",
    19: "all rights reserved",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "spdx license identifier mit",
    24: "spdx license identifier apache 2 0",
    25: "spdx license identifier gpl 3 0 or later",
    26: "spdx license identifier bsd 3 clause",
    27: "this source code form is subject to the terms of the mozilla public license v 2 0",
    28: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    29: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    30: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    31: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    32: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    33: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    34: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    35: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    36: "see the gnu affero general public license for more details",
    37: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    38: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    39: "see the gnu lesser general public license for more details",
    40: "this is free and unencumbered software released into the public domain",
    41: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    42: "distributed under the boost software license version 1 0",
    43: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    44: "spdx license identifier bsd 2 clause",
    45: "spdx license identifier isc",
    46: "spdx license identifier mpl 2 0",
    47: "spdx license identifier gpl 2 0 or later",
    48: "spdx license identifier agpl 3 0 or later",
    49: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    50: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
# Licence, then the identifiers that make it up in order.
RULES = [
    ("MIT", [1]), ("MIT", [2]), ("MIT", [3, 4, 5]), ("MIT", [23]),
    ("Apache-2.0", [6]), ("Apache-2.0", [7, 8, 9]), ("Apache-2.0", [10]), ("Apache-2.0", [24]),
    ("GPL-3.0", [11]), ("GPL-3.0", [12, 13, 14]), ("GPL-3.0", [25]),
    ("CC-BY-NC-4.0", [15]), ("CC-BY-4.0", [16]), ("CC-BY-4.0", [18]), ("CC-BY-SA-4.0", [17]),
    ("BSD-3-Clause", [20, 21, 22, 29]), ("BSD-3-Clause", [26]), ("MPL-2.0", [27, 28]), ("All-Rights-Reserved", [19]),
    ("BSD-2-Clause", [20, 21, 22]), ("BSD-2-Clause", [44]), ("MIT", [3, 4, 5, 30]), ("MPL-2.0", [27, 31]), ("MPL-2.0", [46]),
    ("ISC", [32]), ("0BSD", [33]), ("ISC", [45]), ("GPL-2.0", [34, 13, 14]), ("GPL-2.0", [47]), ("AGPL-3.0", [35, 13, 36]),
    ("AGPL-3.0", [48]), ("LGPL-2.1", [37, 38, 39]), ("Unlicense", [40, 41]), ("BSL-1.0", [42]), ("Zlib", [43]),
    ("CC-BY-SA-4.0", [49]), ("CC-BY-NC-4.0", [50]),
]
# Where a sentence ends, and what turns a published text into paragraphs of one line, in order.
STOP = (r"([.!?;])[ \t]+", "$1\n")
PUBLISHED = [
    (r"\r\n?", "\n"),
    (r"(?m)^[^\p{L}\p{N}\n]+$", ""),  # a line of comment marks is blank
    (r"(?i)https?://(www\.)?apache\.org/licenses/license-2\.0(\.txt|\.html)?", "\n\n"),
    (r"(?i)(without any warranty);", "$1,"),  # the known GPL sentence goes on after it
    (r"(?i)\bv\.[ \t\n]*([0-9])", "v $1"),
    (r"(^|\n)[^\p{L}\p{N}\n]*[0-9]{1,2}[.)][ \t]+", "\n\n"),
    (r"([:.;])[ \t]+\(?[0-9]{1,2}[.)][ \t]+", "$1\n\n"),
    (r":[ \t]*\n", ":\n\n"),
    (r"(?i)(following conditions(?: are met)?):[ \t]+", "$1:\n\n"),
    (r"\n\n+", "\x02"),
    (r"\n", " "),
    (r"\x02", "\n\n"),
]


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return text


def sentences_of(text: Column) -> Column:
    return F.split(replaced(text, [STOP]), r"[\n\r]+")


def published(text: Column) -> Column:
    """The sentences of a text with wrapped lines and numbered items."""
    return F.filter(sentences_of(replaced(text, PUBLISHED)), lambda x: x.rlike(r"\p{L}"))


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def tell_tales(sentences: list[str]) -> list[str]:
    """A few words of which every sentence has one: always the word that most of the rest have."""
    left, out = [set(s.split()) for s in sentences], []
    while left:
        n = Counter(w for s in left for w in s)
        out.append(max(n, key=lambda w: (n[w] * (len(w) >= 5), len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def inside(rules: list[tuple[str, list[int]]]) -> list[tuple[int, int, int]]:
    """(longer rule, shorter rule, place) where the identifiers of the shorter one stand in the longer."""
    return [(a, b, k) for a, (_, x) in enumerate(rules) for b, (_, y) in enumerate(rules) if len(y) < len(x) for k in range(len(x) - len(y) + 1) if x[k : k + len(y)] == y]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict[int, str] | None = None, rules: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """doc_id, license, rule, first_sentence, last_sentence, copies of every match."""
    spark = docs.sparkSession
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = spark.createDataFrame(list(sentences.items()), "id int, sentence string")
    steps = spark.createDataFrame([(r, name, k, len(ids), i) for r, (name, ids) in enumerate(rules) for k, i in enumerate(ids)], "rule int, license string, step int, steps int, id int")
    voters = known.join(F.broadcast(steps), "id").select("sentence", "rule", "license", "step", "steps")
    # a normalised sentence's words are runs of a-z and 0-9 in its text, so a text without these words has none
    some = docs.where(F.lower(F.col(text)).rlike("|".join(tell_tales(list(sentences.values())))))
    rows = some.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    cuts = F.array(F.struct(F.lit(0).alias("cut"), sentences_of(F.col("text")).alias("parts")), F.struct(F.lit(1).alias("cut"), published(F.col("text")).alias("parts")))
    said = rows.select("doc_id", "h", F.explode(cuts).alias("c")).select("doc_id", "h", "c.cut", F.posexplode("c.parts").alias("pos", "raw"))
    # a known sentence has so many characters at least; most others needn't be normalised
    least = min(map(len, sentences.values()))
    said = said.where(F.length("raw") >= least).select("doc_id", "h", "cut", "pos", normal(F.col("raw")).alias("sentence"))
    votes = said.join(F.broadcast(voters), "sentence").withColumn("first", F.col("pos") - F.col("step"))
    found = votes.groupBy("doc_id", "h", "cut", "license", "rule", "steps", "first").agg(F.countDistinct("step").alias("met"), F.count("*").alias("n")).where("met = steps").drop("met")
    parts = spark.createDataFrame(inside(rules), "rule int, part int, place int")
    covered = found.select("doc_id", "h", "cut", "rule", "first").join(F.broadcast(parts), "rule").select("doc_id", "h", "cut", F.col("part").alias("rule"), (F.col("first") + F.col("place")).alias("first"), F.lit(True).alias("covered")).distinct()
    same = [found[c].eqNullSafe(covered[c]) for c in ("doc_id", "h", "cut", "rule", "first")]
    found = found.join(covered, same, "left_anti")
    found = found.withColumn("least", F.min("cut").over(W.partitionBy("doc_id", "h", "rule"))).where("cut = least")
    matches = found.groupBy("doc_id", "license", "rule", "steps", "first").agg(F.sum("n").alias("n"))
    return matches.select(
        "doc_id", "license", "rule", F.col("first").cast("int").alias("first_sentence"), (F.col("first") + F.col("steps") - 1).cast("int").alias("last_sentence"), F.expr("n div steps").alias("copies")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _sql(text: str, rules: list[tuple[str, str]]) -> str:
    """The same replacements in DuckDB's SQL."""
    for pattern, put in rules:
        parts = [{"\n": "chr(10)", "\x02": "chr(2)"}.get(x) or "'" + x.replace("$1", r"\1") + "'" for x in re.split("(\n|\x02)", put) if x] or ["''"]
        text = f"regexp_replace({text}, '{pattern}', {' || '.join(parts)}, 'g')"
    return text


ORACLE = rf"""
with known(id, sentence) as (values {_values(list(SENTENCES.items()))}),
steps(rule, license, step, steps, id) as (values {_values([(r, name, k, len(ids), i) for r, (name, ids) in enumerate(RULES) for k, i in enumerate(ids)])}),
inside(longer, rule, place) as (values {_values(inside(RULES))}),
cuts as (
  select doc_id, text, 0 as cut, string_split_regex(TEXT0, '[

]+') as p from documents
  union all select doc_id, text, 1 as cut, list_filter(string_split_regex(TEXT1, '[

]+'), lambda x: regexp_matches(x, '\p{{L}}')) as p from documents
),
said as (select doc_id, text, cut, unnest(p) as raw, generate_subscripts(p, 1) - 1 as pos from cuts),
votes as (
  select doc_id, text, cut, license, rule, steps, pos - step as first, step
  from said join known on trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) = sentence join steps using (id)
),
found as (select doc_id, text, cut, license, rule, steps, first, count(*) as n from votes group by all having count(distinct step) = steps),
alone as (
  select * from found f where not exists (select 1 from found l join inside i on i.longer = l.rule
    where i.rule = f.rule and l.doc_id is not distinct from f.doc_id and l.text = f.text and l.cut = f.cut and l.first + i.place = f.first)
),
chosen as (select * from alone qualify cut = min(cut) over (partition by doc_id, text, rule))
select doc_id, license, cast(rule as integer) as rule, cast(first as integer) as first_sentence,
  cast(first + steps - 1 as integer) as last_sentence, cast(sum(n) // steps as bigint) as copies
from chosen group by doc_id, license, rule, steps, first
""".replace("TEXT0", _sql("text", [STOP])).replace("TEXT1", _sql("text", [*PUBLISHED, STOP]))
