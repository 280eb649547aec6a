"""Every operator on odd and on empty tables."""

import pickle
import random

import pytest

from tessella.llm import kneser_ney, op1_language_id, op2_mixing, op3_licenses, op4_topk, op5_packing, op6_simhash, op7_tokens, op8_toxicity, op9_fingerprints, op10_line_dedup
from tessella.llm.common import shared_dir
from tessella.llm.tokens import default_path

from .conftest import words

KEEPING = {"language": op1_language_id.accepted, "line dedup": op10_line_dedup.deduplicated, "simhash": op6_simhash.deduplicated, "mix": op2_mixing.mixed}


@pytest.mark.parametrize("name", KEEPING)
def test_filters_keep_the_columns(name, odd, empty):
    got = KEEPING[name](odd)
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    got.collect()
    none = KEEPING[name](empty)
    assert none.columns == odd.columns and none.count() == 0


def test_language_of_odd_texts(odd, empty):
    found = op1_language_id.recognised(odd, keep=["doc_id", "lang"])
    assert found.columns[-2:] == ["_lid", "_lid_rejected"]  # lengthened, as odd has a column lid
    got = found.toDF("doc_id", "known", "lid", "lid_rejected").collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lid.lang == "und" and by[i].lid.score == 0 and by[i].lid_rejected for i in (0, 1, 2, 3))
    assert all(0 <= r.lid.score <= 1 for r in got)
    assert op1_language_id.recognised(empty).count() == 0


def test_mix_of_odd_texts(odd, empty):
    got = op2_mixing.mix(odd)
    name = got.columns[-1]
    assert name == "_mix" and got.count() == odd.count()
    assert all(r[name].copies <= 3 and (r[name].size or not r[name].copies) for r in got.collect())
    assert op2_mixing.mix(empty).count() == 0


def test_licences_of_odd_texts(spark, odd, empty):
    assert op3_licenses.scan(odd).count() == op3_licenses.scan(empty).count() == 0
    text = "Intro.\nReleased under the MIT License.\nAll rights reserved."
    rows = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.first_sentence, r.copies) for r in op3_licenses.scan(rows).collect()}
    assert got == {(None, "MIT", 1, 1), (None, "All-Rights-Reserved", 2, 1), (5, "MIT", 1, 2), (5, "All-Rights-Reserved", 2, 2)}


def test_rules_need_their_sentences_in_order(spark):
    known, rules = {1: "first known sentence", 2: "second known sentence"}, [("L", [1, 2])]
    rows = [(1, "First known sentence. Second known sentence."), (2, "Second known sentence. First known sentence."), (3, "First known sentence. Other words stand here. Second known sentence.")]
    got = op3_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), sentences=known, rules=rules).collect()
    assert [(r.doc_id, r.first_sentence, r.last_sentence) for r in got] == [(1, 0, 1)]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_published_licences(spark):
    """Wrapped texts, the same in a comment with # and on one line, each with words around it; the SQL agrees."""
    import duckdb

    texts = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0": GPL, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + THIRD, "MPL-2.0": MPL}
    rows = []
    for name, t in texts.items():
        rows += [(f"{name} wrapped", f"Some words.\n\n{t}\n\nMore words."), (f"{name} comment", "\n".join(f"# {x}".rstrip() for x in t.split("\n")) + "\n\ncode"), (f"{name} line", " ".join(t.split()))]
    # halves of a rule under one id, or without an id, make no match together
    half = MIT.split("\n\n")
    rows += [("halves", half[0]), ("halves", "\n\n".join(half[1:])), (None, half[0]), (None, "\n\n".join(half[1:]))]
    got = op3_licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(d, d.rsplit(" ", 1)[0]) for d, _ in rows if d and d != "halves"}
    steps = {"MPL-2.0": 1, "BSD-3-Clause": 3}
    assert {r.doc_id for r in got if r.last_sentence - r.first_sentence == steps.get(r.license, 2)} == {r.doc_id for r in got}
    con = duckdb.connect()
    con.sql("create table documents(doc_id varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.sql(op3_licenses.ORACLE).fetchall())


def test_every_known_sentence_has_a_tell_tale():
    words = op3_licenses.tell_tales(list(op3_licenses.SENTENCES.values()))
    assert len(words) < 12 and all(any(w in s for w in words) for s in op3_licenses.SENTENCES.values())


def test_top_k_leaves_out_broken_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (10, [3.0]), (11, []), (1, [1.0, 0.0])]
    rows = [(i, v, "x", 1, 2, 3.0, None) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, rank int, upper int, score double, v string")
    v = op4_topk.whole_vectors(df, "vec_id", "embedding")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op4_topk.search(v, v.where("id in (1, 4, 9)"))[0].collect()}
    assert got == {(1, 1): (2, 2048 * 1024), (1, 2): (8, 2048 * 1024), (1, 3): (8, 2048 * 1024), (4, 1): (11, 0), (9, 1): (10, 3 * 1024 * 1024)}
    none = op4_topk.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert op4_topk.search(none, none)[0].count() == 0


def test_top_k_reads_few_exact_vectors_in_several_waves_and_steps(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(op4_topk, "QUERY_BYTES", 4000)
    monkeypatch.setattr(op4_topk, "FIRST", 4)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24)) * 1000
    v = v.astype(int)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<bigint>")
    got, read = op4_topk.search(rows, rows.where("id % 50 = 0"), 7)
    expected = {}
    for q in range(0, 1500, 50):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(1500) if c != q)[:7]
        expected |= {(q, k): (c, -s) for k, (s, c) in enumerate(best, 1)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()} == expected
    assert len(read) > 1 and sum(read) < 0.1 * 30 * 1500


def test_packing_of_odd_texts(odd, empty):
    got = op5_packing.packed(odd).collect()
    assert sum(r.piece == 0 for r in got) == odd.count()
    assert op5_packing.packed(empty).count() == 0


def test_simhash_of_odd_texts(odd, empty):
    got = op6_simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert op6_simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_a_document_of_every_component(spark):
    """Unrelated texts without an id, or under one id, all stay; of copies one does."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (3, a), (None, e), (None, None), (None, None)]
    got = op6_simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, a), (None, b), (1, c), (1, d), (None, e), (None, None)], key=str)


def test_tokens_of_odd_texts(spark, odd, empty):
    for docs in (odd, empty):
        folder = f"{shared_dir(spark)}/t{docs.count()}"
        op7_tokens.write_tokens(docs, folder, default_path())
        got = op7_tokens.read_tokens(spark, folder).collect()
        assert len(got) == docs.count()
        assert sorted(r.start for r in got) == [sum(r.n_tokens for r in sorted(got, key=lambda r: r.start)[:k]) for k in range(len(got))]


def test_toxicity_of_odd_texts(spark, odd, empty):
    kinds = "doc_id long, toxic int"
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(None, 1), (5, None), (6, 0), (6, 1), (77, 1)], kinds)
    for known in (labels, spark.createDataFrame([], kinds)):
        got = op8_toxicity.scored(odd, op8_toxicity.fit(odd, known)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert op8_toxicity.scored(empty, op8_toxicity.fit(empty, labels)).count() == 0


def test_fingerprints_of_odd_texts(odd, empty):
    got = op9_fingerprints.fingerprints(odd).collect()
    assert len(got) == odd.count()
    same = {r.fingerprint for r in got if r.doc_id in (7, 8)}
    assert len(same) == 1 and all(0 <= r.near_next <= 1 for r in got)
    assert op9_fingerprints.fingerprints(empty).count() == 0
    assert op9_fingerprints.near_duplicates(odd).count() == odd.count() and op9_fingerprints.near_duplicates(empty).count() == 0


def test_language_models_are_whole_and_travel_as_files(spark, monkeypatch):
    """A model written in pieces is the one written at once, counts beyond a byte included; what is pickled doesn't grow with it."""
    rng = random.Random(21)
    rows = [(i, f"l{i % 2}", words(rng, 300) + " " + "".join(chr(rng.randrange(97, 123)) for _ in range(200))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    whole = op1_language_id.learn(df)
    for module in (kneser_ney, op1_language_id):
        monkeypatch.setattr(module, "PIECE", 100)
    cut = op1_language_id.learn(df)
    hi, lo, _ = op1_language_id._grams([op1_language_id._normal(rows[0][2]), "zq zq"])
    assert (whole.nats(hi, lo) == cut.nats(hi, lo)).all() and sum(len(t.keys) for t in whole.tables.values()) > 2000
    assert any(len(place) for t in whole.tables.values() for _, place, _ in t.coded)
    assert len(pickle.dumps(whole)) < 20_000 and (pickle.loads(pickle.dumps(cut)).nats(hi, lo) == whole.nats(hi, lo)).all()
    counted = df.selectExpr("cast(doc_id % 2 as int) as part", "text").mapInArrow(op8_toxicity._count, "part int, hi bigint, lo bigint, n bigint").withColumnRenamed("part", "toxic")
    split = op8_toxicity.learn(counted)
    monkeypatch.undo()
    hi, lo, _, _ = op8_toxicity._grams([op8_toxicity._normal(rows[1][2])])
    assert (op8_toxicity.learn(counted).evidence(hi, lo) == split.evidence(hi, lo)).all()
