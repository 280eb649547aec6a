"""Filter audit, lexical search and decontamination against plain versions, and on odd and empty tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import op11_filter_audit, op12_lexical_search, op13_decontamination, registry

from .conftest import TEN, words

VOCABULARY = " ".join(f"{a}{b}x" for a in "bcdfghklmn" for b in "aeiou")
NAMES = ["op11_filter_audit", "op12_lexical_search", "op13_decontamination"]


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as from '{TEN}/{t}.parquet'")
    got, expected = registry.queries()[name](spark, TEN), con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, expected.select(*order).fetchall()))


def test_paths_of_the_lattice():
    for n in (1, 3, 5):
        taken = Counter()
        for order in permutations(range(n)):
            state = 0
            for f in order:
                taken[state, f] += 1
                state |= 1 << f
        assert op11_filter_audit.lattice(n) == taken


def audited(rows, labels, filters):
    """Every order run over the documents themselves."""
    out = {}
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = [{k for k, f in filters.items() if (f(t or "") if f else i is not None and i > first.get(t or "", i))} for i, _, t in rows]
    for part in {p or "" for _, p, _ in rows}:
        own = [(i, f) for (i, p, _), f in zip(rows, fails) if (p or "") == part]
        total = Counter()
        for order in permutations(filters):
            left = own
            for step, k in enumerate(order, 1):
                gone, left = [r for r in left if k in r[1]], [r for r in left if k not in r[1]]
                total[k] += len(gone)
                lost = [sum(labels.get(i, (0, 0))[y] for i, _ in gone) for y in (0, 1)]
                out[part, "".join(order), step] = (len(left), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == {k} for _, f in own), *lost)
        for order in permutations(filters):
            for step, k in enumerate(order, 1):
                out[part, "".join(order), step] += (total[k],)
    return out


def test_audit(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(0, 12), "a b c D # EE") for _ in range(40)]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(texts + [None])) for i in range(150)] + [(None, "x", texts[0]), (None, "x", texts[0]), (3, "x", texts[1]), (3, "x", texts[1])]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)]
    plain = {"S": lambda t: len(t.split()) < 5, "H": lambda t: "#" in t, "E": None}
    filters = {"S": F.size("_words") < 5, "H": F.col("_text").contains("#"), "E": None}
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, lang string, text string, part string")
    known = spark.createDataFrame([*labels, (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in op11_filter_audit.audit(docs, filters, "lang", known).collect()}
    assert got == audited(rows, {i: (q, t) for i, q, t in labels}, plain)
    assert op11_filter_audit.audit(docs.where("false"), filters, "lang", known).isEmpty()
    assert op11_filter_audit.audit(docs, filters, "lang", known.where("false")).agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError, match="1 to 8"):
        op11_filter_audit.audit(docs, {str(k): F.lit(True) for k in range(9)}, "lang", known)


def ranked(rows, items, k):
    """Scores of all documents."""
    say = lambda t: [x for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    docs = [(i, Counter(say(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total, df, out = len(docs), sum(sum(c.values()) for _, c in docs), Counter(x for _, c in docs for x in c), []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(say(text)) if x in c)
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return out


def test_search(spark):
    """Many ties, one very common term, terms of other alphabets, queries of over 64 terms, in one and in many blocks and pieces."""
    rng = random.Random(8)
    vocabulary = VOCABULARY + " the the the Épée ÉPÉE x1 42"
    rows = [(i, words(rng, rng.randint(0, 60), vocabulary)) for i in range(700)]
    rows += [(1000 + i, "the cax") for i in range(90)] + [(None, "the cax"), (5000, "the cax"), (5000, "the cax"), (5001, None), (5002, ""), (5003, "--- ?")]
    items = [(0, "the cax"), (1, "The bax, bax; Épée"), (2, VOCABULARY + " " + " ".join(f"q{i}" for i in range(80))), (3, "unknown words"), (4, "?"), (5, None), (6, words(rng, 8, vocabulary))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, item string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = ranked(rows, items, 50)
    for most in (1 << 14, 70):
        assert sorted(map(tuple, op12_lexical_search.search(docs, asked, most=most).collect()), key=repr) == sorted(expected, key=repr)
    assert op12_lexical_search.search(docs, asked.where("false")).isEmpty() and op12_lexical_search.search(docs.where("false"), asked).isEmpty()


def test_masks_stop_early():
    """Documents of poor masks are not scored, and the best are those of a full scan."""
    rng = np.random.default_rng(3)
    size, n = 40, 5000
    held = rng.random((n, size)) < np.linspace(0.5, 0.002, size)
    doc, term = np.nonzero(held)
    piece = op12_lexical_search.Piece(rng.integers(80, 120, n), np.arange(n), doc, term, rng.integers(1, 4, len(doc)), size)
    weight = np.linspace(100, 9000, size).astype(np.int64)
    for own in (np.arange(0, 40, 3), np.arange(40), np.array([0, 39])):
        found, scores, done = piece.best(own, weight[own], 10)
        every = piece.scores(np.arange(n), own, weight[own])
        kth = np.sort(every)[-10]
        assert set(found) == set(np.flatnonzero((every >= kth) & (every > 0))) and (every[found] == scores).all()
        assert done < n / 2 or len(own) == 2


def marked(text, items, window=10):
    """Hit words and items of a text, window by window."""
    say = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, met = say(text), set(), set()
    for item, t in items:
        w = say(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            for p in range(len(own) - k + 1):
                if own[p : p + k] == w[s : s + k]:
                    hit.update(range(p, p + k))
                    met.add(str(item))
    return len(own), len(hit), sorted(met)


def test_decontamination(spark):
    rng = random.Random(9)
    common = words(rng, 12, VOCABULARY)
    items = [(i, words(rng, rng.randint(1, 40), VOCABULARY)) for i in range(25)] + [(30, common + " tail"), (31, "Head, " + common), (32, "cax"), (33, "..."), (34, None), (35, "the É 7 pair"), (35, "another TEXT here")]
    rows = []
    for i in range(80):
        t = words(rng, rng.randint(0, 50), VOCABULARY + " cex the É 7 pair").split()
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items[:27])[1] or "").upper().split()
            at, a = rng.randint(0, len(t)), rng.randint(0, max(0, len(w) - 10))
            t[at:at] = w[a : a + rng.randint(8, 14)]
        rows.append((i, ", ".join(t)))
    rows += [(90, ("cax " * 30)), (91, common + " " + common), (91, common), (None, common), (None, "clean words"), (92, None), (92, ""), (93, common), (93, common)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, pos int, h string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(repr((i, *marked(t, items))) for i, t in rows)
    for block in (1 << 16, 150):
        assert sorted(repr(tuple(r)) for r in op13_decontamination.scan(docs, asked, block=block).collect()) == expected
    kept = op13_decontamination.clean(docs, asked)
    assert kept.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr((i, t)) for i, t in rows if not marked(t, items)[1])
    assert op13_decontamination.scan(docs.where("false"), asked).isEmpty()
    assert op13_decontamination.scan(docs, asked.where("false")).agg(F.sum("n_hit"), F.count("*")).first() == (0, len(rows))


def test_windows_that_are_held_in_part(spark):
    """Of six shingles four must be found, each at its place: all stretches are compared with all windows."""
    rng = random.Random(10)
    item = words(rng, 30, VOCABULARY).split()
    rows = []
    for i in range(40):
        w = list(item[5:25])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(words(rng, 5, VOCABULARY).split() + w)))

    def held(text):
        t, hit = text.split(), set()
        for s in range(21):
            v = item[s : s + 10]
            for p in range(len(t) - 9):
                if sum(t[p + o : p + o + 5] == v[o : o + 5] for o in range(6)) >= 4:
                    hit.update(range(p, p + 10))
        return len(hit)

    got = op13_decontamination.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), least=0.6)
    expected = {i: held(t) for i, t in rows}
    assert {r.doc_id: r.n_hit for r in got.collect()} == expected and len(set(expected.values())) > 3


def test_words_are_cut_quickly_and_as_the_contract_says(spark):
    """By Python's expressions, and in less than half the time of Spark's on the contract's class."""
    every = "".join(map(chr, range(0x100))) + "\u0130\u03a3\u212a\U0001f600\uffff\U0010ffff"
    texts = [None, "", " ", "a", " a ", "A1b", "\x00x\x7fy", every, "z".join(every), "É".join(every), *(c + "Ab" + c for c in every), *(f"é{c}Q{c}{c}Ü" for c in every)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", op13_decontamination.words_of(F.col("text")), op13_decontamination.count_of_words(F.col("text"))).collect()
    for t, own, n in got:
        low = t and re.sub("[A-Z]+", lambda m: m[0].lower(), t)
        expected = None if t is None else re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        assert own == expected and n == (None if t is None else len(expected))
    docs = spark.read.parquet(f"{TEN}/documents.parquet").select("text").repartition(8).cache()
    plain = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))

    def seconds(words):
        before = time.time()
        docs.crossJoin(spark.range(4)).agg(F.sum(F.size(words))).collect()
        return time.time() - before

    for words in (plain, op13_decontamination.words_of(F.col("text"))):
        seconds(words)
    assert min(seconds(op13_decontamination.words_of(F.col("text"))) for _ in range(2)) < 0.5 * min(seconds(plain) for _ in range(2))
    docs.unpersist()


def test_decontamination_stays_in_spark(spark):
    """No Python worker on the path of the query."""
    plan = registry.queries()["op13_decontamination"](spark, TEN)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, empty, name):
    items = spark.createDataFrame([(1, "same text here"), (None, "alder"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    run = {
        "op11_filter_audit": lambda d: op11_filter_audit.audit(d, op11_filter_audit.contract_filters(), "lang", labels),
        "op12_lexical_search": lambda d: op12_lexical_search.search(d, items),
        "op13_decontamination": lambda d: op13_decontamination.scan(d, items),
    }[name]
    got, size = run(odd).collect(), odd.count()
    assert run(empty).isEmpty()
    if name == "op11_filter_audit":
        assert {r.part for r in got} == {"", "en"} and all(r.kept + r.removed <= size for r in got)
    if name == "op12_lexical_search":
        assert {r.doc_id for r in got if r.item_id == 1} == {7, 8} and any(r.item_id is None for r in got)
    if name == "op13_decontamination":
        assert len(got) == size and {r.doc_id for r in got if "1" in r["items"]} == {7, 8}
        assert any(r["items"] == [""] and r.n_hit > 100 for r in got)


def test_digest_of_no_items(spark):
    docs = spark.createDataFrame([(1, "nothing of it")], "doc_id long, text string")
    got = op13_decontamination.scan(docs, spark.createDataFrame([(1, "other")], "item_id long, text string")).select(F.sha2(F.concat_ws(",", "items"), 256)).first()[0]
    assert got == hashlib.sha256(b"").hexdigest()
