"""The operators against plain versions, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tessella.llm import kneser_ney, op1_language_id, op2_mixing, op3_licenses, op4_topk, op5_packing, op6_simhash, op7_tokens, op8_toxicity, op9_fingerprints, op10_line_dedup
from tessella.llm.tokens import Encoder, default_path

from .conftest import SMALL, TEN, words

VOCABULARY = " ".join(f"w{i}" for i in range(400))


@pytest.fixture(scope="module")
def table():
    return {r[0]: r[1] for r in duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()}


def test_simhash(spark):
    rng = random.Random(1)
    base = [words(rng, rng.randint(1, 300), VOCABULARY) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        for _ in range(rng.randint(1, 12)):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    expected = []
    for t in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sh = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        expected.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (expected[i] ^ expected[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = op6_simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (expected[i], find(i)) for i in range(len(texts))}
    assert len({find(i) for i in range(len(texts))}) < len(texts)


def classes_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(int(a)), find(int(b))))
        root[b] = a
    return [find(i) for i in range(n)]


def near_values(rng, seeds, steps, few=False):
    """Chains of values that differ by a bit each, clusters around one value, and single values."""
    start = rng.integers(0, 1 << 63, seeds, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (seeds, steps), dtype=np.uint64)
    chains = start[:, None] ^ np.bitwise_xor.accumulate(flips, axis=1)
    cluster = start[0] ^ (np.uint64(1) << rng.integers(0, 63, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200, dtype=np.uint64))
    return np.unique(np.r_[start, chains.ravel(), cluster, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])


def test_bk_trees_link_all_that_are_near():
    """A forest of one, of several and of tiny shards; few more links than a spanning forest needs."""
    rng = np.random.default_rng(5)
    for shards in (1, 3, 400):
        values = near_values(rng, 40, 30)
        shard = np.unique(rng.integers(0, shards, len(values)), return_inverse=True)[1]
        near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 4) & (shard[:, None] == shard[None, :])
        got = op6_simhash.shard_links(values, shard)
        assert all(near[a, b] for a, b in got)
        assert classes_of(len(values), got) == classes_of(len(values), np.argwhere(near))
        assert len(got) < 1.5 * len(values)
        forest = op6_simhash.Forest(values, shard)
        a, b = forest.ask(values, shard, 4)
        assert sorted(zip(a.tolist(), forest.member[b].tolist())) == sorted(map(tuple, np.argwhere(near).tolist()))


def test_large_shards_are_searched_in_pieces(spark):
    """Trees of pieces, broadcast in several waves, give the links of the whole."""
    values = near_values(np.random.default_rng(6), 30, 20)
    rows = spark.createDataFrame([(int(v.view(np.int64)),) for v in values], "fp long")
    at = {int(v.view(np.int64)): i for i, v in enumerate(values)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    expected = classes_of(len(values), np.argwhere(near))
    for hot, piece, wave in ((1 << 20, 1, 1), (40, 16, 30)):
        got = [(at[r.a], at[r.b]) for r in op6_simhash.links(rows, hot=hot, piece=piece, wave=wave).collect()]
        assert all(near[a, b] for a, b in got) and classes_of(len(values), got) == expected


def test_top_k(spark):
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op4_topk.query(spark, SMALL).collect()}
    rows = duckdb.sql(f"select vec_id, embedding from '{SMALL}/embeddings.parquet'").fetchall()
    v = {i: np.floor(1024 * np.array(x, float)).astype(np.int64) for i, x in rows if x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x)}
    expected = {}
    for q in v:
        if q % 100 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:10]
            expected |= {(q, k): (c, -s) for k, (s, c) in enumerate(best, 1)}
    assert got == expected


def test_topk_beyond_a_bigint(spark):
    """Large finite components: products and sums beyond a bigint become its nearest value, and equal scores go to the smaller id."""
    rng = random.Random(7)
    big = lambda: rng.choice((-1, 1)) * 10.0 ** rng.choice((0, 3, 6, 9, 12, 15, 16.5, 17, 30, 300))
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(60)] + [(i, [big(), big()]) for i in range(60, 220)] + [(220, [3e16, 1.0]), (221, [1e17, -1e17]), (222, [float("inf"), 1.0])]
    least, most = -(1 << 63), (1 << 63) - 1
    inside = lambda n: max(least, min(most, n))
    whole = lambda x: inside(int(np.floor(x * 1024))) if abs(x) < 1e300 else (most if x > 0 else least)
    v = {i: [whole(x) for x in own] for i, own in rows[:-1]}
    frame = op4_topk.whole_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op4_topk.search(frame, frame.where("id % 20 = 0"))[0].collect()}
    expected = {}
    for q in range(0, 221, 20):
        best = sorted((-inside(sum(a * b for a, b in zip(v[q], v[c]))), c) for c in v if c != q)[:10]
        expected |= {(q, k): (c, -s) for k, (s, c) in enumerate(best, 1)}
    assert got == expected


def test_hot_bands_are_numbered_apart(spark):
    """Numbers are unique in a band, and begin as its members do where one task numbers them; no salt has much over its share."""
    rows = [(b, n * 7919) for b, size in ((1, 1), (2, 40), (3, 1000)) for n in range(size)]
    got = op9_fingerprints.numbered(spark.createDataFrame(rows, "band long, node long"), hot=50).collect()
    assert sorted((r.band, r.node) for r in got) == sorted(rows) and len({(r.band, r.k) for r in got}) == len(rows)
    assert sorted(r.k for r in got if r.band == 2) == list(range(1, 41)) and min(r.k for r in got) == 1
    assert max(r.k for r in got if r.band == 3) < 2000


def test_next_of_rows_without_an_id(spark, monkeypatch):
    """Null ids come first, by the hashes of their texts, over several parts; the first of all follows the last."""
    monkeypatch.setattr(op9_fingerprints, "PART_ROWS", 10)
    rng = random.Random(12)
    rows = [(None, words(rng, rng.randint(0, 12), VOCABULARY)) for _ in range(60)] + [(None, "same text again and again")] * 30 + [(i * 3, words(rng, 9, VOCABULARY)) for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_chars, r.edited.hex()) for r in op9_fingerprints.digests(df).collect())
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    expected = Counter((i, len(t), hashlib.sha256(op9_fingerprints.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert got == expected


def test_licences_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{TEN}/documents.parquet'")
    expected = Counter(con.sql(op3_licenses.ORACLE).fetchall())
    assert expected and Counter(tuple(r) for r in op3_licenses.query(spark, TEN).collect()) == expected


def library_ids(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 1] for e in Tokenizer.from_file(default_path()).encode_batch(texts, add_special_tokens=False)]


def test_tokens_round_trip(spark, table):
    got = {r.doc_id: r for r in op7_tokens.query(spark, SMALL).collect()}
    start = 0
    for (d, t), ids in zip(sorted(table.items()), library_ids([table[d] or "" for d in sorted(table)])):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_on_odd_words():
    texts = ["it's don't we're", "U.S.A. 3,000.50 a.b., x", "<|endoftext|> </w> .,", "Ünïcode ﬁ ﷺ １２", "a b c\x1cd​e", "x,. ,y .", "\U0001f600ok naïve, café.", "İstanbul ΣΟΦΟΣ Ÿ ŉ ªº µß ÀÞ mot*** mot,&&& mot<|endoftext|> mot' l'ami's d'", "e\u0301te\u0301 가 한국어. \u0345a"]
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(default_path())(texts)] == [i[:-1] for i in library_ids(texts)]


def test_encoder_keeps_recurring_words(monkeypatch):
    monkeypatch.setattr("tessella.llm.tokens.CACHE_WORDS", 40)
    monkeypatch.setattr("tessella.llm.tokens.CHUNK_BYTES", 100)
    texts = [" ".join(f"common, w{i}x{k} {chr(97 + i % 26)}{chr(97 + k)}. common" for k in range(12)) for i in range(40)] + [None, "", " ", "x\x1fy z"]
    encode = Encoder(default_path())
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [i[:-1] for i in library_ids([t or "" for t in texts])]
    assert len(encode.words) < 200


def test_shard_reads_one_token_and_one_document():
    rng = np.random.default_rng(2)
    docs = [np.r_[rng.choice([5, 6, 7, 8], n), 1].astype("<u4") for n in (0, 1, 50, 4000)] + [np.r_[np.full(999, 9), 1].astype("<u4")]
    s = op7_tokens.Shard(op7_tokens.image(np.concatenate(docs), np.array([len(d) for d in docs]), [1, None, 3, 4, 5]))
    assert len(s.pairs) and len(s.seq) < sum(map(len, docs)) and s.doc_ids == [1, None, 3, 4, 5]
    for i, d in enumerate(docs):
        assert s.document(i).tolist() == d.tolist()
        assert all(s.token(i, k) == d[k] for k in range(0, len(d), max(1, len(d) // 50)))


def test_shards_are_smaller_than_plain_ids(table):
    """Of all pairs that may become rules none is left that occurs PAYS times without overlap, and images beat 16-bit ids."""
    texts = [t or "" for t in table.values()]
    ids = [np.frombuffer(b, "<u4") for b in Encoder(default_path())(texts)]
    ids = [np.r_[x, 1].astype("<u4") for x in ids]
    raw = op7_tokens.image(np.concatenate(ids), np.array([len(x) for x in ids]), list(range(len(ids))))
    s = op7_tokens.Shard(raw)
    assert all(a.tolist() == b.tolist() for a, b in zip(s.all_documents(), ids))
    assert len(raw) < 0.75 * 2 * sum(map(len, ids))
    left: dict[tuple, list] = defaultdict(list)
    for a, b in zip(s.starts, s.starts[1:]):
        own = s.seq[a:b].tolist()
        for i in range(a, b - 1):
            left[tuple(own[i - a : i - a + 2])].append(i)
    for places in left.values():
        alone, last = 0, -2
        for i in places:
            if i > last + 1:
                alone, last = alone + 1, i
        assert alone < op7_tokens.PAYS


def test_packing(spark, table):
    rows = op5_packing.query(spark, SMALL).collect()
    ids = dict(zip(sorted(table), library_ids([table[d] or "" for d in sorted(table)])))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for d, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids[d]) and all(r.length == 4096 for r in own[:-1])
        assert [r.start for r in own] == [4096 * k for k in range(len(own))]
    assert set(by) == set(ids)
    for s in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(s))])
        assert [o for o, _ in sorted(s)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_configurations_fill_sequences():
    rng = random.Random(4)
    demand = Counter(min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(20_000))
    groups = op5_packing.pack_histogram(dict(demand), 100)
    used = Counter()
    for config, n in groups:
        assert sum(x * k for x, k in config) <= 100
        for x, k in config:
            used[x] += k * n
    assert used == demand
    assert sum(n for _, n in groups) <= 1.01 * -(-sum(x * n for x, n in demand.items()) // 100)


@pytest.mark.parametrize("n", [10_000, 200_000])
def test_configurations_pack_most_tokens(n):
    """On a histogram of over a thousand lengths the program, and not best-fit decreasing, deals the tokens."""
    rng = np.random.default_rng(8)
    demand = Counter(np.clip(rng.lognormal(6, 1, n), 1, 4095).astype(int).tolist())
    chosen, left = op5_packing.configuration_program(dict(demand))
    used = Counter(left)
    for config, k in chosen:
        assert sum(x * m for x, m in config.items()) <= 4096
        for x, m in config.items():
            used[x] += m * k
    tokens = sum(x * m for x, m in demand.items())
    assert len(demand) > 1000 and used == demand
    assert sum(x * m for x, m in left.items()) <= 0.02 * tokens
    assert sum(k for _, k in op5_packing.pack_histogram(dict(demand))) <= 1.005 * -(-tokens // 4096) + 1


def test_mixing(spark):
    rows = op2_mixing.query(spark, TEN).collect()
    docs = duckdb.sql(f"select doc_id, text, source from '{TEN}/documents.parquet'").fetchall()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    of, total = {d: s for d, _, s in docs}, Counter()
    for d, _, s in docs:
        total[s] += size[d]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    target, free, left = {}, {s: 1 + i % 3 for i, s in enumerate(names)}, sum(total.values())
    while free:
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * total[s]]
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 3 * total[s]
            free.pop(s)
        left = sum(total.values()) - sum(target.values())
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == total[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(0.005 * target[s], 200) for s in names)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, op2_mixing.query(spark, TEN).collect()))


def test_mixing_of_repeated_rows(spark):
    """Rows alike in all columns are taken one by one, whatever the size of the last cell; a rerun agrees."""
    rows = [(1, "one two three four five six seven eight nine ten", "a")] * 50 + [(100 + i, " ".join(f"w{i}x{k}" for k in range(10)), "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for cell in (50_000, 1):
        got = [Counter((r.source, r.mix.size * r.mix.copies) for r in op2_mixing.mix(df, cell=cell).collect()) for _ in range(2)]
        assert got[0] == got[1]
        taken = Counter()
        for (s, n), k in got[0].items():
            taken[s] += n * k
        assert abs(taken["a"] - 1000 / 3) <= 10 and abs(taken["b"] - 2000 / 3) <= 10


def test_flow_of_many_patterns():
    rng = random.Random(3)
    names = [f"s{i}" for i in range(12)]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 4)))): rng.randint(1, 100) for _ in range(3000)}
    total = sum(patterns.values())
    flow = op2_mixing.route(patterns, dict.fromkeys(names, total // 12))
    given = Counter()
    for (p, s), n in flow.items():
        assert s in p
        given[s] += n
    assert all(given[s] == total // 12 for s in names)


def test_flow_is_least_cost():
    # b's quota can only be met in the first round if the shared documents leave a
    flow = op2_mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 10, "b": 15})
    assert sum(n for (p, s), n in flow.items() if s == "a") == 10 and sum(n for (p, s), n in flow.items() if s == "b") == 15
    assert all(sum(n for (q, _), n in flow.items() if q == p) <= 10 for p in {p for p, _ in flow})


def same_share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, table):
    """Both ways to the next document, in stored order and shuffled with gaps, against plain sets."""
    shuffled = spark.createDataFrame([(3 * d, t) for d, t in table.items()], "doc_id long, text string").repartition(5, "text")
    for got, k in ((op9_fingerprints.query(spark, SMALL), 1), (op9_fingerprints.fingerprints(shuffled), 3)):
        got = {r.doc_id: r for r in got.collect()}
        order = sorted(table)
        assert len(got) == len(order)
        for d, e in zip(order, order[1:] + order[:1]):
            t, u = table[d] or "", table[e] or ""
            n = len(t) // 4
            new = t[: len(t) - n] + u[:n]
            r = got[k * d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
            a, b, c = (set(op9_fingerprints.shingles(x).tolist()) for x in (t, new, u))
            assert abs(r.near_edited - same_share(a, b)) < 0.2 and abs(r.near_next - same_share(a, c)) < 0.2
            assert r.fingerprint == op9_fingerprints.signature(op9_fingerprints.shingles(t)).astype(">u2").tobytes().hex()


def test_minhash_classes_against_all_pairs(spark):
    """Links at a likeness of 0.8 by comparing all pairs: copies, near copies of several degrees, chains, and others."""
    rng = random.Random(8)
    base = [words(rng, rng.randint(40, 200), VOCABULARY) for _ in range(40)]
    texts = list(base)
    for t in base[:25]:
        for k in range(rng.randint(1, 6)):
            w = texts[-1 if k % 3 == 2 else base.index(t)].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(99)}"
            texts.append(" ".join(w))
    texts += ["", None, base[3]]
    sets = [set(op9_fingerprints.shingles(t).tolist()) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if same_share(sets[i], sets[j]) >= 0.8]
    got = {r.doc_id: r.class_id for r in op9_fingerprints.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(near) > 60 and len(got) == len(texts)
    whole = classes_of(len(sets), near)
    assert np.mean([got[i] == got[j] for i, j in near]) >= 0.95
    assert all(whole[i] == whole[c] for i, c in got.items())


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_large_counts_are_found_without_a_search(monkeypatch, share):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    counts = np.where(rng.random(len(keys)) < share, rng.integers(255, 10**6, len(keys)), rng.integers(0, 255, len(keys)))
    large = np.flatnonzero(counts >= 255)
    table = kneser_ney.Table(keys, kneser_ney.Table.index(keys), [(np.minimum(counts, 255).astype(np.uint8), large, counts[large].astype(float))])
    asked = rng.permutation(np.r_[keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 1000, dtype=np.uint64)])
    known = dict(zip(keys.tolist(), counts.tolist()))
    monkeypatch.delattr(np, "searchsorted")
    assert table.look(asked)[0].tolist() == [known.get(k, 0) for k in asked.tolist()]


def test_new_words_take_few_calls_of_the_library(monkeypatch):
    """Words that aren't Latin letters alone are encoded together, also those that hold the word between them."""
    from tessella.llm import tokens

    encode = tokens.Encoder(default_path())
    own = [*(f"é{k}-x$$$" for k in range(5000)), "throughout-1", "Throughout2", "(throughout)", "日本", "don't", "1.5"]
    expected = [e.ids for e in encode.library.encode_batch([" ".join(own), "throughout 1", ""], add_special_tokens=False)]
    calls = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    library = encode.library
    monkeypatch.setattr(encode, "library", Counting())
    got = [np.frombuffer(b, "<u4").tolist() for b in encode([" ".join(own), "throughout 1", ""])]
    assert got == expected and sum(calls) < 100


def test_tiles_link_what_all_pairs_of_a_large_band_link(spark):
    """Near copies about the threshold, which no representatives join: rows grow with the blocks and not with the pairs."""
    rng = random.Random(11)
    base = words(rng, 150, VOCABULARY).split()
    texts = [" ".join(f"changed{rng.randrange(999)}" if k in at else w for k, w in enumerate(base)) for at in ({rng.randrange(150) for _ in range(rng.choice([1, 2, 3, 5]))} for _ in range(300))]
    sets = [op9_fingerprints.shingles(t) for t in texts]
    sig = [op9_fingerprints.signature(s) for s in sets]
    near = [(i, j) for i in range(300) for j in range(i) if same_share(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8 and (sig[i] == sig[j]).mean() >= op9_fingerprints.NEAR]
    rows = [(7, i, i, bytearray(g.astype(">u2").tobytes()), bytearray(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes())) for i, (s, g) in enumerate(zip(sets, sig))]
    members = spark.createDataFrame(rows, "band long, node long, root long, sig binary, shingles binary").repartition(4)
    assert len(set(classes_of(300, near))) > 1 and op9_fingerprints.tiles(members, 100).count() == 900
    for most in (1000, 100):
        got = [(r.a, r.b) for r in op9_fingerprints.linked(members, 0.8, most).collect()]
        assert {(max(e), min(e)) for e in got} <= set(near) and len(got) < 6 * 300
        assert classes_of(300, got) == classes_of(300, near)


def test_held_out_languages(spark):
    rows = op1_language_id.query(spark, TEN).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{TEN}/documents.parquet'").fetchall())
    known = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(known) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in known]) > 0.95


def test_held_out_toxicity(spark):
    rows = op8_toxicity.query(spark, TEN).collect()
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{TEN}/labels.parquet'").fetchall())
    pos, neg = ([r.score for r in rows if r.held_out and toxic.get(r.doc_id) == y] for y in (1, 0))
    assert pos and neg and np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.85


def plain_kneser_ney(texts, order, discounts):
    """P(last | before) by dictionaries: raw counts at the top, continuation counts below, any code point alike at the end."""
    tables = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    sums, kinds = ({k: Counter() for k in tables} for _ in range(2))
    for k, own in tables.items():
        for g, n in own.items():
            sums[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(gram, end):
        out = end
        for k in range(1, order + 1):
            g = gram[len(gram) - k :]
            s = sums[k][g[:-1]]
            if s:
                d = discounts[k]
                out = max(tables[k][g] - d, 0) / s + min(d * kinds[k][g[:-1]] / s, 1) * out
        return out

    return p, tables


def test_language_models_are_kneser_ney(spark):
    """Three languages against dictionaries, with letters beyond the first 65,536; an unlearned language is rejected."""
    rng = random.Random(13)
    letters = {"aa": "abcdef", "bb": "abcxyz", "cc": "\U00010400\U00010401ж中e"}
    say = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(100 * k + i, lang, say(a, 150)) for k, (lang, a) in enumerate(letters.items()) for i in range(20)]
    model = op1_language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == ["aa", "bb", "cc"]
    hi, lo, _ = op1_language_id._grams([op1_language_id._normal(say("".join(letters.values()), 40))])
    spell = lambda h, g: "".join(chr(int(c)) for c in (h & 0x1FFFFF, g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF))
    nats = model.nats(hi, lo)
    for j, lang in enumerate(model.langs):
        texts = ["   " + op1_language_id._normal(t) + " " for _, k, t in rows if k == lang]
        p, _ = plain_kneser_ney(texts, 4, {k: model.discounts[lang, k] for k in range(1, 5)})
        expected = [-np.log(max(p(spell(int(h), int(g)), 1 / (1 << 21)), 1e-12)) for h, g in zip(hi, lo)]
        assert np.allclose(nats[:, j], expected, rtol=1e-5)
    docs = rows + [(1000 + i, None, say("ßðþæøåé", 150)) for i in range(5)]
    got = op1_language_id.recognised(spark.createDataFrame(docs, "doc_id long, lang string, text string"), keep=["doc_id", "lang"]).collect()
    assert [(r.doc_id, r.lid.nats) for r in got if r.lid_rejected != (r.doc_id >= 1000)] == []


def test_language_model_keeps_its_bound(spark):
    rng = random.Random(14)
    letters = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400))
    rows = [(i, "aa", words(rng, 60, letters)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    size = lambda m: sum(len(t.keys) for t in m.tables.values())
    whole, small = op1_language_id.learn(df), op1_language_id.learn(df, most=1500)
    assert size(small) <= 1500 < size(whole) and small.discounts == whole.discounts and small.totals == whole.totals


def test_toxicity_models_are_kneser_ney(spark):
    """Orders 6 to 4 by class, 3 to 1 shared, against dictionaries, with letters beyond the first 1,024."""
    rng = random.Random(15)
    say = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 5))) for _ in range(n))
    rows = [(y, say("abж\U00010400" if y else "abcж中", 40)) for y in (0, 1) for _ in range(15)]
    counted = spark.createDataFrame(rows, "part int, text string").mapInArrow(op8_toxicity._count, "part int, hi bigint, lo bigint, n bigint")
    model = op8_toxicity.learn(counted.withColumn("toxic", counted.part))
    hi, lo, _, _ = op8_toxicity._grams([op8_toxicity._normal(say("abcж中\U00010400", 60))])
    spell = lambda h, g: "".join(chr(int(x >> s) & 0x1FFFFF) for x in (h, g) for s in (42, 21, 0))
    padded = {y: ["     " + op8_toxicity._normal(t) + " " for k, t in rows if k == y] for y in (0, 1)}
    own = {y: plain_kneser_ney(padded[y], 6, {k: model.discounts[k, y] if k > 3 else 0 for k in range(1, 7)})[1] for y in (0, 1)}
    # shared counts: a 3-gram counts once for each 4-gram that either class has
    four = set(own[0][4]) | set(own[1][4])
    shared = {3: Counter(g[1:] for g in four)}
    for k in (2, 1):
        shared[k] = Counter(g[1:] for g in shared[k + 1])

    def step(table, g, d, lower):
        s = sum(n for x, n in table.items() if x[:-1] == g[:-1])
        kinds = sum(1 for x in table if x[:-1] == g[:-1])
        return max(table[g] - d, 0) / s + min(d * kinds / s, 1) * lower if s else lower

    got = model.likelihoods(hi, lo)
    for i in range(0, len(hi), 7):
        gram = spell(int(hi[i]), int(lo[i]))
        low = 1 / (1 << 21)
        for k in (1, 2, 3):
            low = step(shared[k], gram[6 - k :], model.discounts[k, 0], low)
        for y in (0, 1):
            p = low
            for k in (4, 5, 6):
                p = step(own[y][k], gram[6 - k :], model.discounts[k, y], p)
            assert got[y][i] == pytest.approx(p, rel=1e-5)


def test_line_dedup(spark):
    rng = random.Random(6)
    line = lambda n=12: words(rng, n, VOCABULARY)
    passage = [line() for _ in range(6)]
    own = [[line() for _ in range(4)] for _ in range(6)]
    texts = [own[0] + passage + own[0][:1], own[1] + passage, passage + own[2], own[3] + passage[:2], own[4][:2] + ["", passage[0], "short line", *passage[1:]] + own[4][2:], own[5]]
    got = {r.doc_id: r for r in op10_line_dedup.dedup(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).select("row.*", "removed_words").collect()}
    assert got[0].text == "\n".join(texts[0]) and got[5].text == "\n".join(own[5])
    assert got[1].text.strip() == "\n".join(own[1]) and got[1].removed_words == 72
    assert got[2].text.strip() == "\n".join(own[2])
    assert got[3].text == "\n".join(texts[3])  # 24 words are less than a block
    assert all(x in got[4].text for x in own[4] + ["short line", passage[0]]) and passage[3] not in got[4].text


def test_line_dedup_of_a_passage_met_in_parts(spark):
    """The lines of a passage have different first holders, each under a block; all later copies but the first go."""
    rng = random.Random(9)
    line = lambda n=12: words(rng, n, VOCABULARY)
    passage = [line() for _ in range(6)]
    own = [[line() for _ in range(2)] for _ in range(6)]
    texts = [own[i] + passage[2 * i : 2 * i + 2] for i in range(3)] + [own[i] + passage for i in range(3, 6)]
    got = {r.doc_id: r for r in op10_line_dedup.dedup(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).select("row.*", "removed_words").collect()}
    assert all(got[i].text == "\n".join(texts[i]) for i in range(4))
    assert all((got[i].text, got[i].removed_words) == ("\n".join(own[i]), 72) for i in (4, 5))


def test_line_dedup_inside_lines(spark):
    """A passage in running text, and one of 7-word lines, go from the later document."""
    rng = random.Random(10)
    said = lambda n: words(rng, n, VOCABULARY) + "."
    passage = " ".join(said(10) for _ in range(6))
    short = "\n".join(words(rng, 7, VOCABULARY) for _ in range(8))
    own = [said(9) for _ in range(8)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{own[3]}  {passage}\t{own[4]}\nend", f"{own[5]}\n{short}", f"{short}\n{own[6]}"]
    got = {r.doc_id: r for r in op10_line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.*", "removed_words").collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2]
    assert got[1].text == f"{own[2]}\n{own[3]}  {own[4]}\nend" and got[1].removed_words == 60
    assert got[3].text == own[6] and got[3].removed_words == 56


def test_patience_subsequence():
    rng = random.Random(7)
    for _ in range(50):
        x = rng.sample(range(12), 12)
        keep = op10_line_dedup.increasing(x)
        best = [1] * 12
        for i in range(12):
            best[i] += max([best[j] for j in range(i) if x[j] < x[i]], default=0)
        assert len(keep) == max(best) and all(x[a] < x[b] for a, b in zip(keep, keep[1:]))


def shared_units(texts):
    """For each text the units in stretches of at least BLOCK_WORDS words that an earlier text has, by plain comparison of all pairs."""
    own = [op10_line_dedup.units(t) for t in texts]
    out = [set() for _ in own]
    for d, a in enumerate(own):
        for b in own[:d]:
            for shift in range(-len(b) + 1, len(a)):
                i = max(0, shift)
                while i < len(a) and i - shift < len(b):
                    j = i
                    while j < len(a) and j - shift < len(b) and a[j] == b[j - shift]:
                        j += 1
                    if sum(len(u.split()) for u in a[i:j]) >= op10_line_dedup.BLOCK_WORDS:
                        out[d].update(range(i, j))
                    i = j + 1
    return own, out


def test_line_dedup_against_all_pairs(spark):
    """Copies, passages in another order or twice, short lines and hot lines: what all pairs share goes, and nothing else."""
    rng = random.Random(12)
    line = lambda n=9: words(rng, n, VOCABULARY)
    passages = [[line(rng.randint(3, 14)) for _ in range(rng.randint(3, 9))] for _ in range(12)]
    texts = []
    for _ in range(70):
        parts = [[line() for _ in range(rng.randint(0, 3))]]
        for p in rng.sample(passages, rng.randint(0, 4)) + rng.sample(passages, rng.randint(0, 1)):
            k = rng.randint(0, 2)
            parts += [p[k:], [line() for _ in range(rng.randint(0, 2))]]
        texts.append("\n".join(x for part in parts for x in part))
    texts += [texts[5], texts[5], texts[9]]
    own, expected = shared_units(texts)
    got = [set() for _ in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op10_line_dedup.overlaps(df, df.doc_id, df.text).collect():
        for s in r.spans:
            got[r.doc_id].update(range(s["first"], s["last"]))
    # repeated texts are told by their text: equal documents under other ids are later copies
    assert all(g <= e for g, e in zip(got, expected))
    assert sum(map(len, expected)) > 500 and sum(map(len, got)) >= 0.99 * sum(map(len, expected))
    assert got[-3] == set(range(len(own[-3]))) and got[-2] == got[-3]


def sequences(groups):
    return sum(n for _, n in groups)


def test_packing_is_never_worse_than_best_fit():
    """Lengths that occur once, lengths of a corpus, many of each length, and lengths of a quarter to a half, where the program wins."""
    rng = np.random.default_rng(1)
    kinds = {
        "once": rng.integers(1, 4095, 3000), "corpus": np.minimum(rng.lognormal(5, 1.2, 10_000).astype(int) + 1, 4095),
        "many": rng.integers(1, 4095, 200_000), "quarter to half": rng.integers(1000, 2200, 20_000),
    }
    for name, lengths in kinds.items():
        demand = Counter(lengths.tolist())
        groups = op5_packing.pack_histogram(demand)
        held = Counter()
        for config, n in groups:
            assert sum(x * k for x, k in config) <= 4096
            for x, k in config:
                held[x] += n * k
        best = sequences(op5_packing.best_fit(demand))
        assert held == demand and -(-sum(lengths) // 4096) <= sequences(groups) <= best, name
        if name == "quarter to half":
            assert sequences(groups) < best
