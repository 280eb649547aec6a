"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

SMALL, TEN = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, lid string, mix string, row string, "
    "rank int, fp long, utf8 string, h string, part int, copy string, spans string"
)


def words(rng, n, vocabulary="alder birch cedar elm fir hazel larch maple oak pine rowan yew"):
    return " ".join(rng.choice(vocabulary.split()) for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "12 34 --", "a", words(rng, 3), words(rng, 40_000), "same text here", "same text here", "\U0001f600 éè x", "null\x00byte"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id " + words(rng, 5), "en", "s0", 10), (None, None, None, None, None)]
    return [(*r, "x", None, "y", 1, 2, None, "z", 3, None, "w") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
