"""Periodic runs against a plain search of every period."""

import hashlib
import re
import zlib
from random import Random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import queries
from siltstone.llm.runs import RunParams, collapsed, find_runs, joined, runs_of
from siltstone.llm.wordbytes import BLANKS, Words

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i = i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check(texts, params):
    words = Words(pa.array(texts, pa.string()), BLANKS)
    runs = runs_of(words, params)
    left = joined(words, collapsed(words, runs)).to_pylist()
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        low, high = words.first[i], words.first[i + 1]
        want = plain_runs(w, params.least)
        assert [(int(s - low), int(e - s), int(q)) for s, e, q in runs if low <= s < high] == want
        assert left[i] == kept(w, want)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abé"), max_size=40), st.integers(1, 6)), max_size=6), st.sampled_from([4, 12]), st.sampled_from([1, 30, 1 << 19]))
def test_runs_of_small_alphabets(parts, least, portion):
    """Any portion of candidates gives the same runs, in texts of few different words."""
    check([" ".join(w * times) for w, times in parts] + [None, "", " a\n"], RunParams(least, portion))


def test_runs_nested_and_planted():
    rng = Random(5)
    texts = []
    for _ in range(60):
        inner = [rng.choice("xyz") for _ in range(rng.randrange(1, 7))] * rng.randrange(2, 6)
        outer = (inner + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(9))]) * rng.randrange(1, 5)
        texts.append("\t".join(outer + [f"w{rng.randrange(9)}" for _ in range(40)] + outer))
    check(texts, RunParams())


def test_runs_long_text(spark):
    """200,000 equal words are one run, and so is a text repeated once."""
    rng = Random(1)
    half = " ".join(f"w{rng.randrange(10**9)}" for _ in range(50_000))
    docs = spark.createDataFrame([(1, "again " * 200_000), (2, f"{half} {half}"), (3, None), (None, "lone words"), (4, "a b " * 6), (4, "a b " * 6)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): [tuple(x) for x in r.runs] for r in find_runs(docs).collect()}
    assert got == {(1, 200_000): [(0, 200_000, 1)], (2, 100_000): [(0, 100_000, 50_000)], (3, 0): [], (None, 2): [], (4, 12): [(0, 12, 2)]}
    assert find_runs(docs).filter("doc_id = 4").count() == 2 and find_runs(docs.limit(0)).collect() == []
    named = spark.createDataFrame([("k", "z " * 13, 5)], "key string, body string, runs int")
    assert find_runs(named, id_col="key", text_col="body").collect()[0].collapsed == "z"


@pytest.fixture(scope="module")
def rows(spark):
    return queries.queries()["op13_periodic_runs"](spark, SF).collect()


def test_runs_query(spark, rows):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    planted = 0
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a, planted = h // 10 % n, planted + 1
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        want = plain_runs(w)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in want)
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(want), *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept(w, want))))
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period, r.exponent_milli) == (*best, best[1] and 1000 * best[1] // best[2])
    assert planted > 5
