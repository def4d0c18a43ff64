"""Fill-in-middle against a plain list of units, and its exact way back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import queries
from siltstone.llm.fim import FimParams, cuts, fill_in_middle, restore, transform

SF = "/root/testdata/sf0.001"
UNIT = re.compile(FimParams().unit)
ODD = [None, "", "a", "abc", "  ", "é\U0001f600\n\n", "one two", "<P> inside", "a<S>b", "x <M", "<<S", "S> <", "words and 12 numbers. " * 4000, "\r\n\t", "ends with <"]


def plain(text, doc_id):
    """n, form, prefix, middle and suffix by a list of all units."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    kept = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    return len(units), "plain" if kept else "spm" if h4 % 100 < 20 else "psm", "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


def test_fim_against_plain_units(spark):
    rows = [(100 * k + i, t, "note", 1) for k in range(30) for i, t in enumerate(ODD)] + [(None, "null id", None, None), (7, "twice", "n", 2), (7, "twice", "n", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, node int")
    got = fill_in_middle(docs).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = r.text or ""
        n, form, prefix, middle, suffix = plain(text, "" if r.doc_id is None else r.doc_id)
        output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        assert (r.n, r.form, r.output, r.back) == (n, form, output, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(prefix), len(middle)))
    assert sorted((r.doc_id or 0, r.text or "", r.lang or "") for r in got) == sorted((i or 0, t or "", lang or "") for i, t, lang, _ in rows)


def test_fim_cuts_at_any_ranks():
    text = "ab, cd\U0001f600é ef"
    units = UNIT.findall(text)
    for a in range(len(units) + 1):
        for b in range(a, len(units) + 1):
            assert cuts(text, UNIT, a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_fim_keeps_no_units():
    """Memory beside the text and its output does not grow with the number of units."""
    import tracemalloc

    text = "a " * 500_000
    tracemalloc.start()
    transform(text, "3", FimParams(plain=0), UNIT)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text)  # prefix, middle, suffix and output; a million units would take more than ten times as much


def test_fim_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(empty).collect() == []
    with pytest.raises(ValueError, match="form"):
        fill_in_middle(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, form string"))
    named = fill_in_middle(spark.createDataFrame([("k", "a b c")], "key string, body string"), id_col="key", text_col="body").collect()
    assert (named[0].key, named[0].n) == ("k", 5)


def test_fim_query_restores_every_text(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op11_fill_in_middle"](spark, SF).collect()
    assert len(got) == len(texts)
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
