"""The rule ensemble: statistics against plain counts, compiled rules against their definition, held-out accuracy."""

import re
import zlib
from collections import Counter
from math import exp, log1p

import pyarrow as pa
import pytest

from siltstone.llm import queries
from siltstone.llm.quality import STATISTICS, QualityModel, QualityParams, fit_quality, score_quality, simplest, statistics

SF = "/root/testdata/sf0.01"
ODD = [None, "", "  \n", "one", "A B a b", "Word$$$ two### word$$$\nline\nline\n\nline", "née 12 ünder, ok!", "a b c d e " * 300, "x" * 5000, "| 1 | 2 |\r\n| 1 | 2 |"]


def plain(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    blank = len(re.findall("[\x20\x09-\x0d]", text))
    kinds = {k: len(re.findall(p, text)) for k, p in (("letter", "[a-z\u0080-\U0010ffff]"), ("upper", "[A-Z]"), ("digit", "[0-9]"), ("stop", "[.,;:!?'\"()-]"))}
    mark = len(text) - blank - sum(kinds.values())
    share = lambda a, b: a / max(b, 1)
    again = lambda xs: share(len(xs) - len(set(xs)), len(xs))
    grams = lambda k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    lines = re.findall("[^\n\r]+", text)
    ends = sum(bool(re.match(r"[^A-Za-z0-9\u0080-\U0010ffff.,;:!?'\"()\x20\x09-\x0d-]", x[-1])) for x in w)
    return [
        log1p(len(text)), log1p(len(w)), share(len(text) - blank, len(w)), share(kinds["letter"] + kinds["upper"], len(text)), share(kinds["upper"], kinds["letter"] + kinds["upper"]), share(kinds["digit"], len(text)), share(kinds["stop"], len(text)), share(mark, len(text)), share(ends, len(w)),
        again(w), again(grams(2)), again(grams(5)), share(max(Counter(w).values(), default=0), len(w)), log1p(len(lines)), share(len(w), len(lines)), again(lines),
    ]


def test_statistics_against_plain_counts(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    columns = statistics(pa.array(texts, pa.string()))
    assert len(columns) == len(STATISTICS)
    for i, t in enumerate(texts):
        # the last byte of a word decides whether it ends with a mark, and later bytes of a character are none
        want = plain(t)
        assert [float(c[i]) for c in columns] == pytest.approx(want, abs=1e-9), (i, t and t[:80])


def test_compiled_rules(spark):
    rules = [((("letters", False, 0.5), ("log_words", True, 1.0)), 1.5), ((("digits", True, 0.1),), -2.0)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(ODD)], "doc_id long, text string, digits double")
    got = {r.doc_id: r for r in score_quality(docs, QualityModel(rules, 0.25, QualityParams())).collect()}
    for i, t in enumerate(ODD):
        s = dict(zip(STATISTICS, plain(t)))
        want = 0.25 + 1.5 * (s["letters"] <= 0.5 and s["log_words"] > 1.0) - 2.0 * (s["digits"] > 0.1)
        assert got[i].score == pytest.approx(1 / (1 + exp(-want))) and got[i].predicted == int(got[i].score >= 0.3)


def test_simplest_rule():
    assert simplest((("a", True, 1.0), ("b", False, 2.0), ("a", True, 3.0), ("b", False, 1.0))) == (("a", True, 3.0), ("b", False, 1.0))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_query(spark, labels):
    got = queries.queries()["op12_quality_classifier"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].join(labels.toPandas().set_index("doc_id").quality, how="inner")
    assert (held.predicted == held.quality).mean() >= 0.95 and held.quality.nunique() == 2


def test_quality_fit_on_odd_rows(spark, labels):
    """Repeated rows change nothing, a model is sparse, and one class or no label gives that class's score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = QualityParams(per_class=40, trees=6)
    one, twice = (fit_quality(d, labels, few) for d in (docs, docs.unionAll(docs)))
    assert one.rules and len(one.rules) < 30 and one.rules == twice.rules
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (2, None)], "doc_id long, text string")
    marks = lambda *r: spark.createDataFrame(list(r), "doc_id long, quality int")
    scores = lambda m: sorted(round(r.score, 6) for r in score_quality(rows, m).collect())
    assert scores(fit_quality(rows, marks((1, 1), (2, None), (None, 0), (2, 7)))) == [1.0] * 4
    assert scores(fit_quality(rows, marks())) == [0.0] * 4
    assert score_quality(rows.limit(0), one).collect() == []
