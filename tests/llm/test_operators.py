"""The numbered operators: DuckDB where SQL expresses them, brute force or held-out accuracy elsewhere."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from dataclasses import fields, replace
from math import log2, log10
from random import Random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import queries
from siltstone.llm.decontaminate import WinnowParams, drop_contaminated, find_contamination
from siltstone.llm.jaccard import JaccardParams, jaccard_classes, keep_one_of_each
from siltstone.llm.language import LanguageParams, fit_language, frequencies, identify_language
from siltstone.llm.licenses import TEMPLATES, scan_licenses
from siltstone.llm.lm import LmParams, score, train
from siltstone.llm.packing import pack
from siltstone.llm.secrets import ALLOWED, CLASSES, KINDS, WITHIN, find_spans, redact_secrets, scan_secrets
from siltstone.llm.substrings import SubstringParams, mark_repeats
from siltstone.llm.toxicity import ToxicityParams, fit_toxicity, keep_clean, present, score_toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node int"
WORDS = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None, None, "a", 0, "x", 1), (2, "", "en", None, 0, None, 2), (3, "one", "en", "a", 3, "y", None), (4, WORDS, "en", "a", 9, "y", 3),
    (4, WORDS, "en", "a", 9, "y", 3), (5, WORDS, "fr", "b", 9, "y", 3), (6, "é \U0001f600 " * 30000, "fr", "b", 9, "z", 3), (None, "lone words here", None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name]).to_arrow_table().select(columns)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns])))
    assert rows(got.select(*columns).toArrow()) == rows(want)


MIT = TEMPLATES["MIT"][1]
APACHE = TEMPLATES["Apache-2.0"][1]
CC = TEMPLATES["CC-BY-4.0"][1]


@pytest.mark.parametrize(("text", "want"), [
    (CC.replace("Commons ", "Commons\n"), {("CC-BY-4.0", 1)}),
    ("Some words before it. Other words\n" + CC.replace("Commons ", "Commons\n") + "\nand prose that goes on. And on.", {("CC-BY-4.0", 1)}),
    ("Prose in front of it, without a blank line. " + MIT + " More prose follows at once, and then more.", {("MIT", 1)}),
    (MIT.replace(": The above", ":\n\nThe above").replace("copies or", "copies\nor"), {("MIT", 1)}),
    (APACHE.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless", "\n\n    Unless"), {("Apache-2.0", 1)}),
    ((CC + "\n") * 40 + "filler\n" + MIT, {("CC-BY-4.0", 40), ("MIT", 1)}),
    (CC + "\nfiller words\n" + CC, {("CC-BY-4.0", 2)}),
    ("You may use the work under the terms of a contract. This software is furnished to do so, without warranty.", set()),
    ("license " * 50, set()),
])
def test_license_runs(spark, text, want):
    """Wrapped, embedded and split notices, repeated ones, and text that only sounds alike."""
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    found = scan_licenses(docs).collect()
    assert {(r.license_id, r.n_places) for r in found if r.best_dice > 0.9} == want and (want or not found)


def top_k_rows(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["op1_top_k_search"]).fetchall()
    got = queries.queries()["op1_top_k_search"](spark, str(folder)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    return want


def test_top_k_repeated_and_clashing_ids(spark, tmp_path):
    """Repeated rows are one; different vectors of an id, also of another length, all take part."""
    rng = Random(5)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vector(6)) for i in range(90)]
    rows += [rows[20]] + [rows[40]] * 19 + [rows[3]] * 5
    rows += [(i, vector(6)) for i in (0, 0, 7, 7, 7, 60)]
    rows += [(i, vector(2)) for i in (60, 7, 100, 101, 102)]
    rows += [(None, vector(6)), (200, None), (201, []), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6)]
    want = top_k_rows(spark, tmp_path, rows)
    assert Counter(r[0] for r in want) == {0: 20, 20: 20, 40: 20, 60: 20, 80: 20, 100: 4}


def test_top_k_empty_table(spark, tmp_path):
    assert top_k_rows(spark, tmp_path, []) == []


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_toxicity(spark, docs):
    got = queries.queries()["op4_toxicity"](spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (crc(i) % 5 == 0) for i, h in got.held_out.items())
    assert (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].join(labels, how="inner")
    assert (held.predicted == held.toxic).mean() >= 0.85


def test_toxicity_against_plain_fit(spark, docs):
    """The buckets with a weight are those of a plain count and test over the learned texts; repeated rows change nothing."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    params = ToxicityParams(per_class=50, level=0.01)
    model, twice = fit_toxicity(docs, labels, params), fit_toxicity(docs.unionAll(docs).unionAll(docs), labels, params)
    assert (model.kept == twice.kept).all() and np.allclose(model.weights, twice.weights, atol=1e-5)
    y = {r.doc_id: r.toxic for r in labels.filter("toxic IS NOT NULL").collect() if crc(r.doc_id) % 5}
    rows = docs.withColumn("h", F.xxhash64("doc_id")).collect()
    own = [(y[r.doc_id], r.text) for r in sorted((r for r in rows if r.doc_id in y), key=lambda r: r.h)]
    own = [r for c in (0, 1) for r in [x for x in own if x[0] == c][:50]]
    held = [[set() for _ in own], np.array([c for c, _ in own])]
    for i, (_, t) in enumerate(own):
        held[0][i] = set(present([t], params.sizes, params.bits)[1].tolist())
    n = [int((held[1] == c).sum()) for c in (0, 1)]
    count = [Counter(b for s, c in zip(held[0], held[1]) for b in s if c == k) for k in (0, 1)]

    def z(b):
        q, p = count[0][b], count[1][b]
        rate = (p + q + 1) / (sum(n) + 2)
        return abs(p / n[1] - q / n[0]) / (rate * (1 - rate) * (1 / n[0] + 1 / n[1])) ** 0.5 if p + q > 1 else 0

    want = {b for b in count[0] | count[1] if z(b) >= 2.5758293035489}  # 1 % of a normal variable lie outside
    assert set(np.flatnonzero(model.kept).tolist()) == want and len(want) > 20


def test_toxicity_tries_parameters_apart(spark, docs):
    """The loss of the tried rows decides: with one value of each parameter, that one is taken, with several, one of them."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = [fit_toxicity(docs, labels, ToxicityParams(decays=(d,), steps=(s,))) for d in (1e-3, 1e-1) for s in (50, 200)]
    both = fit_toxicity(docs, labels, ToxicityParams(decays=(1e-3, 1e-1), steps=(50, 200)))
    assert sum(np.allclose(both.weights, m.weights, atol=1e-6) for m in one) == 1


def test_language(spark, docs):
    got = queries.queries()["op5_language_id"](spark, SF).toPandas().set_index("doc_id")
    lang = docs.toPandas().set_index("doc_id").lang
    held = got[got.held_out].join(lang, how="inner").dropna(subset=["lang"])
    assert (held.lang_pred == held.lang).mean() >= 0.85 and got.score.between(0, 1).all()


def test_language_every_tag_is_learned(spark):
    """More languages than a block holds: each has its own alphabet and is found again, as it is with one block."""
    rng = Random(9)
    alphabets = {f"l{i:03}": [chr(0x4E00 + 12 * i + j) for j in range(12)] for i in range(230)}
    rows = [(10 * i + k, name, " ".join("".join(rng.choices(letters, k=4)) for _ in range(30))) for i, (name, letters) in enumerate(alphabets.items()) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    few, one = (identify_language(docs, fit_language(docs, LanguageParams(block_languages=n))).toPandas().set_index("doc_id") for n in (64, 1000))
    assert few.sort_index().equals(one.sort_index())
    want = {r[0]: r[1] for r in rows}
    learned = {name for i, name, _ in rows if crc(i) % 5}
    assert all(few.lang_pred[i] == name for i, name in want.items() if name in learned and crc(i) % 5)
    assert set(few.lang_pred) == learned and len(learned) > 200


def test_language_against_plain_count(spark, docs):
    """Document frequencies are those of all training texts, and centroids those of a plain k-means on the sample."""
    params = LanguageParams(per_language=40)
    model = fit_language(docs, params)
    rows = [r for r in docs.withColumn("h", F.xxhash64("doc_id", "text")).collect() if r.lang is not None and r.text is not None and crc(r.doc_id) % 5]
    tf, letters = frequencies([r.text for r in rows], params)
    idf = np.log((1 + letters.sum()) / (1 + (tf[letters] > 0).sum(0))) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5)
    block = next(model.blocks())
    for name in model.languages:
        own = sorted((i for i, r in enumerate(rows) if r.lang == name and letters[i]), key=lambda i: rows[i].h)[:40]
        x = tf[own] * idf
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        c = x[np.linspace(0, len(x) - 1, min(3, len(x))).astype(int)]
        for _ in range(params.rounds):
            at = (x @ c.T).argmax(1)
            c = np.stack([x[at == j].sum(0) / np.linalg.norm(x[at == j].sum(0)) if (at == j).any() else c[j] for j in range(len(c))])
        assert np.allclose(block.centroids[[n == name for n in block.names]], c, atol=1e-4), name


def test_language_rejects_what_is_far(spark):
    rows = [(i, "en" if i % 2 else "de", ("the house and the garden " if i % 2 else "das Haus und der Garten ") * 5) for i in range(60)]
    docs = spark.createDataFrame(rows + [(100, None, "Жилой дом и сад"), (101, None, "123 !?")], "doc_id long, lang string, text string")
    got = identify_language(docs, fit_language(docs)).toPandas().set_index("doc_id")
    assert got.lang_pred[100] in ("de", "en") and got.rejected[100] and got.accepted[100] == "und"
    assert (got.lang_pred[101], got.score[101], got.accepted[101]) == ("und", 0.0, "und")
    assert not got.rejected[3] and got.accepted[3] == got.lang_pred[3] == "en"


def test_lm_base(spark, texts):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", lower(t)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in queries.queries()["op6_lm_scoring"](spark, SF).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0


@pytest.mark.parametrize("bound", sorted(f.name for f in fields(LmParams) if f.name not in ("pair_weight", "hashes", "fold", "held")))
def test_lm_score_under_any_bound(spark, docs, texts, bound):
    """What bounds a task's work changes no score: words and pairs seen once count under any bound."""
    some = sorted(texts)[:60]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", lower(texts[i])), None] for i in some}
    follows = lambda ws: list(zip([None, *ws], ws))
    train_on = [tokens[i] for i in some if crc(i) % 7 != 2]
    one, two = Counter(w for ws in train_on for w in ws), Counter(p for ws in train_on for p in follows(ws))
    n, v = sum(one.values()), len(one)
    value = lambda c: 1.5 * 2.0 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    params = replace(LmParams(hashes=30), **{bound: 2000})  # 30 hashes: no false positives among these few
    few = docs.filter(F.col("doc_id").isin(some))
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    got = {r.doc_id: r.score for r in score(few, train(few.filter(fold != 2), params), F.coalesce(fold == 2, F.lit(False))).collect()}
    assert got.keys() == set(some) and any(c == 1 for c in one.values())
    for i in some:
        want = sum(log10(0.6 * (min(value(two[a, b]) / max(value(one[a]), 1), 1) if one[a] else 0) + 0.4 * (value(one[b]) + 1) / (n + v + 1)) for a, b in follows(tokens[i]))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_packing_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    rows = queries.queries()["op8_best_fit_packing"](spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(p, p * 2048, min(2048, len(ids) - p * 2048)) for p in range(-(-len(ids) // 2048))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= 1.05 * sum(r.length for r in rows) / 2048 + 1


BASE = (
    ("assign", re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 6, 1),
    ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0),
)


def test_secret_base_spans(spark, texts):
    for r in queries.queries()["op9_secret_scan"](spark, SF).collect():
        spans = [(m.start(), k, kind, m.end()) for k, (kind, p, least, g) in enumerate(BASE) for m in p.finditer(texts[r.doc_id]) if len(m[g]) >= least]
        line = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(line) <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize("key", [
    "k3v9x0qz7m2w8tj5r1ypb4ncg6", "K3V7XQZM2WTJ5RYPB4NCG6HDLA", "qzkxwvjmpfybhgtdncrulosaie", "kQzXwVjMpFyBhGtDnCrUlOsA", "Zk3vX9qL0wTj5RyPb4Nc",
])
def test_secret_character_classes(key):
    """Keys of each class, also of 20 characters and of letters alone, after a path that holds an allow-listed word."""
    for before in ("", "x = ", "opt/example/", "test_only/dummy="):
        spans = find_spans(f"{before}{key} and more")
        assert any(a <= len(before) and len(before) + len(key) <= b for a, b, _ in spans), (before, spans)
    assert find_spans(f"example{key}") == []


def plain_entropy_spans(text):
    """All spans by the definition: every window counted anew, every span compared with every other."""
    found = [(m.start(), m.end(), kind) for kind, p, least, g in BASE for m in p.finditer(text) if len(m[g]) >= least]
    base = list(found)
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
        gone = [False] * len(m[0])
        for x in ALLOWED.finditer(m[0]):
            a, b = x.span()
            while a > 0 and m[0][a - 1] not in "/=_-":
                a -= 1
            while b < len(m[0]) and m[0][b] not in "/=_-":
                b += 1
            gone[a:b] = [True] * (b - a)
        edges = [i for i in range(len(gone) + 1) if i in (0, len(gone)) or gone[i] != gone[i - 1]]
        for a, b in zip(edges, edges[1:]):
            piece = m[0][a:b]
            if gone[a] or len(piece) < 20 or piece.isdigit():
                continue
            own = []
            for cls in CLASSES:
                hit = [False] * len(piece)
                for i in range(len(piece) - cls.window + 1):
                    w = piece[i : i + cls.window]
                    if set(w) <= set(cls.characters) and all(set(w) & set(n) for n in cls.needs):
                        if -sum(c / len(w) * log2(c / len(w)) for c in Counter(w).values()) >= cls.bits - 1e-9:
                            hit[i : i + cls.window] = [True] * cls.window
                starts = [i for i in range(len(hit)) if hit[i] and (i == 0 or not hit[i - 1])]
                new = []
                for i in starts:
                    j = i
                    while j < len(hit) and hit[j]:
                        j += 1
                    span = (m.start() + a + i, m.start() + a + j)
                    if not any(x <= span[0] and span[1] <= y for x, y, _ in base + (own if cls.kind in WITHIN else [])):
                        new.append((*span, cls.kind))
                own += new
            found += own
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def test_secret_entropy_spans_against_plain_windows(texts):
    rng = Random(8)
    pieces = ["", "example", "test_only", "0123456789abcdef", "/", "=", "-", "_", " ", "\n", "password: ", "token=", "é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization"]
    sets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyz"]
    made = ["".join(rng.choice(pieces) if rng.random() < 0.4 else "".join(rng.choices(rng.choice(sets), k=rng.randrange(3, 50))) for _ in range(8)) for _ in range(300)]
    spans = 0
    for text in made + list(texts.values())[:60]:
        want = plain_entropy_spans(text)
        assert find_spans(text) == want, text
        spans += len(want)
    assert spans > 500


def test_secret_long_texts():
    """Time grows with the text: four megabytes of keys, and one candidate full of allow-listed words, take seconds."""
    rng = Random(2)
    keys = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40)) for _ in range(25_000))
    began = time.perf_counter()
    assert len(find_spans(keys)) > 20_000
    one = time.perf_counter() - began
    began = time.perf_counter()
    find_spans(keys * 4)
    assert time.perf_counter() - began < 12 * one + 5
    assert find_spans("example" * 300_000) == []


def test_secret_allowed_and_plain():
    for text in ("test_only/example-placeholder=dummy", "123e4567-e89b-12d3-a456-426614174000", "9" * 23, "internationalization", "Donaudampfschifffahrtsgesellschaft", "z" * 30):
        assert find_spans(text) == [], text


def grams(t):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("params", [SubstringParams(hot=1), SubstringParams(block_chars=20_000), SubstringParams(shard_chars=10_000, hot=3)])
def test_substrings_under_any_bound(spark, docs, params):
    """What bounds a block or a shard, and what splits a common minimiser, changes no result."""
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(mark_repeats(docs, params)) == rows(mark_repeats(docs))


def test_substrings_need_whole_number_ids(spark, odd):
    with pytest.raises(TypeError, match="whole-number"):
        mark_repeats(odd, id_col="id")


def test_jaccard_recall():
    """The runs are as many as the expected misses at the threshold allow."""
    params = JaccardParams()
    assert params.missed(params.runs) <= 1 - params.recall < params.missed(params.runs - 1)


def test_jaccard_split_buckets_and_large_group(spark):
    """Buckets that are split down to the last level, and a chain of near copies over many chunks, lose no link."""
    rng = Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(160)]
    texts = {}
    for i in range(600):
        words = base if i < 400 else [f"x{rng.randrange(10**6)}" for _ in range(160)]
        words = list(words)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: grams(t) for i, t in texts.items()}
    links = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    got = {r.doc_id: r for r in jaccard_classes(docs, JaccardParams(small=16)).collect()}
    assert {i: got[i].n_links for i in sets} == links
    assert [i for i in sets if got[i].class_id != (0 if i < 400 else i)] == [i for i in range(400) if not links[i] and i]


def test_jaccard_against_all_pairs(spark, texts):
    sets = {i: grams(t) for i, t in texts.items()}
    linked = defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                linked[a].add(b)
                linked[b].add(a)
    root = {}
    for i in ids:
        stack = [] if i in root else [i]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += linked[x]
    got = {r.doc_id: r for r in queries.queries()["op10_ngram_jaccard_join"](spark, SF).collect()}
    assert {i: got[i].n_links for i in ids} == {i: len(linked[i]) for i in ids}
    assert {i: got[i].class_id for i in ids} == root


def test_stages(spark, docs, texts):
    """Each stage on the raw documents: what goes is what its operator names, and columns stay."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    scores = queries.queries()["op4_toxicity"](spark, SF)
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    assert clean == {r.doc_id for r in scores.filter("predicted = 0").collect()}
    classes = queries.queries()["op10_ngram_jaccard_join"](spark, SF)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()) == sorted(r.class_id for r in classes.select("class_id").distinct().collect())
    hit = queries.queries()["op2_decontamination"](spark, SF).filter("contaminated").select("doc_id")
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, SF).collect()} == texts.keys() - {r.doc_id for r in hit.collect()}
    assert corpus_pipeline.hide_secrets(spark, docs, SF).count() == len(texts)


@pytest.mark.parametrize("params", [WinnowParams(block_words=300), WinnowParams(block_words=300, filter_bits=1 << 10)])
def test_contamination_in_blocks(spark, docs, params):
    """A benchmark of many blocks gives what one block gives, repeated documents and short items included."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = items.unionByName(spark.createDataFrame([("short", "the and"), ("none", None), ("blank", " "), (None, "the and of")], "item_id string, text string"))
    twice = docs.unionAll(docs.filter("doc_id % 3 = 0"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    one = rows(find_contamination(twice, items))
    assert rows(find_contamination(twice, items, params)) == one and any(r[5] for r in one) and not all(r[5] for r in one)
    gone = {r[0] for r in one if r[5]}
    assert {r.doc_id for r in drop_contaminated(twice, items, params).collect()} == {r[0] for r in one} - gone


def test_pipeline_run(spark, docs):
    """The whole run packs what the four stages before keep, each on its predecessor's output."""
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in kept.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want.keys() and 0 < len(want) < docs.count()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in want[r.doc_id][r.start : r.start + r.length]))
    assert sum(r.length for r in rows) == sum(map(len, want.values()))


def test_stages_on_odd_rows(spark, odd):
    """Stages keep columns, and rows that their operator has nothing against."""
    bench = spark.createDataFrame([(1, WORDS)], "item_id long, text string")
    left = drop_contaminated(odd, bench)
    assert left.columns == odd.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 6]
    hidden = redact_secrets(odd.withColumn("text", F.when(F.col("doc_id") == 3, "password = hunter2x!").otherwise(F.col("text"))))
    texts = {r.doc_id: (r.text, r.n_chars) for r in hidden.collect()}
    assert hidden.columns == odd.columns and "hunter2x" not in texts[3][0] and texts[3][1] == len(texts[3][0]) and texts[4][0] == WORDS and texts[1][0] is None
    packed = pack(odd, queries.vocabulary_path()).collect()
    assert sorted({r.doc_id for r in packed if r.doc_id is not None}) == [1, 2, 3, 4, 5, 6] and sum(r.doc_id == 4 for r in packed) == 2
    assert all(sum(q.length for q in packed if q.sequence_id == r.sequence_id) <= 2048 for r in packed)
    for empty in (drop_contaminated(odd.limit(0), bench), redact_secrets(odd.limit(0)), pack(odd.limit(0), queries.vocabulary_path())):
        assert empty.count() == 0


def operators(spark, docs):
    bench = spark.createDataFrame([(1, WORDS), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 7)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    return {
        "decontaminate": lambda: find_contamination(docs, bench), "licences": lambda: scan_licenses(docs), "toxicity": lambda: score_toxicity(docs, fit_toxicity(docs, labels)),
        "language": lambda: identify_language(docs, fit_language(docs)), "lm": lambda: score(docs, train(docs.filter(fold != 2), LmParams()), F.coalesce(fold == 2, F.lit(False))),
        "substrings": lambda: mark_repeats(docs), "packing": lambda: pack(docs, queries.vocabulary_path()), "secrets": lambda: scan_secrets(docs), "jaccard": lambda: jaccard_classes(docs),
        "one_of_each": lambda: keep_one_of_each(docs), "clean": lambda: keep_clean(docs, fit_toxicity(docs, labels)),
    }


NAMES = ("decontaminate", "licences", "toxicity", "language", "lm", "substrings", "packing", "secrets", "jaccard", "one_of_each", "clean")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    """Nulls, empty and long texts, repeated rows and clashing column names."""
    n = operators(spark, odd)[name]().count()
    if name in ("toxicity", "language", "lm", "substrings", "secrets", "jaccard", "decontaminate"):
        assert n == len(ODD)
    if name == "one_of_each":
        assert n == 6


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, name):
    assert operators(spark, odd.limit(0))[name]().count() == 0
