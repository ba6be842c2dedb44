"""Operators that keep rows where they are: token counts, quality votes, benchmark windows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.llm import contamination, quality, token_counts
from hybridrank.llm.queries import _tokenizer

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ordered(rows):
    return sorted(rows, key=repr)


def brute_windows(rows, items, window=13, share=20):
    words = lambda s: re.findall(WORDS, (s or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    out = []
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return out


FIELDS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("most", [contamination.AUTOMATON_WORDS, 40])
def test_windows_against_brute_force(cases, case_rows, benchmark, monkeypatch, most):
    monkeypatch.setattr(contamination.automata, "__defaults__", ("item_id", "text", most))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = [tuple(r) for r in contamination.contamination(cases, benchmark).select(*FIELDS).collect()]
    assert ordered(got) == ordered(brute_windows(case_rows, items))


def test_windows_of_repeated_items(spark, cases, case_rows, benchmark, monkeypatch):
    """Repeated benchmark rows make automata no more and no larger; no plan holds more than one automaton's scan."""
    repeated = benchmark
    for _ in range(4):
        repeated = repeated.unionByName(repeated)
    sizes = [sorted(len(a.length) for a in contamination.automata(b, 13, most=60)) for b in (benchmark, repeated)]
    assert sizes[0] == sizes[1] and len(sizes[0]) > 1
    monkeypatch.setattr(contamination.automata, "__defaults__", ("item_id", "text", 60))
    found = contamination.contamination(cases, repeated).select(*FIELDS)
    assert found._jdf.queryExecution().analyzed().toString().count("scan(") == 1
    assert ordered(tuple(r) for r in found.collect()) == ordered(brute_windows(case_rows, [(r.item_id, r.text) for r in benchmark.collect()]))


def test_windows_of_nothing(cases, nothing, benchmark):
    assert contamination.contamination(nothing, benchmark).collect() == []
    assert contamination.contamination(cases, benchmark.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    kept = contamination.clean_documents(cases, benchmark)
    assert kept.columns == cases.columns
    bad = contamination.contamination(cases, benchmark).filter("contaminated").count()
    assert 0 < bad and kept.count() == cases.count() - bad


def test_hits_are_cut_out():
    automaton = contamination.Automaton([("1", contamination.words("b c d"))], 3)
    text = "A, b C d! e b c d".encode()
    marks, items = automaton.scan(contamination.words(text))
    assert (list(marks), items) == ([0, 1, 1, 1, 0, 1, 1, 1], {"1"})
    assert contamination.without_hits(text, bytes(marks)) == "A, ! e "


def test_automaton_random():
    rng = np.random.default_rng(3)
    for _ in range(60):
        window = int(rng.integers(2, 5))
        items = [(str(k), "".join(rng.choice(list("ab"), rng.integers(1, 9)))) for k in range(4)]
        doc = [(0, " ".join(rng.choice(list("ab"), 30)), "")]
        spaced = [(i, " ".join(t)) for i, t in items]
        automaton = contamination.Automaton([(i, contamination.words(t)) for i, t in spaced], window)
        marks, found = automaton.scan(contamination.words(doc[0][1]))
        want = brute_windows(doc, spaced, window)[0]
        assert (sum(marks or b""), len(found)) == want[2:4]


def test_counts_against_tokenizer(spark, cases, case_rows, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = _tokenizer("piece_bpe_32k.model")
    pieces, by_bytes = token_counts.pieces_of(path)
    assert by_bytes and any("▁" in p[1:] for p, _ in pieces)
    every_byte = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *every_byte], unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    counter = token_counts.Counter(pieces, by_bytes)
    for text in ("a   b", "x    y  z", "  lead", "trail  ", "▁▁ ▁", " ", "a\u3000b \n c", "<s> </s>"):
        assert counter.text(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text
    assert counter.text("a<0x41>b") == counter.text("a<0x42>b") > 3  # pieces for bytes are never read from a text
    got = [tuple(r) for r in token_counts.counted(cases, path).collect()]
    assert ordered(got) == ordered((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in case_rows)
    assert token_counts.counted(nothing, path).collect() == []


def test_counts_ties_and_unknowns():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = np.random.default_rng(1)
    for _ in range(80):
        words = {"".join(rng.choice(list("ab▁"), rng.integers(1, 4))) for _ in range(6)}
        pieces = [("<unk>", 0.0)] + [(p, -float(rng.integers(1, 4))) for p in sorted(words | ({"▁"} if rng.random() < 0.6 else set()))]
        tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        counter = token_counts.Counter(pieces)
        for _ in range(10):
            text = "".join(rng.choice(list("abc é"), rng.integers(0, 12)))
            assert counter.text(text) == len(tokenizer.encode(text).ids), (pieces, text)


@pytest.fixture(scope="module")
def labelled(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf_small}/../sf0.1/labels.parquet")


def test_quality_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = quality.scored(docs, labels).join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    bad = [r.predicted for r in rows if r.quality == 0]
    good = [r.predicted for r in rows if r.quality == 1]
    assert len(rows) > 500 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_quality_of_repeated_ids(spark, labelled):
    """However many rows share a chosen id, one text of it is gathered; the same in any order."""
    docs, labels = labelled
    ids = [r.doc_id for r in labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id").distinct().orderBy("doc_id").limit(6).collect()]
    some, known = docs.filter(F.col("doc_id").isin(ids)), labels.filter(F.col("doc_id").isin(ids))
    again = some.filter(F.col("doc_id") == ids[0])
    for _ in range(5):
        again = again.unionByName(again)
    other = again.limit(3).withColumn("text", F.lit("another text of the same id"))
    many = some.unionByName(again).unionByName(other)
    plain, model = quality.fit(some, known, dimensions=4), quality.fit(many, known, dimensions=4)
    assert len(plain.labels) == len(model.labels) == some.select("doc_id").distinct().count()
    assert model.labels.tolist() == plain.labels.tolist()
    turned = quality.fit(many.repartition(7), known, dimensions=4)
    assert np.allclose(turned.vectors, model.vectors) and turned.labels.tolist() == model.labels.tolist()


def test_quality_of_cases(spark, cases, case_rows, nothing, labelled):
    docs, labels = labelled
    rows = quality.scored(cases, labels.filter("doc_id < 0")).collect()
    assert len(rows) == len(case_rows) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(("null" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (4, 0), (508, 0), (None, 1), (9, None), (10, 3)], "doc_id long, quality int")
    rows = quality.scored(cases, labels, neighbours=2).collect()
    assert len(rows) == len(case_rows) and all(0.0 <= r.score <= 1.0 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert quality.scored(nothing, labels).collect() == []
    assert quality.accepted(cases, labels, neighbours=2).columns == cases.columns


def test_votes_and_axes_by_brute_force():
    """Ties at the edge go to the earlier labelled vector; the axes are the main directions."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        kinds = quality._unit_rows(rng.normal(size=(5, 6))).astype(np.float32)
        vectors, labels = kinds[rng.integers(0, 5, 60)], rng.integers(0, 2, 60).astype(np.float32)
        asked = quality._unit_rows(rng.normal(size=(8, 6))).astype(np.float32)
        got = quality.vote(quality.Model(np.eye(6, dtype=np.float32), vectors, labels, 7, 8.0), asked)
        for q, score in zip(asked, got, strict=True):
            near = sorted(range(60), key=lambda j: (-round(float(q @ vectors[j]), 6), j))[:7]
            weight = np.array([max(float(q @ vectors[j]), 1e-6) ** 8 for j in near])
            assert score == pytest.approx(float((weight * labels[near]).sum() / weight.sum()), abs=1e-4)
    alike, first = np.tile(np.array([[1.0, 0.0]], np.float32), (3000, 1)), np.repeat([1.0, 0.0], [16, 2984]).astype(np.float32)
    assert quality.vote(quality.Model(np.eye(2), alike, first, 16, 8.0), alike[:1])[0] == 1.0
    x = (rng.normal(size=(300, 40)) * np.linspace(5, 0.1, 40)).astype(np.float16)
    axes = quality._axes(x, 5, spare=10)
    _, _, exact = np.linalg.svd(x.astype(np.float64), full_matrices=False)
    assert np.allclose(np.abs(np.diag(axes.T @ exact[:5].T)), 1, atol=1e-3)


def test_stages_keep_columns_of_any_name(spark, case_rows, benchmark):
    """Columns named like an operator's own come back as they were; empty tables too."""
    from hybridrank.llm import mixing, near_join

    names = ["row", "score", "doc", "twin", "__score", "__doc", "__twin", "__r", "__n_hit", "__next", "__contaminated", "__size", "__copy", "__copies", "__id", "__crc", "__own", "__from"]
    docs = spark.createDataFrame([(i, t, s) for i, t, s in case_rows], "doc_id long, text string, source string")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)], "doc_id long, quality int")
    stages = {
        "quality": lambda d: quality.accepted(d, labels, threshold=0.0),
        "near": near_join.one_of_each,
        "clean": lambda d: contamination.clean_documents(d, benchmark),
        "mix": lambda d: mixing.repeat_documents(d, mixing.mix(d, [5, 2, 1], 1.5, 2.0)),
    }
    for stage in stages.values():
        rows = stage(docs).collect()
        assert rows and all(r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
        assert stage(docs).columns == docs.columns
        assert stage(docs.limit(0)).collect() == []


def test_decontaminated_texts_lose_their_spans(spark):
    passage = " ".join(f"bench{i}" for i in range(13))
    long = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{long} {passage.upper()}. {long}"), (2, f"short {passage}"), (3, long), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in contamination.clean_documents(docs, items).collect()}
    assert got == {1: f"{long} . {long}", 3: long, 4: None}
