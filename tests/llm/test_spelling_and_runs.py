import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.llm import fm_index, periodic, queries, spelling

CLASHING = ["n", "word", "near", "root", "runs", "collapsed", "id", "found", "block"]


def with_clashes(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def points(word):
    return np.array([ord(c) for c in word], np.int64)


def test_index_finds_all_words_one_error_away():
    rng = random.Random(2)
    for _ in range(60):
        letters = "abcd"[: rng.randint(1, 4)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 50))})
        rng.shuffle(words)
        asked = words + ["".join(rng.choice(letters + "z") for _ in range(rng.randint(2, 7))) for _ in range(10)]
        index, found = fm_index.BidirectionalIndex([points(w) for w in words]), set()
        for first in (True, False):
            pairs = list(zip(*(x.tolist() for x in fm_index.one_error(index, [points(q) for q in asked], first)), strict=True))
            assert len(pairs) == len(set(pairs))
            found |= set(pairs)
        assert found == {(i, j) for i, q in enumerate(asked) for j, w in enumerate(words) if len(w) >= len(q) and one_apart(q, w)}


def expected_variants(rows, least=6, count=5, times=5, every=199):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    known = {w: n for w, n in total.items() if len(w) >= least and n >= count}
    near = {w: [v for v in known if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in known}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-known[v], v), default=None)
        if best is not None and known[best] >= times * known[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), known.get(form.get(w), 0)) for w, n in known.items())


@pytest.fixture(scope="module")
def spelt(spark):
    rng = random.Random(7)
    base = ["grenze", "übergang", "Spelling", "aaaaaa", "aaaaaaa", "aaaaaaaa", "naïveté", "ÀÉÎÕÜß", "wordform", "wordsform", "x" * 3000]
    words = []
    for w in base:
        forms = {w} | {w[:i] + rng.choice("abé") + w[i + rng.randint(0, 1) :] for i in (rng.randrange(len(w)) for _ in range(12))}
        for f in forms:
            words += [f] * rng.choice([2, 5, 6, 25, 30, 130])
    # a chain of forms, each five times as frequent as the one before
    for k, w in enumerate(["chainaaaa", "chainbaaa", "chainbbaa", "chainbbba", "chainbbbb"]):
        words += [w] * 5 ** (k + 1)
    words += ["suffix" + a + b for a in "abcdefghij" for b in "abcdefghij" for _ in range(5)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    rows += [(None, None), (None, "no id Spelling-Spelling spelling9spelling"), (3, ""), (5, rows[5][1]), (6, "日本語 short an")]
    return rows


@pytest.mark.parametrize("share", [8192, 25])
def test_variants(spark, spelt, share):
    docs = with_clashes(spark.createDataFrame(spelt, "doc_id long, text string")).repartition(5)
    got = spelling.variants(spelling.counted_words(docs, 6, 199), share=share).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == expected_variants(spelt)
    assert {r.root for r in got if r.word.startswith("chain")} == {"chainbbbb"}


def test_words_without_typos(spark, spelt):
    docs = spark.createDataFrame(spelt, "doc_id long, text string")
    got = spelling.variants(spelling.counted_words(docs)).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == expected_variants(spelt, every=2**40)


def test_nothing_to_spell_or_repeat(spark):
    docs = with_clashes(spark.createDataFrame([], "doc_id long, text string"))
    assert spelling.variants(spelling.counted_words(docs)).collect() == []
    assert periodic.repeated_stretches(docs).collect() == []


def brute_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i:
                s, e = i, j + q
                if e - s >= max(least, 2 * q) and not any(all(words[x] == words[x + p] for x in range(s, e - p)) for p in range(1, q)):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("rounds", [periodic.ROUNDS, 1])
def test_runs_of_numbers(monkeypatch, rounds):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng = random.Random(11)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randrange(rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randint(0, 60))]
            at = rng.randrange(len(words) + 1)
            texts.append(words[:at] + words[at : at + rng.randint(1, 10)] * rng.randint(1, 6) + words[at:])
        offsets = np.cumsum([0, *map(len, texts)])
        least = rng.choice([12, 4, 2])
        found = periodic.periodic_runs(np.array([w for t in texts for w in t], np.int32), offsets, least)
        assert found == [(int(o) + s, int(o) + s + n, q) for t, o in zip(texts, offsets, strict=False) for s, n, q in brute_runs(t, least)]


def test_runs_survive_hashes_that_collide(monkeypatch):
    monkeypatch.setattr(periodic._Equal, "at", lambda self, places, lag, size: np.ones(len(places), bool))
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.randrange(2) for _ in range(60)]
        assert periodic.periodic_runs(np.array(words, np.int32), np.array([0, 60]), 4) == [(s, s + n, q) for s, n, q in brute_runs(words, 4)]


def test_a_very_long_text_takes_no_square_of_its_length():
    words = np.zeros(60_000, np.int32)
    assert periodic.periodic_runs(words, np.array([0, len(words)])) == [(0, 60_000, 1)]
    k = np.arange(40_000)
    chain = np.stack([k, np.maximum(0, k - 1)], axis=1).ravel().astype(np.int32)  # each cut makes one more word rare
    assert periodic.periodic_runs(chain, np.array([0, len(chain)])) == []


def planted(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_periodic_query(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "é x y " * 9), (204, "a\tb\x0bc\x0c " * 9), (None, "no id " * 7), (None, None), rows[3], (205, "z " * 20_000)]
    with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc, text in rows:
        words = planted(doc, text)
        runs = [(0, 20_000, 1)] if doc == 205 else brute_runs(words)
        assert doc != 205 or len(set(words)) == 1
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((doc, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:8] for r in got), key=lambda r: str(key(r))) == sorted(expected, key=lambda r: str(key(r)))
