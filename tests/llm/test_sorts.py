"""Operators that order or pair rows: shards, mix, content sort, suffix sort, near duplicates; the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hybridrank.llm import components, content_sort, kernels, mixing, near_join, sharding, suffixes
from hybridrank.llm.common import NO_ID
from hybridrank.llm.queries import CURVE, MIX

LOWER = {c: c + 32 for c in range(65, 91)}


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- shards


def test_hilbert_curve_is_one(spark):
    """Every cell once, and neighbours on the curve differ by one step in one axis."""
    from pyspark.sql import functions as F

    for n, bits in ((2, 3), (3, 2), (4, 2), (2, 1), (1, 3)):
        cells = spark.range(1 << (n * bits)).select(*[F.expr(f"shiftright(id, {k * bits}) & {(1 << bits) - 1}").alias(f"c{k}") for k in range(n)])
        rows = cells.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (n * bits)))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))  # noqa: B905


@pytest.mark.parametrize("n_shards", [40, 7, 1000])
def test_shards(cases, case_rows, n_shards):
    rows = sharding.shard(cases, n_shards, CURVE).collect()
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t, _ in case_rows]
    assert ordered((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == ordered(want)
    shards = Counter(r.shard for r in rows)
    counts = [shards.get(s, 0) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for s in shards:
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [r.curve for r in own] == sorted(r.curve for r in own)
    again = sharding.shard(cases.repartition(3), n_shards, CURVE).collect()
    assert ordered(again) == ordered(rows)


def test_shards_of_nothing_and_files(spark, cases, nothing, tmp_path):
    assert sharding.shard(nothing, 40, CURVE).collect() == []
    sharding.write_shards(cases, 5, CURVE, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert ordered(back.select(*cases.columns).collect()) == ordered(cases.collect())
    equal = spark.createDataFrame([(1, "same", 4)] * 50 + [(i, f"t{i}", i) for i in range(2, 52)], "doc_id long, text string, n_chars long").withColumns({"source": F.lit("s"), "lang": F.lit("l")})
    sharding.write_shards(equal, 10, CURVE, str(tmp_path / "equal"))
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "equal")).groupBy("shard").count().collect()] == [10] * 10
    sharding.write_shards(nothing, 5, CURVE, str(tmp_path / "nothing"))


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements have equal hashes modulo a power of two, whatever the base."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " one two three four"
    rows = near_join.near_duplicates(spark.createDataFrame([(1, word + tail), (2, other + tail), (3, word + tail)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 1}


def test_a_long_text_is_read_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 400 if rng.random() < 0.02 else 9))) for _ in range(3000)) + " \t"
    whole = [s.tolist() for _, s in near_join.Shingles(5).of(pa.array([text, "x"]))]
    for piece in (64, 1000, 5000):
        monkeypatch.setattr(near_join, "PIECE", piece)
        assert [s.tolist() for _, s in near_join.Shingles(5).of(pa.array([text]))] == whole[:1]
        assert [s.tolist() for _, s in near_join.Shingles(5).of(pa.array(["z" * 9000]))][0]


# --- mix


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(out.values())
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix(cases, case_rows, nothing):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in case_rows:
        sizes[s] += n(t)
    goals = brute_targets(dict(sizes), **MIX)
    rows = mixing.mix(cases, **MIX).collect()
    assert sum(r.m for r in rows) == len(case_rows)
    assert ordered({(r.doc_id, r.size) for r in rows}) == ordered({(i, n(t)) for i, t, _ in case_rows})
    for s, size in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == size and abs(r.target - goals[s]) < 1e-6 for r in own)
        taken = sum(r.copies * r.size * r.m for r in own)
        assert abs(taken - goals[s]) <= max((r.size * r.m for r in own), default=0)
    assert all(0 <= r.copies <= 2 for r in rows)
    assert ordered(mixing.mix(cases.repartition(2), **MIX).collect()) == ordered(rows)
    assert mixing.mix(nothing, **MIX).collect() == []


def test_mix_through_a_tree(cases, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = mixing.mix(cases, **MIX).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size * r.m for r in own) - own[0].target) <= max(r.size * r.m for r in own)
    out = mixing.repeat_documents(cases, mixing.mix(cases, **MIX))
    assert out.columns == cases.columns
    assert out.count() == sum(r.copies * r.m for r in rows)


def test_mix_of_repeated_rows(spark, monkeypatch):
    """A third of all rows are one text, with an id or without; words miss the target by less than one row's."""
    rng = np.random.default_rng(14)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows = [(i, text(int(rng.integers(5, 30))), f"s{i % 3}") for i in range(90)]
    rows += [(None, "again " * 25, "s0")] * 31 + [(5, "five " * 20, "s1")] * 14 + [(6, "none " * 9, None)] * 5
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, tag long").repartition(5)
    monkeypatch.setattr(mixing, "DEALT", 4)
    for weights in ([5, 2, 1], [3, 4, 2]):
        mixed = mixing.mix(docs, weights, 0.9)
        got = mixed.collect()
        assert sum(r.m for r in got) == len(rows)
        assert ordered(mixing.mix(docs.repartition(2), weights, 0.9).collect()) == ordered(got)
        want = Counter()
        for s in {r.source for r in got}:
            own = [r for r in got if r.source == s]
            assert abs(sum(r.copies * r.size * r.m for r in own) - own[0].target) < max(r.size for r in own)
            for r in own:
                want[r.doc_id, r.source, r.size, r.copies] += r.m
        assert len({(r.doc_id, r.source, r.size) for r in got}) < len(got)  # some are taken unequally often
        out = Counter(r.tag for r in mixing.repeat_documents(docs, mixed).collect())
        assert +want == Counter((i, s, len(t.split()), out[k]) for k, (i, t, s) in enumerate(rows))


def test_pivot_keeps_expectations():
    rng = np.random.default_rng(2)
    size, p = [5.0, 1.0, 3.0, 2.0, 8.0], [0.3, 0.5, 0.9, 0.25, 0.6]
    total = np.zeros(5)
    for _ in range(20_000):
        out, held = mixing.pivot(size, p, rng.random(5).tolist())
        assert sum(0 < x < 1 for x in out) <= 1 and abs(np.dot(out, size) - np.dot(p, size)) < 1e-9
        total += out
    assert np.allclose(total / 20_000, p, atol=0.015)


# --- exact duplicates


def test_content_sort(spark, cases, case_rows, nothing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in case_rows:
        groups.setdefault(norm(t), []).append(i)
    for parts in ("8", "1", "61"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = content_sort.exact_duplicates(cases).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        want = []
        for i, t, _ in case_rows:
            g = groups[norm(t)]
            want.append((i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
        assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == ordered(want)
        kept = Counter(r.text_sha256 for r in rows if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert content_sort.exact_duplicates(nothing).collect() == []


def test_content_sort_cuts_evenly(spark):
    """Splitters are spread over the whole sample; rows without ids and with one beginning are sampled like others."""
    keys = spark.createDataFrame([(f"{k:04d}",) for k in range(1000)], "key string").repartition(3)
    cuts = [int(c) for c in content_sort.splitters(keys, 5)]
    assert len(cuts) == 4 and all(abs(c - 200 * (k + 1)) <= 1 for k, c in enumerate(cuts))
    alike = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "concat(repeat('same ', 10), id) as raw")
    assert 1500 < content_sort.sampled(alike, 10).count() < 2500


def test_content_sort_cuts_hot_groups(spark, monkeypatch):
    """Rows without id that share a text are cut into ranges, and so are texts whose beginnings are longer than a splitter."""
    start = "a beginning that many texts share " * 20
    texts = ["one text of a great many rows"] * 3000 + [f"{start}{k % 500:03d}" for k in range(1000)]
    docs = spark.createDataFrame([(None if k < 3000 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    saved = []
    monkeypatch.setattr(content_sort, "written", lambda df, name: saved.append(df.cache()) or saved[-1])
    rows = content_sort.exact_duplicates(docs).collect()
    assert Counter((r.keep_id, r.group_size) for r in rows) == Counter({(None, 3000): 3000, **{(3000 + k, 2): 2 for k in range(500)}})
    assert sum(r.kept for r in rows) == 501
    sizes = Counter(r.part for r in saved[0].collect())
    assert len(sizes) == 8 and max(sizes.values()) < 1000


# --- repeated strings




def test_repeated_strings(cases, case_rows, nothing):
    got = {}
    for r in suffixes.repeated_strings(cases).collect():
        got.setdefault((r.doc_id, r.n_bytes), set()).add((r.n_removed, r.n_spans, r.kept_sha256))
    assert sum(1 for _ in suffixes.repeated_strings(cases).collect()) == len(case_rows)
    ids = Counter(i for i, _ in {(i, t) for i, t, _ in case_rows})
    seen = set()
    for i, t in sorted({(i, t or "") for i, t, _ in case_rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 99):
            if (w := raw[k : k + 100]) in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want = (sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(left).hexdigest())
        if ids[i] == 1:  # texts that share an id have an order of their own
            assert got[i, len(raw)] == {want}, i
    assert suffixes.repeated_strings(nothing).collect() == []


def test_repeated_strings_of_texts_that_share_an_id(spark, monkeypatch):
    """Texts without ids, picked to agree in the low 18 bits of their hashes; all hold one line, at places of their own."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(13)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    line = word(90)
    made = spark.createDataFrame([(word(int(rng.integers(1, 200))) + line + word(int(rng.integers(1, 200))),) for _ in range(3000)], "text string")
    made = sorted((r.h, r.text) for r in made.select("text", F.xxhash64("text").alias("h")).collect())
    low = Counter(h % (1 << 18) for h, _ in made)
    rows = [(h, t) for h, t in made if low[h % (1 << 18)] > 1]
    assert len(rows) >= 8
    seen, want = set(), []
    for _, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 63):
            if t[k : k + 64] in seen:
                gone[k : k + 64] = b"\1" * 64
            seen.add(t[k : k + 64])
        want.append((len(t), sum(gone), hashlib.sha256(bytes(c for c, g in zip(t.encode(), gone, strict=True) if not g)).hexdigest()))
    docs = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string").repartition(3)
    for crowd in (suffixes.CROWD, 2):
        monkeypatch.setattr(suffixes, "CROWD", crowd)
        got = suffixes.repeated_strings(docs, 64).collect()
        assert ordered((r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == ordered(want)


def test_crowded_keys_pieces_and_text(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    line = word(70)
    rows = [(i, word(60) + line + word(60)) for i in range(12)] + [(20, word(5000) * 2 + line + word(40)), (21, line + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = ordered(suffixes.repeated_strings(docs, 64, with_text=True).collect())
    seen, want = set(), []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 63):
            if t[k : k + 64] in seen:
                gone[k : k + 64] = b"\1" * 64
            seen.add(t[k : k + 64])
        want.append((i, sum(gone), hashlib.sha256(bytes(c for c, g in zip(t.encode(), gone, strict=True) if not g)).hexdigest()))
    assert ordered((r[0], r[2], r[4]) for r in plain) == ordered(want)
    monkeypatch.setattr(suffixes, "CROWD", 2)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    monkeypatch.setattr(suffixes, "blocks", lambda texts: kernels.blocks(texts, 1))
    assert ordered(suffixes.repeated_strings(docs, 64, with_text=True).collect()) == plain


def test_suffix_sort_random_and_collisions(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 400)
    places, group = rng.integers(0, 300, 200), rng.integers(0, 3, 200)
    raw = data.tobytes()
    for broken in (False, True):
        sorter = suffixes.SuffixSort(data, 100)
        if broken:
            monkeypatch.setattr(sorter, "extension", lambda a, b: np.full(len(a), 7))
        order, cls = sorter.classes(places, group)
        keys = [(group[k], raw[places[k] : places[k] + 100]) for k in order]
        assert keys == sorted(keys)
        assert [a == b for a, b in zip(cls, cls[1:])] == [a == b for a, b in zip(keys, keys[1:])]  # noqa: B905


# --- near duplicates


def brute_components(rows):
    sets = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), NO_ID), NO_ID if i is None else i)
    name = lambda k: None if least[find(k)] == NO_ID else least[find(k)]
    return [(i, len(s), name(k)) for k, (i, s) in enumerate(sets)]


def test_near_duplicates(cases, case_rows, nothing):
    got = near_join.near_duplicates(cases).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute_components(case_rows))
    assert near_join.near_duplicates(nothing).collect() == []
    one = near_join.one_of_each(cases)
    assert one.columns == cases.columns
    kept = Counter(r.doc_id for r in one.collect() if r.doc_id is not None)
    want = {c for _, _, c in brute_components(case_rows) if c is not None}
    assert set(kept) == want and sum(kept.values()) == len(want) + 1  # id 7 has two texts


def test_chains_of_near_duplicates(spark):
    """Each document is near its neighbours only; a frequent passage is in all of them and in others."""
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows = [(i, " ".join(pool[3 * i : 3 * i + 100]), "") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(pool, 20)) + " " + " ".join(pool[:60]) + " " + " ".join(rng.choice(pool, 20)), "") for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = near_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute_components(rows))


def test_many_changed_copies_of_one_text(spark):
    """Copies with one to five changed words out of 150: most are near the text itself, few near each other."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(150)]
    rows = [(int(i), " ".join(words), "") for i in rng.integers(0, 120, 1)]
    for i in set(range(120)) - {rows[0][0]}:
        changed = list(words)
        for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
            changed[at] = f"x{i}y{at}"
        rows.append((i, " ".join(changed), ""))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = near_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute_components(rows))


def test_near_duplicates_that_share_ids(spark):
    """Pairs of near copies without any id; ids with two texts, of which one has a near copy under another id."""
    rng = np.random.default_rng(12)
    text = lambda: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(80)]
    near = lambda words: " ".join([*words[:-1], "changed"])
    pairs = [text() for _ in range(8)]
    rows = [(None, t, "") for words in pairs for t in (" ".join(words), near(words))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + rows[:5]], "doc_id long, text string").repartition(4)
    assert near_join.one_of_each(docs).count() == len(pairs)
    rows = [(k, " ".join(text()), "") for k in range(10)]
    for k in range(10):
        words = text()
        rows += [(k, " ".join(words), ""), (100 + k, near(words), "")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = near_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute_components(rows))


def test_parities_rule_out_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 300, 2500):
        for changed in (0, 1, n // 20, n // 8, n):
            for longer in (0, n // 4):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**64, changed + longer, dtype=np.uint64)]))
                apart = near_join.least_apart(near_join.parities(a), near_join.parities(b))
                assert apart == near_join.least_apart(near_join.parities(b), near_join.parities(a)) <= len(np.setxor1d(a, b))
                if n >= 300 and changed == n:  # sets without a common shingle are told apart
                    assert apart * 180 > (len(a) + len(b)) * 20


def test_texts_move_for_few_of_the_pairs(spark, monkeypatch):
    """Texts that share a passage and no link are many pairs; their texts don't go through a join, and no step's shuffle files stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, f"{passage} {' '.join(word() for _ in range(60))}") for i in range(60)]
    rows += [(100 + i, f"{t} end") for i, t in rows[:3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    steps, held = {}, near_join.written
    monkeypatch.setattr(near_join, "written", lambda df, name: steps.setdefault(name, []).append(out := held(df, name)) or out)
    # all shingles are as rare as any other, so that the passage's stay in the prefixes
    monkeypatch.setattr(near_join, "_ranks", lambda sets: np.zeros(1 << near_join.SKETCH, np.uint8))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", disk.getAllFiles().mkString(" ")))
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(key)
    out = near_join.near_duplicates(docs)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(key) == was
    moved = sum(p.count() for p in steps["close-pairs"])
    assert sum(p.count() for p in steps["pairs"]) > 300 and 3 <= moved < 20
    got = out.select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute_components([(i, t, "") for i, t in rows]))


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 160)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    parent = {x: x for p in pairs for x in p if None not in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- pipeline


def test_pipeline(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_small).cache()
        assert after.columns == columns, name
        if name == "near_duplicates":
            want = {c for _, _, c in brute_components([(r.doc_id, r.text, None) for r in docs.select("doc_id", "text").collect()])}
            assert {r.doc_id for r in after.select("doc_id").collect()} == want and after.count() == len(want)
        counts.append(after.count())
        docs = after
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    out = corpus_pipeline.run(spark, sf_small).collect()
    assert len(out) == counts[-1] and [n for n, _ in corpus_pipeline.STAGES][-1] == "sharding"
