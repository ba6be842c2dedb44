import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, copies int, doc long, place long, key string, shard int, id long, n long, source_size long"
EXTRA = [7, True, 0.5, 3, 9, 11, "k", 2, 5, 6, 8]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def case_rows():
    """Documents with nulls, empty, short and very long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(5)
    passage, line = sentence(rng, 40), sentence(rng, 14)
    base = sentence(rng, 120)
    words = base.split()
    rows = [(i, sentence(rng, rng.randint(1, 150)), f"src{i % 3}") for i in range(40)]
    rows += [(100 + i, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}", "src0") for i in range(8)]
    rows += [(200 + i, f"{line}\n{sentence(rng, 25)}\n{line}", "src0") for i in range(8)]
    rows += [(300 + i, " ".join(words[: 10 + i] + ["edit%d" % i] + words[11 + i :]), "src1") for i in range(12)]
    rows += [(400 + i, base, "src0") for i in range(15)] + [(450, base.replace(" ", "\t \n"), "src2")]
    rows += [(500, "", "src0"), (501, None, "src1"), (502, " \t\n ", None), (503, "Naïve “ÉTÉ” 日本語 don't 3.14 <|endoftext|> İI", "é"), (504, "one two", "src1"), (505, "One TWO", "src1"), (506, "x" * 300, "src1")]
    rows += [(507, sentence(rng, 30000), "src2"), (508, "ab " * 20000, "src2")]
    rows += [(None, "no id " + sentence(rng, 40), "src1"), (None, None, None), (None, base, "src1")]
    rows += [rows[3], rows[3], (7, "another text of id seven " + sentence(rng, 30), "src0")]
    return rows


def frame(spark, rows):
    full = [(i, t, "en" if i is None or i % 2 else None, s, None if t is None else len(t), *EXTRA) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def cases(spark, case_rows):
    return frame(spark, case_rows).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def benchmark(spark, case_rows):
    texts = {i: t for i, t, _ in case_rows if i is not None}
    w = texts[100].split()
    items = [(1, " ".join(w[30:60])), (2, " ".join(w[40:53]).upper()), (3, "one, two"), (4, ""), (5, None), (None, " ".join(texts[20].split()[:20])), (6, "one, two"), (7, "absent words only here " * 4)]
    return spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double").withColumn("n_words", F.lit(1))
