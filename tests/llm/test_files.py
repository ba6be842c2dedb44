"""Operators that write files and read them back: token frames and WARC archives."""

import base64
import glob
import hashlib
import io
import zlib

import numpy as np
import pytest
import zstandard

from hybridrank.llm import token_frames, warc
from hybridrank.llm.common import shared_folder
from hybridrank.llm.queries import _tokenizer

TOKENIZER = _tokenizer("word_bpe_49k.json")


def ids_of(texts, end=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_tokens_round_trip(cases, case_rows, nothing):
    rows = sorted(case_rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, at = [], 0
    for (i, _, _), ids in zip(rows, ids_of(t for _, t, _ in rows), strict=True):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in token_frames.token_files(cases, TOKENIZER, 2).collect()), key=lambda r: r[1])
    assert got == want
    assert token_frames.token_files(nothing, TOKENIZER, 2).collect() == []


def test_frames_split_roll_and_check(spark, cases, monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_IDS", 1000)
    folder = shared_folder(spark, "frames")
    manifest = token_frames.write_tokens(cases.repartition(1), folder, TOKENIZER, 2, file_bytes=20_000)
    files = manifest.collect()
    assert sum(f.documents for f in files) == cases.count()
    for f in files:
        reader = token_frames.FrameReader(f.path)
        ids = [reader.ids(k) for k in range(len(reader.index))]
        assert sum(map(len, ids)) == f.units
        raw = open(f.path.removeprefix("file:"), "rb").read()
        assert len(raw) == f.bytes
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert plain == b"".join(x.tobytes() for x in ids)  # any zstandard tool reads it
    assert token_frames.read_tokens(manifest).count() == cases.count()
    reader.checks[0] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        reader.ids(0)


def test_words_encode_like_texts():
    encoder = token_frames.WordEncoder(TOKENIZER)
    import pyarrow as pa

    texts = ["don't. 'twas a.'s '.x ’s b É.x x≠ ΣΑΣ ΑΣ. 3.14 a_b", "", "  ", "a\x1fb c\x85d 日本。語.x", "A<|endoftext|>b", "<|ENDOFTEXT|> İ", "é É", "1'2 o'clock's $5.00%", " x y"]
    for got, want in zip(encoder.encode(pa.array(texts)), ids_of(texts), strict=True):
        assert got.tolist() == want[:-1].tolist()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}", f"<html>{i % 7} page é " + "text " * (i % 5) * 20 + "</html>") for i in range(60)]
    rows += [(100, "u", None), (101, None, ""), (102, "a b\r\nc", "x"), (103, "u", "\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nWARC/1.1"), (None, "n", "x"), (None, "n", "only without id"), (5, "again", rows[5][2]), (104, "long", "y" * 3_000_000)]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, payload_digest string, n int").repartition(3)


@pytest.mark.parametrize("least", [0, 100])
def test_archives_round_trip(pages, least):
    largest = {}
    for r in pages.collect():
        if r.page_id is not None:
            largest[r.html or ""] = max(largest.get(r.html or "", -1), r.page_id)
    want = []
    for r in pages.collect():
        raw, keep = (r.html or "").encode(), largest.get(r.html or "")
        revisit = len(raw) >= least and r.page_id != keep
        want.append((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    got = [tuple(r) for r in warc.archives(pages, least).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_archives_of_nothing_and_dictionary(spark, pages, sf_small):
    assert warc.archives(pages.limit(0)).collect() == []
    folder = shared_folder(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_small}/../sf0.01/pages.parquet").coalesce(1), folder)
    heads = [open(f, "rb").read(8) for f in glob.glob(folder.removeprefix("file:") + "/*.warc.zst")]
    assert heads and any(int.from_bytes(h[:4], "little") == warc.SKIPPABLE_DICTIONARY for h in heads)
