"""Token ids in files of independent zstandard frames with a seek table.

A file is a row of zstandard frames, one or more for each document, each the little-endian unsigned
32-bit ids of that document (or of a piece of it); then a skippable frame that says which document has
which frames; last the seek table of zstandard's seekable format: compressed size, decompressed size and
checksum of each frame. A reader takes the end of the file, looks the document up and decompresses that
document's frames only. Any zstandard tool can decompress a whole file.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_folder, text_or_empty, written
from .files import MANIFEST, Manifest, create, dealt, opened, slices
from .kernels import blocks, is_word_byte, lower_table

# Fixed values of the zstandard formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Bytes of a special token's beginning and of combining marks.
AS_THEY_ARE = (b"<|", b"\xcc", b"\xcd")

#: Ids in a frame at most; compressed bytes after which a new file begins; words a worker remembers, and encodes in one call.
FRAME_IDS, FILE_BYTES, MEMORY_WORDS, JOINED = 1 << 22, 128 << 20, 1 << 20, 512


def _kept(key, make):
    """What a worker process keeps from task to task (functions here are shipped by value, so a module
    global would not last)."""
    store = sys.modules.setdefault("_hybridrank_llm_kept", types.ModuleType("_hybridrank_llm_kept"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]


class Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _letters_and_marks() -> tuple[np.ndarray, np.ndarray]:
    """ASCII letters and digits; other visible ASCII characters but the apostrophe."""
    letters, marks = np.zeros(256, bool), np.zeros(256, bool)
    letters[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    marks[0x21:0x7F] = ~letters[0x21:0x7F]
    marks[ord("'")] = False
    return letters, marks


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` in an array of at least ``size`` places, which at least doubles when it grows."""
    return values if size <= len(values) else np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)])


class WordEncoder:
    """A tokenizer applied word by word, each distinct word once.

    For tokenizers that drop white space, never join characters across it, never join an ASCII letter
    or digit with an ASCII mark other than the apostrophe, and lower-case: encoding a text is encoding
    the pieces between such places one after the other. A-Z are lower-cased first, so that pieces that
    differ in case are one. Texts that could hold a special token or combining marks go to the
    tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark = next((t for t in special if t.encode().startswith(AS_THEY_ARE[0])), None)
        self.letters, self.marks = _letters_and_marks()
        self.inside, self.lower = is_word_byte(), lower_table()
        self.forget()

    def forget(self) -> None:
        self.at = Numbered()
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if self.mark is not None:  # many words at once, told apart by a special token that no word holds
            words = [self.mark.join(words[k : k + JOINED]) + self.mark for k in range(0, len(words), JOINED)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        if self.mark is not None:
            marks = flat == self.tokenizer.token_to_id(self.mark)
            flat, length = flat[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1
        return flat, length

    def learn(self, words: list[bytes], first: int) -> None:
        """The ids of new words, which are numbered from ``first`` on."""
        flat, length = self._each([w.decode("utf-8") for w in words])
        total, last = len(flat), first + len(words)
        self.ids, self.start, self.length = _room(self.ids, self.n_ids + total), _room(self.start, last), _room(self.length, last)
        self.start[first:last] = self.n_ids + np.cumsum(length) - length
        self.length[first:last] = length
        self.ids[self.n_ids : self.n_ids + total] = flat
        self.n_ids += total

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block in a row, and where each text's ids end."""
        if len(self.at) > MEMORY_WORDS:
            self.forget()
        inside, letter, mark = self.inside[data], self.letters[data], self.marks[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = inside[first]  # texts begin a word too
        begins = np.flatnonzero(begins)
        kept = self.lower[data[inside]]
        at = np.append(np.cumsum(inside)[begins] - 1, len(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
        known, different = len(self.at), words.dictionary.to_pylist()
        number = np.fromiter(map(self.at.__getitem__, different), np.int64, len(different))
        if len(self.at) > known:
            self.learn(list(islice(reversed(self.at), len(self.at) - known))[::-1], known)
        number = number[words.indices.to_numpy()]
        length = self.length[number]
        ends = np.cumsum(length)
        take = np.repeat(self.start[number] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[take], np.concatenate([[0], ends])[np.searchsorted(begins, offsets[1:])]

    def encode(self, texts: pa.Array):
        """The ids of each text."""
        for row, data, offsets in blocks(texts):
            raw = data.tobytes()
            if any(m in raw for m in AS_THEY_ARE):
                for k in range(len(offsets) - 1):
                    own = raw[offsets[k] : offsets[k + 1]]
                    if any(m in own for m in AS_THEY_ARE):
                        yield np.array(self.tokenizer.encode(own.decode("utf-8"), add_special_tokens=False).ids, np.uint32)
                    else:
                        yield self._block(data[offsets[k] : offsets[k + 1]], np.array([0, len(own)]))[0]
                continue
            ids, ends = self._block(data, offsets)
            yield from np.split(ids, ends[:-1])


class FrameWriter:
    """One file of frames."""

    def __init__(self, folder: str, level: int) -> None:
        import xxhash
        import zstandard

        self.uri, self.out = create(folder, ".ids.zst")
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.checksum = xxhash.xxh64_intdigest
        self.table, self.index, self.size, self.n_ids = [], [], 0, 0

    def _put(self, frame: bytes, content: int, check: int) -> None:
        self.out.write(frame)
        self.table.append((len(frame), content, check))
        self.size += len(frame)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        pieces = range(0, max(len(ids), 1), FRAME_IDS)
        for at in pieces:
            raw = ids[at : at + FRAME_IDS].astype("<u4").tobytes()
            self._put(self.compress(raw), len(raw), self.checksum(raw) & 0xFFFFFFFF)
        self.index.append((doc_id or 0, doc_id is None, len(pieces)))
        self.n_ids += len(ids)

    def close(self) -> int:
        index = b"".join(struct.pack("<q?I", *x) for x in self.index)
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index, 0, self.checksum(b"") & 0xFFFFFFFF)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)
        self.out.close()
        return self.size + 8 + len(table)


class FrameReader:
    """Documents of one file by number; only their frames are read and decompressed."""

    def __init__(self, uri: str) -> None:
        import xxhash
        import zstandard

        self.file, self.checksum = opened(uri), xxhash.xxh64_intdigest
        self.decompress = zstandard.ZstdDecompressor().decompress
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_FOOTER or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{uri} doesn't end in a seek table with checksums")
        table = np.frombuffer(self._read(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        self.sizes, self.contents, self.checks = (table[:, k].astype(np.int64) for k in range(3))
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = self._read(int(self.starts[-1]) + 8, int(self.sizes[-1]) - 8)
        self.index = [(None if none else i, n) for i, none, n in struct.iter_unpack("<q?I", raw)]
        self.first = np.cumsum([0, *(n for _, n in self.index)])

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's document ``k``."""
        out = []
        for f in range(self.first[k], self.first[k + 1]):
            raw = self.decompress(self._read(int(self.starts[f]), int(self.sizes[f])), max_output_size=int(self.contents[f]))
            if self.checksum(raw) & 0xFFFFFFFF != self.checks[f]:
                raise ValueError(f"frame {f} doesn't match its checksum")
            out.append(np.frombuffer(raw, "<u4"))
        return np.concatenate(out)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids by ascending id; the files' manifest.

    ``tokenizer`` is the path of a tokenizers file that every worker can open. A null text counts as
    empty (the end id alone), null ids come first, rows that share an id follow each other by checksum
    of the text, and rows alike in both keep all their copies. An empty table gives no files. Other
    columns are not read. A text longer than ``FRAME_IDS`` ids takes several frames.

    Texts move once, to ranges of ids; a task streams its range into files of about ``file_bytes``.
    """
    spark = docs.sparkSession

    def write(batches):
        encoder = _kept(("words", tokenizer), lambda: WordEncoder(tokenizer))
        manifest, out = Manifest(), None
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                out = out or FrameWriter(folder, level)
                out.add(doc_id, np.append(ids, np.uint32(end_id)))
                if out.size >= file_bytes:
                    manifest.add(out.uri, len(out.index), out.n_ids, out.close())
                    out = None
        if out:
            manifest.add(out.uri, len(out.index), out.n_ids, out.close())
        yield manifest.batch()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = ["doc_id", F.crc32(F.col("text").cast("binary"))]
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``, all from the files.

    ``start`` counts the ids of all documents before it, over all files.
    """

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader, rows = FrameReader(path), []
                for k, (doc_id, _) in enumerate(reader.index):
                    ids = reader.ids(k)
                    rows.append((doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("units").over(earlier), F.lit(0)))
    return dealt(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`write_tokens` to a new folder of the shared one, then :func:`read_tokens`."""
    return read_tokens(write_tokens(docs, shared_folder(docs.sparkSession, "tokens"), tokenizer, end_id, id_col, text_col))
