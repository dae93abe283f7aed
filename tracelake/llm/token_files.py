"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file is the content of one row of a table (shard, content), so that Spark's commit
protocol covers it; the dictionary is a table of one row beside it.  Its layout, all numbers little-endian:

    "TIDS", u16 version, u16 bytes of an id, 32 bytes SHA-256 of the dictionary,
    frames, each one document's ids as one zstandard frame,
    index: i64 doc_id[n], u8 has_id[n], u64 frame_end[n], u64 ids_before[n + 1],
    u64 n, u64 place of the index, "SDIT"

A document is read through the index without its neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.kernels import _powers, blocks, mix
from tracelake.llm.shared import shared_folder, stored

END_ID = 1
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 2000, 8000
CHARS_PER_FILE = 8_000_000
CACHE_KINDS = 600_000
LEVEL = 3
_MARK = "<|startoftext|>"
_HEAD, _TAIL = struct.Struct("<4sHH32s"), struct.Struct("<QQ4s")
_U = np.uint64

#: Code points below _LATIN by what the pretokenizer sees in them; words with other code points go to the library whole.
_LATIN = 0x250
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _kind(c: int) -> int:
    sign = chr(c)
    if sign in " \t\n\v\f\r":
        return _SPACE
    if c < 33 or 0x7F <= c <= 0xA0 or sign in "'<" or len(sign.lower()) > 1 or ord(sign.lower()) >= _LATIN:
        return _ODD
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(sign)[0], _SIGN)


_KIND = np.array([*(_kind(c) for c in range(_LATIN)), _ODD], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if _KIND[c] != _ODD else c for c in range(_LATIN)], np.uint32)


def pretokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First place, end, hash and oddness of each pretoken of a text's code points.

    Runs of letters, single digits and runs of other signs, all lower-cased; a word
    with an odd sign (apostrophes start contractions, < a special token) is one pretoken as it is.
    """
    kind = _KIND[np.minimum(codes, _LATIN)]
    inside = kind != _SPACE
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    word = np.cumsum(opens) - 1
    odd_words = np.zeros(int(word[-1]) + 1 if len(word) else 0, bool)
    odd_words[word[kind == _ODD]] = True
    odd = odd_words[word] & inside if len(odd_words) else inside
    start = opens.copy()
    start[1:] |= inside[1:] & ~odd[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    low = np.where(odd, codes, _LOWER[np.minimum(codes, _LATIN - 1)])
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(low.astype(np.uint64) + _U(1)) * up[: len(codes)], out=sums[1:])
    return a, b, mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _U(2) + odd[a]), odd[a]


class WordEncoder:
    """Ids of a `tokenizers` file, remembered by pretoken.

    Pretokens of many texts are found and hashed at once; each kind goes through the
    library's model once, and the texts' ids are gathered from one array.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.mark = self.tokenizer.token_to_id(_MARK)
        self.forget()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_sign = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}  # as byte-level vocabularies write bytes
        probe = ["the", "über", "ção", "naïveté", "zzxqj", "straße", "7", "½", ".", "!!)", "§§", "$$$"]
        self.direct = all(self._model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.ends = array(self.type.char), array("q", [0])

    def _model(self, pretoken: str) -> list[int]:
        """Ids of a lower-case pretoken straight from the library's model, as normalising and splitting would leave it whole."""
        return [t.id for t in self.tokenizer.model.tokenize(pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(self.byte_sign))]

    def _library(self, parts: list[str]) -> Iterator[list[int]]:
        """Ids of parts from the library, many in one call with a sign between them."""
        at = 0
        while at < len(parts):
            group = [] if self.mark is None else list(takewhile(lambda w: "<|" not in w and "|>" not in w, parts[at : at + 200]))
            if not group:
                yield self.tokenizer.encode(parts[at], add_special_tokens=False).ids
                at += 1
                continue
            ids = np.array(self.tokenizer.encode(_MARK.join(group), add_special_tokens=False).ids)
            yield from (x[x != self.mark].tolist() for x in np.split(ids, np.flatnonzero(ids == self.mark)))
            at += len(group)

    def _learn(self, hashes: list[int], parts: list[str], odd: list[bool]) -> None:
        direct = [self.direct and not o for o in odd]
        rest = self._library([p for p, d in zip(parts, direct, strict=True) if not d])
        for h, part, d in zip(hashes, parts, direct, strict=True):
            self.slot[h] = len(self.ends) - 1
            self.ids.extend(self._model(part.lower()) if d else next(rest))
            self.ends.append(len(self.ids))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's with END_ID behind them, and their offsets."""
        if len(self.slot) > CACHE_KINDS:
            self.forget()
        flat = "\n".join([t or "" for t in texts])
        first, end, h, odd = pretokens(np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32))
        kinds, at, back = np.unique(h, return_index=True, return_inverse=True)
        names = kinds.tolist()
        new = [k for k, name in enumerate(names) if name not in self.slot]
        if new:
            self._learn([names[k] for k in new], [flat[a:b] for a, b in zip(first[at[new]].tolist(), end[at[new]].tolist(), strict=True)], odd[at[new]].tolist())
        slot = np.array([self.slot[name] for name in names], np.int64)
        ends = np.frombuffer(self.ends, np.int64)
        size = np.diff(ends)[slot][back]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(self.ids, self.type)[np.arange(total[-1]) + np.repeat(ends[slot][back] - total[:-1], size)] if len(size) else np.zeros(0, self.type)
        text_ends = np.cumsum([len(t or "") + 1 for t in texts])
        offsets = np.concatenate([[0], total[np.searchsorted(first, text_ends)]])
        return np.insert(ids, offsets[1:], END_ID), offsets + np.arange(len(offsets))

    def encode_each(self, texts: list[str | None]) -> list[bytes]:
        ids, offsets = self.encode(texts)
        raw, offsets = ids.tobytes(), (offsets * self.type.itemsize).tolist()
        return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@lru_cache(maxsize=2)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    more = {"dict_data": shared} if shared else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **more), zstandard.ZstdDecompressor(**more)


def train_dictionary(docs: DataFrame, tokenizer_file: str) -> bytes:
    """Dictionary from the SAMPLE_DOCUMENTS texts of up to SAMPLE_CHARS characters whose ids have the smallest hashes.

    Hashes are chosen first, so that only the chosen texts reach the driver.  Empty where
    they are too few to train on; the files are read back the same either way.
    """
    import zstandard

    rows = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.struct(F.xxhash64("doc_id"), F.xxhash64("text")).alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return b""
    chosen = rows.where(F.col("h") <= F.struct(*(F.lit(x) for x in last))).dropDuplicates(["h"]).collect()  # SAMPLE_DOCUMENTS rows at most
    samples = word_encoder(tokenizer_file).encode_each([r["text"] for r in sorted(chosen, key=lambda r: r["h"])])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def compress_documents(docs: DataFrame, tokenizer_file: str, dictionary: bytes) -> DataFrame:
    """(doc_id, n_tokens, frame) of each text with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        size = encoder.type.itemsize
        pack = _codec(dictionary)[0].compress
        for whole in batches:
            length = np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0))
            for a, b in blocks(np.concatenate([[0], np.cumsum(length)])):
                batch = whole.slice(a, b - a)
                raw = encoder.encode_each(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(r) // size for r in raw], pa.int64()), pa.array([pack(r) for r in raw], pa.binary())], ["doc_id", "n_tokens", "frame"])
        encoder.forget()  # workers live on for other stages

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def file_bytes(doc_ids: list[int | None], n_tokens: list[int], frames: list[bytes], width: int, dictionary: bytes) -> bytes:
    """One file of documents in the given order."""
    ends = _HEAD.size + np.cumsum([len(f) for f in frames]).astype("<u8")
    before = np.concatenate([[0], np.cumsum(n_tokens)]).astype("<u8")
    has = np.array([i is not None for i in doc_ids], np.uint8)
    ids = np.array([i or 0 for i in doc_ids], "<i8")
    place = int(ends[-1]) if len(frames) else _HEAD.size
    head = _HEAD.pack(b"TIDS", 1, width, hashlib.sha256(dictionary).digest())
    return b"".join([head, *frames, ids.tobytes(), has.tobytes(), ends.tobytes(), before.tobytes(), _TAIL.pack(len(frames), place, b"SDIT")])


class TokenFile:
    """Reader of one file; `ids(k)` decompresses the k-th document alone."""

    def __init__(self, content: bytes, dictionary: bytes):
        magic, version, width, digest = _HEAD.unpack_from(content)
        n, place, end = _TAIL.unpack_from(content, len(content) - _TAIL.size)
        if magic != b"TIDS" or end != b"SDIT" or version != 1:
            raise ValueError("not a token-id file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.content, self.kind, self.n = content, np.dtype(f"<u{width}"), n
        ids = np.frombuffer(content, "<i8", n, place)
        has = np.frombuffer(content, np.uint8, n, place + 8 * n)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has, strict=True)]
        self.ends = np.concatenate([[_HEAD.size], np.frombuffer(content, "<u8", n, place + 9 * n)]).astype(np.int64)
        self.before = np.frombuffer(content, "<u8", n + 1, place + 17 * n).astype(np.int64)
        self.unpack = _codec(dictionary)[1].decompress

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.unpack(self.content[self.ends[k] : self.ends[k + 1]]), self.kind)


def write_files(docs: DataFrame, tokenizer_file: str, dictionary: bytes, chars_per_file: int = CHARS_PER_FILE, path: str | None = None) -> DataFrame:
    """(shard, n_tokens, content): files in ascending doc_id order, shard by shard, null ids first.

    Rows of one id are ordered by length and dealt over files like others.  With `path`,
    the table of files is written to path/files and the dictionary beside it, to
    path/dictionary, where `open_files` finds both.
    """
    width, spark = word_encoder(tokenizer_file).type.itemsize, docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()["c"]
    frames = stored(compress_documents(docs, tokenizer_file, dictionary), "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, packed = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            n += batch.column("n_tokens").to_pylist()
            packed += batch.column("frame").to_pylist()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sum(n)], pa.int64()), pa.array([file_bytes(ids, n, packed, width, dictionary)], pa.binary())], ["shard", "n_tokens", "content"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("row")]
    dealt = frames.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-chars // chars_per_file)), *order)
    files = dealt.sortWithinPartitions(*order).mapInArrow(run, "shard int, n_tokens long, content binary")
    if path is None:
        return stored(files, "token-files")
    files.write.parquet(f"{path}/files")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return open_files(spark, path)[0]


def open_files(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The table of files that `write_files` put at a path, and their dictionary."""
    return spark.read.parquet(f"{path}/files"), bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read_files(files: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, shard, before, n_tokens, ids_crc32) of each document of files, read from their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                file = TokenFile(content.as_py(), dictionary)
                crc = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(file.n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array([shard] * file.n, pa.int32()), pa.array(file.before[:-1]), pa.array(np.diff(file.before)), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "before", "n_tokens", "ids_crc32"],
                )

    return files.select("shard", "content").mapInArrow(run, "doc_id long, shard int, before long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of docs (doc_id, text), written to files and read back.

    Null and empty texts hold the end id alone.  Rows with equal ids stand side by side,
    shorter first, and each has its own start; null ids come first.  Other columns are
    ignored, an empty table gives no rows.
    """
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_files(docs, tokenizer_file, train_dictionary(docs, tokenizer_file), path=path)
    files, dictionary = open_files(docs.sparkSession, path)
    # one row for each file of CHARS_PER_FILE characters
    starts = files.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("first"))
    each = read_files(files, dictionary)
    return each.join(starts, "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
