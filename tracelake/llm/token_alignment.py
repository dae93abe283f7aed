"""Alignment of two tokenizers over the same text, by byte ranges.

Both token lists of a document are flattened with the index of their document; byte
lengths, summed within each document, give every token's end; a hash join on
(document, end) finds the places where both end.  Between two of these lies a group.
All ends in order cut the text into stretches of one token of either side: the links.
How many documents hold an id pair linked is counted in each task and summed by Spark.

A: byte-level BPE over a space and the text; B: pieces over the text, which add that space.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.kernels import _powers, mix
from tracelake.llm.piece_codec import piece_table
from tracelake.llm.shared import stored

BLOCK_CHARS = 1 << 20
CACHE_UNITS = 600_000
PARTIAL_PAIRS = 1 << 20
PAIRS_PER_ROW = 1 << 14
#: Pairs that are sent to all tasks: the most frequent ones, so many at most.
MOST_COMMON = 1 << 19

_U = np.uint64
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: A space that starts a token on both sides: it follows no space sign and precedes no white space.
_CUT = re.compile(r"(?<![ ▁]) (?=\S)")
_PER_DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "count_pairs": pa.list_(pa.int64()), "count_docs": pa.list_(pa.int64())}
_PER_DOC_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>, count_pairs array<long>, count_docs array<long>"


class ByteUnits:
    """Ids of a byte-level BPE file for texts that begin with a space, remembered by unit.

    A unit starts at a space before anything but white space, where the
    pretokenizer always begins a new token, whatever stands before; so each kind of unit is encoded once.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.n = self.tokenizer.get_vocab_size()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}  # as byte-level vocabularies write bytes
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.n)]
        self.token_bytes = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        self.size = np.array([len(t) for t in self.token_bytes])
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def _learn(self, names: list[int], units: list[str]) -> None:
        """Encode units end to end, in one call, and cut the ids where the units end."""
        ids = np.array(self.tokenizer.encode("".join(units), add_special_tokens=False).ids, np.int64)
        ends = np.cumsum(self.size[ids])
        at = np.searchsorted(ends, np.cumsum([len(u.encode("utf-8", "replace")) for u in units]), "left") + 1
        self.slot.update(zip(names, range(len(self.ends) - 1, len(self.ends) - 1 + len(names)), strict=True))
        self.ends.frombytes((len(self.ids) + at).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text, end to end, and their offsets; empty texts have none."""
        if len(self.slot) > CACHE_UNITS:
            self.forget()
        full = [" " + t for t in texts if t]
        flat = "".join(full)
        codes = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
        begin = np.cumsum([0, *map(len, full)])
        opens = np.zeros(len(codes), bool)
        opens[:-1] = (codes[:-1] == 32) & ~_WHITE[np.minimum(codes[1:], 0x3001)]
        opens[begin[1:-1] - 1] = False  # the last sign of a text has nothing of it behind
        opens[begin[:-1]] = True
        first = np.flatnonzero(opens)
        length = np.diff(np.append(first, len(codes)))
        up, down = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * up[: len(codes)], out=sums[1:])
        kinds, at, back = np.unique(mix((sums[first + length] - sums[first]) * down[first] + length.astype(np.uint64)), return_index=True, return_inverse=True)
        names = kinds.tolist()
        new = [k for k, name in enumerate(names) if name not in self.slot]
        units = [flat[a : a + n] for a, n in zip(first[at[new]].tolist(), length[at[new]].tolist(), strict=True)] if new else []
        if new:
            self._learn([names[k] for k in new], units)
        slot = np.array([self.slot[name] for name in names], np.int64)[back]
        ends = np.frombuffer(self.ends, np.int64)
        size = np.diff(ends)[slot] if len(slot) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(self.ids, np.int32)[np.arange(total[-1]) + np.repeat(ends[slot] - total[:-1], size)] if len(slot) else np.zeros(0, np.int32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        has = np.flatnonzero([bool(t) for t in texts])
        offsets[has + 1] = np.diff(total[np.searchsorted(first, begin)]) if len(has) else 0
        return ids, np.cumsum(offsets)


class Side:
    """Encoder of one side with the bytes, byte lengths and decimals of its ids."""

    def __init__(self, encoder, token_bytes: list[bytes]):
        self.encode, self.forget = encoder.encode, encoder.forget
        self.bytes = pa.array(token_bytes, pa.large_binary())
        self.size = pc.binary_length(self.bytes)
        self.decimal = pa.array([str(i) for i in range(len(token_bytes))], pa.large_string())

    def lists(self, texts: list[str]) -> pa.LargeListArray:
        ids, offsets = self.encode(texts)
        return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32()))

    def text(self, lists: pa.LargeListArray) -> pa.Array:
        """The joined bytes of each list."""
        return pc.binary_join(_regrouped(pc.take(self.bytes, pc.list_flatten(lists)), lists.offsets), pa.scalar(b"", pa.large_binary()))

    def ends(self, lists: pa.LargeListArray, name: str) -> pa.Table:
        """(doc, end, place): where each token ends in its document, in bytes."""
        flat = pc.list_flatten(lists)
        doc = pc.list_parent_indices(lists).cast(pa.int64())
        total = pc.cumulative_sum(pc.take(self.size, flat).cast(pa.int64()))
        starts = lists.offsets.slice(0, len(lists))
        before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), starts)
        return pa.table({"doc": doc, "end": pc.subtract(total, pc.take(before, doc)), name: pa.array(np.arange(len(flat)))})


def _regrouped(values: pa.Array, offsets) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


@lru_cache(maxsize=2)
def sides(byte_file: str, piece_file: str) -> tuple[Side, Side]:
    a, b = ByteUnits(byte_file), piece_table(piece_file)
    piece = [b.piece_bytes[b.piece_at[i] : b.piece_at[i + 1]].tobytes() for i in range(b.n)]
    return Side(a, a.token_bytes), Side(b, piece)


def aligned(texts: list[str], a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Table]:
    """For each text whether its tokens' bytes are a space and it, its four counts, its groups as text; and (doc, pair, times)."""
    la, lb = a.lists(texts), b.lists(texts)
    want = pa.array([b" " + t.encode("utf-8", "replace") if t else b"" for t in texts], pa.large_binary())
    good = pc.and_(pc.equal(a.text(la), want), pc.equal(b.text(lb), want))
    if not pc.all(good).as_py():
        la, lb = (pc.if_else(good, x, pa.scalar([], x.type)) for x in (la, lb))
        la, lb = (_regrouped(pc.list_flatten(x), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(x)))])) for x in (la, lb))
    both = a.ends(la, "a").join(b.ends(lb, "b"), ["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
    before = np.asarray(pc.binary_length(want)).cumsum() - np.asarray(pc.binary_length(want))
    both = both.take(np.argsort(before[np.asarray(both["doc"])] + np.asarray(both["end"])))
    shared = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    groups = both.filter(shared)
    doc = np.asarray(both["doc"])
    group_doc = np.asarray(groups["doc"])
    places = np.arange(len(texts) + 1)
    group_at = np.searchsorted(group_doc, places)
    side_text = [
        pc.binary_join(_regrouped(pc.take(side.decimal, pc.list_flatten(lists)), np.concatenate([[0], np.asarray(groups[name]) + 1])), pa.scalar(",", pa.large_string())) for side, lists, name in ((a, la, "a"), (b, lb, "b"))
    ]
    text = pc.binary_join(_regrouped(pc.binary_join_element_wise(*side_text, pa.scalar("|", pa.large_string())), group_at), pa.scalar(";", pa.large_string()))
    ids = [pc.take(pc.list_flatten(lists), pc.fill_null_backward(both[name].combine_chunks())).cast(pa.int64()) for lists, name in ((la, "a"), (lb, "b"))]
    links = pa.table({"doc": both["doc"], "pair": pc.add(pc.multiply(ids[0], len(b.bytes)), ids[1])})
    pairs = links.group_by(["doc", "pair"], use_threads=False).aggregate([("pair", "count")]).rename_columns(["doc", "pair", "times"])
    pairs = pairs.take(np.argsort(np.asarray(pairs["doc"]), kind="stable"))
    counts = np.stack([np.asarray(pc.list_value_length(la)), np.asarray(pc.list_value_length(lb)), np.diff(group_at), np.diff(np.searchsorted(doc, places))], 1)
    return np.asarray(good), counts, text, pairs


def pieces_of(text: str, most: int = BLOCK_CHARS) -> list[str]:
    """A text in parts of about `most` characters that are encoded alike apart, without the spaces between them."""
    out, at = [], 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def _blocks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _whole(text: str, a: Side, b: Side, most: int) -> tuple[np.ndarray, str, pa.Table]:
    """Counts, digest and pairs of one long text, part after part."""
    counts, digest, tables, first = np.zeros(4, np.int64), hashlib.sha256(), [], True
    for part in pieces_of(text, most):
        good, own, groups, pairs = aligned([part], a, b)
        if not part:
            continue
        if not good[0]:
            return np.zeros(4, np.int64), "", pairs.slice(0, 0)
        digest.update(("" if first else ";").encode() + groups[0].as_py().encode())
        counts, first = counts + own[0], False
        tables.append(pairs)
        if len(tables) > 8:
            tables = [_summed(tables)]
    return counts, digest.hexdigest(), _summed(tables)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "pair", "times"])


class PairCounts:
    """Documents of each pair so far; grows to PARTIAL_PAIRS pairs before it is given out."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, pairs: pa.Table) -> None:
        own = pairs.group_by("pair", use_threads=False).aggregate([("pair", "count")]).rename_columns(["pair", "docs"])
        self.tables.append(own)
        self.rows += own.num_rows
        if self.rows > 4 * PARTIAL_PAIRS:
            self.merge()

    def merge(self) -> None:
        if len(self.tables) > 1:
            self.tables = [pa.concat_tables(self.tables).group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])]
            self.rows = self.tables[0].num_rows

    def given(self, least: int) -> Iterator[pa.RecordBatch]:
        """Rows of lists, once there are more than `least` pairs."""
        if self.rows <= least:
            return
        self.merge()
        if self.rows <= least:
            return
        table = self.tables[0].combine_chunks()
        self.tables, self.rows = [], 0
        for at in range(0, table.num_rows, PAIRS_PER_ROW):
            part = table.slice(at, PAIRS_PER_ROW)
            yield _row_batch(1, count_pairs=_one_list(part["pair"]), count_docs=_one_list(part["docs"]))


def _one_list(values: pa.ChunkedArray) -> pa.Array:
    flat = values.combine_chunks().cast(pa.int64())
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _row_batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)).cast(kind) for name, kind in _PER_DOC.items()], list(_PER_DOC))


def align_documents(docs: DataFrame, byte_file: str, piece_file: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of documents (counts, digest of the groups, linked pairs with their numbers), and rows of pair counts of a task."""

    def documents(ids: pa.Array, texts: list[str], a: Side, b: Side, counts: PairCounts) -> pa.RecordBatch:
        if len(texts) == 1 and len(texts[0]) > block_chars:
            own, digest, pairs = _whole(texts[0], a, b, block_chars)
            own, digests = own[None], [digest]
        else:
            _, own, groups, pairs = aligned(texts, a, b)
            digests = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(groups.to_pylist(), own[:, 0].tolist(), strict=True)]
        counts.add(pairs)
        at = pa.array(np.searchsorted(np.asarray(pairs["doc"]), np.arange(len(texts) + 1)), pa.int32())
        lists = {new: pa.ListArray.from_arrays(at, pairs[old].combine_chunks().cast(pa.int64())) for new, old in (("pairs", "pair"), ("times", "times"))}
        return _row_batch(len(texts), doc_id=ids, n_a=pa.array(own[:, 0]), n_b=pa.array(own[:, 1]), n_groups=pa.array(own[:, 2]), n_links=pa.array(own[:, 3]), groups_sha256=pa.array(digests, pa.string()), **lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(byte_file, piece_file)
        counts = PairCounts()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for x, y in _blocks(texts, block_chars):
                yield documents(batch.column("doc_id").slice(x, y - x), texts[x:y], a, b, counts)
            yield from counts.given(PARTIAL_PAIRS)
        yield from counts.given(0)
        a.forget(), b.forget()  # workers live on for other stages

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PER_DOC_DDL)


def pair_counts(parts: DataFrame, n_b: int) -> DataFrame:
    """(pair, docs, best) of all pairs: in how many documents it is linked, and whether no pair of its A id is in more."""
    each = parts.where("count_pairs is not null").select(F.explode(F.arrays_zip("count_pairs", "count_docs")).alias("c"))
    docs = stored(each.groupBy(F.col("c.count_pairs").alias("pair")).agg(F.sum("c.count_docs").alias("docs")), "pairs")
    a = F.expr(f"pair div {n_b}")
    most = docs.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    # one row for each id of the vocabulary at most
    return docs.join(F.broadcast(most), a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def frequent_from(pairs: DataFrame, most: int = MOST_COMMON) -> int:
    """Smallest number of documents from which no more than `most` pairs are left; by steps of an eighth, so that few rows reach the driver."""
    step = F.floor(F.log2("docs") * 8)
    rows = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("docs").alias("least"), F.max("docs").alias("most")).orderBy(F.desc("step")).collect()  # 512 rows at most
    total, least = 0, None
    for r in rows:
        total += r["n"]
        if total > most:
            return least if least is not None else r["most"] + 1
        least = r["least"]
    return least or 1


def link_counts(rows: DataFrame, pairs: DataFrame, most: int = MOST_COMMON) -> DataFrame:
    """Add n_best and count_sum to document rows; frequent pairs are looked up in each task, the others are joined."""
    spark = rows.sparkSession
    least = frequent_from(pairs, most)
    common = pairs.where(F.col("docs") >= least).toArrow()
    order = np.argsort(np.asarray(common["pair"]))
    shared = spark.sparkContext.broadcast(tuple(np.asarray(common[c])[order] for c in ("pair", "docs", "best")))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = rows.select(*kept, "pairs", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pair, times = np.asarray(pc.list_flatten(lists)), np.asarray(pc.list_flatten(batch.column("times")))
            doc = np.asarray(pc.list_parent_indices(lists))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, doc[hit], times[hit] * best[at[hit]])
            np.add.at(total, doc[hit], times[hit] * docs[at[hit]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best), pa.array(total), *rare], [*kept, "n_best", "count_sum", "rare", "rare_times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_times array<long>"
    found = own.mapInArrow(run, schema)
    if least <= 1:
        return found.drop("rare", "rare_times")
    found = stored(found, "common")
    rare = found.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", F.col("r.rare").alias("pair"), F.col("r.rare_times").alias("times"))
    more = rare.join(pairs.where(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more"))
    both = found.drop("rare", "rare_times").join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).drop("more_best", "more")


def align_tokenizers(docs: DataFrame, byte_file: str, piece_file: str, block_chars: int = BLOCK_CHARS, most_common: int = MOST_COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text).

    Null and empty texts, and those that a side does not give back byte for byte, have
    no tokens: zeros and an empty digest.  Each row counts as one document, also where ids
    repeat or are null; other columns are ignored, an empty table gives no rows.  Long texts are
    taken part after part.
    """
    n_b = piece_table(piece_file).n
    parts = stored(align_documents(docs, byte_file, piece_file, block_chars), "aligned")
    pairs = stored(pair_counts(parts, n_b), "pair-counts")
    rows = parts.where("n_a is not null").withColumn("row", F.monotonically_increasing_id())
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return link_counts(rows, pairs, most_common).select(*names)
