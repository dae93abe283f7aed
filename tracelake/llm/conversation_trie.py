"""Prefix trie of conversations: which of them begin alike, and how far.

Conversations are ordered by their turns' digests, so that those with a common
beginning stand side by side.  In each block of this order the common depths (LCP) of
neighbours are edges; a union-find takes them from the deepest to the shallowest, and each
merge of components makes a branching node.  Nodes on the way to a block's first or last
conversation may go on in the next block: each block's forest is contracted to these,
and they are merged by their keys over all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.kernels import mix
from tracelake.llm.shared import stored

DIGEST = 16
BLOCK_TURNS = 200_000
IDS_PER_CHUNK = 1000

_U = np.uint64
_SALT = _U(0xD6E8FEB86659FD93)
SEQUENCE = "conv_id long, turns binary, sizes array<long>"
_CLOSED, _COMMON, _FIRST, _LAST = range(4)
_NODE = {
    "part": pa.int64(), "side": pa.int8(), "parent_side": pa.int8(), "depth": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "p1": pa.int64(), "p2": pa.int64(),
    "size": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}
_NODE_DDL = ", ".join(f"{n} {'byte' if t == pa.int8() else 'string' if t == pa.string() else 'long'}" for n, t in _NODE.items())
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): each conversation's turns in order, as digests of role and text and as bytes of text.

    Turns are ordered by number, null first; those of one number by role and digest, so
    repeated rows count as turns of their own.  Null roles and texts are empty; rows
    without a conv_id belong to no conversation.  A conversation is one row of some 40 bytes a
    turn; its texts stay behind.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("turns"), F.col("t.size").alias("sizes"))


def swap_heads(sequences: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % 5, where h is crc32 of the decimal c modulo 9.

    A base with fewer turns gives all it has, one that is missing none; what c has after
    its own first h turns follows.  One row for each conv_id.
    """
    most = 8
    heads = sequences.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.substring("turns", 1, most * DIGEST).alias("head"), F.slice("sizes", 1, most).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = sequences.select("conv_id", "turns", "sizes", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    both = own.join(heads, "base", "left")
    head = F.coalesce(F.expr(f"substring(head, 1, h * {DIGEST})"), F.lit(b""))
    sizes = F.when(F.col("h") > 0, F.coalesce(F.expr("slice(head_sizes, 1, h)"), F.array().cast("array<long>"))).otherwise(F.array().cast("array<long>"))
    return both.select("conv_id", F.concat(head, F.expr(f"substring(turns, h * {DIGEST} + 1)")).alias("turns"), F.concat(sizes, F.expr("slice(sizes, h + 1, greatest(size(sizes) - h, 0))")).alias("sizes"))


def equal_sequences(sequences: DataFrame, ids_per_chunk: int = IDS_PER_CHUNK) -> DataFrame:
    """One row for each distinct sequence: (conv_id, turns, sizes, n, ends_sha256), with the smallest and number of its conversations and the digest of their ids.

    A group of copies is ordered over many partitions and packed there into chunks of `ids_per_chunk`
    ids; only the chunks meet, and run through SHA-256, which has to see them in turn.
    """
    named = sequences.select(F.unhex(F.md5("turns")).alias("sequence"), "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None and kept.num_rows:
                table = pa.concat_tables([kept, table])
            cuts = _chunks(table, ids_per_chunk)
            yield from _packed(table.slice(0, cuts[-2]), cuts[:-1])
            kept = table.slice(cuts[-2])
        if kept is not None and kept.num_rows:
            yield from _packed(kept, _chunks(kept, ids_per_chunk))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, state = None, 0, 0, None
        for batch in batches:
            out = []
            for sequence, least, count, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence", "first", "n", "ids")), strict=True):
                if sequence != now:
                    if now is not None:
                        out.append((first, n, state.hexdigest()))
                    now, first, n, state = sequence, least, 0, hashlib.sha256()
                state.update(b"," + ids if n else ids)
                n += count
            yield _rows(out)
        if now is not None:
            yield _rows([(first, n, state.hexdigest())])

    order = ["sequence", "conv_id"]
    chunks = named.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "sequence binary, first long, n long, ids binary")
    groups = chunks.repartition("sequence").sortWithinPartitions("sequence", "first").mapInArrow(digest, "conv_id long, n long, ends_sha256 string")
    return groups.join(sequences, "conv_id")


def _chunks(table: pa.Table, most: int) -> list[int]:
    """Places where the sequence changes, and every `most` rows of one sequence."""
    n = table.num_rows
    if not n:
        return [0, 0]
    raw = np.frombuffer(b"".join(table.column("sequence").to_pylist()), ">u8").reshape(n, 2)
    new = np.flatnonzero((raw[1:] != raw[:-1]).any(1)) + 1
    starts = np.concatenate([[0], new])
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return [*np.flatnonzero(place % most == 0).tolist(), n]


def _packed(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
    if len(cuts) < 2:
        return
    ids = table.column("conv_id").to_pylist()
    text = [",".join(map(str, ids[a:b])).encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    first = table.take(pa.array(cuts[:-1], pa.int64()))
    yield from pa.table({"sequence": first.column("sequence"), "first": first.column("conv_id"), "n": pa.array(np.diff(cuts), pa.int64()), "ids": pa.array(text, pa.binary())}).combine_chunks().to_batches()


def _rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "n", "ends_sha256"])


class Block:
    """Forest of one block of distinct sequences in order."""

    def __init__(self, table: pa.Table):
        turns = table.column("turns").combine_chunks()
        lengths = np.array([len(t) // DIGEST for t in turns.to_pylist()], np.int64)
        self.n = len(lengths)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer(b"".join(turns.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        self.length = lengths
        self.sizes = np.concatenate([np.asarray(x, np.int64) for x in [[], *table.column("sizes").to_pylist()]])
        self.conv = np.asarray(table.column("conv_id"), np.int64)
        self.count = np.asarray(table.column("n"), np.int64)
        self.ends = table.column("ends_sha256").to_pylist()
        place = np.arange(len(raw)) - np.repeat(self.start[:-1], lengths)
        self.keys = [self._prefixes(raw[:, k], place) for k in (0, 1)]
        self.lcp = self._common(raw, place)

    def _prefixes(self, digests: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Key of each prefix: a sum of its turns' digests, each mixed with its place."""
        sums = np.cumsum(mix(digests + (place.astype(np.uint64) + _U(1)) * _SALT))
        before = np.where(self.start[:-1] > 0, sums[np.maximum(self.start[:-1] - 1, 0)] if len(sums) else _U(0), _U(0))
        return mix(sums - np.repeat(before, self.length)).view(np.int64)

    def _common(self, raw: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Number of turns that each sequence shares with the one before it."""
        of = np.repeat(np.arange(self.n), self.length)
        partner = self.start[np.maximum(of - 1, 0)] + place
        same = (of > 0) & (place < self.length[np.maximum(of - 1, 0)])
        same &= (raw == raw[np.minimum(partner, max(len(raw) - 1, 0))]).all(1)
        out = self.length.copy()
        other = np.flatnonzero(~same)[::-1]
        out[of[other]] = place[other]
        return out[1:]

    def branches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Depth, first and last member and parent of each node where members part or end; the last is the root."""
        depth, lo, hi, up = self.length.tolist(), list(range(self.n)), list(range(self.n)), [-1] * self.n
        top = list(range(self.n))  # of each component, by its representative
        joined = list(range(self.n))
        fused = {}

        def find(x: int) -> int:
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        for edge in np.argsort(-self.lcp, kind="stable").tolist():
            at = int(self.lcp[edge])
            a, b = find(edge), find(edge + 1)
            x, y = top[a], top[b]
            if depth[x] == at and depth[y] == at:  # both stand for the same prefix
                fused[y] = x
                node = x
            elif depth[x] == at:
                up[y] = node = x
            elif depth[y] == at:
                up[x] = node = y
            else:
                node = len(depth)
                depth.append(at), lo.append(lo[x]), hi.append(hi[y]), up.append(-1)
                up[x] = up[y] = node
            lo[node], hi[node] = min(lo[x], lo[y]), max(hi[x], hi[y])
            joined[b] = a
            top[a] = node
        root = top[find(0)]
        if depth[root]:
            depth.append(0), lo.append(0), hi.append(self.n - 1), up.append(-1)
            up[root] = len(depth) - 1

        def real(x: int) -> int:
            while x in fused:
                x = fused[x]
            return x

        keep = [x for x in range(len(depth)) if x not in fused]
        keep.sort(key=lambda x: -depth[x])
        number = {x: k for k, x in enumerate(keep)}
        parent = [number[real(up[x])] if up[x] >= 0 else -1 for x in keep]
        return np.array([depth[x] for x in keep]), np.array([lo[x] for x in keep]), np.array([hi[x] for x in keep]), np.array(parent)

    def nodes(self, part: int) -> pa.Table:
        """One row for each prefix.  Rows of open nodes hold sums over the closed nodes below them, all others final values."""
        depth, lo, hi, parent = self.branches()
        m = len(depth)
        total = np.concatenate([[0], np.cumsum(self.count)])
        n = total[hi + 1] - total[lo]
        conv = self._least(depth, parent, lo)
        side = np.where(lo == 0, np.where(hi == self.n - 1, _COMMON, _FIRST), np.where(hi == self.n - 1, _LAST, _CLOSED))
        shut = side == _CLOSED
        above = np.where(parent >= 0, depth[parent], -1)
        bytes_to = np.concatenate([[0], np.cumsum(self.sizes)])
        chain = bytes_to[self.start[lo] + depth] - bytes_to[self.start[lo] + np.maximum(above, 0)]
        children, shut_children, leaves, saved = (np.zeros(m, np.int64) for _ in range(4))
        own = np.where(shut, (n - 1) * chain, 0)
        for k in range(m):  # children come before their parents
            if shut[k] and not children[k]:
                leaves[k] = 1
            p = parent[k]
            if p >= 0:
                children[p] += 1
                shut_children[p] += shut[k]
                leaves[p] += leaves[k]
                saved[p] += saved[k] + own[k]
        rows = depth - above
        node = np.repeat(np.arange(m), rows)
        d = above[node] + 1 + np.arange(len(node)) - np.repeat(np.cumsum(rows) - rows, rows)
        bottom = d == depth[node]
        at = self.start[lo[node]] + d - 1
        size = np.where(d > 0, self.sizes[np.maximum(at, 0)] if len(self.sizes) else 0, 0)
        key = [np.where(d > 0, k[np.maximum(at, 0)] if len(k) else 0, 0) for k in self.keys]
        key_above = [np.where(d > 1, k[np.maximum(at - 1, 0)] if len(k) else 0, 0) for k in self.keys]
        deeper = bytes_to[self.start[lo[node]] + depth[node]] - bytes_to[np.where(d > 0, at, self.start[lo[node]])]
        up = np.where(d > above[node] + 1, node, parent[node])  # whose prefix the parent's row belongs to
        known = (up >= 0) & shut[up]
        ends = np.full(len(node), NO_ENDS, object)
        for row in np.flatnonzero(bottom & (self.length[lo[node]] == d)).tolist():  # what ends at a node is the first of its members
            ends[row] = self.ends[lo[node[row]]]
        columns = {
            "part": np.full(len(node), part), "side": side[node].astype(np.int8), "parent_side": np.where(up >= 0, side[up], _CLOSED).astype(np.int8), "depth": d, "k1": key[0], "k2": key[1], "p1": key_above[0], "p2": key_above[1],
            "size": size, "conv_id": conv[node], "parent_conv_id": pa.array(conv[up], mask=~known), "n_convs": n[node], "n_leaves": leaves[node], "ends_sha256": ends,
            "n_children": np.where(shut[node], np.where(bottom, children[node], 1), np.where(bottom, shut_children[node], 0)),
            "saved_tokens": saved[node] + np.where(shut[node], (n[node] - 1) * deeper, 0),
        }
        return pa.table({name: pa.array(columns[name], kind) if not isinstance(columns[name], pa.Array) else columns[name].cast(kind) for name, kind in _NODE.items()})

    def _least(self, depth: np.ndarray, parent: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Smallest conv_id below each node."""
        out = np.full(len(depth), np.iinfo(np.int64).max)
        ends_at = self.length[lo] == depth
        out[ends_at] = self.conv[lo[ends_at]]
        for k in range(len(depth)):
            if parent[k] >= 0:
                out[parent[k]] = min(out[parent[k]], out[k])
        return out


def block_forests(distinct: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rows of `Block.nodes` for all blocks of about `block_turns` turns in the order of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column("sizes"))).astype(np.int64) + 1
            at = 0
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), block_turns - turns, "right")))
                kept.append(batch.slice(at, to - at))
                turns += int(size[at:to].sum())
                at = to
                if turns >= block_turns:
                    yield from Block(pa.Table.from_batches(kept)).nodes(number).combine_chunks().to_batches()
                    number, kept, turns = number + 1, [], 0
        if kept:
            yield from Block(pa.Table.from_batches(kept)).nodes(number).combine_chunks().to_batches()

    return distinct.select("conv_id", "turns", "sizes", "n", "ends_sha256").repartitionByRange("turns").sortWithinPartitions("turns").mapInArrow(run, _NODE_DDL)


def prefix_trie(sequences: DataFrame, block_turns: int = BLOCK_TURNS, ids_per_chunk: int = IDS_PER_CHUNK) -> DataFrame:
    """One row for each distinct prefix of the sequences (conv_id, turns, sizes), the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): a node is known by its depth and smallest member.  Sequences of no turns are
    members of the root, which has no parent; no sequences give no rows.  conv_id must not repeat.

    Of open nodes each block has a row with what lies closed below it.  Merged, such a
    node counts itself once, in the first block that has it; a running sum up the block's
    two edges then carries it to the open nodes above.
    """
    forest = stored(block_forests(stored(equal_sequences(sequences, ids_per_chunk), "sequences"), block_turns), "forests")
    shut, open_ = forest.where(f"side = {_CLOSED}"), forest.where(f"side <> {_CLOSED}")
    key, above = ["depth", "k1", "k2"], [F.col("depth") - 1, F.col("p1"), F.col("p2")]
    merged = open_.groupBy(*key).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"), F.sum("n_children").alias("shut_children"), F.min("part").alias("owner"), F.min("size").alias("bytes"),
        F.coalesce(F.min(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends"),
    )
    merged = stored(merged, "open")
    children = merged.where("depth > 0").groupBy(*(c.alias(n) for c, n in zip(above, key, strict=True))).agg(F.count("*").alias("open_children"))
    parents = merged.select(*key, F.col("least").alias("parent_least"))
    merged = merged.join(children, key, "left").withColumn("children", F.col("shut_children") + F.coalesce("open_children", F.lit(0)))
    merged = merged.join(parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_least"), ["depth", "p1", "p2"], "left").drop("p1", "p2")
    merged = stored(merged, "open")
    each = open_.select("part", "side", *key, "n_leaves", "saved_tokens").join(merged, key)
    own = lambda value: F.when(F.col("owner") == F.col("part"), value).otherwise(0)
    leaf, saved = own(F.when(F.col("children") == 0, 1).otherwise(0)), own((F.col("members") - 1) * F.col("bytes"))
    edge, block = Window.partitionBy("part", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("part")
    gathered = each.select(*each.columns, leaf.alias("leaf"), saved.alias("own"))
    for name in ("leaf", "own"):
        beside = F.sum(F.when(F.col("side") != _COMMON, F.col(name)).otherwise(0)).over(block)
        gathered = gathered.withColumn(f"all_{name}", F.sum(name).over(edge) + F.when(F.col("side") == _COMMON, beside).otherwise(0))
    whole = gathered.groupBy(*key).agg(*(F.min(c).alias(c) for c in ("least", "parent_least", "members", "children", "ends")), F.sum(F.col("n_leaves") + F.col("all_leaf")).alias("n_leaves"), F.sum(F.col("saved_tokens") + F.col("all_own")).alias("saved_tokens"))
    spanning = whole.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    inner = shut.where("parent_conv_id is not null")
    # children of open nodes find their parent beside them in their own block
    parent = each.select("part", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    hanging = shut.where("parent_conv_id is null").drop("parent_conv_id").join(parent, ["part", "parent_side", "depth"])
    return spanning.unionByName(inner.select(*spanning.columns)).unionByName(hanging.select(*spanning.columns))


def rebuilt_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """`prefix_trie` of all conversations after `swap_heads`; other columns are ignored."""
    sequences = stored(turn_sequences(conversations), "turns")
    return prefix_trie(stored(swap_heads(sequences), "rebuilt"), **sizes)
