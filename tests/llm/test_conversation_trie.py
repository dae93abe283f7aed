"""The prefix trie against a plain one, over the given conversations and odd ones."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracelake.llm import conversation_trie as ct
from tracelake.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = sum(saved[k] for k in children[key]) + ((len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0)
    out = []
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(key)))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def ours(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


#: Blocks of a few turns, so that most nodes span several, and chunks of a few ids.
SIZES = pytest.mark.parametrize("sizes", [{"block_turns": 7, "ids_per_chunk": 2}, {"block_turns": 40, "ids_per_chunk": 7}, {}])


def test_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ours(op12_conversation_trie(spark, sf_dir)) == plain(rows)


@SIZES
def test_many_common_prefixes_over_many_blocks(spark, sizes):
    draw = random.Random(len(sizes))
    rows = []
    for c in range(300):
        if c % 3 == 0:
            rows += [(c, t, "user", f"same {t}") for t in range(6)]
        elif c % 3 == 1:
            rows += [(c, t, draw.choice(["user", None]), draw.choice("ab")) for t in range(draw.randrange(0, 9))]
        else:
            rows += [(c, t if t else None, "user", draw.choice(["é", "same 0", ""])) for t in range(draw.randrange(0, 14))]
    assert ours(ct.rebuilt_trie(frame(spark, rows).repartition(5), **sizes)) == plain(rows)


@SIZES
def test_odd_conversations(spark, sizes):
    rows = [
        (0, 1, "user", "a"), (0, None, "system", "z"), (0, 2, None, None), (1, 1, "user", "a"), (None, 1, "user", "a"), (7, 3, "user", "a"), (7, 3, "user", "a"), (12, 0, "x", "y"), (10, 0, "user", ""),
        *((20, t, "user", "t" * t) for t in range(60)), *((25, t, "user", "t" * t) for t in range(60)), (3, 1, "user", "only"),
    ]
    more = frame(spark, rows).selectExpr("*", "1 as depth", "'x' as turns", "2 as n", "'y' as part")
    assert ours(ct.rebuilt_trie(more, **sizes)) == plain(rows)
    assert ct.rebuilt_trie(frame(spark, [])).count() == 0
    assert ours(ct.rebuilt_trie(frame(spark, [(None, 1, "a", "b")]))) == []
    assert ours(ct.rebuilt_trie(frame(spark, [(4, 1, "a", "b")]))) == plain([(4, 1, "a", "b")])
