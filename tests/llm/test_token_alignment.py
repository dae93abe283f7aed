"""Alignment of two tokenizers against a plain version that asks the libraries for whole texts."""

import bisect
import functools
import hashlib
from collections import Counter

import pytest

from tracelake.llm import token_alignment as ta
from tracelake.llm.queries import op11_token_alignment, tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def byte_level(entry):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return bytes(table[c] for c in entry)


def ranges(ids, spell):
    at, out = 0, []
    for i in ids:
        n = len(spell(i))
        out.append((at, at + n))
        at += n
    return out


def plain(texts, libraries):
    a, b = libraries
    piece = functools.lru_cache(None)(lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
    entry = functools.lru_cache(None)(lambda i: byte_level(a.id_to_token(i)))
    coded = []
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        whole = (" " + text).encode() if text else b""
        coded.append(ids if b"".join(map(entry, ids[0])) == whole == b"".join(map(piece, ids[1])) else [[], []])
    linked, counts = [], Counter()
    for x, y in coded:
        rx, ry, j, own = ranges(x, entry), ranges(y, piece), 0, []
        for i, (s, e) in enumerate(rx):
            while j and ry[j - 1][1] > s:
                j -= 1
            while j < len(ry) and ry[j][0] < e:
                if ry[j][1] > s:
                    own.append((x[i], y[j]))
                j += 1
        linked.append(own)
        counts.update(set(own))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for (x, y), own in zip(coded, linked, strict=True):
        rx, ry = ranges(x, entry), ranges(y, piece)
        ends = sorted({e for _, e in rx} & {e for _, e in ry})
        groups = [([], []) for _ in ends]
        for side, (ids, spans) in enumerate(((x, rx), (y, ry))):
            for i, (_, e) in zip(ids, spans, strict=True):
                groups[bisect.bisect_left(ends, e)][side].append(str(i))
        groups = [tuple(map(",".join, g)) for g in groups]
        text = ";".join("|".join(g) for g in groups)
        out.append((len(x), len(y), len(ends), len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out


def ours(frame):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(((r["doc_id"], tuple(r[n] for n in names)) for r in frame.collect()), key=str)


ODD = [
    None, "", "a", " ", "  lead", "trail  ", "x  y   z", "tab\tnew\nline \n x", "x y  z 　 q", "don't we're I'LL", "<|endoftext|> <s> </s> <unk> a<|endoftext|>b", "▁ under ▁▁ x", "a▁b", "naïve Ünïcode ßtraße", "日本語のテキスト 漢字", "🎉🎉 ok 👨‍👩‍👧",
    "1234567 3.14", "\x00\x01 \x1c \x1f\x85x", "word " * 300, "é" * 200, "same text here", "same text here", "​ zero", "á combining", "x" * 3000, " 　x \x1cy",
]


def test_given_documents(spark, sf_dir, libraries):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows], libraries), strict=True), key=str)
    assert ours(op11_token_alignment(spark, sf_dir)) == want


@pytest.mark.parametrize(("block_chars", "most_common"), [(1 << 20, 1 << 19), (40, 25), (7, 0)])
def test_odd_texts_in_parts_and_with_rare_pairs(spark, libraries, block_chars, most_common):
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD)] + [(None, "no id here", 2, "y"), (3, "same text here", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, row string")
    want = sorted(zip([r[0] for r in rows], plain([r[1] for r in rows], libraries), strict=True), key=str)
    assert ours(ta.align_tokenizers(docs, *FILES, block_chars=block_chars, most_common=most_common)) == want


def test_empty_table(spark):
    assert ta.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *FILES).count() == 0


def test_long_text_equals_the_libraries(spark, libraries):
    text = "".join(f"word{i % 97} ünd\n {'x' * (i % 31)}  y{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = ta.align_tokenizers(docs, *FILES, block_chars=100_000).first()
    assert got["n_a"] == len(libraries[0].encode(" " + text, add_special_tokens=False).ids)
    assert got["n_b"] == len(libraries[1].encode(text))
    assert got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"]
