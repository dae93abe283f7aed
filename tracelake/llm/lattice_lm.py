"""Document likelihood under a unigram model of subwords, summed over all segmentations.

The vocabulary and its first scores are those of an existing tokenizer.  A word,
written with the space sign before it, is a lattice of pieces; characters without a
piece fall back to their bytes.  Expectation-maximisation over the training tokens
fits the scores, with the vocabulary's own as a prior worth PRIOR_TOKENS tokens.  A
training word is one more arc, from the first node of its lattice to the last: with N
training tokens of V kinds, of which c are the word, that arc weighs c / (N + V) and
the way through the pieces V / (N + V), so that probabilities sum to one over all words
and the end sign of a text.  The forward recursion in log space adds up all paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.kernels import _LOWER, blocks, mix, utf8, word_hashes, word_spans
from tracelake.llm.shared import drop_stored, stored

FOLDS, HELD_OUT = 7, 2
SPACE = "▁"
ROUNDS = 2
PRIOR_TOKENS = 1000.0
BLOCK_BYTES = 3 << 19
MOST_HOT = 400_000
_NO_ID = -(1 << 62)
_U = np.uint64


class Pieces:
    """Strings of a vocabulary, found by hash at all places of a text at once."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        normal.sort(key=lambda i: (-model.get_score(i), i))
        self.text = [model.id_to_piece(i) for i in normal]
        self.n = len(self.text) + 256 + 1  # byte signs and the end follow the pieces
        self.end = self.n - 1
        self.opens = np.array([p.startswith(SPACE) for p in self.text] + [False] * 257)
        lengths = np.array([len(p) for p in self.text])
        self.longest = int(lengths.max())
        codes = np.frombuffer("".join(self.text).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(lengths)])
        keys = self._hashes(codes, at[:-1], lengths)
        self.size = 1 << 20
        self.slot_key, self.slot_id = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
        for k, i in zip(keys.tolist(), range(len(keys)), strict=True):
            s = k & (self.size - 1)
            while self.slot_id[s] >= 0:
                s = (s + 1) & (self.size - 1)
            self.slot_key[s], self.slot_id[s] = k, i
        self.first_scores = np.log(1.0 / (np.arange(self.n) + 10.0))
        self.first_scores -= np.logaddexp.reduce(self.first_scores)

    def _hashes(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        from tracelake.llm.kernels import _powers

        up, down = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * up[: len(codes)], out=sums[1:])
        return mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        s = (keys & _U(self.size - 1)).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            ids, same = self.slot_id[s[left]], self.slot_key[s[left]] == keys[left]
            out[left[same & (ids >= 0)]] = ids[same & (ids >= 0)]
            left = left[(ids >= 0) & ~same]
            s[left] = (s[left] + 1) & (self.size - 1)
        return out

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words of one length at a time: (their places, arcs' ids [length, words, longest], byte ids, byte owners).

        The arc [j, w, l] is the piece of l + 1 characters of word w that ends after
        character j + 1, or -1.  A character without a piece has the arc -2; its byte
        signs are listed with the flat place of the character.
        """
        length = np.array([len(w) for w in words])
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            for at in range(0, len(mine), max(1, 50_000 // n)):
                which = mine[at : at + max(1, 50_000 // n)]
                flat = "".join([words[i] for i in which.tolist()])
                codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
                arcs = np.full((n, len(which), min(n, self.longest)), -1, np.int32)
                for l in range(1, arcs.shape[2] + 1):
                    start = (np.arange(len(which))[:, None] * n + np.arange(n - l + 1)[None, :]).ravel()
                    found = self.find(self._hashes(codes, start, np.full(len(start), l)))
                    arcs[l - 1 :, :, l - 1] = found.reshape(len(which), n - l + 1).T
                bare = np.argwhere(arcs[:, :, 0] < 0)
                ids, owner = [], []
                for j, w in bare.tolist():
                    arcs[j, w, 0] = -2
                    for b in flat[w * n + j].encode("utf-8", "replace"):
                        ids.append(len(self.text) + b)
                        owner.append(j * len(which) + w)
                yield which, arcs, np.array(ids, np.int64), np.array(owner, np.int64)


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def _arc_scores(arcs: np.ndarray, scores: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    out = np.where(arcs >= 0, scores[np.maximum(arcs, 0)], -np.inf)
    if len(ids):
        n = arcs.shape[0] * arcs.shape[1]
        by_bytes = np.bincount(owner, weights=scores[ids], minlength=n).reshape(arcs.shape[:2])
        out[:, :, 0] = np.where(arcs[:, :, 0] == -2, by_bytes, out[:, :, 0])
    return out


def forward(arc: np.ndarray) -> np.ndarray:
    """Log probability of each prefix, [length + 1, words]."""
    n, w, longest = arc.shape
    alpha = np.full((n + 1, w), -np.inf)
    alpha[0] = 0
    for j in range(1, n + 1):
        k = min(j, longest)
        terms = alpha[j - k : j][::-1] + arc[j - 1, :, :k].T
        top = terms.max(axis=0)
        alpha[j] = top + np.log(np.exp(terms - top).sum(axis=0))
    return alpha


def backward(arc: np.ndarray) -> np.ndarray:
    """Log probability of each suffix, [length + 1, words]."""
    n, w, longest = arc.shape
    beta = np.full((n + 1, w), -np.inf)
    beta[n] = 0
    for j in range(n - 1, -1, -1):
        k = min(n - j, longest)
        terms = np.stack([beta[j + l] + arc[j + l - 1, :, l - 1] for l in range(1, k + 1)])
        top = terms.max(axis=0)
        beta[j] = top + np.log(np.exp(terms - top).sum(axis=0))
    return beta


def word_scores(words: list[str], table: Pieces, scores: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all its segmentations."""
    out = np.zeros(len(words))
    for which, arcs, ids, owner in table.lattices([SPACE + w for w in words]):
        out[which] = forward(_arc_scores(arcs, scores, ids, owner))[-1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, table: Pieces, scores: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur `counts` times."""
    out = np.zeros(table.n)
    for which, arcs, ids, owner in table.lattices([SPACE + w for w in words]):
        arc = _arc_scores(arcs, scores, ids, owner)
        alpha, beta = forward(arc), backward(arc)
        weight = counts[which]
        for l in range(1, arc.shape[2] + 1):
            use = np.exp(alpha[: len(arc) - l + 1] + arc[l - 1 :, :, l - 1] + beta[l:] - alpha[-1]) * weight
            real = arcs[l - 1 :, :, l - 1]
            out += np.bincount(real[real >= 0], weights=use[real >= 0], minlength=table.n)
            if l == 1 and len(ids):
                out += np.bincount(ids, weights=use.ravel()[owner], minlength=table.n)
    return out


_BLOCK = "block long, ids binary, sizes binary, train binary, places binary, counts binary, word_sizes binary, words binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, lowest first, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unpack(cell: pa.Scalar, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(cell.as_buffer()), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _place_kind(kinds: int) -> str:
    return "<u2" if kinds <= 1 << 16 else "<u4"


def block_rows(docs: DataFrame) -> DataFrame:
    """Blocks of about BLOCK_BYTES of text, one row each, in packed columns.

    A block has its documents' ids, numbers of tokens and folds, each token's place in
    the list of the block's kinds of words, and that list, common words first: count in
    training documents, length and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            row, train = np.asarray(batch.column("row")), np.asarray(batch.column("train")).astype(np.uint8)
            for a, b in blocks(offsets, BLOCK_BYTES):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = word_spans(part, own)
                _, first, place, total = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-total, kind="stable")
                turn = np.empty(len(order), np.int64)
                turn[order] = np.arange(len(order))
                first, place, sizes = first[order], turn[place], np.diff(rows)
                counts = np.bincount(place[np.repeat(train[a:b] == 1, sizes)], minlength=len(order))
                length = (ends - starts)[first]
                at = np.arange(int(length.sum())) + np.repeat(starts[first] - np.cumsum(length) + length, length)
                columns = [row[a:b].astype("<i8"), sizes.astype("<i4"), train[a:b], place.astype(_place_kind(len(order))), counts.astype("<i4"), length.astype("<i4"), _LOWER[part[at]]]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([_pack(c)], pa.binary()) for c in columns)], [c.split()[0] for c in _BLOCK.split(", ")])
                number += 1

    return docs.select("row", "train", "text").mapInArrow(run, _BLOCK)


def _block_words(word_sizes: pa.Scalar, words: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, offsets and hashes of a block's kinds of words."""
    ends, text = np.concatenate([[0], np.cumsum(_unpack(word_sizes, "<i4"))]), _unpack(words, "u1")
    return text, ends, word_hashes(text, ends[:-1], ends[1:]).view(np.int64)


def block_words(all_blocks: DataFrame) -> DataFrame:
    """(hash, c, word) of each kind of word of each block."""

    def run(batches):
        for batch in batches:
            for c, size, words in zip(*batch.columns, strict=True):
                text, ends, h = _block_words(size, words)
                if len(h):
                    column = pa.StringArray.from_buffers(len(h), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(_unpack(c, "<i4").astype(np.int64)), column], ["hash", "c", "word"])

    return all_blocks.select("counts", "word_sizes", "words").mapInArrow(run, "hash long, c long, word string")


def _found(h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is among the sorted hot ones, and where."""
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    return (hot[at] == h) if len(hot) else np.zeros(len(h), bool), at


def cold_words(all_blocks: DataFrame, hot) -> DataFrame:
    """(block, place, hash) of the kinds of words of each block that the broadcast hot ones don't hold."""

    def run(batches):
        for batch in batches:
            for block, size, words in zip(*batch.columns, strict=True):
                h = _block_words(size, words)[2]
                place = np.flatnonzero(~_found(h, hot.value[0])[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block.as_py())), pa.array(place.astype(np.int32)), pa.array(h[place])], ["block", "place", "hash"])

    return all_blocks.select("block", "word_sizes", "words").mapInArrow(run, "block long, place int, hash long")


def block_tokens(all_blocks: DataFrame, hot) -> DataFrame:
    """(block, ids, sizes, train, places, hot_places, hot_at): blocks without their words, those of hot words by their number."""

    def run(batches):
        for batch in batches:
            parts = [_found(_block_words(size, words)[2], hot.value[0]) for size, words in zip(batch.column("word_sizes"), batch.column("words"), strict=True)]
            hot_places = pa.array([_pack(np.flatnonzero(is_hot).astype("<i4")) for is_hot, _ in parts], pa.binary())
            hot_at = pa.array([_pack(at[is_hot].astype("<i4")) for is_hot, at in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], hot_places, hot_at], [*batch.schema.names[:-2], "hot_places", "hot_at"])

    return all_blocks.select("block", "ids", "sizes", "train", "places", "word_sizes", "words").mapInArrow(run, "block long, ids binary, sizes binary, train binary, places binary, hot_places binary, hot_at binary")


def fit_pieces(words: DataFrame, ends: int, model_file: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of pieces, byte signs and the end, fitted to training words (word, c) and `ends` end signs."""
    table = pieces(model_file)
    scores, spark = table.first_scores, words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(scores)  # one number for each piece of the vocabulary

        def run(batches, shared=shared):
            own, total = pieces(model_file), None
            for batch in batches:
                uses = expected_counts(batch.column("word").to_pylist(), np.asarray(batch.column("c")).astype(float), own, shared.value)
                total = uses if total is None else total + uses
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        uses = PRIOR_TOKENS * np.exp(table.first_scores)
        uses[table.end] += ends
        found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses[np.asarray(found.column("piece"))] += np.asarray(found.column("uses"))
        scores = np.log(uses / uses.sum())
    return scores


def with_word_arc(log_p: np.ndarray, count: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """Log probability of words whose pieces give exp(log_p), with the arc of a word seen `count` times."""
    if not tokens:
        return log_p
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(count), np.log(kinds) + log_p) - np.log(tokens + kinds)


def score_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, piece_score) of each row of docs (doc_id, text).

    Words are runs outside \\x20 and \\x09-\\x0D after A-Z are lower-cased, and each text
    has one end sign.  Rows whose crc32(doc_id as text) modulo 7 is not 2 are training
    text.  base_score adds up log10((c + 1) / (N + V + 1)) over the tokens; score is the
    log10 of the lattice model's probability of the text, piece_score that of the
    lattice without the training words' arcs.  Null and empty texts are the end sign
    alone; rows that repeat are scored and learned from each time; a null doc_id is
    training text and comes back null; other columns are ignored; an empty table gives
    no rows; without training text the vocabulary's own scores count.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).cast("long").alias("row"), (fold != HELD_OUT).alias("train"), "text")
    all_blocks = stored(block_rows(rows), "blocks")
    words = stored(block_words(all_blocks).groupBy("hash", "word").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("blocks")), "words")
    learned = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = rows.where("train").count()
    total, kinds = learned["n"] + ends, learned["v"] + (ends > 0)
    scores = fit_pieces(words, ends, model_file)
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def marginal(batches):
        table = pieces(model_file)
        for batch in batches:
            log_p = word_scores(batch.column("word").to_pylist(), table, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.select(["hash", "c", "blocks"]).columns, pa.array(log_p)], ["hash", "c", "blocks", "log_p"])

    scored = stored(words.mapInArrow(marginal, "hash long, c long, blocks long, log_p double"), "scored-words")
    drop_stored(words)
    entries = scored.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    common = scored.where(F.col("blocks") > entries // MOST_HOT).select("hash", "c", "log_p").toArrow().sort_by("hash")  # MOST_HOT rows at most
    hot = docs.sparkSession.sparkContext.broadcast(tuple(np.asarray(common.column(n)) for n in ("hash", "c", "log_p")))
    known = stored(cold_words(all_blocks, hot).join(scored.select("hash", "c", "log_p"), "hash").select("block", "place", "c", "log_p"), "known")
    chance = np.exp(scores)
    end_alone = np.log(chance[-1] / (chance[-1] + chance[pieces(model_file).opens].sum()))  # among what can follow a whole word
    end_p, end_piece = float(with_word_arc(end_alone, np.float64(ends), total, kinds)), float(scores[-1])
    ln10 = float(np.log(10))

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        block = {n: left.column(n)[0] for n in left.column_names}  # a group is one block
        at, hot_at, hot_places = np.asarray(right.column("place")), _unpack(block["hot_at"], "<i4"), _unpack(block["hot_places"], "<i4")
        c, p = np.zeros(len(at) + len(hot_at)), np.zeros(len(at) + len(hot_at))
        c[at], p[at] = np.asarray(right.column("c")), np.asarray(right.column("log_p"))
        c[hot_places], p[hot_places] = hot.value[1][hot_at], hot.value[2][hot_at]
        kinds_p = with_word_arc(p, c, total, kinds)
        base = np.log10((c + 1) / (total + kinds + 1))
        ids, sizes, place = _unpack(block["ids"], "<i8"), _unpack(block["sizes"], "<i4"), _unpack(block["places"], _place_kind(len(c)))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda v: np.bincount(doc, weights=v[place], minlength=len(sizes))
        return pa.table(
            {
                "row": ids,
                "held_out": _unpack(block["train"], "u1") == 0,
                "n_tokens": sizes.astype(np.int64) + 1,
                "n_known": add(c > 0).astype(np.int64) + (ends > 0),
                "base_score": add(base) + np.log10((ends + 1) / (total + kinds + 1)),
                "score": (add(kinds_p) + end_p) / ln10,
                "piece_score": (add(p) + end_piece) / ln10,
            }
        )

    result = block_tokens(all_blocks, hot).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(back, "row long, held_out boolean, n_tokens long, n_known long, base_score double, score double, piece_score double")
    doc_id = F.when(F.col("row") != _NO_ID, F.col("row")).cast(docs.schema["doc_id"].dataType)
    return result.select(doc_id.alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", "piece_score")
