"""Encoding and decoding with a SentencePiece BPE vocabulary.

No piece of the vocabulary has the space sign after another character, so merges
never leave a word (a run of space signs and what follows it).  A batch's distinct
words are laid end to end in one flat array of symbols.  Each round takes the
smallest pair rank of every word at once, merges the places of that rank from left
to right, up to the first whose new piece makes a pair of a better rank with a
neighbour, and compacts the array.  Words without a pair leave it.

A long word is first cut between characters that stand side by side in no piece: no
merge goes over such a place, so its parts merge apart, as words do.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.kernels import _powers, mix

SPACE = "▁"
CACHE_WORDS = 600_000
LONG_WORD = 48
_NONE = np.iinfo(np.int64).max


def _one_each(data: bytes, start: int, end: int) -> str:
    return "�" * (end - start)


class PieceTable:
    """Pieces, merge ranks and byte pieces of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
        score = np.array([model.get_score(i) for i in range(n)])
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(self.pieces[i][1:-1], 16)] = i
        ids = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece of this vocabulary goes over the start of a word")
        self.char_id = {p: i for p, i in ids.items() if len(p) == 1}
        self.touching = np.unique(np.array([ord(a) << 32 | ord(b) for p in ids for a, b in pairwise(p)], np.int64))
        _, rank = np.unique(-score, return_inverse=True)
        pairs, made = [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(a * n + b)
                    made.append(i)
        order = np.argsort(np.array(pairs, np.int64))
        self.n, self.rank = n, rank.astype(np.int64)
        self.pair, self.made = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]
        text = [self._bytes(model, i) for i in range(n)]
        self.piece_len = np.array([len(t) for t in text])
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.leading = np.array([p.startswith(SPACE) for p in self.pieces]) & self.normal
        self.control = np.array([model.is_control(i) for i in range(n)])
        self.forget()

    def _bytes(self, model, i: int) -> bytes:
        if model.is_control(i):
            return b""
        if model.is_unknown(i):
            return " ⁇ ".encode()
        if model.is_byte(i):
            return bytes([int(self.pieces[i][1:-1], 16)])
        return self.pieces[i].replace(SPACE, " ").encode()

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that a pair of symbols makes, or -1; a negative symbol is a character without a piece."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def merge_rounds(self, symbols: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge the words that start at `starts` until no pair is left; (words, symbols, lengths) in the order they finish."""
        done = []
        word = np.arange(len(starts))
        lengths = np.diff(np.append(starts, len(symbols)))
        while len(word):
            of = np.repeat(np.arange(len(word)), lengths)
            made = np.full(len(symbols), -1)
            inner = np.flatnonzero(of[:-1] == of[1:]) if len(symbols) > 1 else np.zeros(0, np.int64)
            made[inner] = self._merged(symbols[inner], symbols[inner + 1])
            rank = np.where(made >= 0, self.rank[made], _NONE)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            least = np.minimum.reduceat(rank, begin)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, lengths)
                done.append((word[over], symbols[gone], lengths[over]))
                symbols, made, rank = symbols[~gone], made[~gone], rank[~gone]
                word, lengths, least = word[~over], lengths[~over], least[~over]
                if not len(word):
                    break
                of = np.repeat(np.arange(len(word)), lengths)
            at = np.flatnonzero(rank == least[of])
            # a run of touching pairs merges at its first, third, ... place
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1] + 1
            head = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
            at = at[self._in_turn(symbols, made, at, of)]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lengths = lengths - np.bincount(of[at], minlength=len(word))
            symbols = symbols[keep]
        return done

    def _in_turn(self, symbols: np.ndarray, made: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which of the places can merge before any other pair of their word: those up to the first that makes a pair of its rank or a better one."""
        new, own = made[at], of[at]
        left, right = np.full(len(at), -1), np.full(len(at), -1)
        has = np.flatnonzero((at > 0) & (of[at - 1] == own))
        left[has] = symbols[at[has] - 1]
        after = np.flatnonzero((at[1:] == at[:-1] + 2) & (own[1:] == own[:-1])) + 1  # the place before has merged by then
        left[after] = new[after - 1]
        has = np.flatnonzero(at + 2 < len(symbols))
        has = has[of[at[has] + 2] == own[has]]
        right[has] = symbols[at[has] + 2]
        grown = [self._merged(left, new), self._merged(new, right)]
        better = np.zeros(len(at), bool)
        for piece in grown:
            better |= (piece >= 0) & (self.rank[piece] <= self.rank[new])
        before = np.cumsum(better) - better
        first = np.ones(len(at), bool)
        first[1:] = own[1:] != own[:-1]
        return before == np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(at))))

    def learn(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie end to end as code points, each with its leading space signs, and how many each word has."""
        kinds, back = np.unique(codes, return_inverse=True)
        symbols = np.array([self.char_id.get(chr(c), -1 - int(c)) for c in kinds], np.int64)[back]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        parts = self._parts(codes, starts, lengths)
        done = self.merge_rounds(symbols, parts)
        part, n = np.concatenate([d[0] for d in done]), np.concatenate([d[2] for d in done])
        ids = np.concatenate([d[1] for d in done])
        order = np.argsort(part)
        begin = (np.cumsum(n) - n)[order]
        n = n[order]
        ids = ids[np.arange(len(ids)) + np.repeat(begin - np.cumsum(n) + n, n)]
        per_word = np.add.reduceat(n, np.searchsorted(parts, starts))
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            signs, which = np.unique(-1 - ids[bare], return_inverse=True)
            raw = [self.byte_id[list(chr(c).encode("utf-8", "replace"))] for c in signs.tolist()]
            size = np.array([len(r) for r in raw])
            width = np.ones(len(ids), np.int64)
            width[bare] = size[which]
            word = np.repeat(np.arange(len(per_word)), per_word)
            per_word = np.bincount(word, weights=width, minlength=len(per_word)).astype(np.int64)
            first = np.cumsum(width) - width
            out = np.repeat(ids, width)
            at = np.repeat(first[bare], size[which]) + np.arange(int(size[which].sum())) - np.repeat(np.cumsum(size[which]) - size[which], size[which])
            out[at] = np.concatenate([raw[k] for k in which.tolist()])
            ids = out
        return ids, per_word

    def _parts(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Starts of the words, and of what follows each place in a long word that no piece goes over."""
        if lengths.max() <= LONG_WORD:
            return starts
        inside = np.flatnonzero(np.repeat(lengths > LONG_WORD, lengths)[:-1])
        pair = (codes[inside] << 32) | codes[inside + 1]
        at = np.minimum(np.searchsorted(self.touching, pair), len(self.touching) - 1)
        return np.union1d(starts, inside[self.touching[at] != pair] + 1)

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their offsets.

        A word is a run of space signs and what follows it; each text begins with one
        more.  Words are named by a 64-bit hash, and each kind is merged once.
        """
        if len(self.slot) > CACHE_WORDS:
            self.forget()
        full = [t for t in texts if t]
        codes = np.frombuffer(("".join([SPACE + t for t in full])).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes[codes == 32] = ord(SPACE)
        begin = np.cumsum([0, *(len(t) + 1 for t in full)])
        space = codes == ord(SPACE)
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[begin[:-1]] = True
        first = np.flatnonzero(opens)
        length = np.diff(np.append(first, len(codes)))
        up, down = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        kinds, at, back = np.unique(mix((sums[first + length] - sums[first]) * down[first] + length.astype(np.uint64)), return_index=True, return_inverse=True)
        names = kinds.tolist()
        new = np.array([k for k, name in enumerate(names) if name not in self.slot], np.int64)
        if len(new):
            size = length[at[new]]
            where = np.repeat(first[at[new]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            ids, per_word = self.learn(codes[where], size)
            self.slot.update(zip([names[k] for k in new.tolist()], range(len(self.ends) - 1, len(self.ends) - 1 + len(new)), strict=True))
            self.ends.frombytes((self.ends[-1] + np.cumsum(per_word)).astype(np.int64).tobytes())
            self.ids.frombytes(ids.astype(np.int32).tobytes())
        slot = np.array([self.slot[name] for name in names], np.int64)[back]
        ends = np.frombuffer(self.ends, np.int64)
        size = np.diff(ends)[slot] if len(slot) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(self.ids, np.int32)[np.arange(total[-1]) + np.repeat(ends[slot] - total[:-1], size)] if len(slot) else np.zeros(0, np.int32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        has = np.flatnonzero([bool(t) for t in texts])
        offsets[has + 1] = np.diff(total[np.searchsorted(first, begin)]) if len(has) else 0
        return ids, np.cumsum(offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists that lie end to end."""
        ids = ids.astype(np.int64)
        size = self.piece_len[ids]
        if len(ids):
            # the first piece that isn't a control sign loses the space that encoding puts before a text
            shown = np.flatnonzero(~self.control[ids])
            at = np.searchsorted(shown, offsets[:-1])
            ok = at < len(shown)
            first = shown[np.minimum(at, max(len(shown) - 1, 0))] if len(shown) else np.zeros(len(at), np.int64)
            first = first[ok & (first < offsets[1:])]
            first = first[self.leading[ids[first]]]
        else:
            first = np.zeros(0, np.int64)
        skip = np.zeros(len(ids), np.int64)
        skip[first] = 1
        take = size - skip
        ends = np.cumsum(take)
        source = np.repeat(self.piece_at[ids] + skip - (ends - take), take) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = self.piece_bytes[source].tobytes()
        cuts = np.concatenate([[0], ends])[offsets]
        return [raw[a:b].decode("utf-8", "piece-bytes") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def piece_table(model_file: str) -> PieceTable:
    import codecs

    codecs.register_error("piece-bytes", lambda e: (_one_each(e.object, e.start, e.end), e.end))
    return PieceTable(model_file)


def _slices(batch: pa.RecordBatch, size, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows' sizes add up to about `most`."""
    at = 0
    total = np.concatenate([[0], np.cumsum(size)])
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the column `ids` (array<int>): the piece ids of `text`, without begin or end ids.

    Null and empty texts have no ids.  Texts of any length are encoded whole; all
    other columns, nulls, repeated rows and empty tables pass through.  A column
    that is already called `ids` is replaced.  With `decoded`, a column of that name
    holds what the ids decode to, from the same pass.  No shuffle.
    """
    docs = docs.drop(ids, *([decoded] if decoded else []))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        added.append(T.StructField(decoded, T.StringType(), False))
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_file)
        for whole in batches:
            length = pc.fill_null(pc.binary_length(whole.column(text)), 0)
            for batch in _slices(whole, np.asarray(length), 1 << 20):
                flat, offsets = table.encode(batch.column(text).to_pylist())
                out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
                if decoded:
                    out.append(pa.array(table.decode(flat, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], schema.names)
        table.forget()  # workers live on for other stages

    return docs.mapInArrow(run, schema)


def decode_pieces(frame: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column `text`: what the lists of piece ids stand for; null and empty lists give ''.

    Byte pieces join to characters, a byte that fits none becomes U+FFFD.  A column
    that is already called `text` is replaced.  No shuffle.
    """
    frame = frame.drop(text)
    schema = T.StructType([*frame.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_file)
        for whole in batches:
            length = pc.fill_null(pc.list_value_length(whole.column(ids)), 0)
            for batch in _slices(whole, np.asarray(length), 1 << 18):
                lists = batch.column(ids)
                n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                flat = np.asarray(pc.list_flatten(lists)) if offsets[-1] else np.zeros(0, np.int32)
                out = pa.array(table.decode(flat, offsets), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, text])

    return frame.mapInArrow(run, schema)


def digests(docs: DataFrame, model_file: str, *keep: str) -> DataFrame:
    """Token count and digests of the encoded and decoded texts, one row per document."""
    coded = encode_pieces(docs.select(*keep, "text"), model_file, decoded="decoded")
    return coded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
