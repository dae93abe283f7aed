"""Secrets in texts: three fixed shapes, and random strings that a token vocabulary spells inefficiently.

A byte-pair vocabulary learns what people write, so that a word or a name takes one
token for some four characters and a random string one for less than two.  Runs of
key characters are measured so, after known digests and identifiers are set aside.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.kernels import blocks, utf8

#: In the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: A random string has this many characters at least, and fewer characters a token than RATIO.
LEAST_RANDOM, RATIO = 20, 2.0
PART = 256

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_KEY_SIGN = np.zeros(256, bool)
_KEY_SIGN[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]] = True
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGESTS = {32, 40, 56, 64, 96, 128}
_DIGEST_TEXT = re.compile(rb"(?:sha1|sha224|sha256|sha384|sha512|md5)[-_=]", re.IGNORECASE)
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Names of code and paths: words, or a word and a number, between separators.
_NAME = re.compile(rb"[+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[A-Za-z][a-z]+[0-9]{1,4}|[0-9]{1,10})(?:[+/_=-]+|$))+")
_NUMBER = re.compile(rb"[0-9+/_=-]+")

SPANS = "array<struct<kind:string,start:long,end:long>>"


class TokenRatio:
    """Characters per token of a rank file."""

    def __init__(self, rank_file: str):
        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> float:
        """Long strings are measured in parts of PART characters."""
        return len(text) / sum(len(self.encoding.encode_ordinary(text[k : k + PART])) for k in range(0, len(text), PART))


@lru_cache(maxsize=2)
def token_ratio(rank_file: str) -> TokenRatio:
    return TokenRatio(rank_file)


def known(run: bytes) -> bool:
    """Whether a run of key characters is a digest, a number or an identifier and so no secret by itself."""
    bare = run.strip(b"+/_=-")
    if _UUID.fullmatch(bare) or _NUMBER.fullmatch(run) or _DIGEST_TEXT.match(bare):
        return True
    if re.fullmatch(rb"[0-9A-Fa-f]+", bare) and len(bare) in _DIGESTS:
        return True
    if _NAME.fullmatch(run):
        return True
    kinds = sum(bool(re.search(p, bare)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]"))
    return kinds < 2 or bool(re.fullmatch(rb"[A-Z]?[a-z]+", bare))


def base_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the three fixed shapes, in bytes; runs: the long runs of key characters."""
    out = []
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    for a, b in runs:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out)


def random_spans(text: bytes, runs: list[tuple[int, int]], base: list[tuple[int, int, int]], ratio: TokenRatio) -> list[tuple[int, int, int]]:
    """Runs that meet no base span, are not known and cost more than one token for RATIO characters."""
    taken = np.array([(a, b) for a, _, b in base], np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    out = []
    for a, b in runs:
        before = int(np.searchsorted(taken[:, 0], b))
        if before and ends[before - 1] > a or known(text[a:b]):
            continue
        if ratio(text[a:b].decode()) < RATIO:
            out.append((a, 3, b))
    return out


def _characters(text: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each of some places in bytes."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += len(text[at:place].decode())
        out[place], at = n, place
    return out


def secret_spans(docs: DataFrame, rank_file: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add the column `spans`: (kind, start, end) of every secret of whole texts, in code points, end exclusive.

    Sorted by start, then kind in the order of KINDS.  Spans of one base kind are the
    leftmost ones that don't overlap; a random string never overlaps a base span.  Null and empty texts
    have no spans.  All other columns, nulls, repeated rows and empty tables pass
    through; a column that is already called `spans` is replaced.  No shuffle.
    """
    docs = docs.drop(spans) if spans != text else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, T._parse_datatype_string(SPANS), False)])
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = token_ratio(rank_file)
        for whole in batches:
            found: list[list[dict]] = []
            data, offsets = utf8(whole.column(text))
            for a, b in blocks(offsets):
                found += _block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ratio)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(found, pa.list_(kind_of))], schema.names)

    return docs.mapInArrow(run, schema)


def _block(data: np.ndarray, offsets: np.ndarray, ratio: TokenRatio) -> list[list[dict]]:
    """Spans of texts that lie end to end."""
    cuts = np.flatnonzero(~_KEY_SIGN[data])
    first = np.union1d(cuts, offsets[:-1] - 1) + 1
    text_end = offsets[np.minimum(np.searchsorted(offsets, first, "right"), len(offsets) - 1)]
    last = np.minimum(np.append(cuts, len(data))[np.searchsorted(cuts, first)], text_end)
    keep = last - first >= LEAST_RANDOM
    first, last = first[keep], last[keep]
    of = np.searchsorted(offsets, first, "right") - 1
    bounds = np.searchsorted(of, np.arange(len(offsets)))
    out: list[list[dict]] = []
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        content = data[a:b].tobytes()
        runs = [(int(x) - a, int(y) - a) for x, y in zip(first[bounds[k] : bounds[k + 1]], last[bounds[k] : bounds[k + 1]], strict=True)]
        base = base_spans(content, runs)
        all_spans = sorted(base + random_spans(content, runs, base, ratio)) if runs else base
        at = _characters(content, [p for s, _, e in all_spans for p in (s, e)])
        out.append([{"kind": KINDS[n], "start": at[s], "end": at[e]} for s, n, e in all_spans])
    return out


def joined(spans: str, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of some kinds, joined with commas."""
    mine = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row of docs (doc_id, text).

    base_sha256 covers the three fixed kinds, spans lists all; both are written kind:start:end.
    Rows with null or repeated ids are kept as they are; other columns are ignored.
    """
    found = secret_spans(docs.select("doc_id", "text"), rank_file)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined("spans", BASE), 256).alias("base_sha256"), joined("spans").alias("spans"))
