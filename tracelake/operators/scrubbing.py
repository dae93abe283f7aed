"""Names replaced in every text of a table in one pass, at any depth of its columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: home folders in paths.
HOME = r"/(?:Users|home)/[A-Za-z0-9._-]+"
JSON_STRING = re.compile(r'("(?:[^"\\]|\\.)*")(\s*:)?')


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay; what would grow stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Names:
    """Names with what stands for them, whatever the case; longer names first, then in order of the alphabet.

    Of names that meet in a text the longest is replaced, of equally long ones the first in the alphabet, then the one further left.
    With `again`, a replacement that holds shorter names is itself scrubbed of these, as if
    names were replaced one after the other.
    """

    def __init__(self, mapping: dict[str, str], home: str | None = "~", again: bool = True):
        first: dict[str, tuple[str, str]] = {}
        for name, other in sorted(mapping.items(), key=lambda m: (-len(m[0]), m[0])):
            if name:
                first.setdefault(_lower(name), (name, other))  # of names that differ in case the first
        self.home = home
        self._order = {low: i for i, low in enumerate(first)}
        self._others = [other for _, other in first.values()]
        self._lengths = [len(low) for low in first]
        self._words = ahocorasick.Automaton()
        for low, i in self._order.items():
            self._words.add_word(low, i)
        self._words.make_automaton()
        if again:
            for i in range(len(self._others) - 1, -1, -1):  # later ones are final by then
                self._others[i] = self._replaced(self._others[i], i + 1)

    def _replaced(self, text: str, since: int = 0) -> str:
        if not self._lengths or not text:
            return text
        met = sorted((i, end + 1 - self._lengths[i]) for end, i in self._words.iter(_lower(text)) if i >= since)
        if not met:
            return text
        taken, chosen = bytearray(len(text)), []
        for i, start in met:
            end = start + self._lengths[i]
            # shorter names come later, so one that meets a taken place touches it with an end
            if taken[start] or taken[end - 1]:
                continue
            taken[start:end] = b"\1" * (end - start)
            chosen.append((start, end, i))
        out, at = [], 0
        for start, end, i in sorted(chosen):
            out += (text[at:start], self._others[i])
            at = end
        return "".join([*out, text[at:]])

    def scrub(self, text: str | None) -> str | None:
        if not text:
            return text
        return self._replaced(re.sub(HOME, lambda _: self.home, text) if self.home is not None and "/" in text else text)


def _in_json(change: Callable[[str | None], str | None]) -> Callable[[str | None], str | None]:
    """The change applied to the strings of a JSON text; keys and numbers stay as they are written."""

    def value(found: re.Match) -> str:
        return found[0] if found[2] else json.dumps(change(json.loads(found[1])), ensure_ascii=False)

    return lambda text: text and JSON_STRING.sub(value, text)


def _walk(values: pa.Array, change: Callable[[str | None], str | None]) -> pa.Array:
    """The array with all its strings changed; keys of maps stay, as names of fields do."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        known = values.dictionary_encode()  # each text once
        fresh = pa.array([change(v) for v in known.dictionary.to_pylist()], kind)
        return pa.DictionaryArray.from_arrays(known.indices, fresh).cast(kind)
    if pa.types.is_struct(kind):
        parts = [_walk(values.field(i), change) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=values.is_null())
    if pa.types.is_map(kind) or pa.types.is_list(kind) or pa.types.is_large_list(kind):
        values = pa.concat_arrays([values, values.slice(0, 0)])  # offsets that start at 0
        if pa.types.is_map(kind):
            fresh = pa.MapArray.from_arrays(values.offsets, values.keys, _walk(values.items, change), type=kind, mask=values.is_null())
        else:
            fresh = type(values).from_arrays(values.offsets, _walk(values.values, change), type=kind, mask=values.is_null())
        return fresh
    return values


def _texts(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_texts(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _texts(kind.elementType)
    return _texts(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def scrub_table(table: DataFrame, mapping: dict[str, str], home: str | None = "~", again: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table with home folders and names replaced in all its strings, also in structs, arrays, values of maps and variants.

    `mapping` is the user's list of names; it goes to every task and so has to fit there.  Each
    text is read once, however many names there are.  Columns named in `keep`, keys of maps and variants and
    strings of bytes stay; null and empty texts too.  Differences from names replaced one after the other (`scrub`): a name that
    arises only where a replacement meets its neighbours is not replaced, and without `again` no
    replacement is; letters beyond ASCII match in either case.
    """
    kinds, order = {f.name: f.dataType for f in table.schema}, table.columns
    variants = [n for n, k in kinds.items() if isinstance(k, T.VariantType) and n not in keep]
    if variants:
        table = table.withColumns({n: F.to_json(n) for n in variants})
    sent = table.sparkSession.sparkContext.broadcast((dict(mapping), home, again))
    chosen = {f.name for f in table.schema if f.name not in keep and _texts(f.dataType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(*sent.value)  # once for a task
        for batch in batches:
            columns = [_walk(c, _in_json(names.scrub) if n in variants else names.scrub) if n in chosen else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = table.mapInArrow(run, table.schema)
    return out.withColumns({n: F.parse_json(n) for n in variants}).select(*(F.col(f"`{n}`") for n in order)) if variants else out
