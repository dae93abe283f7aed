"""Column functions on text: folding, tokens, searchable and display text, scrubbing, entities."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH_FIELDS = ("summary", "description", "display", "prompt", "url", "query", "title")
SEARCH_FIELDS_CLI = ("summary", "description", "prompt", "url", "query", "event_id", "milestone", "cwd")
FALLBACK_FIELDS = ("event_id", "milestone")
WORD_CUT, NOT_ASCII = "[^a-z0-9]+", re.compile("[^\x00-\x7f]+")
#: Bytes of a token as they are, all others as spaces.
TOKEN_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
# Patterns of ids, file names, versions and fetch summaries that logs and queries carry.
EVENT_ID = r"((?:evt-|git-)[a-z0-9]+)"
FILE_NAME = r"([/A-Za-z0-9_.-]+\.[a-zA-Z0-9]{1,8})"
VERSION = r"^[0-9].*\.[0-9]"
FETCHED = r"^(?:Fetched|Search):\s*(https?://\S+)"


@lru_cache
def fold_table() -> tuple[str, str]:
    """Characters whose decomposition is an ASCII letter or digit and marks U+0300-036F, and those letters.

    The marks themselves follow without a partner, so `translate` drops them.
    """
    marks = [chr(c) for c in range(0x300, 0x370)]
    found = []
    for c in map(chr, range(0x80, 0x10000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if x not in marks)
        if len(base) == 1 and base.isascii() and base.isalnum():
            found.append((c, base))
    return "".join(c for c, _ in found) + "".join(marks), "".join(b for _, b in found)


def fold(text: Column) -> Column:
    """Lower-case text without accents."""
    return F.lower(F.translate(text, *fold_table()))


def tokenize(text: Column, folded: bool = True, keep_empty: bool = False) -> Column:
    """Runs of a-z and 0-9; `keep_empty` keeps what splitting leaves at the ends, as the command-line dialect counts it."""
    parts = F.split(fold(text) if folded else F.lower(text), WORD_CUT)
    return parts if keep_empty else F.filter(parts, lambda t: t != "")


@lru_cache
def _letters() -> dict[int, str | None]:
    marked, plain = fold_table()
    return {ord(c): plain[i] if i < len(plain) else None for i, c in enumerate(marked)}


def words_of(text: str) -> list[str]:
    """The tokens of `tokenize` for one text, inside a task."""
    letters = _letters()
    plain = text if text.isascii() else NOT_ASCII.sub(lambda m: m[0].translate(letters), text)
    return plain.lower().encode("ascii", "replace").translate(TOKEN_BYTES).decode("ascii").split()


def present(name: str, columns) -> Column:
    """The column, or null where it is empty or the frame lacks it."""
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit(None).cast("string")


def search_text(columns, dialect: str = "server") -> Column:
    """Searchable text of an event: its text fields, else its id or milestone."""
    fields = SEARCH_FIELDS if dialect == "server" else SEARCH_FIELDS_CLI
    joined = F.nullif(F.concat_ws(" ", *[present(f, columns) for f in fields]), F.lit(""))
    return F.coalesce(joined, *[present(f, columns) for f in FALLBACK_FIELDS], F.lit(""))


def embedding_text(columns, words: int = 200) -> Column:
    """Text to embed: fields joined by bars, its first `words` words."""
    tag = lambda prefix, name: F.concat(F.lit(prefix), present(name, columns))
    parts = [present("summary", columns), present("description", columns), present("url", columns), tag("Search: ", "query"), present("prompt", columns), present("title", columns), tag("project: ", "project")]
    return F.array_join(F.slice(F.split(F.concat_ws(" | ", *parts), r"\s+"), 1, words), " ")


def short_url(url: Column, keep: int = 50) -> Column:
    """Host and the first `keep` characters of the path; the url itself where it has no host."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    return F.coalesce(F.concat(host, F.when(F.length(path) > keep, F.concat(F.substring(path, 1, keep), F.lit("..."))).otherwise(path)), url)


def display_text(columns) -> Column:
    """Headline of an event: the most telling of its fields; fetched urls are shortened."""
    summary = present("summary", columns)
    fetched = F.nullif(F.regexp_extract(summary, FETCHED, 1), F.lit(""))
    own = F.coalesce(F.when(fetched.isNotNull(), short_url(fetched)), summary)
    first = [present(c, columns) for c in ("prompt", "query", "title", "description", "display")]
    return F.coalesce(*first, own, short_url(present("url", columns)), present("event_id", columns), F.lit(""))


def session_line(columns, keep: int = 120) -> Column:
    return F.substring(F.coalesce(*[present(c, columns) for c in ("summary", "display", "description")], F.lit("")), 1, keep)


def scrub(text: Column, mapping: dict[str, str], home: str = "~") -> Column:
    """Replace home folders and the names of `mapping`, longest first, whatever their case."""
    out = F.regexp_replace(text, r"/(?:Users|home)/[A-Za-z0-9._-]+", home)
    for name in sorted(mapping, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, "(?i)" + re.escape(name), mapping[name].replace("\\", "\\\\").replace("$", "\\$"))
    return out


def query_entities(query: Column) -> Column:
    """Event ids and file names in a query; versions, *.md and names that end in a dot are left out."""
    ids = F.regexp_extract_all(query, F.lit(EVENT_ID), F.lit(1))
    paths = F.regexp_extract_all(query, F.lit(FILE_NAME), F.lit(1))
    real = F.filter(paths, lambda p: ~p.rlike(VERSION) & ~p.endswith(".md") & ~p.endswith("."))
    return F.array_distinct(F.concat(ids, real))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; null counts 0."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def project_from_cwd(cwd: Column, root: str) -> Column:
    """First folder below `root`, else ''."""
    return F.regexp_extract(cwd, "^" + re.escape(root.rstrip("/")) + "/([^/]+)", 1)
