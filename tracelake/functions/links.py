"""Links from events to transcripts and messages, and filters by project."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the scheme of links that logs hold.
SCHEME = "claude-history://session/"


def build_link(path: Column) -> Column:
    """Link to a transcript, percent-encoded."""
    return F.when(path != "", F.concat(F.lit(SCHEME), F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))))


def link_path(link: Column) -> Column:
    """Transcript path of a link; null where it is none."""
    body = F.regexp_extract(link, "^" + re.escape(SCHEME) + r"([^?#]+)", 1)
    return F.try_url_decode(F.nullif(body, F.lit("")))


def link_message(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, r"[?&#]uuid=([^&#]+)", 1), F.lit(""))


def resolve_links(events: DataFrame, transcripts: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Add path, message_uuid, stale and link to events (deeplink, transcript_path).

    `transcripts` has transcript_path, `entries` uuid and message_ordinal.  A link is
    stale if its transcript is gone; events without a link get one.
    """
    out = events.withColumn("path", F.coalesce(link_path(F.col("deeplink")), F.nullif("transcript_path", F.lit("")))).withColumn("message_uuid", link_message(F.col("deeplink")))
    known = transcripts.select(F.col("transcript_path").alias("path"), F.lit(True).alias("there")).distinct()
    out = out.join(known, "path", "left").withColumn("stale", F.col("path").isNotNull() & F.col("there").isNull()).drop("there")
    out = out.withColumn("link", F.coalesce(F.nullif("deeplink", F.lit("")), build_link(F.col("path"))))
    if entries is not None:
        out = out.join(entries.select(F.col("uuid").alias("message_uuid"), F.col("ordinal").alias("message_ordinal")), "message_uuid", "left")
    return out


def project_filter(events: DataFrame, project: str | DataFrame, mode: str = "substring", column: str = "project") -> DataFrame:
    """Events of a project: `substring`, `regex` (both whatever the case), `exact`, or `alias` with a frame of projects."""
    c = F.col(column)
    if mode == "alias":
        return events.join(project.select(F.col("project").alias(column)).distinct(), column, "left_semi")
    if mode == "regex":
        return events.where(c.rlike("(?i)" + project))
    return events.where(c == project) if mode == "exact" else events.where(F.contains(F.lower(c), F.lit(project.lower())))


def expand_alias(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each project of a query's alias; an unknown alias stays as it is."""
    named = registry.select("alias", F.col("project").alias("member"))
    return queries.join(named, queries["project"] == named["alias"], "left").withColumn("project", F.coalesce("member", "project")).drop("alias", "member")
