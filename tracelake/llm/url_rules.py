"""URL filtering by explicit host rules and mined association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE = 0.005, 20, 0.4


def host_of(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, A-Z lower-cased; '' without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: parts of its host, path and query, marked by where they stand; digits become 0."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    shape = lambda c: F.regexp_replace(F.translate(c, UPPER, LOWER), "[0-9]+", "0")
    parts = lambda mark, c, cut: F.transform(F.filter(F.split(c, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    scheme = F.transform(F.filter(F.array(F.regexp_extract(url, "^([A-Za-z]+)://", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("s:"), F.lower(x)))
    tokens = F.concat(scheme, parts("h:", shape(host), r"\."), parts("w:", F.regexp_replace(shape(host), r"(^|\.)[^.-]*(?=\.|$)", "."), r"[.-]+"), parts("p:", shape(path), r"[/.]"), parts("q:", shape(query), "[&]"))
    return F.coalesce(F.array_distinct(tokens), F.array().cast("array<string>"))


def _labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, tokens, bad) of the pages with tokens and a label: page_id = doc_id, bad is quality 0 or toxic 1 in any label."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int")).alias("bad"))
    known = pages.select(F.col("page_id").alias("doc_id"), url_tokens(F.col("url")).alias("tokens")).where(F.size("tokens") > 0).join(bad, "doc_id")
    return known.select(F.monotonically_increasing_id().alias("page"), "tokens", "bad")


def token_classes(known: DataFrame) -> DataFrame:
    """(token, class): tokens that stand in exactly the same labelled pages share a class, named by the smallest of them.

    Two 64-bit sums of page hashes name a set of pages.
    """
    each = known.select("page", F.explode("tokens").alias("token"))
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), "page").cast("decimal(20,0)")).alias(f"h{salt}")
    sets = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), total(1), total(2))
    names = sets.groupBy("n", "h1", "h2").agg(F.min("token").alias("class"), F.collect_list("token").alias("tokens"))  # tokens of one page set: as many as its urls hold
    return names.select(F.explode("tokens").alias("token"), "class")


def mine_classes(known: DataFrame, classes: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(classes, confidence, support, key): combinations of token classes that go with bad pages.

    FP-growth runs over the classes of each page and the sign of bad pages.  A rule
    with a smaller rule of at least its confidence inside it is pruned: from size to
    size, each set takes over the best confidence of the sets that lack one of its
    members.  `key` is the rule's rarest class, under which it is indexed.
    """
    spark = known.sparkSession
    own = known.select("page", "bad", F.explode("tokens").alias("token")).join(classes, "token").groupBy("page", "bad").agg(F.collect_set("class").alias("items"))
    items = stored(own.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "items")
    n = items.count()
    if not n:
        return spark.createDataFrame([], "classes array<string>, confidence double, support double, key string")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_PAGES / n)), minConfidence=min_confidence).fit(items)
    frequent = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_bad = frequent.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("classes"), F.col("freq").alias("hits"))
    sets = stored(with_bad.join(frequent.withColumnRenamed("items", "classes"), "classes").select("classes", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / n).alias("support")), "rule-sets")
    longest = sets.agg(F.coalesce(F.max(F.size("classes")), F.lit(0)).alias("n")).first()["n"]
    best, kept = None, None
    for size in range(1, longest + 1):
        mine = sets.where(F.size("classes") == size)
        if best is None:
            level = mine.withColumn("inner", F.lit(0.0))
        else:
            parts = mine.select("classes", F.explode(F.transform("classes", lambda c: F.array_remove("classes", c))).alias("part"))
            inner = parts.join(best.select(F.col("classes").alias("part"), "best"), "part").groupBy("classes").agg(F.max("best").alias("inner"))
            level = mine.join(inner, "classes")
        level = stored(level.withColumn("best", F.greatest("inner", "confidence")), "rule-level")
        best, rules = level, level.where((F.col("confidence") >= min_confidence) & (F.col("inner") < F.col("confidence")))
        kept = rules if kept is None else kept.unionByName(rules)
    if kept is None:
        return spark.createDataFrame([], "classes array<string>, confidence double, support double, key string")
    single = frequent.where(F.size("items") == 1).select(F.element_at("items", 1).alias("class"), "freq")
    each = kept.select("classes", "confidence", "support", F.explode("classes").alias("class")).join(single, "class")
    return each.groupBy("classes", "confidence", "support").agg(F.min_by("class", F.struct("freq", "class")).alias("key"))


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, confidence, support): the mined rules written out in tokens, one for each choice of a token from each class.

    For display; `judge_urls` matches classes.  Support is MIN_PAGES labelled pages at least.
    """
    known = stored(_labelled(pages, labels), "labelled-pages")
    classes = stored(token_classes(known), "token-classes")
    rules = mine_classes(known, classes, min_support, min_confidence)
    members = classes.groupBy("class").agg(F.collect_list("token").alias("members"))
    each = rules.select("classes", "confidence", "support", F.explode("classes").alias("class")).join(members, "class").groupBy("classes", "confidence", "support").agg(F.collect_list("members").alias("choices"))
    grown = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda done, choice: F.flatten(F.transform(done, lambda d: F.transform(choice, lambda t: F.concat(d, F.array(t))))))
    return each.select(F.explode(grown).alias("tokens"), "confidence", "support").select(F.array_sort("tokens").alias("tokens"), "confidence", "support")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=HOST_RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every row of `pages`.

    The longest explicit rule decides; without one, a page is blocked if a mined rule
    holds for its url, that is, if the url has a token of each of the rule's classes;
    else it is allowed.  `mined` is the most confident mined rule, of equals the last by
    its classes, null if none holds.
    Null urls and urls without :// have empty host and path and no tokens, and are
    allowed.  Repeated rows are judged alike, null page ids pass and have no label;
    labels that are null don't make a page bad; other columns of the tables are
    ignored; without labelled pages nothing is mined; an empty table gives no rows.
    """
    url = F.col("url")
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    own = pages.select("page_id", F.xxhash64("url").alias("u1"), F.xxhash64(F.lit("second"), "url").alias("u2"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens")).withColumns({"rule": rule, "given": verdict})
    known = stored(_labelled(pages, labels), "labelled-pages")
    classes = stored(token_classes(known), "token-classes")
    mined = stored(mine_classes(known, classes, min_support, min_confidence), "rules")
    used = classes.join(mined.select(F.explode("classes").alias("class")).distinct(), "class", "left_semi")
    # a url is carried as two hashes: its tokens are as many as it is long
    held = (
        own.where(F.col("given").isNull() & (F.size("tokens") > 0))
        .select("u1", "u2", F.explode("tokens").alias("token"))
        .distinct()
        .join(used, "token")
        .groupBy("u1", "u2")
        .agg(F.collect_set("class").alias("has"))
    )
    met = (
        held.withColumn("key", F.explode("has"))
        .join(mined, "key")
        .where(F.size(F.array_except("classes", "has")) == 0)
        .groupBy("u1", "u2")
        .agg(F.max(F.struct("confidence", F.array_join("classes", " ").alias("mined"))).alias("best"))
    )
    out = own.drop("tokens").join(met, ["u1", "u2"], "left")
    blocked = F.when(F.col("given").isNull() & F.col("best").isNotNull(), "block").otherwise("allow")
    shown = lambda c: F.when(F.col("given").isNull(), F.col(f"best.{c}"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", blocked).alias("verdict"), shown("mined").alias("mined"), shown("confidence").alias("confidence"))
