"""The stored index: what it reads, what it skips, how it grows."""

import random

from tracelake.operators import index as ix
from tracelake.plans import adapters as ad
from tracelake.plans.search_queries import index_terms


def corpus(spark, n=400, seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choices(words, [1 / (i + 1) for i in range(300)], k=draw.randrange(1, 120))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_a_changed_folder_gives_the_new_terms(spark, tmp_path):
    for words in ("alpha beta", "gamma delta"):
        spark.createDataFrame([(1, words, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert sorted(r["term"] for r in index_terms(spark, str(tmp_path)).collect()) == sorted(words.split())


def test_the_first_document_of_an_id_counts(spark):
    docs = spark.createDataFrame([(1, "a c c", 2), (1, "a b", 1), (2, "z", 1), (3, None, 1), (3, "late", 2)], "doc_id long, text string, ord int")
    assert rows(ix.build_index(docs).postings) == [("a", 1, 1), ("b", 1, 1), ("z", 2, 1)]
    assert rows(ix.build_index(docs.drop("ord")).docs)[0] == (1, 2)
    assert ix.build_index(docs.limit(0)).postings.count() == 0


def test_a_search_opens_only_the_files_of_its_terms(spark):
    index = ix.build_index(corpus(spark), bucket=1500)
    blocks = index.segments[0].table("blocks")
    assert len(blocks.inputFiles()) > 2
    few = index.blocks(spark.createDataFrame([("w299",)], "term string"))
    assert "PartitionFilters: [isnotnull(bucket" in few._jdf.queryExecution().executedPlan().toString()
    assert len({r["bucket"] for r in few.select("bucket").distinct().collect()}) < len({r["bucket"] for r in blocks.select("bucket").distinct().collect()})
    assert few.where("term = 'w299'").count() == blocks.where("term = 'w299'").count()
    assert index.blocks(spark.createDataFrame([("zzz",)], "term string")).count() == 0


def test_skipping_blocks_changes_no_hit(spark, monkeypatch):
    docs = corpus(spark, 3000)
    index = ix.build_index(docs, bucket=5000)
    asked = spark.createDataFrame([(1, "w9 w299"), (2, "w5 w6 w7"), (3, "w250"), (4, "nothing"), (5, "w1 w1 w40")], "query_id long, query string")
    terms = ix.query_terms(asked)
    for n in (1, 5, 200, 5000):
        plain = ix.rank_hits(ix.bm25(index, terms), n).select("query_id", "doc_id", "score", "rank")
        assert rows(ix.bm25_top(index, terms, n).select("query_id", "doc_id", "score", "rank")) == rows(plain)


def test_segments_count_as_one_index(spark):
    docs = corpus(spark)
    whole, grown = ix.build_index(docs), ix.build_index(docs.where("doc_id < 50"))
    for end in (90, 91, 200, 400):
        grown = ix.update_index(grown, docs.where(f"doc_id < {end}"), most=3)
        assert len(grown.segments) <= 3
    assert rows(grown.postings) == rows(whole.postings) and rows(grown.terms) == rows(whole.terms) and rows(grown.corpus) == rows(whole.corpus)
    terms = ix.query_terms(spark.createDataFrame([(1, "w20 w30"), (2, "w4")], "query_id long, query string"))
    assert rows(ix.bm25_top(grown, terms, 7)) == rows(ix.bm25_top(whole, terms, 7))


def test_adding_documents_reads_only_the_documents_table(spark):
    index = ix.build_index(corpus(spark, 2000))
    plan = corpus(spark, 10).join(index.docs.select("doc_id"), "doc_id", "left_anti")
    assert all("/docs/" in f for f in plan.inputFiles())
    size = lambda files: sum(n for _, n, _ in files)
    from tracelake.sources.tables import file_state

    assert size(file_state(index.segments[0].table("docs"))) < 0.05 * size(file_state(index.segments[0].table("blocks"))) + 4096


def test_the_adapter_keeps_an_index_while_nothing_changes(spark, sf_dir):
    assert ad.index(spark, sf_dir) is ad.index(spark, sf_dir)


def test_a_task_cuts_words_as_a_column_does(spark):
    from pyspark.sql import functions as F

    from tracelake.functions.text import tokenize, words_of

    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000), 0x1D400, 0x1F600, 0x1E900)]
    texts = ["a" + "b".join(chars[at : at + 500]) + "Z9" for at in range(0, len(chars), 500)] + ["", "É́tİ K9 ǅx ß"]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokenize(F.col("text")).alias("tokens")).collect():
        assert words_of(r["text"]) == r["tokens"]


def test_only_the_first_of_a_shard_leave_it(spark, monkeypatch):
    monkeypatch.setattr(ix, "SHARD", 100, raising=False)
    monkeypatch.setattr(ix, "QUERIES", 2, raising=False)
    docs = corpus(spark, 600).unionByName(spark.createDataFrame([(1000 + i, "w200 w201 w202") for i in range(300)], "doc_id long, text string"))
    index = ix.build_index(docs, bucket=2000)
    shards = index.segments[0].table("blocks").groupBy("doc_ids").agg({"shard": "min"}).select("min(shard)").distinct().count()
    assert shards >= 9
    asked = spark.createDataFrame([(str(q), " ".join(f"w{20 * q + i}" for i in range(1, 14))) for q in range(1, 11)], "query_id string, query string")
    terms = ix.query_terms(asked)
    weighed = ix._weighed(index, terms)
    assert ix._scores(weighed, index.blocks(terms.select("term").distinct()), ix.K1, ix.B, 3).count() <= shards * 10 * 3
    plain = ix.rank_hits(ix._sums(weighed.join(index.blocks(terms.select("term").distinct()), "term"), ix.K1, ix.B), 3)
    assert rows(ix.bm25_top(index, terms, 3)) == rows(plain)


def test_packed_postings_are_those_of_each_document(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(ix, "FLUSH", 500)
    docs = corpus(spark, 300).selectExpr("concat('d', doc_id) AS doc_id", "text")
    expected = sorted((t, r["doc_id"], n) for r in docs.collect() for t, n in Counter(r["text"].split()).items())
    index = ix.build_index(docs)
    assert rows(index.postings) == expected
    assert rows(index.docs) == sorted((r["doc_id"], len(r["text"].split())) for r in docs.collect())
    assert rows(index.terms) == sorted(Counter(t for t, _, _ in expected).items())
    assert rows(ix.postings(docs).select("term", "doc_id", "tf")) == expected


def test_coterms_are_counted_in_shards(spark, monkeypatch):
    import math
    import re
    from collections import Counter

    for name, value in (("SHARD", 100), ("TOGETHER", 2000), ("LEADS", 12)):
        monkeypatch.setattr(ix, name, value, raising=False)
    docs = corpus(spark, 700).selectExpr("doc_id", "regexp_replace(text, 'w', 'wx') AS text").unionByName(spark.createDataFrame([(1000, "wx3 lone lone wx250"), (1001, "")], "doc_id long, text string"))
    index = ix.update_index(ix.build_index(docs.where("doc_id < 500")), docs)  # two segments
    asked = ["wx0", "wx7", "wx250", "lone", "nowhere"]
    texts = [Counter(r["text"].split()) for r in docs.collect() if r["text"]]
    df, expected = Counter(t for c in texts for t in c), []
    for word in asked:
        co = sum((c for c in texts if word in c), Counter())
        scored = [(round(n / math.log2(df[t] + 1), 5), t, n) for t, n in co.items() if t != word and 1 < df[t] < len(texts) * 0.3]
        expected += [(word, t, n, s, i + 1) for i, (s, t, n) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:6])]
    keywords = spark.createDataFrame([(w,) for w in [*asked, "WX-7", None]], "keyword string")
    left, whole = [], ix._together
    monkeypatch.setattr(ix, "_together", lambda a, b, parts: left.append((whole(a, b, parts), parts)) or left[-1][0])
    found = ix.coterms(index, keywords, share=0.3)
    assert rows(found) == sorted(expected) and len(expected) > 12
    assert not re.search(r"Join \[doc_id", found._jdf.queryExecution().executedPlan().toString())
    assert left[-1][1] > 1
    assert left[-1][0].count() < 0.5 * sum(sum(1 < df[t] < len(texts) * 0.3 and t != w for t in c) for w in asked for c in texts if w in c)


def test_cutting_words_looks_at_unplain_characters_alone(monkeypatch):
    from tracelake.functions import text as tx

    read = []

    class Letters(dict):
        def __missing__(self, code):
            read.append(code)
            raise LookupError(code)

    letters = Letters(tx._letters())
    monkeypatch.setattr(tx, "_letters", lambda: letters)
    assert tx.words_of("Plain WORDS, a café 中2 İK9 étK") == ["plain", "words", "a", "cafe", "2", "ik9", "etk"]
    assert all(code > 127 for code in read)
