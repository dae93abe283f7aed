"""Names replaced in one pass, against names replaced one after the other."""

import json
import random
import re
import string
import time

from pyspark.sql import functions as F

from tracelake.functions.text import scrub
from tracelake.operators import index as ix
from tracelake.operators.scrubbing import Names, scrub_table


def one_after_the_other(text, mapping, home="~"):
    text = re.sub(r"/(?:Users|home)/[A-Za-z0-9._-]+", home, text)
    for name in sorted(mapping, key=lambda n: (-len(n), n)):
        text = re.sub(re.escape(name), lambda _: mapping[name], text, flags=re.I)
    return text


def test_equals_names_replaced_in_turn():
    """Overlaps, names within names and cases; replacements in letters that no name has, so none arises at their borders."""
    rnd = random.Random(5)
    for _ in range(400):
        mapping = {"".join(rnd.choice("abAB") for _ in range(rnd.randint(1, 4))): rnd.choice(["X", "", "YZ", "\\1$"]) for _ in range(rnd.randint(1, 6))}
        unlike = {}
        for name in sorted(mapping):
            if name.lower() not in {n.lower() for n in unlike}:
                unlike[name] = mapping[name] or "W"
        text = "".join(rnd.choice("abAB -") for _ in range(40))
        assert Names(unlike).scrub(text) == one_after_the_other(text, unlike)


def test_replacements_are_scrubbed_again():
    chain = {"acme-two": "the beta", "beta": "gamma", "gammarus": "z"}
    assert Names(chain).scrub("Acme-Two, BETA /home/me/x") == one_after_the_other("Acme-Two, BETA /home/me/x", chain) == "the gamma, gamma ~/x"
    assert Names(chain, again=False).scrub("Acme-Two") == "the beta"
    assert Names({}).scrub("/Users/a.b/c") == "~/c" and Names({"x": "y"}, home=None).scrub("/home/x") == "/home/y"
    assert Names({"straße": "road", "i": "j"}).scrub("STRAßE İi") == "road İj"


def test_all_strings_at_any_depth(spark):
    kind = "id long, text string, s struct<a:string,b:array<string>,n:int>, m map<string,string>, deep array<struct<x:map<string,array<string>>>>, raw binary, own string"
    rows = [
        (1, "acme", ("an Acme", ["ACME", None, ""], 3), {"acme": "acme", "k": None}, [({"acme": ["x acme"]},), None], b"acme", "acme"),
        (2, None, None, None, None, None, None),
        (3, "", (None, None, None), {}, [], b"", ""),
    ]
    table = spark.createDataFrame(rows, kind).repartition(1).sortWithinPartitions("id").withColumn("v", F.parse_json(F.lit('{"acme": ["Acme \\\\ \\"x\\"", 1]}')))
    got = scrub_table(table, {"acme": "zed", "x": 'say "y"'}, keep=("own",))
    assert got.columns == table.columns and got.schema.simpleString() == table.schema.simpleString()
    a, b, c = got.withColumn("v", F.to_json("v")).orderBy("id").collect()
    assert tuple(a)[:2] == (1, "zed") and (a["s"]["a"], a["s"]["b"], a["s"]["n"]) == ("an zed", ["zed", None, ""], 3)
    assert a["m"] == {"acme": "zed", "k": None} and a["deep"][0]["x"] == {"acme": ['say "y" zed']} and a["deep"][1] is None
    assert bytes(a["raw"]) == b"acme" and a["own"] == "acme" and json.loads(a["v"]) == {"acme": ['zed \\ "say "y""', 1]}
    assert tuple(b)[:7] == rows[1] and (c["text"], c["m"], c["deep"]) == ("", {}, [])
    assert scrub_table(table.limit(0), {"acme": "zed"}).count() == 0


def test_ten_thousand_names_in_one_pass(spark, sf_dir):
    rnd = random.Random(1)
    names = {"".join(rnd.choice(string.ascii_lowercase) for _ in range(9)): f"N{i}" for i in range(10_000)}
    few = {"the": "yy", "tion": "xxx"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: r["text"] for r in docs.select("doc_id", scrub(F.col("text"), few).alias("text")).collect()}
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in scrub_table(docs, names | few).collect()}
    assert got == want and time.time() - began < 60


def test_scan_equals_contains(spark):
    """Ids and needles that repeat, needles within needles, beyond the automaton's heads, in several scans."""
    long = "ab" * ix.HEAD
    docs = spark.createDataFrame([(1, "s", "Xyz " + long + "c"), (2, "s", long + "d"), (3, "t", None), (4, "t", ""), (5, "t", "É xyz")], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(1, long.upper() + "C"), (2, "xyz"), (3, "yz"), (4, ""), (5, None), (6, "é"), (7, "xyz"), (8, long)], "query_id long, query string")
    want = {(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (8, 2), (2, 5), (3, 5), (6, 5), (7, 5)}
    for block in (ix.NEEDLES, 500):
        assert {(r["query_id"], r["doc_id"]) for r in ix.substring_scan(docs, asked, None, block=block).collect()} == want
    assert {(r["query_id"], r["rank"]) for r in ix.substring_scan(docs, asked, 1).where("source = 's'").collect()} == {(q, 1) for q in (1, 2, 3, 7, 8)}
    assert ix.substring_scan(docs, asked.limit(0)).count() == ix.substring_scan(docs.limit(0), asked).count() == 0
