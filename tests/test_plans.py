"""Plan shapes against brute force, with every group oversized or skewed."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from fleetlens.plans.adjacent import hot_keys, next_row, previous_row
from fleetlens.plans.fixpoint import closure, shared_folder, subtree_sizes
from fleetlens.plans.listing import listed
from fleetlens.plans.nesting import nest
from fleetlens.plans.patterns import match_patterns
from fleetlens.plans.ranking import numbered


def timeline(spark, seed=1, n=400):
    """One key holds most rows; gaps span days, bursts share a second."""
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    data, at = [], start
    for seq in range(n):
        at += r.choice([timedelta(0), timedelta(seconds=1), timedelta(minutes=3), timedelta(days=2)])
        data.append((r.choice(["hot"] * 5 + ["a", "b"]), at, seq, r.randint(0, 9)))
    return spark.createDataFrame(data, "k string, ts timestamp, seq long, v int").repartition(5)


@pytest.mark.parametrize("hot_rows", [0, 100, 10_000])
@pytest.mark.parametrize("levels", [[], ["DAY"], ["MINUTE", "DAY"], ["SECOND", "HOUR", "MONTH"]])
def test_neighbours_equal_plain_window(spark, levels, hot_rows):
    df = timeline(spark)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("n", F.lead("v").over(w))
    got = next_row(
        previous_row(df, ["k"], "ts", ["ts", "seq"], ["v"], levels=levels, hot_rows=hot_rows),
        ["k"], "ts", ["ts", "seq"], ["v"], levels=levels, hot_rows=hot_rows,
    ).select("k", "ts", "seq", "v", F.col("previous.v").alias("p"), F.col("next.v").alias("n"))
    assert rows(got) == rows(want.select(*got.columns))


def test_neighbours_do_not_depend_on_partitioning(spark):
    few, many = timeline(spark).repartition(2), timeline(spark).repartition(50)
    a = previous_row(few, ["k"], "ts", ["ts", "seq"], ["v"], hot_rows=50)
    b = previous_row(many, ["k"], "ts", ["ts", "seq"], ["v"], hot_rows=50)
    assert rows(a, "k", "seq", "previous.v") == rows(b, "k", "seq", "previous.v")


def test_hot_keys_are_few_whatever_the_data(spark):
    df = timeline(spark)
    assert rows(hot_keys(df, ["k"], hot_rows=100), "k") == [("hot",)]
    assert hot_keys(df, ["k"]).count() == 0


def test_sizing_does_not_change_the_result(spark):
    df = timeline(spark)
    other = spark.createDataFrame([("a",)] * 20, "k string")
    a = previous_row(df, ["k"], "ts", ["ts", "seq"], ["v"], sizing=other, hot_rows=5)
    b = previous_row(df, ["k"], "ts", ["ts", "seq"], ["v"])
    assert rows(a, "k", "seq", "previous.v") == rows(b, "k", "seq", "previous.v")


def test_listing_has_one_shape_at_every_size(spark):
    data = [("hot", "same")] * 5000 + [("hot", f"t{n}") for n in range(40)] + [("cold", "x"), ("cold", None)]
    df = spark.createDataFrame(data, "k string, t string")
    out = listed(df, ["k"], {"line": "t"}, totals=lambda n: [F.sum(n).alias("all")])
    want = [("hot", "same", 5000, 5040), *[("hot", f"t{n}", 1, 5040) for n in range(40)], ("cold", "x", 1, 2), ("cold", None, 1, 2)]
    assert rows(out, "k", "line", "copies", "all") == sorted(want, key=repr)
    assert rows(listed(df.filter("k = 'cold'"), ["k"], {"line": "t"})) == sorted([("cold", "x", 1), ("cold", None, 1)], key=repr)


def test_nesting_gives_a_row_per_child_and_keeps_childless_parents(spark):
    parent = spark.createDataFrame([("hot", 1), ("none", 2)], "k string, p int")
    a = spark.createDataFrame([("hot", n) for n in range(1001)] + [("no parent", 1)], "k string, n int")
    b = spark.createDataFrame([("hot", None), ("hot", "s"), ("hot", "s")], "k string, s string")
    out = rows(nest(parent, ["k"], {"a": (a, ["n"]), "b": (b, ["s"])}), "k", "p", "kind", "item")
    want = [("hot", 1, None, None), ("none", 2, None, None), *[("hot", None, "a", f'{{"n":{n}}}') for n in range(1001)]]
    want += [("hot", None, "b", '{"s":null}')] + [("hot", None, "b", '{"s":"s"}')] * 2
    assert out == sorted(want, key=repr)


def like(text, pattern):
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "[" and "]" in pattern[i + 1:]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1:end]
            out += f"[{re.escape(body)}]" if body in ("%", "_", "[") else f"[{body}]"
            i = end
        else:
            out += {"%": ".*", "_": "."}.get(ch, re.escape(ch))
        i += 1
    return re.fullmatch(out, text, re.I | re.S) is not None


def test_patterns_equal_brute_force(spark):
    names = ["Cache Hit Ratio", "cache miss", "100% used", "a_b", "axb", "a.b", "Page reads/sec", "x[1]", "", "^x"]
    patterns = ["cache%", "%ratio", "%[%]%", "a[_]b", "a_b", "a.b", "page reads/sec", "%", "[a-c]%", "x[[]1]", "^x", "%[^a-z]%"]
    n = spark.createDataFrame([("i", x) for x in names], "k string, name string")
    p = spark.createDataFrame([("i", x) for x in patterns], "k string, pattern string")
    got = match_patterns(n, p, [("name", "pattern")], ["k"])
    want = sorted((x, y) for x in names for y in patterns if like(x, y))
    assert rows(got, "name", "pattern") == sorted(want, key=repr)


def test_null_pattern_matches_everything(spark):
    n = spark.createDataFrame([("i", "x", "y")], "k string, name string, other string")
    p = spark.createDataFrame([("i", "x", None)], "k string, pattern string, other_pattern string")
    got = match_patterns(n, p, [("name", "pattern"), ("other", "other_pattern")], ["k"])
    assert got.count() == 1


def test_closure_ends_on_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("u", "a")]
    df = spark.createDataFrame([("i", s, t) for s, t in edges], "k string, source string, target string")
    got = {(r["source"], r["target"]): r["depth"] for r in closure(df, df, "k").collect()}
    assert got[("u", "d")] == 4 and got[("a", "a")] == 3
    assert {t for s, t in got if s == "u"} == {"a", "b", "c", "d"}


def test_closure_has_no_depth_limit(spark):
    df = spark.createDataFrame([("i", n, n + 1) for n in range(60)], "k string, source long, target long")
    got = {r["target"]: r["depth"] for r in closure(df.filter("source = 0"), df, "k").collect()}
    assert got == {n: n for n in range(1, 61)}


def reach(links):
    out = {}
    for root in links:
        seen, todo = {root}, [root]
        while todo:
            here = todo.pop()
            for node, up in links.items():
                if up == here and node not in seen:
                    seen.add(node)
                    todo.append(node)
        out[root] = len(seen)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_subtree_sizes_equal_reachability(spark, seed):
    r = random.Random(seed)
    # chains, forests and rings, with self-blocking and unknown blockers
    links = {n: r.choice([None, r.randint(0, 30), n - 1 if n else None]) for n in range(28)}
    df = spark.createDataFrame([("i", n, up) for n, up in links.items()], "k string, node long, up long")
    got = {x["node"]: x["size"] for x in subtree_sizes(df, "k", "node", "up").collect()}
    assert got == reach(links)


def test_long_chain_takes_few_rounds(spark):
    df = spark.range(200).selectExpr("'i' k", "id node", "CASE WHEN id > 0 THEN id - 1 END up")
    got = {x["node"]: x["size"] for x in subtree_sizes(df, "k", "node", "up").collect()}
    assert got == {n: 200 - n for n in range(200)}


def test_numbering_equals_row_number(spark):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.8 else f"k{n % 5}", r.randint(0, 40), f"n{n}") for n in range(500)]
    df = spark.createDataFrame(data, "k string, size int, name string").repartition(7)
    got = numbered(df, "k", [F.desc("size"), F.asc("name")], "no")
    want = df.withColumn("no", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("size"), "name")))
    assert rows(got, "k", "name", "no") == rows(want, "k", "name", "no")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
