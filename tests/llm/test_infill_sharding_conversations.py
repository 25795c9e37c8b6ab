"""Fill-in-the-middle, shuffled shards and conversation repair on small tables against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from fleetlens.llm import conversations, infill, registry, sharding

# -- fill in the middle ------------------------------------------------------------


def infill_rows():
    draw = random.Random(4)
    rows = [(i, "".join(draw.choice(("ab", "é🦆", "\n", "\n\n", " ", "\r", "<P", "S>")) for _ in range(draw.randint(1, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "one line"), (204, "x<S>\ny\n"), (205, "<P>"), (None, "a\nb\nc\n"), (206, "a\n" * 50_000)]
    return rows + [(207, "q" * 300_000 + "\nend"), (203, "one line"), (203, "one line")]


def plain_infill(doc_id, text):
    """By a loop over the lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    k = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(lines[: k[0]]), "".join(lines[k[0] : k[1]]), "".join(lines[k[1] :])
    if h[3] % 100 < 50:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_documents_are_cut_after_lines_and_restored(spark):
    rows = infill_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("__id", F.lit(1)).withColumn("other", F.lit(2))
    out = infill.fill_in_middle(df.drop("__id")).withColumn("restored", infill.restored())
    assert out.columns[:3] == ["doc_id", "text", "other"]
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, *plain_infill(i, t)) for i, t in rows), key=repr)
    assert all(r.restored == (r.text or "") for r in out.collect())
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}


def test_infill_rates_units_and_nothing(spark):
    df = spark.createDataFrame([(i, "a b c d") for i in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in infill.fill_in_middle(df, rate=30, spm=100, unit=r"\S+\s*+").collect())
    assert set(forms) == {"plain", "spm"} and 80 <= forms["spm"] <= 160
    words = infill.fill_in_middle(df, unit=r"\S+\s*+").filter("n <> 4 OR prefix_chars NOT IN (0, 2, 4, 6, 7)")
    assert words.count() == 0
    assert infill.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.cut("a b", regex.compile(r"(\w+)*+"), (0, 0, 0, 0), 100, 50)


# -- shards ------------------------------------------------------------------------


def hyper_law(total, marked, drawn):
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    return {k: math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) for k in range(low, high + 1)}


@pytest.mark.parametrize("total,marked,drawn", [(10, 4, 5), (1, 1, 1), (7, 0, 3), (7, 7, 3), (40, 15, 20), (1000, 63, 500), (9, 5, 8)])
def test_hypergeometric_draws_follow_the_law(spark, total, marked, drawn):
    n = 3000
    long = lambda v: F.lit(v).cast("long")
    draws = spark.range(n).select(sharding.hypergeometric(long(total), long(marked), long(drawn), F.col("id")).alias("k"))
    seen = {r.k: r["count"] for r in draws.groupBy("k").count().collect()}
    law = hyper_law(total, marked, drawn)
    assert set(seen) <= set(law)
    # chi-square over the values that are expected often enough; 5 standard deviations
    often = [k for k, p in law.items() if p * n >= 5]
    chi = sum((seen.get(k, 0) - law[k] * n) ** 2 / (law[k] * n) for k in often)
    assert chi < len(often) + 5 * math.sqrt(2 * len(often)) + 5


def test_large_draws_have_mean_and_deviation_of_the_law(spark):
    total, marked, drawn = 10**7, 625_000, 5 * 10**6
    long = lambda v: F.lit(v).cast("long")
    k = spark.range(60).select(sharding.hypergeometric(long(total), long(marked), long(drawn), F.col("id")).alias("k"))
    mean, sd = k.agg(F.avg("k"), F.stddev("k")).first()
    true = math.sqrt(drawn * marked / total * (1 - marked / total) * (total - drawn) / (total - 1))
    assert abs(mean - drawn * marked / total) < 5 * true / math.sqrt(60) and 0.6 * true < sd < 1.5 * true


def test_matrix_has_the_sums_of_partitions_and_shards(spark):
    sizes = {0: 3, 1: 0, 2: 5000, 3: 1, 6: 70, 9: 2, 12: 411}
    df = spark.createDataFrame([(p, n) for p, n in sizes.items() if n], "part long, n long")
    matrix = {r.part: r.counts for r in sharding.communication_matrix(df, 7, 3).collect()}
    assert {p: sum(c) for p, c in matrix.items()} == {p: n for p, n in sizes.items() if n}
    columns = [sum(c) for c in zip(*matrix.values(), strict=True)]
    assert sorted(columns, reverse=True) == columns and max(columns) - min(columns) <= 1
    assert all(x >= 0 for c in matrix.values() for x in c)


def test_shards_are_a_uniform_permutation_of_all_rows(spark, tmp_path):
    n = 2500
    # a third of the rows are one row
    rows = [(7, "hot") if i % 3 == 0 else (i, None if i % 5 == 0 else "t" * (i % 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("shard", F.lit("clash")).withColumn("source", F.lit(1))
    out = sharding.shuffle_into_shards(df, shards=5, block_rows=100)
    assert out.columns == ["doc_id", "text", "source", "shard", "slot"]
    got = out.collect()
    assert sorted((repr((r.doc_id, r.text)) for r in got)) == sorted(repr(r) for r in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(500))
    hot = Counter(r.shard for r in got if r.doc_id == 7)
    assert all(abs(c - 167) < 5 * math.sqrt(167) for c in hot.values())
    # places don't follow the order of the input
    own = [(r.doc_id, r.shard * 500 + r.slot) for r in got if r.doc_id != 7]
    mean = lambda v: sum(v) / len(v)
    a, b = [x for x, _ in own], [y for _, y in own]
    ma, mb = mean(a), mean(b)
    r = sum((x - ma) * (y - mb) for x, y in own) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert abs(r) < 5 / math.sqrt(len(own))
    path = str(tmp_path / "shards")
    sharding.write_shards(out, path)
    assert spark.read.parquet(path).groupBy("shard").count().filter("count = 500").count() == 5


def test_every_place_is_equally_likely(spark):
    """Which of 6 rows in 3 partitions comes first in shard 0, over many seeds."""
    df = spark.createDataFrame([(i,) for i in range(6)], "id long").repartition(3).cache()
    seen = Counter()
    for seed in range(8):
        first = sharding.shuffle_into_shards(df, shards=2, seed=seed).filter("shard = 0").collect()
        assert len(first) == 3
        seen.update(r.id for r in first)
    assert set(seen) == set(range(6)) and max(seen.values()) <= 7 and min(seen.values()) >= 1


def test_shards_of_few_rows_and_of_none(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    got = sharding.shuffle_into_shards(df, shards=16).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shuffle_into_shards(df.limit(0)).count() == 0


# -- conversations -----------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def first_faults(rows):
    seen, faults = set(), []
    for role, text in rows:
        trimmed = text.strip(SPACE)
        faults.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def exhaustive(rows, faults, most_inserts):
    """All edits of each row with up to some insertions anywhere; the least (cost, audit) and its lines."""
    best = None
    options = []
    for (role, text), fault in zip(rows, faults, strict=True):
        late = 5 if fault == "truncated" else 0
        mine = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            mine += [("K", late, (role, text)), ("R", 1 + late, ("user", text)), ("R", 1 + late, ("assistant", text))]
        options.append(mine)
    for pick in itertools.product(*options):
        for k in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), k):
                for roles in itertools.product(("user", "assistant"), repeat=k):
                    steps = []
                    for i in range(len(rows) + 1):
                        steps += [("I", 5, (r, "")) for p, r in zip(places, roles, strict=True) if p == i]
                        steps += [pick[i]] if i < len(rows) else []
                    kept = [s[2] for s in steps if s[2]]
                    if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
                        continue
                    found = (sum(s[1] for s in steps), "".join(s[0] for s in steps), "\n".join(f"{r}:{t}" for r, t in kept))
                    best = found if best is None else min(best, found)
    return best


def plain_repair(rows, most_inserts=1):
    """{conv: all columns} by enumeration."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        said = [(r[2], r[3]) for r in mine]
        faults = first_faults(said)
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = exhaustive(said, faults, most_inserts)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"


def conversation_rows():
    draw = random.Random(11)
    rows = []
    for conv in range(60):
        start = draw.choice(("user", "user", "system"))
        for turn in range(draw.randint(1, 5)):
            role = start if turn == 0 else draw.choice(("user", "assistant", "assistant", "system", "other", "", None))
            rows.append((conv, turn * draw.choice((1, 1, 2)), role, draw.choice(("Yes.", "No!", "why", "é?", " ", "", None, "A longer one. \n"))))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (70, None, "user", "Hi."), (70, None, "user", "Hi."), (70, 3, None, None)]
    return rows + [(71, 2**62, "user", "x"), (72, 0, "user", "y" * 200_000), (72, 1, "assistant", "z" * 200_000 + ".")]


def test_repairs_are_the_cheapest_of_all(spark):
    rows = plain_damage(conversation_rows())
    df = spark.createDataFrame(conversation_rows(), CONV).withColumn("place", F.lit("clash")).withColumn("cost", F.lit("clash"))
    found = conversations.repair(conversations.damage(df))
    hashes = {r.conv: r.repaired_sha256 for r in conversations.digests(found.turns).collect()}
    got = {r.conv: (*r[1:], hashes.get(r.conv, hashlib.sha256(b"").hexdigest())) for r in found.conversations.collect()}
    assert got == plain_repair(rows)


def test_query_returns_every_original_conversation(spark, tmp_path):
    rows = conversation_rows()
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hi."))
    spark.createDataFrame(rows, CONV).write.parquet(str(tmp_path / "conversations.parquet"))
    out = registry.op13_conversation_repair(spark, str(tmp_path))
    got = {r.conv_id: tuple(r[1:]) for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    assert got.pop(gone) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = plain_repair(plain_damage(rows))
    assert {c: v for c, v in got.items() if c in want} == want
    spark.createDataFrame([], CONV).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert registry.op13_conversation_repair(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("block", [1, 2, 64])
def test_search_equals_enumeration(block):
    draw = random.Random(block)
    texts = {".": "a.", "t": "a", "x": ""}
    for _ in range(60):
        rows = [draw.choice("suuaao") + draw.choice("...tx") for _ in range(draw.randint(1, 4))]
        said = [({"s": "system", "u": "user", "a": "assistant", "o": "other"}[r[0]], texts[r[1]]) for r in rows]
        faults = [{".": "", "t": "truncated", "x": "blank"}[r[1]] for r in rows]
        cost, codes = conversations.cheapest_edits(rows, block)
        want = exhaustive(said, faults, 2)
        assert (cost, "".join(codes).translate(str.maketrans("uaUA", "RRII"))) == want[:2]


def test_bounds_never_exceed_the_cost():
    draw = random.Random(3)
    for _ in range(100):
        rows = [draw.choice("suuaao") + draw.choice("...tx") for _ in range(30)]
        exact = conversations.suffix_bounds(rows, 100)
        for block in (1, 3, 7):
            loose = conversations.suffix_bounds(rows, block)
            assert all(x <= y for a, b in zip(loose, exact, strict=True) for x, y in zip(a, b, strict=True))
        assert conversations.cheapest_edits(rows, 4)[0] == exact[0][0]


def test_a_conversation_of_a_third_of_all_rows(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(3000)]
    rows += [(2 + t // 2, t % 2, ("user", "assistant")[t % 2], "One.") for t in range(6000)]
    found = conversations.repair(conversations.damage(spark.createDataFrame(rows, CONV)).repartition(5))
    hot = found.conversations.filter("conv = 1").first()
    mine = [(r[2], r[3]) for r in plain_damage(rows[:3000])]
    faults = first_faults(mine)
    signs = [r[:1] + {"": ".", "truncated": "t"}.get(f, "x") for (r, _), f in zip(mine, faults, strict=True)]
    cost, codes = conversations.cheapest_edits(signs, 10**6)
    assert (hot.cost, hot.audit) == (cost, "".join(codes).translate(str.maketrans("uaUA", "RRII")))
    roles = "".join(r.role[0] for r in found.turns.filter("conv = 1").orderBy("place", "step").collect())
    assert re.fullmatch("(s?(ua)+)?", roles)
