"""Line dedup, decontamination and the n-gram join on small tables, against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, line_dedup, ngram_join
from fleetlens.llm.components import components
from fleetlens.llm.text import ALNUM, NOT_SPACE, Chunk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# -- hashing -------------------------------------------------------------------


def test_words_hash_alike_wherever_they_stand():
    texts = ["Ab cd  ab\tCD", "", "cd", "é ab"]
    chunk = Chunk([t.encode() for t in texts], NOT_SPACE)
    assert list(chunk.bounds) == [0, 4, 4, 5, 7]
    h = chunk.words
    assert h[0] == h[2] == h[6] and h[1] == h[3] == h[4] and h[0] != h[1] != h[5]
    assert len(Chunk([b"it's-one, two"], ALNUM).words) == 4


# -- line dedup ----------------------------------------------------------------


def line_rows():
    rows = [(i, f"own text number {i} of this page and more\n Shared line \n\nend {i}", "en", f"s{i % 9}", 0) for i in range(20)]
    rows += [(100 + i, "Shared line", "en", f"s{i}", 0) for i in range(9)]  # wholly boilerplate: copies
    rows += [(200, None, "en", "s1", 0), (201, "", "en", None, 0), (202, "\n\n", None, "s1", 0)]
    rows += [(300, "only here\nonly here\nonly here", "en", "s1", 0)]
    rows += [(301 + i, f"near bound\nsomething of its own that is long {i}", "en", f"s{i}", 0) for i in range(7)]
    return rows


def test_boilerplate_lines_go_and_the_rest_stays(spark):
    out = {r.doc_id: r for r in line_dedup.dedupe_lines(frame(spark, line_rows()), min_sites=8).collect()}
    assert len(out) == len(line_rows())
    assert out[3].text == "own text number 3 of this page and more\n\nend 3" and (out[3].n_lines, out[3].n_removed) == (4, 1)
    assert out[104].text == "Shared line" and out[104].n_removed == 0
    assert out[200].text is None and (out[200].n_lines, out[200].n_removed) == (0, 0)
    assert out[201].text == "" and out[201].n_lines == 1 and out[202].text == "\n\n"
    assert out[300].n_removed == 0
    assert out[303].n_removed == 0  # 7 sites, in the band of exact counts
    lower = {r.doc_id: r for r in line_dedup.dedupe_lines(frame(spark, line_rows()), min_sites=7).collect()}
    assert lower[303].text == "something of its own that is long 2"


def test_lines_of_one_text_only_stay(spark):
    rows = [(i, "a line\nanother line of it", "en", f"s{i}", 0) for i in range(12)] * 2
    out = line_dedup.dedupe_lines(frame(spark, rows), min_sites=3).collect()
    assert len(out) == 24 and {r.text for r in out} == {"a line\nanother line of it"}


def test_every_site_of_copied_texts_counts(spark):
    text = lambda i: f"article {i} has a body that is long enough to be its own\nSyndicated by the agency"
    rows = [(10 * i + j, text(i), "en", f"s{j}", 0) for i in range(3) for j in range(9)]  # three texts, each on nine sites
    out = line_dedup.dedupe_lines(frame(spark, rows), min_sites=8).collect()
    assert len(out) == 27 and all(r.n_removed == 1 and "Syndicated" not in r.text for r in out)
    fewer = line_dedup.dedupe_lines(frame(spark, [r for r in rows if r[3] < "s7"]), min_sites=8).collect()
    assert all(r.n_removed == 0 for r in fewer)


def test_boilerplate_goes_from_texts_that_are_mostly_boilerplate(spark):
    notice = "A long notice that many sites put on their pages, " * 6
    rows = [(i, f"{notice}\nown {i}", "en", f"s{i}", 0) for i in range(9)]  # nearly all notice, but no copies
    rows += [(20, notice, "en", "s1", 0), (21, f"\n{notice}\n\n", "en", "s2", 0)]  # wholly notice, of one row each
    rows += [(30 + i, f"{notice}\n{notice}", "en", "s3", 0) for i in range(2)]  # wholly notice, and copies
    out = {r.doc_id: r for r in line_dedup.dedupe_lines(frame(spark, rows), min_sites=8).collect()}
    assert len(out) == len(rows) and all((out[i].text, out[i].n_removed) == (f"own {i}", 1) for i in range(9))
    assert (out[20].text, out[20].n_removed) == ("", 1) and (out[21].text, out[21].n_removed) == ("\n\n", 1)
    assert all((out[30 + i].text, out[30 + i].n_removed) == (f"{notice}\n{notice}", 0) for i in range(2))


def test_line_dedup_of_nothing_and_with_clashing_columns(spark):
    assert line_dedup.dedupe_lines(frame(spark, [])).collect() == []
    df = frame(spark, line_rows()).withColumn("n_lines", F.lit(-1)).withColumn("line", F.lit("x")).withColumn("tkey", F.lit(1))
    out = line_dedup.dedupe_lines(df, counts=("__a", "__b"))
    assert {r.n_lines for r in out.collect()} == {-1} and "line" in out.columns


def test_a_very_long_text_is_cut_whole(spark):
    long = "\n".join(["x" * 50] * 4000 + ["Shared line"] + ["y" * 50])
    out = line_dedup.dedupe_lines(frame(spark, [*line_rows(), (500, long, "en", "s0", 0)]), min_sites=8).filter("doc_id = 500").first()
    assert out.n_removed == 1 and out.text == long.replace("\nShared line", "")


# -- components ------------------------------------------------------------------


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(120)],
    [(0, i) for i in range(1, 200)] + [(500, 501), (501, 500), (7, 7)],
    [],
])
def test_components(spark, edges):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


# -- n-gram join -----------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_join(rows):
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    labels = brute_components(edges)
    return {i: (len(s), labels.get(i, i)) for i, s in sets.items()}


def edited(draw, base, edits):
    out = list(base)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**6)}"
    return out


def join_rows():
    draw = random.Random(3)
    rows, base = [], words(draw, 300)
    rows += [edited(draw, base, draw.randrange(0, 9)) for _ in range(40)]  # chains of near copies
    chain = words(draw, 200)
    for _ in range(12):
        chain = edited(draw, chain, 2)
        rows.append(chain)
    passage = words(draw, 60)  # common to texts that are otherwise different
    rows += [words(draw, 100, 10**6) + passage for _ in range(25)]
    rows += [words(draw, n, 30) for n in (1, 2, 3, 4, 5, 6, 7) for _ in range(3)]
    rows += [passage[:n] for n in range(40, 60)]  # sizes near the bound
    texts = [" ".join(r) for r in rows]
    texts += ["", None, " \t\n", "Same Words here", "same words HERE", "É é É", "é é é", texts[0].upper(), texts[0]]
    return [(1000 - i, t) for i, t in enumerate(texts)]


def test_join_finds_the_components_of_all_links(spark):
    rows = join_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_join(rows)


def test_join_at_another_threshold_and_on_a_very_long_text(spark):
    draw = random.Random(8)
    long = words(draw, 30_000, 10**6)
    rows = [(1, " ".join(long)), (2, " ".join(edited(draw, long, 300))), (3, " ".join(words(draw, 30_000, 10**6)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]
    got = ngram_join.near_duplicates(df, percent=100).collect()
    assert {r.component_id for r in got} == {1, 2, 3}


def test_join_of_nothing_and_of_null_ids(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (None, "z z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()), key=repr)
    assert got == [(7, 2, 7), (7, 2, 7), (None, 0, None), (None, 1, None), (None, 2, 7)]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()), key=repr)
    assert kept == [(7, "a b c d e f"), (None, "z z z z z"), (None, None)]


def cluster_rows(draw, near, apart, kin):
    """Near copies of one text; copies too far from it and from each other; and copies of near ones, that only link with these."""
    base = words(draw, 200, 10**6)
    close = [edited(draw, base, draw.randrange(1, 4)) for _ in range(near)]
    rows = [base, *close, *(edited(draw, base, draw.randrange(7, 10)) for _ in range(apart))]
    rows += [edited(draw, draw.choice(close), draw.randrange(3, 6)) for _ in range(kin)]
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_queries_of_a_large_group_are_compared_with_few_of_its_members(spark, monkeypatch):
    rows, pairs = cluster_rows(random.Random(5), 150, 60, 30), []

    def counting(name):
        plain = getattr(ngram_join, name)

        def run(given, *others):
            pairs.append(given.count())
            return plain(given, *others)

        monkeypatch.setattr(ngram_join, name, run)

    for name in {"_verified", "_compared"} & set(vars(ngram_join)):
        counting(name)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)
    assert pairs[-1] < 3 * len(rows)  # the last step opens the groups: each query with each member were several thousand


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_of_a_group_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "FIRST_SHARE", 1)
    monkeypatch.setattr(ngram_join, "SHARES", 2)
    draw = random.Random(seed)
    rows = [t for n in (40, 25) for _, t in cluster_rows(draw, n, 15, 20)]
    rows += [" ".join(words(draw, 30, 12)) for _ in range(10)] + ["", None]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)


# -- decontamination ---------------------------------------------------------------


def passages(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("tkey", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_passages(d, b, **more).collect()
    return {(r.doc_id, r.item_id): r for r in found}


def test_passages_exact_edited_and_at_any_place(spark):
    draw = random.Random(5)
    items = [(i, " ".join(words(draw, n, 10**6))) for i, n in enumerate((15, 30, 59, 41, 3, 5))] + [(90, None), (91, ""), (92, " ,. ")]
    filler = lambda n: " ".join(words(draw, n, 10**6))
    docs = [(i, f"{filler(40)} {t} {filler(draw.randrange(0, 50))}") for i, t in items[:6]]
    one = items[2][1].split()
    one[50] = "other"
    docs.append((20, f"{filler(9)} {' '.join(one)}"))  # one of 59 words: similar by 50/60
    many = items[2][1].split()
    many[::7] = ["other"] * len(many[::7])
    docs.append((21, " ".join(many)))
    docs.append((22, items[0][1].upper().replace(" ", ",  ") + "."))  # words alike, signs not
    docs += [(23, None), (24, ""), (25, " ".join(items[1][1].split()[:20])), (26, filler(500)), (None, items[0][1])]
    docs.append((27, f"{items[0][1]} {filler(20_000)} {items[1][1]}"))
    docs.append((28, f"{items[0][1]} {items[0][1]}"))
    found = passages(spark, docs, items)
    expected = {(i, i) for i in range(6)} | {(20, 2), (22, 0), (27, 0), (27, 1), (28, 0), (None, 0)}
    assert set(found) == expected
    assert found[3, 3].first_word == 40 and found[3, 3].n_words == 41 and found[3, 3].similarity == 1.0
    assert 0.8 <= found[20, 2].similarity < 1 and found[28, 0].first_word == 0
    assert set(passages(spark, docs, items, block_bytes=100)) == expected  # block by block


def test_items_cut_short_are_found(spark):
    draw = random.Random(8)
    items = [(i, " ".join(words(draw, n, 10**6))) for i, n in enumerate((38, 60, 38, 5, 3))]
    cut = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs = [(1, cut(0, 0, -1)), (2, cut(1, 2, None)), (3, cut(2, 0, 20)), (4, cut(3, 0, 4)), (5, cut(4, 0, 2))]
    found = passages(spark, docs, items)
    assert set(found) == {(1, 0), (2, 1)}  # by 33/34 and 54/56; half of an item isn't it
    assert (found[1, 0].first_word, found[1, 0].n_words) == (0, 37) and abs(found[1, 0].similarity - 33 / 34) < 1e-9
    assert found[2, 1].n_words == 58 and set(passages(spark, docs, items, block_bytes=100)) == set(found)


def test_no_benchmark_or_no_documents(spark):
    assert passages(spark, [(1, "a b c")], []) == {} and passages(spark, [], [(1, "a b c")]) == {}


def test_blocks_find_every_print_within_the_radius():
    import numpy as np

    draw = random.Random(2)
    items = decontaminate.prepare_items([(i, " ".join(words(draw, 20, 1000))) for i in range(50)], 5)
    prints = []
    for p in items.prints:
        bits = draw.sample(range(64), decontaminate.RADIUS)
        prints.append(int(p) ^ sum(1 << b for b in bits))
    found = {(item, int(w)) for item, at in decontaminate._within(items, np.array(prints, dtype=np.uint64), 20) for w in at}
    assert {(i, i) for i in range(50)} <= found


def test_a_hundred_thousand_boilerplate_lines(spark):
    block = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda n: F.concat(F.lit("line "), (F.col("id") * 1000 + n).cast("string")))
    docs = spark.range(100).crossJoin(spark.range(9).withColumnRenamed("id", "site"))
    own = F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" "), F.col("site").cast("string"))
    docs = docs.select(
        (F.col("id") * 9 + F.col("site")).alias("doc_id"), F.array_join(F.concat(F.array(own), block), "\n").alias("text"),
        F.concat(F.lit("s"), F.col("site").cast("string")).alias("source"),
    )
    out = line_dedup.dedupe_lines(docs, min_sites=8)
    assert out.filter("n_lines = 1001 and n_removed = 1000 and text like 'own %' and length(text) < 12").count() == 900


def test_near_copies_come_to_few_groups(spark):
    draw = random.Random(12)
    base = words(draw, 120)
    rows = [(i, edited(draw, base, 1), "en", "s", 0) for i in range(120)] + [(500 + i, words(draw, 60), "en", "s", 0) for i in range(10)]
    df = frame(spark, rows)
    texts = df.select(F.col("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("rkey"))
    profile = ngram_join._profile(texts.select("doc_id", "rkey", "text"), 5).filter("n > 0")
    reps = profile.select("cid", "n", "mins", "bits", "fine", "rkey").dropDuplicates(["cid"]).cache()
    links, grouped = ngram_join._groups(reps, texts, 5, 80)
    groups = {r.cid: r.gid for r in grouped.collect()}
    alone = reps.count() - 10 - len(groups)
    assert len(set(groups.values())) + alone <= 12  # of about 120 classes
    label = brute_components([(r.a, r.b) for r in links.collect()])
    assert all(label[c] == label[g] for c, g in groups.items())  # every group is connected by verified links
