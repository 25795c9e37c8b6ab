"""Samples under copies, and operators against formulas written out by loops."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import zstandard
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, dom, html_extract, language, quality
from fleetlens.llm.text import ALNUM, Chunk


def prose(draw, n):
    return " ".join("".join(draw.choices(("ka", "to", "mi", "ren", "sol"), k=3)) for _ in range(n))


# -- samples -------------------------------------------------------------------------


def test_a_sample_is_bounded_where_a_text_is_a_third_of_all(spark):
    hot = spark.range(20_000).select(F.lit("hot text").alias("text"))
    df = hot.union(spark.range(40_000).selectExpr("concat('own ', id)"))
    got = {r.text: r.weight for r in quality._sample(df, "text", 600).collect()}
    assert 199 <= got["hot text"] <= 201 and set(got.values()) - {got["hot text"]} == {1}
    assert 300 < len(got) < 500
    few = {r.text: r.weight for r in quality._sample(df, "text", 60_000).collect()}
    assert len(few) == 40_001 and few["hot text"] == 20_000
    assert quality._sample(df.limit(0), "text", 5).collect() == []


def test_weights_count_as_rows(spark):
    df = spark.createDataFrame([("aaa bbb",)] * 5 + [("ccc",), (None,), ("",)], "text string")
    got = quality._matrix(quality._sample(df, "text", 100))
    want = quality.features_of(Chunk([b"aaa bbb"] * 5 + [b"ccc", b""], quality.NOT_SPACE))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_pages_that_are_mostly_copies(spark):
    page = lambda i: f"<nav>Home</nav><article><p>Some long text of page {i}, with words.</p></article>"
    own = [(page(i),) for i in range(40)]
    few, hot = spark.createDataFrame(own, "html string"), spark.createDataFrame(own + [own[0]] * 500, "html string")
    assert html_extract.learn(few, layouts=1) == html_extract.learn(hot, layouts=1)


def test_features_read_whole_blocks_and_all_names():
    names = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "pqrst")
    block = dom.blocks(f"<div class='{names} sidebar'>{'x' * 500} {'Y' * 4000} 7</div>")[0]
    own = html_extract.features([block])[0]
    assert "name:sidebar" in own and "digits" in own and "upper:4" in own


# -- benchmark passages: all windows -----------------------------------------------------


def all_windows(docs, items, k=5, least=decontaminate.SIMILARITY, radius=decontaminate.RADIUS):
    """(doc, item): (words, best similarity) over every window, each with its own fingerprint."""
    words = lambda t: re.findall("[0-9a-z\u0080-￿]+", t.lower())
    shingles = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}

    def fingerprint(w):
        hashes = [int(h) for h in Chunk([" ".join(w).encode()], ALNUM).words]
        return sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)

    held = {i: words(t) for i, t in items if t and words(t)}
    have = [shingles(w) for w in held.values()]
    weigh = lambda x: math.log1p(len(held) / (sum(x in s for s in have) or 1)) if any(x in s for s in have) else math.log1p(len(held))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, item in held.items():
            n, wanted, of_item = min(len(item), len(w)), shingles(item), fingerprint(item)
            for start in range(len(w) - n + 1 if n else 0):
                window = w[start : start + n]
                if (fingerprint(window) ^ of_item).bit_count() <= radius:
                    own = shingles(window)
                    same = sum(map(weigh, own & wanted)) / sum(map(weigh, own | wanted))
                    if same >= least and same > out.get((d, i), (0, 0))[1]:
                        out[d, i] = (n, same)
    return {key: (n, round(same, 6)) for key, (n, same) in out.items()}


def test_passages_equal_all_windows(spark):
    draw = random.Random(8)
    own = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(own, k=n))) for i, n in enumerate((3, 5, 8, 20, 20, 33))]
    items.append((9, items[3][1] + " " + items[4][1]))  # shares most shingles with two
    docs = []
    for d in range(50):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            w = draw.choice(items)[1].split()
            for _ in range(draw.randrange(0, 3)):
                w[draw.randrange(len(w))] = draw.choice(own)
            parts += w[draw.randrange(0, 2) : len(w) - draw.randrange(0, 2)] + draw.choices(own, k=draw.randrange(0, 12))
        docs.append((d, " ".join(parts)))
    found = decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_words, round(r.similarity, 6)) for r in found.collect()}
    assert got == all_windows(docs, items) and len(got) > 30


# -- sizes, prior and risk ---------------------------------------------------------------


def test_languages_by_sizes_counted_again(spark):
    draw = random.Random(3)
    texts = [prose(draw, n) for n in (1, 5, 40, 700)] + ["ÉÉ 12 schu", "berg ung " * 400]
    tables = {"aa": prose(draw, 300).encode(), "bb": b"schu berg ung keit " * 200}
    out = language.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tables).collect()
    for r in out:
        t = "".join(c if c.isalpha() else " " for c in r.text.lower())
        t = re.sub(" +", " ", t)
        sizes = {}
        for name, content in tables.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = 0
            for i in range(0, len(t), 2000):
                engine = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[name] += len(engine.compress(t[i : i + 2000].encode()))
        best, second = sorted(sizes, key=lambda n: (sizes[n], n))
        gap = 1 - sizes[best] / sizes[second]
        assert r.lang_pred == best and math.isclose(r.score, gap / (gap + 0.02), abs_tol=1e-12) and r.rejected == (gap < 0.02)


def risk(w, p, u, prior, decay):
    """The non-negative risk, a row at a time."""
    loss = lambda x, sign: math.log1p(math.exp(-sign * (sum(a * b for a, b in zip(x, w, strict=False)) + w[-1])))
    positive = sum(loss(x, 1) for x in p) / len(p)
    negative = sum(loss(x, -1) for x in u) / len(u) - prior * sum(loss(x, -1) for x in p) / len(p)
    return prior * positive + max(0.0, negative) + decay / 2 * sum(v * v for v in w[:-1])


def test_the_fit_has_the_least_risk():
    draw = np.random.default_rng(4)
    p, u = draw.normal(0.7, 1, (40, 2)), np.concatenate([draw.normal(0.7, 1, (30, 2)), draw.normal(-0.7, 1, (50, 2))])
    w = quality._fit(p, u, 0.375, 3000, decay=0.05)
    least = risk(w, p, u, 0.375, 0.05)
    for _ in range(30):
        assert risk(w + draw.normal(0, 0.1, 3), p, u, 0.375, 0.05) > least - 1e-6


def test_the_prior_is_the_least_ratio_of_survivals():
    draw = np.random.default_rng(7)
    p, u = draw.normal(2, 1, 300), np.concatenate([draw.normal(2, 1, 240), draw.normal(-2, 1, 160)])
    ratios = []
    for q in np.linspace(0, 2 / 3, 41):
        cut = float(np.quantile(p, q))
        above = sum(x >= cut for x in u) / len(u) + 0.1 * (300**-0.5 + 400**-0.5)
        ratios.append(above / (sum(x >= cut for x in p) / len(p)))
    assert math.isclose(quality.estimate_prior(p, u), min(ratios)) and 0.5 < min(ratios) < 0.7
