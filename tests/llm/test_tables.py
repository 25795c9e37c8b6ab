"""Mixing, top-k search, archives and page text on small tables; the registry and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import dom, html_extract, mixing, topk, warc

# -- mixing ------------------------------------------------------------------------


def mix_rows(n=400, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else draw.choice(("a", "b", "é", "Z", None, "tiny"))
        if source == "tiny" and draw.random() < 0.9:
            source = "a"
        rows.append((i, " ".join(["w"] * int(draw.paretovariate(1.2) * 10)), source))
    return rows + [(900, None, "a"), (901, "", None), (902, " \t\n", "empty"), (903, "x y", "a"), (903, "x y", "a"), (None, "z " * 40, "b")]


def filled(sizes, weights, total, most):
    """Shares by weight, resharing what is over, one source at a time."""
    full: dict = {}
    while True:
        free = [s for s in sizes if s not in full]
        if not free:
            return full
        level = (total - sum(full.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > most * sizes[s]]
        if not over:
            return full | {s: weights[s] * level for s in free}
        full |= {s: float(most * sizes[s]) for s in over}


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("rate", F.lit(0))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = filled(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), 3)
    for s in order:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9) for r in mine)
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in mine)
        largest = max(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(0.02 * want[s], min(largest, 8))
        got = sum(r.rate * r.size for r in mine)  # the rates themselves solve the constraint
        assert math.isclose(got, want[s], rel_tol=1e-5, abs_tol=1e-6)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_rates_are_tilted_exponentially_and_stop_at_the_limit(spark):
    out = mixing.mix(spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")).collect()
    for s in ("hot", "a"):
        mine = [r for r in out if r.source == s and 0 < r.rate < 3 and r.size]
        tilts = {round(math.log(r.rate) / r.size, 9) for r in mine}
        assert max(tilts) - min(tilts) < 1e-8


def test_mix_of_nothing_of_one_and_of_empty_texts(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    one = mixing.mix(spark.createDataFrame([(1, "a b c", None)], schema)).first()
    assert (one.source, one.size, one.target, one.taken) == (None, 3, 3.0, 3)
    none = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], schema)).collect()
    assert {(r.size, r.target, r.taken) for r in none} == {(0, 0.0, 0)}


# -- top-k -------------------------------------------------------------------------


def brute_top(rows, k, scale=256):
    kept = {i: [math.floor(scale * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in kept.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in kept.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("width", [1, 7, 40])
def test_top_k_equals_brute_force(spark, width):
    draw = np.random.default_rng(width)
    base = draw.normal(size=(30, width))
    rows = [(i, [float(np.float32(x)) for x in base[i % 30] + draw.normal(size=width) * (0.2 if i % 4 else 0)]) for i in range(700)]
    rows += [(1000, None), (1001, [None] * width), (1050, [float("nan")] * width), (1100, [float("inf")] * width), (1150, [0.0] * width)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    v = topk.quantised(df)
    for block in (8 << 20, 500):
        got = topk.top_k(v.filter("vec_id % 50 = 0").repartition(3), v.repartition(4), block_bytes=block).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(rows, 5)


def test_top_k_of_few_rows_of_ragged_and_of_huge_ones(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, [0.5, 0.5, 9.0]), (3, [])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v.filter("vec_id = 0"), v).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(rows, 5)
    huge = [(0, [1e7, 1e7]), (1, [1e7 + 1, -1e7]), (2, [1e7, 1.0])]
    v = topk.quantised(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    got = topk.top_k(v.filter("vec_id = 0"), v).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(huge, 5)
    none = v.filter("vec_id < 0")
    assert topk.top_k(none, v).collect() == [] and topk.top_k(v, none).collect() == []


# -- archives ----------------------------------------------------------------------


def page_rows():
    big = "é" * 600
    rows = [(i, f"http://x.org/{i}", big) for i in range(1, 6)] + [(7, "http://x.org/a b\tc", "x" * 999), (8, None, "x" * 999)]
    rows += [(9, "http://é.org", None), (10, "u", ""), (11, "u", "\r\n\r\nWARC/1.1\n"), (12, "u", "z" * 200_000), (12, "u", "z" * 200_000)]
    return [*rows, (None, "u", big), (13, "u", "x" * 1000), (14, "u", "x" * 1000)]


def test_archives_give_the_pages_back(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("path", F.lit(1))
    out = warc.archived_pages(df.repartition(4)).collect()
    assert len(out) == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in out), key=repr)
    payload = lambda h: (h or "").encode()
    assert got == sorted(((p, len(payload(h)), hashlib.sha1(payload(h)).hexdigest()) for p, _, h in rows), key=repr)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in out if r.page_id != 12}
    assert kinds[5] == ("response", None) and all(kinds[i] == ("revisit", 5) for i in (1, 2, 3, 4, None))
    assert all(kinds[i] == ("response", None) for i in (7, 8, 9, 10, 11))
    assert kinds[13] == ("revisit", 14) and kinds[14] == ("response", None)
    assert sorted((r.record_type, r.refers_to) for r in out if r.page_id == 12) == [("response", None), ("revisit", 12)]
    urls = {r.page_id: r.url for r in out}
    assert urls[7] == "http://x.org/a%20b%09c" and urls[8] == warc.NO_URL
    assert warc.archived_pages(df.limit(0)).collect() == []


ARC_1 = b"""filedesc://a.arc 0.0.0.0 19970101000000 text/plain 75
1 0 Someone
URL IP-address Archive-date Content-type Archive-length

http://a b.org/x y 1.2.3.4 19970102030405 text/html 30
HTTP/1.0 200 OK

<p>hello</p>

dns:a.org 1.2.3.4 199701020304 text/dns 9
1.2.3.4
x
"""
ARC_2 = b"""filedesc://b.arc 0.0.0.0 19980101000000 text/plain 200 - - 0 b.arc 122
2 0 Someone
URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

http://b.org/ 1.2.3.4 19980102030405 text/html 200 abc - 250 b.arc 4
abcd
"""


def arc(raw):
    """The samples with their first length set to what it is."""
    head, _, rest = raw.partition(b"\n")
    length = rest.index(b"\n\n") + 2
    return head.rpartition(b" ")[0] + b" %d\n" % length + rest


def test_legacy_headers_are_read_by_version():
    one = list(warc.read_arc(io.BytesIO(arc(ARC_1).replace(b" 30\n", b" 29\n"))))
    assert [(h["url"], h["date"], len(c)) for _, h, c in one] == [("http://a b.org/x y", "19970102030405", 29), ("dns:a.org", "199701020304", 9)]
    two = list(warc.read_arc(io.BytesIO(arc(ARC_2))))
    assert [(h["url"], h["status"], h["checksum"], c) for _, h, c in two] == [("http://b.org/", "200", "abc", b"abcd")]
    assert warc.warc_date("199701020304") == "1997-01-02T03:04:00Z"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_arc(io.BytesIO(arc(ARC_2).replace(b" 4\n", b" 4000\n"))))


def test_a_legacy_file_becomes_equivalent_records(spark, tmp_path):
    path = str(tmp_path / "old.arc.gz")
    with gzip.open(path, "wb") as out:
        out.write(arc(ARC_1).replace(b" 30\n", b" 29\n"))
    index = warc.index_arc(spark.createDataFrame([(path, 3)], "path string, records long"))
    done = warc.convert_arc(warc.plan_revisits(index), str(tmp_path / "new"))
    found = {r.url: r for r in warc.read_archives(done).collect()}
    assert found["http://a b.org/x y"].type == "resource" or found["http://a b.org/x y"].type == "response"
    assert found["dns:a.org"].type == "resource" and found["dns:a.org"].date == "1997-01-02T03:04:00Z"
    assert found["dns:a.org"].digest == hashlib.sha1(b"1.2.3.4\nx").hexdigest()


# -- page text -----------------------------------------------------------------------


def test_blocks_of_broken_markup():
    page = ("<!DOCTYPE html><title>no</title><style>p{}</style><body><!-- <p>no</p> --><p>a&amp;b&nbsp; c<b>d</b>e<br>f<p class='X yZ'>g"
            '<script>var t="</p>";</script><ul><li>h<li>i<a href="x>y">j</a></ul><table><tr><td>k<td>l</table>m < n <script>open')  # fmt: skip
    found = dom.blocks(page)
    assert [b.text for b in found] == ["a&b cde f", "g", "h", "ij", "k", "l", "m < n"]
    assert {"name:x", "name:y", "in:p"} <= found[1].node.names and found[3].linked == 1
    assert "in:li" not in found[4].node.names
    assert dom.blocks("") == [] and [b.text for b in dom.blocks("just text")] == ["just text"]
    assert [b.text for b in dom.blocks("<div>" * 3000 + "x" + "</p></span>" * 3000)] == ["x"]


def labelled_pages(n, seed):
    draw = random.Random(seed)
    sentence = lambda: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(draw.randrange(4, 30))).capitalize() + "."
    bodies = [[sentence() for _ in range(draw.randrange(2, 9))] for _ in range(n)]
    return [html_extract.layout(draw, b[0][:40], b, [t for o in draw.sample(bodies, 4) for t in o]) for b in bodies]


def test_field_labels_unseen_layouts():
    model = html_extract.train([html_extract.labelled(p) for p in labelled_pages(150, 1)], epochs=15)
    wrong = total = 0
    for page in labelled_pages(60, 2):
        found, labels = html_extract.labelled(page)
        wrong += sum(a != b for a, b in zip(labels, model.decode(found), strict=True))
        total += len(labels)
    assert wrong < 0.03 * total


def test_viterbi_and_marginals_equal_enumeration():
    import itertools

    draw = np.random.default_rng(1)
    score, steps = draw.normal(size=6), draw.normal(size=(2, 2))
    weigh = lambda y: sum(s * a for s, a in zip(score, y, strict=True)) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False))
    every = list(itertools.product((0, 1), repeat=6))
    weights = np.exp([weigh(y) for y in every])
    p, pairs = html_extract._marginals(score, steps)
    assert np.allclose(p, (np.array(every) * weights[:, None]).sum(axis=0) / weights.sum())
    assert math.isclose(pairs.sum(), 5)
    page = dom.blocks("".join(f"<p>{'x' * (i + 1)}</p>" for i in range(6)))
    weights = {f: float(s) for fs, s in zip(html_extract.features(page), score, strict=True) for f in fs if f.startswith("place:")}
    model = html_extract.Model(weights, tuple(map(tuple, steps.tolist())))
    score = np.array([weights[next(f for f in fs if f.startswith("place:"))] for fs in html_extract.features(page)])
    best = max(every, key=lambda y: sum(s * a for s, a in zip(score, y, strict=True)) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False)))
    assert model.decode(page) == [bool(x) for x in best]


def test_main_text_of_pages(spark):
    pages = [(i, "u", p) for i, p in enumerate(f"<nav><a href='/'>Home</a></nav><article><h1>T {i}</h1><p>Some long text of page {i}, with words.</p>"
             f"<p>And more &lt;text&gt; of it {i}.</p></article><footer>© us</footer>" for i in range(60))]  # fmt: skip
    pages += [(90, None, None), (91, "u", ""), (92, "u", "<script>x</script>"), (92, "u", "<script>x</script>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r for r in html_extract.extract(df, html_extract.learn(df, layouts=2)).collect()}
    assert out[7].text == "T 7 Some long text of page 7, with words. And more <text> of it 7." and out[7].n_chars == len(out[7].text)
    assert all(out[i].text == "" and out[i].n_chars == 0 for i in (90, 91, 92))
    empty = df.limit(0)
    assert html_extract.extract(empty, html_extract.learn(empty, layouts=1)).collect() == []


# -- the whole ---------------------------------------------------------------------------


def test_every_operator_is_registered_once():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_stages_keep_the_columns_and_bear_odd_rows(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(4)
    prose = lambda n: " ".join("".join(draw.choices(("ka", "to", "mi", "ren"), k=3)) for _ in range(n)).capitalize() + "."
    leak = prose(40)
    texts = [prose(draw.randrange(20, 90)) for _ in range(120)]
    texts += [texts[0], texts[1] + " more", f"{prose(30)} {leak} {prose(20)}", None, "", "junk*** " * 60]
    rows = [(i, t, "aa", f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(50), None, None, None), (3, texts[3], "aa", "s3", len(texts[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit(7)).withColumn("component_id", F.lit("x")).withColumn("n_lines", F.lit(1))
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, kept, folder)
        assert sorted(kept.columns) == sorted(docs.columns)
    ids = {r.doc_id for r in kept.collect()}
    assert {120, 122} & ids == set() and {0, 1, 2, 3, 123, 124, None} <= ids and 121 not in ids
    assert kept.count() == len(rows) - 4
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= ids and len(out) > 100 and sum(r.taken for r in out) > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
