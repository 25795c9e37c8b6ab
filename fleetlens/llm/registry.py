"""The operators on the given tables, by query name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (
    conversations,
    decontaminate,
    html_extract,
    infill,
    language,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    secrets,
    sharding,
    topk,
    warc,
)

from .text import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            bounded_batches(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return keep


def fold(doc_id: str, parts: int, held: int):
    """Whether a row is held out of learning; a null id never is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == held, F.lit(False))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    learned = language.learn_dictionaries(docs.filter(~fold("doc_id", 4, 2)))
    rows = docs.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "text")
    return language.classify(rows, learned).drop("text")


#: Documents labelled good, and unlabelled ones, that the quality model is fitted on, at most.
QUALITY_SAMPLE = 6000


def quality_model(documents: DataFrame, labels: DataFrame) -> quality.Model:
    """Positives are the texts labelled good in the learning fold; all documents are the unlabelled text.

    The ids to learn from are drawn by hash before the texts are looked up, so
    that the broadcast side is bounded, whatever the number of labels.
    """
    good = labels.filter((F.col("quality") == 1) & ~fold("doc_id", 5, 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    share = F.xxhash64("doc_id", F.lit(3)) / F.lit(2.0**64) + F.lit(0.5)
    drawn = good.filter(share * good.count() < QUALITY_SAMPLE)
    positives = documents.join(F.broadcast(drawn), "doc_id", "left_semi")
    return quality.learn(positives, documents, most=QUALITY_SAMPLE)


#: Scores from here on keep a document.
QUALITY_FLOOR = 0.3


@query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, folder, "labels"))
    found = quality.score(docs.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "text"), model)
    return found.drop("text").withColumn("predicted", (F.col("score") >= QUALITY_FLOOR).cast("int"))


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratios = secrets.log_ratios(secrets.labelled_samples(docs))
    found = secrets.find(docs, ratios).select("doc_id", "base", "spans")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


LINE_DEDUP_SQL = f"""
WITH texts AS (SELECT text, count(*) AS copies, list(DISTINCT coalesce(source, '')) AS sites FROM documents WHERE text IS NOT NULL GROUP BY text),
split AS (SELECT *, string_split(text, chr(10)) AS ls FROM texts),
lines AS (SELECT text, copies, sites, generate_subscripts(ls, 1) AS pos, unnest(ls) AS raw FROM split),
cut AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
bad AS (SELECT line FROM (SELECT DISTINCT line, text, unnest(sites) AS site FROM cut WHERE line <> '')
        GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES} AND count(DISTINCT text) >= 2),
flagged AS (SELECT c.text, c.copies, c.pos, c.raw, c.line, b.line IS NOT NULL AS bad FROM cut c LEFT JOIN bad b USING (line)),
done AS (
  SELECT text, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad,
         count(*) FILTER (bad) > 0 AND (count(*) FILTER (NOT bad AND line <> '') > 0 OR max(copies) = 1) AS carrier,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS rest
  FROM flagged GROUP BY text)
SELECT d.doc_id, CASE WHEN c.carrier THEN c.rest ELSE d.text END AS text,
       coalesce(c.n_lines, 0) AS n_lines, CASE WHEN c.carrier THEN c.n_bad ELSE 0 END AS n_removed
FROM documents d LEFT JOIN done c ON d.text = c.text
"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedupe_lines(table(spark, folder, "documents").select("doc_id", "text", "source")).drop("source")


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("tkey").withColumn("similarity", F.round("similarity", 6))


@query("op4_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM m
""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(table(spark, folder, "pages")).drop("url")


@query("op7_topk", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors)


@query("op5_html_extract")
def op5_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.learn(pages))


INFILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls, len(string_split(t, chr(10))) - 1 AS feeds,
             list_transform(range(4), lambda i: ('0x' || substr(h, i * 8 + 1, 8))::BIGINT) AS x FROM d),
u AS (SELECT *, feeds + (ls[-1] <> '')::INT AS n FROM r),
k AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS k1, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS k2,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain'
                  WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, t, n, form,
             CASE WHEN k1 = 0 THEN '' WHEN k1 > feeds THEN t ELSE array_to_string(ls[1:k1], chr(10)) || chr(10) END AS a,
             CASE WHEN k2 = 0 THEN '' WHEN k2 > feeds THEN t ELSE array_to_string(ls[1:k2], chr(10)) || chr(10) END AS b FROM k),
p AS (SELECT *, substr(t, length(a) + 1, length(b) - length(a)) AS middle, substr(t, length(b) + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || a || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", INFILL_SQL)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"),
    )


@query("op12_sharding")
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return sharding.shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.repair(conversations.damage(given))
    ids = given.select("conv_id").distinct()
    faults, hashes = found.conversations, conversations.digests(found.turns).withColumnRenamed("conv", "hashed")
    out = ids.join(faults, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        # a conversation that lost all its rows has none to repair; gaps may be null where there are rows
        *[F.when(F.col("cost").isNull(), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
