"""Language of texts by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
_OTHERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """The words of a text in lower case, all else one space each."""
    return _OTHERS.sub(" ", text.lower())


def learn_dictionaries(
    samples: DataFrame, text: str = "text", lang: str = "lang", max_texts: int = 400, max_bytes: int = 110_000
) -> dict[str, bytes]:
    """Raw-content dictionary of each language, of its words, the most frequent language first.

    Of each language `max_texts` distinct texts are sampled, evenly by the hash
    of the text, or all where there are fewer.  Each gives an equal share of
    `max_bytes`, so a few long texts don't fill a dictionary, from a place that
    its hash decides, so what many texts begin with doesn't either.  Rows whose
    text or language is null, or whose text is empty, teach nothing; a text
    counts once.
    """
    rows = samples.select(F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & (F.length("t") > 0))
    distinct = rows.groupBy("l", F.xxhash64("t").alias("h")).agg(F.count("*").alias("n"))
    counts = distinct.groupBy("l").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()  # a row per language
    if not counts:
        return {}
    order = {r.l: r.n for r in counts}
    number = F.create_map(*[F.lit(x) for r in counts for x in (r.l, r.texts)])[F.col("l")]
    share = max(64, max_bytes // max_texts)
    part = lambda seed: F.xxhash64("t", F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)
    start = F.floor(part(11) * (F.greatest(F.length("t") - 4 * share, F.lit(0)) + 1)).cast("int")
    # four times the texts wanted pass, or all; copies fall out, then the least hashes stay
    some = (
        rows.select("l", part(7).alias("u"), part(13).alias("place"), F.substring("t", start + 1, F.lit(4 * share)).alias("t"))
        .filter(F.col("u") * number < 4 * max_texts)
        .dropDuplicates(["l", "u"])
    )
    ranked = some.selectExpr("l", "t", "place", "row_number() over (partition by l order by u) as r")
    found = ranked.filter(F.col("r") <= max_texts).collect()
    out: dict[str, bytes] = {}
    for _, language in sorted({(-order[r.l], r.l) for r in found}):
        chosen = sorted((r for r in found if r.l == language), key=lambda r: r.r)
        texts = [(letters_of(r.t).encode(), r.place) for r in chosen]
        size = share
        while size < 4 * share and sum(len(t[:size]) for t, _ in texts) < max_bytes:
            size += share // 2
        starts = [int(place * (max(len(t) - size, 0) + 1)) for t, place in texts]
        out[language] = b"\n".join(t[s : s + size] for (t, _), s in zip(texts, starts, strict=True))[:max_bytes]
    return out


def classify(
    df: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    piece: int = 2000,
    level: int = 3,
    margin: float = 0.02,
) -> DataFrame:
    """Add `lang_pred`, `score` (0 to 1) and `rejected`.

    The whole text is encoded in pieces of `piece` characters with every
    dictionary, and the language of the fewest bytes wins; ties go to the
    language that comes first in `dictionaries`.  Case and all but letters are ignored.  Pieces keep the dictionaries in effect to a long text's end.
    With g = 1 - best / second, `score` is g / (g + margin), and `rejected` tells
    that g is below `margin`: no language fits, or two do.

    A text that is null or has no letter is `und`, score 0 and rejected.  With
    one language only, or none, the margin is unknown: the score is 0.  Other
    columns go through; columns named like the three are replaced.
    """
    names = list(dictionaries)
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("lang_pred string, score double, rejected boolean")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {
            n: zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for n in names
        }
        for d in tables.values():
            d.precompute_compress(level=level)
        engines = [
            zstandard.ZstdCompressor(dict_data=tables[n], write_content_size=False, write_checksum=False, write_dict_id=False)
            for n in names
        ]

        def judge(t: str | None) -> tuple[str, float, bool]:
            if t is None or not any(map(str.isalpha, t)):
                return UNDETERMINED, 0.0, True
            if not names:
                return UNDETERMINED, 0.0, True
            t = letters_of(t)
            parts = [t[i : i + piece].encode("utf-8", "replace") for i in range(0, len(t), piece)]
            sizes = [sum(len(e.compress(p)) for p in parts) for e in engines]
            order = sorted(range(len(names)), key=lambda i: (sizes[i], i))
            if len(order) == 1:
                return names[0], 0.0, True
            gap = 1 - sizes[order[0]] / sizes[order[1]]
            return names[order[0]], min(1.0, gap / (gap + margin)), gap < margin

        for batch in batches:
            found = [judge(t) for t in batch.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                names=[*kept, "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(encode, schema)
