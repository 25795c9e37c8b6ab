"""Fill-in-the-middle documents by repeated-capture matching.

One `fullmatch` of `(unit)*` keeps the end of every repetition; the number of
units and both cuts are read from that list.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line with its line feed, or the last one without.
LINE = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: str | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that the seed and the id decide; a null id counts as empty."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()[:16])


def cut(
    text: str, units: regex.Pattern, numbers: tuple[int, int, int, int], rate: int, spm: int
) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output) of one text; `units` is the compiled `(unit)*`."""
    match = units.fullmatch(text)
    if match is None:
        raise ValueError("the units don't cover the text")
    ends = match.ends(1)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or numbers[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if numbers[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    df: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Add n, form (`plain`, `psm`, `spm`), prefix_chars, middle_chars and output.

    Prefix and middle end after whole units, at places the hash of seed and id
    decides; `rate` percent of the texts are cut, `spm` percent of these put the suffix
    first.  Positions are code points.  Every text is read whole, of any length.

    A null text counts as empty; an empty text, and one that holds a mark
    itself, stays `plain`: the output is the text, the two lengths are null.  Equal ids give
    equal draws, so repeated rows give repeated rows; a null id draws as the empty
    one.  An empty table gives none.  Other columns go through; those
    named like an added one are replaced.
    """
    added = T._parse_datatype_string(_OUT)
    kept = [c for c in df.columns if c not in added.fieldNames()]
    rows = df.select(F.col(doc_id).cast("string").alias("__id"), F.col(text).alias("__text"), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields[2:], *added.fields])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*+")
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            found = [
                cut(t.as_py() or "", units, draws(seed, i.as_py()), rate, spm)
                for i, t in zip(batch.column(0), batch.column(1), strict=True)
            ]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=schema.fieldNames())

    return rows.mapInArrow(transform, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text an output was made of: its parts stand between the marks, which no cut text holds."""
    part = F.split(F.col(output), "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
