"""Operator 11, fill-in-middle transformation: an Arrow-batched pandas UDF cuts and rearranges each text."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import content, for_python

#: A unit of a text, the marks, and the rates in percent.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    """Code points up to the end of each unit, eight bytes a unit, with the text's start before them."""
    ends = array("q", [0])
    ends.extend(m.end() for m in regex.finditer(UNIT, text))
    return ends


def seeds(doc_id: object, version: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document; a missing id is an empty string."""
    digest = hashlib.sha256(f"{version}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transformed(doc_id: object, text: str, version: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    ends = unit_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = seeds(doc_id, version)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first], ends[second]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _cut(version: int):
    @F.pandas_udf(CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [transformed(i, t, version) for i, t in zip(ids, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out["output_sha256"] = [hashlib.sha256(r[4].encode()).hexdigest() for r in rows]
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut


def fill_in_middle(docs: DataFrame, version: int = 1) -> DataFrame:
    """Documents with a middle moved to their end, behind marks: (doc_id, n, form, prefix_chars, middle_chars,
    output, output_sha256), one row for each input row, repeated rows included.

    A text is cut between units, runs of A-Z and a-z or single other characters; where and whether is drawn from
    a digest of ``version`` and doc_id, so reruns and other partitions agree, and rows that share an id share
    their draws.  A null doc_id draws as the empty string.  A null text is an empty one; an empty text and one
    that holds a mark stay plain.  Prefix, middle or suffix may be empty.  Texts are whole however long they are:
    eight bytes a unit and two copies are held while one is cut.  An empty table gives an empty result.  Only
    doc_id and text are read, other columns may have any names.
    """
    rows = for_python(docs).select("doc_id", _cut(version)(F.col("doc_id").cast("string"), content()).alias("_cut"))
    return rows.select("doc_id", "_cut.*")


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from output and form alone: no text that was cut holds a mark."""
    opening = F.when(form == "psm", PREFIX).otherwise(SUFFIX)
    between = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substr(output, F.length(opening) + 1)
    head, tail = F.split_part(body, between, F.lit(1)), F.split_part(body, between, F.lit(2))
    second, middle = F.split_part(tail, F.lit(MIDDLE), F.lit(1)), F.split_part(tail, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, second)).otherwise(F.concat(second, middle, head))
