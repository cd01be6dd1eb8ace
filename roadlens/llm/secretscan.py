"""Operator 12, secret scans: all rules in one deterministic automaton, one pass over the bytes of each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.automaton import Automaton, Rule, Scanner
from roadlens.llm.common import content, for_python

# The base rules, and formats of well-known keys that come on top.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # the same as runs of any length of which shorter ones are dropped
]
MORE = [
    Rule("service_key", r"(?:gh[opsu]_|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_.-]+", 30),
    Rule("private_key", r"-----BEGIN\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+!$&*-]+@"),
]
RULES = BASE + MORE
MASK = "[secret]"


@cache
def automaton() -> Automaton:
    """The automaton of RULES; its size depends on the rules alone."""
    return Automaton(RULES)


def spans_of(scanner: Scanner, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then in the order of the rules."""
    data = text.encode()
    found = sorted((start, k, end) for k, start, end in scanner.matches(data))
    if len(data) == len(text):
        return [(scanner.rules[k].kind, start, end) for start, k, end in found]
    place, at, points = {}, 0, 0
    for byte in sorted({b for start, _, end in found for b in (start, end)}):
        points += len(data[at:byte].decode())
        place[byte], at = points, byte
    return [(scanner.rules[k].kind, place[start], place[end]) for start, k, end in found]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by MASK."""
    parts, done, reach = [], 0, -1
    for _, start, end in spans:
        if start >= reach:
            parts += [text[max(done, reach) : start], MASK]
            done = start
        reach = max(reach, end)
    return "".join([*parts, text[max(done, reach, 0) :]])


def scan_secrets(docs: DataFrame, mask: bool = False) -> DataFrame:
    """Secrets in each whole text: (doc_id, spans), spans an array of (kind, start, end), with ``mask`` also
    ``masked``, the text with its secrets replaced.

    Kinds are those of RULES; the matches of a kind are leftmost, longest, do not overlap, and those shorter than
    the rule's least length are dropped after they were found.  Spans count code points, end exclusive, and are in
    order of start, then of the rules.  One row for each input row, repeated rows and null doc_ids included; a null
    or empty text has no spans; an empty table gives an empty result.  Texts are scanned whole, byte by byte, with
    one byte a byte of text besides; the automaton is built once on the driver and sent along.  Only doc_id and
    text are read, other columns may have any names.
    """
    rows = for_python(docs).select("doc_id", content().alias("content"))
    compiled = automaton()
    names = ["doc_id", "spans", *(["masked"] if mask else [])]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(compiled)
        for batch in batches:
            texts = batch.column("content").to_pylist()
            found = [spans_of(scanner, t) for t in texts]
            listed = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in found], kind)
            more = [pa.array([masked(t, s) for t, s in zip(texts, found, strict=True)], pa.string())] if mask else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, *more], names)

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(run, schema + (", masked string" if mask else ""))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
