"""Operator 10, best-fit packing: sum of squares."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import content, for_python
from roadlens.llm.encoder import encoder
from roadlens.session import saved

#: ``nth`` numbers a task's pieces: it deals pieces that share all else to different tasks.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
#: Pieces that one task packs in the first and in the second round; bins with a larger gap are packed again.
FIRST_ROUND, SECOND_ROUND, GAP_KEPT = 20_000, 100_000, 8


def _cut(path: str, room: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made = encoder(path), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                whole = np.append(ids(text.decode("utf-8", "replace")), end_id).astype("<u4")
                at, first = 0, len(whole) % room or room
                for piece, stop in enumerate(range(first, len(whole) + 1, room)):
                    out.append((doc, piece, at, stop - at, zlib.crc32(whole[at:stop].tobytes()), made))
                    at, made = stop, made + 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return run


def pieces_of(docs: DataFrame, tokenizer_path: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``room`` ids: only longer documents are cut, and only their first piece may be shorter."""
    rows = for_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), content().cast("binary").alias("content"))
    return rows.mapInArrow(_cut(tokenizer_path, room, end_id), PIECES)


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the gap of each bin.

    ``open_[g]`` counts open bins with residual gap g.  Moving a bin from gap g to g - s changes the sum of
    the squared counts by 2 * (open_[g - s] - open_[g]) + 2, or by 1 - 2 * open_[g] if it closes the bin; a new
    bin changes it by 2 * open_[room - s] + 1.  The smallest change is taken, the smaller gap on ties.  Longer
    lengths come first.
    """
    open_ = np.zeros(room + 1, np.int64)
    with_gap: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    gaps: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):
        s = int(lengths[k])
        here = open_[s:]
        change = 2 * (open_[: room + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        if change[best] <= (2 * open_[room - s] + 1 if s < room else 0):
            gap = best + s
            b = with_gap[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = room, len(gaps)
            gaps.append(room)
        bins[k], offsets[k] = b, room - gap
        gaps[b] = gap - s
        if gap > s:
            open_[gap - s] += 1
            with_gap[gap - s].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def _pack(room: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets, gaps = sum_of_squares(pdf["length"].to_numpy(np.int64), room)
        return pdf.assign(bin=bins, offset=offsets, gap=gaps[bins])

    return run


def _packed(pieces: DataFrame, n: int, a_task: int, room: int, number: int) -> DataFrame:
    buckets = max(1, math.ceil(n / a_task))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth", F.lit(number)), F.lit(buckets)))
    out = dealt.groupBy("bucket").applyInPandas(_pack(room), f"{PIECES}, bucket long, bin long, offset long, gap long")
    named = (F.lit(number << 60).cast("long") + F.shiftleft(F.col("bucket"), 30) + F.col("bin")).alias("sequence_id")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", named, "offset", "gap")


def pack(docs: DataFrame, tokenizer_path: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole documents into sequences of at most ``room`` ids.

    Texts are encoded once into a small table of pieces.  Pieces that fill a sequence are done; the others
    are dealt by hash (of rows that are alike, too) to tasks of about FIRST_ROUND pieces, each of which runs the sum-of-squares rule; the
    few sequences left with a gap above GAP_KEPT are dealt again to tasks of about SECOND_ROUND pieces.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Every row of ``docs`` is packed:
    an empty or null text is its end id alone, repeated rows are packed as often as they occur, a null doc_id
    stays null, an empty table gives an empty result.  Only doc_id and text are read, other columns may have any
    names.
    """
    pieces = saved(pieces_of(docs, tokenizer_path, room, end_id), "pieces")
    full = pieces.where(F.col("length") == room).withColumn("sequence_id", F.bitwise_not(F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < room)
    first = saved(_packed(rest, rest.count(), FIRST_ROUND, room, 1), "packed")
    kept, again = first.where(F.col("gap") <= GAP_KEPT), first.where(F.col("gap") > GAP_KEPT)
    second = _packed(again.select(*pieces.columns), again.count(), SECOND_ROUND, room, 2)
    return full.unionByName(kept.drop("gap")).unionByName(second.drop("gap")).drop("nth")
