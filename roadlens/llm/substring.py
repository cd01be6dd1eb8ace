"""Operator 3, substring dedup: suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import content, for_python
from roadlens.llm.textarrays import Words, as_bytes, slices
from roadlens.session import discard, saved

#: Words of an anchor; the smallest anchor hash of a window is the window's route.
ANCHOR = 5
#: Routes in more documents than this are hot: their windows are routed one by one, by their own hash.
HOT_DOCUMENTS = 1000
#: Distinct passages of which one task builds an automaton.
SHARD_PASSAGES = 20_000
NO_ID = (1 << 63) - 1


class Windows:
    """The windows of ``length`` words of a slice: first word and route of each."""

    def __init__(self, words: Words, length: int):
        self.hashes = words.hashes()
        anchor = min(ANCHOR, length)
        grams, at = words.grams(self.hashes, anchor)
        every = np.full(len(self.hashes), np.iinfo(np.uint64).max, np.uint64)
        every[at] = grams
        n = max(0, len(self.hashes) - length + 1)
        least = every[:n].copy()
        for k in range(1, length - anchor + 1):
            np.minimum(least, every[k : k + n], out=least)
        self.at = np.flatnonzero(words.row[:n] == words.row[length - 1 :]) if n else np.zeros(0, np.int64)
        self.route = least[self.at].view(np.int64)
        self.row = words.row[self.at]


def _routes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            rows = batch.column("version").to_numpy(zero_copy_only=False)
            texts = as_bytes(batch.column("content"))
            for first, last in slices(texts):
                w = Windows(Words(texts, first, last), length)
                order = np.lexsort((w.route, w.row))
                route, row = w.route[order], w.row[order]
                new = np.ones(len(route), bool)
                new[1:] = (route[1:] != route[:-1]) | (row[1:] != row[:-1])
                at = first + row[new]
                yield pa.RecordBatch.from_arrays([pa.array(route[new]), pa.array(ids[at]), pa.array(rows[at])], ["route", "id", "version"])

    return run


def _passages(length: int):
    """Runs of windows with one repeated route as one passage; windows of hot routes one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            versions = batch.column("version").to_numpy(zero_copy_only=False)
            some, hot = batch.column("some"), batch.column("hot")
            texts = as_bytes(batch.column("content"))
            for first, last in slices(texts):
                words = Words(texts, first, last)
                w = Windows(words, length)
                whole, whole_at = words.grams(w.hashes, length)
                data = words.data.tobytes()
                out: list[tuple] = []
                cuts = np.searchsorted(w.row, np.arange(last - first + 1))
                for row in range(last - first):
                    a, b = cuts[row], cuts[row + 1]
                    if a == b:
                        continue
                    at, route = w.at[a:b], w.route[a:b]
                    base = words.bounds[row]
                    text = [data[s:e] for s, e in zip(words.start[base : words.bounds[row + 1]].tolist(), words.end[base : words.bounds[row + 1]].tolist(), strict=True)]
                    key = (int(ids[first + row]), int(versions[first + row]))
                    keep = np.flatnonzero(np.isin(route, some[first + row].values.to_numpy()))
                    if len(keep):
                        breaks = np.flatnonzero((np.diff(keep) != 1) | (np.diff(route[keep]) != 0)) + 1
                        for part in np.split(keep, breaks):
                            i, j = int(at[part[0]] - base), int(at[part[-1]] - base) + length
                            out.append((*key, i, int(route[part[0]]), b" ".join(text[i:j])))
                    for k in np.flatnonzero(np.isin(route, hot[first + row].values.to_numpy())).tolist():
                        i = int(at[k] - base)
                        own = int(whole[np.searchsorted(whole_at, at[k])].view(np.int64))
                        out.append((*key, i, own, b" ".join(text[i : i + length])))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "version", "start", "route", "passage"])

    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows the smallest label of a sequence it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NO_ID]

    def _state(self, length: int, link: int, moves: dict[bytes, int], least: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for its sequences of length(p) + 1 words."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), NO_ID)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], label: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}, NO_ID), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            self.least[last] = min(self.least[last], label)

    def finish(self) -> None:
        """Hand every label down the suffix links, longest states first."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            self.least[up] = min(self.least[up], self.least[v])

    def stream(self, words: list[bytes], length: int) -> list[int]:
        """Matching statistics of ``words``: where the longest known suffix has ``length`` words or more, the
        smallest label of a sequence with the last ``length`` words; elsewhere NO_ID.  One value a window."""
        out, v, known = [], 0, 0
        for k, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                known = self.length[v]
            if word in self.next[v]:
                v = self.next[v][word]
                known += 1
            while v and self.length[self.link[v]] >= length:  # the state of the last ``length`` words
                v = self.link[v]
                known = self.length[v]
            if k >= length - 1:
                out.append(self.least[v] if known >= length else NO_ID)
        return out


def _first_documents(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        alone = ~pdf["route"].duplicated(keep=False).to_numpy()
        passages = [p.split(b" ") for p in pdf["passage"]]
        labels = pdf["least"].tolist()
        for words, label, single in zip(passages, labels, alone, strict=True):
            if not single:
                automaton.add(words, label)
        automaton.finish()
        # A route with one passage holds no other sequence, so each of its windows first occurs in that passage.
        firsts = [[label] * (len(w) - length + 1) if single else automaton.stream(w, length) for w, label, single in zip(passages, labels, alone, strict=True)]
        return pd.DataFrame({"route": pdf["route"], "code": pdf["code"], "firsts": firsts})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, removed = batch.column("doc_id"), batch.column("removed")
        texts = as_bytes(batch.column("content"))
        length = batch.column("length")[0].as_py() if len(batch) else 0
        for first, last in slices(texts):
            words = Words(texts, first, last)
            data = words.data.tobytes()
            n_words, n_removed, kept = [], [], []
            for row in range(last - first):
                a, b = int(words.bounds[row]), int(words.bounds[row + 1])
                stay = np.ones(b - a, bool)
                if removed[first + row].is_valid:
                    change = np.zeros(b - a + 1, np.int64)
                    starts = removed[first + row].values.to_numpy()
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + length, -1)
                    stay = np.cumsum(change[:-1]) == 0
                start, end = words.start[a:b][stay].tolist(), words.end[a:b][stay].tolist()
                n_words.append(b - a)
                n_removed.append(b - a - len(start))
                kept.append(b" ".join([data[s:e] for s, e in zip(start, end, strict=True)]))
            arrays = [docs.slice(first, last - first), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_text"])


def _rows(docs: DataFrame) -> DataFrame:
    """Documents by an id that is never null, and by the version of their text where ids repeat."""
    rows = for_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), content().alias("content"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("content").alias("version"), "content")


def _shared_routes(docs: DataFrame, length: int) -> DataFrame:
    """Phase 1: of each document, the routes that other documents have too."""
    routes = _rows(docs).select("id", "version", F.col("content").cast("binary").alias("content")).mapInArrow(_routes(length), "route long, id long, version long")
    shared = routes.groupBy("route").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most")
    owned = routes.join(shared.select("route", (F.col("n") > HOT_DOCUMENTS).alias("is_hot")), "route")
    lists = owned.groupBy("id", "version").agg(
        F.collect_set(F.when(~F.col("is_hot"), F.col("route"))).alias("some"), F.collect_set(F.when(F.col("is_hot"), F.col("route"))).alias("hot")
    )
    return saved(lists, "routes")


def _cut_passages(docs: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """Phase 2: the passages of those routes."""
    rows = _rows(docs).select("id", "version", F.col("content").cast("binary").alias("content")).join(lists, ["id", "version"])
    cut = rows.mapInArrow(_passages(length), "id long, version long, start int, route long, passage binary")
    return saved(cut.withColumn("code", F.xxhash64("passage")), "passages")


def _distinct_passages(passages: DataFrame) -> DataFrame:
    return saved(passages.groupBy("route", "code", "passage").agg(F.min("id").alias("least")), "distinct")


def _answers(distinct: DataFrame, length: int) -> DataFrame:
    """Phase 3: of each distinct passage, the smallest document of each of its windows."""
    shards = max(1, -(-distinct.count() // SHARD_PASSAGES))
    dealt = distinct.groupBy(F.pmod(F.xxhash64("route", F.lit(1)), F.lit(shards)))
    return saved(dealt.applyInPandas(_first_documents(length), "route long, code long, firsts array<long>"), "firsts")


def _removed(passages: DataFrame, firsts: DataFrame) -> DataFrame:
    """Phase 4: of each document, the first words of the windows that a smaller document has."""
    met = passages.select("id", "version", "start", "route", "code").join(firsts, ["route", "code"])
    late = F.filter(F.transform("firsts", lambda first, k: F.when(first < F.col("id"), F.col("start") + k)), lambda k: k.isNotNull())
    met = met.select("id", "version", late.alias("late")).where(F.size("late") > 0)
    return saved(met.groupBy("id", "version").agg(F.flatten(F.collect_list("late")).alias("removed")), "removed")


def dedup_substrings(docs: DataFrame, length: int = 13) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that a document with a smaller doc_id has too.

    The reference is the corpus itself, whose automata no broadcast could hold.  So each window is routed by
    the smallest hash of its 5-word anchors: equal windows have equal routes.  Phase 1 finds the routes of two
    or more documents from small rows.  Phase 2 cuts the runs of windows of such routes as passages; routes of
    very many documents are dealt on by the hash of the whole window.  Phase 3 reduces equal passages to one
    with their smallest doc_id, builds a suffix automaton over each shard's passages, labelled with those ids,
    and streams the passages through it for matching statistics.  Phase 4 joins the answers to the documents.  Words
    are compared as bytes, so clashing hashes cost time and change nothing.

    Returns doc_id, n_words, n_removed, kept_text (binary; the kept words joined by one space), one row for
    each input row, repeated ones too.  Null texts have no words.  Rows that share a doc_id don't remove each
    other's words.  A null doc_id counts as larger than all others.  An empty table gives an empty result.  Only
    doc_id and text are read, other columns may have any names.
    """
    spark = docs.sparkSession
    lists = _shared_routes(docs, length)
    passages = _cut_passages(docs, lists, length)
    discard(lists)
    distinct = _distinct_passages(passages)
    firsts = _answers(distinct, length)
    discard(distinct)
    removed = _removed(passages, firsts)
    discard(passages, firsts)
    rows = _rows(docs).join(removed, ["id", "version"], "left")
    rows = rows.select("doc_id", F.col("content").cast("binary").alias("content"), "removed", F.lit(length).alias("length"))
    return rows.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text binary")
