"""Operator 7, quality rules: n-gram perplexity of words and of their bytes under modified Kneser-Ney models."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import content, for_python, running_totals
from roadlens.llm.textarrays import BASE, Words, as_bytes, mix, slices
from roadlens.session import discard, saved

#: Models that are broadcast together have so many bytes at most, or are the model of one language, whose
#: 2**24 trigrams, 2**16 pairs and 2**16 contexts of bytes are at most 135 MB.
MODEL_BYTES = 192 << 20
#: A band: from BAND lower deviations below to BAND upper deviations above the median log perplexity of a
#: language's texts of one length bin (powers of two from 2**FIRST_BIN to 2**LAST_BIN words; shorter and longer
#: texts go with the nearest).  A deviation is the robust one of the texts on its side, LEAST_DEVIATION (in log10
#: perplexity) at least.  Bins of fewer than LEAST_TEXTS texts take the band of their whole language, wider for
#: short texts of n words by sqrt(1 + SHORT / n).
BAND, SHORT, LEAST_DEVIATION = 3.5, 200.0, 0.004
FIRST_BIN, LAST_BIN, LEAST_TEXTS, ALL_LENGTHS = 6, 11, 30, -1
#: A text's words are less predictable than its band allows from WORD_BAND upper deviations above the median on.
WORD_BAND = 3.5
#: Trigrams of words are dealt by their middle word to classes of about so many; a class is one task's work.  Those of
#: a middle word with more than a quarter of it are dealt on by their first word.
CLASS_WORDS = 1_000_000
#: Classes are worked off in so many rounds, each of which holds its own share of the trigrams on disk only.
WORD_ROUNDS = 4
#: Slices of texts of one language that are dealt to classes together.
ROUTED_SLICES = 4
#: Identity of the two begins before a text's first word; bits of a word's identity; steps of a log10 chance.
PAD, WORD_BITS, CHANCE_STEPS = 0x5EED_0BE6_1A11, 48, 256
#: A discount is at least this, so that every symbol keeps a chance after every context.
LEAST_DISCOUNT = 0.05
#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Distinct trigrams that a task holds before it hands them on.
HELD_CODES = 2_000_000
#: A language of at most so many possible trigrams of its own bytes is looked up in a table of them (8 bytes each).
TABLE_CHANCES = 1 << 22


def _tallied(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    every, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(new)
    return every[at], np.add.reduceat(n, at) if len(at) else n


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes (24 bits) of all trigrams of bytes, and the bounds of each text.

    The symbols of a text are the bytes of its words, each word followed by a space; two spaces, which no two
    words have between them, stand before the first.
    """
    size = words.end - words.start + 1
    of_text = np.bincount(words.row, size, words.n_rows).astype(np.int64)
    stream = np.full(int(of_text.sum()) + 2 * words.n_rows, 32, np.uint32)
    begin = np.cumsum(size) - size + 2 * (words.row + 1)
    before = np.cumsum(size - 1) - (size - 1)
    stream[np.repeat(begin - before, size - 1) + np.arange(int(size.sum()) - len(size))] = words.data[words.inside]
    code = (stream[:-2] << 16) | (stream[1:-1] << 8) | stream[2:] if len(stream) > 2 else np.zeros(0, np.uint32)
    bounds = np.concatenate([[0], np.cumsum(of_text)])
    own = np.ones(len(code), bool)
    text_begins = (bounds + 2 * np.arange(words.n_rows + 1))[1:-1]  # windows that reach into the next text
    own[text_begins - 2] = own[text_begins - 1] = False
    return code[own], bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language: each task adds up its own before it hands them on."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (code, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int32)), pa.array(n)], ["lang", "code", "n"])
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").dictionary_encode(), as_bytes(batch.column("content"))
        names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for first, last in slices(texts):
            code, bounds = _trigrams(Words(texts, first, last))
            key = np.repeat(which[first:last].astype(np.uint64), np.diff(bounds)) << np.uint64(24) | code
            key, n = np.unique(key, return_counts=True)
            cuts = np.searchsorted(key >> np.uint64(24), np.arange(len(names) + 1))
            for k, name in enumerate(names):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    own = (key[a:b] & np.uint64((1 << 24) - 1)).astype(np.uint32), n[a:b].astype(np.int64)
                    held[name] = _tallied(*zip(held[name], own, strict=True)) if name in held else own
            if sum(len(c) for c, _ in held.values()) > HELD_CODES:
                yield from out()
    yield from out()


@dataclass
class Model:
    """One language's model: sorted arrays of codes, each with log10 values beside it."""

    trigrams: np.ndarray  # codes of three bytes, and their chances
    chances: np.ndarray
    contexts: np.ndarray  # codes of two bytes, and the weight of what is unseen behind them
    weights: np.ndarray
    pairs: np.ndarray  # codes of two bytes, and the second's continuation chance after the first
    pair_chances: np.ndarray
    after_one: np.ndarray  # of each byte, the weight of what is unseen behind it
    alone: np.ndarray  # of each byte, its own continuation chance
    table: tuple | None = None  # see _table; each worker's own

    def log_chances(self, code: np.ndarray) -> np.ndarray:
        """log10 chance of the last byte of each trigram after the two before it."""
        symbol, table = self._table()
        if table is None:
            return self._searched(code)
        a, b, c = symbol[code >> np.uint32(16)], symbol[(code >> np.uint32(8)) & np.uint32(0xFF)], symbol[code & np.uint32(0xFF)]
        size = np.int32(len(table))
        out = table.ravel().take((a * size + b) * size + c, mode="clip")
        new = np.flatnonzero((a | b | c) < 0)
        if len(new):
            out[new] = self._searched(code[new])
        return out

    def _table(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Numbers of the bytes that occur (-1: none), and the chances of all their trigrams, if these are few enough."""
        if self.table is None:
            used = np.unique(np.concatenate([self.trigrams >> np.uint32(16), (self.trigrams >> np.uint32(8)) & np.uint32(0xFF), self.trigrams & np.uint32(0xFF)]))
            symbol, size = np.full(256, -1, np.int32), len(used)
            symbol[used] = np.arange(size)
            if size**3 > TABLE_CHANCES:
                self.table = symbol, None
                return self.table
            pair = (self.after_one[used][:, None] + self.alone[used]).astype(np.float64)
            pair[symbol[self.pairs >> np.uint32(8)], symbol[self.pairs & np.uint32(0xFF)]] = self.pair_chances
            weight = np.zeros((size, size))
            weight[symbol[self.contexts >> np.uint32(8)], symbol[self.contexts & np.uint32(0xFF)]] = self.weights
            table = weight[:, :, None] + pair
            table[symbol[self.trigrams >> np.uint32(16)], symbol[(self.trigrams >> np.uint32(8)) & np.uint32(0xFF)], symbol[self.trigrams & np.uint32(0xFF)]] = self.chances
            self.table = symbol, table
        return self.table

    def _searched(self, code: np.ndarray) -> np.ndarray:
        out, seen = _find(self.trigrams, self.chances, code)
        new = code[~seen]
        if len(new):
            last, first = new & np.uint32(0xFF), (new >> np.uint32(8)) & np.uint32(0xFF)
            pair, known = _find(self.pairs, self.pair_chances, new & np.uint32(0xFFFF))
            pair = np.where(known, pair, self.after_one[first] + self.alone[last])
            out[~seen] = _find(self.contexts, self.weights, new >> np.uint32(8))[0] + pair
        return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the wanted keys (0 where there is none), and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    seen = keys[at] == wanted
    return np.where(seen, values[at].astype(np.float64), 0.0), seen


def _discounted(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney: the discount of each count, by the numbers of counts of one to four."""
    n1, n2, n3, n4 = (int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4))
    d = [0.5, 0.75, 0.9]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    d = [min(max(x, LEAST_DISCOUNT), float(k + 1)) for k, x in enumerate(d)]
    return np.array(d)[np.minimum(n, 3) - 1]


def _level(codes: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated chances of the codes given those of the level below, and contexts with their unseen weight."""
    contexts, of = np.unique(codes >> np.uint32(8), return_inverse=True)
    discount = _discounted(n)
    total = np.bincount(of, n, len(contexts))
    weight = np.bincount(of, discount, len(contexts)) / total
    return (n - discount) / total[of] + weight[of] * lower, contexts, weight


def kneser_ney(codes: np.ndarray, n: np.ndarray) -> Model:
    """The model of one language from all its trigrams (sorted codes) and their counts.

    Trigrams count as often as they occur; pairs and single bytes count by the different bytes before them.
    """
    pairs, pair_n = np.unique(codes & np.uint32(0xFFFF), return_counts=True)
    ones, one_n = np.unique(pairs & np.uint32(0xFF), return_counts=True)
    one_d = _discounted(one_n)
    alone = np.full(256, one_d.sum() / one_n.sum() / 256)
    alone[ones] += (one_n - one_d) / one_n.sum()
    pair_chance, firsts, first_weight = _level(pairs, pair_n, alone[pairs & np.uint32(0xFF)])
    after_one = np.ones(256)
    after_one[firsts] = first_weight
    chance, contexts, weight = _level(codes, n, pair_chance[np.searchsorted(pairs, codes & np.uint32(0xFFFF))])
    logs = (np.log10(x).astype(np.float32) for x in (chance, weight, pair_chance, after_one, alone))
    chance, weight, pair_chance, after_one, alone = logs
    return Model(codes, chance, contexts, weight, pairs, pair_chance, after_one, alone)


_PARTS = {"trigrams": "<u4", "chances": "<f4", "contexts": "<u4", "weights": "<f4", "pairs": "<u4", "pair_chances": "<f4", "after_one": "<f4", "alone": "<f4"}
_STORED = f"lang string, bytes long, {', '.join(f'{k} binary' for k in _PARTS)}"


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("code")
    model = kneser_ney(pdf["code"].to_numpy(np.uint32), pdf["n"].to_numpy(np.int64))
    parts = {k: getattr(model, k).astype(t).tobytes() for k, t in _PARTS.items()}
    return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "bytes": sum(map(len, parts.values())), **parts}])


def _language() -> Column:
    """A key of the language that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("none"))


def fit(docs: DataFrame) -> DataFrame:
    """The models of all languages, one row each, from counts over all texts: a saved table.

    ``turn`` numbers the broadcasts: languages are taken in turns of MODEL_BYTES.
    """
    texts = for_python(docs).select(_language().alias("lang"), content().cast("binary").alias("content"))
    counts = saved(texts.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "trigrams")
    models = saved(counts.groupBy("lang").applyInPandas(_fitted, _STORED), "models")  # at most 2**24 rows a language
    discard(counts)
    sizes = models.select("lang", "bytes", F.xxhash64("lang").alias("h"))
    before = running_totals(sizes, [], "h", ["lang"], {"before": "bytes"}).select("lang", F.floor(F.col("before") / MODEL_BYTES).cast("int").alias("turn"))
    return saved(models.join(before, "lang"), "models")


def _repeated(words: Words) -> np.ndarray:
    """Words of each text in 3-word windows that the text has twice or more."""
    hashes = words.hashes()
    grams, at = words.grams(hashes, 3)
    row = words.row[at]
    code = mix(grams + row.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(code, kind="stable")
    same = np.zeros(len(code), bool)
    equal = code[order][1:] == code[order][:-1]
    same[1:] |= equal
    same[:-1] |= equal
    starts = at[order[same]]
    inside = np.zeros(len(hashes), np.int64)
    for k in range(3):
        inside[starts + k] = 1
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[words.bounds[1:]] - total[words.bounds[:-1]]


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _log_perplexity(models: dict[str, Model], words: Words, langs: list[str]) -> np.ndarray:
    """Mean negative log10 chance of the symbols of each text (0 without words)."""
    code, bounds = _trigrams(words)
    chance = np.zeros(len(code))
    which = np.repeat(np.arange(words.n_rows), np.diff(bounds))
    numbers = {name: k for k, name in enumerate(dict.fromkeys(langs))}
    of_text = np.array([numbers[x] for x in langs])
    for name, k in numbers.items():
        own = of_text[which] == k if len(numbers) > 1 else slice(None)
        chance[own] = models[name].log_chances(code[own])
    return -np.bincount(which, chance, words.n_rows) / np.maximum(np.diff(bounds), 1)


def _measured(models):
    symbol_bytes = np.zeros(256, bool)
    symbol_bytes[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, langs, texts = batch.column("row"), batch.column("lang"), as_bytes(batch.column("content"))
            names = langs.to_pylist()
            for first, last in slices(texts):
                words = Words(texts, first, last)
                n = np.diff(words.bounds)
                letter = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                in_words = np.concatenate([[0], np.cumsum(letter[words.end] - letter[words.start])])
                marks = np.concatenate([[0], np.cumsum(symbol_bytes[words.data])])
                columns = [
                    n, in_words[words.bounds[1:]] - in_words[words.bounds[:-1]], marks[words.cuts[1:]] - marks[words.cuts[:-1]],
                    np.array([_repeated_lines(texts[k].as_py()) for k in range(first, last)], np.int64), _repeated(words),
                ]
                mean = pa.array(_log_perplexity(models.value, words, names[first:last]), mask=n == 0)
                arrays = [rows.slice(first, last - first), langs.slice(first, last - first), *[pa.array(x.astype(np.int64)) for x in columns], mean]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "lang", *MEASURES, "log_perplexity"])

    return run


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _keys() -> list[Column]:
    """128 bits by which equal texts of one language meet."""
    return [F.xxhash64(_language(), content()).alias("key"), F.xxhash64(F.lit(7), content(), _language()).alias("key2")]


def _in_turns(rows: DataFrame, models: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``task`` of the broadcast models, run over the rows of their languages, turn after turn."""
    turns = (models.agg(F.max("turn")).first()[0] or 0) + 1
    out = None
    for k in range(turns):
        stored = models.where(F.col("turn") == k).select("lang", *_PARTS).collect()  # bounded by MODEL_BYTES or one language
        of_turn = {r["lang"]: Model(*[np.frombuffer(r[p], t) for p, t in _PARTS.items()]) for r in stored}
        mine = rows if turns == 1 else rows.join(models.where(F.col("turn") == k).select("lang"), "lang", "left_semi").select(*rows.columns)
        part = mine.mapInArrow(task(of_turn), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _rows(docs: DataFrame, models: DataFrame) -> DataFrame:
    """The measures of each text, beside its doc_id in the struct ``row`` and its keys."""
    broadcast = for_python(docs).sparkSession.sparkContext.broadcast
    rows = docs.select(F.struct("doc_id", *_keys()).alias("row"), _language().alias("lang"), content().cast("binary").alias("content"))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, lang string, {', '.join(f'{m} long' for m in MEASURES)}, log_perplexity double"
    out = _in_turns(rows, models, lambda of_turn: _measured(broadcast(of_turn)), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _all_measures(docs: DataFrame) -> DataFrame:
    """Measures of all texts, of bytes and of words: a saved table."""
    models = fit(docs)
    rows = saved(_rows(docs, models), "measures")
    words = word_perplexity(docs, models, rows.agg(F.sum("n_words")).first()[0] or 0)
    mean = F.when(F.col("n_words") > 0, -F.col("log_chance") / F.col("n_words"))
    named = rows.select("row.*", "lang", *MEASURES, "base_failed", "log_perplexity").join(words, ["key", "key2"], "left")
    out = saved(named.withColumn("word_log_perplexity", mean).drop("log_chance"), "measures")
    discard(models, rows, words)
    return out


def _word_ids(words: Words, of_lang: int) -> np.ndarray:
    """WORD_BITS bits of each word's hash, with that of its language."""
    return mix(words.hashes() + np.uint64(of_lang)) >> np.uint64(64 - WORD_BITS)


def _word_trigrams(ids: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and middle word of each word's trigram; two begins stand before each text."""
    middle, first = np.full(len(ids), PAD, np.uint64), np.full(len(ids), PAD, np.uint64)
    middle[1:], first[2:] = ids[:-1], ids[:-2]
    begin = words.bounds[:-1][np.diff(words.bounds) > 0]
    middle[begin] = first[begin] = PAD
    first[begin[begin + 1 < len(ids)] + 1] = PAD  # where a text has one word, the next one begins there
    return first, middle


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, Words]]:
    """Slices of texts of one language: its key, a hash of it, rows and words."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        which = langs.indices.to_numpy()
        rows = batch.take(pa.array(np.argsort(which, kind="stable")))
        cuts = np.searchsorted(np.sort(which), np.arange(len(langs.dictionary) + 1)).tolist()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = rows.slice(cuts[k], cuts[k + 1] - cuts[k])
            texts = as_bytes(own.column("content"))
            salt = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
            for some in itertools.batched(slices(texts), ROUTED_SLICES):
                first, last = some[0][0], some[-1][1]
                yield lang, salt, own.slice(first, last - first), Words(texts, first, last)


def _count_middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word is in the middle of a trigram: each task adds up its own before it hands them on."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (word, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(word.astype(np.int64)), pa.array(n)], ["lang", "word", "n"])
        held.clear()

    for lang, salt, _, words in _by_language(batches):
        word, n = np.unique(_word_trigrams(_word_ids(words, salt), words)[1], return_counts=True)
        own = word, n.astype(np.int64)
        held[lang] = _tallied(*zip(held[lang], own, strict=True)) if lang in held else own
        if sum(len(n) for _, n in held.values()) > HELD_CODES:
            yield from out()
    yield from out()


def _six(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _spelt(model: Model, words: Words, which: np.ndarray) -> np.ndarray:
    """log10 chance of words by their bytes and the space behind them, after the last byte before and a space."""
    size = words.end[which] - words.start[which] + 1
    begin = np.cumsum(size) - size
    at = np.repeat(words.start[which] - begin, size) + np.arange(int(size.sum()))
    stream = words.data[np.minimum(at, len(words.data) - 1)].astype(np.uint32)
    stream[begin + size - 1] = 32
    one, two = np.full(len(stream), 32, np.uint32), np.full(len(stream), 32, np.uint32)  # the bytes before
    one[1:], two[2:] = stream[:-1], stream[:-2]
    one[begin] = 32
    inner = which > words.bounds[words.row[which]]
    two[begin] = np.where(inner, words.data[words.end[np.maximum(which - 1, 0)] - 1], 32)
    second = begin + 1  # a word has a byte and its space at least
    two[second] = 32
    return np.add.reduceat(model.log_chances(two << 16 | one << 8 | stream), begin) if len(begin) else np.zeros(0)


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte, so that the shuffle's compression meets runs of zeros."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def _route(models, hot, classes: int, turn: int):
    """Trigrams of words whose class belongs to this round: one row a slice of texts and class.

    ``trigrams`` has six bytes a word (the middle one with its share of a hot word's first words) and two of the last
    word's chance by its bytes; ``texts`` numbers the texts of the slice, twice, and one more for the second half;
    ``lengths`` counts their trigrams.  ``keys`` tells in one row of each slice whose the texts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for lang, salt, rows, words in _by_language(batches):
            ids = _word_ids(words, salt)
            first, middle = _word_trigrams(ids, words)
            names, parts = hot.value.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
            if len(names):
                at = np.minimum(np.searchsorted(names, middle), len(names) - 1)
                among = np.flatnonzero(names[at] == middle)
                share = mix(first[among]) % parts[at[among]]
                middle[among] = mix(middle[among] + np.uint64(BASE) * (share + np.uint64(1))) >> np.uint64(64 - WORD_BITS)
            of = (mix(middle + np.uint64(salt)) % np.uint64(classes)).astype(np.int32)
            mine = np.flatnonzero(of % WORD_ROUNDS == turn)
            if not len(mine):
                continue
            mine = mine[np.argsort(of[mine], kind="stable")]
            chance = np.clip(np.rint(_spelt(models.value[lang], words, mine) * CHANCE_STEPS), -32768, 0).astype("<i2")
            body = np.concatenate([_six(first[mine]), _six(middle[mine]), _six(ids[mine]), chance.view(np.uint8).reshape(-1, 2)], axis=1)
            cuts = np.append(np.flatnonzero(np.diff(of[mine], prepend=-1)), len(mine)).tolist()
            half, name, out = rows.column("half").to_numpy(), next(number), []
            keys: bytes | None = np.stack([rows.column(k).to_numpy() for k in ("key", "key2")], axis=1).astype("<i8").tobytes()
            for a, b in itertools.pairwise(cuts):
                texts, lengths = np.unique(words.row[mine[a:b]], return_counts=True)
                out.append((int(of[mine[a]]), lang, name, body[a:b].tobytes(), _planes(2 * texts + half[texts]), _planes(lengths), keys))
                keys = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _ROUTED_TYPES, strict=True)], _ROUTED_NAMES)

    return run


_ROUTED = "class int, lang string, slice long, trigrams binary, texts binary, lengths binary, keys binary"
_ROUTED_NAMES = [x.split(" ")[0] for x in _ROUTED.split(", ")]
_ROUTED_TYPES = [pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 4]


def word_chances(first: np.ndarray, middle: np.ndarray, last: np.ndarray, base: np.ndarray, half: np.ndarray) -> np.ndarray:
    """log10 chance of the last word of each trigram under the interpolated model of the other half of the texts.

    Trigrams count as often as they occur in that half, pairs by the different words before them; below the pairs
    lies ``base``, the log10 chance of the last word by its bytes.  Each half has its own discounts.
    """
    context, pair = mix(mix(first) + middle), mix(mix(middle) + last + np.uint64(1))
    _, one, trigram = np.unique(mix(context + last), return_index=True, return_inverse=True)
    context, (_, one_pair, pair) = np.unique(context[one], return_inverse=True)[1], np.unique(pair[one], return_index=True, return_inverse=True)
    middle = np.unique(middle[one][one_pair], return_inverse=True)[1]  # of each pair
    spelt, out = 10.0 ** base[one], np.empty(len(first))
    for k in (0, 1):
        n = np.bincount(trigram[half == k], minlength=len(one))
        different = np.bincount(pair, n > 0).astype(np.int64)
        lower = _interpolated(different, middle, np.zeros(len(one_pair)))  # and the weight of the words by bytes
        lower = lower[0][pair] + lower[1][middle][pair] * spelt
        chance, weight = _interpolated(n, context, lower)
        own = half != k
        out[own] = np.log10(chance + weight[context] * lower)[trigram[own]]
    return out


def _interpolated(n: np.ndarray, of: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted share of each count (0: none) among those of its context, and the weight of what lies below."""
    seen = np.flatnonzero(n)
    discount = np.zeros(len(n))
    discount[seen] = _discounted(n[seen])
    total = np.bincount(of, n)
    weight = np.where(total > 0, np.bincount(of, discount) / np.maximum(total, 1), 1.0)
    return (n - discount) / np.maximum(total, 1)[of], weight


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of log10 chances by text over all trigrams of a class and language.  Rows come class by class."""
    rows = (r for batch in batches for r in zip(*(batch.column(k) for k in _ROUTED_NAMES), strict=True))
    for _, own in itertools.groupby(rows, key=lambda r: (r[0].as_py(), r[1].as_py())):
        own = [(r[2], np.frombuffer(r[3].as_buffer(), np.uint8).reshape(-1, 20), _numbers(r[4]), _numbers(r[5]), r[6]) for r in own]
        body = np.concatenate([r[1] for r in own])
        texts, lengths = (np.concatenate([r[k] for r in own]) for k in (2, 3))
        wide = np.zeros((3, len(body), 8), np.uint8)
        for k in range(3):
            wide[k, :, :6] = body[:, 6 * k : 6 * k + 6]
        first, middle, last = wide.view("<u8")[:, :, 0]
        base = np.ascontiguousarray(body[:, 18:]).view("<i2")[:, 0] / CHANCE_STEPS
        chances = word_chances(first, middle, last, base, np.repeat(texts & 1, lengths))
        sums = np.add.reduceat(chances, np.cumsum(lengths) - lengths).astype("<f4")
        cuts = np.cumsum([0, *(len(r[2]) for r in own)])
        columns = [
            pa.array([r[0].as_py() for r in own], pa.int64()), pa.array([_planes(r[2] >> 1) for r in own]),
            pa.array([sums[a:b].tobytes() for a, b in itertools.pairwise(cuts)]), pa.array([r[4].as_py() for r in own], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "texts", "sums", "keys"])


def _text_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the classes of a round for each text.  Rows come slice by slice, the one with the keys first."""
    rows = (r for batch in batches for r in zip(*(batch.column(k) for k in ("slice", "keys", "texts", "sums")), strict=True))
    for _, own in itertools.groupby(rows, key=lambda r: r[0].as_py()):
        keys = sums = None
        for _, held, texts, part in own:
            if keys is None:
                keys = np.frombuffer(held.as_buffer(), "<i8").reshape(-1, 2)
                sums = np.zeros(len(keys))
            sums[_numbers(texts)] += np.frombuffer(part.as_buffer(), "<f4")
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sums)], ["key", "key2", "sum"])


def _hot_middles(texts: DataFrame, classes: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Words that are too often in the middle for one class (at most four a class), and the shares they are dealt to."""
    if classes == 1:
        return {}
    most = max(1, CLASS_WORDS // 4)
    n = texts.select("lang", "content").mapInArrow(_count_middles, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found: dict[str, list] = {}
    for r in n.where(F.col("n") > most).collect():
        found.setdefault(r["lang"], []).append((r["word"], -(-r["n"] // most)))
    return {lang: tuple(np.array(x, np.uint64) for x in zip(*sorted(rows), strict=True)) for lang, rows in found.items()}


def word_perplexity(docs: DataFrame, models: DataFrame, n_words: int) -> DataFrame:
    """Sums of the words' log10 chances: a saved table (key, key2, log_chance), one row a language and text.

    A text without words has 0 or no row.

    The model is interpolated: trigrams of words, below them pairs by continuation counts, below them the word's bytes
    under the language's byte model, so that any word has a chance and no word is cut.  Discounts are modified
    Kneser-Ney ones.  Texts are halved by their hash (equal texts lie in one half); a text is scored under the counts of the
    other half, since its own would make its rare trigrams likely.

    No model is gathered: trigrams are dealt by language and middle word to classes of about CLASS_WORDS, so that a
    trigram, its context, its pair and their totals meet in one task.  Discounts are those of the class.  A middle word
    too frequent for a class is dealt on by the first word, each share with its own continuation counts.  Classes
    depend on the words alone, not on partitions.
    """
    broadcast = for_python(docs).sparkSession.sparkContext.broadcast
    classes = max(1, -(-n_words // CLASS_WORDS))
    texts = docs.select(*_keys(), _language().alias("lang"), content().cast("binary").alias("content"))
    texts = texts.withColumn("half", F.pmod(F.xxhash64("content"), F.lit(2)).cast("int"))
    hot = broadcast(_hot_middles(texts, classes))
    rounds = []
    for turn in range(min(WORD_ROUNDS, classes)):
        routed = _in_turns(texts, models, lambda of_turn: _route(broadcast(of_turn), hot, classes, turn), _ROUTED)  # noqa: B023
        dealt = routed.repartitionById(-(-classes // WORD_ROUNDS), F.floor(F.col("class") / WORD_ROUNDS).cast("int")).sortWithinPartitions("class", "lang")
        sums = dealt.mapInArrow(_class_sums, "slice long, texts binary, sums binary, keys binary")
        sums = sums.repartition("slice").sortWithinPartitions("slice", F.col("keys").isNull())
        rounds.append(saved(sums.mapInArrow(_text_sums, "key long, key2 long, sum double"), "word_sums"))
    # Copies of a text have the same sum in a round: it counts once.
    once = reduce(DataFrame.unionByName, [r.groupBy("key", "key2").agg(F.max("sum").alias("sum")) for r in rounds])
    out = saved(once.groupBy("key", "key2").agg(F.sum("sum").alias("log_chance")), "word_chances")
    discard(*rounds)
    return out


def _bin() -> Column:
    power = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)).cast("double")))
    return F.least(F.greatest(power, F.lit(FIRST_BIN)), F.lit(LAST_BIN)).cast("int")


def _bands(rows: DataFrame) -> DataFrame:
    """Medians and deviations of the log perplexities of the texts that pass the base rules, by language and length bin."""
    judged = rows.where(~F.col("base_failed")).select("lang", "log_perplexity", "word_log_perplexity", F.explode(F.array(_bin(), F.lit(ALL_LENGTHS))).alias("bin"))
    # Saved, so that Spark knows its size: a few languages are broadcast, and a frequent one is never dealt to one task.
    median = lambda x: F.percentile_approx(x, 0.5, 10_000)
    middle = saved(judged.groupBy("lang", "bin").agg(median("log_perplexity").alias("middle"), median("word_log_perplexity").alias("word_middle")), "middles")
    off, word_off = F.col("log_perplexity") - F.col("middle"), F.col("word_log_perplexity") - F.col("word_middle")
    spread = lambda side: F.coalesce(1.4826 * median(F.when(side >= 0, side)), F.lit(0.0))
    bands = judged.join(middle, ["lang", "bin"]).groupBy("lang", "bin")
    sides = [F.max("middle").alias("middle"), spread(-off).alias("below"), spread(off).alias("above")]
    bands = saved(bands.agg(F.count("*").alias("n"), *sides, F.max("word_middle").alias("word_middle"), spread(word_off).alias("word_above")), "bands")
    discard(middle)
    return bands


def _verdicts(rows: DataFrame, bands: DataFrame) -> DataFrame:
    band = F.struct("middle", "below", "above", "word_middle", "word_above")
    own = bands.where((F.col("bin") != ALL_LENGTHS) & (F.col("n") >= LEAST_TEXTS)).select("lang", "bin", band.alias("own"))
    whole = bands.where(F.col("bin") == ALL_LENGTHS).select("lang", band.alias("whole"))
    rows = rows.withColumn("bin", _bin()).join(own, ["lang", "bin"], "left").join(whole, "lang", "left")
    wider = F.when(F.col("own").isNull(), F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1)))).otherwise(1.0)
    band, off = F.coalesce("own", "whole"), F.col("log_perplexity")
    width = lambda side, deviations=BAND: deviations * F.greatest(band[side], F.lit(LEAST_DEVIATION)) * wider
    inside = off.between(band["middle"] - width("below"), band["middle"] + width("above"))
    inside &= F.col("word_log_perplexity") <= band["word_middle"] + width("word_above", WORD_BAND)
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True))))


def quality(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each whole text.

    The base rules fail texts of fewer than LEAST_WORDS words or with more than half of their words in repeated
    3-word windows.  The others are judged by two perplexities under interpolated trigram models of their language with
    modified Kneser-Ney discounts and continuation counts: of the bytes of their words, which tells spelling, and of
    the words, which tells their order (word_perplexity).  Every trigram of every text counts.  A text is rejected if
    the first lies outside the band of its language and length bin, or the second above its own.  A text that is
    more predictable in its words than others is not rejected: copies are for the operators that remove them.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    log_perplexity (log10 a byte or space), word_log_perplexity (log10 a word; both null without words): one row for
    each input row, in whatever number it occurs.  Null texts are empty; null languages are a language of their own; a
    null doc_id stays null; an empty table gives an empty result.  Only doc_id, lang and text are read, other columns
    may have any names.
    """
    rows = _all_measures(docs)
    return _verdicts(rows, _bands(rows)).select("doc_id", *MEASURES, "base_failed", "kept", "log_perplexity", "word_log_perplexity")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, all columns as they are, whatever their names.

    A verdict depends on language and text alone, so rejected texts are dropped by their keys where rows are read; texts
    are not shuffled while Spark can broadcast those keys.  Nulls, empty texts and repeated rows count as in
    quality(): a repeated row stays or goes with its likes; an empty table gives an empty result.
    """
    rows = _all_measures(docs)
    bands = _bands(rows)
    dropped = saved(_verdicts(rows, bands).where(~F.col("kept")).select("key", "key2").distinct(), "dropped")
    discard(rows, bands)
    return docs.select(F.struct("*").alias("row"), *_keys()).join(dropped, ["key", "key2"], "left_anti").select("row.*")
