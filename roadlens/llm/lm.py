"""Operator 5, LM scoring: a gated recurrent network in numpy."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.llm.common import content, for_python
from roadlens.llm.quality import _tallied
from roadlens.llm.textarrays import Words, as_bytes, slices
from roadlens.session import discard, saved

#: The end token's code.
END = 0x7E5D_0E5D_0E5D_0E5D
#: The most frequent tokens that tasks look up themselves; rarer ones meet their counts in a join.
HEAD = 1 << 20
#: Classes of the most frequent words, whose words have outputs of their own, words in such a class, classes to
#: which the hash deals all other words (a power of two), and units of the recurrent layer.
CLASSES, CLASS_WORDS, TAIL, UNITS = 32, 64, 32, 32
#: Truncated backpropagation: steps of a window (state is carried across the windows of a text), streams that
#: are trained on side by side, learning rate, and rounds after each of which the networks are averaged.
STEPS, BATCH, RATE, ROUNDS = 32, 128, 0.01, 4
#: Training texts are dealt to buckets of about so many tokens, and to so many buckets a round at most (beyond,
#: buckets grow).  A bucket trains one network.
BUCKET_TOKENS, BUCKETS = 1_000_000, 4096
#: Streams that are scored side by side, and scored texts in a batch.
STREAMS, SCORED_ROWS = 256, 4096
SMOOTH = 0.1


def _training(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens, an end after each text, and the bounds of each text."""
    bounds = words.bounds + np.arange(words.n_rows + 1)
    out = np.full(len(words.start) + words.n_rows, END, np.uint64)
    stay = np.ones(len(out), bool)
    stay[bounds[1:] - 1] = False
    out[stay] = words.hashes()
    return out, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts, waiting = [], [], 0
    for batch in batches:
        texts = as_bytes(batch.column("content"))
        for first, last in slices(texts):
            got, n = np.unique(_tokens(Words(texts, first, last, lower=True))[0], return_counts=True)
            codes.append(got)
            counts.append(n.astype(np.int64))
            waiting += len(got)
        if waiting > 2_000_000:
            c, n = _tallied(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(n)], ["token", "n"])
            codes, counts, waiting = [], [], 0
    if codes:
        c, n = _tallied(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(n)], ["token", "n"])


@dataclass
class Head:
    """The frequent tokens, sorted, with their counts, and the tail's classes.

    The place of a token is its output among the CLASSES * CLASS_WORDS most frequent ones, or -1 - c for class c
    of the tail, which is the lowest bits of its code, so that every token of any corpus has a place.
    """

    tokens: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    total: int
    types: int
    tail_totals: np.ndarray  # of each class of the tail, its training tokens and its distinct ones
    tail_types: np.ndarray
    first: np.ndarray | None = None  # see _at; each worker's own

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.total + SMOOTH * (self.types + 1)))

    def in_tail(self, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 chance of tokens within their class of the tail."""
        c = -1 - places
        return np.log10((counts + SMOOTH) / (self.tail_totals[c] + SMOOTH * (self.tail_types[c] + 1)))

    def _at(self, tokens: np.ndarray) -> np.ndarray:
        """For each token the first place whose token is not below it, at most the last place.

        Codes are hashes, so their top bits lead to it within a few steps, where a binary search takes twenty.
        """
        shift = np.uint64(64 - len(self.tokens).bit_length())
        if self.first is None:
            of_bits = np.bincount((self.tokens >> shift).astype(np.int64), minlength=1 << len(self.tokens).bit_length())
            self.first = np.concatenate([[0], np.cumsum(of_bits)[:-1]]).astype(np.int32)
        last = len(self.tokens) - 1
        at = np.minimum(self.first[(tokens >> shift).astype(np.int64)], last)
        below = np.flatnonzero(self.tokens[at] < tokens)
        while len(below := below[at[below] < last]):
            at[below] += 1
            below = below[self.tokens[at[below]] < tokens[below]]
        return at

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each token is here, its count and its place."""
        tail = -1 - (tokens & np.uint64(TAIL - 1)).astype(np.int32)
        if not len(self.tokens):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64), tail
        at = self._at(tokens)
        here = self.tokens[at] == tokens
        return here, np.where(here, self.counts[at], 0), np.where(here & (self.places[at] >= 0), self.places[at], tail).astype(np.int32)


def _head(counts: DataFrame) -> Head:
    of_class = counts.groupBy(F.col("token").bitwiseAND(TAIL - 1).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    totals, types = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in of_class:  # TAIL rows at most
        totals[r["c"]], types[r["c"]] = r["n"], r["types"]
    total, n_types = int(totals.sum()), int(types.sum())
    by_count = counts.groupBy("n").agg(F.count("*").alias("tokens"))  # as many rows as different counts
    upto = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc()))
    least = by_count.withColumn("upto", upto).where(F.col("upto") <= HEAD).agg(F.min("n")).first()[0]
    rows = counts.where(F.col("n") >= (least if least is not None else (1 << 62))).select("token", "n").toArrow()
    tokens, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    tokens, n = tokens[order], n[order]
    best = np.lexsort((tokens, -n))[: CLASSES * CLASS_WORDS]
    places = np.full(len(tokens), -1, np.int32)
    places[best] = np.arange(len(best))
    c = (tokens[best] & np.uint64(TAIL - 1)).astype(np.int64)
    return Head(tokens, n, places, total, n_types, totals - np.bincount(c, n[best], TAIL).astype(np.int64), types - np.bincount(c, minlength=TAIL))


def _exponentials(x: np.ndarray, at: np.ndarray, bias: np.ndarray, bias_at: np.ndarray, of: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of rows of logits, in place: of ``x`` and of the row ``of`` of ``bias``, whose exponentials are left out and returned.

    They are factors of columns, so products with ``x`` take them in without a pass over it.  Each row's maximum
    is subtracted only where floats would not hold the exponentials or their quotients; the factors are 1 then.
    ``at`` and ``bias_at`` are the flat places of each row's own logit, which comes first.
    """
    low = bias - bias.max(axis=1, keepdims=True)
    if max(float(x.max(initial=0)), -float(x.min(initial=0))) - float(low.min()) < 80:
        own = x.ravel()[at] + low.ravel()[bias_at]
        np.exp(x, out=x)
        return own, np.exp(low)
    x += low[of]
    x -= x.max(axis=1, keepdims=True)
    own = x.ravel()[at]
    np.exp(x, out=x)
    return own, np.ones_like(low)


def _placed(nth: int, shape: tuple[int, ...]) -> np.ndarray:
    """Zeros that begin with a cache line, and in another line of their page than those of other small ``nth``.

    Where numpy puts large arrays, every vector lies across two lines, and all arrays begin at one place of a page,
    so that writing one delays reading another.
    """
    size = int(np.prod(shape))
    held = np.zeros(size + 2048, np.float32)
    first = -held.ctypes.data % 4096 // 4 + nth * 13 % 64 * 16
    return held[first : first + size].reshape(shape)


class Space:
    """Arrays by name that one window after another fills: page faults of fresh ones cost as much as the arithmetic."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = _placed(len(self.held), (size,))
        return self.held[name][:size].reshape(shape)

    def rows(self, name: str, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return x.take(at, axis=0, out=self(name, len(at), x.shape[1]), mode="clip")


def _blocks(n: int, size: int = 2048) -> list[slice]:
    """Rows whose logits fit the cache."""
    return [slice(a, min(a + size, n)) for a in range(0, n, size)]


#: Classes by place; those of the tail, whose places are negative, from the end.
_CLASS = np.append(np.repeat(np.arange(CLASSES), CLASS_WORDS), np.arange(CLASSES + TAIL - 1, CLASSES - 1, -1))


@dataclass
class Network:
    """Gated recurrent units; output: a class of words, then a word of the class.  The last classes are the tail's."""

    head_counts: np.ndarray  # of the words by place
    tail_counts: np.ndarray  # of the classes of the tail
    p: dict[str, np.ndarray] = field(default_factory=dict)
    space: Space = field(default_factory=Space)

    #: Inputs besides the frequent words: the classes of the tail and the begin of a text.
    WORDS, BEGIN = CLASSES * CLASS_WORDS, CLASSES * CLASS_WORDS + TAIL

    @staticmethod
    def inputs_of(places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, places, Network.WORDS - 1 - places)

    @staticmethod
    def classes_of(places: np.ndarray) -> np.ndarray:
        return _CLASS[places]

    def start(self, seed: int = 11) -> Network:
        """Random recurrent weights; outputs that give the tokens' own frequencies."""
        rng = np.random.default_rng(seed)
        n = np.zeros(CLASSES * CLASS_WORDS)
        n[: len(self.head_counts)] = self.head_counts
        by_class = np.append(n.reshape(CLASSES, CLASS_WORDS).sum(axis=1), self.tail_counts) + 0.01
        inside = np.where(n > 0, np.log(np.maximum(n, 1)), -30.0).reshape(CLASSES, CLASS_WORDS)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "inputs": normal(self.BEGIN + 1, 3 * UNITS, scale=0.3),
            "state": normal(UNITS, 3 * UNITS, scale=UNITS**-0.5),
            "class": np.zeros((UNITS, CLASSES + TAIL), np.float32),
            "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
            "word": np.zeros((CLASSES, CLASS_WORDS, UNITS), np.float32),
            "word_bias": (inside - inside.max(axis=1, keepdims=True)).astype(np.float32),
        }
        return self

    def _planes(self) -> np.ndarray:
        """The recurrent weights of update, reset and new state, (3, units, units)."""
        return np.ascontiguousarray(self.p["state"].reshape(UNITS, 3, UNITS).transpose(1, 0, 2))

    @staticmethod
    def _begins(keep: np.ndarray | None, steps: int) -> list[np.ndarray]:
        """The streams in which a text begins, of each step."""
        if keep is None:
            return [np.zeros(0, np.int64)] * steps
        t, stream = np.nonzero(keep == 0)
        cuts = np.searchsorted(t, np.arange(steps + 1)).tolist()
        return [stream[a:b] for a, b in itertools.pairwise(cuts)]

    def _run(self, inputs: np.ndarray, keep: np.ndarray | None, h: np.ndarray, trace: bool = False) -> tuple[np.ndarray, ...]:
        """States after each input of a window (steps, streams, units), valid until the next run; with ``trace``, what
        backpropagation needs besides: the states before, the gates, and the factors that lead back to update, reset and new state.

        The three parts of inputs and weights lie apart, so that every step works on contiguous rows, which stay in
        the cache, and a window's states are a matrix with a row for each token.  Gates are 1 / (1 + exp(-x)).
        """
        u, one = self._planes(), np.float32(1)
        u[:2] *= np.float32(-1)
        steps, streams = inputs.shape
        parts, table = 3 * inputs[:, None] + np.arange(3)[:, None], self.p["inputs"].reshape(-1, UNITS)
        begins, kept, space, before = self._begins(keep, steps), steps if trace else 1, self.space, []
        states, gates, factors = space("states", steps, streams, UNITS), space("gates", kept, 2, streams, UNITS), space("factors", kept, 3, streams, UNITS)
        x, b, rest, n = (space(f"{k} of a step", *m, streams, UNITS) for k, m in (("x", (3,)), ("b", (3,)), ("rest", (2,)), ("n", ())))
        with np.errstate(over="ignore"):  # an infinite exponential gives the gates' limits
            for t in range(steps):
                zr = gates[t % kept]
                if len(begins[t]):
                    h = h.copy()
                    h[begins[t]] = 0
                before.append(h)
                table.take(parts[t], axis=0, out=x, mode="clip")
                np.matmul(h, u, out=b)
                np.subtract(b[:2], x[:2], out=zr)  # update and reset
                np.exp(zr, out=zr)
                zr += one
                np.reciprocal(zr, out=zr)
                np.multiply(zr[1], b[2], out=n)
                n += x[2]
                np.tanh(n, out=n)
                off = np.subtract(h, n, out=b[1])
                h = np.multiply(zr[0], off, out=states[t])
                h += n
                if trace:
                    back = factors[t]
                    np.subtract(one, zr, out=rest)
                    np.multiply(n, n, out=n)
                    np.subtract(one, n, out=n)
                    np.multiply(n, rest[0], out=back[2])
                    np.multiply(b[1:], zr, out=back[:2])
                    back[:2] *= rest
                    back[1] *= back[2]
        return states, before, gates, factors

    def forward(self, inputs: np.ndarray, keep: np.ndarray | None, h: np.ndarray, trace: bool) -> tuple[np.ndarray, tuple, np.ndarray]:
        """States (steps, streams, units) after each input of a window (steps x streams); ``keep`` is 0 where a text begins."""
        states, *rest = self._run(inputs, keep, h, trace)
        return states.copy(), tuple(np.array(x) for x in rest) if trace else (), states[-1].copy()

    def _classes(self, states: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each state its class's logit, the classes' exponentials without factors, the factors, and the sums."""
        w = self.p["class"]
        x = np.matmul(states, w, out=self.space("classes", len(states), CLASSES + TAIL))
        own, factors = _exponentials(x, np.arange(len(cls)) * (CLASSES + TAIL) + cls, self.p["class_bias"][None], cls, 0)
        return own, x, factors[0], x @ factors[0]

    def _words(self, states: np.ndarray, places: np.ndarray, cls: np.ndarray, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        """The same for the words of each state's class; states come class by class."""
        w = self.p["word"]
        x, sums = self.space("words", len(states), CLASS_WORDS), np.empty(len(states), np.float32)
        for c, a, b in cuts:
            np.matmul(states[a:b], w[c].T, out=x[a:b])
        own, factors = _exponentials(x, np.arange(len(cls)) * CLASS_WORDS + places % CLASS_WORDS, self.p["word_bias"], places, cls)
        for c, a, b in cuts:
            np.matmul(x[a:b], factors[c], out=sums[a:b])
        return own, x, factors, sums

    @staticmethod
    def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The frequent words, class by class, and the (class, first, end) that occur."""
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        return order[: cuts[-1]], [(c, a, b) for c, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b]

    def chances(self, states: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 of the chance of each place (below 0: of a class of the tail) after each state (a row each)."""
        cls, out = self.classes_of(places), np.empty(len(places))
        for rows in _blocks(len(places)):
            own, _, _, sums = self._classes(states[rows], cls[rows])
            out[rows] = own - np.log(sums)
        order, cuts = self._by_class(cls)
        if len(order):
            own, _, _, sums = self._words(self.space.rows("by_class", states, order), places[order], cls[order], cuts)
            out[order] += own - np.log(sums)
        return out / np.log(10.0)

    def gradient(
        self, inputs: np.ndarray, places: np.ndarray, mask: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None, out: dict[str, np.ndarray] | None = None
    ) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradient of the mean log loss of one window, by backpropagation to the begin of the window or text only.

        With ``out`` it is added there, as the sum over the tokens, not their mean.
        """
        steps, streams = inputs.shape
        states, before, gates, factors = self._run(inputs, keep, h, True)
        space, target, weight = self.space, places.ravel(), mask.ravel().astype(np.float32)
        if out is None:
            weight /= np.float32(max(1.0, float(weight.sum())))
        g = {k: np.zeros_like(x) for k, x in self.p.items()} if out is None else out
        flat, cls, ones, back = states.reshape(-1, UNITS), self.classes_of(target), np.ones(len(target), np.float32), space("back", len(target), UNITS)
        for rows in _blocks(len(target)):
            own, to = flat[rows], cls[rows]
            _, d, of, sums = self._classes(own, to)
            d.ravel()[np.arange(len(to)) * (CLASSES + TAIL) + to] -= sums / of[to]
            d *= (weight[rows] / sums)[:, None]
            g["class"] += (own.T @ d) * of
            g["class_bias"] += (ones[rows] @ d) * of
            np.matmul(d, (self.p["class"] * of).T, out=back[rows])
        order, cuts = self._by_class(cls)
        if len(order):
            cls, target, weight, by_class = cls[order], target[order], weight[order], space.rows("by_class", flat, order)
            _, d, of, sums = self._words(by_class, target, cls, cuts)
            d.ravel()[np.arange(len(cls)) * CLASS_WORDS + target % CLASS_WORDS] -= sums / of.ravel()[target]
            d *= (weight / sums)[:, None]
            words, sorted_back = self.p["word"] * of[:, :, None], space("sorted_back", len(cls), UNITS)
            to_words, to_biases = space("to_words", *words.shape), space("to_biases", *of.shape)
            to_words.fill(0)
            to_biases.fill(0)
            for c, a, b in cuts:
                own = d[a:b]
                np.matmul(own.T, by_class[a:b], out=to_words[c])
                np.matmul(ones[a:b], own, out=to_biases[c])
                np.matmul(own, words[c], out=sorted_back[a:b])
            to_words *= of[:, :, None]
            to_biases *= of
            g["word"] += to_words
            g["word_bias"] += to_biases
            back[order] += sorted_back
        fed, occurs = inputs.ravel(), np.bincount(inputs.ravel(), minlength=self.BEGIN + 1)
        kind = (occurs > 1).astype(np.int64) + (occurs > 16)  # inputs that occur once, a few times, often
        order = np.argsort((fed + kind[fed] * (self.BEGIN + 1)).astype(np.int16), kind="stable")
        u, later = self._planes()[[2, 0, 1]].transpose(0, 2, 1).copy(), np.zeros((streams, UNITS), np.float32)
        begins, every, parts = self._begins(keep, steps), space("into", steps, 4, streams, UNITS), space("parts", 3, streams, UNITS)
        own, state = np.empty((3, UNITS, UNITS), np.float32), np.zeros((3, UNITS, UNITS), np.float32)
        back = back.reshape(steps, streams, UNITS)
        for t in range(steps - 1, -1, -1):
            dh, (z, r), into = back[t], gates[t], every[t]  # into the new state's recurrent part, update, reset, new state
            dh += later
            np.multiply(dh, factors[t], out=into[1:])
            np.multiply(into[3], r, out=into[0])
            np.matmul(into[:3], u, out=parts)
            np.matmul(before[t].T, into[:3], out=own)
            state += own
            np.multiply(dh, z, out=later)
            for x in parts:
                later += x
            if len(begins[t]):
                later[begins[t]] = 0
        g["state"].reshape(UNITS, 3, UNITS)[:] += state[[1, 2, 0]].transpose(1, 0, 2)
        of_token = (4 * streams * np.arange(steps)[:, None] + np.arange(streams)).ravel()[order, None] + np.arange(1, 4) * streams
        by_input, rows = space.rows("by_input", every.reshape(-1, UNITS), of_token.ravel()).reshape(-1, 3 * UNITS), fed[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        one, few = int((kind[rows[first]] == 0).sum()), int((kind[rows[first]] < 2).sum())
        cuts = np.append(first, len(rows)).tolist()
        g["inputs"][rows[:one]] += by_input[:one]
        if one < few:  # sums of pairs of floats, as complex numbers, take half the calls
            pairs = by_input[: cuts[few]].view(np.complex64)
            g["inputs"].view(np.complex64)[rows[first[one:few]]] += np.add.reduceat(pairs, first[one:few], axis=0)
        for a, b in itertools.pairwise(cuts[few:]):
            g["inputs"][rows[a]] += ones[a:b] @ by_input[a:b]
        return g, states[-1].copy()

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unflat(self, values: np.ndarray) -> Network:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self


class Adam:
    """Adaptive moments, in place, a block after another, so that a block's passes stay in the cache.

    Both moments are kept without their constant factors, 0.1 and 0.001.
    """

    BLOCK = 1 << 15

    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v = ({k: _placed(nth, (x.size,)) for k, x in p.items()} for nth in (2, 3))
        self.part, self.t = _placed(4, (self.BLOCK,)), 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], n: int) -> None:
        """One step by the gradient's sum over n tokens, which is cleared; every token weighs the same."""
        self.t, rate, each = self.t + 1, RATE * n / (STEPS * BATCH), np.float32(1 / n)
        fix = np.float32(rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * 0.1 / np.sqrt(0.001))
        for k in g:
            values, slopes = p[k].reshape(-1), g[k].reshape(-1)
            for a in range(0, len(values), self.BLOCK):
                own, x, m, v = (y[a : a + self.BLOCK] for y in (values, slopes, self.m[k], self.v[k]))
                part = self.part[: len(x)]
                x *= each
                m *= np.float32(0.9)
                m += x
                v *= np.float32(0.999)
                v += np.multiply(x, x, out=part)
                np.sqrt(v, out=part)
                part += np.float32(1e-8 / np.sqrt(0.001))
                np.divide(m, part, out=part)
                part *= fix
                own -= part
                x.fill(0)


def _network(head: Head) -> Network:
    at = np.flatnonzero(head.places >= 0)
    counts = np.zeros(len(at))
    counts[head.places[at]] = head.counts[at]
    return Network(counts, head.tail_totals)


@dataclass
class Steps:
    """STEPS steps of the live streams (steps x streams), and the texts that end in it: (stream, steps, key)."""

    inputs: np.ndarray
    places: np.ndarray
    mask: np.ndarray
    keep: np.ndarray  # 0 where a text begins
    ends: list[tuple[int, int, object]]
    live: np.ndarray  # rows of the state of the window before that go on


def stream_windows(texts: Iterator[tuple[object, np.ndarray]], width: int) -> Iterator[Steps]:
    """Windows over every token of whole texts, given as (key, places).

    ``width`` streams run side by side; a stream that ends a text goes on with the next one at once, so a long
    text holds up nothing, and memory holds the texts at hand and one window only.
    """
    current: list = [None] * width  # of each stream: [key, places, position]
    previous = np.full(width, -1, np.int32)
    live = np.arange(width)
    more = True
    while True:
        n = len(current)
        target, begins = np.full((n, STEPS), -1, np.int32), np.zeros((n, STEPS), bool)
        filled, ends = np.zeros(n, np.int64), []
        for s in range(n):
            if (text := current[s]) is not None and len(text[1]) - text[2] > STEPS:  # the window lies inside the text
                target[s] = text[1][text[2] : text[2] + STEPS]
                text[2] += STEPS
                filled[s] = STEPS
                continue
            at = 0
            while at < STEPS:
                if current[s] is None:
                    text = next(texts, None) if more else None
                    if text is None:
                        more = False
                        break
                    current[s] = [text[0], text[1], 0]
                    begins[s, at] = True
                key, places, position = current[s]
                take = min(STEPS - at, len(places) - position)
                target[s, at : at + take] = places[position : position + take]
                at += take
                current[s][2] = position + take
                if position + take == len(places):
                    ends.append((s, at, key))
                    current[s] = None
            filled[s] = at
        some = np.flatnonzero(filled)
        if not len(some):
            return
        if len(some) < n:
            number = np.full(n, -1)
            number[some] = np.arange(len(some))
            ends = [(int(number[s]), at, key) for s, at, key in ends]
            current, live = [current[s] for s in some], live[some]
            target, begins, filled, previous = target[some], begins[some], filled[some], previous[some]
        before = np.concatenate([previous[:, None], target[:, :-1]], axis=1)
        inputs = np.where(begins, Network.BEGIN, Network.inputs_of(before)).astype(np.int32)
        steps = int(filled.max())
        mask = np.arange(steps)[None, :] < filled[:, None]
        previous = target[:, -1].copy()
        yield Steps(inputs[:, :steps].T, target[:, :steps].T, mask.T, (~begins[:, :steps].T).astype(np.float32), ends, live)
        live = np.arange(len(current))


def train_network(net: Network, texts: Iterator[tuple[object, np.ndarray]]) -> int:
    """Train on every token of the texts; the number of tokens.  Gradients of small windows are gathered first."""
    old, (net.p, g) = net.p, ({k: _placed(nth, x.shape) for k, x in net.p.items()} for nth in (0, 1))
    for k, x in old.items():
        net.p[k][:] = x
    adam, seen, gathered = Adam(net.p), 0, 0
    h = np.zeros((BATCH, UNITS), np.float32)
    for w in stream_windows(texts, BATCH):
        _, h = net.gradient(w.inputs, w.places, w.mask, h[w.live], w.keep, g)
        n = int(w.mask.sum())
        seen, gathered = seen + n, gathered + n
        if 2 * gathered >= STEPS * BATCH:
            adam.step(net.p, g, gathered)
            gathered = 0
    if gathered:
        adam.step(net.p, g, gathered)
    return seen


ENCODED = "doc_id long, held_out boolean, h long, places binary, known long, base double, within double, tail array<long>"


def _encode(model):
    """Texts as places, two bytes each, with what their tokens need besides: sums over the head's, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = model.value
        for batch in batches:
            texts = as_bytes(batch.column("content"))
            for first, last in slices(texts):
                tokens, bounds = _tokens(Words(texts, first, last, lower=True))
                here, counts, places = head.look_up(tokens)
                within = np.zeros(len(tokens))
                rare = here & (places < 0)
                within[rare] = head.in_tail(counts[rare], places[rare])
                rest = np.concatenate([[0], np.cumsum(~here)])[bounds]
                sums = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (here, np.where(here, head.base(counts), 0.0), within)]
                known, base, more = (x[1:] - x[:-1] for x in sums)
                places = places.astype("<i2")
                columns = [
                    *(batch.column(k).slice(first, last - first) for k in ("doc_id", "held_out", "h")),
                    pa.array([places[bounds[k] : bounds[k + 1]].tobytes() for k in range(last - first)], pa.binary()), pa.array(known), pa.array(base), pa.array(more),
                    pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(tokens[~here].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "h", "places", "known", "base", "within", "tail"])

    return run


def _started(head: Head, weights: bytes | None) -> Network:
    net = _network(head).start()
    return net if weights is None else net.unflat(np.frombuffer(weights, "<f4"))


def _train(model, weights):
    """One network for each bucket, trained from the common start: (bucket, weights, n).  Rows come bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                yield from zip(batch.column("bucket").to_pylist(), (np.frombuffer(p.as_py(), "<i2") for p in batch.column("places")), strict=True)

        for bucket, texts in itertools.groupby(rows(), key=lambda r: r[0]):
            net = _started(model.value, weights.value)
            seen = train_network(net, iter(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int64()), pa.array([net.flat().astype("<f4").tobytes()]), pa.array([seen], pa.int64())], ["bucket", "weights", "n"]
            )

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean of networks, one at a time."""
    total, n, least = None, 0, None
    for batch in batches:
        for bucket, weights, k in zip(batch.column("bucket").to_pylist(), batch.column("weights"), batch.column("n").to_pylist(), strict=True):
            part = np.frombuffer(weights.as_py(), "<f4").astype(np.float64) * k
            total, n, least = part if total is None else total + part, n + k, bucket if least is None else least
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()]), pa.array([n], pa.int64())], ["bucket", "weights", "n"])


def score_texts(net: Network, texts: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[object, float]]:
    """(key, log10 chance) of whole texts given as (key, places), as they end; the state runs through each text."""
    h, sums = np.zeros((STREAMS, UNITS), np.float32), np.zeros(STREAMS)
    for w in stream_windows(texts, STREAMS):
        states = net._run(w.inputs, w.keep, h[w.live])[0]
        h, chance = states[-1], np.where(w.mask, net.chances(states.reshape(-1, UNITS), w.places.ravel()).reshape(w.mask.shape), 0.0)
        upto = np.concatenate([np.zeros((1, chance.shape[1])), np.cumsum(chance, axis=0)])
        sums, done = sums[w.live], np.zeros(chance.shape[1], np.int64)
        for s, at, key in w.ends:
            yield key, float(sums[s] + upto[at, s] - upto[done[s], s])
            sums[s], done[s] = 0.0, at
        sums += upto[-1] - upto[done, np.arange(len(done))]


SCORED = "row long, doc_id long, held_out boolean, known long, base double, n_tokens long, score double"


def _score(model, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple[tuple, np.ndarray]]:
            for batch in batches:
                keys = zip(*(batch.column(k).to_pylist() for k in ("row", "doc_id", "held_out", "known", "base", "within")), strict=True)
                for key, stored in zip(keys, batch.column("places"), strict=True):
                    places = np.frombuffer(stored.as_py(), "<i2")
                    yield (*key, len(places)), places

        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        names = ["row", "doc_id", "held_out", "known", "base", "n_tokens", "score"]
        scored = score_texts(_started(model.value, weights.value), texts())
        while rows := [(*r[:5], r[6], r[5] + chance) for r, chance in itertools.islice(scored, SCORED_ROWS)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


@dataclass
class Fitted:
    """What training leaves: all token counts (a saved table), the frequent ones, and the network's weights."""

    counts: DataFrame
    head: Head
    weights: bytes | None


def _encoded(docs: DataFrame, head: Head) -> DataFrame:
    """All texts as places, a saved table with a number for each row."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), (~_training()).alias("held_out"), F.xxhash64("doc_id", content(), F.lit(5)).alias("h")]
    model = docs.sparkSession.sparkContext.broadcast(head)  # at most HEAD tokens
    encoded = docs.select(*own, content().cast("binary").alias("content")).mapInArrow(_encode(model), ENCODED)
    return saved(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _fit(docs: DataFrame) -> tuple[Fitted, DataFrame]:
    """See train; with all texts as places, which scoring reads instead of the texts."""
    spark = for_python(docs).sparkSession
    texts = docs.where(_training()).select(content().cast("binary").alias("content"))
    counts = saved(texts.mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    head = _head(counts)
    model = spark.sparkContext.broadcast(head)
    a_round = min(BUCKETS, max(1, -(-head.total // (BUCKET_TOKENS * ROUNDS))))
    buckets = min(a_round * ROUNDS, max(1, head.total // BUCKET_TOKENS))
    encoded = _encoded(docs, head)
    rows = encoded.where("not held_out").select("h", "places", F.pmod("h", F.lit(buckets)).alias("bucket"))
    weights = None
    for k in range(ROUNDS):
        mine = rows.where(F.pmod("bucket", F.lit(ROUNDS)) == k)
        dealt = mine.repartitionById(a_round, F.floor(F.col("bucket") / ROUNDS).cast("int")).sortWithinPartitions("bucket", "h", "places")
        networks = saved(dealt.mapInArrow(_train(model, spark.sparkContext.broadcast(weights)), "bucket long, weights binary, n long"), "networks")
        few = networks.repartition(32, F.pmod(F.col("bucket"), F.lit(32))).sortWithinPartitions("bucket")
        means = sorted(few.mapInArrow(_mean, "bucket long, weights binary, n long").collect())  # at most 32 networks
        discard(networks)
        if means:
            n = sum(r["n"] for r in means)
            weights = sum(np.frombuffer(r["weights"], "<f4").astype(np.float64) * (r["n"] / n) for r in means).astype("<f4").tobytes()
    return Fitted(counts, head, weights), encoded


def train(docs: DataFrame) -> Fitted:
    """Learn from the documents with crc32(doc_id) mod 10 other than 0.

    Token counts come from every token, by a shuffle.  The network learns from every token too: texts become
    sequences of places, which are dealt by hash to buckets of about BUCKET_TOKENS tokens, and the buckets to
    ROUNDS rounds.  In a round each bucket trains a network from the common start, in hash order of its texts,
    with truncated backpropagation and the state carried through each text; then the networks are averaged by
    their tokens.  Nothing depends on how ``docs`` is partitioned.
    """
    fitted, encoded = _fit(docs)
    discard(encoded)
    return fitted


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """Scores of whole texts under a trained model: see score_documents."""
    return _scored(_encoded(for_python(docs), fitted.head), fitted)


def _scored(encoded: DataFrame, fitted: Fitted) -> DataFrame:
    broadcast, head = encoded.sparkSession.sparkContext.broadcast, fitted.head
    scored = saved(encoded.drop("h", "tail").mapInArrow(_score(broadcast(head), broadcast(fitted.weights)), SCORED), "scored")
    least = int(head.counts.min()) if len(head.counts) else 1 << 62
    tail = encoded.select("row", F.explode("tail").alias("token")).join(fitted.counts.where(F.col("n") < least), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.log10((F.col("n") + SMOOTH) / (head.total + SMOOTH * (head.types + 1)))
    whole = [float(t + SMOOTH * (k + 1)) for t, k in zip(head.tail_totals, head.tail_types, strict=True)]
    of_class = F.element_at(F.array(*[F.lit(x) for x in whole]), (F.col("token").bitwiseAND(TAIL - 1) + 1).cast("int"))
    within = F.log10((F.col("n") + SMOOTH) / of_class)
    tail = tail.groupBy("row").agg(F.sum(base).alias("more_base"), F.sum(within).alias("more"), F.count_if(F.col("n") > 0).alias("more_known"))
    out = scored.join(tail, "row", "left")
    none = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more", none)).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Log-likelihood of each whole text under a unigram base and under a recurrent model, both trained on ``docs``.

    The output layer picks one of CLASSES classes of frequent words and a word of it, or one of TAIL classes to
    which the hash deals all other words, within which words have their smoothed frequencies; so every word has
    a class and an input, and the chances of all tokens and of one unknown token a class add up to one.  Tasks
    know the HEAD most frequent tokens; the others meet their counts in a join.  Texts are encoded once, for training
    and scoring, and run through the network in streams, so memory does not grow with the longest text beyond
    its places.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10): one row for each
    input row, in whatever number it occurs.  Null texts are empty: their one token is the end.  A null doc_id
    counts as empty text in the division.  Without any training text all counts are 0; an empty table gives an
    empty result.  Only doc_id and text are read, other columns may have any names.
    """
    fitted, encoded = _fit(docs)
    return _scored(encoded, fitted)
