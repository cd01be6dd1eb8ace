import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from roadlens.llm import lm, quality, queries

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_measures(r):
    text = r["text"] or ""
    words = words_of(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (r["doc_id"], len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), failed)


def test_quality_measures(awkward, crowd, empty):
    for docs in (awkward, crowd):
        rows = quality.quality(docs).collect()
        assert Counter(tuple(r)[:7] for r in rows) == Counter(map(brute_measures, docs.collect()))
        assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.quality(empty).count() == 0


def test_quality_keeps_rows_whole(awkward, crowd):
    for docs in (awkward, crowd):
        want = Counter(r["doc_id"] for r in quality.quality(docs).collect() if r["kept"])
        kept = quality.keep_good(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert Counter(r["doc_id"] for r in rows) == want
        assert not Counter(map(str, rows)) - Counter(map(str, docs.collect()))


def brute_chances(texts):
    """Interpolated modified Kneser-Ney over byte trigrams, from dictionaries: a function of (a, b, c)."""
    seen = Counter()
    for text in texts:
        stream = b"  " + b"".join(w.encode() + b" " for w in words_of(text))
        seen.update(stream[i : i + 3] for i in range(len(stream) - 2))
    pairs, ones = Counter(g[1:] for g in seen), Counter()
    ones = Counter(g[1:] for g in pairs)

    def discount(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        d = [0.5, 0.75, 0.9]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2 - 3 * y * n[2] / n[1]]
        d = [min(max(x, quality.LEAST_DISCOUNT), k + 1) for k, x in enumerate(d)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    d3, d2, d1 = discount(seen), discount(pairs), discount(ones)
    total = sum(ones.values())
    alone = lambda c: (ones[c] - d1(ones[c])) / total + sum(map(d1, ones.values())) / total / 256

    def level(counts, d, lower):
        sums, gaps = Counter(), Counter()
        for g, n in counts.items():
            sums[g[:-1]] += n
            gaps[g[:-1]] += d(n)

        def chance(g):
            h = g[:-1]
            if h not in sums:
                return lower(g[1:])
            return (counts.get(g, 0) - d(counts.get(g, 0))) / sums[h] + gaps[h] / sums[h] * lower(g[1:])

        return chance

    return level(seen, d3, level(pairs, d2, alone))


def brute_kept(rows):
    """Base rules, perplexities and bands, text by text."""
    models = {lang: brute_chances(r["text"] for r in rows if r["lang"] == lang) for lang in {r["lang"] for r in rows}}
    measured = []
    for r in rows:
        stream = b"  " + b"".join(w.encode() + b" " for w in words_of(r["text"]))
        logs = [math.log10(models[r["lang"]](stream[i : i + 3])) for i in range(len(stream) - 2)]
        *_, n, _chars, _marks, _dup, _rep, failed = brute_measures(r)
        measured.append((r["doc_id"], r["lang"], n, failed, -sum(logs) / len(logs) if logs else None))
    least = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
    of_bin = lambda n: min(max(math.floor(math.log2(max(n, 1))), quality.FIRST_BIN), quality.LAST_BIN)

    def band(values):
        middle = least(values)
        sides = ([middle - v for v in values if v <= middle], [v - middle for v in values if v >= middle])
        return middle, *(max(1.4826 * least(x), quality.LEAST_DEVIATION) for x in sides)

    out = Counter()
    for doc, lang, n, failed, x in measured:
        passing = [m for m in measured if m[1] == lang and not m[3]]
        own = [m[4] for m in passing if of_bin(m[2]) == of_bin(n)]
        wider = 1.0 if len(own) >= quality.LEAST_TEXTS else math.sqrt(1 + quality.SHORT / max(n, 1))
        kept = False
        if not failed:
            middle, below, above = band(own if len(own) >= quality.LEAST_TEXTS else [m[4] for m in passing])
            kept = middle - quality.BAND * below * wider <= x <= middle + quality.BAND * above * wider
        out[(doc, kept, None if x is None else round(x, 5))] += 1
    return out


@pytest.mark.parametrize("width", [3.5, 0.7])
@pytest.mark.parametrize("turn_bytes", [192 << 20, 20_000])
def test_verdicts_against_brute_force(crowd, awkward, monkeypatch, width, turn_bytes):
    """Also with narrow bands, which cut the crowd, and with one language a turn."""
    monkeypatch.setattr(quality, "BAND", width)
    monkeypatch.setattr(quality, "MODEL_BYTES", turn_bytes)
    for docs in (crowd, awkward):
        got = quality.quality(docs).collect()
        want = brute_kept(docs.collect())
        assert Counter((r["doc_id"], r["kept"], None if r["log_perplexity"] is None else round(r["log_perplexity"], 5)) for r in got) == want
    assert width > 1 or 10 < sum(n for (_, kept, _), n in brute_kept(crowd.collect()).items() if kept) < 100


def brute_word_chances(rows, halves, class_of):
    """Mean negative log10 chance of a word, from dictionaries: word trigrams, pairs by continuation, bytes by brute_chances."""

    def model(grams):
        tables = []
        for order in (3, 2):
            seen = Counter(grams) if order == 3 else Counter((k, b, c) for k, _, b, c in tables[0][0])
            sums, gaps, kinds = Counter(), Counter(), list(seen.values())
            n = [kinds.count(k) for k in (1, 2, 3, 4)]
            three = [0.5, 0.75, 0.9]
            if n[0] and n[1]:
                y = n[0] / (n[0] + 2 * n[1])
                three = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2 - 3 * y * n[2] / n[1]]
            three = [min(max(x, quality.LEAST_DISCOUNT), k + 1) for k, x in enumerate(three)]
            for g, m in seen.items():
                sums[g[:-1]] += m
                gaps[g[:-1]] += three[min(m, 3) - 1]
            tables.append((seen, three, sums, gaps))

        def chance(g, spelt):
            for key, (seen, three, sums, gaps) in ((g[:1] + g[2:], tables[1]), (g, tables[0])):
                if key[:-1] in sums:
                    n = seen.get(key, 0)
                    spelt = (n - three[min(n, 3) - 1] * (n > 0) + gaps[key[:-1]] * spelt) / sums[key[:-1]]
            return spelt

        return chance

    out = Counter()
    for lang in {r["lang"] for r in rows}:
        own = [(r, words_of(r["text"]), halves[r["text"]]) for r in rows if r["lang"] == lang]
        byte = brute_chances(r["text"] for r, _, _ in own)
        grams = {k: [] for k in range(len(own))}
        for k, (_, words, _) in enumerate(own):
            for a, b, c in zip([None, None, *words], [None, *words], words):
                grams[k].append((*class_of(lang, a, b), c))
        models = {}
        for half in (0, 1):
            by_class = {}
            for k, (_, _, h) in enumerate(own):
                if h == half:
                    for cls, share, a, b, c in grams[k]:
                        by_class.setdefault(cls, []).append((0, a, (share, b), c))
            models[half] = {cls: model(g) for cls, g in by_class.items()}
        for k, (r, words, h) in enumerate(own):
            logs = []
            for (cls, share, a, b, c), before in zip(grams[k], [None, *words]):
                stream = (before.encode()[-1:] if before else b" ") + b" " + c.encode() + b" "
                spelt = sum(math.log10(byte(stream[i : i + 3])) for i in range(len(stream) - 2))
                spelt = 10 ** (round(spelt * 256) / 256)
                of = models[1 - h].get(cls)
                logs.append(math.log10(of((0, a, (share, b), c), spelt) if of else spelt))
            out[(r["doc_id"], r["text"])] = -sum(logs) / len(logs) if logs else None
    return out


@pytest.mark.parametrize("class_words", [1_000_000, 400])
def test_word_perplexity_against_brute_force(crowd, awkward, monkeypatch, class_words):
    """In one class, and in many, with the first words of texts and frequent words dealt on."""
    monkeypatch.setattr(quality, "CLASS_WORDS", class_words)
    for docs in (crowd, awkward):
        rows = docs.collect()
        halves = {r["text"]: r["half"] for r in docs.selectExpr("text", "pmod(xxhash64(cast(coalesce(text, '') as binary)), 2) as half").collect()}
        classes = max(1, -(-sum(len(words_of(r["text"])) for r in rows) // class_words))
        assert (classes > 1) == (class_words == 400)
        most, middles, ids = class_words // 4, Counter(), {}
        for r in rows:
            middles.update((r["lang"], b) for b in [None, *words_of(r["text"])][:-1])

        def identity(lang, word):
            if word is None:
                return np.array([quality.PAD], np.uint64)
            if (lang, word) not in ids:
                ids[lang, word] = quality._word_ids(quality.Words(quality.as_bytes(lm.pa.array([word])), 0, 1), salt(lang))
            return ids[lang, word]

        def salt(lang):
            return int.from_bytes(quality.hashlib.blake2b(("none" if lang is None else "=" + lang).encode(), digest_size=8).digest(), "little")

        def class_of(lang, a, b):
            middle, share = identity(lang, b), 0
            if classes > 1 and middles[lang, b] > most:
                share = 1 + quality.mix(identity(lang, a)) % np.uint64(-(-middles[lang, b] // most))
                middle = quality.mix(middle + np.uint64(quality.BASE) * share) >> np.uint64(16)
                share = int(share[0])
            return int((quality.mix(middle + np.uint64(salt(lang))) % np.uint64(classes))[0]), share, a, b

        want = brute_word_chances(rows, halves, class_of)
        models = quality.fit(docs)
        sums = quality.word_perplexity(docs, models, sum(len(words_of(r["text"])) for r in rows))
        got = docs.select("doc_id", "text", *quality._keys()).join(sums, ["key", "key2"], "left").collect()
        assert len(got) == len(rows)
        for r in got:
            n = len(words_of(r["text"]))
            if n:
                assert -r["log_chance"] / n == pytest.approx(want[r["doc_id"], r["text"]], abs=2e-3)
            else:
                assert not r["log_chance"]


def test_shuffled_words_are_rejected(spark):
    """Sentences of fixed phrases are kept, the same words in random order are not: their spelling is the same."""
    rng = np.random.default_rng(5)
    phrases = [[f"p{k}w{i}" for i in range(6)] for k in range(150)]
    text = lambda: [w for k in rng.choice(len(phrases), 20, replace=False) for w in phrases[k]]
    rows = [(k, " ".join(text()), "en") for k in range(300)]
    rows += [(1000 + k, " ".join(rng.permutation(text())), "en") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    assert not kept & set(range(1000, 1005))
    assert len(kept) >= 0.95 * 300


def test_model_is_a_distribution():
    """Chances of all bytes add up to one after any context, seen or not."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdeé .,"), 200)) for _ in range(30)]
    words = quality.Words(quality.as_bytes(lm.pa.array(texts)), 0, len(texts))
    codes, n = np.unique(quality._trigrams(words)[0], return_counts=True)
    model = quality.kneser_ney(codes, n)
    for context in [*model.contexts[::7], np.uint32(0), np.uint32(0xFFFF), np.uint32((200 << 8) | ord("a"))]:
        chance = 10 ** model.log_chances((np.uint32(context) << np.uint32(8)) + np.arange(256, dtype=np.uint32))
        assert chance.sum() == pytest.approx(1, abs=1e-5)


def test_chances_from_the_table_are_those_searched(monkeypatch):
    """Of all kinds of contexts, with bytes that never occur; and with too many trigrams for a table."""
    rng = np.random.default_rng(9)
    words = quality.Words(quality.as_bytes(lm.pa.array(["".join(rng.choice(list("abcdefé .,"), 500)) for _ in range(20)])), 0, 20)
    codes, n = np.unique(quality._trigrams(words)[0], return_counts=True)
    some = rng.choice(np.frombuffer("abcdefé .,x".encode(), np.uint8), (5000, 3)).astype(np.uint32)
    some = some[:, 0] << 16 | some[:, 1] << 8 | some[:, 2]
    for most in (quality.TABLE_CHANCES, 10):
        monkeypatch.setattr(quality, "TABLE_CHANCES", most)
        model = quality.kneser_ney(codes, n)
        assert (model._table()[1] is None) == (most == 10)
        assert np.array_equal(model.log_chances(some), model._searched(some))


def test_repeats_survive_polynomial_twins(spark):
    """The Thue-Morse word and its complement are different words that polynomial hashes modulo 2**64 confuse."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    twin = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{word} x y {twin} x y", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.quality(docs).first()["n_repeat_words"] == 0
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in lm.score_documents(docs).collect()) == brute_base(docs.collect())


def test_gibberish_is_rejected_and_clean_text_kept(spark):
    rng = np.random.default_rng(2)
    common = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(common, 200, p=None)), "en", "a", 0) for k in range(150)]
    rows += [(1000 + k, " ".join("".join(rng.choice(list("qxzjk#"), 9)) for _ in range(200)), "en", "a", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    assert kept == set(range(150))


def test_short_gibberish_and_foreign_texts_are_rejected_in_every_language(spark):
    """Among the test documents: texts of 64 words of random letters, in capitals, or of another language."""
    rng = np.random.default_rng(3)
    real = [r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect() if len(words_of(r["text"])) >= 64]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in real]
    bad = {}
    for lang in ("de", "en", "es", "fr"):
        own = [r["text"] for r in real if r["lang"] == lang]
        other = [w.lower() for r in real if r["lang"] == {"de": "fr", "en": "de", "es": "en", "fr": "en"}[lang] for w in words_of(r["text"])]
        for k in range(3):
            letters = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(64))
            capitals = " ".join(words_of(own[k])[:64]).upper()
            foreign = " ".join(other[64 * k : 64 * k + 64])
            for kind, text in (("letters", letters), ("capitals", capitals), ("foreign", foreign)):
                bad[1_000_000 + len(bad)] = kind, lang
                rows.append((1_000_000 + len(bad) - 1, text, lang, "a", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    verdicts = quality.quality(docs).where("not base_failed").collect()
    kept = {r["doc_id"] for r in verdicts if r["kept"]}
    assert sorted(bad[k] for k in kept & set(bad)) == []
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    good = [r["doc_id"] in kept for r in verdicts if labels.get(r["doc_id"]) == 1]
    assert sum(good) >= 0.95 * len(good)


def brute_base(rows):
    train, out = Counter(), []
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 10 == 0
    tokens = lambda r: [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), None]
    for r in rows:
        if not held(r):
            train.update(tokens(r))
    total, types = sum(train.values()), len(train)
    for r in rows:
        own = tokens(r)
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (types + 1))) for t in own)
        out.append((r["doc_id"], held(r), len(own), sum(train[t] > 0 for t in own), total, round(base, 6)))
    return Counter(out)


@pytest.mark.parametrize("head", [1 << 20, 5])
def test_lm_base(awkward, crowd, empty, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    for docs in (awkward, crowd):
        rows = lm.score_documents(docs).collect()
        got = Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in rows)
        assert got == brute_base(docs.collect())
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lm.score_documents(empty).count() == 0


def network():
    counts = np.arange(200, 100, -1)
    return lm.Network(counts, np.full(lm.TAIL, 700 / lm.TAIL)).start()


def stirred(net, seed=1):
    rng = np.random.default_rng(seed)
    for k in net.p:
        net.p[k] = net.p[k] + (rng.standard_normal(net.p[k].shape) * 0.05).astype(np.float32)
    return net


def test_gradient():
    net = stirred(network())
    rng = np.random.default_rng(1)
    places = rng.integers(-5, 100, (5, 3))
    inputs = net.inputs_of(places)
    mask = rng.random((5, 3)) < 0.8
    h = rng.standard_normal((3, lm.UNITS)).astype(np.float32) * 0.1

    def loss():
        states, _, _ = net.forward(inputs, None, h, False)
        chance = net.chances(states.reshape(-1, lm.UNITS), places.ravel()) * math.log(10)
        return -float((chance * mask.ravel()).sum() / mask.sum())

    g, _ = net.gradient(inputs, places, mask, h)
    for k, at in (("state", (3, 40)), ("inputs", (int(inputs[0, 0]), 5)), ("class", (2, 1)), ("class", (2, lm.CLASSES + 3)), ("class_bias", (0,)), ("word", (0, 7, 3)), ("word_bias", (0, 7)), ("state", (1, 70))):
        old = net.p[k][at]
        eps = 3e-3
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def test_gradient_adds_up():
    """Over parts of the streams, in one sum; inputs occur once, a few times and often, in ever other numbers."""
    net, rng = stirred(network()), np.random.default_rng(12)
    places = np.minimum(rng.zipf(1.3, (lm.STEPS, 128)) - 1, 99 + lm.TAIL)
    places = np.where(places < 100, places, 99 - places)
    inputs, mask, h = net.inputs_of(np.roll(places, 1, axis=0)), rng.random(places.shape) < 0.9, rng.standard_normal((128, lm.UNITS)).astype(np.float32) * 0.1
    keep = (rng.random(places.shape) < 0.95).astype(np.float32)
    mean, _ = net.gradient(inputs, places, mask, h, keep)
    total = {k: np.zeros_like(x) for k, x in net.p.items()}
    for a, b in ((0, 1), (1, 20), (20, 128)):
        net.gradient(inputs[:, a:b], places[:, a:b], mask[:, a:b], h[a:b], np.ascontiguousarray(keep[:, a:b]), total)
    for k, x in mean.items():
        assert total[k] / mask.sum() == pytest.approx(x, abs=1e-6)


def test_logits_beyond_floats():
    """Where exponentials would overflow, the maximum of the row is taken off; elsewhere chances are the same without."""
    net, rng = stirred(network()), np.random.default_rng(13)
    net.p["class"] = net.p["class"] * 2000
    net.p["word"] = net.p["word"] * 2000
    places = rng.integers(-lm.TAIL, 100, 300)
    h = rng.standard_normal((300, lm.UNITS)).astype(np.float32)
    with np.errstate(all="raise", under="ignore"):
        got = net.chances(h, places)
    log_softmax = lambda x: x - x.max() - math.log(np.exp(x - x.max()).sum())
    for x, place, chance in zip(h.astype(np.float64), places.tolist(), got.tolist(), strict=True):
        c = place // lm.CLASS_WORDS if place >= 0 else lm.CLASSES - 1 - place
        want = log_softmax(x @ net.p["class"] + net.p["class_bias"])[c]
        if place >= 0:
            want += log_softmax(net.p["word"][c] @ x + net.p["word_bias"][c])[place % lm.CLASS_WORDS]
        assert chance == pytest.approx(want / math.log(10), rel=1e-4, abs=1e-3)
    g, _ = net.gradient(places[:, None] * 0, places[:, None], np.ones((300, 1), bool), h[:1] * 0)
    assert all(np.isfinite(x).all() for x in g.values())


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4096])
def test_head_finds_tokens_by_their_top_bits(n):
    rng = np.random.default_rng(n)
    tokens = np.unique(np.concatenate([rng.integers(0, 2**64, n, np.uint64), np.uint64([0, 1, 2**64 - 1])[: n - 1], np.arange(n // 8, dtype=np.uint64)]))
    head = lm.Head(tokens, np.arange(len(tokens)) + 1, np.full(len(tokens), -1, np.int32), 1, 1, np.ones(lm.TAIL), np.ones(lm.TAIL))
    asked = np.concatenate([tokens, tokens + np.uint64(1), tokens - np.uint64(1), rng.integers(0, 2**64, 500, np.uint64)])
    assert np.array_equal(head._at(asked), np.minimum(np.searchsorted(tokens, asked), len(tokens) - 1))
    here, counts, _ = head.look_up(asked)
    assert np.array_equal(here, np.isin(asked, tokens))
    assert np.array_equal(counts[: len(tokens)], head.counts)


def brute_score(net, places):
    """One text, token by token, in double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    u, out, h, before = lm.UNITS, [], np.zeros(lm.UNITS), None
    log_softmax = lambda x: x - x.max() - math.log(np.exp(x - x.max()).sum())
    for place in places.tolist():
        x = p["inputs"][lm.Network.BEGIN if before is None else before if before >= 0 else lm.Network.WORDS - 1 - before]
        b = h @ p["state"]
        z, r = (1 / (1 + np.exp(-(x + b)[k * u : (k + 1) * u])) for k in (0, 1))
        new = np.tanh(x[2 * u :] + r * b[2 * u :])
        h = (1 - z) * new + z * h
        c = place // lm.CLASS_WORDS if place >= 0 else lm.CLASSES - 1 - place
        chance = log_softmax(h @ p["class"] + p["class_bias"])[c]
        if place >= 0:
            chance += log_softmax(p["word"][c] @ h + p["word_bias"][c])[place % lm.CLASS_WORDS]
        out.append(chance / math.log(10))
        before = place
    return sum(out)


def test_streams_score_as_token_by_token():
    net, rng = stirred(network()), np.random.default_rng(6)
    texts = [rng.integers(-lm.TAIL, 100, n).astype(np.int32) for n in (1, 7, 31, 32, 33, 900, 3, 64, *range(1, 400))]
    got = dict(lm.score_texts(net, iter(enumerate(texts))))
    assert sorted(got) == list(range(len(texts)))
    for k in [*range(8), *range(8, len(texts), 17)]:
        assert got[k] == pytest.approx(brute_score(net, texts[k]), rel=1e-4)


def test_scores_of_documents_token_by_token(spark, crowd):
    """score, from the trained weights and all training counts, without streams, heads or joins."""
    fitted = lm.train(crowd)
    net = lm._started(fitted.head, fitted.weights)
    assert not np.array_equal(net.flat(), lm._network(fitted.head).start().flat())
    counts = {r["token"]: r["n"] for r in fitted.counts.collect()}
    place = dict(zip(fitted.head.tokens.view(np.int64).tolist(), fitted.head.places.tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in lm.score(crowd, fitted).collect()}
    for r in crowd.collect():
        words = lm.Words(lm.as_bytes(lm.pa.array([r["text"] or ""])), 0, 1, lower=True)
        tokens = lm._tokens(words)[0].view(np.int64).tolist()
        places = np.array([p if (p := place.get(t, -1)) >= 0 else -1 - t % lm.TAIL for t in tokens])
        more = 0.0
        for t, p in zip(tokens, places.tolist(), strict=True):
            if p < 0:
                own = [n for x, n in counts.items() if x % lm.TAIL == -1 - p and place.get(x, -1) < 0]
                more += math.log10((counts.get(t, 0) + 0.1) / (sum(own) + 0.1 * (len(own) + 1)))
        assert got[r["doc_id"]] == pytest.approx(brute_score(net, places) + more, rel=1e-4)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 10_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, six = ({r["doc_id"]: r["score"] for r in lm.score_documents(docs.repartition(n)).collect()} for n in (1, 6))
    assert len(one) == docs.count()
    assert all(one[k] == pytest.approx(six[k], rel=1e-5) for k in one)


def test_long_text_takes_little_memory():
    import tracemalloc

    net = network()
    texts = [np.zeros(100_000, np.int32), *[np.zeros(5, np.int32)] * 299]
    tracemalloc.start()
    assert len(list(lm.score_texts(net, iter(enumerate(texts))))) == 300
    lm.train_network(net, iter(enumerate(texts[1:])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_training_reads_every_token_once():
    rng = np.random.default_rng(6)
    texts = [rng.integers(-lm.TAIL, 100, n) for n in (1, 7, 31, 32, 33, 200, 3, *range(1, 300))]
    got = np.concatenate([w.places[w.mask] for w in lm.stream_windows(iter(enumerate(texts)), lm.BATCH)])
    assert np.array_equal(np.sort(got), np.sort(np.concatenate(texts)))
    net = network()
    before = sum(x for _, x in lm.score_texts(net, iter(enumerate(texts))))
    assert lm.train_network(net, iter(enumerate(texts * 20))) == 20 * sum(map(len, texts))
    assert sum(x for _, x in lm.score_texts(net, iter(enumerate(texts)))) > before


def test_gradient_stops_at_the_begin_of_a_text():
    net = network()
    places = np.random.default_rng(7).integers(0, 100, (6, 1))
    mask = np.ones((6, 1), bool)
    keep = np.array([1, 1, 1, 0, 1, 1], np.float32)[:, None]
    h = np.full((1, lm.UNITS), 0.3, np.float32)
    both, last = net.gradient(places, places, mask, h, keep)
    first, _ = net.gradient(places[:3], places[:3], mask[:3], h)
    second, own = net.gradient(places[3:], places[3:], mask[3:], np.zeros_like(h))
    assert last == pytest.approx(own)
    for k in both:
        assert both[k] == pytest.approx((first[k] + second[k]) / 2, abs=1e-6)


def test_output_is_a_distribution():
    net = stirred(network())
    states = np.random.default_rng(4).standard_normal((1, lm.UNITS)).astype(np.float32)
    places = np.append(np.arange(lm.CLASSES * lm.CLASS_WORDS), -1 - np.arange(lm.TAIL))
    assert (10 ** net.chances(np.repeat(states, len(places), axis=0), places)).sum() == pytest.approx(1, abs=1e-3)


def test_held_out_likelihood_beats_the_base(spark):
    rows = [r for r in queries.op5_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(rows) > 50
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
