import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from roadlens.llm import exact, neardup, substring

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(words_of(r["text"]))].append(r)
    out = Counter()
    for norm, own in groups.items():
        best = min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        for r in own:
            out[(r["doc_id"], best, len(own), r["doc_id"] == best, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bits", [64, 2])
def test_exact(awkward, crowd, empty, bits):
    """With digests of two bits almost all rows clash, and the bytes decide."""
    for docs in (awkward, crowd):
        assert Counter(map(tuple, exact.exact_classes(docs, bits).collect())) == brute_exact(docs.collect())
    assert exact.exact_classes(empty, bits).count() == 0


def test_exact_keeps_one(awkward, crowd):
    for docs in (awkward, crowd):
        kept = exact.keep_first(docs)
        assert kept.columns == docs.columns
        norms = ["".join(words_of(r["text"])) for r in kept.collect()]
        assert sorted(norms) == sorted({"".join(words_of(r["text"])) for r in docs.collect()})


def brute_substring(rows, n):
    first = {}
    big = float("inf")
    for r in rows:
        words = words_of(r["text"])
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            first[g] = min(first.get(g, big), big if r["doc_id"] is None else r["doc_id"])
    out = Counter()
    for r in rows:
        words = words_of(r["text"])
        gone = set()
        for i in range(len(words) - n + 1):
            if first[tuple(words[i : i + n])] < (big if r["doc_id"] is None else r["doc_id"]):
                gone |= set(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[(r["doc_id"], len(words), len(gone), kept)] += 1
    return out


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("n", [3, 7, 13])
def test_substring(crowd, monkeypatch, n, hot):
    monkeypatch.setattr(substring, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(substring, "SHARD_PASSAGES", 100)
    got = Counter((*tuple(r)[:3], bytes(r["kept_text"]).decode()) for r in substring.dedup_substrings(crowd, n).collect())
    assert got == brute_substring(crowd.collect(), n)


def test_substring_awkward(awkward, empty):
    got = Counter((*tuple(r)[:3], bytes(r["kept_text"]).decode()) for r in substring.dedup_substrings(awkward).collect())
    assert got == brute_substring(awkward.collect(), 13)
    assert substring.dedup_substrings(empty).count() == 0


def test_suffix_automaton():
    """Against every window of every sequence."""
    import random

    rng = random.Random(1)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(3, 14))] for _ in range(60)]
    automaton = substring.SuffixAutomaton()
    for label, words in enumerate(sequences):
        automaton.add(words, label)
    automaton.finish()
    for n in (1, 2, 4):
        first = {}
        for label, words in enumerate(sequences):
            for i in range(len(words) - n + 1):
                first.setdefault(tuple(words[i : i + n]), label)
        other = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(300)]
        for words in [*sequences, other]:
            want = [first.get(tuple(words[i : i + n]), substring.NO_ID) for i in range(len(words) - n + 1)]
            assert automaton.stream(words, n) == want


def shingles_of(text, size=3):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_near(rows, percent, size=3):
    sets = [shingles_of(r["text"], size) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if root(j) == root(i) and rows[j]["doc_id"] is not None]
        least[i] = min(ids, default=None)
    return Counter((r["doc_id"], len(sets[i]), least[i], r["doc_id"] == least[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("centres,block", [(3, 20), (1, 2)])
@pytest.mark.parametrize("percent", [85, 95])
def test_near(crowd, monkeypatch, centres, block, percent):
    """With one centre and blocks of two, most links are found in blocks, some of which one component owns."""
    monkeypatch.setattr(neardup, "CENTRES", centres)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = Counter(map(tuple, neardup.near_duplicates(crowd, percent).collect()))
    assert got == brute_near(crowd.collect(), percent)


def test_near_awkward(awkward, empty):
    assert Counter(map(tuple, neardup.near_duplicates(awkward).collect())) == brute_near(awkward.collect(), 85)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns


def test_index_merges_runs_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select((F.col("id") % 300).alias("digest"), F.struct((-F.col("id")).alias("minus_length"), F.lit(False).alias("no_id"), F.col("id").alias("doc_id")).alias("best"), F.lit(1).cast("long").alias("n"))
    for flushes in (1, 2, 3, 4, 5):
        index = exact.build_index(rows, flushes)
        assert index.runs == 1
        assert {(r["digest"], r["best"]["doc_id"], r["n"]) for r in index.entries().collect()} == {(d, max(range(d, 2000, 300)), len(range(d, 2000, 300))) for d in range(300)}
        index.drop()
    level = exact.Level(spark)
    level.flush(rows)
    level.flush(rows.where("digest < 50"))
    merged = level.entries().groupBy("digest").agg(F.min("best"))
    assert merged.count() == 300
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


#: Columns with names that steps of the operators use themselves.
OWN_NAMES = "_id long, _sha string, _place int, _nth int, _size long, row string, stays string, digest long, norm string, hit string"


@pytest.fixture(scope="module")
def odd(spark):
    """Negative, null and repeated ids beside each other, and columns with the operators' own names."""
    rows = [(-5, "equal text of a few words here"), (-1, "equal text of a few words here"), (None, "equal text of a few words here"), (None, "a text that occurs once only here"), (3, "third"), (3, "third"), (3, "an other under three")]
    return spark.createDataFrame([(*r, "en", "a", 0, 1, "s", 2, 3, 4, "r", "t", 5, "n", "h") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {OWN_NAMES}")


def test_keepers_carry_whole_rows(odd):
    for kept in (exact.keep_first(odd), neardup.keep_one(odd)):
        assert kept.schema == odd.schema
        rows = sorted(kept.collect(), key=str)
        assert sorted(str(r["doc_id"]) for r in rows) == ["-5", "3", "3", "None"]
        assert sorted(r["text"] for r in rows) == ["a text that occurs once only here", "an other under three", "equal text of a few words here", "third"]
        assert all(tuple(r)[5:] == (1, "s", 2, 3, 4, "r", "t", 5, "n", "h") for r in rows)
    for keep in (exact.keep_first, neardup.keep_one):
        assert keep(odd.limit(0)).count() == 0


def test_chain_of_candidates_costs_by_its_tables(spark, monkeypatch):
    """Neighbours share three quarters of their shingles and a key of some table, so all are one cluster."""
    monkeypatch.setattr(neardup, "CENTRES", 1)
    monkeypatch.setattr(neardup, "BLOCK", 50)
    texts = [" ".join(f"w{k}" for k in range(15 * i, 15 * i + 110)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[700] + " more"])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert all(r["component_id"] == k for k, r in rows.items() if k < 1500) and rows[1500]["component_id"] == 700


def test_dense_cluster_with_outliers(spark, monkeypatch):
    """One template: most texts are linked to its centre, some lie below the threshold of it and are linked among themselves or not at all."""
    monkeypatch.setattr(neardup, "BLOCK", 25)
    rng = random.Random(8)
    template = [f"w{k}" for k in range(120)]

    def changed(n):
        words = list(template)
        for k in rng.sample(range(120), n):
            words[k] = f"x{rng.randrange(10_000)}"
        return words

    texts = [changed(rng.choice([0, 1, 1, 2, 3])) for _ in range(220)] + [changed(rng.choice([5, 6, 8])) for _ in range(60)]
    texts += [[*rng.choice(texts[220:280]), "more"] for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = Counter(map(tuple, neardup.near_duplicates(docs).collect()))
    want = brute_near(docs.collect(), 85)
    assert got == want and len({r[2] for r in want}) > 20


def test_hot_rows_keep_one_whole_row(spark):
    """100,000 rows of one id and text, and as many without an id: one row of each stays, the same in every layout."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text of words").otherwise("no id has this").alias("text"), F.lit("s").alias("source"), F.col("id").alias("other"))
    for keep in (exact.keep_first, neardup.keep_one):
        one, two = (sorted(map(tuple, keep(d).collect()), key=str) for d in (rows, rows.repartition(7)))
        assert one == two and [r[0] for r in one] == [7, None]
