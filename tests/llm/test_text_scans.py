"""Fill-in-middle, secret scans and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadlens.llm import infill, queries, secretscan, spelling
from roadlens.llm.automaton import Automaton, Rule, Scanner

DOCS = "doc_id long, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- fill-in-middle -----------------------------------------------------------------------------


def cut_by_hand(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_and_back(spark, awkward):
    rng = random.Random(3)
    bits = ["abc", "Z", " ", "\n", "é", "\U0001f600", "<", "S", ">", "<P", "<S>", "9", "\0"]
    more = spark.createDataFrame([(k, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for k in range(400)], DOCS)
    docs = awkward.select("doc_id", "text", "content", "key").unionByName(more, allowMissingColumns=True)
    got = infill.fill_in_middle(docs).cache()
    want = sorted((cut_by_hand(r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)
    assert rows_of(got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text"))
    assert rows_of(back) == rows_of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert got.where(F.sha2("output", 256) != F.col("output_sha256")).isEmpty()


def test_fill_in_middle_of_a_very_long_text(spark):
    text = "ab " * 700_000
    docs = spark.createDataFrame([(k, text) for k in range(3)], DOCS)
    got = infill.fill_in_middle(docs)
    assert {r["n"] for r in got.select("n").collect()} == {1_400_000}
    assert got.select(infill.restored(F.col("output"), F.col("form")).alias("t")).where(F.col("t") != text).isEmpty()


def test_fill_in_middle_of_nothing(empty):
    assert infill.fill_in_middle(empty).count() == 0


# --- secret scans -------------------------------------------------------------------------------


def scanned_by_hand(text):
    found = []
    for k, rule in enumerate(secretscan.RULES):
        pattern = re.compile(rule.pattern.replace("{24,}", "+"), re.ASCII)
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(secretscan.RULES[k].kind, a, b) for a, k, b in sorted(found)]


def test_scan_against_regexes():
    scanner, rng = Scanner(secretscan.automaton()), random.Random(1)
    bits = ["token", "TOKEN", "secret", "passw", "password", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "a", "abcdef0", "AKIA", "AKI", "0", "9f", "ABCD1234", "é", "ſecret", "-----", "BEGIN "]
    bits += ["PRIVATE KEY", "RSA ", "eyJ", ".", "ghp_", "xoxb-", "-", "://", "@", "user", "\n", "f" * 9, "0" * 9, "AIza", "F" * 11, "\U0001f600", "PRIVATE KEY-----", "-----BEGIN RSA "]
    kinds = Counter()
    for _ in range(15_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        want = scanned_by_hand(text)
        assert secretscan.spans_of(scanner, text) == want, text
        kinds.update(k for k, _, _ in want)
    assert set(kinds) == {r.kind for r in secretscan.RULES}


def test_failing_matches_take_their_text():
    scanner = Scanner(secretscan.automaton())
    assert secretscan.spans_of(scanner, 'secret: "token: abcdefgh') == []
    assert secretscan.spans_of(scanner, 'é secret: "tok: token: abcdefgh') == [("assign", 16, 31)]


def test_automaton_is_minimal_and_refuses_other_rules():
    assert Automaton([Rule("a", "ab+|cb+")]).table.shape[0] == 3
    for pattern in ("a*", "(?:ab)+", "^a", r"a\d", "ab.*"):
        with pytest.raises(ValueError):
            Automaton([Rule("bad", pattern)])
    with pytest.raises(ValueError):
        Automaton([Rule("within", "ab{9}c|b")])
    alternate = Scanner(Automaton([Rule("x", "a|b+"), Rule("y", "(?i:ab?)c{2,3}")]))
    assert list(alternate.matches(b"abbaABcccc")) == [(0, 0, 1), (0, 1, 3), (0, 3, 4), (1, 4, 9)]


def test_scan_over_tables(spark, awkward, empty):
    key = "AKIA" + "Q7" * 9
    more = [(50, f"ü {key} und password = 'abc-123456'"), (None, key), (51, "x" * 2_000_000 + f" token={key}")]
    docs = awkward.select("doc_id", "text", "kept").unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    got = secretscan.scan_secrets(docs, mask=True).cache()
    want = sorted(((r["doc_id"], ",".join(f"{k}:{a}:{b}" for k, a, b in scanned_by_hand(r["text"] or ""))) for r in docs.collect()), key=repr)
    assert rows_of(got.select("doc_id", secretscan.listed(F.col("spans")))) == want
    assert got.where("doc_id = 50").first()["masked"] == "ü [secret] und [secret]'"
    assert got.where("doc_id = 51").first()["masked"] == "x" * 2_000_000 + " [secret]"
    assert secretscan.scan_secrets(empty).count() == 0


def test_scan_query(spark, small):
    got = queries.op12_secret_scans(spark, small).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        spans = scanned_by_hand(texts[r["doc_id"]])
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- spelling variants --------------------------------------------------------------------------


def vocabulary_by_hand(docs):
    lower, counts = str.maketrans(spelling.CAPITALS, spelling.SMALL), Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near_by_hand(words):
    """Words that agree in all but one place, or where one is the other without a place."""
    agree, near = defaultdict(set), {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            agree[k, w[:k], w[k + 1 :]].add(w)
            short = w[:k] + w[k + 1 :]
            if short in near:
                near[w].add(short)
                near[short].add(w)
    for same in agree.values():
        for w in same:
            near[w] |= same - {w}
    return near


def groups_by_hand(counts):
    near = near_by_hand(counts)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("part", [spelling.PART, 12])
def test_variants_against_brute_force(spark, part):
    """Words over few letters, so that runs of equal letters, chains of forms and large parts occur; 12 code points a part force cuts."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 11))) for _ in range(400)] + ["a" * k for k in range(4, 12)]
    docs = [(k if k % 5 else None, " ".join(base[int(len(base) ** rng.random()) - 1] + rng.choice([" ", "-", "1"]) for _ in range(100))) for k in range(400)]
    docs += [(9, None), (10, ""), (11, "Ausdruck AUSDRUCK " * 4)]
    got = rows_of(spelling.variant_groups(spark.createDataFrame(docs, DOCS).repartition(5), part))
    want = groups_by_hand(vocabulary_by_hand(docs))
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] is not None and r[1] != r[2] for r in want)


def test_variants_of_long_words_and_one_prefix(spark):
    """A third of all words share a long prefix, others are very long: parts are cut, none is lost."""
    rng = random.Random(4)
    stem, long_word = "unter" * 30, "".join(rng.choice("abc") for _ in range(30_000))
    words = {stem + "".join(rng.choice("xyz") for _ in range(rng.randrange(3, 6))) for _ in range(200)}
    words |= {long_word, long_word + "a", long_word[:70] + long_word[71:], "q" + long_word[1:], "andere", "anderes", "andre"}
    pairs = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), part=2_000)
    near = near_by_hand({w: 1 for w in words if len(w) < 1_000})
    got = {frozenset(p) for p in rows_of(pairs)}
    assert pairs.count() == len(got)
    assert {p for p in got if max(map(len, p)) < 1_000} == {frozenset((a, b)) for a in near for b in near[a]}
    assert {p for p in got if max(map(len, p)) > 1_000} == {frozenset((long_word, w)) for w in words if len(w) > 1_000 and w != long_word}


def test_variants_on_awkward_tables(awkward, empty):
    want = groups_by_hand(vocabulary_by_hand([(r["doc_id"], r["text"]) for r in awkward.collect()]))
    assert rows_of(spelling.variant_groups(awkward)) == want
    assert spelling.variant_groups(empty).count() == 0


def test_variants_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert rows_of(queries.op13_spelling_variants(spark, small)) == groups_by_hand(vocabulary_by_hand(docs))
