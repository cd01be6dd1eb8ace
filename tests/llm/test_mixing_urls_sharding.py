import zlib
from collections import Counter, defaultdict

import pytest

from roadlens.llm import common, mixing, neardup, queries, sharding, urls
from roadlens.llm.mixing import split_quotas
from test_dedup import words_of


def brute_targets(sizes):
    """Reshare by weight, round after round."""
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, rest, total = {}, set(sizes), 1.5 * sum(sizes.values())
    while rest:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
        rest -= over
    return target


def check_mix(docs, rows):
    want = Counter((r["doc_id"], r["source"], len(words_of(r["text"]))) for r in docs.collect())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    targets = brute_targets(sizes)
    for s, own in by.items():
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s], abs=1e-6) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[s]) < 1
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["parts"]) for r in own)
        assert all(0 <= p["shard"] < 4 for r in own for p in r["parts"])


def test_mix(awkward, crowd, empty):
    for docs in (awkward, crowd):
        rows = mixing.mix(docs, 4).collect()
        check_mix(docs, rows)
        assert Counter(map(str, rows)) == Counter(map(str, mixing.mix(docs.repartition(5), 4).collect()))
    assert mixing.mix(empty, 4).count() == 0


def test_mixed_documents(awkward, crowd):
    for docs in (awkward, crowd):
        out = mixing.mixed_documents(docs, 4)
        assert out.columns == docs.columns
        taken = Counter()
        for r in out.collect():
            taken[r["doc_id"]] += len(words_of(r["text"]))
        want = Counter()
        for r in mixing.mix(docs, 4).collect():
            want[r["doc_id"]] += r["taken"]
        assert +taken == +want


def test_mix_of_repeated_and_missing_ids(spark):
    """Rows that share an id, a size, or all: what is taken doesn't depend on how rows are partitioned."""
    rows = [(k % 7 or None, f"a{k % 40} b c", "s" if k % 3 else None) for k in range(900)] + [(5, "same text", "t")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, many = (Counter(map(str, mixing.mix(d, 4).drop("parts").collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many and sum(one.values()) == 1200
    plan = mixing.mix(docs, 4).collect()
    check_mix(docs, plan)
    taken = Counter()
    for r in mixing.mixed_documents(docs, 4).collect():
        taken[r["doc_id"]] += len(words_of(r["text"]))
    assert taken == +sum((Counter({r["doc_id"]: r["taken"]}) for r in plan), Counter())


def test_a_hot_row_is_split(spark):
    """100,000 equal rows and as many without an id: whole results, other columns kept, no task with most of them."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text").otherwise("no id").alias("text"), F.lit("s").alias("source"), F.col("id").alias("other"))
    plan = mixing.mix(rows, 4)
    assert plan.count() == 200_000
    assert plan.agg(F.sum("taken")).first()[0] == 600_000  # a source alone gives one and a half times its words
    blocks = common.numbered(rows.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(0)).alias("k")), ["k"], common.whole_row_hash())
    assert {(r["k"], r["n"], r["top"], r["d"]) for r in blocks.groupBy("k").agg(F.count("*").alias("n"), F.max("nth").alias("top"), F.count_distinct("nth").alias("d")).collect()} == {(0, 100_000, 100_000, 100_000), (7, 100_000, 100_000, 100_000)}
    mixed = mixing.mixed_documents(rows, 4)
    assert mixed.count() == 300_000 and mixed.select("other").distinct().count() == 200_000


def test_splitting_tree_of_many_sources(spark):
    """Quotas of 3,000 sources: chunks add up, shards are even, and a source's draws have the mean and the spread of the law."""
    quotas = {f"s{k:04d}": 40 + k % 7 for k in range(3000)}
    rows = split_quotas(spark.createDataFrame(list(quotas.items()), "key string, quota long"), 4).collect()
    by_key, by_shard = Counter(), Counter()
    for r in rows:
        by_key[r["key"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert by_key == quotas and max(by_shard.values()) - min(by_shard.values()) <= 3
    first = [r["blocks"] - quotas[r["key"]] / 4 for r in rows if r["shard"] == 0]
    variance = sum(x * x for x in first) / len(first)
    assert abs(sum(first)) <= 3 and variance == pytest.approx(43 * 0.25 * 0.75, rel=0.1)


def test_mix_runs_no_python(crowd):
    plan = mixing.mix(crowd, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_splitting_tree(spark):
    quotas = {f"s{k}": q for k, q in enumerate([0, 1, 7, 500, 12_345])}
    rows = split_quotas(spark.createDataFrame(list(quotas.items()), "key string, quota long"), 8).collect()
    by_key, by_shard = Counter(), Counter()
    for r in rows:
        assert r["blocks"] >= 0
        by_key[r["key"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert all(by_key[k] == q for k, q in quotas.items())
    assert max(by_shard.values()) - min(by_shard.values()) <= 3
    big = [r["blocks"] for r in rows if r["key"] == "s4"]
    assert max(abs(b - 12_345 / 8) for b in big) < 60  # a few standard deviations of a draw without replacement


def test_hypergeometric_draws(spark):
    """Mean and variance of draws, against the exact ones."""
    from pyspark.sql import functions as F

    n, k, d = 200, 60, 50
    rows = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    lit = lambda x: F.lit(x).cast("long")
    got = [r[0] for r in rows.select(mixing._hypergeometric(lit(n), lit(k), lit(d), F.col("u"))).collect()]
    mean, share = sum(got) / len(got), k / n
    assert mean == pytest.approx(d * share, abs=0.02)
    assert sum((x - mean) ** 2 for x in got) / len(got) == pytest.approx(d * share * (1 - share) * (n - d) / (n - 1), rel=0.02)
    assert got == sorted(got) and min(got) >= 0 and max(got) <= d


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (1, "http://Shop.Example.com/en/x", ""),
    (2, "http://www.example.com/en/x?q", ""),
    (3, "http://a.com", ""),
    (4, "http://a.com/", ""),
    (5, None, None),
    (6, "no scheme/en/", "<link rel=canonical href=/x>"),
    (7, "https://other.org/a/b", '<link rel="canonical" href="http://bad.net/es/1">'),
    (8, "https://third.org/", '<meta http-equiv="refresh" content="0; url=https://other.org/a/b#frag">'),
    (9, "https://fourth.org/", "<META HTTP-EQUIV='Refresh' CONTENT='5;URL=//fifth.org/x'>"),
    (10, "https://fifth.org/x", '<link href="https://good.com/" rel="canonical">'),
    (11, "https://fifth.org/y", '<link rel="canonical" href="x">'),
    (12, "https://sixth.org/", '<link rel="canonical" href="https://fourth.org/"><link rel="canonical" href="http://bad.net/fr/1">'),
    (12, "https://bad.net/es/1#x", "<p>"),
    (13, "https://alone.org/q?a=1&b=2", "x"),
    (14, "http://notnet/es/", ""),
]


def test_urls(spark):
    pages = spark.createDataFrame([(*p, 1, "r") for p in PAGES], "page_id long, url string, html string, node long, rule string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect())
    want = Counter(
        [
            (1, "shop.example.com", "/en/x", "example.com/en/", "block"),
            (2, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
            (3, "a.com", "", None, "allow"),
            (4, "a.com", "/", "com/", "allow"),
            (5, "", "", None, "allow"),
            (6, "", "", None, "allow"),
            (7, "other.org", "/a/b", None, "block"),
            (8, "third.org", "/", None, "block"),
            (9, "fourth.org", "/", None, "allow"),
            (10, "fifth.org", "/x", None, "allow"),
            (11, "fifth.org", "/y", None, "allow"),
            (12, "sixth.org", "/", None, "allow"),
            (12, "bad.net", "/es/1", "net/es/", "block"),
            (13, "alone.org", "/q", None, "allow"),
            (14, "notnet", "/es/", None, "allow"),
        ]
    )
    assert got == want
    assert urls.judge(pages.limit(0)).count() == 0


def check_shards(docs, rows, shards, tolerance):
    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        want[(r["doc_id"], len(raw) + 8, zlib.crc32(raw))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(load.values()) / shards
    assert all(abs(load[s] - share) <= tolerance for s in range(shards))


def test_sharding(awkward, crowd, empty):
    rows = sharding.shard_documents(crowd, 4).collect()
    check_shards(crowd, rows, 4, max(r["size"] for r in rows))
    rows = sharding.shard_documents(awkward, 3).collect()
    check_shards(awkward, rows, 3, max(r["size"] for r in rows))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_splits_a_hot_group_and_keeps_small_ones(spark):
    rows = [(k, "hot text " * 20) for k in range(300)] + [(1000 + k, f"pair {k // 2} " * 15) for k in range(200)] + [(5000 + k, f"alone {k} " * 15) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, 8).collect()
    check_shards(docs, got, 8, 600)
    where = defaultdict(set)
    for r in got:
        if 1000 <= r["doc_id"] < 5000:
            where[r["g1"]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 0.1 * len(where)
    assert len({r["shard"] for r in got if r["doc_id"] < 1000}) <= 5


def test_cut_edges(spark):
    """Against pairs counted one by one, and far fewer than placement by hash cuts."""
    from pyspark.sql import functions as F

    rows = [(k, f"text {k // 3} " * 9) for k in range(600)] + [(1000 + k, f"alone {k}") for k in range(200)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).withColumn("by_hash", F.pmod(F.xxhash64("doc_id"), F.lit(8))).cache()
    got = out.collect()
    by = defaultdict(list)
    for r in got:
        by[r["g1"]].append(r)
    for column in ("shard", "by_hash"):
        cut = sum(a[column] != b[column] for own in by.values() for i, a in enumerate(own) for b in own[:i])
        assert tuple(sharding.cut_edges(out, column).first()) == (600, cut)
    assert sharding.cut_edges(out).first()["cut"] < 0.2 * sharding.cut_edges(out, "by_hash").first()["cut"]


def test_mixed_documents_carry_whole_rows(spark):
    """Columns with the operator's own names, negative, null and repeated ids."""
    names = "id long, no_id string, version int, nth string, size string, shuffle_key int, parts string, row int, _id long"
    rows = [(d, f"one two three four {k % 3}", s, 9, *(1, "a", 2, "b", "c", 3, "d", 4, 5)) for k, (d, s) in enumerate([(-1, "x"), (None, "x"), (None, "y"), (4, "y"), (4, "y"), (5, None)] * 3)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, n_chars long, {names}")
    out = mixing.mixed_documents(docs, 4)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(tuple(r)[4:] == (1, "a", 2, "b", "c", 3, "d", 4, 5) and r["n_chars"] == len(r["text"]) for r in got)
    taken, want = Counter(), Counter()
    for r in got:
        taken[r["doc_id"]] += len(words_of(r["text"]))
    for r in mixing.mix(docs, 4).collect():
        want[r["doc_id"]] += r["taken"]
    assert +taken == +want
    assert mixing.mixed_documents(docs.limit(0), 4).count() == 0


def test_shards_draw_disjoint_blocks_and_fill_their_quotas(spark, crowd, monkeypatch):
    """Each block of a source goes to one shard a pass, and the shards' blocks are within one of each other."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    whole = defaultdict(set)
    for r in mixing.mix(crowd, 4).collect():
        for at, p in enumerate(r["parts"]):
            whole[(r["source"], r["doc_id"], at)].add(p["shard"])
    assert all(len(s) == 1 for s in whole.values()) and {s for x in whole.values() for s in x} == {0, 1, 2, 3}


def test_aliases_at_scale(spark):
    """A hundred thousand links: chains, cycles, a hub, and pages alone; against components by hand."""
    n, pages, links = 20_000, [], []

    def page(k, target):
        html = "" if target is None else f'<link rel="canonical" href="http://h{target}.org/p">'
        pages.append((k, f"http://h{k}.org/p", html))
        if target is not None:
            links.append((k, target))

    for k in range(n):  # chains of 40
        page(k, k + 1 if k % 40 != 39 else None)
    for k in range(n, 2 * n):  # cycles of 10
        page(k, k + 1 if k % 10 != 9 else k - 9)
    for k in range(2 * n, 5 * n):  # a hub
        page(k, 2 * n if k > 2 * n else None)
    parent = list(range(5 * n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    allowed, blocked = {39 + 40 * k for k in range(0, 400, 2)}, {20 + 40 * k for k in range(400)} | {n + 10 * k for k in range(100)} | {2 * n + 5}
    rules = tuple(urls.Rule("allow", f"h{k}.org", "/") for k in sorted(allowed)[:40]) + tuple(urls.Rule("block", f"h{k}.org", "/") for k in [*sorted(blocked)[:40], n, n + 50, 2 * n + 5])
    own = {int(r.host[1:-4]): r.verdict for r in rules}
    by = defaultdict(set)
    for k, v in own.items():
        by[root(k)].add(v)
    want = {k: own.get(k) or ("allow" if "allow" in by[root(k)] or not by[root(k)] else "block") for k in range(5 * n)}
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(docs, rules).select("page_id", "verdict").collect()}
    assert got == want and Counter(got.values())["block"] > 3 * n


def test_queries(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op9_sharding(spark, small).collect()
    check_shards(docs, rows, 24, max(r["size"] for r in rows))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert queries.op2_source_mixing(spark, small).count() == docs.count()
    assert neardup.CENTRES == 3
