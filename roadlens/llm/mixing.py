"""Operator 2, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.llm.common import WORD, content, numbered, row_key, running_totals, whole_row_hash
from roadlens.session import saved

#: Weights of the sources in order, repeating; the mix's share of all words; passes over a source at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Documents of a block on average, output shards, seed.
BLOCK_ROWS, SHARDS, SEED = 256, 16, "mix-1"
#: Pieces of an output shard that tasks write and shuffle one by one.
PIECES = 4096
#: Sources whose quotas are one row of the tree, on average.
CHUNK_SOURCES = 256
#: Copies of a row that are made of one element of an array.
COPIES = 4096
#: Width of the draw's support in standard deviations; the mass outside is below 1e-20.
SPREAD = 10


def _hash60(*parts: Column | str) -> Column:
    """A 60-bit hash that any SQL engine can repeat: the first 15 hexadecimal digits of an MD5."""
    text = F.concat_ws("|", F.lit(SEED), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _targets(stats: DataFrame) -> DataFrame:
    """Words that the mix wants from each source: (key, source_size, source_rows, target).

    Sources by code point, null last, weigh WEIGHTS, repeating.  With sources ordered by cap / weight, the
    level at which the first i are at their caps is (all - caps before) / (weights from here on); it rises
    while sources are above their caps and falls afterwards, so its maximum is the level that holds.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = stats.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(everything) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", PASSES * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    earlier, later = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    ranked = ranked.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight"))
    return ranked.select("key", "source_size", "source_rows", target.alias("target"))


def _hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """Number of marked items among ``drawn`` items of the population, by inversion within SPREAD deviations.

    Weights run up from the low end by the ratio of neighbouring probabilities and stay below e**50.
    """
    share = F.when(population > 0, marked / population).otherwise(F.lit(0.0))
    mean = drawn * share
    wide = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * (population - drawn) / F.greatest(population - 1, F.lit(1))))
    low = F.greatest(F.lit(0), drawn - (population - marked), F.floor(mean - SPREAD * wide - 1)).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + SPREAD * wide + 1)).cast("long")
    steps = F.sequence(low, F.greatest(low, high))

    def ratio(x: Column) -> Column:
        above = (marked - x).cast("double") * (drawn - x)
        return above / ((x + 1).cast("double") * (population - marked - drawn + x + 1))

    def run(start: Column, move) -> Column:
        return F.aggregate(steps, start, move)

    zero, one = F.lit(0.0), F.lit(1.0)
    total = run(
        F.struct(one.alias("w"), zero.alias("sum")),
        lambda a, x: F.struct((a["w"] * F.when(x < high, ratio(x)).otherwise(zero)).alias("w"), (a["sum"] + a["w"]).alias("sum")),
    )["sum"]
    found = run(
        F.struct(one.alias("w"), zero.alias("sum"), low.alias("x")),
        lambda a, x: F.struct(
            (a["w"] * F.when(x < high, ratio(x)).otherwise(zero)).alias("w"),
            (a["sum"] + a["w"]).alias("sum"),
            F.when(a["sum"] < uniform * total, x).otherwise(a["x"]).alias("x"),
        ),
    )["x"]
    return F.least(F.greatest(found, low), F.greatest(low, high))


def split_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The splitting tree: (key, quota) in, (key, shard, blocks) out; ``shards`` is a power of two.

    A node holds a number of shards and the exact quota of each source.  Its left half draws its share of the
    blocks from the node's without replacement: source by source a hypergeometric draw from what remains,
    which together is a multivariate hypergeometric draw.  The right half has the rest, so at every level the
    quotas add up exactly.  The sources of a node are dealt by hash to chunks of about CHUNK_SOURCES, one row each:
    a first draw divides the node's share among the chunks, a second one each chunk's among its sources, which is
    the same law; what one row holds grows with the number of sources by its 256th part.
    """
    chunks = max(1, -(-quotas.count() // CHUNK_SOURCES))
    tree = quotas.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks))).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("key", F.col("quota").cast("long").alias("q")))).alias("quotas")).withColumn("node", F.lit(0).cast("long"))
    width = shards
    while width > 1:
        width //= 2
        tree = saved(_drawn(tree, width), "tree")
        first = F.transform(F.arrays_zip("quotas", "drawn"), lambda z: F.struct(z["quotas"]["key"].alias("key"), z["drawn"].alias("q")))
        second = F.transform(F.arrays_zip("quotas", "drawn"), lambda z: F.struct(z["quotas"]["key"].alias("key"), (z["quotas"]["q"] - z["drawn"]).alias("q")))
        halves = F.array(F.struct(first.alias("quotas"), (2 * F.col("node")).alias("node")), F.struct(second.alias("quotas"), (2 * F.col("node") + 1).alias("node")))
        tree = tree.select("chunk", F.explode(halves).alias("half")).select("chunk", "half.*")
    return tree.select(F.col("node").cast("int").alias("shard"), F.explode("quotas").alias("s")).select("s.key", "shard", F.col("s.q").alias("blocks"))


def _total(quotas: str) -> Column:
    return F.aggregate(quotas, F.lit(0).cast("long"), lambda a, s: a + s["q"])


def _draws(quotas: str, n: Column, width: int, what: str) -> Column:
    """How many of ``n`` blocks, drawn without replacement, each element (key, q) of an array has."""

    def draw(acc: Column, s: Column) -> Column:
        uniform = (_hash60(F.lit(what), F.lit(width).cast("string"), F.col("node").cast("string"), s["key"].cast("string")) + 0.5) / float(1 << 60)
        x = F.when((s["q"] > 0) & (acc["n"] > 0), _hypergeometric(acc["pop"], s["q"], acc["n"], uniform)).otherwise(F.lit(0).cast("long"))
        return F.struct((acc["pop"] - s["q"]).alias("pop"), (acc["n"] - x).alias("n"), F.concat(acc["out"], F.array(x)).alias("out"))

    start = F.struct(_total(quotas).alias("pop"), n.alias("n"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(quotas, start, draw)["out"]


def _drawn(tree: DataFrame, width: int) -> DataFrame:
    """The tree's rows (node, chunk, quotas) with ``drawn``, what the node's left half has of each source."""
    totals = tree.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("chunk").alias("key"), _total("quotas").alias("q")))).alias("chunks"))
    left = F.floor((_total("chunks") + F.pmod(F.col("node"), F.lit(2))) / 2).cast("long")
    shares = totals.select("node", F.arrays_zip("chunks", _draws("chunks", left, width, "chunk").alias("drawn")).alias("z")).select("node", F.explode("z").alias("z"))
    shares = shares.select("node", F.col("z.chunks.key").alias("chunk"), F.col("z.drawn").alias("n"))
    rows = tree.join(shares, ["node", "chunk"])
    return rows.withColumn("drawn", _draws("quotas", F.col("n"), width, "draw")).drop("n")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What the mix takes of each document, and the output shards it goes to.

    A source's documents are dealt to blocks by hash, its blocks permuted by hash, and the mix takes whole
    passes over the source while its target allows, then the permuted blocks until the target is met; the
    last document of a source is taken in part, so taken words differ from the target by less than one.  The
    exact number of blocks of each source is then divided among the output shards by the splitting tree, and
    shards draw disjoint ranges of the permuted blocks.  ``shuffle_key`` orders a shard's documents.

    Returns doc_id, source, size, source_size, target, taken, parts (array of (shard, words), one a pass),
    shuffle_key, version (xxhash64 of the text), nth: one row for each input row.  Rows that share doc_id, source and
    text are counted and numbered (nth, from 1), and each is dealt by its number, so results don't depend on how
    rows are partitioned.  Null texts and texts without words have size 0 and are never taken; a null source is
    a source of its own, last in order.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("key"), F.regexp_count(content(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(content()).alias("version"))
    sizes = sizes.groupBy("doc_id", "source", "key", "size", "version").agg(F.count("*").alias("m"))
    each = F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES))
    sizes = sizes.withColumn("part", F.explode(each)).withColumn("nth", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least("m", (F.col("part") + 1) * COPIES)))).drop("m", "part")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sizes = saved(sizes.withColumn("h", _hash60(F.lit("doc"), name, F.col("version").cast("string"), F.col("nth").cast("string"))), "sizes")
    stats = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    stats = saved(_targets(stats), "targets")
    stats = stats.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_rows") / BLOCK_ROWS)).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    stats = stats.withColumn("passes", passes).withColumn("rest", (F.floor("target") - F.col("passes") * F.col("source_size")).cast("long"))

    dealt = sizes.join(stats, "key").withColumn("block", F.pmod("h", "n_blocks"))
    dealt = saved(dealt.withColumn("g", _hash60(F.lit("block"), F.col("key"), F.col("block").cast("string"))), "dealt")
    placed = running_totals(dealt, ["key"], "g", ["block", "h", "doc_id", "version", "nth"], {"before": "size"}, width=60)
    partly = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))).cast("long")
    placed = saved(placed.withColumn("partly", partly), "placed")

    blocks = placed.groupBy("key", "block", "g", "passes", "n_blocks").agg(F.max(F.when(F.col("partly") > 0, 1).otherwise(0)).cast("long").alias("drawn")).withColumn("one", F.lit(1).cast("long"))
    blocks = saved(blocks, "blocks")
    ranked = running_totals(blocks, ["key"], "g", ["block"], {"rank": "one", "deck": "drawn"}, width=60)
    used = blocks.groupBy("key", "passes").agg(F.sum("one").alias("have"), F.sum("drawn").alias("drawn"))
    quotas = used.select("key", (F.col("passes") * F.col("have") + F.col("drawn")).alias("quota"), "have")
    drawn = split_quotas(quotas.select("key", "quota"), shards)
    upto = F.sum("blocks").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ends = drawn.withColumn("upto", upto).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("ends"))
    # Position of a block's passes in the source's deck; the shard is the first whose range ends behind it.
    places = ranked.join(ends.join(quotas.select("key", "have"), "key"), "key")

    def shard_at(position: Column) -> Column:
        return F.size(F.filter("ends", lambda e: e["upto"] <= position))

    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(PASSES).cast("long")), lambda p: shard_at(p * F.col("have") + F.when(p < F.col("passes"), F.col("rank")).otherwise(F.col("deck"))))
    places = places.select("key", "block", every.alias("shards"))
    out = placed.join(places, ["key", "block"])
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes")),
        lambda p: F.struct(F.element_at("shards", (p + 1).cast("int")).alias("shard"), F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("partly")).alias("words")),
    )
    out = out.withColumn("parts", F.filter(parts, lambda p: p["words"] > 0))
    taken = (F.col("passes") * F.col("size") + F.col("partly")).alias("taken")
    shuffle_key = _hash60(F.lit("shuffle"), name, F.col("version").cast("string"), F.col("nth").cast("string")).alias("shuffle_key")
    return out.select("doc_id", "source", "size", "source_size", "target", taken, "parts", shuffle_key, "version", "nth")


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents of the mix with the columns of ``docs``: one row a pass, dealt to pieces of the output shards
    (as many as the data need, PIECES a shard at most) and shuffled within them.

    A document taken in part keeps its first words, joined by one space, and n_chars follows its text.  Null and
    empty texts and texts without words are never taken.  Rows that share doc_id, source and text are numbered among
    themselves, so each is taken as often as the plan says.  A null doc_id stays null; an empty table gives an
    empty result.  Columns may have any names: rows travel as one struct.
    """
    plan = mix(docs, shards)
    same = ["id", "no_id", "key", "version"]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key")
    left = docs.select(F.struct("*").alias("row"), *row_key(), key, F.xxhash64(content()).alias("version"))
    right = plan.where("taken > 0").select(*row_key(), key, "version", "nth", "size", "shuffle_key", "parts")
    repeated = saved(plan.where("nth > 1").select(*row_key(), key, "version").distinct(), "repeated")
    if repeated.isEmpty():  # then no row needs a number
        left = left.withColumn("nth", F.lit(1).cast("long"))
    else:
        once = left.join(repeated, same, "left_anti").withColumn("nth", F.lit(1).cast("long"))
        left = once.unionByName(numbered(left.join(repeated, same, "left_semi"), same, whole_row_hash()))
    same = [*same, "nth"]
    rows = left.join(right, same).withColumn("part", F.explode("parts"))
    text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.greatest(F.lit(1), F.col("part.words")).cast("int")), " ")
    taken = F.when(F.col("part.words") < F.col("size"), cut).otherwise(F.col("row")["text"])
    changed = {"text": taken, "n_chars": F.length(taken)}
    fields = [changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns]
    rows = rows.select("part.shard", "shuffle_key", F.struct(*fields).alias("row"))
    dealt = rows.repartition("shard", F.pmod("shuffle_key", F.lit(PIECES)))
    return dealt.sortWithinPartitions("shard", "shuffle_key").select("row.*")
