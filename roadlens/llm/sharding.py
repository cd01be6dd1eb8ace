"""Operator 9, sharding: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.llm.common import content, running_totals
from roadlens.session import discard, saved

#: Bytes that a document takes besides its text; rounds of propagation at most.
OVERHEAD, ROUNDS = 8, 8
#: Unlinked documents above 1/HEAVY of a shard are placed one by one: at most HEAVY * shards of them exist.
HEAVY = 128


def _spread(load: list[float], amount: float) -> list[float]:
    """How much each shard gets of ``amount`` so that all end as level as possible."""
    order, level, used = sorted(load), 0.0, 0.0
    for k, low in enumerate(order):
        level = (amount + used + low) / (k + 1)
        used += low
        if k + 1 == len(order) or level <= order[k + 1]:
            break
    return [max(0.0, level - x) for x in load]


def _lookup(values: list[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at + 1).cast("int"))


def _propagate(state: DataFrame, shards: int, share: float, rounds: int) -> DataFrame:
    """Rounds over (g1, g2, size, shard, n): n documents of a group in a shard.

    Documents of a group are neighbours of each other, so n is the number of neighbours that a shard holds.  In
    a round each group's neighbour counts give the shard that holds most (ties by hash); the documents in shards
    that hold fewer meet it in a join and want to move there.  Moves into a shard are admitted in hash order
    while they fit its quota, the last group in part.  In even rounds all shards may be chosen, and a quota is
    the shard's room and what wants to leave it, so that flows may cross; in odd rounds only shards with room.
    """
    idle = 0
    for k in range(rounds):
        loads = {r["shard"]: r["bytes"] for r in state.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).collect()}
        room = [share - loads.get(s, 0) for s in range(shards)]
        open_ = F.col("size") <= (F.lit(share) if k % 2 == 0 else _lookup(room, F.col("shard")))
        best = state.where(open_).groupBy("g1", "g2").agg(F.max(F.struct("n", F.xxhash64("g1", "g2", "shard").alias("tie"), F.col("shard").alias("target"))).alias("best"))
        wants = state.join(best, ["g1", "g2"]).where("shard <> best.target")
        wants = wants.select("g1", "g2", "size", "shard", "n", "best.target", (F.col("n") * F.col("size")).alias("bytes"), F.xxhash64("g1", "g2").alias("h"))
        wants = saved(wants, "wants")
        leaving = {r["shard"]: r["bytes"] for r in wants.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()} if k % 2 == 0 else {}
        quota = [max(0.0, room[s] + leaving.get(s, 0)) for s in range(shards)]
        fits = F.floor((_lookup(quota, F.col("target")) - F.col("before")) / F.col("size"))
        moves = running_totals(wants, ["target"], "h", ["g1", "g2", "shard"], {"before": "bytes"})
        moves = moves.withColumn("k", F.greatest(F.lit(0), F.least(F.col("n"), fits)).cast("long")).where("k > 0")
        moves = saved(moves.select("g1", "g2", "size", "shard", "target", "k"), "moves")
        discard(wants)
        idle = idle + 1 if moves.isEmpty() else 0
        if idle == 2:
            break
        if idle:
            continue
        after = state.unionByName(moves.select("g1", "g2", "size", "shard", (-F.col("k")).alias("n"))).unionByName(
            moves.select("g1", "g2", "size", F.col("target").alias("shard"), F.col("k").alias("n"))
        )
        state = saved(after.groupBy("g1", "g2", "size", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "labels")
    return state


def cut_edges(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Links between documents of equal texts (g1, g2), and how many of them join two shards: one row (links, cut)."""
    pairs = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long")
    held = rows.groupBy("g1", "g2", shard).agg(F.count("*").alias("n"))
    inside = held.agg(pairs(F.col("n")).alias("inside"))
    links = held.groupBy("g1", "g2").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("links"))
    return links.join(F.broadcast(inside)).select("links", (F.col("links") - F.col("inside")).alias("cut"))  # one row each


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """Shards of near equal bytes that keep equal texts together.

    Documents with equal texts are linked; each starts in a shard by hash and balanced label propagation moves
    the groups together.  Documents above a shard's share go back into a pool.  Documents without links, and
    the pool, then level the shards: heavy ones go one by one to the lightest shard, the others are cut from
    their hash order at the points that fill every shard to the same level.

    Returns doc_id, size (bytes of the text and OVERHEAD), text_crc32, shard, slot (gapless from 0 within a
    shard), g1 and g2 (digests of the text, by which cut_edges tells links): one row for each input row.  Null
    texts are empty, and empty texts are equal; rows that repeat are documents of their own; a null doc_id stays
    null; an empty table gives an empty result.  Only doc_id and text are read, other columns may have any names.
    """
    text = content().cast("binary")
    base = docs.select("doc_id", F.octet_length(content()).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(text, F.lit(1)).alias("g2"))
    base = saved(base.select("doc_id", (F.col("bytes") + OVERHEAD).alias("size"), "text_crc32", "g1", "g2", F.xxhash64("doc_id", "g1", F.lit(7)).alias("h")), "documents")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / shards
    groups = saved(base.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1").select("g1", "g2"), "groups")
    linked = saved(base.join(groups, ["g1", "g2"]), "linked")
    alone = base.join(groups, ["g1", "g2"], "left_anti")
    start = F.pmod("h", F.lit(shards)).cast("int")
    state = saved(linked.groupBy("g1", "g2", "size", start.alias("shard")).agg(F.count("*").alias("n")), "labels")
    state = _propagate(state, shards, share, rounds)

    # What is above a shard's share goes into the pool (shard -1).
    held = state.withColumn("bytes", F.col("n") * F.col("size")).withColumn("spread", F.xxhash64("g1", "g2", F.lit(3)))
    held = running_totals(held, ["shard"], "spread", ["g1", "g2"], {"before": "bytes"})
    stay = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.lit(share) - F.col("before")) / F.col("size")))).cast("long")
    held = held.withColumn("stay", F.when(F.col("before") + F.col("bytes") <= share, F.col("n")).otherwise(stay))
    pairs = F.array(F.struct(F.col("shard"), F.col("stay").alias("n")), F.struct(F.lit(-1).alias("shard"), (F.col("n") - F.col("stay")).alias("n")))
    placed = held.select("g1", "g2", "size", F.explode(pairs).alias("p")).select("g1", "g2", "size", "p.shard", "p.n").where("n > 0")
    placed = saved(placed.groupBy("g1", "g2", "size", "shard").agg(F.sum("n").alias("n")), "placed")
    loads = {r["shard"]: float(r["bytes"]) for r in placed.where("shard >= 0").groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).collect()}
    load = [loads.get(s, 0.0) for s in range(shards)]

    # Linked documents: those of a group are numbered, and take its shards in order.
    upto = F.sum("n").over(Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    plan = placed.withColumn("upto", upto).groupBy("g1", "g2").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("plan"))
    numbered = running_totals(linked.withColumn("one", F.lit(1).cast("long")), ["g1", "g2"], "h", ["doc_id"], {"place": "one"})
    settled = numbered.join(saved(plan, "plan"), ["g1", "g2"])
    settled = settled.withColumn("shard", F.element_at(F.filter("plan", lambda p: p["upto"] > F.col("place")), 1)["shard"])
    columns = ["doc_id", "size", "text_crc32", "g1", "g2", "h"]
    settled = saved(settled.select(*columns, "shard"), "settled")

    rest = saved(alone.select(*columns).unionByName(settled.where("shard < 0").select(*columns)), "rest")
    limit = share / HEAVY
    if rest.where(F.col("size") > limit).limit(HEAVY * shards + 1).count() <= HEAVY * shards:
        heavy = sorted(((r["size"], r["h"], r["g1"]) for r in rest.where(F.col("size") > limit).select("size", "h", "g1").collect()), reverse=True)
    else:
        raise AssertionError("more heavy documents than the total allows")
    rows = []
    for size, h, g1 in heavy:
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += size
        rows.append((h, g1, s))
    spark = docs.sparkSession
    by_hand = spark.createDataFrame(rows, "h long, g1 long, shard int").groupBy("h", "g1").agg(F.sort_array(F.collect_list("shard")).alias("its"))
    nth = F.row_number().over(Window.partitionBy("h", "g1").orderBy("doc_id"))
    heavies = rest.where(F.col("size") > limit).join(by_hand, ["h", "g1"]).withColumn("shard", F.element_at("its", nth)).select(*columns, "shard")

    light = rest.where(F.col("size") <= limit)
    amount = light.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    gets, ends, at = _spread(load, float(amount)), [], 0.0
    for x in gets:
        at += x
        ends.append(at)
    light = running_totals(light, [], "h", ["g1", "doc_id"], {"before": "size"})
    middle = F.col("before") + F.col("size") / 2
    fill = F.array(*[F.lit(float(e)) for e in ends[:-1]]) if shards > 1 else F.array().cast("array<double>")
    lights = light.withColumn("shard", F.size(F.filter(fill, lambda e: e <= middle))).select(*columns, "shard")

    everything = saved(settled.where("shard >= 0").unionByName(heavies).unionByName(lights).withColumn("one", F.lit(1).cast("long")), "sharded")
    return running_totals(everything, ["shard"], "h", ["g1", "doc_id"], {"slot": "one"}).select("doc_id", "size", "text_crc32", "shard", "slot", "g1", "g2")
