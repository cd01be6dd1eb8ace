"""Parts that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.session import discard, saved, ship

#: White space of every contract, and what is a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def content(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def for_python(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Python workers have this package and get batches bounded in bytes."""
    ship(df.sparkSession)
    return df


def running_totals(rows: DataFrame, group: list[str], spread: str, order: list[str], sums: dict[str, str], width: int = 64, a_cut: int = 10_000) -> DataFrame:
    """Sums of the earlier rows of a group, in the order of the hash column ``spread`` of ``width`` bits.

    ``sums`` maps result columns to the summed columns.  A group is cut by the top bits of the hash, so that a
    group of any share of the rows is dealt to many tasks: one window adds up the cuts of a group, another
    runs within each cut.  The number of bits follows the number of rows, for about ``a_cut`` rows a cut of
    a group that has them all.  Group columns must not be null.  ``rows`` is read three times and should be a
    saved table.
    """
    bits = min(width - 1, max(8, (rows.count() // a_cut).bit_length()))
    rows = rows.withColumn("_cut", F.shiftright(F.col(spread), width - bits))
    keys = [*group, "_cut"]
    cuts = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_cut_{o}") for o, c in sums.items()])
    over_cuts = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(*keys, *[F.coalesce(F.sum(f"_cut_{o}").over(over_cuts), F.lit(0)).alias(f"_before_{o}") for o in sums])
    within = Window.partitionBy(*keys).orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_within_{o}") for o, c in sums.items()])
    out = out.join(cuts, keys).select("*", *[(F.col(f"_before_{o}") + F.col(f"_within_{o}")).alias(o) for o in sums])
    return out.drop("_cut", *[f"_within_{o}" for o in sums], *[f"_before_{o}" for o in sums])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps: every node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows.  Each step is a few shuffles of the edges; tasks reduce their own rows of a
    hub before the shuffle.  The minima are saved tables, which Spark broadcasts by their known size or joins
    with a hub split; that of a round's start also tells whether the edges form stars, which ends the rounds.  Their
    number grows with the logarithm of the longest path; ``rounds`` is far beyond any that 64-bit ids allow, and a
    caller who sees the error has edges that change between reads.
    """
    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    back = [F.col("v").alias("u"), F.col("u").alias("v")]
    for _ in range(rounds):
        both = now.select("u", "v", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(*back, F.lit(0).alias("up"), F.lit(1).alias("down")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.sum("up").alias("up"), F.max("down").alias("down")), "least")
        if least.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            discard(least)
            break
        large = now.select(*back).join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        lower = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now, least, lower)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def row_key() -> list[Column]:
    """doc_id as two columns that joins can compare: ``id``, and ``no_id`` where it is null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id")]


def without(rows: DataFrame, same: list[str], dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """The structs ``row`` of ``rows`` (row, content, *same) whose key ``same`` is not in ``dropped``.

    Of rows that share a key of ``repeated`` one with the longest content stays, chosen by an aggregate that tasks
    begin on their own rows; ties go by hashes of the content, then of the whole row.  Both key tables are saved ones:
    Spark broadcasts them if their known size allows, so that texts are not shuffled then.
    """
    left = rows.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    order = F.struct(F.length("content"), F.xxhash64("content"), whole_row_hash())
    again = left.join(repeated, same, "left_semi").groupBy(*same).agg(F.max_by("row", order).alias("row"))
    return left.join(repeated, same, "left_anti").select("row.*").unionByName(again.select("row.*"))


def whole_row_hash() -> Column:
    """A hash of the struct ``row``, whatever types it holds: rows that share it are equal."""
    return F.xxhash64(F.to_json(F.struct("row")))


def numbered(rows: DataFrame, same: list[str], order: Column, salts: int = 256) -> DataFrame:
    """Rows with ``nth``, from 1, among those that share the columns ``same`` (not null).

    A key's rows are dealt by a salt, numbered by ``order`` within it, and salts follow one another, so that no task
    numbers all rows of a key.  Rows must come from a table, read alike each time.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    counts = saved(dealt.groupBy(*same, "_salt").agg(F.count("*").alias("_n")), "salts")
    earlier = Window.partitionBy(*same).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*same, "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = dealt.withColumn("_within", F.row_number().over(Window.partitionBy(*same, "_salt").orderBy(order)))
    return within.join(before, [*same, "_salt"]).withColumn("nth", F.col("_before") + F.col("_within")).drop("_salt", "_before", "_within")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
