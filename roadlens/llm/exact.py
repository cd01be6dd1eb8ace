"""Operator 6, exact dedup: a log-structured merge index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import content, row_key, without
from roadlens.session import cleaned_up, discard, fresh_path, saved

#: Characters that normalising deletes: fixed values of the contract.
DELETED = " \t\n\x0b\x0c\r"
#: Memtables that are flushed as runs of level 0, and runs that a compaction merges into one of the next level.
FLUSHES, FAN_OUT = 4, 2


def normalised(text: Column) -> Column:
    return F.translate(text, DELETED, "")


class Level:
    """Runs of one level: a table in the shared folder, bucketed by digest.

    A run is one file a bucket, sorted by digest, with the ranges and a Bloom filter of its digests.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.runs = spark, 0
        self.name, self.path = f"digests_{uuid.uuid4().hex}", fresh_path(spark, "level")

    def flush(self, rows: DataFrame) -> None:
        """Add a run: rows (digest, best, n) become an entry a digest, which keeps the best row and adds up the counts."""
        run = rows.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        # As many buckets as shuffle partitions, so that each bucket comes from one task as one sorted file.
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = run.write.mode("append").format("parquet").option("path", self.path).bucketBy(buckets, "digest").sortBy("digest")
        with cleaned_up(self.spark):
            writer.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").saveAsTable(self.name)
        self.runs += 1

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def build_index(rows: DataFrame, flushes: int = FLUSHES, fan_out: int = FAN_OUT) -> Level:
    """The index over rows (digest, best, n), dealt to memtables by their ``best`` row: one run of the last level.

    A level with ``fan_out`` runs is compacted: its buckets are merged by digest where they are, without a
    shuffle, into a run of the next level.
    """
    spark, levels = rows.sparkSession, [Level(rows.sparkSession)]

    def compact(k: int) -> None:
        if k + 1 == len(levels):
            levels.append(Level(spark))
        levels[k + 1].flush(levels[k].entries())
        levels[k].drop()
        levels[k] = Level(spark)

    for k in range(flushes):
        levels[0].flush(rows.where(F.pmod(F.xxhash64("best"), F.lit(flushes)) == k))
        for at in range(len(levels)):
            if levels[at].runs == fan_out:
                compact(at)
    for at, level in enumerate(levels):
        if level.runs and (level.runs > 1 or any(x.runs for x in levels[at + 1 :])):
            compact(at)
    return levels[-1]


def exact_classes(docs: DataFrame, digest_bits: int = 64) -> DataFrame:
    """Class of each document under equality of its text without white space.

    The index maps a 64-bit digest of the normalised text to the row that stays (most code points in the
    original, then smallest doc_id) and the number of rows.  Digests of several rows are hits; only their texts
    are read again and compared, byte for byte, with the text of the row that stays.  Rows that differ (a clash
    of digests) are grouped again by their normalised bytes, so results are exact for any digest.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each input row.  Null counts as empty;
    all empty texts are one group.  A null doc_id orders after all others.  If rows share the doc_id that stays,
    each of them has kept true.  An empty table gives an empty result.  Only doc_id and text are read, other
    columns may have any names.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content().alias("content")).withColumn("norm", normalised(F.col("content")))
    digest = F.xxhash64("norm") if digest_bits == 64 else F.pmod(F.xxhash64("norm"), F.lit(1 << digest_bits))
    best = F.struct((-F.length("content")).alias("minus_length"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    keyed = keyed.select("doc_id", "norm", digest.alias("digest"), best.alias("best"))
    entries = keyed.select("doc_id", "digest", "best", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    entries = saved(entries, "entries")
    index = build_index(entries.select("digest", "best", F.lit(1).cast("long").alias("n")))
    hits = saved(index.entries().where("n > 1"), "hits")  # a plain table, whose join can split a hot digest
    index.drop()
    clashes = _clashes(keyed, hits)

    sha = F.lower(F.hex("sha")).alias("text_sha256")
    own = F.coalesce(F.col("hit"), F.struct("best", F.lit(1).cast("long").alias("n")))
    plain = entries.join(hits.select("digest", F.struct("best", "n").alias("hit")), "digest", "left")
    plain = plain.select("doc_id", own["best"].alias("stays"), own["n"].alias("group_size"), sha, "digest")
    if not clashes.isEmpty():  # clashing digests: group by the bytes themselves
        whole = keyed.join(clashes, "digest", "left_semi")
        groups = saved(whole.groupBy("norm").agg(F.min("best").alias("stays"), F.count("*").alias("group_size")), "groups")
        regrouped = whole.join(groups, "norm").select("doc_id", "stays", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "digest")
        plain = plain.join(clashes, "digest", "left_anti").unionByName(regrouped)
    keep_id = F.col("stays.doc_id")
    return plain.select("doc_id", keep_id.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def _clashes(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """Byte verification: digests with a row whose bytes differ from those of the row that stays.

    Only rows of hits go on from the scan.  The text that stays is found by digest and row, so a hot group brings
    one; then all rows of hits meet it, in a join of plain tables that can split a hot digest.
    """
    several = keyed.join(hits.select("digest", F.col("best").alias("stays")), "digest").select("digest", "norm", "best", "stays")
    several = saved(several, "several")
    stays = saved(several.where("best = stays").groupBy("digest").agg(F.min("norm").alias("text")), "stays")
    different = saved(several.join(stays, "digest").where("norm <> text").select("digest"), "different")
    clashes = saved(different.distinct(), "clashes")
    discard(several, stays, different)
    return clashes


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    Which one is as in exact_classes; of rows that share its doc_id too, one with the longest text stays, so
    repeated rows stay once.  Null counts as empty text, a null doc_id orders last, an empty table gives an empty
    result.  Columns may have any names: rows travel as one struct.
    """
    classes = saved(exact_classes(docs), "classes")
    same = ["id", "no_id", "text_sha256"]
    keys = classes.select("kept", "group_size", *row_key(), "text_sha256")
    dropped = saved(keys.where("not kept").select(*same).distinct(), "dropped")
    repeated = saved(keys.where("kept and group_size > 1").groupBy(*same).count().where("count > 1").drop("count"), "repeated")
    sha = F.sha2(normalised(content()).cast("binary"), 256).alias("text_sha256")
    return without(docs.select(F.struct("*").alias("row"), content().alias("content"), *row_key(), sha), same, dropped, repeated)
