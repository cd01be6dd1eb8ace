"""Operator 1, token counts: a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import content, for_python
from roadlens.llm.encoder import encoder, tokenizer_version
from roadlens.session import path_exists, saved


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        for batch in batches:
            counts = [len(ids(t.decode("utf-8", "replace"))) for t in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def stored_counts(docs: DataFrame, cache_path: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version in the cache: (digest, n_tokens), one row a digest."""
    spark = docs.sparkSession
    if not path_exists(spark, cache_path):
        return None
    table = spark.read.schema("tokenizer string, digest binary, n_tokens long").parquet(cache_path)
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _cached(digests: DataFrame, known: DataFrame | None) -> DataFrame | None:
    """The cache's counts of these digests, as a saved table: the rest of the cache goes no further than the scan."""
    return None if known is None else saved(known.join(digests, "digest", "left_semi"), "cached")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """Token count of each whole text.

    Normalised content is the text itself with null as empty (any other change would change counts); its
    SHA-256 and the tokenizer's version digest are the key of the cache, a Parquet table at ``cache_path``.
    Texts whose digest the cache lacks are reduced to one row a digest before the shuffle, encoded, and
    appended; then all documents meet the counts of their own digests.  Encoders run in the executors.

    Returns doc_id, n_bytes, n_tokens, over_limit, digest: one row for each input row, repeated rows and null
    doc_ids included.  A null text counts as empty; an empty text has 0 tokens; an empty table gives an empty
    result.  Only doc_id and text are read, other columns may have any names.
    """
    keyed = for_python(docs).select("doc_id", content().alias("content"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    version = tokenizer_version(tokenizer_path)
    missed = keyed.select("digest", F.col("content").cast("binary").alias("content"))
    cached = _cached(keyed.select("digest").distinct(), stored_counts(docs, cache_path, version))
    if cached is not None:
        missed = missed.join(cached, "digest", "left_anti")
    missed = missed.dropDuplicates(["digest"])
    fresh = saved(missed.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long"), "counts")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    # Saved tables, one row a digest: the join can split a hot digest.
    counts = fresh if cached is None else fresh.unionByName(cached)
    return keyed.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes")).join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest")
    )
