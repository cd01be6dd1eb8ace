"""Operator 4, MinHash near-dedup: tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import components, content, for_python, row_key, without
from roadlens.llm.textarrays import Words, as_bytes, mix, slices
from roadlens.session import discard, saved

#: Collections on each side.  A table is a pair of collections, so 144 tables come from 24 collections.  A
#: collection has as many minhashes as keep the chance that all tables miss a pair at the threshold below
#: MISS: three from 0.85 on (2.2e-5), two from 0.78 on (0.80: 9.5e-6), else one.
COLLECTIONS, MISS = 12, 3e-5
#: Centres that a candidate is held against before the rest is compared in groups, and sets in a block of a group.
CENTRES, BLOCK = 3, 200
#: Owner of the blocks of a group that hold sets of small components.
MIXED = -1
#: Nodes whose table keys one task makes.
NODES_A_TASK = 20_000
SEED = 20_240_501


def hashes_for(percent: int) -> int:
    """Minhashes in a collection."""
    return next((k for k in (3, 2) if 2 * (1 - (percent / 100) ** k) ** COLLECTIONS <= MISS), 1)


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a slice, sorted within each text, and the bounds of each text."""
    hashes = words.hashes()
    grams, at = words.grams(hashes, size)
    row = words.row[at]
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = []
        for r in short.tolist():
            code = np.uint64(int(counts[r]))
            for h in hashes[words.bounds[r] : words.bounds[r + 1]]:
                code = mix((np.array([code]) ^ h) * np.uint64(0x9E3779B97F4A7C15))[0]
            whole.append(code)
        grams, row = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(words.n_rows + 1))


def _signatures(size: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        n = 2 * COLLECTIONS * hashes
        odd = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 63, n, np.uint64)
        for batch in batches:
            ids, versions, texts = batch.column("doc_id"), batch.column("version"), as_bytes(batch.column("content"))
            for first, last in slices(texts):
                grams, bounds = _shingles(Words(texts, first, last, lower=True), size)
                counts = np.diff(bounds)
                some = np.flatnonzero(counts)
                sides = np.zeros((last - first, 2 * COLLECTIONS), np.uint64)
                d1, d2 = np.zeros(last - first, np.uint64), np.zeros(last - first, np.uint64)
                if len(some):
                    starts = bounds[:-1][some]
                    d1[some] = np.add.reduceat(mix(grams), starts)
                    d2[some] = np.bitwise_xor.reduceat(mix(grams + np.uint64(SEED)), starts)
                    for c in range(2 * COLLECTIONS):
                        code = np.zeros(len(some), np.uint64)
                        for k in range(c * hashes, (c + 1) * hashes):
                            spread = grams * odd[k] + plus[k]
                            spread ^= spread >> np.uint64(32)
                            spread *= odd[k]
                            code = mix(code ^ np.minimum.reduceat(spread, starts))
                        sides[some, c] = code
                half = COLLECTIONS * (last - first)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(0, half + 1, COLLECTIONS), pa.int32()), pa.array(part.ravel().view(np.int64)))
                    for part in (np.ascontiguousarray(sides[:, :COLLECTIONS]), np.ascontiguousarray(sides[:, COLLECTIONS:]))
                ]
                arrays = [ids.slice(first, last - first), versions.slice(first, last - first), pa.array(counts.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "version", "n_shingles", "d1", "d2", "left", "right"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                out.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return run


def _linked_in_blocks(percent: int):
    """Components that links of one pair of blocks connect: a spanning forest of those not connected yet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        sets = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        sizes = np.array([len(s) for s in sets])
        codes, where = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(where) > 1  # others are in one set only
        column = np.cumsum(often) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(often.sum()), 4096):
            inside = often[where] & (column[where] >= first) & (column[where] < first + 4096)
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[inside], column[where[inside]] - first] = 1
            shared += part @ part.T
        both = np.rint(shared).astype(np.int64)
        links = np.argwhere(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
        parent = {c: c for c in pdf["component"]}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out, comps = [], pdf["component"].tolist()
        for i, j in links.tolist():
            a, b = root(comps[i]), root(comps[j])
            if a != b:
                parent[a] = b
                out.append((comps[i], comps[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, the version of its text (rows may share a doc_id), and the text."""
    return for_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(content()).alias("version"), content().cast("binary").alias("content"))


def _members(nodes: DataFrame) -> DataFrame:
    """Table keys that two or more sets share: (key, node)."""
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // NODES_A_TASK)
    tables = F.flatten(F.transform("left", lambda a, i: F.transform("right", lambda b, j: F.xxhash64(a, b, i * COLLECTIONS + j))))
    keys = nodes.select("node", "left", "right").repartition(tasks, "node").select("node", F.explode(tables).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    return saved(keys.join(shared, "key"), "members")


def _classes(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """doc_id, version, n_shingles and component (a node, null for empty sets) of each row: a saved table."""
    signed = _texts(docs).mapInArrow(_signatures(size, hashes_for(percent)), "doc_id long, version long, n_shingles long, d1 long, d2 long, left array<long>, right array<long>")
    signed = saved(signed, "signatures")
    owner = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version", "left", "right")
    node_sets = signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(owner).alias("one"))
    nodes = saved(node_sets.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n_shingles", "one.doc_id", "one.version", "one.left", "one.right"), "nodes")
    members = _members(nodes)
    sets = _sets_of(docs, nodes, members, size)
    labels = _linked(nodes, members, sets, percent)
    discard(sets, members)
    rows = saved(signed.select("doc_id", "version", "n_shingles", "d1", "d2").join(labels, ["d1", "d2", "n_shingles"], "left").drop("d1", "d2"), "classes")
    discard(signed, nodes, labels)
    return rows


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """Components of documents linked by 100 * |A and B| >= percent * |A or B| over their word shingles.

    Equal sets are one node.  A node's table keys are all pairs of a left and a right collection of minhashes.
    Nodes that share a key are candidates.  First a node is held against CENTRES centres of its tables (the
    smallest nodes by as many hashes), and confirmed links join components; tables within one component are done.
    The other tables are gathered by the largest component that each holds, the members of a component of more
    than BLOCK sets in blocks of its own, all others in blocks together, and every pair of blocks is compared whole
    but those of one component.  So no pair that shares a key goes unexamined unless its ends are connected already,
    and a dense cluster of n sets of which m are not linked to its largest component costs n times m comparisons.
    Sets are compared in full.

    Returns doc_id, n_shingles, component_id, kept, one row for each input row, in whatever number it occurs.
    Null texts are empty; texts without words are empty sets, linked with nothing.  A null doc_id is larger than
    any other: it never names a component that has another member.  Rows that share a doc_id are rows of their
    own with the same component_id if linked.  An empty table gives an empty result.  Only doc_id and text are
    read, other columns may have any names.
    """
    rows = _classes(docs, percent, size)
    names = saved(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(names, "component", "left").select("doc_id", "n_shingles", component_id.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets_of(docs: DataFrame, nodes: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """The full sets of the candidates, each from a document that has it: (node, grams)."""
    same = ["id", "no_id", "version"]
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "d1", *row_key(), "version")
    wanted = saved(wanted, "wanted")
    # Merged at every size: a broadcast of small tables would only hide what large ones shuffle.
    rows = _texts(docs).select("content", *row_key(), "version").join(wanted.hint("merge"), same)
    made = rows.select("node", "content", "d1").mapInArrow(_checked_sets(size), "node long, grams binary")
    sets = saved(made.groupBy("node").agg(F.min("grams").alias("grams")), "sets")
    discard(wanted)
    return sets


def _checked_sets(size: int):
    """Sets of the texts; only a text with the node's own set counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column("node").to_pylist(), as_bytes(batch.column("content"))
            d1 = batch.column("d1").to_numpy(zero_copy_only=False).view(np.uint64)
            for first, last in slices(texts):
                grams, bounds = _shingles(Words(texts, first, last, lower=True), size)
                keep, sets = [], []
                for k in range(last - first):
                    own = grams[bounds[k] : bounds[k + 1]]
                    if np.add.reduce(mix(own)) == d1[first + k] and len(own):
                        keep.append(nodes[first + k])
                        sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())], ["node", "grams"])

    return run


def _centre_pairs(members: DataFrame) -> DataFrame:
    """Each node with centres of its tables: (a, b), at most CENTRES rows a node."""
    by = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("centre"))).alias(f"c{k}") for k in range(CENTRES)]
    centres = saved(members.groupBy("key").agg(*by), "centres")  # plain, so that the join can split a table of very many nodes
    nearest = [F.min(F.when(F.col(f"c{k}.centre") != F.col("node"), F.col(f"c{k}")))["centre"] for k in range(CENTRES)]
    of_node = members.join(centres, "key").groupBy("node").agg(F.array_distinct(F.array_compact(F.array(*nearest))).alias("others"))
    return of_node.select(F.col("node").alias("a"), F.explode("others").alias("b"))


def _linked(nodes: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The component of every node: (d1, d2, n_shingles, component), a saved table."""
    pairs = _centre_pairs(members)
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b"
    )
    links = saved(full.select("a", "b", "left", "right").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    comp = saved(components(links), "components")
    labelled = lambda rows: rows.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = labelled(members)
    mixed = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    active = saved(rows.join(mixed, "key", "left_semi"), "active")
    labels = labelled(nodes.select("node", "d1", "d2", "n_shingles"))
    if not active.isEmpty():
        found = saved(_in_groups(active, sets, percent), "found")
        if not found.isEmpty():
            joined = saved(components(found).select(F.col("node").alias("component"), F.col("component").alias("joined")), "joined")
            labels = labels.join(joined, "component", "left").withColumn("component", F.coalesce("joined", "component"))
    labels = saved(labels.select("d1", "d2", "n_shingles", "component"), "labels")  # plain, so that the join can split a set that very many rows have
    discard(links, comp, active)
    return labels


def _in_groups(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (a, b) that links connect among the candidates of tables with more than one component."""
    sizes = saved(active.select("node", "component").distinct().groupBy("component").agg(F.count("*").alias("size")), "sizes")
    largest = active.join(sizes, "component").groupBy("key").agg(F.max(F.struct("size", "component"))["component"].alias("home"))
    groups = saved(active.join(saved(largest, "homes"), "key").select("home", "node", "component").distinct(), "groups")
    counts = groups.groupBy("home", "component").agg(F.count("*").alias("n"))
    owned = counts.select("home", F.when(F.col("n") > BLOCK, F.col("component")).otherwise(MIXED).alias("owner"), "n")
    owned = owned.groupBy("home", "owner").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"))
    layout = saved(owned.groupBy("home").agg(F.collect_list(F.struct("owner", "blocks")).alias("layout")), "layout")
    rows = groups.join(layout, "home").withColumn("own", F.filter("layout", lambda x: x["owner"] == F.col("component")))
    rows = rows.withColumn("own", F.coalesce(F.get("own", F.lit(0)), F.get(F.filter("layout", lambda x: x["owner"] == MIXED), F.lit(0))))
    place = F.array(F.col("own.owner"), F.pmod(F.xxhash64("node"), F.col("own.blocks")))
    others = F.filter("layout", lambda x: (x["owner"] == MIXED) | (x["owner"] != F.col("component")))
    each = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda k: F.array(x["owner"], k))))
    rows = rows.select("home", "node", "component", place.alias("place"), each.alias("others")).join(sets, "node")
    rows = rows.withColumn("other", F.explode("others")).select(
        "home", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), "node", "component", "grams"
    )
    return rows.groupBy("home", "i", "j").applyInPandas(_linked_in_blocks(percent), "a long, b long")


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates, with all their columns: of each component one row stays.

    Five-word shingles and a similarity of 0.8, unless told otherwise.  The row with the smallest doc_id stays (a
    null one orders last); of rows that share it, one text and one row stay, the same in every run.  Rows without
    words (null, empty or blank texts) have no duplicates here and all stay.  An empty table gives an empty
    result.  Columns may have any names: rows travel as one struct.
    """
    same = ["id", "no_id", "version"]
    rows = _classes(docs, percent, size).where("component is not null")
    first = saved(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")).alias("stays")), "first")
    keys = rows.join(first, "component").select(*row_key(), "version", F.col("stays.doc_id").eqNullSafe(F.col("doc_id")).alias("own"), (F.col("stays.version") == F.col("version")).alias("as_is"))
    dropped = saved(keys.where("not (own and as_is)").select(*same).distinct(), "dropped")
    repeated = saved(keys.where("own and as_is").groupBy(*same).count().where("count > 1").drop("count"), "repeated")
    return without(docs.select(F.struct("*").alias("row"), content().alias("content"), *row_key(), F.xxhash64(content()).alias("version")), same, dropped, repeated)
