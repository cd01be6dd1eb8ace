"""Operator 13, spelling variant grouping: a self-join of the vocabulary's trie with active-node sets.

Two words at distance one share all code points before and after one place.  So the trie is cut into parts: a part
holds the words that agree before some place and after another, and finds the pairs whose first difference lies
between the two.  A word goes to the part of its first half and to that of its second half; a part of too many code
points is cut at the middle of its range, again and again, down to a range of one code point, where a part can
hold no more words than there are letters.  No pair is found twice, none is lost, and no part is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.llm.common import content, for_python
from roadlens.session import discard, saved

#: Runs of letters, what a variant is drawn by, and which words count.
RUN = r"[A-Za-zÀ-ÿ]+"
ONE_IN, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Code points of the differing ranges of a part's words that one task's trie holds.
PART = 400_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def planted(doc_id: Column, run: Column) -> Column:
    """The run, with one code point deleted where a hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % ONE_IN == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of letters of whole texts, A-Z lower-cased, with planted deletions.

    Runs are counted in their own tasks first, so a frequent word reaches its counter once a task.
    """
    small = F.translate(content(), CAPITALS, SMALL)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(small, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(planted(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """Each word in the parts of both halves: as the shorter or an equally long word (base l = length) and as the longer (l = length - 1)."""
    base = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("base")
    rows = words.select("word", base)
    middle = F.floor(F.col("base") / 2).cast("int")
    both = F.array(
        F.struct(F.lit(0).alias("low"), middle.alias("high")), F.struct(middle.alias("low"), (F.col("base") + 1).alias("high"))
    )  # places 0 to base: a code point more may stand behind the last
    return rows.select("word", "base", F.inline(both))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (word, base, low, high) with what a part's words share, ``head`` and ``tail``, and the range between, ``inner``."""
    behind = F.greatest(F.col("base") - F.col("high"), F.lit(0))
    length = F.length("word")
    return rows.select(
        "word", "base", "low", "high",
        F.substring("word", F.lit(1), F.col("low")).alias("head"), F.substr(F.col("word"), length - behind + 1).alias("tail"),
        F.substring(F.col("word"), F.col("low") + 1, length - behind - F.col("low")).alias("inner"),
    )


KEY = ["base", "low", "high", "head", "tail"]


def neighbours(inners: list[str], places: int, shorter: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of different texts at distance one whose first difference is before ``places``, the
    shorter one of ``shorter`` letters.

    The trie of the texts is walked from its root with each node's active nodes: those whose path is at distance
    one.  A node's active nodes are its parent's, each followed by the same letter, and as new ones its siblings,
    its children and its parent.
    """
    children: list[dict[str, int]] = [{}]
    parent, ends = [0], [-1]
    for i, text in enumerate(inners):
        node = 0
        for c in text:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                parent.append(node)
                ends.append(-1)
            node = children[node][c]
        ends[node] = i
    # Paths that differ at a place stay so: from depth ``places`` on no new differences count.
    stack = [(0, 0, [*children[0].values()] if places > 0 else [])]
    while stack:
        node, depth, active = stack.pop()
        i = ends[node]
        if i >= 0:
            for other in active:
                j = ends[other]
                # A letter put into a run of the same letter is reached at each of the run's places: the last one counts.
                if i < j and min(len(inners[i]), len(inners[j])) == shorter and inners[i][:places] != inners[j][:places]:
                    yield i, j
        for c, below in children[node].items():
            found = {children[a][c] for a in active if c in children[a]}
            if depth < places:  # the place of the letter below
                found.update(n for n in children[node].values() if n != below)
                found.add(node)
            if depth + 1 < places:
                found.update(children[below].values())
            stack.append((below, depth + 1, list(found)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each part, whose rows follow one another."""
    part, words, inners = None, [], []

    def found() -> Iterator[pa.RecordBatch]:
        if len(words) > 1:
            base, low, high, head, tail = part
            pairs = [(words[i], words[j]) for i, j in neighbours(inners, high - low, base - len(head) - len(tail))]
            for k in range(0, len(pairs), 10_000):
                a, b = zip(*pairs[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "word", "inner")]
        for *key, word, inner in zip(*columns, strict=True):
            if key != part:
                yield from found()
                part, words, inners = key, [], []
            words.append(word)
            inners.append(inner)
    yield from found()


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """Pairs (a, b) of the distinct ``word`` that differ by one inserted, deleted or replaced code point, each pair once.

    Parts of one word are dropped; those of more than ``part`` code points between head and tail are halved.
    """
    spark, saves = words.sparkSession, []
    rows, pairs = saved(_halves(words), "parts"), None
    saves.append(rows)
    while True:
        placed = _placed(rows)
        sizes = placed.groupBy(*KEY).agg(F.count("*").alias("m"), F.sum(F.length("inner")).alias("points")).where("m > 1")
        large = (F.col("points") > part) & (F.col("high") - F.col("low") > 1)
        sizes = saved(sizes.select(*KEY, large.alias("large")), "sizes")
        small = placed.join(sizes.where("not large"), KEY, "left_semi")
        dealt = small.repartition(*KEY).sortWithinPartitions(*KEY, "word")
        found = saved(dealt.mapInArrow(_pairs, "a string, b string"), "near")
        pairs = found if pairs is None else pairs.unionByName(found)
        if sizes.where("large").isEmpty():
            break
        cut = placed.join(sizes.where("large"), KEY, "left_semi")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        both = F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct(middle.alias("l"), F.col("high").alias("h")))
        rows = saved(cut.select("word", "base", F.inline(both)).withColumnsRenamed({"l": "low", "h": "high"}), "parts")
        saves += [sizes, rows]
    discard(*saves, sizes)
    return pairs


def variant_groups(docs: DataFrame, part: int = PART) -> DataFrame:
    """Words of a corpus with the more frequent spelling that each is a variant of.

    Returns (word, form, root, n, n_near, form_n), one row a distinct word of at least six code points that occurs
    five times or more: n is its count, n_near how many such words are at distance one, form the one of them with
    the largest n (ties: the smallest in code-point order) if that n is at least five times the word's, else null, form_n
    its n, and root where the forms lead to in the end, the word itself if it has none.  A form is always more
    frequent than its word, so forms have no cycles and a chain has at most log5 of the largest count links.

    A null text has no words and a null doc_id plants as the empty string; repeated rows count as often as they
    occur; an empty table, or one without such words, gives an empty result.  Words may be of any length.  Only
    doc_id and text are read, other columns may have any names.
    """
    words = saved(vocabulary(for_python(docs).select("doc_id", "text")), "words")
    pairs = near_words(words.select("word"), part)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = counted.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    has = -F.col("best.less") >= RATIO * F.col("n")
    rows = saved(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.b")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    return rows.join(_roots(rows.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): each link is replaced by its target's link until no target has one; chains halve every round."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = saved(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after.drop("moved")
        now._saved_at = after._saved_at
        if after.where("moved").isEmpty():
            return now
