"""Ranked lexical search with sequential reads only (NRA) over impact-sorted lists.

A document's score for an item is the sum, over the item's terms, of the term's weight times the
document's impact for it. Documents are searched in blocks that tasks take from their
partitions. In a block every term of the items has a list of its documents, highest impact first:

1. The lists of an item are read from the top, in rounds of twice the depth of the last. What was
   read of a document is the lower end of its score's interval; the upper end adds, for each list
   in which it was not met, the contribution last read there.
2. The k-th best lower end, of this block or carried over from the blocks before, is what a
   document must reach. Reading goes on until the lists' last contributions together stay below
   it, so that no document unread can enter, and until every document whose upper end reaches
   it has an interval of one point: then members, ties and scores are settled.
3. The block's settled documents join the item's best k so far, whose worst score makes later
   blocks stop earlier. Each task gives up k documents for an item; two ranked windows over
   the tasks' documents, the first salted, leave the k best of all.

Document frequencies and the sums of lengths are grouped sums over all documents beforehand. The
items are the stated query set: they are dealt by hash to sets of about PAIRS_A_SET pairs of
item and term, and each set, which tasks hold in memory, meets all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailmart.llm.common import small_table, stored
from retailmart.llm.words import ALNUM, Words, words_of

PAIRS_A_SET = 100_000
POSTINGS_A_BLOCK = 1 << 20
FIRST_DEPTH = 64
SALTS = 1024

# Fixed values of the score: impacts are (SCALE * tf) div (1000 * tf + 8 * m), with
# m = 100 - SLOPE + (SLOPE * n * N) div L.
SCALE, SLOPE = 1_000_000_000, 90


@dataclass(frozen=True)
class Items:
    """Items 0 to len(cuts) - 2; item i has the vocabulary's terms term[cuts[i]:cuts[i + 1]]."""

    vocabulary: np.ndarray  # sorted term hashes
    cuts: np.ndarray
    term: np.ndarray


@dataclass(frozen=True)
class Statistics:
    documents: int  # with a term
    terms: int  # with repeats
    weight: np.ndarray  # of each term of the vocabulary

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        length, at = np.unique(n, return_inverse=True)  # n * N may pass 64 bits: exact in Python
        m = np.array([100 - SLOPE + SLOPE * int(x) * self.documents // self.terms for x in length], np.int64)
        return (SCALE * tf) // (1000 * tf + 8 * m[at])


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _terms(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in words_of(batch.column(1), lower=True, solid_bytes=ALNUM):
            items = batch.column(0).take(pa.array(chunk.first + chunk.row))
            yield pa.RecordBatch.from_arrays([items, pa.array(chunk.hash.view(np.int64))], ["item", "term"])


def _postings(chunk: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the chunk, term of the vocabulary, occurrences)."""
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, chunk.hash), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[at] == chunk.hash)
    both, tf = np.unique(chunk.row[known] * len(vocabulary) + at[known], return_counts=True)
    return both // len(vocabulary), both % len(vocabulary), tf.astype(np.int64)


def _frequencies(batches, vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, sum): documents of each term; as term -1 those with any, as -2 all terms' occurrences."""
    df, documents, terms = np.zeros(len(vocabulary), np.int64), 0, 0
    for batch in batches:
        for chunk in words_of(batch.column(0), lower=True, solid_bytes=ALNUM):
            documents += len(np.unique(chunk.row))
            terms += len(chunk.row)
            df += np.bincount(_postings(chunk, vocabulary)[1], minlength=len(df))
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, -2, *seen.tolist()], pa.int64()), pa.array([documents, terms, *df[seen].tolist()], pa.int64())],
        ["term", "sum"],
    )


class Block:
    """Impact-sorted lists of some documents."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, vocabulary: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.cuts = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.documents = documents

    def lists(self, terms: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, contributions) for the terms that occur and count."""
        spans = [(self.cuts[t], self.cuts[t + 1], weight[t]) for t in terms.tolist()]
        return [(self.doc[a:b], w * self.impact[a:b]) for a, b, w in spans if b > a and w > 0]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, entries read): all documents of 0 to ``documents`` - 1 that can be among
    the best k, given that k scores of ``least`` are known, ties included; their scores are exact."""
    low = np.zeros(documents, np.int64)
    read = [0] * len(lists)
    depth = FIRST_DEPTH
    while True:
        last = np.zeros(len(lists), np.int64)
        for t, (doc, add) in enumerate(lists):
            to = min(depth, len(doc))
            low[doc[read[t] : to]] += add[read[t] : to]
            read[t] = to
            last[t] = add[to - 1] if to < len(doc) else 0
        enter = max(least, int(np.partition(low, documents - k)[documents - k]) if documents >= k else 0, 1)
        rest = int(last.sum())
        if rest < enter:
            room = np.full(documents, rest)
            for t, (doc, _) in enumerate(lists):
                if last[t]:
                    room[doc[: read[t]]] -= last[t]
            able = np.flatnonzero((low > 0) & (low + room >= enter))
            if not room[able].any():
                return able, low[able], sum(read)
        depth *= 2


class Best:
    """The best k documents so far of every item: highest score, then lowest id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def least(self, item: int) -> int:
        rows = self.rows[item]
        return -rows[-1][0] if len(rows) == self.k else 0

    def add(self, item: int, scores: np.ndarray, ids: list[int | None]) -> None:
        own = [(-s, i is None, 0 if i is None else i) for s, i in zip(scores.tolist(), ids, strict=True)]
        self.rows[item] = sorted(self.rows[item] + own)[: self.k]


def _search(batches, items: Items, statistics: Statistics, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(items.cuts) - 1, k)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids: list[int | None] = []

    def settle() -> None:
        if not ids:
            return
        doc, term, impact = (np.concatenate(parts) for parts in zip(*held, strict=True))
        block = Block(doc, term, impact, len(ids), len(items.vocabulary))
        for i in range(len(items.cuts) - 1):
            lists = block.lists(items.term[items.cuts[i] : items.cuts[i + 1]], statistics.weight)
            if lists:
                able, scores, _ = nra(lists, block.documents, k, best.least(i))
                best.add(i, scores, [ids[d] for d in able])
        held.clear()
        ids.clear()

    for batch in batches:
        for chunk in words_of(batch.column(1), lower=True, solid_bytes=ALNUM):
            row, term, tf = _postings(chunk, items.vocabulary)
            words = np.diff(chunk.bounds())
            some = np.unique(row)  # documents without a term of the items don't count as one of the block
            held.append((np.searchsorted(some, row) + len(ids), term, statistics.impact(tf, words[row])))
            ids.extend(batch.column(0).take(pa.array(chunk.first + some)).to_pylist())
            if sum(len(h[0]) for h in held) >= POSTINGS_A_BLOCK:
                settle()
    settle()
    rows = [(i, None if null else doc, -score) for i, own in enumerate(best.rows) for score, null, doc in own]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
        ["place", "id", "score"],
    )


def _search_set(plain: DataFrame, pairs: list, k: int, kind: str) -> DataFrame:
    """The best documents of one set of items: (item, rank, id, score)."""
    spark = plain.sparkSession
    names = sorted({p["item"] for p in pairs}, key=lambda n: (n is None, n))
    place = {name: i for i, name in enumerate(names)}
    vocabulary = np.unique(np.array([p["term"] for p in pairs], np.int64).view(np.uint64))
    item = np.array([place[p["item"]] for p in pairs], np.int64)
    term = np.searchsorted(vocabulary, np.array([p["term"] for p in pairs], np.int64).view(np.uint64))
    order = np.argsort(item, kind="stable")
    items = Items(vocabulary, np.searchsorted(item[order], np.arange(len(names) + 1)), term[order])

    sums = plain.select("text").mapInArrow(partial(_frequencies, vocabulary=vocabulary), "term bigint, sum bigint")
    sums = {r["term"]: r["sum"] for r in sums.groupBy("term").agg(F.sum("sum").alias("sum")).collect()}
    documents = sums.get(-1, 0)
    weight = np.array([term_weight(documents, sums.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    statistics = Statistics(documents, sums.get(-2, 0), weight)

    found = plain.mapInArrow(partial(_search, items=items, statistics=statistics, k=k), "place bigint, id bigint, score bigint")
    found = found.withColumn("__salt", F.spark_partition_id() % SALTS)
    order_by = [F.desc("score"), F.asc_nulls_last("id")]
    salted = Window.partitionBy("place", "__salt").orderBy(*order_by)
    found = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k).drop("rank", "__salt")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order_by)))
    named = small_table(spark, [(i, name) for i, name in enumerate(names)], f"__place bigint, item {kind}")
    ranked = ranked.where(F.col("rank") <= k)
    return ranked.join(named, F.col("place") == F.col("__place")).select("item", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """(item column, rank, id column, score): the k documents with the highest score above 0 of each
    item, from rank 1; fewer if there are fewer; equal scores by ascending id, a null id last.

    Terms are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. Of N
    documents with a term, df of them with this one, a term weighs w = floor(1000 * ln((2 * N + 2) /
    (2 * df + 1))). A document with n of all L terms has m = 100 - 90 + (90 * n * N) div L, and
    scores the sum of w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the item's distinct terms.

    A null text has no terms. Rows of docs count as documents of their own, also if they are equal,
    so that one id may take several ranks; ids are whole numbers. Rows of items with the same id
    are one item with the terms of all. An item without terms, or whose terms no document holds,
    has no rows. Other columns are not read; empty tables give no rows. Terms are known by 64-bit
    hashes.
    """
    plain = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    named = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    kind = named.schema["item"].dataType.simpleString()
    pairs = stored(named.mapInArrow(_terms, f"item {kind}, term bigint").distinct(), "item_terms")
    sets = max(1, -(-pairs.count() // PAIRS_A_SET))
    part = F.pmod(F.xxhash64("item"), F.lit(sets))
    results = []
    for n in range(sets):
        own = pairs.where(part == n).collect()
        if own:
            found = _search_set(plain, own, k, kind)
            results.append(found if sets == 1 else stored(found, "ranked"))
    if not results:
        return plain.limit(0).select(F.lit(None).cast(kind).alias(item), F.lit(0).alias("rank"), F.col("id").alias(id), F.lit(0).cast("bigint").alias("score"))
    return reduce(DataFrame.union, results).select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM docs WHERE len(w) > 0),
tfs AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, corpus),
parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS part
  FROM tfs JOIN weights USING (term), corpus),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM item_terms JOIN parts USING (term) GROUP BY item_id, r, doc_id HAVING sum(part) > 0),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scores)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
