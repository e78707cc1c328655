"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

1. Every item is cut into its windows of ``window`` consecutive words (an item of fewer words is
   one); equal windows are one *unit*. A unit is the set of its shingles, each with its place.
2. Shingles are ordered by rarity, which is the number of documents that hold them. A unit that
   must have ``need`` of its m shingles in place in a document meets it in at least one of its
   ``m - need + 1`` rarest ones, so only these, its prefix, are joined.
3. A document's shingle at word q that is the shingle at place p of a unit leaves one window for
   the unit: the item-sized one that begins at q - p. Windows that begin before the text or end
   behind it go, by the lengths and places alone.
4. The window's words are compared with the unit's: the shingles at the same places are counted.

Documents are read twice: to count the documents of the items' shingles, and to find prefix
shingles. Both times a bitmap of fixed size lets through the shingles asked for and a few others,
which the joins by whole hash drop; a larger benchmark fills the bitmap and lets through more,
but never loses one. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailmart.llm.common import stored
from retailmart.llm.words import ALNUM, Words, text_buffers, windows, words_of

FILTER_BITS = 24  # slots of the bitmap, as a power of two: at most 2 MB wherever it is sent
HITS_A_BATCH = 50_000
BROADCAST_UNITS = 50_000  # at most so many short rows are broadcast; more are joined by salted hash
SALTS = 16


def _flat_ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of the ranges first[i] to last[i] - 1, one behind the other."""
    offsets = np.concatenate(([0], np.cumsum(last - first)))
    return offsets, np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], last - first)


def _long_lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _item_units(batches, window: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(item, words) of every window of every item that has words."""
    for batch in batches:
        for chunk in words_of(batch.column(1), lower=True, solid_bytes=ALNUM):
            bounds = chunk.bounds()
            counts = np.diff(bounds)
            row = np.repeat(np.arange(chunk.rows), np.where(counts > window, counts - window + 1, np.minimum(counts, 1)))
            if not len(row):
                continue
            inside = np.arange(len(row)) - np.searchsorted(row, row)
            first = bounds[row] + inside
            for i in range(0, len(row), rows):
                own = slice(i, i + rows)
                offsets, at = _flat_ranges(first[own], np.minimum(first[own] + window, bounds[row[own] + 1]))
                items = batch.column(0).take(pa.array(chunk.first + row[own]))
                yield pa.RecordBatch.from_arrays([items, _long_lists(offsets, chunk.hash[at])], ["item", "words"])


def _unit_shingles(batches, shingle: int) -> Iterator[pa.RecordBatch]:
    """(unit, grams): the hashes of a unit's shingles in their places."""
    for batch in batches:
        grams = []
        for words in batch.column(1).to_pylist():
            value = np.array(words, np.int64).view(np.uint64)
            grams.append(windows(value, min(shingle, len(value))).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["unit", "grams"])


def units_of(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """items: item, text. ((item, unit), (unit, words, grams)), each pair and unit once."""
    kind = items.schema["item"].dataType.simpleString()
    cut = items.select("item", "text").mapInArrow(partial(_item_units, window=window, rows=HITS_A_BATCH), f"item {kind}, words array<bigint>")
    cut = stored(cut.withColumn("unit", F.md5(F.concat_ws(",", "words"))), "item_units")
    units = cut.groupBy("unit").agg(F.first("words").alias("words"))
    grams = units.mapInArrow(partial(_unit_shingles, shingle=shingle), "unit string, grams array<bigint>")
    units = units.join(grams.withColumnRenamed("unit", "__unit"), F.col("unit") == F.col("__unit")).drop("__unit")
    return cut.select("item", "unit").distinct(), stored(units, "units")


class Bitmap:
    """Which slots of the hashes modulo 2^FILTER_BITS are wanted."""

    def __init__(self, grams: DataFrame):
        slot = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        bit = F.expr(f"shiftleft(1L, cast((gram & {(1 << FILTER_BITS) - 1}) % 64 as int))")
        rows = grams.groupBy((F.floor(slot / 64)).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
        self.slots = 1 << FILTER_BITS
        self.at = np.array([r["at"] for r in rows], np.int64)
        self.bits = np.array([r["bits"] for r in rows], np.int64)

    def table(self) -> np.ndarray:
        full = np.zeros(self.slots // 64, np.int64)
        full[self.at] = self.bits
        return np.unpackbits(full.view(np.uint8), bitorder="little").view(bool)


def _wanted(chunk: Words, sizes: Sequence[int], table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shingle size, first word, hash) of a chunk's shingles that the bitmap lets through."""
    for k in sizes:
        gram = windows(chunk.hash, k)
        if len(gram):
            inside = chunk.row[: len(gram)] == chunk.row[k - 1 :]
            at = np.flatnonzero(inside & table[(gram & np.uint64(len(table) - 1)).astype(np.int64)])
            yield k, at, gram[at]


def _count(batches, sizes: Sequence[int], bitmap: Bitmap) -> Iterator[pa.RecordBatch]:
    table = bitmap.table()
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for chunk in words_of(batch.column(0), lower=True, solid_bytes=ALNUM):
            for _, at, gram in _wanted(chunk, sizes, table):
                order = np.lexsort((gram, chunk.row[at]))
                row, gram = chunk.row[at][order], gram[order]
                fresh = np.ones(len(gram), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                found.append(gram[fresh])
        gram, count = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))], ["gram", "df"])


_SCAN = "k1 bigint, k2 bigint, n_words bigint, q bigint, gram bigint, before bigint, around array<bigint>"


def _scan(batches, sizes: Sequence[int], bitmap: Bitmap, window: int, rows: int) -> Iterator[pa.RecordBatch]:
    """One row for each document, with its words (q null), and one for each prefix shingle in it:
    the words around word q that a unit holding the shingle could cover, from word ``before`` on."""
    table = bitmap.table()
    names = [part.split()[0] for part in _SCAN.split(", ")]
    for batch in batches:
        ids = [batch.schema.get_field_index(c) for c in ("id", "k1", "k2")]
        identity = [batch.column(i) for i in ids]
        for chunk in words_of(batch.column(batch.schema.get_field_index("text")), lower=True, solid_bytes=ALNUM):
            bounds = chunk.bounds()
            own = [c.slice(chunk.first, chunk.rows) for c in identity]
            none = pa.nulls(chunk.rows, pa.int64())
            counts = pa.array(np.diff(bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*own, counts, none, none, none, pa.nulls(chunk.rows, pa.list_(pa.int64()))], ["id", *names]
            )
            for k, at, gram in _wanted(chunk, sizes, table):
                for i in range(0, len(at), rows):
                    word, hashes = at[i : i + rows], gram[i : i + rows]
                    row = chunk.row[word]
                    first = np.maximum(bounds[row], word - (window - k))
                    offsets, near = _flat_ranges(first, np.minimum(bounds[row + 1], word + window))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[c.take(pa.array(row)) for c in own],
                            counts.take(pa.array(row)),
                            pa.array(word - bounds[row]),
                            pa.array(hashes.view(np.int64)),
                            pa.array(first - bounds[row]),
                            _long_lists(offsets, chunk.hash[near]),
                        ],
                        ["id", *names],
                    )


def _in_place(words: Column, unit: Column, shingle: int) -> Column:
    """How many of a unit's shingles stand at the same places among words, as many as the unit's."""
    same = F.zip_with(words, unit, lambda a, b: a == b)
    size = F.least(F.lit(shingle), F.size(unit))
    places = F.sequence(F.lit(1), F.size(unit) - size + 1)
    return F.size(F.filter(places, lambda j: F.forall(F.slice(same, j, size), lambda x: x)))


def find_items(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, percent: int = 100,
    id: str = "doc_id", text: str = "text", item: str = "item_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where windows of items occur in documents: (rows, spans, names).

    rows: id, k1, k2, n_words for every row of docs. spans: k1, k2, start, stop, unit for every
    occurrence, as words from start to stop - 1 of the rows of that key. names: item, unit.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. A unit
    occurs where at least ``percent`` of its shingles of ``shingle`` words stand in their places;
    at 100 all its words are there in order. A null text has no words; an item without words has
    no windows. (k1, k2) are 128 hash bits of id and text, so a null or shared id stands only for
    its own text, and rows equal in both share their spans. Items of one id are one item. Other
    columns are not read, whatever their names; empty tables give empty ones.
    """
    own = [F.col(f"`{id}`"), F.col(f"`{text}`")]
    said = [*own, *[c.isNull() for c in own]]
    plain = docs.select(
        own[0].alias("id"), F.xxhash64(*said).alias("k1"), F.xxhash64(F.lit("row"), *said).alias("k2"), own[1].alias("text")
    )
    kind = plain.schema["id"].dataType.simpleString()
    names, units = units_of(items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")), window, shingle)
    sizes = sorted(r[0] for r in units.select(F.least(F.lit(shingle), F.size("words"))).distinct().collect())
    placed = units.select("unit", "words", F.size("grams").alias("m"), F.posexplode("grams").alias("p", "gram"))
    wanted = placed.select("gram").distinct()

    counts = plain.select("text").mapInArrow(partial(_count, sizes=sizes, bitmap=Bitmap(wanted)), "gram bigint, df bigint")
    counts = counts.groupBy(F.col("gram").alias("__gram")).agg(F.sum("df").alias("df"))
    counts = counts.join(wanted, F.col("__gram") == F.col("gram"), "left_semi")
    rarest = Window.partitionBy("unit").orderBy("df", "p")
    need = F.ceil(F.col("m") * percent / 100)
    prefix = placed.join(stored(counts, "rarity"), F.col("gram") == F.col("__gram"), "left")
    prefix = prefix.withColumn("df", F.coalesce("df", F.lit(0))).withColumn("__place", F.row_number().over(rarest))
    prefix = prefix.where((F.col("__place") <= F.col("m") - need + 1) & (F.col("df") > 0))
    prefix = stored(prefix.select("unit", "words", F.col("p").cast("bigint").alias("p"), need.alias("need"), F.col("gram").alias("__gram")), "prefix")

    scan = partial(_scan, sizes=sizes, bitmap=Bitmap(prefix.select(F.col("__gram").alias("gram"))), window=window, rows=HITS_A_BATCH)
    scanned = stored(plain.mapInArrow(scan, f"id {kind}, {_SCAN}"), "scan")
    met = F.col("gram") == F.col("__gram")
    if prefix.count() <= BROADCAST_UNITS:
        prefix = F.broadcast(prefix)
    else:
        prefix = prefix.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met & (F.pmod(F.xxhash64("k1", "q"), F.lit(SALTS)) == F.col("__salt"))
    length = F.size("words")
    start = F.col("q") - F.col("p")
    inside = F.slice("around", F.greatest(start - F.col("before") + 1, F.lit(1)).cast("int"), length)
    spans = (
        scanned.where("q is not null").join(prefix, met)
        .where((start >= 0) & (start + length <= F.col("n_words")))
        .where(_in_place(inside, F.col("words"), shingle) >= F.col("need"))
        .select("k1", "k2", start.alias("start"), (start + length).alias("stop"), "unit")
        .distinct()
    )
    return scanned.where("q is null").select("id", "k1", "k2", "n_words"), stored(spans, "spans"), names


def hit_words(spans: DataFrame) -> DataFrame:
    """(k1, k2, n_hit): the words that lie in any span."""
    ends = spans.groupBy("k1", "k2", "start").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__from", F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    return ends.groupBy("k1", "k2").agg(F.sum(F.greatest(F.col("stop") - F.col("__from"), F.lit(0))).alias("n_hit"))


def report(rows: DataFrame, spans: DataFrame, names: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, n_items, items) for each row; items are sorted as strings and not null."""
    units = spans.select("k1", "k2", "unit").distinct()
    named = units.join(names.select("item", F.col("unit").alias("__unit")), F.col("unit") == F.col("__unit"))
    found = named.where("item is not null").groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    found = hit_words(spans).join(found, ["k1", "k2"], "left").select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "n_hit", "items"
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), items.alias("items"),
    )


def _cut(batches, marker: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.schema.get_field_index("text")
        starts, stops = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("starts", "stops"))
        cuts, data = text_buffers(batch.column(column))
        texts = [None if null else data[cuts[i] : cuts[i + 1]].tobytes() for i, null in enumerate(batch.column(column).is_null().to_pylist())]
        for chunk in words_of(batch.column(column), lower=True, solid_bytes=ALNUM):
            bounds = chunk.bounds()
            for r in range(chunk.rows):
                i = chunk.first + r
                if not starts[i]:
                    continue
                text, parts, at, own = texts[i], [], 0, bounds[r]
                for a, b in zip(starts[i], stops[i], strict=True):
                    first, last = (int(x - chunk.cuts[r]) for x in (chunk.start[own + a], chunk.end[own + b - 1]))
                    parts += [text[at:first], marker]
                    at = last
                texts[i] = b"".join([*parts, text[at:]])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:column], pa.array([None if t is None else t.decode() for t in texts], pa.string())],
            batch.schema.names[: column + 1],
        )


def without_hits(docs: DataFrame, spans: DataFrame, marker: str = "", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) of every row of docs, each stretch of words that spans cover replaced by marker."""
    ends = spans.groupBy("k1", "k2", "start").agg(F.max("stop").alias("stop"))
    order = Window.partitionBy("k1", "k2").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int")
    runs = ends.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(order))
    runs = runs.groupBy("k1", "k2", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    cuts = runs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    cuts = cuts.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "cuts.start", "cuts.stop")
    own = [F.col(f"`{id}`"), F.col(f"`{text}`")]
    said = [*own, *[c.isNull() for c in own]]
    plain = docs.select(own[0].alias("id"), own[1].alias("text"), F.xxhash64(*said).alias("k1"), F.xxhash64(F.lit("row"), *said).alias("k2"))
    kind = plain.schema["id"].dataType.simpleString()
    joined = plain.join(cuts, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left")
    joined = joined.select("id", "text", F.col("start").alias("starts"), F.col("stop").alias("stops"))
    out = joined.mapInArrow(partial(_cut, marker=marker.encode()), f"id {kind}, text string")
    return out.select(F.col("id").alias(id), F.col("text").alias(text))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS u
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM windows),
doc_windows AS (
  SELECT r, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS u
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM words, lengths WHERE len(w) >= l)),
found AS (SELECT r, i, d.l, item_id FROM doc_windows d JOIN windows USING (l, u)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS j FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
