"""N-gram Jaccard join of all documents, as a blocked sparse product of the document by n-gram
incidence with bounds from the set sizes.

1. Every text becomes its set of n-gram hashes; equal sets are one *node*.
2. Linked sets of sizes a and b share at least ``percent * (a + b) / (100 + percent)`` n-grams,
   so under any common order of all n-grams they meet among the first ``a - ceil(a * percent /
   100) + 1`` and likewise of b. The order is (band of the hash, documents that hold the n-gram,
   hash): rare ones come first within a band, so a passage that many documents share falls
   outside the prefix of a document that is mostly its own. The incidence is dealt to blocks
   by hash; each block counts its n-grams' documents and passes on those of two or more. Blocks
   that very common n-grams make long are taken apart and counted by partial sums instead.
3. Each node is compared with one of the most shared nodes of its lists, and joined with it
   if linked. Lists whose nodes are then in one component are done.
4. In the other lists, pairs of different components stay candidates if their sizes and the
   places of the n-gram in both orders leave room for the overlap they need. Nodes reachable
   by candidates form a family; the product of its incidence with itself is accumulated in
   blocks of nodes over all n-grams, and pairs below the bound go. A long list is compared
   part by part, every two parts in a group of their own.

A list or block passes on no more rows than it has nodes: those that span its components.
Comparisons count all n-grams of both sets, so no link is missed or made up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailmart.llm.common import components, spans_of, stored
from retailmart.llm.words import shingle_sets
from retailmart.llm.workers import lean, parts

LEAST_BLOCKS = 512
GRAMS_A_BLOCK = 1 << 20
LONG_BLOCK = 1 << 21  # entries; a longer block is not gathered
PART_BYTES = 1 << 23  # of text whose n-grams a task holds at a time
PRODUCTS = 1 << 20  # shared n-grams of pairs that a task holds at a time
PAIRS = 1 << 18  # pairs of a list that a task holds at a time
LIST_ROWS = 512  # longer lists are compared part by part


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _band_edges(percent: int) -> np.ndarray:
    """First hashes of the bands after the first; a band holds 1.5 prefixes on average."""
    width = min(1.0, 1.5 * (100 - percent) / 100 + 0.01)
    return np.array([int(k * width * 2.0**64) for k in range(1, int(np.ceil(1 / width)))], np.uint64)


def _node(grams: np.ndarray) -> int | None:
    if not len(grams):
        return None
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parts(batches, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut to about PART_BYTES of text (a longer one by itself)."""
    return parts(batches, text, PART_BYTES)


@lean
def _set_rows(batches, n: int, percent: int) -> Iterator[pa.RecordBatch]:
    edges = _band_edges(percent)
    for batch in _parts(batches):
        nodes, sizes, bands = [], [], []
        for grams in shingle_sets(batch.column(1), n):
            nodes.append(_node(grams))
            sizes.append(len(grams))
            ends = [*np.searchsorted(grams, edges).tolist(), len(grams)]
            need = prefix_size(len(grams), percent) if len(grams) else 0
            last = next(k for k, end in enumerate(ends) if end >= need)
            bands.append(ends[: last + 1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "key", "node", "n", "bands"],
        )


def sets_of(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs: id, text, key. (id, key, node, n, bands): the set's digest (null if empty), its size, and
    how many n-grams lie in the bands up to each that its prefix can reach."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        partial(_set_rows, n=n, percent=percent), f"id {kind}, key bigint, node bigint, n bigint, bands array<bigint>"
    )


@lean
def _incidence(batches, n: int, percent: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """(block, entries, grams, nodes) pieces; each set once for a task."""
    edges, seen = _band_edges(percent), set()
    for batch in _parts(batches):
        grams, nodes = [], []
        for own in shingle_sets(batch.column(1), n):
            node = _node(own)
            if node is None or node in seen:
                continue
            seen.add(node)
            ends = [*np.searchsorted(own, edges).tolist(), len(own)]
            need = prefix_size(len(own), percent)
            own = own[: next(end for end in ends if end >= need)]
            grams.append(own)
            nodes.append(np.full(len(own), node, np.int64))
        if not grams:
            continue
        g, v = np.concatenate(grams), np.concatenate(nodes)
        block = (g % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        g, v, block = g[order], v[order], block[order]
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        last = [*first[1:].tolist(), len(block)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block[first], pa.int64()),
                pa.array(np.array(last) - first, pa.int64()),
                pa.array([g[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
                pa.array([v[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
            ],
            ["block", "entries", "grams", "nodes"],
        )


@lean
def _entries(batches) -> Iterator[pa.RecordBatch]:
    """(gram, node) of pieces."""
    for batch in batches:
        g, v = (b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("grams", "nodes"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(g, np.int64)), pa.array(np.frombuffer(v, np.int64))], ["gram", "node"]
        )


def _shared(pieces: pa.Table) -> pa.Table:
    """(node, gram, df) of the n-grams of one block that two or more nodes hold."""
    g = np.frombuffer(b"".join(pieces.column("grams").to_pylist()), np.uint64)
    v = np.frombuffer(b"".join(pieces.column("nodes").to_pylist()), np.int64)
    order = np.lexsort((v, g))
    g, v = g[order], v[order]
    fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
    g, v = g[fresh], v[fresh]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    count = np.diff(np.flatnonzero(np.concatenate((first, [True]))))
    df = np.repeat(count, count)
    keep = df > 1
    return pa.table({"node": v[keep], "gram": g[keep].view(np.int64), "df": df[keep].astype(np.int64)})


def _counted(pieces: DataFrame) -> DataFrame:
    """(node, gram, df) of the n-grams that two or more nodes hold; pieces must be stored.

    No task gathers a block of more than LONG_BLOCK entries: an n-gram that a large part of all
    documents hold is counted where its entries lie, and its count joined back to them.
    """
    long = pieces.groupBy(F.col("block").alias("__block")).agg(F.sum("entries").alias("n"))
    long = stored(long.where(F.col("n") > LONG_BLOCK).select("__block"), "long_blocks")
    own = F.col("block") == F.col("__block")
    shared = pieces.join(long, own, "left_anti").groupBy("block").applyInArrow(
        _shared, "node bigint, gram bigint, df bigint"
    )
    if long.isEmpty():
        return shared
    single = pieces.join(long, own, "left_semi").select("grams", "nodes").mapInArrow(_entries, "gram bigint, node bigint")
    single = stored(single.distinct(), "entries")
    df = single.groupBy(F.col("gram").alias("__gram")).agg(F.count(F.lit(1)).alias("df"))
    df = stored(df.where("df > 1"), "frequencies")
    return shared.union(single.join(df, F.col("gram") == F.col("__gram")).select("node", "gram", "df"))


def _lists(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(gram, node, n, place, slots): prefix n-grams held by two or more nodes, with their place in
    the node's order from 1, and how many a node has."""
    nodes = sets.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    held = nodes.agg(F.sum(F.element_at("bands", -1))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-held // GRAMS_A_BLOCK))
    pieces = docs.mapInArrow(
        partial(_incidence, n=n, percent=percent, blocks=blocks),
        "block bigint, entries bigint, grams binary, nodes binary",
    )
    shared = _counted(stored(pieces, "pieces"))
    edges = [int(e) - (1 << 64) if e >= 1 << 63 else int(e) for e in _band_edges(percent).tolist()]
    as_unsigned = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))
    band = sum((as_unsigned >= F.lit(e ^ -(1 << 63))).cast("int") for e in edges) if edges else F.lit(0)
    own = Window.partitionBy("node")
    in_order = own.orderBy("band", "df", "gram")
    up_to_band = own.orderBy("band").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.element_at("bands", F.col("band") + 1) - F.col("__shared")
    return (
        shared.withColumn("band", band)
        .join(nodes, "node")
        .withColumn("__shared", F.count(F.lit(1)).over(up_to_band))
        .withColumn("__place", F.row_number().over(in_order))
        .withColumn("place", F.col("__place") + alone)
        .where(F.col("place") <= need)
        .withColumn("slots", F.count(F.lit(1)).over(own))
        .select("gram", "node", "n", "place", "slots")
    )


def _need(a, b, percent: int):
    """The overlap that sets of sizes a and b need; columns or arrays of whole numbers."""
    return ((a + b) * percent + 99 + percent) / (100 + percent)


def _dealt_lists(lists: DataFrame, blocks: int) -> DataFrame:
    """Lists of one part together in blocks; of the others every two parts by themselves, and each
    part with itself."""
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    dealt = lists.withColumn("b", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("c", other)
    long = F.col("parts") > 1
    return dealt.select(
        "gram", "node", "n", "place", "root", long.alias("long"),
        F.when(long, F.col("gram")).otherwise(F.pmod("gram", F.lit(blocks))).alias("block"),
        F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), (F.col("b") > F.col("c")).cast("int").alias("side"),
    )


def _candidates(rows: pa.Table, percent: int) -> pa.Table:
    """(x, y) that span the candidate pairs of each list of one block, or of two parts of a list."""
    gram, node, n, place, root, side = (
        rows.column(c).to_numpy() for c in ("gram", "node", "n", "place", "root", "side")
    )
    within = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    order = np.argsort(gram, kind="stable")
    gram, node, n, place, root, side = (c[order] for c in (gram, node, n, place, root, side))
    cuts = [*np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))).tolist(), len(gram)]
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m, left, right = b - a, [], []
        v, size, after, top = node[a:b], n[a:b], n[a:b] - place[a:b], root[a:b]
        one = np.flatnonzero(side[a:b] == 0)
        two = one if within else np.flatnonzero(side[a:b] == 1)
        step = max(1, PAIRS // max(1, len(two)))
        for i in range(0, len(one), step):
            j = one[i : i + step]
            need = ((size[j, None] + size[two]) * percent + 99 + percent) // (100 + percent)
            room = 1 + np.minimum(after[j, None], after[two])
            own, other = np.nonzero((room >= need) & (top[j, None] != top[two]))
            own, other = j[own], two[other]
            if within:
                own, other = own[own < other], other[own < other]
            found = spans_of(own, other, m)
            moved = np.flatnonzero(found != np.arange(m))
            left.append(moved)
            right.append(found[moved])
        if left:
            found = spans_of(np.concatenate(left), np.concatenate(right), m)
            moved = np.flatnonzero(found != np.arange(m))
            xs.append(v[moved])
            ys.append(v[found[moved]])
    return pa.table({"x": np.concatenate(xs), "y": np.concatenate(ys)})


def _incident(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = [np.frombuffer(s, np.uint64) for s in sets]
    size = np.array([len(g) for g in grams])
    return np.concatenate(grams), np.repeat(np.arange(len(grams)), size), size


def _block_product(rows: pa.Table, percent: int) -> pa.Table:
    """(x, y) that span the links between two blocks of a family (or within one)."""
    side = rows.column("side").to_numpy()
    node = rows.column("node").to_numpy()
    sets = rows.column("grams").to_pylist()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(one) or not len(two):  # a block with itself, or with one that hashing left empty
        one = two = one if len(one) else two
    g, i, size = _incident([sets[k] for k in one])
    h, j, other = _incident([sets[k] for k in two])
    order = np.argsort(h, kind="stable")
    h, j = h[order], j[order]
    low, high = np.searchsorted(h, g), np.searchsorted(h, g, "right")
    overlap = np.zeros(len(one) * len(two), np.int64)
    ends = np.cumsum(high - low)
    first = 0
    while first < len(g):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PRODUCTS)))
        count = (high - low)[first:last]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pair = np.repeat(i[first:last] * len(two), count) + j[np.repeat(low[first:last], count) + inside]
        overlap += np.bincount(pair, minlength=len(overlap))
        first = last
    overlap = overlap.reshape(len(one), len(two))
    united = size[:, None] + other - overlap
    a, b = np.nonzero(100 * overlap >= percent * united)
    names = np.concatenate((node[one], node[two]))
    found = spans_of(a, b + len(one), len(names))
    moved = np.flatnonzero(names != names[found])
    return pa.table({"x": names[moved], "y": names[found[moved]]})


def _family_links(families: DataFrame, full: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links within families (node, root), by the product of every two blocks of nodes."""
    sizes = families.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = families.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = dealt.select(
        "root", "node", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("c")
    )
    pairs = pairs.select(
        "root", "node", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"),
        (F.col("b") > F.col("c")).cast("int").alias("side"),
    )
    sets = full.select(F.col("node").alias("__node"), "grams")
    rows = stored(pairs, "blocks").join(sets, F.col("node") == F.col("__node"))
    return rows.groupBy("root", "b", "c").applyInArrow(
        lambda t: _block_product(t, percent), "x bigint, y bigint"
    )


@lean
def _compare(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (y, salt, x with null first): the set of y, then those to compare with it."""
    y = y_grams = None
    for batch in batches:
        out = []
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("y", "x", "grams")]
        for own_y, x, grams in zip(*(c.to_pylist() for c in columns), strict=True):
            own = np.frombuffer(grams, np.uint64)
            if x is None:
                y, y_grams = own_y, own
                continue
            if own_y != y:
                raise ValueError("a set to compare with is missing")
            small, large = (own, y_grams) if len(own) < len(y_grams) else (y_grams, own)
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            overlap = int((large[place] == small).sum())
            if 100 * overlap >= percent * (len(own) + len(y_grams) - overlap):
                out.append((x, y))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["x", "y"]
        )


def _linked(pairs: DataFrame, full: DataFrame, percent: int, rows_a_salt: int = 512) -> DataFrame:
    """The pairs (x, y) whose whole sets are linked. A y with many partners is dealt to salts."""
    many = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / rows_a_salt).alias("salts"))
    dealt = pairs.join(many, "y").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts"))).select("x", "y", "salt")
    dealt = stored(dealt, "pairs")
    sets = full.select(F.col("node").alias("__node"), "grams")
    left = dealt.join(sets, F.col("x") == F.col("__node")).select("y", "salt", "x", "grams")
    heads = dealt.select("y", "salt").distinct().join(sets, F.col("y") == F.col("__node"))
    heads = heads.select("y", "salt", F.lit(None).cast("bigint").alias("x"), "grams")
    together = left.unionByName(heads).repartition(F.col("y"), F.col("salt"))
    return together.sortWithinPartitions("y", "salt", F.asc_nulls_first("x")).mapInArrow(
        partial(_compare, percent=percent), "x bigint, y bigint"
    )


@lean
def _full_rows(batches, n: int) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        nodes, grams = [], []
        for wanted, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
            if _node(own) == wanted:
                nodes.append(wanted)
                grams.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(grams, pa.binary())], ["node", "grams"])


def _links(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between different nodes, enough to reach all that are reachable."""
    lists = stored(_lists(docs, sets, n, percent), "lists")
    centre = F.max(F.struct("slots", "node", "n", "place")).alias("c")
    heads = lists.groupBy("gram").agg(centre, F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = heads.select(
        "gram", F.col("c.node").alias("y"), F.col("c.n").alias("y_n"), F.col("c.place").alias("y_place")
    )
    shared = lists.join(stored(heads, "heads"), "gram")
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("y_n") - F.col("y_place"))
    enough = room >= F.floor(_need(F.col("n"), F.col("y_n"), percent))
    votes = shared.where((F.col("node") != F.col("y")) & enough).groupBy(F.col("node").alias("x"), "y").count()
    star = votes.groupBy("x").agg(F.max(F.struct("count", "y")).alias("best"))
    star = stored(star.select("x", F.col("best.y").alias("y")), "star")

    members = stored(shared.select("node").distinct(), "members")
    keep = sets.where("node is not null").groupBy("node").agg(F.min("key").alias("__key"))
    keep = keep.join(members, "node")  # one row of each, known by its hash: ids may be null or shared
    rows = docs.join(keep, F.col("key") == F.col("__key")).select("node", "text")
    full = rows.mapInArrow(partial(_full_rows, n=n), "node bigint, grams binary")
    full = stored(full.dropDuplicates(["node"]), "full")

    first = stored(_linked(star, full, percent), "links")
    joined = components(first, "x", "y").withColumnRenamed("node", "__n")
    placed = lists.join(joined, F.col("node") == F.col("__n"), "left").select(
        "gram", "node", "n", "place", F.coalesce("root", "node").alias("root")
    )
    rows_of = F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("parts")
    apart = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), rows_of).where("low <> high")
    open_lists = placed.join(stored(apart.select("gram", "parts"), "apart"), "gram")
    blocks = max(LEAST_BLOCKS, -(-lists.count() // GRAMS_A_BLOCK))
    spans = _dealt_lists(open_lists, blocks).groupBy("long", "block", "i", "j").applyInArrow(
        lambda t: _candidates(t, percent), "x bigint, y bigint"
    )
    families = components(stored(spans, "spans"), "x", "y")
    return first.union(_family_links(families, full, percent))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id column, n_shingles, component_id, node) for each row of docs.

    Two texts link when 100 * shared >= percent * united n-grams of their A-Z-lowered words; a
    text of fewer words is one n-gram; a text without words, or null, has none and links with
    nothing: its component_id is its own id. component_id is the smallest id reachable by links.
    Equal rows come back as often as they came; a null id is never the smallest, and other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    own, said = F.col(f"`{id}`"), F.col(f"`{text}`")
    plain = docs.select(own.alias("id"), said.alias("text"), F.xxhash64(own, own.isNull(), said, said.isNull()).alias("key"))
    sets = stored(sets_of(plain, n, percent), "sets")
    links = stored(_links(plain, sets, n, percent), "links")
    roots = components(links, "x", "y").withColumnRenamed("node", "__n")
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    rooted = stored(nodes.join(roots, F.col("node") == F.col("__n"), "left").select("node", "low", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy(F.col("root").alias("__root")).agg(F.min("low").alias("component"))
    named = stored(rooted.join(least, F.col("root") == F.col("__root")).select(F.col("node").alias("__n"), "component"), "named")
    return sets.join(named, F.col("node") == F.col("__n"), "left").select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
        "node",
    )


def keep_rows(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id.

    Rows are known by 64 hash bits of id and text, so an id may be null or stand for several texts. A row without
    an id stays only if its group has no id at all; of several texts of the smallest id that of the
    smallest hash stays. Texts without words are kept. Rows equal in id and text are copies.
    """
    own = F.col(f"`{id}`")
    keyed = docs.withColumn("__row", F.xxhash64(own, own.isNull(), F.col(f"`{text}`"), F.col(f"`{text}`").isNull()))
    found = near_duplicates(keyed, n, percent, "__row", text).select(F.col("__row").alias("__key"), "component_id").distinct()
    ids = keyed.select("__row", own.isNull().alias("no_id"), own.alias("id")).distinct()
    ids = ids.join(stored(found, "found"), F.col("__row") == F.col("__key"))
    chosen = ids.groupBy("component_id").agg(F.min(F.struct("no_id", "id", "__row")).alias("least"))
    chosen = stored(chosen.select(F.col("least.__row").alias("__key")), "chosen")
    one = keyed.join(chosen, F.col("__row") == F.col("__key")).drop("__key")
    return one.dropDuplicates(["__row"]).drop("__row")
