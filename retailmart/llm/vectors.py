"""Near-duplicate vectors: spherical k-means deals them to cells, blocked cosine products compare
them within cells, and one representative of each group is kept.

Linked vectors of different cells are found as well. Of two unit vectors at cosine >= c, the
distances to the plane between their cells' centres add up to at most their own distance
sqrt(2 - 2c), so one of them is within half of that of the plane: a vector also visits every
cell whose plane is that near. Equal vectors are one row with a count throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailmart.llm.common import components, spans_of, stored

SAMPLE = 20_000  # vectors that the centres are fitted to, about
MOST_CELLS = 4096
SLACK = 1e-9  # for rounding, on the side of more visits


def cells_for(rows: int) -> int:
    """About 4,096 vectors a cell: where vectors have no clusters each visits a large part of the
    cells, and what is shuffled grows with their number."""
    return min(MOST_CELLS, max(8, rows // 4096))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of unit vectors x, fewer if there are fewer vectors."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        best = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return np.unique(centres, axis=0)


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid_rows(batches) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles scaled to a largest component of 1; null if not comparable."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
            usable = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            out.append((x / np.abs(x).max()).tobytes() if usable else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])


def _visits(batches, centres: dict[int, np.ndarray], reach: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(1).to_pylist()
        home, cells, met = np.zeros(len(vectors), np.int64), [[]] * len(vectors), [b"\0"] * len(vectors)
        size = np.array([len(v) // 8 for v in vectors])
        for d in np.unique(size):
            c = centres.get(int(d))
            at = np.flatnonzero(size == d)
            if c is None:  # too few vectors of this length to have centres: one cell
                continue
            between = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-18))
            for i in range(0, len(at), 512):
                own = at[i : i + 512]
                dots = _unit([vectors[r] for r in own]) @ c.T
                best = dots.argmax(1)
                away = (dots.max(1)[:, None] - dots) / between[best]
                near = away <= reach + SLACK
                near[np.arange(len(own)), best] = False
                home[own] = best
                for k, r in enumerate(own):
                    cells[r] = np.flatnonzero(near[k]).tolist()
                    met[r] = np.packbits(near[k]).tobytes()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(size, pa.int64()), pa.array(home, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(met, pa.binary())],
            [*batch.schema.names, "d", "home", "cells", "met"],
        )


def _product(rows: pa.Table, least: float) -> pa.Table:
    """(node, links, root): what the pairs of two blocks add to each node, and their span.

    Products are made in single precision first; a pair that its rounding leaves in doubt is
    decided in double precision.
    """
    node, weight, side, home, cell = (
        rows.column(c).to_numpy() for c in ("node", "weight", "side", "home", "cell")
    )
    visitors = bool(rows.column("visitors")[0].as_py())
    x = _unit(rows.column("v").to_pylist())
    narrow, doubt = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not visitors and not len(two)
    if same:
        two = one
    links = np.zeros(len(node))
    root = np.arange(len(node))
    lefts, rights = [], []
    if visitors and len(one) and len(two):
        bits = rows.column("met").to_pylist()
        met = np.unpackbits(np.stack([np.frombuffer(bits[i], np.uint8) for i in one]), axis=1).view(bool)
    for i in range(0, len(one) if len(two) else 0, 256):
        dots = narrow[one[i : i + 256]] @ narrow[two].T
        a, b = np.nonzero(dots >= least - doubt)
        near = dots[a, b] > least + doubt
        a, b = one[i + a], two[b]
        unsure = np.flatnonzero(~near)
        for j in range(0, len(unsure), 1 << 16):
            some = unsure[j : j + (1 << 16)]
            near[some] = np.einsum("ij,ij->i", x[a[some]], x[b[some]]) >= least
        if same:
            near &= a != b
        if visitors:  # a pair that also meets in the visitor's home counts in the lower cell
            near &= ~((home[b] < cell[0]) & met[np.searchsorted(one, a), home[b]])
        a, b = a[near], b[near]
        links += np.bincount(a, weight[b], len(node))
        if not same:
            links += np.bincount(b, weight[a], len(node))
        lefts.append(a)
        rights.append(b)
        if sum(map(len, lefts)) > 1 << 20:
            root = spans_of(np.concatenate([*lefts, np.arange(len(node))]), np.concatenate([*rights, root]), len(node))
            lefts, rights = [], []
    root = spans_of(np.concatenate([*lefts, np.arange(len(node))]), np.concatenate([*rights, root]), len(node))
    seen = links > 0
    return pa.table({"node": node[seen], "links": links[seen].astype(np.int64), "root": node[root[seen]]})


def near_duplicate_vectors(
    rows: DataFrame, least: float = 0.9, id: str = "vec_id", vector: str = "embedding", block: int = 4096
) -> DataFrame:
    """(id column, n_links, component_id, kept) for every row.

    Two rows link if the cosine of their vectors, in double precision, is at least ``least``
    (equal vectors always do). n_links counts the other rows linked directly, component_id is the
    smallest id reachable by links, kept says that it is the row's own. A vector that is null,
    empty, zero or holds null or non-finite components links with nothing; vectors of different
    length don't link. Equal rows count as rows of their own, a null id is never the smallest,
    other columns are not read, and an empty table gives no rows.
    """
    plain = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    kind = plain.schema["id"].dataType.simpleString()
    vectors = plain.mapInArrow(_valid_rows, f"id {kind}, v binary").withColumn("node", F.xxhash64("v"))
    vectors = stored(vectors.withColumn("node", F.when(F.col("v").isNotNull(), F.col("node"))), "vectors")
    valid = vectors.where("node is not null")
    nodes = valid.groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"))
    nodes = stored(nodes, "nodes")

    sizes = {r["d"]: r["count"] for r in nodes.groupBy((F.octet_length("v") / 8).cast("int").alias("d")).count().collect()}
    centres = {}
    for d, n in sorted(sizes.items()):
        u = F.pmod(F.xxhash64("node", F.lit("cells")), F.lit(1 << 30)) / (1 << 30)
        chosen = nodes.where((F.octet_length("v") == 8 * d) & (u < min(1.0, SAMPLE / n))).orderBy("node").select("v")
        x = [bytes(r["v"]) for r in chosen.toLocalIterator()]
        if x:
            centres[d] = spherical_kmeans(_unit(x), cells_for(n))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) / 2
    dealt = nodes.select("node", "v", "weight").mapInArrow(
        partial(_visits, centres=centres, reach=reach),
        "node bigint, v binary, weight bigint, d bigint, home bigint, cells array<bigint>, met binary",
    )
    dealt = stored(dealt, "cells")

    at_home = dealt.withColumn("cell", F.col("home"))
    away = dealt.withColumn("cell", F.explode("cells")).withColumn("met", F.lit(None).cast("binary"))  # only the hosts' is read
    counts = at_home.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    counts = counts.select(F.col("d").alias("__d"), F.col("cell").alias("__cell"), "blocks")
    visits = away.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).alias("visit_blocks"))
    visits = visits.select(F.col("d").alias("__vd"), F.col("cell").alias("__vcell"), "visit_blocks")
    here = (F.col("__d") == F.col("d")) & (F.col("__cell") == F.col("cell"))
    sizes_of = stored(counts.join(visits, (F.col("__d") == F.col("__vd")) & (F.col("__cell") == F.col("__vcell")), "left")
                      .select("__d", "__cell", "blocks", F.coalesce("visit_blocks", F.lit(0)).alias("visit_blocks")), "blocks")
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    keep = ["d", "cell", "node", "v", "weight", "home", "met"]
    owned = at_home.join(sizes_of, here).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    among = owned.withColumn("c", numbers("blocks")).select(
        *keep, F.lit(False).alias("visitors"), F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"),
        (F.col("b") > F.col("c")).cast("int").alias("side"),
    )
    hosts = owned.where("visit_blocks > 0").withColumn("j", numbers("visit_blocks"))
    hosts = hosts.select(*keep, F.lit(True).alias("visitors"), F.col("b").alias("i"), "j", F.lit(0).alias("side"))
    guests = away.join(sizes_of, here).withColumn("j", F.pmod(F.xxhash64("node"), F.col("visit_blocks")))
    guests = guests.withColumn("i", numbers("blocks"))
    guests = guests.select(*keep, F.lit(True).alias("visitors"), "i", "j", F.lit(1).alias("side"))
    met = among.unionByName(hosts).unionByName(guests)
    spans = stored(
        met.groupBy("d", "cell", "visitors", "i", "j").applyInArrow(
            lambda t: _product(t, least), "node bigint, links bigint, root bigint"
        ),
        "spans",
    )

    links = spans.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "__n")
    roots = components(spans, "node", "root").withColumnRenamed("node", "__r")
    named = nodes.select("node", "weight", "low").join(links, F.col("node") == F.col("__n"), "left")
    named = named.join(roots, F.col("node") == F.col("__r"), "left").select(
        "node", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    named = stored(named, "rooted")
    least_id = named.groupBy(F.col("root").alias("__root")).agg(F.min("low").alias("component"))
    named = stored(named.join(least_id, F.col("root") == F.col("__root")).select(F.col("node").alias("__n"), "n_links", "component"), "named")
    out = vectors.join(named, F.col("node") == F.col("__n"), "left").select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
