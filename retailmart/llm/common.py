"""Stored intermediate tables, gapless ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests, a folder of its own.

    A cluster must name one, as its executors don't share the driver's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDER:
        _OWN_FOLDER[application] = tempfile.mkdtemp(prefix="llm-")
    return _OWN_FOLDER[application]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends at files every executor can read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of the driver's, carried in the plan; ``rows`` may be empty."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), fields)


def clean_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def gapless(df: DataFrame, key: list[str], order: list[str], name: str, rows_a_chunk: int = 50_000):
    """Number the rows of each key from 0, without gaps, in no given order of chunks.

    A key may hold any share of the rows: its rows are dealt to hashed chunks, numbered there
    and moved up by the rows of the chunks before. ``df`` should be stored, as it is read twice.
    Equal rows get different numbers. An empty table gives an empty table.
    """
    total = df.count()
    chunks = max(64, -(-total // rows_a_chunk))
    dealt = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    by_key = [F.col(k) for k in key]
    sizes = dealt.groupBy(*by_key, "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*by_key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)],
        F.col("__chunk").alias("__c"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*by_key, "__chunk").orderBy(*order)
    ranked = dealt.withColumn("__in_chunk", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    return (
        ranked.join(starts, reduce(lambda a, b: a & b, same) & (F.col("__chunk") == F.col("__c")))
        .withColumn(name, F.col("__in_chunk") + F.col("__before"))
        .drop("__chunk", "__in_chunk", "__c", "__before", *[f"__k{i}" for i in range(len(key))])
    )


def spans_of(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For 0 to size - 1 the smallest number reachable by the links left - right."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their
    ends and contracts the edges to those ends, so that stars end after one round and chains
    after a number of rounds in the logarithm of their length. Minima are pre-aggregated
    before the shuffle and joins are between stored tables, which adaptive execution can
    split at a hub. Null ends, loops and repeated edges don't count.
    """
    live = stored(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges"
    )
    roots = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        point = stored(point.select("node", F.least("node", "low").alias("root")), "pointers")
        while True:
            up = point.select(F.col("node").alias("__up"), F.col("root").alias("__top"))
            moved = stored(
                point.join(up, F.col("root") == F.col("__up")).select(
                    "node", F.col("__top").alias("root"), (F.col("root") != F.col("__top")).alias("moved")
                ),
                "pointers",
            )
            point = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        if roots is None:
            roots = point
        else:
            ends = point.select(F.col("node").alias("__end"), F.col("root").alias("__top"))
            roots = stored(
                roots.join(ends, F.col("root") == F.col("__end"), "left").select(
                    "node", F.coalesce("__top", "root").alias("root")
                ),
                "roots",
            )
        left = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = stored(
            live.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            .distinct(),
            "edges",
        )
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
