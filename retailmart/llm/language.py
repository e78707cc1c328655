"""Language identification by Bayesian evidence fusion.

The posterior of a row joins the likelihood of its text under byte n-gram models with what its
markup declares, its address suffix and a prior for its host. How far a declaration or suffix
can be trusted, and the host priors, are grouped aggregations of the text posteriors of all
rows; a host's prior is smoothed with its parent domain's, and that with the whole corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailmart.llm.common import stored
from retailmart.llm.words import mix, text_buffers
from retailmart.llm.workers import lean

TABLE = 1 << 16
SLICES = 64  # parts of a table that are added up apart
SAMPLE_A_LANGUAGE = 2000  # labelled rows of each language that the text models are fitted to, about
TEXT_TRUST = 0.25  # neighbouring n-grams overlap: each counts as a quarter of a free observation
PIECE = 1 << 17

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_PLAIN = np.ones(256, bool)  # letters and other bytes that carry evidence; digits and marks don't
_PLAIN[[*range(0, 65), *range(91, 97), *range(123, 128)]] = False


def _grams(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table place, whether it counts) of the trigram that begins at each byte; blanks follow a text's end."""
    blank = np.uint64(32)
    low = np.where(_PLAIN[data], _LOWER[data], blank)
    one, two = np.append(low[1:], blank)[: len(low)], np.append(low[2:], [blank, blank])[: len(low)]
    last = cuts[1:][np.diff(cuts) > 0] - 1
    one[last], two[last], two[np.maximum(last - 1, 0)] = blank, blank, blank
    code = (low << np.uint64(16)) | (one << np.uint64(8)) | two
    return (mix(code + np.uint64(1)) % np.uint64(TABLE)).astype(np.int64), _PLAIN[data]


def _pieces(array: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, cuts, bytes) of whole texts, about PIECE bytes at a time."""
    cuts, data = text_buffers(array)
    first = 0
    while first < len(array):
        after = int(np.searchsorted(cuts, cuts[first] + PIECE, "right")) - 1
        after = min(max(after, first + 1), len(array))
        yield first, cuts[first : after + 1] - cuts[first], data[cuts[first] : cuts[after]]
        first = after


@lean
def _count(batches) -> Iterator[pa.RecordBatch]:
    """(language, slice, counts): a task's n-gram counts, where a slice of the table has any."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for first, cuts, data in _pieces(batch.column(1)):
            at, counts = _grams(data, cuts)
            for r in range(len(cuts) - 1):
                own = slice(cuts[r], cuts[r + 1])
                total = totals.setdefault(names[first + r], np.zeros(TABLE, np.int64))
                total += np.bincount(at[own][counts[own]], minlength=TABLE)
    parts = [(c, k, part) for c, t in totals.items() for k, part in enumerate(np.split(t, SLICES)) if part.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.int32()),
         pa.array([p[2].tobytes() for p in parts], pa.binary())],
        ["language", "slice", "counts"],
    )


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist()], axis=0)
    return pa.table([[key[0].as_py()], [key[1].as_py()], [total.tobytes()]], pa.schema([("language", pa.string()), ("slice", pa.int32()), ("counts", pa.binary())]))


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    log_odds: np.ndarray  # (TABLE, languages), float32


def fit_text_model(labelled: DataFrame, sample: int = SAMPLE_A_LANGUAGE) -> TextModel:
    """labelled: language, text, id. Uses about ``sample`` rows of each language, chosen by a hash
    of the id; a language of fewer rows is used whole. Null languages and texts don't count.

    Tasks give up counts only where they met sampled rows, slices are added up on executors, and
    one table for each language is collected once, whatever the number of splits."""
    known = labelled.where("language is not null and text is not null")
    sizes = {r["language"]: r["count"] for r in known.groupBy("language").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.zeros((TABLE, 0), np.float32))
    share = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, sample / n))])
    u = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = known.where(u < share[F.col("language")]).select("language", "text")
    schema = "language string, slice int, counts binary"
    parts = chosen.mapInArrow(_count, schema)
    totals = {c: np.zeros(TABLE) for c in languages}
    width = TABLE // SLICES
    for row in parts.groupBy("language", "slice").applyInArrow(_added, schema).collect():
        totals[row["language"]][row["slice"] * width :][:width] = np.frombuffer(row["counts"], np.int64)
    table = np.stack([totals[c] + 0.5 for c in languages], axis=1)
    table = np.log(table / table.sum(0))
    return TextModel(languages, (table - table.mean(1, keepdims=True)).astype(np.float32))


@lean
def _text_scores(batches, model: TextModel) -> Iterator[pa.RecordBatch]:
    k = len(model.languages)
    for batch in batches:
        scores, letters = np.zeros((batch.num_rows, k)), np.zeros(batch.num_rows, np.int64)
        for first, cuts, data in _pieces(batch.column(0)):
            at, counts = _grams(data, cuts)
            before = np.concatenate(([0], np.cumsum(counts)))[cuts]  # n-grams that count, before each text
            odds = model.log_odds[at[counts]]
            sums = np.zeros((len(odds) + 1, k))
            np.cumsum(odds, axis=0, out=sums[1:])
            rows = slice(first, first + len(cuts) - 1)
            scores[rows] = np.diff(sums[before], axis=0)
            letters[rows] = np.diff(before)
        values = pa.array(scores.reshape(-1), pa.float64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * k + 1, max(k, 1)) if k else np.zeros(batch.num_rows + 1), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, pa.array(letters)], [*batch.schema.names[1:], "scores", "letters"])


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def _sums(p: str, k: int) -> list[Column]:
    return [F.sum(F.col(p)[i]).alias(f"s{i}") for i in range(k)]


def _array(k: int, cell) -> Column:
    return F.array(*[cell(i) for i in range(k)])


def identify(rows: DataFrame, model: TextModel, id: str = "id", least: float = 0.6, strength: float = 20.0) -> DataFrame:
    """rows: id and the strings text, declared, suffix, host, parent; returns id, language (null if
    rejected), best_language, posterior, letters, kept.

    Evidence that is null or blank has no say. A row is rejected if its text has no letter, or its
    best posterior is below ``least``. Equal rows come back as often as they came, null ids with
    them; other columns are dropped. Without a fitted language every row is rejected.
    """
    k = len(model.languages)
    kind = rows.schema[id].dataType.simpleString()
    if not k:
        return rows.select(id, F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("best_language"),
                           F.lit(0.0).alias("posterior"), F.lit(0).cast("bigint").alias("letters"), F.lit(False).alias("kept"))
    named = {c: F.when(F.trim(F.lower(c)) != "", F.trim(F.lower(c))) for c in ("declared", "suffix", "host", "parent")}
    plain = rows.select("text", F.col(id).alias("id"), *[v.alias(c) for c, v in named.items()])
    strings = ", ".join(f"{c} string" for c in named)
    scored = plain.mapInArrow(
        partial(_text_scores, model=model), f"id {kind}, {strings}, scores array<double>, letters bigint"
    )
    trusted = F.transform("scores", lambda x: x * TEXT_TRUST)
    scored = stored(scored.withColumn("p", _softmax(trusted)), "scored")

    lettered = scored.where("letters > 0")
    totals = lettered.agg(*_sums("p", k)).first()
    everywhere = [(totals[i] or 0.0) + 1.0 for i in range(k)]
    shares = [x / sum(everywhere) for x in everywhere]

    def tokens(column: str) -> DataFrame:
        """log P(value | language) up to a constant, from how the value goes with the texts."""
        sums = lettered.where(F.col(column).isNotNull()).groupBy(column).agg(*_sums("p", k))
        seen = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
        odds = _array(k, lambda i: F.log((F.col(f"s{i}") + strength * shares[i] / k) / (everywhere[i])))
        return stored(sums.where(seen > 0).select(F.col(column).alias(f"__{column}"), odds.alias(f"{column}_odds")), column)

    parents = lettered.where("parent is not null").groupBy("parent").agg(*_sums("p", k))
    total = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    parents = parents.select(
        F.col("parent").alias("__parent"),
        _array(k, lambda i: (F.col(f"s{i}") + strength * shares[i]) / (total + strength)).alias("above"),
    )
    parents = stored(parents, "parents")
    hosts = lettered.where("host is not null").groupBy("host", "parent").agg(*_sums("p", k))
    above = F.coalesce("above", F.array(*[F.lit(x) for x in shares]))
    hosts = hosts.join(parents, F.col("parent") == F.col("__parent"), "left").select(
        F.col("host").alias("__host"),
        F.col("parent").alias("__host_parent"),
        _array(k, lambda i: F.log((F.col(f"s{i}") + strength * above[i]) / (total + strength))).alias("prior"),
    )
    hosts = stored(hosts, "hosts")

    joined = scored.join(hosts, (F.col("host") == F.col("__host")) & F.col("parent").eqNullSafe(F.col("__host_parent")), "left")
    for column in ("declared", "suffix"):
        joined = joined.join(tokens(column), F.col(column) == F.col(f"__{column}"), "left")
    base = F.coalesce("prior", F.array(*[F.lit(float(np.log(x))) for x in shares]))
    none = F.array(*[F.lit(0.0)] * k)
    logs = _array(
        k,
        lambda i: F.col("scores")[i] * TEXT_TRUST + base[i]
        + F.coalesce("declared_odds", none)[i] + F.coalesce("suffix_odds", none)[i],
    )
    fused = joined.select("id", "letters", _softmax(logs).alias("p"))
    best = F.array_max("p")
    names = F.array(*[F.lit(c) for c in model.languages])
    out = fused.select(
        F.col("id").alias(id),
        F.element_at(names, F.array_position("p", best).cast("int")).alias("best_language"),
        best.alias("posterior"),
        "letters",
        ((F.col("letters") > 0) & (best >= least)).alias("kept"),
    )
    return out.withColumn("language", F.when(F.col("kept"), F.col("best_language")))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text, declared, suffix, host and parent read from address and markup."""
    address = F.lower(F.coalesce(F.col(url), F.lit("")))
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    markup = F.coalesce(F.col(html), F.lit(""))
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract(markup, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)
    return pages.withColumns(
        {
            "text": text,
            "declared": declared,
            "suffix": F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1),
            "host": host,
            "parent": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        }
    )
