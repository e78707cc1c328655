"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic); the table is raked, within what each cell holds,
until its marginals are the targets; each document is then sampled with the probability that
gives its cell the raked share of the token budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailmart.llm.common import small_table, stored
from retailmart.llm.words import words_of
from retailmart.llm.workers import lean, parts

FEATURES = 256
TOPIC_SAMPLE = 4000  # rows that the first topic centres are drawn from, about
TOPIC_ROUNDS = 20
UNIT = 1 << 24  # vectors are summed as whole numbers of this part, so no order of tasks shows
RATES_A_PLAN = 100_000  # rates that one plan carries
AXES = ("source", "lang", "topic")
PART_BYTES = 1 << 22  # of text whose vectors a task holds at a time
PART_ROWS = 1024  # vectors that a task holds at a time


def _features(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, unit vectors of square-rooted hashed word counts) of a run of rows."""
    for chunk in words_of(array, lower=True):
        at = chunk.row * FEATURES + (chunk.hash % np.uint64(FEATURES)).astype(np.int64)
        counts = np.bincount(at, minlength=chunk.rows * FEATURES).reshape(chunk.rows, FEATURES)
        vectors = np.sqrt(counts)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        yield np.diff(chunk.bounds()), vectors


@lean
def _vectors(batches) -> Iterator[pa.RecordBatch]:
    """id, text, source, lang to id, source, lang, tokens, v."""
    for batch in parts(batches, 1, PART_BYTES, PART_ROWS):
        words, rows = [], []
        for n, vectors in _features(batch.column(1)):
            words += n.tolist()
            rows += [v.tobytes() for v in vectors.astype(np.float32)]
        columns = [batch.column(0), *batch.columns[2:], pa.array(words, pa.int64()), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "source", "lang", "tokens", "v"])


def _vector_parts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(first, PART_ROWS)


def _matrix(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.float32).reshape(-1, FEATURES)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors.astype(np.float64) @ centres.T).round(9).argmax(1)


@lean
def _topic_sums(batches, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((len(centres), FEATURES), np.int64)
    for batch in _vector_parts(batches):
        vectors = _matrix(batch.column(0))
        best, units = _nearest(vectors, centres), np.rint(vectors.astype(np.float64) * UNIT).astype(np.int64)
        for k in np.unique(best):
            sums[k] += units[best == k].sum(0)
    topic, place = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(topic), pa.array(place), pa.array(sums[topic, place])], ["topic", "place", "sum"])


def fit_topics(vectors: DataFrame, topics: int, sample: int = TOPIC_SAMPLE) -> np.ndarray:
    """Centres of ``topics`` topics, by k-means over all stored ``vectors`` (id, v).

    The first centres are drawn from about ``sample`` rows chosen by a hash of the id; each round
    sums all vectors by their nearest centre on the executors, entry by entry, so that no task
    holds the sums of all the others. Documents may be fewer than topics.
    """
    u = F.pmod(F.xxhash64("id", F.lit("topic sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = vectors.where(u < min(1.0, sample / max(vectors.count(), 1))).select("v")
    x = _matrix(pa.array(sorted(bytes(r["v"]) for r in chosen.collect()), pa.binary())).astype(np.float64)
    if not len(x):  # one id for all rows may miss the sample
        x = _matrix(pa.array(sorted(bytes(r["v"]) for r in vectors.select("v").limit(topics).collect()), pa.binary())).astype(np.float64)
    if not len(x):
        return np.zeros((1, FEATURES))
    centres = x[np.linspace(0, len(x) - 1, topics).astype(int)]
    for _ in range(TOPIC_ROUNDS):
        parts = vectors.select("v").mapInArrow(partial(_topic_sums, centres=centres), "topic bigint, place bigint, sum bigint")
        found = np.zeros(centres.shape)
        for r in parts.groupBy("topic", "place").agg(F.sum("sum").alias("sum")).collect():
            found[r["topic"], r["place"]] = r["sum"] / UNIT
        sums = np.where(found.any(1, keepdims=True), found, centres)
        before, centres = centres, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.abs(centres - before).max() < 1e-6:
            break
    return centres


@lean
def _label(batches, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in _vector_parts(batches):
        topic = [f"topic{k}" for k in _nearest(_matrix(batch.column(4)), centres)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(topic, pa.string())], ["id", "source", "lang", "tokens", "topic"])


def rake(mass: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Scale a table of masses along its axes in turn until its marginals are the targets.

    Targets need not sum to the mass; a target whose cells are all empty is left out, and the
    others of its axis share its part. Where the targets contradict the empty cells, the last
    table is returned, whose last axis fits.
    """
    if not mass.sum():
        return mass
    out = mass / mass.sum()
    axes = range(mass.ndim)
    others = [tuple(a for a in axes if a != axis) for axis in axes]
    wanted = []
    for axis, target in enumerate(targets):
        possible = np.where(mass.sum(others[axis]) > 0, target, 0.0)
        wanted.append(possible / possible.sum() if possible.sum() else mass.sum(others[axis]) / mass.sum())
    for _ in range(rounds):
        worst = 0.0
        for axis in axes:
            now = out.sum(others[axis])
            factor = np.divide(wanted[axis], now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(now - wanted[axis]).max()))
            out = out * factor.reshape([-1 if a == axis else 1 for a in axes])
        if worst < tolerance:
            break
    return out


def calibrate(mass: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, factor * weight) with the factor for which the expected mass is the budget, or all
    that has weight if that is less."""
    low, high = 0.0, 1.0
    while (np.minimum(1, high * weight) * mass).sum() < min(budget, mass[weight > 0].sum()) * (1 - 1e-12) and high < 1e300:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (np.minimum(1, middle * weight) * mass).sum() < budget else (low, middle)
    return np.minimum(1, high * weight)


def fill(own: np.ndarray, wanted: np.ndarray, budget: float) -> np.ndarray:
    """min(own, factor * wanted) of sum ``budget``, or all that is wanted at all if that is less."""
    goal = np.where(wanted > 0, own, 0.0)
    if goal.sum() <= budget:
        return goal
    at = np.flatnonzero(goal > 0)
    at = at[np.argsort(own[at] / wanted[at], kind="stable")]
    before = np.concatenate(([0.0], np.cumsum(own[at])[:-1]))
    rest = np.cumsum(wanted[at][::-1])[::-1]
    factor = (budget - before) / rest
    first = int(np.argmax(factor * wanted[at] < own[at]))  # those before have less than their part
    goal[at[first:]] = factor[first] * wanted[at[first:]]
    return goal


@dataclass(frozen=True)
class Axis:
    names: list[str]
    target: np.ndarray  # shares wanted
    goal: np.ndarray  # tokens to keep: the target's part of the budget, or all where there are fewer
    kept: np.ndarray  # tokens expected to be kept


def rake_within(
    codes: list[np.ndarray], mass: np.ndarray, goals: list[np.ndarray], budget: float, rounds: int = 500, tolerance: float = 1e-9
) -> np.ndarray:
    """The probability min(1, product of a factor of each axis) of each cell, with which the kept
    mass has the goals as its marginals.

    codes: the place of each cell's value on each axis; all masses are above 0. Each step fits one
    axis: cells at 1 stay there while the others of their value are scaled to what is left of
    its goal. Where goals contradict each other, the table of the last round is scaled to the budget.
    """
    live = np.ones(len(mass), bool)
    for code, goal in zip(codes, goals, strict=True):
        live &= goal[code] > 0
    out = np.zeros(len(mass))
    codes, m = [code[live] for code in codes], mass[live]
    if not len(m):
        return out
    owns = [np.bincount(code, m, len(goal)) for code, goal in zip(codes, goals, strict=True)]
    x = np.full(len(m), budget / m.sum())
    for _ in range(rounds):
        worst = 0.0
        for code, goal, own in zip(codes, goals, owns, strict=True):
            n = len(goal)
            worst = max(worst, float(np.abs(np.bincount(code, m * np.minimum(1, x), n) - goal)[own > 0].max()) / budget)
            all_of_it = (goal >= own * (1 - 1e-12)) & (own > 0)
            least = np.full(n, np.inf)
            np.minimum.at(least, code, x)
            for _ in range(30):  # Newton steps on a concave function of each value's factor
                full = np.bincount(code, m * (x >= 1), n)
                part = np.bincount(code, m * np.where(x < 1, x, 0), n)
                step = np.divide(goal - full, part, out=np.zeros(n), where=part > 0)
                low = np.divide(goal, np.bincount(code, m * x, n), out=np.ones(n), where=own > 0)
                step = np.where(step > 0, step, low)
                step[all_of_it] = np.maximum(1, 1 / least[all_of_it])
                least[all_of_it] = 1
                x = np.clip(x * step[code], 1e-100, 1e100)
                if np.abs(step[(own > 0) & ~all_of_it] - 1).max(initial=0) < 1e-12:
                    break
        if worst < tolerance:
            break
    out[live] = calibrate(m, x, budget)
    return out


@dataclass(frozen=True)
class Mix:
    axes: list[Axis]
    codes: list[np.ndarray]
    mass: np.ndarray
    probability: np.ndarray


def tempered(shares: np.ndarray, power: float) -> np.ndarray:
    raised = np.where(shares > 0, shares, 0) ** power
    return raised / raised.sum() if raised.sum() else shares


def label(docs: DataFrame, topics: int = 8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (id, source, lang, tokens, topic): tokens are words; null labels become '(none)'."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in AXES[:2]]
    plain = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), *named)
    kind = plain.schema["id"].dataType.simpleString()
    rows = stored(plain.mapInArrow(_vectors, f"id {kind}, source string, lang string, tokens bigint, v binary"), "features")
    centres = fit_topics(rows, topics)
    rows = rows.mapInArrow(
        partial(_label, centres=centres), f"id {kind}, source string, lang string, tokens bigint, topic string"
    )
    return stored(rows, "labelled")


def mix(labelled: DataFrame, budget: float, power: Mapping[str, float], targets: Mapping[str, Mapping[str, float]] | None = None):
    """(rows, Mix): labelled with weight, probability and sampled.

    budget: share of all tokens to keep. targets: wanted token share of each value of an axis;
    an axis without has its shares raised to ``power``. A value with fewer tokens than its target
    asks for is kept whole and the others of its axis share the rest in proportion to their
    targets; Mix has the target, the goal and what is expected to be kept of each value. All
    values are raked; the driver holds labels and a few numbers for each (source, lang, topic)
    that occurs. A row is kept if a hash of its id is
    below its cell's probability: rows of one id fare alike, and null ids as one. Rows without
    tokens have no weight of their own and take their cell's probability.
    """
    cells = labelled.groupBy(*AXES).agg(F.sum("tokens").alias("t")).toArrow()
    cells = cells.sort_by([(k, "ascending") for k in AXES])
    codes, names = [], []
    for k in AXES:
        values = cells.column(k).combine_chunks().dictionary_encode()
        codes.append(values.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        names.append(values.dictionary.to_pylist())
    mass = cells.column("t").to_numpy().astype(float)
    some = mass > 0
    kept = budget * mass.sum()
    wanted, live = [], some
    for a, axis in enumerate(AXES):
        own = np.bincount(codes[a], mass, len(names[a]))
        given = (targets or {}).get(axis)
        target = np.array([given.get(v, 0.0) for v in names[a]], float) if given else tempered(own / max(own.sum(), 1), power[axis])
        target = np.where(own > 0, target, 0)
        wanted.append(target / target.sum() if target.sum() else own / max(own.sum(), 1))
        live = live & (wanted[a][codes[a]] > 0)
    kept = min(kept, mass[live].sum())
    goals = [fill(np.bincount(codes[a], mass * live, len(names[a])), wanted[a], kept) for a in range(3)]
    probability = np.full(len(mass), budget)
    weight = np.ones(len(mass))
    if some.any():
        probability[some] = rake_within([c[some] for c in codes], mass[some], goals, kept)
        weight[some] = probability[some] * mass.sum() / max(1e-300, (probability * mass).sum())
    axes = [
        Axis(names[a], wanted[a], goals[a], np.bincount(codes[a], mass * probability, len(names[a]))) for a in range(3)
    ]
    spark = labelled.sparkSession
    fields = ", ".join(f"__c{a} string" for a in range(3))
    found = []
    for first in range(0, max(len(mass), 1), RATES_A_PLAN):
        part = slice(first, first + RATES_A_PLAN)
        table = list(zip(*[cells.column(k)[part].to_pylist() for k in AXES], weight[part].tolist(), probability[part].tolist(), strict=True))
        found.append(stored(small_table(spark, table, f"{fields}, weight double, probability double"), "rates"))
    rates = reduce(DataFrame.union, found)
    same = [F.col(k) == F.col(f"__c{a}") for a, k in enumerate(AXES)]
    u = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 52)) / (1 << 52)
    rows = labelled.join(rates, same[0] & same[1] & same[2], "left")
    rows = rows.withColumn("sampled", u < F.col("probability")).drop("__c0", "__c1", "__c2")
    return rows, Mix(axes, codes, mass, probability)
