"""Quality by weak supervision: rules vote good, bad or abstain; expectation-maximisation
estimates how often each is right; the posterior probability of good decides.

The votes of all documents are counted by pattern (at most 3^rules patterns), so that the
model is fitted to the whole corpus with one small aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailmart.llm.common import stored
from retailmart.llm.words import windows, words_of

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct", "n_lines"]
BLANK = b" \t\n\x0b\x0c\r"


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _MARK, _UPPER = _flags(SYMBOLS), _flags(b"!?"), _flags(bytes(range(65, 91)))
_CODE_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])
_BLANK = _flags(BLANK)


def repeated(grams: np.ndarray, words: int) -> int:
    """Words covered by windows that stand in the text twice or more."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def lines_of(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [line for line in text.split(b"\n") if line.strip(BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list] = {c: [] for c in LONGS}
        for chunk in words_of(batch.column(1)):
            bounds, cuts, data = chunk.bounds(), chunk.cuts, chunk.data

            def by_row(flags, cuts=cuts):
                return np.diff(np.concatenate(([0], np.cumsum(flags)))[cuts]).tolist()

            grams = windows(chunk.hash, WINDOW)
            found["n_words"] += np.diff(bounds).tolist()
            found["word_chars"] += by_row(_CODE_POINT[data] & ~_BLANK[data])
            found["n_symbols"] += by_row(_SYMBOL[data])
            found["n_upper"] += by_row(_UPPER[data])
            found["n_marks"] += by_row(_MARK[data])
            for r in range(chunk.rows):
                a, b = int(bounds[r]), int(bounds[r + 1])
                found["n_repeat_words"].append(repeated(grams[a : max(a, b - WINDOW + 1)], b - a))
                found["n_distinct"].append(len(np.unique(chunk.hash[a:b])))
                lines, equal = lines_of(data[cuts[r] : cuts[r + 1]].tobytes())
                found["n_lines"].append(lines)
                found["n_dup_lines"].append(equal)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(found[c], pa.int64()) for c in LONGS)], ["id", *LONGS]
        )


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the counts of LONGS of each whole text; null counts as empty."""
    plain = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(_rows, f"id {kind}, " + ", ".join(f"{c} bigint" for c in LONGS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """1 good, 0 bad, -1 abstain; a rule without enough words abstains."""
    n, c = F.col("n_words"), F.col
    enough = n >= 10
    return {
        "length": _vote(n >= 40, n < 15),
        "word_length": _vote(enough & c("word_chars").between(3 * n, 9 * n), enough & ((c("word_chars") < 2 * n) | (c("word_chars") > 14 * n))),
        "symbols_per_word": _vote(enough & (20 * c("n_symbols") <= n), 4 * c("n_symbols") > n),
        "symbols_per_char": _vote(enough & (100 * c("n_symbols") <= c("word_chars")), 20 * c("n_symbols") > c("word_chars")),
        "marks": _vote(enough & (20 * c("n_marks") <= n), 2 * c("n_marks") > n),
        "capitals": _vote(enough & (5 * c("n_upper") <= c("word_chars")), enough & (2 * c("n_upper") > c("word_chars"))),
        "lines": _vote((c("n_lines") >= 3) & (c("n_dup_lines") == 0), 3 * c("n_dup_lines") > c("n_lines")),
        "repeats": _vote(enough & (20 * c("n_repeat_words") <= n), 4 * c("n_repeat_words") > n),
        "variety": _vote((n >= 40) & (4 * c("n_distinct") > n), (n >= 15) & (5 * c("n_distinct") < n)),
    }


@dataclass(frozen=True)
class VoteModel:
    """good: share of good documents; right_good, right_bad: how often a vote on a good or bad
    document is right, for each rule."""

    good: float
    right_good: np.ndarray
    right_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        if not len(votes):
            return np.zeros(0)
        odds = np.full(len(votes), np.log(self.good) - np.log1p(-self.good))
        odds += ((votes == 1) * (np.log(self.right_good) - np.log1p(-self.right_bad))).sum(1)
        odds += ((votes == 0) * (np.log1p(-self.right_good) - np.log(self.right_bad))).sum(1)
        return 1 / (1 + np.exp(-odds))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over vote patterns with counts.

    A rule looks for one fault: it is seldom bad on a good document (right_good is at least 0.9)
    but may say good of a document that has another fault (right_bad can be small). The start
    and that bound keep good from changing places with bad.
    """
    k = votes.shape[1]
    model = VoteModel(0.8, np.full(k, 0.99), np.full(k, 0.4))
    for _ in range(rounds):
        p = model.posterior(votes) * counts
        q = counts - p
        good, bad = votes == 1, votes == 0
        right_good = (p @ good + 9.9) / (p @ (good | bad) + 10)
        right_bad = (q @ bad + 4) / (q @ (good | bad) + 10)
        share = (p.sum() + 8) / (counts.sum() + 10)
        fresh = VoteModel(float(share), np.clip(right_good, 0.9, 1 - 1e-4), np.clip(right_bad, 0.02, 1 - 1e-4))
        moved = max(abs(fresh.good - model.good), np.abs(fresh.right_good - model.right_good).max(initial=0))
        model = fresh
        if moved < tolerance:
            break
    return model


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, VoteModel]:
    """(rows, model). rows: id, the counts, vote_<rule> for each rule, and quality, the posterior
    probability of good.

    Null texts count as empty: most rules abstain on them. Equal rows come back as often as they
    came, null ids with them; other columns are not read. An empty table gives no rows.
    """
    voted = rules()
    rows = stored(measures(docs, id, text).withColumns({f"vote_{k}": v for k, v in voted.items()}), "votes")
    names = [f"vote_{k}" for k in voted]
    patterns = rows.groupBy(*names).count().collect()  # at most 3^rules
    votes = np.array([[r[c] for c in names] for r in patterns]).reshape(-1, len(names))
    model = fit(votes, np.array([r["count"] for r in patterns], float))
    odds = F.lit(float(np.log(model.good) - np.log1p(-model.good)))
    for c, a, b in zip(names, model.right_good, model.right_bad, strict=True):
        yes, no = float(np.log(a) - np.log1p(-b)), float(np.log1p(-a) - np.log(b))
        odds = odds + F.when(F.col(c) == 1, yes).when(F.col(c) == 0, no).otherwise(0.0)
    return rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumnRenamed("id", id), model
