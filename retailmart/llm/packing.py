"""Best-fit packing of documents into sequences by the linear grouping scheme.

Large pieces, ordered by length, form groups of equal cardinality and are rounded up to the
longest of their group. Configurations of these few sizes are chosen, each used as often as the
groups allow; the actual pieces take the places of their group in order of length. What room
the sequences then really have is filled with the small pieces, largest first, each into the
tightest room. The driver sees only how many pieces have each length and how many sequences
have each room, at most ``capacity`` numbers; pieces find their place by their rank.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailmart.llm.common import gapless, small_table, stored
from retailmart.llm.workers import CACHES, lean, parts

CAPACITY = 2048
GROUPS = 384
MEMO_PARTS = 300_000  # parts of text whose ids a worker remembers before it starts anew
PART_BYTES = 1 << 22  # of text whose ids a task holds at a time
END_ID = 0


class Ids:
    """The ids of a byte-level BPE vocabulary, by text.

    The ids are those of the tokenizer file. A space after another character than white space
    always begins a new word there, so the ids of the parts from one such space to the next
    are joined, and a part met before is not encoded again.
    """

    def __init__(self, json_file: str, rank_file: str, pattern: str, special: tuple[str, ...]):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_file)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.memo: dict[str, bytes] = {}
        self.whole = re.compile(r"\s ")

    def _encode(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text, and END_ID."""
        if self.special.search(text):
            return np.array([*self.exact.encode(text, add_special_tokens=False).ids, END_ID], "<u4").tobytes()
        if self.whole.search(text):
            return self._encode(text) + bytes(4)
        memo, out = self.memo, []
        first, *rest = text.split(" ")
        out.append(self._encode(first))
        for part in rest:
            ids = memo.get(part)
            if ids is None:
                if len(memo) >= MEMO_PARTS:
                    memo.clear()
                ids = memo[part] = self._encode(" " + part)
            out.append(ids)
        out.append(bytes(4))
        return b"".join(out)


@lru_cache(maxsize=1)
def _ids(json_file: str, rank_file: str, pattern: str, special: tuple[str, ...]) -> Ids:
    return Ids(json_file, rank_file, pattern, special)


CACHES.append(_ids)


@partial(lean, keep=_ids)
def _piece_rows(batches, files: tuple, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = _ids(*files)
    for batch in parts(batches, 1, PART_BYTES):
        rows, piece, start, length, ids = [], [], [], [], []
        for r, text in enumerate(batch.column(1).to_pylist()):
            own = encode(text or "")
            n = len(own) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                rows.append(r)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                ids.append(own[4 * a : 4 * b])
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])


def pieces(docs: DataFrame, files: tuple, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id column, piece, start, length, ids): the ids of every document, ended by END_ID.

    files: tokenizer JSON, the same vocabulary as ranks, its split pattern, its special strings.
    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity`` of which the
    first may be shorter. A null text counts as empty and gives one piece. Equal rows come back
    as often as they came, null ids with them; other columns are not read.
    """
    plain = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = plain.mapInArrow(
        partial(_piece_rows, files=files, capacity=capacity),
        f"id {kind}, piece int, start bigint, length bigint, ids binary",
    )
    return rows.withColumnRenamed("id", id)


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (size: how many) and how often each is used, until all counts are used up.

    Each holds the largest size left and, of all fillings of the rest of its room with sizes
    left, one of the fullest.
    """
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n}
    used = []
    while left:
        largest = next(iter(left))
        room = capacity - largest
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        for size in reversed(left):
            if size > room:
                break
            own = left[size] - (size == largest)
            for _ in range(min(own, room // size)):
                wider = (reach | reach << size) & mask
                if wider == reach:
                    break
                steps.append((size, reach))
                reach = wider
        config = {largest: 1}
        total = reach.bit_length() - 1
        for size, before in reversed(steps):
            if not before >> total & 1:
                config[size] = config.get(size, 0) + 1
                total -= size
        times = min(left[s] // n for s, n in config.items())
        for s, n in config.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        used.append((config, times))
    return used


def plan_large(histogram: dict[int, int], capacity: int, groups: int) -> tuple[np.ndarray, int]:
    """(rows, sequences). rows: first rank, places a sequence has for this group, first sequence;
    a piece of rank q, by falling length, has the sequence first + (q - rank) // places."""
    lengths = sorted(histogram, reverse=True)
    total = sum(histogram.values())
    if not total:
        return np.zeros((0, 3), np.int64), 0
    each = -(-total // groups)
    sizes: dict[int, int] = {}
    first: dict[int, int] = {}
    rank = seen = 0
    places = iter(lengths)
    length = next(places)
    while rank < total:  # one round for each group
        while rank >= seen + histogram[length]:
            seen += histogram[length]
            length = next(places)
        sizes[length] = sizes.get(length, 0) + min(each, total - rank)
        first.setdefault(length, rank)
        rank += each
    rows, sequences = [], 0
    for config, times in configurations(sizes, capacity):
        for size, n in config.items():
            rows.append((first[size], n, sequences))
            first[size] += n * times
        sequences += times
    return np.array(sorted(rows), np.int64), sequences


def plan_small(histogram: dict[int, int], rooms: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit, largest first: rows of length, first rank, room (-1: a new sequence) and first
    rank among the sequences of that room; ranks go on side by side."""
    open_at: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if n and r}
    order = sorted(open_at)
    rows, fresh = [], 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if not room:
            return
        if room not in open_at:
            open_at[room] = []
            order.insert(bisect_left(order, room), room)
        open_at[room].append(run)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                n = -(-left // (capacity // length))
                put(capacity, (-1, fresh, fresh + n))
                fresh += n
                continue
            room = order[at]
            kind, a, b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                order.pop(at)
            n = min(left, b - a)
            if n < b - a:
                put(room, (kind, a + n, b))
            rows.append((length, rank, kind, a))
            put(room - length, (kind, a, a + n))
            rank += n
            left -= n
    return np.array(rows, np.int64).reshape(-1, 4)


def _histogram(df: DataFrame, column: str) -> dict[int, int]:
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


@partial(lean, keep=_ids)
def _find(batches, keys: np.ndarray, values: np.ndarray, small: bool) -> Iterator[pa.RecordBatch]:
    """Add what the plan says for each rank: (sequence) of large, (room, room_rank) of small ones."""
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        rank = at["__rank"].to_numpy()
        if small:
            key = at["length"].to_numpy() * (1 << 40) + rank
            row = np.searchsorted(keys, key, "right") - 1
            extra = {"room": values[row, 2], "room_rank": values[row, 3] + rank - values[row, 1]}
        else:
            row = np.searchsorted(keys, rank, "right") - 1
            extra = {"sequence_id": values[row, 2] + (rank - values[row, 0]) // values[row, 1]}
        out = {**{k: v for k, v in at.items() if k != "__rank"}, **{k: pa.array(v) for k, v in extra.items()}}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{c} bigint" for c in more])


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> DataFrame:
    """rows with sequence_id and offset: pieces of ``length`` tokens, 1 to capacity, put into few
    sequences of at most ``capacity`` tokens. rows should be stored, as they are read several times.

    Pieces of at most ``small`` tokens (an eighth of the capacity) are best-fitted last. order:
    columns that rank equal lengths; rows equal in these are interchangeable. offset is the
    place in the sequence, from 0 without gaps. Columns sequence_id and offset are replaced; an
    empty table gives no rows.
    """
    spark = rows.sparkSession
    small = capacity // 8 if small is None else small
    rows = rows.drop("sequence_id", "offset")
    histogram = _histogram(rows, "length")
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a piece is longer than a sequence, or empty")
    lengths = sorted((n for n in histogram if n > small), reverse=True)
    before = dict(zip(lengths, np.cumsum([0, *(histogram[n] for n in lengths)]).tolist()[:-1], strict=True))
    plan, sequences = plan_large({n: histogram[n] for n in lengths}, capacity, groups)

    starts = small_table(spark, [(n, b) for n, b in before.items()], "__length bigint, __before bigint")
    large = gapless(rows.where(F.col("length") > small), ["length"], order, "__rank")
    large = large.join(F.broadcast(starts), F.col("length") == F.col("__length"))
    large = large.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__length", "__before")
    placed = large.mapInArrow(
        partial(_find, keys=plan[:, 0].copy(), values=plan, small=False), _schema(rows, "sequence_id")
    )
    placed = stored(placed, "large")

    filled = placed.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room"))
    filled = stored(filled, "rooms")
    lanes = gapless(filled, ["room"], ["sequence_id"], "__lane")
    few = {n: c for n, c in histogram.items() if n <= small}
    fit = plan_small(few, _histogram(filled, "room"), capacity)
    fit = fit[np.lexsort((fit[:, 1], fit[:, 0]))]
    ranked = gapless(rows.where(F.col("length") <= small), ["length"], order, "__rank")
    found = ranked.mapInArrow(
        partial(_find, keys=fit[:, 0] * (1 << 40) + fit[:, 1], values=fit, small=True), _schema(rows, "room", "room_rank")
    )
    lanes = lanes.select(F.col("room").alias("__room"), F.col("__lane"), "sequence_id")
    found = found.join(lanes, (F.col("room") == F.col("__room")) & (F.col("room_rank") == F.col("__lane")), "left")
    found = found.withColumn("sequence_id", F.coalesce("sequence_id", sequences + F.col("room_rank")))
    together = placed.unionByName(found.drop("room", "room_rank", "__room", "__lane"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    return together.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
