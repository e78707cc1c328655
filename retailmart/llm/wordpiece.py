"""Greedy word-piece lengths in time linear in the text, by a longest-match automaton.

A trie of the vocabulary gets a failure link for every node: where matching goes on once the
pieces that end for certain are popped. As only lengths are asked for, a node holds the number
of pieces popped on its link; no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailmart.llm.words import text_buffers

WORD_START = "▁"
MEMO_WORDS = 400_000  # words whose length a worker remembers before it starts anew


class LongestMatch:
    """Number of pieces of the greedy longest-match split; None if the word can't be split."""

    def __init__(self, pieces: Iterable[str]):
        children: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for char in piece:
                after = children[node].get(char)
                if after is None:
                    after = children[node][char] = len(children)
                    children.append({})
                    ends.append(False)
                node = after
            ends[node] = node != 0
        link: list[int | None] = [None] * len(children)
        popped = [0] * len(children)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for char, after in children[node].items():
                queue.append(after)
                if ends[after]:
                    link[after], popped[after] = 0, 1
                    continue
                at, count = link[node], popped[node]
                while at is not None and char not in children[at]:
                    count += popped[at]
                    at = link[at]
                if at is not None:
                    link[after], popped[after] = children[at][char], count
        self.children, self.link, self.popped = children, link, popped

    def length(self, word: str) -> int | None:
        children, link, popped = self.children, self.link, self.popped
        node: int | None = 0
        count = 0
        for char in word:
            while char not in children[node]:
                count += popped[node]
                node = link[node]
                if node is None:
                    return None
            node = children[node][char]
        while node:
            count += popped[node]
            node = link[node]
        return None if node is None else count


@lru_cache(maxsize=2)
def _automaton(model_file: str) -> LongestMatch:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = (model.IsControl, model.IsUnknown, model.IsByte, model.IsUnused)
    return LongestMatch(model.IdToPiece(i) for i in range(model.GetPieceSize()) if not any(f(i) for f in special))


@lru_cache(maxsize=1)
def _memo(model_file: str) -> dict[bytes, int]:
    return {}


def _rows(batches, model_file: str) -> Iterator[pa.RecordBatch]:
    automaton, memo = _automaton(model_file), _memo(model_file)
    for batch in batches:
        cuts, data = text_buffers(batch.column(1))
        cuts = cuts.tolist()
        words, tokens, unknown = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = data[a:b].tobytes().split()  # bytes split at ASCII white space
            total = missed = 0
            for word in own:
                n = memo.get(word)
                if n is None:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    n = memo[word] = automaton.length(WORD_START + word.decode("utf-8", "replace")) or -1
                if n < 0:
                    missed += 1
                    n = 1
                total += n
            words.append(len(own))
            tokens.append(total)
            unknown.append(missed)
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_tokens", "n_unknown"])


def token_counts(docs: DataFrame, model_file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id column, n_words, n_tokens, n_unknown) of each whole text.

    Words are runs of other characters than ASCII white space; each is split greedily into the
    longest pieces of the vocabulary of ``model_file`` (its first piece carries the word-start
    mark), and counts as one unknown token if it can't be. Null counts as empty: 0 of each.
    Equal rows come back as often as they came; other columns are not read.
    """
    plain = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = plain.mapInArrow(
        partial(_rows, model_file=model_file), f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint"
    )
    return rows.withColumnRenamed("id", id)
