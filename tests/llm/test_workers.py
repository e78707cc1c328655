"""What a task holds at a time, and what it leaves in its Python worker."""

import tracemalloc
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from retailmart.llm import jaccard, mixing, packing, pii, workers
from retailmart.llm.queries import tokenizer_files

TEXTS = [None if k % 7 == 0 else f"w{k} call 555-{k:07d} or a{k}@b.org " * (k % 40) for k in range(300)]


def documents(rows=300):
    said = [TEXTS[k % 300] for k in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(said, pa.string())], ["id", "text"])


def labelled(rows=300):
    own = [pa.array([f"x{k % 3}" for k in range(rows)])] * 2
    return pa.RecordBatch.from_arrays([*documents(rows).columns, *own], ["id", "text", "source", "lang"])


def vectors(rows):
    rng = np.random.default_rng(3)
    made = [v.tobytes() for v in rng.random((rows, mixing.FEATURES)).astype(np.float32)]
    return pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["v"])


def batch_of(name):
    return labelled() if name == "vectors" else documents()


OPERATORS = {
    "vectors": (mixing, mixing._vectors),
    "pseudonyms": (pii, partial(pii._rows, key=b"k", place=1)),
    "pieces": (packing, partial(packing._piece_rows, files=tokenizer_files(), capacity=64)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_made_of_parts_and_whole(monkeypatch, name):
    module, operator = OPERATORS[name]
    monkeypatch.setattr(module, "PART_BYTES", 1 << 30)
    if module is mixing:
        monkeypatch.setattr(module, "PART_ROWS", 1 << 30)
    whole = list(operator(iter([batch_of(name).slice(5)])))
    monkeypatch.setattr(module, "PART_BYTES", 2000)
    some = list(operator(iter([batch_of(name).slice(5), batch_of(name).slice(0, 0)])))
    assert len(whole) == 1 and len(some) > 50
    assert pa.Table.from_batches(some).equals(pa.Table.from_batches(whole))


def test_parts_by_rows():
    parts = list(workers.parts([documents()], 1, 1 << 30, 64))
    assert [p.num_rows for p in parts] == [64, 64, 64, 64, 44]
    assert pa.Table.from_batches(parts).to_pylist() == documents().to_pylist()


def test_topic_sums_and_labels_hold_few_vectors_at_a_time():
    """Ten thousand vectors of a batch were held as doubles and as whole numbers at once."""
    batch, centres = vectors(10_000), np.random.default_rng(4).random((8, mixing.FEATURES))
    tracemalloc.start()
    sums = pa.Table.from_batches(mixing._topic_sums(iter([batch]), centres))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    x = mixing._matrix(batch.column(0))
    best, units = mixing._nearest(x, centres), np.rint(x.astype(np.float64) * mixing.UNIT).astype(np.int64)
    wanted = np.stack([units[best == k].sum(0) for k in range(8)])
    got = np.zeros_like(wanted)
    got[sums["topic"].to_numpy(), sums["place"].to_numpy()] = sums["sum"].to_numpy()
    assert (got == wanted).all()


def test_a_task_of_another_operator_lets_go_of_the_tokenizers():
    """The vocabulary and 300,000 remembered parts stayed in the worker for its whole life."""
    list(packing._piece_rows(iter([documents()]), tokenizer_files(), 64))
    list(packing._piece_rows(iter([documents()]), tokenizer_files(), 64))
    assert packing._ids.cache_info().currsize == 1 and packing._ids.cache_info().hits > 0
    list(jaccard._full_rows(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"])], ["node", "text"])]), 2))
    assert packing._ids.cache_info().currsize == 0


def test_freed_memory_is_given_back_before_and_after_a_task(monkeypatch):
    said = []
    monkeypatch.setattr(workers, "give_back", lambda: said.append("back"))

    @workers.lean
    def rows(batches):
        for batch in batches:
            said.append(batch)
            yield batch

    assert list(rows([1, 2])) == [1, 2] and said == ["back", 1, 2, "back"]
