"""Decontamination, ranked search and whitening against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import no_docs, odd_docs

from retailmart.llm import contamination, ranking, whitening
from retailmart.llm.common import shared_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


# ------------------------------------------------------------------------ decontamination


def brute_contamination(docs, items, window, shingle, percent):
    """{doc: (words, hit words, items)}"""
    units = []
    for name, text in items:
        w = terms(text)
        for i in range(max(len(w) - window + 1, min(len(w), 1))):
            units.append((name, w[i : i + window]))
    found = {}
    for doc, text in docs:
        w, hit, names = terms(text), set(), set()
        for name, u in units:
            k = min(shingle, len(u))
            m = len(u) - k + 1
            for s in range(len(w) - len(u) + 1):
                same = sum(w[s + j : s + j + k] == u[j : j + k] for j in range(m))
                if 100 * same >= percent * m:
                    hit |= set(range(s, s + len(u)))
                    names.add(name)
        found[doc] = (len(w), len(hit), sorted(map(str, names)))
    return found


def benchmark_case(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(rng.choice([1, 3, 4, 9, 10, 11, 25]))) for i in range(12)]
    items += [(100, "a b a b a b a b a b a b"), (101, "Über, ÜBER die x_1 Straße!"), (102, items[5][1])]
    docs = []
    for d in range(60):
        text = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            own = terms(rng.choice(items)[1])
            a = rng.randrange(len(own))
            part = own[a : a + rng.randint(1, 20)]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "other"
            text += [rng.choice([" ", ", ", "\n--"]).join(part).upper(), say(rng.randint(0, 8))]
        docs.append((d, " ".join(text)))
    docs += [(200, "b a b a b a b a b a b"), (201, "über die x 1 straße"), (202, "ÜBER über die x 1 straße")]
    return docs, items


@pytest.mark.parametrize(("window", "shingle", "percent"), [(10, 5, 100), (10, 3, 60), (6, 2, 75), (4, 6, 100)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_every_window_is_found(spark, monkeypatch, window, shingle, percent, broadcast):
    if not broadcast:
        monkeypatch.setattr(contamination, "BROADCAST_UNITS", 0)
    monkeypatch.setattr(contamination, "HITS_A_BATCH", 7)
    docs, items = benchmark_case(window)
    rows, spans, names = contamination.find_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"), window, shingle, percent,
    )
    found = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination.report(rows, spans, names).collect()}
    assert found == brute_contamination(docs, items, window, shingle, percent)
    assert any(hit for _, hit, _ in found.values()) and not all(hit for _, hit, _ in found.values())


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(contamination, "FILTER_BITS", 6)
    docs, items = benchmark_case(3)
    found = contamination.report(*contamination.find_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )).collect()
    assert {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found} == brute_contamination(docs, items, 10, 5, 100)


def test_hits_can_be_cut_out(spark):
    docs = spark.createDataFrame(
        [(1, "Say: ONE two, three four! end"), (2, "one two"), (3, None), (4, "é one-two-three-four, one two three four")],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    _, spans, _ = contamination.find_items(docs, items)
    found = {r["doc_id"]: r["text"] for r in contamination.without_hits(docs, spans, "[cut]").collect()}
    assert found == {1: "Say: [cut]! end", 2: "one two", 3: None, 4: "é [cut]"}


def test_contamination_on_odd_rows(spark):
    docs = odd_docs(spark).withColumn("item_id", F.lit(1)).withColumn("unit", F.lit("u"))
    items = spark.createDataFrame(
        [(1, "a b c", "x"), (1, "A b c", "y"), (None, "x y", "z"), (3, None, "z"), (4, "?", "z"), (5, "é Ü 漢字 A", None)],
        "item_id bigint, text string, k1 string",
    )
    found = contamination.report(*contamination.find_items(docs, items))
    rows = [(r["id"], r["n_words"], r["n_hit"], r["n_items"]) for r in found.collect()]
    long = 11971
    # only A-Z are lowered, so Ü is another word than ü; a no-break space is part of a word
    assert Counter(rows) == Counter(
        [(1, 6, 3, 1)] * 2 + [(2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, long, 0, 0), (6, long, 0, 0)]
        + [(None, 2, 2, 0), (None, 0, 0, 0), (7, 0, 0, 0), (8, 3, 0, 0)]
    )
    rows, spans, names = contamination.find_items(no_docs(spark), items)
    assert contamination.report(rows, spans, names).count() == 0
    rows, spans, names = contamination.find_items(docs, items.limit(0))
    assert {r["n_hit"] for r in contamination.report(rows, spans, names).collect()} == {0}
    assert contamination.without_hits(docs, spans).count() == docs.count()


# --------------------------------------------------------------------------------- search


def brute_ranking(docs, items, k):
    texts = [(d, terms(t)) for d, t in docs]
    texts = [(d, w) for d, w in texts if w]
    total, n_docs = sum(len(w) for _, w in texts), len(texts)
    df = Counter(t for _, w in texts for t in set(w))
    wanted = {}
    for name, text in items:
        wanted.setdefault(name, set()).update(terms(text))
    out = {}
    for name, own in wanted.items():
        scores = []
        for d, w in texts:
            tf = Counter(w)
            m = 10 + 90 * len(w) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in own & set(w)
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        if scores:
            out[name] = [(d, -s) for s, _, _, d in sorted(scores)[:k]]
    return out


def ranked(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert all([x[0] for x in rows] == list(range(1, len(rows) + 1)) for rows in found.values())
    return {name: [(d, s) for _, d, s in rows] for name, rows in found.items()}


def search_case(seed, docs=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    say = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(d, say(rng.choice([0, 1, 5, 30, 200]))) for d in range(docs)]
    rows += [(1000 - d, rows[d % 7][1]) for d in range(60)]  # copies: ties
    return rows, [(i, say(rng.choice([1, 4, 20]))) for i in range(25)] + [(90, "nowhere found"), (91, "w0")]


@pytest.mark.parametrize("k", [1, 10])
@pytest.mark.parametrize(("block", "pairs"), [(1 << 20, 100_000), (500, 100_000), (2000, 60)])
def test_search_finds_the_best(spark, monkeypatch, k, block, pairs):
    monkeypatch.setattr(ranking, "PAIRS_A_SET", pairs)
    # tasks read the module anew, so a block size is given to them through what they call
    search = ranking._search

    def with_block(batches, items, statistics, k, block=block):
        from retailmart.llm import ranking as own

        own.POSTINGS_A_BLOCK = block
        yield from search(batches, items, statistics, k)

    monkeypatch.setattr(ranking, "_search", with_block)
    docs, items = search_case(k)
    found = ranking.search(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"), k,
    )
    assert ranked(found) == brute_ranking(docs, items, k)


def test_reads_stop_before_the_lists_end():
    rng = np.random.default_rng(4)
    lists = []
    for _ in range(4):
        doc = rng.permutation(50_000)[:40_000]
        lists.append((doc, -np.sort(-rng.integers(1, 1000, 40_000))))
    exact = np.zeros(50_000, np.int64)
    for doc, add in lists:
        exact[doc] += add
    best = np.sort(exact)[::-1][9]
    able, scores, read = ranking.nra(lists, 50_000, 10, 0)
    assert set(np.flatnonzero(exact >= best)) <= set(able) and (scores == exact[able]).all()
    able, scores, read = ranking.nra(lists, 50_000, 10, int(exact.max()) + 1)
    assert not len(able) and read < 40_000


def test_search_on_odd_rows(spark):
    docs = odd_docs(spark).withColumn("rank", F.lit(1)).withColumn("item", F.lit("i"))
    items = spark.createDataFrame(
        [(1, "A b", 2.0), (1, "c", 1.0), (2, None, 0.0), (3, "", 0.0), (None, "x zz", 0.0), (4, "漢字 Ü", 0.0), (5, "w1 w2", 0.0)],
        "item_id bigint, text string, score double",
    )
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    found = ranked(ranking.search(docs, items))
    assert found == brute_ranking(rows, pairs, 10)
    assert [d for d, _ in found[1]] == [1, 1, 8] and found[None][0][0] is None
    assert ranking.search(no_docs(spark), items).count() == 0
    assert ranking.search(docs, items.limit(0)).collect() == []


# ------------------------------------------------------------------------------ whitening


def matrices():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    x = rng.standard_normal((90, 8))
    return {
        "random": rng.standard_normal((500, 40)),
        "repeated columns": np.hstack((x, x)),
        "equal values": q,
        "groups of equal values": q @ np.diag([1.0] * 15 + [0.01] * 15 + [1e-5] * 10) @ q.T,
        "nearly equal values": q @ np.diag([1 + 1e-9 * i for i in range(40)]) @ q.T,
        "graded": q @ np.diag(np.logspace(0, -7, 40)) @ q.T,
        "fewer rows than columns": rng.standard_normal((12, 30)),
        "triangle of ones": np.tril(np.ones((30, 30))),
        "zeros on the diagonal": np.diag([3.0, 0, 2, 0, 1]),
        "coupled pairs": np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
        "one row": rng.standard_normal((1, 6)),
        "zero": np.zeros((4, 4)),
        "one entry": np.array([[2.0]]),
    }


@pytest.mark.parametrize("name", matrices())
def test_singular_values_and_directions(name):
    a = matrices()[name]
    d = a.shape[1]
    r = np.zeros((d, d))
    r[: min(a.shape)] = np.linalg.qr(a, mode="r")
    squares, v = whitening.right_singular(r, d)
    true = np.zeros(d)
    true[: min(a.shape)] = np.linalg.svd(a, compute_uv=False) ** 2
    k = v.shape[1]
    assert k == (true > 1e-26 * max(true.max(), 1)).sum()
    assert np.abs(squares - true).max() <= 1e-13 * max(true.max(), 1)
    assert np.abs(v.T @ v - np.eye(k)).max(initial=0) < 1e-10
    assert np.abs(a.T @ (a @ v) - v * squares[:k]).max(initial=0) <= 1e-12 * max(true.max(), 1)


def test_dqds_keeps_small_singular_values():
    rng = np.random.default_rng(1)
    a, b = 10.0 ** rng.uniform(-12, 0, 25), 10.0 ** rng.uniform(-12, 0, 24)
    squares = whitening.squared_singular_values(a, b)
    assert len(squares) == 25 and (np.diff(squares) <= 0).all()
    # the determinant is the product of the diagonal, to high relative accuracy
    assert np.log(squares).sum() == pytest.approx(2 * np.log(a).sum(), abs=1e-11)


def brute_whitening(vectors):
    y = np.array([[math.floor(64 * c) for c in v] for v in vectors], float)
    n = len(y)
    centred = y - y.sum(0) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, y.sum(0), strict=True)) for row in y]
    return centred, e[::-1], u[:, ::-1], exact


@pytest.mark.parametrize("parts", [1, 50])
def test_whitening_matches_the_covariance(spark, parts):
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((700, 12)) * np.linspace(0.2, 30, 12) + 5).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(parts)
    found = whitening.whitened_components(frame, most=9).toPandas()
    centred, e, u, exact = brute_whitening(x)
    assert len(found) == 700 * 9 and set(found["n"]) == {700} and found["identity_error"].nunique() == 1
    assert found["identity_error"].max() < 1e-10
    for k, own in found.groupby("component"):
        own = own.sort_values("vec_id")
        true = centred @ u[:, k - 1] / np.sqrt(e[k - 1])
        sign = np.sign(true @ own["whitened"])
        assert np.abs(sign * own["whitened"].to_numpy() - true).max() < 1e-9
        assert np.abs(own["explained"] / (e[k - 1] / e.sum()) - 1).max() < 1e-9
        assert own["deviation"].tolist() == exact


def test_whitening_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i % 3), 7.0], 1.0) for i in range(30)]
    odd = [(40, None, 1.0), (41, [], 1.0), (42, [1.0, None, 2.0], 1.0), (43, [1.0, nan, 2.0], 1.0), (44, [inf, 1.0, 2.0], 1.0),
           (45, [1.0, 2.0], 1.0), (46, [1e300, 1.0, 2.0], 1.0), (None, [0.0, 0.0, 7.0], 1.0), (3, [3.0, 0.0, 7.0], 1.0)]
    schema = "vec_id bigint, embedding array<double>, whitened double"
    frame = spark.createDataFrame(good + odd, schema)
    found = whitening.whitened_components(frame, most=32).toPandas()
    usable = [v for _, v, _ in good] + [[0.0, 0.0, 7.0], [3.0, 0.0, 7.0]]
    assert set(found["n"]) == {32} and set(found["component"]) == {1, 2}  # the third entry never changes
    assert len(found) == 64 and found["vec_id"].isna().sum() == 2 and (found["vec_id"] == 3).sum() == 4
    assert sorted(found[found["component"] == 1]["deviation"]) == sorted(brute_whitening(usable)[3])
    assert found["identity_error"].max() < 1e-10 and abs(found.drop_duplicates("component")["explained"].sum() - 1) < 1e-12
    for empty in (frame.limit(0), frame.where("vec_id >= 40"), frame.where("vec_id = 1"), spark.createDataFrame([good[0]] * 3, schema)):
        none = whitening.whitened_components(empty)
        assert none.count() == 0 and none.columns == found.columns.tolist()


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + i), 2.0**50, -float(i * i)]) for i in range(6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["deviation"] for r in whitening.whitened_components(frame).where("component = 1").collect()}
    assert found == dict(enumerate(brute_whitening([v for _, v in rows])[3]))
    far = spark.createDataFrame([(0, [2.0**55, 0.0]), (1, [0.0, 1.0]), (2, [-(2.0**55), 0.0])], "vec_id bigint, embedding array<double>")
    assert {r["deviation"] for r in whitening.whitened_components(far).where("vec_id <> 1").collect()} == {None}


@pytest.mark.parametrize(("master", "fine"), [("local[2]", True), ("yarn", False), ("spark://host:7077", False)])
def test_a_cluster_must_name_its_shared_folder(master, fine):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master, applicationId=f"a-{master}")
    )
    if fine:
        assert shared_folder(session) == shared_folder(session)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session)
