"""Each operator against a brute-force version, and on null, empty, equal and clashing rows."""

import datetime as dt
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retailmart.llm import chat, jaccard, language, mixing, packing, pii, quality, sharding, vectors, wordpiece
from retailmart.llm.common import components, stored
from retailmart.llm.queries import tokenizer_files

WORDS = [f"w{i}" for i in range(400)]


def texts(seed, n, low=0, high=60):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(low, high))) for _ in range(n)]


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and clashing extra columns."""
    long = " ".join(WORDS) * 30
    own = [(1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, long), (None, "x y"), (None, None)]
    own += [(1, "a b c d e f"), (7, "!"), (8, "é ü 漢字 a")]
    rows = [(i, t, None if k % 3 else "en", "s" if k % 2 else None, k, "v", 1.5) for k, (i, t) in enumerate(own)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, node double"
    return spark.createDataFrame(rows, names)


def no_docs(spark):
    return odd_docs(spark).limit(0)


def groups_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(500, 560)] + [(900, 900)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert found == groups_of([e for e in edges if e[0] != e[1]], nodes)


def brute_shards(sizes, shards):
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("bits", [1, 14])
def test_minimax_cuts_find_the_smallest_capacity(spark, monkeypatch, bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "MAX_BLOCKS", 64)
    rng = random.Random(bits)
    keys = sorted({rng.getrandbits(64) - (1 << 63) for _ in range(300)})
    sizes = [rng.randint(1, 900) for _ in keys]
    df = stored(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key bigint, bytes bigint"), "t")
    capacity, cuts = sharding.minimax_cuts(df, 7)
    assert capacity == brute_shards(sizes, 7)
    sums = Counter()
    for k, s in zip(keys, sizes, strict=True):
        sums[sum(k >= c for c in cuts)] += s
    assert len(cuts) < 7 and max(sums.values()) <= capacity


def test_shards_hold_groups_together_and_number_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 300) + ["hot"] * 900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 8)[0].collect()
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        text = rows[r["doc_id"]][1]
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        assert r["text_crc32"] == zlib.crc32(text.encode()) and r["size"] == len(text.encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = sharding.shard_documents(odd_docs(spark), 3)[0]
    assert odd.count() == 11 and odd.where("shard is null").count() == 0
    assert sharding.shard_documents(no_docs(spark), 3)[0].count() == 0


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 257):
        assert sorted(pii.feistel(v, size, b"k", "t") for v in range(size)) == list(range(size))


def test_pseudonyms_keep_format_checks_and_links(spark):
    text = (
        "mail bob.7@site.example.com card 4845168114407329 phone +1 (017) 555-7713 ip 97.51.17.173 day 2001-02-28"
        ' iban DE89 3704 0044 0532 0130 00 token = "04dbebab91a" no 4845168114407328 nor 31/31/2001'
    )
    fresh, counts = pii.pseudonymise(text, b"key")
    assert counts == dict.fromkeys(("email", "card", "phone", "ip", "date", "iban", "secret"), 1)
    for value in ("bob.7@", "4845168114407329", "555-7713", "97.51.17.173", "2001-02-28", "3704 0044", "04dbebab91a"):
        assert value not in fresh
    assert "4845168114407328" in fresh and "31/31/2001" in fresh
    again, more = pii.pseudonymise(fresh, b"other")
    assert more == counts  # pseudonyms pass the validation again
    assert pii.pseudonymise(text, b"key")[0] == fresh and pii.pseudonymise(text, b"k2")[0] != fresh
    card = pii.pseudonymise("4845168114407329", b"key")[0]
    assert card in fresh  # equal values stay linked
    got = pii.pseudonymise_documents(odd_docs(spark).withColumnRenamed("shard", "n_card"), b"k")
    assert got.count() == 11 and got.where("text is null").count() == 2 and dict(got.dtypes)["n_card"] == "bigint"
    assert pii.pseudonymise("a\x00b 97.51.17.173", b"k")[0].startswith("a\x00b ")
    assert pii.pseudonymise_documents(no_docs(spark), b"k").count() == 0


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        ("order 7 4111111111111111", "4111111111111111", "card"),
        ("4111111111111111 123", "4111111111111111", "card"),
        ("4111111111111111 12/26", "4111111111111111", "card"),
        ("no 12 4111 1111 1111 1111 99", "4111 1111 1111 1111", "card"),
        ("card 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
        ("card 3782 822463 10005 12", "3782 822463 10005", "card"),
        ("GB82 WEST 1234 5698 7654 32 EUR 500", "GB82 WEST 1234 5698 7654 32", "iban"),
        ("DE89370400440532013000 BIC COBADEFF", "DE89370400440532013000", "iban"),
        ("AB12 GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32", "iban"),
    ],
)
def test_values_are_found_beside_other_words_and_digits(text, value, kind):
    fresh, counts = pii.pseudonymise(text, b"key")
    assert counts == {kind: 1}
    alone = pii.pseudonymise(value, b"key")[0]
    assert alone != value and fresh == text.replace(value, alone)
    joined = pii.pseudonymise(value.replace(" ", ""), b"key")[0]
    assert alone.replace(" ", "") == joined  # spaced and unspaced forms stay linked


@pytest.mark.parametrize(
    ("kind", "forms", "plain"),
    [
        ("phone", ["555-123-4567", "555.123.4567", "(555) 123-4567", "555 123 4567"], lambda t: "".join(c for c in t if c.isdigit())),
        ("phone", ["+49 30 1234 5678", "+49 (30) 1234-5678", "+49.30.1234.5678"], lambda t: "".join(c for c in t if c.isdigit())),
        ("card", ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111.1111.1111.1111"], lambda t: "".join(c for c in t if c.isdigit())),
        ("iban", ["GB82WEST12345698765432", "gb82west12345698765432", "GB82 WEST 1234 5698 7654 32", "gb82 west 1234 5698 7654 32"], lambda t: t.replace(" ", "").upper()),
        ("email", ["A.B@c-host.com", "a.b@c-host.com", "a.B@C-HOST.com"], str.lower),
        ("date", ["2020-01-05", "2020-01-05T10:00:00", "2020-01-05T1000Z", "2020-01-05 10:00"], lambda t: t[:10]),
    ],
)
def test_one_value_in_many_forms_has_one_pseudonym(kind, forms, plain):
    made = set()
    for form in forms:
        fresh, counts = pii.pseudonymise(f"see {form}, or not", b"key")
        assert counts == {kind: 1} and fresh.startswith("see ") and fresh.endswith(", or not")
        fresh = fresh[4:-8]
        assert len(fresh) == len(form) and [c.isalnum() for c in fresh] == [c.isalnum() for c in form]
        assert plain(fresh) != plain(form)
        made.add(plain(fresh))
    assert len(made) == 1


def test_values_of_a_format_are_permuted_one_to_one():
    """All of a format's small values against each other: none is met twice, none stays without reason."""
    days = [(dt.date(1999, 1, 1) + dt.timedelta(days=k)).isoformat() for k in range(4000)]
    assert len({pii.pseudonymise(day, b"key")[0] for day in days}) == 4000
    phones = [f"555-{k:03d}-{k * 7 % 10000:04d}" for k in range(1000)]
    fresh = [pii.pseudonymise(p, b"key")[0] for p in phones]
    assert len(set(fresh)) == 1000 and sum(a == b for a, b in zip(phones, fresh, strict=True)) <= 1
    for text in ("version 3.1415926535897932", "at 2020-01-05Tomorrow", "4111.1111.1111.1112", "xx82west12345698765432", "1.2.3.4.5"):
        assert pii.pseudonymise(text, b"key") == (text, Counter())


def test_phones_side_by_side_and_dates_of_equal_parts():
    fresh, counts = pii.pseudonymise("call 555 123 4567 555 987 6543", b"key")
    assert counts == {"phone": 2}
    for day in ("5/5/2020", "12.12.2020", "5-5-2020", "1/31/2020"):
        fresh, counts = pii.pseudonymise(day, b"key")
        assert counts == {"date": 1} and pii.pseudonymise(fresh, b"other")[1] == {"date": 1}
    assert pii.pseudonymise("5/5/2020", b"key")[0] == pii.pseudonymise("05/05/2020", b"key")[0]


def test_pseudonyms_of_long_and_multilingual_texts():
    many = "97.51.17.173 " * 140_000
    fresh, counts = pii.pseudonymise(many, b"key")
    assert counts == {"ip": 140_000} and set(fresh.split()) == {pii.pseudonymise("97.51.17.173", b"key")[0]}
    shape = "٠١٢-٣٤-٥٦٧٨ ٢٠٠١-٠٢-٢٨ ٩٧.٥١.١٧.١٧٣ +٤٩ ٣٠ ١٢٣٤ ٥٦٧٨"
    fresh, counts = pii.pseudonymise(f"{shape} bob@site.example.com", b"key")
    assert fresh.startswith(shape) and counts == {"email": 1}
    secret = "".join(random.Random(0).choices("abcdefghij0123456789", k=9000))
    fresh, counts = pii.pseudonymise(f"token={secret}", b"key")
    assert counts == {"secret": 1} and len(fresh) == len(f"token={secret}")
    assert all(fresh[6 + k : 14 + k] != secret[k : k + 8] for k in range(8993))


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(0)
    mass = rng.uniform(1, 9, (4, 3, 2))
    targets = [np.array([4, 3, 2, 1.0]) / 10, np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    out = mixing.rake(mass, targets)
    for axis, target in enumerate(targets):
        others = tuple(a for a in range(3) if a != axis)
        assert np.allclose(out.sum(others), target, atol=1e-8)
    p = mixing.calibrate(mass, out / mass, 0.4 * mass.sum())
    assert abs((p * mass).sum() - 0.4 * mass.sum()) < 1e-6 and p.max() <= 1


def test_raking_within_bounds_meets_the_marginals():
    rng = np.random.default_rng(1)
    source = np.array([1 / 3, *[2 / 57] * 19])
    lang = np.array([0.6, 0.17, 0.15, 0.08])
    mass = (source[:, None, None] * lang[:, None] * np.full(8, 1 / 8)) * rng.uniform(0.5, 1.5, (20, 4, 8)) * 1e6
    codes = [c.ravel() for c in np.indices(mass.shape)]
    sums = [mass.sum(tuple(b for b in range(3) if b != a)) for a in range(3)]
    for power, budget in ((0.7, 0.8), (0.7, 0.7), (0.5, 0.5), (0.7, 1.0)):
        kept = budget * mass.sum()
        targets = [mixing.tempered(s / s.sum(), power) for s in sums]
        goals = [mixing.fill(s, t, kept) for s, t in zip(sums, targets, strict=True)]
        p = mixing.rake_within(codes, mass.ravel(), goals, kept)
        assert 0 <= p.min() and p.max() <= 1 and abs((p * mass.ravel()).sum() / kept - 1) < 1e-9
        for a in range(3):
            real = np.bincount(codes[a], p * mass.ravel())
            assert np.abs(real - goals[a]).max() < 1e-4 * kept
            short = sums[a] < goals[a] * (1 + 1e-9)  # kept whole; the others in proportion
            ratio = goals[a][~short] / targets[a][~short]
            assert short.all() or np.allclose(ratio, ratio[0])
            assert (goals[a][short] <= ratio.max(initial=np.inf) * targets[a][short]).all()
    goals = [mixing.fill(s, mixing.tempered(s / s.sum(), 0.3), 0.8 * mass.sum()) for s in sums]  # these contradict each other
    p = mixing.rake_within(codes, mass.ravel(), goals, 0.8 * mass.sum())
    assert abs((p * mass.ravel()).sum() / mass.sum() - 0.8) < 1e-9 and p.max() <= 1
    loose = mixing.rake_within(codes, mass.ravel(), [t * mass.sum() * 0.1 for t in targets], 0.1 * mass.sum())
    assert np.allclose(loose * mass.ravel() / mass.sum() / 0.1, mixing.rake(mass, targets).ravel(), atol=1e-8)


def test_mix_meets_its_targets_at_the_production_budget(spark):
    rng = random.Random(6)
    langs, sources = ["en"] * 12 + ["fr"] * 4 + ["de"] * 3 + ["it"], ["hot"] * 10 + [f"s{k}" for k in range(20)]
    rows = [(i, t, rng.choice(langs), rng.choice(sources)) for i, t in enumerate(texts(3, 4000, 5))]
    labelled = mixing.label(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    got, mix = mixing.mix(labelled, 0.8, {"source": 0.7, "lang": 0.7, "topic": 0.8})
    total = mix.mass.sum()
    for axis in mix.axes:
        assert np.abs(axis.kept - axis.goal).max() < 1e-4 * total and abs(axis.goal.sum() / total - 0.8) < 1e-9
    got = got.toPandas()
    assert abs(got[got.sampled].tokens.sum() / got.tokens.sum() - 0.8) < 0.03


def test_topics_are_fitted_to_all_documents(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(11, 900, 20) + [f"q{k % 7} zz yy xx q{k % 5}" for k in range(100)])]
    docs = spark.createDataFrame(rows, "id bigint, text string, source string, lang string")
    features = stored(docs.mapInArrow(mixing._vectors, "id bigint, source string, lang string, tokens bigint, v binary"), "features")
    centres = mixing.fit_topics(features, 3, sample=60)
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in features.collect()]).astype(np.float64)
    best = mixing._nearest(x, centres)
    for k in np.unique(best):  # each centre is the mean direction of all documents nearest to it
        mean = x[best == k].sum(0)
        assert np.abs(centres[k] - mean / np.linalg.norm(mean)).max() < 0.02
    again = mixing.fit_topics(features.repartition(5), 3, sample=60)
    assert np.array_equal(centres, again)


def test_mix_rakes_every_value_of_an_axis(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RATES_A_PLAN", 500)
    rng = random.Random(7)
    rows = [(i, t, "en", "big" if i % 2 else f"h{rng.randrange(600)}") for i, t in enumerate(texts(4, 4000, 5))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labelled = mixing.label(docs, topics=2)
    power = {"source": 0.7, "lang": 1.0, "topic": 1.0}
    got, mix = mixing.mix(labelled, 0.3, power)
    source = mix.axes[0]
    assert set(source.names) == {r[3] for r in rows} and np.abs(source.kept - source.goal).max() < 1e-5 * mix.mass.sum()
    rates = np.array([k / m for k, m in zip(source.kept, np.bincount(mix.codes[0], mix.mass), strict=True)])
    by_name = dict(zip(source.names, rates, strict=True))
    small = [n for n in source.names if n != "big"]
    assert min(by_name[n] for n in small) > by_name["big"] and max(by_name[n] for n in small) > 1.2 * min(by_name[n] for n in small)
    assert got.count() == 4000 and got.where("probability is null").count() == 0
    named = {"source": {"h1": 0.5, "h2": 0.5}}  # sources of far less than 0.5 % of the tokens
    got = mixing.mix(labelled, 0.001, power, named)[0].toPandas()
    assert (got[got.source.isin(["h1", "h2"])].probability > 0).all() and (got[~got.source.isin(["h1", "h2"]) & (got.tokens > 0)].probability == 0).all()


def test_mix_keeps_about_the_budget(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["en", "en", "fr"]), rng.choice(["a", "a", "b"])) for i, t in enumerate(texts(2, 3000, 5))]
    labelled = mixing.label(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), topics=3)
    got, _ = mixing.mix(labelled, 0.5, {"source": 0.7, "lang": 0.7, "topic": 1.0}, {"lang": {"en": 0.5, "fr": 0.5}})
    got = got.toPandas()
    assert len(got) == 3000 and abs((got.tokens * got.probability).sum() / got.tokens.sum() - 0.5) < 1e-6
    kept = got[got.sampled]
    assert abs(kept.tokens.sum() / got.tokens.sum() - 0.5) < 0.05
    assert abs(kept[kept.lang == "en"].tokens.sum() / kept.tokens.sum() - 0.5) < 0.05
    for docs, n in ((odd_docs(spark), 11), (no_docs(spark), 0)):
        assert mixing.mix(mixing.label(docs), 0.5, {"source": 1, "lang": 1, "topic": 1})[0].count() == n


def test_quality_counts_and_votes(spark):
    rng = random.Random(9)
    good = texts(4, 300, 60, 90)
    bad = [" ".join(w + "###" for w in t.split()[:40]) for t in texts(5, 60, 40, 60)]
    lines = ["a b\na b\n\n \nc\nc\nc"]
    rows = list(enumerate(good + bad + lines))
    rng.shuffle(rows)
    scored, model = quality.score(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert all(got[i]["quality"] > 0.5 for i in range(300)) and all(got[i]["quality"] < 0.5 for i in range(300, 360))
    assert got[360]["n_dup_lines"] == 3 and got[360]["n_words"] == 7
    for i, text in rows:
        words = text.split()
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        many, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if many[g] > 1:
                covered |= set(range(k, k + 8))
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(words), len(covered))
        assert got[i]["word_chars"] == sum(map(len, words))
    assert quality.score(odd_docs(spark))[0].count() == 11 and quality.score(no_docs(spark))[0].count() == 0


def test_repeated_words_match_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = np.array(rng.choices(range(3), k=rng.randint(0, 40)), np.uint64)
        grams = quality.windows(words, 8)
        keys = [tuple(words[k : k + 8]) for k in range(max(0, len(words) - 7))]
        many = Counter(keys)
        covered = {p for k, g in enumerate(keys) if many[g] > 1 for p in range(k, k + 8)}
        assert quality.repeated(grams, len(words)) == len(covered)


def greedy(word, pieces):
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, count = end, count + 1
    return count


def test_longest_match_is_greedy():
    rng = random.Random(0)
    word = lambda n: "".join(rng.choices("abc", k=rng.randint(1, n)))
    for _ in range(500):
        pieces = {word(5) for _ in range(rng.randint(1, 12))}
        text = word(14)
        assert wordpiece.LongestMatch(pieces).length(text) == greedy(text, pieces)


def test_token_counts(spark):
    import public_tokenizers

    file = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in wordpiece.token_counts(odd_docs(spark), file).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_words"] == 0 and got[1]["n_words"] == 6
    automaton = wordpiece._automaton(file)
    assert got[8]["n_tokens"] == sum(automaton.length("▁" + w) or 1 for w in ("é ü", "漢字", "a"))
    assert wordpiece.token_counts(no_docs(spark), file).count() == 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(8)
    stems = {"en": ["the", "ing", "th", "with", "er"], "fr": ["eau", "le", "ou", "éà", "que"], "de": ["sch", "ein", "ung", "ü", "der"]}
    make = lambda c: " ".join("".join(rng.choices(stems[c], k=3)) for _ in range(30))
    rows = [(i, c, make(c)) for i, c in enumerate(rng.choices(list(stems), k=600))]
    model = language.fit_text_model(spark.createDataFrame(rows[:300], "id bigint, language string, text string"), sample=50)
    plain = [(i, t, c if i % 2 else None, None, f"h{i % 5}", None) for i, c, t in rows[300:]]
    plain += [(9000, None, "en", None, None, None), (9001, "12 34", "fr", None, None, None), (9002, "", None, "fr", "h1", "p")]
    names = "id bigint, text string, declared string, suffix string, host string, parent string"
    got = {r["id"]: r for r in language.identify(spark.createDataFrame(plain, names), model).collect()}
    assert len(got) == 303 and sum(got[i]["language"] == c for i, c, _ in rows[300:]) >= 297
    assert not any(got[i]["kept"] for i in (9000, 9001, 9002))
    none = spark.createDataFrame([], names)
    assert language.identify(none, model).count() == 0
    empty = language.fit_text_model(none.selectExpr("id", "declared as language", "text"))
    assert [r["kept"] for r in language.identify(spark.createDataFrame(plain[:1], names), empty).collect()] == [False]


def test_text_models_take_the_same_jobs_whatever_the_splits(spark):
    rows = [(i, "en" if i % 2 else "de", f"the quick {i}" if i % 2 else f"die schnelle {i}") for i in range(200)]
    frame, models, jobs = spark.createDataFrame(rows, "id bigint, language string, text string"), [], []
    for parts in (2, 40):
        split = stored(frame.repartition(parts, "id"), "labelled")
        spark.sparkContext.setJobGroup(f"fit-{parts}", "")
        models.append(language.fit_text_model(split))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{parts}")))
        spark.sparkContext.setJobGroup("after", "")
    assert (models[0].log_odds == models[1].log_odds).all() and models[0].languages == ["de", "en"]
    assert jobs[0] == jobs[1] < 10
    totals = language._count([pa.RecordBatch.from_pydict({"language": ["en"], "text": ["abc"]})])
    assert sum(np.frombuffer(c, np.int64).sum() for batch in totals for c in batch.column(2).to_pylist()) == 3


def test_page_evidence(spark):
    html = '<html lang="fr-CA"><script>x<b></script><p>Bon</p><!-- no --> jour</html>'
    rows = [(1, "https://www.a.example.org:80/x", html), (2, None, None)]
    one, two = language.page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert (one["declared"], one["suffix"], one["host"], one["parent"]) == ("fr", "org", "a.example.org", "example.org")
    assert one["text"].split() == ["Bon", "jour"] and two["host"] == two["text"] == ""


def brute_vectors(x, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near.sum(1), groups_of(list(zip(*np.nonzero(near), strict=True)), range(len(x)))


def test_vectors_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    x = np.concatenate([base, base[rng.integers(0, 60, 240)] + 0.25 * rng.normal(size=(240, 6)), np.repeat(base[:1], 80, 0)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 6, 1), (902, [float("nan")] * 6, 1), (903, [1.0, None], 1), (904, [], 1), (None, base[1].tolist(), 1)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df, block=32).collect()}
    links, group = brute_vectors(np.concatenate([x, base[1:2]]), 0.9)
    for i in range(len(x)):
        assert got[i]["n_links"] == links[i] and got[i]["component_id"] == group[i] and got[i]["kept"] == (group[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 905))
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(6)
    hard = ["<|im_end|>", "␛a", "<|", "<", "|>", "\n", "␛", "é", "<|im_start|>user\nx", ""]
    rows, told = [], {}
    for c in range(40):
        turns = [(t, rng.choice(["user", "assistant", "odd\nrole"]), "".join(rng.choices(hard, k=4))) for t in range(rng.randint(1, 5))]
        rows += [(c, *t) for t in turns]
        told[c] = turns
    rows += [(99, None, None, None), (99, 1, "user", None), (None, 0, "user", "x"), (7, 9, "user", "x"), (7, 9, "user", "x")]
    told[7] += [(9, "user", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("extra", "loss")
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    for c, turns in told.items():
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[99]["n_turns"] == 2 and None in got
    assert chat.format_conversations(df.limit(0)).count() == 0
    valid = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    assert {r["conv_id"]: r["valid"] for r in chat.format_conversations(valid).collect()} == {1: True, 2: False, 3: False}


def test_parts_of_a_batch_are_bounded_and_whole(monkeypatch):
    """What a task makes of a batch stays small, however large the batch; no row is lost or moved."""
    monkeypatch.setattr(jaccard, "PART_BYTES", 100)
    said = [f"{k} b c d e " * k if k % 5 else None for k in range(40)]
    whole = pa.RecordBatch.from_arrays(
        [pa.array(range(40)), pa.array(said, pa.string()), pa.array(range(40))], ["id", "text", "key"]
    )
    parts = list(jaccard._parts([whole.slice(3), whole.slice(0, 0)]))
    assert pa.Table.from_batches(parts).to_pylist() == whole.slice(3).to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)
    pieces = list(jaccard._incidence([whole], 2, 80, 4))
    assert max(sum(b.column(1).to_pylist()) for b in pieces) < sum(sum(b.column(1).to_pylist()) for b in pieces)


def brute_jaccard(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    ids = list(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, groups_of(links, ids)


@pytest.mark.parametrize(
    ("n", "percent", "long_block"), [(4, 85, 1 << 22), (5, 80, 1 << 22), (2, 60, 1 << 22), (4, 85, 0), (2, 60, 12)]
)
def test_jaccard_finds_every_link(spark, monkeypatch, n, percent, long_block):
    """Also where all blocks of n-grams, or some, are too long to be gathered."""
    monkeypatch.setattr(jaccard, "LONG_BLOCK", long_block)
    rng = random.Random(n)
    rows = list(enumerate(texts(7, 60, 0, 50)))
    for base in rows[:12] + [(0, " ".join(WORDS[:90]))]:
        for _ in range(12):  # chains of small edits, and copies
            words = base[1].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
            rows.append((len(rows), "  ".join(words)))
    passage = " ".join(WORDS[100:160])
    rows += [(len(rows) + k, passage + " " + t) for k, t in enumerate(texts(8, 40, 1, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(docs, n, percent).collect()}
    sets, group = brute_jaccard(rows, n, percent)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in got} == {i: (len(sets[i]), group[i]) for i in sets}


def test_jaccard_on_odd_rows(spark):
    got = jaccard.near_duplicates(odd_docs(spark))
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()]
    assert len(rows) == 11 and rows.count((1, 2, 1)) == 2 and {(5, 401, 5), (6, 401, 5)} <= set(rows)
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 0, None)} <= set(rows)
    assert jaccard.near_duplicates(no_docs(spark)).count() == 0


@pytest.mark.parametrize("rows_a_part", [3, 1024])
def test_jaccard_of_long_lists_and_shared_ids(spark, monkeypatch, rows_a_part):
    """Rare n-grams that many different texts hold, compared in parts; one id for all rows, or none."""
    monkeypatch.setattr(jaccard, "LIST_ROWS", rows_a_part)
    rng = random.Random(5)
    frame = "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 q0 q1 q2 q3 q4 q5 q6 q7 q8 q9".split()
    rows = []
    for k in range(150):
        own = frame + [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 9]))]
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 4, 85).collect()}
    assert got == brute_jaccard(rows, 4, 85)[1]
    groups = Counter(Counter(got.values()).values())
    for shared in (None, 7):
        found = jaccard.near_duplicates(docs.withColumn("doc_id", F.lit(shared).cast("bigint")), 4, 85).collect()
        assert len(found) == 150 and {r["doc_id"] for r in found} == {shared}
        nodes = jaccard.keep_rows(docs.withColumn("doc_id", F.lit(shared).cast("bigint")), 4, 85).count()
        assert nodes == sum(groups.values())


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = (" ".join(WORDS[k : k + 40]) for k in (0, 100, 200))
    near = a.replace("w39", "w399")
    rows = [(1, near), (5, a), (3, b), (3, c), (None, b), (None, "only here"), (None, "nor there"), (None, "nor there"), (None, None), (7, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1.5))
    got = jaccard.keep_rows(docs)
    assert got.columns == docs.columns
    kept = [(1, near), (3, b), (3, c), (None, "only here"), (None, "nor there"), (None, None), (7, "")]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"]) == sorted(k for k in kept if k[0])
    assert Counter(r["text"] for r in got.collect() if not r["doc_id"]) == Counter(k[1] for k in kept if not k[0])
    odd = jaccard.keep_rows(odd_docs(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in odd) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    assert jaccard.keep_rows(no_docs(spark)).count() == 0


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    files = tokenizer_files()
    ids, exact = packing.Ids(*files), Tokenizer.from_file(files[0])
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", " \n ", "it's", "12 3", "é", "漢", "<|endoftext|>", " ", "\x1c ", ".,", "  x", "don't ", "\t"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(ids(text), "<u4").tolist() == [*exact.encode(text, add_special_tokens=False).ids, 0]


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((k for k, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, n) for i, n in enumerate([rng.randint(1, 200) for _ in range(900)] + [77] * 400 + [200] * 30 + list(range(1, 201)))]
    df = stored(spark.createDataFrame(rows, "doc_id bigint, length bigint"), "t")
    got = packing.pack(df, ["doc_id"], capacity=200, groups=400).toPandas()
    assert sorted(got.doc_id) == [i for i, _ in rows]
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 200 and len(used) <= 1.01 * first_fit_decreasing([n for _, n in rows], 200)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()


@pytest.mark.parametrize("lengths", [[], [5], [200] * 3, [1] * 500, [150, 150, 50, 50, 60]])
def test_packing_of_few_lengths(spark, lengths):
    df = stored(spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, length bigint"), "t")
    got = packing.pack(df, ["doc_id"], capacity=200).toPandas()
    assert len(got) == len(lengths) and (not lengths or got.groupby("sequence_id").length.sum().max() <= 200)


def test_pieces(spark):
    got = packing.pieces(odd_docs(spark), tokenizer_files(), capacity=100).toPandas()
    assert (got.length <= 100).all() and len(got[got.doc_id == 2]) == 1
    long = got[got.doc_id == 5].sort_values("piece")
    assert (long.length[1:] == 100).all() and long.start.tolist() == [0, *np.cumsum(long.length)[:-1]]
    assert packing.pieces(no_docs(spark), tokenizer_files()).count() == 0
