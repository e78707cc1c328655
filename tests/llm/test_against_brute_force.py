"""Operators that SQL can't express, over whole tables, against plain versions of the same rules."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from retailmart.llm import language, mixing, pii, queries

SF_DIR = "/root/testdata/sf0.001"
KEY = b"a key"


# ----------------------------------------------------------------------------- language


def places(text):
    """Table places of the trigrams that begin with a letter; blanks stand for all other bytes."""
    letter = lambda b: b >= 128 or chr(b).isalpha()
    seen = [b + 32 if 65 <= b <= 90 else b if letter(b) else 32 for b in text.encode()] + [32, 32]
    codes = [(a << 16 | b << 8 | c) + 1 for a, b, c in zip(seen, seen[1:], seen[2:], strict=False) if a != 32]
    return (language.mix(np.array(codes, np.uint64)) % np.uint64(language.TABLE)).astype(int).tolist() if codes else []


def softmax(logs):
    weights = [math.exp(x - max(logs)) for x in logs]
    return [w / sum(weights) for w in weights]


def brute_languages(labelled, rows, strength=20.0, least=0.6):
    """rows: id to (text, declared, suffix, host, parent); returns id to (best, posterior, letters, kept)."""
    seen = defaultdict(Counter)
    for name, text in labelled:
        seen[name].update(places(text))
    names = sorted(seen)
    size = {c: sum(seen[c].values()) + 0.5 * language.TABLE for c in names}
    k = len(names)

    def odds(place):
        logs = [math.log((seen[c][place] + 0.5) / size[c]) for c in names]
        return [x - sum(logs) / k for x in logs]

    known = {}
    scores, letters = {}, {}
    for i, (text, *_) in rows.items():
        found = places(text or "")
        letters[i] = len(found)
        for place in found:
            if place not in known:
                known[place] = odds(place)
        scores[i] = [language.TEXT_TRUST * sum(known[p][c] for p in found) for c in range(k)]
    clean = {i: (r[0], *[v.lower().strip(" ") if v and v.strip(" ") else None for v in r[1:]]) for i, r in rows.items()}
    sums = defaultdict(lambda: [0.0] * k)
    for i, (_, declared, suffix, host, parent) in clean.items():
        if letters[i]:
            p = softmax(scores[i])
            keys = [("all",)] + [("declared", declared)] * (declared is not None) + [("suffix", suffix)] * (suffix is not None)
            keys += [("parent", parent)] * (parent is not None) + [("host", host, parent)] * (host is not None)
            for key in keys:
                sums[key] = [a + b for a, b in zip(sums[key], p, strict=True)]
    everywhere = [x + 1 for x in sums[("all",)]]
    shares = [x / sum(everywhere) for x in everywhere]
    out = {}
    for i, (_, declared, suffix, host, parent) in clean.items():
        logs = [a + math.log(b) for a, b in zip(scores[i], shares, strict=True)]
        if ("host", host, parent) in sums:
            above = shares
            if ("parent", parent) in sums:
                s = sums[("parent", parent)]
                above = [(s[c] + strength * shares[c]) / (sum(s) + strength) for c in range(k)]
            s = sums[("host", host, parent)]
            logs = [a + math.log((s[c] + strength * above[c]) / (sum(s) + strength)) for c, a in enumerate(scores[i])]
        for key in (("declared", declared), ("suffix", suffix)):
            if key in sums:
                logs = [x + math.log((sums[key][c] + strength * shares[c] / k) / everywhere[c]) for c, x in enumerate(logs)]
        p = softmax(logs)
        out[i] = (names[p.index(max(p))], max(p), letters[i], letters[i] > 0 and max(p) >= least)
    return out


def test_languages_of_pages_and_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    rows = {("d", r["doc_id"]): (r["text"], r["lang"], None, r["source"], None) for r in docs}
    for r in pages:
        url, html = (r["url"] or "").lower(), r["html"] or ""
        host = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", url)
        host = re.sub(r"^www\.", "", host.group(1)) if host else ""
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html)
        declared = re.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", html)
        ends = [re.search(p, host) for p in (r"\.([a-z0-9-]+)$", r"([^.]+\.[^.]+)$")]
        suffix, parent = (m.group(1) if m else None for m in ends)
        rows[("p", r["page_id"])] = (text, declared.group(1) if declared else None, suffix, host, parent)
    labelled = [(r["lang"], r["text"]) for r in docs if r["lang"] is not None and r["text"] is not None]
    assert max(Counter(c for c, _ in labelled).values()) <= language.SAMPLE_A_LANGUAGE  # so all of them are fitted
    wanted = brute_languages(labelled, rows)
    got = queries.queries()["op6_language_fusion"](spark, SF_DIR).collect()
    assert len(got) == len(rows) == len(wanted)
    for r in got:
        best, posterior, letters, kept = wanted[("d", r["doc_id"]) if r["page_id"] is None else ("p", r["page_id"])]
        assert r["letters"] == letters and abs(r["posterior"] - posterior) < 1e-4
        if abs(posterior - 0.6) > 1e-4:
            assert r["kept"] == kept
        if posterior > 0.51:
            assert r["best_language"] == best and r["language"] == (best if r["kept"] else None)


def test_a_text_is_scored_alike_beside_any_other(spark):
    fit = [(i, c, t) for i, (c, t) in enumerate([("en", "the thing with"), ("de", "ein schiff und")] * 20)]
    model = language.fit_text_model(spark.createDataFrame(fit, "id bigint, language string, text string"))
    texts = ["th", "ei", "a", "", "é", None, "und", "x" * 200_000 + "th"]
    alone = [language._text_scores([batch(t)], model) for t in texts]
    alone = [next(a).column("scores").to_pylist()[0] for a in alone]
    together = next(language._text_scores([batch(*texts)], model)).column("scores").to_pylist()
    assert np.allclose(alone, together)


def batch(*texts):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "id": pa.array(range(len(texts)), pa.int64())})


# -------------------------------------------------------------------------------- mixing


def bisect(function, goal, low=0.0, high=1.0):
    """The number at which a rising function reaches its goal."""
    while function(high) < goal and high < 1e12:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if function(middle) < goal else (low, middle)
    return high


def brute_rates(mass, budget, power):
    """mass: (source, lang, topic) to tokens; returns the goals and each cell's probability."""
    total, goals = sum(mass.values()), []
    for a, axis in enumerate(mixing.AXES):
        own = Counter()
        for cell, tokens in mass.items():
            own[cell[a]] += tokens
        wanted = {v: (n / total) ** power[axis] for v, n in own.items()}
        factor = bisect(lambda f: sum(min(own[v], f * wanted[v]) for v in own), budget * total)  # noqa: B023
        goals.append({v: min(own[v], factor * wanted[v]) for v in own})
    factors = [dict.fromkeys(goal, 1.0) for goal in goals]
    rate = lambda cell: math.prod(f[v] for f, v in zip(factors, cell, strict=True))
    for _ in range(60):
        for a, goal in enumerate(goals):
            for value, tokens in goal.items():
                cells = [(n, rate(c) / factors[a][value]) for c, n in mass.items() if c[a] == value]
                factors[a][value] = bisect(lambda f: sum(n * min(1, f * x) for n, x in cells), tokens * (1 - 1e-12))  # noqa: B023
    return goals, {cell: min(1.0, rate(cell)) for cell in mass}


def test_rates_of_a_mix(spark):
    rng = random.Random(6)
    langs, sources = ["en"] * 6 + ["fr"] * 3 + ["de"] * 2, ["hot"] * 6 + [f"s{k}" for k in range(6)]
    texts = [" ".join(rng.choices([f"w{i}" for i in range(200)], k=rng.randint(5, 60))) for _ in range(3000)]
    docs = [(i, t, rng.choice(langs), rng.choice(sources)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    labelled = mixing.label(docs, topics=3)
    rows, _ = mixing.mix(labelled, 0.6, queries.MIX_POWER)
    u = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 52)) / (1 << 52)
    rows = rows.withColumn("u", u).collect()
    mass = Counter()
    for r in rows:
        assert r["tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["id"]]))
        mass[tuple(r[a] for a in mixing.AXES)] += r["tokens"]
    goals, wanted = brute_rates(mass, 0.6, queries.MIX_POWER)
    for a, goal in enumerate(goals):  # the plain version meets its goals, so they don't contradict each other
        for value, tokens in goal.items():
            assert abs(sum(n * wanted[c] for c, n in mass.items() if c[a] == value) - tokens) < 1e-4 * sum(mass.values())
    for r in rows:
        p = wanted[tuple(r[a] for a in mixing.AXES)]
        assert abs(r["probability"] - p) < 1e-3 and r["sampled"] == (r["u"] < r["probability"])


# ----------------------------------------------------------------------------- pseudonyms


def permuted(digits, tweak):
    value = pii.feistel(int(digits), 10 ** len(digits), KEY, f"{tweak}|{'0' * len(digits)}")
    return f"{value:0{len(digits)}d}"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def in_groups(digits, shape):
    left = iter(digits)
    return "".join(next(left) if c == "9" else c for c in shape)


def a_card(rng):
    body = "".join(rng.choices("0123456789", k=15))
    close = lambda b: next(b + c for c in "0123456789" if luhn(b + c))
    shape = rng.choice(["9999 9999 9999 9999", "9999-9999-9999-9999", "9999.9999.9999.9999", "9" * 16])
    return "card", in_groups(close(body), shape), in_groups(close(permuted(body, "card")), shape)


def an_iban(rng):
    body = "".join(rng.choices("0123456789", k=18))
    close = lambda b: next(f"DE{n:02d}{b}" for n in range(2, 99) if mod97(f"DE{n:02d}{b}"))
    shape = rng.choice([lambda t: t, str.lower, lambda t: " ".join(t[k : k + 4] for k in range(0, 22, 4))])
    return "iban", shape(close(body)), shape(close(permuted(body, "iban|DE")))


def a_date(rng):
    first, last = date(1900, 1, 1), date(2100, 1, 1)
    day = first + timedelta(rng.randrange((last - first).days))
    moved = first + timedelta(pii.feistel((day - first).days, (last - first).days, KEY, "date"))
    end = rng.choice(["", "T10:20:30"])
    return "date", f"{day}{end}", f"{moved}{end}"


def an_ip(rng):
    value = rng.randrange(1 << 32)
    dotted = lambda v: ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    return "ip", dotted(value), dotted(pii.feistel(value, 1 << 32, KEY, "ip"))


def an_ssn(rng):
    fine = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = next(d for d in iter(lambda: f"{rng.randrange(10**9):09d}", None) if fine(d))
    fresh = permuted(digits, "ssn")
    while not fine(fresh):
        fresh = permuted(fresh, "ssn")
    return "ssn", in_groups(digits, "999-99-9999"), in_groups(fresh, "999-99-9999")


def a_phone(rng):
    digits = "".join(rng.choices("0123456789", k=10))
    shape = rng.choice(["999-999-9999", "999.999.9999", "(999) 999-9999"])
    return "phone", in_groups(digits, shape), in_groups(permuted(digits, "phone|"), shape)


def test_planted_values_and_nothing_else_change(spark):
    rng = random.Random(4)
    makers = [a_card, an_iban, a_date, an_ip, an_ssn, a_phone]
    plain = ["lorem", "ipsum,", "é漢", "12", "v2", "3.14", "\n", "(x)", "1999"]
    docs, wanted = [], {}
    for i in range(400):
        before, after, counts = [], [], Counter()
        for _ in range(rng.randrange(30)):
            word = rng.choice(plain)
            kind, old, new = rng.choice(makers)(rng) if rng.random() < 0.3 else (None, word, word)
            counts[kind] += 1
            before += [old, "word"]
            after += [new, "word"]
        docs.append((i, " ".join(before)))
        wanted[i] = (" ".join(after), [counts[k] for k in pii.KINDS])
    got = pii.pseudonymise_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), KEY).collect()
    assert len(got) == 400
    for r in got:
        assert (r["text"], [r[f"n_{k}"] for k in pii.KINDS]) == wanted[r["doc_id"]]
