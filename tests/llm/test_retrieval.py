"""The audit and the two searches against plain Python over the whole fixture."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ROWS, WORDS, body

from tidelog.llm import divergence, inner_product, lexical

LETTERS = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


AUDITED = ([(i, t, "en", f"s{i % 3}" if i else None) for i, t in ROWS]
           + [(100 + k, f"{body(k)} É{'x' * (k % 3)} Beta-gamma9delta", ["en", "de", None][k % 3], f"s{k % 4}") for k in range(40)]
           + [(200, "12 34", "en", "numbers"), (201, None, "xx", "a"), (202, "alone", "xx", "b"), (203, "one", "yy", "only")])


def audit_brute(rows, least, top):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = LETTERS.findall(lower(text))
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for (g, t), d in docs.items() if g == lang and d >= least]
        sides = {s: Counter({t: counts[lang, s][t] for t in kept}) for g, s in groups if g == lang}
        whole = Counter({t: sum(c[t] for c in sides.values()) for t in kept})

        def p(count):
            total = sum(count.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        own, q = p(sides[source]), p(whole)
        pairs = [(s, sum(abs(own[t] - x) for t, x in p(c).items())) for s, c in sides.items() if s != source]
        terms = [(t, own[t] - q[t]) for t in kept if sides[source][t] and own[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("block", [divergence.BLOCK, 40])
def test_audit_matches_brute_force(spark, docs, block):
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in AUDITED], "doc_id long, text string, lang string, source string, value int, item int, shard int").repartition(3)
    for least in (3, 1, 1000):
        assert sorted(map(tuple, divergence.audit(table, least, 7, block).collect())) == audit_brute(AUDITED, least, 7)


def test_audit_of_nothing(empty):
    assert divergence.audit(empty).collect() == []


def test_long_texts_are_sliced_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 50)
    text = (" ".join(body(k) for k in range(9)) + " " + "z" * 170 + " éé").encode()
    assert b"".join(divergence.slices(text)) == text and len(list(divergence.slices(text))) > 10
    held = divergence.Block()
    held.add("a", "b", text)
    held.add("a", "b", b"alpha")
    held.count()
    got = {r["term"]: (r["count"], r["docs"]) for r in held.summed().to_pylist()}
    want = Counter(LETTERS.findall(text.decode()))
    assert got == {t.encode(): (n + (t == "alpha"), 1 + (t == "alpha")) for t, n in want.items()}


ITEMS = [(1, body(3)), (2, None), (3, ""), (4, "nowhere found"), (5, "ALPHA alpha0 ß"), (5, "ALPHA alpha0 ß"), (6, " ".join(WORDS) + " w1x1 w2x2 more tail"), (None, body(9))]


def lexical_brute(rows, items, top):
    texts = [(i, Counter(ALNUM.findall(lower(t)))) for i, t in rows]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_words, df = len(texts), sum(sum(c.values()) for _, c in texts), Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in texts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(ALNUM.findall(lower(text))))
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [lexical.BUCKET_DOCS, 3])
def test_lexical_search_matches_brute_force(spark, docs, bucket, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(lexical, "SEEDS", 4)
    items = spark.createDataFrame([(*r, 0, 1.0) for r in ITEMS], "item_id long, text string, item int, length double")
    for top in (10, 2):
        assert sorted(map(tuple, lexical.rank_documents(docs, items, top).collect()), key=str) == lexical_brute(ROWS, ITEMS, top)
    monkeypatch.setattr(lexical, "PASS_BYTES", 100)  # a pass for every few items
    assert sorted(map(tuple, lexical.rank_documents(docs, items).collect()), key=str) == lexical_brute(ROWS, ITEMS, 10)


def test_lexical_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank_documents(empty, items).collect() == []
    assert lexical.rank_documents(docs, items.limit(0)).collect() == []


def test_bucket_bounds_never_lose_a_score():
    rng = np.random.default_rng(3)
    stats = lexical.Statistics(500, 20000, rng.integers(1, 400, 60))
    for _ in range(20):
        rows = []
        for k in range(80):
            terms = np.flatnonzero(rng.random(60) < 0.2).astype("<i4")
            terms = terms if len(terms) else np.array([k % 60], "<i4")
            rows.append((k, int(rng.integers(1, 300)), terms, rng.integers(1, 9, len(terms)).astype("<i8")))
        rows = [(*r, math.sqrt(sum((float(stats.weight[t]) * int(x)) ** 2 for t, x in zip(r[2], stats.impacts(r[1], r[3]))))) for r in rows]
        bucket = lexical.Bucket(rows, stats)
        asked = np.sort(rng.choice(60, 6, replace=False))
        true = [sum(int(stats.weight[t]) * int(dict(zip(r[2].tolist(), stats.impacts(r[1], r[3]).tolist())).get(int(t), 0)) for t in asked) for r in rows]
        for least in (0, sorted(true)[-10], sorted(true)[-1], sorted(true)[-1] + 1):
            at, scores = bucket.search(asked, stats.weight[asked], least)
            got = dict(zip(at.tolist(), scores.tolist()))
            assert all(got[k] == true[k] for k in got) and {k for k, s in enumerate(true) if s >= max(least, 1)} <= set(got)


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    rows = [(k, (base[k % 30] * (1 + k % 7) / 3 + 0.01 * rng.normal(size=8)).tolist()) for k in range(400)]
    rows += [(500, rows[7][1]), (501, rows[7][1]), (600, rows[7][1]), (700, [0.0] * 8), (800, rows[3][1][:5]), (300, rows[9][1]), (300, rows[9][1]), (900, [])]
    return rows + [(1000, None), (1001, [1.0, None, 2.0]), (1002, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, rows[1][1]), (None, rows[1][1])]


def products_brute(rows, every, top):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q is not None and q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in whole if i != q)[:top]
            out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(scored, 1)]
    return sorted(out, key=str)


def test_top_products_match_brute_force(spark, monkeypatch):
    table = spark.createDataFrame([(*r, 1, "x") for r in vectors()], "vec_id long, embedding array<double>, at int, vector string").repartition(4)
    for rows, bucket in ((40, 16), (10_000, 1024)):
        monkeypatch.setattr(inner_product, "CELL_ROWS", rows)
        monkeypatch.setattr(inner_product, "BUCKET", bucket)
        for every, top in ((100, 10), (7, 3)):
            assert sorted(map(tuple, inner_product.top_products(table, every, top).collect()), key=str) == products_brute(vectors(), every, top)
    assert inner_product.top_products(table.limit(0)).collect() == []
    few = table.filter("vec_id in (0, 5)")
    assert [tuple(r)[:3] for r in inner_product.top_products(few).collect()] == [(0, 1, 5)]


def test_products_are_exact_at_every_size():
    for size in (2 ** 20, 2 ** 27, 2 ** 62):
        a = np.array([[size, 1, -3], [-size, 5, 7]], np.int64)
        want = [[max(min(sum(int(x) * int(y) for x, y in zip(p, q)), 2 ** 63 - 1), -2 ** 63 + 1) for q in a] for p in a]
        assert inner_product.products(a, a).tolist() == want


def test_coordinate_bounds_never_lose_a_vector():
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(300, 6)) * 1000).astype(np.int64)
    v[:100] = v[0] + rng.integers(-60, 60, (100, 6))
    lengths = np.sqrt((v.astype(float) ** 2).sum(1))
    bucket = inner_product.Bucket(v, lengths)
    for k in range(0, 300, 30):
        q = v[k] / lengths[k]
        true = v @ q / lengths
        for cosine in (0.9, 0.99):
            assert set(np.flatnonzero(true >= cosine)) <= set(bucket.by_coordinates(q, cosine).tolist())
    assert len(bucket.by_coordinates(v[0] / lengths[0], 0.99)) < 200
