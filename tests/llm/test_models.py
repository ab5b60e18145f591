import math
import zlib

import numpy as np
from conftest_llm import ROWS, vocabulary

from tidelog.llm import language_model, quality, toxicity
from tidelog.llm.lattice import CHARACTERS, MARK, Lattice


def test_forward_recursion_sums_over_all_segmentations():
    lattice = Lattice([MARK, "a", "b", "ab", MARK + "a", "ba", MARK + "ab"])
    scores = np.log(np.array([0.1] * 8 + [0.2]))

    def brute(w, i=0):
        if i == len(w):
            return 1.0
        return sum((0.1 if w[i:j] in lattice.pieces else 0.0) * brute(w, j) for j in range(i + 1, len(w) + 1)) + (0.1 / CHARACTERS * brute(w, i + 1) if i else 0)

    words = ["abab", "a", "x", "baab", "aaaaabbbbb", "é"]
    got = lattice.log_marginals(words, scores)
    assert np.allclose(np.exp(got), [brute(MARK + w) for w in words], rtol=1e-9, atol=0)
    uses = lattice.expected(["ab"], np.ones(1), scores)
    ways = {(MARK, "a", "b"): 1e-3, (MARK, "ab"): 1e-2, (MARK + "a", "b"): 1e-2, (MARK + "ab",): 1e-1}
    want = sum(p for way, p in ways.items() if "b" in way) / sum(ways.values())
    assert math.isclose(uses[lattice.pieces.index("b")], want, rel_tol=1e-5)


def test_likelihoods_have_the_base_by_definition(docs, empty):
    rows = language_model.likelihoods(docs, vocabulary("piece_bpe_32k.model")).collect()
    train = {}
    for i, t in ROWS:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            for w in [*language_model.words_of(t or ""), b""]:
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    assert len(rows) == len(ROWS)
    text = {i: t for i, t in ROWS if i is not None}
    for r in rows:
        assert r["train_tokens"] == n and r["score"] < 0
        if r["doc_id"] is not None:
            w = [*language_model.words_of(text[r["doc_id"]] or ""), b""]
            assert math.isclose(r["base_score"], sum(math.log10((train.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
            assert (r["n_tokens"], r["n_known"]) == (len(w), sum(x in train for x in w))
    assert language_model.likelihoods(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def _labelled(spark, n, bad):
    rows = [(k, bad(k) if k % 4 == 0 else " ".join(f"word{(k * 7 + j) % 40}" for j in range(25))) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0)) for k in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(spark, docs, empty):
    rows, labels = _labelled(spark, 400, lambda k: " ".join([f"JUNK{k}!!"] * 12))
    got = [r for r in quality.classify(rows, labels).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got]) > 0.95
    assert quality.classify(docs, labels).count() == len(ROWS)
    assert quality.classify(empty, labels.limit(0)).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rows, labels = _labelled(spark, 600, lambda k: " ".join([f"word{(k + j) % 40}" for j in range(20)] + [f"vile{k % 3}", f"grumpf{k}"]))
    got = [r for r in toxicity.classify(rows, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got]) > 0.95
    assert toxicity.classify(docs, labels).count() == len(ROWS)
    assert toxicity.classify(empty, labels.limit(0)).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_label_model_finds_accuracies_and_the_correlated_pair():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(int)
    v = np.stack([np.where(rng.random(4000) < a, y, 1 - y) for a in (0.95, 0.8, 0.6)], 1)
    v = np.concatenate([v, np.where(rng.random((4000, 1)) < 0.97, v[:, 2:3], 1 - v[:, 2:3])], 1).astype(np.int8)
    m = toxicity.LabelModel(v, y.astype(float))
    a = m.accuracies.mean(axis=1)
    assert a[0] > a[1] > a[2] and (m.parent[3] == 2 or m.parent[2] == 3)
    assert np.mean((m.posterior(v.astype(int)) > 0.5) == y) > 0.9


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 20
    signs = np.array([1, 1, -1, -1.0] * 20)
    w = quality.dual_coordinate_descent(rows, signs, np.array([2.0, -2.0, 0.0, 0.0]))
    scale = np.array([2.0, -2.0, 0.0, 0.0])
    assert all(np.sign(w[x] @ scale[x] + w[-1]) == s for x, s in zip(rows, signs, strict=True))


def test_every_piece_of_a_vocabulary_has_its_arc():
    """Also those whose slots are taken in both tables: each is found by the hash of its own characters."""
    pieces, _ = language_model.vocabulary(vocabulary("piece_bpe_32k.model"))
    own = Lattice(pieces)
    assert len(own.last) and own._find(own.keys[:len(pieces)]).tolist() == list(range(len(pieces)))
    assert (own._find(own.keys[:len(pieces)] ^ np.uint64(0x5555555555555555)) == len(pieces)).all()
