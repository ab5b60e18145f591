import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from conftest_llm import ROWS

from tidelog.llm import exact, imatch, lines, near
from tidelog.llm.components import components
from tidelog.llm.common import stored


def _key(i):
    return (i is not None, i or 0)


def test_exact_groups(docs, empty):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256(re.sub("[ \t-\r]+", " ", t or "").encode()).hexdigest()].append(i)
    rows = exact.deduplicate(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        own = groups[r["text_sha256"]]
        keep = min((i for i in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)
    assert exact.deduplicate(empty).count() == 0
    left = exact.drop_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 7, 500, 3000):
        digests = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        displace, slot = exact.build(digests)
        assert sorted(slot.tolist()) == list(range(n))
        assert exact.look_up(digests, displace, n).tolist() == slot.tolist()


def _components(rows):
    sets = [(i, set(near.shingles(t or "").tolist())) for i, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) or (sets[a][0] is not None and sets[a][0] == sets[b][0]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return {(i, len(s)): min(least[find(k)], default=None) for k, (i, s) in enumerate(sets)}


def test_near_duplicates_match_brute_force(docs, empty):
    want = _components(ROWS)
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows} == want
    assert near.near_duplicates(empty).count() == 0
    assert near.drop_near_duplicates(docs).columns == docs.columns


def test_chains_of_edits_are_one_component(spark, docs):
    """A large group whose members drift from each other: no member is near all others."""
    words = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join(words[k % 17:k % 17 + 40] + [f"u{k // 17}"])) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}
    assert got == {i: c for (i, _), c in _components(rows).items()}


def test_shingles_and_posterior():
    assert len(near.shingles("A b\tc D e f")) == 2 and len(near.shingles("a B")) == 1 and len(near.shingles(" \n")) == 0
    assert near.shingles("A b")[0] == near.shingles("a  B")[0] != near.shingles("b a")[0]
    needed = near.least_matches(1024)
    assert all(m < 0.75 * n for n, m in needed) and [m for _, m in needed] == sorted(m for _, m in needed)


def test_components_of_a_long_path(spark):
    links = stored(spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (7, 7)], "a long, b long"), "t")
    got = {r["a"]: r["root"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {501: 500}


def test_fingerprints(docs, empty):
    rows = imatch.fingerprint_documents(docs).collect()
    assert len(rows) == len(ROWS)
    prints = defaultdict(set)
    text = {i: t or "" for i, t in ROWS if i is not None}
    ids = sorted(text)
    for r in rows:
        assert len(r["fingerprint"]) == 8 * imatch.SUBSETS and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            t = text[r["doc_id"]]
            prints[t].add(r["fingerprint"])
            after = ids[ids.index(r["doc_id"]) + 1] if r["doc_id"] != ids[-1] else None
            if after is not None:
                q = len(t) // 4
                assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[:len(t) - q] + text[after][:q]).encode()).hexdigest()
    assert all(len(x) == 1 for x in prints.values())
    assert imatch.fingerprint_documents(empty).count() == 0


def test_repeated_chunks_leave_all_but_the_first(docs, empty):
    got = {(r["doc_id"], r["n_lines"]): r for r in lines.deduplicate_lines(docs).collect()}
    assert sum(1 for _ in got) and all(r["left_lines"] + r["removed_lines"] == r["n_lines"] for r in got.values())
    assert got[(12, 1)]["text"] == "one two" and got[(5, 1)]["text"] == ""
    assert lines.deduplicate_lines(empty).count() == 0


def test_line_chunks_match_brute_force(spark):
    passage = [f"shared line {k} with some words in it" for k in range(12)]
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(k % 4)] + passage + [f"end {k}"])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(df).collect()}
    assert out[0] == rows[0][1]
    kept = Counter(line for t in out.values() for line in t.split("\n") if line.startswith("shared"))
    # The passage's inner chunks stay once; its ends share a chunk with what is around them.
    assert sum(1 for n in kept.values() if n == 1) >= 3 and all(set(f"own {k} {j}" for j in range(k % 4)) <= set(out[k].split("\n")) for k in out)


def test_planted_passages_inside_lines_go(spark):
    """Passages of 50 to 100 words, on one line among other words, in two different texts each."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abdeghilnorstu"), rng.integers(2, 8))) for _ in range(3000)]

    def run(n):
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in rng.choice(vocabulary, n))

    passages = [run(50 + k % 51) for k in range(60)]
    own = [(run(30), run(30)) for _ in range(120)]
    rows = [(k, f"{own[k][0]} {passages[k % 60]} {own[k][1]}") for k in range(120)]
    rows.append((None, "apart\n\n  from that\n"))
    out = {r["doc_id"]: r for r in lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(out[i]["text"] == t for i, t in rows[:60] + rows[-1:])
    kept = []
    for i, t in rows[60:120]:
        a, b = own[i]
        left = out[i]["text"]
        assert left.startswith(a) and left.rstrip().endswith(b), left
        kept.append((len(left.split()) - 60) / len(passages[i - 60].split()))
    assert max(kept) < 1 and sum(kept) / len(kept) < 0.2, kept


def test_lexicon_counts_terms_not_buckets(spark):
    """More terms than any small table has buckets: those of one document stay out, those of two are in."""
    rows = [(k, " ".join(f"only{k}x{j}" for j in range(2000)) + f" pair{k // 2} every") for k in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    band, common = imatch.lexicon(df)
    hashed = {w: h for w, h in spark.createDataFrame([(f"pair{k}",) for k in range(50)] + [("every",)], "w string").selectExpr("w", "xxhash64(w)").collect()}
    assert common == [hashed.pop("every")] and {r["term"] for r in band.collect()} == set(hashed.values())
    # The fingerprint hangs on the band's term alone: texts that share it are alike.
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_documents(df.withColumnRenamed("id", "doc_id")).collect()}
    assert all(got[k] == got[k + 1] for k in range(0, 100, 2))


def test_short_texts_have_fingerprints_of_their_own(spark):
    """Only texts without terms are alike with nothing to compare; any other pair of different terms is not."""
    rows = [(k, f"word{k}") for k in range(40)] + [(90, ""), (91, " \n")]
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[k]["fingerprint"] for k in range(40)}) == 40 and got[90]["fingerprint"] == got[91]["fingerprint"] == "0" * 8 * imatch.SUBSETS
    assert all(got[k]["near_next"] == 0 for k in range(40)) and got[90]["near_next"] == 1
    assert all(got[k]["near_edited"] < 1 for k in range(39))


def test_long_texts_without_lexicon_terms_use_all(spark):
    """Texts of many terms that no other text has: their fingerprints differ, an edit shows."""
    rows = [(k, " ".join(f"only{k}x{j}" for j in range(50))) for k in range(6)]
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({r["fingerprint"] for r in got.values()}) == 6 and all(0 < r["near_edited"] < 1 and set(r["fingerprint"]) != {"0"} for r in got.values())


def test_texts_of_one_id_are_one_document(spark):
    x, y, z = ("one two three four five six", "ten eleven twelve thirteen fourteen", "red green blue white black")
    rows = [(3, x), (14, x.upper()), (14, y), (20, y), (14, ""), (30, z), (30, "short text here and there"), (40, "")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got} == _components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {3: 3, 14: 3, 20: 3, 30: 30, 40: 40}
    left = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 30, 30, 40]


def _xx(data, seed=42):
    """Spark's xxhash64 of bytes, as a signed number."""
    x = xxhash.xxh64_intdigest(data, seed=seed & (1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def _cut_lines(text):
    """Units and (place, n, digest) of the chunks of a text, step by step."""
    after = "[\t\v\f\r\n\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]"
    units = re.sub(f"({after})", r"\1 ", text).split(" ")
    hashes = [_xx(u.encode()) for u in units]
    mask = (1 << 64) - 1
    rolled = [None if i < 2 else hashes[i] & mask ^ (hashes[i - 1] << 21) & mask ^ (hashes[i - 2] << 42) & mask for i in range(len(units))]
    rolled = [r if r is None or r < 1 << 63 else r - (1 << 64) for r in rolled]
    ends = [i for i in range(7, len(units) - 5) if rolled[i] < -(1 << 62) and all(rolled[i] < rolled[i - d] and rolled[i] <= rolled[i + d] for d in range(1, 6))]
    spans, begin = [], 0
    for e in ends + [len(units) - 1] * (len(units) > 0):
        digest = 42
        for x in hashes[begin:e + 1]:
            digest = _xx(x.to_bytes(8, "little", signed=True), digest)
        spans.append((begin, e + 1 - begin, digest))
        begin = e + 1
    return units, spans


def _without_repeats(rows):
    """(id, text) -> text left, chunks removed, by walking every pair of places."""
    cut = {(i, _xx(t.encode())): _cut_lines(t) for i, t in rows}
    first, times = {}, Counter()
    for at in sorted(cut):
        for place, n, digest in cut[at][1]:
            if n >= 5:
                first.setdefault(digest, (*at, place))
    out = {}
    for at, (units, spans) in cut.items():
        runs = []
        for place, n, digest in spans:
            f = first.get(digest)
            if n < 5 or f == (*at, place):
                continue
            if runs and runs[-1][0] + runs[-1][1] == place and runs[-1][2] == f[:2] and runs[-1][3] + runs[-1][1] == f[2]:
                runs[-1][1] += n
                runs[-1][4] += 1
            else:
                runs.append([place, n, f[:2], f[2], 1])
        gone, chunks = set(), 0
        for place, n, other, there, count in runs:
            theirs = cut[other][0]
            assert units[place:place + n] == theirs[there:there + n]
            left = right = 0
            while left < min(32, place, there) and units[place - left - 1].rstrip(" \t\n\v\f\r") == theirs[there - left - 1].rstrip(" \t\n\v\f\r"):
                left += 1
            while right < 32 and max(place, there) >= 0 and place + n + right < len(units) and there + n + right < len(theirs) \
                    and units[place + n + right].rstrip(" \t\n\v\f\r") == theirs[there + n + right].rstrip(" \t\n\v\f\r"):
                right += 1
            begin, end = place - left, place + n + right
            if begin > 0 and (left == 32 or "\n" not in units[begin - 1]):
                left -= next((k + 1 for k, u in enumerate(units[begin:min(end, begin + 7)]) if "\n" in u), 0)
            if not (end == len(units) and right < 32):
                right -= next((k for k, u in enumerate(reversed(units[max(begin, end - 7):end])) if "\n" in u), 0)
            own = units[place:place + n]
            if left + sum(u.strip(" \t\n\v\f\r") != "" for u in own) + right >= 8 and len(" ".join(own)) + left + right >= 16:
                gone |= set(range(place - left, place + n + right))
                chunks += count
        text = re.sub("([\t\v\f\r\n\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]) ", r"\1",
                      " ".join(u for k, u in enumerate(units) if k not in gone))
        out[at] = (text.rstrip(" \t\n\v\f\r") if len(units) - 1 in gone else text, chunks, len(spans))
    return out


def _passages(rng, kind, n):
    latin = ["".join(rng.choice(list("abceghilnorsu"), rng.integers(2, 8))) for _ in range(3000)]
    if kind == "words":
        return [" ".join(rng.choice(latin, 50 + k % 51)) for k in range(n)]
    if kind == "unspaced":
        return ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 200)) for _ in range(n)]
    return ["\n".join(" ".join(rng.choice(latin, 8)) for _ in range(6)) for _ in range(n)]


def test_left_text_equals_a_walk_over_all_places(spark):
    """Repeats inside a text and between texts, chains of copies, repeated lines, equal rows, scripts without blanks, odd white space."""
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    shared = [" ".join(rng.choice(words, rng.integers(5, 40))) for _ in range(12)] + _passages(rng, "unspaced", 3)
    rows = [(i, t) for i, t in ROWS if i is not None and t is not None]
    for k in range(60):
        parts = []
        for _ in range(rng.integers(1, 6)):
            parts += [" ".join(rng.choice(words, rng.integers(0, 30))), shared[rng.integers(0, 15)]]
        rows.append((100 + k // 2, str(rng.choice([" ", "\n", "\t \n", "\v"])).join(parts)))
    rows += [(200, "again\n" * 400), (201, "one two three four five six seven\n" * 100), (100, rows[-1][1]), (200, "again\n" * 400)]
    expected = Counter()
    model = _without_repeats(rows)
    for i, t in rows:
        expected[(i, *model[(i, _xx(t.encode()))])] += 1
    got = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r["doc_id"], r["text"], r["removed_chunks"], r["n_chunks"]) for r in got.collect()) == expected


def test_shared_passages_of_any_script_go(spark):
    """Passages of 50 to 100 words, 200 characters without blanks, six lines of eight words: the later copies lose nearly all of them."""
    rng = np.random.default_rng(12)
    rows, own = [], []
    for kind in ("words", "unspaced", "lines"):
        for p in _passages(rng, kind, 40):
            for copy in range(2):
                sides = _passages(rng, "words", 2)
                own.append(sides)
                rows.append((len(rows), f"{sides[0]} {p} {sides[1]}" if kind != "lines" else f"{sides[0]}\n{p}\n{sides[1]}"))
    out = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, (i, text) in enumerate(rows):
        a, b = own[k]
        if i % 2 == 0:
            assert out[i] == text
        else:
            assert out[i].startswith(a) and out[i].endswith(b)
            assert len(out[i]) - len(a) - len(b) <= 2 + 0.1 * (len(text) - len(a) - len(b)), (i, out[i])
