"""MinHash near-duplicates with sequential Bayesian verification (operator 8).

Texts become sets of word shingles.  Equal sets are one class, represented by its smallest doc_id.  Banded MinHash
signatures put representatives into buckets.  Candidates are compared in batches of signature values: a pair is pruned
as soon as the posterior probability that its similarity reaches the threshold falls below ``MISS``.
Survivors are verified on their full shingle sets.

A bucket isn't expanded into all pairs.  First every member is compared with the bucket's head.  The links found form
components; only members of different components that still share a bucket are then compared with each other.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import stored, texts, word_cache
from tidelog.llm.components import components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values of the long signature, by which members of different components are told apart; a byte of each is kept.
LONG = 1024
#: Signature values compared before each look at the posterior, at first.
BATCH = 16
#: A pair is pruned where its similarity reaches the threshold with less than this probability.
MISS = 1e-7
#: Members of a bucket that are held at once on either side, about.
BLOCK = 1024
#: Documents for each task that writes a table of small rows, about.
ROWS_A_TASK = 20_000
#: Word hashes kept by one worker.
KEPT = 500_000

_random = np.random.default_rng(20240229)
_A = _random.integers(0, 1 << 32, HASHES + LONG, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES + LONG, dtype=np.uint32)
_PLACE = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finishing multiplications of a 64-bit hash (fixed constants of a common finisher)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    kept = word_cache("shingles")
    got = list(map(kept.get, words))
    if None in got:
        for k, h in enumerate(got):
            if h is None:
                got[k] = h = int.from_bytes(hashlib.blake2b(words[k], digest_size=8).digest(), "little")
                if len(kept) < KEPT:
                    kept[words[k]] = h
    return np.array(got, np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``WORDS`` words; fewer words: the whole sequence as one; none: empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = len(h)
    width = min(n, WORDS)
    s = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        s += h[k:n - width + 1 + k] * _PLACE[k]
    return np.unique(_mixed(s))


def signature(s: np.ndarray, first: int = 0, end: int = HASHES) -> np.ndarray:
    """Least value of each hash function over a nonempty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(end - first, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):  # long sets in pieces that stay in cache
        y = np.multiply.outer(_A[first:end], x[k:k + 512])
        y += _B[first:end, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: equal where all its values are."""
    v = sig.reshape(BANDS, ROWS).astype(np.uint64)
    x = (v * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(x).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), sig, bands (null without shingles)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                s = shingles(text)
                if len(s):
                    sig = signature(s)
                    rows.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.tobytes(), bands(sig)))
                else:
                    rows.append((doc, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "sig", "bands"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return texts(docs).mapInPandas(run, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def least_matches(hashes: int = HASHES, threshold: float = PERCENT / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): with a uniform prior, fewer matches leave P(similarity >= threshold) below ``miss``.

    Batches double in size from ``BATCH`` values compared on.
    """
    out, n = [], BATCH
    while n <= hashes:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
        n *= 2
    return out


def long_signature(text: Column) -> Column:
    """The lowest byte of each of ``LONG`` further signature values, then the keys of all bands."""

    def one(text: str) -> bytes:
        s = shingles(text)
        return signature(s, HASHES, HASHES + LONG).astype(np.uint8).tobytes() + bands(signature(s)).tobytes()

    @F.pandas_udf("binary")
    def lows(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return lows(text)


def plausible(sig_a: Column, sig_b: Column) -> Column:
    """Whether a pair of signatures survives the sequential comparison."""
    needed = least_matches()

    @F.pandas_udf("boolean")
    def survives(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint32).reshape(-1, HASHES)
        y = np.frombuffer(b"".join(b), np.uint32).reshape(-1, HASHES)
        alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, least in needed:
            matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], n
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pd.Series(out)

    return survives(sig_a, sig_b)


def similar(text_a: Column, text_b: Column) -> Column:
    """100 * intersection >= PERCENT * union on the full shingle sets."""

    @F.pandas_udf("boolean")
    def confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last = [], (None, None)
        for x, y in zip(a, b, strict=True):
            s = shingles(x)
            if last[0] != y:  # pairs with one head often follow each other
                last = (y, shingles(y))
            t = last[1]
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(len(s) > 0 and 100 * common >= PERCENT * (len(s) + len(t) - common))
        return pd.Series(out, dtype=bool)

    return confirmed(text_a, text_b)


def _verified(pairs: DataFrame, sigs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: pruned by signatures, then confirmed on full sets."""
    one, two = (sigs.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT  # else no overlap reaches the threshold
    left = pairs.join(one, "a").join(two, "b").filter(size).filter(plausible(F.col("sig_a"), F.col("sig_b")))
    return _confirmed(stored(left.select("a", "b").distinct(), "plausible"), bodies)


def _confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    one, two = (bodies.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return stored(pairs.join(one, "a").join(two, "b").filter(similar(F.col("text_a"), F.col("text_b"))).select("a", "b"), "links")


def _merged(roots: DataFrame, more: DataFrame, few: int) -> DataFrame:
    """roots (a, root) after further links: only the components' roots are linked anew."""
    of = [roots.select(F.col("a").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
    between = more.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = components(stored(between.distinct().coalesce(few), "root-links"))
    again = above.select(F.col("a").alias("root"), F.col("root").alias("top"))
    moved = roots.join(again, "root", "left").select("a", F.coalesce("top", "root").alias("root"))
    return stored(moved.unionByName(above).coalesce(few), "roots")


def _met(shared: DataFrame, roots: DataFrame, bodies: DataFrame, few: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket, as far as their long signatures allow.

    In a bucket that holds several components, the members outside its largest one meet all others.  Both sides are
    dealt into blocks of about ``BLOCK`` rows, and a task holds two blocks of a bucket at a time, however many there are.
    """
    marked = shared.join(roots.withColumnRenamed("a", "rep"), "rep", "left").select("band", "rep", "head", F.coalesce("root", "rep").alias("root"))
    marked = stored(marked, "marked-bands")
    sizes = marked.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(
        F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).filter("k > 1")
    sizes = stored(sizes.select("band", F.col("top.root").alias("top"), F.ceil((F.col("rows") - F.col("top.n")) / BLOCK).cast("int").alias("minor_blocks"),
                                F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")).coalesce(few), "mixed-buckets")
    apart = stored(marked.join(sizes, "band"), "apart-bands")
    lows = stored(bodies.join(apart.select("rep").distinct(), "rep").select("rep", long_signature(F.col("text")).alias("low")), "long-signatures")
    members = stored(apart.join(lows, "rep"), "apart-signatures")
    own, own_minor = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("minor_blocks")).cast("int")
    row = ["band", "rep", "root", F.col("rep").eqNullSafe(F.col("head")).alias("is_head"), (F.col("root") == F.col("top")).alias("in_top"), "low"]
    minor = members.filter("root <> top").withColumn("i", own_minor).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = members.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)))
    both = minor.select(*row, "i", "j", F.lit(True).alias("minor")).unionByName(every.select(*row, "i", "j", F.lit(False).alias("minor")))
    key = ["band", "i", "j"]
    return both.repartition(*key).sortWithinPartitions(*key).mapInPandas(_meet, "a long, b long").distinct()


def _meet(batches):
    """Rows sorted by (band, i, j) -> pairs that the long signatures don't rule out."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        key = held[["band", "i", "j"]].to_numpy()
        cuts = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1
        if len(cuts):
            yield _pairs(held.iloc[:cuts[-1]], cuts[:-1])
            held = held.iloc[cuts[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield _pairs(held, np.zeros(0, int))


def _pairs(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
    low = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(len(rows), LONG + 8 * BANDS)
    keys, band = np.ascontiguousarray(low[:, LONG:]).view(np.int64), rows["band"].to_numpy()
    rep, root = rows["rep"].to_numpy(), rows["root"].to_numpy()
    minor, top, head = rows["minor"].to_numpy(), rows["in_top"].to_numpy(), rows["is_head"].to_numpy()
    needed, out = least_matches(LONG), []
    for first, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        left, right = (first + np.nonzero(x)[0] for x in (minor[first:end], ~minor[first:end]))
        for k in range(0, len(left), 128):
            a = left[k:k + 128]
            # Two minor members meet once; the head has met every member before.
            x, y = np.nonzero((root[a][:, None] != root[right]) & (top[right] | (rep[a][:, None] > rep[right])) & ~head[a][:, None] & ~head[right])
            x, y = a[x], right[y]
            done, matches = 0, np.zeros(len(x), np.int64)
            for n, least in needed:
                matches = matches + (low[x, done:n] == low[y, done:n]).sum(axis=1)
                keep = matches >= least
                x, y, matches, done = x[keep], y[keep], matches[keep], n
                if not len(x):
                    break
            if len(x):  # in the first bucket that both share
                both = keys[x] == keys[y]
                once = keys[x, both.argmax(axis=1)] == band[x]
                x, y = x[once], y[once]
            out.append((rep[x], rep[y]))
    a, b = (np.concatenate([p[side] for p in out]) if out else np.zeros(0, np.int64) for side in (0, 1))
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def _ties(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the representatives of the classes that one doc_id's texts belong to."""
    named = rows.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_key")
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).filter("one <> other").select("doc_id")
    several = stored(several, "repeated-ids")
    reps = named.join(several, "doc_id").distinct().join(classes, "set_key").select("doc_id", "rep")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return reps.join(least, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    component_id: the smallest doc_id reachable by links, itself included; kept: doc_id = component_id.
    Null and empty texts have no shingles and are linked with nothing.  Rows that share a doc_id count as one document,
    linked by any of its texts.  Rows with null doc_id join the class of their equal set but link nothing; where no row
    of the class has an id, component_id is null and the row is kept.  Empty table: no rows.  Other columns are not read.
    """
    rows = stored(sketches(docs), "sketches")
    few = max(1, -(-rows.count() // ROWS_A_TASK))
    classes = stored(rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep")).coalesce(few), "classes")
    reps = rows.join(classes.filter("rep is not null").select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"]).withColumnRenamed("doc_id", "rep")
    reps = stored(reps.dropDuplicates(["rep", "set_key"]).select("rep", "n_shingles", "sig", "bands"), "representatives")
    in_band = reps.select("rep", F.explode("bands").alias("band"))
    heads = stored(in_band.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).filter("head < tail").select("band", "head").coalesce(few), "heads")
    shared = stored(in_band.join(heads.hint("merge"), "band"), "shared-bands")  # by shuffle at every size, as all sides grow
    candidates = stored(shared.select("rep").distinct().coalesce(few), "candidates")
    sigs = stored(reps.join(candidates.hint("merge"), "rep").select("rep", "sig", "n_shingles"), "signatures")
    bodies = stored(texts(docs).withColumnRenamed("doc_id", "rep").join(candidates.hint("merge"), "rep"), "candidate-texts")

    stars = shared.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    links = _verified(stars, sigs, bodies)
    links = stored(links.select("a", "b").unionByName(_ties(rows, classes)), "all-links")
    roots = components(links)
    more = _confirmed(stored(_met(shared, roots, bodies, few), "met"), bodies)
    if not more.isEmpty():
        roots = _merged(roots, more, few)
    named = classes.join(roots.withColumnRenamed("a", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("class_component"))
    named = stored(named.coalesce(few), "named")
    linked = rows.select("doc_id", "n_shingles", "set_key").filter("n_shingles > 0").join(named.hint("merge"), "set_key").drop("set_key")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles")
    others = linked.join(alone.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("class_component").alias("class_component"))
    alone = alone.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("class_component"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", F.col("class_component").alias("component_id"),
                                            F.col("doc_id").eqNullSafe(F.col("class_component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id.  Rows without an id stay.  All columns stay."""
    gone = near_duplicates(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_tl_id")).distinct()
    return docs.join(stored(gone, "near-repeats").hint("merge"), F.col("doc_id") == F.col("_tl_id"), "left_anti")
