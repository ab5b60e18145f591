"""Source divergence audit (operator 11): term frequencies by single-pass in-memory indexing, then pairs of sources.

Each task reads its documents once and counts (language, term, source) postings in memory.  When the block is full it is
spilled as a run: sorted by term, cut by a hash of (language, term) into shards.  One task a shard merges its runs with a
heap, so that each term comes by once with all its sources, and only terms of enough documents go on.  Pairs of sources
start from the difference that terms missing in both have; terms that a source holds correct it by a histogram of shares,
and terms that both hold are streamed once more for the rest.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import stored

#: Postings (distinct language, source and term) that a block holds before it is spilled: under 100 MB with what its count needs.
BLOCK = 500_000
#: Bytes of text for each shard of the merge, and the most shards (a run has a page for each and language).
SHARD_BYTES, MOST_SHARDS = 8 << 20, 1 << 18
#: Bytes of texts that are split into terms at once; a longer text is split in slices that end between terms.
SLICE = 4 << 20
#: Pair corrections that a task holds before it hands them on.
PAIRS = 1 << 20
#: Shares are whole numbers of this unit, with this much added to every count.
UNIT, ADDED = 1_000_000_000, 5

#: A-Z to lower case; every ASCII character that isn't a letter to a blank.  Other bytes are parts of non-ASCII characters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RUN = pa.schema([("shard", pa.int32()), ("lang", pa.string()), *((c, pa.binary()) for c in ("terms", "term_ends", "sources", "source_ends", "counts", "docs"))])
RUN_DDL = "shard int, lang string, terms binary, term_ends binary, sources binary, source_ends binary, counts binary, docs binary"
KEPT_DDL = "lang string, term string, source string, count long, total long, head int"
KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("total", pa.int64()), ("head", pa.int32())])


def slices(text: bytes):
    """A text in slices that end at a blank or another character that no term holds."""
    start = 0
    while len(text) - start > SLICE:
        end = start + SLICE
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """(number of its text, code) of each term, and the terms that the codes stand for."""
    joined = b" ".join(texts).translate(FOLD)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    chars = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], chars != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside[1:-1]])]).dictionary_encode()
    return np.searchsorted(begins, starts, "right") - 1, terms.indices.to_numpy().astype(np.int64), terms.dictionary


def count_postings(groups: list[tuple[str, str]], texts: list[bytes]) -> pa.Table:
    """lang, source, term, count and docs over whole texts; ``groups`` has the language and source of each."""
    text, code, terms = split(texts)
    known = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    pair, times = np.unique(text * max(len(terms), 1) + code, return_counts=True)
    text, code = np.divmod(pair, max(len(terms), 1))
    pair = np.array([known[g] for g in groups], np.int64)[text] * max(len(terms), 1) + code
    order = np.argsort(pair, kind="stable")
    pair, times = pair[order], times[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
    group, code = np.divmod(pair[first], max(len(terms), 1))
    langs, sources = (pa.array([g[k] for g in known], pa.string()) for k in (0, 1))
    return pa.table({"lang": langs.take(group), "source": sources.take(group), "term": terms.take(code),
                     "count": np.add.reduceat(times, first) if len(first) else times, "docs": np.diff(np.append(first, len(pair)))})


class Block:
    """Postings of the documents read since the last spill."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.groups: list[tuple[str, str]] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        if len(text) > SLICE:
            whole = pa.concat_tables([count_postings([(lang, source)], [part]) for part in slices(text)])
            whole = whole.group_by(["lang", "source", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "max")])
            self.tables.append(whole.rename_columns(["lang", "source", "term", "count", "docs"]))
            return
        self.groups.append((lang, source))
        self.texts.append(text)
        self.bytes += len(text)
        if self.bytes > SLICE:
            self.count()

    def count(self) -> None:
        if self.texts:
            self.tables.append(count_postings(self.groups, self.texts))
            self.groups, self.texts, self.bytes = [], [], 0

    def full(self, block: int) -> bool:
        """More than ``block`` postings, also when equal ones of several tables are added up."""
        if sum(map(len, self.tables)) < block:
            return False
        self.tables = [self.summed()]
        return len(self.tables[0]) >= block // 2

    def summed(self) -> pa.Table:
        table = pa.concat_tables(self.tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
        return table.rename_columns(["lang", "source", "term", "count", "docs"])

    def spill(self, shards: int):
        """The block as a run: one page for each shard and language, in the order of term and source."""
        self.count()
        if not self.tables:
            return
        table, self.tables = self.summed(), []
        lang, source, term = (_ranked(table[c]) for c in ("lang", "source", "term"))
        hashes = np.fromiter((zlib.crc32(t) % shards for t in term[1].to_pylist()), np.int64, len(term[1]))
        order = np.lexsort((source[0], term[0], lang[0], hashes[term[0]]))
        table = table.take(pa.array(order)).combine_chunks()
        shard, lang = hashes[term[0]][order], lang[0][order]
        new = np.concatenate(([True], (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1])))
        cuts = np.append(np.flatnonzero(new), len(table))
        heads = table.take(pa.array(cuts[:-1]))
        columns = [pa.array(shard[cuts[:-1]], pa.int32()), heads["lang"].combine_chunks()]
        for name in ("term", "source"):
            columns += _pages_of_strings(table[name].combine_chunks(), cuts)
        columns += [_pages_of(table[name].to_numpy().astype("<i8"), cuts) for name in ("count", "docs")]
        for k in range(0, len(cuts) - 1, 512):
            yield pa.RecordBatch.from_arrays([c.slice(k, 512) for c in columns], schema=RUN)


def _ranked(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Ranks of the values among the distinct ones in byte order, and those in that order."""
    coded = column.cast(pa.binary()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _pages_of(values: np.ndarray, cuts: np.ndarray) -> pa.BinaryArray:
    """Fixed-width values as one binary for each page."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _pages_of_strings(values: pa.Array, cuts: np.ndarray) -> list[pa.BinaryArray]:
    """Strings as one binary for each page, and where in it each ends."""
    values = pa.array(values.to_pylist(), pa.binary()) if values.offset else values
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)
    text = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts].astype(np.int32)), values.buffers()[2]])
    begins = np.repeat(ends[cuts[:-1]], np.diff(cuts))
    return [text, _pages_of((ends[1:] - begins).astype("<i4"), cuts)]


def spill_runs(docs: DataFrame, shards: int, block: int = BLOCK) -> DataFrame:
    """Pages of term-sorted runs; ``docs`` has lang, source and text (binary)."""

    def run(batches):
        held = Block()
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
                held.add(lang, source, text.as_py())
                if held.full(block):
                    yield from held.spill(shards)
        yield from held.spill(shards)

    return docs.select("lang", "source", "text").mapInArrow(run, RUN_DDL)


def _strings(text: bytes, ends: bytes) -> list[bytes]:
    at = np.frombuffer(ends, "<i4").tolist()
    return [text[a:b] for a, b in zip([0, *at], at)]


def _postings(page: dict) -> zip:
    """(term, source, count, docs) of a page, in its order."""
    return zip(_strings(page["terms"], page["term_ends"]), _strings(page["sources"], page["source_ends"]),
               np.frombuffer(page["counts"], "<i8").tolist(), np.frombuffer(page["docs"], "<i8").tolist(), strict=True)


def merge_runs(runs: DataFrame, least_docs: int) -> DataFrame:
    """Frequencies of the terms in at least ``least_docs`` documents of their language: a row for each source that has the term.

    ``total`` is the term's count in the language; ``head`` is 1 in one row of each term."""

    def merge(shard: pa.Table) -> pa.Table:
        out = []
        pages: dict[str, list[dict]] = {}
        for page in shard.to_pylist():
            pages.setdefault(page["lang"], []).append(page)
        for lang, runs_of_lang in pages.items():
            for term, same in itertools.groupby(heapq.merge(*map(_postings, runs_of_lang)), key=itemgetter(0)):
                postings = list(same)
                if sum(p[3] for p in postings) < least_docs:
                    continue
                by_source: dict[bytes, int] = {}
                for _, source, n, _ in postings:
                    by_source[source] = by_source.get(source, 0) + n
                total, text = sum(by_source.values()), term.decode()
                out += [(lang, text, source.decode(), n, total, int(k == 0)) for k, (source, n) in enumerate(by_source.items())]
        columns = list(zip(*out)) or [()] * len(KEPT)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KEPT, strict=True)], schema=KEPT)

    return runs.groupBy("shard").applyInArrow(merge, KEPT_DDL)


def share(count: Column, out_of: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / out_of), exact while out_of * 1000 fits in 64 bits: long division to base 1000."""
    rest, digits = count + F.lit(ADDED), F.lit(0)
    for _ in range(3):
        up = rest * F.lit(1000)
        rest = up % out_of
        digits = digits * F.lit(1000) + _div(up, out_of)
    return digits + F.lit(1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _distance(a, b) -> Column:
    return F.abs(F.col(a) - F.col(b))


def _whole_terms(batches):
    """Tables that end with the last row of a term."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        new = _new_term(rows)
        cut = int(np.flatnonzero(new)[-1]) if len(new) else 0
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _new_term(rows: pa.Table) -> np.ndarray:
    """Whether a row begins another term than the one before."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = False
        for c in ("lang", "term"):
            column = rows[c].combine_chunks()
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
    return new


def _corrections(rows: pa.Table):
    """((lang, source, other), correction) summed over the terms: rows that lie d apart and have one term, for every d."""
    term = np.cumsum(_new_term(rows))
    (lang, langs), (source, sources) = (_ranked(rows[c]) for c in ("lang", "source"))
    p, zero = rows["p"].to_numpy(), rows["zero"].to_numpy()
    pair, add = [], []
    for d in range(1, int(np.bincount(term).max(initial=0))):
        at = np.flatnonzero(term[d:] == term[:-d])
        a, b = at, at + d
        pair.append((lang[a] * len(sources) + source[a]) * len(sources) + source[b])
        add.append(np.abs(p[a] - p[b]) - np.abs(p[a] - zero[b]) - np.abs(zero[a] - p[b]) + np.abs(zero[a] - zero[b]))
        if sum(map(len, pair)) > PAIRS:
            pair, add = [[x] for x in _summed(pair, add)]
    if pair:
        langs, sources = ([x.decode() for x in names.to_pylist()] for names in (langs, sources))
        for key, x in zip(*(c.tolist() for c in _summed(pair, add))):
            yield (langs[key // len(sources) ** 2], sources[key // len(sources) % len(sources)], sources[key % len(sources)]), x


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(value, first) if len(first) else value


def shared_corrections(terms: DataFrame) -> DataFrame:
    """(lang, source, other, correction) over terms that both sources hold, once for each two sources (source < other).

    ``terms`` (lang, term, source, p, zero) is dealt by term and streamed; corrections are added up in the task."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("correction", pa.int64())])

    def run(batches):
        held: Counter = Counter()

        def table():
            keys = list(zip(*held)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in keys] + [pa.array(held.values(), pa.int64())], schema=schema)

        for rows in _whole_terms(batches):
            for key, x in _corrections(rows):
                held[key] += x
                if len(held) >= PAIRS:
                    yield table()
                    held.clear()
        yield table()

    dealt = terms.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(run, "lang string, source string, other string, correction long")


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50, block: int = BLOCK) -> DataFrame:
    """How far the sources of each language lie apart in their terms: lang, source, part, item, value, rank.

    Terms are runs of letters and non-ASCII characters, A-Z in lower case; a language keeps those of at least ``least_docs``
    documents.  Part ``pair`` has every other source of the language, part ``term`` the ``top_terms`` terms that a source
    holds more of than its language.  Null text, lang and source are empty strings; repeated rows count each; other columns
    are not read.  A group without terms is compared like any other; a language without kept terms gives pairs of value 0 and
    no terms; a language of one source gives no pairs; an empty table gives no rows.  Very long texts are split in slices.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    groups = stored(own.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "audit-groups")
    size = groups.agg(F.sum("bytes")).collect()[0][0] or 0
    runs = spill_runs(own, max(1, min(MOST_SHARDS, -(-size // SHARD_BYTES))), block)
    kept = stored(merge_runs(runs, least_docs), "audit-terms")

    langs = kept.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("count").alias("lang_n"))
    own_n = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    none = F.lit(0).cast("long")
    measured = (groups.select("lang", "source").join(own_n, ["lang", "source"], "left").join(langs, "lang", "left")
                .select("lang", "source", F.coalesce("v", none).alias("v"), F.coalesce("n", none).alias("n"), F.coalesce("lang_n", none).alias("lang_n")))
    out_of, lang_out_of = F.col("n") + ADDED * F.col("v"), F.col("lang_n") + ADDED * F.col("v")
    sides = stored(measured.select("lang", "source", "v", out_of.alias("out_of"), lang_out_of.alias("lang_out_of"),
                                   F.when(F.col("v") > 0, share(none, F.greatest(out_of, F.lit(1)))).otherwise(none).alias("zero")), "audit-sides")

    terms = kept.join(sides, ["lang", "source"]).select(
        "lang", "source", "term", "zero", share(F.col("count"), F.col("out_of")).alias("p"), share(F.col("total"), F.col("lang_out_of")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    term_part = (terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
                 .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms))

    others = sides.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    base = (sides.join(others, "lang").filter("source <> other")
            .select("lang", "source", "other", (F.col("v") * _distance("zero", "other_zero")).alias("value")))
    shares = terms.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("n_terms"))
    held = (shares.join(others, "lang").filter("source <> other").groupBy("lang", "source", "other")
            .agg(F.sum(F.col("n_terms") * (_distance("p", "other_zero") - _distance("zero", "other_zero"))).alias("value")))
    both = shared_corrections(terms).withColumnRenamed("correction", "value")

    def turned(df):
        return df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")

    parts = [base, held, turned(held), both, turned(both)]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pair_part = (pairs.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
                 .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)))
    return pair_part.unionByName(term_part)
