"""Content-defined chunks of lines and of parts of lines (operator 10), in DataFrame operations only.

A text is cut into units, whatever its line ends are: a word, or one character of a script that is written without blanks.  A rolling hash runs over the units' hashes; a chunk ends at a unit whose rolling hash is the least
among its neighbours', so a shared passage is cut at the same places wherever it lies, in any language.  Chunks that occur
again anywhere, in the same or another document, are joined to runs that lie side by side in a first occurrence too.  A run's
text is compared with the first one's, byte for byte, and grown by the words on both sides that equal the first one's; runs
of enough words are removed, but for a few words at their edges that belong to a line of other words.  The first occurrence (smallest doc_id, then place) of a chunk stays: what is removed always
equals something before it, in that order, so one copy of every word of a run is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import stored, texts

#: Characters of scripts that are written without blanks: Thai to Lao, Burmese, Khmer, ideographs and kana.
UNSPACED = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u2E80-\\u9FFF\\uF900-\\uFAFF\\uFF00-\\uFFEF\\x{20000}-\\x{3FFFF}"
#: A unit ends after each of these, after a line feed and at each blank.
AFTER = f"[\\t\\x0B\\f\\r{UNSPACED}]"
#: A chunk's end has the least rolling hash among so many units on each side, and one of the lowest quarter: about 11 units on average.
AROUND, LOWEST = 5, -(1 << 62)
#: Units that go into a rolling hash, by shifts of so many bits.
SHIFTS = (21, 42)
#: Runs of fewer units or characters, grown, stay.
LEAST_WORDS, LEAST_CHARS = 8, 16
#: Units on each side of a run that are compared with the first one's: an end of a passage lies in a chunk, and most chunks are shorter.
BESIDE = 32
BLANKS = " \t\n\v\f\r"
NO_ID = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is."""
    return F.transform(F.array(value), body)[0]


def _spread(text: Column) -> Column:
    """The text with a blank after each character that ends a unit and is none itself; ``_joined`` takes them away again."""
    text = F.when(F.rlike(text, F.lit(AFTER)), F.regexp_replace(text, f"({AFTER})", "$1 ")).otherwise(text)
    return F.replace(text, F.lit("\n"), F.lit("\n "))


def _units(text: Column) -> Column:
    """text -> array of its units, without the blanks between them; an empty text is one empty unit."""
    return F.split(_spread(text), " ")


def _joined(units: Column) -> Column:
    """Units -> their text."""
    text = F.replace(F.array_join(units, " "), F.lit("\n "), F.lit("\n"))
    return F.when(F.rlike(text, F.lit(AFTER)), F.regexp_replace(text, f"({AFTER}) ", "$1")).otherwise(text)


def _rolling(h: Column) -> Column:
    """Hashes of units -> rolling hashes; null where there are too few units before."""
    def at(x: Column, i: Column) -> Column:
        for k, bits in enumerate(SHIFTS, 1):
            x = x.bitwiseXOR(F.shiftleft(F.get(h, i - k), bits))
        return x

    return F.transform(h, at)


def _chunks(text: Column) -> Column:
    """text -> array of (place, n, digest) of its chunks: first unit, number of units and a hash of the units' hashes."""
    def is_end(r: Column, x: Column, i: Column) -> Column:
        # Null, that is no end, near the text's ends: where a chunk ends hangs on units inside the text alone.
        least = x < LOWEST
        for k in range(1, AROUND + 1):
            least = least & (x < F.get(r, i - k)) & (x <= F.get(r, i + k))
        return least

    def spans(h: Column) -> Column:
        ends = _let(_rolling(h), lambda r: F.filter(F.transform(r, lambda x, i: F.when(is_end(r, x, i), i)), lambda e: e.isNotNull()))
        ends = F.when(F.size(h) > 0, F.concat(ends, F.array(F.size(h) - 1))).otherwise(F.array().cast("array<int>"))

        def cut(e: Column) -> Column:
            firsts = F.transform(e, lambda end, k: F.struct((F.coalesce(F.get(e, k - 1), F.lit(-1)) + 1).alias("place"), end.alias("end")))
            return F.transform(firsts, lambda s: F.struct(s["place"], (s["end"] - s["place"] + 1).alias("n"),
                                                          F.xxhash64(F.slice(h, s["place"] + 1, s["end"] - s["place"] + 1)).alias("digest")))

        return _let(ends, cut)

    return _let(F.transform(_units(text), lambda u: F.xxhash64(u)), spans)


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _common(a: Column, b: Column) -> Column:
    """How many units at the start of two arrays are equal, one by one, but for white space at their ends; none where either is null."""
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.coalesce((p["x"] == p["y"]) | (_trimmed(p["x"]) == _trimmed(p["y"])), F.lit(False)))
    return F.coalesce(_let(same, lambda s: F.when(F.array_contains(s, False), F.array_position(s, False) - 1).otherwise(F.size(s)).cast("int")), F.lit(0))


def _sliced(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every span of ``wanted`` (id, h, spans) with its units and those beside it, blanks between them; null where there are none beside."""
    def slices(u: Column) -> Column:
        def of(s: Column) -> Column:
            end = s["place"] + s["n"]
            left = F.least(s["place"], F.lit(BESIDE))
            return F.struct(s.alias("span"), F.array_join(F.slice(u, s["place"] + 1, s["n"]), " ").alias("body"),
                            F.when(left > 0, F.array_join(F.slice(u, s["place"] - left + 1, left), " ")).alias("before"),
                            F.when(end < F.size(u), F.array_join(F.slice(u, end + 1, F.lit(BESIDE)), " ")).alias("after"))

        return F.transform("spans", of)

    found = rows.join(wanted.hint("merge"), ["id", "h"]).select("id", "h", F.explode_outer(_let(_units(F.col("text")), slices)).alias("s"))
    return found.select("id", "h", "s.span.*", "s.body", "s.before", "s.after")


def _grown(left: Column, right: Column) -> tuple[Column, Column]:
    """How far a run reaches to the left and the right of its chunks.

    Fewer than ``LEAST_WORDS`` units of a line at the run's edges, with others of that line beside them, stay with their line.
    """
    def breaks(units: Column) -> Column:
        """Place (from 1) of the first of some units at the edge that ends a line; 0 where none does."""
        return F.array_position(F.transform(F.slice(units, 1, LEAST_WORDS - 1), lambda u: F.contains(u, F.lit("\n"))), True).cast("int")

    none = F.array().cast("array<string>")
    before, after = F.coalesce("before", none), F.coalesce("after", none)
    begins = (F.col("place") == left) | F.coalesce(F.contains(F.get(before, left), F.lit("\n")), F.lit(False))
    ends = (F.size(after) == right) & (right < BESIDE)
    first = breaks(F.concat(F.reverse(F.slice(before, F.lit(1), left)), F.slice("units", 1, LEAST_WORDS)))
    last = breaks(F.concat(F.reverse(F.slice(after, F.lit(1), right)), F.slice(F.reverse("units"), 1, LEAST_WORDS)))
    return left - F.when(begins, 0).otherwise(first), right - F.when(ends, 0).otherwise(F.greatest(last - 1, F.lit(0)))


def _runs(chunked: DataFrame) -> DataFrame:
    """id, h, place, n, chunks, first_id, first_h, first_place: runs of chunks that occur before, side by side there too."""
    # Counts and smallest ids are gathered in every task before they are shuffled; the hash only finds candidates.
    repeated = stored(chunked.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "repeated-chunks")
    again = stored(chunked.join(repeated.hint("merge"), "digest").select("digest", "id", "h", "place", "n", "first_id"), "chunk-copies")
    firsts = again.filter("id = first_id").groupBy("digest").agg(F.min(F.struct("h", "place")).alias("f"))
    firsts = stored(firsts.select("digest", F.col("f.h").alias("first_h"), F.col("f.place").alias("first_place")), "first-chunks")
    copies = again.join(firsts.hint("merge"), "digest").filter("id != first_id or h != first_h or place != first_place")
    copies = copies.select("id", "h", "place", "n", "first_id", "first_h", "first_place").dropDuplicates(["id", "h", "place"])
    order = Window.partitionBy("id", "h").orderBy("place")
    goes_on = F.lit(True)
    for c in ("first_id", "first_h"):
        goes_on = goes_on & (F.lag(c).over(order) == F.col(c))
    for c in ("place", "first_place"):
        goes_on = goes_on & (F.lag(F.col(c) + F.col("n")).over(order) == F.col(c))
    copies = copies.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    copies = copies.withColumn("run", F.sum("begins").over(order))
    runs = copies.groupBy("id", "h", "run", "first_id", "first_h").agg(
        F.min("place").alias("place"), F.sum("n").cast("int").alias("n"), F.count(F.lit(1)).alias("chunks"), F.min("first_place").alias("first_place"))
    return stored(runs.drop("run"), "chunk-runs")


def _cuts(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """id, h, chunks, pieces, rest: what is left of each text with something removed, as (place, n) of units and the place of the last piece."""
    own = runs.groupBy("id", "h").agg(F.collect_list(F.struct("place", "n", "chunks", "first_id", "first_h", "first_place")).alias("spans"))
    first = runs.select(F.col("first_id").alias("id"), F.col("first_h").alias("h"), F.col("first_place").alias("place"), "n").distinct()
    first = first.groupBy("id", "h").agg(F.collect_list(F.struct("place", "n")).alias("spans"))
    firsts = _sliced(rows, first).select(F.col("id").alias("first_id"), F.col("h").alias("first_h"), F.col("place").alias("first_place"), "n",
                                         *[F.col(c).alias(f"first_{c}") for c in ("body", "before", "after")])
    equal = _sliced(rows, own).join(firsts.hint("merge"), ["first_id", "first_h", "first_place", "n"]).filter(F.col("body") == F.col("first_body"))
    split = {c: F.split(c, " ") for c in ("after", "first_after")} | {c: F.reverse(F.split(c, " ")) for c in ("before", "first_before")}
    equal = equal.withColumns(split | {"units": F.split("body", " "), "chars": F.char_length("body")})
    equal = equal.withColumns({"left": _common(F.col("before"), F.col("first_before")), "right": _common(F.col("after"), F.col("first_after")),
                               "words": F.size(F.filter("units", lambda u: _trimmed(u) != ""))})
    reach = _grown(F.col("left"), F.col("right"))
    equal = equal.select("id", "h", "place", "n", "chunks", "words", "chars", reach[0].alias("left"), reach[1].alias("right"))
    equal = equal.filter((F.col("words") + F.col("left") + F.col("right") >= LEAST_WORDS) & (F.col("chars") + F.col("left") + F.col("right") >= LEAST_CHARS))
    equal = equal.select("id", "h", "chunks", (F.col("place") - F.col("left")).alias("from"), (F.col("place") + F.col("n") + F.col("right")).alias("to"))
    earlier = Window.partitionBy("id", "h").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("place", F.coalesce(F.max("to").over(earlier), F.lit(0)))
    kept = F.when(F.col("from") > F.col("place"), F.struct("place", (F.col("from") - F.col("place")).alias("n")))
    return equal.groupBy("id", "h").agg(F.sum("chunks").alias("chunks"), F.sort_array(F.collect_list(kept)).alias("pieces"), F.max("to").alias("rest"))


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_chunks, removed_chunks, left_lines, removed_lines: one row for each row of ``docs``.

    Lines are cut at line feeds; an empty or null text is one empty line and one chunk.  ``removed_lines`` are the lines that
    the text has fewer, ``removed_chunks`` the repeated chunks removed.  Where a text's end goes, the white space before it goes too.
    Rows that share a doc_id are told apart by a hash of their text; rows equal in both are repeats of one another, and what is
    removed from one is removed from all but is counted as one occurrence.  A null doc_id comes first.  Very long texts are
    read whole; a task holds one text at a time.  Empty table: no rows.  Extra columns are not read.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), "text")
    # No array here is empty; an outer explode spares the filter on emptiness, which would compute every array twice.
    chunked = rows.select("id", "h", _chunks(F.col("text")).alias("chunks")).select("id", "h", F.size("chunks").alias("of"), F.explode_outer("chunks").alias("c"))
    chunked = stored(chunked.select("id", "h", "of", "c.*"), "line-chunks")
    runs = _runs(chunked.filter(F.col("n") >= AROUND))
    # All joins read this one: texts are shuffled once, and repeats of a row go as one.
    once = rows.groupBy("id", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    sizes = chunked.groupBy("id", "h").agg(F.max("of").cast("long").alias("n_chunks"))
    found = once.join(_cuts(once, runs).hint("merge"), ["id", "h"], "left").join(sizes.hint("merge"), ["id", "h"], "left")

    def left(u: Column) -> Column:
        rest = F.when(F.col("rest") < F.size(u), F.array(F.struct(F.col("rest").alias("place"), (F.size(u) - F.col("rest")).alias("n"))))
        pieces = F.concat("pieces", F.coalesce(rest, F.array().cast("array<struct<place:int,n:int>>")))
        joined = _joined(F.flatten(F.transform(pieces, lambda p: F.slice(u, p["place"] + 1, p["n"]))))
        return F.when(rest.isNull(), _trimmed(joined)).otherwise(joined)

    def lines_in(text: Column) -> Column:
        return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")

    zero = F.lit(0).cast("long")
    changed = F.when(F.col("chunks").isNull(), F.col("text")).otherwise(_let(_units(F.col("text")), left))
    found = found.select("id", "times", changed.alias("text"), lines_in(F.col("text")).alias("n_lines"), F.coalesce("n_chunks", zero).alias("n_chunks"),
                         F.coalesce("chunks", zero).alias("removed_chunks"))
    found = found.withColumn("left_lines", F.when((F.col("text") == "") & (F.col("removed_chunks") > 0), zero).otherwise(lines_in(F.col("text"))))
    found = found.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "n_lines", "n_chunks", "removed_chunks", "left_lines",
                        (F.col("n_lines") - F.col("left_lines")).alias("removed_lines"))
