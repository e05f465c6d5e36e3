"""Document fingerprints by winnowing, in DataFrame operations only.

The grams are runs of GRAM words. Their hashes roll up by doubling: a hash of a pair of neighbours from two word
hashes, of four from two pairs, of GRAM from four and one; each step is one pass over an array. The minimum of each
window of WINDOW gram hashes rolls up in the same way, with the rightmost place on ties (hash and place share one
number, later places being smaller). Chosen grams keep their places, so two texts that share a run of at least
GRAM + WINDOW - 1 words share a chosen gram.

Defined cases: null text counts as empty and has an empty fingerprint; texts of fewer than GRAM words are one gram,
texts of fewer than WINDOW grams one window; two empty fingerprints are alike (1.0), an empty one and another are
not (0.0); the next document of a lone row is itself; rows that share a doc_id are ordered by text; null ids come
last; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let

GRAM, WINDOW = 5, 6
#: Ranges of ids that are ordered apart from each other: rows in each at this scale, and the most of them.
ROWS_PER_RANGE, MAX_RANGES = 4000, 2048
_LOW31 = (1 << 31) - 1


def _shift(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(n + 1), F.greatest(F.size(xs) - n, F.lit(0)))


def gram_hashes(words: Column) -> Column:
    """Hashes of the runs of GRAM words, as numbers below 2**32; of all words where they are fewer."""

    def rolled(one: Column) -> Column:
        pair = lambda a, b: F.xxhash64(a, b)
        n = F.size(one)
        out = let(F.zip_with(one, _shift(one, 1), pair), lambda two: let(F.zip_with(two, _shift(two, 2), pair), lambda four: F.zip_with(four, _shift(one, 4), pair)))
        return F.when(n >= GRAM, F.slice(out, F.lit(1), F.greatest(n - GRAM + 1, F.lit(0)))).when(n > 0, F.array(F.xxhash64(one))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def chosen(hashes: Column) -> Column:
    """The minima of the windows, each once: (hash's low 32 bits << 31) + (2**31 - 1 - place)."""
    placed = F.transform(hashes, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31) + (F.lit(_LOW31) - i))

    def minima(v: Column) -> Column:
        least = lambda a, b: F.least(a, b)
        # a missing partner is ignored, so windows cut off at the end would be kept; slice drops them
        out = let(F.zip_with(v, _shift(v, 1), least), lambda two: let(F.zip_with(two, _shift(two, 2), least), lambda four: F.zip_with(four, _shift(two, 4), least)))
        return F.array_distinct(F.slice(out, F.lit(1), F.greatest(F.size(v) - WINDOW + 1, F.lit(1))))

    return F.when(F.size(hashes) > 0, let(placed, minima)).otherwise(F.array().cast("array<bigint>"))


def said(picks: Column) -> Column:
    """The fingerprint as text: hash in hex and place of each chosen gram."""
    return F.array_join(F.transform(picks, lambda p: F.concat(F.lower(F.hex(F.shiftright(p, 31))), F.lit(":"), (F.lit(_LOW31) - p.bitwiseAND(F.lit(_LOW31))).cast("string"))), " ")


def hashes_of(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: F.shiftright(p, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both, n = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(both / (n - both)).cast("double")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def fingerprint(text: Column) -> Column:
    """Chosen grams of a text, as numbers of hash and place."""
    return chosen(gram_hashes(words_of(F.coalesce(text, F.lit("")))))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, own (its chosen grams, made once, after the shuffle) and next, next_own: those of the next row by
    descending doc_id, of the first row for the last.

    Rows are dealt to ranges of doc_id by approximate quantiles and ordered inside each; the first row of the next
    range is dealt to a range as well, behind its own rows. Bounds and first ids are MAX_RANGES numbers at most."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    cuts = F.array(*[F.lit(int(x)) for x in bounds]).cast("array<bigint>")
    home = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))))
    firsts = docs.groupBy(home.alias("home")).agg(F.max("doc_id").alias("first")).collect()  # one row per range
    firsts = sorted((r["home"], r["first"]) for r in firsts)
    follow = {h: firsts[i - 1][0] for i, (h, _) in enumerate(firsts)}  # where the first row of h comes last
    target = F.lit(None).cast("int")
    for h, first in firsts:
        is_first = F.col("doc_id").isNull() if first is None else F.col("doc_id") == F.lit(first)
        target = F.when((F.col("home") == h) & is_first, follow[h]).otherwise(target)
    if len(firsts) > 64:  # long chains of conditions are slow to compile: a map does the same
        pairs = docs.sparkSession.createDataFrame([(h, f, follow[h]) for h, f in firsts], "_home int, _first long, _to int")
        d = docs.withColumn("home", home).join(F.broadcast(pairs), (F.col("home") == F.col("_home")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left").withColumn("to", F.col("_to"))
    else:
        d = docs.withColumn("home", home).withColumn("to", target)
    here = F.struct(F.col("home").alias("range"), F.lit(False).alias("guest"))
    there = F.struct(F.col("to").alias("range"), F.lit(True).alias("guest"))
    d = d.select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    # own is made where the rows of a range have met, so that it isn't shuffled
    d = d.select("doc_id", "text", "at.range", "at.guest").repartition("range").withColumn("own", fingerprint(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    d = d.withColumn("next", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order))
    return d.filter(~F.col("guest")).select("doc_id", "text", "own", "next", "next_own")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    d = with_next(documents)
    n = F.length("text")
    d = d.withColumn("n", n).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    d = d.select("doc_id", "own", "next_own", "n", F.expr("substring(text, 1, n - cut)").alias("kept"), F.expr("substring(next, 1, cut)").alias("head"))
    cut_words = lambda c: F.split(F.col(c), SPACE + "+", -1)
    d = d.select("doc_id", "own", "next_own", "n", F.sha2(F.concat("kept", "head"), 256).alias("edited_sha256"), cut_words("kept").alias("p"), cut_words("head").alias("r"))
    # the word at the cut is made of both sides' outer pieces; empty pieces are white space at an end
    joined = F.filter(F.concat(F.slice("p", F.lit(1), F.size("p") - 1), F.array(F.concat(F.element_at("p", -1), F.get("r", F.lit(0)))), _shift(F.col("r"), 1)), lambda w: w != "")
    d = d.select("doc_id", "n", "edited_sha256", "own", chosen(gram_hashes(joined)).alias("edited"), "next_own")
    d = d.select("*", hashes_of(F.col("own")).alias("a"), hashes_of(F.col("edited")).alias("b"), hashes_of(F.col("next_own")).alias("c"))
    return d.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", said(F.col("own")).alias("fingerprint"), said(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
