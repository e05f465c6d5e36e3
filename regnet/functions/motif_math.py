"""Motif mathematics over array<array<double>> columns (positions by letters), without UDFs."""

from __future__ import annotations

import random
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-letter codes for positions with two likely bases.
IUPAC = {"AT": "W", "AC": "M", "AG": "R", "CG": "S", "CT": "Y", "GT": "K", "A": "A", "C": "C", "G": "G", "T": "T"}
LIKELY = 0.35
LETTERS = ("A", "C", "G", "T")


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def uniform_background(n: int = 4) -> Column:
    return F.array_repeat(F.lit(1.0 / n), n)


def probabilities(counts: Column) -> Column:
    return F.transform(counts, lambda row: F.transform(row, lambda x: x / _total(row)))


def entropy(pwm: Column) -> Column:
    """Shannon entropy in bits, summed over positions."""
    return -_total(F.transform(F.flatten(pwm), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def information_matrix(pwm: Column, background: Column | None = None) -> Column:
    bg = uniform_background() if background is None else background
    return F.transform(pwm, lambda row: F.zip_with(row, bg, lambda p, b: F.when(p > 0, F.greatest(p * F.log2(p / b), F.lit(0.0))).otherwise(0.0)))


def information(pwm: Column, background: Column | None = None) -> Column:
    return _total(F.flatten(information_matrix(pwm, background)))


def occurrence(ic: Column) -> Column:
    return F.floor(F.pow(F.lit(2.0), ic)).cast("bigint")


def _letters(alphabet: Column | None) -> Column:
    return F.array(*[F.lit(x) for x in LETTERS]) if alphabet is None else alphabet


def consensus(pwm: Column, alphabet: Column | None = None) -> Column:
    """The likeliest letter of each position, the first of equal ones."""
    abc = _letters(alphabet)
    return F.array_join(F.transform(pwm, lambda row: F.element_at(abc, F.array_position(row, F.array_max(row)).cast("int"))), "")


def degenerate_consensus(pwm: Column) -> Column:
    """Letters of at least LIKELY probability as one code; N where none is."""
    codes = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in IUPAC.items()))
    likely = lambda row: F.array_join(F.filter(F.zip_with(_letters(None), row, lambda a, p: F.when(p >= LIKELY, a)), lambda a: a.isNotNull()), "")
    return F.array_join(F.transform(pwm, lambda row: F.coalesce(F.element_at(codes, likely(row)), F.lit("N"))), "")


def max_ln_odds(pwm: Column) -> Column:
    return _total(F.transform(pwm, lambda row: F.log(F.array_max(row) / 0.25)))


def threshold_ln_odds(pwm: Column) -> Column:
    second = F.transform(pwm, lambda row: F.element_at(F.sort_array(row), 3))
    gain = _total(F.transform(second, lambda p: F.when(p > 0.25, F.log(p / 0.25)).otherwise(0.0)))
    return max_ln_odds(pwm) - F.greatest(gain, 0.1 * max_ln_odds(pwm))


def truncated(pwm: Column, threshold: float = LIKELY) -> Column:
    """Positions from the first to the last whose highest probability is over threshold; all where none is."""
    strong = F.transform(pwm, lambda row: F.array_max(row) > threshold)
    first = F.array_position(strong, True).cast("int")
    last = F.size(pwm) - F.array_position(F.reverse(strong), True).cast("int") + 1
    return F.when(first > 0, F.slice(pwm, first, last - first + 1)).otherwise(pwm)


def letter_order(seed: int, n: int = 4) -> list[int]:
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def shuffled(pwm: Column, seed: int, n: int = 4) -> Column:
    """One seeded permutation of the letters, the same for all motifs and positions."""
    order = letter_order(seed, n)
    return F.transform(pwm, lambda row: F.array(*[F.get(row, F.lit(i)) for i in order]))


def same_motif(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    close = F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: F.abs(x - y) <= tolerance + 1e-5 * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda c: F.coalesce(c, F.lit(False)))


def equal_motifs(a: Column, b: Column) -> Column:
    """Of two motif structs: the same id, name and matrix."""
    return a["motif_id"].eqNullSafe(b["motif_id"]) & a["motif_name"].eqNullSafe(b["motif_name"]) & same_motif(a["pwm"], b["pwm"])


def has_species(species: Column, name: str) -> Column:
    return F.exists(species, lambda s: F.contains(F.lower(s), F.lit(name.lower())))


def describe(motifs: DataFrame) -> DataFrame:
    """motifs (motif_id, motif_name, pwm, ...) plus information_content, shannon_entropy, occurrence, length, consensus."""
    pwm = F.col("pwm")
    df = motifs.withColumn("information_content", information(pwm)).withColumn("shannon_entropy", entropy(pwm))
    return df.withColumns({"occurrence": occurrence(F.col("information_content")), "length": F.size(pwm), "consensus": consensus(pwm)})


def ic_or_more(motifs: DataFrame, least: float | None) -> DataFrame:
    return motifs if least is None else motifs.filter(F.col("information_content") >= least)
