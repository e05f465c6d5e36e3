"""Sequence columns: complement, and the score of a matched sequence against a motif."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .motif_math import LETTERS


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def per_base(ic: Column, seq: Column) -> Column:
    """The information of each matched base, in the order of seq; 0 for other letters."""
    place = lambda c: F.instr(F.lit("".join(LETTERS)), c)
    return F.zip_with(ic, F.split(F.upper(seq), ""), lambda row, c: F.when(place(c) > 0, F.get(row, place(c) - 1)).otherwise(F.lit(0.0)))


def match_score(ic: Column, pwm: Column, seq: Column, max_mismatch: int | None = None) -> Column:
    """Information of the match less the squared loss against the consensus at each position, at least 0.
    0 for runs of one letter, and for motifs longer than 6 with fewer than 4 bases off one letter, two of a kind
    at most counting; with max_mismatch, 0 for more improbable bases. Null where the lengths differ."""
    s = F.upper(seq)
    got = per_base(ic, s)
    best = F.zip_with(ic, pwm, lambda i, p: F.get(i, (F.array_position(p, F.array_max(p)) - 1).cast("int")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    kinds = [F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in LETTERS]
    varied = sum((F.least(k, F.lit(2)) for k in kinds[1:]), F.least(kinds[0], F.lit(2)))
    lone = F.greatest(*kinds) == F.length(s)
    score = F.greatest(total(got) - total(F.zip_with(best, got, lambda b, g: (b - g) * (b - g))), F.lit(0.0))
    bad = lone | ((F.length(s) > 6) & (varied < 4))
    if max_mismatch is not None:
        odd = F.zip_with(pwm, F.split(s, ""), lambda p, c: F.when(F.coalesce(F.get(p, F.instr(F.lit("".join(LETTERS)), c) - 1), F.lit(0.0)) < 0.001, 1).otherwise(0))
        bad = bad | (F.aggregate(odd, F.lit(0), lambda a, x: a + x) > max_mismatch)
    return F.when(F.length(s) != F.size(pwm), None).when(bad, 0.0).otherwise(score)
