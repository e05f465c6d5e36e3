"""Secret scans in DataFrame operations only: pattern spans plus spans of high sliding-window entropy.

A first pass finds the long runs of key characters; all but the assignments lie inside them. Spans come from
splitting at a pattern: pieces and matches alternate, so their lengths give each match's place. Candidates are
the runs of each character class inside the long runs; a window of WINDOW characters slides over a candidate while
counts, packed into a few numbers, are updated by the character that comes and the one that goes, and with them the
sum of count * log2(count), which gives the window's Shannon entropy. Windows at or over the class's threshold merge
into spans; candidates on the allow-list are suppressed. Places are code points, end exclusive. Long candidates are
scanned in pieces that share a window less one, and long lists of matches placed in groups, so that no list grows
by copies and a text takes time in proportion to its length.

Defined cases: null text counts as empty; equal spans of one kind appear once; repeated rows and null ids stay as
they are; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_digits", "entropy_base64"]

WINDOW = 20
RUNS = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Character classes of the entropy scan: kind, pattern of candidates, alphabet, least bits per character.
CLASSES = [
    ("entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 3.0),
    ("entropy_digits", r"(?<![0-9])[0-9]{20,}", "0123456789", 2.9),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
]
#: Windows of a piece of a candidate; matches of a group; bits of a count, and counts in a number.
PIECE, GROUP, BITS, PACKED = 256, 256, 5, 12
_SPANS = "array<struct<s:int,e:int>>"
_FOUND = "array<struct<s:int,e:int,v:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _groups(values: Column, size: int) -> Column:
    """values in arrays of at most size."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda g: F.slice(values, g * size + 1, F.lit(size)))


def matches(text: Column, pattern: str) -> Column:
    """Structs of the places s, e (0-based, end exclusive) and the matched text v; empty for no match."""

    def step(a: Column, x: Column) -> Column:
        s, e = a["at"] + x["p"], a["at"] + x["p"] + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    def in_group(group: Column, start: Column) -> Column:
        return F.aggregate(group, F.struct(start.alias("at"), _none(_FOUND).alias("out")), step, lambda a: a["out"])

    def placed(groups: Column) -> Column:
        total = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, x: n + x["p"] + F.length(x["m"])))
        begin = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        starts = F.aggregate(total, F.struct(F.lit(0).alias("at"), _none("array<int>").alias("out")), begin, lambda a: a["out"])
        return F.flatten(F.zip_with(groups, starts, in_group))

    def places(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m")))
        return F.when(F.size(found) > 0, let(_groups(pairs, GROUP), placed)).otherwise(_none(_FOUND))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def inside(runs: Column, pattern: str, least: int) -> Column:
    """Matches of pattern inside runs, at their places in the text, if long enough."""
    per_run = F.transform(runs, lambda r: F.transform(matches(r["v"], pattern), lambda m: F.struct((m["s"] + r["s"]).alias("s"), (m["e"] + r["s"]).alias("e"), m["v"].alias("v"))))
    return F.filter(F.flatten(per_run), lambda m: m["e"] - m["s"] >= least)


def _joined(spans: Column) -> Column:
    """Spans in order of start and end, those that touch joined."""
    first = F.filter(spans, lambda x, i: (i == 0) | (x["s"] > F.get(spans, i - 1)["e"]))
    last = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["s"] > x["e"]))
    return F.zip_with(first, last, lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e")))


def entropy_spans(candidate: Column, alphabet: str, bits: float) -> Column:
    """Merged spans (s, e within the candidate) of the windows whose entropy is at least bits."""
    words, log = -(-len(alphabet) // PACKED), [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # one comes before one goes
    table = F.array(*[F.lit(x) for x in log])
    units = F.array(*[F.lit(1 << (BITS * (i % PACKED))).cast("long") for i in range(len(alphabet))])
    # of each character the number that holds its count, and one of it there
    codes = F.transform(F.split(candidate, ""), lambda c: let(F.instr(F.lit(alphabet), c) - 1, lambda i: F.struct(F.floor(i / PACKED).cast("int").alias("w"), F.get(units, i).alias("u"), (i % PACKED * BITS).alias("at"))))

    def scanned(piece: Column, start: Column) -> Column:
        """Spans of the windows of a piece that starts there."""

        def count(counts: Column, code: Column) -> Column:
            return F.call_function("shiftright", F.get(counts, code["w"]), code["at"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

        def step(a: Column, i: Column) -> Column:
            come, go = F.get(piece, i), F.when(i >= WINDOW, F.get(piece, i - WINDOW))
            more = F.transform(a["counts"], lambda x, j: F.when(j == come["w"], x + come["u"]).otherwise(x))
            n_come = count(a["counts"], come)
            after = let(more, lambda m: F.struct(F.when(go.isNull(), m).otherwise(F.transform(m, lambda x, j: F.when(j == go["w"], x - go["u"]).otherwise(x))).alias("counts"), F.when(go.isNotNull(), count(m, go)).alias("n")))
            return let(after, lambda b: _moved(a, b, n_come, i))

        def _moved(a: Column, b: Column, n_come: Column, i: Column) -> Column:
            total = a["total"] + F.get(table, n_come + 1) - F.get(table, n_come) + F.coalesce(F.get(table, b["n"] - 1) - F.get(table, b["n"]), F.lit(0.0))
            hit = (i >= WINDOW - 1) & (math.log2(WINDOW) - total / WINDOW >= bits - 1e-9)
            s, e = (start + i - (WINDOW - 1)).cast("int"), (start + i + 1).cast("int")
            joins = (F.size(a["out"]) > 0) & (F.element_at(a["out"], -1)["e"] >= s)
            longer = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(F.element_at(a["out"], -1)["s"].alias("s"), e.alias("e"))))
            out = F.when(~hit, a["out"]).when(joins, longer).otherwise(F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e")))))
            return F.struct(total.alias("total"), b["counts"].alias("counts"), out.alias("out"))

        zero = F.struct(F.lit(0.0).alias("total"), F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), _none(_SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(piece) - 1), zero, step, lambda a: a["out"])

    def over(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(codes) - WINDOW, F.lit(0)), F.lit(PIECE))
        pieces = F.transform(starts, lambda s: let(F.slice(codes, s + 1, F.lit(PIECE + WINDOW - 1)), lambda p: scanned(p, s)))
        return let(F.flatten(pieces), _joined)

    return let(codes, over)


def _allowed(value: Column) -> Column:
    """Candidates that are no secrets: words or rules (parted by signs; capitals only begin words, or all are), UUIDs, one unit
    of up to 8 characters repeated, documentation keys. Tests without nested repetition, so that none looks back."""
    words = value.rlike("^[A-Za-z].*[a-z]$") & ~value.rlike("[^A-Za-z_/=+-]|[A-Za-z][A-Z]|[A-Z][^a-z]")
    capitals = value.rlike("^[A-Z].*[A-Z]$") & ~value.rlike("[^A-Z_/=+-]")
    found = words | capitals | ~value.rlike("[^-_=+/]") | value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$") | F.contains(value, F.lit("EXAMPLE"))
    n = F.length(value)
    for p in range(1, 9):
        found = found | ((n % p == 0) & (n >= 3 * p) & (F.substring(value, F.lit(p + 1), n - p) == F.substring(value, F.lit(1), n - p)))
    return found


def secret_spans(documents: DataFrame) -> DataFrame:
    """documents plus _spans: an array of (s, rank of kind, e), in order; and _base, those of the three base kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = _none(_FOUND)
    df = documents.withColumn("_text", text)
    df = df.withColumn("_runs", matches(F.col("_text"), RUNS))
    gate = F.contains("_text", F.lit("=")) | F.contains("_text", F.lit(":"))
    value_size = lambda v: F.length(F.regexp_extract(v, "^" + ASSIGN + "$", 2))
    df = df.withColumn("_assign", F.when(gate, F.filter(matches(F.col("_text"), ASSIGN), lambda m: value_size(m["v"]) >= MIN_ASSIGN)).otherwise(none))
    df = df.withColumn("_access", F.when(F.size("_runs") > 0, inside(F.col("_runs"), ACCESS, MIN_ACCESS)).otherwise(none))
    df = df.withColumn("_hex", F.when(F.size("_runs") > 0, inside(F.col("_runs"), HEX, MIN_HEX)).otherwise(none))
    placed = lambda spans, rank: F.transform(spans, lambda m: F.struct(m["s"].alias("s"), F.lit(rank).alias("rank"), m["e"].alias("e")))
    extra = []
    for kind, pattern, alphabet, bits in CLASSES:
        found = F.filter(inside(F.col("_runs"), pattern, WINDOW), lambda c: ~_allowed(c["v"]))
        at = lambda c, a=alphabet, b=bits: F.transform(entropy_spans(c["v"], a, b), lambda x: F.struct((c["s"] + x["s"]).alias("s"), (c["s"] + x["e"]).alias("e")))
        spans = F.flatten(F.transform(found, (lambda at: lambda c: at(c))(at)))
        extra.append(F.when(F.size("_runs") > 0, placed(spans, KINDS.index(kind))).otherwise(_none("array<struct<s:int,rank:int,e:int>>")))
    base = F.array_sort(F.concat(placed(F.col("_assign"), 0), placed(F.col("_access"), 1), placed(F.col("_hex"), 2)))
    return df.withColumn("_base", base).withColumn("_spans", F.array_sort(F.concat(F.col("_base"), *extra)))


def _said(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of documents."""
    s = secret_spans(documents.select("doc_id", "text"))
    n = lambda c: F.size(c).cast("long")
    return s.select("doc_id", n("_assign").alias("n_assign"), n("_access").alias("n_access"), n("_hex").alias("n_hex"), F.sha2(_said(F.col("_base")), 256).alias("base_sha256"), _said(F.col("_spans")).alias("spans"))
