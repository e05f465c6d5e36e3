"""Benchmark decontamination: windows of benchmark words found in whole documents.

Main path in DataFrame operations only. Every window of 10 words holds a 5-gram that starts at a position
divisible by 6, so one sixth of a document's positions are probed against a broadcast hash table of all
benchmark 5-grams (hash); a hit carries the words around it and is verified word by word against the
benchmark's windows.

Defined cases: null or empty texts have no words; an item without words has no window; an item of fewer than
10 words is one window; repeated rows get equal results; items that share a window all count; null ids stay
and are compared as rows; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, bounded, let, only, row_key

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
#: Benchmark windows (about 100 bytes each) up to which they are broadcast; beyond, the joins shuffle.
MAX_BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAKS), lambda w: w != "")


def grams(items: Column, size: int, step: int, context: int) -> Column:
    """Structs of the window size s, each probed position i (1-based), its gram's hash, the words around it from place a on."""
    last = F.size(items) - size + 1

    def at(i: Column) -> Column:
        a = F.greatest(i - (context - size), F.lit(1))
        return F.struct(F.lit(context).alias("s"), i.alias("i"), F.xxhash64(F.slice(items, i, size)).alias("h"), a.alias("a"), F.slice(items, a, i - a + context).alias("c"))

    none = F.array().cast("array<struct<s:int,i:int,h:bigint,a:int,c:array<string>>>")
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last, F.lit(step)), at)).otherwise(none)


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item and window: item_id, size, win (its words joined), h (hash)."""
    b = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    b = b.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("ws"))
    return b.select("item_id", "size", F.array_join("ws", " ").alias("win"), "ws").distinct()


def occurrences(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row (keys _k1, _k2): n_words and hits, an array of (start 0-based, size, item_id)."""
    wins = windows(benchmark)
    few = bounded(wins, MAX_BROADCAST_ROWS)
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())  # at most ten values
    scans = [(WINDOW, GRAM, WINDOW - GRAM + 1)] + [(n, n, 1) for n in sizes if n < WINDOW]

    probes = None
    for size, gram, step in scans:
        w = wins.filter(F.col("size") == size)
        g = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(size - gram + 1)), lambda i: F.xxhash64(F.slice("ws", i, F.lit(gram))))).alias("h"))
        g = g.select(F.lit(size).alias("s"), "h")
        probes = g if probes is None else probes.union(g)
    probes = probes.distinct()

    def scanned(ws: Column) -> Column:
        none = F.lit(None)
        first = F.array(F.struct(F.lit(0).alias("s"), F.size(ws).alias("i"), none.cast("bigint").alias("h"), none.cast("int").alias("a"), none.cast("array<string>").alias("c")))
        return F.concat(first, *[grams(ws, gram, step, size) for size, gram, step in scans])

    docs = documents.select(*row_key(F.col(id_col), F.col(text_col)), F.explode(let(words(F.col(text_col)), scanned)).alias("p"))
    docs = docs.select(*KEY, "p.*")
    known = small(probes.withColumn("known", F.lit(True)))
    rows = docs.join(known, ["s", "h"], "left").filter((F.col("s") == 0) | F.col("known"))
    tries = F.when(F.col("s") == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("win")))).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("c") - F.col("s") + 1, F.lit(1))),
            lambda j: F.struct((F.col("a") + j - 2).cast("int").alias("start"), F.array_join(F.slice("c", j, F.col("s")), " ").alias("win")),
        )
    )
    rows = rows.select(*KEY, "s", F.when(F.col("s") == 0, F.col("i")).alias("n"), F.explode(tries).alias("t")).select(*KEY, "s", "n", "t.*")
    exact = small(wins.select(F.col("size").alias("s"), "win", "item_id", F.lit(True).alias("same")))
    rows = rows.join(exact, ["s", "win"], "left").filter((F.col("s") == 0) | F.col("same"))
    hit = F.when(F.col("s") > 0, F.struct("start", F.col("s").alias("size"), "item_id"))
    return rows.groupBy(*KEY).agg(F.max("n").alias("n_words"), F.collect_set(hit).alias("hits"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents."""
    ids = documents.select("doc_id", *row_key(F.col("doc_id"), F.col("text")))
    found = occurrences(only(documents, "doc_id", "text"), benchmark)
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1)))))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    found = found.select(*KEY, F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), items.alias("_items"))
    out = ids.join(found, KEY)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, max_share: float = 0.0) -> DataFrame:
    """documents without the rows of which more than max_share of the words are hit. Columns stay as they are."""
    found = occurrences(documents, benchmark)
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1)))))
    bad = found.filter(hit > max_share * F.col("n_words")).select(F.col("_k1").alias("_regnet_b1"), F.col("_k2").alias("_regnet_b2"))
    k1, k2 = (c for c in row_key(documents["doc_id"], documents["text"]))
    return documents.join(bad, (k1 == F.col("_regnet_b1")) & (k2 == F.col("_regnet_b2")), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents with each hit word, and what follows it up to the next word, cut out of the text."""
    found = occurrences(documents, benchmark).filter(F.size("hits") > 0)
    cut = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    found = found.select(F.col("_k1").alias("_regnet_b1"), F.col("_k2").alias("_regnet_b2"), cut.alias("_regnet_cut"))
    k1, k2 = (c for c in row_key(documents["doc_id"], documents["text"]))
    text = documents["text"]
    parts = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$"), F.lit(0))
    kept = F.expr("filter(_regnet_parts, (x, i) -> NOT array_contains(_regnet_cut, i))")
    joined = documents.join(found, (k1 == F.col("_regnet_b1")) & (k2 == F.col("_regnet_b2")), "left").withColumn("_regnet_parts", parts)
    new = F.when(F.col("_regnet_cut").isNull(), F.col("text")).otherwise(F.trim(F.array_join(kept, "")))
    return joined.withColumn("text", new).select(*documents.columns)
