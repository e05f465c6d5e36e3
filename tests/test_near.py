"""Hits in windows without their pairs against the same operators over the pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regnet.operators import near, network, peaks, sites

HIT = "seqname string, regulator string, start_pos long, stop_pos long, score double, per_base array<double>"
WIN = "gene_name string, seqname string, win_start long, win_end long"


def _rows(df, *cols):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=str)


def _hits(rng, n, place, length):
    out = []
    for _ in range(n):
        at, size = rng.randint(0, place), length(rng)
        per = [round(rng.uniform(-1, 3), 2) if rng.random() > 0.05 else None for _ in range(max(0, size + rng.choice([1, 1, 1, 0, 2])))]
        out.append((rng.choice(["c1", "c1", "c2"]), rng.choice(["a", "b", None]), at, at + size, float(rng.randint(0, 6)), per))
    return out + out[: n // 5]


def _windows(rng, n, place, many):
    out = [(f"g{i}", rng.choice(["c1", "c2"]), (a := rng.randint(-5, place)), a + rng.randint(0, 60)) for i in range(n)]
    if many:
        out += [(f"g{i}", rng.choice(["c1", "c2"]), (a := rng.randint(0, place)), a + 30) for i in range(5)] + [("far", "c1", 0, 40_000), ("lost", None, 1, 9)]
    return out


@pytest.mark.parametrize("seed, n, place, length", [
    (1, 250, 150, lambda r: 11), (2, 200, 300, lambda r: r.choice([5, 9])), (3, 200, 100, lambda r: r.choice([0, 1, 3, 40])), (4, 40, 2000, lambda r: 11), (5, 500, 60, lambda r: 4),
])
def test_same_as_over_pairs(spark, monkeypatch, seed, n, place, length):
    monkeypatch.setattr(near, "WIDTH", 64)
    rng = random.Random(seed)
    h, w = spark.createDataFrame(_hits(rng, n, place, length), HIT), spark.createDataFrame(_windows(rng, 40, place, seed % 2), WIN)
    pairs = network.hits_near_genes(h, w)
    site = ("target", "regulator", "start_pos", "stop_pos", "score")
    assert _rows(near.sites_near(h, w), *site) == _rows(sites.merge_islands(pairs), *site)
    assert _rows(near.top_near(h, w), *site) == _rows(sites.top_hits(pairs), *site)
    ic = spark.createDataFrame([("a", 9.0), ("b", 3.0), ("b", 9.5)], "regulator string, information_content double")
    edge = ("regulator", "target", "n_sites", "score", "motif_ic", "start_pos", "stop_pos", "chromosome")
    assert _rows(near.edges_near(h, w, ic, max_gap=20, min_ic=2.0), *edge) == _rows(network.edges(pairs, ic, max_gap=20, min_ic=2.0), *edge)


@pytest.mark.parametrize("length", [lambda r: 11, lambda r: r.choice([0, 1, 3, 40])])
def test_kernels_by_small_pieces(monkeypatch, length):
    rng = random.Random(8)
    h = pa.Table.from_pylist([dict(zip(("seqname", "regulator", "start_pos", "stop_pos", "score", "per_base"), x)) for x in _hits(rng, 200, 100, length)])
    w = pa.Table.from_pylist([dict(zip(("gene_name", "seqname", "win_start", "win_end"), x)) for x in _windows(rng, 30, 100, False)])
    whole = [k(w, h).to_pylist() for k in (near._sites_kernel, near._top_kernel)]
    monkeypatch.setattr(near, "ROWS", 50)
    monkeypatch.setattr(near, "ITEMS", 7)
    assert [k(w, h).to_pylist() for k in (near._sites_kernel, near._top_kernel)] == whole


def test_no_row_for_each_pair(spark):
    """2,000 equal windows over 2,000 hits: what is shuffled grows with the tables, not with their product."""
    h = spark.range(2000).selectExpr("'c' AS seqname", "'a' AS regulator", "id AS start_pos", "id + 11 AS stop_pos", "1.0D AS score").withColumn("per_base", F.array_repeat(F.lit(1.0), 12))
    w = spark.range(2000).selectExpr("cast(id AS string) AS gene_name", "'c' AS seqname", "500L AS win_start", "1500L AS win_end")
    got = near.sites_near(h, w)
    assert "_rbin" in network.hits_near_genes(h, w)._jdf.queryExecution().optimizedPlan().toString()
    assert "_rbin" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[2:] for r in got.collect()} == {(489, 1511, 1023.0)}
    assert got.count() == 2000


def test_empty_tables(spark):
    h, w = spark.createDataFrame([], HIT), spark.createDataFrame([("g", "c", 1, 5)], WIN)
    assert near.sites_near(h, w).count() == near.top_near(h, w).count() == near.sites_near(h, w.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_peaks_by_gene_as_over_links(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["c1", "c2"]), (a := rng.randint(0, 6000)), a + rng.choice([0, 1, 30, 400]), ".", rng.choice([1.5, 2.0, 7.25, None]), f"e{rng.randint(0, 5)}.bed") for _ in range(300)]
    p = spark.createDataFrame(rows + rows[:60], "chrom string, start_pos long, end_pos long, strand string, signal_value double, file_name string")
    meta = [(f"e{i}.bed", f"t{i % 2}", f"e{i}", True, i == 3, False) for i in range(6)]
    m = spark.createDataFrame(meta, "file_name string, tf string, accession string, file_exists boolean, error boolean, noncompliant boolean")
    w = _windows(rng, 40, 6000, False) + [("g1", "c1", 100, 900), ("g1", "c1", 100, 900), ("g1", "c1", 500, 3000), ("g2", "c1", 0, 40_000)]
    w = spark.createDataFrame(w, WIN).withColumns({"strand": F.lit("+"), "tss": F.col("win_start")})
    mask = spark.createDataFrame([(rng.choice(["c1", "c2"]), (a := rng.randint(0, 6000)), a + 700, ".") for _ in range(12)], "chrom string, start_pos long, end_pos long, strand string")
    linked = peaks.batch_link(p, m, w)
    cols = ("chrom", "start_pos", "end_pos", "gene", "regulator", "accession")
    found = peaks.distinct_links(p, m, w)
    assert _rows(found, *cols) == _rows(peaks.distinct_peaks(linked), *cols)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]  # nothing is compared after the rows have met
    prior = peaks.peak_prior(linked.groupBy(*cols).agg(F.max("signal_value").alias("signal_value")), mask, 0.5)
    assert _rows(peaks.prior_near(p, m, w, mask, 0.5), "target", "regulator", "score") == _rows(prior, "target", "regulator", "score")
