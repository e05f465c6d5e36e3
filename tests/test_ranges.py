"""Windows by ranges, islands and clusters against plain Python, on rows that cross borders."""

import random

import pytest
from pyspark.sql import functions as F

from regnet.operators import genes, network, ranges, sites


@pytest.mark.parametrize("width", [1, 7, 50, 1 << 16])
def test_neighbours_and_running_sums(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 200)]) if i % 9 == 0 else rng.randint(-60, 200), i) for i in range(300)] + [("a", 5, 300), ("a", 5, 301), ("far", 10**12, 302), ("far", 0, 303)]
    df = spark.createDataFrame(rows, "k string, at long, i long")
    got = ranges.neighbours(df, ("k",), ("at", "i"), before={"was": "i"}, after={"next": "at"}, width=width)
    got = ranges.running(got, ("k",), ("at", "i"), F.col("i"), "total", width)
    want = []
    for k in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = 0
        for n, (_, at, i) in enumerate(line):
            total += i
            want.append((k, at, i, line[n - 1][2] if n else None, line[n + 1][1] if n + 1 < len(line) else None, total))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_windows_of_few_keys_are_spread(spark):
    df = spark.range(20_000).selectExpr("'chr1' AS seqname", "id * 50 AS start_pos", "id * 50 + 60 AS end_pos", "cast(id AS string) AS gene_name", "id * 50 - 100 AS win_start", "id * 50 + 200 AS win_end")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = ranges.neighbours(df, ("seqname",), ("start_pos", "end_pos", "gene_name"), before={"_before": "end_pos"})
        assert near.groupBy(F.spark_partition_id()).count().count() > 1
        assert genes.clamp(df).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("gap", [None, 0, 12])
def test_islands_by_ranges_are_islands(spark, gap):
    rng = random.Random(5)
    rows = [("t", "r", a, a + rng.randint(0, 30), i) for i, a in enumerate(sorted(rng.randint(0, 3000) for _ in range(200)))]
    df = spark.createDataFrame(rows, "target string, regulator string, start_pos long, stop_pos long, i long")
    plain = {r.i: r.island for r in sites.islands(df, gap=gap).collect()}
    # equal starts and stops have no order of their own
    assert {r.i: r.island for r in sites.islands(df, gap=gap, width=40).collect()} == plain


@pytest.mark.parametrize("size", [5, 64, 4096])
def test_island_folds_are_sums_of_the_highest(spark, monkeypatch, size):
    monkeypatch.setattr(sites, "RANGE", size)
    rng = random.Random(size)
    rows = []
    for k in range(6):
        for _ in range(rng.choice([1, 2, 30])):
            a, w = rng.randint(-20, 200), rng.choice([1, 4, 12])
            rows.append(("t", f"r{k}", a, a + w - 1, float(rng.randint(1, 40)), [float(rng.randint(0, 9)) for _ in range(w + rng.choice([0, 0, 2]))]))
    df = spark.createDataFrame(rows, "target string, regulator string, start_pos long, stop_pos long, score double, per_base array<double>")
    want = []
    for k in range(6):
        line = sorted((r for r in rows if r[1] == f"r{k}"), key=lambda r: (r[2], r[3]))
        runs = []
        for r in line:
            if runs and r[2] < runs[-1][-1][3]:
                runs[-1].append(r)
            else:
                runs.append([r])
        for run in runs:
            best = {}
            stop = max(r[3] for r in run)
            for r in run:
                for i, x in enumerate(r[5]):
                    if r[2] + i <= r[3]:
                        best[r[2] + i] = max(best.get(r[2] + i, 0.0), x)
            want.append(("t", f"r{k}", run[0][2], stop, run[0][4] if len(run) == 1 else sum(best.values())))
    assert sorted(map(tuple, sites.merge_islands(df).collect())) == sorted(want)


def brute_clusters(values, eps, min_share, least):
    """values: q -> weight."""
    line = sorted(values)
    need = max(int(len(line) * min_share), least)
    core = [q for q in line if sum(w for x, w in values.items() if abs(x - q) <= eps) >= need]
    run, number = -1, {}
    for i, q in enumerate(core):
        run += i == 0 or q - core[i - 1] > eps
        number[q] = run
    out = {}
    for q in line:
        left, right = [c for c in core if c <= q and q - c <= eps], [c for c in core if c > q and c - q <= eps]
        out[q] = number[left[-1]] if left else number[right[0]] if right else -1
    return out


def test_clusters_across_bins(spark):
    rng = random.Random(11)
    rows = []
    for k in range(8):
        at = 0.0
        for _ in range(60):
            at += rng.choice([0.05, 0.3, 1.0, 1.0, 2.5, 40.0])
            rows += [(f"r{k}", round(at, 3))] * rng.choice([1, 1, 3])
        rows += [(f"r{k}", 0.0)] * 20
    df = spark.createDataFrame(rows, "regulator string, score double")
    got = {(r.regulator, r.q): r.label for r in network.clusters(df, least=4).collect()}
    for k in range(8):
        values = {}
        for r, x in rows:
            if r == f"r{k}":
                values[round(x * network.SCALE)] = values.get(round(x * network.SCALE), 0) + 1
        want = brute_clusters(values, network.SCALE, 0.001, 4)
        assert {q: got[(f"r{k}", q)] for q in values} == want


def test_ties_go_on_with_the_run_that_one_of_them_opens(spark):
    # the order of equal rows in the window that gave the amounts is lost: whichever comes first, the run opens before it goes on
    for amounts in ([0, 1, 0], [1, 0, 0], [0, 0, 1]):
        rows = [("a", 0, 11, 1), *[("a", 100, 111, x) for x in amounts]]
        df = spark.createDataFrame(rows, "k string, start_pos long, stop_pos long, new int").coalesce(1)
        got = ranges.running(df, ("k",), ("start_pos", "stop_pos"), F.col("new"), "island")
        assert sorted((r.start_pos, r.island) for r in got.collect()) == [(0, 1), (100, 2), (100, 2), (100, 2)]


def test_names_are_distinct_before_they_meet(spark):
    many = spark.range(1000).selectExpr("concat('chr', cast(id % 3 AS string)) AS seqname")
    both = genes.shared_chromosomes(many, many.filter("seqname <> 'chr1'"))
    assert sorted(r.seqname for r in both.collect()) == ["chr0", "chr2"]
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join LeftSemi") :]  # the side that a task holds is names, not rows
