"""The queries over whole tables, whose namesakes are bound to SQL over a part, against brute force."""

from collections import Counter

from regnet.plans import views as v
from regnet.queries import QUERIES


def test_links_of_all_genes(spark, data):
    windows = []
    for g in v.genes(spark, data).collect():
        minus = g.strand == "-"
        tss = g.end_pos if minus else g.start_pos
        windows.append((g.gene_name, g.seqname, g.strand, tss, max(tss - (100 if minus else 500), 1), tss + (500 if minus else 100)))
    links, near, linked = Counter(), Counter(), set()
    peaks = v.peaks(spark, data).collect()
    for p in peaks:
        for name, chrom, strand, tss, a, b in windows:
            if p.chrom == chrom and p.end_pos > a and p.start_pos < b:
                links[(p.chrom, p.start_pos, p.end_pos, strand, name, p.file_name)] += 1
                near[(p.chrom, p.start_pos, p.end_pos, name, 0 if p.start_pos < tss < p.end_pos else min(abs(p.start_pos - tss), abs(p.end_pos - tss)))] += 1
                linked.add((p.chrom, p.start_pos, p.end_pos))
    for p in peaks:
        if (p.chrom, p.start_pos, p.end_pos) not in linked:
            links[(p.chrom, p.start_pos, p.end_pos, ".", "Intergenic", p.file_name)] += 1
    assert Counter(map(tuple, QUERIES["jn_link_intergenic_all"](spark, data).collect())) == links
    assert Counter(map(tuple, QUERIES["jn_link_distance_all"](spark, data).collect())) == near
    assert any(int(k[4]) % 4 for k in links if k[4] != "Intergenic")


def test_metadata_of_every_row(spark, data):
    keys = sorted(r.s_suppkey for r in spark.read.parquet(f"{data}/supplier.parquet").collect())
    tf = {k: ("hum" if k % 2 == 0 else "MAX") + str(k % 3) for k in keys}
    got = QUERIES["enc_metadata_all"](spark, data).collect()
    assert Counter(map(tuple, got)) == Counter((f"EXP{k}", tf[k], f"EXP{k}.bed.gz", k % 8 != 7, k % 8 == 3, k % 8 == 4, k % 8 == 5) for k in keys)
    assert len(keys) > 7
    good = {k for k in keys if k % 8 not in (3, 5, 7)}
    q = QUERIES["enc_quality_all"](spark, data).first()
    assert (q.missing, q.error, q.noncompliant, q.kept) == tuple(sum(k % 8 == x for k in keys) for x in (7, 3, 5)) + (len(good),)
    genes = v.bodies(spark, data).collect()
    orders = spark.read.parquet(f"{data}/orders.parquet").selectExpr(*v._split(v.PEAK), "o_custkey").collect()
    links = Counter()
    for p in orders:
        k = p.o_custkey % len(keys)
        if k in good:
            for g in genes:
                if p.chrom == g.seqname and p.end_pos > g.start_pos and p.start_pos < g.end_pos:
                    links[(p.chrom, p.start_pos, p.end_pos, g.gene_name, tf[k], f"EXP{k}", p.signal_value)] += 1
    assert Counter(map(tuple, QUERIES["enc_batch_link_all"](spark, data).collect())) == links
    assert {k[5] for k in links} == {f"EXP{k}" for k in good}
    assert {tuple(r) for r in QUERIES["dst_peaks_all"](spark, data).collect()} == {k[:6] for k in links}
    most, masks = {}, v.mask(spark, data).collect()
    for k in links:
        most[k[:6]] = max(most.get(k[:6], 0), k[6])
    prior = Counter()
    for (chrom, a, b, gene, name, _), x in most.items():
        if any(m.chrom == chrom and min(b, m.end_pos) - max(a, m.start_pos) >= 0.5 * (b - a) and b > m.start_pos and a < m.end_pos for m in masks):
            prior[(gene, name)] += x
    assert {(r.target, r.regulator): r.score for r in QUERIES["enc_prior_all"](spark, data).collect()} == prior and prior
