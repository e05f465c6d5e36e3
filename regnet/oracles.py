"""The queries as SQL over the test tables, for DuckDB."""

from __future__ import annotations

from .functions.motif_math import letter_order
from .plans.views import GENE, HIT, LENGTH, MASK, MOTIF_IC, PEAK, SEQUENCE
from .queries import GAP, IC_MIN, MOTIF

G = f"g AS (SELECT {GENE} FROM part)"
H = f"h AS (SELECT *, row_number() OVER () AS hid FROM (SELECT {HIT} FROM lineitem))"
P = f"p AS (SELECT {PEAK} FROM orders)"
K = f"k AS (SELECT {MASK} FROM supplier)"
IC = f"ic AS (SELECT {MOTIF_IC} FROM supplier)"
SEQ = "s AS (SELECT {} FROM documents)".format(SEQUENCE.format(g=", 'g'"))
CNT = "c AS (SELECT sample, gene, CAST(sum(n) AS BIGINT) AS count FROM (SELECT concat('S', CAST(l_suppkey % 8 AS STRING)) AS sample, CASE WHEN l_partkey % 97 = 0 THEN '__no_feature' ELSE CAST(l_partkey AS STRING) END AS gene, CAST(l_quantity AS BIGINT) AS n FROM lineitem) GROUP BY ALL)"
LEN = "l AS (SELECT {} FROM part)".format(LENGTH.replace("10.0D", "10.0::DOUBLE").replace("0.1D", "0.1::DOUBLE"))
NEAR = f"{G}, {H}, near AS (SELECT gene_name AS target, regulator, h.seqname, h.start_pos, h.stop_pos, score, hid FROM h JOIN g ON h.seqname = g.seqname AND h.stop_pos >= g.start_pos AND h.start_pos <= g.end_pos)"


def _window(start: str, end: str, up: int, down: int, extra: str = "") -> str:
    return f"""w AS (SELECT *, greatest({start} - CASE WHEN strand = '-' THEN {down} ELSE {up} END, 1) AS win_start,
 {end} + CASE WHEN strand = '-' THEN {up} ELSE {down} END AS win_end FROM (SELECT *, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS tss FROM g{extra}))"""


TSS = ("tss", "tss")
OUT = "gene_name, seqname, strand, win_start, win_end"


def _sites(near: str = "near", where: str = "TRUE", keys: str = "target, regulator") -> str:
    """CTEs up to m: merged sites with their keys, start_pos, stop_pos, score."""
    return f"""i0 AS (SELECT *, CASE WHEN start_pos < lag(stop_pos) OVER (PARTITION BY {keys} ORDER BY start_pos, stop_pos) THEN 0 ELSE 1 END AS nw FROM {near} WHERE {where}),
i1 AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY start_pos, stop_pos ROWS UNBOUNDED PRECEDING) AS island FROM i0),
i2 AS (SELECT *, count(*) OVER (PARTITION BY {keys}, island) AS n FROM i1),
b0 AS (SELECT {keys}, island, start_pos, stop_pos, start_pos + i AS base, (score * (i + 3)) % 7 AS x FROM (SELECT *, unnest(generate_series(0, 11)) AS i FROM i2 WHERE n > 1)),
b1 AS (SELECT {keys}, island, base, max(x) AS x, min(start_pos) AS start_pos, max(stop_pos) AS stop_pos FROM b0 GROUP BY {keys}, island, base),
m AS (SELECT {keys}, start_pos, stop_pos, CAST(score AS DOUBLE) AS score FROM i2 WHERE n = 1
 UNION ALL SELECT {keys}, min(start_pos), max(stop_pos), sum(x) FROM b1 GROUP BY {keys}, island)"""


def _arrays(keys: str = "target, regulator") -> str:
    return f"""a0 AS (SELECT *, CASE WHEN start_pos - lag(stop_pos) OVER (PARTITION BY {keys} ORDER BY start_pos, stop_pos) <= {GAP} THEN 0 ELSE 1 END AS nw FROM m),
a1 AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY start_pos, stop_pos ROWS UNBOUNDED PRECEDING) AS arr FROM a0),
a2 AS (SELECT {keys}, CAST(arr AS BIGINT) AS arr, min(start_pos) AS start_pos, max(stop_pos) AS stop_pos, sum(score) AS score, count(*) AS n_sites FROM a1 GROUP BY {keys}, arr),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY (n_sites > 1) DESC, score DESC, start_pos) AS r FROM a2) WHERE r = 1)"""


EDGES = f"""{NEAR}, {IC}, icr AS (SELECT regulator, avg(information_content) AS motif_ic FROM ic WHERE information_content >= {IC_MIN} GROUP BY regulator),
{_sites(where=f"score >= {IC_MIN} AND regulator IN (SELECT regulator FROM icr)", keys="target, regulator, seqname")}, {_arrays("target, regulator, seqname")},
edge AS (SELECT * EXCLUDE (q) FROM (SELECT regulator, target, n_sites, score, motif_ic, start_pos, stop_pos, seqname AS chromosome,
 row_number() OVER (PARTITION BY target, regulator ORDER BY score DESC, seqname) AS q FROM best JOIN icr USING (regulator)) WHERE q = 1)"""
GRID = f"""{EDGES}, grid AS (SELECT t.target, r.regulator, coalesce(e.score, 0.0) AS score FROM (SELECT DISTINCT gene_name AS target FROM g) t
 CROSS JOIN (SELECT DISTINCT regulator FROM ic) r LEFT JOIN edge e ON e.target = t.target AND e.regulator = r.regulator)"""
CLUSTERS = f"""{GRID}, d0 AS (SELECT regulator, CAST(round(score * 1000000) AS BIGINT) AS q, count(*) AS weight FROM grid GROUP BY ALL),
d1 AS (SELECT *, sum(weight) OVER (PARTITION BY regulator ORDER BY q RANGE BETWEEN 1000000 PRECEDING AND 1000000 FOLLOWING) >= greatest(floor(count(*) OVER (PARTITION BY regulator) * 0.001), 10) AS core FROM d0),
d2 AS (SELECT *, last_value(CASE WHEN core THEN q END IGNORE NULLS) OVER (PARTITION BY regulator ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft,
 first_value(CASE WHEN core THEN q END IGNORE NULLS) OVER (PARTITION BY regulator ORDER BY q ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt FROM d1),
d3 AS (SELECT *, sum(CASE WHEN core AND (lft IS NULL OR q - lft > 1000000) THEN 1 ELSE 0 END) OVER (PARTITION BY regulator ORDER BY q ROWS UNBOUNDED PRECEDING) - 1 AS run FROM d2),
cl AS (SELECT regulator, q, CAST(weight AS BIGINT) AS weight, CAST(CASE WHEN core OR q - lft <= 1000000 THEN run WHEN rgt - q <= 1000000 THEN run + 1 ELSE -1 END AS BIGINT) AS label FROM d3)"""
CHOSEN = f"""{CLUSTERS}, e0 AS (SELECT *, max(label) OVER (PARTITION BY regulator) AS top, min(label) OVER (PARTITION BY regulator) AS low FROM cl),
e1 AS (SELECT *, min(CASE WHEN label = top THEN q END) OVER (PARTITION BY regulator) AS cut FROM e0),
e2 AS (SELECT *, sum(CASE WHEN q >= cut THEN weight ELSE 0 END) OVER (PARTITION BY regulator) / sum(weight) OVER (PARTITION BY regulator) AS share FROM e1),
e3 AS (SELECT regulator, q, CASE WHEN top = -1 THEN q > 0 WHEN top = 0 AND low = 0 THEN FALSE WHEN share <= 0.05 THEN q >= cut ELSE label = -1 AND q > cut END AS edge FROM e2),
chosen AS (SELECT grid.target, grid.regulator, grid.score, e3.edge FROM grid JOIN e3 ON grid.regulator = e3.regulator AND CAST(round(grid.score * 1000000) AS BIGINT) = e3.q)"""

MOTS = """pw AS (SELECT vec_id, i, j, abs(CAST(embedding[4 * i + j + 1] AS DOUBLE)) + 0.01 AS x FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 4)) AS i FROM embeddings), generate_series(0, 3) b(j)),
tot AS (SELECT vec_id, i, max(x) FILTER (j = 0) + max(x) FILTER (j = 1) + max(x) FILTER (j = 2) + max(x) FILTER (j = 3) AS t FROM pw GROUP BY ALL),
mp AS (SELECT concat('M', CAST(vec_id AS VARCHAR)) AS motif_id, concat('TF', CAST(vec_id % 25 AS VARCHAR)) AS motif_name, i, j, round(x / t, 3) AS p, substr('ACGT', CAST(j + 1 AS INT), 1) AS a FROM pw JOIN tot USING (vec_id, i)),
inf AS (SELECT *, CASE WHEN p > 0 THEN greatest(p * log2(p / 0.25), 0.0) ELSE 0.0 END AS v, row_number() OVER (PARTITION BY motif_id, i ORDER BY p DESC, j) AS r FROM mp)"""
CONSENSUS = "string_agg(a, '' ORDER BY i) FILTER (r = 1)"
WITH_PEAKS = f"{G}, {P}"
WIN4 = f"{G}, {P}, {_window(*TSS, 500, 100)}"
LINK = "p.chrom = w.seqname AND p.end_pos > w.win_start AND p.start_pos < w.win_end"
NAMES = "nm AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN replace(p_name, ' ', '-') WHEN p_partkey % 7 = 0 THEN concat(p_name, ' (var.2)') WHEN p_partkey % 11 = 0 THEN concat(p_name, ':', p_name) ELSE p_name END AS name FROM part)"
META = """raw AS (SELECT s_suppkey AS n, concat('EXP', CAST(s_suppkey AS VARCHAR)) AS accession, concat(CASE WHEN s_suppkey % 2 = 0 THEN 'hum' ELSE 'MAX' END, CAST(s_suppkey % 3 AS VARCHAR)) AS tf FROM supplier),
meta AS (SELECT accession, tf, concat(accession, '.bed.gz') AS file_name, n % 8 <> 7 AS file_exists, n % 8 = 3 AS error, n % 8 = 4 AS warning, n % 8 = 5 AS noncompliant FROM raw)"""
LINKED = f"""{G}, {META}, p AS (SELECT * REPLACE (concat('EXP', CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), '.bed.gz') AS file_name) FROM (SELECT {PEAK}, o_custkey FROM orders)), linked AS (SELECT p.chrom, p.start_pos, p.end_pos, g.gene_name AS gene, meta.tf AS regulator, meta.accession, p.signal_value
 FROM p JOIN meta ON p.file_name = meta.file_name AND file_exists AND NOT error AND NOT noncompliant
 JOIN g ON p.chrom = g.seqname AND p.end_pos > g.start_pos AND p.start_pos < g.end_pos)"""
OWN = f"{CNT}, o AS (SELECT * FROM c WHERE NOT starts_with(gene, '__')), {LEN}"
TPM = f"{OWN}, tpm AS (SELECT sample, gene, (count / length) / sum(count / length) OVER (PARTITION BY sample) * 1e6 AS tpm FROM o JOIN l USING (gene))"
MODE = "(SELECT gene_name, {0} FROM (SELECT gene_name, {0}, row_number() OVER (PARTITION BY gene_name ORDER BY count(*) DESC, {0}) AS r FROM a GROUP BY gene_name, {0}) WHERE r = 1)"
MOTIF_ROWS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(MOTIF))
ISL = "PARTITION BY seqname, regulator ORDER BY start_pos, stop_pos"
TFS = [f"TF{i}" for i in range(25)]

ORACLE_SQL = {
    "jn_overlap": f"WITH {NEAR} SELECT * EXCLUDE (hid) FROM near",
    "prj_tss": f"WITH {G} SELECT gene_name, seqname, strand, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS tss FROM g",
    "win_promoter": f"WITH {G}, {_window(*TSS, 500, 100)} SELECT {OUT} FROM w",
    "win_gene_body": f"WITH {G}, {_window(*TSS, 500, 100)} SELECT gene_name, seqname, strand, CASE WHEN strand = '-' THEN least(win_start, start_pos) ELSE win_start END AS win_start, CASE WHEN strand = '-' THEN win_end ELSE greatest(win_end, end_pos) END AS win_end FROM w",
    "win_truncate": f"WITH {G}, {_window(*TSS, 500, 400)} SELECT gene_name, seqname, strand, CASE WHEN strand = '-' THEN greatest(win_start, start_pos) ELSE win_start END AS win_start, CASE WHEN strand = '-' THEN win_end ELSE least(win_end, end_pos) END AS win_end FROM w",
    "win_intergenic": f"""WITH {G}, {_window("start_pos", "end_pos", 500, 100)},
n AS (SELECT *, greatest(win_start, coalesce(lag(end_pos) OVER q, win_start)) AS a, least(win_end, coalesce(lead(start_pos) OVER q, win_end)) AS b FROM w WINDOW q AS (PARTITION BY seqname ORDER BY start_pos, end_pos, gene_name))
SELECT gene_name, seqname, strand, CASE WHEN a < b THEN a ELSE win_start END AS win_start, CASE WHEN a < b THEN b ELSE win_end END AS win_end FROM n""",
    "jn_clip": f"""WITH {G}, {_window("start_pos", "end_pos", 1000, 1000)}, ln AS (SELECT seqname, max(end_pos) - 500 AS length FROM g WHERE seqname <> 'chr4' GROUP BY seqname)
SELECT gene_name, w.seqname, strand, least(win_start, coalesce(length, win_start)) AS win_start, least(win_end, coalesce(length, win_end)) AS win_end FROM w LEFT JOIN ln ON w.seqname = ln.seqname""",
    "agg_gene_collapse": f"""WITH a AS (SELECT concat('g', CAST(l_partkey % 5000 AS VARCHAR)) AS gene_name, concat('chr', CAST(l_suppkey % 5 AS VARCHAR)) AS seqname, CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand,
 l_orderkey AS start_pos, l_orderkey + CAST(l_quantity AS BIGINT) AS end_pos, l_returnflag = 'R' AS coding FROM lineitem)
SELECT gene_name, seqname, strand, start_pos, end_pos, protein_coding FROM (SELECT gene_name, min(start_pos) AS start_pos, max(end_pos) AS end_pos, bool_or(coding) AS protein_coding FROM a GROUP BY gene_name)
JOIN {MODE.format("seqname")} USING (gene_name) JOIN {MODE.format("strand")} USING (gene_name)""",
    "flt_gene_list": f"WITH {G} SELECT * FROM g WHERE gene_name IN (SELECT CAST(c_custkey * 3 AS VARCHAR) FROM customer)",
    "flt_tf_list": f"WITH {IC} SELECT * FROM ic WHERE upper(regulator) IN (SELECT upper(concat('tf', CAST(s_suppkey % 7 AS VARCHAR))) FROM supplier)",
    "flt_min_ic": f"WITH {IC} SELECT * FROM ic WHERE information_content >= {IC_MIN}",
    "flt_min_score": f"WITH {H}, {IC} SELECT regulator, seqname, start_pos, stop_pos, score FROM h WHERE score >= 40 AND regulator IN (SELECT regulator FROM ic WHERE information_content >= 11)",
    "flt_dimers": f"WITH {NAMES} SELECT * FROM nm WHERE NOT regexp_matches(name, ':|, |;')",
    "mot_fuzzy": rf"""WITH {NAMES}, ky AS (SELECT id, name, trim(regexp_replace(replace(lower(name), '-', ''), '\(.*\)', '', 'g'), concat(',-:\/ ', chr(13), chr(10))) AS ky FROM nm WHERE NOT regexp_matches(name, ':|, |;')),
bst AS (SELECT ky, name FROM (SELECT ky, name, row_number() OVER (PARTITION BY ky ORDER BY count(*) DESC, name) AS r FROM ky GROUP BY ky, name) WHERE r = 1)
SELECT id, bst.name, trim(regexp_replace(replace(lower(bst.name), '-', ''), '\(.*\)', '', 'g'), concat(',-:\/ ', chr(13), chr(10))) AS name_key FROM ky JOIN bst ON ky.ky = bst.ky""",
    "chr_check": f"""WITH {WITH_PEAKS}, a AS (SELECT DISTINCT seqname FROM g), b AS (SELECT chrom AS seqname FROM p WHERE chrom <> 'chr1' UNION SELECT concat(file_name, 'x') FROM p)
SELECT coalesce(a.seqname, b.seqname) AS seqname, CASE WHEN a.seqname IS NULL THEN 'right' WHEN b.seqname IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.seqname = b.seqname""",
    "flt_rename": f"WITH {G} SELECT gene_name, CASE seqname WHEN 'chr0' THEN 'I' WHEN 'chr1' THEN 'II' ELSE 'IV' END AS seqname FROM g WHERE seqname IN ('chr0', 'chr1', 'chr3')",
    "jn_bucket": f"WITH {H} SELECT seqname AS target, regulator, count(*) AS n, sum(score) AS total FROM h WHERE seqname IN ('chr1', 'chr3', 'none') GROUP BY ALL",
    "jn_intersect": f"WITH {P}, {K} SELECT p.chrom, greatest(p.start_pos, k.start_pos) AS start_pos, least(p.end_pos, k.end_pos) AS end_pos, file_name FROM p JOIN k ON p.chrom = k.chrom AND p.end_pos > k.start_pos AND p.start_pos < k.end_pos",
    "jn_intersect_wb": f"WITH {P}, {K} SELECT p.chrom, greatest(p.start_pos, k.start_pos) AS start_pos, least(p.end_pos, k.end_pos) AS end_pos, k.start_pos AS b_start_pos, k.end_pos AS b_end_pos FROM p JOIN k ON p.chrom = k.chrom AND p.end_pos > k.start_pos AND p.start_pos < k.end_pos",
    "jn_intersect_frac": f"WITH {P}, {K} SELECT p.chrom, p.start_pos, p.end_pos, file_name FROM p JOIN k ON p.chrom = k.chrom AND p.end_pos > k.start_pos AND p.start_pos < k.end_pos WHERE least(p.end_pos, k.end_pos) - greatest(p.start_pos, k.start_pos) >= 0.75 * (p.end_pos - p.start_pos)",
    "jn_link_intergenic": f"""WITH {WIN4} SELECT p.chrom, p.start_pos, p.end_pos, w.strand, gene_name AS gene, file_name FROM p JOIN w ON {LINK}
UNION ALL SELECT chrom, start_pos, end_pos, '.', 'Intergenic', file_name FROM p WHERE NOT EXISTS (SELECT 1 FROM p q JOIN w ON q.chrom = w.seqname AND q.end_pos > w.win_start AND q.start_pos < w.win_end WHERE q.chrom = p.chrom AND q.start_pos = p.start_pos AND q.end_pos = p.end_pos)""",
    "jn_link_distance": f"WITH {WIN4} SELECT p.chrom, p.start_pos, p.end_pos, gene_name AS gene, CAST(CASE WHEN p.start_pos < tss AND p.end_pos > tss THEN 0 ELSE least(abs(p.start_pos - tss), abs(p.end_pos - tss)) END AS BIGINT) AS distance FROM p JOIN w ON {LINK}",
    "seq_extract": f"WITH {SEQ} SELECT concat(seqname, ':', CAST(a AS VARCHAR), '-', CAST(a + 30 AS VARCHAR)) AS seqname, seqname AS chrom, CAST(a AS BIGINT) AS start_pos, CAST(a + 30 AS BIGINT) AS end_pos, substr(seq, a + 1, 30) AS seq FROM s, (VALUES (0), (25), (60)) t(a)",
    "seq_revcomp": f"WITH {SEQ} SELECT seqname, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM s",
    "fasta_lengths": f"WITH {SEQ} SELECT seqname, CAST(length(seq) AS BIGINT) AS length FROM s",
    "seq_scan_exact": f"""WITH {SEQ}, pos AS (SELECT seqname, seq, unnest(generate_series(1, length(seq) - 4)) AS i FROM s), w AS (SELECT seqname, CAST(i - 1 AS BIGINT) AS start_pos, CAST(i + 3 AS BIGINT) AS stop_pos, substr(seq, CAST(i AS INT), 5) AS x FROM pos)
SELECT seqname, start_pos, stop_pos, '+' AS strand, x AS matched FROM w WHERE x = 'GATTA' UNION ALL SELECT seqname, start_pos, stop_pos, '-', 'GATTA' FROM w WHERE x = 'TAATC'""",
    "score_match": f"""WITH {MOTS}, q AS (SELECT * FROM (VALUES {MOTIF_ROWS}) t(i, c)), per AS (SELECT motif_id, i, max(v) FILTER (a = c) AS got, max(v) FILTER (r = 1) AS best FROM inf JOIN q USING (i) GROUP BY ALL)
SELECT motif_id, CASE WHEN w = length('{MOTIF}') THEN round(greatest(sum(got) - sum((best - got) * (best - got)), 0.0), 6) END AS score FROM per RIGHT JOIN (SELECT motif_id, count(DISTINCT i) AS w FROM mp GROUP BY motif_id) m USING (motif_id) GROUP BY motif_id, w""",
    "win_islands": f"""WITH {H}, a AS (SELECT *, CASE WHEN start_pos < lag(stop_pos) OVER ({ISL}) THEN 0 ELSE 1 END AS nw FROM h), b AS (SELECT *, sum(nw) OVER ({ISL} ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT seqname, regulator, CAST(island AS BIGINT) AS island, min(start_pos) AS start_pos, max(stop_pos) AS stop_pos, count(*) AS n FROM b GROUP BY seqname, regulator, island""",
    "agg_per_base": f"WITH {NEAR}, {_sites()} SELECT target, regulator, start_pos, stop_pos, score FROM m",
    "win_tandem": f"WITH {NEAR}, {_sites()}, {_arrays()} SELECT target, regulator, arr AS array, start_pos, stop_pos, score, n_sites FROM a2",
    "site_score": f"WITH {NEAR}, {_sites(where='score >= 10')}, {_arrays()} SELECT target, regulator, score, n_sites, start_pos, stop_pos FROM best",
    "top_hit": f"WITH {NEAR} SELECT target, regulator, start_pos, stop_pos, score FROM (SELECT *, row_number() OVER (PARTITION BY target, regulator ORDER BY score DESC, start_pos, stop_pos) AS r FROM near) WHERE r = 1",
    "net_edges": f"WITH {EDGES} SELECT regulator, target, n_sites, score, round(motif_ic, 6) AS motif_ic, start_pos, stop_pos, chromosome FROM edge",
    "net_complete": f"WITH {GRID} SELECT * FROM grid",
    "net_matrix_long": f"WITH {GRID} SELECT target, " + ", ".join(f"coalesce(sum(score) FILTER (regulator = '{t}'), 0.0) AS tf_{t[2:]}" for t in TFS) + " FROM grid GROUP BY target",
    "net_unpivot": f"WITH {GRID} SELECT * FROM grid WHERE score > 0",
    "net_nonzero": f"WITH {GRID} SELECT regulator, count(*) FILTER (score <> 0) AS n_nonzero, count(*) AS n FROM grid GROUP BY regulator",
    "sel_dbscan": f"WITH {CLUSTERS} SELECT * FROM cl",
    "sel_edges": f"WITH {CHOSEN} SELECT * FROM chosen",
    "net_flagged": f"WITH {CHOSEN} SELECT edge.target, edge.regulator, edge.score, chosen.edge AS filter_included FROM edge JOIN chosen ON edge.target = chosen.target AND edge.regulator = chosen.regulator",
    "mot_entropy": f"WITH {MOTS} SELECT motif_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy FROM mp GROUP BY motif_id",
    "mot_ic": f"WITH {MOTS} SELECT motif_id, round(sum(v), 6) AS ic FROM inf GROUP BY motif_id",
    "mot_consensus": f"WITH {MOTS} SELECT motif_id, {CONSENSUS} AS consensus FROM inf GROUP BY motif_id",
    "mot_degenerate": f"""WITH {MOTS}, lk AS (SELECT motif_id, i, coalesce(string_agg(a, '' ORDER BY j) FILTER (p >= 0.35), '') AS z FROM mp GROUP BY motif_id, i)
SELECT motif_id, string_agg(CASE z WHEN 'AT' THEN 'W' WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K' WHEN '' THEN 'N' ELSE z END, '' ORDER BY i) AS consensus FROM lk GROUP BY motif_id""",
    "mot_ln_odds": f"""WITH {MOTS}, ps AS (SELECT motif_id, i, max(p) AS top, max(p) FILTER (r = 2) AS second FROM inf GROUP BY ALL), sm AS (SELECT motif_id, sum(ln(top / 0.25)) AS mx, sum(CASE WHEN second > 0.25 THEN ln(second / 0.25) ELSE 0 END) AS gain FROM ps GROUP BY motif_id)
SELECT motif_id, round(mx, 6) AS max_ln_odds, round(mx - greatest(gain, 0.1 * mx), 6) AS threshold_ln_odds FROM sm""",
    "mot_truncate": f"""WITH {MOTS}, st AS (SELECT motif_id, i, max(p) > 0.5 AS strong FROM mp GROUP BY ALL), bd AS (SELECT motif_id, coalesce(min(i) FILTER (strong), 0) AS lo, coalesce(max(i) FILTER (strong), max(i)) AS hi FROM st GROUP BY motif_id)
SELECT motif_id, CAST(max(hi) - max(lo) + 1 AS BIGINT) AS length, {CONSENSUS} AS consensus FROM inf JOIN bd USING (motif_id) WHERE i BETWEEN lo AND hi GROUP BY motif_id""",
    "mot_summary": f"""WITH {MOTS} SELECT motif_id, motif_name, round(sum(v), 6) AS ic, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy, CAST(floor(pow(2, sum(v))) AS BIGINT) AS occurrence, count(DISTINCT i) AS length, {CONSENSUS} AS consensus FROM inf GROUP BY motif_id, motif_name""",
    "mot_shuffle": f"""WITH {MOTS}, sh AS (SELECT motif_id, i, p, CASE j {" ".join(f"WHEN {j} THEN {k}" for k, j in enumerate(letter_order(7)))} END AS k FROM mp),
rk AS (SELECT *, row_number() OVER (PARTITION BY motif_id, i ORDER BY p DESC, k) AS r FROM sh)
SELECT motif_id, string_agg(substr('ACGT', CAST(k + 1 AS INT), 1), '' ORDER BY i) FILTER (r = 1) AS consensus FROM rk GROUP BY motif_id""",
    "exp_pileup": f"""WITH {CNT}, o AS (SELECT * FROM c WHERE NOT starts_with(gene, '__')) SELECT a.sample, b.gene, coalesce(o.count, 0) AS count FROM (SELECT DISTINCT sample FROM o) a CROSS JOIN (SELECT DISTINCT gene FROM o) b LEFT JOIN o ON o.sample = a.sample AND o.gene = b.gene
UNION ALL SELECT sample, 'meta:no_feature', count FROM c WHERE gene = '__no_feature' UNION ALL SELECT sample, 'meta:aligned', CAST(sum(count) AS BIGINT) FROM o GROUP BY sample""",
    "exp_fpkm": f"WITH {OWN} SELECT sample, gene, round(count / sum(count) OVER (PARTITION BY sample) * 1e6 / length, 4) AS fpkm FROM o JOIN l USING (gene)",
    "exp_tpm": f"WITH {TPM} SELECT sample, gene, round(tpm, 4) AS tpm FROM tpm",
    "exp_lengths": f"""WITH {H}, e AS (SELECT regulator AS gene, seqname, start_pos, stop_pos + 40 AS end_pos FROM h), f AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY gene, seqname ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM e),
r AS (SELECT *, sum(nw) OVER (PARTITION BY gene, seqname ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS run FROM f), u AS (SELECT gene, max(end_pos) - min(start_pos) + 1 AS n FROM r GROUP BY gene, seqname, run)
SELECT a.gene, round(a.x / 1000.0, 6) AS length, round(b.x / 1000.0, 6) AS merged FROM (SELECT gene, CAST(sum(end_pos - start_pos + 1) AS DOUBLE) AS x FROM e GROUP BY gene) a JOIN (SELECT gene, CAST(sum(n) AS DOUBLE) AS x FROM u GROUP BY gene) b ON a.gene = b.gene""",
    "exp_t2g": f"WITH {TPM} SELECT sample, p_brand AS gene, round(sum(tpm), 4) AS tpm FROM tpm JOIN part ON CAST(p_partkey AS VARCHAR) = tpm.gene GROUP BY sample, p_brand",
    "exp_unknown": f"WITH {OWN} SELECT DISTINCT gene FROM o WHERE gene NOT IN (SELECT gene FROM l WHERE CAST(gene AS BIGINT) % 5 <> 0)",
    "enc_metadata": f"WITH {META} SELECT * FROM meta",
    "enc_batch_link": f"WITH {LINKED} SELECT * FROM linked",
    "enc_prior": f"""WITH {LINKED}, {K}, u AS (SELECT chrom, start_pos, end_pos, gene, regulator, accession, max(signal_value) AS signal_value FROM linked GROUP BY ALL),
m AS (SELECT DISTINCT u.* FROM u JOIN k ON u.chrom = k.chrom AND u.end_pos > k.start_pos AND u.start_pos < k.end_pos WHERE least(u.end_pos, k.end_pos) - greatest(u.start_pos, k.start_pos) >= 0.5 * (u.end_pos - u.start_pos))
SELECT gene AS target, regulator, sum(signal_value) AS score FROM m GROUP BY gene, regulator""",
    "enc_quality": f"WITH {META} SELECT count(*) FILTER (NOT file_exists) AS missing, count(*) FILTER (file_exists AND error) AS error, count(*) FILTER (file_exists AND NOT error AND noncompliant) AS noncompliant, count(*) FILTER (file_exists AND NOT error AND NOT noncompliant) AS kept FROM meta",
    "dst_peaks": f"WITH {LINKED} SELECT DISTINCT chrom, start_pos, end_pos, gene, regulator, accession FROM linked",
    "dst_hits": f"WITH {H} SELECT regulator AS motif_id, seqname, start_pos, stop_pos, min(score) AS score FROM h GROUP BY ALL",
    "set_union": f"WITH {G}, {K} SELECT seqname, start_pos, end_pos, NULL AS strand FROM g UNION ALL SELECT chrom, start_pos, end_pos, strand FROM k",
    "set_symdiff": f"WITH {WITH_PEAKS} (SELECT seqname, start_pos FROM g EXCEPT SELECT chrom, start_pos FROM p) UNION ALL (SELECT chrom, start_pos FROM p EXCEPT SELECT seqname, start_pos FROM g)",
    "set_shared": f"WITH {WITH_PEAKS} SELECT seqname FROM g INTERSECT SELECT chrom FROM p",
}
ORACLE_SQL |= {f"{k}_all": ORACLE_SQL[k] for k in ("jn_link_intergenic", "jn_link_distance", "enc_metadata", "enc_batch_link", "enc_prior", "enc_quality", "dst_peaks")}
