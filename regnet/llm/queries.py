"""The corpus operators as queries over whole tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontaminate, hnsw, lexical, line_dedup, mixing, ngram_join, quality, secrets, suffix_dedup, token_counts, warc, winnowing
from .common import table


#: The tokenizer file that op5 counts with.
TOKENIZER = "word_bpe_49k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), digest=True)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_secret_scan, op3_benchmark_decontamination, op4_winnowing, op5_token_counts, op6_suffix_array_dedup, op7_ngram_jaccard_join,
    op8_source_mixing, op9_quality_ranking, op10_line_dedup, op11_nearest_neighbours, op12_lexical_search, op13_conversation_trie,
)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS o FROM p WHERE octet_length(b) >= 100 GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN f.o IS NOT NULL AND p.page_id IS DISTINCT FROM f.o AND octet_length(b) >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.o IS NOT NULL AND p.page_id IS DISTINCT FROM f.o AND octet_length(b) >= 100 THEN f.o END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h""",
    "op3_benchmark_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS s, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT s FROM bw),
dw AS (SELECT r, s, i, array_to_string(w[i:i + s - 1], ' ') AS win
       FROM (SELECT r, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM d, sizes WHERE len(w) >= s)),
h AS (SELECT r, i, dw.s, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.s = bw.s),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + s - 1)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN it ON d.r = it.r""",
    "op6_suffix_array_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, doc_id, p, hash(substr(x, CAST(2 * p + 1 AS INT), 100)) AS g FROM (SELECT r, doc_id, x, unnest(generate_series(0, n - 50)) AS p FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT w.r, w.p FROM w JOIN f ON w.g = f.g WHERE f.least < w.doc_id OR (w.doc_id IS NULL AND f.least IS NOT NULL)),
e0 AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM hit),
e1 AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM e0),
runs AS (SELECT r, k, min(p) AS a, max(p) + 50 AS b FROM e1 GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM runs),
kept AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM runs GROUP BY r),
parts AS (SELECT gaps.r, string_agg(substr(x, CAST(2 * c + 1 AS INT), CAST(2 * (a - c) AS INT)), '' ORDER BY a) AS head FROM gaps JOIN d ON d.r = gaps.r GROUP BY gaps.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE concat(head, substr(x, CAST(2 * last + 1 AS INT))) END)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN parts ON parts.r = d.r""",
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
m AS (SELECT s.r, s.h, n.n FROM s JOIN n ON n.r = s.r WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
p AS (SELECT a.r AS a, b.r AS b FROM m a JOIN m b ON a.h = b.h AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(r, x) AS (SELECT d.r, d.r FROM d UNION SELECT e.b, c.x FROM c JOIN e ON e.a = c.r),
l AS (SELECT c.r, min(doc_id) AS component_id FROM c JOIN d ON d.r = c.x GROUP BY c.r)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN l ON l.r = d.r LEFT JOIN n ON n.r = d.r""",
    "op10_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, {_LOW.format("regexp_replace(ls[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS k
      FROM (SELECT r, doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
common AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
f AS (SELECT l.r, l.i, l.line, common.k IS NOT NULL AND l.doc_id IS DISTINCT FROM common.keeper AS gone FROM l LEFT JOIN common ON l.k = common.k)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f JOIN d USING (r) GROUP BY r""".replace(r"\\x", r"\x"),
    "op11_nearest_neighbours": r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (e.v[i] - q.v[i]) * (e.v[i] - q.v[i])))) AS score
      FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.r <> q.r AND len(e.v) = len(q.v)),
n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score, vec_id NULLS LAST) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM n WHERE rank <= 10""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
l AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
tot AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM l),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM l) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT i, item_id, t, count(*) AS k FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
qw AS (SELECT i, item_id, q.t, k * CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df ON df.t = q.t, tot),
s AS (SELECT i, item_id, l.r, l.doc_id, CAST(sum(qw.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) AS BIGINT) AS score
      FROM qw JOIN tf ON tf.t = qw.t JOIN l ON l.r = tf.r, tot GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 10""",
    "op13_conversation_trie": r"""
WITH RECURSIVE tab AS (SELECT list(CAST(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS BIGINT) ORDER BY i) AS ct FROM range(256) r(i)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, c - c % 100 AS b, CASE WHEN c % 100 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda acc, x: xor(acc >> 8, ct[CAST((xor(acc, x) & 255) + 1 AS INT)])), 4294967295) % 6 END AS h FROM (SELECT DISTINCT c FROM t), tab),
r AS (SELECT cs.c, t.p, t.g, t.chars FROM cs JOIN t ON t.c = cs.b AND t.p <= cs.h WHERE cs.h > 0
      UNION ALL SELECT cs.c, t.p - cs.h + least(cs.h, coalesce(n.n, 0)), t.g, t.chars FROM cs JOIN t ON t.c = cs.c AND t.p > cs.h LEFT JOIN (SELECT c, count(*) AS n FROM t GROUP BY c) n ON n.c = cs.b),
k AS (SELECT c, p, md5(string_agg(g, ',' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS k, chars FROM r UNION ALL SELECT c, 0, '', 0 FROM cs),
ends AS (SELECT c, max(p) AS p FROM k GROUP BY c),
n AS (SELECT k.k, any_value(k.p) AS depth, min(k.c) AS m, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(k.c AS VARCHAR), ',' ORDER BY k.c) FILTER (k.p = ends.p), '')) AS ends_sha256
      FROM k JOIN ends ON ends.c = k.c GROUP BY k.k),
up AS (SELECT n.k, kp.k AS pk, np.m AS pm FROM n JOIN k kp ON kp.c = n.m AND kp.p = n.depth - 1 JOIN n np ON np.k = kp.k),
kids AS (SELECT pk, count(*) AS n FROM up GROUP BY pk),
s AS (SELECT a.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n_convs - 1) * n.chars) AS saved FROM n LEFT JOIN kids ON kids.pk = n.k JOIN k a ON a.c = n.m AND a.p <= n.depth GROUP BY a.k)
SELECT n.m AS conv_id, CAST(n.depth AS BIGINT) AS depth, up.pm AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN up ON up.k = n.k LEFT JOIN kids ON kids.pk = n.k JOIN s ON s.k = n.k""",
}
