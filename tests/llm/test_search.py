"""Operators 11 to 13 against plain Python over small tables with edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from regnet.llm import conversation_trie, hnsw, lexical

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_nearest(rows, every, k):
    fine = [(i, tuple(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = Counter()
    for a, (i, v) in enumerate(fine):
        if i is not None and i % every == 0:
            by = []
            for b, (j, w) in enumerate(fine):
                if a != b and len(v) == len(w):
                    total = 0.0
                    for x, y in zip(w, v, strict=True):
                        total += (x - y) * (x - y)
                    by.append((math.sqrt(total), j is None, j or 0, j))
            want.update((i, r, j, d) for r, (d, _, _, j) in enumerate(sorted(by)[:k], 1))
    return want


def test_nearest_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 60)
    monkeypatch.setattr(hnsw, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    copy = rows[40][1]
    rows += [(1000 + i, copy) for i in range(30)] + [(40, copy), (None, copy), (None, rng.normal(size=6).tolist())]
    rows += [(400, None), (410, []), (420, [0.0] * 6), (430, [1.0, None, 0, 0, 0, 0]), (440, [float("nan")] * 6), (450, [float("inf")] * 6), (460, [1.0, 2.0]), (461, [1.0, 2.5]), (470, [-0.0, 0.0, 0, 0, 0, 1e-300]), (481, [1e150] * 6)]
    rows = [(i, v and [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, 1, 0) for r in rows], "vec_id long, embedding array<double>, rank int, shard int")
    got = Counter(tuple(r) for r in hnsw.nearest(df, 10, 5).collect())
    want = brute_nearest(rows, 10, 5)
    assert got == want, (got - want, want - got)
    assert hnsw.nearest(df.limit(0)).count() == 0 and hnsw.nearest(df.filter("vec_id = 460")).count() == 0
    stored = hnsw.build(df, 5).collect()
    assert all(len(x) == n * (2 * hnsw.M if i == len(r.sizes) - 1 else hnsw.M) for r in stored for i, (n, x) in enumerate(zip(r.sizes, r.neighbours, strict=True)))


def test_nearest_recall(spark, monkeypatch):
    """A graph of several layers and batches, with clusters far from each other, against all pairs."""
    monkeypatch.setattr(hnsw, "SHARD", 3000)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64)) * 20
    rows += [(5001 + 2 * i, (centres[i % 8] + rng.normal(size=64)).tolist()) for i in range(3000)]
    rows += [(10_000 + 100 * i, (centres[i % 8] + rng.normal(size=64)).tolist()) for i in range(16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df).collect()
    at, v = {r[0]: i for i, r in enumerate(rows)}, np.array([r[1] for r in rows])
    found, true = defaultdict(set), {}
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - np.linalg.norm(v[at[r.query_id]] - v[at[r.vec_id]])) < 1e-9
    for i, x in enumerate(v):
        if rows[i][0] % 100 == 0:
            d = ((v - x) ** 2).sum(1)
            d[i] = np.inf
            true[rows[i][0]] = {rows[j][0] for j in np.argsort(d)[:10]}
    assert found.keys() == true.keys()
    assert np.mean([len(found[q] & true[q]) / 10 for q in true]) >= 0.97


def brute_search(docs, queries, k):
    low = lambda x: TERM.findall((x or "").translate(AZ))
    counted = [(d, w, Counter(w)) for d, x in docs if (w := low(x))]
    n_docs, total = len(counted), sum(len(w) for _, w, _ in counted)
    df = Counter(t for *_, c in counted for t in c)
    want = Counter()
    for item, text in queries:
        q, by = Counter(low(text)), []
        for d, w, c in counted:
            m = 25 + 75 * len(w) * n_docs // total
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in q.items() if t in c)
            if s > 0:
                by.append((-s, d is None, d or 0, d))
        want.update((item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(by)[:k], 1))
    return want


@pytest.mark.parametrize("blocks", [(64, 16384, 4, 200_000), (3, 500, 1, 300)])
def test_lexical_search(docs, benchmark, monkeypatch, blocks):
    for name, x in zip(("DOCS", "ENTRIES", "FIRST", "TERMS"), blocks, strict=True):
        monkeypatch.setattr(lexical, name, x)
    queries = benchmark.union(benchmark.limit(2)).union(benchmark.sparkSession.createDataFrame([(None, "one BE w5 ñandú one", 1, 1), (77, "common é first", 1, 1)], "item_id long, text string, n int, size int"))
    found = lexical.search(lexical.build(docs), queries)
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in queries.collect()], 10)
    got = Counter(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect())
    assert got == want, (got - want, want - got)


def test_lexical_search_of_nothing(docs, benchmark, spark):
    assert lexical.search(lexical.build(docs.limit(0)), benchmark).count() == 0
    assert lexical.search(lexical.build(docs.filter("doc_id < 30")), benchmark.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "  --- ")], "doc_id long, text string")
    index = lexical.build(blank)
    assert (index.n_docs, index.n_terms) == (0, 0) and lexical.search(index, benchmark).count() == 0


def test_blocks_below_the_threshold_are_passed_over():
    """Bounds are never below a document's score, and a threshold leaves blocks out."""
    texts = [" ".join(f"t{(i * j) % 50}" for j in range(1, 5 + i % 7)) for i in range(400)] + ["rare words here"] * 3
    held = [(i, len(lexical.terms(x)), Counter(lexical.terms(x))) for i, x in enumerate(texts)]
    total = sum(n for _, n, _ in held)
    blocks = lexical._rows([lexical._block(b, held[8 * b : 8 * b + 8], len(held), total) for b in range(-(-len(held) // 8))])
    asked = lexical.Queries(["rare words t1", "t7 t7 t9", ""])
    df = Counter(t for *_, c in held for t in c)
    asked.weigh(len(held), {i: df[w.decode()] if isinstance(w, bytes) and w.decode() in df else df[w] for i, w in enumerate(asked.words)})
    bound, ids, at = lexical._block_bounds(asked, blocks)
    most = np.zeros_like(bound)
    for i in range(len(blocks)):
        query, score = asked.scores(lexical._opened(blocks, i), ids[at[i] : at[i + 1]], np.ones(3, bool), len(held), total)
        most[i, query] = score.max(1)
    assert (bound >= most).all() and (bound[:, 2] == 0).all()
    assert (bound[:, 0] >= np.sort(most[:, 0])[-1]).sum() < len(blocks) / 4


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()), (r, x)))
    own = {c: [p[1] for p in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        first = c - int(math.fmod(c, 100))
        h = 0 if first == c else zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(first, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items())


@pytest.mark.parametrize("sizes", [(256, 1024, 4096), (3, 2, 2)])
def test_conversation_trie(spark, data, monkeypatch, sizes):
    for name, x in zip(("BLOCK", "SPAN", "IDS"), sizes, strict=True):
        monkeypatch.setattr(conversation_trie, name, x)
    own = [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in range(5001, 5020) for t in range(4)]  # copies; the family's first conversation is absent
    own += [(6000, t, None if t == 3 else "user", None if t % 5 == 0 else f"é😀 {t % 3}") for t in range(-3, 40)] + [(6001, t, "user", "x") for t in range(3)] + [(6000, None, "system", "first"), (6000, None, "system", "before")]
    own += [(6007, 0, "user", "a"), (6007, 0, "user", "a"), (6007, 0, "user", "b"), (None, 0, "user", "no id"), (-5, 0, "user", "turn 0"), (-105, 1, "", "user"), (7000, 5, "", ""), (7001, 0, "user", "long " * 20_000), (6050, 10**12, "user", "late")]
    extra = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    df = spark.read.parquet(f"{data}/conversations.parquet").union(extra).selectExpr("*", "1 AS pos", "2 AS key", "3 AS n")
    want = brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    got = Counter(tuple(r) for r in conversation_trie.trie(df).collect())
    assert got == want, (got - want, want - got)
    assert conversation_trie.trie(df.limit(0)).count() == 0
