"""Hits in windows without their pairs. Where genes and hits are dense, each hit lies in thousands of windows, and rows of such
pairs grow with the product of both tables. Here distinct windows and hits meet by ranges of a sequence, in Arrow columns: hits in a
window follow each other in order, so that what is asked of them comes from tables over the ordered hits (island scores, sums over bases,
best of a run) and from the few hits at the window's borders. Windows of targets with several rows, and very long ones, take the pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .network import EDGE_KEYS, best_edges, hits_near_genes, regulator_ic
from .sites import KEYS, best_arrays, merge_islands, top_hits

#: Bases of a range, longest window that ranges take, parts into which a range's regulators are dealt.
WIDTH, LONG, PARTS = 4096, 16384, 4
#: Hits that are laid out by window at once, and places that are folded at once.
ROWS, ITEMS = 1 << 18, 1 << 15
SPOT = ("seqname", "win_start", "win_end", "regulator")


def split(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plain, others) of windows: those that are all of their target, in order and not too long; the rest, as it is."""
    whole = F.col("seqname").isNotNull() & F.col("win_start").isNotNull() & F.col("win_end").isNotNull()
    w = windows.filter(whole).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("gene_name")))
    plain = (F.col("_n") == 1) & (F.col("win_end") - F.col("win_start")).between(0, LONG)
    return w.filter(plain).select(F.col("gene_name").alias("target"), "seqname", "win_start", "win_end"), w.filter(~plain).drop("_n")


def _met(hits: DataFrame, plain: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """kernel over the distinct windows that begin in a range and all hits that may touch them."""
    w = plain.select("seqname", "win_start", "win_end").distinct()
    reach = w.agg(F.coalesce(F.max(F.col("win_end") - F.col("win_start")), F.lit(0)).alias("_reach"))
    deal = w.withColumns({"_bin": F.floor(F.col("win_start") / WIDTH), "_part": F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(PARTS)]))})
    h = hits.filter(F.col("seqname").isNotNull()).crossJoin(F.broadcast(reach))
    first, last = F.floor((F.col("start_pos") - F.col("_reach")) / WIDTH), F.floor(F.col("stop_pos") / WIDTH)
    h = h.withColumn("_bin", F.explode(F.when(last >= first, F.sequence(first, last)))).withColumn("_part", F.pmod(F.xxhash64("regulator"), F.lit(PARTS))).drop("_reach")
    on = ("seqname", "_bin", "_part")
    return deal.groupBy(*on).cogroup(h.groupBy(*on)).applyInArrow(kernel, schema)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all [a, b) one after the other, and whose they are."""
    n = b - a
    whose = np.repeat(np.arange(len(a)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n), whose


def _spans(reg: np.ndarray, start: np.ndarray, stop: np.ndarray, ws: np.ndarray, we: np.ndarray):
    """Of hits by regulator, start and stop: runs (picked, segment, a, b, window) that hold each window's hits as picked[a:b].
    Where stops never fall, the hits themselves are such a line; others are laid out window by window."""
    n = len(reg)
    heads = np.flatnonzero(np.r_[True, reg[1:] != reg[:-1]])
    straight: list[tuple] = []
    for lo, hi in zip(heads, np.r_[heads[1:], n], strict=True):
        furthest = np.maximum.accumulate(stop[lo:hi])
        a, b = lo + np.searchsorted(furthest, ws, "left"), lo + np.searchsorted(start[lo:hi], we, "right")
        window = np.flatnonzero(b > a)
        a, b = a[window], b[window]
        if (furthest == stop[lo:hi]).all():
            straight.append((a, b, window))
            continue
        size = np.cumsum(b - a)
        cuts = np.r_[0, np.flatnonzero(np.diff(size // ROWS)) + 1, len(a)] if len(a) else [0]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            picked, whose = _runs(a[x:y], b[x:y])
            good = stop[picked] >= ws[window[x:y]][whose]
            picked, whose = picked[good], whose[good]
            if len(picked):
                ends = np.cumsum(np.bincount(whose, minlength=y - x))
                begins = np.r_[0, ends[:-1]]
                some = ends > begins
                yield picked, whose, begins[some], ends[some], window[x:y][some]
    if straight:
        a, b, window = (np.concatenate(x) for x in zip(*straight, strict=True))
        if len(a):
            yield np.arange(n), reg, a, b, window


def _ordered(hits: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regulators, and by regulator, start and stop: order, regulators' numbers, starts, stops."""
    coded = hits["regulator"].combine_chunks().dictionary_encode(null_encoding="encode")
    reg, start, stop = coded.indices.to_numpy().astype(np.int64), _ints(hits, "start_pos"), _ints(hits, "stop_pos")
    order = np.lexsort((stop, start, reg))
    return coded.dictionary, order, reg[order], start[order], stop[order]


def _bases(hits: pa.Table, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A row of numbers for each hit, on its bases up to stop; -inf where there is none."""
    col = hits["per_base"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
    own = np.clip(np.minimum(size, stop - start + 1), 0, None)
    values = np.append(pc.fill_null(col.flatten(), -np.inf).to_numpy(), -np.inf)
    at = (np.cumsum(size) - size)[:, None] + np.arange(max(int(own.max()), 1))
    return np.where(np.arange(at.shape[1]) < own[:, None], values[np.minimum(at, len(values) - 1)], -np.inf)


def _total(highest: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(highest), 0.0, highest)


def _fold(first: np.ndarray, last: np.ndarray, origin: np.ndarray, wide: int, at: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For hits [first, last): the sum over the wide bases from origin on of the highest number of each."""
    w, out = per.shape[1], np.zeros(len(first))
    for c in range(0, len(first), ITEMS):
        lo, hi, o = first[c : c + ITEMS], last[c : c + ITEMS], origin[c : c + ITEMS]
        highest = np.full((len(lo), 4 * w), -np.inf)
        for d in range(int((hi - lo).max())):
            rows = np.flatnonzero(lo + d < hi)
            k = lo[rows] + d
            cols = (at[k] - o[rows] + w)[:, None] + np.arange(w)
            highest[rows[:, None], cols] = np.maximum(highest[rows[:, None], cols], per[k])
        out[c : c + ITEMS] = _total(highest[:, w : w + wide]).sum(1)
    return out


def _merged(seg: np.ndarray, start: np.ndarray, stop: np.ndarray, count: np.ndarray, score: np.ndarray, per: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The islands of each [a, b): whose, start, stop, score. An island that a window cuts has all its hits' stops in order."""
    n, w = per.shape
    heads = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (start[1:] >= stop[:-1])])
    island = np.zeros(n, np.int64)
    island[heads[1:]] = 1
    island = np.cumsum(island)
    tails = np.r_[heads[1:], n]
    counted = np.r_[0, np.cumsum(count)]
    # the islands' bases one after the other, and the highest number of each
    filled = np.where(np.isneginf(per), 0, np.arange(1, w + 1)).max(1)
    size = np.maximum.reduceat(start + np.maximum(filled, 1), heads) - start[heads]
    begin = np.cumsum(size) - size
    at = begin[island] + start - start[heads][island]
    highest = np.full(int(size.sum()), -np.inf)
    for i in range(w):
        have = np.flatnonzero(filled > i)
        np.maximum.at(highest, at[have] + i, per[have, i])
    highest = _total(highest)
    whole_sum, whole_stop = np.add.reduceat(highest, begin), np.maximum.reduceat(stop, heads)

    i1, i2 = np.searchsorted(heads, a, "right"), np.searchsorted(heads, b, "left")
    step, whose = _runs(np.zeros(len(a), np.int64), i2 - i1 + 1)
    last = step == (i2 - i1)[whose]
    lo = np.where(step == 0, a[whose], heads[np.clip(i1[whose] + step - 1, 0, len(heads) - 1)])
    hi = np.where(last, b[whose], heads[np.clip(i1[whose] + step, 0, len(heads) - 1)])
    k = island[lo]
    whole = (lo == heads[k]) & (hi == tails[k])
    lone = counted[hi] - counted[lo] == 1
    out_stop = np.where(whole, whole_stop[k], stop[hi - 1])
    out = np.where(lone, score[lo], whole_sum[k])
    cut = np.flatnonzero(~whole & ~lone)
    if len(cut):
        lo_, hi_, k_ = lo[cut], hi[cut], k[cut]
        far = at[hi_ - 1] - at[lo_] >= w
        got = np.zeros(len(cut))
        near = np.flatnonzero(~far)
        got[near] = _fold(lo_[near], hi_[near], at[lo_[near]], 2 * w, at, per)
        far = np.flatnonzero(far)
        if len(far):
            # hits left out reach w bases from the first one on, or begin at the last one: between these all hits of a base are in
            lo_, hi_, k_ = lo_[far], hi_[far], k_[far]
            before = np.r_[np.longdouble(0), np.cumsum(highest.astype(np.longdouble))]
            inner = (before[at[hi_ - 1]] - before[at[lo_] + w]).astype(float)
            x, back = np.unique(lo_, return_inverse=True)
            left = _fold(x, np.minimum(np.searchsorted(at, at[x] + w, "left"), tails[island[x]]), at[x], w, at, per)[back]
            y, back = np.unique(hi_, return_inverse=True)
            right = _fold(np.maximum(np.searchsorted(at, at[y - 1] - w + 1, "left"), heads[island[y - 1]]), y, at[y - 1], w, at, per)[back]
            got[far] = left + inner + right
        out[cut] = got
    return whose, start[lo], out_stop, out


def _sites_kernel(windows: pa.Table, hits: pa.Table) -> pa.Table:
    names = [*SPOT, "start_pos", "stop_pos", "score"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    if not windows.num_rows or not hits.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    ws, we = _ints(windows, "win_start"), _ints(windows, "win_end")
    regulators, order, reg, start, stop = _ordered(hits)
    per = _bases(hits, _ints(hits, "start_pos"), _ints(hits, "stop_pos"))[order]
    score = hits["score"].to_numpy().astype(float)[order]
    # equal hits are one; those that don't overlap their own copies stay
    same = np.r_[False, (reg[1:] == reg[:-1]) & (start[1:] == start[:-1]) & (stop[1:] == stop[:-1]) & (start[1:] < stop[1:])]
    heads = np.flatnonzero(~same)
    per, count = np.maximum.reduceat(per, heads, axis=0), np.diff(np.r_[heads, len(reg)])
    reg, start, stop, score = reg[heads], start[heads], stop[heads], score[heads]
    out = []
    for picked, seg, a, b, window in _spans(reg, start, stop, ws, we):
        whose, lo, hi, total = _merged(seg, start[picked], stop[picked], count[picked], score[picked], per[picked], a, b)
        at = window[whose]
        out.append((ws[at], we[at], reg[picked[a[whose]]], lo, hi, total))
    if not out:
        return pa.table([pa.array([], t) for t in types], names)
    lo, hi, r, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
    key = pa.repeat(windows["seqname"][0], len(lo))
    return pa.table([key, lo, hi, regulators.take(pa.array(r)), rest[0], rest[1], pa.array(rest[2], from_pandas=True)], names)


def _top_kernel(windows: pa.Table, hits: pa.Table) -> pa.Table:
    empty = pa.table({"seqname": pa.array([], pa.string()), "win_start": pa.array([], pa.int64()), "win_end": pa.array([], pa.int64())} | {c: hits[c][:0] for c in ("regulator", "start_pos", "stop_pos", "score")})
    if not windows.num_rows or not hits.num_rows:
        return empty
    ws, we = _ints(windows, "win_start"), _ints(windows, "win_end")
    _, order, reg, start, stop = _ordered(hits)
    best = pc.sort_indices(hits, [("score", "descending"), ("start_pos", "ascending"), ("stop_pos", "ascending")]).to_numpy()
    rank = np.empty(len(best), np.int64)
    rank[best] = np.arange(len(best))
    rank = rank[order]
    out = []
    for picked, _, a, b, window in _spans(reg, start, stop, ws, we):
        level, step = rank[picked], 0  # the lowest rank of 2 ** step hits from each one on
        found, wanted = np.zeros(len(a), np.int64), np.frexp((b - a).astype(float))[1] - 1
        while True:
            mine = np.flatnonzero(wanted == step)
            found[mine] = np.minimum(level[a[mine]], level[b[mine] - (1 << step)])
            if step == wanted.max():
                break
            level = np.minimum(level[: len(level) - (1 << step)], level[1 << step :])
            step += 1
        out.append((window, best[found]))
    if not out:
        return empty
    window, hit = (np.concatenate(x) for x in zip(*out, strict=True))
    got = hits.select(["regulator", "start_pos", "stop_pos", "score"]).take(pa.array(hit))
    return pa.table([pa.repeat(windows["seqname"][0], len(window)), ws[window], we[window], *got.columns], empty.column_names)


def _sum_kernel(windows: pa.Table, hits: pa.Table) -> pa.Table:
    """Sums of scores by window and regulator, half-open: those that begin before a window's end less those that end by its start."""
    names, types = [*SPOT, "score"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
    out = []
    if windows.num_rows and hits.num_rows:
        ws, we = _ints(windows, "win_start"), _ints(windows, "win_end")
        regulators, order, reg, start, stop = _ordered(hits)
        known = pc.is_valid(hits["score"]).to_numpy()[order]
        score = pc.fill_null(hits["score"], 0.0).to_numpy()[order]
        heads = np.flatnonzero(np.r_[True, reg[1:] != reg[:-1]])
        for lo, hi in zip(heads, np.r_[heads[1:], len(reg)], strict=True):
            s, e, x = start[lo:hi], stop[lo:hi], np.stack([np.ones(hi - lo), known[lo:hi], score[lo:hi]], 1).astype(np.longdouble)
            odd = (s > e) | ~np.isfinite(score[lo:hi])
            ends = np.flatnonzero(~odd)[np.argsort(e[~odd], kind="stable")]
            upto = lambda rows: np.concatenate([np.zeros((1, 3), np.longdouble), np.cumsum(x[rows], 0)])
            total = upto(~odd)[np.searchsorted(s[~odd], we, "left")] - upto(ends)[np.searchsorted(e[ends], ws, "right")]
            for i in np.flatnonzero(odd):
                total[(e[i] > ws) & (s[i] < we)] += x[i]
            some = np.flatnonzero(total[:, 0] > 0)
            got = np.where(total[some, 1] > 0, total[some, 2], np.nan).astype(float)
            out.append((ws[some], we[some], np.full(len(some), reg[lo]), got, total[some, 1] == 0))
    if not out:
        return pa.table([pa.array([], t) for t in types], names)
    lo, hi, r, total, none = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table([pa.repeat(windows["seqname"][0], len(lo)), lo, hi, regulators.take(pa.array(r)), pa.array(total, mask=none)], names)


def _whole(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("start_pos").isNotNull() & F.col("stop_pos").isNotNull()).withColumns({c: F.col(c).cast("bigint") for c in ("start_pos", "stop_pos")})


def _by_target(plain: DataFrame, found: DataFrame) -> DataFrame:
    return plain.join(found, ["seqname", "win_start", "win_end"]).drop("win_start", "win_end")


def sites_near(
    hits: DataFrame, windows: DataFrame, then: Callable[[DataFrame, tuple[str, ...]], DataFrame] = lambda sites, keys: sites, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """then(merge_islands(hits_near_genes(hits, windows), keys), keys): merged sites by target, or what then makes of those of each
    target and regulator. keys: target and regulator, or these and seqname."""
    plain, others = split(windows)
    h = _whole(hits).select("seqname", "regulator", "start_pos", "stop_pos", F.col("score").cast("double").alias("score"), F.col("per_base").cast("array<double>").alias("per_base"))
    sites = _met(h, plain, _sites_kernel, "seqname string, win_start bigint, win_end bigint, regulator string, start_pos bigint, stop_pos bigint, score double")
    out = _by_target(plain, then(sites, SPOT))
    out = out.select(*keys, *[c for c in out.columns if c not in ("target", "regulator", "seqname")])
    if others.isEmpty():
        return out
    return out.unionByName(then(merge_islands(hits_near_genes(hits, others), keys), keys).select(*out.columns))


def top_near(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """top_hits(hits_near_genes(hits, windows)): target, regulator, start_pos, stop_pos, score."""
    plain, others = split(windows)
    h = _whole(hits).select("seqname", "regulator", "start_pos", "stop_pos", "score")
    found = _met(h, plain, _top_kernel, f"seqname string, win_start bigint, win_end bigint, regulator string, start_pos bigint, stop_pos bigint, score {dict(h.dtypes)['score']}")
    cols = ["target", "regulator", "start_pos", "stop_pos", "score"]
    out = _by_target(plain, found).select(*cols)
    return out if others.isEmpty() else out.unionByName(top_hits(hits_near_genes(hits, others)).select(*cols))


def edges_near(hits: DataFrame, windows: DataFrame, motif_ic: DataFrame, *, max_gap: int, min_ic: float | None = None) -> DataFrame:
    """edges(hits_near_genes(hits, windows), ...) without the pairs."""
    ic = regulator_ic(motif_ic, min_ic)
    kept = hits.join(ic.select("regulator"), "regulator", "left_semi")
    kept = kept if min_ic is None else kept.filter(F.col("score") >= min_ic)
    return best_edges(sites_near(kept, windows, lambda sites, keys: best_arrays(sites, max_gap, keys), EDGE_KEYS), ic)


def sums_near(intervals: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """intervals (seqname, regulator, start_pos, stop_pos, score), half-open: target, regulator and the sum of score over those that share a
    base with the target's window; and the windows for which that is not told, as they are."""
    plain, others = split(windows)
    h = _whole(intervals).select("seqname", "regulator", "start_pos", "stop_pos", F.col("score").cast("double").alias("score"))
    found = _met(h, plain, _sum_kernel, "seqname string, win_start bigint, win_end bigint, regulator string, score double")
    return _by_target(plain, found).select("target", "regulator", "score"), others
