"""Cycles through time-stamped edges, counted for a stretch of time in one task.

Paths never leave the task: they are walked as numpy blocks of bounded size over the edges of the window. A path goes on only
while what is left of the bound can lead back to where the cycle began, as told by a search backwards over half the bound.
"""

from __future__ import annotations

import numpy as np

#: Edges, pairs or paths that are held at once.
BLOCK = 1 << 18


def _spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans of positions: which span each position is of, and the positions, one span after the other."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) + np.repeat(start - (np.cumsum(size) - size), size)


def _starts(sorted_ids: np.ndarray, m: int) -> np.ndarray:
    return np.searchsorted(sorted_ids, np.arange(m + 1))


def count_cycles(src: np.ndarray, dst: np.ndarray, time: np.ndarray, own: np.ndarray, w: int, longest: int, block: int = BLOCK) -> np.ndarray:
    """(edges, longest - 1): the simple cycles of 2..longest accounts through each own edge, over edges not later and within w.

    The edges are distinct and without loops; those that are not own only lie on cycles of others. Times are taken in slices of
    an eighth of w, as graphs beside each other. An edge counts from its time until its pair recurs, so a path is met once.
    """
    n = len(src)
    counts = np.zeros((n, longest - 1), dtype=np.int64)
    if not own.any():
        return counts
    names, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    order = np.lexsort((time, codes[n:], codes[:n]))
    u, v, t = codes[:n][order], codes[n:][order], time[order]
    nxt = np.full(n, np.inf if t.dtype.kind == "f" else np.iinfo(t.dtype).max, dtype=t.dtype)
    same = (u[1:] == u[:-1]) & (v[1:] == v[:-1])
    nxt[:-1][same] = t[1:][same]
    by_time = np.argsort(t, kind="stable")
    u, v, t, nxt, order = u[by_time], v[by_time], t[by_time], nxt[by_time], order[by_time]
    mine = np.flatnonzero(own[order])
    slices, first = np.unique(np.floor(t[mine] * 8 / w), return_index=True)
    last = np.append(first[1:], len(mine)) - 1
    low, high = t[mine[first]], t[mine[last]]
    lo, hi = np.searchsorted(t, low - w, "right"), np.searchsorted(t, high, "right")
    k = 0
    while k < len(slices):
        end = k + 1
        while end < len(slices) and (hi[k : end + 1] - lo[k : end + 1]).sum() <= block and (end + 1 - k) * len(names) <= 4 * block:
            end += 1
        g, e = _spans(lo[k:end], hi[k:end] - lo[k:end])
        alive = nxt[e] > low[k:end][g]
        g, e = g[alive], e[alive]
        asked = own[order[e]] & (t[e] >= low[k:end][g])
        got, of = _in_graphs(g * len(names) + u[e], g * len(names) + v[e], t[e], nxt[e], asked, (end - k) * len(names), w, longest, bool((low[k:end] == high[k:end]).all()), block)
        counts[order[e[of]]] = got
        k = end
    return counts


def _in_graphs(a: np.ndarray, b: np.ndarray, t: np.ndarray, nxt: np.ndarray, asked: np.ndarray, m: int, w: int, longest: int, one_time: bool, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the asked edges a -> b that may lie on cycles, and which edges those are."""
    at = np.arange(len(a))
    while len(a):  # edges that nothing leads to or that lead nowhere lie on no cycle
        ok = (np.bincount(a, minlength=m) > 0)[b] & (np.bincount(b, minlength=m) > 0)[a]
        if ok.all():
            break
        a, b, at = a[ok], b[ok], at[ok]
    by = np.argsort(a, kind="stable")
    a, b, at = a[by], b[by], at[by]
    t, nxt = t[at], nxt[at]
    back = np.argsort(b, kind="stable")
    out, into = (_starts(a, m), b), (_starts(b[back], m), a[back])
    q = np.flatnonzero(asked[at])  # in order of a
    counts = np.zeros((len(q), longest - 1), dtype=np.int64)
    origins = np.unique(a[q])
    step = max(1, block // 32)
    stack = [(i, min(i + step, len(origins))) for i in range(0, len(origins), step)]
    while stack:
        i, j = stack.pop()
        near = _distances(origins[i:j], *into, m, longest // 2, 8 * block if j > i + 1 else None)
        if near is None:  # too many for one go
            stack += [(i, (i + j) // 2), ((i + j) // 2, j)]
            continue
        some = slice(*np.searchsorted(a[q], [origins[i], origins[j - 1] + 1]))
        of = q[some]
        _walk(counts[some], a[of], np.searchsorted(origins[i:j], a[of]), b[of], t[of], out, (t, nxt), near, m, w, longest, one_time, block)
    return counts, at[q]


def _distances(origins: np.ndarray, start: np.ndarray, before: np.ndarray, m: int, far: int, most: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(keys, distances): for pairs origin number * m + account, in order, how many edges lead from there to the origin; none beyond far."""
    seen = level = np.arange(len(origins)) * m + origins
    keys, dist = [level], [np.zeros(len(level), dtype=np.int8)]
    for d in range(1, far + 1):
        o, x = level // m, level % m
        of, e = _spans(start[x], start[x + 1] - start[x])
        if most is not None and len(of) + len(seen) > most:
            return None
        level = np.unique(o[of] * m + before[e])
        level = level[seen[np.minimum(np.searchsorted(seen, level), len(seen) - 1)] != level]
        keys.append(level)
        dist.append(np.full(len(level), d, dtype=np.int8))
        seen = np.sort(np.concatenate([seen, level]), kind="stable")
    all_keys = np.concatenate(keys)
    by = np.argsort(all_keys, kind="stable")
    return all_keys[by], np.concatenate(dist)[by]


def _walk(counts: np.ndarray, a: np.ndarray, origin: np.ndarray, b: np.ndarray, t: np.ndarray, out: tuple, times: tuple, near: tuple, m: int, w: int, longest: int, one_time: bool, block: int) -> None:
    """Adds to counts, a row an edge a -> b at t, the cycles by the number of their accounts."""
    start, head = out
    keys, dist = near

    def leads_back(q: np.ndarray, x: np.ndarray, left: int) -> np.ndarray:
        k = origin[q] * m + x
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return (keys[i] == k) & (dist[i] <= left)

    stack = [(np.arange(len(a)), b[:, None])]
    while stack:
        q, path = stack.pop()
        long = path.shape[1]
        size = start[path[:, -1] + 1] - start[path[:, -1]]
        if len(q) > 1 and size.sum() > block:
            stack += [(q[: len(q) // 2], path[: len(q) // 2]), (q[len(q) // 2 :], path[len(q) // 2 :])]
            continue
        of, e = _spans(start[path[:, -1]], size)
        x, qx = head[e], q[of]
        if not one_time:
            now = t[qx]
            ok = (times[0][e] > now - w) & (times[0][e] <= now) & (times[1][e] > now)
            of, x, qx = of[ok], x[ok], qx[ok]
        closed = x == a[qx]
        counts[:, long - 1] += np.bincount(qx[closed], minlength=len(counts))
        if long + 1 >= longest:
            continue
        ok = ~closed
        for j in range(long):
            ok &= path[of, j] != x
        of, x, qx = of[ok], x[ok], qx[ok]
        if longest - long - 1 <= longest // 2:
            ok = leads_back(qx, x, longest - long - 1)
            of, x, qx = of[ok], x[ok], qx[ok]
        if len(qx):
            stack.append((qx, np.column_stack([path[of], x])))


def in_stretch(w: int, longest: int):
    """For applyInArrow over (src, dst, edge_time, _own): the own edges that lie on cycles, with an n_{length} for each length."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        got = count_cycles(*(table[c].to_numpy() for c in ("src", "dst", "edge_time", "_own")), w, longest)
        on = np.flatnonzero(got.any(axis=1))
        rows = table.select(["src", "dst", "edge_time"]).take(pa.array(on))
        return pa.table({c: rows[c] for c in rows.column_names} | {f"n_{k + 2}": got[on, k] for k in range(longest - 1)})

    return run
