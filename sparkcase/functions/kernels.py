"""Plain kernels behind the Arrow-batched measures: strings, assignment and sequence alignment."""

from __future__ import annotations

import numpy as np

INF = float("inf")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    matched = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            matched.append(c)
    m = len(matched)
    if not m:
        return 0.0
    swapped = sum(c != d for c, d in zip(matched, (b[j] for j in range(len(b)) if not free[j]))) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """The prefix of up to four characters counts where the Jaro score is above 0.7."""
    score = jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return score + same * prefix_weight * (1 - score) if score > 0.7 else score


def rising(values: np.ndarray) -> int:
    """Pairs of places of which the later one has the greater number; a missing number is in none."""
    total, less = 0, np.zeros(len(values), int)
    for v in np.unique(values[~np.isnan(values)]):
        here = values == v
        total += int(np.cumsum(less)[here].sum())
        less += here
    return total


def assignment(scores) -> list[tuple[int, int]]:
    """Pairs of the assignment with the greatest sum: shortest augmenting paths over potentials, rows to columns."""
    s = np.asarray(scores, float)
    if not s.size:
        return []
    flipped = s.shape[0] > s.shape[1]
    cost = -(s.T if flipped else s)
    rows, columns = cost.shape
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    owner = np.zeros(columns + 1, int)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        least, back, done = np.full(columns + 1, INF), np.zeros(columns + 1, int), np.zeros(columns + 1, bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            open_ = np.where(done[1:], INF, least[1:])
            step = 1 + int(open_.argmin())
            delta = open_[step - 1]
            u[owner[done]] += delta
            v[done] -= delta
            least[1:][~done[1:]] -= delta
            at = step
        while at:
            owner[at], at = owner[back[at]], back[at]
    pairs = [(int(owner[c]) - 1, c - 1) for c in range(1, columns + 1) if owner[c]]
    return sorted((c, r) for r, c in pairs) if flipped else sorted(pairs)


def assignment_value(scores) -> float:
    return float(sum(scores[i][j] for i, j in assignment(scores)))


def _table(n: int, m: int, match, up, left) -> np.ndarray:
    """Least cost of every pair of prefixes, given the cost of a match, of leaving out an x, of leaving out a y."""
    best = np.full((n + 1, m + 1), INF)
    best[0, 0] = 0.0
    for i in range(1, n + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, m + 1):
            row[j] = min(above[j - 1] + match(i, j), above[j] + up(i, j), row[j - 1] + left(i, j))
    return best


def _trace(best, match, up, left, shared: bool) -> list[tuple[int | None, int | None]]:
    """Aligned positions ``(y, x)``; a match wins ties, then the case's step. ``shared`` pairs every step's positions."""
    i, j = best.shape[0] - 1, best.shape[1] - 1
    out = []
    while i and j:
        options = (best[i - 1, j - 1] + match(i, j), best[i - 1, j] + up(i, j), best[i, j - 1] + left(i, j))
        step = options.index(min(options))
        if shared or step == 0:
            out.append((j - 1, i - 1))
        else:
            out.append((None, i - 1) if step == 1 else (j - 1, None))
        i, j = i - (step != 2), j - (step != 1)
    out += [(None, k - 1) for k in range(i, 0, -1)] + [(k - 1, None) for k in range(j, 0, -1)]
    return out[::-1]


def dtw(x, y, distance) -> tuple[float, list]:
    d = [[float(distance(a, b)) for b in y] for a in x]
    cost = lambda i, j: d[i - 1][j - 1]
    best = _table(len(x), len(y), cost, cost, cost)
    return 1 / (1 + best[-1, -1]), _trace(best, cost, cost, cost, shared=True)


def twed(x, y, distance, timestamp=None, stiffness=0.001, penalty=1.0, origin=0.0) -> tuple[float, list]:
    def times(s):
        t = [0.0, *(float(timestamp(v)) for v in s)] if timestamp else [0.0, *map(float, range(len(s)))]
        if any(b < a for a, b in zip(t, t[1:])):
            raise ValueError("timestamps must not fall")
        return t

    tx, ty = times(x), times(y)
    px, py = [origin, *x], [origin, *y]

    def match(i, j):
        return float(distance(px[i], py[j])) + float(distance(px[i - 1], py[j - 1])) + stiffness * (abs(tx[i] - ty[j]) + abs(tx[i - 1] - ty[j - 1]))

    def up(i, j):
        return float(distance(px[i], px[i - 1])) + stiffness * (tx[i] - tx[i - 1]) + penalty

    def left(i, j):
        return float(distance(py[j], py[j - 1])) + stiffness * (ty[j] - ty[j - 1]) + penalty

    best = _table(len(x), len(y), match, up, left)
    return 1 / (1 + best[-1, -1]), _trace(best, match, up, left, shared=False)


def smith_waterman(x, y, similarity, deletion=-1.0, insertion=-1.0) -> tuple[float, list]:
    if not len(x) or not len(y):
        return 0.0, []
    s = [[float(similarity(a, b)) for a in x] for b in y]
    best = np.zeros((len(y) + 1, len(x) + 1))
    for i in range(1, len(y) + 1):
        for j in range(1, len(x) + 1):
            best[i, j] = max(0.0, best[i - 1, j - 1] + s[i - 1][j - 1], best[i - 1, j] + deletion, best[i, j - 1] + insertion)
    i, j = len(y), int(best[-1].argmax())
    value, out = min(1.0, float(best[i, j]) / len(y)), []
    while i and j and best[i, j] > 0:
        options = (best[i - 1, j - 1] + s[i - 1][j - 1], best[i - 1, j] + deletion, best[i, j - 1] + insertion)
        step = options.index(max(options))
        out.append(((i - 1) if step != 2 else None, (j - 1) if step != 1 else None))
        i, j = i - (step != 2), j - (step != 1)
    return value, out[::-1]


def _batches(xs, ys):
    """Numbers of the pairs, those of like lengths together, and padded to few cells a diagonal."""
    sizes = np.array([(len(a) + len(b), len(a)) for a, b in zip(xs, ys)], int).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    at = 0
    while at < len(order):
        step = max(1, min(512, 200_000 // (int(sizes[order[at:], 0].max()) + 1)))
        yield order[at : at + step]
        at += step


def _padded(rows, kind) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, n.max())), kind)
    for o, r in zip(out, rows):
        o[: len(r)] = r
    return out, n


def _diagonals(n: int, m: int):
    """Each diagonal ``d`` of a table and the rows ``lo`` to ``hi`` of its inner cells."""
    for d in range(1, n + m + 1):
        yield d, max(1, d - m), min(n, d - 1)


def _warped(xs, ys, costs) -> np.ndarray:
    """Least costs of many tables at once, by diagonals; ``costs(x, y, d, lo, hi)`` gives those of the three steps."""
    out = np.zeros(len(xs))
    for some in _batches(xs, ys):
        (x, n), (y, m) = _padded([xs[k] for k in some], float), _padded([ys[k] for k in some], float)
        before, last = np.full((len(some), n.max() + 1), INF), np.full((len(some), n.max() + 1), INF)
        last[:, 0] = 0.0
        every, found = np.arange(len(some)), np.where(n + m == 0, 0.0, INF)
        for d, lo, hi in _diagonals(int(n.max()), int(m.max())):
            now = np.full_like(last, INF)
            if lo <= hi:
                match, up, left = costs(x, y, d, lo, hi)
                now[:, lo : hi + 1] = np.minimum(np.minimum(before[:, lo - 1 : hi] + match, last[:, lo - 1 : hi] + up), last[:, lo : hi + 1] + left)
            found = np.where(n + m == d, now[every, n], found)
            before, last = last, now
        out[some] = found
    return out


def dtw_values(xs, ys) -> np.ndarray:
    """The values of ``dtw`` of many pairs of finite numbers, by their absolute differences."""

    def costs(x, y, d, lo, hi):
        c = np.abs(x[:, lo - 1 : hi] - y[:, d - hi - 1 : d - lo][:, ::-1])
        return c, c, c

    return 1 / (1 + _warped(xs, ys, costs))


def twed_values(xs, ys, stiffness=0.001, penalty=1.0, origin=0.0) -> np.ndarray:
    """The values of ``twed`` of many pairs of finite numbers a step apart, by their absolute differences."""
    time = lambda k: np.maximum(k - 1, 0).astype(float)

    def costs(x, y, d, lo, hi):
        first = np.full((len(x), 1), float(origin))
        i = np.arange(lo, hi + 1)
        j = d - i
        px, py = np.hstack([first, x]), np.hstack([first, y])
        xi, xb, yj, yb = px[:, i], px[:, i - 1], py[:, j], py[:, j - 1]
        match = np.abs(xi - yj) + np.abs(xb - yb) + stiffness * (np.abs(time(i) - time(j)) + np.abs(time(i - 1) - time(j - 1)))
        return match, np.abs(xi - xb) + stiffness * (time(i) - time(i - 1)) + penalty, np.abs(yj - yb) + stiffness * (time(j) - time(j - 1)) + penalty

    return 1 / (1 + _warped(xs, ys, costs))


def smith_waterman_values(xs, ys, deletion=-1.0, insertion=-1.0) -> np.ndarray:
    """The values of ``smith_waterman`` of many pairs of strings or other equal or unequal items."""
    codes: dict = {}
    coded = lambda rows: [[codes.setdefault(v, len(codes)) for v in r] for r in rows]
    xs, ys, out = coded(xs), coded(ys), np.zeros(len(xs))
    for some in _batches(ys, xs):
        (y, m), (x, n) = _padded([ys[k] for k in some], int), _padded([xs[k] for k in some], int)
        before = last = np.zeros((len(some), m.max() + 1))
        every, found = np.arange(len(some)), np.zeros(len(some))
        for d, lo, hi in _diagonals(int(m.max()), int(n.max())):
            now = np.zeros_like(last)
            if lo <= hi:
                same = (y[:, lo - 1 : hi] == x[:, d - hi - 1 : d - lo][:, ::-1]).astype(float)
                steps = np.maximum(np.maximum(before[:, lo - 1 : hi] + same, last[:, lo - 1 : hi] + deletion), last[:, lo : hi + 1] + insertion)
                now[:, lo : hi + 1] = np.maximum(0.0, steps)
            inside = (d - m >= 1) & (d - m <= n)
            found = np.where(inside, np.maximum(found, now[every, m]), found)
            before, last = last, now
        out[some] = [min(1.0, f / k) if k and o else 0.0 for f, k, o in zip(found, m, n)]
    return out
