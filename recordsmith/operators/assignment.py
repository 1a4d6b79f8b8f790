"""The best one-to-one pairing of two lists of records, by classes of equal records.

Records that are equal on both sides are paired first, as many as both sides have: where matching is transitive, a best
pairing that does so exists.  What is left forms classes of equal records, between which a min-cost flow runs by shortest
augmenting paths; costs of a class are made when it is visited, so memory grows with the records and not with
their pairs.  Documents with few records left on a side are solved many at a time instead, by the sets of these records
that are used.  Of pairings with equally many matching fields one with the most fields that match by a value is taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np

#: A record: for each field a number, a text, or None.
Record = tuple

#: Cells up to which all costs between classes are held.
DENSE = 4_000_000
#: Records of the smaller and of the larger side up to which documents are solved many at a time.
FEW, SEVERAL = 6, 64


def close(a: float, b: float, rel: float) -> bool:
    return a == b or abs(a - b) <= rel * max(abs(a), abs(b))


def canonical(records: Sequence[Record], rel: float) -> tuple[list[Record], set[int]]:
    """Records with one value for numbers that match each other, and the fields where matching is not transitive."""
    out, loose = list(records), set()
    for f in range(len(records[0]) if records else 0):
        numbers = sorted({r[f] for r in records if isinstance(r[f], float)})
        if not any(close(a, b, rel) for a, b in pairwise(numbers)):
            continue
        same, chain = {}, numbers[:1]
        for x in [*numbers[1:], None]:
            if x is not None and close(chain[-1], x, rel):
                chain.append(x)
                continue
            if len(chain) > 1 and not close(chain[0], chain[-1], rel):
                loose.add(f)
            same |= dict.fromkeys(chain, chain[0])
            chain = [x]
        if f not in loose:
            out = [(*r[:f], same.get(r[f], r[f]) if isinstance(r[f], float) else r[f], *r[f + 1 :]) for r in out]
    return out, loose


class Costs:
    """Gain of pairing classes: matching fields (both empty too), times ``unit``, plus fields that match by a value."""

    def __init__(self, left: list[Record], right: list[Record], loose: set[int], rel: float, unit: int):
        self.unit, self.rel, self.held = unit, rel, {}
        self.fields = []
        for f in range(len(left[0])):
            code: dict = {None: -1}
            a, b = (np.array([code.setdefault(r[f], len(code)) for r in side]) for side in (left, right))
            number = lambda side: np.array([r[f] if isinstance(r[f], float) else np.nan for r in side])  # noqa: B023, E731
            self.fields.append((a, b, *((number(left), number(right)) if f in loose else (None, None))))
        self.keep = len(left) * len(right) <= DENSE

    def row(self, i: int) -> np.ndarray:
        if i in self.held:
            return self.held[i]
        gain = 0
        for a, b, x, y in self.fields:
            same = b == a[i]
            if x is not None and not np.isnan(x[i]):
                with np.errstate(invalid="ignore"):
                    same = same | (np.abs(y - x[i]) <= self.rel * np.maximum(np.abs(y), abs(x[i])))
            gain = gain + same.astype(np.int64) * (self.unit + int(a[i] >= 0))
        if self.keep:
            self.held[i] = gain
        return gain


def flow(costs: Costs, supply: list[int], demand: list[int]) -> Iterator[tuple[int, int, int]]:
    """(left class, right class, records): all of the left side's records go to the right side with the greatest gain.

    The right side has as many records or more.
    """
    n, m = len(supply), len(demand)
    room, left = np.array(demand, np.int64), list(supply)
    price = np.zeros(m, np.int64)  # of right classes; the cost of a pair is minus its gain
    sent: list[dict[int, int]] = [{} for _ in range(m)]  # by right class: units of left classes
    owed = [0] * n
    for i in range(n):  # to the best right classes that have room, while none is better without room
        cost = -costs.row(i)
        owed[i] = int(cost.min())
        for j in np.flatnonzero(cost == owed[i]).tolist():
            units = min(left[i], int(room[j]))
            if units:
                sent[j][i] = units
                room[j] -= units
                left[i] -= units
            if not left[i]:
                break
    far = np.iinfo(np.int64).max // 4
    while any(left):
        # distances of all right classes from the left ones that still have records, up to the nearest with room
        at = {i: 0 for i in range(n) if left[i]}
        least, done, seen = np.full(m, far), np.zeros(m, bool), list(at)
        while True:
            for k in seen:
                np.minimum(least, at[k] - costs.row(k) - owed[k] - price, out=least)
            d = int(least[~done].min())
            now = ~done & (least == d)
            if room[now].any():
                break
            done |= now
            seen = list({k for j in np.flatnonzero(now).tolist() for k in sent[j]} - at.keys())
            at |= dict.fromkeys(seen, d)
        for k, own in at.items():
            owed[k] += d - own
        price[done] += least[done] - d
        # then along pairs without loss, each right class entered once
        entered = np.zeros(m, bool)
        for i in [i for i in range(n) if left[i]]:
            while left[i] and _sent_on(i, costs, owed, price, left, room, sent, entered):
                pass
    for j, units in enumerate(sent):
        for i, u in units.items():
            yield i, j, u


def _sent_on(start: int, costs: Costs, owed: list[int], price: np.ndarray, left: list[int], room: np.ndarray, sent: list[dict[int, int]], entered: np.ndarray) -> bool:
    """Send records of one left class by a path to a right class with room; those on the way change places."""
    path: list[tuple[int, int, list[int]]] = []  # left class, right class entered, other left classes there
    i = start
    while True:
        tight = -costs.row(i) - owed[i] == price
        free = np.flatnonzero(tight & (room > 0))
        if len(free):
            end = int(free[0])
            units = min(left[start], int(room[end]), *[sent[j][k] for (_, j, _), k in zip(path, [p[0] for p in path[1:]] + [i])])
            steps = [*[(k, j) for k, j, _ in path], (i, end)]
            for (k, j), (_, was) in zip(steps[1:], steps):
                sent[was][k] -= units
                if not sent[was][k]:
                    del sent[was][k]
            for k, j in steps:
                sent[j][k] = sent[j].get(k, 0) + units
            left[start] -= units
            room[end] -= units
            return True
        more = np.flatnonzero(tight & ~entered)
        if len(more):
            j = int(more[0])
            entered[j] = True
            others = [k for k in sent[j] if k != i]
            if others:
                path.append((i, j, others))
                i = others.pop()
            continue
        while path and not path[-1][2]:
            i = path.pop()[0]
            if (-costs.row(i) - owed[i] == price)[~entered].any():
                break
        else:
            if not path:
                return False
            i = path[-1][2].pop()


def pairing(found: Sequence[Record], gold: Sequence[Record], rel: float = 1e-9) -> list[tuple[int, int, int]]:
    """(place of a found record, place of a gold one, matching fields): min(len(found), len(gold)) pairs.

    Equal records of a class are dealt in the order of their places.
    """
    if not found or not gold:
        return []
    records, loose = canonical([*found, *gold], rel)
    classes: tuple[dict[Record, list[int]], ...] = ({}, {})
    for side, own in zip(classes, (records[: len(found)], records[len(found) :])):
        for at, r in enumerate(own):
            side.setdefault(r, []).append(at)
    out, width = [], len(records[0])
    if not loose:
        for r, places in classes[0].items():
            others = classes[1].get(r, [])
            both = min(len(places), len(others))
            out += [(a, b, width) for a, b in zip(places[:both], others[:both])]
            del places[:both], others[:both]
    left, right = ({r: p for r, p in side.items() if p} for side in classes)
    if not left or not right:
        return out
    turned = sum(map(len, left.values())) > sum(map(len, right.values()))
    if turned:
        left, right = right, left
    lists = list(left.values()), list(right.values())
    unit = width * len(records) + 1
    costs = Costs(list(left), list(right), loose, rel, unit)
    taken = [0] * len(lists[0]), [0] * len(lists[1])
    for i, j, units in sorted(flow(costs, [len(p) for p in lists[0]], [len(p) for p in lists[1]])):
        matches = int(costs.row(i)[j]) // unit
        ones, others = lists[0][i][taken[0][i] :][:units], lists[1][j][taken[1][j] :][:units]
        taken[0][i] += units
        taken[1][j] += units
        out += [(b, a, matches) if turned else (a, b, matches) for a, b in zip(ones, others)]
    return out


def _count(sorted_groups: np.ndarray) -> np.ndarray:
    """Number from 0 within each run of equal values."""
    n = np.arange(len(sorted_groups))
    return n - np.maximum.accumulate(np.where(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]]), n, 0)) if len(n) else n


def _ids(*columns: np.ndarray) -> np.ndarray:
    """The same number for rows with the same values; values are -1 or more."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        out = np.unique(out * (int(c.max(initial=0)) + 2) + c + 1, return_inverse=True)[1]
    return out


def best_of_many(gain: np.ndarray) -> np.ndarray:
    """Gains (document, few, several) -> (document, few): the one of the several that each of the few goes to."""
    docs, few, several = gain.shape
    best = np.full((docs, 1 << few), -1, np.int64)
    best[:, 0] = 0
    took = np.full((several, docs, 1 << few), -1, np.int8)
    for j in range(several):
        now = best.copy()
        for k in range(few):
            sets = np.flatnonzero(np.arange(1 << few) >> k & 1)
            was = best[:, sets ^ (1 << k)]
            tried = np.where(was >= 0, was + gain[:, k, j, None], -1)
            better = tried > now[:, sets]
            now[:, sets] = np.where(better, tried, now[:, sets])
            took[j][:, sets] = np.where(better, np.int8(k), took[j][:, sets])
        best = now
    out, used, n = np.zeros((docs, few), np.int64), np.full(docs, (1 << few) - 1), np.arange(docs)
    for j in range(several - 1, -1, -1):
        k = took[j][n, used].astype(np.int64)
        d = np.flatnonzero(k >= 0)
        out[d, k[d]] = j
        used[d] ^= 1 << k[d]
    return out


def aligned_rows(doc: np.ndarray, found: np.ndarray, alone: np.ndarray, codes: np.ndarray, numbers: np.ndarray, rel: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found row, gold row, matching fields) of the best pairing of each document, all rows once; -1 for no partner.

    Rows stand by document, and those of a side by place.  ``codes`` and ``numbers`` hold, for each field, a code of every
    row's value (-1: none) and its number (NaN: none).  Rows that are ``alone`` have no partner.
    """
    width, hard = len(codes), np.zeros(int(doc.max(initial=-1)) + 1, bool)
    for x in numbers:  # documents with numbers that match and are not the same
        at = np.flatnonzero(~np.isnan(x))
        hard[doc[at[np.isinf(x[at])]]] = True
        order = at[np.lexsort((x[at], doc[at]))]
        with np.errstate(invalid="ignore"):
            a, b = x[order[:-1]], x[order[1:]]
            near = (doc[order[1:]] == doc[order[:-1]]) & (a != b) & (np.abs(a - b) <= rel * np.maximum(np.abs(a), np.abs(b)))
        hard[doc[order[1:][near]]] = True
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cls = _ids(doc, *codes)
    rows = np.flatnonzero(~alone & ~hard[doc])
    # equal records, in the order of their places
    side = cls * 2 + found
    order = rows[np.argsort(side[rows], kind="stable")]
    nth = np.zeros(len(doc), np.int64)
    nth[order] = _count(side[order])
    f, g = rows[found[rows]], rows[~found[rows]]
    both = lambda r: cls[r] * (int(nth.max(initial=0)) + 1) + nth[r]
    _, at_f, at_g = np.intersect1d(both(f), both(g), assume_unique=True, return_indices=True)
    out.append((f[at_f], g[at_g], np.full(len(at_f), width)))
    left = ~alone & ~hard[doc]
    left[f[at_f]] = left[g[at_g]] = False
    # the others, by the numbers of records on either side
    docs = int(doc.max(initial=-1)) + 1
    n_f, n_g = np.bincount(doc[left & found], minlength=docs), np.bincount(doc[left & ~found], minlength=docs)
    few, several = np.minimum(n_f, n_g), np.maximum(n_f, n_g)
    many = ~hard & (few > 0) & ((few > FEW) | (several > SEVERAL))
    unit = width * int(max((n_f + n_g).max(initial=0), 1)) + 1
    turned = n_f > n_g
    small, large = (np.flatnonzero(left & ((found ^ turned[doc]) == x)) for x in (True, False))
    start = [np.searchsorted(doc[r], np.arange(docs)) for r in (small, large)]
    todo = np.flatnonzero((few > 0) & ~hard & ~many)
    shape = few[todo] * (SEVERAL + 1) + several[todo]
    for kind in np.unique(shape):
        own, n, m = todo[shape == kind], int(kind) // (SEVERAL + 1), int(kind) % (SEVERAL + 1)
        step = max(1, DENSE // (m * 2**n))
        for i in range(0, len(own), step):
            d = own[i : i + step]
            x, y = small[start[0][d][:, None] + np.arange(n)], large[start[1][d][:, None] + np.arange(m)]
            same = [codes[f][x][:, :, None] == codes[f][y][:, None, :] for f in range(width)]
            gain = sum(e * (unit + (codes[f][x] >= 0)[:, :, None]) for f, e in enumerate(same))
            to = best_of_many(gain)
            picked = np.take_along_axis(gain, to[:, :, None], 2)[:, :, 0] // unit
            mine, theirs, k = _dealt(x.ravel(), np.take_along_axis(y, to, 1).ravel(), picked.ravel(), cls, y.ravel())
            swap = turned[doc[mine]]
            out.append((np.where(swap, theirs, mine), np.where(swap, mine, theirs), k))
    # documents with more records or with numbers that match and are not the same, one by one
    for d in np.flatnonzero(hard | many):
        begin, end = np.searchsorted(doc, [d, d + 1])
        own = np.arange(begin, end)
        own = own[~alone[own] if hard[d] else left[own]]
        sides = [own[found[own] == x] for x in (True, False)]
        records = [[tuple(float(numbers[f][r]) if not np.isnan(numbers[f][r]) else None if codes[f][r] < 0 else str(codes[f][r]) for f in range(width)) for r in s] for s in sides]
        pairs = pairing(*records, rel)
        if pairs:
            a, b, k = map(np.array, zip(*pairs))
            out.append((sides[0][a], sides[1][b], k))
    a, b, k = (np.concatenate(c).astype(np.int64) for c in zip(*out))
    lone = np.ones(len(doc), bool)
    lone[a] = lone[b] = False
    lone = np.flatnonzero(lone)
    none = np.full(len(lone), -1)
    return np.concatenate([a, np.where(found[lone], lone, -1)]), np.concatenate([b, np.where(found[lone], -1, lone)]), np.concatenate([k, none])


def _dealt(x: np.ndarray, y: np.ndarray, matches: np.ndarray, cls: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same pairs of classes, with the records of a class dealt in the order of their places.

    ``x`` has all records of its side, ``rows`` all of the other.
    """
    order = np.lexsort((cls[y], cls[x]))
    theirs = cls[y[order]]
    by = np.argsort(theirs, kind="stable")
    rows = rows[np.lexsort((rows, cls[rows]))]
    others = np.empty(len(x), np.int64)
    others[by] = rows[np.searchsorted(cls[rows], theirs[by]) + _count(theirs[by])]
    return x[np.lexsort((x, cls[x]))], others, matches[order]
