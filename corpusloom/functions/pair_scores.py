"""Scores of all pairs of texts at once: the numbers of `metrics.chrf` and `metrics.bleu`, to the last bit.

The n-grams of every text are counted once, as whole numbers without hashes. What two texts share is counted for all pairs
together: in a few texts along runs of one n-gram, in many by products of 0/1 matrices over (n-gram, nth time).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

from corpusloom.functions import metrics

#: Up to that many texts of a record are met along runs, more by matrices.
FEW = 16
#: Columns of a matrix at once.
WIDTH = 8192
#: A score is summed as two whole numbers, by 2**-30 and 2**-61: exact, whatever the order of the summands.
HIGH, LOW = 2.0**30, 2.0**31


def _numbered(lists: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    flat = list(chain.from_iterable(lists))
    ids = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    return np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat)), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _characters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    bare = ["".join(t.split()) for t in texts]
    points = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    return (np.cumsum(seen) - 1)[points], np.repeat(np.arange(len(texts)), [len(t) for t in bare])


def _runs(items: np.ndarray, owner: np.ndarray, n_texts: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For every order: n-grams, texts and counts, sorted by n-gram and text; and the number of n-grams of each text."""
    bits = max(1, (n_texts - 1).bit_length())
    size = int(items.max(initial=0)) + 1
    code, top = items, size
    for n in range(1, most + 1):
        if n > 1:
            if top * size >= 2 ** (62 - bits):
                code = np.unique(code, return_inverse=True)[1]
                top = int(code.max(initial=0)) + 1
            code = code[:-1] * size + items[n - 1 :]
            top *= size
        inside = owner[: len(code)] == owner[n - 1 :]
        of = owner[: len(code)][inside]
        keys = np.sort(code[inside] << bits | of)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        kept = keys[starts]
        yield kept >> bits, kept & ((1 << bits) - 1), np.diff(starts, append=len(keys)), np.bincount(of, minlength=n_texts)


def _orders(texts: Sequence[str], geo: bool) -> Iterator[tuple[np.ndarray, ...]]:
    yield from _runs(*_characters(texts), len(texts), metrics.CHAR_ORDER)
    yield from _runs(*_numbered([metrics._words(t) for t in texts]), len(texts), metrics.WORD_ORDER)
    if geo:
        yield from _runs(*_numbered([metrics._tokens(t) for t in texts]), len(texts), metrics.BLEU_ORDER)


def _chrf(orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """As `metrics.chrf_score`; of each order shared n-grams, those of the candidate and of the reference."""
    precision = recall = used = 0.0
    for shared, a, b in orders:
        both = (a > 0) & (b > 0)
        precision = precision + np.where(both, shared / np.maximum(a, 1), 0.0)
        recall = recall + np.where(both, shared / np.maximum(b, 1), 0.0)
        used = used + both
    p, r = precision / np.maximum(used, 1), recall / np.maximum(used, 1)
    below = metrics.BETA**2 * p + r
    return np.where(below > 0, 100 * (1 + metrics.BETA**2) * p * r / np.where(below > 0, below, 1.0), 0.0)


def _each(f, x: np.ndarray) -> np.ndarray:
    """numpy's own logarithm and power differ from Python's in the last bit."""
    return np.array(list(map(f, x.ravel().tolist())), float).reshape(x.shape)


def _bleu(orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """As `metrics.bleu_score` with effective order."""
    logs, smooth, used, found = 0.0, 1.0, 0, False
    for shared, a, _ in orders:
        there, none = a > 0, (a > 0) & (shared == 0)
        smooth = np.where(none, smooth * 2, smooth)
        hits = np.where(none, 1 / smooth, np.maximum(shared, 1))
        logs = logs + np.where(there, _each(math.log, hits / np.maximum(a, 1)), 0.0)
        used, found = used + there, found | (shared > 0)
    a, b = orders[0][1:]
    return np.where(found, 100 * _each(math.exp, np.minimum(0.0, 1 - b / np.maximum(a, 1)) + logs / np.maximum(used, 1)), 0.0)


def _scores(orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    n = metrics.CHAR_ORDER + metrics.WORD_ORDER
    return [_chrf(orders[:n]), *([_bleu(orders[n:])] if len(orders) > n else [])]


def _by_matrices(gram: np.ndarray, owner: np.ndarray, count: np.ndarray, n_left: int, n_texts: int) -> np.ndarray:
    """Shared n-grams of the first n_left texts with the others, or of all with all if there are no others."""
    square = n_left == n_texts
    shared = np.zeros((n_left, n_texts if square else n_texts - n_left))
    if not len(gram):
        return shared
    place = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
    df = np.bincount(place)
    left = np.bincount(place[owner < n_left], minlength=len(df))
    of_use = (df > 1 if square else (left > 0) & (left < df))[place]
    place, owner, count = place[of_use], owner[of_use], count[of_use]
    if not len(place):
        return shared
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    most = np.maximum.reduceat(count, starts)
    column = np.repeat(np.cumsum(most) - most, np.diff(starts, append=len(place)))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    column, row = np.repeat(column, count) + nth, np.repeat(owner, count)
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    last = int(column[-1]) + 1
    edges = np.searchsorted(column, np.arange(0, last + WIDTH, WIDTH))
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        grid = np.zeros((n_texts, min(WIDTH, last - k * WIDTH)), np.float32)
        grid[row[low:high], column[low:high] - k * WIDTH] = 1
        shared += grid @ grid.T if square else grid[:n_left] @ grid[n_left:].T
    return shared


def scores_within(texts: Sequence[str], sizes: Sequence[int], geo: bool) -> list[np.ndarray]:
    """chrF++ and, for geo, BLEU of each text (as candidate) with each of its record; records of so many texts follow one another.

    A record of n texts fills n * n places, candidate by candidate.
    """
    n_texts, sizes = len(texts), np.asarray(sizes)
    record = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(n_texts) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = sizes[record]
    base = np.cumsum(wide) - wide
    a = np.repeat(np.arange(n_texts), wide)
    b = a - local[a] + np.arange(len(a)) - base[a]
    turned, own = base[b] + local[a], base + local
    orders = []
    for gram, owner, count, total in _orders(texts, geo):
        if len(sizes) == 1 and n_texts > FEW:
            shared = _by_matrices(gram, owner, count, n_texts, n_texts).ravel()
        else:
            shared, at, of = np.zeros(len(a)), np.arange(len(gram)), record[owner]
            for step in range(1, int(sizes.max(initial=1))):
                at = at[: np.searchsorted(at, len(gram) - step)]
                at = at[(gram[at] == gram[at + step]) & (of[at] == of[at + step])]
                if not len(at):
                    break
                shared += np.bincount(base[owner[at]] + local[owner[at + step]], np.minimum(count[at], count[at + step]), len(a))
            shared += shared[turned]
        shared[own] = total
        orders.append((shared, total[a], total[b]))
    return _scores(orders)


def scores_between(left: Sequence[str], right: Sequence[str], geo: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Scores of the left texts as candidates with the right ones as references, and of the right ones with the left ones."""
    n, n_texts = len(left), len(left) + len(right)
    orders, back = [], []
    for gram, owner, count, total in _orders([*left, *right], geo):
        shared = _by_matrices(gram, owner, count, n, n_texts)
        a, b = np.broadcast_to(total[:n, None], shared.shape), np.broadcast_to(total[None, n:], shared.shape)
        orders.append((shared, a, b))
        back.append((shared.T, b.T, a.T))
    return _scores(orders), _scores(back)


def whole(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as two whole numbers each, to be summed in any order."""
    high = np.floor(scores * HIGH)
    return high.astype(np.int64), np.floor((scores * HIGH - high) * LOW).astype(np.int64)
