"""Text metrics in Python, for pandas functions: n-gram F-scores, BLEU, sequence ratio.

chrF++ after Popovic (2017): character n-grams to 6 and word n-grams to 2, beta 2, averaged over the orders that either
side has. BLEU after Papineni et al. (2002): clipped n-gram precisions to 4, geometric mean, brevity penalty; sentence
scores use the orders the candidate has (effective order).
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np

CHAR_ORDER, WORD_ORDER, BETA, BLEU_ORDER = 6, 2, 2.0, 4
#: From that many characters on, n-grams are counted in numpy.
LONG = 400
PUNCTUATION = re.compile(r"^([^\w\s])(.+)$|^(.+)([^\w\s])$")


def _ngrams(items: Sequence, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _shared_runs(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two bags of numbers."""
    (u, m), (v, n) = (np.unique(z, return_counts=True) for z in (x, y))
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def _char_counts(a: str, b: str) -> list[int]:
    """As by Counter, for long texts: n-grams as 64-bit hashes made from those one shorter."""
    sides = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) for t in (a, b)]
    grams = [np.zeros(len(s), np.uint64) for s in sides]
    out = []
    for n in range(1, CHAR_ORDER + 1):
        for k, s in enumerate(sides):
            ahead = s[n - 1 :]
            h = (grams[k][: len(ahead)] ^ (ahead + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            grams[k] = h ^ (h >> np.uint64(29))
        out += [len(grams[0]), len(grams[1]), _shared_runs(*grams)]
    return out


def _words(text: str) -> list[str]:
    """Words with one punctuation mark at an end set apart."""
    out = []
    for w in text.split():
        m = PUNCTUATION.match(w) if len(w) > 1 and not w.isalnum() else None
        out.extend([x for x in m.groups() if x] if m else [w])
    return out


def chrf_counts(candidate: str, reference: str) -> list[int]:
    """For every order: n-grams of the candidate, of the reference, and shared. Sums over texts give corpus scores."""
    out = []
    a, b = "".join(candidate.split()), "".join(reference.split())
    sides = [(a, b, CHAR_ORDER), (_words(candidate), _words(reference), WORD_ORDER)]
    if min(len(a), len(b)) >= LONG:
        out = _char_counts(a, b)
        del sides[0]
    for a, b, most in sides:
        for n in range(1, most + 1):
            x, y = _ngrams(a, n), _ngrams(b, n)
            out += [sum(x.values()), sum(y.values()), sum((x & y).values())]
    return out


def chrf_score(counts: Sequence[float]) -> float:
    precision = recall = 0.0
    orders = 0
    for k in range(0, len(counts), 3):
        a, b, shared = counts[k : k + 3]
        if a and b:
            precision += shared / a
            recall += shared / b
            orders += 1
    if not orders or not precision + recall:
        return 0.0
    p, r = precision / orders, recall / orders
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p + r else 0.0


def chrf(candidate: str | None, reference: str | None) -> float:
    """0 if either is blank."""
    if not (candidate or "").strip() or not (reference or "").strip():
        return 0.0
    return chrf_score(chrf_counts(candidate, reference))


def bleu_counts(candidate: str, reference: str) -> list[int]:
    """Lengths of both, then for every order n-grams of the candidate and clipped matches."""
    a, b = _tokens(candidate), _tokens(reference)
    out = [len(a), len(b)]
    for n in range(1, BLEU_ORDER + 1):
        x, y = _ngrams(a, n), _ngrams(b, n)
        out += [sum(x.values()), sum((x & y).values())]
    return out


def _tokens(text: str) -> list[str]:
    """Punctuation set apart, but not between digits."""
    text = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def bleu_score(counts: Sequence[float], effective: bool = False) -> float:
    """Orders without a match count as half of what halves with each such order (exponential smoothing)."""
    a, b = counts[0], counts[1]
    if not a:
        return 0.0
    logs, orders, smooth = 0.0, 0, 1.0
    for k in range(2, len(counts), 2):
        n, hits = counts[k], counts[k + 1]
        if not n:
            if effective:
                break
            return 0.0
        orders += 1
        if not hits:
            smooth *= 2
            hits = 1 / smooth
        logs += math.log(hits / n)
    if not orders or not any(counts[k] for k in range(3, len(counts), 2)):
        return 0.0
    return 100 * math.exp(min(0.0, 1 - b / a) + logs / orders)


def bleu(candidate: str | None, reference: str | None) -> float:
    if not (candidate or "").strip() or not (reference or "").strip():
        return 0.0
    return bleu_score(bleu_counts(candidate, reference), effective=True)


def sequence_ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()
