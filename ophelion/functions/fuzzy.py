"""Fuzzy ratios of two strings, 0..100: insertions and deletions only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _lcs(masks: dict[str, int], n: int, b: str) -> int:
    """Longest common subsequence of b and the text of n characters with these masks,
    by bit-parallel rows."""
    row = full = (1 << n) - 1
    get = masks.get
    for c in b:
        hit = row & get(c, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def lcs(a: str, b: str) -> int:
    return _lcs(_masks(a), len(a), b)


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer that is as long,
    or that one of its ends cuts off. A stretch whose last character the shorter text
    lacks is no better than the one before it."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, masks, best = len(short), _masks(short), 0.0
    for s in range(1 - n, len(long)):
        part = long[max(0, s) : s + n]
        if part[-1] in masks or s + n > len(long):
            if 200.0 * min(n, len(part)) / (n + len(part)) > best:
                best = max(best, 200.0 * _lcs(masks, n, part) / (n + len(part)))
    return best


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    """Compares the shared words with each side's shared and own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base = " ".join(both)
    left, right = " ".join([*both, *only_x]), " ".join([*both, *only_y])
    best = ratio(" ".join(only_x), " ".join(only_y)) if not base else ratio(left, right)
    return max(best, ratio(base, left), ratio(base, right)) if base else best


#: Characters of a shorter text that fit one word of bits, and pairs compared at a time.
BITS, CHUNK = 64, 32_768


def _codes(texts: Sequence[str], n: int) -> np.ndarray:
    """Texts of n characters as rows of code points."""
    return np.array(texts, f"U{n}").view(np.uint32).reshape(len(texts), n)


def _best(hits: list[np.ndarray], back: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ratio, partial ratio) of many pairs at once by the rows of ``_lcs``. ``hits`` has
    for each character of the longer text the places in the shorter one, of n characters,
    as bits; ``back`` the same with the places counted from the end."""
    m, full = len(hits), np.uint64((1 << n) - 1)

    def scan(steps: list[np.ndarray], keep: int):
        row = np.full(hits[0].shape, full)
        for k, places in enumerate(steps, 1):
            hit = row & places
            row = (row + hit) | (row - hit)
            if k <= keep or k == len(steps):
                yield k, n - np.bitwise_count(row & full).astype(np.int64)

    partial = np.zeros(hits[0].shape)
    for k, common in scan(hits, n):
        if k <= n:  # a stretch at the start
            np.maximum(partial, 200.0 * common / (n + k), out=partial)
        whole = common
    for k, common in scan(back[::-1][: n - 1], n - 1):  # a stretch at the end
        np.maximum(partial, 200.0 * common / (n + k), out=partial)
    for start in range(1, m - n + 1):
        *_, (_, common) = scan(hits[start : start + n], 0)
        np.maximum(partial, 200.0 * common / (2 * n), out=partial)
    return 200.0 * whole / (n + m), partial


def _by_length(texts: Sequence[str]) -> dict[int, np.ndarray]:
    sizes = np.array([len(x) for x in texts], np.int64)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def paired_ratios(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``ratio`` and ``partial_ratio`` of each pair of texts that are not empty."""
    both = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    whole, partial = np.zeros(len(both)), np.zeros(len(both))
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(both):
        groups.setdefault((len(x), len(y)), []).append(k)
    for (n, m), every in groups.items():
        if n > BITS or len(every) < 8:
            for k in every:
                whole[k], partial[k] = ratio(*both[k]), partial_ratio(*both[k])
            continue
        step = max(1, CHUNK * BITS // (n + m) // 4)
        for at in range(0, len(every), step):
            some = every[at : at + step]
            short, long = _codes([both[k][0] for k in some], n), _codes([both[k][1] for k in some], m)
            hits, back = [], []
            for j in range(m):
                same = (short == long[:, j : j + 1]).astype(np.uint64)
                hits.append((same << np.arange(n, dtype=np.uint64)).sum(1, dtype=np.uint64))
                back.append((same << np.arange(n - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64))
            whole[some], partial[some] = _best(hits, back, n)
    return whole, partial


def near_pairs(a: Sequence[str], b: Sequence[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all pairs whose ratio or partial ratio is at or over
    the threshold; none of the texts is empty or has white space."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for p, mine in _by_length(a).items():
        for q, theirs in _by_length(b).items():
            swap = p > q
            short, long, n, m = (theirs, mine, q, p) if swap else (mine, theirs, p, q)
            x, y = [(b if swap else a)[k] for k in short], [(a if swap else b)[k] for k in long]
            if n > BITS:
                found = [(i, j) for i, s in zip(short, x, strict=True) for j, t in zip(long, y, strict=True) if ratio(s, t) >= threshold or partial_ratio(s, t) >= threshold]
                pairs = np.array(found, np.int64).reshape(-1, 2)
                out.append((pairs[:, 1], pairs[:, 0]) if swap else (pairs[:, 0], pairs[:, 1]))
                continue
            s, t = _codes(x, n), _codes(y, m)
            letters = np.unique(t)
            t = np.searchsorted(letters, t)
            ahead, behind = (np.zeros((len(letters), len(s)), np.uint64) for _ in range(2))
            for i in range(n):
                at = np.minimum(np.searchsorted(letters, s[:, i]), len(letters) - 1)
                held = np.flatnonzero(letters[at] == s[:, i])
                ahead[at[held], held] |= np.uint64(1 << i)
                behind[at[held], held] |= np.uint64(1 << (n - 1 - i))
            step = max(1, CHUNK // len(s))
            for at in range(0, len(t), step):
                part = t[at : at + step]
                whole, partial = _best([ahead[part[:, j]] for j in range(m)], [behind[part[:, j]] for j in range(m)], n)
                j, i = np.nonzero(np.maximum(whole, partial) >= threshold)
                i, j = short[i], long[at + j]
                out.append((j, i) if swap else (i, j))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


COLUMNS = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "fuzzy_best")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in COLUMNS]))
def fuzzy_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All four ratios cut to whole numbers, and the best; zeros where ours is empty."""
    x, y = a.fillna("").to_numpy(object), b.fillna("").to_numpy(object)
    out = np.zeros((len(x), 5), "int32")
    told = np.flatnonzero((x != "") & (y != ""))
    if len(told):
        whole, partial = paired_ratios(x[told], y[told])
        # a text without white space is one word
        sort, common = whole.copy(), whole.copy()
        for k, (one, other) in enumerate(zip(x[told], y[told], strict=True)):
            if len(one.split()) != 1 or len(other.split()) != 1 or one.strip() != one or other.strip() != other:
                sort[k], common[k] = token_sort_ratio(one, other), token_set_ratio(one, other)
        out[told, :4] = np.stack([whole, partial, sort, common], 1).astype("int32")
    for k in np.flatnonzero((x != "") & (y == "")):
        out[k, 2] = token_sort_ratio(x[k], "")  # 100 where ours is white space
    out[:, 4] = out[:, :4].max(1)
    return pd.DataFrame(out, columns=list(COLUMNS))
