"""Jaro-Winkler similarity of display names and brand names, vectorised for Arrow batches."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from headrisk.constants import (BRAND_MARGIN, BRAND_MIN_CORE, BRAND_MIN_NAME, BRAND_MIN_SCORE, BRANDS,
                                BRANDS_CORE_REQUIRED)

# executors get these few functions with the task, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BRAND_DDL = "brand_domain string, brand_score double, brand_rank int"


def jaro_winkler(names: list[str], other: str, scale: float = 0.1, prefix_max: int = 4) -> np.ndarray:
    """Similarity of every name to ``other``, four decimals; two empty texts are equal."""
    lengths = np.array([len(n) for n in names], dtype=np.int64)
    m = len(other)
    if m == 0 or not len(names):
        return np.where(lengths == m, 1.0, 0.0)
    width = max(int(lengths.max()), 1)
    text = np.zeros((len(names), width), dtype=np.uint32)
    for row, name in enumerate(names):
        text[row, :len(name)] = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32)
    target = np.frombuffer(other.encode("utf-32-le"), dtype=np.uint32)

    reach = np.maximum(np.maximum(lengths, m) // 2 - 1, 0)
    used = np.zeros((len(names), m), dtype=bool)
    matched = np.zeros(text.shape, dtype=bool)
    for i in range(width):
        for j in range(m):
            hit = ((text[:, i] == target[j]) & ~used[:, j] & ~matched[:, i]
                   & (abs(i - j) <= reach) & (i < lengths))
            used[:, j] |= hit
            matched[:, i] |= hit
    common = matched.sum(axis=1)

    # the k-th matched character on either side; a pair that differs is half a transposition
    rows = np.arange(len(names))
    left = np.zeros((len(names), m), dtype=np.uint32)
    right = np.zeros((len(names), m), dtype=np.uint32)
    place = np.zeros(len(names), dtype=np.int64)
    for i in range(width):
        on = matched[:, i]
        left[rows[on], place[on]] = text[on, i]
        place += on
    place[:] = 0
    for j in range(m):
        on = used[:, j]
        right[rows[on], place[on]] = target[j]
        place += on
    swaps = (left != right).sum(axis=1) / 2

    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (common / lengths + common / m + (common - swaps) / common) / 3
    jaro = np.where(common > 0, jaro, 0.0)
    prefix = np.zeros(len(names))
    same = np.ones(len(names), dtype=bool)
    for i in range(min(prefix_max, width, m)):
        same &= (text[:, i] == target[i]) & (i < lengths)
        prefix += same
    return np.floor((jaro + prefix * scale * (1 - jaro)) * 10000 + 0.5) / 10000


def best_brands(names: list[str]) -> pd.DataFrame:
    """The clearly best brand of every normalised name; nulls where none qualifies."""
    entries = [(core, domain, rank) for rank, (core, domain) in enumerate(BRANDS, 1)
               if len(core) >= BRAND_MIN_CORE]
    scores = np.empty((len(names), len(entries)))
    for k, (core, _domain, _rank) in enumerate(entries):
        scores[:, k] = jaro_winkler(names, core)
        if core in BRANDS_CORE_REQUIRED:
            scores[[core not in n for n in names], k] = -1.0
    best = scores.argmax(axis=1)
    top = scores[np.arange(len(names)), best]
    scores[np.arange(len(names)), best] = -1.0
    second = scores.max(axis=1)
    clear = (top >= BRAND_MIN_SCORE) & ~((second >= 0) & (top - second < BRAND_MARGIN))
    return pd.DataFrame({
        "brand_domain": [entries[b][1] if ok else None for b, ok in zip(best, clear)],
        "brand_score": np.where(clear, top, np.nan),
        "brand_rank": pd.array([entries[b][2] if ok else None for b, ok in zip(best, clear)], dtype="Int32"),
    })


def _infer_brand(names: pd.Series) -> pd.DataFrame:
    long_enough = names.where(names.str.len() >= BRAND_MIN_NAME)
    codes, distinct = pd.factorize(long_enough)  # every distinct name of a batch is compared once
    found = best_brands(list(distinct)) if len(distinct) else best_brands(["-"]).iloc[:0]
    out = found.reindex(codes).reset_index(drop=True)
    out["brand_score"] = out["brand_score"].astype(object).where(out["brand_score"].notna(), None)
    return out


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(index=a.index, dtype="float64")
    for other, part in a.groupby(b):
        out[part.index] = jaro_winkler(list(part), other)
    return out


def infer_brand(normalised_name: Column) -> Column:
    """Clearly best brand of a normalised Latin display name, if any."""
    return F.pandas_udf(_infer_brand, BRAND_DDL)(normalised_name)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """Null when either side is null."""
    return F.when(a.isNotNull() & b.isNotNull(),
                  F.pandas_udf(_jaro_winkler, "double")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(index=a.index, dtype="float64")
    for other, part in a.groupby(b):
        out[part.index] = jaro_winkler(list(part), other, scale=0.0)
    return out


def jaro_similarity(a: Column, b: Column) -> Column:
    """Jaro similarity without the prefix bonus; null when either side is null."""
    return F.when(a.isNotNull() & b.isNotNull(),
                  F.pandas_udf(_jaro, "double")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
