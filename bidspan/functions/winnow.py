"""Winnowed grams: of every few neighbouring grams of a text the least hash, so that a quotation shares one with its source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least length of a quotation, length of its grams, and neighbours of which one is kept.
TIERS = [(96, 32, 65), (24, 12, 13), (12, 8, 5)]
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def tier(length: int) -> tuple[int, int]:
    """Gram and window for quotations of ``length`` characters; very short ones are one gram themselves."""
    return next(((gram, window) for least, gram, window in TIERS if length >= least), (length, 1))


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes that begin at every byte, as far as they fit."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.zeros(len(data), np.uint64)
    for r in range(min(8, len(data))):
        some = padded[r : r + (len(padded) - r) // 8 * 8].view("<u8")
        words[r::8] = some[: len(words[r::8])]
    h = np.full(n, np.uint64(gram), np.uint64)
    if gram < 8:
        offsets, mask = [0], np.uint64((1 << (8 * gram)) - 1)
    else:
        offsets, mask = [*range(0, gram - 7, 8)], np.uint64(2**64 - 1)
        offsets += [gram - 8] if gram % 8 else []
    for at in offsets:
        h = (h ^ (words[at : at + n] & mask)) * _ODD[0]
        h ^= h >> np.uint64(32)
        h *= _ODD[1]
        h ^= h >> np.uint64(29)
    return h


def winnow(data: bytes, gram: int, window: int) -> np.ndarray:
    """The least hash of every ``window`` neighbouring grams, each once; none for a text shorter than that."""
    h = gram_hashes(data, gram)
    n = len(h) - window + 1
    if n <= 0:
        return h[:0]
    rows = np.concatenate((h, np.full(-len(h) % window, np.uint64(2**64 - 1)))).reshape(-1, window)
    ahead, back = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.unique(np.minimum(back[:n], ahead[window - 1 : window - 1 + n]))


def short_form(key: Column) -> Column:
    """The low 16 bits of a hash: few enough values to keep a set of them beside a text."""
    return key.bitwiseAND(F.lit(0xFFFF)).cast("int")


def text_keys(form: Column, tiers: list[tuple[int, int]], short: Column) -> Column:
    """Distinct winnowed hashes of a text for all the ``tiers`` (gram, window) in use, of those in ``short`` only; null means all."""

    @F.pandas_udf("array<bigint>")
    def keys(forms: pd.Series, shorts: pd.Series) -> pd.Series:
        def one(text: str | None, few: np.ndarray | None) -> np.ndarray:
            data = (text or "").encode()
            found = np.concatenate([winnow(data, *t) for t in tiers]).view(np.int64)
            return found if few is None else found[np.isin(found & 0xFFFF, few)]

        return pd.Series([one(*row) for row in zip(forms, shorts)], dtype="object")

    return keys(form, short)


def probe_key(probe: Column) -> Column:
    """The winnowed hash of a quotation's first window: every text that holds the quotation has it among its own."""

    @F.pandas_udf("bigint")
    def key(probes: pd.Series) -> pd.Series:
        def one(text: str) -> int:
            data = text.encode()
            gram, window = tier(len(data))
            return int(winnow(data[: gram + window - 1], gram, window).view(np.int64)[0])

        return probes.map(one)

    return key(probe)
