"""Words of many texts at once, as places in one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STRETCH = 500_000  # bytes looked at together
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the ends of each (from 0); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def stretches(ends: np.ndarray, most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, at least one text each."""
    start = 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def split(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, and text of every word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACES[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    cuts = ends[:-1][np.diff(ends) > 0]
    opens[cuts] = word[cuts]
    closes[cuts[1:] - 1] = word[cuts[1:] - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, stops, np.searchsorted(ends, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    firsts = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        bytes_ = data[np.repeat(starts, sizes) + inside].astype(np.uint64) + np.uint64(1)
        bytes_ *= _POWERS[inside % len(_POWERS)]
        if (longest := int(sizes.max())) > len(_POWERS):  # further powers for the bytes beyond the table
            further = np.cumprod(np.full(longest // len(_POWERS), _POWERS[-1]))
            far = np.flatnonzero(inside >= len(_POWERS))
            bytes_[far] *= further[inside[far] // len(_POWERS) - 1]
        sums = np.add.reduceat(bytes_, firsts)
        return mixed(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words each followed by one space, with their new places."""
    sizes = stops - starts + 1
    new = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(new, sizes)
    at = np.minimum(np.repeat(starts, sizes) + inside, max(0, len(data) - 1))
    out = data[at].copy()
    out[new + sizes - 1] = 32
    return out, new, new + sizes - 1


def slices(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Bytes of all slices one after another."""
    sizes = stops - starts
    firsts = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - firsts, sizes) + np.arange(int(sizes.sum()))]
