"""Periodic runs of words: stretches that repeat with a fixed lag, found by seeds on diagonals and extended once.

In a run of period q and length n word i equals word i + q for n - q words in a row, a stretch on the diagonal of lag q.
A run of at least max(least, 2q) words guarantees a stretch of max(least - q, q) words, so a k-gram that lies on a
multiple of k, k being half of that overlap, stands inside it and occurs again q words later. k doubles with the lag: seeds
of k words serve lags from 2k to 4k, and a text of n words has at most 2n occurrence pairs per doubling, however often its
words repeat.

Pairs of one lag are taken in the order of position beside the furthest place covered so far on that diagonal; a pair
that starts where the cover ends prolongs it without a comparison, and only the two ends of a cover are extended.

k-grams are named exactly (a name per pair of names of its halves), so nothing rests on digests. The texts of a batch
are worked on together; a name belongs to one text, so no pair joins two of them.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from flowsight.llm.common import Batches, map_rows

#: Least words of a run.
LEAST = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names of pairs of names; -1 where a part has none or the pair occurs once, so that it cannot be a seed."""
    names = np.full(len(first), -1, dtype=np.int64)
    at = np.flatnonzero((first >= 0) & (second >= 0))
    if len(at):
        pairs = first[at] * (second.max() + 1) + second[at]
        _, found, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        names[at] = np.where(counts[found] > 1, found, -1)
    return names


def _shifted(names: np.ndarray, by: int) -> np.ndarray:
    out = np.full(len(names), -1, dtype=np.int64)
    out[: max(0, len(names) - by)] = names[by:]
    return out


def _same(names: np.ndarray, at: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Where the grams at and at + lag have one name; places outside the texts have none."""
    inside = (at >= 0) & (at + lags < len(names))
    left, right = names[np.where(inside, at, 0)], names[np.where(inside, at + lags, 0)]
    return inside & (left >= 0) & (left == right)


def _pairs(names: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of each seed on a multiple of step and each later occurrence at a lag from low to high - 1."""
    occurs = np.flatnonzero(names >= 0)
    # The index: grams by name, then position.
    size = len(names) + high + 1
    index = np.sort(names[occurs] * size + occurs)
    seeds = occurs[occurs % step == 0]
    begin = np.searchsorted(index, names[seeds] * size + seeds + low)
    n = np.searchsorted(index, names[seeds] * size + seeds + high) - begin
    starts = np.repeat(seeds, n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    return starts, index[place] % size - starts


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each text, given as words: rows (start, length, period) by start, then period."""
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    known: dict[bytes, int] = {}
    # A place between two texts has no name.
    total = int(sizes.sum()) + len(texts)
    begins = np.cumsum(sizes + 1) - sizes - 1
    numbers = np.full(total, -1, dtype=np.int64)
    for begin, words in zip(begins.tolist(), texts):
        numbers[begin : begin + len(words)] = [known.setdefault(w, len(known)) for w in words]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    single = _named(owner, numbers)
    # A run of period q has max(least - q, q) matches, half of `least` at the fewest, and half of those are a seed.
    k = max(1, (least // 2 + 1) // 2)
    grams = single
    for extra in range(1, k):
        grams = _named(grams, _shifted(single, extra))
    levels, low, high, found = [(1, single)] * (k - 1), 1, 4 * k, []
    while low <= (sizes.max() // 2 if len(sizes) else 0) and (grams >= 0).any():
        at, lags = _pairs(grams, k, low, high)
        if len(at):
            order = np.lexsort((at, lags))
            at, lags = at[order], lags[order]
            # Pairs that begin where the cover of their lag ends only move its end.
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (lags[1:] != lags[:-1]) | (at[1:] != at[:-1] + k)
            heads = np.flatnonzero(fresh)
            left, lag = at[heads], lags[heads]
            right = at[np.append(heads[1:], len(at)) - 1] + k
            # What is left to extend is shorter than k on both sides.
            for width, names in reversed(levels):
                left = left - width * _same(names, left - width, lag)
                right = right + width * _same(names, right, lag)
            length = right - left + lag
            good = length >= np.maximum(least, 2 * lag)
            found.append(np.stack((left[good], length[good], lag[good]), axis=1))
        levels.append((k, grams))
        grams = _named(grams, _shifted(grams, k))
        k, low, high = 2 * k, high, 2 * high
    runs = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    # A stretch that has a multiple of its period too is one run, that of the smallest.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    once = np.ones(len(runs), dtype=bool)
    once[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[once]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    of = owner[runs[:, 0]]
    runs[:, 0] -= begins[of]
    return np.split(runs, np.searchsorted(of, np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """The columns `keep` of docs (all of them by default) with runs and collapsed, one row per row of docs.

    runs is an array of (start, length, period) by start, then period: every stretch of at least max(least, 2 * period)
    words (`[^\\x20\\x09-\\x0D]+`) whose smallest period is `period` and that no neighbouring word prolongs. collapsed is
    the text's words joined by a space, without those that any run holds after its first period.

    Null, empty and blank texts: no runs, collapsed is empty. Repeated rows give repeated results. Columns of docs named
    runs or collapsed are replaced, others may have any name. Empty table: no rows. Whole texts are read without a shuffle; a task
    holds the texts of a batch and, for each doubling of the lag, a few numbers per word.
    """
    if least < 4:
        raise ValueError("least must be at least 4")
    added = ["runs", "collapsed"]
    kept = [c for c in (keep or docs.columns) if c not in added]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            # bytes.split() knows the blanks 0x20 and 0x09-0x0D only.
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch["text"].to_pylist()]
            found = find_runs(texts, least)
            flat = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(_RUN))
            short = [collapsed(words, r).decode("utf-8", "surrogatepass") for words, r in zip(texts, found)]
            columns = [pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(short, pa.string())]
            yield pa.record_batch([*(batch[c] for c in kept), *columns], [*kept, *added])

    read = docs.select(*dict.fromkeys([*kept, "text"]))
    added_schema = StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return map_rows(read, run, StructType([*docs.select(*kept).schema, *added_schema]))
