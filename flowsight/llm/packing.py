"""Packing of token sequences by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The program asks for the least total of configurations
that covers the histogram; its size depends on the capacity alone. Multiplicative weights keep a price per
length that falls as the length is covered; a knapsack dynamic program finds, for every length, the most valuable
configuration that holds it; those near the best value share the step. The fractional solution is rounded along its
running total, what stays uncovered is solved again, and the last few pieces are placed by best fit.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowsight.llm.common import Batches, map_rows, stored
from flowsight.llm.tokens import encoder, vocabulary

#: Steps of multiplicative weights, sharpness of the weights, and the share of the best value at which
#: a configuration still takes part.
STEPS, SHARPNESS, NEAR_BEST = 40, 8.0, 0.995
#: Below so many pieces best fit places the rest.
FEW_PIECES = 2_000


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity, and the place in lengths of a piece to take there (-1: leave one token free)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if n := fitting[room]:
            gains = prices[:n] + value[room - lengths[:n]]
            best = int(gains.argmax())
            if gains[best] > value[room]:
                value[room], choice[room] = gains[best], best
    return value, choice


def _filled(lengths: np.ndarray, choice: np.ndarray, chosen: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For each chosen length the best configuration that holds it, as sorted places in lengths."""
    room, columns = capacity - lengths[chosen], [chosen]
    while (room > 0).any():
        take = np.where(room > 0, choice[room], -1)
        columns.append(take)
        room = np.where(take >= 0, room - lengths[take], room - 1)
    return [tuple(sorted(row[row >= 0].tolist())) for row in np.stack(columns, axis=1)]


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int = STEPS) -> Counter:
    """A fractional cover of the histogram: configurations (places in lengths) with their amounts.

    Prices start at the share of a sequence that a length takes, which is what a full sequence is worth per token, and
    fall with the share of the length that is covered. No length is covered twice over, so a part may stay uncovered.
    """
    total = float((lengths * counts).sum()) / capacity
    need, amounts = counts.astype(np.float64), Counter()
    for _ in range(steps):
        covered = 1.0 - need / counts
        prices = np.where(need > 1e-9, lengths / capacity * np.exp(-SHARPNESS * (covered - covered.min())), 0.0)
        value, choice = _knapsack(lengths, prices, capacity)
        worth = prices + value[capacity - lengths]
        chosen = np.flatnonzero((worth >= NEAR_BEST * worth.max()) & (need > 1e-9))
        share = need[chosen] * lengths[chosen]
        share *= total / steps / share.sum()
        for places, amount in zip(_filled(lengths, choice, chosen, capacity), share.tolist()):
            times = Counter(places)
            amount = min(amount, *(need[place] / n for place, n in times.items()))
            if amount > 1e-9:
                amounts[places] += amount
                for place, n in times.items():
                    need[place] -= n * amount
        if need.max() <= 1e-9:
            break
    return amounts


class Plan:
    """Places for pieces known by length and rank among pieces of that length, in runs of equal sequences."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used: Counter = Counter()
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: first sequence, number
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, number, first sequence, offset

    def _put(self, length: int, number: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], number, sequence, offset))
        self.used[length] += number

    def add(self, pieces: list[int], number: int) -> None:
        """Open `number` sequences that each hold pieces of these lengths."""
        offset = 0
        for length in pieces:
            self._put(length, number, self.sequences, offset)
            offset += length
        self.open[self.capacity - offset].append((self.sequences, number))
        self.sequences += number

    def best_fit(self, length: int, number: int) -> None:
        """Place pieces in the open sequences with the least free tokens, then in new ones."""
        while number:
            free = min((f for f, groups in self.open.items() if groups and f >= length), default=None)
            if free is None:
                each = self.capacity // length
                if number >= each:
                    self.add([length] * each, number // each)
                    number %= each
                if number:
                    self.add([length] * number, 1)
                return
            sequence, there = self.open[free].pop()
            taken = min(number, there)
            self._put(length, taken, sequence, self.capacity - free)
            self.open[free - length].append((sequence, taken))
            if there > taken:
                self.open[free].append((sequence + taken, there - taken))
            number -= taken


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack a histogram of lengths from 1 to capacity. Its size, not the number of pieces, bounds the work."""
    plan, left = Plan(capacity), Counter({n: c for n, c in histogram.items() if c})
    while sum(left.values()) > FEW_PIECES:
        lengths = np.array(sorted(left))
        counts = np.array([left[n] for n in lengths.tolist()])
        amounts = configuration_program(lengths, counts, capacity)
        before, running, done = sum(left.values()), 0.0, 0
        # Neighbours in this order hold similar lengths, so rounding the running total moves little between lengths.
        for places in sorted(amounts, reverse=True):
            running += amounts[places]
            wanted = int(running) - done
            if not wanted:
                continue
            done += wanted
            pieces = Counter(lengths[list(places)].tolist())
            number = min(wanted, *(left[n] // c for n, c in pieces.items()))
            if number:
                plan.add(sorted(pieces.elements(), reverse=True), number)
                left -= Counter({n: c * number for n, c in pieces.items()})
        if sum(left.values()) > before / 2:
            break
    for length in sorted(left, reverse=True):
        plan.best_fit(length, left[length])
    return plan


def pieces_of(docs: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, place): documents cut where longer than the capacity."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def cut(batches: Batches) -> Batches:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder(path).ids(batch["text"].to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    out.append((doc_id, piece, start, len(own), zlib.crc32(own.data), part, seen[len(own)]))
                    seen[len(own)] += 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return map_rows(rows, cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, place bigint")


def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece's place in a sequence.

    A document is its ids and end_id. Only documents longer than the capacity are cut, into pieces of that length
    and a last one that may be shorter. offset counts the ids before the piece in its sequence. ids_crc32 is the
    unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. path: a vocabulary file of the tokenizers library.

    Null text: as empty, so the end id alone. Null and repeated doc_ids are packed like others. Other columns are not read.
    Empty table: no rows.

    Texts are never shuffled. The driver sees the histogram of lengths (at most `capacity` rows) and makes a plan
    whose size depends on the capacity; pieces find their place by length and rank, and ranks come from counts
    per length and task.
    """
    pieces = stored(pieces_of(docs, capacity, path or vocabulary("word_bpe_49k.json"), end_id))
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(make_plan(histogram, capacity).runs), dtype=np.int64).reshape(-1, 5)
    # One increasing key per run: length, then first rank.
    starts = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches: Batches) -> Batches:
        for batch in batches:
            key = (batch["length"].to_numpy() << 48) + batch["rank"].to_numpy()
            at = np.searchsorted(starts, key, side="right") - 1
            sequence = runs[at, 3] + key - starts[at]
            kept = [batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*kept, pa.array(sequence), pa.array(runs[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Stored small, this table is large in memory, and it grows with the number of tasks: never broadcast.
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")
    return map_rows(
        ranked, place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", 10_000,
    )
