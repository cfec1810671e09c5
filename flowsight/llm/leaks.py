"""Benchmark passages in documents: latent semantic retrieval, then exact checks of the candidates.

Documents are read as overlapping passages of words. Passages and benchmark items become TF-IDF vectors over hashed words
and are folded into a latent space from a randomised singular value decomposition of all passages' vectors. Items whose cosine
with a passage is high enough are candidates; the longest common subsequence of words between item and the words around the
passage, and the presence of the item's closing words, decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsight.llm.common import Batches, map_rows, mixed, stored, word_bounds, word_digests

#: Hashed words, latent dimensions, and further random directions of the sketch.
FEATURES, RANK, EXTRA = 8192, 96, 32
#: Words of a passage and between the starts of passages.
PASSAGE, STRIDE = 48, 16
#: Files of a stored sample.
SAMPLE_FILES = 16
#: Blocks of STRIDE words that are folded at a time, rows that are added up as one, and rows that are held for that.
FOLDED, ADDED, HELD = 16_384, 8, 8192
#: Least weight of a hashed word.
LEAST_IDF = 0.01
#: Words of a part of a long text that is held at a time.
CHUNK = 4096 * STRIDE
#: Items that are searched for in one reading of the documents.
ITEM_BLOCK = 8192


@dataclass
class Space:
    """Weights of hashed words and their latent vectors, scaled so that passages have like spread in all dimensions."""

    idf: np.ndarray
    basis: np.ndarray

    def __post_init__(self):
        self.words = _table(self.idf[:, None] * self.basis)


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def features(text: str | None) -> np.ndarray:
    """Digests of the words of a text, ASCII letters in lower case."""
    return word_digests(_lower(text))


def _hashed(words: np.ndarray) -> np.ndarray:
    return (mixed(words) & np.uint64(FEATURES - 1)).astype(np.int64)


def _table(rows: np.ndarray) -> np.ndarray:
    """Rows per hashed word with a row of zeros behind them, which fills up a text's last block of words."""
    return np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)


def _taken(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the table rows that each row of numbers names."""
    sums = np.empty((len(at), table.shape[1]), dtype=np.float32)
    step = max(1, HELD // at.shape[1])
    for i in range(0, len(at), step):
        np.take(table, at[i : i + step], axis=0).sum(axis=1, out=sums[i : i + step])
    return sums


def _starts(words: int) -> int:
    """Passages of a text or part: PASSAGE words from every STRIDE-th word on, the last ones cut off."""
    # Passages that lie wholly inside the one before add nothing.
    return max(1, -(-words // STRIDE) - PASSAGE // STRIDE + 1)


def _sums(table: np.ndarray, at: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Sums of table rows over some passages; each block of STRIDE words is added up once."""
    steps = range(PASSAGE // STRIDE)
    blocks = -(-len(at) // STRIDE) + len(steps)
    filled = np.full(blocks * STRIDE, FEATURES)
    filled[: len(at)] = at
    needed = np.zeros(blocks, dtype=bool)
    for step in steps:
        needed[passages + step] = True
    parts = np.take(table, filled.reshape(blocks, STRIDE)[needed], axis=0).sum(axis=1)
    where = np.cumsum(needed) - 1
    return sum((parts[where[passages + step]] for step in steps[1:]), parts[where[passages]])


def _norms(idf: np.ndarray) -> np.ndarray:
    """A table whose sums are the squared lengths of passage vectors."""
    return _table((idf * idf)[:, None])


def _chunks(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that overlap by a passage, each with the number of its first passage."""
    for start in range(0, len(words), CHUNK):
        yield start // STRIDE, words[start : start + CHUNK + PASSAGE]


Fold = Callable[[pa.RecordBatch, np.ndarray], None]


def _partial_sums(rows: DataFrame, fold: Fold, shape: tuple[int, ...]) -> np.ndarray:
    """An array that fold(batch, array) adds to for all rows: one per task, added up in Spark piece by piece."""
    pieces, schema = 64, "piece bigint, values binary"

    def run(batches: Batches) -> Batches:
        total = np.zeros(shape)
        for batch in batches:
            fold(batch, total)
        if total.any():
            parts = [p.astype("<f4").tobytes() for p in np.array_split(total.reshape(-1), pieces)]
            yield pa.record_batch([pa.array(range(pieces)), pa.array(parts, pa.binary())], ["piece", "values"])

    def add(batches: Batches) -> Batches:
        key, total = None, np.zeros(0)

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key]), pa.array([total.tobytes()], pa.binary())], ["piece", "values"])

        for batch in batches:
            for piece, values in zip(batch["piece"].to_pylist(), batch["values"]):
                part = np.frombuffer(values.as_py(), "<f4").astype(np.float64)
                if piece == key:
                    total += part
                    continue
                if key is not None:
                    yield done()
                key, total = piece, part
        if key is not None:
            yield done()

    found = map_rows(rows, run, schema).repartition("piece").sortWithinPartitions("piece")
    parts = {row["piece"]: np.frombuffer(row["values"]) for row in map_rows(found, add, schema).collect()}
    return np.concatenate([parts[i] for i in range(pieces)]).reshape(shape) if parts else np.zeros(shape)


def _passages(n: int) -> int:
    """Passages of a text of n words."""
    return _starts(n) if n else 0


def hashed_texts(texts: DataFrame, seed: int = 7) -> DataFrame:
    """Rows (id, owner, passages, own, words) of all texts, a row per CHUNK words, stored: passes over them read no text again.

    id is one number per row of texts, owner a digest of the text, passages the number of passages that begin in the part,
    words its hashed words as unsigned 16-bit numbers; those behind the first `own` are in the next part too.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for at, owner, text in zip(batch["id"].to_pylist(), batch["owner"].to_pylist(), batch["text"].to_pylist()):
                words = _hashed(features(text)).astype("<u2")
                passages = _passages(len(words))
                for first in range(0, passages, CHUNK // STRIDE):
                    part = words[first * STRIDE : first * STRIDE + CHUNK + PASSAGE - STRIDE]
                    starts = min(passages - first, CHUNK // STRIDE)
                    own = CHUNK if first + starts < passages else len(part)
                    rows.append((at, owner, starts, own, part.tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["id", "owner", "passages", "own", "words"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    named = texts.where(F.length("text") > 0).select("text", F.monotonically_increasing_id().alias("id"), F.xxhash64("text", F.lit(seed)).alias("owner"))
    return stored(map_rows(named, run, "id bigint, owner bigint, passages bigint, own bigint, words binary"))


def distinct_texts(hashed: DataFrame) -> DataFrame:
    """The rows of hashed_texts of one text of each digest; only the numbers of those that go are moved, as a rule."""
    owners = hashed.groupBy("owner").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    gone = stored(hashed.select("owner", "id").join(owners, "owner").where("id > first").select("id").distinct())
    return hashed.join(gone, "id", "left_anti")


@dataclass
class Blocks:
    """Hashed words of some texts in blocks of STRIDE, and where each block stands; two places stay free behind each text."""

    words: np.ndarray
    place: np.ndarray
    #: Places at which passages begin.
    passages: np.ndarray

    @property
    def size(self) -> int:
        return int(self.place[-1]) + PASSAGE // STRIDE

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sums of table rows over the passage at each place, meant only for places in passages."""
        sums = np.zeros((self.size, table.shape[1]), dtype=np.float32)
        sums[self.place] = _taken(table, self.words.reshape(-1, STRIDE))
        return sum((sums[step : len(sums) - PASSAGE // STRIDE + 1 + step] for step in range(1, PASSAGE // STRIDE)), sums[: 1 - PASSAGE // STRIDE])


def _blocks(batch: pa.RecordBatch) -> Iterator[Blocks]:
    """Rows of hashed words, some FOLDED blocks at a time."""
    gap = PASSAGE // STRIDE - 1

    def laid(some: list[tuple[bytes, int]]) -> Blocks:
        sizes = np.array([len(words) // 2 for words, _ in some])
        blocks, starts = -(-sizes // STRIDE), np.array([n for _, n in some])
        first = np.cumsum(blocks) - blocks
        at = np.full(blocks.sum() * STRIDE, FEATURES, dtype=np.uint16)
        inside = np.arange(sizes.sum()) + np.repeat(first * STRIDE - (np.cumsum(sizes) - sizes), sizes)
        at[inside] = np.frombuffer(b"".join(words for words, _ in some), "<u2")
        text = np.repeat(np.arange(len(some)), blocks)
        place = np.arange(len(text)) + gap * text
        return Blocks(at, place, place[np.arange(len(text)) - first[text] < starts[text]])

    some, blocks = [], 0
    for words, passages in zip(batch["words"].to_pylist(), batch["passages"].to_pylist()):
        some.append((words, passages))
        blocks += -(-len(words) // (2 * STRIDE))
        if blocks >= FOLDED:
            yield laid(some)
            some, blocks = [], 0
    if some:
        yield laid(some)


def _added(rows: np.ndarray, picks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the picked rows over groups of the given sizes, one group after the other, ADDED rows at a time."""
    while True:
        parts = -(-sizes // ADDED)
        padded = np.full(parts.sum() * ADDED, len(rows))
        shift = (np.cumsum(parts) - parts) * ADDED - (np.cumsum(sizes) - sizes)
        padded[np.arange(len(picks)) + np.repeat(shift, sizes)] = picks
        rows = np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
        rows = _taken(rows, padded.reshape(-1, ADDED))
        if not len(parts) or parts.max() == 1:
            return rows
        sizes, picks = parts, np.arange(len(rows))


def _document_frequency(batch: pa.RecordBatch, total: np.ndarray) -> None:
    """Passages (here without overlap) that hold each hashed word; the last numbers count these and all passages."""
    for value, own, n in zip(*(batch[name].to_pylist() for name in ("words", "own", "passages"))):
        words = np.frombuffer(value, "<u2")[:own]
        places = np.arange(len(words)) // PASSAGE * FEATURES + words
        places.sort()
        first = np.ones(len(places), dtype=bool)
        first[1:] = places[1:] != places[:-1]
        total[:FEATURES] += np.bincount(places[first] % FEATURES, minlength=FEATURES)
        total[FEATURES] += -(-len(words) // PASSAGE)
        total[FEATURES + 1] += n


def sample_passages(docs: DataFrame, most: int, passages: float, seed: int = 7) -> DataFrame:
    """Rows (owner, place, words): `most` passages of the distinct texts of docs, or all if there are no more, stored.

    owner is a digest of the text, place the passage's number in it, words the passage's hashed words as unsigned 16-bit numbers.
    Every text gives each step-th of its passages, from a place that its digest decides, so a passage is as likely to be taken
    in a long text as in a short one, copies of a text give the same rows, and most texts are passed over without being
    read for words. `passages` is the number of all passages, copies included; where copies make the
    sample too small, it is taken again with a smaller step. Of more than `most` passages those with the least digests stay.
    """
    spread = 1.25
    text = F.col("text").cast("string")
    texts = docs.where(F.length(text) > 0).select(text.alias("text"), F.xxhash64(text, F.lit(seed)).alias("owner"))
    # Words take two bytes or more with the space behind them.
    bound = F.ceil(F.octet_length("text") / F.lit(2 * STRIDE)) + F.lit(1)

    def taken(step: int) -> DataFrame:
        def run(batches: Batches) -> Batches:
            for batch in batches:
                for value, owner in zip(batch["text"].to_pylist(), batch["owner"].to_pylist()):
                    # Words are counted in the whole text, digests are taken in the chosen passages alone.
                    data = _lower(value)
                    starts, ends = word_bounds(data)
                    places = range(owner % step, _passages(len(starts)), step)
                    for some in (places[i : i + 10_000] for i in range(0, len(places), 10_000)):
                        bounds = ((p * STRIDE, min(p * STRIDE + PASSAGE, len(starts)) - 1) for p in some)
                        passages = (data[starts[first] : ends[last]] for first, last in bounds)
                        words = [_hashed(word_digests(passage)).astype("<u2").tobytes() for passage in passages]
                        columns = [pa.array([owner] * len(some)), pa.array(list(some)), pa.array(words, pa.binary())]
                        yield pa.record_batch(columns, ["owner", "place", "words"])

        rows = texts.where(F.pmod("owner", F.lit(step)) < bound)
        return map_rows(rows, run, "owner bigint, place bigint, words binary").dropDuplicates(["owner", "place"])

    step = max(1, int(passages / (spread * max(1, most))))
    while True:
        found = stored(taken(step))
        n = found.count()
        if n >= most or step == 1:
            break
        step = max(1, min(step - 1, int(step * max(n, most / 64) / (spread * most))))
    if n > most:
        # A bounded table: at most `most` rows of a hundred bytes.
        found = found.orderBy(F.xxhash64("owner", "place"), "owner", "place").limit(most)
    return stored(found.repartition(SAMPLE_FILES))


def fit_space(docs: DataFrame, fit_passages: int | None = None, seed: int = 7) -> Space:
    """Word weights from all passages, and a latent space from all passages of the distinct texts.

    Randomised decomposition: a random test matrix is multiplied by the passage matrix and its transpose in the tasks; the
    orthonormal basis of the result spans the leading directions, and the passages' second moments in that basis give
    the singular values. Both sums have a fixed size whatever the number of passages. Copies of a text count once in the space,
    each in the weights. Where fit_passages is given, the space is of a sample of so many passages.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    hashed = hashed_texts(texts, seed)
    counts = _partial_sums(hashed.select("words", "own", "passages"), _document_frequency, (FEATURES + 2,))
    total, passages = counts[FEATURES:]
    # Words of every passage keep a little weight, so that a table of one short text is searched too.
    idf = np.maximum(np.log((1.0 + total) / (1.0 + counts[:FEATURES])), LEAST_IDF)
    if fit_passages is None:
        fitted = distinct_texts(hashed).select("words", "passages")
    else:
        fitted = sample_passages(texts, fit_passages, passages, seed).select("words", F.lit(1).cast("bigint").alias("passages"))
    test = _table(idf[:, None] * np.random.default_rng(seed).standard_normal((FEATURES, RANK + EXTRA)))
    squares = _norms(idf)

    def sketch(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for blocks in _blocks(batch):
            at, sums = blocks.passages, blocks.sums(test)
            folded = np.zeros_like(sums)
            folded[at] = sums[at] / np.maximum(blocks.sums(squares)[at], 1e-12)
            # Each block of words gathers the passages that it is part of.
            gathered = folded.copy()
            for step in range(1, PASSAGE // STRIDE):
                gathered[step:] += folded[:-step]
            order = np.argsort(blocks.words, kind="stable")
            sizes = np.bincount(blocks.words, minlength=FEATURES)[:FEATURES]
            seen = np.flatnonzero(sizes)
            picks = order[: sizes.sum()] // STRIDE
            total[seen] += _added(gathered[blocks.place], picks, sizes[seen]) * idf[seen, None]

    sketched = _partial_sums(fitted, sketch, (FEATURES, RANK + EXTRA))
    basis = np.linalg.qr(sketched)[0]
    folding = _table(idf[:, None] * basis)

    def moments(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for blocks in _blocks(batch):
            at = blocks.passages
            lengths = np.maximum(blocks.sums(squares)[at], 1e-12)
            rows = (blocks.sums(folding)[at] / np.sqrt(lengths)).astype(np.float64)
            total += rows.T @ rows

    second = _partial_sums(fitted, moments, (RANK + EXTRA, RANK + EXTRA))
    values, turn = np.linalg.eigh(second)
    values, turn = values[::-1][:RANK], turn[:, ::-1][:, :RANK]
    kept = values > 1e-9 * max(values[0], 1e-300)
    latent = basis @ (turn[:, kept] / np.sqrt(values[kept])) if kept.any() else np.zeros((FEATURES, 0))
    unseen = (counts[:FEATURES] > 0) & ~sketched.any(axis=1)
    if not unseen.any():
        return Space(idf, latent if latent.shape[1] else basis[:, :1])
    # Words of the table that a sample lacks get directions of their own, as long as the sample's passages are on average.
    own = np.zeros((FEATURES, RANK))
    own[unseen] = np.random.default_rng(seed + 1).standard_normal((int(unseen.sum()), RANK)) / np.sqrt(RANK)
    scale = np.sqrt(kept.sum() / np.trace(second)) if kept.any() else 1.0
    return Space(idf, np.hstack([latent, own * scale]))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, all places of the item side by side in the bits of one number."""
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    every = (1 << len(item)) - 1
    row = every
    for word in words.tolist():
        if match := places.get(word):
            taken = row & match
            row = ((row + taken) | (row - taken)) & every
    return len(item) - row.bit_count()


def _holds(words: np.ndarray, part: np.ndarray) -> bool:
    if len(part) > len(words):
        return False
    at = np.flatnonzero(words[: len(words) - len(part) + 1] == part[0])
    return any(np.array_equal(words[i : i + len(part)], part) for i in at.tolist())


@dataclass(frozen=True)
class Limits:
    """What counts as a leak: a common subsequence of `whole` of the item's words, or of `most` if its answer is there too."""

    cosine: float = 0.2
    whole: float = 0.8
    most: float = 0.65
    #: Words of the answer: the item's last sentence, made up to at least so many words from before it.
    answer: int = 6


def _answer_words(text: str, least: int) -> int:
    cut = max(text.rstrip().rstrip(".!?").rfind(mark) for mark in (". ", "! ", "? ", "\n"))
    return max(least, len(text[cut + 1 :].split()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), space: Space | None = None) -> DataFrame:
    """Rows (doc_id, item_id, cosine, overlap, answer): benchmark items found in documents, once per row of docs and item.

    cosine is the largest one of the document's passages, overlap the longest common subsequence as a share of the item's
    words, answer whether the item's closing words occur. All passages of every text are searched, against all items in
    blocks of ITEM_BLOCK that the tasks hold; those around which no item has enough of its rare words, and which so cannot hold
    a leak, are known without a cosine. Words are compared with ASCII letters in lower case.

    Null or empty texts and items: never a leak. Items with a null item_id are searched for and reported with null. Null
    doc_ids are reported with null. Repeated rows and items give repeated results. Empty tables: no rows. Other columns are not
    read.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, cosine double, overlap double, answer boolean"
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.length(F.trim("text")) > 0)
    block: list = []
    found: DataFrame | None = None
    if space is None and not items.isEmpty():
        space = fit_space(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def searched(block: list) -> DataFrame:
        return map_rows(rows, _search(block, space, limits), schema)

    # The iterator holds one partition of items at a time; a block of them goes with each reading of the documents.
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == ITEM_BLOCK:
            found, block = searched(block) if found is None else found.unionByName(searched(block)), []
    if block:
        found = searched(block) if found is None else found.unionByName(searched(block))
    return spark.createDataFrame([], schema) if found is None else found


class Rare:
    """The rarest words of each item, of which a leak must hold some.

    A common subsequence of m of an item's n words misses n - m of them, so of any n - m + t words it holds t.
    """

    def __init__(self, words: list[np.ndarray], idf: np.ndarray, least: float, some: int = 3):
        self.need = np.zeros(len(words), dtype=np.int64)
        digests, items = [], []
        for item, own in enumerate(words):
            most = math.ceil(least * len(own))
            self.need[item] = min(some, most)
            rarest = np.argsort(-idf[_hashed(own)], kind="stable")[: len(own) - most + self.need[item]]
            digests.append(np.unique(own[rarest]))
            items.append(np.full(len(digests[-1]), item))
        every = np.concatenate(digests)
        order = np.argsort(every, kind="stable")
        self.items = np.concatenate(items)[order]
        self.vocabulary, self.first = np.unique(every[order], return_index=True)
        self.sizes = np.diff(np.append(self.first, len(every)))
        # Most other words are told by the first bits of their digests.
        self.heads = np.zeros(1 << 16, dtype=bool)
        self.heads[self.vocabulary >> np.uint64(48)] = True

    def hits(self, doc: np.ndarray) -> np.ndarray:
        """Where words of items stand in a text, as item * (words + 1) + place, in order."""
        places = np.flatnonzero(self.heads[doc >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.vocabulary, doc[places]), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == doc[places]
        places, at = places[known], at[known]
        sizes = self.sizes[at]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.sort(self.items[np.repeat(self.first[at], sizes) + inside] * (len(doc) + 1) + np.repeat(places, sizes))

    def near(self, hits: np.ndarray, n: int, reach: np.ndarray) -> np.ndarray:
        """Whether the words around each passage of a text of n words may hold a leak of any item, reach words further on both sides."""
        items, places = np.divmod(hits, n + 1)
        last = np.arange(len(hits)) + self.need[items] - 1
        inside = last < len(hits)
        inside[inside] = items[last[inside]] == items[inside]
        ends, starts, reach = places[last[inside]], places[inside], reach[items[inside]]
        low = np.maximum((ends - reach - PASSAGE) // STRIDE + 1, 0)
        high = np.minimum((starts + reach) // STRIDE, n // STRIDE)
        some = low <= high
        marks = np.bincount(low[some], minlength=n // STRIDE + 2) - np.bincount(high[some] + 1, minlength=n // STRIDE + 2)
        return np.cumsum(marks) > 0

    def enough(self, hits: np.ndarray, n: int, items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the words from start to end may hold a leak of an item."""
        base = items * (n + 1)
        low = np.searchsorted(hits, base + np.maximum(starts, 0))
        return np.searchsorted(hits, base + np.minimum(ends, n)) - low >= self.need[items]


def _search(block: list[tuple[int | None, str]], space: Space, limits: Limits):
    named = [(item_id, features(text), _answer_words(text, limits.answer)) for item_id, text in block]
    ids, words, tails = zip(*(item for item in named if len(item[1])))
    known = _unit(np.stack([space.words[_hashed(w)].sum(axis=0) for w in words])).T.copy()
    rare = Rare(list(words), space.idf, min(limits.whole, limits.most))
    sizes = np.array([len(w) for w in words])
    folding = space.words

    def judge(doc: np.ndarray, item: int, at: np.ndarray, cosines: np.ndarray) -> tuple | None:
        own, best, answered = words[item], 0.0, False
        # Passages next to each other are looked at as one.
        for group in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            span = doc[max(0, group[0] * STRIDE - len(own)) : group[-1] * STRIDE + PASSAGE + len(own)]
            overlap = common_subsequence(own, span) / len(own)
            answer = _holds(span, own[-tails[item] :])
            if overlap >= limits.whole or overlap >= limits.most and answer:
                best, answered = max(best, overlap), answered or answer
        return (ids[item], float(cosines.max()), best, answered) if best else None

    def candidates(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and cosines worth a comparison of words."""
        hits, near = rare.hits(doc), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        # The bound on rare words comes first, as it costs less: it leaves out no passage that it would not leave out below.
        marks = rare.near(hits, len(doc), sizes)
        for first, part in _chunks(doc):
            some = np.flatnonzero(marks[first : first + _starts(len(part))])
            if not len(some):
                continue
            cosine = _unit(_sums(folding, _hashed(part), some)) @ known
            passages, items = np.nonzero(cosine >= limits.cosine)
            cosine, passages = cosine[passages, items], some[passages]
            starts = (passages + first) * STRIDE
            kept = rare.enough(hits, len(doc), items, starts - sizes[items], starts + PASSAGE + sizes[items])
            near.append((passages[kept] + first, items[kept], cosine[kept]))
        return tuple(np.concatenate(c) for c in zip(*near))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                doc = features(text)
                if not len(doc):
                    continue
                passages, items, cosines = candidates(doc)
                for item in np.unique(items).tolist():
                    mine = items == item
                    if leak := judge(doc, item, np.unique(passages[mine]), cosines[mine]):
                        out.append((doc_id, *leak))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                names = ["doc_id", "item_id", "cosine", "overlap", "answer"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run
