"""Language of texts by cross-parsing: how few phrases of a language's sample text does a text fall into?

A suffix automaton of the labelled sample of each language knows every substring of it. A text is parsed from left
to right into the longest phrases that occur in the sample; a text in the sample's language needs few, long phrases.
The number of phrases times their price, per character, estimates the cross entropy, and the language with the least
estimate wins. The price is one for all languages, the logarithm of the longest sample's length, so that a short sample
is no cheaper than a long one.

Every letter of every script counts: the most frequent letters of the samples are symbols of their own, any other is
written as a lead symbol and the digits of its code point, so the table stays narrow and no letters are merged.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsight.llm.common import Batches, map_rows, stored

#: Letters with a symbol of their own; symbol 0 stands for blanks and marks, and digits of base DIGITS write other letters.
LETTERS, DIGITS = 28, 32
BLANK = 0
#: Leads of letters with two, three and four digits come after the digits.
_FIRST_DIGIT = LETTERS + 1
_FIRST_LEAD = _FIRST_DIGIT + DIGITS
WIDTH = _FIRST_LEAD + 3
#: A phrase never crosses a border between blocks of so many characters, so that blocks are parsed side by side.
BLOCK = 512


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case form, 0 if it is no letter."""
    folded = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            folded[point] = ord(lower) if len(lower) == 1 else point
    return folded


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _folded(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points; 0 for each run of anything else, and at both ends."""
    letters = np.concatenate((np.zeros(1, np.uint32), _lower_letters()[_points(text)], np.zeros(1, np.uint32)))
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    return letters[keep]


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence: a row per state, -1 where there is none."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and symbol not in following[state]:
            following[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = following[state][symbol]
            if length[state] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                link.append(link[target])
                length.append(length[state] + 1)
                while state >= 0 and following[state].get(symbol) == target:
                    following[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    table = np.full((len(following), width), -1, dtype=np.int32)
    for state, moves in enumerate(following):
        for symbol, target in moves.items():
            table[state, symbol] = target
    return table


def encode(letters: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Symbols of folded letters; own holds the symbol of letters that have one, 0 for others."""
    single = own[letters]
    sizes = np.where((letters == 0) | (single > 0), 1, 3 + (letters >= DIGITS**2) + (letters >= DIGITS**3))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    out[ends - sizes] = np.where(sizes == 1, single, _FIRST_LEAD + sizes - 3)
    for place in range(4):
        at = np.flatnonzero(sizes >= max(3, place + 2))
        out[ends[at] - 1 - place] = _FIRST_DIGIT + letters[at] // DIGITS**place % DIGITS
    return out


class Model:
    """Automata of all languages in one table, ready to parse many blocks at once.

    Samples without a letter teach nothing and are left out.
    """

    def __init__(self, samples: dict[str, str]):
        texts = {name: _folded(samples[name]) for name in sorted(samples)}
        texts = {name: text for name, text in texts.items() if text.any()}
        if not texts:
            raise ValueError("no labelled text")
        self.languages, self.width = list(texts), WIDTH
        points, counts = np.unique(np.concatenate(list(texts.values())), return_counts=True)
        known = [p for p in points[np.argsort(-counts, kind="stable")].tolist() if p][:LETTERS]
        self.own = np.zeros(0x110000, dtype=np.int32)
        self.own[known] = np.arange(1, len(known) + 1)
        tables, self.roots, longest = [], [], 2
        at = 0
        for name in self.languages:
            symbols = encode(texts[name], self.own).tolist()
            table = suffix_automaton(symbols, self.width)
            # Where a phrase ends, the next one starts with the same character: its state, or the root if the sample lacks it.
            start = np.where(table[0] >= 0, table[0], 0)
            ends = table < 0
            moves = np.where(ends, start[None, :], table).astype(np.int64) + at
            # A cell holds the next row's offset, doubled, plus one if a phrase ends.
            tables.append((moves * self.width * 2 + ends).ravel())
            self.roots.append(at * self.width)
            longest = max(longest, len(symbols))
            at += len(table)
        self.price = np.log2(longest)
        self.table = np.concatenate(tables)
        if len(self.table) * 2 < 1 << 31:
            self.table = self.table.astype(np.int32)

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Phrases of each block of symbols in each language: an array of (languages, blocks)."""
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        sizes = np.array([len(blocks[i]) for i in order])
        longest = int(sizes[0]) if len(sizes) else 0
        grid = np.zeros((longest, len(blocks)), dtype=self.table.dtype)
        for lane, i in enumerate(order):
            grid[: len(blocks[i]), lane] = blocks[i]
        state = np.repeat(np.array(self.roots, dtype=self.table.dtype)[:, None], len(blocks), axis=1)
        count = np.ones(state.shape, dtype=np.int32)
        # The lanes still running at each step are the first ones, as lanes are sorted by length.
        running = np.searchsorted(-sizes, -np.arange(longest), side="left")
        for step in range(longest):
            n = running[step]
            cell = self.table[state[:, :n] + grid[step, :n]]
            count[:, :n] += cell & 1
            state[:, :n] = cell >> 1
        found = np.empty_like(count)
        found[:, order] = count
        return found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: und and 0 for null or no letter, else 1 less the ratio of the two least estimates."""
        blocks, owner, out = [], [], [("und", 0.0)] * len(texts)
        sizes = np.zeros(len(texts))
        for i, text in enumerate(texts):
            folded = _folded(text or "")
            if not folded.any():
                continue
            symbols = encode(folded, self.own)
            sizes[i] = len(folded)
            for start in range(0, len(symbols), BLOCK):
                blocks.append(symbols[start : start + BLOCK])
                owner.append(i)
        if not blocks:
            return out
        total = np.zeros((len(self.languages), len(texts)))
        np.add.at(total, (slice(None), np.array(owner)), self.phrases(blocks))
        bits = total * self.price / np.maximum(sizes, 1)
        for i in np.flatnonzero(sizes).tolist():
            ranked = np.argsort(bits[:, i], kind="stable")
            best = ranked[0]
            score = 1.0 - bits[best, i] / bits[ranked[1], i] if len(ranked) > 1 else 1.0
            out[i] = (self.languages[best], float(score))
        return out


def is_held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: CRC-32 of doc_id as text leaves 2 on division by 4 (null: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def labelled_samples(
    docs: DataFrame, total_chars: int = 80_000, most_chars: int = 2_000, least_chars: int = 500, first_rows: int = 80,
) -> dict[str, str]:
    """Sample text per language: an equal share of total_chars (least_chars at least), at most most_chars of a text.

    Distinct texts with a letter are taken in the order of a digest until their characters fill the share, so copies of a text
    count once, and the sample is spread over the table and the same on every run. first_rows texts per language are looked at
    first, eight times as many in each further round in which a language is not full yet. Rows that are held out or have no
    language, text or letter are not used; with no other rows there is no sample. Repeated rows change nothing; other
    columns are not read. The sample is the only thing that is bounded; it fits the model, which then reads every text whole.
    """
    learned = ~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").cast("string").rlike("\\p{L}")
    usable = docs.where(learned).select(F.col("lang").alias("_lang"), F.xxhash64("text").alias("_digest"), F.col("text").alias("_text"))
    distinct = stored(usable.select("_lang", "_digest").distinct())
    languages = {r["_lang"]: r["count"] for r in distinct.groupBy("_lang").count().collect()}
    if not languages:
        return {}
    chars = max(total_chars // len(languages), least_chars)
    rows, order = first_rows, Window.partitionBy("_lang").orderBy("_digest")
    while True:
        # A few digests per language, so Spark hands them to every task.
        chosen = stored(distinct.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= rows))
        found = usable.join(chosen, ["_lang", "_digest"]).groupBy("_lang", "_place").agg(F.min(F.substring("_text", 1, most_chars)).alias("_start"))
        before = Window.partitionBy("_lang").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        needed = found.withColumn("_before", F.coalesce(F.sum(F.length("_start")).over(before), F.lit(0))).where(F.col("_before") < chars)
        samples: dict[str, list[str]] = {}
        for row in needed.select("_lang", "_place", "_start").orderBy("_lang", "_place").collect():
            samples.setdefault(row["_lang"], []).append(row["_start"])
        short = [name for name, n in languages.items() if n > rows and sum(map(len, samples.get(name, []))) < chars]
        if not short:
            return {name: "\n".join(parts)[:chars] for name, parts in samples.items()}
        rows *= 8


def identify(docs: DataFrame, samples: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all of them by default) with lang_pred and score, which come from text alone.

    lang_pred is a language of the samples, or und if the text is null or has no letter; score (0 to 1) tells how far the
    second language is behind. Ties go to the first language by name. Columns of docs named lang_pred or score are
    replaced. Empty table: no rows. Whole texts are parsed, in blocks of BLOCK characters. Without samples every text is und.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    pairs = tuple(sorted(samples.items()))

    def predict(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = _model(pairs).predict(texts) if pairs else [("und", 0.0)] * len(texts)
            languages, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.record_batch([*(batch[c] for c in kept), languages, scores], [*kept, "lang_pred", "score"])

    read = docs.select(*dict.fromkeys([*kept, "text"]))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return map_rows(read, predict, schema)


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(samples))

