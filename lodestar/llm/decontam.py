"""Benchmark decontamination by greedy string tiling.

A running Karp-Rabin hash over TILE words joins every document with the benchmark items that share a seed. For
each document and item the longest match that is not marked yet is marked as a tile, again and again, until no
match of TILE words is left; tiles do not overlap in either text, and their order is free, so passages that were
cut up and reordered are found. The share of an item's words that tiles cover decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, map_arrow, raw, row_chunks, source_columns
from lodestar.llm.neardup import mixed, word_hashes

#: Words of the shortest tile, and of the seeds.
TILE = 4
#: Share of an item's words that tiles must cover, and covered words that are needed at least (all of a shorter item).
COVERAGE = 0.6
LEAST_WORDS = 8
#: Text of benchmark items that one index holds; a larger benchmark is searched for in several blocks, one after the other.
BLOCK_BYTES = 16 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FILTER_BITS = 22
#: Seeds of a text whose postings are looked at in one step.
_SLICE = 4096


def plain_table() -> np.ndarray:
    """Bytes as they are compared: ASCII letters in lower case, other ASCII but digits as space."""
    of = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalnum():
            of[b] = 32
    of[65:91] += 32
    return of


PLAIN = plain_table()


def plain_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(PLAIN[data], at)


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the TILE words from each position on (they may run over the end of a row)."""
    n = max(0, len(words) - TILE + 1)
    value = np.zeros(n, np.uint64)
    for t in range(TILE):
        value = value * _BASE + words[t : t + n]
    return mixed(value)


class Items:
    """Index of benchmark items by seed, in flat arrays of about 6 times the bytes of their texts."""

    def __init__(self, ids: list[int], texts: list[str], coverage: float):
        data, at = raw(pa.array(texts, pa.large_string()))
        parts = [plain_words(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in row_chunks(at)]
        self.ids = ids
        self.words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(np.diff(x) for _, x in parts)])
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.need = np.maximum(coverage * n, np.minimum(n, LEAST_WORDS))
        item = np.repeat(np.arange(len(n)), n)
        seeds = seed_hashes(self.words)
        inside = np.arange(len(seeds)) + TILE <= self.at[1:][item[: len(seeds)]]
        self.keys, seed = np.unique(seeds[inside], return_inverse=True)
        self.seed_at = np.full(len(self.words), -1, np.int32)  # number of the seed that begins at each word
        self.seed_at[np.flatnonzero(inside)] = seed
        # postings: the items of each seed, and at how many places they have it
        pair, self.times = np.unique(seed.astype(np.int64) * max(1, len(n)) + item[: len(seeds)][inside], return_counts=True)
        self.item = (pair % max(1, len(n))).astype(np.int32)
        self.offsets = np.searchsorted(pair // max(1, len(n)), np.arange(len(self.keys) + 1))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the seeds that some item has, and their numbers."""
        maybe = np.flatnonzero(self.filter[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, seeds[maybe]), len(self.keys) - 1)
        real = self.keys[at] == seeds[maybe]
        return maybe[real], at[real]

    def find(self, words: np.ndarray, at: np.ndarray, seed: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, covered words, words) of the items that a text covers enough; at are its places with a seed."""
        most = np.zeros(len(self.ids), np.int64)  # places of each item with a seed of the text
        seen = np.unique(seed)
        sizes = self.offsets[seen + 1] - self.offsets[seen]
        for k in range(0, len(seen), _SLICE):
            own, n = seen[k : k + _SLICE], sizes[k : k + _SLICE]
            posting = np.repeat(self.offsets[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            most += np.bincount(self.item[posting], self.times[posting], len(most)).astype(np.int64)
        out = []
        for k in np.flatnonzero((most > 0) & (most * TILE >= self.need)).tolist():
            a, b = self.at[k], self.at[k + 1]
            own = self.seed_at[a:b]
            c = covered(words, at[np.isin(seed, own)], self.words[a:b], np.flatnonzero(np.isin(own, seen)))
            if c >= self.need[k]:
                out.append((k, c, int(b - a)))
        return out


class Side:
    """The words of a text that lie in seeds, in runs, with running hashes and marks."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        inside = np.zeros(len(words), bool)
        for t in range(TILE):
            inside[at + t] = True
        where = np.flatnonzero(inside)
        self.words = words[where]
        self.begins = np.concatenate([[True], np.diff(where) != 1])[: len(where)]
        self.free = np.ones(len(where), bool)
        power = np.full(len(where) + 1, _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.undo = np.full(len(where) + 1, _UNDO)
        self.undo[0] = 1
        self.undo = np.multiply.accumulate(self.undo)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * power[:-1])])

    def room(self) -> np.ndarray:
        """How many words from each place on are unmarked and follow each other in the text."""
        n = len(self.words)
        stop = np.where(self.begins | ~self.free, np.arange(n), n)
        after = np.append(np.minimum.accumulate(stop[::-1])[::-1][1:], n)
        return np.where(self.free, after - np.arange(n), 0)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Karp-Rabin hash of the words of one length from each place on."""
        return mixed((self.sums[at + length] - self.sums[at]) * self.undo[at])


def covered(text: np.ndarray, text_at: np.ndarray, item: np.ndarray, item_at: np.ndarray) -> int:
    """Words of an item that greedy tiles cover, given the places of seeds that both have.

    The largest length of which both have unmarked words in common is found by bisection over running hashes. All
    matches of that length are marked from left to right, if their words are equal and still unmarked in both; then
    the next length is searched for. Memory is linear in the seeds of the two texts, however often they repeat.
    """
    left, right = Side(text, text_at), Side(item, item_at)
    limit, total = len(item), 0
    while True:
        room, own = left.room(), right.room()
        limit = min(limit, int(room.max(initial=0)), int(own.max(initial=0)))
        low, high = TILE - 1, limit
        while low < high:
            length = (low + high + 1) // 2
            common = np.isin(right.hashes(np.flatnonzero(own >= length), length), left.hashes(np.flatnonzero(room >= length), length)).any()
            low, high = (length, high) if common else (low, length - 1)
        if low < TILE:
            return total
        total += mark(left, np.flatnonzero(room >= low), right, np.flatnonzero(own >= low), low)
        limit = low - 1


def mark(left: Side, at: np.ndarray, right: Side, to: np.ndarray, length: int) -> int:
    """Mark all matches of one length from left to right; the words that were marked on the right side."""
    hashes = right.hashes(to, length)
    order = np.argsort(hashes, kind="stable")
    hashes, to = hashes[order], to[order]
    wanted = left.hashes(at, length)
    first, last = np.searchsorted(hashes, wanted), np.searchsorted(hashes, wanted, "right")
    some = first < last
    next_of: dict[int, int] = {}  # first place of a hash that may be free; a place once marked stays so
    total = 0
    for d, low, high in zip(at[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
        k = next_of.get(low, low)
        if k == high or not left.free[d : d + length].all():
            continue
        while k < high and not right.free[to[k] : to[k] + length].all():
            k += 1
        next_of[low] = k
        if k < high and np.array_equal(left.words[d : d + length], right.words[to[k] : to[k] + length]):
            left.free[d : d + length] = False
            right.free[to[k] : to[k] + length] = False
            total += length
    return total


FOUND = ["n_items", "best_item", "coverage"]


def search(docs: DataFrame, items: Items, folded: str, last: bool) -> DataFrame:
    """Add what one block of items finds to the columns n_items, best_item and coverage of docs.

    The column folded holds the lower-case text; it is dropped after the last block, and other columns pass.
    """
    index = docs.sparkSession.sparkContext.broadcast(items)
    passed = [c for c in docs.columns if c not in [*FOUND, *[folded] * last]]

    def run(batches):
        items = index.value
        for batch in batches:
            data, at = raw(batch.column(folded))
            n_items, best, share = (batch.column(c).to_pylist() for c in FOUND)
            for a, b in row_chunks(at):
                words, words_at = plain_words(data[at[a] : at[b]], at[a : b + 1] - at[a])
                place, seed = items.hits(seed_hashes(words))
                rows = np.searchsorted(words_at, place, "right") - 1
                inside = place + TILE <= words_at[rows + 1]
                place, seed, rows = place[inside], seed[inside], rows[inside]
                ends = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)[: len(rows)]) + 1
                for low, high in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                    row = int(rows[low])
                    for k, c, n in items.find(words[words_at[row] : words_at[row + 1]], place[low:high] - words_at[row], seed[low:high]):
                        n_items[a + row] += 1
                        if (-c / n, items.ids[k]) < (-share[a + row], best[a + row] if best[a + row] is not None else items.ids[k] + 1):
                            best[a + row], share[a + row] = items.ids[k], c / n
            found_columns = [pa.array(n_items, pa.int64()), pa.array(best, pa.int64()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *found_columns], names=[*passed, *FOUND])

    return map_arrow(docs, run, docs.select(*(F.col(f"`{c}`") for c in [*passed, *FOUND])).schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, keep_text: bool = True
) -> DataFrame:
    """docs with n_items, best_item, coverage and contaminated added, from every whole text.

    n_items counts the items that reach the coverage; best_item is the one with the largest coverage (the
    smallest id of equals; null if none) and coverage is its share, else 0. The benchmark is a stated query set:
    its text is measured first, and one index holds block_bytes of it at most; a larger one is searched for block
    by block in a chain of narrow steps. Null texts are empty; items that are null or have fewer than TILE words
    match nothing (an item of fewer words than LEAST_WORDS must be covered whole); repeated rows and null ids stay,
    and extra columns pass unless they have the names of the result, which are replaced. No shuffle of documents.
    """
    items = source_columns(benchmark, item_id=item_col, text=item_text_col).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.select("item_id", F.lower("text").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    folded = fresh("folded", docs.columns)
    out = docs.withColumns({"n_items": F.lit(0).cast("long"), "best_item": F.lit(None).cast("long"), "coverage": F.lit(0.0), folded: F.lower(F.col(f"`{text_col}`"))})
    if not keep_text:
        out = out.drop(text_col)
    for k in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())
        out = search(out, Items([r.item_id for r in rows], [r.text for r in rows], coverage), folded, k + 1 == blocks)
    return out.withColumn("contaminated", F.col("n_items") > 0)
