"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of words. Every k-mer of K words is labelled with its occurrence number; under each of
SKETCHES hash orders the ELL smallest labelled k-mers are taken and hashed in their text order (Order MinHash), so
that two texts agree in a sketch more often the smaller their edit distance is. Texts that agree in a sketch are
candidates. A candidate is verified by the edit distance of the words inside a band of the width that the
threshold allows, computed on bit vectors that slide along the diagonal.

Exact copies are one class from the start. In a bucket of a sketch every class is compared with the bucket's
pivot, the class of least hashed id. What is left are buckets whose classes are in more than one component then.
In such a bucket all classes of different components are compared, in blocks; the words that two texts have in common
bound their edit distance, so that few pairs are left to align. A bucket of more than MIDDLE classes comes of a passage
that very many texts share. Its classes go through an exact set-similarity join over their words instead, whose work
follows the words that are rare among them and not the square of the bucket. Nothing is capped or dropped: two classes
that agree in a sketch are aligned, unless they are in one component already or a bound proves that they cannot be
similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, raw, row_chunks, source_columns
from lodestar.operators.graph import connected_components
from lodestar.session import cut

K = 3
ELL = 2
SKETCHES = 48
#: Edit similarity, 1 - distance / words of the longer text, from which two texts are near-duplicates.
SIMILARITY = 0.8
#: Texts of fewer words have SHORT_SKETCHES more sketches, of ELL single words: few of their k-mers outlive an edit.
SHORT_WORDS, SHORT_SKETCHES = 32, 16
#: Classes up to which the pairs of an open bucket are joined as they are; larger ones are compared in blocks.
SMALL = 16
#: Classes from which an open bucket is not compared pair by pair any more, but joined by its rare words.
MIDDLE = 4096
#: Classes that a task compares with each other; larger buckets, and larger groups of one rare word, are dealt in blocks.
BLOCK = 1024
#: Ids up to which texts are picked by broadcasting them (8 bytes each), so that the other texts are not shuffled.
FEW_IDS = 1_000_000
#: Cells of the word counts that bound an edit distance from below, and the count from which a cell is full.
CELLS, FULL = 256, 15
#: Cells (as a power of two) in which the words of the classes of large buckets are counted, to rank them.
RANK_BITS = 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POSITION = 24
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in a row, and the offsets of each row's words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    rows = at[:-1][at[:-1] < len(data)]
    begins[rows] = ~space[rows]  # a row begins a word even if the row before ends in one
    starts = np.flatnonzero(begins)
    words_at = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), words_at
    inside = np.zeros(len(data), np.int64)
    inside[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    power = np.ones(int(inside.max()) + 1, np.uint64)
    np.multiply.accumulate(np.concatenate([power[:1], np.full(len(power) - 1, 0x100000001B3, np.uint64)]), out=power)
    value = (LOWER[data].astype(np.uint64) + np.uint64(1)) * power[inside]
    value[space] = 0
    return mixed(np.add.reduceat(value, starts)), words_at


def kmer_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of all rows and their offsets; a row of fewer than k words is one k-mer."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    out_at = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    last = np.repeat(at[1:], count)
    value = np.zeros(len(first), np.uint64)
    for t in range(k):
        pos = first + t
        w = words[np.minimum(pos, len(words) - 1)] if len(words) else value
        value = (value * _MIX + np.where(pos < last, w, np.uint64(0))) * np.uint64(0xC2B2AE3D27D4EB4F)
        value ^= value >> np.uint64(31)
    # label repeated k-mers of a row with their occurrence number
    row = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((value, row))
    same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
    if same.any():
        new = np.concatenate([[True], ~same])
        run = np.flatnonzero(new)
        label = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
        again = label > 0
        value[order[again]] = mixed(value[order[again]] + label[again].astype(np.uint64) * _MIX)
    return value, out_at


def order_sketches(data: np.ndarray, at: np.ndarray, k: int = K, ell: int = ELL, sketches: int = SKETCHES, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash [row, sketch] and the number of words of each row; rows without words have zeros.

    counts, if given, is filled with how many words of each row have a hash of each of CELLS residues, FULL at most.
    """
    out = np.zeros((len(at) - 1, sketches), np.uint64)
    n_words = np.zeros(len(at) - 1, np.int64)
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    top = np.uint64(2**64 - 1)
    low = np.uint64((1 << _POSITION) - 1)
    for a, b in row_chunks(at):
        words, words_at = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
        n_words[a:b] = np.diff(words_at)
        if counts is not None:
            cell = np.repeat(np.arange(b - a), n_words[a:b]) * CELLS + (words % np.uint64(CELLS)).astype(np.int64)
            counts[a:b] = np.minimum(np.bincount(cell, minlength=(b - a) * CELLS), FULL).reshape(-1, CELLS)
        value, value_at = kmer_hashes(words, words_at, k)
        full = np.flatnonzero(np.diff(value_at) > 0)
        if not len(full):
            continue
        starts, sizes = value_at[full], np.diff(value_at)[full]
        place = (np.arange(len(value)) - np.repeat(starts, sizes)).astype(np.uint64) & low
        for s, seed in enumerate(seeds):
            ranked = ((value * seed) & ~low) | place
            picked = np.empty((ell, len(full)), np.int64)
            for e in range(ell):
                least = np.minimum.reduceat(ranked, starts)
                where = np.where(least == top, 0, (least & low)).astype(np.int64)
                picked[e] = np.where(sizes > e, starts + where, -1)
                ranked[starts + where] = top
            picked.sort(axis=0)  # back in text order
            made = np.full(len(full), seed ^ _MIX)
            for e in range(ell):
                x = np.where(picked[e] >= 0, value[np.maximum(picked[e], 0)], np.uint64(7))
                made = mixed(made * np.uint64(0xC2B2AE3D27D4EB4F) + x)
            out[a + full, s] = made
    return out, n_words


def banded_distance(a: list[bytes], b: list[bytes], limit: int) -> int:
    """Edit distance of two word lists if it is at most limit, else limit + 1.

    Rows are the words of a. The vertical differences of one column stand in two bit vectors that cover only the
    rows within limit of the diagonal; what enters the band from above counts as one more edit.
    """
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    m, n = len(a), len(b)
    if abs(m - n) > limit:
        return limit + 1
    if not m or not n:
        return m + n
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    first, last = 1, min(m, limit)
    plus, minus, above = (1 << last) - 1, 0, 0
    for j in range(1, n + 1):
        lo, hi = max(1, j - limit), min(m, j + limit)
        if lo > first:
            above += (plus & 1) - (minus & 1)
            plus >>= 1
            minus >>= 1
            first = lo
        if hi > last:
            plus |= 1 << (hi - lo)
            last = hi
        mask = (1 << (hi - lo + 1)) - 1
        eq = places.get(b[j - 1], 0) >> (lo - 1) & mask
        diagonal = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus) & mask
        down = plus & across & mask
        up = (up << 1 | 1) & mask
        down = down << 1 & mask
        plus = (down | ~(diagonal | up)) & mask
        minus = up & diagonal
        above += 1
        if not j & 31 and above - minus.bit_count() > limit:
            return limit + 1
    return min(limit + 1, above + plus.bit_count() - minus.bit_count())


def similar(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity of the words (ASCII case folded) reaches the threshold."""
    x, y = a.lower().split(), b.lower().split()
    longer = max(len(x), len(y))
    if not longer:
        return False
    limit = int(longer * (1 - similarity) + 1e-9)
    return banded_distance(x, y, limit) <= limit


def with_class(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.sha2(F.col("text"), 256))


def packed(counts: np.ndarray) -> pa.Array:
    """Word counts [row, cell] as a binary column, two cells a byte."""
    return pa.array([c.tobytes() for c in counts[:, ::2] | counts[:, 1::2] << np.uint8(4)], pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Word counts [row, cell] of a binary column."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS // 2)
    return np.stack([both & np.uint8(15), both >> np.uint8(4)], axis=2).reshape(-1, CELLS)


def classes_of(docs: DataFrame, k: int, ell: int, sketches: int) -> DataFrame:
    """One row per different non-null text: id (smallest doc_id), digest, n_copies, n_words, sketch, counts."""

    def run(batches):
        for batch in batches:
            counts = np.zeros((batch.num_rows, CELLS), np.uint8)
            data, at = raw(batch.column(2))
            made, n_words = order_sketches(data, at, k, ell, sketches, counts)
            rows = list(made.view(np.int64))
            short = np.flatnonzero((n_words < SHORT_WORDS) & (n_words > 0))
            if len(short):
                texts = pa.array([data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in short], pa.large_string())
                for r, more in zip(short.tolist(), order_sketches(*raw(texts), 1, ell, SHORT_SKETCHES)[0].view(np.int64), strict=True):
                    rows[r] = np.concatenate([rows[r], more])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), lists, packed(counts)], names=["doc_id", "digest", "n_words", "sketch", "counts"])

    rows = map_arrow(with_class(docs).select("doc_id", "digest", "text"), run, "doc_id long, digest string, n_words long, sketch array<long>, counts binary")
    return rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"), F.first("counts").alias("counts"))


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of class ids whose texts are similar; texts has one row per id."""

    def run(batches):
        for batch in batches:
            first, second = (c.cast(pa.large_binary()) for c in (batch.column(2), batch.column(3)))
            ok = [similar(x.as_py(), y.as_py(), similarity) for x, y in zip(first, second, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return map_arrow(both.select("a", "b", "text_a", "text_b"), run, "a long, b long, ok boolean")


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text for each id in pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    ids = cut(ids)
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    found = docs.where("text IS NOT NULL").join(ids, "doc_id", "left_semi")
    return found.groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text"))


def may_be_similar(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, similarity: float) -> np.ndarray:
    """False only where texts with word counts x and y and n_x and n_y words cannot be similar.

    Every word that one text has beyond those of the other costs an edit; cells that hold several words and full
    cells can only make the texts look more alike.
    """
    common = np.minimum(x, y).sum(axis=1, dtype=np.int32)
    most = np.maximum(x.sum(axis=-1, dtype=np.int32), y.sum(axis=-1, dtype=np.int32))
    return most - common <= np.floor(np.maximum(n_x, n_y) * (1 - similarity) + 1e-9)


def small_pairs(few: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different parts in buckets of bounded size that no bound rules out."""
    names = ["id", "part", "n_words", "counts"]
    x = few.select("key", *(F.col(c).alias(f"x_{c}") for c in names))
    y = few.select("key", *(F.col(c).alias(f"y_{c}") for c in names))
    near = F.least("x_n_words", "y_n_words") >= similarity * F.greatest("x_n_words", "y_n_words")
    two = x.join(y, "key").where("x_id < y_id AND x_part <> y_part").where(near).select("x_id", "y_id", "x_n_words", "y_n_words", "x_counts", "y_counts")

    def bound(batches):
        for batch in batches:
            n_x, n_y = (batch.column(c).to_numpy() for c in (2, 3))
            ok = may_be_similar(unpacked(batch.column(4)), unpacked(batch.column(5)), n_x, n_y, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in (0, 1)], names=["a", "b"])

    return map_arrow(two, bound, "a long, b long")


def short_words(texts: DataFrame) -> DataFrame:
    """(id, words): the words of (id, text) as sorted 16-bit hashes."""

    def run(batches):
        for batch in batches:
            data, at = raw(batch.column(1))
            out = []
            for a, b in row_chunks(at):
                words, words_at = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
                out += [np.sort((words[x:y] >> np.uint64(48)).astype(np.uint16)).tobytes() for x, y in zip(words_at, words_at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "words"])

    return map_arrow(texts.select("id", "text"), run, "id long, words binary")


def block_pairs(middle: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of different parts in buckets: middle is (key, n, id, part, n_words, keys, words).

    A bucket is dealt in blocks of about BLOCK classes, each pair of which is compared by one task. keys are all
    buckets of a class; a pair comes out of the first bucket that both are in. Of the pairs that their lengths and
    word counts do not rule out, the words are compared as sets with repetitions; a hash that two words share can
    only make texts look more alike.
    """
    dealt = middle.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "part", "n_words", "keys", "words")

    def compare(table: pa.Table) -> pa.Table:
        block, p, q, key = (table.column(c).to_numpy() for c in ("block", "p", "q", "key"))
        ids, part, n = (table.column(c).to_numpy() for c in ("id", "part", "n_words"))
        words = [np.frombuffer(w, np.uint16) for w in table.column("words").to_pylist()]
        cells = np.stack([np.minimum(np.bincount(w % CELLS, minlength=CELLS), FULL) for w in words]).astype(np.uint8)
        keys = [frozenset(k) for k in table.column("keys").to_pylist()]
        counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        right = right[np.argsort(n[right], kind="stable")]
        lengths = n[right]
        first = np.searchsorted(lengths, np.floor(n * similarity))
        last = np.searchsorted(lengths, np.ceil(n / similarity), "right")
        a, b = [], []
        for i in left.tolist():
            with_i = right[first[i] : last[i]]
            with_i = with_i[part[with_i] != part[i]]
            if p[0] == q[0]:
                with_i = with_i[ids[with_i] > ids[i]]
            m = n[with_i]
            with_i = with_i[np.minimum(m, n[i]) >= similarity * np.maximum(m, n[i])]
            if len(with_i):
                with_i = with_i[may_be_similar(cells[with_i], cells[i], n[with_i], n[i], similarity)]
            if not len(with_i):
                continue
            own = np.bincount(words[i], minlength=1 << 16)
            for j in with_i.tolist():
                if j not in counted:
                    counted[j] = np.unique(words[j], return_counts=True)
                value, times = counted[j]
                longer = max(int(n[i]), int(n[j]))
                if longer - int(np.minimum(own[value], times).sum()) <= int(longer * (1 - similarity) + 1e-9) and min(keys[i] & keys[j]) == key[0]:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def word_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled word hashes of all rows and their offsets."""
    return kmer_hashes(*word_hashes(data, at), 1)


def word_ranks(texts: DataFrame) -> np.ndarray:
    """How often the words of each of 2 ** RANK_BITS cells occur in (id, text); its size does not grow with the rows."""

    def run(batches):
        sums = np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            data, at = raw(batch.column(0))
            for a, b in row_chunks(at):
                tokens, _ = word_tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
                sums += np.bincount((tokens >> np.uint64(64 - RANK_BITS)).astype(np.int64), minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["cell", "n"])

    found = map_arrow(texts.select("text"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RANK_BITS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(data: np.ndarray, at: np.ndarray, ranks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, long) of the rarest words of each row, from which a similar text must have one.

    Of two similar texts the longer one, of n words, has at most (1 - similarity) * n words that the other has not.
    So the rarest word that both have, in an order that is the same for all texts, is among that many words and one
    more of either text in its order. A text of n words may be the shorter one, and the longer one has then
    n / similarity words at most; long marks the words that count if the text is the longer one.
    """
    tokens, tokens_at = word_tokens(data, at)
    n = np.diff(tokens_at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((tokens, ranks[(tokens >> np.uint64(64 - RANK_BITS)).astype(np.int64)], row))
    place = np.arange(len(tokens)) - np.repeat(tokens_at[:-1], n)
    if_longer = np.floor(n * (1 - similarity) + 1e-6)
    if_shorter = np.floor(n / similarity * (1 - similarity) + 1e-6)
    kept = place <= np.repeat(if_shorter, n)
    return tokens[order[kept]], row[order[kept]], (place <= np.repeat(if_longer, n))[kept]


def pairs_in_groups(group: np.ndarray, sides: np.ndarray, ids: np.ndarray, part: np.ndarray, n: np.ndarray, long: np.ndarray, counts: pa.Array, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows that stand next to each other with one group number, sorted by n within a group.

    sides: 0 for a group whose rows are all compared with each other, else 1 or 2, and only rows of different sides
    are compared.
    """
    at, found = np.arange(len(group)), [np.zeros((0, 2), np.int64)]
    cells = unpacked(counts)
    step = 0
    while len(at):
        step += 1
        at = at[at < len(group) - step]
        other = at + step
        near = (group[at] == group[other]) & (n[at] >= similarity * n[other] - 1e-9)
        at, other = at[near], other[near]
        ok = (part[at] != part[other]) & (long[other] | (long[at] & (n[at] == n[other]))) & ((sides[at] == 0) | (sides[at] != sides[other]))
        x, y = at[ok], other[ok]
        for k in range(0, len(x), 16384):
            u, v = x[k : k + 16384], y[k : k + 16384]
            hit = may_be_similar(cells[u], cells[v], n[u], n[v], similarity)
            if hit.any():
                u, v = ids[u[hit]], ids[v[hit]]
                found.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def word_pairs(many: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of different parts: an exact set-similarity join of (id, part, text) over words.

    Words are ranked by how often they occur in these texts. Each text is dealt to the groups of its rarest words
    (prefixes), and the texts of a group are compared by length and word counts. A group of more than BLOCK texts is
    dealt in blocks, each pair of which is compared by one task. Every similar pair comes out.
    """
    ranks = many.sparkSession.sparkContext.broadcast(word_ranks(many))

    def deal(batches):
        for batch in batches:
            data, at = raw(batch.column(2))
            for a, b in row_chunks(at):
                part, part_at = data[at[a] : at[b]], at[a : b + 1] - at[a]
                tokens, row, long = prefixes(part, part_at, ranks.value, similarity)
                words, words_at = word_hashes(part, part_at)
                cell = np.repeat(np.arange(b - a), np.diff(words_at)) * CELLS + (words % np.uint64(CELLS)).astype(np.int64)
                counts = packed(np.minimum(np.bincount(cell, minlength=(b - a) * CELLS), FULL).reshape(-1, CELLS).astype(np.uint8))
                of = pa.array(row)
                own = [batch.column(c).slice(a, b - a).take(of) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), *own, pa.array(np.diff(words_at)[row], pa.int64()), pa.array(long), counts.take(of)], names=["token", "id", "part", "n_words", "long", "counts"])

    tokens = cut(map_arrow(many.select("id", "part", "text"), deal, "token long, id long, part long, n_words long, long boolean, counts binary"))
    groups = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("long").alias("long_one"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    groups = groups.where("n > 1 AND long_one AND lo <> hi").select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = tokens.join(groups, "token").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p, q = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(p == q, 0).when(F.col("block") == p, 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("token", p, q).alias("group"), "token", p.alias("p"), q.alias("q"), side.alias("side"), "id", "part", "n_words", "long", "counts")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "token", "p", "q", "n_words")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> pa.RecordBatch:
            token, p, q, side, ids, part, n = (rows.column(c).to_numpy() for c in ("token", "p", "q", "side", "id", "part", "n_words"))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            a, b = pairs_in_groups(np.cumsum(new), side, ids, part, n, rows.column("long").to_numpy(zero_copy_only=False), rows.column("counts"), similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * BLOCK:
                continue
            whole = pa.Table.from_batches(held)
            token, p, q = (whole.column(c).to_numpy() for c in ("token", "p", "q"))
            same = (token == token[-1]) & (p == p[-1]) & (q == q[-1])
            begin = rows - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last group, which may go on, begins
            if begin:
                yield emit(whole.slice(0, begin))
                held, rows = whole.slice(begin).to_batches(), rows - begin
        if rows:
            yield emit(pa.Table.from_batches(held))

    return map_arrow(dealt, compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ell: int = ELL, sketches: int = SKETCHES, similarity: float = SIMILARITY, exact: bool = False
) -> DataFrame:
    """doc_id, class_id, component_id, n_copies, kept: one row per document.

    class_id is the smallest doc_id with exactly the same text, component_id the smallest doc_id among all
    documents reachable over near-duplicate links, n_copies how many rows have the text. kept marks the one
    document that stays: doc_id = component_id (all rows of it, if rows with one id are repeated). A null
    text links with nothing (class_id and component_id are its own doc_id, n_copies 1); empty texts are exact
    copies of each other and near nothing else, as are texts of white space. Rows with a null id and a text are
    classed by text; a class with null ids only has null class_id and is kept. Two texts under one doc_id count
    as one document. Other columns are not looked at. exact: all classes go through the join of the large buckets,
    so that no link is left to the chance of a shared sketch.
    """
    docs = source_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    some = docs.where("text IS NOT NULL")
    classes = cut(classes_of(some, k, ell, sketches))
    known = classes.where("n_words > 0 AND id IS NOT NULL")
    rows = known.select("id", "n_words", F.posexplode("sketch").alias("band", "value"))
    rows = rows.select(F.xxhash64("band", "value").alias("key"), "id", "n_words")
    order = F.struct(F.xxhash64("id").alias("h"), "id", "n_words")
    pivots = rows.groupBy("key").agg(F.min(order).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pivots = pivots.select("key", F.col("pivot.id").alias("pivot"), F.col("pivot.n_words").alias("pivot_words"), (F.col("n") > 2).alias("more"))
    met = cut(rows.join(pivots, "key").where("id <> pivot").select("key", "id", "n_words", "pivot", "pivot_words", "more"))
    close = F.least("n_words", "pivot_words") >= similarity * F.greatest("n_words", "pivot_words")
    pairs = met.where(close).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    checked = cut(verify(pairs, texts_of(some, pairs), similarity))
    found = cut(connected_components(checked.where("ok").select("a", "b")))
    # a bucket is settled if it has no more than its pivot and one class, which are compared by now, or if all of its
    # classes are in one component
    of = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    left = cut(met.where("more").join(of("id"), "id", "left").select("key", "id", "n_words", F.coalesce("of_id", "id").alias("part")))
    open_keys = left.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    rest = cut(left.join(open_keys, "key"))
    few = rest.where(F.col("n") <= SMALL).join(known.select("id", "counts"), "id").select("key", "id", "part", "n_words", "counts")
    more = small_pairs(few, similarity)
    middle = rest.where((F.col("n") > SMALL) & (F.col("n") <= MIDDLE))
    many = rest.where(F.col("n") > MIDDLE).select("id", "part").distinct()
    if exact:
        many = known.select("id").join(of("id"), "id", "left").select("id", F.coalesce("of_id", "id").alias("part"))
    if not middle.isEmpty():
        keys = middle.groupBy("id").agg(F.collect_list("key").alias("keys"))  # no more than a class has sketches
        words = short_words(texts_of(some, keys.select(F.col("id").alias("a"), F.col("id").alias("b"))))
        more = more.unionByName(block_pairs(middle.join(keys.join(words, "id"), "id"), similarity))
    if not many.isEmpty():
        many = many.join(texts_of(some, many.select(F.col("id").alias("a"), F.col("id").alias("b"))), "id")
        more = more.unionByName(word_pairs(cut(many), similarity))
    more = cut(more.distinct().join(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        new = verify(more, texts_of(some, more), similarity).where("ok").select("a", "b")
        whole = cut(connected_components(new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))))
        joined = found.join(whole.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
        joined = joined.select("node", F.coalesce("least", "component").alias("component"))
        found = joined.unionByName(whole.join(found, "node", "left_anti"))
    classes = classes.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    classes = classes.select("digest", F.col("id").alias("class_id"), "n_copies", F.coalesce("component", "id").alias("component_id"))
    joined = with_class(docs).drop("text").join(classes, "digest", "left")
    none = F.col("digest").isNull()
    out = joined.select(
        "doc_id",
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
