"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of up to ORDER bytes with the counts of the bytes that follow. The code
length of a byte is that of PPM with escape method C and exclusion, under frozen counts: the longest context of the
tree predicts it, or escapes to the next shorter one, where the bytes that the longer context predicts are excluded,
down to all bytes that are left being equal. A text gets the language whose tree gives it the shortest code.

As the counts are frozen, everything that an escape costs is a constant of the context. All orders of a tree lie in
sorted arrays, so that the code lengths of an array of grams are a few searches. The most frequent grams of all
languages have their code lengths laid out in a table of bounded size; it only saves time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import CHUNK_BYTES, held_out, map_arrow, raw, row_chunks, source_columns

#: Bytes of the longest context; a gram (context and byte) is one 32-bit number.
ORDER = 3
#: Documents of each language that the model learns from, about; they are chosen by a hash of doc_id.
TRAIN_DOCS = 2000
#: Code lengths in the table of frequent grams at most; the others are computed when they occur, with the same result.
TABLE_CELLS = 8_000_000
UNKNOWN = "und"

_MIX = np.uint32(0x9E3779B1)


def gram_codes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each position and its own byte as a number; what lies before a text counts as byte 0."""
    code = data.astype(np.uint32)
    offset = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(1, ORDER + 1):
        if back < len(data):
            code[back:] |= np.where(offset[back:] >= back, data[:-back], 0).astype(np.uint32) << np.uint32(8 * back)
    return code


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of the grams of the given rows (lang, text)."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, at = raw(batch.column(1))
            sums: dict[str, list[np.ndarray]] = {}
            for k, lang in enumerate(langs):
                part = data[at[k] : at[k + 1]]
                if len(part):
                    sums.setdefault(lang, []).append(gram_codes(part, np.array([0, len(part)])))
            for lang, parts in sums.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return map_arrow(docs, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def found_at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """Context tree of one language: per order the sorted grams and contexts with their constants."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        """grams and n: the different grams of the language and how often each occurs."""
        self.grams, self.counts, self.contexts, self.total, self.distinct, self.shared = [], [], [], [], [], []
        for order in range(ORDER + 1):
            own, back = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(back, n, len(own))
            contexts, of = np.unique(own >> 8, return_inverse=True)  # the byte itself is the lowest
            self.grams.append(own)
            self.counts.append(counts)
            self.contexts.append(contexts)
            self.total.append(np.bincount(of, counts, len(contexts)))
            self.distinct.append(np.bincount(of, minlength=len(contexts)).astype(float))
            # what the bytes that follow a context count in the context that is one byte shorter: they are excluded there
            shared = np.zeros(len(contexts))
            if order:
                at, _ = found_at(self.grams[order - 1], own & ((1 << 8 * order) - 1))
                shared = np.bincount(of, self.counts[order - 1][at], len(contexts))
            self.shared.append(shared)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))  # grams whose byte no order has predicted yet
        excluded, sums = np.zeros(len(grams)), np.zeros(len(grams))  # bytes excluded, and their counts in this order
        for order in range(ORDER, -1, -1):
            gram = grams[left] & ((1 << 8 * (order + 1)) - 1)
            at, known = found_at(self.contexts[order], gram >> 8)
            n = np.where(known, self.total[order][at] if len(self.total[order]) else 0, 0) - sums
            distinct = np.where(known, self.distinct[order][at] if len(self.distinct[order]) else 0, 0) - excluded
            use = known & (n > 0)
            place, seen = found_at(self.grams[order], gram)
            seen &= use
            out[left[seen]] += np.log2((n[seen] + distinct[seen]) / self.counts[order][place[seen]])
            escaped = use & ~seen
            out[left[escaped]] += np.log2((n[escaped] + distinct[escaped]) / distinct[escaped])
            rest = ~seen
            # bytes that follow here also follow in the shorter context, so the exclusion there is this context's alone
            sums = np.where(known, self.shared[order][at] if len(self.shared[order]) else 0, 0)[rest]
            excluded = np.where(known, self.distinct[order][at] if len(self.distinct[order]) else 0, 0)[rest]
            left = left[rest]
        out[left] += np.log2(np.maximum(256 - excluded, 1))
        return out


class Trees:
    """Context trees of all languages, and the table of frequent grams."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], table_cells: int = TABLE_CELLS):
        self.langs = langs
        self.trees = [Tree(counts[x][0].astype(np.int64), counts[x][1].astype(float)) for x in langs]
        every = np.concatenate([np.zeros(0, np.int64), *(counts[x][0] for x in langs)])
        n = np.concatenate([np.zeros(0), *(counts[x][1] for x in langs)])
        grams, back = np.unique(every, return_inverse=True)
        total = np.bincount(back, n, len(grams))
        first = np.argsort(-total, kind="stable")[: table_cells // max(1, len(langs))]
        self.table = self.code_lengths(grams[first]).astype(np.float32)
        # an open table of one probe: a gram that finds its slot taken is computed like one that is not in the table
        self.shift = np.uint32(32 - max(10, int(4 * len(first)).bit_length()))
        slots = self.slot(grams[first].astype(np.uint32))
        _, owner = np.unique(slots, return_index=True)
        self.keys = np.zeros(1 << (32 - int(self.shift)), np.uint32)
        self.rows = np.full(len(self.keys), -1, np.int32)
        self.keys[slots[owner]], self.rows[slots[owner]] = grams[first][owner], owner

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _MIX) ^ (grams >> np.uint32(15)) * _MIX) >> self.shift

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits [gram, language]."""
        return np.stack([t.bits(grams.astype(np.int64)) for t in self.trees], axis=1) if self.trees else np.zeros((len(grams), 1))

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits [gram, language] of 32-bit grams, by the table where they are in it."""
        slots = self.slot(grams)
        row = self.rows[slots]
        missing = np.flatnonzero((row < 0) | (self.keys[slots] != grams))
        out = self.table[row] if len(self.table) else np.zeros((len(grams), max(1, len(self.langs))), np.float32)
        if len(missing):
            different, back = np.unique(grams[missing], return_inverse=True)
            out[missing] = self.code_lengths(different)[back]
        return out

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths in bits [text, language] of texts that lie in one byte array."""
        out = np.zeros((len(at) - 1, max(1, len(self.langs))))
        limit = max(1 << 14, CHUNK_BYTES // max(1, len(self.langs) // 4))
        for a, b in row_chunks(at, limit):
            starts = at[a : b + 1] - at[a]
            grams = gram_codes(data[at[a] : at[b]], starts)
            for low in range(0, len(grams), limit):  # a text above the limit comes in pieces
                high = min(low + limit, len(grams))
                bits = self.gram_bits(grams[low:high])
                rows = np.flatnonzero((starts[:-1] < high) & (starts[1:] > low) & (starts[1:] > starts[:-1]))
                cuts = np.maximum(starts[rows], low) - low
                out[a + rows] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Trees:
    """Learn the trees from a bounded sample of the labelled rows that are not held out.

    Only the counts of each language and of its grams come to the driver; both are bounded by the sample.
    """
    rows = source_columns(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Trees([], {})
    spark = docs.sparkSession
    shares = spark.createDataFrame([(lang, min(1.0, train_docs / sizes[lang])) for lang in langs], "lang string, share double")
    point = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("point")
    sample = rows.select("lang", "text", point).join(F.broadcast(shares), "lang").where("point < share").select("lang", "text")
    found = gram_counts(sample).toArrow()
    lang, gram, n = (found.column(k).to_numpy() for k in range(3))
    return Trees(langs, {x: (gram[lang == x], n[lang == x]) for x in langs})


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    score is the posterior share of the predicted language among the learned ones (0 to 1). Texts that are null
    or have no letter get `und` and score 0, as does everything if no language was learned. Ties go to the
    language that sorts first. Repeated rows and null ids stay; other columns are not looked at. No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        trees = model.value
        ascii_letters = np.zeros(256, bool)
        ascii_letters[65:91] = ascii_letters[97:123] = True
        for batch in batches:
            column = batch.column(1)
            data, at = raw(column)
            bits = trees.score(data, at) if trees.langs else np.zeros((len(at) - 1, 1))
            letters = np.zeros(len(at) - 1, bool)
            marks = np.concatenate([[0], np.cumsum(ascii_letters[data])])
            letters[:] = marks[at[1:]] > marks[at[:-1]]
            for k in np.flatnonzero(~letters & (at[1:] > at[:-1])):
                letters[k] = any(c.isalpha() for c in data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
            least = bits.min(axis=1, keepdims=True)
            share = 1.0 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=1)
            known = letters & bool(trees.langs)
            names = np.array([*trees.langs, UNKNOWN], object)
            pred = np.where(known, names[bits.argmin(axis=1)], UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = source_columns(docs, doc_id=id_col, text=text_col)
    return map_arrow(slim, run, f"doc_id {dict(slim.dtypes)['doc_id']}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row: doc_id, held_out, lang_pred, score."""
    out = predict(docs, train(docs, id_col, text_col, lang_col, train_docs), id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
