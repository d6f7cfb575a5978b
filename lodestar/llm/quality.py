"""Quality classifier without gold labels: a weak-label model teaches a hashed linear scorer.

Heuristic labellers look at statistics of a text and vote good, bad or not at all. The votes of the whole corpus
are counted by pattern, and expectation-maximisation over these counts estimates how often each labeller votes
what, given the true class (their accuracies), together with the share of bad texts. The posterior of a bounded
sample of texts then trains a linear scorer over hashed byte trigrams and binned statistics, which judges every
text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, raw, row_chunks
from lodestar.llm.neardup import word_hashes

#: (statistic, lower edge, upper edge, vote below, vote above, least number of words to vote); votes are "good",
#: "bad" or None, as are all texts between the edges. Detectors of one fault do not vote good where it is missing.
LABELLERS = [
    ("symbols", 0.010, 0.040, None, "bad", 1),
    ("upper", 0.080, 0.250, None, "bad", 5),
    ("repeated", 0.050, 0.150, None, "bad", 8),
    ("unique", 0.350, 0.550, "bad", "good", 30),
    ("unique", 0.100, 0.350, "bad", None, 100),
    ("top_word", 0.150, 0.250, None, "bad", 20),
    ("top_word", 0.090, 0.115, None, "bad", 80),
    ("odd_bytes", 0.050, 0.450, "good", "bad", 1),
    ("stops", 0.030, 0.080, "bad", "good", 20),
    ("stops", 0.200, 0.240, None, "bad", 40),
    ("digits", 0.050, 0.250, None, "bad", 30),
]
SHORT = 3
STATS = ["symbols", "upper", "repeated", "unique", "top_word", "odd_bytes", "stops", "digits"]

BUCKETS = 4096
#: Texts that train the scorer, about; they are chosen by a hash of doc_id.
TRAIN_DOCS = 3000
EM_ROUNDS = 100
#: Weight of what is believed of a labeller before, as a share of the corpus.
BELIEF = 0.02
#: Bytes from which the trigrams of a text count in full.
FULL_BYTES = 200
STEPS, RATE, DECAY = 300, 0.05, 1e-4
_STAT_BINS = 8
_GRAM = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> dict[str, np.ndarray]:
    of = {name: np.zeros(256, bool) for name in ("symbols", "upper", "digits", "letters")}
    of["symbols"][[ord(c) for c in "#$%&*|!@^~<>{}[]\\=+_"]] = True
    of["upper"][65:91] = True
    of["digits"][48:58] = True
    of["letters"][65:91] = of["letters"][97:123] = of["letters"][128:] = True
    return of


def statistics(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics [text, STATS] and number of words of texts that lie in one byte array."""
    of = _classes()
    n = np.maximum(np.diff(at), 1)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    words, words_at = word_hashes(data, at)
    n_words = np.diff(words_at)
    some = np.maximum(n_words, 1)
    row = np.repeat(np.arange(len(n_words)), n_words)
    rows = len(n_words)
    same = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    repeated = np.bincount(row[1:][same], minlength=rows)
    ordered = np.sort(words >> np.uint64(24) | row.astype(np.uint64) << np.uint64(40))  # by row, then word
    runs = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(words)])
    run_row = (ordered[runs] >> np.uint64(40)).astype(np.int64)
    unique = np.bincount(run_row, minlength=rows)
    top = np.zeros(rows, np.int64)
    if len(runs):
        lead = np.flatnonzero(np.concatenate([[True], run_row[1:] != run_row[:-1]]))
        top[run_row[lead]] = np.maximum.reduceat(np.diff(np.append(runs, len(words))), lead)
    space = np.append(data[1:] <= 32, True)[: len(data)]
    space[at[1:][at[1:] > at[:-1]] - 1] = True  # the end of a text
    stop = ((data == 46) | (data == 44)) & space
    odd = ~(of["letters"][data] | of["digits"][data] | (data <= 32) | stop)
    out = np.stack(
        [count(of["symbols"][data]) / n, count(of["upper"][data]) / np.maximum(count(of["letters"][data]), 1), repeated / some, unique / some, top / some, count(odd) / some, count(stop) / some, count(of["digits"][data]) / n],
        axis=1,
    )
    return out, n_words


def votes(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Vote [text, labeller]: 0 for none, 1 for good, 2 for bad, SHORT if the text is too short to be looked at."""
    out = np.zeros((len(stats), len(LABELLERS)), np.int64)
    said = {None: 0, "good": 1, "bad": 2}
    for k, (name, low, high, below, above, least) in enumerate(LABELLERS):
        x = stats[:, STATS.index(name)]
        out[:, k] = np.where(n_words < least, SHORT, np.where(x <= low, said[below], np.where(x >= high, said[above], 0)))
    return out


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return vote @ 4 ** np.arange(vote.shape[1])


class WeakLabels:
    """Shares of good and bad texts and the vote probabilities of each labeller given the class, by EM."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        k = len(LABELLERS)
        vote = patterns[:, None] // 4 ** np.arange(k) % 4
        self.bad = 0.2
        # [labeller, class, vote]: what is believed before, that each labeller is better than chance
        before = np.array([[0.55, 0.43, 0.02], [0.4, 0.1, 0.5]])
        self.given = np.stack([before] * k)
        total = max(1, counts.sum())
        for _ in range(EM_ROUNDS):
            p = self.posterior(vote)
            self.bad = float(np.clip((counts * p).sum() / total, 1e-3, 1 - 1e-3))
            for c, weight in enumerate((counts * (1 - p), counts * p)):
                for j in range(k):
                    n = np.bincount(vote[:, j], weight, 4)[:3] + BELIEF * total * before[c]
                    self.given[j, c] = n / n.sum()

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability that a text is bad, given its votes; that a labeller looked and did not vote also counts."""
        z = np.full(len(vote), np.log(self.bad / (1 - self.bad)))
        for j in range(vote.shape[1]):
            z += np.append(np.log(self.given[j, 1] / self.given[j, 0]), 0.0)[vote[:, j]]
        return 1 / (1 + np.exp(-z))

    def accuracies(self) -> list[float]:
        """How often each labeller is right when it votes."""
        out = []
        for j in range(len(LABELLERS)):
            right = (1 - self.bad) * self.given[j, 0, 1] + self.bad * self.given[j, 1, 2]
            out.append(float(right / ((1 - self.bad) * self.given[j, 0, 1:].sum() + self.bad * self.given[j, 1, 1:].sum())))
        return out


def gram_cells(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash bucket of the byte trigram that begins at each position; it ends with its text."""
    code = np.zeros(len(data), np.uint64)
    code[:] = data
    for t in (1, 2):
        code[:-t] += data[t:].astype(np.uint64) << np.uint64(8 * t)
    sizes = np.diff(at)
    code[at[1:][sizes > 0] - 1] &= np.uint64(0xFF)
    code[at[1:][sizes > 1] - 2] &= np.uint64(0xFFFF)
    return ((code * _GRAM) >> np.uint64(64 - 12)).astype(np.int64)


def stat_cells(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Buckets of the binned statistics [text, labellers + 1]; they lie behind those of the grams."""
    size = np.minimum(np.log2(np.maximum(n_words, 1)).astype(np.int64), _STAT_BINS - 1)
    out = [BUCKETS + size]
    for k, (name, low, high, *_) in enumerate(LABELLERS):
        edges = np.concatenate([[low * 0.5], np.linspace(low, high, _STAT_BINS - 3), [high * 1.6]])
        out.append(BUCKETS + (k + 1) * _STAT_BINS + np.searchsorted(edges, stats[:, STATS.index(name)], "right"))
    return np.stack(out, axis=1)


WIDTH = BUCKETS + (len(LABELLERS) + 1) * _STAT_BINS


def scores(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of being good of texts in one byte array; 0 without words."""
    out = np.zeros(len(at) - 1)
    for a, b in row_chunks(at):
        part, part_at = data[at[a] : at[b]], at[a : b + 1] - at[a]
        stats, n_words = statistics(part, part_at)
        sums = np.concatenate([[0.0], np.cumsum(weights[gram_cells(part, part_at)])]) if len(part) else np.zeros(1)
        z = (sums[part_at[1:]] - sums[part_at[:-1]]) / np.maximum(np.diff(part_at), FULL_BYTES) * 10 + weights[stat_cells(stats, n_words)].sum(axis=1) + weights[-1]
        out[a:b] = np.where(n_words > 0, 1 / (1 + np.exp(-z)), 0.0)
    return out


def vote_counts(texts: DataFrame) -> DataFrame:
    """(pattern, n) over all texts; at most four to the power of the labellers rows."""

    def run(batches):
        for batch in batches:
            data, at = raw(batch.column(0))
            parts = [pattern_of(votes(*statistics(data[at[a] : at[b]], at[a : b + 1] - at[a]))) for a, b in row_chunks(at)]
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    return map_arrow(texts, run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def sample_features(texts: DataFrame) -> DataFrame:
    """(cells, values, pattern) of the sampled texts: cells that are not zero as 16-bit and their values as 32-bit numbers."""

    def run(batches):
        for batch in batches:
            data, at = raw(batch.column(0))
            cells, values, patterns = [], [], []
            for k in range(len(at) - 1):
                part = data[at[k] : at[k + 1]]
                stats, n_words = statistics(part, np.array([0, len(part)]))
                x = np.zeros(WIDTH, np.float32)
                if len(part):
                    x[:BUCKETS] = np.bincount(gram_cells(part, np.array([0, len(part)])), minlength=BUCKETS) / max(len(part), FULL_BYTES) * 10
                x[stat_cells(stats, n_words)[0]] = 1
                some = np.flatnonzero(x)
                cells.append(some.astype(np.uint16).tobytes())
                values.append(x[some].tobytes())
                patterns.append(int(pattern_of(votes(stats, n_words))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), pa.array(values, pa.binary()), pa.array(patterns, pa.int64())], names=["cells", "values", "pattern"])

    return map_arrow(texts, run, "cells binary, values binary, pattern long")


def dense(cells: list[bytes], values: list[bytes]) -> np.ndarray:
    """Features [text, WIDTH] of a bounded sample."""
    out = np.zeros((len(cells), WIDTH), np.float32)
    for k, (c, v) in enumerate(zip(cells, values, strict=True)):
        out[k, np.frombuffer(c, np.uint16)] = np.frombuffer(v, np.float32)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, WeakLabels]:
    """Weights of the scorer (the bias last) and the weak-label model. Vote counts cover all texts."""
    texts = docs.where(F.col(f"`{text_col}`").isNotNull())
    counted = vote_counts(texts.select(F.col(f"`{text_col}`").alias("text"))).collect()
    labels = WeakLabels(np.array([r.pattern for r in counted], np.int64), np.array([r.n for r in counted], np.float64))
    total = sum(r.n for r in counted)
    weights = np.zeros(WIDTH + 1)
    if not total:
        return weights, labels
    point = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = sample_features(texts.where(point < train_docs / total).select(F.col(f"`{text_col}`").alias("text"))).toArrow()
    if not sample.num_rows:
        return weights, labels
    x = dense(sample.column("cells").to_pylist(), sample.column("values").to_pylist())
    return fit(x, sample.column("pattern").to_numpy(), labels), labels


def fit(x: np.ndarray, patterns: np.ndarray, labels: WeakLabels) -> np.ndarray:
    """Weights and bias of the linear scorer from dense features and the posterior of the votes."""
    vote = patterns[:, None] // 4 ** np.arange(len(LABELLERS)) % 4
    y = 1 - labels.posterior(vote)
    w, bias, mean, square = np.zeros(WIDTH, np.float32), 0.0, np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for step in range(1, STEPS + 1):  # Adam over the full sample: the same every time
        error = ((1 / (1 + np.exp(-(x @ w + bias))) - y) / len(y)).astype(np.float32)
        slope = np.append(x.T @ error + DECAY * w, error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = (w - move[:-1]).astype(np.float32), bias - move[-1]
    return np.append(w, bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs with score and kept added: the probability of being good, and whether it reaches the threshold.

    A text that is null or has no words has score 0 and is not kept. With nothing to learn from every other text
    has score 0.5. Repeated rows and null ids stay; extra columns pass, unless they are named score or kept, which
    are replaced. Documents are not shuffled.
    """
    weights, _ = train(docs, id_col, text_col, train_docs)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("score", "kept")))
    place = rest.columns.index(text_col)
    passed = [c for c in rest.columns if keep_text or c != text_col]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(scores(*raw(batch.column(place)), model.value))], names=[*passed, "score"])

    out = map_arrow(rest, run, rest.select(*(F.col(f"`{c}`") for c in passed), F.lit(0.0).alias("score")).schema)
    return out.withColumn("kept", F.col("score") >= threshold)
