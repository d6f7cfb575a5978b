"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A word is held as an array of part ids beside an array with the rank of every adjacent pair. The smallest rank
is found by scanning the array; its boundary is deleted by moving the rest one place to the left, and only the
two neighbouring ranks are looked up again. All new words of a batch are merged together, one row of a matrix
each, so that scan, deletion and refresh are single array operations. Words above SHORT bytes would make the
repeated scan quadratic; they use a heap over linked parts instead, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.common import map_arrow, source_columns

#: Bytes up to which a word is merged in the rank array.
SHORT = 48
#: Words that the cache of one worker holds at most; it is then emptied (results do not depend on it).
CACHE_WORDS = 300_000
#: New words merged in one matrix.
BLOCK_WORDS = 8192
NONE = np.int32(2**31 - 1)

#: The published split pattern of byte-level BPE, with white space spelt out as the Unicode property.
WHITE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: The same for texts of Latin-1 characters only, where the standard matcher is faster.
LATIN_WORDS = re.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^\t-\r \x85\xa00-9A-Za-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: And for texts of ASCII only, where the standard matcher is faster.
ASCII_WORDS = re.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def matcher(text: str):
    """The fastest of the three patterns that is right for this text."""
    if text.isascii():
        return ASCII_WORDS.findall
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORDS.findall
    return LATIN_WORDS.findall


def check_kind(spec: dict) -> None:
    """An error for a file that asks for more than byte-level BPE by the published pattern, which would be encoded wrongly."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [k for k in ("normalizer", "post_processor") if spec.get(k)]
    wrong += [] if model.get("type", "BPE") == "BPE" else ["model"]
    wrong += [] if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) else ["pre_tokenizer"]
    wrong += [f"added token {t['content']}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if wrong:
        raise ValueError(f"not plain byte-level BPE: {', '.join(wrong)}")


class ByteBpe:
    """Encoder and decoder of one vocabulary file in the public tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.added = sorted(((t["content"], t["id"]) for t in spec.get("added_tokens", [])), key=lambda x: -len(x[0]))
        size = max([*vocabulary.values(), *(i for _, i in self.added)]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added:
            self.token_bytes[i] = token.encode()
        self.split_added = re.compile("|".join(re.escape(t) for t, _ in self.added)) if self.added else None
        self.added_id = dict(self.added)
        of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            of_byte[b] = vocabulary[c]
        self.of_byte = of_byte
        self.width = 1 << int(size).bit_length()
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocabulary[left] * self.width + vocabulary[right], (rank, vocabulary[left + right]))
        self.pairs = pairs
        # an open-addressing table: one gather finds most pairs
        self.bits = 18
        while (1 << self.bits) < 4 * len(pairs):
            self.bits += 1
        keys, ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        made = np.zeros(len(spec["model"]["merges"]), np.int32)
        for key, (rank, new) in pairs.items():
            at = self._slot(key)
            while keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            keys[at], ranks[at], made[rank] = key, rank, new
        self.keys, self.ranks, self.made_of_rank = keys, ranks, made
        # all token texts in one array, for decoding by gathers
        self.token_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.token_length = np.fromiter(map(len, self.token_bytes), np.int64, size)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.cache: dict[str, bytes] = {}

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        key = left.astype(np.int64) * self.width + right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at = (at if len(at) == len(open_) else at[open_]) + 1 & ((1 << self.bits) - 1)
            key = key if len(key) == len(open_) else key[open_]
            seen = self.keys[at]
            hit = seen == key
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (seen >= 0)
            open_, at, key = open_[more], at[more], key[more]
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Part ids of short words, merged together in one rank matrix; as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        width = int(lengths.max())
        parts = np.zeros((len(words), width), np.int32)
        held = np.arange(width) < lengths[:, None]
        parts[held] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), NONE, np.int32)
        rows, cols = np.nonzero(held[:, 1:])
        ranks[rows, cols] = self._rank(parts[rows, cols], parts[rows, cols + 1])
        row_of, out = np.arange(len(words)), [b""] * len(words)
        while len(row_of):
            row = np.arange(len(row_of))
            at = ranks.argmin(axis=1)  # the first of equal ranks, as merges go from left to right
            going = ranks[row, at] < NONE
            if not going.all():
                over = ~going
                n = lengths[over]
                kept = parts[over]
                flat = kept[np.arange(kept.shape[1]) < n[:, None]].astype("<u4").tobytes()
                ends = np.cumsum(n) * 4
                for k, start, end in zip(row_of[over].tolist(), (ends - n * 4).tolist(), ends.tolist(), strict=True):
                    out[k] = flat[start:end]
                row_of, parts, ranks, lengths, at = row_of[going], parts[going], ranks[going], lengths[going], at[going]
                if not len(row_of):
                    break
                row = np.arange(len(row_of))
            merged = self.made_of_rank[ranks[row, at]]
            # delete the boundary: every row loses one place, what stands right of it moves to the left
            keep = np.ones(parts.shape, bool)
            keep[row, at + 1] = False
            parts = parts[keep].reshape(len(row), -1)
            keep[row, at + 1] = True
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(row), -1)
            parts[row, at] = merged
            lengths = lengths - 1
            if not parts.shape[1]:
                break
            for c in (at - 1, at):  # refresh the two neighbouring ranks
                ok = np.flatnonzero((c >= 0) & (c < lengths - 1))
                ranks[ok, c[ok]] = self._rank(parts[ok, c[ok]], parts[ok, c[ok] + 1])
            last = np.flatnonzero(at == lengths - 1)
            ranks[last, at[last]] = NONE
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """Part ids of a long word: a heap of pair ranks over doubly linked parts."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, pairs, width = len(ids), self.pairs, self.width
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (hit := pairs.get(ids[i] * width + ids[j])):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int64)

    def words(self, text: str) -> list[str]:
        """Words of a text; added tokens stand alone."""
        find = matcher(text)
        if not self.split_added or not any(t in text for t, _ in self.added):
            return find(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += find(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + find(text[at:])

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of new words in the cache, as little-endian unsigned 32-bit integers."""
        cache, short, long = self.cache, [], []
        for word in set(words):
            if word not in cache:
                if word in self.added_id:
                    cache[word] = np.array([self.added_id[word]], "<u4").tobytes()
                else:
                    (short if len(b := word.encode("utf-8", "surrogatepass")) <= SHORT else long).append((word, b))
        short.sort(key=lambda x: len(x[1]))  # rows of about the same width stand in one matrix
        for k in range(0, len(short), BLOCK_WORDS):
            block = short[k : k + BLOCK_WORDS]
            for (word, _), ids in zip(block, self.merge_short([b for _, b in block]), strict=True):
                cache[word] = ids
        for word, b in long:
            cache[word] = self.merge_long(b).astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self.words(t) for t in texts]
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        self.learn(fresh)
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """Text in UTF-8; bytes that are not valid UTF-8 become replacement characters."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        n = self.token_length[at]
        ends = np.cumsum(n)
        where = np.repeat(self.token_start[at] - (ends - n), n)
        where += np.arange(len(where))
        return self.token_flat[where].tobytes().decode("utf-8", "replace").encode("utf-8")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One encoder per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def text_groups(column: pa.Array, limit: int = 1 << 22) -> Iterator[list[str]]:
    """Texts in groups of about limit characters; null is empty."""
    group, size = [], 0
    for x in column:
        text = x.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as an array if keep_ids) of every whole text.

    A null text counts as empty: no tokens and the digests of nothing. Rows stay as they are, repeated rows and
    null ids included, and other columns are not looked at. No shuffle; a worker keeps one batch and a word cache
    of bounded size. The vocabulary file is read on each worker from its installed place.
    """

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for texts in text_groups(batch.column(1)):
                for ids in bpe.encode_batch(texts):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if keep_ids:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    slim = source_columns(docs, doc_id=id_col, text=text_col)
    kind = dict(slim.dtypes)["doc_id"]
    return map_arrow(slim, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
