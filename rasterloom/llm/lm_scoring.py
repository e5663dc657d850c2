"""Language-model scores from a sharded Elias-Fano n-gram trie.

Words become hashes in bounded blocks of tokens, a bucketed table that is written once. A block's
distinct words are routed to word shards, which count and number them and answer the block. The model is
a trigram model with Dirichlet back-off: with P1 the add-one unigram probability of the base score,
P2(w|b) = (c(b,w) + MU2 P1(w)) / (c(b) + MU2) and P(w|a,b) = (c(a,b,w) + MU3 P2(w|b)) / (c(a,b) + MU3), so
each sums to one. A text's first word has the start as its only context and is scored by P2.

Each block's distinct trigrams are routed, with their training counts, to the shard of their first
word. A shard adds the counts up and writes its part of the trie: three levels of words, the pointers from a
level to the next, all monotone sequences in Elias-Fano code (the successors of a context stand above the
last value of the context before), with the rests MU / (c + MU) as two-byte levels of their logarithm: a context's rest is
what it leaves to the shorter one, and a word's share of a context is its count, which its own level tells, times that rest. The file is memory-mapped and stays packed: a word is sought among the successors of its
context by a select in the high bits, through a directory of ranks, and by the low bits of that one bucket. The levels
go back to the blocks, which add up documents. Frequent first words are spread over shards by their
second word. There are as many shards as SHARD_TOKENS of the corpus's tokens ask for, so none grows with it.

Counts up to 3,000 come back exactly; else a level is off by at most half a step, and a token's log10 probability by at most 2.1e-4.

Defined results: a null text counts as empty, its only token is the end; repeated rows count and
are scored each; without training documents every count is 0; more than 2**32 - 1 different words are an error.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, materialise, only_memo, partitions, shared_path, text_of
from .word_hash import hash_words, mix

#: The fold that is not learned from.
FOLDS, HELD_FOLD = 7, 2
#: Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 20
#: Tokens for each shard of the trie and, as a block has fewer different words, for each shard of the words.
SHARD_TOKENS, WORD_SHARD_TOKENS = 1 << 21, 1 << 23
#: Weights of the shorter context's distribution in a context of one and of two words, as numbers of tokens.
MU2, MU3 = 32.0, 2.0
#: Two-byte levels of log10 probabilities from LOWEST to 0; level 0 means none.
LEVELS, LOWEST = 65_535, -9.0
END_WORD = np.uint64(0x45AF1D3B9C0E7711)
#: The word before a text's first and the one after its end.
START = np.int64(0)
BLOCKS = "block bigint, doc_ids binary, nulls binary, held binary, lengths binary, words binary, counts binary, size bigint, tokens binary"


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def squeeze_planes(a: np.ndarray) -> bytes:
    """Whole numbers below 2**32 in four planes of bytes, the higher ones mostly zeros."""
    if len(a) and int(a.max()) >= 1 << 32:
        raise OverflowError("more than 2**32 - 1 different words or counts")
    return pack(a.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def squeeze_words(words: np.ndarray) -> bytes:
    """Hashes by their steps (that wrap where they fall), in eight planes of bytes: in runs of rising hashes the higher ones are mostly zeros."""
    return pack(np.diff(words.astype("<u8"), prepend=np.uint64(0)).view("u1").reshape(-1, 8).T.tobytes())


def stretch_words(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(unpack(b), "u1").reshape(8, -1).T).view("<u8").ravel(), dtype="u8")


def squeeze_levels(a: np.ndarray) -> bytes:
    """Two-byte levels in two planes of bytes."""
    return pack(a.astype("<u2").view("u1").reshape(-1, 2).T.tobytes())


def stretch_levels(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(b), "u1").reshape(2, -1).T).view("<u2").ravel()


def stretch_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(b), "u1").reshape(4, -1).T).view("<u4").ravel().astype("i8")


#: Set bits of each byte, and the place of the k-th set bit in it.
ONES = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little")
POPULATION = ONES.sum(1).astype("u1")
PLACE_OF = np.argsort(ONES == 0, axis=1, kind="stable").astype("u1")


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with the set bits before each 64, read from mapped bytes."""

    @staticmethod
    def encode(values: np.ndarray) -> dict:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, int(math.log2(top / n))) if n else 0
        v = values.astype("u8")
        lows = []
        for at in range(0, n if low else 0, 1 << 14):  # whole bytes each
            lows.append(np.packbits(((v[at : at + (1 << 14), None] >> np.arange(low, dtype="u8")) & np.uint64(1)).astype("u1").ravel(), bitorder="little"))
        high = np.zeros(-(-(n + (top >> low) + 1) // 64) * 64, "u1")
        high[(v >> np.uint64(low)).astype("i8") + np.arange(n)] = 1
        highs = np.packbits(high, bitorder="little")
        ranks = np.cumsum(POPULATION[highs].reshape(-1, 8).sum(1))
        return {"n": n, "low": low, "lows": np.concatenate([*lows, np.zeros(9, "u1")]), "highs": highs, "ranks": np.concatenate([[0], ranks[:-1]]).astype("<u4")}

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ranks: np.ndarray):
        self.n, self.low, self.highs = n, low, highs
        self.lanes = np.ndarray(len(lows) - 7, "<u8", lows, strides=(1,))  # the eight bytes from each byte on
        self.words, self.ranks = highs.reshape(-1, 8), ranks.view("<u4")

    def _in_word(self, word: np.ndarray, k: np.ndarray, flip: int) -> np.ndarray:
        """The place of the k-th set bit, or with flip 255 clear bit, of each word of 64."""
        raw = self.words[word] ^ np.uint8(flip)
        upto = np.cumsum(POPULATION[raw], 1, dtype="i8")
        byte = (upto <= k[:, None]).sum(1)
        rows = np.arange(len(word))
        before = np.where(byte > 0, upto[rows, byte - 1], 0)
        return word * 64 + byte * 8 + PLACE_OF[raw[rows, byte], k - before]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, "i8")
        word = np.searchsorted(self.ranks, i, "right") - 1
        high = self._in_word(word, i - self.ranks[word], 0) - i
        return high.astype("u8") << np.uint64(self.low) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), "u8")
        at = i * self.low
        return self.lanes[at >> 3] >> (at & 7).astype("u8") & np.uint64((1 << self.low) - 1)

    def _has(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether the value at place i has these high bits: then it is the set bit at their sum."""
        at = high + i
        inside = at < len(self.highs) * 8
        at = np.where(inside, at, 0)
        return inside & (self.highs[at >> 3] >> (at & 7).astype("u1") & 1).astype(bool)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below high: the clear bit that ends the high before tells."""
        zeros = np.arange(len(self.ranks), dtype="i8") * 64 - self.ranks
        out = np.zeros(len(high), "i8")
        some = high > 0
        k = np.minimum(high[some] - 1, len(self.words) * 64 - self.n - 1)
        word = np.searchsorted(zeros, k, "right") - 1
        out[some] = self._in_word(word, k - zeros[word], 255) - k
        return out

    def successor(self, key: np.ndarray) -> np.ndarray:
        """The first place whose value is at least key, or n."""
        if not self.n:
            return np.zeros(len(key), "i8")
        key = key.astype("u8")
        high, low = (key >> np.uint64(self.low)).astype("i8"), key & np.uint64((1 << self.low) - 1)
        lo = self._below(high)
        # In the one bucket that shares the high bits: two steps, then, in long buckets, by halves.
        open_ = np.arange(len(key))
        for _ in range(2):
            open_ = open_[self._has(high[open_], lo[open_]) & (self._low(np.minimum(lo[open_], self.n - 1)) < low[open_])]
            lo[open_] += 1
        hi = lo.copy()
        hi[open_] = self._below(high[open_] + 1)
        open_ = open_[lo[open_] < hi[open_]]
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.successor(key)
        key = key.astype("u8")
        there = np.flatnonzero(at < self.n)
        same = self._has((key[there] >> np.uint64(self.low)).astype("i8"), at[there]) & (self._low(at[there]) == key[there] & np.uint64((1 << self.low) - 1))
        out = np.full(len(key), -1)
        out[there[same]] = at[there[same]]
        return out


def to_level(p: np.ndarray) -> np.ndarray:
    """Two bytes for a probability above 0."""
    return (1 + np.clip(np.rint((np.log10(p) - LOWEST) / -LOWEST * (LEVELS - 1)), 0, LEVELS - 1)).astype("<u2")


#: The probability of each level.
OF_LEVEL = np.concatenate([[0.0], 10 ** (LOWEST - LOWEST * np.arange(LEVELS) / (LEVELS - 1))])


def level_of_count(count: np.ndarray) -> np.ndarray:
    return to_level(MU3 / (count + MU3))


def count_of(level: np.ndarray) -> np.ndarray:
    """The count that a level tells; 0 for no level."""
    return np.where(level > 0, np.rint(MU3 / np.maximum(OF_LEVEL[level], 1e-12) - MU3), 0.0)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in rows that are sorted by the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def above_before(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words, each above the last value of the group before; groups begin at first."""
    last = word[np.append(first[1:], len(word)) - 1] + 1
    base = np.concatenate([[0], np.cumsum(last)[:-1]])
    return word + np.repeat(base, np.diff(np.append(first, len(word))))


def trie_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, count: np.ndarray, totals: dict[int, int]) -> bytes:
    """A shard's file from its trigrams, sorted and distinct; totals: of first words that other shards share."""
    if not len(x):
        return (0).to_bytes(8, "little")
    pair = firsts(x, y)
    of_pair = np.add.reduceat(count, pair)
    context = firsts(x[pair])
    total = np.add.reduceat(of_pair, context).astype("f8")
    contexts = x[pair][context]
    for i in np.flatnonzero(np.isin(contexts, list(totals))):
        total[i] = totals[int(contexts[i])]
    parts = {
        "contexts": EliasFano.encode(contexts), "pointers": EliasFano.encode(np.append(context, len(pair))), "seconds": EliasFano.encode(above_before(y[pair], context)),
        "pair_pointers": EliasFano.encode(np.append(pair, len(x))), "thirds": EliasFano.encode(above_before(z, pair)),
    }
    arrays = {f"{k}.{a}": e[a] for k, e in parts.items() for a in ("lows", "highs", "ranks")}
    arrays |= {
        "rest2": to_level(MU2 / (total + MU2)), "count2": level_of_count(of_pair), "count3": level_of_count(count),
    }
    places, at = {}, 0
    for k, a in arrays.items():
        places[k] = [at, a.nbytes]
        at += a.nbytes
    header = json.dumps({"places": places, **{k: [e["n"], e["low"]] for k, e in parts.items()}}).encode()
    return b"".join([len(header).to_bytes(8, "little"), header, *(a.tobytes() for a in arrays.values())])


class Trie:
    """A shard's levels over a buffer, memory-mapped where the store allows it."""

    def __init__(self, buffer):
        data = np.frombuffer(buffer, "u1")
        size = int.from_bytes(data[:8].tobytes(), "little")
        self.empty = not size
        if self.empty:
            return
        header = json.loads(data[8 : 8 + size].tobytes())

        def part(k: str, kind: str = "u1") -> np.ndarray:
            at, length = header["places"][k]
            return np.frombuffer(data[8 + size + at : 8 + size + at + length], kind)

        level = lambda k: EliasFano(*header[k], part(f"{k}.lows"), part(f"{k}.highs"), part(f"{k}.ranks", "<u4"))
        self.contexts, self.pointers, self.seconds, self.pair_pointers, self.thirds = map(level, ("contexts", "pointers", "seconds", "pair_pointers", "thirds"))
        self.rest2, self.count2, self.count3 = (part(k, "<u2") for k in ("rest2", "count2", "count3"))

    @staticmethod
    def open(uri: str) -> Trie:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        if isinstance(system, fs.LocalFileSystem):
            return Trie(pa.memory_map(path).read_buffer())
        with system.open_input_file(path) as f:
            return Trie(f.read_buffer())

    @staticmethod
    def _among(level: EliasFano, pointers: EliasFano, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place on a level of each word among the successors of its parent; -1 if either is missing."""
        out = np.full(len(word), -1)
        known = np.flatnonzero(parent >= 0)
        own, back = np.unique(parent[known], return_inverse=True)
        start, end = pointers[own].astype("i8"), pointers[own + 1].astype("i8")
        base = np.zeros(len(own), "u8")
        base[start > 0] = level[start[start > 0] - 1] + np.uint64(1)
        # The value of the first group is the word itself; every other stands above the one before.
        at = level.find(word[known].astype("u8") + base[back])
        out[known] = np.where((at >= start[back]) & (at < end[back]), at, -1)
        return out

    def find(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
        """Levels of the count of each trigram, of the count of each pair, and of the rest of each first word; 0 where the
        trie has none. The trigrams are sorted and distinct; pairs and first words are told once, in order."""
        pair = firsts(x, y)
        context = firsts(x[pair])
        if self.empty:
            return tuple(np.zeros(n, "<u2") for n in (len(x), len(pair), len(context)))
        of = lambda level, at: np.where(at >= 0, level[at], 0).astype("<u2")
        first = self.contexts.find(x[pair][context])
        second = self._among(self.seconds, self.pointers, np.repeat(first, np.diff(np.append(context, len(pair)))), y[pair])
        third = self._among(self.thirds, self.pair_pointers, np.repeat(second, np.diff(np.append(pair, len(x)))), z)
        return of(self.count3, third), of(self.count2, second), of(self.rest2, first)


def token_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table of blocks of about BLOCK_TOKENS tokens: documents, dictionary and tokens, in buckets by block.

    The buckets let every later step meet the tokens where they lie; they are written once and never moved.
    """

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        hashes: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            words, tokens, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words have small places, which compress well
            place = np.empty(len(words), "i8")
            place[order] = np.arange(len(words))
            words, tokens, n = words[order], place[tokens], n[order]
            ids, held, lengths = (np.array(x) for x in zip(*docs))
            nulls = np.array([i is None for i in ids])
            train = np.bincount(tokens[np.repeat(held == 0, lengths)], minlength=len(words))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number << 32 | made], pa.int64()), "doc_ids": [np.where(nulls, 0, ids).astype("<i8").tobytes()], "nulls": [nulls.astype("u1").tobytes()], "held": [held.astype("u1").tobytes()],
                "lengths": [lengths.astype("<i8").tobytes()], "words": [squeeze_words(words)], "counts": [squeeze_planes(np.concatenate([train, n]))], "size": pa.array([size], pa.int64()), "tokens": [squeeze_planes(tokens)],
            })

        for part in parts:
            ids, held = part.column(0).to_pylist(), part.column(1).to_pylist()
            found, counts = hash_words(part.column(2))
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i, (doc, h) in enumerate(zip(ids, held)):
                docs.append((doc, int(h), int(counts[i]) + 1))
                hashes += [found[edges[i] : edges[i + 1]], np.array([END_WORD])]
                size += int(counts[i]) + 1
                if size >= BLOCK_TOKENS:
                    yield close()
                    docs, hashes, size, made = [], [], 0, made + 1
        if docs:
            yield close()

    spark = df.sparkSession
    held = (id_bucket(id_col, FOLDS) == HELD_FOLD).alias("held")
    blocks = df.select(F.col(id_col).cast("bigint").alias("id"), held, text_of(text_col).alias("text")).mapInArrow(build, BLOCKS)
    name = f"lm_blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").option("path", shared_path(spark, "lm-blocks")).bucketBy(partitions(spark), "block").saveAsTable(name)
    return spark.table(name)


def _routes(words: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each shard of the words, the places of its words in order of hash."""
    shard = (mix(words) % np.uint64(shards)).astype("i8")
    order = np.lexsort((words, shard))
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def number_words(blocks: DataFrame, tokens: int, shards: int) -> DataFrame:
    """(block, shard, data) written, by `shards` of the words: for each block and shard the numbers and training counts of its words there.

    Rows with a null block hold, as JSON, a shard's sums and its frequent words, at most 4 a shard
    on average. A word's number falls as its count grows, and is unique over shards.
    """
    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, raw, counts in zip(*(c.to_pylist() for c in part.columns)):
                words = stretch_words(raw)
                n = stretch_planes(counts).reshape(2, -1)
                routes = [(s, g) for s, g in enumerate(_routes(words, shards)) if len(g)]
                halves = [(squeeze_words(words[g]), squeeze_planes(n[:, g].ravel())) for _, g in routes]
                data, cut = [a + b for a, b in halves], [len(a) for a, _ in halves]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(routes), block)), pa.array([s for s, _ in routes], pa.int64()), pa.array(cut, pa.int64()), pa.array(data, pa.binary())], names=["block", "shard", "cut", "data"])

    def number(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [(stretch_words(d[:c]), stretch_planes(d[c:]).reshape(2, -1)) for d, c in zip(group.column("data").to_pylist(), group.column("cut").to_pylist())]
        words, back = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n, n_all = (np.bincount(back, np.concatenate([m[k] for _, m in parts]), len(words)).astype("i8") for k in (0, 1))
        rank = np.empty(len(words), "i8")
        rank[np.lexsort((words, -n_all))] = np.arange(len(words))
        numbers, at, rows = rank * shards + shard + 1, 0, []
        for w, _ in parts:
            i = back[at : at + len(w)]
            at += len(w)
            rows.append(squeeze_planes(np.concatenate([numbers[i], n[i]])))
        frequent = np.flatnonzero((n_all > tokens / (4 * shards)) & (words != END_WORD))
        ends = n[words == END_WORD]
        told = json.dumps({"n": int(n.sum()), "v": int((n > 0).sum()), "hot": {int(numbers[i]): int(n[i]) for i in frequent}, "starts": int(ends.sum())}).encode()
        return pa.table({"block": pa.array([*group.column("block").to_pylist(), None], pa.int64()), "shard": pa.array(np.full(len(rows) + 1, shard)), "data": pa.array([*rows, told], pa.binary())})

    routed = blocks.select("block", "words", "counts").mapInArrow(route, "block bigint, shard bigint, cut bigint, data binary")
    return materialise(routed.groupby("shard").applyInArrow(number, "block bigint, shard bigint, data binary"), "lm-words")


def _block(row: dict, numbered: dict[int, bytes], shards: int) -> dict[str, np.ndarray]:
    """A block's arrays, with the numbers and training counts of its words."""
    b = {k: np.frombuffer(row[k], kind) for k, kind in (("doc_ids", "<i8"), ("nulls", "u1"), ("held", "u1"), ("lengths", "<i8"))}
    b["words"] = stretch_words(row["words"])
    b["tokens"] = stretch_planes(row["tokens"])
    b["numbers"], b["n"] = np.zeros(len(b["words"]), "i8"), np.zeros(len(b["words"]), "i8")
    for s, g in enumerate(_routes(b["words"], shards)):
        if len(g):
            b["numbers"][g], b["n"][g] = stretch_planes(numbered[s]).reshape(2, -1)
    return b


def _trigrams(b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second and third words of a block's distinct trigrams, sorted, and the place of the one around each token)."""
    numbers, rank = np.unique(np.append(b["numbers"], START), return_inverse=True)
    second = rank[b["tokens"]]
    first, third = np.concatenate([[0], second[:-1]]), np.append(second[1:], 0)  # START has the least rank
    ends = np.cumsum(b["lengths"])
    first[ends[:-1]] = 0
    third[ends - 1] = 0
    bits = np.int64(len(numbers).bit_length())
    if 3 * bits < 63:
        key, place = np.unique((first << 2 * bits) | (second << bits) | third, return_inverse=True)
        pair, third = key >> bits, key & ((1 << bits) - 1)
    else:
        pair, of = np.unique((first << bits) | second, return_inverse=True)
        key, place = np.unique((of << bits) | third, return_inverse=True)
        pair, third = pair[key >> bits], key & ((1 << bits) - 1)
    return numbers[pair >> bits], numbers[pair & ((1 << bits) - 1)], numbers[third], place


def _shards(x: np.ndarray, y: np.ndarray, hot: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its trigrams, in order): that of the first word; for a frequent one, that of the pair."""
    key = mix(x.astype("u8"))
    spread = np.isin(x, hot)
    key[spread] = mix(key[spread] ^ mix(y[spread].astype("u8") + np.uint64(7)))
    shard = (key % np.uint64(shards)).astype("i8")
    order = np.argsort(shard, kind="stable")
    return [(int(shard[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(g)]


def squeeze_trigrams(x: np.ndarray, y: np.ndarray, z: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted trigrams by their steps: each word counts from the one before it, as long as the words to its left stay the same."""
    new_x = np.diff(x, prepend=-1) != 0
    new_pair = new_x | (np.diff(y, prepend=-1) != 0)
    step = lambda v, new: np.where(new, v, np.diff(v, prepend=0))
    return squeeze_planes(np.concatenate([np.diff(x, prepend=0), step(y, new_x), step(z, new_pair), count]))


def stretch_trigrams(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dx, dy, dz, count = stretch_planes(b).reshape(4, -1)

    def run(d: np.ndarray, new: np.ndarray) -> np.ndarray:
        whole, at = np.cumsum(d), np.flatnonzero(new)
        return whole - np.repeat(whole[at] - d[at], np.diff(np.append(at, len(d))))

    new_x = dx > 0
    new_x[:1] = True
    y = run(dy, new_x)
    new_pair = new_x | (dy > 0)
    return np.cumsum(dx), y, run(dz, new_pair), count


def look_up(blocks: DataFrame, numbered: DataFrame, hot: dict[int, int], word_shards: int, shards: int, root: str | None = None) -> DataFrame:
    """Build the trie's shards and look up every block's trigrams: (block, shard, file, data).

    hot: frequent first words and their training totals, at most 4 a shard of the words.
    """
    folder = root or shared_path(blocks.sparkSession, "lm-trie")
    spread = np.array(sorted(hot), "i8")

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right.column("shard").to_pylist(), right.column("data").to_pylist()))
        out = []
        for row in left.to_pylist():
            b = _block(row, found, word_shards)
            x, y, z, place = _trigrams(b)
            count = np.bincount(place[np.repeat(b["held"] == 0, b["lengths"])], minlength=len(x))
            out += [(row["block"], s, squeeze_trigrams(x[g], y[g], z[g], count[g])) for s, g in _shards(x, y, spread, shards)]
        block, shard, data = zip(*out)
        return pa.table({"block": pa.array(block, pa.int64()), "shard": pa.array(shard, pa.int64()), "data": pa.array(data, pa.binary())})

    def build_and_find(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        only_memo("scores")
        parts = [stretch_trigrams(p) for p in group.column("data").to_pylist()]
        x, y, z, count = (np.concatenate(c) for c in zip(*parts))
        seen = count > 0
        pair, of = np.unique(x[seen].astype("u8") << np.uint64(32) | y[seen].astype("u8"), return_inverse=True)
        key, back = np.unique(of.astype("u8") << np.uint64(32) | z[seen].astype("u8"), return_inverse=True)
        total, pair = np.bincount(back, count[seen], len(key)).astype("i8"), pair[(key >> np.uint64(32)).astype("i8")]
        half = lambda k: (k & np.uint64(0xFFFFFFFF)).astype("i8")
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        name = f"shard-{group.column('shard')[0].as_py():06d}-{uuid.uuid4().hex}.eft"
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(trie_bytes((pair >> np.uint64(32)).astype("i8"), half(pair), half(key), total, hot))
        del x, y, z, count, seen, of, back
        trie = Trie.open(f"{folder}/{name}")
        found = [squeeze_levels(np.concatenate(trie.find(*p[:3]))) for p in parts]
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "file": pa.array([f"{folder}/{name}"] * len(parts)), "data": pa.array(found, pa.binary())})

    routed = blocks.select("block", "doc_ids", "nulls", "held", "lengths", "words", "tokens").groupby("block").cogroup(numbered.groupby("block")).applyInArrow(route, "block bigint, shard bigint, data binary")
    return routed.groupby("shard").applyInArrow(build_and_find, "block bigint, shard bigint, file string, data binary")


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of df."""
    blocks = token_blocks(df, id_col, text_col)
    tokens = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    word_shards, shards = (max(partitions(df.sparkSession), -(-tokens // most)) for most in (WORD_SHARD_TOKENS, SHARD_TOKENS))
    told = number_words(blocks, tokens, word_shards)
    sums = [json.loads(r[0]) for r in told.where("block is null").select("data").collect()]  # one row a shard
    numbered = told.where("block is not null")
    train_tokens, vocabulary = sum(x["n"] for x in sums), sum(x["v"] for x in sums)
    hot = {int(k): n for x in sums for k, n in x["hot"].items()}
    hot[int(START)] = sum(x["starts"] for x in sums)  # every text has one start, as it has one end
    levels = look_up(blocks, numbered, hot, word_shards, shards)
    spread = np.array(sorted(hot), "i8")
    spread_rest = OF_LEVEL[to_level(MU2 / (np.array([hot[k] for k in sorted(hot)], "f8") + MU2))]

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        by = {(k, s): d for k, s, d in zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "data")))}
        for row in left.to_pylist():
            b = _block(row, {s: d for (k, s), d in by.items() if k == "words"}, word_shards)
            x, y, z, place = _trigrams(b)
            share3, share2, rest3, rest2 = np.zeros(len(x)), np.zeros(len(x)), np.ones(len(x)), np.ones(len(x))
            for s, g in _shards(x, y, spread, shards):
                found = stretch_levels(by["levels", s])
                pair = firsts(x[g], y[g])
                context = firsts(x[g][pair])
                pairs, thirds = np.diff(np.append(context, len(pair))), np.diff(np.append(pair, len(g)))
                of_third, of_pair, left2 = np.split(found, np.cumsum([len(g), len(pair)]))
                left2 = np.repeat(np.where(left2 > 0, OF_LEVEL[left2], 1.0), pairs)
                of_pair = count_of(of_pair)
                share2[g], rest2[g] = np.repeat(of_pair * left2 / MU2, thirds), np.repeat(left2, thirds)
                rest3[g] = np.repeat(MU3 / (of_pair + MU3), thirds)
                share3[g] = count_of(of_third) * rest3[g] / MU3
            # A frequent first word is spread over shards, and one without any of its pairs doesn't know it.
            at = np.searchsorted(spread, x).clip(max=len(spread) - 1)
            rest2 = np.where(spread[at] == x, spread_rest[at], rest2)
            count = b["n"][b["tokens"]]
            unigram = (count + 1) / (train_tokens + vocabulary + 1)
            start = np.cumsum(b["lengths"]) - b["lengths"]
            # The trigram around a token tells its P2, the one around the token before tells its share with two words before.
            p = share2[place] + rest2[place] * unigram
            before = np.concatenate([[0], place[:-1]])
            p3 = share3[before] + rest3[before] * p
            p3[start] = p[start]
            total = lambda x: np.add.reduceat(x, start)
            tables.append(pa.table({
                id_col: pa.array(b["doc_ids"], pa.int64(), mask=b["nulls"].astype(bool)), "held_out": pa.array(b["held"].astype(bool)), "n_tokens": pa.array(b["lengths"]),
                "n_known": pa.array(total((count > 0).astype("i8"))), "train_tokens": pa.array(np.full(len(start), train_tokens)),
                "base_score": pa.array(total(np.log10(unigram))), "score": pa.array(total(np.log10(np.minimum(p3, 1.0)))),
            }))
        return pa.concat_tables(tables)

    schema = f"{id_col} bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    answers = numbered.select("block", F.lit("words").alias("kind"), "shard", "data").unionByName(levels.select("block", F.lit("levels").alias("kind"), "shard", "data"))
    return blocks.select("block", "doc_ids", "nulls", "held", "lengths", "words", "tokens").groupby("block").cogroup(answers.groupby("block")).applyInArrow(add_up, schema)
