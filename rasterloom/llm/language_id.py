"""Language identification by a bidirectional gated recurrent network over bytes.

Two layers of gated recurrent units read a sequence of bytes, one forwards and one backwards; at every
byte their two states together give a log-probability of each language. A document's probabilities are the
softmax of the sums over all its bytes, divided by TEMPER, as neighbouring bytes tell much the same
thing. A sequence is a word (white space resets both states); a word above SPAN bytes is read in pieces of at most SPAN, cut between characters.
So equal words have equal labels, and a task labels each different word once and remembers it.

The network is trained by backpropagation through time in NumPy, on the driver, on at most SAMPLE
labelled texts, chosen evenly over the languages by a hash, with WORDS words drawn from each: these
two bound what is collected. Every language weighs the same, so that bytes that tell nothing don't
speak for the most frequent one. Prediction reads every byte of every text.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if
nothing could be learned (no labelled row in the training folds, or none with a word); with one
language all others have it with score 1; ties go to the first language by name; repeated rows are
predicted each; rows with a null id belong to the fold of the empty string; rows with a null
language are predicted, never learned from; more than LANGUAGES languages: the most frequent are learned.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, only_memo, single_threaded, text_of

#: Texts that are learned from, words drawn from each, and languages learned, at most.
SAMPLE, WORDS, LANGUAGES = 6_000, 48, 512
#: Rows whose crc32 modulo FOLDS is HELD are held out.
FOLDS, HELD = 4, 2
#: Units in each direction, bytes of a sequence, words of a training step, and steps.
HIDDEN, SPAN, BATCH, STEPS = 16, 48, 256, 600
#: What neighbouring bytes' evidence is divided by.
TEMPER = 4.0
#: Different words, and their bytes, that a task remembers.
MEMO, MEMO_BYTES = 300_000, 8_000_000
#: Sequences that go through the network at once.
LANES = 2048
UNKNOWN = "und"


def pieces(word: bytes, span: int = SPAN) -> list[bytes]:
    """The word in pieces of at most span bytes, cut before a byte that begins a character."""
    out = []
    while len(word) > span:
        at = next((k for k in range(span, span - 4, -1) if word[k] & 0xC0 != 0x80), span)
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


class Layer:
    """Gated recurrent units over bytes; states are (units, lanes)."""

    def __init__(self, table: np.ndarray, inner: np.ndarray):
        self.table, self.inner = table, inner  # (3 units, 256) with the bias, (3 units, units): reset, update, candidate

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, units, lanes) after each byte of x (steps, lanes)."""
        units = self.inner.shape[1]
        h = np.zeros((units, x.shape[1]), self.inner.dtype)
        states = np.empty((len(x), *h.shape), h.dtype)
        for t in range(len(x)):
            a = np.take(self.table, x[t], axis=1)
            g = self.inner @ h
            gates = a[: 2 * units]
            gates += g[: 2 * units]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            r, z = gates[:units], gates[units:]
            n = a[2 * units :]
            n += r * g[2 * units :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, r, z, n, g[2 * units :]))
            out = states[t]
            np.subtract(h, n, out=out)
            out *= z
            out += n
            h = out
        return states

    def backward(self, x: np.ndarray, keep: list, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and inner; wanted (steps, units, lanes) are those of the states."""
        units = self.inner.shape[1]
        table, inner, carried = np.zeros_like(self.table), np.zeros_like(self.inner), 0.0
        for t in reversed(range(len(x))):
            h, r, z, n, g = keep[t]
            d = wanted[t] + carried
            dn = d * (1 - z) * (1 - n * n)
            gates = np.concatenate([dn * g * r * (1 - r), d * (h - n) * z * (1 - z)])
            back = np.concatenate([gates, dn * r])
            inner += back @ h.T
            carried = d * z + self.inner.T @ back
            np.add.at(table.T, x[t], np.concatenate([gates, dn]).T)
        return table, inner


class Network:
    """A layer in each direction and the labels of every position."""

    def __init__(self, languages: list[str], parts: list[np.ndarray]):
        self.languages, self.parts = languages, parts  # table and inner of both layers, output of both, bias

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng, many = np.random.default_rng(seed), len(languages)
        layer = lambda: [rng.normal(0, 0.3, (3 * hidden, 256)), rng.normal(0, hidden**-0.5, (3 * hidden, hidden))]
        return cls(languages, [*layer(), *layer(), rng.normal(0, 0.1, (many, hidden)), rng.normal(0, 0.1, (many, hidden)), np.zeros((many, 1))])

    def log_probabilities(self, x: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, languages, lanes) and both layers' states at each byte of x (steps, lanes)."""
        ft, fi, bt, bi, of, ob, bias = self.parts
        f = Layer(ft, fi).forward(x, kept and kept[0])
        b = Layer(bt, bi).forward(x[::-1], kept and kept[1])[::-1]
        y = of @ f + ob @ b + bias
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True)), f, b

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of all positions and its gradients; label is one number a lane."""
        kept = ([], [])
        y, f, b = self.log_probabilities(x, kept)
        lanes, many = np.arange(x.shape[1]), x.size
        loss = -float(y[:, label, lanes].sum()) / many
        d = np.exp(y)
        d[:, label, lanes] -= 1
        d /= many
        ft, fi, bt, bi, of, ob, _ = self.parts
        out = [*Layer(ft, fi).backward(x, kept[0], of.T @ d), *Layer(bt, bi).backward(x[::-1], kept[1], (ob.T @ d)[::-1])]
        return loss, [*out, np.einsum("tlb,thb->lh", d, f), np.einsum("tlb,thb->lh", d, b), d.sum((0, 2))[:, None]]

    def label(self, words: list[bytes]) -> np.ndarray:
        """The sum over each word's bytes of the languages' log-probabilities, (words, languages)."""
        out = np.zeros((len(words), len(self.languages)), "f8")
        cut = [(i, p) for i, w in enumerate(words) for p in pieces(w)]
        length = np.array([len(p) for _, p in cut], "i8")
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            size = length[order[at]]
            to = min(at + LANES, int(np.searchsorted(length[order], size, "right")))
            took = [cut[k] for k in order[at:to]]
            x = np.frombuffer(b"".join(p for _, p in took), "u1").reshape(-1, size).T.astype("i8") if size else None
            if size:
                np.add.at(out, [i for i, _ in took], self.log_probabilities(np.ascontiguousarray(x))[0].sum(0).T)
            at = to
        return out

    def positions(self, text: str) -> list[tuple[int, int, str]]:
        """(first byte, end, language) of the runs of positions with one language; white space has none and ends a run."""
        runs, raw = [], text.encode()
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
            at = m.start()
            for p in pieces(m.group()):
                best = self.log_probabilities(np.frombuffer(p, "u1").astype("i8")[:, None])[0][:, :, 0].argmax(1)
                for k in best:
                    name = self.languages[k]
                    if runs and runs[-1][1] == at and runs[-1][2] == name:
                        runs[-1] = (runs[-1][0], at + 1, name)
                    else:
                        runs.append((at, at + 1, name))
                    at += 1
        return runs

    def single(self) -> Network:
        return Network(self.languages, [p.astype("f4") for p in self.parts])


def fit(words: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Network:
    """Train on (word, language) by Adam; each language weighs the same, whatever its number of words."""
    languages = sorted({name for _, name in words})
    net, rng = Network.new(languages, hidden, seed), np.random.default_rng(seed)
    place = {name: k for k, name in enumerate(languages)}
    by_length: dict[int, list[list[bytes]]] = {}
    for word, name in sorted(words):
        for p in pieces(word):
            by_length.setdefault(len(p), [[] for _ in languages])[place[name]].append(p)
    lengths = sorted(by_length)
    share = np.array([n * sum(map(len, by_length[n])) for n in lengths], "f8")
    share /= share.sum()
    totals = np.array([sum(len(by_length[n][k]) * n for n in lengths) for k in range(len(languages))], "f8")
    pools = {n: (np.frombuffer(b"".join(w for each in by_length[n] for w in each), "u1").reshape(-1, n), np.repeat(np.arange(len(languages)), [len(each) for each in by_length[n]])) for n in lengths}
    first, second = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts]
    for t in range(1, steps + 1):
        raw, label = pools[lengths[rng.choice(len(lengths), p=share)]]
        weight = np.cumsum(1 / totals[label])
        took = np.searchsorted(weight, rng.random(batch) * weight[-1]).clip(max=len(label) - 1)
        _, grads = net.gradients(np.ascontiguousarray(raw[took].T.astype("i8")), label[took])
        rate = 0.02 * min(1.0, 2.0 * (1 - t / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p, g, m, v in zip(net.parts, grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def training_words(df: DataFrame, sample: int, words: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """Words of at most sample labelled texts of the training folds, drawn at places that a hash of the text gives."""
    known = df.where(F.col(lang_col).isNotNull() & (id_bucket(id_col, FOLDS) != HELD)).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()  # at most LANGUAGES
    if not counts:
        return []
    of_each = sample / len(counts)
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 1.1 * of_each / r["count"]) * (1 << 30))))))
    chosen = known.where(F.pmod("h", F.lit(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0))).orderBy(F.xxhash64("h"), "lang").limit(sample)  # SAMPLE rows

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                have = text.encode().split()
                places = np.random.default_rng(zlib.crc32(text.encode())).integers(0, max(len(have), 1), words) if have else []
                found += [(have[k][: 4 * SPAN], name) for k in places]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=["word", "lang"])

    return sorted((bytes(r[0]), r[1]) for r in chosen.mapInArrow(draw, "word binary, lang string").collect())  # SAMPLE * WORDS words


def train(df: DataFrame, sample: int = SAMPLE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network learned from df's labelled rows; None if there is nothing to learn from."""
    have = training_words(df, sample, words, id_col, text_col, lang_col)
    if not have:
        return None
    if len({name for _, name in have}) == 1:
        return Network.new([have[0][1]])
    return fit(have)


class Reader:
    """Labels texts, remembering the words that it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.places, self.sums, self.held = {}, np.zeros((0, len(self.net.languages))), 0

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities of each text's bytes, and the bytes counted."""
        if len(self.places) > MEMO or self.held > MEMO_BYTES:
            self.forget()
        counted = [Counter((t or "").encode().split()) for t in texts]
        new = list({w: None for c in counted for w in c if w not in self.places})
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            self.held += sum(map(len, new))
            self.sums = np.concatenate([self.sums, self.net.label(new)])
        place = np.fromiter((self.places[w] for c in counted for w in c), "i8")
        times = np.fromiter((k for c in counted for k in c.values()), "f8")
        size = np.fromiter((len(w) * k for c in counted for w, k in c.items()), "f8")
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in counted])
        out = np.stack([np.bincount(owner, self.sums[place, k] * times, len(texts)) for k in range(self.sums.shape[1])], 1)
        return out, np.bincount(owner, size, len(texts))


def pooled(sums: np.ndarray) -> np.ndarray:
    """Document probabilities from summed log-probabilities."""
    y = sums / TEMPER
    y = np.exp(y - y.max(1, keepdims=True))
    return y / y.sum(1, keepdims=True)


def identify(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """df's columns with __lang and __score; every row, whole texts."""
    told = df.select(*df.columns, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"), text_of(text_col).alias("__text"))
    if net is None:
        return told.select(*df.columns, F.lit(UNKNOWN).alias("__lang"), F.lit(0.0).alias("__score"))
    kept = df.columns
    shipped = df.sparkSession.sparkContext.broadcast(net.single())  # the weights: a few numbers for each byte, unit and language

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        reader = Reader(shipped.value)
        only_memo("language", reader.forget)
        names = np.array(reader.net.languages, object)
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                p = pooled(reader.read(some.column("__text").to_pylist())[0])
                letters = np.array(some.column("__letters").to_pylist(), bool)
                lang, score = np.where(letters, names[p.argmax(1)], UNKNOWN), np.where(letters, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*kept, "__lang", "__score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return told.mapInArrow(read, f"{schema}, __lang string, __score double")


def language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row of df."""
    read = identify(df.select(F.col(id_col), F.col(text_col).alias("__given")), train(df, id_col=id_col, text_col=text_col, lang_col=lang_col), "__given")
    return read.select(id_col, (id_bucket(id_col, FOLDS) == HELD).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
