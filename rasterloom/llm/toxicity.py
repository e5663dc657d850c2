"""Toxicity by a counterfactual-regularised linear classifier.

A document's features are the distinct words it holds and their beginnings of four to six letters,
hashed. The classifier is logistic regression on the features that tell the labels apart best. For
each labelled text a counterfactual is made: identity terms are swapped for others of their group,
and where a text names no group, one of its words becomes an identity term. The loss penalises the
squared change of the score from a text to its counterfactual, so that naming a group is neutral.

Training uses a bounded sample of labelled rows (SAMPLE, chosen by a hash of the id, expected size)
from the training folds; counts for the choice of features, the fit and the penalty all come from
it. Scoring reads every word of every document, with the weights, at most FEATURES numbers, shipped
to the tasks and a bounded memo from word to features.

Defined results: a null text counts as empty; an empty text has the score of the bias; several
labels of one document count as toxic if one does; without labels of both kinds the score is the
share of toxic labels (0 without any); repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_bucket, materialise, only_memo, text_of

#: Labelled rows that training uses, as an expected number, and features kept.
SAMPLE, FEATURES = 20_000, 8_192
#: Every id whose crc32 modulo FOLDS is 0 is held out.
FOLDS = 5
#: A feature counts if this many sampled texts have it.
LEAST_TEXTS = 3
#: and if its chi-squared statistic is at least this: few of a million chance features reach it.
LEAST_CHI = 20.0
#: Weights of the ridge and of the counterfactual penalty.
RIDGE, COUNTERFACTUAL = 1e-4, 0.5
#: Bytes, as estimated, of the tokens whose features a Python worker remembers.
MEMO_BYTES = 32 << 20
WORDS = re.compile(r"[^\W\d_]+")

#: Groups of identity terms that may replace each other.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "african", "arab", "latino", "european", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens", "natives"),
    ("disabled", "blind", "deaf", "elderly", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "atheisten"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
)
GROUP_OF = {t: g for g in IDENTITY_TERMS for t in g}
TERMS = tuple(dict.fromkeys(t for g in IDENTITY_TERMS for t in g))


def token_features(token: str) -> tuple[int, ...]:
    """Hashed features of the words in a lower-case token."""
    found = []
    for word in WORDS.findall(token):
        raw = word.encode()
        found.append(zlib.crc32(b"w" + raw))
        found += [zlib.crc32(b"p" + word[:n].encode()) for n in (4, 5, 6) if len(word) > n]
    return tuple(found)


def counterfactual(tokens: list[str], seed: int) -> list[str]:
    """The tokens with each identity term swapped for another of its group, or with one made from a word."""
    out, swapped = [], False
    for i, t in enumerate(tokens):
        word = t.strip(".,;:!?\"'()")
        if word in GROUP_OF:
            others = [x for x in GROUP_OF[word] if x != word]
            t, swapped = t.replace(word, others[(seed + i) % len(others)]), True
        out.append(t)
    if not swapped and out:
        out[seed % len(out)] = TERMS[seed // 7 % len(TERMS)]
    return out


def training_rows(df: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(toxic, ids, swapped): hashed features of sampled labelled texts and of their counterfactuals, written."""
    told = labels.where(F.col("toxic").isNotNull() & (id_bucket("doc_id", FOLDS) != 0)).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(told.count(), 1))
    # 2**20 steps of the hash; a hash of the id, so that reruns and every size agree.
    chosen = F.broadcast(told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))))  # about SAMPLE rows

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda tokens: np.array(sorted({f for t in set(tokens) for f in token_features(t)}), "<u4").tobytes()
        for part in parts:
            rows = []
            for i, toxic, text in zip(*(c.to_pylist() for c in part.columns)):
                tokens = text.lower().split()
                rows.append((toxic, pack(tokens), pack(counterfactual(tokens, zlib.crc32(str(i).encode())))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["toxic", "ids", "swapped"])

    texts = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    met = texts.join(chosen, "id").select("id", F.col("toxic").cast("int").alias("toxic"), "text")
    return materialise(met.mapInArrow(extract, "toxic int, ids binary, swapped binary"), "toxicity-rows")


def choose_features(rows: DataFrame, features: int) -> np.ndarray:
    """The hashed features with the largest chi-squared statistic, and those of the identity terms, sorted."""

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            toxic = np.array(part.column(0).to_pylist(), bool)
            sets = [np.frombuffer(b, "<u4") for b in part.column(1).to_pylist()]
            if not sets:
                continue
            ids, place = np.unique(np.concatenate(sets), return_inverse=True)
            n = np.bincount(place, minlength=len(ids))
            y = np.bincount(place, np.repeat(toxic, [len(s) for s in sets]), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype("i8")), pa.array(n), pa.array(y.astype("i8"))], names=["feature", "n", "y"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("y")).first()
    n, y = float(max(total["n"], 1)), float(total["y"])
    counts = rows.select("toxic", "ids").mapInArrow(tally, "feature bigint, n bigint, y bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    a, m = F.col("y").cast("double"), F.col("n").cast("double")
    chi = n * F.pow(a * n - m * y, 2) / (m * (n - m) * y * (n - y))
    best = counts.where((F.col("n") >= LEAST_TEXTS) & (F.col("n") < n) & (chi >= LEAST_CHI)).orderBy(F.desc(chi), "feature").limit(features).select("feature")  # a top-k report
    named = {f for t in TERMS for f in token_features(t)}
    return np.array(sorted({r[0] for r in best.collect()} | named), "i8")


def fit(rows: list, width: int, ridge: float = RIDGE, penalty: float = COUNTERFACTUAL, steps: int = 250) -> np.ndarray:
    """Weights and, last, the bias; rows are (toxic, features, swapped features) with places below width."""
    y = np.array([r[0] for r in rows], "f8")
    plain, swapped = [np.asarray(r[1], "i8") for r in rows], [np.asarray(r[2], "i8") for r in rows]

    def flat(sets):
        return np.concatenate([*sets, np.zeros(0, "i8")]).astype("i8"), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (xi, xr), (si, sr) = flat(plain), flat(swapped)
    n, w = len(rows), np.zeros(width + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    weight = np.where(y == 1, np.sqrt((1 - y.mean()) / y.mean()), 1.0)  # rare labels weigh more, clean texts are left alone
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(xr, w[xi], n) + w[-1]
        moved = z - (np.bincount(sr, w[si], n) + w[-1])
        g = weight * (1 / (1 + np.exp(-z)) - y) / n
        h = 2 * penalty * moved / n
        grad = np.append(np.bincount(xi, (g + h)[xr], width) - np.bincount(si, h[sr], width), g.sum())
        grad[:-1] += 2 * ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Classifier:
    """Scores texts; feature ids are sorted and weights stand in their order, the bias last."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.places = {int(f): float(w) for f, w in zip(features, weights)}
        self.bias, self.memo, self.held = float(weights[-1]), {}, 0

    def forget(self) -> None:
        self.memo, self.held = {}, 0

    def score(self, text: str) -> float:
        if self.held > MEMO_BYTES:
            self.forget()
        memo, active = self.memo, set()
        for token in set(text.lower().split()):
            known = memo.get(token)
            if known is None:
                known = memo[token] = tuple(f for f in token_features(token) if f in self.places)
                self.held += 150 + len(token)
            if known:
                active.update(known)
        z = self.bias + sum(self.places[f] for f in sorted(active))
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    rows = training_rows(df, labels, sample, id_col, text_col)
    share = rows.agg(F.avg("toxic")).first()[0]
    if not share or share == 1.0:
        z = 60.0 if share else -60.0
        return Classifier(np.zeros(0, "i8"), np.array([z]))
    chosen = choose_features(rows, features)

    def restrict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep(raw: bytes) -> np.ndarray:
            ids = np.frombuffer(raw, "<u4").astype("i8")
            at = np.searchsorted(chosen, ids).clip(max=len(chosen) - 1)
            return at[chosen[at] == ids].astype("i4")

        for part in parts:
            sets = [[keep(b) for b in part.column(c).to_pylist()] for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s, pa.list_(pa.int32())) for s in sets)], names=["toxic", "ids", "swapped"])

    few = rows.mapInArrow(restrict, "toxic int, ids array<int>, swapped array<int>").collect()  # about SAMPLE rows of chosen features
    few = sorted((r[0], sorted(r[1]), sorted(r[2])) for r in few)
    return Classifier(chosen, fit(few, len(chosen)))


def score(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns with held_out, score and predicted; every row, whole texts."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # at most FEATURES and the identity terms' weights

    def rate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = shipped.value
        only_memo(f"toxicity-{id(rater)}", rater.forget)
        for part in parts:
            scores = [rater.score(t or "") for t in part.column("__text").to_pylist()]
            kept = part.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], names=[*kept.schema.names, "__score"])

    bound_batches(df.sparkSession)
    told = df.select(*df.columns, (id_bucket(id_col, FOLDS) == 0).alias("__held"), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.drop("__text").schema)
    return told.mapInArrow(rate, f"{schema}, __score double")


def toxicity(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row of df."""
    rated = score(df.select(F.col(id_col).alias(id_col), text_of(text_col).alias("text")), train(df, labels, sample, features, id_col, text_col), id_col, "text")
    return rated.select(id_col, F.col("__held").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
