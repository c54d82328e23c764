"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes at most ``per_class`` labelled texts of each class, chosen by a hash of their id. Spark counts in how many
texts of each class every n-gram stands; the n-grams that separate the classes best by a two-proportion test, at most
``features``, are kept with their log-count ratio r. Each text is then the vector of r over the kept n-grams that it holds,
and a logistic regression with an L2 penalty is fitted to those vectors. Scoring looks at every n-gram of the whole text.

Defined results: null and empty texts hold no n-gram and get the score of the intercept; rows of ``labels`` that are null
or whose text is missing teach nothing, and an id labelled more than once counts as toxic if any label is; with no or one
class in the labels every text gets that share (0.0 without labels); texts of any length are scored whole, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_likely, slices
from .shingles import U, blocks, mix

SIZES = (4, 5)
_BASE = U(0x9FB21C651E98DF25)
_TABLE_BITS = 20


def ngrams(texts: list[str | None], sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the hashes of all n-grams of the lower-cased texts, and where each text's begin.

    Texts are set apart by a character that no n-gram of interest holds; hashes of n-grams that hold it are 0.
    """
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\x00".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    hashed, power, apart = code.copy(), U(1), code == 0
    for n in range(2, max(sizes) + 1):
        with np.errstate(over="ignore"):
            power = power * _BASE
        hashed = hashed[:-1] + code[n - 1 :] * power
        apart = apart[:-1] | (code[n - 1 :] == 0)
        if n in sizes:
            out = mix(hashed + U(n))
            out[apart] = 0
            yield out, begins


@dataclass
class Model:
    grams: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams >> U(64 - _TABLE_BITS)).astype(np.int64)] = True

    def held(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Which kept n-grams each text holds: pairs of text and n-gram index, each once."""
        keys = [np.zeros(0, dtype=np.int64)]
        for hashed, begins in ngrams(texts):
            at = np.flatnonzero(self.table[(hashed >> U(64 - _TABLE_BITS)).astype(np.int64)])
            if len(at) and len(self.grams):
                i = np.minimum(np.searchsorted(self.grams, hashed[at]), len(self.grams) - 1)
                same = self.grams[i] == hashed[at]
                keys.append((np.searchsorted(begins, at[same], side="right") - 1) * len(self.grams) + i[same])
        key = np.unique(np.concatenate(keys))
        return key // max(1, len(self.grams)), key % max(1, len(self.grams))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        row, gram = self.held(texts)
        z = self.bias + np.bincount(row, weights=self.weights[gram] if len(gram) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        sides = [np.concatenate([*(g for g, y in held if y == side), np.zeros(0, dtype=np.uint64)]) for side in (1, 0)]
        grams, where = np.unique(np.concatenate(sides), return_inverse=True)
        pos = np.bincount(where[: len(sides[0])], minlength=len(grams))
        neg = np.bincount(where[len(sides[0]) :], minlength=len(grams))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (grams.view(np.int64), pos, neg)], names=["gram", "pos", "neg"])

    held, n = [], 0
    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            for hashed, _ in ngrams([text]):
                g = np.unique(hashed[hashed != 0])
                held.append((g, y))
                n += len(g)
            if n > 1 << 22:
                yield emit(held)
                held, n = [], 0
    if held:
        yield emit(held)


def fit_logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, l2: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression on sparse rows, by accelerated gradient steps."""
    n = len(y)
    w, b = np.zeros(width), 0.0
    norm = np.bincount(row, weights=value**2, minlength=n)
    step = 1 / (0.25 * (float(np.mean(norm)) * 2 + 1) + l2)
    pw, pb, momentum = w, b, 1.0
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[col] * value, minlength=n)
        d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gw = np.bincount(col, weights=d[row] * value, minlength=width) / n + l2 * w
        nw, nb = w - step * gw, b - step * float(d.mean())
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        w, b = nw + (momentum - 1) / following * (nw - pw), nb + (momentum - 1) / following * (nb - pb)
        pw, pb, momentum = nw, nb, following
    return pw, float(pb)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, features: int = 2048, min_texts: int = 3, least_z: float = 4.0, l2: float = 3e-4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most about ``per_class`` texts of each class.

    The model has at most ``features`` n-grams: those held by ``min_texts`` sampled texts or more whose shares of both classes lie at least ``least_z`` standard
    errors apart, the farthest first. Without both classes every text scores near 0, or near 1 if all labels are toxic.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = np.zeros(0, dtype=np.uint64)
    if not (count.get(0) and count.get(1)):
        return Model(empty, np.zeros(0), 40.0 if count.get(1) else -40.0)
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / count[1])).otherwise(min(1.0, per_class / count[0]))
    chosen = known.where(draw < share)
    sample = keep_likely(texts, "id", chosen.select("id")).join(chosen, "id").select("text", "toxic").persist()
    drawn = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = drawn.get(1, 0), drawn.get(0, 0)
    if not (pos and neg):
        sample.unpersist()
        return Model(empty, np.zeros(0), 40.0 if pos else -40.0)
    grams = sample.mapInArrow(_count, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = F.col("pos") / pos, F.col("neg") / neg
    both = (F.col("pos") + F.col("neg")) / (pos + neg)
    spread = F.sqrt(both * (1 - both) * (1 / pos + 1 / neg) + 1e-12)
    ratio = F.log((F.col("pos") + 1) / (pos + 2)) - F.log((F.col("neg") + 1) / (neg + 2))
    kept = grams.where(F.col("pos") + F.col("neg") >= min_texts).select("gram", ratio.alias("r"), (F.abs(p - q) / spread).alias("z"))
    best = kept.where(F.col("z") >= least_z).orderBy(F.desc("z"), "gram").limit(features).collect()
    order = np.argsort(np.array([r["gram"] for r in best], dtype=np.int64).view(np.uint64))
    chosen_grams = np.array([r["gram"] for r in best], dtype=np.int64).view(np.uint64)[order]
    ratios = np.array([r["r"] for r in best])[order]
    model = Model(chosen_grams, ratios, 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch["text"].to_pylist()
            for a, b in blocks(texts_, 1 << 17):
                row, gram = model.held(texts_[a:b])
                parts = np.split(gram, np.searchsorted(row, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch["toxic"][a:b], pa.array([x.tolist() for x in parts], pa.list_(pa.int32()))], names=["toxic", "grams"])

    rows = sample.mapInArrow(vectors, "toxic int, grams array<int>").orderBy("toxic", "grams").collect()
    sample.unpersist()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    sizes = [len(r["grams"]) for r in rows]
    col = np.array([g for r in rows for g in r["grams"]], dtype=np.int64)
    w, bias = fit_logistic(np.repeat(np.arange(len(y)), sizes), col, ratios[col], y, len(ratios), l2)
    return Model(chosen_grams, w * ratios, bias)


def score_column(text: Column, model: Model) -> Column:
    """Double from 0 to 1: how likely the whole text is toxic."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(parts):
            texts = part.to_pylist()
            found = [model.scores(texts[a:b]) for a, b in blocks(texts, 1 << 17)]
            yield pa.array(np.concatenate([*found, np.zeros(0)]))

    return score.asNondeterministic()(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score column."""
    return docs.withColumn(out_col, score_column(F.col(text_col).cast("string"), model))
