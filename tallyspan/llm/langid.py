"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

A text is the vector of square roots of the shares of its hashed character 1- to 3-grams; letters are lower-cased, and
every run of other characters counts as one gap. Training takes at most ``per_language`` texts of each language and ``total``
texts in all, chosen by a hash of their id. The family is the one with the largest margin among one-versus-rest linear
SVMs; in a family of several languages each pair has an SVM, and most votes, then the larger sum of margins, then the
alphabet decide.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts if no language
was learned; with one learned language every other text is of that language. Texts of any length are read whole, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import U, blocks, mix

#: Families of some languages by ISO code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
}
CELLS = 1 << 12
_BASE = U(0x9FB21C651E98DF25)
_LETTER = regex.compile(r"\p{L}")
_GAP = regex.compile(r"[^\p{L}\p{M}]+")


def vectors(texts: list[str]) -> np.ndarray:
    """One row of length 1 for each text. Long texts are summed over parts."""
    out = np.zeros((len(texts), CELLS), dtype=np.float32)
    spans = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t)), 1 << 17)]
    parts = [texts[i][max(0, a - 2) : a + (1 << 17)].lower() for i, a in spans]
    for lo, hi in blocks(parts, 1 << 17):
        clean = [" " + _GAP.sub(" ", p) + " " for p in parts[lo:hi]]
        code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        owner = np.repeat(np.arange(hi - lo), [len(c) for c in clean])
        grams, power, total = code.copy(), U(1), np.zeros((hi - lo) * CELLS, dtype=np.int64)
        for n in (1, 2, 3):
            if n > 1:
                with np.errstate(over="ignore"):
                    power = power * _BASE
                grams = grams[:-1] + code[n - 1 :] * power
            cell = (mix(grams + U(n)) >> U(52)).astype(np.int64) + owner[: len(grams)] * CELLS
            inside = owner[: len(grams)] == owner[n - 1 :]
            if n == 1:
                inside = inside & (code != 32)
            total += np.bincount(cell[inside], minlength=len(total))
        np.add.at(out, [i for i, _ in spans[lo:hi]], total.reshape(-1, CELLS).astype(np.float32))
    share = out / np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(share)


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 120) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge loss, classes weighted equally) by accelerated gradient steps; y is -1 or 1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    pw, pb, momentum = w, b, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w + b)).astype(np.float32)
        d = -2 * share * y * slack
        nw, nb = w - 0.25 * (x.T @ d.astype(np.float32) + l2 * w), b - 0.25 * float(d.sum())
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        w, b = nw + np.float32((momentum - 1) / following) * (nw - pw), nb + (momentum - 1) / following * (nb - pb)
        pw, pb, momentum = nw, nb, following
    return pw, float(pb)


@dataclass
class Model:
    families: list[list[str]]
    outer: list[tuple[np.ndarray, float]]  # by family, empty if there is one
    inner: list[dict[tuple[int, int], tuple[np.ndarray, float]]]  # by family, by pair of its languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x = vectors(texts)
        some = np.array([i for i, t in enumerate(texts) if self.families and _LETTER.search(t)], dtype=np.int64)
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not len(some):
            return lang, score
        x = x[some]
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -40, 40)))
        margins = np.stack([x @ w + b for w, b in self.outer], axis=1) if self.outer else np.ones((len(x), 1))
        family = margins.argmax(axis=1)
        trust = sure(margins.max(axis=1))
        for f, names in enumerate(self.families):
            own = np.flatnonzero(family == f)
            votes, sums = np.zeros((len(own), len(names))), np.zeros((len(own), len(names)))
            for (i, j), (w, b) in self.inner[f].items():
                m = x[own] @ w + b
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                sums[:, i] += m
                sums[:, j] -= m
            best = np.array([max(range(len(names)), key=lambda k, r=r: (votes[r, k], sums[r, k], -k)) for r in range(len(own))], dtype=np.int64)
            for r, k in zip(own.tolist(), best.tolist()):
                lang[some[r]] = names[k]
            inside = sure(sums[np.arange(len(own)), best] / max(1, len(names) - 1)) if len(names) > 1 else np.ones(len(own))
            score[some[own]] = trust[own] * inside
        return lang, score


def train(docs: DataFrame, per_language: int = 500, total: int = 3000, families: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most about min(per_language, total / languages) texts of each language that has a name and texts."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return Model([], [], [])
    cap = min(per_language, max(2, total // len(count)))
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, cap / n)) for k, n in sorted(count.items())])
    draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in blocks(texts, 1 << 17):
                yield pa.RecordBatch.from_arrays([batch["lang"][a:b], pa.array([v.astype("<f2").tobytes() for v in vectors(texts[a:b])], pa.binary())], names=["lang", "x"])

    found = rows.where(draw < share).select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], dtype="<f2") for r in found]).astype(np.float32) if found else np.zeros((0, CELLS), dtype=np.float32)
    lang = np.array([r["lang"] for r in found])
    of = {code: name for name, codes in (families or FAMILIES).items() for code in codes.split()}
    groups: dict[str, list[str]] = {}
    for code in sorted(set(lang.tolist())):
        groups.setdefault(of.get(code.lower().split("-")[0], "own " + code), []).append(code)
    names = [groups[g] for g in sorted(groups)]
    outer = [fit_svm(x, np.where(np.isin(lang, f), 1.0, -1.0)) for f in names] if len(names) > 1 else []
    inner = []
    for f in names:
        pairs = {}
        for i in range(len(f)):
            for j in range(i + 1, len(f)):
                own = np.isin(lang, [f[i], f[j]])
                pairs[i, j] = fit_svm(x[own], np.where(lang[own] == f[i], 1.0, -1.0))
        inner.append(pairs)
    return Model(names, outer, inner)


def predict_column(text: Column, model: Model) -> Column:
    """struct<lang_pred: string, score: double>."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(parts):
            texts = [t or "" for t in part.to_pylist()]
            lang, score = [], [np.zeros(0)]
            for a, b in blocks(texts, 1 << 17):
                names, s = model.predict(texts[a:b])
                lang += names
                score.append(s)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score))], names=["lang_pred", "score"])

    return predict.asNondeterministic()(text)


def predict(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """docs with a struct column (lang_pred, score)."""
    return docs.withColumn(out_col, predict_column(F.col(text_col).cast("string"), model))
