"""Toxicity grades by cumulative-link ordinal regression on words and word beginnings.

P(grade <= k) = logistic(threshold_k - score), with one weight a feature shared by all thresholds; a text's score is
the sum of the weights of its distinct words and of each one's first letters. The result is the expected severity, the
sum over k of P(grade > k). Only features that go with a grade beyond chance enter, and the fit minimises the negative
log-likelihood with an L1 penalty (accelerated proximal gradient), so long clean texts do not add up noise.

Labels give three grades: 0 not toxic, 1 toxic, 2 toxic in a text of low quality. The model is fitted on a bounded
sample (``FIT_ROWS`` labelled documents, those of the smallest hashed id); scoring covers all documents and whole texts.

Cases: a null or empty text scores 0; labels with a null grade or without a document are left out; a grade nobody has
costs nothing; without labels, or with one grade only, nothing is toxic; ids may repeat or be null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coding import Recent, release
from .common import documents, narrow, ship
from .registry import query

#: labelled documents the model is fitted on, at most
FIT_ROWS = 8_000
#: documents of the sample that must have a feature
LEAST_DOCS = 3
#: how much less likely than one in all features a feature's agreement with a grade must be by chance (natural logarithm)
CERTAIN = 3.0
#: share of the sample's clean texts that the dividing score may lose
MOST_WRONGED = 0.001
PENALTY = 4e-4
STEPS = 500
GRADES = 3
CACHE = 300_000
PREFIXES = (4, 5)
NOT_WORD = re.compile(r"[\W_]+")


def words_of(text: str) -> set[str]:
    return set(NOT_WORD.sub(" ", text.lower()).split())


def features_of(words: set[str]) -> set[str]:
    """Words, and beginnings marked by a star; a word shorter than a beginning has none."""
    return words.union(w[:n] + "*" for w in words for n in PREFIXES if len(w) > n)


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]
    #: texts of at least this score are toxic
    cut: float

    def score(self, words: set[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features_of(words))

    def severity(self, score):
        return sum(1 / (1 + np.exp(np.clip(t - np.asarray(score, float), -500, 500))) for t in self.thresholds)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str]]:
    """(grade, text) of at most ``rows`` documents."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    some = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = narrow(docs, id_col, text_col).join(F.broadcast(some), "doc_id")
    ship(docs.sparkSession)

    def shortened(batches):
        # what the fit needs of a text: each word once
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([" ".join(sorted(words_of(t))) for t in batch.column(2).to_pylist()], pa.string())], ["doc_id", "grade", "text"])

    lists = found.select("doc_id", "grade", "text").mapInArrow(shortened, "doc_id long, grade int, text string")
    return [(r["grade"], r["text"]) for r in lists.orderBy("doc_id", "text").limit(rows).collect()]


def fit(rows: list[tuple[int, str]], grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS, least: int = LEAST_DOCS) -> Model:
    """Accelerated proximal gradient; thresholds are kept in order by fitting the logarithms of their distances."""
    y = np.array([g for g, _ in rows], int)
    if len(set(y.tolist())) < 2:
        return Model({}, [40.0] * (grades - 1), np.inf)
    # features as numbers from the start: as texts they would take many times the memory
    number: dict[str, int] = {}
    lists = []
    for _, text in rows:
        found = features_of(set(text.split()))
        lists.append(np.fromiter((number.setdefault(f, len(number)) for f in found), np.int32, len(found)))
    often = np.bincount(np.concatenate(lists), minlength=len(number)) >= least
    names = sorted(f for f, i in number.items() if often[i])
    place = np.full(len(number), -1, np.int32)
    place[[number[f] for f in names]] = np.arange(len(names), dtype=np.int32)
    del number
    lists = [np.sort(x[x >= 0]) for x in (place[x] for x in lists)]
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    col = np.concatenate(lists)
    # of very many features some go with a grade by chance: only those stay for which chance is out of the question
    seen = np.bincount(col, minlength=len(names))
    telling = np.zeros(len(names), bool)
    for k in range(1, grades):
        share = (y >= k).mean()
        if 0 < share < 1:
            with_it = np.bincount(col, (y >= k)[row], len(names))
            gain = _entropy_terms(with_it, seen * share) + _entropy_terms(seen - with_it, seen * (1 - share))
            telling |= gain > np.log(max(len(names), 1)) + CERTAIN
    if not telling.any():
        return Model({}, [40.0] * (grades - 1), np.inf)
    names = [f for f, keep in zip(names, telling.tolist()) if keep]
    place = np.cumsum(telling) - 1
    part = telling[col]
    row, col = row[part], place[col[part]]
    n, m = len(lists), len(names)
    # each feature scaled by its frequency: rare telling ones move as fast as common ones
    scale = np.minimum(1 / np.sqrt(np.maximum(1, np.bincount(col, minlength=m)) / n), np.sqrt(n / 20))
    share = np.cumsum(np.bincount(y, minlength=grades)[:grades])[:-1] + 0.5
    logit = np.log(share / (n + 1 - share))
    theta = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 0.05))])
    weights, active = np.zeros(m), np.zeros(m, bool)
    while True:
        # features the penalty holds at zero have a small gradient; only the others enter the fit, until none is left out
        of_score = _loss(np.bincount(row, (scale * weights)[col], n), y, theta, grades)[1]
        slope = np.abs(np.bincount(col, of_score[row], m)) * scale
        entering = ~active & (slope > penalty * scale * 1.001)
        if not entering.any():
            break
        ranked = np.argsort(np.where(entering, slope / (penalty * scale), 0))[::-1][:max(200, int(active.sum()))]
        active[ranked[entering[ranked]]] = True
        chosen = np.flatnonzero(active)
        place = np.full(m, -1)
        place[chosen] = np.arange(len(chosen))
        part = place[col] >= 0
        w, theta = _solve(row[part], place[col[part]], scale[chosen], y, grades, theta, weights[chosen], penalty, steps)
        weights[:] = 0
        weights[chosen] = w
    kept = np.flatnonzero(weights)
    return Model({names[i]: float(weights[i] * scale[i]) for i in kept}, _cuts(theta).tolist(), _dividing(np.bincount(row, (scale * weights)[col], n), y > 0))


def _dividing(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score that divides the sample with the fewest errors while hardly a clean text is lost, half way between its neighbours."""
    order = np.argsort(score, kind="stable")
    s, t = score[order], toxic[order]
    # when the first i are called clean: toxic ones among them, and clean ones behind
    missed = np.concatenate([[0], np.cumsum(t)])
    wronged = (~t).sum() - np.concatenate([[0], np.cumsum(~t)])
    possible = np.concatenate([[True], s[1:] > s[:-1], [True]]) & (wronged <= MOST_WRONGED * (~t).sum())
    errors = missed + wronged
    best = np.flatnonzero(possible & (errors == errors[possible].min()))
    i = int(best[len(best) // 2])
    return float((s[max(i - 1, 0)] + s[min(i, len(s) - 1)]) / 2) if 0 < i < len(s) else float(s[-1] + 1 if i else s[0])


def _entropy_terms(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.where(found > 0, found * np.log(np.maximum(found, 1) / np.maximum(expected, 1e-300)), 0.0)


def _cuts(theta: np.ndarray) -> np.ndarray:
    return np.concatenate([theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))])


def _loss(score: np.ndarray, y: np.ndarray, theta: np.ndarray, grades: int):
    """Mean negative log-likelihood, its slope by each text's score and by theta."""
    n, cuts = len(y), _cuts(theta)
    up = np.concatenate([cuts, [500.0]])[y] - score
    down = np.concatenate([[-500.0], cuts])[y] - score
    a, b = 1 / (1 + np.exp(-np.clip(up, -500, 500))), 1 / (1 + np.exp(-np.clip(down, -500, 500)))
    p = np.maximum(a - b, 1e-12)
    da, db = a * (1 - a) / p, b * (1 - b) / p
    of_cut = np.array([(db[y == k + 1].sum() - da[y == k].sum()) / n for k in range(grades - 1)])
    # a slight pull on the distances places the thresholds of grades nobody has
    of_theta = np.concatenate([[of_cut.sum()], [of_cut[j:].sum() * np.exp(theta[j]) + 1e-3 * theta[j] for j in range(1, grades - 1)]])
    return -np.log(p).mean() + 5e-4 * (theta[1:] ** 2).sum(), (da - db) / n, of_theta


def _solve(row, col, scale, y, grades, theta, start, penalty, steps):
    """Weights of the chosen features and thresholds, from the ones given."""
    n, m, value = len(y), len(scale), scale[col]
    w = v = start
    th = u = theta
    rate, k, before = 1.0, 1.0, np.inf
    for _ in range(steps):
        f, of_score, gt = _loss(np.bincount(row, value * v[col], n), y, u, grades)
        g = np.bincount(col, of_score[row] * value, m)
        while True:
            step = v - rate * g
            new, new_th = np.sign(step) * np.maximum(np.abs(step) - rate * penalty * scale, 0), u - rate * gt
            dw, dt = new - v, new_th - u
            now = _loss(np.bincount(row, value * new[col], n), y, new_th, grades)[0]
            if now <= f + g @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * rate) + 1e-12 or rate < 1e-8:
                break
            rate /= 2
        total = now + penalty * (scale * np.abs(new)).sum()
        if total > before:
            k = 1.0  # restart the acceleration
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v, u = new + (k - 1) / nk * (new - w), new_th + (k - 1) / nk * (new_th - th)
        if abs(before - total) < 1e-9:
            break
        w, th, k, before, rate = new, new_th, nk, total, rate * 1.1
    return w, th


def scorer(m: Model):
    """Scores of a list of texts."""
    get = m.weights.get
    # a word carries its own weight and, apart, those of its beginnings, which count once a text
    own = Recent(lambda ws: [(get(w, 0.0), tuple(p for n in PREFIXES if len(w) > n and (p := w[:n] + "*") in m.weights)) for w in ws], CACHE)

    def scores_of(texts: list[str]) -> list[float]:
        scores = []
        for text in texts:
            found = own.values(list(words_of(text)))
            beginnings = {p for _, ps in found if ps for p in ps}
            scores.append(sum(x for x, _ in found) + sum(map(get, beginnings)))
        return scores

    return scores_of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, score, severity, grade (the nearest), toxic."""
    ship(docs.sparkSession)
    # features with a weight: fewer than the words of the sample, whatever the number of documents
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def graded(batches):
        release()
        m = shared.value
        scores_of = scorer(m)
        for batch in batches:
            scores = scores_of(batch.column(1).to_pylist())
            severity = m.severity(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(severity, pa.float64()), pa.array(np.rint(severity).astype(np.int32))], ["doc_id", "score", "severity", "grade"])

    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(graded, "doc_id long, score double, severity double, grade int").withColumn("toxic", F.col("score") >= model.cut)


def grade(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **columns: str) -> DataFrame:
    return score(docs, fit(labelled(docs, labels, rows, **columns)), **columns)


def clean(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text isn't toxic, with all their columns; a row without text stays."""
    ship(docs.sparkSession)
    model = fit(labelled(docs, labels, rows, id_col=id_col, text_col=text_col))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def passed(batches):
        release()
        scores_of = scorer(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = scores_of(["" if t is None else t for t in texts])
            yield batch.filter(pa.array([t is None or x < shared.value.cut for t, x in zip(texts, scores)], pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)


@query("op9_toxicity")
def op9(spark, sf_dir):
    return grade(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
