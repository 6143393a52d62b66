"""Toxicity as an ordered severity, by cumulative-link regression on sparse text features.

    P(grade <= k | x) = logistic(theta_k - w . x),  theta_0 < theta_1 < ...

One weight vector serves all thresholds. Features are words (runs of letters, lower case) and their beginnings of 3 to 7
letters, and enter as log(1 + count). They are screened by the likelihood ratio of their document counts at a Bonferroni
level over all features of the sample, so a handful of labelled rows does not fit noise. The output is the expected severity, the median grade and P(grade > 0).

Labels with two values only (toxic 0/1) are graded 0, and 1 or 2 for toxic documents, crosswise: labelled documents fall into
two halves by a hash of their id, features are screened in each half alone, and a toxic document is graded 2 where features
of the other half occur more often than in the median toxic document that has any. So no document's grade comes from the
features that its own label has chosen. Any column of grades 0, 1, 2 ... can be given instead.

The model is fitted on a hashed sample of about MAX_LABELLED labelled rows where there are more; scoring covers the whole text
of every document. Features of the sample stay on the executors; the driver gets, for each document of the sample, the counts
of the features that passed. Nulls and empty texts have no features; with no labels, or labels of one kind, all severities
are 0. Labels of unknown ids and null labels are left out; an id labelled twice counts with its highest grade, and of several
texts of one id the greatest is taken. Ties in probability go to the lower grade. Very long texts are read whole. Repeated
rows get equal scores; an empty table gives an empty result. Other columns than doc_id and text are neither read nor returned,
so clashing names do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, stored, whole_text

WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows used for fitting, about.
MAX_LABELLED = 20_000
#: Words whose features a worker keeps at hand.
KEPT_WORDS = 100_000
LEVEL, RIDGE, ROUNDS = 0.05, 0.02, 300


BEGINNINGS = range(3, 8)


def features(text: str) -> Counter:
    """Counts of the words, and of beginnings of longer words."""
    words = Counter(WORDS.findall(text.lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        """P(grade = k) for each k, by row."""
        below = 1 / (1 + np.exp(-(np.array(self.thresholds)[None, :] - margin[:, None])))
        edges = np.concatenate([np.zeros((len(margin), 1)), below, np.ones((len(margin), 1))], axis=1)
        return np.diff(edges, axis=1)


def _differs(a: Column, b: Column, n1: int, n0: int, features_seen: int, level: float = LEVEL) -> Column:
    """Whether document counts a of n1 and b of n0 differ beyond chance, by the likelihood ratio. A chi-square variable with
    one degree of freedom exceeds x with a probability below exp(-x / 2)."""

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / expected)).otherwise(0.0)

    share = (a + b) / (n1 + n0)
    ratio = 2 * (part(a, share * n1) + part(n1 - a, (1 - share) * n1) + part(b, share * n0) + part(n0 - b, (1 - share) * n0))
    return ratio > 2 * float(np.log(max(1, features_seen) / level))


@dataclass
class Sparse:
    """Counts of chosen features by document: entries (row, column, value)."""

    rows: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * weights[self.column], minlength=self.rows)

    def transposed_times(self, x: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * x[self.row], minlength=columns)


def graded(counts: Sparse, toxic: np.ndarray, half: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0 and 1; chosen: which columns were screened in each half."""
    found = np.zeros(counts.rows)
    for k in (0, 1):
        found = np.where(half == k, counts.times(chosen[1 - k].astype(float)), found)
    some = toxic & (found > 0)
    middle = np.median(found[some]) if some.any() else 0
    return np.where(toxic, 1 + (found > middle), 0)


def fit(counts: Sparse, grades: np.ndarray, words: list[str]) -> Model:
    """Weights and thresholds by gradient descent (Adam) on the penalised likelihood; features enter as log(1 + count)."""
    top = int(grades.max(initial=0))
    if not words or top == 0:
        return Model({}, [np.inf] * max(1, top))
    x = Sparse(counts.rows, counts.row, counts.column, np.log1p(counts.value))
    weight = np.full(len(grades), 1 / len(grades))
    # thresholds as a first value and positive steps
    p = np.concatenate([np.zeros(len(words)), [0.0], np.zeros(top - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, ROUNDS + 1):
        w, steps = p[: len(words)], np.exp(p[len(words) + 1 :])
        theta = p[len(words)] + np.concatenate([[0.0], np.cumsum(steps)])
        margin = x.times(w)
        hi = np.where(grades < top, sigmoid(np.append(theta, np.inf)[np.minimum(grades, top)] - margin), 1.0)
        lo = np.where(grades > 0, sigmoid(np.insert(theta, 0, -np.inf)[grades] - margin), 0.0)
        own = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / own, lo * (1 - lo) / own
        g_theta = np.array([(-weight * d_hi)[grades == k].sum() + (weight * d_lo)[grades == k + 1].sum() for k in range(top)])
        g_w = x.transposed_times(weight * (d_hi - d_lo), len(words)) + RIDGE * w / len(words)
        g = np.concatenate([g_w, [g_theta.sum()], [g_theta[k + 1 :].sum() * steps[k] for k in range(top - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = p[len(words)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(words) + 1 :]))])
    return Model({w: float(b) for w, b in zip(words, p, strict=False)}, theta.tolist())


def trained(docs: DataFrame, labels: DataFrame, grade: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """The model from labelled documents. labels holds doc_id and the grade; the bound on rows also bounds what is collected."""
    spark = docs.sparkSession
    given = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    if (n := given.count()) > max_labelled:
        # a hash draws the sample where the rows are; no task gets more of them than its share
        given = given.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [features(t) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([list(c) for c in rows], pa.list_(pa.string())), pa.array([list(c.values()) for c in rows], pa.list_(pa.int32()))],
                    names=["doc_id", "grade", "half", "words", "counts"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # the bound on labelled rows is also the bound of what is broadcast here
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(given), "doc_id").groupBy("doc_id", "grade").agg(F.max("text").alias("text"))
    sample = sample.select("doc_id", "grade", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "text")
    rows = stored(sample.mapInArrow(lean(bags), f"doc_id {kind}, grade int, half int, words array<string>, counts array<int>"), "toxicity-sample")
    sizes = {(r["half"], r["yes"]): r["n"] for r in rows.groupBy("half", (F.col("grade") > 0).alias("yes")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = ([sizes.get((k, yes), 0) for k in (0, 1)] for yes in (True, False))
    if not sum(n1) or not sum(n0):
        return Model({}, [np.inf])
    flat = rows.select("half", (F.col("grade") > 0).alias("yes"), F.explode("words").alias("word"))
    seen = lambda yes, *halves: F.sum(((F.col("yes") == yes) & F.col("half").isin(*halves)).cast("double"))
    by_word = stored(flat.groupBy("word").agg(*(seen(yes, k).alias(f"{name}{k}") for yes, name in ((True, "a"), (False, "b")) for k in (0, 1))), "toxicity-words")
    total = by_word.count()
    a, b = (F.col(f"{x}0") + F.col(f"{x}1") for x in "ab")
    screened = by_word.select("word", _differs(a, b, sum(n1), sum(n0), total).alias("chosen"), *(_differs(F.col(f"a{k}"), F.col(f"b{k}"), n1[k], n0[k], total).alias(f"chosen{k}") if n1[k] and n0[k] else F.lit(False).alias(f"chosen{k}") for k in (0, 1)))
    found = screened.where("chosen or chosen0 or chosen1").orderBy("word").collect()  # features that pass the screening, a few
    place = spark.sparkContext.broadcast({r["word"]: i for i, r in enumerate(found)})

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for batch in batches:
            own = [[(known[w], n) for w, n in zip(words, counts, strict=True) if w in known] for words, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([[i for i, _ in x] for x in own], pa.list_(pa.int32())), pa.array([[n for _, n in x] for x in own], pa.list_(pa.int32()))],
                names=["grade", "half", "columns", "counts"],
            )

    table = rows.orderBy("doc_id").select("grade", "half", "words", "counts").mapInArrow(lean(picked), "grade int, half int, columns array<int>, counts array<int>").toArrow()
    columns, values = (table.column(k).combine_chunks() for k in ("columns", "counts"))
    grades, half = (table.column(k).to_numpy().astype(int) for k in ("grade", "half"))
    counts = Sparse(table.num_rows, np.repeat(np.arange(table.num_rows), np.diff(columns.offsets.to_numpy())), columns.flatten().to_numpy(), values.flatten().to_numpy().astype(float))
    if grades.max(initial=0) == 1:
        grades = graded(counts, grades > 0, half, [np.array([r[f"chosen{k}"] for r in found], bool) for k in (0, 1)])
    # the model's own features are those of both halves together
    own = np.array([r["chosen"] for r in found], bool)
    kept = own[counts.column]
    moved = np.cumsum(own) - 1
    return fit(Sparse(counts.rows, counts.row[kept], moved[counts.column[kept]], counts.value[kept]), grades, [r["word"] for r in found if r["chosen"]])


def severity(docs: DataFrame, model: Model, reject_at: float = 0.4) -> DataFrame:
    """doc_id, severity (the expected grade), grade, p_toxic, rejected for each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as many weights as words passed the screening of a bounded sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = m.weights
        known: dict[str, list[str]] = {}

        def known_in(word: str) -> list[str]:
            """Features of a word that have a weight; kept for words seen lately."""
            if (f := known.get(word)) is None:
                f = [x for x in (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)) if x in weights]
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[word] = f
            return f

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                margin = np.zeros(part.num_rows)
                for i, text in enumerate(part.column(1).to_pylist()):
                    if own := Counter(chain.from_iterable(map(known_in, WORDS.findall(text.lower())))):
                        margin[i] = sum(weights[w] * np.log1p(n) for w, n in sorted(own.items()))
                p = m.probabilities(margin)
                expected = p @ np.arange(p.shape[1])
                toxic = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array((np.cumsum(p, axis=1) < 0.5).sum(axis=1).clip(0, p.shape[1] - 1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= reject_at)], names=["doc_id", "severity", "grade", "p_toxic", "rejected"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(lean(run), f"doc_id {kind}, severity double, grade int, p_toxic double, rejected boolean")
