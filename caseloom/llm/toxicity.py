"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < 2: P(grade > j) = sigmoid(w.x - theta_j), one weight vector w
for both ordered thresholds theta_0 < theta_1. Features are sparse: the distinct words
of the whole text (lower case, outer punctuation stripped) and their prefixes of 3, 4, 5
and 6 letters, marked by "^". The model is fitted on a bounded sample of labelled rows
(`fit_rows`, a documented parameter); every document is then scored, on its whole text, in
one scan.

Grades come from the labels alone: 0 where toxic is 0, 1 where it is 1, and 2 where it is 1
and quality is 0.

Features of the sample are counted in Spark. The driver gets one signature of each row of
the sample (to leave out near copies of rows of the same grade, whose features would count as
evidence twice), the chosen features, at most MOST_FEATURES, and for each row the numbers of
those it has. No text reaches it.

Features: those whose toxic rate is above the base rate by `min_z` standard scores more
than chance would give to the best of as many features; the rest carry no weight. This
keeps long clean texts at the intercept.

Defined results: null or empty text has no features and gets the intercept's severity;
repeated rows are scored alike; with no labelled rows, or labels of one kind, every
severity is 0; an empty table gives an empty result. `toxicity` adds severity, grade and
toxic in place of columns of these names; `judged` keeps all columns. Names that begin with
"__" are reserved.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import PandasUDFType

from caseloom.llm import minhash_near
from caseloom.session import materialize, tidy

FIT_ROWS = 12_000  # most labelled documents that the model is fitted on
MIN_Z, MOST_FEATURES = 2.0, 2000
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.25  # expected severity from which a document is rejected
_edges = re.compile(r"^[\W_]+|[\W_]+$")


def words(text: str | None) -> set[str]:
    return {w for w in {_edges.sub("", x) for x in set((text or "").lower().split())} if w}


def features(text: str | None) -> set[str]:
    ws = words(text)
    out = set(ws)
    for n in PREFIXES:
        out |= {"^" + w[:n] for w in ws if len(w) >= n}
    return out


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thetas: tuple[float, ...] = (math.inf, math.inf)

    def severity(self, text: str | None) -> tuple[float, int]:
        """Expected grade, and the grade that is most probable."""
        if not self.weights:
            return 0.0, 0
        get, s = self.weights.get, 0.0
        for w in sorted(words(text)):
            s += get(w, 0.0)
        for p in sorted({"^" + w[:n] for w in words(text) for n in PREFIXES if len(w) >= n}):
            s += get(p, 0.0)
        above = [1 / (1 + math.exp(min(700.0, t - s))) for t in self.thetas]
        chance = [1 - above[0], *[a - b for a, b in zip(above, above[1:], strict=False)], above[-1]]
        return sum(above), int(np.argmax(chance))


def losses(s: np.ndarray, thetas: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log likelihood of grades at scores s, and its gradients by s and thetas."""
    n = len(s)
    up = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(s[:, None] - thetas[None, :], -40, 40))), np.zeros(n)])
    hi, lo = up[np.arange(n), grades], up[np.arange(n), grades + 1]
    p = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g_t = np.array([(d_hi * weight)[grades == j + 1].sum() - (d_lo * weight)[grades == j].sum() for j in range(len(thetas))])
    return float(-(weight * np.log(p)).sum()), -(d_hi - d_lo) * weight, g_t


def fit_cumulative_link(rows: list[list[int]], grades: np.ndarray, width: int, classes: int = 3, l2: float = 1e-5, steps: int = 3000, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient descent with momentum on the mean
    negative log likelihood, in which grade 0 and the grades above it weigh alike; each
    weight's step is divided by a bound of its row of the Hessian. Weights stay at 0 or
    above, as features are chosen as evidence of toxicity. Thresholds are theta_0 and positive gaps (as logarithms)."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate([np.asarray(r, "i8") for r in rows]) if rows else np.zeros(0, "i8")
    w, base, gaps = np.zeros(width), 1.0, np.zeros(classes - 2)
    vel = [np.zeros(width), 0.0, np.zeros(classes - 2)]
    n = len(rows)
    n_low = int((grades == 0).sum())
    weight = np.where(grades == 0, 0.5 / max(1, n_low), 0.5 / max(1, n - n_low))
    width_of = np.bincount(owner, minlength=n)
    share = np.bincount(index, (weight * width_of)[owner], width) / 4 + 1e-4  # bounds the Hessian's row
    for _ in range(steps):
        thetas = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(owner, w[index], n)
        _, g_s, g_t = losses(s, thetas, grades, weight)
        g_w = (np.bincount(index, g_s[owner], width) + l2 * w) / share
        g_base = g_t.sum()
        g_gaps = np.array([np.exp(gaps[j]) * g_t[j + 1 :].sum() for j in range(classes - 2)])
        for k, g in enumerate((g_w, 4 * g_base, g_gaps)):
            vel[k] = 0.9 * vel[k] - rate * g
        w, base, gaps = np.maximum(0, w + vel[0]), base + vel[1], np.clip(gaps + vel[2], -5, 5)
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def without_copies(signatures: list[list[int] | None], grades: list[int], same: float = 0.8, band: int = 4) -> list[int]:
    """Rows that are no near copies of an earlier one of their grade: features of one copied
    text must not count as evidence twice. Rows that agree in `band` neighbouring minhashes are
    compared on all of them, whose share of agreement estimates the Jaccard similarity."""
    seen: dict[tuple, list[int]] = {}
    held = [None if s is None else np.asarray(s) for s in signatures]
    out = []
    for k, (s, grade) in enumerate(zip(held, grades, strict=True)):
        own = [] if s is None else s.tolist()
        marks = [(grade, j, *own[j : j + band]) for j in range(0, len(own) - band + 1, band)]
        hits = {x for m in marks for x in seen.get(m, ())}
        if not any((held[x] == s).mean() >= same for x in hits):
            out.append(k)
            for m in marks:
                seen.setdefault(m, []).append(k)
    return out


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, __grade) of documents with a label; of several labels, the gravest."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(grade).alias("__grade"))


def sample_features(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(row, grade, sig, feats) of at most fit_rows labelled documents, those with the least hash
    of their id, so that the sample doesn't depend on partitions. Rows of one text are one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 100):
                rows = []
                for row, grade, text in pdf.iloc[at : at + 100].itertuples(index=False):
                    own = sorted(features(text))
                    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), "u8", len(own))
                    rows.append((row, grade, minhash_near.signature(hashes) if own else None, own))
                yield pd.DataFrame(rows, columns=["row", "grade", "sig", "feats"])

    least = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(least), "doc_id")  # at most fit_rows pairs of numbers
    once = picked.select(F.xxhash64("doc_id", "text").alias("row"), F.col("__grade").alias("grade"), "text").dropDuplicates(["row"])
    return once.mapInPandas(tidy(run), "row long, grade int, sig array<int>, feats array<string>")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, min_z: float = MIN_Z, most: int = MOST_FEATURES) -> OrdinalModel:
    stored = materialize(sample_features(docs, labels, fit_rows), "toxicity-sample")
    rows = sorted(map(tuple, stored.select("grade", "row", "sig").toLocalIterator()))
    rows = [rows[k] for k in without_copies([r[2] for r in rows], [r[0] for r in rows])]
    n, n_pos = len(rows), sum(g > 0 for g, _, _ in rows)
    if not 0 < n_pos < n:
        return OrdinalModel()
    kept = docs.sparkSession.createDataFrame(pa.table({"row": pa.array([r for _, r, _ in rows], pa.int64())}))  # an Arrow table needs no Python workers of its own
    used = stored.select("row", "grade", "feats").join(F.broadcast(kept), "row")  # at most fit_rows numbers
    counts = used.select((F.col("grade") > 0).cast("int").alias("pos"), F.explode("feats").alias("f")).groupBy("f").agg(F.sum("pos").alias("c"), F.count(F.lit(1)).alias("m"))
    counts = materialize(counts.where("c > 0"), "toxicity-features")
    rate = n_pos / n
    bound = min_z + math.sqrt(2 * math.log(max(1, counts.count())))  # the most that chance gives among so many
    z = (F.col("c") - F.col("m") * rate) / F.sqrt(F.col("m") * rate * (1 - rate))
    best = counts.withColumn("z", z).where((F.col("z") >= bound) & (F.col("c") / F.col("m") >= 0.6)).orderBy(F.desc("z"), "f").limit(most)
    chosen = {r["f"]: k for k, r in enumerate(best.collect())}  # at most `most` rows

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "grade": pdf["grade"], "index": [sorted(chosen[f] for f in own if f in chosen) for own in pdf["feats"]]})

    sparse = sorted((r["row"], r["grade"], r["index"]) for r in used.select("row", "grade", "feats").mapInPandas(numbers, "row long, grade int, index array<int>").toLocalIterator())
    w, thetas = fit_cumulative_link([list(r[2]) for r in sparse], np.array([r[1] for r in sparse]), len(chosen))
    thetas = thetas + max(0.0, math.log((n - n_pos) / n_pos))  # from grades that weigh alike back to the sample's rates
    return OrdinalModel({f: float(w[k]) for f, k in chosen.items()}, tuple(float(t) for t in thetas))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with a struct __tox: severity (expected grade, six places) and grade."""
    kind = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType())])

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [model.severity(t) for t in texts]
            yield pd.DataFrame({"severity": [round(s, 6) for s, _ in got], "grade": [g for _, g in got]})

    return docs.withColumn("__tox", F.pandas_udf(tidy(judge), kind, PandasUDFType.SCALAR_ITER)("text"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a struct __tox: severity and grade."""
    return score(docs, fit(docs, labels))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with severity, grade and toxic (severity >= threshold)."""
    out = judged(docs.drop("severity", "grade", "toxic"), labels)
    severity = F.col("__tox.severity")
    return out.select(*[c for c in out.columns if c != "__tox"], severity.alias("severity"), F.col("__tox.grade").alias("grade"), (severity >= threshold).alias("toxic"))
