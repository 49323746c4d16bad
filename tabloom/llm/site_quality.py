"""Quality classifier with hierarchical empirical Bayes over sites.

A document's evidence comes from two logistic models over its text, one for quality and one for
toxicity, fitted on a bounded sample of labelled rows.  The evidence of all documents is added up
by path and by host.  A host's posterior is its mean shrunk toward the global mean, a path's is its
mean shrunk toward its host's; the weights of the priors follow from the variances between hosts, between
the paths of a host and within paths, estimated from the same sums by the method of moments (the
nested analysis of variance for groups of unequal size).  A document's final log-odds are its own plus
those by which its path (without the document itself) differs from the global prior, so a site can
save a doubtful document as well as condemn it; only what is taken as toxic isn't saved.

Only sums per host and path are shuffled, after partial aggregation; they are joined back by a
broadcast if there are few enough, else by a shuffle in which the largest sites stay apart.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import cut, join_hot, ship

SAMPLE_ROWS = 4_000
EPOCHS = 30
BROADCAST_SITES = 20_000
SITE_WEIGHT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 5.0, 1e6
#: A text counts as toxic from these log-odds on: letting one through costs more than losing a clean one.
TOXIC_LOGIT = -0.5
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
LONG_TEXT = 1_000_000
WORD_FEATURES = 400
LEAST_CHI2 = 24.0
LEAST_ROWS = 4
PREFIX = 4
DENSE = 64
RIDGE = 0.5


def features(text: str | None) -> tuple[np.ndarray, dict[str, float]]:
    """The whole text's shape, in numbers of order one, and its tokens' values.

    A token that is there has the value 1.  The first PREFIX letters of tokens, marked by ``^``, have
    DENSE times their share of all tokens, at most 1: a text that keeps coming back to a stem differs
    from a long one that holds it once.
    """
    shape = np.zeros(9)
    shape[0] = 1.0
    if not text:
        return shape, {}
    found = Counter(_WORD.findall(text) if len(text) < LONG_TEXT else (m.group() for m in _WORD.finditer(text)))
    if not found:
        return shape, {}
    n = letters = shouted = length = marks = long_marks = 0
    folded: Counter[str] = Counter()
    for token, k in found.items():
        n += k
        folded[sys.intern(token.lower())] += k
        if token[0].isalpha():
            letters, length = letters + k, length + k * len(token)
            shouted += k * (len(token) > 1 and token.isupper())
        elif not token[0].isalnum():
            marks, long_marks = marks + k, long_marks + k * (len(token) > 1)
    shape[1] = shouted / max(1, letters)
    shape[2] = marks / n
    shape[3] = long_marks / n
    shape[4] = (n - letters - marks) / n
    shape[5] = len(folded) / n
    shape[6] = min(1.0, math.log1p(n) / 10)
    shape[7] = length / max(1, letters) / 10
    shape[8] = (text.count("\n") + 1) / n
    stems: Counter[str] = Counter()
    for token, k in folded.items():
        stems["^" + token[:PREFIX]] += k
    values = dict.fromkeys(folded, 1.0)
    values.update((sys.intern(stem), min(1.0, DENSE * k / n)) for stem, k in stems.items())
    return shape, values


class Logistic:
    """A ridge logistic model over the shape, its squares, and the presence of picked tokens."""

    def __init__(self, weights: np.ndarray, vocabulary: list[str], offset: float):
        self.weights, self.vocabulary, self.offset = weights, vocabulary, offset
        self.places = {w: 17 + k for k, w in enumerate(vocabulary)}
        self.picked = set(vocabulary)

    @staticmethod
    def _dense(shape: np.ndarray) -> np.ndarray:
        return np.concatenate([shape, shape[1:] ** 2])

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, dict[str, float]]], labels: np.ndarray) -> Logistic:
        """Tokens are picked by the chi-squared statistic of the documents in which they have at least half
        their full value, in either class."""
        positive, negative = Counter(), Counter()
        for (_, values), y in zip(rows, labels):
            (positive if y else negative).update([w for w, v in values.items() if v >= 0.5])
        n, p = len(labels), float(labels.sum())
        scored = []
        for word in positive.keys() | negative.keys():
            a, b = positive[word], negative[word]
            if a + b < LEAST_ROWS or not 0 < p < n:
                continue
            c, d = p - a, n - p - b
            scored.append((n * (a * d - b * c) ** 2 / (p * (n - p) * (a + b) * max(c + d, 1e-9)), word))
        vocabulary = [w for x, w in sorted(scored, key=lambda s: (-s[0], s[1]))[:WORD_FEATURES] if x >= LEAST_CHI2]
        model = cls(np.zeros(17 + len(vocabulary)), vocabulary, 0.0)
        x = np.zeros((n, 17 + len(vocabulary)))
        for k, (shape, values) in enumerate(rows):
            x[k, :17] = cls._dense(shape)
            for word in values.keys() & model.picked:
                x[k, model.places[word]] = values[word]
        share = (p + 1) / (n + 2)
        cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        pull = np.full(x.shape[1], RIDGE)
        pull[:17] = 0.05
        weights = np.zeros(x.shape[1])
        for _ in range(EPOCHS):  # Newton steps
            fitted = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (cost * (fitted - labels)) + pull * weights
            bend = (x * (cost * np.maximum(fitted * (1 - fitted), 1e-6))[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(bend, slope)
            weights = weights - step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-6:
                break
        model.weights = weights
        return model

    def logit(self, row: tuple[np.ndarray, dict[str, float]]) -> float:
        shape, values = row
        total = self.offset + float(self.weights[:17] @ self._dense(shape))
        # In the order of the vocabulary, so that reruns add up alike.
        known = sorted(values.keys() & self.picked, key=self.places.__getitem__)
        return max(-12.0, min(12.0, total + sum(float(self.weights[self.places[w]]) * values[w] for w in known)))


def _score_task(models):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = models.value
        for batch in batches:
            good, bad = [], []
            for text in batch.column(0):
                row = features(text.as_py())
                good.append(fitted[0].logit(row) if fitted else 0.0)
                bad.append(fitted[1].logit(row) if fitted else -50.0)
            columns = [*batch.columns[1:], pa.array(good, pa.float64()), pa.array(bad, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "quality_logit", "toxic_logit"])

    return score


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def score_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, carry: list[str]) -> DataFrame:
    """(row, host, path, quality_logit, toxic_logit, p) for every row; ``row`` has the columns to carry."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"),
        F.max("toxic").alias("toxic"))
    # A bounded sample of labelled rows, the same at every run: those of the smallest hashes.
    known = known.withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    picked = known.orderBy("h", "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality", "toxic", "h").agg(F.min("text").alias("text")).orderBy("h",
        "doc_id").limit(SAMPLE_ROWS)
    # The driver may not hold thousands of whole texts: one task fits, a batch of texts at a time, and returns
    # the weights.
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            rows += [features(t.as_py()) for t in batch.column("text")]
            labels += zip(batch.column("quality").to_pylist(), batch.column("toxic").to_pylist())
        if rows:
            made = [Logistic.fit(rows, np.array([float(y[k] == 1) for y in labels])) for k in (0, 1)]
            yield pa.RecordBatch.from_pydict({"k": pa.array([0, 1], pa.int32()), "vocabulary": [json.dumps(m.vocabulary) for m in made],
                "weights": pa.array([m.weights.astype("<f8").tobytes() for m in made], pa.binary())})

    fitted = sample.coalesce(1).mapInArrow(fit, "k int, vocabulary string, weights binary").orderBy("k").collect()
    models = spark.sparkContext.broadcast(tuple(Logistic(np.frombuffer(bytes(r["weights"]), "<f8"), json.loads(r["vocabulary"]), 0.0) for r in fitted) or None)

    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = docs.select(F.col("text").cast("string").alias("text"), row, F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("quality_logit", T.DoubleType()), T.StructField("toxic_logit", T.DoubleType())])
    scored = rows.mapInArrow(_score_task(models), schema)
    return scored.withColumn("p", _sigmoid(F.col("quality_logit")) * (1 - _sigmoid(F.col("toxic_logit"))))


def _strength(between: float, within: float) -> float:
    """The prior's weight, in documents: the variance within groups over that between their true means."""
    return max(LEAST_STRENGTH, min(MOST_STRENGTH, within / between if between > 0 else MOST_STRENGTH))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Sums and shrunken means by (host, path): path_n, path_sum, host_n, host_sum, host_mean, path_strength,
    host_strength, global_mean."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_sum"),
        F.sum(F.col("p") * F.col("p")).alias("path_sq")), "paths")
    squares = F.sum(F.col("path_n").cast("double") * F.col("path_n")).alias("host_squares")
    hosts = cut(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"), F.count("*").alias("host_paths"), squares), "hosts")
    joined = cut(join_hot(paths, hosts, "host", "host_paths"), "nested")
    path_mean, host_mean = F.col("path_sum") / F.col("path_n"), F.col("host_sum") / F.col("host_n")
    by_path = joined.agg(
        F.sum("path_n").alias("n"), F.count("*").alias("paths"), F.sum("path_sum").alias("s"),
        F.sum(F.col("path_sq") - F.col("path_sum") * path_mean).alias("inside"),
        F.sum(F.col("path_n") * F.pow(path_mean - host_mean, 2)).alias("between"),
    ).first()
    n = float(by_path["n"] or 0)
    mean = by_path["s"] / n if n else 0.5
    by_host = hosts.agg(
        F.count("*").alias("hosts"), F.sum(F.col("host_n") * F.pow(host_mean - mean, 2)).alias("between"),
        F.sum(F.col("host_squares") / F.col("host_n")).alias("nested"), F.sum("host_squares").alias("path_squares"),
        F.sum(F.col("host_n").cast("double") * F.col("host_n")).alias("host_squares"),
    ).first()
    path_strength = host_strength = LEAST_STRENGTH
    if n:
        count, groups = by_path["paths"], by_host["hosts"]
        within = max(by_path["inside"] / max(n - count, 1.0), 1e-9)
        spread = lambda total, noise, size: max(0.0, total - noise) / size if size > 1e-9 * n else 0.0
        of_paths = spread(by_path["between"], (count - groups) * within, n - by_host["nested"])
        noise = (groups - 1) * within + of_paths * (by_host["nested"] - by_host["path_squares"] / n)
        of_hosts = spread(by_host["between"], noise, n - by_host["host_squares"] / n)
        path_strength, host_strength = _strength(of_paths, within), _strength(of_hosts, within)
    shrunk = (F.col("host_sum") + F.lit(host_strength * mean)) / (F.col("host_n") + F.lit(host_strength))
    out = joined.select("host", "path", "path_n", "path_sum", "path_sq", "host_n", "host_sum", shrunk.alias("host_mean"))
    return out.withColumn("path_strength", F.lit(path_strength)).withColumn("host_strength", F.lit(host_strength)).withColumn("global_mean", F.lit(mean))


def classify_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """(row, host, path, doc_score, host_posterior, path_posterior, quality_score, kept, ...) per row.

    ``row`` is a struct of the columns to carry (doc_id alone unless told otherwise), so that no
    name of theirs can clash.
    ``docs`` has doc_id and text; ``host`` and ``path`` default to its column ``source`` and to that
    with its ``lang``.  ``labels`` has doc_id, quality and toxic (1 or 0); rows with a null in them
    aren't used, repeated ids count as their worst.  At most SAMPLE_ROWS labelled documents, those
    of the smallest id hashes, are fitted on; everything else covers all rows.

    ``doc_score`` is the probability of good and not toxic from the text alone; ``quality_score``
    adds the site's evidence; ``kept`` says that it is at least 0.5, and that the text's own toxicity is
    below TOXIC_LOGIT.  A null or empty text has an empty
    feature list and is judged by shape and site.  Null hosts and paths count as ''.  Without labels
    every score is that of a prior of a half, and every row is kept.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))) if path is None else path
    scored = cut(score_documents(docs, labels, host, path, carry or ["doc_id"]), "scored")
    sites = cut(site_posteriors(scored), "sites")
    few = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    d = scored.join(F.broadcast(sites), ["host", "path"]) if few else join_hot(scored, sites, ["host", "path"], "path_n")
    # Without the document itself: its own evidence must not count twice.
    own = F.col("p")
    host_mean = (F.col("host_sum") - own + F.col("host_strength") * F.col("global_mean")) / (F.col("host_n") - 1 + F.col("host_strength"))
    path_mean = (F.col("path_sum") - own + F.col("path_strength") * host_mean) / (F.col("path_n") - 1 + F.col("path_strength"))
    final = _logit(own) + SITE_WEIGHT * (_logit(path_mean) - _logit(F.col("global_mean")))
    kept = (_sigmoid(final) >= 0.5 - 1e-9) & (F.col("toxic_logit") < TOXIC_LOGIT)
    return d.select("row", "host", "path", own.alias("doc_score"), host_mean.alias("host_posterior"), path_mean.alias("path_posterior"),
        _sigmoid(final).alias("quality_score"), kept.alias("kept"), "quality_logit", "toxic_logit")


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    names = docs.columns
    judged = classify_quality(docs, labels, host, path, carry=names)
    return judged.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in names])
