"""Out-of-fold model fitting and scoring with Spark ML.

The contract is the protocol (what is fitted on which folds) and the score
schema, not bit-equal scores. Feature tables hold one row per user with scalar
columns and ``ARRAY<FLOAT>`` blocks. Fold sizes and class counts come from one
aggregate with a row per fold and label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions import numeric as N
from ..functions import vectors as V
from ..functions.labels import NEGATIVE, NO_EVIDENCE, POSITIVE, TERNARY
from ..functions.text import blank_to_space
from ..session import written
from . import fold_fits
from .metrics import fold_average
from .selection import align_scores


@dataclass(frozen=True)
class Candidate:
    """A model to fit: family, feature blocks and settings.

    ``vectors`` are array columns (each reduced by PCA), ``scalars`` numeric columns.
    Families: ``logreg``, ``boost``, ``trees``, ``mlp``, ``focal``, ``hierarchical``, ``baseline``.
    """

    model_id: str
    family: str = "logreg"
    vectors: tuple[str, ...] = ()
    scalars: tuple[str, ...] = ()
    pca: int = 80
    seed: int = 42
    params: dict = field(default_factory=dict)


Counts = dict[str, int]


def fold_counts(train: DataFrame, label: str = "label", fold: str = "fold") -> dict[int, Counts]:
    """Rows per fold and label."""
    out: dict[int, Counts] = {}
    for r in train.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r[fold], {})[r[label]] = r["n"]
    return out


def _total(counts: dict[int, Counts], without: Sequence[int] = ()) -> Counts:
    total: Counts = {}
    for fold, per in counts.items():
        if fold not in without:
            for label, n in per.items():
                total[label] = total.get(label, 0) + n
    return total


def class_weight(label: Column, counts: Counts, classes: int, power: int = 1) -> Column:
    """Balanced weight n / (classes * count), raised to ``power``."""
    n = sum(counts.values())
    out = F.lit(1.0)
    for name, c in counts.items():
        out = F.when(label == name, F.lit((n / (classes * max(c, 1))) ** power)).otherwise(out)
    return out


def _code(label: Column, classes: Sequence[str]) -> Column:
    out = F.lit(None).cast("double")
    for i, name in enumerate(classes):
        out = F.when(label == name, F.lit(float(i))).otherwise(out)
    return out


def prepare_features(df: DataFrame, candidate: Candidate) -> DataFrame:
    """Blocks as ML vectors, NaN and NULL as 0."""
    def clean(c: Column) -> Column:
        return F.transform(c, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))

    out = df.withColumns({f"__v_{v}": array_to_vector(clean(F.col(v))) for v in candidate.vectors})
    if candidate.scalars:
        values = F.array(*[F.coalesce(F.nanvl(F.col(s).cast("double"), F.lit(0.0)), F.lit(0.0)) for s in candidate.scalars])
        out = out.withColumn("__s", array_to_vector(values))
    return out


def feature_stages(candidate: Candidate, rows: int, dims: dict[str, int]) -> list:
    """PCA per vector block, concatenation, standardisation; fitted on training folds only."""
    stages, parts = [], []
    for v in candidate.vectors:
        k = min(candidate.pca, rows - 1, dims[v])
        if k < 1:
            raise ValueError(f"{candidate.model_id}: too few rows for PCA of {v}")
        stages.append(PCA(k=k, inputCol=f"__v_{v}", outputCol=f"__p_{v}"))
        parts.append(f"__p_{v}")
    if candidate.scalars:
        parts.append("__s")
    stages.append(VectorAssembler(inputCols=parts, outputCol="__raw"))
    stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return stages


def vector_dims(df: DataFrame, candidate: Candidate) -> dict[str, int]:
    """Length of each vector block, from one row."""
    if not candidate.vectors:
        return {}
    row = df.select(*[F.size(v).alias(v) for v in candidate.vectors]).first()
    return row.asDict()


def _width(candidate: Candidate, rows: int, dims: dict[str, int]) -> int:
    return sum(min(candidate.pca, rows - 1, dims[v]) for v in candidate.vectors) + len(candidate.scalars)


def estimator(candidate: Candidate, rows: int, width: int, classes: int = 2):
    """Spark ML estimator of a family; the L2 strength 1/(C n) matches a summed loss with C."""
    p = candidate.params
    common = {"featuresCol": "features", "labelCol": "__y"}
    if candidate.family == "logreg":
        return LogisticRegression(
            **common,
            weightCol="__w",
            maxIter=int(p.get("max_iter", 1000)),
            regParam=1.0 / (float(p.get("c", 1.0)) * rows),
            elasticNetParam=0.0,
            standardization=False,
            family="binomial" if classes == 2 else "multinomial",
        )
    if candidate.family == "boost":
        return GBTClassifier(
            **common,
            weightCol="__w",
            maxIter=int(p.get("rounds", 250)),
            maxDepth=int(p.get("max_depth", 3)),
            stepSize=float(p.get("learning_rate", 0.05)),
            subsamplingRate=float(p.get("subsample", 0.85)),
            featureSubsetStrategy=str(p.get("columns", 0.85)),
            minInstancesPerNode=int(p.get("min_leaf", 2)),
            seed=candidate.seed,
        )
    if candidate.family == "trees":
        return RandomForestClassifier(
            **common,
            weightCol="__w",
            numTrees=int(p.get("trees", 400)),
            maxDepth=int(p.get("max_depth", 5)),
            minInstancesPerNode=int(p.get("min_leaf", 10)),
            seed=candidate.seed,
        )
    if candidate.family == "mlp":
        return MultilayerPerceptronClassifier(**common, layers=[width, int(p.get("hidden", 32)), classes], maxIter=int(p.get("max_iter", 500)), seed=candidate.seed)
    raise ValueError(f"unsupported family: {candidate.family}")


@dataclass
class Fitted:
    """Fitted features and model; ``constant`` stands in when only one class was seen."""

    candidate: Candidate
    features: PipelineModel | None = None
    model: object | None = None
    constant: float | None = None
    weights: np.ndarray | None = None

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the positive probability."""
        if self.constant is not None:
            return df.withColumn(name, F.lit(self.constant))
        if self.candidate.family == "baseline":
            return df.withColumn(name, N.clean_score("evidence_score"))
        ready = self.features.transform(prepare_features(df, self.candidate))
        if self.weights is not None:
            logit = linear_logits("features", self.weights)[0]
            scored = ready.withColumn("__p", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
        else:
            scored = self.model.transform(ready).withColumn("__p", vector_to_array("probability")[1])
        return scored.select(*df.columns, N.clean_score("__p").alias(name))


def fit_binary(train: DataFrame, candidate: Candidate, counts: Counts, label: str = "label", power: int = 1) -> Fitted:
    """Fit one binary model on all rows of ``train``."""
    present = [c for c in (NEGATIVE, POSITIVE) if counts.get(c, 0) > 0]
    if candidate.family == "baseline":
        return Fitted(candidate)
    if len(present) < 2:
        return Fitted(candidate, constant=1.0 if present == [POSITIVE] else 0.0)
    rows = sum(counts.values())
    dims = vector_dims(train, candidate)
    ready = prepare_features(train, candidate).withColumn("__y", _code(F.col(label), (NEGATIVE, POSITIVE))).withColumn("__w", class_weight(F.col(label), counts, 2, power))
    stages = feature_stages(candidate, rows, dims)
    if candidate.family == "focal":
        features = Pipeline(stages=stages).fit(ready)
        weights = fit_focal(features.transform(ready), 1, **candidate.params)
        return Fitted(candidate, features, weights=weights)
    features = Pipeline(stages=stages).fit(ready)
    model = estimator(candidate, rows, _width(candidate, rows, dims)).fit(features.transform(ready))
    return Fitted(candidate, features, model)


# --- focal loss ----------------------------------------------------------------------


def linear_logits(features: str, weights: np.ndarray, limit: float = 30.0) -> list[Column]:
    """Clipped linear scores of an ML vector column; ``weights`` has a bias as last entry per class."""
    x = vector_to_array(features)
    out = []
    for row in np.atleast_2d(weights):
        w = F.array(*[F.lit(float(v)) for v in row[:-1]])
        dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        out.append(N.clamp(dot + F.lit(float(row[-1])), -limit, limit))
    return out


def focal_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, params: np.ndarray, gamma: float, limit: float = 30.0) -> np.ndarray:
    """Summed gradient of the focal loss: one logit (binary) or one per class."""
    z = x @ params[:, :-1].T + params[:, -1]
    open_ = (np.abs(z) < limit).astype(float)
    z = np.clip(z, -limit, limit)
    if params.shape[0] == 1:
        p = 1.0 / (1.0 + np.exp(-z[:, 0]))
        loss = np.where(y > 0.5, np.logaddexp(0.0, -z[:, 0]), np.logaddexp(0.0, z[:, 0]))
        pt = np.exp(-loss)
        slope = w * (gamma * np.power(np.maximum(1 - pt, 1e-12), gamma - 1) * pt * loss + np.power(1 - pt, gamma))
        d = (slope * (p - y))[:, None]
    else:
        soft = np.exp(z - z.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        hot = np.eye(params.shape[0])[y.astype(int)]
        loss = -w * np.log(np.maximum((soft * hot).sum(axis=1), 1e-300))
        pt = np.exp(-loss)
        slope = w * (gamma * np.power(np.maximum(1 - pt, 1e-12), gamma - 1) * pt * loss + np.power(1 - pt, gamma))
        d = slope[:, None] * (soft - hot)
    d = d * open_
    return np.hstack([d.T @ x, d.sum(axis=0)[:, None]])


def _partial_gradients(params: np.ndarray, gamma: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(params), 0
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["x"].to_numpy())
                total += focal_gradient(x, pdf["y"].to_numpy(), pdf["w"].to_numpy(), params, gamma)
                n += len(pdf)
        if n:
            yield pd.DataFrame({"g": [total.ravel().tolist()], "n": [n]})

    return run


def fit_focal(
    ready: DataFrame,
    outputs: int = 1,
    gamma: float = 1.0,
    epochs: int = 250,
    learning_rate: float = 3e-4,
    weight_decay: float = 1e-4,
    clip_norm: float | None = None,
) -> np.ndarray:
    """Linear model under focal loss: full-batch AdamW from zero.

    Per epoch each task sums its gradient, Spark adds the sums up, and the
    driver sees one vector of the model's size.
    """
    data = ready.select(vector_to_array("features").alias("x"), F.col("__y").alias("y"), F.col("__w").alias("w")).persist()
    try:
        width = len(data.first()["x"])
        params = np.zeros((outputs, width + 1))
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, epochs + 1):
            parts = data.mapInPandas(_partial_gradients(params, gamma), "g array<double>, n bigint")
            row = parts.agg(vector_to_array(Summarizer.mean(array_to_vector("g"))).alias("g"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
            grad = np.asarray(row["g"]).reshape(params.shape) * row["k"] / row["n"]
            if not np.all(np.isfinite(grad)):
                raise RuntimeError("focal fit produced a non-finite gradient")
            if clip_norm is not None:
                grad *= min(1.0, clip_norm / (np.linalg.norm(grad) + 1e-6))
            params *= 1 - learning_rate * weight_decay
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            params -= learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return params
    finally:
        data.unpersist()


# --- out-of-fold loops ---------------------------------------------------------------


def oof_scores(train: DataFrame, candidate: Candidate, label: str = "label", key: str = "user_id", power: int = 1, counts: dict[int, Counts] | None = None) -> DataFrame:
    """Fit on the other folds, score the held-out fold: ``user_id, label, fold, score, model_id``."""
    counts = counts or fold_counts(train, label)

    def scored_fold(fold: int) -> DataFrame:
        per_fold = Candidate(**{**candidate.__dict__, "seed": candidate.seed + fold})
        fitted = fit_binary(train.where(F.col("fold") != fold), per_fold, _total(counts, [fold]), label, power)
        scored = fitted.score(train.where(F.col("fold") == fold))
        return scored.select(key, F.col(label).alias("label"), "fold", "score", F.lit(candidate.model_id).alias("model_id"))

    # The folds are fitted side by side, as a cross-validator does: the many short jobs of one leave cores idle.
    with ThreadPoolExecutor(len(counts)) as pool:
        parts = list(pool.map(inheritable_thread_target(train.sparkSession)(scored_fold), sorted(counts)))
    return reduce(DataFrame.unionByName, parts)


def fit_full(train: DataFrame, candidate: Candidate, label: str = "label", power: int = 1) -> Fitted:
    return fit_binary(train, candidate, _total(fold_counts(train, label)), label, power)


def score_test(fitted: Fitted, test: DataFrame, key: str = "user_id") -> DataFrame:
    """Label-free test scores; label columns are not even selected."""
    inputs = [key, *fitted.candidate.vectors, *fitted.candidate.scalars]
    if fitted.candidate.family == "baseline":
        inputs.append("evidence_score")
    return fitted.score(test.select(*dict.fromkeys(inputs))).select(key, "score", F.lit(fitted.candidate.model_id).alias("model_id"))


def fold_model_scores(train: DataFrame, test: DataFrame, candidate: Candidate, label: str = "label", key: str = "user_id") -> DataFrame:
    """Mean test score of the fold models."""
    counts = fold_counts(train, label)
    parts = []
    for fold in sorted(counts):
        fitted = fit_binary(train.where(F.col("fold") != fold), candidate, _total(counts, [fold]), label)
        parts.append(score_test(fitted, test, key).withColumn("fold", F.lit(fold)))
    return fold_average(reduce(DataFrame.unionByName, parts), len(counts), (key, "model_id"))


def paired_oof(train: DataFrame, candidate: Candidate, labels: Sequence[str], key: str = "user_id") -> DataFrame:
    """Same folds, features and model for several label columns; ``target`` names the column."""
    parts = [oof_scores(train, candidate, label, key).withColumn("target", F.lit(label)) for label in labels]
    return reduce(DataFrame.unionByName, parts)


def _stack_table(scores: DataFrame, models: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, tuple[str, ...]]:
    names = tuple(f"s_{m}" for m in models)
    aligned = align_scores(scores, models, keep=keep)
    return aligned.select("user_id", *keep, *[F.col("scores")[i].alias(n) for i, n in enumerate(names)]), names


def _raw_stack(candidate: Candidate, names: tuple[str, ...]) -> Candidate:
    return Candidate(**{**candidate.__dict__, "scalars": names, "vectors": ()})


def stack_oof(scores: DataFrame, models: Sequence[str], candidate: Candidate, power: int = 2) -> DataFrame:
    """Stacking on out-of-fold scores. ``power`` 2 keeps the doubled class weighting of the plain stackers."""
    table, names = _stack_table(scores, sorted(models), ("label", "fold"))
    # Every fold counts, fits and scores these rows, so the scores are aligned once.
    return oof_scores(written(table), _raw_stack(candidate, names), power=power)


def stack_test(train_scores: DataFrame, test_scores: DataFrame, models: Sequence[str], candidate: Candidate, power: int = 2) -> DataFrame:
    """Final stack: fit on all out-of-fold scores, score the label-free test scores."""
    table, names = _stack_table(train_scores, sorted(models), ("label", "fold"))
    table = written(table)
    test, _ = _stack_table(test_scores, sorted(models), ())
    return score_test(fit_full(table, _raw_stack(candidate, names), power=power), test)


def nested_stack(train: DataFrame, bases: Sequence[Candidate], meta: Candidate, label: str = "label", key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Strict nested stacking: meta features never come from a model that saw the row's fold.

    Returns the out-of-fold scores and provenance rows
    ``outer_fold, inner_validation_fold, base_model_id, fit_folds``.
    """
    # The operands of all bases side by side, each once.
    scalars = list(dict.fromkeys(c for base in bases for c in base.scalars))
    vectors = list(dict.fromkeys(v for base in bases for v in base.vectors))
    dims = train.select(*[F.size(v).alias(v) for v in vectors]).first().asDict() if vectors else {}
    starts, at = {}, len(scalars)
    for v in vectors:
        starts[v], at = at, at + dims[v]
    flat = train.select(key, label, "fold", *scalars, *[F.col(v)[i].alias(f"__{v}_{i}") for v in vectors for i in range(dims[v])])
    names = [*scalars, *[f"__{v}_{i}" for v in vectors for i in range(dims[v])]]
    packed = [
        fold_fits.Base(
            b.model_id,
            b.family,
            tuple(scalars.index(c) for c in b.scalars),
            tuple((tuple(range(starts[v], starts[v] + dims[v])), b.pca) for v in b.vectors),
            dict(b.params),
            b.seed,
        )
        for b in bases
    ]
    if any(b.vectors and b.family not in ("logreg", "mlp") for b in bases):
        raise ValueError("tree models take number columns only")
    scores, records = fold_fits.nested_scores(train.sparkSession, fold_fits.pack(flat, POSITIVE, names, key, label), packed, float(meta.params.get("c", 1.0)))
    spark = train.sparkSession
    provenance = spark.createDataFrame(records, "outer_fold INT, inner_validation_fold INT, base_model_id STRING, fit_folds ARRAY<INT>")
    shown = F.when(F.col("y") == 1, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))
    key_type = train.schema[key].dataType
    return scores.select(F.col("key").cast(key_type).alias(key), shown.alias("label"), "fold", N.clean_score("score").alias("score"), F.lit(meta.model_id).alias("model_id")), provenance


# --- ternary -------------------------------------------------------------------------


def fit_ternary(train: DataFrame, candidate: Candidate, counts: Counts, label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """Fit a three-class model; returns a function that adds the three probabilities."""
    if candidate.family == "baseline":
        return lambda df: _with_probabilities(df, N.baseline_probabilities("evidence_score"))
    present = [c for c in TERNARY if counts.get(c, 0) > 0]
    if len(present) == 1:
        constant = [F.lit(1.0 if c == present[0] else 1e-9) for c in TERNARY]
        return lambda df: _with_probabilities(df, N.clean_probabilities(*constant))
    if candidate.family == "hierarchical":
        return _fit_hierarchical(train, candidate, counts, label)
    if candidate.family == "boost":
        return _fit_one_vs_rest(train, candidate, counts, label)
    rows = sum(counts.values())
    dims = vector_dims(train, candidate)
    ready = prepare_features(train, candidate).withColumn("__y", _code(F.col(label), TERNARY)).withColumn("__w", class_weight(F.col(label), counts, 3))
    features = Pipeline(stages=feature_stages(candidate, rows, dims)).fit(ready)
    if candidate.family == "focal":
        weights = fit_focal(features.transform(ready), 3, **candidate.params)

        def score_focal(df: DataFrame) -> DataFrame:
            logits = linear_logits("features", weights)
            scored = features.transform(prepare_features(df, candidate)).withColumns({f"__e{i}": F.exp(z) for i, z in enumerate(logits)})
            return _with_probabilities(scored, N.clean_probabilities(*[F.col(f"__e{i}") / (F.col("__e0") + F.col("__e1") + F.col("__e2")) for i in range(3)]), df.columns)

        return score_focal
    model = estimator(candidate, rows, _width(candidate, rows, dims), 3).fit(features.transform(ready))

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(features.transform(prepare_features(df, candidate)))
        p = vector_to_array("probability")
        # A class that did not occur in training has no entry.
        return _with_probabilities(scored, N.clean_probabilities(*[F.coalesce(F.get(p, i), F.lit(0.0)) for i in range(3)]), df.columns)

    return score


def _with_probabilities(df: DataFrame, probabilities: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    names = ("prob_diagnosed", "prob_control", "prob_no_evidence")
    return df.select(*(keep or df.columns), *[p.alias(n) for p, n in zip(probabilities, names)])


def _binary_view(df: DataFrame, positive: Column) -> DataFrame:
    return df.withColumn("__binary", F.when(positive, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE)))


def _fit_hierarchical(train: DataFrame, candidate: Candidate, counts: Counts, label: str) -> Callable[[DataFrame], DataFrame]:
    """P(positive) from the binary label, then P(diagnosed | positive) on the positive rows."""
    linear = Candidate(**{**candidate.__dict__, "family": "logreg"})
    positive = F.col(label) != NEGATIVE
    d, c, n = (counts.get(x, 0) for x in (POSITIVE, NEGATIVE, NO_EVIDENCE))
    first = fit_binary(_binary_view(train, positive), linear, {POSITIVE: d + n, NEGATIVE: c}, "__binary")
    gate_rows = _binary_view(train.where(positive), F.col(label) == POSITIVE)
    if d + n == 0:
        gate = Fitted(linear, constant=0.0)
    else:
        gate = fit_binary(gate_rows, linear, {POSITIVE: d, NEGATIVE: n}, "__binary")

    def score(df: DataFrame) -> DataFrame:
        scored = gate.score(first.score(df, "__pos"), "__gate")
        return _with_probabilities(scored, N.gated_probabilities("__pos", "__gate"), df.columns)

    return score


def _fit_one_vs_rest(train: DataFrame, candidate: Candidate, counts: Counts, label: str) -> Callable[[DataFrame], DataFrame]:
    """One boosted model per class, normalised."""
    n = sum(counts.values())
    fits = {}
    for name in TERNARY:
        c = counts.get(name, 0)
        fits[name] = fit_binary(_binary_view(train, F.col(label) == name), candidate, {POSITIVE: c, NEGATIVE: n - c}, "__binary")

    def score(df: DataFrame) -> DataFrame:
        scored = df
        for i, name in enumerate(TERNARY):
            scored = fits[name].score(scored, f"__p{i}")
        return _with_probabilities(scored, N.clean_probabilities("__p0", "__p1", "__p2"), df.columns)

    return score


def ternary_oof(train: DataFrame, candidate: Candidate, policy_id: str, label: str = "label", key: str = "user_id") -> DataFrame:
    """Out-of-fold probabilities with the score schema of a label policy."""
    counts = fold_counts(train, label)
    parts = []
    for fold in sorted(counts):
        score = fit_ternary(train.where(F.col("fold") != fold), candidate, _total(counts, [fold]), label)
        parts.append(score(train.where(F.col("fold") == fold)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(key, F.col(label).alias("label"), "fold", "prob_diagnosed", "prob_control", "prob_no_evidence", F.lit(candidate.model_id).alias("model_id"), F.lit(policy_id).alias("label_policy_id"))


# --- encoder step --------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def encode_posts(posts: DataFrame, encoder: Encoder, dim: int, batch: int = 256, text: str = "tweet_text") -> DataFrame:
    """Add ``embedding``: the encoder's vectors cut to ``dim`` and scaled to unit length.

    The encoder is a plain function from a list of texts to a 2-d array; it is
    shipped to the executors and called on batches there.
    """
    names = posts.columns
    source = posts.withColumn("__input", blank_to_space(text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                out = part[names].copy()
                out["__e"] = list(np.asarray(encoder(part["__input"].tolist()), dtype=np.float32))
                yield out

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posts.schema.fields)
    encoded = source.mapInPandas(run, f"{types}, __e array<float>")
    return encoded.select(*names, V.truncate_and_normalize("__e", dim).alias("embedding"))


def remaining_posts(posts: DataFrame, written: DataFrame, key: str = "user_id") -> DataFrame:
    """Resume: posts of users that have not been written yet."""
    return posts.join(written.select(key), key, "left_anti")
