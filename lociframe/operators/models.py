"""Models fitted by Spark ML, evaluation plans, and scoring with given autoencoder weights (ML, ST28, ST29)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .neighbors import random_neighbor_score
from .sampling import control_task, kfold, permute, permute_places
from .sets import union
from .stats import classification_metrics, permutation_p, regression_metrics, wilcoxon

Factory = Estimator | Callable[[int], Estimator]


def classifier(name: str = "forest", seed: int = 0, **kw) -> Estimator:
    """ML2: ``forest``, or ``logistic`` with its penalty (none to all L1) chosen by cross-validation."""
    if name == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, **kw)
    if name == "logistic":
        lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=kw.pop("regParam", 0.01), **kw)
        grid = ParamGridBuilder().addGrid(lr.elasticNetParam, [0.0, 1.0]).build()
        return CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="logLoss"),
            numFolds=3, seed=seed)
    raise ValueError(f"no such classifier: {name}")


def perceptron(layers: Sequence[int], seed: int = 0, **kw) -> Estimator:
    """ML3: sigmoid layers, a softmax at the end; ``layers`` are the widths from input to classes."""
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=list(layers), seed=seed, **kw)


def encode_labels(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, StringIndexerModel]]:
    """ML7: ``<col>_code`` numbers in alphabetical order; rows with an unknown or null label get the number after the last."""
    models = {}
    for c in cols:
        models[c] = StringIndexer(inputCol=c, outputCol=f"{c}_code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
        df = models[c].transform(df)
    return df, models


def decode_labels(df: DataFrame, col: str, model: StringIndexerModel, out: str) -> DataFrame:
    """ML7: numbers back to labels."""
    return IndexToString(inputCol=col, outputCol=out, labels=model.labels).transform(df)


def _features(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(x).cast("array<double>")))


def _width(df: DataFrame, x: str) -> int:
    row = df.where(F.col(x).isNotNull()).select(F.size(x)).first()
    return row[0] if row else 0


def _make(estimator: Factory, width: int) -> Estimator:
    return estimator.copy() if isinstance(estimator, Estimator) else estimator(width)


def fit_tasks(df: DataFrame, x: str, tasks: Sequence[str], estimator: Factory | None = None, regression: bool = False) -> dict[str, tuple]:
    """ML1: a model a task, with its labels; trees by default. Rows without a task's value are left out of its fit."""
    width, models = _width(df, x), {}
    for t in tasks:
        rows = _features(df.where(F.col(t).isNotNull()).select(F.col(x), F.col(t).alias("_task")), x)
        if regression:
            models[t] = (_make(estimator or GBTRegressor(maxIter=20), width).fit(rows.withColumn("label", F.col("_task").cast("double"))),
                None)
        else:
            index = StringIndexer(inputCol="_task", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
            models[t] = (_make(estimator or RandomForestClassifier(seed=0), width).fit(index.transform(rows)), index.labels)
    return models


def predict_tasks(df: DataFrame, x: str, id: str, models: Mapping[str, tuple]) -> DataFrame:
    """ML1: ``id, task, truth, pred, proba`` (a map from label to probability, null for regressions)."""
    rows, out = _features(df.select(*{id, x, *models}), x), []
    for t, (model, labels) in models.items():
        done = model.transform(rows)
        if labels is None:
            out.append(done.select(F.col(id).alias("id"), F.lit(t).alias("task"), F.col(t).cast("string").alias("truth"),
                F.col("prediction").cast("string").alias("pred"), F.lit(None).cast("map<string,double>").alias("proba")))
        else:
            names = F.array(*[F.lit(n) for n in labels])
            p = F.map_from_arrays(names, F.slice(vector_to_array("probability"), 1, len(labels)))
            out.append(done.select(F.col(id).alias("id"), F.lit(t).alias("task"), F.col(t).alias("truth"),
                F.get(names, F.col("prediction").cast("int")).alias("pred"), p.alias("proba")))
    return union(out, diagonal=False)


def _score(done: DataFrame, regression: bool, by: Sequence[str]) -> DataFrame:
    if regression:
        return regression_metrics(done.withColumns({"truth": F.col("truth").cast("double"), "pred": F.col("pred").cast("double")}), "truth",
            "pred", by)
    return classification_metrics(done.where("truth is not null"), "truth", "pred", "proba", by)


def split_predictions(df: DataFrame, x: str, id: str, tasks: Sequence[str], plan: Sequence[Mapping], estimator: Factory | None = None,
    regression: bool = False, preprocess: Sequence[Estimator] = ()) -> list[tuple[DataFrame, dict]]:
    """ML4: the written predictions of each split's test rows (``id, task, truth, pred, proba``), with the split's names; each is made once, whatever is read from it.

    Preprocessing is fitted on the training rows alone. Fits are the one thing done in turn: one a split and task.
    """
    out = []
    for split in plan:
        train, test = df.where(split["train"]), df.where(split["test"])
        if preprocess:
            fitted = Pipeline(stages=list(preprocess)).fit(_features(train, x))
            of = lambda d: fitted.transform(_features(d, x)).withColumn(x, vector_to_array(preprocess[-1].getOutputCol())).drop("features",
                *[p.getOutputCol() for p in preprocess])  # noqa: B023,E731
            train, test = of(train), of(test)
        done = materialise(predict_tasks(test, x, id, fit_tasks(train, x, tasks, estimator, regression)))
        out.append((done, {k: v for k, v in split.items() if k not in ("train", "test")}))
    return out


def evaluate(df: DataFrame, x: str, id: str, tasks: Sequence[str], plan: Sequence[Mapping], estimator: Factory | None = None,
    regression: bool = False, preprocess: Sequence[Estimator] = ()) -> DataFrame:
    """ML4: ``task, metric, value`` and each split's names, for splits ``{"train": predicate, "test": predicate, names...}``."""
    done = split_predictions(df, x, id, tasks, plan, estimator, regression, preprocess)
    return union([_score(rows, regression, ["task"]).withColumns({k: F.lit(v) for k, v in names.items()}) for rows, names in done],
        diagonal=True)


def cv_predictions(df: DataFrame, x: str, id: str, tasks: Sequence[str], k: int = 5, repeats: int = 1, seed: int = 0,
    stratify: str | None = None, **kw) -> DataFrame:
    """ML4: each row's prediction by the model that was fitted without its fold, with ``iter``."""
    done = split_predictions(kfold(df, id, k, repeats, seed, stratify), x, id, tasks, cv_plan(k, repeats), **kw)
    return union([rows.withColumns({n: F.lit(v) for n, v in names.items()}) for rows, names in done], diagonal=True)


def cv_plan(k: int, repeats: int = 1) -> list[dict]:
    """Splits of the columns that ``kfold`` adds."""
    return [{"train": (F.col("repeat") == r) & (F.col("fold") != f), "test": (F.col("repeat") == r) & (F.col("fold") == f),
        "iter": r * k + f} for r in range(repeats) for f in range(k)]


def cross_validate(df: DataFrame, x: str, id: str, tasks: Sequence[str], k: int = 5, repeats: int = 1, seed: int = 0,
    stratify: str | None = None, **kw) -> DataFrame:
    """ML4 over folds."""
    return evaluate(kfold(df, id, k, repeats, seed, stratify), x, id, tasks, cv_plan(k, repeats), **kw)


def permutation_test(df: DataFrame, x: str, id: str, task: str, kind: int = 1, rounds: int = 5, k: int = 3, seed: int = 0,
    **kw) -> DataFrame:
    """ML5: p-value of a classifier's cross-validated error: against permuted labels (1), or against features permuted within classes (2)."""

    def error(d: DataFrame, r: int) -> DataFrame:
        done = split_predictions(kfold(d, id, k, 1, seed + r), x, id, [task], cv_plan(k), **kw)
        hit = F.coalesce((F.col("truth") == F.col("pred")).cast("double"), F.lit(0.0))
        each = [made.where("truth is not null").groupBy("task").agg(F.avg(hit).alias("acc")) for made, _ in done]
        return union(each, diagonal=False).agg((1 - F.avg("acc")).alias("error"))

    rows = df.select(id, x, task)
    if kind == 2:
        width = _width(rows, x)
        other = lambda r: permute_places(rows, id, x, width, task, seed + r)
    else:
        other = lambda r: permute(rows, id, [task], seed=seed + r)
    null = union([error(materialise(other(r)), r) for r in range(rounds)], diagonal=False)  # folds read them more than once
    return permutation_p(error(rows, 0), null)


def control_cv(df: DataFrame, x: str, id: str, target: str, control: str, k: int = 3, seed: int = 0, **kw) -> DataFrame:
    """ML6: cross-validated metrics of the task and of its control task, told apart by ``control``."""
    real = cross_validate(df, x, id, [target], k, 1, seed, **kw).withColumn("control", F.lit(False))
    fake = control_task(df, target, control, seed, "_control").drop(target).withColumnRenamed("_control", target)
    return real.unionByName(cross_validate(fake, x, id, [target], k, 1, seed, **kw).withColumn("control", F.lit(True)))


def latent_profiles(acts: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """``latent, x``: each latent's activations by sample, folded to ``dims`` sums by a signed hash of the sample; absent samples are zero.

    A random fold keeps distances between latents in expectation, so no task holds a value a sample.
    """
    from ..functions.seeded import draw

    h = draw(seed, "fold", "sample")
    folded = acts.select("latent", (h % dims).cast("int").alias("d"),
        F.when(F.shiftright(h, 40) % 2 == 0, F.col("act")).otherwise(-F.col("act")).alias("v"))
    sums = folded.groupBy("latent", "d").agg(F.sum("v").alias("v")).groupBy("latent").agg(
        F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"))  # dims values a latent
    return sums.select("latent",
        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def cluster_latents(acts: DataFrame, k: int, seed: int = 0, dims: int = 256, clusterer: Estimator | Callable[[DataFrame], DataFrame]
    | None = None) -> DataFrame:
    """ML8: clusters of latents by their activations: ``latent, x, cluster``.

    UD3: ``clusterer`` is an estimator over ``features``, or a function from ``latent, x`` to ``latent, cluster``; by default k-means.
    """
    rows = latent_profiles(acts, dims, seed)
    if clusterer is not None and not isinstance(clusterer, Estimator):
        return rows.join(clusterer(rows).select("latent", "cluster"), "latent")
    model = (clusterer or KMeans(k=k, seed=seed)).fit(_features(rows, "x"))
    return model.transform(_features(rows, "x")).select("latent", "x", F.col("prediction").alias("cluster"))


def pca(df: DataFrame, x: str, k: int) -> DataFrame:
    """ML9: ``pc``, the first ``k`` coordinates."""
    rows = _features(df, x)
    return PCA(k=k, inputCol="features", outputCol="_pc").fit(rows).transform(rows).withColumn("pc",
        vector_to_array("_pc")).drop("features", "_pc")


class SaeWeights:
    """Given weights: encoder (d x m), decoder (m x d), and the decoder's bias (d)."""

    def __init__(self, enc: np.ndarray, dec: np.ndarray, bias: np.ndarray):
        self.enc, self.dec, self.bias = (np.asarray(a, float) for a in (enc, dec, bias))


def sae_encode(df: DataFrame, id: str, x: str, weights: SaeWeights, threshold: float = 0.0, standardise: bool = False) -> DataFrame:
    """ML10: ``id, latent, act`` of activations above zero and at least ``threshold``; the weights are of a fixed size and sent to the tasks."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            if standardise:
                v = (v - v.mean(1, keepdims=True)) / (v.std(1, ddof=1, keepdims=True) + 1e-5)
            a = np.maximum((v - w.bias) @ w.enc, 0)
            a[a < threshold] = 0
            row, col = np.nonzero(a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(col, pa.int32()), pa.array(a[row, col])],
                names=["id", "latent", "act"])

    return df.where(F.col(x).isNotNull()).select(id, F.col(x).cast("array<double>")).mapInArrow(run, f"id {kind}, latent int, act double")


def sae_reconstruct(df: DataFrame, id: str, x: str, weights: SaeWeights, threshold: float = 0.0, ablate: Sequence[int] = ()) -> DataFrame:
    """ML11: ``id, x, recon, n_active, l1`` in one pass, with some latents set to zero."""
    sent = df.sparkSession.sparkContext.broadcast((weights, list(ablate)))
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, off = sent.value
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            a = np.maximum((v - w.bias) @ w.enc, 0)
            a[a < threshold] = 0
            a[:, off] = 0
            out = a @ w.dec + w.bias
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out), pa.list_(pa.float64())),
                pa.array((a > 0).sum(1)), pa.array(a.sum(1))], names=["id", "x", "recon", "n_active", "l1"])

    return df.where(F.col(x).isNotNull()).select(id, F.col(x).cast("array<double>")).mapInArrow(run,
        f"id {kind}, x array<double>, recon array<double>, n_active long, l1 double")


def sae_loss(df: DataFrame, id: str, x: str, weights: SaeWeights, threshold: float = 0.0) -> DataFrame:
    """ML13: ``mse, mean_l1, mean_l0, dead_latents``."""
    done = sae_reconstruct(df, id, x, weights, threshold)
    gap = F.aggregate(F.zip_with("x", "recon", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("x")
    live = sae_encode(df, id, x, weights, threshold).agg(F.count_distinct("latent").alias("live"))
    one = done.agg(F.avg(gap).alias("mse"), F.avg("l1").alias("mean_l1"), F.avg("n_active").alias("mean_l0"))
    return one.join(F.broadcast(live)).select("mse", "mean_l1", "mean_l0",
        (F.lit(weights.enc.shape[1]) - F.col("live")).alias("dead_latents"))  # one row each


def ablation(df: DataFrame, x: str, id: str, tasks: Sequence[str], weights: SaeWeights, latents: Sequence[int], how: str = "each",
    k: int = 3, seed: int = 0, **kw) -> DataFrame:
    """ML12: ``task, metric, before, after, delta`` with the latents zeroed ``each`` alone, ``all`` at once, or all but them (``keep``)."""
    every = set(range(weights.enc.shape[1]))
    sets = {"each": [[i] for i in latents], "all": [list(latents)], "keep": [sorted(every - set(latents))]}[how]

    def score(off: Sequence[int]) -> DataFrame:
        new = sae_reconstruct(df, id, x, weights, ablate=off).select(F.col("id").alias(id), F.col("recon").alias(x))
        return cross_validate(df.drop(x).join(new, id), x, id, tasks, k, 1, seed, **kw).groupBy("task",
            "metric").agg(F.avg("value").alias("value"))

    before = score([]).withColumnRenamed("value", "before")
    out = [score(off).select("task", "metric", F.col("value").alias("after"), F.lit(",".join(map(str, off))).alias("ablated"))
        for off in sets]
    return union(out, diagonal=False).join(before, ["task", "metric"]).withColumn("delta", F.col("after") - F.col("before"))


def external_metrics(codes: DataFrame) -> DataFrame:
    """ML14: accuracy, mcc, sensitivity, specificity of each tool and drug from TP, FP, FN, TN codes."""
    n = {c: F.count_if(F.col("code") == c).cast("double").alias(c) for c in ("TP", "FP", "FN", "TN")}
    g = codes.groupBy("tool", "drug").agg(*n.values())
    tp, fp, fn, tn = (F.col(c) for c in n)
    safe = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return g.select("tool", "drug", safe(tp + tn, tp + fp + fn + tn).alias("acc"),
        F.coalesce(safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)).alias("mcc"),
            safe(tp, tp + fn).alias("sensitivity"), safe(tn, tn + fp).alias("specificity"))


def random_label_baseline(df: DataFrame, x: str, id: str, n: int = 3, k: int = 3, seed: int = 0,
    estimator: Factory | None = None) -> DataFrame:
    """ST29: ``iter, mcc`` of a classifier on labels drawn by hash."""
    from ..functions.seeded import pick

    out = []
    for r in range(n):
        rows = df.select(id, x, pick(F.lit(2), seed, "label", F.lit(r), id).cast("string").alias("_y"))
        out.append(cross_validate(rows, x, id, ["_y"], k, 1, seed + r, estimator=estimator).where("metric = 'mcc'")
            .agg(F.lit(r).alias("iter"), F.avg("value").alias("mcc")))
    return union(out, diagonal=False)


def perturbation_report(natural: DataFrame, perturbed: DataFrame, random: DataFrame, id: str, x: str, k: int = 3, neighbors: int = 10,
    seed: int = 0, estimator: Factory | None = None) -> DataFrame:
    """ST28: ``measure, value``: cross-validated mcc of telling natural from perturbed and from random rows, the share of perturbed rows that the natural-from-random classifier calls natural, random neighbours of natural rows, and the p-value that perturbed rows stay nearer to their origin than random ones."""
    from ..functions.columns import vec_distance
    from .joins import align_pairs

    tag = lambda d, y: d.select(F.concat(F.lit(y), F.col(id).cast("string")).alias("id"), x, F.lit(y).alias("_y"))
    out = []
    for name, other in (("perturbed", perturbed), ("random", random)):
        both = tag(natural, "natural").unionByName(tag(other, name))
        out.append(cross_validate(both, x, "id", ["_y"], k, 1, seed, estimator=estimator).where("metric = 'mcc'")
            .agg(F.lit(f"mcc_{name}").alias("measure"), F.avg("value").alias("value")))
    models = fit_tasks(tag(natural, "natural").unionByName(tag(random, "random")), x, ["_y"], estimator)
    out.append(predict_tasks(tag(perturbed, "perturbed"), x, "id", models).agg(F.lit("transfer").alias("measure"),
        F.avg((F.col("pred") == "natural").cast("double")).alias("value")))
    out.append(random_neighbor_score(natural, random, id, x, neighbors, seed=seed).agg(F.lit("random_neighbors").alias("measure"),
        F.avg("score").alias("value")))
    pairs = align_pairs(natural, perturbed, random, id, x).select(vec_distance("natural", "perturbed").alias("a"),
        vec_distance("natural", "random").alias("b"))
    out.append(wilcoxon(pairs, "a", "b").select(F.lit("wilcoxon_p").alias("measure"), F.col("p").alias("value")))
    return union(out, diagonal=False)
