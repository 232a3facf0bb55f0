"""Feature scaling, TF-IDF and a registry of classifiers on Spark ML."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from corpusloom.operators import stats
from corpusloom.session import cut, discard


def scale(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """Zero mean and unit population deviation of the training rows; constant
    features are only centred."""
    return scaled(rows, moments(train, features), features)


def moments(train: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population deviation of each feature."""
    return train.agg(*(F.avg(f).alias(f"_m_{f}") for f in features), *(F.stddev_pop(f).alias(f"_s_{f}") for f in features))


def scaled(rows: DataFrame, moments: DataFrame, features: list[str]) -> DataFrame:
    """As :func:`scale`, by given moments."""
    z = lambda f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0)
    return rows.join(F.broadcast(moments)).withColumns({f: z(f) for f in features}).drop(*(f"_{x}_{f}" for x in "ms" for f in features))


def impute(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """Missing values by the training median."""
    m = train.agg(*(F.median(f).alias(f"_m_{f}") for f in features))
    return rows.join(F.broadcast(m)).withColumns({f: F.coalesce(F.col(f), F.col(f"_m_{f}")) for f in features}).drop(*(f"_m_{f}" for f in features))


def word_grams(c: Column, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of the lower-cased text. Longer ones are zipped from shorter ones
    and shifted words, because what stands inside a lambda is evaluated per element."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    of, got = w, [w] if low == 1 else []
    for n in range(2, high + 1):
        left = F.greatest(F.size(w) - (n - 1), F.lit(0))
        of = F.zip_with(F.slice(of, F.lit(1), left), F.slice(w, F.lit(n), left), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            got.append(of)
    return F.concat(*got)


def char_grams(c: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words padded with a blank."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of = lambda n: F.flatten(F.transform(words, lambda w: F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(w, i, n))))
    return F.concat(*(of(n) for n in range(low, high + 1)))


def term_counts(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, tf), written once: vocabulary and weights both read it."""
    return cut(docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))


def vocabulary(counts: DataFrame, n_docs: int, size: int, min_df: int = 3, max_df: float = 0.95) -> DataFrame:
    """(term, df) of the ``size`` most frequent terms within the document-frequency bounds."""
    v = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return v.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).orderBy(F.desc("cf"), "term").limit(size).select("term", "df")


def tfidf_long(counts: DataFrame, key: str, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """(key, term, weight): 1 + ln(tf), times ln((1 + n) / (1 + df)) + 1, scaled to
    unit length; ``vocabulary`` has term and df of the training documents. Only terms
    of the vocabulary (bounded by its size, hence broadcast) are moved, once."""
    w = counts.join(F.broadcast(vocabulary), "term").select(key, "term", ((1 + F.ln("tf")) * (F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    one = w.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("_t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return one.select(key, "_n", F.explode("_t").alias("_t")).select(key, F.col("_t.term").alias("term"), (F.col("_t.w") / F.col("_n")).alias("weight"))


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (2 * n of the class)."""
    n = train.groupBy(label).agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("_t"))
    return train.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("_t") / (2.0 * F.col("_c"))).drop("_c", "_t")


def registry(n_train: int) -> dict[str, object]:
    """Name to estimator; C of logistic regression becomes 1 / (C * n)."""
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "lr_l2_c1": LogisticRegression(regParam=1.0 / max(1, n_train), weightCol="weight", maxIter=60, **common),
        "lr_l2_c01": LogisticRegression(regParam=10.0 / max(1, n_train), weightCol="weight", maxIter=60, **common),
        "linear_svc": LinearSVC(maxIter=30, weightCol="weight", **common),
        "decision_tree": DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=5, seed=42, **common),
        "random_forest": RandomForestClassifier(numTrees=40, maxDepth=8, seed=42, **common),
        "gbt": GBTClassifier(maxIter=15, maxDepth=4, seed=42, **common),
        "lr_l1": LogisticRegression(regParam=1.0 / max(1, n_train), elasticNetParam=1.0, weightCol="weight", maxIter=60, **common),
        "sgd_log": LogisticRegression(regParam=1e-4, weightCol="weight", maxIter=10, **common),
        "gaussian_nb": NaiveBayes(modelType="gaussian", weightCol="weight", **common),
        "bagging": RandomForestClassifier(numTrees=20, maxDepth=8, featureSubsetStrategy="all", subsamplingRate=0.5, seed=42, **common),
        "deep_tree": DecisionTreeClassifier(maxDepth=16, seed=42, **common),
    }


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def fit(train: DataFrame, name: str, features: list[str]) -> tuple[PipelineModel, float]:
    """(fitted pipeline, seconds). Features are numeric columns or array columns of
    terms; the latter become blocks of TF-IDF weights beside the others."""
    data = balanced_weights(train).persist()
    began = time.time()
    model = Pipeline(stages=[*blocks(train, features), registry(data.count())[name]]).fit(data)
    took = time.time() - began
    data.unpersist()
    return model, took


def blocks(rows: DataFrame, features: list[str], size: int = 2000, min_df: int = 3) -> list:
    """Stages that put numeric columns and the TF-IDF of term columns side by side."""
    terms = [f for f in features if rows.schema[f].dataType.typeName() == "array"]
    stages: list = []
    for f in terms:
        stages += [CountVectorizer(inputCol=f, outputCol=f"_tf_{f}", vocabSize=size, minDF=min_df), IDF(inputCol=f"_tf_{f}", outputCol=f"_idf_{f}"), Normalizer(inputCol=f"_idf_{f}", outputCol=f"_w_{f}")]
    columns = [f"_w_{f}" if f in terms else f for f in features]
    return [*stages, VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]


def save(model: PipelineModel, path: str, meta: dict) -> None:
    """The fitted pipeline (scaling and vocabularies included) and its description."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/meta").first()[0])


def counters(rows: DataFrame, features: list[str]) -> list:
    """A fitted count of the most frequent terms for each term column of ``features``."""
    return [stage.fit(rows.select(stage.getInputCol())) for stage in blocks(rows, features) if isinstance(stage, CountVectorizer)]


def counted(rows: DataFrame, counters: list) -> DataFrame:
    """Term columns replaced by their counts, written once."""
    return cut(PipelineModel(counters).transform(rows).drop(*(c.getInputCol() for c in counters)))


def weighing(rows: DataFrame, counters: list) -> list:
    """Fitted stages from counts to TF-IDF weights, those of one term column in one list."""
    out = []
    for c in counters:
        f = c.getInputCol()
        idf = IDF(inputCol=c.getOutputCol(), outputCol=f"_idf_{f}").fit(rows.select(c.getOutputCol()))
        out.append([idf, Normalizer(inputCol=f"_idf_{f}", outputCol=f"_w_{f}")])
    return out


def fit_counted(train: DataFrame, n: int, name: str, features: list[str], counters: list, weighers: list) -> tuple[PipelineModel, float]:
    """As :func:`fit`, over ``n`` written rows with counts and ``weight``: only the classifier
    is fitted, and timed. The pipeline starts at the counts. Few rows make few tasks: a fit is
    a job for every step, and small ones cost more to start than to run."""
    own = {c.getInputCol(): w for c, w in zip(counters, weighers) if c.getInputCol() in features}
    columns = [f"_w_{f}" if f in own else f for f in features]
    before = [*(s for w in own.values() for s in w), VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]
    data = PipelineModel(before).transform(train.coalesce(-(-n // ROWS_A_TASK) or 1)).select("features", "label", "weight")
    began = time.time()
    model = registry(n)[name].fit(data)
    return PipelineModel([*before, model]), time.time() - began


ROWS_A_TASK = 30_000
#: Fits that run beside each other: most of a fit is waiting for short jobs, but each holds its rows.
BESIDE = 4


def best_experiment(train: DataFrame, val: DataFrame, models: list[str], sets: dict[str, list[str]]) -> list[dict]:
    """Every model on every feature set, with F1 on ``val`` and timings, best first
    (then by name). Terms are counted and weighed once for all; timings are those of the
    classifier alone, with other fits beside it."""
    used = list(dict.fromkeys(f for features in sets.values() for f in features))
    c = counters(train, used)
    x, y = counted(balanced_weights(train), c), counted(val, c)
    w, n, n_val = weighing(x, c), x.count(), y.count()

    def one(name: str, block: str) -> dict:
        model, took = fit_counted(x, n, name, sets[block], c, w)
        began = time.time()
        got = stats.threshold_metrics(predict(model, y).select(F.lit(1).alias("_all"), "label", "score"), ["_all"], "label", "score").first()
        f1 = float(got["f1"] or 0.0) if got else 0.0
        return {"model": name, "features": block, "f1": f1, "train_time_s": took, "infer_time_per_sample": (time.time() - began) / max(1, n_val), "fitted": PipelineModel([*c, *model.stages])}

    with ThreadPoolExecutor(BESIDE) as pool:
        out = list(pool.map(inheritable_thread_target(train.sparkSession)(lambda e: one(*e)), [(m, b) for m in models for b in sets]))
    discard(x)
    discard(y)
    return sorted(out, key=lambda r: (-r["f1"], r["model"], r["features"]))


def fit_terms(train: DataFrame, name: str, features: list[str]) -> PipelineModel:
    """As :func:`fit`, with the counts of terms written instead of the terms kept in memory."""
    c = counters(train, features)
    x = counted(balanced_weights(train), c)
    model, _ = fit_counted(x, x.count(), name, features, c, weighing(x, c))
    discard(x)
    return PipelineModel([*c, *model.stages])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``score`` in [0, 1]: the probability, or the margin's logistic."""
    out = model.transform(rows)
    score = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn("score", score)


def evaluate(scored: DataFrame, by: list[str], name: str) -> DataFrame:
    """Model, slice, rank and threshold metrics."""
    a = stats.rank_metrics(scored.select(*by, "label", "score"), by, "label", "score")
    b = stats.threshold_metrics(scored.select(*by, "label", "score"), by, "label", "score")
    return a.join(b, by).select(F.lit(name).alias("model"), *by, "n_pos", "n_neg", "roc_auc", "average_precision", "accuracy", "balanced_accuracy", "precision", "recall", "f1")


def project(rows: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """First k principal components (the features should be scaled)."""
    v = assemble(rows, features)
    return PCA(k=k, inputCol="features", outputCol="_pc").fit(v).transform(v).select("*", *(vector_to_array("_pc")[i].alias(f"pc{i + 1}") for i in range(k))).drop("_pc", "features")


def linear_attribution(rows: DataFrame, features: list[str], coefficients: list[float]) -> DataFrame:
    """Mean absolute attribution |w * (x - mean)| of a linear model's features."""
    m = rows.agg(*(F.avg(f).alias(f"_m_{f}") for f in features))
    r = rows.join(F.broadcast(m)).agg(*(F.avg(F.abs(F.lit(float(w)) * (F.col(f) - F.col(f"_m_{f}")))).alias(f) for f, w in zip(features, coefficients)))
    return r.select(F.expr(f"stack({len(features)}, " + ", ".join(f"'{f}', `{f}`" for f in features) + ") as (feature, mean_abs)"))

