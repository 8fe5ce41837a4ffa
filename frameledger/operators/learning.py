"""Classifier work on score rows and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameledger.functions.numeric import mean_or_zero

C = F.col


def class_scores(vectors: DataFrame, means: DataFrame, features: str, label: str, digits: int = 9) -> DataFrame:
    """All class scores of a vector as one array `zs` (vector times class weights), beside its label `gt`.

    `means` has (k, m): a row of weights for each class, so its size is that of the model, whatever the data; it is
    gathered to one row and broadcast, and vectors are neither exploded nor moved.
    """
    model = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda r: r["m"]).alias("_w"))
    dot = lambda w: F.round(F.aggregate(F.zip_with(features, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, t: acc + t), digits)
    return vectors.withColumn("gt", C(label)).crossJoin(F.broadcast(model)).withColumn("zs", F.transform("_w", dot)).drop("_w")


def _exponents(zs: Column, top: Column) -> Column:
    return F.transform(zs, lambda z: F.exp(z - top))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def softmax(scored: DataFrame, zs: str = "zs") -> DataFrame:
    """Class probabilities `ps` with the maximum shifted out."""
    e = scored.withColumn("_e", _exponents(C(zs), F.array_max(zs)))
    e = e.withColumn("_s", _total(C("_e")))
    return e.withColumn("ps", F.transform("_e", lambda v: v / C("_s"))).drop("_e", "_s")


def predict(scored: DataFrame, zs: str = "zs") -> DataFrame:
    """Adds the best class `pred` (first index on ties) and its probability `conf`."""
    top = F.array_max(zs)
    return scored.withColumns({"pred": (F.array_position(zs, top) - 1).cast("int"), "conf": F.lit(1.0) / _total(_exponents(C(zs), top))})


def smoothed_cross_entropy(scored: DataFrame, smoothing: float = 0.05, zs: str = "zs") -> DataFrame:
    """Mean cross-entropy against a smoothed one-hot target."""
    top = F.array_max(zs)
    lse, n = top + F.log(_total(_exponents(C(zs), top))), F.size(zs)
    own = lse - F.get(zs, C("gt"))
    every = _total(F.transform(zs, lambda z: lse - z))
    return scored.select((F.lit(1.0 - smoothing) * own + F.lit(smoothing) / n * every).alias("_l")).agg(mean_or_zero(C("_l")).alias("cls"))


def standardised(vectors: DataFrame, features: str, size: int) -> DataFrame:
    """Subtract the mean, divide by the population deviation + 1e-6, per dimension of a `size`-long array.

    One aggregate over all dimensions (a row of 2 x `size` numbers, broadcast); vectors are neither exploded nor moved.
    """
    at = [F.get(features, F.lit(i)).cast("double") for i in range(size)]
    st = vectors.agg(F.array(*[F.avg(v) for v in at]).alias("_mu"), F.array(*[F.stddev_pop(v) + F.lit(1e-6) for v in at]).alias("_sd"))
    scaled = F.zip_with(F.zip_with(features, "_mu", lambda v, m: v.cast("double") - m), "_sd", lambda v, s: v / s)
    return vectors.crossJoin(F.broadcast(st)).withColumn(features, scaled).drop("_mu", "_sd")


def gradient(vectors: DataFrame, features: str, label: str, n_classes: int) -> DataFrame:
    """First full-batch gradient of the multinomial model at zero weights, bias included.

    At zero weights every class has probability 1 / n, so the gradient of weight (pos, k) is
    mean(x_pos * (1/n - [label = k])). Long result: (pos, k, g); pos = -1 is the bias.
    """
    total = vectors.groupBy().agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    per = (vectors.select(label, F.posexplode(F.concat(features, F.array(F.lit(1.0)))).alias("pos", "v"))
           .groupBy(label, "pos").agg(F.sum("v").alias("s")))       # labels x dimensions rows
    spread = per.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    share = F.lit(1.0 / n_classes) - F.when(C(label) == C("k"), 1.0).otherwise(0.0)
    g = spread.groupBy("pos", "k").agg(F.sum(C("s") * share).alias("g")).withColumn("_one", F.lit(1))
    return g.join(F.broadcast(total), "_one").select("pos", "k", (C("g") / C("_n")).alias("g"))


def fit_multinomial(vectors: DataFrame, features: str, label: str, l2: float = 1e-4, iterations: int = 50):
    """Multinomial logistic regression by Spark's own distributed optimiser, on scaled features.

    Returns a pipeline model; `model.stages[-1].summary.objectiveHistory` is the training log.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    scale = StandardScaler(inputCol=features, outputCol="scaled", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, family="multinomial", regParam=l2,
                               elasticNetParam=0.0, maxIter=iterations, standardization=False)
    return Pipeline(stages=[scale, model]).fit(vectors)


def crop_choice(box: list[Column], img_w: int, img_h: int) -> list[Column]:
    """Integer crop of a predicted box, clamped, at least 2 px; the whole frame when there is none."""
    x1, y1, x2, y2 = [F.bround(b).cast("int") for b in box]
    left, top = F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1)
    right, bottom = F.least(F.lit(img_w), F.greatest(left + 2, x2)), F.least(F.lit(img_h), F.greatest(top + 2, y2))
    use = box[0].isNotNull() & (right > left) & (bottom > top)
    whole = (0, 0, img_w, img_h)
    return [F.when(use, c).otherwise(F.lit(d)) for c, d in zip((left, top, right, bottom), whole)]
