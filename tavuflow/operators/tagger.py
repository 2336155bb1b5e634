"""Token classifiers from MLlib: multinomial logistic regression over hashed features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavuflow.session import materialize


def prepared(tokens: DataFrame, word: str = "word", size: int = 1 << 12) -> DataFrame:
    """tokens with features: the lower-cased word, its ends and its shape, hashed."""
    from pyspark.ml.feature import HashingTF

    low = F.lower(F.col(word))
    parts = F.array(
        F.concat(F.lit("w="), low), F.concat(F.lit("p="), F.substring(low, 1, 3)), F.concat(F.lit("s="), F.substring(low, -3, 3)),
        F.concat(F.lit("cap="), (F.substring(F.col(word), 1, 1) != F.substring(low, 1, 1)).cast("string")), F.concat(F.lit("num="), F.col(word).rlike("[0-9]").cast("string")),
    )
    return HashingTF(numFeatures=size, inputCol="_parts", outputCol="features", binary=True).transform(tokens.withColumn("_parts", parts)).drop("_parts")


def label_ids(tokens: DataFrame, tag: str = "tag"):
    """A fitted label encoder: ids in alphabetic order; an unknown label is an error."""
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol=tag, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error").fit(tokens)


def fit_logistic(train: DataFrame, rounds: int = 500, l2: float = 1e-3, tolerance: float = 1e-4):
    """A multinomial model of (features, label); training stops when the loss moves by less than tolerance."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(family="multinomial", maxIter=rounds, regParam=l2, tol=tolerance).fit(train)


def losses(model) -> list[tuple[int, float]]:
    """(epoch, loss) of a fit."""
    return list(enumerate(model.summary.objectiveHistory))


def cross_validate(tokens: DataFrame, rounds: int = 500) -> DataFrame:
    """tokens (with fold) and pred: each fold predicted by a model of the others. Features are hashed once; the folds' fits, each a
    row of small jobs over all rows, run side by side."""
    ids = label_ids(tokens)
    names = F.array(*[F.lit(x) for x in ids.labels])
    ready = materialize(ids.transform(prepared(tokens)).select(*tokens.columns, "label", "features"), "features")
    folds = sorted(r["fold"] for r in ready.select("fold").distinct().collect())  # a few numbers
    with ThreadPoolExecutor(max(len(folds), 1)) as pool:
        models = list(pool.map(inheritable_thread_target(tokens.sparkSession)(lambda fold: fit_logistic(ready.filter(F.col("fold") != fold), rounds)), folds))
    out = None
    for fold, model in zip(folds, models, strict=True):
        part = model.transform(ready.filter(F.col("fold") == fold)).withColumn("pred", names[F.col("prediction").cast("int")])
        part = part.select(*tokens.columns, "pred")
        out = part if out is None else out.unionByName(part)
    return out
