"""Ranking models on MLlib: training, selection, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.functions.scores import min_max
from quillrec.operators.features import is_validation_user
from quillrec.operators.skew import dealt
from quillrec.operators.topk import top_k

SEED = 42
DIGITS = 8
CLIP = 1e-6
MODEL_ROWS = 1 << 17  # training rows held by a task
# The same where hundreds of trees are grown: every task sends its counts for each level of each of them.
SELECTION_ROWS = 1 << 20
# The boosted-tree settings compared by model selection (depth, step).
TREE_GRID = ((4, 0.05), (5, 0.05), (5, 0.08))
ROUNDS = 120  # trees of each of them


@dataclass
class FittedRanker:
    name: str
    model: PipelineModel
    features: Sequence[str]

    def scored(self, df: DataFrame) -> DataFrame:
        """Add `score`: probability of label 1, or the raw prediction of a regressor."""
        out = self.model.transform(df)
        if "probability" in out.columns:
            out = out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
        else:
            out = out.withColumn("score", F.col("prediction"))
        extra = [c for c in out.columns if c not in df.columns and c != "score"]
        return out.drop(*extra)


def split_by_user(df: DataFrame, percent: int = 20) -> tuple[DataFrame, DataFrame]:
    valid = is_validation_user(F.col("user_id"), percent)
    return df.where(~valid), df.where(valid)


def boosted_classifier(depth: int, step: float, rounds: int) -> GBTClassifier:
    return GBTClassifier(
        labelCol="label", maxDepth=depth, stepSize=step, maxIter=rounds, subsamplingRate=0.85, seed=SEED
    )


def training_rows(train: DataFrame, columns: Sequence[str], task_rows: int | None = None) -> DataFrame:
    """The columns that a model reads, in tasks of about `task_rows` rows (default MODEL_ROWS).

    Tasks cut by compressed bytes hold many millions of such rows, which the trees keep and read uncompressed in every
    round. `train` is counted first: hand in a stored table.
    """
    return dealt(train.select(*columns), train.count(), task_rows=task_rows or MODEL_ROWS)


def fit(name: str, estimator, train: DataFrame, features: Sequence[str], scale: bool = False, deal: bool = True) -> FittedRanker:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_raw" if scale else "features")
    stages = [assembler]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    weight = [estimator.getWeightCol()] if estimator.isSet("weightCol") else []
    columns = [*features, estimator.getLabelCol(), *weight]
    rows = training_rows(train, columns) if deal else train.select(*columns)
    return FittedRanker(name, Pipeline(stages=[*stages, estimator]).fit(rows), features)


def logistic(train: DataFrame, features: Sequence[str], deal: bool = True) -> FittedRanker:
    """Balanced logistic regression on standardised features."""
    rows = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    positive, negative = max(rows.p, 1), max(rows.n - rows.p, 1)
    weight = F.when(F.col("label") == 1, rows.n / (2 * positive)).otherwise(rows.n / (2 * negative))
    estimator = LogisticRegression(labelCol="label", weightCol="_weight", maxIter=100)
    return fit("logistic_regression", estimator, train.withColumn("_weight", weight), features, scale=True, deal=deal)


def classification_metrics(scored: DataFrame, name: str) -> DataFrame:
    """One row: model, auc, accuracy, logloss. Without both labels present auc and logloss are 0."""
    p = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    hit = (F.col("score") >= 0.5) == (F.col("label") == 1)
    both = F.min("label") < F.max("label")
    scored = scored.select("label", "score").persist()  # read twice: rows are scored once
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score")
    auc = evaluator.evaluate(scored)
    row = scored.agg(
        F.lit(name).alias("model"),
        F.when(both, F.lit(auc)).otherwise(0.0).alias("auc"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.when(both, F.avg(loss)).otherwise(0.0).alias("logloss"),
    )
    found = scored.sparkSession.createDataFrame(row.collect(), row.schema)
    scored.unpersist()
    return found


def importances(ranker: FittedRanker) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, strongest first."""
    weights = ranker.model.stages[-1].featureImportances.toArray()
    return sorted(zip(ranker.features, map(float, weights)), key=lambda pair: (-pair[1], pair[0]))


def select_model(
    train: DataFrame, valid: DataFrame, features: Sequence[str], rounds: int = ROUNDS
) -> tuple[FittedRanker, DataFrame]:
    """Best of three boosted-tree settings, a deeper faster one and logistic regression.

    Order: auc desc, logloss asc, name. Returns the winner and the comparison table. The training rows are dealt out once
    for all models. Hand in stored tables.
    """
    rows = training_rows(train, [*features, "label"], SELECTION_ROWS).persist()
    settings = [(f"gbt_depth{depth}_step{step}", depth, step) for depth, step in TREE_GRID] + [("gbt_deep", 6, 0.1)]
    rankers = [fit(name, boosted_classifier(depth, step, rounds), rows, features, deal=False) for name, depth, step in settings]
    rankers.append(logistic(rows, features, deal=False))
    rows.unpersist()
    table = None
    for ranker in rankers:
        row = classification_metrics(ranker.scored(valid), ranker.name)
        table = row if table is None else table.unionByName(row)
    winner = table.orderBy(F.desc("auc"), F.asc("logloss"), F.asc("model")).first().model
    return next(r for r in rankers if r.name == winner), table


def rank_top(scored: DataFrame, k: int = 50, scale: bool = False) -> DataFrame:
    """Top k per user by (score, merged_score, id); scores are rounded only after ranking.

    With `scale` raw scores are first brought to [0, 1] over the whole table.
    """
    df = scored
    if scale:
        span = df.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
        df = df.withColumn("score", min_max(F.col("score"), span["lo"], span["hi"]))
    order = [F.desc("score"), F.desc("merged_score"), F.asc("item_id")]
    best = top_k(df, ["user_id"], order, k, "rank_position")
    return best.withColumn("rank_score", F.round("score", DIGITS)).drop("score")


def rating_regressor(train: DataFrame, features: Sequence[str], rounds: int = 20) -> FittedRanker:
    estimator = GBTRegressor(
        labelCol="rating", maxDepth=6, stepSize=0.05, maxIter=rounds, subsamplingRate=0.8, seed=SEED
    )
    return fit("rating_regressor", estimator, train, features)


def regression_metrics(scored: DataFrame) -> DataFrame:
    error = F.col("score") - F.col("rating")
    return scored.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.count(F.lit(1)).alias("n")
    )
