"""Window classifier, scoring, model search and evaluation (M1, M2, M3, T4)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesprep.operators.evaluate import (
    accuracy_and_loss,
    confusion_matrix,
    predicted_class,
)
from seriesprep.schema import NUM_CLASSES, SPLIT_SEED, SeriesLayout


def flat_features(windows: DataFrame) -> DataFrame:
    """Window as one vector; a null step value counts as the mean, 0 after standardization."""
    values = F.transform(F.flatten("X"), lambda v: F.coalesce(v, F.lit(0.0)))
    return windows.withColumn("features", array_to_vector(values))


def fit_window_classifier(
    windows: DataFrame,
    n: int,
    layout: SeriesLayout,
    hidden: int = 32,
    step_size: float | None = None,
    max_iter: int = 50,
    seed: int = SPLIT_SEED,
):
    """Perceptron over flattened windows with one output per class, trained on the cluster.

    With ``step_size`` by gradient descent of that rate, else by L-BFGS, which has no rate.
    """
    solver = {"solver": "l-bfgs"} if step_size is None else {"solver": "gd", "stepSize": step_size}
    trainer = MultilayerPerceptronClassifier(
        layers=[n * len(layout.sensors), hidden, NUM_CLASSES],
        labelCol="label",
        maxIter=max_iter,
        seed=seed,
        **solver,
    )
    return trainer.fit(flat_features(windows).select("features", F.col("label").cast("double")))


def score_windows(model, windows: DataFrame) -> DataFrame:
    """Windows with class probabilities and predicted class."""
    scored = model.transform(flat_features(windows))
    scored = scored.withColumn("probability", vector_to_array("probability"))
    return predicted_class(scored.drop("features", "rawPrediction", "prediction"))


def score_with(
    windows: DataFrame, make_predictor: Callable, window_shape: list[int], batch_size: int = 1_024
) -> DataFrame:
    """Score with a model of the user's own: ``make_predictor()`` returns a batch function."""
    udf = predict_batch_udf(
        make_predictor,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[window_shape],
    )
    return predicted_class(windows.withColumn("probability", udf(F.flatten("X"))))


def search_classifier(
    train: DataFrame,
    validation: DataFrame,
    n: int,
    layout: SeriesLayout,
    grid: Iterable[dict],
    seed: int = SPLIT_SEED,
) -> tuple[object, list[tuple[dict, float]]]:
    """Best model by accuracy on the validation split, and the accuracy of every candidate.

    Without any validation window there is nothing to choose by and it fails. The given split is kept: drawing again at random would put windows of one event on both
    sides.
    """
    if validation.isEmpty():
        raise ValueError("the validation split has no window")
    results = []
    best = None
    for parameters in grid:
        model = fit_window_classifier(train, n, layout, seed=seed, **parameters)
        accuracy = accuracy_and_loss(score_windows(model, validation)).first()["accuracy"]
        if best is None or accuracy > best[1]:
            best = (model, accuracy)
        results.append((parameters, accuracy))
    return best[0], sorted(results, key=lambda r: -r[1])


def evaluate_model(model, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, confusion matrix, and accuracy with loss, for labelled windows.

    Scoring keeps the label on its row; predictions made elsewhere meet their labels through
    ``match_labels``.
    """
    scored = score_windows(model, windows)
    return scored, confusion_matrix(scored), accuracy_and_loss(scored)
