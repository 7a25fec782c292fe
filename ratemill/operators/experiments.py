"""Compare model settings, and retrain on a schedule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ratemill.operators.factors import RatingModel, error_metrics, fit_biases, fit_factors, predict, with_split
from ratemill.operators.profile import dataset_stats
from ratemill.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Settings:
    run_name: str
    rank: int = 100
    max_iter: int = 20
    reg: float = 0.02
    seed: int = 42


# The compared settings. Factors and epochs become rank and iterations; ALS has no learning rate.
GRID = (
    Settings("default", 100, 20, 0.02),
    Settings("large_factors", 200, 25, 0.02),
    Settings("more_epochs", 100, 40, 0.02),
)
RETRAINING = Settings("retraining", 100, 40, 0.02)
RUN_COLUMNS = (
    "run_name string, rank int, max_iter int, reg double, rmse double, mae double, "
    "n_users long, n_products long, n_reviews long"
)


def _fit(split: DataFrame, settings: Settings) -> RatingModel:
    return fit_factors(split.filter("is_train"), settings.rank, settings.max_iter, settings.reg, settings.seed)


def _evaluate(split: DataFrame, model: RatingModel) -> tuple[float, float]:
    metrics = error_metrics(predict(split.filter(~F.col("is_train")), model)).first()
    return metrics["rmse"], metrics["mae"]


def _kept(split: DataFrame) -> DataFrame:
    """The narrow split ratings, computed once for all fits."""
    ensure_checkpoint_dir(split.sparkSession)
    return split.select("user_id", "product_id", "rating", "is_train").checkpoint()


def bias_runs(split: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """Hold-out errors of the biases for each setting of user_shrinkage and product_shrinkage; `split` has is_train."""
    split, rows = _kept(split), None
    for settings in grid:
        metrics = error_metrics(predict(split.filter(~F.col("is_train")), fit_biases(split.filter("is_train"), **settings)))
        named = metrics.select(*[F.lit(value).alias(name) for name, value in settings.items()], "rmse", "mae", "n")
        rows = named if rows is None else rows.unionByName(named)
    return rows


def compare(ratings: DataFrame, grid: tuple[Settings, ...] = GRID) -> tuple[DataFrame, RatingModel]:
    """One row per settings with its hold-out errors, and the model with the least RMSE."""
    split = _kept(with_split(ratings))
    size = dataset_stats(ratings).first()
    runs, best, best_rmse = [], None, None
    for settings in grid:
        model = _fit(split, settings)
        rmse, mae = _evaluate(split, model)
        runs.append(
            (
                settings.run_name, settings.rank, settings.max_iter, settings.reg, rmse, mae,
                size["total_users"], size["total_products"], size["total_reviews"],
            )
        )
        if best_rmse is None or rmse < best_rmse:
            best, best_rmse = model, rmse
    return ratings.sparkSession.createDataFrame(runs, RUN_COLUMNS), best


def retrain(
    ratings: DataFrame, folder: str, version: int, settings: Settings = RETRAINING, only_if_not_worse: bool = False
) -> float:
    """Fit, evaluate and save a new version; it becomes current unless it must not be worse and is.

    Returns the hold-out RMSE. Versions live in their own folders; which one is current is the last row of
    the append-only promotions table.
    """
    spark = ratings.sparkSession
    split = _kept(with_split(ratings))
    model = _fit(split, settings)
    rmse, _ = _evaluate(split, model)
    model.save(f"{folder}/version={version}")
    current = current_version(spark, folder)
    if current is None or not only_if_not_worse or rmse <= current[1]:
        row = spark.createDataFrame([(version, rmse)], "version long, rmse double")
        row.write.mode("append").parquet(f"{folder}/promotions")
    return rmse


def current_version(spark: SparkSession, folder: str) -> tuple[int, float] | None:
    """Version and RMSE of the current model; None before the first one."""
    try:
        promotions = spark.read.parquet(f"{folder}/promotions")
    except AnalysisException:
        return None
    row = promotions.orderBy(F.desc("version")).first()
    return (row["version"], row["rmse"]) if row else None


def load_current(spark: SparkSession, folder: str) -> RatingModel:
    current = current_version(spark, folder)
    if current is None:
        raise FileNotFoundError(f"no promoted model in {folder}")
    return RatingModel.load(spark, f"{folder}/version={current[0]}")
