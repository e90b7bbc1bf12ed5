"""Panel forecasting and news analytics as Spark DataFrame operators."""

from panelforecast.operators.panel import LagSpec, lag_features
from panelforecast.plans.datasets import prepare_dataset
from panelforecast.plans.evaluation import model_eval

__all__ = ["LagSpec", "lag_features", "prepare_dataset", "model_eval"]
