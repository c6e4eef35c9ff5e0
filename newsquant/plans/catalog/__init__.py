"""The query catalogue: every query beside the SQL that checks it."""

from newsquant.plans.catalog.registry import ORACLES, QUERIES
from newsquant.plans.catalog import news, explore, medoids, prices, samples, text, trading, models, forecasts, names, streams  # noqa: F401, I001

__all__ = ["ORACLES", "QUERIES"]
