"""The layered build: DataFrame jobs, SQL models, and the gated run."""

from strata.plans.increments import (
    run_bronze_batch,
    run_gold_increment,
    run_increment,
    run_silver_increment,
)
from strata.plans.jobs import (
    aggregate,
    clean,
    run_all,
    run_bronze,
    run_gold,
    run_silver,
)
from strata.plans.models import (
    build_model,
    clean_model,
    daily_model,
    run_gated,
    run_gold_model,
    run_silver_model,
)

__all__ = [
    "aggregate",
    "build_model",
    "clean",
    "clean_model",
    "daily_model",
    "run_all",
    "run_bronze",
    "run_bronze_batch",
    "run_gated",
    "run_gold",
    "run_gold_increment",
    "run_gold_model",
    "run_increment",
    "run_silver",
    "run_silver_increment",
    "run_silver_model",
]
