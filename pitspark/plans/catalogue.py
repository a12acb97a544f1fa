"""All queries; importing the modules registers them."""

from pitspark.plans import activity, decisions, outcomes, point_in_time, sources_and_identity  # noqa: F401
from pitspark.plans.registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["i3_strategy_metrics_by_firm"](spark, sf_dir)
