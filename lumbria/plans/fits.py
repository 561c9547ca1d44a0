"""Calibration and simulation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as ca
from .relational import T

c = F.col


def ways(s: SparkSession, d: str) -> DataFrame:
    """Orders' lines as ways: minutes are 1.5 a km, 0.8 more a km unpaved, 9 a trip, and some are far off."""
    km, off, k = c("l_quantity").cast("double"), c("l_partkey") % 3 == 0, (c("l_orderkey") * 7 + c("l_linenumber")) % 11
    odd = F.when(c("l_orderkey") % 37 == 0, 200.0).otherwise((k - 5) / 10.0)
    return T(s, d, "lineitem").select((c("l_suppkey") % 20).alias("district"), km.alias("km"), F.when(off, km).otherwise(0.0).alias("unpaved"), F.lit(1.0).alias("trip"), (1.5 * km + F.when(off, 0.8 * km).otherwise(0.0) + 9 + odd).alias("minutes"))


def _fit(s: SparkSession, d: str) -> DataFrame:
    beta = ca.robust_fit(ways(s, d), ["km", "unpaved", "trip"], "minutes", 0.5, {"trip": 8.0}, 1.0)
    return s.createDataFrame([(n, round(v, 6)) for n, v in beta.items()], "name string, value double")


def _folds(s: SparkSession, d: str) -> DataFrame:
    f = ca.cross_validated(ways(s, d), ["km", "unpaved", "trip"], "minutes", "district", 3, scale=0.5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.abs(c("predicted") - c("minutes")), F.lit(0.5)).alias("median_error"))


QUERIES = {
    "G21_robust_fit": (_fit, None),
    "G21_cross_validated": (_folds, None),
    "G36_simulated_sessions": (lambda s, d: ca.simulated_sessions(s, 200, 2026), None),
}
