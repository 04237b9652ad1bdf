"""A session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning does the partition sizing and the splitting of skewed
# join sides; UTC keeps date arithmetic the same on every machine.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(
    app: str = "retentia", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Build (or fetch) a session; ``conf`` adds to or overrides the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
