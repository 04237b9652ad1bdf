"""The whole analysis as one batch job: every output is a written table, and later
outputs read the earlier ones back, so a failed run can be taken up in the middle. Tables
that an output needs only for itself are removed once it is written."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from retentia.operators import activity, metrics, quality, survival, woe
from retentia.operators.joins import union_by_position
from retentia.plans import reports
from retentia.sources.tables import read_table, scratch_scope, write_table


@dataclass
class Job:
    """Inputs, settings and the place of the outputs.

    ``labels`` and ``updates`` have the key and a 0/1 label; ``members``,
    ``transactions`` and ``logs`` the columns named in FIXTURES.md. The two-file
    inputs are given as sequences.
    """

    spark: SparkSession
    out_dir: str
    labels: DataFrame
    updates: DataFrame
    members: DataFrame
    transactions: Sequence[DataFrame]
    logs: Sequence[DataFrame]
    key: str = "user_id"
    date: str = "date"
    since_year: int = 2015
    fmt: str = "parquet"
    model_settings: dict = field(default_factory=dict)

    def all_logs(self) -> DataFrame:
        first, *rest = self.logs
        for other in rest:
            first = union_by_position(first, other)
        return first

    def path(self, name: str) -> str:
        return f"{self.out_dir.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        """An output with the types it was written with, also by an earlier run."""
        schema = None
        if self.fmt != "parquet":
            text = self.spark.read.text(f"{self.path(name)}.schema").first()[0]
            schema = StructType.fromJson(json.loads(text))
        return read_table(self.spark, self.path(name), schema=schema, fmt=self.fmt)

    def write(self, name: str, df: DataFrame) -> None:
        """Writes an output; formats that do not keep types get a schema beside it, as JSON."""
        if self.fmt != "parquet":
            row = self.spark.createDataFrame([(df.schema.json(),)], "value string")
            row.coalesce(1).write.mode("overwrite").text(f"{self.path(name)}.schema")
        write_table(df, self.path(name), fmt=self.fmt)


def _model_columns(features: DataFrame) -> list[str]:
    """The columns the models use, as far as the elimination kept them."""
    kept = [c for c in reports.MODEL_COLUMNS if c in features.columns]
    if not kept:
        raise ValueError(f"none of {list(reports.MODEL_COLUMNS)} is among the reduced features")
    return kept


def _scored_models(job: Job) -> DataFrame:
    features = job.read("reduced_features")
    return reports.scored_models(features, job.key, _model_columns(features), **job.model_settings)


BY_MODEL = ["model", "split"]
# The cuts of the sweep and the months at which the hazard is read.
THRESHOLDS = [i / 20 for i in range(1, 20)]
HAZARD_MONTHS = [6, 12, 18, 24]
MONTH_BINS = 10


def _nth(n: int, suffix: str) -> Callable[[Job], DataFrame]:
    return lambda j: activity.nth_of_recent(
        j.read("activity_recent_rows"), j.key, j.date, n, activity.activity_measures(), suffix
    )


ACTIVITY = (
    *(f"activity_{suffix}" for suffix in activity.RECENCY_SUFFIXES),
    "activity_last_3_sums",
    "activity_lifetime_sums",
)

# Name of every output and how it is made, in the order of their making.
OUTPUTS: dict[str, Callable[[Job], DataFrame]] = {
    "churn_target": lambda j: reports.churn_target(
        j.labels.toDF(j.key, "is_churn"), j.updates.toDF(j.key, "is_churn_update"), j.key
    ),
    "labelled_transactions": lambda j: reports.labelled_transactions(
        j.read("churn_target"), j.transactions, j.key
    ),
    "transaction_checks": lambda j: reports.transaction_checks(*j.transactions, j.key),
    "log_checks": lambda j: reports.log_checks(*j.logs, j.key, j.date),
    "clean_members": lambda j: reports.clean_members(j.read("churn_target"), j.members, j.key),
    "cohort_transactions": lambda j: reports.cohort_transactions(
        j.read("labelled_transactions"), j.read("clean_members"), j.since_year, j.key
    ),
    "consolidated_logs": lambda j: reports.consolidated_logs(
        *j.logs, j.read("churn_target"), j.key, j.date
    ),
    # The logs are read for these rows and for the lifetime sums, and for no other feature.
    "activity_recent_rows": lambda j: activity.recent_rows(
        j.all_logs(), j.key, j.date, len(activity.RECENCY_SUFFIXES)
    ),
    **{
        f"activity_{suffix}": _nth(n, suffix)
        for n, suffix in enumerate(activity.RECENCY_SUFFIXES, start=1)
    },
    "activity_last_3_sums": lambda j: activity.sums_of_recent(
        j.read("activity_recent_rows"), j.key, 3, activity.activity_measures()
    ),
    "activity_lifetime_sums": lambda j: activity.lifetime_sums(
        j.all_logs(), j.key, activity.activity_measures()
    ),
    "encoding_table": lambda j: reports.encoding_table(j.read("clean_members"), j.key),
    "information_value": lambda j: woe.iv_table(j.read("encoding_table")),
    "encoded_members": lambda j: reports.encode(j.read("clean_members"), j.read("encoding_table"), j.key),
    "wide_features": lambda j: reports.wide_features(
        j.read("encoded_members"), [j.read(name) for name in ACTIVITY], j.key, j.date
    ),
    "feature_ranking": lambda j: reports.feature_ranking(j.read("wide_features"), j.key),
    "reduced_features": lambda j: reports.reduced_features(
        j.read("wide_features"), j.key, ranked=j.read("feature_ranking")
    ),
    "model_coefficients": lambda j: reports.model_coefficients(
        j.read("reduced_features"), j.key, _model_columns(j.read("reduced_features"))
    ),
    "model_scores": _scored_models,
    "model_comparison": lambda j: metrics.model_report(j.read("model_scores"), by=BY_MODEL),
    "model_roc_curves": lambda j: metrics.roc_curve(j.read("model_scores"), by=BY_MODEL),
    "model_pr_curves": lambda j: metrics.pr_curve(j.read("model_scores"), by=BY_MODEL),
    "model_threshold_sweep": lambda j: metrics.threshold_sweep(
        j.read("model_scores"), THRESHOLDS, by=BY_MODEL
    ),
    "survival_table": lambda j: reports.survival_table(j.read("cohort_transactions"), j.key),
    "survival_curves": lambda j: reports.survival_curves(j.read("survival_table")),
    "median_survival": lambda j: survival.median_survival(j.read("survival_curves")),
    "hazard_at_months": lambda j: survival.curve_at(
        j.read("survival_curves"), HAZARD_MONTHS, "cumulative_hazard"
    ),
    "month_histogram": lambda j: quality.histogram(j.read("survival_table"), "month", MONTH_BINS),
    "churn_by_registration": lambda j: reports.churn_by_registration(j.read("clean_members")),
    "churn_by_age": lambda j: reports.churn_by_age(j.read("clean_members")),
    "churn_by_city": lambda j: reports.churn_by_city(j.read("clean_members")),
    "churn_by_city_group": lambda j: reports.churn_by_city_group(j.read("clean_members")),
    "churn_by_segment": lambda j: reports.churn_by_segment(j.read("clean_members")),
}


def run(job: Job, only: Sequence[str] | None = None) -> dict[str, str]:
    """Makes the outputs (all, or those named, whose inputs must exist) and returns their paths."""
    unknown = set(only or ()) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"no such output: {sorted(unknown)}")
    done = {}
    for name, make in OUTPUTS.items():
        if only is None or name in only:
            with scratch_scope(job.spark):
                job.write(name, make(job))
            done[name] = job.path(name)
    return done
