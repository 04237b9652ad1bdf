"""Tenure tables and survival curves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import as_col
from retentia.operators.joins import semi_filter, union_by_name
from retentia.operators.ordered import ONE_TASK_ROWS, running_totals
from retentia.sources.tables import materialize


def tenure(
    df: DataFrame,
    key: str,
    date: str,
    event: str,
    keep_single: bool = False,
    tie: str | None = None,
    out: str = "month",
) -> DataFrame:
    """Months from the first to the last row of every key, and its event.

    The months are summed over the gaps between consecutive dates and rounded to
    whole ones. Keys with a single row have no gap and are left out, unless
    ``keep_single`` gives them 0. The event is the first non-null one by date.

    Repeated dates add nothing to the sum, so a key is reduced to its distinct
    dates (no more than the calendar has) before the shuffle.
    """
    rank = F.struct(F.col(date), *([F.col(tie)] if tie else []))
    per_key = (
        df.where(F.col(date).isNotNull())
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_set(F.col(date).cast("date"))).alias("_days"),
            F.count("*").alias("_rows"),
            F.min_by(F.col(event), F.when(F.col(event).isNotNull(), rank)).alias(event),
        )
    )
    if not keep_single:
        per_key = per_key.where(F.col("_rows") > 1)
    days = F.col("_days")
    pairs = F.arrays_zip(
        F.slice(days, F.lit(1), F.size(days) - 1).alias("from"),
        F.slice(days, F.lit(2), F.size(days) - 1).alias("to"),
    )
    total = F.aggregate(
        pairs, F.lit(0.0), lambda months, d: months + F.months_between(d["to"], d["from"])
    )
    return per_key.select(key, event, F.round(total, 0).alias(out))


_LIFE = ("timeline", "removed", "observed", "at_risk")


def _time_counts(df: DataFrame, t: str, e: str) -> tuple[DataFrame, int]:
    """``(timeline, removed, observed)`` per distinct time as a written table, and its number of rows."""
    known = df.where(F.col(t).isNotNull() & F.col(e).isNotNull())
    counts = known.groupBy(F.col(t).cast("double").alias("timeline")).agg(
        F.count("*").alias("removed"), F.count_if(F.col(e) == 1).alias("observed")
    )
    origin = df.sparkSession.createDataFrame(
        [(0.0, 0, 0)], "timeline double, removed bigint, observed bigint"
    )
    counts = (
        counts.unionByName(origin)
        .groupBy("timeline")
        .agg(F.sum("removed").alias("removed"), F.sum("observed").alias("observed"))
    )
    written = materialize(counts, "times")
    return written, written.count()


def _at_risk(counts: DataFrame, rows: int, one_task_rows: int) -> DataFrame:
    sums = {"at_risk": F.col("removed")}
    left = running_totals(
        counts, ["timeline"], sums, descending=True, one_task_rows=one_task_rows, rows=rows
    )
    return left.select(*_LIFE)


def life_table(
    df: DataFrame, t: str, e: str, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """``(timeline, removed, observed, at_risk)`` per distinct time, from time 0 on.

    Rows without a duration or an event flag are left out.
    """
    return _at_risk(*_time_counts(df, t, e), one_task_rows)


def _summed(
    df: DataFrame, t: str, e: str, sums: dict[str, Column], one_task_rows: int
) -> DataFrame:
    """The life table with running sums over time; ``df`` is read once."""
    counts, rows = _time_counts(df, t, e)
    table = _at_risk(counts, rows, one_task_rows)
    return running_totals(table, ["timeline"], sums, one_task_rows=one_task_rows, rows=rows)


def _km_sums() -> dict[str, Column]:
    """What has to be summed over time for the survival function and its variance."""
    d, n = F.col("observed"), F.col("at_risk")
    alive = n > d
    return {
        "_log": F.when(alive, F.log1p(-d / n)).otherwise(F.lit(0.0)),
        "_end": F.when(alive | (d == 0), 0).otherwise(1),
        "_var": F.when(alive, d / (n.cast("double") * (n - d))).otherwise(F.lit(0.0)),
    }


def _km_columns(ci: float) -> list[Column]:
    ended, log_s = F.col("_end") > 0, F.col("_log")
    survival = F.when(ended, 0.0).otherwise(F.exp(log_s))
    z = NormalDist().inv_cdf(1 - (1 - ci) / 2)

    def band(sign: int) -> Column:
        spread = F.lit(sign * z) * F.sqrt("_var") / log_s
        inner = F.exp(-F.exp(F.log(-log_s) + spread))
        return F.when(ended, F.lit(None)).when(log_s == 0, 1.0).otherwise(inner)

    return [
        survival.alias("km_estimate"),
        band(-1).alias("km_lower"),
        band(1).alias("km_upper"),
        (1 - survival).alias("cumulative_density"),
    ]


def kaplan_meier(
    df: DataFrame, t: str, e: str, ci: float = 0.95, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Product-limit survival function with a log(-log) band from Greenwood's variance.

    Columns: timeline, removed, observed, at_risk, km_estimate, km_lower, km_upper,
    cumulative_density. Where survival is 1 so is the band; where it is 0 the band
    is null.
    """
    summed = _summed(df, t, e, _km_sums(), one_task_rows)
    return summed.select(*_LIFE, *_km_columns(ci))


def median_survival(km: DataFrame) -> DataFrame:
    """One row: the first time survival is at or below a half, infinite if never."""
    # The tolerance covers rounding in the sum of logs where survival is exactly 1/2.
    below = F.min(F.when(F.col("km_estimate") <= 0.5 + 1e-12, F.col("timeline")))
    return km.agg(F.coalesce(below, F.lit(float("inf"))).alias("median"))


# From this many on the asymptotic series of the harmonic numbers is exact to
# double precision; below it their differences are listed.
_SERIES_FROM = 32


def harmonic_difference(n: Column, m: Column) -> Column:
    """1/(m+1) + 1/(m+2) + ... + 1/n for 0 <= m <= n, without a loop over the terms."""

    def series(high: Column, low: Column) -> Column:
        def tail(x: Column) -> Column:
            return 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)

        return F.log(high / low) + tail(high) - tail(low)

    listed = [math.fsum(1 / k for k in range(1, i + 1)) for i in range(_SERIES_FROM + 1)]
    small = F.array(*[F.lit(v) for v in listed])
    bound = F.lit(_SERIES_FROM)

    def at(x: Column) -> Column:
        return F.get(small, F.least(x, bound).cast("int"))

    top, base = F.greatest(n, bound).cast("double"), F.greatest(m, bound).cast("double")
    return series(top, base) + (at(n) - at(m))


def _hazard_step(ties: str) -> Column:
    d, n = F.col("observed"), F.col("at_risk")
    if ties == "fh":
        step = harmonic_difference(n, n - d)
    elif ties == "plain":
        step = F.try_divide(d, n)
    else:
        raise ValueError("ties is 'fh' or 'plain'")
    return F.when(d > 0, step).otherwise(F.lit(0.0))


def nelson_aalen(
    df: DataFrame, t: str, e: str, ties: str = "fh", one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Cumulative hazard per time.

    ``ties='plain'`` adds d/n per time; ``'fh'`` counts the d events of one time
    as if they came one after the other.
    """
    sums = {"cumulative_hazard": _hazard_step(ties)}
    return _summed(df, t, e, sums, one_task_rows).select(*_LIFE, "cumulative_hazard")


def survival_curves(
    df: DataFrame,
    t: str,
    e: str,
    ci: float = 0.95,
    ties: str = "fh",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``kaplan_meier`` and ``nelson_aalen`` side by side, from one life table."""
    sums = {**_km_sums(), "cumulative_hazard": _hazard_step(ties)}
    summed = _summed(df, t, e, sums, one_task_rows)
    return summed.select(*_LIFE, *_km_columns(ci), "cumulative_hazard")


def curve_at(curve: DataFrame, times: Sequence[float], value: str, exact: bool = False) -> DataFrame:
    """The curve at given times: its last value at or before each of them.

    ``exact`` returns only times that occur in the curve.
    """
    if exact:
        return curve.where(F.col("timeline").isin([float(x) for x in times])).select(
            "timeline", value
        )
    row = curve.agg(
        *[
            F.max_by(F.col(value), F.when(F.col("timeline") <= x, F.col("timeline"))).alias(f"v{i}")
            for i, x in enumerate(times)
        ]
    )
    cells = [
        F.struct(F.lit(float(x)).alias("timeline"), F.col(f"v{i}").alias(value))
        for i, x in enumerate(times)
    ]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def cohort(
    transactions: DataFrame,
    members: DataFrame,
    since_year: int,
    key: str,
    date: str,
    registered: str,
    year: str,
) -> DataFrame:
    """Transactions of members registered from ``since_year`` on, plus their registrations.

    A registration is added as a row of its own, with only key and date, unless
    the member has a transaction on that day. Reads the transactions twice, the second
    time only their key and date.
    """
    since = members.where(F.col(year) >= since_year)
    kept = semi_filter(transactions, since, key)
    starts = since.select(key, as_col(registered).alias(date))
    # Reduced to the starts before the distinct, so at most one date a member is left.
    known = semi_filter(transactions.select(key, date), starts, [key, date]).distinct()
    return union_by_name(kept, starts.join(known, [key, date], "left_anti"))
