"""Event-study and time-series steps. A series has one row a period; ``group_by`` keeps several series apart and distributed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns, need_one_of, need_positive
from weft.functions.scalars import moment, number

METHODS = ("moving_average", "holt", "seasonal_naive", "holt_winters")
_FORECAST = "period string, actual double, predicted double, lower double, upper double, horizon int"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _spread(errors) -> float:
    return 1.96 * float(np.std(errors, ddof=1)) if len(errors) > 1 else 0.0


def _smooth(y: np.ndarray, alpha: float, beta: float, gamma: float, season: int):
    """One-step predictions and the final state of additive smoothing with trend; ``season`` 0 has no seasonal part."""
    cycle = np.zeros(1)
    if season:
        first = y[:season].mean()
        level, slope, cycle = first, (y[season : 2 * season].mean() - first) / season, y[:season] - first
    else:
        level, slope = y[0], 0.0
    ahead = np.full(len(y), np.nan)
    for i in range(0 if season else 1, len(y)):
        k = i % len(cycle)
        ahead[i], last = level + slope + cycle[k], level
        level = alpha * (y[i] - cycle[k]) + (1 - alpha) * (level + slope)
        slope = beta * (level - last) + (1 - beta) * slope
        if season:
            cycle[k] = gamma * (y[i] - level) + (1 - gamma) * cycle[k]
    return ahead, level, slope, cycle


def forecast_values(y: np.ndarray, method: str, horizon: int, window: int, alpha: float, beta: float, gamma: float, season: int):
    """``(fitted, half widths, future, future half widths)``; NaN where nothing is claimed."""
    n, steps = len(y), np.arange(1, horizon + 1)
    fitted, half = np.full(n, np.nan), np.full(n, np.nan)
    if method == "moving_average":
        view = np.lib.stride_tricks.sliding_window_view(y, window)
        bands = np.array([_spread(v) for v in view])
        fitted[window:], half[window:] = view[:-1].mean(axis=1), bands[:-1]
        return fitted, half, np.full(horizon, view[-1].mean()), np.full(horizon, bands[-1])
    if method == "seasonal_naive":
        fitted[season:] = y[:-season]
        spread = _spread(y[season:] - y[:-season])
        half[season:] = spread
        return fitted, half, y[n - season + (steps - 1) % season], np.full(horizon, spread)
    seasonal = season if method == "holt_winters" else 0
    ahead, level, slope, cycle = _smooth(y, alpha, beta, gamma, seasonal)
    fitted[seasonal or 1 :] = ahead[seasonal or 1 :]
    spread = _spread((y - ahead)[seasonal or 1 :])
    return fitted, half, level + steps * slope + cycle[(n + steps - 1) % len(cycle)], spread * np.sqrt(steps)


def forecast(df: DataFrame, column: str, value_col: str, method: str = "moving_average", horizon: int = 3, window: int = 3, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2, season_len: int = 7, group_by: list[str] = ()) -> DataFrame:
    """``period, actual, predicted, lower, upper, horizon``: the fit (horizon 0) and ``horizon`` periods beyond, rounded to 4 places.

    Days without a number do not count. Two rows of a day, less than a day between most rows, or
    too few rows fail when the series is computed. Each series is one group of ``group_by``.
    """
    op = "forecast"
    need_columns(op, "columns", df, [column, value_col, *group_by])
    need_one_of(op, "method", method, METHODS)
    for name, v in (("horizon", horizon), ("window", window), ("season_len", season_len)):
        need_positive(op, name, v)
    for name, v in (("alpha", alpha), ("beta", beta), ("gamma", gamma)):
        if not 0 < v <= 1:
            raise OpError(op, name, f"{v!r} is not above 0 and up to 1")
    least = {"moving_average": window + 1, "holt": 3, "seasonal_naive": season_len + 1, "holt_winters": 2 * season_len}[method]
    keys = list(group_by)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        days, y = pdf["t"].to_numpy("datetime64[D]"), pdf["v"].to_numpy(float)
        if len(y) < least:
            raise OpError(op, "column", f"{len(y)} rows; {method} needs {least}")
        gaps = np.diff(days).astype(int)
        if (np.diff(pdf["t"].to_numpy()) == np.timedelta64(0)).any():
            raise OpError(op, "column", "two rows of one period")
        sizes, counts = np.unique(gaps, return_counts=True)
        step = int(sizes[counts.argmax()])
        if step < 1:
            raise OpError(op, "column", "most rows are less than a day apart")
        fitted, half, future, wide = forecast_values(y, method, horizon, window, alpha, beta, gamma, season_len)
        beyond = days[-1] + np.arange(1, horizon + 1) * step
        predicted, bands = np.concatenate([fitted, future]), np.concatenate([half, wide])
        out = pd.DataFrame({"period": np.concatenate([days, beyond]).astype(str), "actual": np.concatenate([y, np.full(horizon, np.nan)]), "predicted": predicted, "lower": predicted - bands, "upper": predicted + bands, "horizon": np.concatenate([np.zeros(len(y), int), np.arange(1, horizon + 1)])})
        out[["actual", "predicted", "lower", "upper"]] = out[["actual", "predicted", "lower", "upper"]].round(4)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "period", "actual", "predicted", "lower", "upper", "horizon"]]

    t = moment(_col(column), df.schema[column].dataType)
    rows = df.select(*map(_col, keys), t.alias("t"), number(_col(value_col)).alias("v")).where("t is not null and v is not null")
    schema = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys) + _FORECAST
    return rows.groupBy(*keys).applyInPandas(fit, schema).select(*keys, "period", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("actual", "predicted", "lower", "upper")], "horizon")


def alert(df: DataFrame, column: str, index_col: str = "sentiment_index", intensity_col: str = "", volume_col: str = "", streak: int = 2, swing: float = 0.2, heating: float = 0.15, volume_floor: float = 0.6, group_by: list[str] = ()) -> DataFrame:
    """``period, signal, value, threshold``: where an index turns or an intensity rises over ``streak`` periods.

    ``turning``: the last ``streak`` moves share a sign and are each at least ``swing``;
    ``heating``: the intensity rose by ``heating`` a period or more; both join with ``+``. A signal is
    ``(suppressed)`` where the volume is under ``volume_floor`` times the mean of the periods
    before. A series without signals has one row ``none`` with its largest move.
    """
    op = "alert"
    names = [c for c in (index_col, intensity_col, volume_col) if c]
    need_columns(op, "columns", df, [column, *names, *group_by])
    need_positive(op, "streak", streak)
    if not 0 <= volume_floor <= 1:
        raise OpError(op, "volume_floor", f"{volume_floor!r} is not from 0 to 1")
    keys = [_col(k) for k in group_by]
    w = Window.partitionBy(*keys).orderBy("t")
    cell = lambda c: number(_col(c)) if c else F.lit(None).cast("double")
    rows = df.select(*keys, _col(column).cast("string").alias("period"), moment(_col(column), df.schema[column].dataType).alias("t"), cell(index_col).alias("i"), cell(intensity_col).alias("s"), cell(volume_col).alias("v")).where("t is not null")
    rows = rows.withColumn("move", F.col("i") - F.lag("i").over(w)).withColumn("moves", F.collect_list("move").over(w.rowsBetween(-(streak - 1), 0)))
    rows = rows.withColumn("rise", (F.col("s") - F.lag("s", streak).over(w)) / streak).withColumn("usual", F.avg("v").over(w.rowsBetween(-streak, -1)))
    whole = (F.size("moves") == streak) & F.lag("i", streak).over(w).isNotNull() & F.col("i").isNotNull()
    one_way = F.forall("moves", lambda m: m > 0) | F.forall("moves", lambda m: m < 0)
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumn("turned", F.col("whole") & one_way & F.forall("moves", lambda m: F.abs(m) >= swing)).withColumn("heated", F.col("whole") & F.coalesce(F.col("rise") >= heating, F.lit(False)))
    rows = rows.withColumn("biggest", F.when(F.col("whole"), F.array_max(F.transform("moves", F.abs))))
    sized = F.aggregate("moves", F.lit(0.0), lambda a, m: a + F.abs(m)) / streak
    kind = F.concat_ws("+", F.when(F.col("turned"), "turning"), F.when(F.col("heated"), "heating"))
    low = F.coalesce(F.col("v") < F.lit(volume_floor) * F.col("usual"), F.lit(False))
    signals = rows.where("turned or heated").select(*keys, "period", F.concat(kind, F.when(low, " (suppressed)").otherwise("")).alias("signal"), F.round(F.when(F.col("turned"), sized).otherwise(F.col("rise")), 4).alias("value"), F.when(F.col("turned"), swing).otherwise(heating).alias("threshold"))
    calm = rows.groupBy(*keys).agg(F.max_by("period", "t").alias("period"), F.max("biggest").alias("value"), F.max(F.col("turned") | F.col("heated")).alias("any"))
    calm = calm.where("not any").select(*keys, "period", F.lit("none").alias("signal"), F.round("value", 4).alias("value"), F.lit(float(swing)).alias("threshold"))
    return signals.unionByName(calm)


def daily_counts(df: DataFrame, column: str) -> DataFrame:
    """``(day, n)`` for every calendar day from the first to the last, days without rows at 0."""
    need_columns("daily_counts", "column", df, [column])
    days = df.select(moment(_col(column), df.schema[column].dataType).cast("date").alias("day")).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    calendar = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return calendar.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def stage_starts(n: np.ndarray, min_days: int, max_windows: int, peak_ratio: float) -> list[tuple[int, int | None]]:
    """``(first day, valley before it)`` of the stages of a daily curve; one stage if it has under two peaks.

    Days at ``peak_ratio`` times the usual (median) busy day are high. High days at most two
    apart join if the three-day mean stays high between them. Stages part after the lowest
    smoothed day between two peaks; stages under ``min_days`` join their larger neighbour.
    """
    floor = float(np.median(n[n > 0])) * peak_ratio
    padded = np.concatenate([[np.nan], n.astype(float), [np.nan]])
    mean = np.nanmean(np.stack([padded[:-2], padded[1:-1], padded[2:]]), axis=0)
    high = np.nonzero(n >= floor)[0]
    cuts = [k for k in range(1, len(high)) if high[k] - high[k - 1] > 2 or (mean[high[k - 1] : high[k] + 1] < floor).any()]
    peaks = [int(run[n[run].argmax()]) for run in np.split(high, cuts) if len(run)]
    peaks = sorted(sorted(peaks, key=lambda p: (-n[p], p))[:max_windows])
    starts: list[tuple[int, int | None]] = [(0, None)]
    for a, b in zip(peaks, peaks[1:], strict=False):
        if b - a > 1:
            valley = a + 1 + int(mean[a + 1 : b].argmin())
            if starts[-1][0] < valley + 1 < len(n):
                starts.append((valley + 1, valley))
    while len(starts) > 1:
        lengths = np.diff([s for s, _ in starts] + [len(n)])
        k = int(lengths.argmin())
        if lengths[k] >= min_days:
            break
        before = lengths[k - 1] if k else -1
        after = lengths[k + 1] if k + 1 < len(lengths) else -1
        starts.pop(k if before >= after and k else k + 1)
    return starts


def suggest_stages(df: DataFrame, column: str, min_days: int = 3, max_windows: int = 6, peak_ratio: float = 2.0) -> DataFrame:
    """``(stage, start, end, days, rows, peak_day, peak_count, valley)``: stages of the daily row count.

    The rows are counted by day first; only the calendar (a row a day) meets in one group.
    """
    op = "suggest_stages"
    for name, v in (("min_days", min_days), ("max_windows", max_windows)):
        need_positive(op, name, v)
    if peak_ratio < 1:
        raise OpError(op, "peak_ratio", f"{peak_ratio} is under 1: every usual day would be a peak")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        n, days = pdf["n"].to_numpy(), pdf["day"].to_numpy("datetime64[D]")
        if len(n) < 2 * min_days:
            raise OpError(op, "column", f"{len(n)} days; {2 * min_days} are needed")
        starts = stage_starts(n, min_days, max_windows, peak_ratio)
        rows = []
        for k, ((a, valley), b) in enumerate(zip(starts, [*(s for s, _ in starts[1:]), len(n)], strict=True), 1):
            top = a + int(n[a:b].argmax())
            rows.append((k, str(days[a]), str(days[b - 1]), b - a, int(n[a:b].sum()), str(days[top]), int(n[top]), "" if valley is None else str(days[valley])))
        return pd.DataFrame(rows, columns=["stage", "start", "end", "days", "rows", "peak_day", "peak_count", "valley"])

    return daily_counts(df, column).groupBy().applyInPandas(cut, "stage int, start string, end string, days int, rows bigint, peak_day string, peak_count bigint, valley string")


def stage_order(df: DataFrame, stage_col: str, order_col: str = "", time_col: str = "") -> DataFrame:
    """``(stage, position)`` from 1: by the least order number, else by the earliest moment."""
    op = "stage_order"
    need_columns(op, "columns", df, [stage_col, *[c for c in (order_col, time_col) if c]])
    if not order_col and not time_col:
        raise OpError(op, "order_col", "stages have no order of their own; name an order or a time column")
    key = number(_col(order_col)) if order_col else moment(_col(time_col), df.schema[time_col].dataType)
    stages = df.where(_col(stage_col).isNotNull()).groupBy(_col(stage_col).alias("stage")).agg(F.min(key).alias("k"))
    return stages.select("stage", F.row_number().over(Window.orderBy(F.col("k").asc_nulls_last(), "stage")).alias("position"))  # a row a stage


def peak_counts(df: DataFrame, key_col: str, time_col: str, minutes: int = 10) -> DataFrame:
    """``(key, posts, peak)``: all rows of a key, and the most in any span of so many minutes."""
    need_columns("peak_counts", "columns", df, [key_col, time_col])
    rows = df.select(_col(key_col).alias("key"), F.unix_timestamp(moment(_col(time_col), df.schema[time_col].dataType).cast("timestamp")).alias("t")).where("key is not null and t is not null")
    by_second = rows.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"))
    span = F.sum("n").over(Window.partitionBy("key").orderBy("t").rangeBetween(0, 60 * minutes))
    return by_second.withColumn("span", span).groupBy("key").agg(F.sum("n").alias("posts"), F.max("span").alias("peak"))


def rolling_mean(df: DataFrame, order_col: str, value_col: str, before: int = 1, after: int = 1, group_by: list[str] = (), new_col: str = "rolling_mean") -> DataFrame:
    """The mean of a row and its neighbours in order."""
    need_columns("rolling_mean", "columns", df, [order_col, value_col, *group_by])
    w = Window.partitionBy(*map(_col, group_by)).orderBy(_col(order_col)).rowsBetween(-before, after)
    return df.withColumn(new_col, F.avg(number(_col(value_col))).over(w))
