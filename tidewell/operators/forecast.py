"""Forecasts and anomalies of series of buckets.

A series' buckets go to one task, as a smoothing is a recursion over all of them;
a query's range and interval bound their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _smoothed(values: np.ndarray, season: int, alpha: float, beta: float, gamma: float, phi: float, ahead: int) -> np.ndarray:
    """Fitted values and then ``ahead`` forecasts, with a damped trend and, from
    a season of two on, factors for each place in it."""
    m = season if season >= 2 else 1
    level = values[:m].mean()
    trend = (values[m : 2 * m].mean() - level) / m if len(values) >= 2 * m and m > 1 else (values[1] - values[0] if len(values) > 1 else 0.0)
    factors = list(values[:m] / level) if m > 1 and level else [1.0] * m
    out = np.empty(len(values) + ahead)
    for i, v in enumerate(values):
        factor, before = factors[i % m], level
        out[i] = (level + phi * trend) * factor
        level = alpha * (v / factor if factor else v) + (1 - alpha) * (level + phi * trend)
        trend = beta * (level - before) + (1 - beta) * phi * trend
        if m > 1 and level:
            factors[i % m] = gamma * v / level + (1 - gamma) * factor
    reach = 0.0
    for h in range(ahead):
        reach += phi ** (h + 1)
        out[len(values) + h] = (level + reach * trend) * factors[(len(values) + h) % m]
    return out


def nelder_mead(f, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """A minimum of ``f`` by the simplex method, within 0 and 1."""
    points = [np.clip(p, 0, 1) for p in [start, *(start + 0.2 * e for e in np.eye(len(start)))]]
    costs = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(costs, kind="stable")
        points, costs = [points[i] for i in order], [costs[i] for i in order]
        if costs[-1] - costs[0] <= 1e-10 * (abs(costs[0]) + 1e-10):
            break
        centre, worst = np.mean(points[:-1], 0), points[-1]
        tried = np.clip(centre + (centre - worst), 0, 1)
        cost = f(tried)
        if cost < costs[0]:
            far = np.clip(centre + 2 * (centre - worst), 0, 1)
            points[-1], costs[-1] = min(((tried, cost), (far, f(far))), key=lambda x: x[1])
        elif cost < costs[-2]:
            points[-1], costs[-1] = tried, cost
        else:
            near = centre + 0.5 * (worst - centre)
            cost = f(near)
            if cost < costs[-1]:
                points[-1], costs[-1] = near, cost
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                costs = [costs[0], *(f(p) for p in points[1:])]
    return points[int(np.argmin(costs))]


def fitted(values: np.ndarray, ahead: int, season: int = 0) -> np.ndarray:
    """Fitted values and forecasts with the parameters that err least."""
    values = np.asarray(values, float)
    if len(values) < max(2, 2 * season if season >= 2 else 2):
        return np.full(len(values) + ahead, values[-1] if len(values) else np.nan)
    error = lambda p: float(np.sum((_smoothed(values, season, *p, 0) - values) ** 2))
    best = nelder_mead(error, np.array([0.5, 0.1, 0.1, 0.95]))
    return _smoothed(values, season, *best, ahead)


def holt_winters(buckets: DataFrame, by: tuple[str, ...], value: str, every: int, ahead: int, season: int = 0, with_fit: bool = False) -> DataFrame:
    """by, time, value: ``ahead`` buckets after each series' last one, and the
    fitted ones before, if asked for. Missing buckets are carried over."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[value]).sort_values("time")
        if not len(rows):
            return pd.DataFrame({**{b: [] for b in by}, "time": [], "value": []})
        first, last = int(rows["time"].iloc[0]), int(rows["time"].iloc[-1])
        steps = np.arange(first, last + 1, every)
        known = pd.Series(rows[value].to_numpy(float), index=rows["time"]).reindex(steps).ffill().to_numpy()
        out = fitted(known, ahead, season)
        times = np.arange(first, first + every * len(out), every)
        keep = slice(None) if with_fit else slice(len(known), None)
        return pd.DataFrame({**{b: rows[b].iloc[0] for b in by}, "time": times[keep], "value": out[keep]})

    kinds = {f.name: f.dataType.simpleString() for f in buckets.schema}
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "time long, value double"])
    return buckets.groupBy(*by).applyInPandas(run, schema)


def residual_scores(values: np.ndarray, width: int) -> np.ndarray:
    """How far each value lies from the median of those around it, in robust
    deviations of all such distances."""
    series = pd.Series(np.asarray(values, float))
    rest = series - series.rolling(width, center=True, min_periods=1).median()
    spread = 1.4826 * float((rest - rest.median()).abs().median())
    return np.where(rest == 0, 0.0, rest.to_numpy() / spread if spread > 0 else np.sign(rest.to_numpy()) * np.inf)


#: Values that a step over many series sorts or gathers at a time.
_BLOCK = 4_000_000


def _by_length(starts: np.ndarray, ends: np.ndarray):
    """Series of one length each time, as their places and an index of their values
    with a row for each: reduced along it, a row goes as the series alone would."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        length = int(lengths[same[0]])
        step = max(1, _BLOCK // max(1, length))
        for i in range(0, len(same), step):
            places = same[i : i + step]
            yield places, starts[places][:, None] + np.arange(length)


def _local_medians(rows: np.ndarray, width: int) -> np.ndarray:
    """Of each row's values the median of ``width`` around it, as far as there are."""
    right = (width - 1) // 2
    left, length = width - 1 - right, rows.shape[1]
    place = np.arange(length)
    count = np.minimum(place + right, length - 1) - np.maximum(place - left, 0) + 1
    out = np.empty_like(rows)
    step = max(1, _BLOCK // width)
    per = max(1, step // length)
    for i in range(0, len(rows), per):
        padded = np.pad(rows[i : i + per], ((0, 0), (left, right)), constant_values=np.inf)
        windows = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)
        for j in range(0, length, step):
            part, n = np.sort(windows[:, j : j + step], axis=2), count[j : j + step]
            low, high = (np.take_along_axis(part, np.broadcast_to(k[None, :, None], (len(part), len(n), 1)), 2)[..., 0] for k in ((n - 1) // 2, n // 2))
            out[i : i + per, j : j + step] = np.where(n % 2 == 1, low, (low + high) / 2)
    return out


def residual_scores_of_many(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """``residual_scores`` of each series from a start to its end."""
    out = np.empty(len(values))
    for places, index in _by_length(starts, ends):
        rows = values[index]
        if not (isinstance(width, int) and 1 <= width <= 1000 and np.isfinite(rows).all()):
            for a, b in zip(starts[places], ends[places]):
                out[a:b] = residual_scores(values[a:b], width)
            continue
        rest = rows - _local_medians(rows, width)
        spread = 1.4826 * np.median(np.abs(rest - np.median(rest, axis=1)[:, None]), axis=1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[index] = np.where(rest == 0, 0.0, np.where(spread > 0, rest / spread, np.sign(rest) * np.inf))
    return out


class Detector:
    """What ``detected`` runs over a series: subclass and return scores.

    ``fit_each`` and ``scores_each`` take the values of many series, each from a
    start to its end; a subclass may do them at once where that gives the same.
    """

    def __init__(self, **parameters):
        self.parameters = parameters

    def fit(self, values: np.ndarray) -> dict:
        """A model as plain numbers."""
        return {}

    def scores(self, values: np.ndarray, model: dict) -> np.ndarray:
        raise NotImplementedError

    def fit_each(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
        return [self.fit(values[a:b]) for a, b in zip(starts, ends)]

    def scores_each(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, models: list[dict]) -> np.ndarray:
        return np.concatenate([np.asarray(self.scores(values[a:b], m), float) for a, b, m in zip(starts, ends, models)])


class LocalMedian(Detector):
    """Distance from the median of the points around."""

    def scores(self, values, model):
        return residual_scores(values, self.parameters.get("width", 11))

    def scores_each(self, values, starts, ends, models):
        if type(self) is not LocalMedian:
            return super().scores_each(values, starts, ends, models)
        return residual_scores_of_many(values, starts, ends, self.parameters.get("width", 11))


class Deviation(Detector):
    """Distance from the mean of a fit, in its deviations."""

    def fit(self, values):
        return {"mean": float(np.mean(values)), "sd": float(np.std(values))}

    def fit_each(self, values, starts, ends):
        if type(self) is not Deviation:
            return super().fit_each(values, starts, ends)
        mean, sd = np.empty(len(starts)), np.empty(len(starts))
        for places, index in _by_length(starts, ends):
            rows = values[index]
            mean[places], sd[places] = np.mean(rows, axis=1), np.std(rows, axis=1)
        return [{"mean": m, "sd": d} for m, d in zip(mean.tolist(), sd.tolist())]

    def scores(self, values, model):
        away = np.asarray(values, float) - model["mean"]
        return away / model["sd"] if model["sd"] > 0 else np.where(away == 0, 0.0, np.sign(away) * np.inf)


class Threshold(Detector):
    """Values above or below a bound."""

    def scores(self, values, model):
        low, high = self.parameters.get("low", -np.inf), self.parameters.get("high", np.inf)
        return np.where((values < low) | (values > high), np.inf, 0.0)

    def scores_each(self, values, starts, ends, models):
        return self.scores(values, {}) if type(self) is Threshold else super().scores_each(values, starts, ends, models)


DETECTORS: dict[str, type[Detector]] = {"local_median": LocalMedian, "deviation": Deviation, "threshold": Threshold}


def register_detector(name: str, kind: type[Detector]) -> None:
    DETECTORS[name] = kind


def _series_starts(rows: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Where another series begins in rows that are sorted by series."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for b in by:
        column = rows.column(b).combine_chunks()
        if pa.types.is_nested(column.type):
            plain = column.to_pylist()
            new[1:] |= np.array([x != y for x, y in zip(plain[1:], plain)], bool)
            continue
        null = np.asarray(pc.is_null(column, nan_is_null=False))
        blank = np.asarray(pc.fill_null(pc.is_nan(column), False)) if pa.types.is_floating(column.type) else np.zeros(len(column), bool)
        same = np.asarray(pc.fill_null(pc.equal(column[1:], column[:-1]), False)) | (null[1:] & null[:-1]) | (blank[1:] & blank[:-1])
        new[1:] |= ~same
    return np.flatnonzero(new)


def _whole_series(batches, by: tuple[str, ...], at_least: int = 100_000):
    """Sorted batches as tables of whole series, many at a time."""
    held, size, wanted = [], 0, at_least
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < wanted:
            continue
        rows = pa.Table.from_batches(held)
        starts = _series_starts(rows, by)
        last = int(starts[-1])
        if last:
            yield rows.slice(0, last), starts[:-1]
        rest = rows.slice(last)
        # A series that goes on is looked at again when it has doubled.
        held, size, wanted = rest.to_batches(), len(rest), max(at_least, 2 * len(rest))
    if size:
        rows = pa.Table.from_batches(held)
        yield rows, _series_starts(rows, by)


def detected(points: DataFrame, by: tuple[str, ...], value: str, algorithm: str, *, task: str = "fit_detect", beyond: float = 3.0, model: dict | None = None, **parameters) -> DataFrame:
    """Scores of each series' points (detect, fit_detect: by, time, value, score,
    anomaly) or fitted models (fit: by, model as JSON text).

    Series are sorted side by side, and many go to the detector at a time.
    """
    import json

    if algorithm not in DETECTORS:
        raise ValueError(f"unknown detector {algorithm}")
    detector = DETECTORS[algorithm](**parameters)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    key = "".join(f"`{b}` {kinds[b]}, " for b in by)

    def run(batches):
        for rows, starts in _whole_series(batches, by):
            values, ends = np.array(rows.column("_value")), np.append(starts[1:], len(rows))
            models = [model] * len(starts) if task == "detect" and model is not None else detector.fit_each(values, starts, ends)
            if task == "fit":
                kept, more = rows.select(list(by)).take(pa.array(starts)), {"model": pa.array([json.dumps(m) for m in models], pa.string())}
            else:
                scores = np.asarray(detector.scores_each(values, starts, ends, models), float)
                kept, more = rows.select([*by, "_time"]), {"value": pa.array(values), "score": pa.array(scores), "anomaly": pa.array(np.abs(scores) > beyond)}
            for name, column in more.items():
                kept = kept.append_column(name, column)
            if task != "fit":
                kept = kept.rename_columns([*by, "time", *more])
            yield from kept.combine_chunks().to_batches()

    # A zero's sign makes no series of its own.
    tags = [(F.col(f"`{b}`") + F.lit(0).cast(kinds[b]) if kinds[b] in ("float", "double") else F.col(f"`{b}`")).alias(b) for b in by]
    number = F.col(f"`{value}`").cast("double")
    kept = points.select(*tags, F.col("time").cast("long").alias("_time"), number.alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    dealt = kept.repartition(*(F.col(f"`{b}`") for b in by)) if by else kept.repartition(1)
    return dealt.sortWithinPartitions(*(F.col(f"`{b}`") for b in by), "_time", "_value").mapInArrow(run, key + ("model string" if task == "fit" else "time long, value double, score double, anomaly boolean"))
