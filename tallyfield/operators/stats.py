"""Statistics over many series at once: lead/lag tests, permutation nulls, forecasts, outliers and result tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import calendar_lag

# closed forms


def lag1_rows(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, month, y, y1, x1): y with its own and x's value of exactly one month before. x, y: (keys, month, v)."""
    own = calendar_lag(y, keys, "v", 1).select(*keys, "month", F.col("v").alias("y"), F.col("before").alias("y1"))
    return own.join(x.select(*keys, F.add_months("month", 1).alias("month"), F.col("v").alias("x1")), [*keys, "month"])


def f_statistic(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """The F of adding x1 to y on a constant and y1, from moments alone; null under `least` rows or on a flat series."""
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("syy"), F.var_pop("y1").alias("saa"), F.var_pop("x1").alias("sxx"),
        F.covar_pop("y", "y1").alias("sya"), F.covar_pop("y", "x1").alias("syx"), F.covar_pop("y1", "x1").alias("sax"),
    )
    short = F.col("syy") - F.col("sya") * F.col("sya") / F.col("saa")
    det = F.col("saa") * F.col("sxx") - F.col("sax") * F.col("sax")
    long = F.col("syy") - (F.col("sya") * F.col("sya") * F.col("sxx") - 2 * F.col("sya") * F.col("syx") * F.col("sax") + F.col("syx") * F.col("syx") * F.col("saa")) / det
    f = F.when((F.col("n") >= least) & (F.col("saa") > 1e-12) & (det > 1e-12) & (long > 1e-12), (short - long) / (long / (F.col("n") - 3)))
    return m.select(*keys, "n", f.alias("f"))


def granger_lag1(x: DataFrame, y: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """f_statistic of x leading y by one calendar month; strict: only months in which x is observed too."""
    rows = lag1_rows(x, y, keys)
    return f_statistic(rows.join(x.select(*keys, "month"), [*keys, "month"], "left_semi") if strict else rows, keys)


def _series(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: its rows in order of months as an array `s`, and how many there are."""
    own = F.array_sort(F.collect_list(F.struct("month", "y", "y1", "x1")))
    return rows.groupBy(*keys).agg(own.alias("s")).withColumn("size", F.size("s").cast("long"))


def _redrawn(series: DataFrame, keys: list[str], draws: Column, place: Callable[[Column], Column]) -> DataFrame:
    """(keys..., draw, month, pos, y, y1, x1): every series once per draw, x1 taken from the place that place(pos) says.

    A series and its draws stay in one row until its months are laid out, so that what is summed up
    by (draw, key) then moves as one row each.
    """
    drawn = series.withColumn("draw", F.explode(draws))
    row = lambda r, i: F.struct(r["month"].alias("month"), i.cast("long").alias("pos"), r["y"].alias("y"), r["y1"].alias("y1"), F.get("s", place(i).cast("int"))["x1"].alias("x1"))
    return drawn.select(*keys, "draw", F.inline(F.transform("s", row)))


def shuffled(rows: DataFrame, keys: list[str], draws: int, seed: str = "42") -> DataFrame:
    """rows once per draw with x1 dealt anew within the key, in the order of md5(draw, key, place, seed)."""
    series = _series(rows, keys).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    mark = lambda i: F.md5(F.concat_ws("|", F.col("draw").cast("string"), *keys, i.cast("string"), F.lit(seed)))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(mark(i).alias("mark"), i.alias("at"))))
    series = series.withColumn("order", order)
    row = lambda r, i: F.struct(r["month"].alias("month"), i.cast("long").alias("pos"), r["y"].alias("y"), r["y1"].alias("y1"), F.get("s", F.get("order", i)["at"].cast("int"))["x1"].alias("x1"))
    return series.select(*keys, "draw", F.inline(F.transform("s", row)))


def rotated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows once for every circular shift of x1 within the key."""
    series = _series(rows, keys).where("size > 1")
    return _redrawn(series, keys, F.sequence(F.lit(1), (F.col("size") - 1).cast("int")), lambda i: (i + F.col("draw")) % F.col("size"))


def blocks(rows: DataFrame, keys: list[str], draws: int, length: int = 5, seed: str = "42") -> DataFrame:
    """rows once per draw with x1 put together from circular blocks whose starts are drawn by md5."""

    def place(i: Column) -> Column:
        mark = F.md5(F.concat_ws("|", F.col("draw").cast("string"), *keys, F.floor(i / length).cast("string"), F.lit(seed)))
        return (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") + i % length) % F.col("size")

    return _redrawn(_series(rows, keys), keys, F.sequence(F.lit(1), F.lit(draws)), place)


def null_summary(null: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Draws, median, 95th percentile and maximum of the null's F, and (1 + draws at or above) / (1 + draws).

    A draw that gives the observed order again differs from it by floating noise, so draws within a billionth count as ties.
    """
    both = null.where("f is not null").join(observed.select(*keys, F.col("f").alias("seen")), keys)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"), F.median("f").alias("median_f"), F.percentile("f", 0.95).alias("q95_f"), F.max("f").alias("max_f"), ((1 + F.count_if(F.col("f") >= F.col("seen") * (1 - 1e-9))) / (1 + F.count(F.lit(1)))).alias("p_value")
    )


def pass_through(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and R2 of y on x."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_r2("y", "x").alias("r2"))


# models that need matrices: one series a call


def t_quantile(p: float, d: int) -> float:
    """The t with P(|T| > t) = p at d degrees of freedom, by bisection of the tail."""
    low, high = 0.0, 1.0
    while f_tail(high * high, 1, d) > p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f_tail(mid * mid, 1, d) > p else (low, mid)
    return (low + high) / 2


def pass_through_models(pairs: DataFrame, keys: list[str], aic_lag: int = 2, least: int = 5, floor: float = 0.001) -> DataFrame:
    """Per key of pairs(keys, month, x, y): the regression of y's log change on x's, with standard error, p, 95 % interval and R2.

    Under 20 changes without lags; else with up to two lags of both (aic_lag at most) and month
    dummies. Three degrees of freedom must be left; what can't be fitted gives a reason.
    """

    def work(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("month")
        head = [d[k].iloc[0] for k in keys]
        dy, dx = (np.diff(np.log(np.maximum(d[c].to_numpy(float), floor))) for c in ("y", "x"))
        months = pd.to_datetime(d["month"]).dt.month.to_numpy()[1:]
        n = len(dy)
        none = lambda why: pd.DataFrame([[*head, n, None, None, None, None, None, None, None, False, why]])
        if n < least:
            return none(f"only {n} changes")
        lags = 0 if n < 20 else min(aic_lag, 2)
        columns, y = [np.ones(n - lags), dx[lags:]], dy[lags:]
        for k in range(1, lags + 1):
            columns += [dy[lags - k : n - k], dx[lags - k : n - k]]
        if lags:
            columns += [(months[lags:] == m).astype(float) for m in sorted(set(months.tolist()))[1:]]
        x = np.column_stack(columns)
        rest = len(y) - x.shape[1]
        if len(y) < least or rest < 3:
            return none(f"no degrees of freedom: {len(y)} rows, {x.shape[1]} terms")
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss, tss = float(((y - x @ beta) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
        se = math.sqrt(rss / rest * np.linalg.pinv(x.T @ x)[1, 1])
        if se <= 0 or tss <= 0:
            return none("no variance")
        p, t = f_tail((beta[1] / se) ** 2, 1, rest), t_quantile(0.05, rest)
        return pd.DataFrame([[*head, n, lags, float(beta[1]), se, p, float(beta[1] - t * se), float(beta[1] + t * se), 1 - rss / tss, p < 0.05, None]])

    schema = f"{', '.join(f'{k} string' for k in keys)}, n long, lags int, beta double, se double, p double, ci_low double, ci_high double, r2 double, significant boolean, reason string"
    return pairs.where("x is not null and y is not null").select(*keys, "month", "x", "y").groupBy(*keys).applyInPandas(work, schema)


def granger_robust(pairs: DataFrame, keys: list[str], most_lags: int = 3, level: float = 0.10, least: int = 8) -> DataFrame:
    """The robustness profile: x leading y in first differences, whatever the unit roots, with every lag up to min(most_lags, n // 3)."""

    def work(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("month")
        head, n = [d[k].iloc[0] for k in keys], len(d)
        x, y = (np.diff(d[c].to_numpy(float)) for c in ("x", "y"))
        none = lambda why: pd.DataFrame([[*head, n, None, None, False, why]])
        if n < least:
            return none(f"only {n} observations")
        if len(x) < least:
            return none(f"only {len(x)} differences")
        best = None
        for k in range(1, min(most_lags, len(x) // 3) + 1):
            m = len(x) - k
            own = np.column_stack([np.ones(m), _lags(y, k, m)])
            full = np.column_stack([own, _lags(x, k, m)])
            rest = m - full.shape[1]
            if rest <= 0:
                break
            a, b = _rss(y[k:], own), _rss(y[k:], full)
            p = f_tail((a - b) / k / (b / rest), k, rest) if b > 0 else 1.0
            if best is None or p < best[1]:
                best = (k, p)
        return none("no degrees of freedom") if best is None else pd.DataFrame([[*head, n, best[0], best[1], best[1] < level, None]])

    schema = f"{', '.join(f'{k} string' for k in keys)}, n long, lead_months int, p double, significant boolean, reason string"
    return pairs.where("x is not null and y is not null").select(*keys, "month", "x", "y").groupBy(*keys).applyInPandas(work, schema)


def sector_split(results: DataFrame, sector: str = "sector", p: str = "p") -> DataFrame:
    """Mean p of the formal and of the informal results (1.0 without any), how many are significant, and which sector is the stronger (ties: formal)."""
    mean = lambda s: F.coalesce(F.avg(F.when(F.col(sector) == s, F.col(p))), F.lit(1.0)).alias(f"{s}_mean_p")
    count = lambda s: F.count_if((F.col(sector) == s) & (F.col(p) < 0.10)).alias(f"{s}_significant")
    out = results.agg(mean("formal"), mean("informal"), count("formal"), count("informal"))
    return out.withColumn("stronger", F.when(F.col("informal_mean_p") < F.col("formal_mean_p"), "informal").otherwise("formal"))


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f) with (d1, d2) degrees of freedom, by the incomplete beta's continued fraction."""
    if not (f > 0) or d2 <= 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)

    def fraction(a, b, x):
        c, d, out = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
        out = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or 1e-300)
                c = 1 + k / c or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def _rss(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum())


def _lags(v, k, n):
    return np.column_stack([v[k - j : k - j + n] for j in range(1, k + 1)])


# MacKinnon's 5 % critical surface of the Dickey-Fuller t with a constant.
_MACKINNON_5 = (-2.86154, -2.8903, -4.234, -40.04)


def unit_root_t(v: np.ndarray) -> tuple[float, float]:
    """(t, 5 % critical value) of the Dickey-Fuller regression with a constant and the lag count of the least AIC."""
    d, most = np.diff(v), int(min(12 * (len(v) / 100) ** 0.25, len(v) // 2 - 2))
    best = None
    for k in range(max(most, 0) + 1):
        n = len(d) - most
        x = np.column_stack([np.ones(n), v[most:-1], *(d[most - j : most - j + n] for j in range(1, k + 1))])
        if n <= x.shape[1]:
            break
        y = d[most:]
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = float(((y - x @ beta) ** 2).sum())
        if rss <= 0:
            continue
        aic = n * math.log(rss / n) + 2 * x.shape[1]
        t = beta[1] / math.sqrt(rss / (n - x.shape[1]) * np.linalg.pinv(x.T @ x)[1, 1])
        if best is None or aic < best[0]:
            best = (aic, t, n)
    if best is None:
        return 0.0, -3.0
    n = best[2]
    return best[1], sum(c / n**i for i, c in enumerate(_MACKINNON_5))


def stationarise(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, month, v, differenced): levels where a unit root is rejected at 5 %, else first differences; under 5 rows always those."""

    def work(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("month", ignore_index=True)
        v = d["v"].to_numpy(float)
        t, bound = unit_root_t(v) if len(v) >= 5 else (0.0, -3.0)
        if t <= bound:
            return d.assign(differenced=False)
        return d.iloc[1:].assign(v=np.diff(v), differenced=True)

    schema = f"{', '.join(f'{k} string' for k in keys)}, month date, v double, differenced boolean"
    return series.select(*keys, "month", "v").groupBy(*keys).applyInPandas(work, schema)


def granger(pairs: DataFrame, keys: list[str], most_lags: int = 4, level: float = 0.05, least: int = 8) -> DataFrame:
    """Per key of pairs(keys, month, x, y): F tests of x leading y for lags 1 to the AIC's order, with the best; short series get a reason."""

    def work(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("month")
        x, y, n = d["x"].to_numpy(float), d["y"].to_numpy(float), len(d)
        head = [d[k].iloc[0] for k in keys]
        none = [*head, n, None, None, None, None, None, False, f"only {n} observations, need {least}"]
        if n < least:
            return pd.DataFrame([none])
        most = max(1, min(most_lags, n // 5))
        aic = []
        for k in range(1, most + 1):
            m = n - k
            full = np.column_stack([np.ones(m), _lags(y, k, m), _lags(x, k, m)])
            aic.append(m * math.log(max(_rss(y[k:], full), 1e-300) / m) + 2 * full.shape[1])
        order = int(np.argmin(aic)) + 1
        tests = []
        for k in range(1, order + 1):
            m = n - k
            own = np.column_stack([np.ones(m), _lags(y, k, m)])
            full = np.column_stack([own, _lags(x, k, m)])
            rest = m - full.shape[1]
            if rest <= 0:
                break
            a, b = _rss(y[k:], own), _rss(y[k:], full)
            f = (a - b) / k / (b / rest) if b > 0 else 0.0
            tests.append((k, f, f_tail(f, k, rest), rest))
        if not tests:
            return pd.DataFrame([[*none[:-1], "no degrees of freedom"]])
        best = min(tests, key=lambda t: t[2])
        return pd.DataFrame([[*head, n, order, best[0], best[1], best[2], [t[2] for t in tests], best[2] < level, None]])

    schema = f"{', '.join(f'{k} string' for k in keys)}, n long, aic_lag int, best_lag int, f double, p double, p_by_lag array<double>, significant boolean, reason string"
    return pairs.select(*keys, "month", "x", "y").groupBy(*keys).applyInPandas(work, schema)


# forecasts


def _split(df: DataFrame, keys: list[str], test: int = 2, least: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys)
    out = df.withColumn("back", F.row_number().over(w.orderBy(F.desc("month")))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least)
    return out.withColumn("step", test + 1 - F.col("back")).withColumn("test", F.col("step") > 0)


def forecasts(df: DataFrame, keys: list[str], test: int = 2) -> DataFrame:
    """Drift, regression and mean forecasts of the last `test` values of y; the regression is of y's changes on x's, cumulated."""
    w = Window.partitionBy(*keys).orderBy("month")
    d = _split(df, keys, test).withColumn("dy", F.col("y") - F.lag("y").over(w)).withColumn("dx", F.col("x") - F.lag("x").over(w))
    past = d.where("not test").groupBy(*keys).agg(F.avg("dy").alias("drift"), F.max_by("y", "month").alias("last"), F.regr_slope("dy", "dx").alias("b"), F.regr_intercept("dy", "dx").alias("a"))
    out = d.where("test").join(past, keys)
    out = out.withColumn("drift_forecast", F.col("last") + F.coalesce("drift", F.lit(0.0)) * F.col("step"))
    out = out.withColumn("ols_forecast", F.col("last") + F.sum(F.col("a") + F.col("b") * F.col("dx")).over(w))
    return out.withColumn("mean_forecast", F.coalesce((F.col("drift_forecast") + F.col("ols_forecast")) / 2, F.col("drift_forecast"))).select(*keys, "month", "y", "last", "drift_forecast", "ols_forecast", "mean_forecast")


def directional_accuracy(predicted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Share of steps whose change has the sign of the actual change, for each forecast, and whether the last beats the first."""
    w = Window.partitionBy(*keys).orderBy("month")
    sign = lambda c: F.signum(F.col(c) - F.coalesce(F.lag(c).over(w), F.col("last")))
    out = predicted.select(*keys, sign("y").alias("s"), *(sign(n).alias(n) for n in names))
    out = out.groupBy(*keys).agg(*(F.avg((F.col(n) == F.col("s")).cast("double")).alias(n.replace("forecast", "accuracy")) for n in names))
    a, b = names[0].replace("forecast", "accuracy"), names[-1].replace("forecast", "accuracy")
    return out.withColumn("adds_value", F.col(b) > F.col(a))


# tables


def zscores(df: DataFrame, keys: list[str], value: str, bound: float = 3.0, least: int = 3) -> DataFrame:
    """value's z within its group by the sample deviation, where the group has enough rows and varies; outlier beyond the bound."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(value).over(w)
    z = F.when((F.count(value).over(w) >= least) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd)
    return df.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > bound, F.lit(False)))


def sector_ratio(df: DataFrame, key: str, high: float = 4.0, low: float = 0.05) -> DataFrame:
    """Median informal against median formal price, flagged where out of bounds."""
    part = lambda s: df.where(F.col("sector") == s).groupBy(key).agg(F.median("price_usd").alias(s))
    out = part("informal").join(part("formal"), key, "full_outer").withColumn("ratio", F.col("informal") / F.col("formal"))
    return out.withColumn("flag", F.coalesce((F.col("ratio") > high) | (F.col("ratio") < low), F.lit(False)))


def jackknife(results: DataFrame, key: str, p: str, level: float = 0.10, share: float = 0.6) -> DataFrame:
    """For each key left out: how many of the others are under the level, and whether that is a stable share (none of none is)."""
    out = results.groupBy().agg(F.count(F.lit(1)).alias("all_n"), F.count_if(F.col(p) < level).alias("hits"))
    out = results.join(F.broadcast(out)).select(F.col(key).alias("dropped"), (F.col("all_n") - 1).alias("rest"), (F.col("hits") - F.coalesce((F.col(p) < level).cast("long"), F.lit(0))).alias("significant"))
    return out.withColumn("stable", (F.col("rest") == 0) | (F.col("significant") / F.col("rest") >= share))


def jackknife_verdict(left_out: DataFrame) -> DataFrame:
    """One row over jackknife()'s: how many countries were left out, after how many of them the finding was stable, and whether it survives them all; null without two countries."""
    out = left_out.agg(F.count(F.lit(1)).alias("dropped"), F.count_if("stable").alias("stable"))
    return out.withColumn("finding_survives", F.when(F.col("dropped") > 1, F.col("dropped") == F.col("stable")))


def weight_sensitivity(index: DataFrame, weights: list[float], missing: float = 100.0) -> DataFrame:
    """The combined index under several informal weights, a missing sector as 100."""
    f, i = F.coalesce("formal_index", F.lit(missing)), F.coalesce("informal_index", F.lit(missing))
    out = index.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    return out.select("country", "month", "weight", (F.col("weight") * i + (1 - F.col("weight")) * f).alias("combined_index"))


def descriptive(df: DataFrame, key: str) -> DataFrame:
    """Mean, sample deviation, sector means, items, restaurants, months and first month of prices."""
    mean = lambda s: F.avg(F.when(F.col("sector") == s, F.col("price_usd")))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sector") == "formal").alias("formal_n"), F.count_if(F.col("sector") == "informal").alias("informal_n"), F.avg("price_usd").alias("mean"), F.stddev_samp("price_usd").alias("sd"),
        mean("formal").alias("formal_mean"), mean("informal").alias("informal_mean"), F.count_distinct("item_name").alias("items"), F.count_distinct("restaurant_name").alias("restaurants"), F.count_distinct("month").alias("months"), F.min("month").alias("first_month"),
    )


def respecified(results: DataFrame, respec: DataFrame, key: str, columns: list[str], places: int = 4) -> DataFrame:
    """results with the columns of a respecified row in place of the published ones, rounded."""
    other = respec.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    return results.join(other, key, "left").select(*[c for c in results.columns if c not in columns], *(F.round(F.coalesce(f"new_{c}", c), places).alias(c) for c in columns))


def crossovers(before: DataFrame, after: DataFrame, key: str, level: float = 0.05) -> DataFrame:
    """Keys whose p crossed the level between two result sets."""
    both = before.select(key, F.col("p").alias("was")).join(after.select(key, F.col("p").alias("now")), key)
    return both.where((F.col("was") < level) != (F.col("now") < level)).withColumn("change", F.when(F.col("now") < level, "gained").otherwise("lost"))
