"""Service metrics over event tables: rates, latencies, alerts, caches, sessions.

Events are rows (ts, labels..., value). Windows are ``window`` groups, so partial aggregation comes before the shuffle
and a hot label is one row a task and window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alert rules as (severity, threshold, windows of five minutes that a breach must last).
ALERTS = {
    "HighErrorRate": ("critical", 0.05, 1),
    "HighResponseLatency": ("warning", 2.0, 1),
    "DatabasePoolSaturation": ("warning", 0.8, 1),
    "HighMemoryUsage": ("warning", 0.85, 1),
    "HighCpuUsage": ("warning", 0.8, 1),
    "LowDiskSpace": ("warning", 0.85, 1),
    "HighCacheMissRate": ("warning", 0.4, 1),
    "SlowVectorSearch": ("warning", 1.0, 1),
    "DocumentProcessingFailures": ("critical", 0.1, 1),
}
#: Histogram bounds of a latency in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def windowed(events: DataFrame, length: str = "5 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Adds ``window_start``; a row stands in each window that holds it."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withColumn("_w", w).withColumn("window_start", F.col("_w.start")).drop("_w")


def rates(events: DataFrame, by: Sequence[str], length: str = "5 minutes", slide: str | None = None, seconds: float = 300.0) -> DataFrame:
    """``count`` and events a second of each window and label set."""
    n = windowed(events, length, slide).groupBy("window_start", *by).agg(F.count("*").alias("count"))
    return n.withColumn("rate", F.col("count") / seconds)


def latency_percentiles(events: DataFrame, by: Sequence[str], value: str = "value", exact: bool = False) -> DataFrame:
    """p50 and p95; approximate by default, with bounded state, as exact ones hold all values of a group."""
    p = (lambda q: F.percentile(value, q)) if exact else (lambda q: F.percentile_approx(value, q, 10000))
    return events.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


def histogram(events: DataFrame, by: Sequence[str], value: str = "value", bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative counts below each bound, with count and sum, as a labelled histogram."""
    cells = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return events.groupBy(*by).agg(*cells, F.count("*").alias("count"), F.sum(value).alias("sum"))


def bucket_quantile(h: DataFrame, q: float, bounds: Sequence[float] = BUCKETS) -> Column:
    """The quantile interpolated inside its bucket; the largest bound if it lies above all."""
    rank, out = F.col("count") * q, F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, under = (bounds[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        inside = low + (bounds[i] - low) * F.coalesce(F.try_divide(rank - under, (F.col(f"le_{i}") - under).cast("double")), F.lit(0.0))
        out = F.when(F.col(f"le_{i}") >= rank, inside).otherwise(out)
    return out


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def hit_rate(hits: Column, misses: Column) -> Column:
    return ratio(hits, hits + misses)


def breaches(windows: DataFrame, value: str, name: str, by: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """Windows (window_start, value) above the rule's threshold."""
    severity, limit, _ = ALERTS[name]
    hit = windows.filter(F.col(value) > (limit if threshold is None else threshold))
    return hit.select("window_start", *by, F.lit(name).alias("alertname"), F.lit(severity).alias("severity"), value)


def firing(windows: DataFrame, measures: dict[str, Column], length_s: int = 300) -> DataFrame:
    """``alertname, severity, start, end, windows``: for every rule of ``measures`` (its value in a window) the stretches of
    consecutive windows above its threshold that last as long as the rule wants."""
    rules = F.array(*(F.struct(F.lit(n).alias("alertname"), F.lit(ALERTS[n][0]).alias("severity"), F.lit(ALERTS[n][1]).alias("limit"), F.lit(ALERTS[n][2]).alias("lasts"), v.cast("double").alias("v")) for n, v in measures.items()))
    hit = windows.select("window_start", F.inline(rules)).filter(F.col("v") > F.col("limit"))
    return lasting(hit, ["alertname", "severity", "lasts"], length_s, 1).filter(F.col("windows") >= F.col("lasts")).drop("lasts")


def durations(records: DataFrame) -> DataFrame:
    """``trace_id, started, seconds`` from start and end records (trace_id, phase, ts): a trace is one group, combined
    before the shuffle; seconds are null while there is no end."""
    at = lambda phase, f: f(F.when(F.col("phase") == phase, F.col("ts")))
    g = records.groupBy("trace_id").agg(at("start", F.min).alias("started"), at("end", F.max).alias("ended"))
    return g.select("trace_id", "started", ((F.unix_micros("ended") - F.unix_micros("started")) / 1e6).alias("seconds"))


def lasting(found: DataFrame, by: Sequence[str], length_s: int = 300, least: int = 2) -> DataFrame:
    """Islands of at least ``least`` consecutive breaching windows: start, end, number."""
    t = F.unix_timestamp("window_start")
    n = F.row_number().over(Window.partitionBy(*by).orderBy("window_start"))
    marked = found.withColumn("_g", t - n * length_s)
    out = marked.groupBy(*by, "_g").agg(F.min("window_start").alias("start"), F.max("window_start").alias("end"), F.count("*").alias("windows"))
    return out.filter(F.col("windows") >= least).drop("_g")


def inhibited(alerts: DataFrame, equal: Sequence[str] = ("alertname", "cluster", "service")) -> DataFrame:
    """Without the warnings for which a critical alert has the same labels."""
    critical = alerts.filter(F.col("severity") == "critical").select(*equal).distinct()
    warnings = alerts.filter(F.col("severity") == "warning").join(critical, list(equal), "left_anti")
    return alerts.filter(F.col("severity") != "warning").unionByName(warnings.select(alerts.columns))


def over_limit(requests: DataFrame, by: str, most: int = 100, seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Requests beyond ``most`` of one key in the last ``seconds``, themselves counted.

    Time is cut into buckets of ``seconds`` and each row is also sent to the next bucket, so a task holds two buckets of a
    key and not all of its history."""
    at = F.unix_timestamp(ts)
    bucket = F.floor(at / seconds)
    rows = requests.withColumn("_at", at).withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    w = Window.partitionBy(by, "_b").orderBy("_at").rangeBetween(-seconds + 1, 0)
    counted = rows.withColumn("in_window", F.count("*").over(w)).filter(F.col("_b") == F.floor(F.col("_at") / seconds))
    return counted.filter(F.col("in_window") > most).drop("_at", "_b")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    s = events.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def summary(events: DataFrame, value: str = "value") -> DataFrame:
    """One row of totals: requests, errors, mean latency, cache hits and misses with their rate."""
    kind = F.col("event_type")
    n = lambda k: F.count_if(kind == k)
    out = events.agg(F.count("*").alias("total"), n("error").alias("errors"), F.avg(value).alias("mean_latency"), n("view").alias("hits"), n("click").alias("misses"))
    return out.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses")))


def exposition(h: DataFrame, name: str, labels: Sequence[str], bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """Prometheus text lines of a histogram."""
    tag = F.concat_ws(",", *[F.format_string(f'{c}="%s"', F.col(c).cast("string")) for c in labels])
    rows = [F.concat(F.lit(f"{name}_bucket{{"), tag, F.lit(f',le="{b}"}} '), F.col(f"le_{i}")) for i, b in enumerate(bounds)]
    rows += [F.concat(F.lit(f"{name}_{k}{{"), tag, F.lit("} "), F.col(k)) for k in ("count", "sum")]
    return h.select(F.explode(F.array(*rows)).alias("line"))


def plan_advice(df: DataFrame) -> list[str]:
    """Advice read off a physical plan: nested-loop joins, scans without pushed filters, single-task windows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    said = []
    if "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan:
        said.append("a join has no equality condition; add one, or score against a literal")
    if "FileScan" in plan and "Filter" in plan and "PushedFilters: []" in plan:
        said.append("no filter reaches the file scan; compare plain columns with literals")
    if "SinglePartition" in plan:
        said.append("an exchange brings all rows to one task; partition the window or aggregate first")
    return said


def timed(rows: DataFrame, category: str, seconds: str) -> DataFrame:
    """Mean, largest and smallest of measured times a category."""
    return rows.groupBy(category).agg(F.avg(seconds).alias("mean"), F.max(seconds).alias("max"), F.min(seconds).alias("min"))
