"""Watching operations: retention, request counters, latency histograms, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores, text

#: Upper bounds of latency buckets in seconds. Fixed values.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def expired(ts: Column, now: Column, keep_days: int) -> Column:
    return scores.seconds_between(now, ts) > keep_days * 86400


def purge(log: DataFrame, now: Column, keep_days: int, ts: str = "ts") -> DataFrame:
    return log.where(~F.coalesce(expired(F.col(ts), now, keep_days), F.lit(False)))


def purge_counts(log: DataFrame, now: Column, keep_days: int, by: str, ts: str = "ts") -> DataFrame:
    """For each kind of log rows: how many would go and stay."""
    old = F.coalesce(expired(F.col(ts), now, keep_days), F.lit(False))
    return log.groupBy(by).agg(F.count_if(old).alias("gone"), F.count_if(~old).alias("kept"))


def latency_histogram(requests: DataFrame, by: list[str], seconds: Column, bounds: tuple[float, ...] = BUCKETS, last: int = 1000) -> DataFrame:
    """Cumulative bucket counts over the last samples of each endpoint: (by…, le, n, total, samples)."""
    order = Window.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    recent = requests.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= last).withColumn("__s", seconds)
    wide = recent.groupBy(*by).agg(F.count("*").alias("samples"), F.sum("__s").alias("total"), *[F.count_if(F.col("__s") <= b).alias(f"le{k}") for k, b in enumerate(bounds)])
    steps = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"le{k}").alias("n")) for k, b in enumerate(bounds)])
    return wide.select(*by, "samples", "total", F.explode(steps).alias("b")).select(*by, "b.le", "b.n", "total", "samples")


def request_counts(requests: DataFrame, path: Column, *more: Column) -> DataFrame:
    return requests.select(text.endpoint(path).alias("endpoint"), *more).groupBy("endpoint", *[m for m in requests.select(*more).columns]).agg(F.count("*").alias("n"))


def rate_limits(requests: DataFrame, subject: str, width_s: int, limit: int) -> DataFrame:
    """Fixed windows in which a subject made requests: (subject, window_start, n, over)."""
    start = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / width_s) * width_s
    return requests.groupBy(subject, start.alias("window_start")).agg(F.count("*").alias("n")).withColumn("over", F.col("n") > limit)


def metric_lines(counts: DataFrame, histogram: DataFrame, prefix: str) -> DataFrame:
    """(metric, line): lines of a monitoring service's text format. counts: method, endpoint, status, n; histogram: of latency_histogram by method and endpoint."""
    labels = lambda *names: F.array_join(F.array(*[F.concat(F.lit(f'{n}="'), F.col(n).cast("string"), F.lit('"')) for n in names]), ",")
    line = lambda name, inside, value: F.concat(F.lit(f"{prefix}_{name}{{"), inside, F.lit("} "), value.cast("string"))
    total, seconds = "http_requests_total", "http_request_duration_seconds"
    own = labels("method", "endpoint")
    rows = [counts.select(F.lit(total).alias("metric"), line(total, labels("method", "endpoint", "status"), F.col("n")).alias("line"))]
    rows.append(histogram.select(F.lit(seconds).alias("metric"), line(f"{seconds}_bucket", F.concat(own, F.lit(',le="'), F.col("le").cast("string"), F.lit('"')), F.col("n")).alias("line")))
    once = histogram.dropDuplicates(["method", "endpoint"])
    rows.append(once.select(F.lit(seconds), line(f"{seconds}_bucket", F.concat(own, F.lit(',le="+Inf"')), F.col("samples"))))
    rows.append(once.select(F.lit(seconds), line(f"{seconds}_sum", own, F.format_string("%.4f", F.col("total")))))
    rows.append(once.select(F.lit(seconds), line(f"{seconds}_count", own, F.col("samples"))))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    heads = counts.sparkSession.createDataFrame([(m, f"# TYPE {prefix}_{m} {kind}") for m, kind in ((total, "counter"), (seconds, "histogram"))], "metric string, line string")
    return out.union(heads)
