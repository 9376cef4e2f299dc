"""Event history, metrics, progress and session state.

Events: (event_id, ts, user_id, event_type, value, props).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the default histogram.
BUCKETS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
HISTORY, SAMPLES, WORKING_SET = 1000, 10_000, 7


def filtered(events: DataFrame, types: list[str] | None = None, source=None, after=None, before=None, source_column: str = "user_id") -> DataFrame:
    """A conjunction of the given predicates; time bounds are included."""
    tests = [F.col("event_type").isin(types) if types else None, F.col(source_column) == source if source is not None else None, F.col("ts") >= after if after is not None else None, F.col("ts") <= before if before is not None else None]
    for t in tests:
        if t is not None:
            events = events.where(t)
    return events


def event_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def history(events: DataFrame, n: int = HISTORY, per: str | None = None) -> DataFrame:
    """The last ``n`` events, or of each ``per``, newest first; ties by id."""
    order = [F.desc("ts"), F.desc("event_id")]
    if per is None:
        return events.orderBy(*order).limit(n)
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def histogram(events: DataFrame, by: str, value: str = "value", bounds: tuple = BUCKETS) -> DataFrame:
    """(by, le, n): cumulative counts up to each bound and +Inf, all in one aggregate."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(by).agg(*aggs, F.count(value).alias("inf"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return wide.select(by, F.explode(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))).alias("x")).select(by, "x.le", "x.n")


def value_summary(events: DataFrame, by: str, value: str = "value") -> DataFrame:
    return events.groupBy(by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("smallest"), F.max(value).alias("largest"))


def counters(events: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    return events.groupBy(*labels).agg(F.sum(value if value is not None else F.lit(1)).alias("total"))


def gauges(events: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    """The last value per label set."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("at"))


def health(events: DataFrame, by: str, slow: float = 1000.0, value: str = "value") -> DataFrame:
    """(by, status): healthy, degraded (slowest above ``slow``) or unhealthy (no value at all)."""
    a = events.groupBy(by).agg(F.max(value).alias("_m"))
    return a.select(by, F.when(F.col("_m").isNull(), "unhealthy").when(F.col("_m") > slow, "degraded").otherwise("healthy").alias("status"))


def exposition(metrics: DataFrame, name: str, labels: list[str], value: str, kind: str = "counter") -> DataFrame:
    """(line): the text exposition of a metric, a TYPE line and a line per label set."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')) for c in labels])
    body = metrics.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
    return metrics.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], "line string").unionByName(body)


def progress(ticks: DataFrame, session: str = "session", at: str = "ts", current: str = "current", total: str = "total") -> DataFrame:
    """Ticks with ``percent``, ``throughput`` (per second since the session's first tick) and ``eta_seconds``:
    the rest over the last five tick rates, the newer ones weighing 16, 8, 4, 2, 1."""
    w = Window.partitionBy(session).orderBy(at, current)
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    rate = (F.col(current) - F.lag(current).over(w)) / F.greatest(F.lit(1e-3), sec(at) - F.lag(sec(at)).over(w))
    t = ticks.withColumn("_rate", rate).withColumn("_last", F.collect_list("_rate").over(w.rowsBetween(-4, 0)))
    weights = F.transform("_last", lambda x, i: F.pow(F.lit(2.0), i))
    mean = F.try_divide(F.aggregate(F.zip_with("_last", weights, lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x), F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))
    elapsed = sec(at) - F.first(sec(at)).over(w)
    t = t.withColumn("percent", F.when(F.col(total) > 0, F.least(F.lit(100.0), F.col(current) / F.col(total) * 100)).otherwise(0.0))
    t = t.withColumn("throughput", F.coalesce(F.try_divide(F.col(current), F.nullif(elapsed, F.lit(0.0))), F.lit(0.0)))
    t = t.withColumn("_mean", F.when(F.size("_last") > 0, mean))
    return t.withColumn("eta_seconds", F.try_divide(F.greatest(F.lit(0.0), F.col(total) - F.col(current)), F.when(F.col("_mean") > 0, F.col("_mean")))).drop("_mean").drop("_rate", "_last")


def working_set(events: DataFrame, session: str = "user_id", item: str = "event_type", n: int = WORKING_SET) -> DataFrame:
    """(session, item, last, place): the ``n`` items a session used last, newest first."""
    last = events.groupBy(session, item).agg(F.max("ts").alias("last"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("last"), item))).where(F.col("place") <= n)


def dopamine(signals: DataFrame, session: str, at: str, kind: str) -> DataFrame:
    """(session, level, n): the fold of a session's signals in order: ``search`` times 0.9 (at least 0.1),
    ``good`` plus 0.3, ``bad`` minus 0.15, between 0.1 and 1; starting from 0.5.

    Every step is a clamped linear map x -> min(hi, max(lo, a x + b)); such maps compose,
    so blocks of a session's signals are folded to one map each and the maps in order.
    """
    import pandas as pd

    block = 4096
    w = Window.partitionBy(session).orderBy(at, kind)
    s = signals.withColumn("_b", F.floor((F.row_number().over(w) - 1) / block))
    kinds = dict(signals.dtypes)

    def step(m, a, b, lo, hi):
        # m = (a, b, lo, hi): x -> clip(a x + b, lo, hi); then the next map after it
        a0, b0, l0, h0 = m
        f = lambda x: min(hi, max(lo, a * x + b))
        return a * a0, a * b0 + b, f(l0), f(h0)

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = (1.0, 0.0, 0.1, 1.0)
        for k in pdf.sort_values([at, kind])[kind]:
            m = step(m, *((0.9, 0.0) if k == "search" else (1.0, 0.3) if k == "good" else (1.0, -0.15)), 0.1, 1.0)
        return pd.DataFrame([(*key, len(pdf), *m)], columns=[session, "_b", "n", "a", "b", "lo", "hi"])

    maps = s.groupBy(session, "_b").applyInPandas(fold, f"`{session}` {kinds[session]}, _b long, n long, a double, b double, lo double, hi double")
    ordered = maps.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("_b", "a", "b", "lo", "hi"))).alias("_m"), F.sum("n").alias("n"))
    level = F.aggregate("_m", F.lit(0.5), lambda x, m: F.least(m["hi"], F.greatest(m["lo"], m["a"] * x + m["b"])))
    return ordered.select(session, level.alias("level"), "n")


def deliveries(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, event_id, ts, event_type): what each subscription (subscriber, event_type, since, once) receives.

    ``event_type`` null or ``*`` takes every event; earlier events than ``since`` aren't
    delivered; ``once`` ends a subscription with its first event (by ts, then id). An
    event that several subscriptions of a subscriber take is delivered once.
    """
    s = subscriptions.select("subscriber", F.nullif(F.trim("event_type"), F.lit("*")).alias("_type"), "since", F.coalesce("once", F.lit(False)).alias("once"), F.monotonically_increasing_id().alias("_s"))
    s = F.broadcast(s)  # subscriptions are configuration, a row each
    e = events.select("event_id", "ts", "event_type")
    typed = e.join(s.where("_type IS NOT NULL"), F.col("event_type") == F.col("_type"))
    every = e.join(s.where("_type IS NULL"))
    got = typed.unionByName(every).where("since IS NULL OR ts >= since")
    first = F.row_number().over(Window.partitionBy("_s").orderBy("ts", "event_id"))
    one = got.where("once").withColumn("_r", first).where("_r = 1").drop("_r")
    return got.where("NOT once").unionByName(one).select("subscriber", "event_id", "ts", "event_type").distinct()
