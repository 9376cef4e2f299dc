"""Journal, clock, event and metric queries over ``journal`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions import clocks as C
from memlattice.operators import events as E
from memlattice.operators import journal as J
from memlattice.plans.data_problems import key
from memlattice.sources.tables import read


def _j(spark, d):
    return J.tidied(read(spark, d, "journal"))


def _sides(spark, d):
    """Two journals: what nodes of an even and of an odd name hash wrote."""
    j = _j(spark, d)
    even = F.length("node_id") % 2 == 0
    return j.where(even), j.where(~even)


def _ev(spark, d):
    return read(spark, d, "events")


def journal_stats(spark, d):
    """Counts by type, by operation and in all, in one pass."""
    return J.statistics(_j(spark, d))


def journal_range(spark, d):
    """The entries of a sequence range and type."""
    return J.between(read(spark, d, "journal"), 100, 2000, "neuron").select("sequence", "entity_id", "payload")


def journal_compact(spark, d):
    """ST5."""
    return J.compacted(_j(spark, d), 1000).groupBy("entity_type").agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence"))


def journal_append(spark, d):
    """ST5: the changes of late arrival appended after the others with new sequences."""
    j = _j(spark, d)
    late = j.where("received_at > changed_at + INTERVAL 1 HOUR")
    out = J.appended(j, late.drop("sequence"), ["received_at", "entity_id", "node_id", "changed_at"])
    return out.agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.countDistinct("sequence").alias("n_sequences"))


def local_changes(spark, d):
    """ST7: events recorded as local changes with their clocks."""
    c = _ev(spark, d).select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("operation"), F.struct("ts", "event_id").alias("at"))
    return J.recorded(c, "node-local", "at").groupBy("entity_id").agg(F.max(C.total("vector_clock")).alias("count"))


def clock_suite(spark, d):
    """ST6: each clock ticked by its node, its sum, size and text."""
    j = _j(spark, d)
    return j.select("sequence", C.shown("vector_clock").alias("clock"), C.shown(C.tick("vector_clock", F.col("node_id"))).alias("ticked"), C.total("vector_clock").alias("total"), F.size("vector_clock").cast("long").alias("n_nodes"))


def clock_merge(spark, d):
    """ST6, J12: the merged clock of every entity."""
    return J.entity_clocks(_j(spark, d)).select("entity_type", "entity_id", C.shown("vector_clock").alias("clock"))


def clock_compare(spark, d):
    """ST6: each change of an entity against the one that arrived before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity_type", "entity_id").orderBy("sequence")
    j = _j(spark, d).withColumn("_before", F.lag("vector_clock").over(w)).where("_before IS NOT NULL")
    return j.withColumn("relation", C.compared("_before", "vector_clock")).groupBy("relation").agg(F.count("*").alias("n"))


def node_states(spark, d):
    """ST8, ST11, S33: what is known of each node."""
    return J.node_state(_j(spark, d))


def state_diff(spark, d):
    """ST8, U7."""
    j = _j(spark, d)
    return J.state_diff(j.where("sequence % 3 <> 0"), j.where("sequence % 3 <> 1"))


def conflicts(spark, d):
    """J11, ST9."""
    return J.conflicts(*_sides(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"))


def lww(spark, d):
    """ST10: conflicts resolved by wall clock."""
    a, b = _sides(spark, d)
    c = J.conflicts(a, b)
    at = lambda j, p: j.select(F.col("sequence").alias(f"{p}_sequence"), F.col("changed_at").alias(f"{p}_changed_at"))
    return J.resolved(c.join(at(a, "local"), "local_sequence").join(at(b, "remote"), "remote_sequence")).groupBy("entity_type", "winner").agg(F.count("*").alias("n"))


def remote_apply(spark, d):
    """ST9: half the journal applied twice appends what is new once."""
    j = _j(spark, d)
    first = J.applied(j.where("sequence % 2 = 0"), j)
    both = j.where("sequence % 2 = 0").unionByName(first.drop("synced"))
    again = J.applied(both, j)
    return first.agg(F.count("*").alias("n_new")).join(again.agg(F.count("*").alias("n_again")))


def event_stats(spark, d):
    """A7."""
    return E.event_stats(_ev(spark, d))


def event_filter(spark, d):
    """F5."""
    return E.filtered(_ev(spark, d), ["click", "purchase", "view"], after=F.lit("2024-01-05").cast("timestamp_ntz"), before=F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "user_id", "event_type")


def event_history(spark, d):
    """ST2, W7, K10: the last 20 events of every user."""
    return E.history(_ev(spark, d), 20, "user_id").select("user_id", "event_id")


def histogram(spark, d):
    """A16."""
    return E.histogram(_ev(spark, d), "event_type")


def value_summary(spark, d):
    """Count, sum, smallest and largest."""
    return E.value_summary(_ev(spark, d), "event_type").select("event_type", "n", F.round("total", 4).alias("total"), "smallest", "largest")


def counters(spark, d):
    """A17."""
    return E.counters(_ev(spark, d), ["event_type", "user_id"])


def gauges(spark, d):
    """Last values."""
    return E.gauges(_ev(spark, d), ["event_type", "user_id"]).select("event_type", "user_id", "value")


def health(spark, d):
    """ST14."""
    return E.health(_ev(spark, d), "event_type", 100.0)


def exposition(spark, d):
    """Counters as text."""
    return E.exposition(E.counters(_ev(spark, d), ["event_type"]), "events_total", ["event_type"], "total")


def progress(spark, d):
    """ST4, W6: every user's events as ticks of a session."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = _ev(spark, d).select("user_id", "event_id", "ts", F.row_number().over(w).alias("current"), F.count("*").over(Window.partitionBy("user_id")).alias("total"))
    return E.progress(t, "user_id").select("user_id", "event_id", F.round("percent", 6).alias("percent"), F.round("throughput", 9).alias("throughput"), F.round("eta_seconds", 3).alias("eta_seconds"))


def working_set(spark, d):
    """W8, SR5."""
    return E.working_set(_ev(spark, d)).select("user_id", "event_type", "last", F.col("place").cast("long").alias("place"))


def dopamine(spark, d):
    """W12, SR5: values above 80 are good, below 20 bad, others searches."""
    kind = F.when(F.col("value") > 80, "good").when(F.col("value") < 20, "bad").otherwise("search")
    return E.dopamine(_ev(spark, d).select("user_id", "ts", kind.alias("kind")), "user_id", "ts", "kind").select("user_id", F.round("level", 6).alias("level"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        journal_stats, journal_range, journal_compact, journal_append, local_changes, clock_suite, clock_merge, clock_compare, node_states, state_diff, conflicts, lww,
        remote_apply, event_stats, event_filter, event_history, histogram, value_summary, counters, gauges, health, exposition, progress, working_set, dopamine,
    )
}

_J = f"""
WITH j AS (
  SELECT DISTINCT ON (sequence) sequence, {key('entity_type')} AS entity_type, {key('operation')} AS operation, {key('entity_id')} AS entity_id, payload,
         vector_clock AS c, changed_at, {key('node_id')} AS node_id, received_at FROM journal)
"""
_SHOW = "array_to_string(list_transform(list_sort(map_entries({0})), lambda e: e.key || ':' || e.value), ',')"
_SIDES = _J + """, own AS (
  SELECT *, coalesce(c[node_id], 0) AS own, list_sort(map_entries(c)) AS en FROM j),
n AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id, node_id ORDER BY own DESC, sequence DESC) = 1),
conf AS (
  SELECT a.entity_type, a.entity_id, a.changed_at AS la, b.changed_at AS ra FROM n a JOIN n b ON a.entity_type = b.entity_type AND a.entity_id = b.entity_id
    AND len(a.node_id) % 2 = 0 AND len(b.node_id) % 2 = 1
  WHERE len(list_filter(map_keys(a.c), lambda k: coalesce(b.c[k], 0) < a.c[k])) > 0 AND len(list_filter(map_keys(b.c), lambda k: coalesce(a.c[k], 0) < b.c[k])) > 0)
"""

SQL = {
    "dopamine": """
WITH s AS (SELECT user_id, list(CASE WHEN value > 80 THEN 20.0::DOUBLE WHEN value < 20 THEN 30 ELSE 10 END ORDER BY ts, CASE WHEN value > 80 THEN 'good' WHEN value < 20 THEN 'bad' ELSE 'search' END) AS k, count(*) AS n
           FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(list_concat([0.5::DOUBLE], k), lambda x, e: CASE e WHEN 10 THEN least(1, greatest(0.1::DOUBLE, x * 0.9::DOUBLE))
    WHEN 20 THEN least(1, greatest(0.1::DOUBLE, x + 0.3::DOUBLE)) ELSE least(1, greatest(0.1::DOUBLE, x - 0.15::DOUBLE)) END), 6) AS level, n FROM s""",
    "progress": """
WITH t AS (
  SELECT user_id, event_id, ts, row_number() OVER w AS current, count(*) OVER (PARTITION BY user_id) AS total, epoch_us(ts) / 1e6 AS sec, lag(epoch_us(ts) / 1e6) OVER w AS before,
         first_value(epoch_us(ts) / 1e6) OVER w AS began FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN before IS NOT NULL THEN 1 / greatest(0.001::DOUBLE, sec - before) END AS rate FROM t),
l AS (SELECT *, list_filter(list(rate) OVER (PARTITION BY user_id ORDER BY ts, current ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS rates FROM r),
m AS (SELECT *, CASE WHEN len(rates) > 0 THEN list_sum(list_transform(rates, lambda x, i: x * 2.0 ** (i - 1))) / list_sum(list_transform(rates, lambda x, i: 2.0 ** (i - 1))) END AS mean FROM l)
SELECT user_id, event_id, round(least(100.0::DOUBLE, current / total * 100), 6) AS percent, round(CASE WHEN sec > began THEN current / (sec - began) ELSE 0 END, 9) AS throughput,
       round(CASE WHEN mean > 0 THEN greatest(0, total - current) / mean END, 3) AS eta_seconds FROM m""",
    "journal_stats": _J + "SELECT entity_type, operation, count(*) AS n, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM j GROUP BY GROUPING SETS ((entity_type), (operation), ())",
    "journal_range": "SELECT sequence, entity_id, payload FROM journal WHERE sequence BETWEEN 100 AND 2000 AND entity_type = 'neuron'",
    "journal_compact": _J + "SELECT entity_type, count(*) AS n, min(sequence) AS first_sequence FROM j WHERE sequence >= 1000 GROUP BY 1",
    "journal_append": _J
    + """, l AS (SELECT count(*) AS n FROM j WHERE received_at > changed_at + INTERVAL 1 HOUR), m AS (SELECT max(sequence) AS s FROM j)
      SELECT n, s + 1 AS first_sequence, s + n AS last_sequence, n AS n_sequences FROM l, m""",
    "local_changes": "SELECT user_id::VARCHAR AS entity_id, count(*) AS count FROM events GROUP BY 1",
    "clock_suite": _J
    + f"""SELECT sequence, {_SHOW.format('c')} AS clock,
        {_SHOW.format("map_from_entries(list_concat(list_filter(map_entries(c), lambda e: e.key <> node_id), [{'key': node_id, 'value': coalesce(c[node_id], 0) + 1}]))")} AS ticked,
        list_sum(map_values(c))::BIGINT AS total, cardinality(c)::BIGINT AS n_nodes FROM j""",
    "clock_merge": _J
    + """, e AS (SELECT entity_type, entity_id, unnest(map_keys(c)) AS k, unnest(map_values(c)) AS v FROM j),
      m AS (SELECT entity_type, entity_id, k, max(v) AS v FROM e GROUP BY ALL)
      SELECT entity_type, entity_id, string_agg(k || ':' || v, ',' ORDER BY k) AS clock FROM m GROUP BY 1, 2""",
    "clock_compare": _J
    + """, p AS (SELECT c, lag(c) OVER (PARTITION BY entity_type, entity_id ORDER BY sequence) AS b FROM j),
      r AS (SELECT len(list_filter(map_keys(c), lambda k: coalesce(b[k], 0) < c[k])) > 0 AS less, len(list_filter(map_keys(b), lambda k: coalesce(c[k], 0) < b[k])) > 0 AS more FROM p WHERE b IS NOT NULL)
      SELECT CASE WHEN less AND more THEN 'concurrent' WHEN less THEN 'before' WHEN more THEN 'after' ELSE 'equal' END AS relation, count(*) AS n FROM r GROUP BY 1""",
    "node_states": _J + "SELECT node_id, max(sequence) AS last_sequence, count(*) AS n, max(coalesce(c[node_id], 0)) AS counter FROM j GROUP BY 1",
    "state_diff": _J
    + """, a AS (SELECT node_id, max(coalesce(c[node_id], 0)) AS l FROM j WHERE sequence % 3 <> 0 GROUP BY 1), b AS (SELECT node_id, max(coalesce(c[node_id], 0)) AS r FROM j WHERE sequence % 3 <> 1 GROUP BY 1),
      f AS (SELECT coalesce(a.node_id, b.node_id) AS node_id, coalesce(l, 0) AS local_counter, coalesce(r, 0) AS remote_counter FROM a FULL JOIN b ON a.node_id = b.node_id)
      SELECT *, CASE WHEN local_counter > remote_counter THEN 'local' WHEN local_counter < remote_counter THEN 'remote' ELSE 'equal' END AS ahead FROM f""",
    "conflicts": _SIDES + "SELECT entity_type, count(*) AS n FROM conf GROUP BY 1",
    "lww": _SIDES + "SELECT entity_type, CASE WHEN ra > la THEN 'remote' ELSE 'local' END AS winner, count(*) AS n FROM conf GROUP BY 1, 2",
    "remote_apply": _J
    + """, k AS (SELECT sequence, entity_type || '|' || entity_id || '|' || node_id || '|' || list_sort(map_entries(c))::VARCHAR AS k FROM j)
      SELECT count(DISTINCT k) AS n_new, 0::BIGINT AS n_again FROM k WHERE k NOT IN (SELECT k FROM k WHERE sequence % 2 = 0)""",
    "event_stats": "SELECT event_type, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY 1",
    "event_filter": "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view') AND ts BETWEEN '2024-01-05' AND '2024-01-20'",
    "event_history": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "histogram": "SELECT event_type, le, count(*) FILTER (value <= b) AS n FROM events, (VALUES "
    + ", ".join(f"('{b}', {b}::DOUBLE)" for b in E.BUCKETS)
    + ", ('+Inf', 'infinity'::DOUBLE)) t(le, b) GROUP BY 1, 2",
    "value_summary": "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS smallest, max(value) AS largest FROM events GROUP BY 1",
    "counters": "SELECT event_type, user_id, count(*) AS total FROM events GROUP BY 1, 2",
    "gauges": "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "health": "SELECT event_type, CASE WHEN max(value) IS NULL THEN 'unhealthy' WHEN max(value) > 100 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY 1",
    "exposition": """SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT '# TYPE events_total counter'""",
    "working_set": """SELECT user_id, event_type, max(ts) AS last, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS place FROM events GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) <= 7""",
}
