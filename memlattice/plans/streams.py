"""Streaming queries, run over what is there, and source queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from memlattice.plans.data_problems import SQL as PROBLEMS
from memlattice.session import shared_dir
from memlattice.sources import connectors, validation
from memlattice.sources.tables import read
from memlattice.streaming import feeds


def _stream(spark, d, name):
    """A file stream of a table (a file or a folder of files)."""
    path = f"{d}/{name}.parquet"
    like = read(spark, d, name)
    if os.path.isfile(path):
        return spark.readStream.schema(like.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return feeds.stream(spark, path, like)


def _folder(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


def stream_event_windows(spark, d):
    """ST1, W-a: events per hour and type, through a stream with a watermark."""
    return feeds.run_to_table(feeds.windowed_events(_stream(spark, d, "events")), _folder(spark, "windows")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_journal_state(spark, d):
    """ST7, ST9: the journal applied as a stream of micro-batches, then the live entities."""
    path = os.path.join(shared_dir(spark), f"journal-{uuid.uuid4().hex[:10]}")
    a = feeds.JournalApplier(spark, f"{path}/data")
    a.start(_stream(spark, d, "journal"), f"{path}/checkpoint").awaitTermination()
    return a.state().select("entity_type", "entity_id")


def stream_progress(spark, d):
    """ST4: every user's events as ticks of a session, state kept in the stream."""
    t = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("current"), F.lit(10**9).cast("long").alias("total"))
    return feeds.run_to_table(feeds.progress_states(t), _folder(spark, "progress"), "update").groupBy("session").agg(F.max("current").alias("current"))


def snapshot_roundtrip(spark, d):
    """A table saved and loaded by name."""
    s = connectors.SnapshotStore(spark, os.path.join(shared_dir(spark), f"snap-{uuid.uuid4().hex[:10]}"))
    s.save("customers", read(spark, d, "customer"))
    return s.load("customers").select("c_custkey", "c_name")


def sync_roundtrip(spark, d):
    """The journal exported as a sync file and read again."""
    path = os.path.join(shared_dir(spark), f"sync-{uuid.uuid4().hex[:10]}")
    connectors.export_sync(read(spark, d, "journal"), path)
    return connectors.import_sync(spark, path).groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("sequence").alias("sum_sequence"), F.max("changed_at").alias("last"))


def document_schema(spark, d):
    """Field kinds of the metadata documents."""
    return connectors.inferred_schema(read(spark, d, "events"), "props").select("field", "types", "n", "required")


def invalid_rows(spark, d):
    """orders whose priority or total breaks a rule."""
    f = validation.Field
    rules = [f("o_orderkey", "integer", required=True), f("o_totalprice", "number", low=0, high=300000), f("o_orderpriority", pattern=r"[1-5]-[A-Z ]+")]
    return validation.invalid_rows(read(spark, d, "orders"), rules).select("o_orderkey", F.array_join("errors", ";").alias("errors"))


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_journal_state, stream_progress, snapshot_roundtrip, sync_roundtrip, document_schema, invalid_rows)}

SQL = {
    "stream_event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_journal_state": PROBLEMS["p3_found"].replace("SELECT entity_type, entity_id, sequence FROM live", "SELECT entity_type, entity_id FROM live"),
    "stream_progress": "SELECT user_id::VARCHAR AS session, max(event_id) AS current FROM events GROUP BY 1",
    "snapshot_roundtrip": "SELECT c_custkey, c_name FROM customer",
    "sync_roundtrip": "SELECT entity_type, count(*) AS n, sum(sequence)::BIGINT AS sum_sequence, max(changed_at) AS last FROM journal GROUP BY 1",
    "invalid_rows": """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice NOT BETWEEN 0 AND 300000 THEN 'o_totalprice must be between 0 and 300000' END,
        CASE WHEN NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+') THEN 'o_orderpriority has the wrong form' END], lambda x: x IS NOT NULL), ';') AS errors
        FROM orders WHERE o_totalprice NOT BETWEEN 0 AND 300000 OR NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')""",
}
