"""The change journal: ranges, statistics, appends, state differences and conflict resolution.

Journal: (sequence, entity_type, operation, entity_id, payload, vector_clock, changed_at, node_id, received_at).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.session import materialize

from memlattice.functions import clocks as C
from memlattice.functions.keys import tidy


def tidied(journal: DataFrame) -> DataFrame:
    """Keys tidied, clocks never null, each sequence once."""
    j = journal
    for c in ("entity_type", "operation", "entity_id", "node_id"):
        j = j.withColumn(c, tidy(c))
    return j.withColumn("vector_clock", F.coalesce("vector_clock", F.create_map().cast("map<string,bigint>"))).dropDuplicates(["sequence"])


def between(journal: DataFrame, low: int | None = None, high: int | None = None, entity_type: str | None = None, entity_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries of a sequence range (both ends included), of a type, of an entity, in order; predicates reach the scan."""
    for column, test in (("sequence", None if low is None else F.col("sequence") >= low), ("sequence", None if high is None else F.col("sequence") <= high), ("entity_type", None if entity_type is None else F.col("entity_type") == entity_type), ("entity_id", None if entity_id is None else F.col("entity_id") == entity_id)):
        if test is not None:
            journal = journal.where(test)
    out = journal.orderBy("sequence")
    return out.limit(min(limit, 1000)) if limit else out


def statistics(journal: DataFrame) -> DataFrame:
    """(entity_type, operation, n, first_sequence, last_sequence) with subtotals as nulls, in one pass of grouping sets."""
    return journal.groupingSets([["entity_type"], ["operation"], []], "entity_type", "operation").agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


def compacted(journal: DataFrame, before: int) -> DataFrame:
    return journal.where(F.col("sequence") >= before)


def appended(journal: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """``changes`` with sequences after the journal's last one, in ``order``.

    Numbers are dealt per range partition from its start, so no single task numbers a
    batch; the partitions are written first, so counts and numbers come from the same ones.
    """
    last = journal.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    sorted_ = changes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    sorted_ = materialize(sorted_, "numbered")
    starts = {r["_p"]: r["n"] for r in sorted_.groupBy("_p").count().withColumnRenamed("count", "n").collect()}
    at, offset = last, {}
    for p in sorted(starts):
        offset[p], at = at, at + starts[p]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]), F.col("_p")) if offset else F.lit(last)
    return sorted_.withColumn("sequence", (base + F.col("_i") + 1).cast("long")).drop("_p", "_i")


def recorded(changes: DataFrame, node: str, at: str) -> DataFrame:
    """Local changes with their clocks: the node's count goes up by one a change, in order of ``at``, per entity."""
    w = Window.partitionBy("entity_type", "entity_id").orderBy(at)
    return changes.withColumn("node_id", F.lit(node)).withColumn("vector_clock", F.create_map(F.lit(node), F.row_number().over(w).cast("bigint")))


def node_state(journal: DataFrame) -> DataFrame:
    """(node_id, last_sequence, n, counter): what is known of each node; counter is its largest own clock entry."""
    return journal.groupBy("node_id").agg(F.max("sequence").alias("last_sequence"), F.count("*").alias("n"), F.max(C.counter("vector_clock", F.col("node_id"))).alias("counter"))


def entity_clocks(journal: DataFrame) -> DataFrame:
    """(entity_type, entity_id, vector_clock): the merge of all clocks of an entity, node by node."""
    rows = journal.select("entity_type", "entity_id", F.explode("vector_clock").alias("k", "v")).groupBy("entity_type", "entity_id", "k").agg(F.max("v").alias("v"))
    return rows.groupBy("entity_type", "entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("vector_clock"))


def state_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(node_id, local_counter, remote_counter, ahead): per node, whose journal knows more."""
    a = node_state(local).select("node_id", F.col("counter").alias("local_counter"))
    b = node_state(remote).select("node_id", F.col("counter").alias("remote_counter"))
    z = F.lit(0).cast("bigint")
    j = a.join(b, "node_id", "full").select("node_id", F.coalesce("local_counter", z).alias("local_counter"), F.coalesce("remote_counter", z).alias("remote_counter"))
    return j.withColumn("ahead", F.when(F.col("local_counter") > F.col("remote_counter"), "local").when(F.col("local_counter") < F.col("remote_counter"), "remote").otherwise("equal"))


def newest_per_node(journal: DataFrame) -> DataFrame:
    """Per entity and node the last change by the node's own count, then sequence: what another node must be compared with."""
    own = C.counter("vector_clock", F.col("node_id"))
    best = F.max(F.struct(own.alias("c"), "sequence", "vector_clock_entries", "changed_at", "operation", "payload"))
    j = journal.withColumn("vector_clock_entries", F.array_sort(F.map_entries("vector_clock")))
    g = j.groupBy("entity_type", "entity_id", "node_id").agg(best.alias("b"))
    return g.select("entity_type", "entity_id", "node_id", F.col("b.sequence").alias("sequence"), F.map_from_entries("b.vector_clock_entries").alias("vector_clock"), "b.changed_at", "b.operation", "b.payload")


def conflicts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(entity_type, entity_id, local_sequence, remote_sequence, relation): pairs of per-node newest changes of
    the two sides whose clocks are concurrent. An entity has one such change a node, so pairs stay few."""
    a = newest_per_node(local).select("entity_type", "entity_id", F.col("sequence").alias("local_sequence"), F.col("vector_clock").alias("_a"), F.col("node_id").alias("local_node"))
    b = newest_per_node(remote).select("entity_type", "entity_id", F.col("sequence").alias("remote_sequence"), F.col("vector_clock").alias("_b"), F.col("node_id").alias("remote_node"))
    j = a.join(b, ["entity_type", "entity_id"]).where("local_node <> remote_node").withColumn("relation", C.compared("_a", "_b"))
    return j.where("relation = 'concurrent'").select("entity_type", "entity_id", "local_node", "remote_node", "local_sequence", "remote_sequence", "relation")


def resolved(pairs: DataFrame, strategy: str = "last-write-wins") -> DataFrame:
    """Pairs (local_*, remote_*: clock, changed_at, payload) with ``winner``: the later one (ties local), or by
    clock order first (strategy ``vector-clock``)."""
    late = F.when(F.col("remote_changed_at") > F.col("local_changed_at"), "remote").otherwise("local")
    if strategy == "vector-clock":
        r = C.compared("local_clock", "remote_clock")
        late = F.when(r == "before", "remote").when(r == "after", "local").otherwise(late)
    return pairs.withColumn("winner", late)


def applied(journal: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote changes that the journal hasn't, by (node, entity, clock): applying a batch again appends nothing."""
    k = ["entity_type", "entity_id", "node_id", "_clock"]
    with_clock = lambda d: d.withColumn("_clock", F.array_sort(F.map_entries("vector_clock")))
    fresh = with_clock(remote).join(with_clock(journal).select(k), k, "left_anti")
    return fresh.dropDuplicates(k).drop("_clock").withColumn("synced", F.lit(True))
