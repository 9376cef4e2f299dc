"""Rebuilding the current state of entities from a change feed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions.keys import tidy

#: An entity that has more than one in HOT_SHARE of all changes is spread over SALTS tasks.
HOT_SHARE = 1024
SALTS = 128
#: Changes of a frontier that are compared one by one; more are looked up by node.
FEW = 16
CREATE, UPDATE, DELETE = 1, 2, 3
_NO_TIME = -(1 << 62)
_NO_SEQUENCE = 1 << 62

_STATE = "entity_type string, entity_id string, op int, sequence long, at long, node_id string, clock map<string,long>, payload string"


def _covers(a: dict, b: dict) -> bool:
    return all(a.get(k, 0) >= v for k, v in b.items())


class Front:
    """The changes that no other change comes after by clock.

    A change is (clock, at, sequence, node, op, payload). One that is there already (same
    node and clock) is skipped; the smaller sequence stays. Clocks are compared only
    where one can cover the other: with those that know the change's own node, and with
    those whose own node the change knows; changes that lack their node's count are few.
    """

    __slots__ = ("changes", "knows", "own", "odd")

    def __init__(self) -> None:
        self.changes: dict[int, tuple] = {}
        #: Changes by the nodes they know, by their own node, and those without their own count; kept for many only.
        self.knows: dict[str, dict[int, tuple]] | None = None
        self.own: dict[str, dict[int, tuple]] = {}
        self.odd: dict[int, tuple] = {}

    def push(self, change: tuple) -> None:
        clock, _, sequence, node = change[:4]
        near = self.changes if self.knows is None or node not in clock else self.knows.get(node, {})
        for x in near.values():
            if x[0] == clock:
                if x[3] == node:
                    if sequence < x[2]:
                        self.drop(x)
                        self.add(change)
                    return
            elif _covers(x[0], clock):
                return
        if self.knows is None:
            rivals = self.changes.values()
        else:
            rivals = [*self.odd.values(), *(x for k in clock for x in self.own.get(k, {}).values())]
        for x in [x for x in rivals if x[0] != clock and _covers(clock, x[0])]:
            self.drop(x)
        self.add(change)

    def add(self, x: tuple) -> None:
        self.changes[id(x)] = x
        if self.knows is not None:
            self.enter(x)
        elif len(self.changes) > FEW:
            self.knows = {}
            for y in self.changes.values():
                self.enter(y)

    def enter(self, x: tuple) -> None:
        for k in x[0]:
            self.knows.setdefault(k, {})[id(x)] = x
        (self.own.setdefault(x[3], {}) if x[3] in x[0] else self.odd)[id(x)] = x

    def drop(self, x: tuple) -> None:
        del self.changes[id(x)]
        if self.knows is not None:
            for k in x[0]:
                del self.knows[k][id(x)]
            del (self.own[x[3]] if x[3] in x[0] else self.odd)[id(x)]


def newest(front: Front) -> tuple | None:
    """Of the clock-maximal changes the one with the latest wall clock, then the largest sequence."""
    return max(front.changes.values(), key=lambda x: (x[1], x[2]), default=None)


def fields_of(payload: str | None) -> dict[str, str]:
    """The top-level columns of a JSON object with their values as text (null: the column's value is null); else none."""
    try:
        found = json.loads(payload) if payload else None
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return {}
    return {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items()}


def is_after(x: tuple, y: tuple) -> bool:
    if x[0] != y[0]:
        if _covers(x[0], y[0]):
            return True
        if _covers(y[0], x[0]):
            return False
    return (x[1], x[2]) > (y[1], y[2])


class EntityState:
    """The state machine of one entity: the frontiers of its creates, deletes and of all changes.

    Under a total order the entity is live if its last create comes after its last
    delete, and then the last change of all stands (it is that create or an update after
    it). With ``columns`` each column of the payloads has its own frontier too: an update
    that carries some columns leaves the others, and what came before the last create is
    gone. Frontiers merge in any order, so parts of one entity can be replayed apart.
    """

    __slots__ = ("creates", "deletes", "all", "columns")

    def __init__(self, columns: bool = False) -> None:
        self.creates, self.deletes, self.all = Front(), Front(), Front()
        self.columns: dict[str, Front] | None = {} if columns else None

    def apply(self, change: tuple) -> None:
        self.all.push(change)
        if change[4] == CREATE:
            self.creates.push(change)
        elif change[4] == DELETE:
            self.deletes.push(change)
        if self.columns is not None and change[4] != DELETE:
            for name in fields_of(change[5]):
                self.columns.setdefault(name, Front()).push(change)

    def standing(self) -> tuple | None:
        create, delete = newest(self.creates), newest(self.deletes)
        if create is None or delete is not None and is_after(delete, create):
            return None
        return newest(self.all)

    def merged(self) -> Iterator[tuple[str, str | None, int]]:
        """(column, value, sequence) of a live entity's columns."""
        create = newest(self.creates)
        for name in sorted(self.columns or ()):
            last = newest(self.columns[name])
            if last is create or is_after(last, create):
                yield name, fields_of(last[5])[name], last[2]

    def parts(self) -> Iterator[tuple]:
        seen = set()
        for front in (self.all, self.creates, self.deletes, *(self.columns or {}).values()):
            for x in front.changes.values():
                if id(x) not in seen:
                    seen.add(id(x))
                    yield x


_COLUMNS = "entity_type string, entity_id string, column string, value string, sequence long"


def _replayer(final: bool, columns: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entity_type", pa.string()), ("entity_id", pa.string()), ("op", pa.int32()), ("sequence", pa.int64()), ("at", pa.int64()), ("node_id", pa.string()), ("clock", pa.map_(pa.string(), pa.int64())), ("payload", pa.string())])
        if final and columns:
            schema = pa.schema([("entity_type", pa.string()), ("entity_id", pa.string()), ("column", pa.string()), ("value", pa.string()), ("sequence", pa.int64())])
        key, state, out = None, None, []

        def emit() -> None:
            if final and columns:
                if state.standing():
                    out.extend((*key, *x) for x in state.merged())
                return
            for x in [y for y in (state.standing(),) if y] if final else state.parts():
                out.append((*key, x[4], x[2], x[1], x[3], list(x[0].items()), x[5]))

        def table() -> pa.RecordBatch:
            rows = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(rows, schema)], schema=schema)

        for b in batches:
            for et, ei, op, seq, at, node, clock, payload in zip(*(c.to_pylist() for c in b.columns)):
                if (et, ei) != key:
                    if key is not None:
                        emit()
                    key, state = (et, ei), EntityState(columns)
                state.apply(({k: v for k, v in clock or () if v}, at, seq, node, op, payload))
            if len(out) > 5000:
                yield table()
        if key is not None:
            emit()
        yield table()

    return run


def changes(journal: DataFrame) -> DataFrame:
    """Journal rows in the shape of the replay; rows without entity or with an unknown operation are no changes."""
    op = tidy("operation")
    clock = F.coalesce(
        F.transform_keys("vector_clock", lambda k, v: tidy(k)), F.create_map().cast("map<string,bigint>")
    )
    return journal.select(
        tidy("entity_type").alias("entity_type"),
        tidy("entity_id").alias("entity_id"),
        F.when(op == "create", CREATE).when(op == "update", UPDATE).when(op == "delete", DELETE).alias("op"),
        F.coalesce("sequence", F.lit(_NO_SEQUENCE)).alias("sequence"),
        F.coalesce(F.unix_micros(F.col("changed_at").cast("timestamp")), F.lit(_NO_TIME)).alias("at"),
        tidy("node_id").alias("node_id"),
        clock.alias("clock"),
        "payload",
    ).where("entity_type IS NOT NULL AND entity_id IS NOT NULL AND op IS NOT NULL")


def hot_entities(feed: DataFrame) -> list[str]:
    """At most HOT_SHARE entities that may each have over 1/HOT_SHARE of all changes (bounded sketch)."""
    key = F.concat_ws("\u0001", "entity_type", "entity_id")
    row = feed.select(key.alias("k")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(k, {HOT_SHARE}, {HOT_SHARE * 16})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] * HOT_SHARE > row["n"] > 10_000]


def replay(journal: DataFrame) -> DataFrame:
    """The live entities with the change that stands for each: (entity_type, entity_id,
    sequence, payload, node_id, changed_at, vector_clock).

    Changes are repartitioned by entity, sorted by sequence within partitions and folded
    by a state machine; deliveries that were applied already (same node and clock) are
    skipped, keeping the smallest sequence. Clock order comes first, then
    ``changed_at``, then sequence. A hot entity is spread over SALTS tasks by (node,
    clock); the parts' frontiers, a few rows each, are merged by a second replay. Null
    clock: the empty clock; null changed_at: before all others; null sequence: comes
    last and comes out null; null payload stays null; extra columns are ignored; an
    empty journal gives no rows.
    """
    live = _replayed(journal, _replayer(final=False), _replayer(final=True), _STATE)
    return live.select(
        "entity_type",
        "entity_id",
        F.when(F.col("sequence") != _NO_SEQUENCE, F.col("sequence")).alias("sequence"),
        "payload",
        "node_id",
        F.when(F.col("at") != _NO_TIME, F.timestamp_micros("at")).alias("changed_at"),
        F.col("clock").alias("vector_clock"),
    )


def replay_columns(journal: DataFrame) -> DataFrame:
    """The columns of the live entities: (entity_type, entity_id, column, value, sequence).

    Payloads are partial: a change sets the columns (top-level keys of a JSON object) that
    it carries and leaves the others as earlier changes since the last create left
    them. ``value`` is text (null for JSON's null), ``sequence`` that of the change that
    set it. Payloads that are null, empty, cut off or no objects set nothing, so an entity without any
    column has no row; else as ``replay``.
    """
    found = _replayed(journal, _replayer(final=False, columns=True), _replayer(final=True, columns=True), _COLUMNS)
    return found.withColumn("sequence", F.when(F.col("sequence") != _NO_SEQUENCE, F.col("sequence")))


def _replayed(journal: DataFrame, part, whole, shape: str) -> DataFrame:
    feed = changes(journal)
    hot = hot_entities(feed)
    columns = feed.columns
    if hot:
        entity = F.concat_ws("\u0001", "entity_type", "entity_id")
        salt = F.pmod(F.xxhash64("node_id", F.array_sort(F.map_entries("clock")).cast("string")), F.lit(SALTS))
        feed = feed.withColumn("_salt", F.when(entity.isin(hot), salt).otherwise(F.lit(0)))
        parts = feed.repartition("entity_type", "entity_id", "_salt").sortWithinPartitions("entity_type", "entity_id", "_salt", "sequence").select(columns)
        feed = parts.mapInArrow(part, _STATE)
    ready = feed.repartition("entity_type", "entity_id").sortWithinPartitions("entity_type", "entity_id", "sequence").select(columns)
    return ready.mapInArrow(whole, shape)


def live_report(live: DataFrame) -> DataFrame:
    """Live entities and the span of their standing changes per entity type."""
    return live.groupBy("entity_type").agg(
        F.count("*").alias("n_live"), F.count("payload").alias("n_with_payload"), F.max("sequence").alias("last_sequence")
    )
