"""Queries of the general data problems (references, replay) and their SQL."""

from __future__ import annotations

from memlattice.operators import references, replay
from memlattice.sources.tables import read


def key(x: str) -> str:
    """SQL: lower case, no white space at the ends."""
    return f"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13)))"


def _dangling(spark, d):
    return references.memory_dangling(read(spark, d, "neurons"), read(spark, d, "synapses"), read(spark, d, "chunk_metadata"))


def p2_found(spark, d):
    return _dangling(spark, d).select("ref_table", "record_id", "field_name", "missing_key")


def p2_report(spark, d):
    return references.dangling_report(_dangling(spark, d))


def p2_intervals(spark, d):
    """Dangling references by where they stand beside the validity interval of what they name."""
    return references.interval_report(_dangling(spark, d))


def p3_found(spark, d):
    return replay.replay(read(spark, d, "journal")).select("entity_type", "entity_id", "sequence")


def p3_state(spark, d):
    return replay.replay(read(spark, d, "journal")).select("entity_type", "entity_id", "sequence", "payload", "node_id")


def p3_columns(spark, d):
    """The columns of the live entities, each with the change that set it: payloads are partial."""
    return replay.replay_columns(read(spark, d, "journal"))


def p3_report(spark, d):
    return replay.live_report(replay.replay(read(spark, d, "journal")))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_intervals, p3_found, p3_state, p3_columns, p3_report)}

_P2 = f"""
WITH cur AS (
  SELECT {key('id')} AS id, arg_max(deleted_at, updated_at) AS gone, max_by(created_at, updated_at) AS created_at,
         max_by(chunk_hashes, updated_at) AS chunk_hashes, max(updated_at) AS u
  FROM neurons WHERE id IS NOT NULL GROUP BY 1),
cur2 AS (
  SELECT {key('n.id')} AS id, max(n.deleted_at) AS gone, max(n.created_at) AS created_at, max(n.chunk_hashes) AS chunk_hashes
  FROM neurons n JOIN cur ON {key('n.id')} = cur.id AND n.updated_at = cur.u GROUP BY 1),
par AS (
  SELECT 'n' AS kind, id AS k, created_at AS f, gone AS t, gone IS NOT NULL AS gone FROM cur2
  UNION ALL
  SELECT 'c', {key('hash')}, min(created_at), NULL, coalesce(max(ref_count) <= 0, false) FROM chunk_metadata WHERE hash IS NOT NULL GROUP BY 1, 2),
refs AS (
  SELECT 'synapses' AS ref_table, {key('id')} AS record_id, 'source_id' AS field_name, {key('source_id')} AS missing_key, 'n' AS kind, created_at AS ts FROM synapses
  UNION ALL
  SELECT 'synapses', {key('id')}, 'target_id', {key('target_id')}, 'n', created_at FROM synapses
  UNION ALL
  SELECT 'neurons', id, 'chunk_hashes', {key('h')}, 'c', created_at FROM (SELECT id, created_at, unnest(chunk_hashes) AS h FROM cur2)),
bad AS (
  SELECT ref_table, record_id, field_name, missing_key, ts,
         CASE WHEN par.k IS NULL THEN 'missing' WHEN par.gone THEN 'deleted' WHEN par.f > refs.ts THEN 'late' END AS reason,
         CASE WHEN par.k IS NULL THEN 'never' WHEN refs.ts < par.f THEN 'before' WHEN refs.ts > par.t THEN 'after' WHEN refs.ts >= par.f THEN 'during' ELSE 'unknown' END AS made
  FROM refs LEFT JOIN par ON par.kind = refs.kind AND par.k = refs.missing_key WHERE refs.missing_key IS NOT NULL),
found AS (
  SELECT ref_table, record_id, field_name, missing_key, min(ts) AS ts,
         min(made) AS made, arg_min(reason, CASE reason WHEN 'missing' THEN 0 WHEN 'deleted' THEN 1 ELSE 2 END) AS reason
  FROM bad WHERE reason IS NOT NULL GROUP BY ALL)
"""

_P3 = f"""
WITH ch AS (
  SELECT {key('entity_type')} AS entity_type, {key('entity_id')} AS entity_id, {key('node_id')} AS node_id,
         {key('operation')} AS op, map_from_entries(list_sort(list_filter(map_entries(vector_clock), lambda e: e.value > 0))) AS c, min(sequence) AS sequence, min(changed_at) AS ts, min(payload) AS payload
  FROM journal WHERE entity_type IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
roles AS (
  SELECT *, 'all' AS part FROM ch UNION ALL SELECT *, op FROM ch WHERE op <> 'update'),
top AS (
  SELECT * FROM roles x WHERE NOT EXISTS (
    SELECT 1 FROM roles y WHERE y.part = x.part AND y.entity_type = x.entity_type AND y.entity_id = x.entity_id AND y.c <> x.c
      AND len(list_filter(map_keys(x.c), lambda k: coalesce(y.c[k], 0) < x.c[k])) = 0)),
one AS (
  SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id, part ORDER BY ts DESC, sequence DESC) = 1),
live AS (
  SELECT a.* FROM one a JOIN one c ON c.part = 'create' AND c.entity_type = a.entity_type AND c.entity_id = a.entity_id
  LEFT JOIN one d ON d.part = 'delete' AND d.entity_type = a.entity_type AND d.entity_id = a.entity_id
  WHERE a.part = 'all' AND (d.entity_id IS NULL OR NOT CASE
    WHEN len(list_filter(map_keys(c.c), lambda k: coalesce(d.c[k], 0) < c.c[k])) = 0 AND d.c <> c.c THEN true
    WHEN len(list_filter(map_keys(d.c), lambda k: coalesce(c.c[k], 0) < d.c[k])) = 0 AND d.c <> c.c THEN false
    ELSE (d.ts, d.sequence) > (c.ts, c.sequence) END))
"""

SQL = {
    "p2_found": _P2 + "SELECT ref_table, record_id, field_name, missing_key FROM found",
    "p2_report": _P2 + "SELECT ref_table, field_name, reason, strftime(ts, '%Y-%m') AS month, count(*) AS n_refs, count(DISTINCT record_id) AS n_records FROM found GROUP BY ALL",
    "p2_intervals": _P2 + "SELECT ref_table, field_name, reason, made, count(*) AS n_refs FROM found GROUP BY ALL",
    "p3_columns": _P3.rstrip().replace(
        "FROM ch WHERE op <> 'update'),",
        """FROM ch WHERE op <> 'update'
  UNION ALL SELECT *, 'column ' || unnest(json_keys(payload)) FROM ch WHERE op <> 'delete' AND json_valid(payload)),""",
        1,
    )
    + """
SELECT f.entity_type, f.entity_id, substr(f.part, 8) AS "column", f.payload ->> ('$."' || substr(f.part, 8) || '"') AS value, f.sequence
FROM one f JOIN live USING (entity_type, entity_id) JOIN one c ON c.part = 'create' AND c.entity_type = f.entity_type AND c.entity_id = f.entity_id
WHERE f.part LIKE 'column %' AND (f.sequence = c.sequence OR CASE
    WHEN len(list_filter(map_keys(c.c), lambda k: coalesce(f.c[k], 0) < c.c[k])) = 0 AND f.c <> c.c THEN true
    WHEN len(list_filter(map_keys(f.c), lambda k: coalesce(c.c[k], 0) < f.c[k])) = 0 AND f.c <> c.c THEN false
    ELSE (f.ts, f.sequence) > (c.ts, c.sequence) END)""",
    "p3_found": _P3 + "SELECT entity_type, entity_id, sequence FROM live",
    "p3_state": _P3 + "SELECT entity_type, entity_id, sequence, payload, node_id FROM live",
    "p3_report": _P3 + "SELECT entity_type, count(*) AS n_live, count(payload) AS n_with_payload, max(sequence) AS last_sequence FROM live GROUP BY 1",
}
