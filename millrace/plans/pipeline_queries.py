"""Queries of the general data-pipeline operators (nested records, repeated messages, incremental runs)."""

from __future__ import annotations

from millrace.operators.events import repeated_deliveries, stored_events
from millrace.operators.incremental import changed_documents, unapplied_records
from millrace.operators.nested import field_rows, flatten_records, nested_objects
from millrace.session import load

QUERIES = {
    "p1_found": lambda s, d: nested_objects(load(s, d, "live_records")),
    "p1_objects": lambda s, d: flatten_records(load(s, d, "live_records")).objects,
    "p1_fields": lambda s, d: flatten_records(load(s, d, "live_records")).fields,
    "p1_bridge": lambda s, d: flatten_records(load(s, d, "live_records")).bridge,
    "p1_rows": lambda s, d: field_rows(load(s, d, "live_records")),
    "p2_found": lambda s, d: repeated_deliveries(load(s, d, "cloud_events")),
    "p2_events": lambda s, d: stored_events(load(s, d, "cloud_events"), ("ce_type", "spec_version", "text_data")),
    "p2_replayed": lambda s, d: stored_events(load(s, d, "cloud_events"), replay=(1, 3)).select("event_source", "event_id", "delivery_id"),
    "p5_found": lambda s, d: unapplied_records(load(s, d, "collection_rows"), load(s, d, "pk_watermarks")),
    "p5_changed": lambda s, d: changed_documents(load(s, d, "collection_rows"), load(s, d, "pk_watermarks")),
}

_IDENTITY = """
SELECT *, coalesce(source, attributes['source'], attributes['ce-source']) AS event_source,
       coalesce(id, attributes['id'], attributes['ce-id']) AS event_id
FROM cloud_events"""

_RANKED = f"""
SELECT *, row_number() OVER (PARTITION BY event_source, event_id ORDER BY received_at NULLS LAST, delivery_id) AS nth
FROM ({_IDENTITY}) WHERE event_source IS NOT NULL AND event_id IS NOT NULL"""

_VALUES = """
WITH RECURSIVE r AS (SELECT rec_id, record_json::JSON AS j FROM live_records WHERE json_valid(record_json)),
v AS (
  SELECT r.rec_id, '/' || replace(replace(e.key, '~', '~0'), '/', '~1') AS path, '' AS parent, e.value AS j FROM r, json_each(coalesce(j->'$.fields', '{}'::JSON)) e
  UNION ALL
  SELECT v.rec_id, v.path || '/' || replace(replace(e.key, '~', '~0'), '/', '~1'),
    CASE WHEN json_keys(v.j)[1] LIKE 'object%' THEN v.path ELSE v.parent END, e.value
  FROM v, json_each(CASE WHEN json_keys(v.j)[1] LIKE 'object%' THEN coalesce(v.j->'$.objectValue.fields', v.j->'$.object_value.fields', '{}'::JSON)
                         WHEN json_keys(v.j)[1] LIKE 'array%' THEN coalesce(v.j->'$.arrayValue.values', v.j->'$.array_value.values', '[]'::JSON) ELSE '{}'::JSON END) e
  WHERE len(json_keys(v.j)) = 1),
bad AS (SELECT DISTINCT rec_id FROM v WHERE len(json_keys(j)) <> 1)
"""

_LAST = """
WITH last AS (
  SELECT link_id, applied FROM (
    SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY manifest_version DESC NULLS LAST, run_id DESC) AS nth
    FROM pk_watermarks WHERE run_state = 'committed') WHERE nth = 1),
marks AS (
  SELECT link_id, unnest(map_keys(applied)) AS part, unnest(map_values(applied)) AS next_seq FROM last)"""

SQL = {
    "p1_found": _VALUES + "SELECT rec_id, path AS node_path, parent AS parent_path FROM v WHERE json_keys(j)[1] IN ('objectValue', 'object_value') AND rec_id NOT IN (FROM bad)",
    "p1_rows": _VALUES + "SELECT rec_id, path AS field_path, regexp_replace(json_keys(j)[1], '_?[Vv]alue$', '') AS kind FROM v WHERE json_keys(j)[1] NOT LIKE 'object%' AND rec_id NOT IN (FROM bad)",
    "p2_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE nth > 1",
    "p2_events": f"SELECT event_source, event_id, received_at, delivery_id, ce_type, spec_version, text_data FROM ({_RANKED}) WHERE nth = 1",
    "p2_replayed": f"SELECT event_source, event_id, delivery_id FROM ({_RANKED}) WHERE nth = 1",
    "p5_found": _LAST
    + """
SELECT DISTINCT c.link_id, CAST(c._partition AS BIGINT) AS _partition, c._seq_no
FROM collection_rows c LEFT JOIN marks m ON c.link_id = m.link_id AND c._partition = m.part
WHERE c._seq_no IS NOT NULL AND (m.next_seq IS NULL OR c._seq_no >= m.next_seq)""",
    "p5_changed": _LAST
    + """
, newest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY link_id, _partition, _id ORDER BY _seq_no DESC) AS nth
  FROM collection_rows WHERE _seq_no IS NOT NULL AND _id IS NOT NULL) WHERE nth = 1)
SELECT c.link_id, CAST(c._partition AS BIGINT) AS _partition, c._id, c._seq_no, c.op_kind
FROM newest c LEFT JOIN marks m ON c.link_id = m.link_id AND c._partition = m.part
WHERE m.next_seq IS NULL OR c._seq_no >= m.next_seq""",
}
