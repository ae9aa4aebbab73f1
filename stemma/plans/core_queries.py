"""Queries of the core: hierarchies and table differences, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import diff, hierarchy
from stemma.session import table

DOC = ["accession_number", "sequence"]
NODE = [*DOC, "node_id"]


def p1_found(spark, d):
    return hierarchy.find_cycles(table(spark, d, "nodes"), DOC, "node_id", "parent_id")


def p1_hierarchy(spark, d):
    return hierarchy.hierarchy(table(spark, d, "nodes"), DOC, "node_id", "parent_id")


def p1_descendants(spark, d):
    return hierarchy.descendants(table(spark, d, "nodes"), DOC, "node_id", "parent_id")


def p1_depth_errors(spark, d):
    """Nodes whose stored depth isn't the true one."""
    n = table(spark, d, "nodes")
    h = hierarchy.hierarchy(n, DOC, "node_id", "parent_id", paths=False).where(F.col("depth").isNotNull())
    stored = n.select(*NODE, F.col("depth").cast("int").alias("stored_depth")).dropDuplicates()
    return h.join(stored, NODE).where(~F.col("depth").eqNullSafe(F.col("stored_depth"))).select(*NODE, "stored_depth", F.col("depth").alias("true_depth"))


def _differences(spark, d):
    fields = ["label_canon", "head_raw_start", "raw_end"]
    return diff.compare_tables(table(spark, d, "nodes"), table(spark, d, "nodes_rerun"), NODE, fields, "only_nodes", "only_nodes_rerun")


def p5_found(spark, d):
    return _differences(spark, d).select(*NODE, "difference")


def p5_values(spark, d):
    return _differences(spark, d)


def p5_summary(spark, d):
    return diff.difference_summary(_differences(spark, d))


def queries():
    return {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_depth_errors, p5_found, p5_values, p5_summary)}


_EDGES = """e AS (
  SELECT accession_number, sequence, node_id::BIGINT AS id, min(CASE WHEN parent_id <> -1 THEN parent_id END)::BIGINT AS p
  FROM nodes WHERE node_id IS NOT NULL GROUP BY 1, 2, 3)"""

_TREE = f"""WITH RECURSIVE {_EDGES},
reach AS (
  SELECT accession_number, sequence, id AS a, p AS here FROM e WHERE p IS NOT NULL
  UNION
  SELECT r.accession_number, r.sequence, r.a, e.p FROM reach r
  JOIN e ON e.accession_number = r.accession_number AND e.sequence = r.sequence AND e.id = r.here WHERE e.p IS NOT NULL),
cyc AS (SELECT DISTINCT accession_number, sequence, a AS id FROM reach WHERE a = here),
tops AS (
  SELECT e.*, CASE WHEN e.p IS NULL THEN 'tree' ELSE 'orphan' END AS status FROM e LEFT JOIN e x
  ON x.accession_number = e.accession_number AND x.sequence = e.sequence AND x.id = e.p WHERE x.id IS NULL),
down AS (
  SELECT accession_number, sequence, id, id AS root, 0 AS depth, id::VARCHAR AS path, [id] AS ids, status FROM tops
  UNION ALL
  SELECT e.accession_number, e.sequence, e.id, d.root, d.depth + 1, d.path || '/' || e.id, list_append(d.ids, e.id), d.status
  FROM down d JOIN e ON e.accession_number = d.accession_number AND e.sequence = d.sequence AND e.p = d.id),
pairs AS (
  SELECT accession_number, sequence, ids[k] AS up, id AS down, depth + 1 - k AS distance
  FROM (SELECT *, unnest(range(1, depth + 1)) AS k FROM down))"""

_DIFF = """WITH a AS (SELECT DISTINCT accession_number, sequence, node_id, label_canon, head_raw_start, raw_end FROM nodes),
b AS (SELECT DISTINCT accession_number, sequence, node_id, label_canon, head_raw_start, raw_end FROM nodes_rerun),
j AS (SELECT a.accession_number AS ka, b.accession_number AS kb, coalesce(a.accession_number, b.accession_number) AS accession_number,
  coalesce(a.sequence, b.sequence) AS sequence, coalesce(a.node_id, b.node_id) AS node_id, a.label_canon AS la, b.label_canon AS lb,
  a.head_raw_start AS ha, b.head_raw_start AS hb, a.raw_end AS ra, b.raw_end AS rb
  FROM a FULL JOIN b ON a.accession_number = b.accession_number AND a.sequence = b.sequence AND a.node_id = b.node_id),
d AS (
  SELECT accession_number, sequence, node_id, 'only_nodes' AS difference, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value FROM j WHERE kb IS NULL
  UNION ALL SELECT accession_number, sequence, node_id, 'only_nodes_rerun', NULL, NULL FROM j WHERE ka IS NULL
  UNION ALL SELECT accession_number, sequence, node_id, 'label_canon', la, lb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND la IS DISTINCT FROM lb
  UNION ALL SELECT accession_number, sequence, node_id, 'head_raw_start', ha::VARCHAR, hb::VARCHAR FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ha IS DISTINCT FROM hb
  UNION ALL SELECT accession_number, sequence, node_id, 'raw_end', ra::VARCHAR, rb::VARCHAR FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ra IS DISTINCT FROM rb)"""


def oracle_sql():
    return {
        "p1_found": f"{_TREE} SELECT accession_number, sequence, id::INTEGER AS node_id FROM cyc",
        "p1_hierarchy": f"""{_TREE}
SELECT e.accession_number, e.sequence, e.id::INTEGER AS node_id, d.root::INTEGER AS root_id, d.depth::INTEGER AS depth, d.path,
  CASE WHEN d.id IS NOT NULL THEN coalesce(k.n, 0) END::BIGINT AS n_descendants,
  CASE WHEN c.id IS NOT NULL THEN 'cycle' ELSE coalesce(d.status, 'below_cycle') END AS status
FROM e LEFT JOIN down d ON d.accession_number = e.accession_number AND d.sequence = e.sequence AND d.id = e.id
LEFT JOIN cyc c ON c.accession_number = e.accession_number AND c.sequence = e.sequence AND c.id = e.id
LEFT JOIN (SELECT accession_number, sequence, up, count(*) AS n FROM pairs GROUP BY 1, 2, 3) k
  ON k.accession_number = e.accession_number AND k.sequence = e.sequence AND k.up = e.id""",
        "p1_descendants": f"{_TREE} SELECT accession_number, sequence, up::INTEGER AS node_id, down::INTEGER AS descendant_id, distance::INTEGER AS distance FROM pairs",
        "p1_depth_errors": f"""{_TREE} SELECT d.accession_number, d.sequence, d.id::INTEGER AS node_id, n.depth::INTEGER AS stored_depth, d.depth::INTEGER AS true_depth
FROM down d JOIN (SELECT DISTINCT accession_number, sequence, node_id, depth FROM nodes) n
ON n.accession_number = d.accession_number AND n.sequence = d.sequence AND n.node_id = d.id WHERE n.depth IS DISTINCT FROM d.depth""",
        "p5_found": f"{_DIFF} SELECT accession_number, sequence, node_id, difference FROM d",
        "p5_values": f"{_DIFF} SELECT * FROM d",
        "p5_summary": f"{_DIFF} SELECT difference, count(*) AS n FROM d GROUP BY 1",
    }
