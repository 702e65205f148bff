"""Registered queries over strong components and reachability, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import components, graph, reachability
from .queries import EDGES_SQL, part_edges, part_functions, query

RECURSIVE = "WITH RECURSIVE " + EDGES_SQL.strip().removeprefix("WITH")
CLOSURE_SQL = ", v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(s, d) AS (SELECT id, id FROM v UNION SELECT s, dst FROM r JOIN e ON d = src), k AS (SELECT p.s AS node, min(p.d) AS component FROM r p JOIN r q ON p.s = q.d AND p.d = q.s GROUP BY 1)"


@query(RECURSIVE + CLOSURE_SQL + "SELECT node, component FROM k")
def call_components(spark, sf):
    return components.strong_components(part_edges(spark, sf))


@query(RECURSIVE + CLOSURE_SQL + ", z AS (SELECT component, count(*) AS size FROM k GROUP BY 1 HAVING count(*) > 1) SELECT component, node, size FROM k JOIN z USING (component)")
def circular_calls(spark, sf):
    """All functions on circles of calls."""
    return components.circular(components.strong_components(part_edges(spark, sf)))


@query(RECURSIVE + CLOSURE_SQL + "SELECT a.component AS src, b.component AS dst, count(*) AS n FROM e JOIN k a ON a.node = src JOIN k b ON b.node = dst WHERE a.component <> b.component GROUP BY 1, 2")
def condensed_calls(spark, sf):
    edges = part_edges(spark, sf)
    return components.condensed(edges, components.strong_components(edges))


@query(RECURSIVE + CLOSURE_SQL + ", mx AS (SELECT max(pos) AS n FROM f), pr AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM f a JOIN mx ON TRUE JOIN (SELECT DISTINCT id, pos FROM f UNION SELECT dst, pos FROM e JOIN f ON id = src) b ON b.pos = a.pos * 7 % mx.n OR b.pos = a.pos) SELECT pr.src, pr.dst, pr.src = pr.dst OR r.s IS NOT NULL AS reached FROM pr LEFT JOIN r ON r.s = pr.src AND r.d = pr.dst")
def call_reaches(spark, sf):
    """Whether each function reaches itself, those that it calls, and another one with what that calls."""
    functions, edges = part_functions(spark, sf).select("id", "pos"), part_edges(spark, sf)
    targets = functions.unionByName(edges.join(functions, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "pos")).distinct()
    number = functions.agg(F.max("pos")).first()[0] or 1
    asked = functions.select(F.col("id").alias("src"), F.explode(F.array("pos", F.col("pos") * 7 % number)).alias("pos"))
    pairs = asked.join(targets, "pos").select("src", F.col("id").alias("dst")).distinct()
    return reachability.reaches(pairs, reachability.labelled(edges))


MODULES_SQL = EDGES_SQL.strip().removeprefix("WITH") + """, m AS (SELECT DISTINCT split_part(id, ':', 1) AS id FROM f), x AS (SELECT DISTINCT split_part(src, ':', 1) AS s, split_part(dst, ':', 1) AS d FROM e WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1)),
g AS (SELECT id, (SELECT count(*) FROM x WHERE d = id) AS i, (SELECT count(*) FROM x WHERE s = id) AS o FROM m), r(s, d) AS (SELECT id, id FROM m UNION SELECT r.s, x.d FROM r JOIN x ON r.d = x.s), k AS (SELECT p.s AS node, min(p.d) AS component FROM r p JOIN r q ON p.s = q.d AND p.d = q.s GROUP BY 1),
z AS (SELECT component, count(*) AS size FROM k GROUP BY 1 HAVING count(*) > 1), o AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) AS place FROM z), h AS (SELECT place, node, row_number() OVER (PARTITION BY place ORDER BY node) AS r FROM k JOIN o USING (component)),
q AS (SELECT 'core' AS section, row_number() OVER (ORDER BY i DESC, id) AS place, id AS value FROM g WHERE i > 0 UNION ALL SELECT 'entry', row_number() OVER (ORDER BY o DESC, id), id FROM g WHERE o > 0 UNION ALL SELECT 'independent', row_number() OVER (ORDER BY id), id FROM g WHERE i = 0 AND o = 0 UNION ALL SELECT 'modules', 1, CAST(count(*) AS VARCHAR) FROM g
  UNION ALL SELECT 'dependencies', 1, CAST(count(*) AS VARCHAR) FROM x UNION ALL SELECT 'circular_groups', 1, CAST(count(*) AS VARCHAR) FROM z UNION ALL SELECT 'circular', place, string_agg(node, ' > ' ORDER BY node) FROM h WHERE r <= 20 GROUP BY place)
SELECT section, place, value FROM q WHERE place <= 10"""


@query("WITH RECURSIVE " + MODULES_SQL)
def architecture_whole(spark, sf):
    """The architecture of all modules, with their circular dependencies."""
    modules = part_functions(spark, sf).select(T.module_of(F.col("id")).alias("id")).distinct()
    edges = graph.module_graph(part_edges(spark, sf))
    return graph.architecture(modules, edges.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")), circular=True)
