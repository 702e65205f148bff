"""Further registered queries: reports, prompts, summaries, lookups, class relations, small texts.

As in ``queries``: customers stand for modules, orders for classes, lineitems for their methods.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph, incremental, ranking, relational, search_index
from .plans import analysis, reports
from .queries import EDGES_SQL, big, part_edges, part_functions, query, table

SHOP = "regexp_replace(c_name, '[0-9]{3}$', '') || '/m' || c_custkey || '.py'"
SHOP_SQL = f"""
WITH mo AS (SELECT c_custkey, {SHOP} AS path, c_mktsegment AS language, CAST(floor(abs(c_acctbal)) AS BIGINT) AS line_count, CASE WHEN c_custkey % 3 = 0 THEN 'about ' || c_name ELSE '' END AS summary FROM customer),
cl AS (SELECT path, 'C' || o_orderkey AS name, o_orderkey AS start_line, o_orderkey + o_custkey % 90 AS end_line, CASE WHEN o_orderkey % 2 = 0 THEN ['C' || (o_custkey + 1), 'B' || o_orderstatus] ELSE CAST([] AS VARCHAR[]) END AS bases, o_orderkey FROM orders JOIN mo ON o_custkey = c_custkey),
fu AS (SELECT cl.path, CASE WHEN l_partkey % 4 > 0 THEN cl.name END AS class_name, 'f' || l_linenumber AS name, o_orderkey * 10 + l_linenumber AS start_line, o_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS end_line, ['a' || l_partkey, l_returnflag] AS parameters,
  CASE WHEN l_linestatus = 'F' THEN 'int' ELSE '' END AS return_type, CASE WHEN l_suppkey % 5 = 0 THEN 'does ' || l_partkey ELSE '' END AS summary, list_transform(range(0, l_partkey % 13), lambda i: 'g' || i) AS calls FROM lineitem JOIN cl ON l_orderkey = o_orderkey),
im AS (SELECT path, i + 1 AS line, 'lib.' || (c_custkey % 7 + i) AS module FROM mo, unnest(range(0, c_custkey % 4)) AS t(i))
"""


def shop(spark, sf):
    """The modules, classes, functions and imports of SHOP_SQL."""
    path = F.concat(F.regexp_replace("c_name", "[0-9]{3}$", ""), F.lit("/m"), F.col("c_custkey"), F.lit(".py"))
    modules = table(spark, sf, "customer").select(
        "c_custkey", path.alias("path"), F.col("c_mktsegment").alias("language"), big(F.floor(F.abs("c_acctbal"))).alias("line_count"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("about "), "c_name")).otherwise("").alias("summary"),
    )
    joined = table(spark, sf, "orders").join(modules.select("c_custkey", "path"), F.col("o_custkey") == F.col("c_custkey"))
    bases = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("C"), F.col("o_custkey") + 1), F.concat(F.lit("B"), "o_orderstatus"))).otherwise(F.array().cast("array<string>"))
    classes = joined.select("path", F.concat(F.lit("C"), "o_orderkey").alias("name"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + F.col("o_custkey") % 90).alias("end_line"), bases.alias("bases"), "o_orderkey")
    start = F.col("o_orderkey") * 10 + F.col("l_linenumber")
    calls = F.when(F.col("l_partkey") % 13 > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("l_partkey") % 13 - 1), lambda i: F.concat(F.lit("g"), i))).otherwise(F.array().cast("array<string>"))
    lines = table(spark, sf, "lineitem").join(classes.select("path", F.col("name").alias("owner"), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    functions = lines.select(
        "path", F.when(F.col("l_partkey") % 4 > 0, F.col("owner")).alias("class_name"), F.concat(F.lit("f"), "l_linenumber").alias("name"), start.alias("start_line"), (start + big(F.col("l_quantity"))).alias("end_line"),
        F.array(F.concat(F.lit("a"), "l_partkey"), "l_returnflag").alias("parameters"), F.when(F.col("l_linestatus") == "F", "int").otherwise("").alias("return_type"), F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("does "), "l_partkey")).otherwise("").alias("summary"), calls.alias("calls"),
    )
    some = modules.where("c_custkey % 4 > 0")
    imports = some.select("path", "c_custkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c_custkey") % 4 - 1)).alias("i"))
    imports = imports.select("path", (F.col("i") + 1).alias("line"), F.concat(F.lit("lib."), F.col("c_custkey") % 7 + F.col("i")).alias("module"))
    return {"modules": modules.drop("c_custkey"), "classes": classes.drop("o_orderkey"), "functions": functions, "imports": imports}


SIGN_SQL = "'`' || name || '(' || array_to_string(parameters, ', ') || ')`' || CASE WHEN return_type <> '' THEN ' -> `' || return_type || '`' ELSE '' END"


@query(SHOP_SQL + f"""SELECT path, part, CAST(place AS BIGINT) AS place, line FROM (
SELECT path, 0 AS part, 0 AS place, '### ' || path AS line FROM mo UNION ALL SELECT path, 1, 0, '> language: ' || language || ', lines: ' || line_count FROM mo UNION ALL SELECT path, 2, 0, summary FROM mo WHERE summary <> ''
UNION ALL SELECT path, 3, line, '- import `' || module || '`' FROM im UNION ALL SELECT path, 4, start_line, '#### ' || name || ' (lines ' || start_line || '-' || end_line || ')' || CASE WHEN len(bases) > 0 THEN ' extends ' || array_to_string(bases, ', ') ELSE '' END FROM cl
UNION ALL SELECT path, 4, start_line, '- ' || class_name || ': ' || {SIGN_SQL} FROM fu WHERE class_name IS NOT NULL UNION ALL SELECT path, 5, start_line, '#### ' || name || ' (lines ' || start_line || '-' || end_line || ')' FROM fu WHERE class_name IS NULL
UNION ALL SELECT path, 6, start_line, {SIGN_SQL} FROM fu WHERE class_name IS NULL UNION ALL SELECT path, 7, start_line, summary FROM fu WHERE class_name IS NULL AND summary <> ''
UNION ALL SELECT path, 8, start_line, 'calls: ' || array_to_string(calls[1:10], ', ') || CASE WHEN len(calls) > 10 THEN '...' ELSE '' END FROM fu WHERE class_name IS NULL AND len(calls) > 0)""")
def full_report(spark, sf):
    found = shop(spark, sf)
    return reports.full(found["modules"], found["imports"], found["classes"], found["functions"])


@query(SHOP_SQL + """, t AS (SELECT count(*) AS f, CAST(sum(line_count) AS BIGINT) AS l FROM mo), k AS (SELECT *, row_number() OVER (ORDER BY path) AS r FROM mo ORDER BY path LIMIT 10) SELECT CAST(place AS BIGINT) AS place, line FROM (
SELECT 0 AS place, '# shop' AS line UNION ALL SELECT 1, '- files: ' || f FROM t UNION ALL SELECT 2, '- lines: ' || l FROM t UNION ALL SELECT * FROM (VALUES (10, '## Architecture'), (11, 'not analysed'), (12, '## Business logic'), (13, 'a shop'), (14, '## Modules'))
UNION ALL SELECT 18 + 2 * r, '### ' || path FROM k UNION ALL SELECT 19 + 2 * r, CASE WHEN summary = '' THEN 'no summary' ELSE summary END FROM k)""")
def summary_report(spark, sf):
    return reports.summary("shop", shop(spark, sf)["modules"], business="a shop")


SIZED_SQL = ", c1 AS (SELECT path, count(*) AS n_classes FROM cl GROUP BY 1), f1 AS (SELECT path, count(*) AS n_functions FROM fu GROUP BY 1), si AS (SELECT mo.path, line_count, coalesce(n_classes, 0) AS n_classes, coalesce(n_functions, 0) AS n_functions, regexp_replace(mo.path, '/[^/]*$', '') AS parent, string_split(mo.path, '/')[-1] AS base FROM mo LEFT JOIN c1 ON c1.path = mo.path LEFT JOIN f1 ON f1.path = mo.path)"


def sized(found):
    rows = relational.with_count(found["modules"].select("path", "line_count"), "path", found["classes"], "path", "n_classes")
    return relational.with_count(rows, "path", found["functions"], "path", "n_functions")


@query(SHOP_SQL + SIZED_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY path) AS place FROM si), k AS (SELECT cl.path, name, row_number() OVER (PARTITION BY cl.path ORDER BY start_line, name) AS i FROM cl)
SELECT DISTINCT parent AS path, 0 AS part, CAST(0 AS BIGINT) AS place, '## ' || parent AS line FROM r UNION ALL SELECT parent, 1, place, '### ' || base || ': ' || line_count || ' lines, ' || n_classes || ' classes, ' || n_functions || ' functions' FROM r
UNION ALL SELECT parent, 1, place, '- `' || name || '`' FROM k JOIN r ON r.path = k.path WHERE i <= 20 UNION ALL SELECT parent, 1, place, '- and ' || (n_classes - 20) || ' more' FROM r WHERE n_classes > 20""")
def split_report(spark, sf):
    found = shop(spark, sf)
    return reports.by_directory(sized(found).drop("n_classes"), found["classes"])


@query(SHOP_SQL + SIZED_SQL + ", r AS (SELECT *, row_number() OVER (ORDER BY n_classes + n_functions DESC, path) AS place FROM si) SELECT place, '## ' || path || ': ' || n_classes || ' classes, ' || n_functions || ' functions' AS line FROM r WHERE place <= 50")
def core_modules_report(spark, sf):
    return reports.core_modules(sized(shop(spark, sf)))


@query("WITH p AS (SELECT string_split(url, '/') AS parts FROM pages), e AS (SELECT parts, unnest(range(1, least(len(parts) - 1, 4) + 1)) AS i FROM p WHERE len(parts) > 1), c AS (SELECT array_to_string(parts[1:i], '/') AS prefix, i, parts[i] AS name, count(*) AS n FROM e GROUP BY ALL) SELECT prefix, repeat('  ', CAST(i - 1 AS INT)) || '- **' || name || '/** (' || n || ' files)' AS line FROM c")
def directory_tree(spark, sf):
    return reports.tree(table(spark, sf, "pages").select(F.col("url").alias("path")))


METHODS_SQL = ", mc AS (SELECT cl.path, cl.name, count(fu.name) AS n_methods FROM cl LEFT JOIN fu ON fu.path = cl.path AND fu.class_name = cl.name GROUP BY 1, 2), ix AS (SELECT 'class' AS kind, row_number() OVER (ORDER BY n_methods DESC, name, path) AS place, name, n_methods AS n, path FROM mc UNION ALL SELECT 'function', row_number() OVER (ORDER BY end_line - start_line DESC, class_name || '.' || name, path), class_name || '.' || name, end_line - start_line, path FROM fu WHERE class_name IS NOT NULL), ie AS (SELECT * FROM ix WHERE place <= CASE kind WHEN 'class' THEN 20 ELSE 30 END)"


def shop_index(spark, sf):
    found = shop(spark, sf)
    counted = found["functions"].where("class_name IS NOT NULL").groupBy("path", F.col("class_name").alias("name")).agg(F.count("*").alias("n_methods"))
    classes = found["classes"].select("path", "name").join(counted, ["path", "name"], "left").na.fill(0)
    return reports.index_summary(classes, found["functions"])


@query(SHOP_SQL + METHODS_SQL + "SELECT kind, place, name, CAST(n AS BIGINT) AS n, path FROM ie")
def index_summary(spark, sf):
    return shop_index(spark, sf)


def shop_directories(spark, sf):
    return shop(spark, sf)["modules"].groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("name")).agg(F.count("*").alias("files"))


@query(SHOP_SQL + METHODS_SQL + ", d AS (SELECT split_part(path, '/', 1) AS name, count(*) AS files FROM mo GROUP BY 1) SELECT 'directories' AS section, row_number() OVER (ORDER BY name) AS place, '  ' || name || '/ (' || files || ' files)' AS line FROM (SELECT * FROM d ORDER BY name LIMIT 10) UNION ALL SELECT kind, place, '  ' || name || ' (' || n || CASE kind WHEN 'class' THEN ' methods) - ' ELSE ' lines) - ' END || path FROM ie WHERE place <= CASE kind WHEN 'class' THEN 15 ELSE 10 END")
def overview_text(spark, sf):
    return reports.overview_text(shop_directories(spark, sf), shop_index(spark, sf))


@query(SHOP_SQL + METHODS_SQL + """, d AS (SELECT split_part(path, '/', 1) AS name, count(*) AS files FROM mo GROUP BY 1)
SELECT '{"stats":{"files":' || (SELECT count(*) FROM mo) || ',"classes":' || (SELECT count(*) FROM cl) || ',"functions":' || (SELECT count(*) FROM fu) || '},"structure":{' || (SELECT string_agg('"' || name || '":' || files, ',' ORDER BY name) FROM d)
|| '},"top_classes":[' || (SELECT string_agg('{"name":"' || name || '","methods":' || n || ',"file":"' || path || '"}', ',' ORDER BY place) FROM ie WHERE kind = 'class') || '],"top_functions":[' || (SELECT string_agg('{"name":"' || name || '","lines":' || n || ',"file":"' || path || '"}', ',' ORDER BY place) FROM ie WHERE kind = 'function') || ']}' AS value""")
def project_overview(spark, sf):
    found = shop(spark, sf)
    totals = found["modules"].agg(F.count("*").alias("files")).crossJoin(found["classes"].agg(F.count("*").alias("classes"))).crossJoin(found["functions"].agg(F.count("*").alias("functions")))  # one row each
    return reports.project_overview(totals, shop_directories(spark, sf), shop_index(spark, sf))


# Graphs.


@query(EDGES_SQL + ", m AS (SELECT DISTINCT split_part(id, ':', 1) AS id FROM f), x AS (SELECT DISTINCT split_part(src, ':', 1) AS s, split_part(dst, ':', 1) AS d FROM e WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1) AND split_part(src, ':', 1) < 'Brand#4'), g AS (SELECT id, (SELECT count(*) FROM x WHERE d = id) AS i, (SELECT count(*) FROM x WHERE s = id) AS o FROM m), q AS (SELECT 'core' AS section, row_number() OVER (ORDER BY i DESC, id) AS place, id AS value FROM g WHERE i > 0 UNION ALL SELECT 'entry', row_number() OVER (ORDER BY o DESC, id), id FROM g WHERE o > 0 UNION ALL SELECT 'independent', row_number() OVER (ORDER BY id), id FROM g WHERE i = 0 AND o = 0 UNION ALL SELECT 'modules', 1, CAST(count(*) AS VARCHAR) FROM g UNION ALL SELECT 'dependencies', 1, CAST(count(*) AS VARCHAR) FROM x) SELECT section, place, value FROM q WHERE place <= 10")
def architecture(spark, sf):
    modules = part_functions(spark, sf).select(T.module_of(F.col("id")).alias("id")).distinct()
    edges = graph.module_graph(part_edges(spark, sf)).where("src_module < 'Brand#4'")
    return graph.architecture(modules, edges.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")))


@query(EDGES_SQL + ", v AS (SELECT src, dst FROM e WHERE contains(src, 'a') OR contains(dst, 'a') ORDER BY src, dst LIMIT 200) SELECT id FROM (SELECT src AS id FROM v UNION SELECT dst FROM v) ORDER BY id LIMIT 100")
def graph_view_nodes(spark, sf):
    return graph.view_nodes(graph.graph_view(part_edges(spark, sf), "a"))


@query("WITH i AS (SELECT DISTINCT url AS path, unnest(regexp_extract_all(lower(html), 'href=\"/([a-z]{4,})\"', 1)) AS module FROM pages), m AS (SELECT DISTINCT url AS depends_on, replace(url, '/', '.') AS dotted FROM pages), n AS (SELECT DISTINCT module FROM i WHERE module <> ''), k AS (SELECT module, depends_on FROM n JOIN m ON contains(dotted, n.module) OR contains(n.module, dotted)) SELECT DISTINCT depends_on AS path, path AS depended_by FROM i JOIN k USING (module)")
def depended_by(spark, sf):
    from .queries import module_dependencies

    return graph.depended_by(module_dependencies(spark, sf))


@query("WITH c AS (SELECT p_brand AS path, 'C' || p_partkey % 97 || '_' || p_partkey % 3 AS name, p_partkey AS pos, ['C' || p_size || '_1', 'C' || (p_partkey * 7 % 113) || '_0', 'X', 'C1_1'] AS bases FROM part), b AS (SELECT path, name, pos, i, bases[i + 1] AS other FROM c, unnest(range(0, 3)) AS t(i)), f AS (SELECT name AS other, path AS other_path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos, path) AS r FROM c) WHERE r = 1), u AS (SELECT DISTINCT name AS other, path AS other_path, pos, unnest(bases) AS name FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY name, other_path ORDER BY pos, other) AS r FROM u) SELECT path, name, 'base' AS relation, CAST(i AS BIGINT) AS place, other, other_path FROM b JOIN f USING (other) UNION ALL SELECT c.path, c.name, 'subclass', r - 1, s.other, s.other_path FROM s JOIN c ON c.name = s.name WHERE r <= 5")
def class_relations(spark, sf):
    key = F.col("p_partkey")
    name = F.concat(F.lit("C"), key % 97, F.lit("_"), key % 3)
    bases = F.array(F.concat(F.lit("C"), "p_size", F.lit("_1")), F.concat(F.lit("C"), key * 7 % 113, F.lit("_0")), F.lit("X"), F.lit("C1_1"))
    return analysis.class_relations(table(spark, sf, "part").select(F.col("p_brand").alias("path"), name.alias("name"), key.alias("pos"), bases.alias("bases")))


# Prompts and batches.


@query(SHOP_SQL + ", s AS (SELECT path, class_name AS name, count(*) AS n, array_to_string(list(name || '(' || array_to_string(parameters, ', ') || ')' ORDER BY start_line, name || '(' || array_to_string(parameters, ', ') || ')')[1:15], '; ') AS said FROM fu WHERE class_name IS NOT NULL GROUP BY 1, 2) SELECT cl.path, cl.name, md5('Explain this class in one sentence, as JSON with the key summary.' || chr(10) || cl.name || chr(10) || 'Methods: ' || coalesce(n, 0) || coalesce(chr(10) || said, '') || CASE WHEN len(bases) > 0 THEN chr(10) || 'Inherits: ' || array_to_string(bases, ', ') ELSE '' END) AS prompt FROM cl LEFT JOIN s ON s.path = cl.path AND s.name = cl.name")
def class_prompts(spark, sf):
    found = shop(spark, sf)
    methods = found["functions"].where("class_name IS NOT NULL").select("path", F.col("class_name").alias("owner"), F.col("start_line").alias("place"), "name", F.transform("parameters", lambda p: F.struct(p.alias("name"))).alias("parameters"))
    rows = analysis.class_prompts(found["classes"].select("path", F.col("name").alias("owner"), "name", "bases"), methods, ["path", "owner"])
    return rows.select("path", F.col("owner").alias("name"), F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query(SHOP_SQL + SIZED_SQL + ", p AS (SELECT path, 'classes' AS kind, start_line AS place, name FROM cl UNION ALL SELECT path, 'functions', start_line, name FROM fu WHERE class_name IS NULL UNION ALL SELECT path, 'imports', line, module FROM im), r AS (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY place, name) AS r, count(*) OVER (PARTITION BY path, kind) AS n FROM p), l AS (SELECT path, kind, any_value(n) AS n, string_agg(name, ', ' ORDER BY place, name) AS said FROM r WHERE r <= CASE kind WHEN 'classes' THEN 15 ELSE 10 END GROUP BY 1, 2), k AS (SELECT mo.path, kinds.kind, o, kinds.kind || ': ' || coalesce(n, 0) || coalesce(' - ' || said, '') AS line FROM mo CROSS JOIN (VALUES (1, 'classes'), (2, 'functions'), (3, 'imports')) kinds(o, kind) LEFT JOIN l ON l.path = mo.path AND l.kind = kinds.kind) SELECT path, md5('Explain this module in one sentence, as JSON with the key summary.' || chr(10) || path || chr(10) || string_agg(line, chr(10) ORDER BY o)) AS prompt FROM k GROUP BY path")
def module_prompts(spark, sf):
    found = shop(spark, sf)
    free = found["functions"].where("class_name IS NULL").withColumn("place", F.col("start_line"))
    rows = analysis.module_prompts(found["modules"], found["classes"].withColumn("place", F.col("start_line")), free, found["imports"].select("path", F.col("line").alias("place"), F.col("module").alias("name")))
    return rows.select("path", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query(SHOP_SQL + SIZED_SQL + "SELECT 'Describe the architecture of a project with these modules.' || chr(10) || string_agg('- ' || path || ': ' || n_classes || ' classes, ' || n_functions || ' functions', chr(10) ORDER BY path) AS prompt FROM (SELECT * FROM si ORDER BY path LIMIT 20)")
def architecture_prompt(spark, sf):
    return analysis.architecture_prompt(sized(shop(spark, sf)))


@query(SHOP_SQL + "SELECT 'Describe the business logic of a project with these modules.' || chr(10) || string_agg('## ' || path || chr(10) || summary, chr(10) ORDER BY path) AS prompt FROM (SELECT * FROM mo ORDER BY path LIMIT 15) WHERE summary <> ''")
def business_prompt(spark, sf):
    return analysis.business_prompt(shop(spark, sf)["modules"])


FIXED_SQL = "b AS (SELECT lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch FROM documents), s AS (SELECT lang, batch, count(*) AS n FROM b GROUP BY 1, 2)"


def language_batches(spark, sf):
    return relational.fixed_batches(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 8)


@query(f"WITH {FIXED_SQL} SELECT lang, CAST(sum(n) AS BIGINT) AS items, count(*) AS batches, avg(n) AS mean FROM s GROUP BY 1")
def batch_averages(spark, sf):
    return relational.batch_averages(language_batches(spark, sf), ["lang"])


@query(f"WITH {FIXED_SQL} SELECT lang, batch, CAST(sum(n) OVER (PARTITION BY lang ORDER BY batch) AS BIGINT) AS processed, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS total FROM s")
def batch_progress(spark, sf):
    return relational.progress(language_batches(spark, sf), ["lang"])


@query("SELECT doc_id, source || ' (simple)' AS summary FROM documents WHERE n_chars < 400 UNION ALL SELECT d.doc_id, coalesce('exact ' || e.doc_id, 'place ' || p.doc_id, 'key' || d.doc_id || ' (no summary)') FROM (SELECT *, doc_id // 10 AS batch FROM documents WHERE n_chars >= 400) d LEFT JOIN (SELECT *, doc_id // 10 AS batch FROM documents WHERE doc_id % 3 = 0) e ON e.batch = d.batch AND e.doc_id = d.doc_id LEFT JOIN (SELECT *, doc_id // 10 AS batch FROM documents WHERE doc_id % 4 = 1) p ON p.batch = d.batch AND p.doc_id % 10 = d.doc_id % 10")
def assigned_summaries(spark, sf):
    """Answers by exact key for every third row, by place for others, defaults for the rest, within batches of ten ids."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 10).alias("batch"))
    simple = docs.where("n_chars < 400").select("doc_id", F.concat("source", F.lit(" (simple)")).alias("summary"))
    key = F.concat(F.lit("key"), "doc_id")
    exact = docs.where("doc_id % 3 = 0").select("batch", key.alias("key"), F.concat(F.lit("exact "), "doc_id").alias("summary"), F.lit(-1).cast("bigint").alias("place"))
    placed = docs.where("doc_id % 4 = 1").select("batch", F.concat(F.lit("other"), "doc_id").alias("key"), F.concat(F.lit("place "), "doc_id").alias("summary"), (F.col("doc_id") % 10).alias("place"))
    rows = docs.where("n_chars >= 400").select("doc_id", "batch", key.alias("name"), (F.col("doc_id") % 10).alias("at"))
    return simple.unionByName(analysis.assigned(rows, exact.unionByName(placed), "name", "at", ["batch"]).select("doc_id", "summary"))


# Lookups and small texts.


@query("SELECT 'class' AS kind, c_custkey AS id FROM customer WHERE c_name = 'Customer#000000007' UNION ALL SELECT 'function', s_suppkey FROM supplier WHERE s_name = 'Supplier#000000007'")
def exact_symbol(spark, sf):
    parts = {"class": table(spark, sf, "customer").where(F.col("c_name") == "Customer#000000007").select(F.col("c_custkey").alias("id")), "function": table(spark, sf, "supplier").where(F.col("s_name") == "Supplier#000000007").select(F.col("s_suppkey").alias("id"))}
    return relational.tagged_union(parts)


@query("WITH w AS (SELECT DISTINCT replace(regexp_extract(url, '/(/[^/]+)+$'), '/', '\\') AS wanted FROM pages WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(url, '[a-z]+/[0-9]') FROM pages), p AS (SELECT wanted, replace(wanted, '\\', '/') AS plain FROM w) SELECT DISTINCT wanted, url FROM pages, p WHERE plain = '' OR contains(url, plain) OR string_split(url, '/')[-1] = string_split(plain, '/')[-1]")
def path_match(spark, sf):
    """The pages that hold a wanted path, have its file name, or whatever if it is empty."""
    pages = table(spark, sf, "pages")
    ends = pages.where("page_id % 3 = 0").select(F.translate(F.regexp_extract("url", "/(/[^/]+)+$", 0), "/", "\\").alias("wanted"))
    parts = pages.select(F.regexp_extract("url", "[a-z]+/[0-9]", 0).alias("wanted"))
    return search_index.paths_matching(pages.select(F.col("url").alias("path")), ends.union(parts)).withColumnRenamed("path", "url")


@query("SELECT url FROM pages ORDER BY url LIMIT 50")
def paths_first(spark, sf):
    return table(spark, sf, "pages").select("url").orderBy("url").limit(50)


@query("SELECT split_part(p_name, ' ', 1) AS word, arg_max(p_name, p_partkey) AS p_name, max(p_partkey) AS p_partkey, min(p_partkey) AS first FROM part GROUP BY 1")
def last_wins(spark, sf):
    rows = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), "p_name", "p_partkey")
    return relational.last_wins(rows, ["word"], "p_partkey")


@query("WITH t AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) SELECT n_nationkey, CASE WHEN n IS NULL THEN n_regionkey ELSE n END AS files, n_name FROM nation LEFT JOIN t ON c_nationkey = n_nationkey")
def stats_update(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", big(F.col("n_regionkey")).alias("files"), "n_name")
    found = table(spark, sf, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("files"))
    return relational.stated(rows, found, ["n_nationkey"], ["files"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 5 = 0")
def get_or_create(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return incremental.get_or_create(customer.where("id % 5 > 0"), customer.withColumn("name", F.lit("new")), "id")


@query("SELECT doc_id, CAST(floor(length(coalesce(text, '')) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS tokens, CAST(len(list_filter(regexp_split_to_array(trim(replace(text, chr(10), ' ')), ' +'), lambda w: length(w) > 1)) AS BIGINT) AS words FROM documents")
def rough_tokens(spark, sf):
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", T.rough_tokens(F.col("text")).alias("tokens"), big(F.size(T.question_words(text))).alias("words"))


@query("SELECT p_partkey, rpad(left(p_name, 12), 12, ' ') || '|' AS shown, p_name AS doc, '[' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: '\"' || w || '\"'), ',') || ']' AS words FROM part")
def displayed(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.concat(T.display(name, 12), F.lit("|")).alias("shown"), T.docstring(F.concat(F.lit('r"""'), name, F.lit('"""'))).alias("doc"), T.json_text(F.split(name, " ")).alias("words"))


@query("WITH p AS (SELECT p_partkey, p_brand AS path, split_part(p_name, ' ', 1) AS name, p_type AS signature, p_size FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY p_partkey DESC) AS r FROM p) SELECT md5(path || ':' || name) AS key, p_partkey AS pos, CAST(floor(length(signature) / 4) AS BIGINT) AS tokens FROM r WHERE r = 1")
def index_build(spark, sf):
    rows = table(spark, sf, "part").select(F.lit("function").alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.col("p_brand").alias("path"), F.lit(0).alias("start_line"), F.col("p_size").alias("end_line"), F.col("p_type").alias("signature"), F.col("p_partkey").alias("pos"))
    return ranking.build_index(rows).select("key", "pos", "tokens")
