"""The registered queries: each operator of the knowledge base applied to the driver's tables, with the same in SQL.

Customers stand for modules, orders for classes (or functions), lineitems for members, parts for functions with dotted
names, documents for source texts, pages for files with paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import buckets, graph, incremental, ranking, relational, search_index, storage
from .sources import definitions, files
from .streaming import events as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(column):
    return column.cast("bigint")


# Filters, joins, counts, orders.


@query("SELECT o_orderkey, o_orderpriority, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority ILIKE '%ur%' ORDER BY length(o_orderpriority), o_orderpriority, o_orderkey LIMIT 20")
def class_search(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relational.shortest_matches(joined, "o_orderpriority", "ur", ["o_orderkey"]).select("o_orderkey", "o_orderpriority", "c_name")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%00_1%' ORDER BY length(c_name), c_name, o_orderkey NULLS FIRST LIMIT 50")
def function_search(spark, sf):
    joined = table(spark, sf, "customer").where(relational.contains_word("c_name", "00_1")).join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.orderBy(F.length("c_name"), "c_name", "o_orderkey").limit(50).select("c_custkey", "c_name", "o_orderkey")


@query("SELECT c_name, o_orderkey, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment ILIKE '%build%' ORDER BY c_name, o_orderkey LIMIT 100")
def module_members(spark, sf):
    chosen = table(spark, sf, "customer").where(relational.contains_word("c_mktsegment", "build"))
    return chosen.join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).orderBy("c_name", "o_orderkey").limit(100).select("c_name", "o_orderkey", "o_orderstatus")


@query("SELECT 'class' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_name LIKE '%7' UNION ALL SELECT 'function', s_suppkey, s_name FROM supplier WHERE s_name LIKE '%7'")
def find_symbol(spark, sf):
    parts = {"class": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "function": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}
    return relational.tagged_union({k: df.where(F.endswith("name", F.lit("7"))) for k, df in parts.items()})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def project_filter_semi(spark, sf):
    project = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(project, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment ILIKE '%auto%'")
def null_rejecting_left_join(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where(relational.all_of(F.col("o_orderstatus") == "F", relational.contains_word("c_mktsegment", "auto"), None)).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
def module_level_only(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where(F.col("o_orderkey").isNull()).select("c_custkey", "c_name")


@query("SELECT (SELECT count(*) FROM nation) AS projects, (SELECT count(*) FROM customer) AS modules, (SELECT count(*) FROM orders) AS classes, (SELECT count(*) FROM lineitem) AS functions, (SELECT coalesce(CAST(sum(n_chars) AS BIGINT), 0) FROM documents) AS lines")
def overview_counts(spark, sf):
    one = table(spark, sf, "documents").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).cast("bigint").alias("lines"))
    for name, source in (("functions", "lineitem"), ("classes", "orders"), ("modules", "customer"), ("projects", "nation")):
        one = table(spark, sf, source).agg(F.count("*").alias(name)).crossJoin(one)  # one row each
    return one


@query("SELECT n_name, count(DISTINCT c_custkey) AS modules, count(o_orderkey) AS classes FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def project_summary(spark, sf):
    modules = relational.with_count(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "n")
    totals = modules.groupBy("c_nationkey").agg(F.count("*").alias("modules"), F.sum("n").alias("classes"))
    joined = table(spark, sf, "nation").join(totals, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", F.coalesce("modules", F.lit(0)).cast("bigint").alias("modules"), F.coalesce("classes", F.lit(0)).cast("bigint").alias("classes"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT o_custkey, count(*) AS o, sum(coalesce(n, 0)) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, CAST(coalesce(o, 0) + coalesce(n, 0) AS BIGINT) AS members FROM customer LEFT JOIN m ON o_custkey = c_custkey ORDER BY members DESC, c_custkey LIMIT 20")
def top_modules_by_members(spark, sf):
    orders = relational.with_count(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey", "n")
    totals = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(big(F.count("*") + F.sum("n")).alias("members"))
    joined = table(spark, sf, "customer").select("c_custkey").join(totals, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("members", F.lit(0)).cast("bigint").alias("members")).orderBy(F.desc("members"), "c_custkey").limit(20)


@query("SELECT o_orderkey, count(l_orderkey) AS members FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY members DESC, o_orderkey LIMIT 20 OFFSET 40")
def classes_paged(spark, sf):
    rows = relational.with_count(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey", "members")
    return relational.page(rows.select("o_orderkey", "members"), [F.desc("members"), F.col("o_orderkey")], 3, 20)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' ORDER BY length(p_name) DESC, p_partkey LIMIT 25 OFFSET 25")
def methods_paged(spark, sf):
    rows = table(spark, sf, "part").where(relational.contains_word("p_name", "a")).select("p_partkey", "p_name")
    return relational.page(rows, [F.desc(F.length("p_name")), F.col("p_partkey")], 2, 25)


@query("SELECT count(*) AS total, CAST((count(*) + 29) // 30 AS BIGINT) AS pages FROM part")
def page_totals(spark, sf):
    return relational.page_count(table(spark, sf, "part"), 30)


@query("SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def language_histogram(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("files"), big(F.sum("n_chars")).alias("chars"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, CAST(strlen(text) AS BIGINT) AS size, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def line_count_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.line_count(F.col("text")).alias("line_count"), big(F.octet_length("text")).alias("size"), T.token_estimate(F.col("text")).alias("tokens"))


@query("WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages), e AS (SELECT parts, unnest(range(1, len(parts))) AS i FROM p) SELECT array_to_string(parts[1:i], '/') AS prefix, i AS depth, count(*) AS files FROM e GROUP BY 1, 2")
def dir_rollup(spark, sf):
    parts = table(spark, sf, "pages").select(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/").alias("parts")).where(F.size("parts") > 1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.struct(F.array_join(F.slice("parts", 1, i), "/").alias("prefix"), big(i).alias("depth")))
    return parts.select(F.explode(prefixes).alias("x")).groupBy("x.prefix", "x.depth").agg(F.count("*").alias("files"))


@query("SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS top, count(*) AS files FROM pages GROUP BY 1")
def top_directories(spark, sf):
    return table(spark, sf, "pages").groupBy(F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(1)).alias("top")).agg(F.count("*").alias("files"))


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains([{STOP_SQL}], w)))) AS BIGINT) AS n_keywords FROM documents")
def keywords_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", big(F.size(T.keywords(F.col("text")))).alias("n_keywords"))


CONCEPT_SQL = " || ".join(f"CASE WHEN regexp_matches(low, '{'|'.join(words)}') THEN '{tag},' ELSE '' END" for tag, words in T.CONCEPTS.items())


@query(f"WITH d AS (SELECT doc_id, lower(source || ' ' || text) AS low, lower(source) AS n, lang FROM documents) SELECT doc_id, {CONCEPT_SQL} || CASE WHEN (lang = 'class' AND contains(n, 'exception')) OR contains(n, 'error') THEN 'exception,' ELSE '' END AS tags FROM d")
def concept_tags(spark, sf):
    tags = T.concept_tags(F.col("source"), F.col("text"), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(tags, lambda t: F.concat(t, F.lit(","))), "").alias("tags"))


@query("WITH o AS (SELECT l_orderkey, string_agg(l_shipmode || ' p' || l_partkey, ', ' ORDER BY l_partkey, l_linenumber, l_shipmode) AS a FROM (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'object' ELSE l_returnflag END AS l_shipmode FROM lineitem) GROUP BY 1) SELECT o_orderkey, o_orderstatus || ' void f' || o_orderkey || '(' || a || ')' AS signature FROM orders JOIN o ON l_orderkey = o_orderkey")
def signature_build(spark, sf):
    kind = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    item = F.struct("l_partkey", "l_linenumber", T.or_default(kind, "object").alias("type"), F.concat(F.lit("p"), F.col("l_partkey")).alias("name"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("args"))
    joined = table(spark, sf, "orders").join(lines, "o_orderkey")
    return joined.select("o_orderkey", T.function_signature(F.concat(F.lit("f"), F.col("o_orderkey")), F.col("args"), F.lit(""), F.array("o_orderstatus")).alias("signature"))


@query(r"SELECT doc_id, md5(source || ':' || doc_id) AS key, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{85}\p{Z}\x1c-\x1f\x0b]+', '', 'g'), '//.*?\n', '', 'g'), '/\*.*?\*/', '', 'g')) AS hash FROM documents")
def code_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.index_key(F.col("source"), F.col("doc_id").cast("string")).alias("key"), T.code_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, o.change FROM (SELECT doc_id, 'hash ' || CASE WHEN doc_id % 3 = 0 OR md5(text) = md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'x' END) THEN 'valid' ELSE 'stale' END AS change FROM documents) o")
def cache_valid(spark, sf):
    old = F.md5(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("x")).cast("binary"))
    good = incremental.valid(F.md5(F.col("text").cast("binary")), old, F.col("doc_id") % 3 == 0)
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("hash "), F.when(good, "valid").otherwise("stale")).alias("change"))


# Search.

QUESTION = ranking.Question.of("cold redWidget of the small rings", {"widget": ["gear", "bolt", "nut", "washer", "brass"], "small": ["small", "tiny", "economy"]})


def part_index(spark, sf):
    part = table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "function").otherwise("module")
    return part.select(
        "p_partkey", kind.alias("kind"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.col("p_brand").alias("path"), F.lit(0).alias("start_line"), F.col("p_size").alias("end_line"),
        F.col("p_type").alias("signature"), T.keywords(F.col("p_type")).alias("keywords"), T.concept_tags(F.col("p_name"), F.col("p_type"), kind).alias("tags"), (F.col("p_size") * 20).cast("bigint").alias("tokens"), F.col("p_partkey").alias("key"),
    )


def sql_list(words) -> str:
    return "CAST([" + ", ".join(f"'{w}'" for w in words) + "] AS VARCHAR[])"


Q, E = sql_list(QUESTION.words), sql_list(QUESTION.expanded)
TAGS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{'|'.join(words)}') THEN '{tag}' END" for tag, words in T.CONCEPTS.items()) + ", CASE WHEN (kind = 'class' AND contains(lower(p_name), 'exception')) OR contains(lower(p_name), 'error') THEN 'exception' END], lambda x: x IS NOT NULL)"
SCORE_SQL = f"""
WITH a AS (SELECT p_partkey, p_brand AS path, p_name, lower(replace(p_name, ' ', '.')) AS n, p_size, lower(p_name || ' ' || p_type) AS low, CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'module' END AS kind,
  list_distinct(list_filter(regexp_extract_all(lower(p_type), '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains([{STOP_SQL}], w))) AS k FROM part),
b AS (SELECT *, {TAGS_SQL} AS tags, split_part(n, '.', 1) AS owner FROM a),
c AS (SELECT *, 50 * len(list_filter({Q}, lambda w: w = n)) + CASE WHEN len(list_filter({Q}, lambda w: starts_with(n, w) AND length(w) >= 3)) > 0 THEN 30 ELSE 0 END AS exact,
  40 * len(list_filter({E}, lambda w: w = n)) + 25 * len(list_filter({E}, lambda w: w <> n AND starts_with(n, w) AND length(w) >= 3)) AS semantic,
  15 * len(list_filter({Q}, lambda w: contains(n, w) AND w <> n)) + 10 * len(list_filter({E}, lambda w: contains(n, w) AND w <> n)) +
  CASE WHEN NOT contains(n, '.') THEN 0 WHEN list_contains({Q}, owner) THEN 20 WHEN len(list_filter({Q}, lambda w: starts_with(owner, w) AND length(w) >= 3)) > 0 THEN 15 ELSE 0 END AS inside,
  12 * len(list_filter(tags, lambda t: list_contains({E}, t))) + 8 * len(list_filter(tags, lambda t: list_contains({Q}, t) AND NOT list_contains({E}, t))) AS concept,
  5 * len(list_filter(k, lambda w: list_contains({Q}, w))) + 3 * len(list_filter(k, lambda w: list_contains({E}, w))) AS signed FROM b),
d AS (SELECT *, CAST(exact > 0 AS INT) + CAST(semantic > 0 AS INT) + CAST(inside > 0 AS INT) + CAST(concept > 0 AS INT) AS kinds FROM c),
s AS (SELECT p_partkey, path, n, CAST(p_size * 20 AS BIGINT) AS tokens, CAST((exact + semantic + inside + concept + signed) * CASE kind WHEN 'class' THEN 2.0 WHEN 'function' THEN 1.5 ELSE 1.0 END * CASE WHEN kinds >= 3 THEN 2.0 WHEN kinds = 2 THEN 1.3 ELSE 1.0 END
  + CASE WHEN kind = 'class' AND p_size > 50 THEN 8 WHEN kind = 'function' AND p_size BETWEEN 15 AND 200 THEN 3 ELSE 0 END AS DOUBLE) AS score FROM d)
"""


@query(SCORE_SQL + "SELECT p_partkey, round(score, 6) AS score FROM s")
def rag_score(spark, sf):
    return ranking.scored(part_index(spark, sf), QUESTION).select("p_partkey", F.round("score", 6).alias("score"))


@query(SCORE_SQL + ", f AS (SELECT *, row_number() OVER (PARTITION BY path, n ORDER BY round(score, 6) DESC, p_partkey) AS r FROM s WHERE score > 0), g AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, p_partkey) AS rank, sum(tokens) OVER (ORDER BY round(score, 6) DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS spent FROM f WHERE r = 1) SELECT p_partkey, rank, CAST(spent AS BIGINT) AS spent FROM g WHERE rank <= 8 AND spent <= 3000")
def rag_search_budget(spark, sf):
    index = part_index(spark, sf).withColumn("name", F.lower("name"))
    return ranking.search(index, QUESTION).select("p_partkey", "rank", "spent")


WORDS = ["ring", "widget", "red", "blue", "small", "hot", "bolt"]


@query(f"WITH w AS (SELECT unnest({sql_list(WORDS)}) AS word UNION SELECT DISTINCT lower(left(n_name, 2)) FROM nation), r AS (SELECT word, p_partkey, row_number() OVER (PARTITION BY word ORDER BY p_partkey) AS r FROM part, w WHERE contains(lower(p_name), word)) SELECT word, p_partkey FROM r WHERE r <= 5")
def keyword_context(spark, sf):
    """For each word the first parts whose name holds it anywhere."""
    words = spark.createDataFrame([(w,) for w in WORDS], "word string").union(table(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 2)))).distinct()
    return search_index.name_index(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name").hits(words, ["p_partkey"]).select("word", "p_partkey")


@query(f"WITH t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS text FROM part), w AS (SELECT id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains([{STOP_SQL}], w)))) AS word FROM t), s AS (SELECT n_name AS key, lower(c_mktsegment) AS value FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT lower(left(p_type, 4)), lower(split_part(p_name, ' ', 1)) FROM part), k AS (SELECT id, key FROM t JOIN (SELECT DISTINCT key FROM s) ON contains(text, key) UNION SELECT id, key FROM w JOIN s ON value = word) SELECT DISTINCT k.id AS p_partkey, value AS concept FROM k JOIN s ON s.key = k.key")
def semantic_expand(spark, sf):
    """The concepts of each part's text: of keys that occur in it, and of keys one of whose values is a word of it."""
    part = table(spark, sf, "part")
    texts = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    segments = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"), F.lower("c_mktsegment").alias("value"))
    types = part.select(F.lower(F.substring("p_type", 1, 4)).alias("key"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("value"))
    return ranking.expanded_texts(texts, segments.unionByName(types).distinct()).withColumnRenamed("id", "p_partkey")


@query("WITH s AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT a.source, a.doc_id, CAST(b.n_chars AS BIGINT) AS second, b.n_chars IS NULL OR a.n_chars > 1.2 * b.n_chars AS clear FROM s a LEFT JOIN s b ON a.source = b.source AND b.r = 2 WHERE a.r = 1")
def score_gap(spark, sf):
    rows = relational.score_gap(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], "n_chars", 1.2)
    return rows.select("source", "doc_id", big(F.col("second")).alias("second"), "clear")


@query("WITH f AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 20000) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = d.source AND f.lang = d.lang)")
def forced_anti_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return relational.not_selected(docs, docs.where("n_chars > 20000"), ["source", "lang"]).select("doc_id")


# Graphs. Part names are functions: the brand is the module, the second word the simple name.

FUNCTIONS_SQL = "f AS (SELECT p_brand || ':' || replace(p_name, ' ', '.') || '.' || p_partkey % 40 AS id, min(p_partkey) AS pos FROM part GROUP BY 1), c AS (SELECT id AS caller, 'x.' || (pos * 7 % 53) AS callee FROM f)"


def part_functions(spark, sf):
    name = F.concat(F.col("p_brand"), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.col("p_partkey") % 40)
    return table(spark, sf, "part").groupBy(name.alias("id")).agg(F.min("p_partkey").alias("pos"))


def part_calls(functions):
    return functions.select(F.col("id").alias("caller"), F.concat(F.lit("x."), F.col("pos") * 7 % 53).alias("callee"))


EDGES_SQL = f"""
WITH {FUNCTIONS_SQL},
n AS (SELECT id, pos, split_part(id, ':', 1) AS module, string_split(id, '.')[-1] AS name FROM f),
p AS (SELECT DISTINCT c.caller AS src, string_split(callee, '.')[-1] AS name, split_part(caller, ':', 1) AS module FROM c),
j AS (SELECT p.src, n.id AS dst, n.module = p.module AS same, count(*) OVER (PARTITION BY p.src, p.name) AS total, bool_or(n.module = p.module) OVER (PARTITION BY p.src, p.name) AS local,
  row_number() OVER (PARTITION BY p.src, p.name, n.module = p.module ORDER BY n.pos, n.id) AS rs, row_number() OVER (PARTITION BY p.src, p.name ORDER BY n.pos, n.id) AS r FROM p JOIN n ON n.name = p.name),
e AS (SELECT DISTINCT src, dst FROM j WHERE total = 1 OR (local AND same AND rs = 1) OR (NOT local AND r <= 3))
"""


def part_edges(spark, sf):
    functions = part_functions(spark, sf)
    return graph.resolve_calls(part_calls(functions), functions)


@query(EDGES_SQL + "SELECT src, dst FROM e")
def call_resolution(spark, sf):
    return part_edges(spark, sf)


DEGREES_SQL = EDGES_SQL + ", d AS (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS n_in, (SELECT count(*) FROM e WHERE src = id) AS n_out FROM f)"


@query(DEGREES_SQL + "SELECT id, n_in, n_out FROM d")
def degrees(spark, sf):
    return graph.degrees(part_functions(spark, sf), part_edges(spark, sf))


@query(DEGREES_SQL + "SELECT id, n_out FROM d WHERE n_in = 0 ORDER BY n_out DESC, id LIMIT 50")
def entry_points(spark, sf):
    return graph.entry_points(graph.degrees(part_functions(spark, sf), part_edges(spark, sf))).limit(50).select("id", "n_out")


@query(DEGREES_SQL + "SELECT id, n_in FROM d ORDER BY n_in DESC, id LIMIT 20")
def core_modules(spark, sf):
    return graph.most_called(graph.degrees(part_functions(spark, sf), part_edges(spark, sf)), 20).select("id", "n_in")


@query(DEGREES_SQL + "SELECT id FROM d WHERE n_in = 0 AND n_out = 0")
def independent_modules(spark, sf):
    return graph.degrees(part_functions(spark, sf), part_edges(spark, sf)).where("n_in = 0 AND n_out = 0").select("id")


@query(EDGES_SQL + "SELECT split_part(src, ':', 1) AS src_module, split_part(dst, ':', 1) AS dst_module, count(*) AS n FROM e WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1) GROUP BY 1, 2")
def module_call_graph(spark, sf):
    return graph.module_graph(part_edges(spark, sf))


@query(EDGES_SQL + "SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def callers_callees(spark, sf):
    return graph.call_index(part_edges(spark, sf))


@query(EDGES_SQL + "SELECT src, dst FROM e WHERE contains(src, 'widget') OR contains(dst, 'widget') ORDER BY src, dst LIMIT 200")
def graph_view(spark, sf):
    return graph.graph_view(part_edges(spark, sf), "widget")


@query("WITH RECURSIVE " + EDGES_SQL.strip().removeprefix("WITH") + ", r(start, node, depth) AS (SELECT id, id, CAST(0 AS BIGINT) FROM f WHERE id LIKE 'Brand#2:%' UNION SELECT start, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3) SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2")
def call_chain(spark, sf):
    starts = part_functions(spark, sf).where(F.startswith("id", F.lit("Brand#2:"))).select("id")
    return graph.reachable(part_edges(spark, sf), starts, 3)


@query("WITH RECURSIVE " + EDGES_SQL.strip().removeprefix("WITH") + ", r(start, last, path, n) AS (SELECT src, dst, [src, dst], 2 FROM e WHERE dst > src UNION ALL SELECT start, dst, list_append(path, dst), n + 1 FROM r JOIN e ON src = last WHERE n < 3 AND dst > start AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, CAST(n AS BIGINT) AS length FROM r JOIN e ON src = last AND dst = start")
def cycles_bounded(spark, sf):
    return graph.cycles(part_edges(spark, sf), 3).select(F.array_join("path", ">").alias("path"), "length")


@query(None)
def call_chain_all(spark, sf):
    """Chains from every function, as deep as the reference's default; recursive SQL walks every path and is too slow."""
    return graph.reachable(part_edges(spark, sf), part_functions(spark, sf).select("id"), 10)


@query(None)
def cycles_all(spark, sf):
    """Cycles of up to 10 nodes, with the starts that may have longer ones: their number grows exponentially."""
    return graph.all_cycles(part_edges(spark, sf), 10).select(F.array_join("path", ">").alias("path"), "length", "truncated")


@query("WITH i AS (SELECT DISTINCT url AS path, unnest(regexp_extract_all(lower(html), 'href=\"/([a-z]{4,})\"', 1)) AS module FROM pages), m AS (SELECT DISTINCT url AS depends_on, replace(url, '/', '.') AS dotted FROM pages), n AS (SELECT DISTINCT module FROM i WHERE module <> ''), k AS (SELECT module, depends_on FROM n JOIN m ON contains(dotted, n.module) OR contains(n.module, dotted)) SELECT DISTINCT path, depends_on FROM i JOIN k USING (module)")
def module_dependencies(spark, sf):
    pages = table(spark, sf, "pages")
    imports = pages.select(F.col("url").alias("path"), F.explode(F.regexp_extract_all(F.lower("html"), F.lit('href="/([a-z]{4,})"'), F.lit(1))).alias("module"))
    return graph.module_dependencies(imports, pages.select(F.col("url").alias("path")))


# Incremental builds.


def cuts(spark, sf):
    """Two states of the orders: the cached one, and the present one with changed, new and missing rows."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", big(F.round(F.col("o_totalprice"))).alias("size"))
    old = orders.where("o_orderkey % 10 <> 1").withColumn("version", F.lit(1).cast("bigint"))
    new = orders.where("o_orderkey % 10 <> 2").withColumn("size", F.when(F.col("o_orderkey") % 10 == 3, F.col("size") + 1).otherwise(F.col("size"))).withColumn("version", F.lit(2).cast("bigint"))
    return old, new


@query("SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'new' WHEN 2 THEN 'gone' WHEN 3 THEN 'changed' ELSE 'same' END AS change FROM orders")
def incremental_diff(spark, sf):
    old, new = cuts(spark, sf)
    return incremental.changes(new, old, "o_orderkey", ["size", "o_orderstatus"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 3)")
def unchanged_skipped(spark, sf):
    old, new = cuts(spark, sf)
    return incremental.unchanged_skipped(new, old, "o_orderkey", ["size", "o_orderstatus"]).select("o_orderkey")


@query("SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS size, CAST(CASE WHEN o_orderkey % 10 = 2 THEN 1 ELSE 2 END AS BIGINT) AS version FROM orders")
def upsert_latest(spark, sf):
    old, new = cuts(spark, sf)
    return incremental.upsert(old, new, ["o_orderkey"], "version").select("o_orderkey", "size", "version")


@query("SELECT count(*) AS children, CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE l_linenumber END) AS BIGINT) AS kept, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS parents FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def replace_cascade(spark, sf):
    orders, lines = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    again = orders.where("o_orderkey % 7 = 0")
    new_lines = storage.dealt(lines, "o_orderkey").join(storage.dealt(again, "o_orderkey"), "o_orderkey", "left_semi").withColumn("l_linenumber", F.lit(0))
    parents, children = incremental.replaced(orders, lines, again, new_lines, "o_orderkey")
    joined = parents.join(children, "o_orderkey")
    return joined.agg(F.count("*").alias("children"), big(F.sum("l_linenumber")).alias("kept"), F.countDistinct("o_orderkey").alias("parents"))


@query("SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest, CAST(version AS BIGINT) AS version FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN coalesce(text, '') || chr(10) || '# changed' ELSE coalesce(text, '') END AS t, CASE WHEN doc_id % 50 = 7 THEN 2 ELSE 1 END AS version FROM documents WHERE (doc_id % 50 = 11) IS NOT TRUE)")
def bucketed_update(spark, sf):
    """Digests of all whole texts in a table of hash buckets, then brought up to date with changed and vanished documents."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    digests = lambda rows, version: rows.select("doc_id", big(F.length("t")).alias("n"), F.md5("t").alias("digest"), F.lit(version).cast("bigint").alias("version"))
    kept = buckets.BucketedTable(spark, storage.new_folder(spark, "digests"), "doc_id bigint, n bigint, digest string, version bigint", "doc_id")
    kept.replace(digests(docs, 1))
    changed = storage.stored(digests(docs.where("doc_id % 50 = 7").withColumn("t", F.concat("t", F.lit("\n# changed"))), 2), "changed")
    touched = changed.select("doc_id").unionByName(docs.where("doc_id % 50 = 11").select("doc_id"))
    kept.exchange(changed, touched, "doc_id", kept.touched(touched))
    return kept.read()


# Batches, windows, conversations.


@query("SELECT o_orderkey, lower(trim(o_orderpriority)) AS name FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) - min(l_linenumber) AS span FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE NOT (n <= 1 AND span < 5)")
def simple_function_filter(spark, sf):
    spans = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), (F.max("l_linenumber") - F.min("l_linenumber")).alias("span"))
    joined = table(spark, sf, "orders").join(spans, "o_orderkey")
    return joined.where(~relational.is_simple_function(F.col("o_orderpriority"), F.col("n"), F.col("span"))).select("o_orderkey", F.lower(F.trim("o_orderpriority")).alias("name"))


@query("WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, n FROM c ORDER BY n DESC, c_custkey LIMIT (SELECT greatest(5, CAST(floor(count(*) * 0.6) AS BIGINT)) FROM customer)")
def top_fraction(spark, sf):
    rows = relational.with_count(table(spark, sf, "customer").select("c_custkey"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "n")
    return relational.top_fraction(rows, [F.desc("n"), F.col("c_custkey")])


@query("SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5) AS BIGINT) AS batch FROM documents")
def batch_fixed(spark, sf):
    return relational.fixed_batches(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 5)


@query("WITH RECURSIVE o AS (SELECT source, doc_id, CAST(floor(n_chars / 4) AS BIGINT) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), r(source, doc_id, cost, i, batch, n, spent) AS (SELECT source, doc_id, cost, i, CAST(0 AS BIGINT), 1, cost FROM o WHERE i = 1 UNION ALL SELECT o.source, o.doc_id, o.cost, o.i, batch + CASE WHEN n >= 15 OR spent + o.cost > 4000 THEN 1 ELSE 0 END, CASE WHEN n >= 15 OR spent + o.cost > 4000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 15 OR spent + o.cost > 4000 THEN o.cost ELSE spent + o.cost END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1) SELECT source, doc_id, cost, batch FROM r")
def batch_greedy(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).cast("bigint").alias("cost"))
    return relational.greedy_batches(rows, ["source"], ["doc_id"], "cost", 15, 4000)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def chat_history_window(spark, sf):
    return relational.last_of_conversation(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT o_custkey, o_orderkey, o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS starts FROM orders")
def group_change(spark, sf):
    return relational.group_changes(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_custkey"], ["o_orderkey"]).drop("o_orderstatus")


@query("SELECT role, count(*) AS calls, CAST(sum(CAST(floor(length(text) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def token_totals(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("calls"), big(F.sum(T.token_estimate(F.col("text")))).alias("tokens"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", big(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT c_custkey, CASE WHEN coalesce(length(k), 0) = 0 THEN 'not configured' WHEN length(k) > 8 THEN left(k, 4) || repeat('*', length(k) - 8) || right(k, 4) ELSE '***' || right(k, 1) END AS masked FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 > 0 THEN left(c_name, CAST(c_custkey % 20 AS INT)) END AS k FROM customer)")
def key_masking(spark, sf):
    key = F.when(F.col("c_custkey") % 13 > 0, F.substr("c_name", F.lit(1), (F.col("c_custkey") % 20).cast("int")))
    return table(spark, sf, "customer").select("c_custkey", T.masked_key(key).alias("masked"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return stream.hourly(table(spark, sf, "events"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    return stream.sessions(table(spark, sf, "events"), "30 minutes")


@query("SELECT '| ' || lang || ' | ' || count(*) || ' | ' || CAST(sum(n_chars) AS BIGINT) || ' |' AS line FROM documents GROUP BY lang")
def report_overview(spark, sf):
    from .plans import reports

    totals = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    return reports.table_lines(totals, ["lang", "files", "chars"])


# Sources and scalar functions.


@query("SELECT doc_id, CAST(i AS BIGINT) AS line, string_split(text, chr(10))[i] AS code FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def source_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return files.numbered_lines(docs).select("doc_id", big(F.col("line")).alias("line"), "code")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS code FROM documents")
def source_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", files.sliced(F.col("text"), F.lit(2), F.lit(4)).alias("code"))


@query("SELECT page_id, CASE regexp_extract(lower(url), '(\\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.cs' THEN 'csharp' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' ELSE 'unknown' END AS language FROM pages")
def detect_language(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.language_of(F.col("url")).alias("language"))


@query("SELECT page_id, regexp_matches(url, '/(fr|blog[^/]*|de)/') AS in_dir, regexp_full_match(string_split(url, '/')[-1], '.*\\.html|7[0-9].*') AS by_name FROM pages")
def scan_exclusion(spark, sf):
    pages = table(spark, sf, "pages")
    name = F.substring_index("url", "/", -1)
    return pages.select("page_id", files.in_excluded_dir(F.col("url"), ["fr", "blog*", "de"]).alias("in_dir"), name.rlike(files.any_pattern(["*.html", "7[0-9]*"])).alias("by_name"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, '404') OR contains(lower(text), 'not found') THEN 'not_found' WHEN contains(text, '401') OR contains(lower(text), 'auth') THEN 'unauthorized' WHEN contains(text, '403') OR contains(lower(text), 'forbidden') THEN 'forbidden' WHEN contains(text, '500') OR contains(text, 'Internal Server Error') THEN 'server' WHEN contains(lower(text), 'timeout') THEN 'timeout' WHEN contains(text, 'JSON') OR contains(text, 'json') THEN 'format' WHEN contains(lower(text), 'rate_limit') OR contains(lower(text), 'rate limit') THEN 'rate_limit' ELSE 'other' END AS kind FROM conversations")
def error_classes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.error_class(F.col("text")).alias("kind"))


@query("SELECT doc_id, CASE WHEN floor(length(text) / 4) <= 200 THEN md5(text) WHEN len(l) > 50 THEN md5(array_to_string(l[1:30], chr(10)) || chr(10) || '... omitted ...' || chr(10) || array_to_string(l[len(l) - 19:], chr(10))) ELSE md5(array_to_string(l[1:30], chr(10))) END AS cut FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def truncated_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.truncated(F.col("text"), 200).cast("binary")).alias("cut"))


@query("SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), ' ') AS parts FROM customer")
def camel_split(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.array_join(T.camel_parts(F.col("c_name")), " ").alias("parts"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def lenient_json(spark, sf):
    """The bare text, a fenced block, the outermost braces, and an answer without any."""
    kind, props = F.col("event_id") % 4, F.col("props")
    answer = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("So:\n```json\n"), props, F.lit("\n```\n"))).when(kind == 2, F.concat(F.lit("Here it is: "), props, F.lit(" as asked."))).otherwise("none")
    return table(spark, sf, "events").select("event_id", big(T.lenient_json(answer)["k"]).alias("k"))


@query("SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(url, '/[^/]*$', '') AS parent, replace(url, '/', '.') AS dotted FROM pages")
def path_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.base_name(url).alias("base"), T.parent_dir(url).alias("parent"), T.dotted(url).alias("dotted"))


@query(EDGES_SQL + "SELECT '    ' || replace(split_part(src, ':', 2), '.', '_') || ' --> ' || replace(split_part(dst, ':', 2), '.', '_') AS line FROM e")
def mermaid_lines(spark, sf):
    edges = part_edges(spark, sf)
    return edges.select(F.concat(F.lit("    "), T.mermaid_id(F.col("src")), F.lit(" --> "), T.mermaid_id(F.col("dst"))).alias("line"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    rows = stream.windowed(table(spark, sf, "events"), "1 day")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH u AS (SELECT 'longest' AS kind, source, doc_id, 100 AS priority FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 10 UNION ALL SELECT 'latest', source, doc_id, 85 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 10) SELECT source, doc_id, arg_max(kind, priority) AS kind, CAST(max(priority) AS BIGINT) AS priority FROM u GROUP BY 1, 2")
def context_union(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    parts = {"longest": (100, [F.desc("n_chars"), F.col("doc_id")]), "latest": (85, [F.desc("doc_id")])}
    tagged = relational.tagged_union({k: relational.first_of_each(docs, ["source"], order, 10).withColumn("priority", big(F.lit(p))) for k, (p, order) in parts.items()})
    return relational.first_of_each(tagged, ["source", "doc_id"], [F.desc("priority")]).select("source", "doc_id", "kind", "priority")


def page_entities(spark, sf):
    """Pages as script files, read by the definition operators."""
    return definitions.entities(table(spark, sf, "pages").select(F.col("url").alias("relative_path"), F.lit("javascript").alias("language"), F.col("html").alias("text")))


@query("SELECT url AS relative_path, CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS BIGINT) AS line_count, CAST(strlen(html) AS BIGINT) AS size FROM pages")
def parsed_modules(spark, sf):
    return page_entities(spark, sf)["modules"].select("relative_path", big(F.col("line_count")).alias("line_count"), big(F.col("size")).alias("size"))


@query("""SELECT CAST(page_id AS VARCHAR) AS target_name, url AS path, CASE WHEN contains(url, 'https') THEN '{}' ELSE '{"summary":"' || md5('Explain ' || url) || '"}' END AS result, contains(url, 'https') AS from_cache FROM pages""")
def cached_analysis(spark, sf):
    """All pages analysed through the cache of the even ones; the deterministic completer answers."""
    from .plans import analysis

    pages = table(spark, sf, "pages")
    targets = pages.select(F.lit("module").alias("target_type"), F.col("page_id").cast("string").alias("target_name"), F.col("url").alias("path"), F.col("html").alias("code"), F.concat(F.lit("Explain "), "url").alias("prompt"))
    cache = pages.select(F.lit("module").alias("target_type"), F.col("page_id").cast("string").alias("target_name"), F.col("url").alias("path"), T.code_hash(F.when(F.contains("url", F.lit("https")), F.col("html")).otherwise(F.lit("old"))).alias("code_hash"), F.lit("{}").alias("result"), F.lit(False).alias("manually_corrected"), F.lit(None).cast("timestamp").alias("updated"))
    results, _ = analysis.analysed(targets, cache, analysis.deterministic)
    return results.select("target_name", "path", "result", "from_cache")
