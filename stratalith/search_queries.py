"""Registered queries over source trees, stored indexes and dictionaries, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import dictionary, ranking, search_index, storage
from .plans import analysis, answers
from .queries import CONCEPT_SQL, STOP_SQL, TAGS_SQL, part_index, query, table
from .sources import tree

TREE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 7 WHEN 0 THEN 'node_modules/p' || doc_id % 5 WHEN 1 THEN 'src/test' WHEN 2 THEN 'web/custom/path' ELSE 'src/m' || doc_id % 11 END AS dir,
  CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.txt' WHEN 3 THEN '.min.js' ELSE '.TS' END AS ending FROM documents),
f AS (SELECT coalesce(lang, 'none') || '/' || dir || '/d' || d.doc_id || ending AS path, coalesce(lang, 'none') AS top, dir, ending, d.text, octet_length(encode(d.text)) AS size FROM d JOIN documents USING (doc_id)),
k AS (SELECT 'file' AS kind, path, size, CASE WHEN dir = 'web/custom/path' THEN 'dir' WHEN ending IN ('.txt', '.min.js') THEN 'pattern' WHEN size > 5000 THEN 'size' END AS reason, text FROM f WHERE dir NOT LIKE 'node_modules%' AND dir <> 'src/test')
SELECT kind, path AS relative_path, CAST(size AS BIGINT) AS size, reason, CASE WHEN reason IS NULL THEN md5(text) END AS content FROM k
UNION ALL SELECT DISTINCT 'folder', top || '/' || CASE WHEN dir = 'src/test' THEN dir ELSE 'node_modules' END, NULL, 'dir', NULL FROM f WHERE dir LIKE 'node_modules%' OR dir = 'src/test'
"""


@query(TREE_SQL)
def source_tree(spark, sf):
    """All documents written out as files of a tree, which is then walked: excluded folders are one row, contents are read for
    what stays."""
    docs = table(spark, sf, "documents")
    part = lambda k: F.col("doc_id") % k
    folder = F.when(part(7) == 0, F.concat(F.lit("node_modules/p"), part(5))).when(part(7) == 1, "src/test").when(part(7) == 2, "web/custom/path").otherwise(F.concat(F.lit("src/m"), part(11)))
    ending = F.when(part(5) == 0, ".py").when(part(5) == 1, ".java").when(part(5) == 2, ".txt").when(part(5) == 3, ".min.js").otherwise(".TS")
    place = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), folder, F.lit("/d"), F.col("doc_id"), ending)
    root = storage.new_folder(spark, "tree")
    storage.stored(tree.write_tree(docs.select(place.alias("relative_path"), "text"), root), "written")
    rows = tree.walked(spark, root, ["node_modules", "test", "custom/path"], ["*.txt", "*.min.js"], 5000, content=True)
    return rows.select("kind", "relative_path", "size", "reason", F.md5("content").alias("content"))


LABELS = [(tag, words, False) for tag, words in T.CONCEPTS.items()]
# What marks a kind of failure, by rank; the patterns with case count as they stand.
FAILURES = [
    ("not_found", ["404"], True), ("not_found", ["not found"], False), ("unauthorized", ["401"], True), ("unauthorized", ["auth"], False), ("forbidden", ["403"], True), ("forbidden", ["forbidden"], False),
    ("server", ["500", "Internal Server Error"], True), ("timeout", ["timeout"], False), ("format", ["JSON", "json"], True), ("rate_limit", ["rate_limit", "rate limit"], False),
]


@query(f"""WITH d AS (SELECT doc_id, text, lower(coalesce(text, '')) AS low FROM documents)
SELECT doc_id, {CONCEPT_SQL} AS tags, CASE WHEN contains(text, '404') OR contains(low, 'not found') THEN 'not_found' WHEN contains(text, '401') OR contains(low, 'auth') THEN 'unauthorized' WHEN contains(text, '403') OR contains(low, 'forbidden') THEN 'forbidden' WHEN contains(text, '500') OR contains(text, 'Internal Server Error') THEN 'server' WHEN contains(low, 'timeout') THEN 'timeout' WHEN contains(text, 'JSON') OR contains(text, 'json') THEN 'format' WHEN contains(low, 'rate_limit') OR contains(low, 'rate limit') THEN 'rate_limit' ELSE 'other' END AS failure FROM d""")
def text_labels(spark, sf):
    """Concepts and kind of failure of each whole text, found in one pass over it."""
    rows = dictionary.labelled(table(spark, sf, "documents").select("doc_id", "text"), [*LABELS, *FAILURES])
    failures = F.array(*[F.lit(x) for x in dict.fromkeys(n for n, _, _ in FAILURES)])
    tags = F.filter("labels", lambda x: ~F.array_contains(failures, x))
    return rows.select("doc_id", F.array_join(F.transform(tags, lambda t: F.concat(t, F.lit(","))), "").alias("tags"), F.coalesce(F.get(F.array_intersect("labels", failures), F.lit(0)), F.lit("other")).alias("failure"))


@query("SELECT DISTINCT c.conv_id, c.turn, n.n_name FROM conversations c JOIN (SELECT DISTINCT n_name FROM (SELECT lower(left(n_name, 2)) AS n_name FROM nation UNION SELECT lower(split_part(p_name, ' ', 2)) FROM part UNION SELECT lower(regexp_extract(text, '^\\w+')) FROM benchmark) WHERE n_name <> '') n ON contains(lower(c.text), n.n_name)")
def dictionary_hits(spark, sf):
    """All keys of three tables that occur in each turn of a conversation."""
    keys = table(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("key")).union(table(spark, sf, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2)))))
    keys = keys.union(table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", r"^\w+", 0)))).where("key != ''")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("text"))
    return dictionary.found_in(turns, keys).withColumnRenamed("key", "n_name").distinct()


# A table of questions: every name and kind of a part, expanded by the names that share its last word.
ASKED_SQL = f"""
WITH t AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS qid, p_name FROM part),
x AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS key, split_part(p_name, ' ', 1) AS value FROM part),
g AS (SELECT DISTINCT qid, list_sort(list_distinct(list_filter(regexp_extract_all(qid, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains([{STOP_SQL}], w)))) AS q,
  list_sort(list_distinct((SELECT list(value) FROM x WHERE key = split_part(p_name, ' ', 2)) || [split_part(p_name, ' ', 2) || '.'])) AS e FROM t),
a AS (SELECT p_partkey AS key, p_brand || '/' || p_partkey AS path, p_name, lower(replace(p_name, ' ', '.')) AS n, p_size, lower(p_name || ' ' || p_type) AS low, CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'module' END AS kind,
  list_distinct(list_filter(regexp_extract_all(lower(p_type), '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains([{STOP_SQL}], w))) AS k FROM part),
b AS (SELECT *, {TAGS_SQL} AS tags, split_part(n, '.', 1) AS owner FROM a),
c AS (SELECT *, 50 * len(list_filter(q, lambda w: w = n)) + CASE WHEN len(list_filter(q, lambda w: starts_with(n, w) AND length(w) >= 3)) > 0 THEN 30 ELSE 0 END AS exact,
  40 * len(list_filter(e, lambda w: w = n)) + 25 * len(list_filter(e, lambda w: w <> n AND starts_with(n, w) AND length(w) >= 3)) AS semantic,
  15 * len(list_filter(q, lambda w: contains(n, w) AND w <> n)) + 10 * len(list_filter(e, lambda w: contains(n, w) AND w <> n)) +
  CASE WHEN NOT contains(n, '.') THEN 0 WHEN list_contains(q, owner) THEN 20 WHEN len(list_filter(q, lambda w: starts_with(owner, w) AND length(w) >= 3)) > 0 THEN 15 ELSE 0 END AS inside,
  12 * len(list_filter(tags, lambda t: list_contains(e, t))) + 8 * len(list_filter(tags, lambda t: list_contains(q, t) AND NOT list_contains(e, t))) AS concept,
  5 * len(list_filter(k, lambda w: list_contains(q, w))) + 3 * len(list_filter(k, lambda w: list_contains(e, w))) AS signed FROM b, g),
d AS (SELECT *, CAST(exact > 0 AS INT) + CAST(semantic > 0 AS INT) + CAST(inside > 0 AS INT) + CAST(concept > 0 AS INT) AS kinds FROM c),
s AS (SELECT qid, key, CAST(p_size * 20 AS BIGINT) AS tokens, CAST((exact + semantic + inside + concept + signed) * CASE kind WHEN 'class' THEN 2.0 WHEN 'function' THEN 1.5 ELSE 1.0 END * CASE WHEN kinds >= 3 THEN 2.0 WHEN kinds = 2 THEN 1.3 ELSE 1.0 END
  + CASE WHEN kind = 'class' AND p_size > 50 THEN 8 WHEN kind = 'function' AND p_size BETWEEN 15 AND 200 THEN 3 ELSE 0 END AS DOUBLE) AS score FROM d),
r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS spent FROM s WHERE score > 0 WINDOW w AS (PARTITION BY qid ORDER BY round(score, 6) DESC, key))
SELECT qid, key, round(score, 6) AS score, rank, CAST(spent AS BIGINT) AS spent FROM r WHERE rank <= 8 AND spent <= 3000
"""


@query(ASKED_SQL)
def index_search(spark, sf):
    """The best parts for each question of a table, from a stored index."""
    part = part_index(spark, sf)
    index = search_index.snippet_index(part.withColumn("path", F.concat_ws("/", "path", "p_partkey")))
    raw = table(spark, sf, "part").select("p_name", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("qid"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"))
    same = raw.groupBy("last").agg(F.array_sort(F.array_union(F.collect_set("first"), F.array(F.concat("last", F.lit("."))))).alias("expanded"))
    questions = raw.select("qid", "last").distinct().join(same, "last").select("qid", T.keywords(F.col("qid")).alias("words"), "expanded")
    return search_index.ask(index, questions).select("qid", "key", F.round("score", 6).alias("score"), "rank", "spent")


def scanned_search(index, questions: list[tuple[str, ranking.Question]], number: int = 8, budget: int = 3000) -> dict[str, list]:
    """The same question by question, by scoring each snippet: what tests compare with."""
    return {qid: [(r["key"], round(r["score"], 6)) for r in ranking.search(index, q, number, budget).orderBy("rank").collect()] for qid, q in questions}


@query("""SELECT page_id, '{"summary": "' || md5('Explain ' || html) || '"}' AS answer, n.asked, CAST(0 AS BIGINT) AS asked_again FROM pages, (SELECT count(DISTINCT html) AS asked FROM pages) n""")
def ledger_answers(spark, sf):
    """Each whole page explained once: the second request finds all answers in the table."""
    ledger = answers.Answers(spark, storage.new_folder(spark, "answers"))
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("Explain "), "html").alias("prompt"))
    first, again = ledger.ensure(pages, analysis.deterministic), ledger.ensure(pages, analysis.deterministic)
    rows = ledger.told(pages, "prompt", analysis.deterministic)
    return rows.select("page_id", "answer", F.lit(first["asked"]).cast("bigint").alias("asked"), F.lit(again["asked"]).cast("bigint").alias("asked_again"))
