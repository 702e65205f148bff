"""Queries of the parser: all documents as source files that hold their whole texts in comments and literals, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queries import big, query, table
from .sources import definitions

JAVA = '''/* {text} */
public class Doc{id}
    extends Base
{
    private String read(
        String key, // {
        List<Map<A, B>> more)
    {
        String s = "}" + '{';
        return load(key);
    }
}
'''
PYTHON = '''class Doc{id}(
    Base,
):
    """{text}"""
    def read(
        self,
        key="(, {",  # the key
    ) -> dict[str, int]:
        return load(
key)
'''


def written(docs: DataFrame) -> DataFrame:
    """relative_path, language, text: a Python file for each even doc_id, a Java file for each other one; marks that would end the
    comment or literal are replaced."""
    text = F.coalesce("text", F.lit(""))
    even = F.col("doc_id") % 2 == 0

    def filled(form: str, body) -> Column:
        head, rest = form.split("{text}") if form.index("{text}") < form.index("{id}") else form.split("{id}")
        second = "{id}" if "{id}" in rest else "{text}"
        middle, tail = rest.split(second)
        values = {"{id}": F.col("doc_id").cast("string"), "{text}": body}
        first = "{text}" if second == "{id}" else "{id}"
        return F.concat(F.lit(head), values[first], F.lit(middle), values[second], F.lit(tail))

    python, java = filled(PYTHON, F.replace(text, F.lit('"'), F.lit("'"))), filled(JAVA, F.replace(text, F.lit("*/"), F.lit("* /")))
    ending = F.when(even, ".py").otherwise(".java")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), ending).alias("relative_path"), F.when(even, "python").otherwise("java").alias("language"), F.when(even, python).otherwise(java).alias("text"))


@query("""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS even, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n FROM documents),
p AS (SELECT 'd' || doc_id || CASE WHEN even THEN '.py' ELSE '.java' END AS relative_path, 'Doc' || doc_id AS class_name, * FROM d)
SELECT relative_path, 'class' AS kind, class_name AS name, CAST(CASE WHEN even THEN 1 ELSE n + 2 END AS BIGINT) AS start_line, CAST(n + CASE WHEN even THEN 10 ELSE 12 END AS BIGINT) AS end_line, '' AS owner, 'Base' AS details, '' AS return_type, '' AS calls FROM p
UNION ALL SELECT relative_path, 'function', 'read', CAST(n + 5 AS BIGINT), CAST(n + CASE WHEN even THEN 10 ELSE 11 END AS BIGINT), class_name, CASE WHEN even THEN 'self|key="(, {"' ELSE 'String key|List<Map<A, B>> more' END, CASE WHEN even THEN 'dict[str, int]' ELSE 'String' END, 'load' FROM p""")
def parsed_members(spark, sf):
    """Classes and functions of all documents' files: spans, bases or parameters, and calls."""
    found = definitions.entities(written(table(spark, sf, "documents").select("doc_id", "text")))
    place = ["name", big(F.col("start_line")).alias("start_line"), big(F.col("end_line")).alias("end_line")]
    joined = lambda c: F.array_join(F.col(c), "|")
    classes = found["classes"].select("relative_path", F.lit("class").alias("kind"), *place, F.lit("").alias("owner"), joined("bases").alias("details"), F.lit("").alias("return_type"), F.lit("").alias("calls"))
    return classes.unionByName(found["functions"].select("relative_path", F.lit("function").alias("kind"), *place, F.coalesce("class_name", F.lit("")).alias("owner"), joined("parameters").alias("details"), F.coalesce("return_type", F.lit("")).alias("return_type"), joined("calls").alias("calls")))
