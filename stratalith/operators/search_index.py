"""A stored index for searching with whole tables of questions.

Names: the distinct names in lower case, each with its grams of one to three characters. A word finds the names that hold it through
its rarest gram, then by looking (a word of up to three characters is a gram itself). No name is compared with all words.

Snippets that no question can tell apart (same name, weight, bonus, concepts and signature words) have equal scores, so that of each such
group the index holds the first ``most`` by key: no question for up to ``most`` snippets can choose another one.

Snippets: by name, and as postings of concepts and signature words. A posting list is cut into blocks by falling impact (the
weight and the size bonus of a snippet), with the greatest of each block beside it. The best ``number`` snippets of a question are
found in three steps, each only as far as its bound allows:
1. Names that hold a word are rated. A name's snippets can earn at most what it, all the question's other words, the greatest
   weight and the greatest bonus give; names whose bound is below the sure points of the ``number``-th best name are left out, the snippets of the others are scored wholly.
2. Snippets without such a name earn at most what all the question's concepts and words give; blocks whose bound is below the
   ``number``-th score so far are never opened. What is opened adds up to exact scores from the postings alone.
3. Snippets that match nothing have their size bonus only; where that can still count, they come from a list in its order.
The result equals scoring each snippet for each question (``ranking.search``).

Defined results: a null name or text is no word's; words are compared in lower case; empty words find nothing; a question without words
gets what its bonus list gives; an empty index or an empty table of questions gives an empty result. Snippets are unique by path and
name, as ``ranking.build_index`` leaves them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import name_points, score_of, size_bonus, weight_of
from .relational import first_of_each, within_budget
from .storage import dealt, globally_ranked, new_folder, stored

#: Snippets of a block of postings.
BLOCK = 128
#: Snippets that a question may ask for, unless the index is built for more.
MOST = 16
#: The greatest weight and size bonus of a snippet.
MOST_WEIGHT, MOST_BONUS = 2.0, 8.0


def grams(text: Column) -> Column:
    """The distinct runs of one, two and three characters."""

    def runs(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, F.lit(k)))
        return F.when(F.length(text) >= k, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def probes(words: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(word, gram) of the distinct words that can be in some name: the rarest of a word's grams of three characters, or the word."""
    all_grams = F.when(F.length("word") <= 3, F.array("word")).otherwise(F.filter(grams(F.col("word")), lambda g: F.length(g) == 3))
    asked = words.where("word != ''").select("word").distinct().select("word", F.explode(all_grams).alias("gram"))
    met = asked.join(frequencies, "gram", "left")
    return met.groupBy("word").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("least")).where("least.names > 0").select("word", F.col("least.gram").alias("gram"))


def names_holding(words: DataFrame, names: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(word, name): every name that holds a word, of tables (word), (gram, name) and (gram, names)."""
    return probes(words, frequencies).join(names, "gram").where(F.contains("name", F.col("word"))).select("word", "name")


@dataclass(frozen=True)
class NameIndex:
    """The stored tables of an index of names: ``names`` (gram, name), ``frequencies`` (gram, names), ``rows`` (name, and columns)."""

    spark: SparkSession
    root: str

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def holding(self, words: DataFrame) -> DataFrame:
        return names_holding(words, self.read("names"), self.read("frequencies"))

    def hits(self, words: DataFrame, order: list[str], number: int = 5) -> DataFrame:
        """For each word its first ``number`` rows, by ``order``, whose name holds it. A name brings its first rows only."""
        first = first_of_each(self.read("rows"), ["name"], [F.col(c) for c in order], number)
        asked = words.select(F.lower("word").alias("word")).distinct()
        return first_of_each(self.holding(asked).join(first, "name"), ["word"], [F.col(c) for c in order], number)


def name_index(rows: DataFrame, name: str, root: str | None = None) -> NameIndex:
    """Write the index of ``rows`` by the column ``name``: sorted by gram or name, so that readers skip row groups by them."""
    spark = rows.sparkSession
    index = NameIndex(spark, root or new_folder(spark, "name-index"))
    named = rows.withColumn("__name", F.lower(F.col(name).cast("string"))).where("__name IS NOT NULL")
    kept = named.drop("name").withColumnRenamed("__name", "name") if name != "name" else named.withColumn("name", F.col("__name")).drop("__name")
    kept.repartitionByRange("name").sortWithinPartitions("name").write.parquet(f"{index.root}/rows")
    own = index.read("rows").select("name").distinct().select(F.explode(grams(F.col("name"))).alias("gram"), "name")
    own.repartitionByRange("gram", "name").sortWithinPartitions("gram", "name").write.parquet(f"{index.root}/names")
    index.read("names").groupBy("gram").agg(F.count("*").alias("names")).write.parquet(f"{index.root}/frequencies")
    return index


@dataclass(frozen=True)
class SnippetIndex:
    """The stored tables of an index of snippets: ``by_name``, ``postings``, ``vocabulary``, ``by_bonus`` and an index of names. Questions
    may ask for up to ``most`` snippets."""

    spark: SparkSession
    root: str
    names: NameIndex
    most: int = MOST

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")


def snippet_index(index: DataFrame, root: str | None = None, most: int = MOST) -> SnippetIndex:
    """Write the index of snippets (key, path, name, kind, start_line, end_line, keywords, tags, tokens), for questions for up to
    ``most`` of them."""
    spark = index.sparkSession
    root = root or new_folder(spark, "snippet-index")
    span = F.col("end_line") - F.col("start_line")
    rows = index.select("key", "path", "name", F.lower("name").alias("low"), "kind", span.alias("span"), "keywords", "tags", "tokens")
    rows = rows.withColumns({"boost": weight_of(F.col("kind")).cast("double"), "bonus": size_bonus(F.col("kind"), F.col("span")).cast("double")})
    same = Window.partitionBy("low", "boost", "bonus", "keywords", "tags").orderBy("key")
    rows = rows.withColumn("among", F.row_number().over(same)).where(F.col("among") <= most)
    rows.repartitionByRange("low", "key").sortWithinPartitions("low", "key").write.parquet(f"{root}/by_name")
    found = SnippetIndex(spark, root, name_index(spark.read.parquet(f"{root}/by_name").select("low").distinct(), "low", f"{root}/names"), most)
    rows = found.read("by_name")
    entry = F.struct("boost", "bonus", "key", "path", "name", "tokens", "among")
    terms = rows.select(F.explode(F.array(F.struct(F.lit("tag").alias("field"), F.col("tags").alias("terms")), F.struct(F.lit("keyword").alias("field"), F.col("keywords").alias("terms")))).alias("of"), entry.alias("entry"))
    terms = terms.select("of.field", F.explode(F.array_distinct("of.terms")).alias("term"), "entry")
    # Ranges hold a list in order of impact, so that blocks are cut without gathering a list.
    order = [F.col("field"), F.col("term"), F.desc("entry.boost"), F.desc("entry.bonus"), F.col("entry.key")]
    ordered = stored(terms.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    blocks = ordered.groupBy("field", "term", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.max("entry.boost").alias("top_boost"), F.max("entry.bonus").alias("top_bonus"), F.collect_list("entry").alias("entries"))
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{root}/postings")
    found.read("postings").groupBy("field", "term").agg(F.sum(F.size("entries")).alias("snippets")).write.parquet(f"{root}/vocabulary")
    sized = rows.where("bonus > 0").select("bonus", "key", "path", "name", "tokens")
    globally_ranked(sized, [F.desc("bonus"), F.col("key")]).withColumnRenamed("rank", "place").sortWithinPartitions("place").write.parquet(f"{root}/by_bonus")
    return found


def kth(rows: DataFrame, value: str, number: int, out: str) -> DataFrame:
    """(qid, out): the ``number``-th largest value of each question that has so many."""
    ranked = first_of_each(rows, ["qid"], [F.desc(value)], number)
    return ranked.groupBy("qid").agg(F.count("*").alias("n"), F.min(value).alias(out)).where(F.col("n") == number).select("qid", out)


def ask(index: SnippetIndex, questions: DataFrame, number: int = 8, budget: int = 3000) -> DataFrame:
    """qid, key, path, name, tokens, score, rank, spent: the best snippets of each question (qid, words, expanded), up to the first that
    overflows its budget."""
    if number > index.most:
        raise ValueError(f"the index was built for questions for up to {index.most} snippets; build it with most={number}")
    some = lambda column: F.filter(F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))), lambda w: w != "").alias(column)
    asked = stored(questions.select("qid", some("words"), some("expanded")).toDF("qid", "q", "e"), "questions")
    words = asked.select("qid", "q", "e", F.explode(F.array_union("q", "e")).alias("word"))
    # What a question's concepts and signature words can give at most.
    of_word = words.join(index.read("vocabulary").select("field", F.col("term").alias("word")), "word")
    in_q, in_e = F.array_contains("q", F.col("word")), F.array_contains("e", F.col("word"))
    points = F.when(F.col("field") == "tag", F.when(in_e, 12).when(in_q, 8).otherwise(0)).otherwise(F.when(in_q, 5).otherwise(0) + F.when(in_e, 3).otherwise(0))
    worth = of_word.select("qid", "field", F.col("word").alias("term"), points.alias("points"))
    bounds = stored(worth.groupBy("qid").agg(F.sum("points").alias("most"), F.max(F.when(F.col("field") == "tag", 1).otherwise(0)).alias("tagged")), "bounds")
    # 1. Names.
    held = words.join(index.names.holding(words.select("word").distinct()), "word").select("qid", "name").distinct().join(asked, "qid")
    earned = name_points(F.col("q"), F.col("e"), F.col("name"))
    kinds = sum((F.when(x > 0, 1).otherwise(0) for x in earned), F.lit(0))
    rated = stored(held.select("qid", "q", "e", "name", sum(earned, F.lit(0)).alias("points"), kinds.alias("kinds")).where("points > 0"), "rated")
    several = lambda k: F.when(k >= 3, 2.0).when(k == 2, 1.3).otherwise(1.0)
    sure = kth(rated.withColumn("least", F.col("points") * several(F.col("kinds"))), "least", number, "sure")
    most = (F.col("points") + F.coalesce("most", F.lit(0))) * several(F.col("kinds") + F.coalesce("tagged", F.lit(0))) * MOST_WEIGHT + MOST_BONUS
    close = rated.join(sure, "qid", "left").join(bounds, "qid", "left").where(most >= F.coalesce("sure", F.lit(0)))
    value = score_of(F.col("q"), F.col("e"), F.col("kind"), F.col("low"), F.col("keywords"), F.col("tags"), F.col("span"))
    columns = ["qid", "key", "path", "name", "tokens", "score"]
    named = dealt(close.withColumnRenamed("name", "low"), "qid", "low").join(index.read("by_name").where(F.col("among") <= number), "low").withColumn("score", value.cast("double")).select(*columns)
    named = stored(named, "named")
    # 2. Concepts and signature words.
    least = kth(named, "score", number, "least")
    opened = worth.join(bounds, "qid").join(least, "qid", "left").join(index.read("postings"), ["field", "term"]).where(F.col("most") * F.col("top_boost") + F.col("top_bonus") >= F.coalesce("least", F.lit(0)))
    entries = opened.select("qid", "points", F.explode(F.filter("entries", lambda x: x["among"] <= number)).alias("x")).groupBy("qid", F.col("x.key").alias("key")).agg(F.sum("points").alias("points"), F.first("x").alias("x"))
    scored = entries.select("qid", "key", "x.path", "x.name", "x.tokens", (F.col("points") * F.col("x.boost") + F.col("x.bonus")).cast("double").alias("score"))
    # A snippet of step 1 may be met again by its words; a name that holds a word is left to step 1, be it near enough or not.
    wordy = scored.withColumn("low", F.lower("name")).join(rated.select("qid", F.col("name").alias("low")), ["qid", "low"], "left_anti")
    matched = stored(named.unionByName(wordy.select(*columns)).where("score > 0"), "matched")
    # 3. Size bonuses. Where they still count, fewer than ``number`` names were found, so that no block was left closed above.
    least = kth(matched, "score", number, "least")
    open_ = asked.select("qid").join(matched.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").join(least, "qid", "left").where(F.coalesce("least", F.lit(0)) <= MOST_BONUS)
    places = open_.select("qid", F.explode(F.sequence(F.lit(1).cast("bigint"), number + F.coalesce("n", F.lit(0)))).alias("place"))
    sized = places.join(index.read("by_bonus"), "place").join(matched.select("qid", "key"), ["qid", "key"], "left_anti")
    matched = matched.unionByName(sized.select("qid", "key", "path", "name", "tokens", F.col("bonus").alias("score")))
    top = first_of_each(matched, ["qid"], [F.desc("score"), F.col("key")], number)
    return within_budget(top, ["qid"], [F.desc("score"), F.col("key")], "tokens", budget, number)


def paths_matching(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, path): the distinct paths that each wanted one matches: they hold it (in any separators), have its file name, or it is
    empty."""
    rows = paths.select("path").where("path IS NOT NULL").distinct()
    asked = wanted.select("wanted").distinct().withColumn("plain", F.translate("wanted", "\\", "/"))
    base = lambda c: F.substring_index(F.translate(c, "\\", "/"), "/", -1)
    index = name_index(rows.withColumn("low", F.lower("path")), "low")
    held = asked.withColumn("word", F.lower("plain")).join(index.holding(asked.select(F.lower("plain").alias("word"))), "word")
    held = held.join(index.read("rows"), "name").where(F.contains("path", F.col("plain"))).select("wanted", "path")
    same = asked.where("plain != ''").withColumn("base", base(F.col("wanted"))).join(rows.withColumn("base", base(F.col("path"))), "base").select("wanted", "path")
    nothing = [r["wanted"] for r in asked.where("plain IS NULL OR plain = ''").select("wanted").collect()]  # null and empty, at most
    every = rows.select(F.explode(F.array(*map(F.lit, nothing)).cast("array<string>")).alias("wanted"), "path")
    return held.unionByName(same).unionByName(every).distinct()
