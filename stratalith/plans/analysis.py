"""Explanations by a language model that callers plug in: prompts, batches, answers, cache.

Nothing here calls a service. A ``Completer`` is any picklable function from prompts to answers; ``deterministic`` is one
for tests. Completion runs in Spark tasks over batches of rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import incremental, relational, storage
from .answers import Answers

Completer = Callable[[list[str]], list[str]]


def deterministic(prompts: list[str]) -> list[str]:
    """Answers that follow from the prompts."""
    return [json.dumps({"summary": hashlib.md5(p.encode()).hexdigest()}) for p in prompts]


def completed(rows: DataFrame, prompt: str, completer: Completer, answers: Answers | None = None) -> DataFrame:
    """Rows with ``answer``; a failing batch answers with empty texts. The answers are stored here, so that later actions on the
    result ask nothing; with a table of ``answers`` no prompt is asked again in later runs either."""
    if answers is not None:
        return answers.told(rows, prompt, completer)
    schema = StructType([*rows.schema.fields, StructField("answer", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answers = completer(pdf[prompt].tolist())
            except Exception:
                answers = [""] * len(pdf)
            yield pdf.assign(answer=answers)

    return storage.stored(rows.mapInPandas(run, schema), "answers")


def function_prompts(functions: DataFrame, most_tokens: int = 2000) -> DataFrame:
    """Functions worth explaining with ``prompt``; the simple ones keep a canned summary."""
    span = F.col("end_line") - F.col("start_line")
    simple = relational.is_simple_function(F.col("name"), F.size("parameters"), span)
    body = T.truncated(F.coalesce("content", F.lit("")), most_tokens)
    prompt = F.concat_ws("\n", F.lit("Explain this function in one sentence, as JSON with the key summary."), F.col("name"), body)
    return functions.withColumn("simple", simple).withColumn("summary", F.when(simple, F.concat("name", F.lit(" (simple)"))).otherwise(F.col("summary"))).withColumn("prompt", F.when(~simple, prompt))


def batch_prompts(rows: DataFrame, keys: list[str], order: list[str], text: str, most: int = 15, budget: int = 4000) -> DataFrame:
    """(keys, batch, prompt, names): one prompt for each greedy batch of the rows' texts."""
    costed = rows.withColumn("cost", T.token_estimate(F.col(text)) + 50)
    placed = relational.greedy_batches(costed, keys, [*order, text], "cost", most, budget)
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("said"))))
    return placed.groupBy(*keys, "batch").agg(listed.alias("items")).withColumn("prompt", F.array_join(F.col("items.said"), "\n---\n"))


def class_prompts(classes: DataFrame, methods: DataFrame, keys: list[str], most: int = 15) -> DataFrame:
    """keys, prompt: each class's name, bases and first method signatures. classes: keys, name, bases; methods: keys, place,
    name, parameters (structs with a name, five of which are shown)."""
    said = F.concat("name", F.lit("("), F.array_join(F.transform(F.slice("parameters", 1, 5), lambda p: p["name"]), ", "), F.lit(")"))
    listed = methods.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("methods"))
    joined = classes.join(listed, keys, "left")
    shown = F.array_join(F.slice(F.col("methods.said"), 1, most), "; ")
    inherits = F.when(F.size("bases") > 0, F.concat(F.lit("Inherits: "), F.array_join("bases", ", ")))
    number = F.coalesce(F.size("methods"), F.lit(0))
    number = F.when(F.col("methods").isNull(), 0).otherwise(number)
    return joined.select(*keys, F.concat_ws("\n", F.lit("Explain this class in one sentence, as JSON with the key summary."), "name", F.concat(F.lit("Methods: "), number), F.when(number > 0, shown), inherits).alias("prompt"))


def module_prompts(modules: DataFrame, classes: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """path, prompt: each module's first 15 classes, 10 functions and 10 imports (all: path, place, name)."""
    rows = modules.select("path")
    for kind, df, most in (("classes", classes, 15), ("functions", functions, 10), ("imports", imports, 10)):
        first = relational.first_of_each(df.select("path", "place", "name"), ["path"], [F.col("place"), F.col("name")], most)
        listed = first.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias(kind))
        rows = relational.with_count(rows, "path", df, "path", f"n_{kind}").join(listed, "path", "left")
    lines = [F.concat(F.lit(f"{kind}: "), F.col(f"n_{kind}"), F.when(F.col(kind).isNotNull(), F.concat(F.lit(" - "), kind)).otherwise("")) for kind in ("classes", "functions", "imports")]
    return rows.select("path", F.concat_ws("\n", F.lit("Explain this module in one sentence, as JSON with the key summary."), "path", *lines).alias("prompt"))


def one_text(rows: DataFrame, order: list[Column], line: Column, most: int, head: str) -> DataFrame:
    """prompt: a heading and the lines of the first ``most`` rows in order."""
    first = rows.orderBy(*order).limit(most).select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    return first.agg(F.concat(F.lit(head + "\n"), joined).alias("prompt"))


def architecture_prompt(modules: DataFrame, most: int = 20) -> DataFrame:
    """One prompt on modules (path, n_classes, n_functions)."""
    line = F.concat(F.lit("- "), "path", F.lit(": "), "n_classes", F.lit(" classes, "), "n_functions", F.lit(" functions"))
    return one_text(modules, [F.col("path")], line, most, "Describe the architecture of a project with these modules.")


def business_prompt(modules: DataFrame, most: int = 15) -> DataFrame:
    """One prompt on the summaries of the first modules (path, summary) that have one."""
    first = modules.orderBy("path").limit(most).where("summary <> ''")
    return one_text(first, [F.col("path")], F.concat(F.lit("## "), "path", F.lit("\n"), "summary"), most, "Describe the business logic of a project with these modules.")


def assigned(rows: DataFrame, answers: DataFrame, name: str, place: str, within: list[str] = (), path: bool = False) -> DataFrame:
    """Rows with ``summary`` from answers (within, key, summary, place) of their own batch (``within``): by the exact name, else
    the lower-case one, else (``path``) a key that the name contains or that contains its file name, else the place."""
    named = lambda df, p: df.select(*[F.col(c).alias(f"__{p}{c}") for c in within], F.col("key").alias(f"__{p}"), F.col("summary").alias(f"__s{p}"))
    same = lambda p: [F.col(c).eqNullSafe(F.col(f"__{p}{c}")) for c in within]
    both = lambda *conditions: reduce(Column.__and__, conditions)
    best = answers.groupBy(*within, "key").agg(F.min_by("summary", "place").alias("summary"))
    lower = answers.groupBy(*within, F.lower("key").alias("key")).agg(F.min_by("summary", "place").alias("summary"))
    placed = answers.groupBy(*within, F.col("place").alias("key")).agg(F.min("summary").alias("summary"))
    joined = rows.join(named(best, "1"), both(*same("1"), F.col(name) == F.col("__1")), "left").join(named(lower, "2"), both(*same("2"), F.lower(name) == F.col("__2")), "left")
    joined = joined.join(named(placed, "3"), both(*same("3"), F.col(place) == F.col("__3")), "left")
    found = ["__s1", "__s2"]
    if path:  # a batch has a handful of answers
        listed = answers.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("place", "key", "summary"))).alias("summary"), F.lit(0).alias("key"))
        joined = joined.join(named(listed, "4"), both(F.lit(True), *same("4")), "left") if within else joined.join(F.broadcast(named(listed, "4")), how="cross")  # one row
        part = F.filter("__s4", lambda a: F.contains(F.col(name), a["key"]) | F.contains(a["key"], T.base_name(F.col(name))))
        joined = joined.withColumn("__s5", F.get(part, F.lit(0))["summary"])
        found.append("__s5")
    summary = F.coalesce(*found, "__s3", F.concat(name, F.lit(" (no summary)")))
    return joined.select(*[c for c in rows.columns if c != "summary"], summary.alias("summary"))


def explained(rows: DataFrame, name: str, text: str, order: list[str], completer: Completer, most: int, budget: int, ledger: Answers | None = None) -> DataFrame:
    """Rows with ``summary``: batches of prompts, their answers (JSON from names to summaries), assigned within each batch.

    A row's key must be unique over ``order``; a failing batch gives default summaries.
    """
    costed = rows.select(*order, F.col(name).alias("__name"), F.col(text).alias("__text")).withColumn("__project", F.lit(0)).withColumn("cost", T.token_estimate(F.col("__text")) + 50)
    placed = relational.greedy_batches(costed, ["__project"], [*order, "__name", "__text"], "cost", most, budget)
    placed = placed.withColumn("__place", F.row_number().over(Window.partitionBy("batch").orderBy(*order)).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("__place", "__text")))
    prompts = placed.groupBy("batch").agg(F.array_join(F.transform(listed, lambda x: x["__text"]), "\n---\n").alias("prompt"))
    said = T.lenient_json(F.col("answer"))
    answers = completed(prompts, "prompt", completer, ledger).select("batch", F.posexplode(F.map_entries(said)).alias("at", "e"))
    answers = answers.select("batch", (F.col("at") + 1).alias("place"), F.col("e.key").alias("key"), F.col("e.value").alias("summary"))
    done = assigned(placed.select("batch", *order, "__name", "__place"), answers, "__name", "__place", ["batch"])
    return rows.drop("summary").join(done.select(*order, "summary"), order, "left")


def analysed_project(functions: DataFrame, classes: DataFrame, modules: DataFrame, completer: Completer, answers: Answers | None = None) -> dict[str, DataFrame]:
    """The whole run: functions (path, name, start_line, prompt; those that need no explanation have none), classes and modules
    (path, name, start_line, prompt) in batches of 15, 8 and 5, then the architecture and business texts on the modules."""
    worth = functions.where("prompt IS NOT NULL")
    told = explained(worth, "name", "prompt", ["path", "start_line"], completer, 15, 4000, answers)
    out = {"functions": functions.where("prompt IS NULL").unionByName(told, allowMissingColumns=True)}
    out["classes"] = explained(classes, "name", "prompt", ["path", "start_line"], completer, 8, 8000, answers)
    out["modules"] = explained(modules, "path", "prompt", ["path"], completer, 5, 1 << 40, answers)
    counts = {k: df.groupBy("path").agg(F.count("*").alias(k)) for k, df in (("n_classes", classes), ("n_functions", functions))}
    sized = modules.select("path").join(counts["n_classes"], "path", "left").join(counts["n_functions"], "path", "left").na.fill(0)
    out["architecture"] = completed(architecture_prompt(sized), "prompt", completer, answers)
    out["business"] = completed(business_prompt(out["modules"].select("path", "summary")), "prompt", completer, answers)
    return out


def cached_text(metadata: DataFrame, key: str, prompt: DataFrame, completer: Completer, force: bool = False, answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """(value, from_cache) of a text that metadata (key, value, updated) keeps under a key, and the metadata after it: the
    business analysis of a project is asked for once."""
    kept = metadata.where(F.col("key") == key).select("value", F.lit(True).alias("from_cache"))
    if not force and not kept.isEmpty():
        return kept, metadata
    new = completed(prompt, "prompt", completer, answers).select(F.col("answer").alias("value"), F.lit(False).alias("from_cache"))
    row = new.select(F.lit(key).alias("key"), "value", F.current_timestamp().alias("updated"))
    return new, incremental.upsert(metadata, row, ["key"], "updated")


def class_relations(classes: DataFrame, most_bases: int = 3, most_subclasses: int = 5) -> DataFrame:
    """(path, name, relation, place, other, other_path) of classes (path, name, pos, bases): each of a class's first bases with
    the first class of that name, and the first classes of each module that name it as a base."""
    named = relational.first_of_each(classes.select(F.col("name").alias("other"), F.col("path").alias("other_path"), "pos"), ["other"], [F.col("pos"), F.col("other_path")]).drop("pos")
    listed = storage.dealt(classes, "name", "pos").select("path", "name", "pos", F.posexplode(F.slice("bases", 1, most_bases)).alias("place", "other"))
    bases = listed.join(named, "other").select("path", "name", F.lit("base").alias("relation"), F.col("place").cast("bigint").alias("place"), "other", "other_path")
    using = classes.select(F.col("name").alias("other"), F.col("path").alias("other_path"), "pos", F.explode(F.array_distinct("bases")).alias("name"))
    first = relational.first_of_each(using, ["name", "other_path"], [F.col("pos"), F.col("other")], most_subclasses)
    rank = F.row_number().over(Window.partitionBy("name", "other_path").orderBy("pos", "other")) - 1
    subs = storage.stored(first.withColumn("place", rank.cast("bigint")).drop("pos"), "subclasses")
    subs = relational.crossed(classes.select("path", "name", "pos"), subs, "name", ["path", "pos"], ["other_path", "place"])
    return bases.unionByName(subs.select("path", "name", F.lit("subclass").alias("relation"), "place", "other", "other_path"))


def analysed(targets: DataFrame, cache: DataFrame, completer: Completer, force: bool = False, answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of targets (target_type, target_name, path, code, prompt) and the cache after them.

    A cached result holds if its code hash is the same or someone corrected it; ``force`` asks again. ``from_cache`` says
    what happened.
    """
    keys = ["target_type", "target_name", "path"]
    old = cache.select(*keys, F.col("code_hash").alias("__hash"), F.col("result").alias("__result"), F.col("manually_corrected").alias("__corrected"))
    now = targets.withColumn("code_hash", T.code_hash(F.col("code"))).join(old, keys, "left")
    good = F.lit(not force) & F.col("__result").isNotNull() & incremental.valid(F.col("code_hash"), F.col("__hash"), F.coalesce("__corrected", F.lit(False)))
    marked = now.withColumn("from_cache", good)
    hit = marked.where("from_cache").select(*keys, "code_hash", F.col("__result").alias("result"), F.col("__corrected").alias("manually_corrected"), "from_cache")
    missed = completed(marked.where("NOT from_cache").select(*keys, "code_hash", "prompt"), "prompt", completer, answers)
    fresh = missed.select(*keys, "code_hash", F.to_json(T.lenient_json(F.col("answer"))).alias("result"), F.lit(False).alias("manually_corrected"), F.lit(False).alias("from_cache"))
    results = hit.unionByName(fresh)
    return results, incremental.upsert(cache, results.drop("from_cache").withColumn("updated", F.current_timestamp()), keys, "updated")


#: What a piece of context is worth before it is cut to the budget.
PRIORITY = {"target": 100, "callee": 85, "caller": 75, "base": 70, "sibling": 65}


def context(functions: DataFrame, edges: DataFrame, target: str, found: DataFrame, most: int = 20, bases: DataFrame | None = None) -> DataFrame:
    """(id, kind, priority, content): the target, what it calls, what calls it, its class's other functions, the bases of its
    class (class_id, id, content), and search results (id, content, score) at half their score; each id once, the first
    ``most`` by priority."""
    rows = functions.select("id", "class_id", "content")
    own = rows.where(F.col("id") == target)
    callees = edges.where(F.col("src") == target).select(F.col("dst").alias("id")).distinct()
    callers = edges.where(F.col("dst") == target).select(F.col("src").alias("id")).distinct()
    siblings = rows.join(own.select("class_id"), "class_id", "left_semi").where(F.col("id") != target).orderBy("id").limit(12)
    parts = {"target": own, "callee": rows.join(callees, "id", "left_semi").orderBy("id").limit(10), "caller": rows.join(callers, "id", "left_semi").orderBy("id").limit(6), "sibling": siblings}
    if bases is not None:
        parts["base"] = bases.join(own.select("class_id"), "class_id", "left_semi").select("id", "content").orderBy("id").limit(3)
    tagged = relational.tagged_union({k: df.select("id", "content", F.lit(float(PRIORITY[k])).alias("priority")) for k, df in parts.items()})
    more = found.select("id", "content", (F.col("score") * 0.5).alias("priority")).withColumn("kind", F.lit("search"))
    best = relational.first_of_each(tagged.unionByName(more), ["id"], [F.desc("priority"), F.col("kind")])
    return best.orderBy(F.desc("priority"), "id").limit(most)


def context_text(rows: DataFrame, most_chars: int = 2500) -> DataFrame:
    """One text: the pieces of context by priority, each cut."""
    piece: Column = F.concat_ws("\n", F.concat(F.lit("### "), F.col("id"), F.lit(" ("), F.col("kind"), F.lit(")")), F.substring("content", 1, most_chars))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), F.col("id"), piece.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def chat_prompt(question: str, found: str, history: DataFrame, most: int = 6) -> str:
    """A prompt of the context and the last turns of a conversation (role, turn, text)."""
    last = relational.last_of_conversation(history.withColumn("__one", F.lit(1)), "__one", "turn", most).orderBy("turn").collect()
    return "\n".join([found, *(f"{r.role}: {r.text}" for r in last), f"user: {question}"])


def paged(rows: DataFrame, order: list[Column], number: int, size: int) -> dict:
    """An answer page as plain values: items, total, page, pages."""
    totals = relational.page_count(rows, size).first()
    return {"items": [r.asDict(True) for r in relational.page(rows, order, number, size).collect()], "total": totals.total, "page": number, "page_size": size, "pages": totals.pages}
