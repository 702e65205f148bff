"""Scalar functions over code texts, names and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to search for.
STOP_WORDS = [
    "get", "set", "is", "to", "string", "int", "bool", "public", "private", "return", "new", "this", "super", "class", "interface", "extends", "implements", "void", "final", "static",
    "import", "package", "throw", "catch", "try", "if", "else", "for", "while", "switch", "case", "break", "continue", "default", "do", "null", "true", "false",
]

# Parts of names that stand for a concept.
CONCEPTS = {
    "database": ["db", "database", "sql", "jdbc", "mybatis"],
    "cache": ["cache", "redis", "caffeine"],
    "api": ["http", "request", "response", "api", "rest"],
    "config": ["config", "setting", "properties"],
    "async": ["async", "future", "thread", "pool"],
    "log": ["log", "logger", "logging"],
    "transaction": ["transaction", "commit", "rollback"],
    "factory": ["factory", "builder", "create", "build"],
}


def line_count(text: Column) -> Column:
    """Line ends plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def token_estimate(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(text) / 4).cast("bigint")


def rough_tokens(text: Column) -> Column:
    """Four tokens for every five characters: the bound that batches are filled by where no tokenizer is at hand."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) * F.lit(0.8)).cast("bigint")


def question_words(question: Column) -> Column:
    """The words between white space that are longer than a character."""
    return F.filter(F.split(F.trim(question), r"\s+"), lambda w: F.length(w) > 1)


def docstring(literal: Column) -> Column:
    """A string literal without its quotes."""
    return F.regexp_replace(literal, r"""^[rRuUbBfF]{0,2}["']+|["']+$""", "")


def display(text: Column, width: int) -> Column:
    """A column of a fixed width: cut or padded."""
    return F.rpad(F.substring(F.coalesce(text, F.lit("")), 1, width), width, " ")


def json_text(value: Column) -> Column:
    """An array, map or struct as JSON; null as an empty array."""
    return F.coalesce(F.to_json(value), F.lit("[]"))


def keywords(text: Column) -> Column:
    """Distinct identifiers of more than two characters that aren't stop words, in order of appearance."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def camel_parts(name: Column) -> Column:
    """The words of a camel-case or underscored identifier, in lower case; split before lowering."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0)), F.lower)


def prefixes(words: Column, length: int = 4) -> Column:
    """The beginnings of the words that are long enough."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= length), lambda w: F.substring(w, 1, length)))


def concept_tags(name: Column, signature: Column, kind: Column) -> Column:
    """The concepts that a name and its signature suggest."""
    text = F.lower(F.concat_ws(" ", name, signature))
    tags = [F.when(text.rlike("|".join(words)), F.lit(tag)) for tag, words in CONCEPTS.items()]
    low = F.lower(name)
    failing = ((kind == "class") & F.contains(low, F.lit("exception"))) | F.contains(low, F.lit("error"))
    return F.array_compact(F.array(*tags, F.when(failing, F.lit("exception"))))


def index_key(path: Column, name: Column) -> Column:
    """The key of a snippet in the index."""
    return F.md5(F.concat_ws(":", path, name).cast("binary"))


def code_hash(code: Column) -> Column:
    """A hash that ignores white space and block comments (line comments count, since line ends are gone by then)."""
    dense = F.regexp_replace(code, r"(?U)\s+", "")
    dense = F.regexp_replace(dense, r"//.*?\n", "")
    return F.md5(F.regexp_replace(dense, r"/\*.*?\*/", "").cast("binary"))


def class_hash(name: Column, bodies: Column) -> Column:
    """The change hash of a class: its methods' bodies in order, then its name."""
    return code_hash(F.concat(F.array_join(bodies, ""), name))


def base_name(path: Column) -> Column:
    return F.substring_index(normal_path(path), "/", -1)


def parent_dir(path: Column) -> Column:
    """The folder of a path, ``.`` at the root."""
    p = normal_path(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def dotted(path: Column) -> Column:
    return F.translate(path, "/\\", "..")


def simple_name(qualified: Column) -> Column:
    """What follows the last dot of what follows the first colon."""
    return F.substring_index(F.regexp_replace(qualified, "^[^:]*:", ""), ".", -1)


def module_of(qualified: Column) -> Column:
    return F.substring_index(qualified, ":", 1)


def mermaid_id(qualified: Column) -> Column:
    return F.replace(F.substring_index(qualified, ":", -1), F.lit("."), F.lit("_"))


def or_default(value: Column, default: str) -> Column:
    """The value, or a default if it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def function_signature(name: Column, parameters: Column, return_type: Column, modifiers: Column) -> Column:
    """``modifiers return_type name(type parameter, ...)``; parameters are structs (name, type)."""
    args = F.array_join(F.transform(parameters, lambda p: F.concat_ws(" ", or_default(p["type"], "object"), p["name"])), ", ")
    return F.concat_ws(" ", F.nullif(F.array_join(modifiers, " "), F.lit("")), or_default(return_type, "void"), F.concat(name, F.lit("("), args, F.lit(")")))


def class_signature(name: Column, bases: Column, methods: Column, most: int = 15) -> Column:
    """``class name : bases { methods }`` with a bounded number of methods."""
    heading = F.when(F.size(bases) > 0, F.concat(F.lit(" : "), F.array_join(bases, ", "))).otherwise("")
    return F.concat(F.lit("class "), name, heading, F.lit(" { "), F.array_join(F.slice(methods, 1, most), "; "), F.lit(" }"))


def truncated(text: Column, most_tokens: int, head: int = 30, tail: int = 20, limit: int = 50) -> Column:
    """The text if short enough, else its first (and, if long, last) lines."""
    lines = F.split(text, "\n", -1)
    first = F.array_join(F.slice(lines, 1, head), "\n")
    last = F.array_join(F.slice(lines, -tail, tail), "\n")
    return F.when(token_estimate(text) <= most_tokens, text).when(F.size(lines) > limit, F.concat(first, F.lit("\n... omitted ...\n"), last)).otherwise(first)


def masked_key(key: Column) -> Column:
    """First and last four characters with stars between; shorter keys show their last character only."""
    long = F.concat(F.substring(key, 1, 4), F.repeat(F.lit("*"), F.length(key) - 8), F.substr(key, F.length(key) - 3))
    short = F.concat(F.lit("***"), F.substr(key, F.length(key)))
    return F.when(F.coalesce(F.length(key), F.lit(0)) == 0, "not configured").when(F.length(key) > 8, long).otherwise(short)


def error_class(message: Column) -> Column:
    """A kind of failure for a message, by the first rule that holds."""
    low = F.lower(message)
    has = lambda text, part: F.contains(text, F.lit(part))
    return (
        F.when(has(message, "404") | has(low, "not found"), "not_found")
        .when(has(message, "401") | has(low, "auth"), "unauthorized")
        .when(has(message, "403") | has(low, "forbidden"), "forbidden")
        .when(has(message, "500") | has(message, "Internal Server Error"), "server")
        .when(has(low, "timeout"), "timeout")
        .when(has(message, "JSON") | has(message, "json"), "format")
        .when(has(low, "rate_limit") | has(low, "rate limit"), "rate_limit")
        .otherwise("other")
    )


def lenient_json(text: Column) -> Column:
    """A map from an answer that should be JSON: the text itself, a fenced block, the outermost braces, or empty."""
    parse = lambda c: F.from_json(c, "map<string,string>")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when(F.size(F.map_keys(parse(c))) > 0, parse(c))
    return F.coalesce(good(text), good(fenced), good(braces), F.create_map().cast("map<string,string>"))
