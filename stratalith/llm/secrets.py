"""Operator 9, secret scans, in DataFrame expressions only: a trigram inverted index in front of the rules.

1. The index holds a posting (trigram, key) for every distinct trigram of every text in lower case, sorted by trigram within
   each file, so that looking up a list reads the pages that hold it. It depends on no rule and serves any set of rules.
   A key is a 64-bit hash of doc_id and text; that two rows share one only makes a candidate more.
2. From each rule's regular expression a Boolean trigram query is derived (an AND of ORs of ANDs of trigrams that any
   match must hold, in lower case); a rule without mandatory trigrams gets none and scans every text.
3. The lists that the queries name are looked up and intersected or united by key, all rules in one pass: each posting
   sets its trigram's bit for its key, and the queries are evaluated on the bits. What is left are the candidates.
4. Only candidates are matched with the rule itself; matches get their places from the lengths of the pieces between them.

Defined results: a null text is an empty one; repeated rows, rows that share a doc_id and rows with a null id are each
judged by their own text; further columns are ignored; an empty table gives no rows. Bytes that are no UTF-8 count as the
JVM decodes them. Offsets are code points, ends exclusive. Arrays of matches are folded in blocks, so that 100,000 matches
in one text are no matter; the index takes long texts in chunks.

The patterns are taken apart by the parser of Python's own ``re`` module, which is not a documented interface of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Bytes of candidates (``CANDIDATE_BYTES`` a row) that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES, CANDIDATE_BYTES = 8 << 20, 32
#: Characters of a text that one array of trigrams takes, and of a piece that a place is cut from.
CHUNK, PIECE = 1 << 16, 1 << 13
#: An executor's heap over what a task of the index reads at most. Such a task sorts some 25 times the bytes that it reads.
HEAP_SHARES = 768
#: Elements that one growing array is folded from.
BLOCK = 128
#: Trigrams that one long holds as bits.
WORD = 60


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least number of characters of one group (0: of the match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: Fixed values of the base kinds, in their order; then further kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("keyblock", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def literal_strings(tree, most: int = 64) -> list[str] | None:
    """All strings that a part of a pattern matches, if these are few."""
    out = [""]
    for kind, arg in tree:
        if kind is op.LITERAL:
            more = [chr(arg)]
        elif kind is op.SUBPATTERN:
            more = literal_strings(arg[3], most)
        elif kind is op.BRANCH:
            parts = [literal_strings(b, most) for b in arg[1]]
            more = None if any(p is None for p in parts) else [s for p in parts for s in p]
        elif kind is op.MAX_REPEAT and arg[:2] == (0, 1):
            inner = literal_strings(arg[2], most)
            more = None if inner is None else ["", *inner]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            more = [chr(c) for _, c in arg]
        else:
            more = None
        if more is None or len(out) * len(more) > most:
            return None
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of ANDs of lower-case trigrams; empty if the pattern has no mandatory trigram."""
    clauses: list[list[frozenset[str]]] = []

    def walk(tree) -> None:
        run = [""]

        def close() -> None:
            sets = [frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in run]
            if all(sets):
                clauses.append(sorted({x for x in sets if not any(y < x for y in sets)}, key=sorted))  # the least demanding

        for node in tree:
            strings = literal_strings([node])
            if strings is not None and len(run) * len(strings) <= 64:
                run = [a + b for a in run for b in strings]
                continue
            close()
            run = [""]
            kind, arg = node
            if kind is op.SUBPATTERN:
                walk(arg[3])
            elif kind is op.MAX_REPEAT and arg[0] > 0:
                walk(arg[2])
        close()

    walk(_parser.parse(pattern))
    return clauses


def trigrams_of(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for alternative in clause for g in alternative})


def row_key() -> Column:
    """The key of a row (doc_id, text) in the index; rows without a text need none and get any."""
    return F.when(F.col("text").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "text"))


def heap_share(spark: SparkSession) -> int:
    """Bytes in one of ``HEAP_SHARES`` of an executor's heap."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.sparkContext.getConf().get("spark.executor.memory", "1g")) // HEAP_SHARES


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Meanwhile no task reads more than a share of an executor's heap from files, or one row group."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(name, str(min(number(before), heap_share(spark))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def postings(docs: DataFrame) -> DataFrame:
    """Store the index of (doc_id, text): (gram, key), one row per chunk of a text and trigram in it.

    A task reads whole row groups, however large the given ones are; so the texts are first written in small ones."""
    low = docs.where("text IS NOT NULL").select(row_key().alias("key"), F.lower("text").alias("low"))
    low = stored(low, "texts", "snappy", row_group=heap_share(docs.sparkSession))
    cut = F.lit(f"(?s)(.{{1,{CHUNK}}})(?=(.{{0,2}}))")  # the next two characters belong to a chunk's last trigrams
    chunks = F.zip_with(F.regexp_extract_all("low", cut, F.lit(1)), F.regexp_extract_all("low", cut, F.lit(2)), lambda a, b: F.concat(a, b))
    chunks = F.when(F.length("low") <= CHUNK, F.array("low")).otherwise(chunks)
    grams = F.array_distinct(F.regexp_extract_all("chunk", F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    rows = low.select("key", F.explode(chunks).alias("chunk")).select(F.explode(grams).alias("gram"), "key")
    with small_splits(docs.sparkSession):
        return stored(rows.sortWithinPartitions("gram"), "trigrams")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the bits of the rules whose queries the lists of their trigrams satisfy for a key."""
    grams = trigrams_of(rules)
    words = range(-(-len(grams) // WORD))

    def looked_up(values) -> Column:
        return F.element_at(F.create_map(*[x for g, v in zip(grams, values, strict=True) for x in (F.lit(g), F.lit(v).cast("long"))]), F.col("gram"))

    lists = index.where(reduce(Column.__or__, [F.col("gram") == g for g in grams], F.lit(False)))  # Parquet takes long lists of values as a range
    placed = lists.select("key", looked_up(k // WORD for k in range(len(grams))).alias("word"), looked_up(1 << k % WORD for k in range(len(grams))).alias("bit"))
    together = placed.groupBy("key").agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"bits{w}") for w in words])

    def holds(alternative: frozenset[str]) -> Column:
        masks = dict.fromkeys(words, 0)
        for g in alternative:
            k = grams.index(g)
            masks[k // WORD] |= 1 << k % WORD
        return reduce(Column.__and__, (F.col(f"bits{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in masks.items() if m))

    total = F.lit(0)
    for k, rule in enumerate(rules):
        if query := trigram_query(rule.pattern):
            met = reduce(Column.__and__, (reduce(Column.__or__, map(holds, clause)) for clause in query))
            total = total.bitwiseOR(F.when(met, F.lit(1 << k)).otherwise(F.lit(0)))
    return together.select("key", total.alias("rules")).where("rules != 0")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, fold) -> Column:
    """The fold (from 0) of all values before each one. Blocks are folded first, so no array grows beyond a block's or
    the blocks' number."""
    none = F.array().cast("array<int>")

    def block(v: Column, k: Column) -> Column:
        return F.slice(v, k * BLOCK + 1, F.lit(BLOCK))

    def so_far(v: Column, start: Column) -> Column:
        return F.aggregate(v, F.struct(start.alias("at"), none.alias("out")), lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda k: F.aggregate(block(v, k), F.lit(0), fold))
        starts = F.transform(so_far(totals, F.lit(0)), lambda at, k: F.struct(at.alias("at"), k.alias("k")))
        return F.flatten(F.transform(starts, lambda s: so_far(block(v, s["k"]), s["at"])))

    return bound(values, whole)


def spans_of(rule: Rule, number: int, text: Column) -> Column:
    """The rule's spans in a text as structs (start, number, kind, end)."""
    pattern = F.lit(rule.pattern)
    lengths = lambda texts: F.transform(texts, F.length)
    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    decisive = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    gaps = lengths(F.split(text, rule.pattern, -1))

    def places(m: Column) -> Column:
        gap = F.slice(m["gap"], F.lit(1), F.size(m["whole"]))
        before = before_each(F.zip_with(gap, m["whole"], lambda g, w: g + w), lambda a, x: a + x)
        rows = F.arrays_zip(before.alias("before"), gap.alias("gap"), m["whole"].alias("whole"), m["decisive"].alias("decisive"))
        good = F.filter(rows, lambda r: r["decisive"] >= rule.least)
        start = lambda r: r["before"] + r["gap"]
        return F.transform(good, lambda r: F.struct(start(r).alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), (start(r) + r["whole"]).alias("end")))

    matched = F.struct(whole.alias("whole"), decisive.alias("decisive"), gaps.alias("gap"))
    return F.when(F.regexp_like(text, pattern), bound(matched, places)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,number:int,kind:string,end:int>>"


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, and all secrets of its text, by start, then in the order of the rules."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keyed = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    found = stored(candidates(postings(keyed.select("doc_id", "text")), rules), "candidates")
    small = found.count() * CANDIDATE_BYTES <= BROADCAST_BYTES
    keyed = keyed.select("row", "text", row_key().alias("at"))
    joined = keyed.join(F.broadcast(found) if small else found, F.col("at") == F.col("key"), "left")
    always = sum(1 << k for k, r in enumerate(rules) if not trigram_query(r.pattern))
    known = F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(always))
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(SPANS)
    parts = [F.when(known.bitwiseAND(F.lit(1 << k)) != 0, spans_of(r, k, text)).otherwise(none) for k, r in enumerate(rules)]
    return joined.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted_text(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """The characters from a to b, from the pieces of ``PIECE`` characters that hold them."""
        part = lambda k: F.substr(F.get(pieces, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        held = F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int"))
        return F.when(b > a, F.array_join(F.transform(held, part), "")).otherwise("")

    def whole(m: Column) -> Column:
        done = before_each(F.transform(m["spans"], lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        rows = F.filter(F.arrays_zip(done.alias("done"), m["spans"].alias("span")), lambda r: r["span"]["start"] >= r["done"])
        said = F.transform(rows, lambda r: F.concat(between(m["pieces"], r["done"], r["span"]["start"]), F.lit("["), F.upper(r["span"]["kind"]), F.lit("]")))
        last = F.array_max(F.transform(m["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(said, ""), between(m["pieces"], last, m["size"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bound(F.struct(pieces.alias("pieces"), spans.alias("spans"), F.length(text).alias("size")), whole)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced, all columns kept; ``n_chars``, if there, follows the new text."""
    new = scanned(docs).withColumn("clean", redacted_text(F.col("row.text"), F.col("spans")))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("clean").alias(name)
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return new.select(*map(column, docs.columns))
