"""Operator 13, repair of conversation structure by a dynamic program over a grammar.

A row becomes a symbol: the initial of its role (s, u, a, other) and whether it may stay, may stay as truncated, or must go.
1. Conversations become sequences of symbols, cut in chunks of at most ``CHUNK`` where one is long.
2. Re-Pair: in each round all chunks are counted for pairs of neighbours, and the most frequent pairs without a common symbol
   become rules. Rounds and rules are bounded (``ROUNDS``, ``RULES``); the results don't depend on where that ends.
3. Each rule gets one transfer matrix, the (min, +) product of its sides' matrices, from the states nothing, system, user,
   assistant to the same: the least cost and a rope of the edits' initials, shared with the sides. Of equal costs the rope that
   spells the least text is kept. (Equal costs over the same rows have texts of which none begins with the other, so the
   least parts make the least whole.)
4. A task streams through sorted rows: first a conversation's chunks, whose products of rule matrices give cost and audit, then its
   rows, to which the audit is applied one by one. It holds one audit, never a conversation's rows.

Edits: keep (K) costs 0, rerole to user or assistant (R) 3, delete (D) 4, insert an empty turn (I) 3; a truncated row that stays
adds 3. The repaired roles' initials are ``(s?(ua)+)?``.

Defined results: a null role or text is one space; rows are ordered by turn (nulls first), of equal turns by role, then by the
MD5 digest of the text; rows that are equal in all of these are the same row repeated. A null id is a conversation of its own.
A role without a character can't stay as it is. A conversation of one id is read by one task in order, since its digest is
over all of it. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .near_duplicates import crowded, dealt

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols of rows: 2 * class + truncated, or the last one for rows that must go.
CLASSES = "sua"
GONE = 8
#: Symbols of a chunk at most; rounds of pairing, rules of a round, and rules in all.
CHUNK, ROUNDS, PER_ROUND, RULES = 4096, 12, 256, 4096
#: Between sequences that are searched at once.
BREAK = 0xFFFF
#: Chunks whose matrices a task remembers.
KNOWN = 4096
BLANKS = " \t\n\x0b\x0c\r"

Rope = str | tuple  # text, or two ropes
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def spelled(rope: Rope) -> str:
    """The text of a rope."""
    parts, todo = [], [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            parts.append(top)
        else:
            todo += (top[1], top[0])
    return "".join(parts)


def least(candidates: list[tuple[int, Rope]]) -> tuple[int, Rope]:
    """The cheapest; of several, the one that spells the least text."""
    cost = min(c for c, _ in candidates)
    ropes = [r for c, r in candidates if c == cost]
    return cost, ropes[0] if len(ropes) == 1 else min(ropes, key=spelled)


def follows(state: int) -> int:
    """The state after an inserted turn, or after one that gets the role that is due."""
    return ASSISTANT if state == USER else USER


def terminal(symbol: int) -> Matrix:
    """One row: inserted turns before it, then what happens to it."""
    found: dict[tuple[int, int], list[tuple[int, Rope]]] = {}
    kind, extra = CLASSES[symbol // 2 : symbol // 2 + 1], TRUNCATED * (symbol % 2)
    for start in range(4):
        state = start
        for inserted in range(3):
            ways = [(DELETE, "D", state)]
            if symbol != GONE:
                due = follows(state)
                ways.append((REROLE + extra, "R", due))
                if kind == {USER: "u", ASSISTANT: "a"}[due]:
                    ways.append((KEEP + extra, "K", due))
                if kind == "s" and state == NOTHING:
                    ways.append((KEEP + extra, "K", SYSTEM))
            for cost, edit, end in ways:
                found.setdefault((start, end), []).append((INSERT * inserted + cost, "I" * inserted + edit))
            state = follows(state)
    return {k: least(v) for k, v in found.items()}


def product(a: Matrix, b: Matrix, join=lambda x, y: (x, y)) -> Matrix:
    """The (min, +) product; ``join`` makes the rope of two."""
    found: dict[tuple[int, int], list[tuple[int, Rope]]] = {}
    for (start, mid), (cost, rope) in a.items():
        for end in range(4):
            if (mid, end) in b:
                more, rest = b[mid, end]
                found.setdefault((start, end), []).append((cost + more, join(rope, rest)))
    return {k: least(v) for k, v in found.items()}


def closed(row: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least way to a whole conversation from the ways to each state, with turns inserted at the end."""
    tails = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    return least([(cost + INSERT * tails[s], rope + "I" * tails[s]) for s, (cost, rope) in row.items()])


class Grammar:
    """Rules by rounds: pair of symbols -> new symbol, with the matrices of all symbols."""

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrices: list[Matrix] = [terminal(s) for s in range(GONE + 1)]
        self.texts: dict[int, Matrix] = {}

    def add(self, pairs: list[tuple[int, int]]) -> None:
        new = {}
        for a, b in pairs:
            new[a, b] = len(self.matrices)
            self.matrices.append(product(self.matrices[a], self.matrices[b]))
        self.rounds.append(new)

    def compressed(self, symbols: np.ndarray) -> np.ndarray:
        """Sequences (with BREAK between) after all rounds."""
        for rules in self.rounds:
            codes = np.array(sorted(a << 16 | b for a, b in rules), np.int64)
            names = np.array([rules[c >> 16, c & 0xFFFF] for c in codes.tolist()], np.int64)
            if len(symbols) < 2:
                break
            here = symbols[:-1] << 16 | symbols[1:]
            at = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
            hit = np.flatnonzero(codes[at] == here)
            # In a run of one symbol every second place begins a pair; other pairs of a round share no symbol.
            first = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            offset = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
            hit = hit[offset % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = names[at[hit]]
            symbols = np.delete(symbols, hit + 1)
        return symbols

    def written(self, symbol: int) -> Matrix:
        """The matrix of a symbol with its ropes spelled."""
        if symbol not in self.texts:
            self.texts[symbol] = {k: (c, spelled(r)) for k, (c, r) in self.matrices[symbol].items()}
        return self.texts[symbol]

    def matrix(self, symbols: bytes) -> Matrix:
        """The matrix of one chunk: neighbours are multiplied until one is left."""
        parts = [self.written(s) for s in self.compressed(np.frombuffer(symbols, np.uint8).astype(np.int64)).tolist()]
        while len(parts) > 1:
            parts = [product(parts[i], parts[i + 1], str.__add__) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def pair_counts(grammar: Grammar):
    """The function that counts neighbours (a, b, n) in a task's sequences."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            rows = [np.frombuffer(s, np.uint8).astype(np.int64) for s in batch.column(0).to_pylist()]
            if not rows:
                continue
            joined = np.concatenate([x for r in rows for x in (r, [BREAK])]).astype(np.int64)
            joined = grammar.compressed(joined)
            pairs = joined[:-1] << 16 | joined[1:]
            codes, n = np.unique(pairs[(joined[:-1] != BREAK) & (joined[1:] != BREAK)], return_counts=True)
            seen.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["pair", "n"])

    return count


def learned(chunks: DataFrame) -> Grammar:
    """The grammar of all chunks (symbols)."""
    grammar = Grammar()
    while len(grammar.rounds) < ROUNDS and len(grammar.matrices) < RULES:
        counted = chunks.select("symbols").mapInArrow(pair_counts(grammar), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(PER_ROUND).collect()
        used: set[int] = set()
        chosen = []
        for r in best:
            a, b = r["pair"] >> 16, r["pair"] & 0xFFFF
            if a not in used and b not in used:
                used |= {a, b}
                chosen.append((a, b))
        if not chosen:
            break
        grammar.add(chosen)
    return grammar


def filled(conversations: DataFrame) -> DataFrame:
    """key (the id as text), conv_id, turn, role, text without nulls but in conv_id and turn."""
    space = F.lit(" ")
    of = {c: F.col(c).cast("string") for c in ("conv_id", "role", "text")}
    return conversations.select(
        F.coalesce(of["conv_id"], space).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(of["role"], space).alias("role"), F.coalesce(of["text"], space).alias("text")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``filled`` after the damage that the CRC of their id and turn chooses: drop, empty, remove ends, repeat, rerole."""
    kind = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    hit = rows.withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("key", "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__copy")).drop("__copy")


def judged(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, turn, role, digest, text) with their number ``n``, ``blank``, ``repeated`` (role and text are in an
    earlier turn too) and ``cut`` (truncated)."""
    whole = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"))
    end = F.expr(f"TRIM(TRAILING '{''.join(f'\\u{ord(c):04x}' for c in BLANKS)}' FROM text)")
    whole = whole.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("blank", end == "").withColumn("cut", ~F.right(end, F.lit(1)).isin(".", "!", "?"))
    whole = stored(whole, "turns")
    firsts = whole.where("NOT blank").groupBy(F.col("key").alias("k"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    met = dealt(whole, ["key", "role", "digest"], firsts, ["k", "r", "d"], crowded(whole, ["key", "role", "digest"]), how="left")
    repeated = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return met.select("key", "turn", "role", "digest", "text", "n", "blank", repeated.alias("repeated"), "cut")


def chunk_rows(most: int):
    """The function that makes chunks of at most ``most`` symbols."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From sorted (key, turn, role, digest, n, blank, repeated, cut): (key, turn, role, digest of its first row, symbols, first and
        last initial, illegal neighbours within) of each chunk."""
        names = ["key", "turn", "role", "digest", "symbols", "first", "last", "illegal"]
        kinds = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()], strict=True)))
        out: list[tuple] = []
        head, symbols, initials = None, bytearray(), ["", ""]
        illegal = 0

        def chunk() -> tuple:
            return (*head, bytes(symbols), *initials, illegal)

        for batch in batches:
            for key, turn, role, digest, n, blank, repeated, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                initial = role[:1]
                if head and (head[0] != key or len(symbols) >= most):
                    out.append(chunk())
                    head = None
                if head is None:
                    head, symbols, initials, illegal = (key, turn, role, digest), bytearray(), [initial, initial], 0
                elif initials[1] + initial not in ("su", "ua", "au"):
                    illegal += 1
                illegal += n - 1
                initials[1] = initial
                kind = "suao".find(initial) if initial else 3
                symbols += bytes([GONE if blank or repeated else 2 * (kind if kind >= 0 else 3) + cut]) + bytes([GONE]) * (n - 1)
            yield from whole_batches(out, kinds)
            out = []
        yield from whole_batches([*out, chunk()] if head else out, kinds)

    return rows


def whole_batches(rows: list[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


STREAM = ["key", "kind", "turn", "role", "digest", "symbols", "text", "n"]


def edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the edits of an audit over rows (role, text) in order."""
    state = NOTHING
    names = {USER: "user", ASSISTANT: "assistant"}
    for edit in audit:
        if edit == "I":
            state = follows(state)
            yield edit, names[state], ""
            continue
        role, text = next(rows)
        if edit == "D":
            yield edit, role, text
            continue
        state = SYSTEM if edit == "K" and role[:1] == "s" else follows(state)
        yield edit, role if edit == "K" else names[state], text


def streamed(grammar: Grammar):
    """The generator of (key, cost, audit, edits) over a task's sorted stream of chunks (kind 0) and rows (kind 1); the edits of a
    conversation are read before the next one."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, str, Iterator]]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        matrix = lru_cache(KNOWN)(grammar.matrix)
        row = next(rows, None)
        while row is not None:
            key, ways = row[0], {NOTHING: (0, "")}
            while row is not None and row[0] == key and row[1] == 0:
                m = matrix(row[5])
                reached: dict[int, list] = {}
                for s, (cost, text) in ways.items():
                    for end in range(4):
                        if (s, end) in m:
                            reached.setdefault(end, []).append((cost + m[s, end][0], text + m[s, end][1]))
                ways = {s: least(c) for s, c in reached.items()}
                row = next(rows, None)
            cost, audit = closed(ways)

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row[0] == key:  # noqa: B023
                    found, row = row, next(rows, None)
                    yield from ((found[3], found[6]) for _ in range(found[7]))

            left = own()
            yield key, cost, audit, edits(audit, left)
            for _ in left:
                pass

    return walk


def prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame, Grammar, DataFrame]:
    """The judged rows, the chunks, the grammar, and the stream: chunks, then rows, by conversation in order."""
    small_batches(rows.sparkSession)
    found = stored(judged(rows), "judged")
    order = ["key", "turn", "role", "digest"]
    chunks = found.select(*order, "n", "blank", "repeated", "cut").repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = stored(chunks.mapInArrow(chunk_rows(CHUNK), "key string, turn long, role string, digest string, symbols binary, first string, last string, illegal long"), "chunks")
    none = F.lit(None)
    both = chunks.select(*order, "symbols", F.lit(0).alias("kind"), none.cast("string").alias("text"), F.lit(1).cast("long").alias("n"))
    both = both.unionByName(found.select(*order, none.cast("binary").alias("symbols"), F.lit(1).alias("kind"), "text", "n"))
    stream = both.select(*STREAM).repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "digest")
    return found, chunks, learned(chunks), stream


def repaired(rows: DataFrame) -> DataFrame:
    """key, place, edit, role, text: the rows of ``filled`` after repair, deleted ones left out."""
    *_, grammar, stream = prepared(rows)
    walk = streamed(grammar)

    def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out: list[tuple] = []
        for key, _, _, changes in walk(batches):
            kept = (c for c in changes if c[0] != "D")
            for place, (edit, role, text) in enumerate(kept):
                out.append((key, place, edit, role, text))
                if len(out) >= 1000:
                    yield from whole_batches(out, kinds)
                    out = []
        yield from whole_batches(out, kinds)

    return stream.mapInArrow(turns, "key string, place long, edit string, role string, text string")


def summaries(batches: Iterable[pa.RecordBatch], walk) -> Iterator[pa.RecordBatch]:
    """(key, cost, audit, repaired_sha256) of each conversation of a task's stream."""
    kinds = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out: list[tuple] = []
    for key, cost, audit, changes in walk(batches):
        digest, between = hashlib.sha256(), b""
        for edit, role, text in changes:
            if edit != "D":
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
        out.append((key, cost, audit, digest.hexdigest()))
        if len(out) >= 1000:
            yield from whole_batches(out, kinds)
            out = []
    yield from whole_batches(out, kinds)


def counted(found: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated of the judged rows."""
    fine = ~F.col("blank") & ~F.col("repeated")

    def number(when: Column, of: Column) -> Column:
        return F.sum(F.when(when, of).otherwise(0)).cast("long")

    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return found.groupBy(F.col("key").alias("counted")).agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        number(F.col("blank"), F.col("n")).alias("blank"),
        number(~F.col("blank"), F.when(F.col("repeated"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        number(fine & F.col("cut"), F.lit(1)).alias("truncated"),
    )


def illegal(chunks: DataFrame) -> DataFrame:
    """key, illegal: neighbours within chunks, and between the last of a chunk and the first of the next one."""
    ends = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "first", "last")))  # a row for CHUNK turns
    met = chunks.groupBy(F.col("key").alias("met")).agg(F.sum("illegal").alias("within"), ends.alias("ends"))
    between = F.zip_with(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), F.slice("ends", 2, F.size("ends")), lambda a, b: F.concat(a["last"], b["first"]).isin("su", "ua", "au"))
    return met.select("met", (F.col("within") + F.size(F.filter(between, lambda ok: ~ok))).cast("long").alias("illegal"))


def reports(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``ids`` (key,
    conv_id; one without rows has zeros, an empty audit and the digest of nothing)."""
    found, chunks, grammar, stream = prepared(rows)
    walk = streamed(grammar)
    solved = stream.mapInArrow(lambda batches: summaries(batches, walk), "key string, cost long, audit string, repaired_sha256 string")
    every = ids.select("key", "conv_id").distinct().join(counted(found), F.col("key") == F.col("counted"), "left").join(illegal(chunks), F.col("key") == F.col("met"), "left").join(solved, "key", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
