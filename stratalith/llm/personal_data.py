"""Operator 10, personal data: base formats plus candidates that gradient-boosted trees select.

1. The base kinds (email, ip, card, phone) are found by their formats and checks; these spans always stay.
2. High-recall generators propose overlapping candidates of each kind: whatever surrounds an ``@`` or a written ``at``, and
   all runs of up to ``WINDOW`` groups of digits with signs between them.
3. Boosted trees over format and context features score the candidates. No labelled spans exist, so they learn from
   planted ones: values of each kind in forms that the base formats don't cover (``name (at) host (dot) org``, national
   phone forms, cards grouped by dots or slashes, defanged addresses) and look-alikes (dates, versions, references,
   numbers that fail their checksum) are set into places of a bounded sample of documents (``TRAIN_DOCS``). The sample's
   own candidates that no base span explains (``OWN_CANDIDATES`` a document at most) are further counter-examples.
4. A quarter of the examples is kept out: it calibrates each kind's scores (a logistic curve over the margin) and gives the
   kind's threshold, the least probability from which on the precision is at least ``PRECISION``.
5. Candidates above their threshold that overlap no base span are added, of overlapping ones that with the highest
   probability.

Defined results: a null text is an empty one; bytes that are no UTF-8 count as one replacement character each; repeated
rows and null ids give one row each; further columns are ignored; an empty table gives no rows. Offsets are code points,
ends exclusive. Everything is linear in the text but for a sort of its spans.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, decoded, id_text, slices, small_batches, text_digest

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample, candidates of each that count as counter-examples, planted examples.
TRAIN_DOCS, OWN_CANDIDATES, PLANTED = 3000, 20, 4000
PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32
#: Groups of digits, parted by blanks, of one candidate at most.
WINDOW = 5

#: Possessive forms of the base patterns: where they can't give back, giving back couldn't lead to a match.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

#: The generators: a sign or word for ``at``, a host with signs or words for its dots, runs of digits.
AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|(?<=\s)at(?=\s)", re.IGNORECASE)
DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)"
HOST = re.compile(rf"\s?[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++", re.IGNORECASE)
DIGITS = re.compile(r"[+(]?[0-9](?:[ ().\-/_\[\]]{0,3}+[0-9])++")
CONTEXT = [re.compile(x, re.IGNORECASE) for x in (r"mail|contact|write", r"\bip\b|host|server|address", r"card|visa|master|pay|credit", r"phone|tel|call|fax|mobile|cell")]
OTHER = re.compile(r"order|ref|isbn|version|\bv$|invoice|\bid\b|serial|date|page|chapter|total|[$\u20ac%#]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, from each ``@`` outwards: linear also in long runs without one."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > done and LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def union(spans: Iterable[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def free(stretches: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether no stretch overlaps a..b."""
    k = bisect_left(stretches[0], b) - 1
    return k < 0 or stretches[1][k] <= a


def mail_candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """From each ``at`` outwards; a scan to the left ends at the last one, so all of them are linear together."""
    done = 0
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        if host:
            end = start = m.start() - (m.start() > done and text[m.start() - 1].isspace())
            while start > done and LOCAL.match(text, start - 1):
                start -= 1
            if start < end:
                yield start, 0, host.end()
        done = m.end()


def digit_candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Windows of groups of digits, for each kind whose number of digits fits."""
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        base, s = m.start(), m[0]
        groups = [(g.start(), g.end()) for g in re.finditer(r"\S+", s)]
        sizes = [len(NOT_DIGIT.sub("", s[a:b])) for a, b in groups]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, min(i + WINDOW, len(groups))):
                digits += sizes[j]
                a, b = base + groups[i][0], base + groups[j][1]
                if i == j and s[groups[i][0] : groups[j][1]].count(".") + s[groups[i][0] : groups[j][1]].count("-") >= 3 and digits <= 12:
                    yield a, 1, b
                if 12 <= digits <= 19:
                    yield a, 2, b
                if 7 <= digits <= 15:
                    yield a, 3, b


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): what might be personal data; candidates overlap."""
    return [*mail_candidates(text), *digit_candidates(text)]


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of a candidate."""
    a, kind, b = span
    s = text[a:b]
    before, after = text[max(0, a - 30) : a], text[b : b + 10]
    groups = re.findall("[0-9]+", s[:200]) or [""]
    sizes = [len(g) for g in groups]
    digits = NOT_DIGIT.sub("", s)
    signs = NOT_DIGIT.split(s)[0] == "" and s[0]
    between = re.findall("[^0-9A-Za-z]+", s)
    at = AT.search(s) if kind == 0 else None
    host = s[at.end() :] if at else ""
    tail = re.split(DOT, host, flags=re.IGNORECASE)[-1] if host else ""
    return [
        kind, b - a, len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(between)), max(map(len, between), default=0),
        s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count("_"), s.count("["), s.count("(") - s.count(")"), s.count("("), signs == "+", signs == "(", digits[:1] == "0", digits[:2] == "00",
        kind == 2 and luhn(digits), len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), any(len(g) > 1 and g[0] == "0" for g in groups),
        0 if not at else 1 if at[0] == "@" else 3 if at[0].lower() == "at" else 2, host[:1].isspace(), "dot" in host.lower(), len(tail), tail.isalpha(), at.start() if at else 0, any(c.isdigit() for c in s[: at.start()]) if at else 0, at is not None and ("(" in host or "[" in host or "{" in host),
        before[-1:].isalnum(), before[-1:] in ".-/_=:#$", after[:1].isalnum(), after[:1] in "-/_=%:", before.rstrip()[-1:].isdigit(), after.lstrip()[:1].isdigit(),
        bool(CONTEXT[kind].search(before)), bool(OTHER.search(before[-14:])), sum(c.isupper() for c in s) / (b - a),
    ]


@dataclass
class Trees:
    """Boosted regression trees on binned features (logistic loss)."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    curves: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0)] * len(KINDS))
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.start)
        for of, cut, leaf in self.trees:
            node = np.zeros(len(binned), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[np.arange(len(binned)), of[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability of each candidate; the first feature is its kind."""
        curve = np.array(self.curves)[x[:, 0].astype(np.int64)]
        return 1 / (1 + np.exp(-np.clip(curve[:, 0] * self.margin(self.binned(x)) + curve[:, 1], -40, 40)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit complete trees of ``DEPTH`` levels to the gradients, one after another."""
    model = Trees([np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])])
    b, wide = model.binned(x), BINS + 1
    model.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-9
        of, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, wide)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                for f in range(x.shape[1]) if len(rows) > 10 else ():
                    sg = np.cumsum(np.bincount(b[rows, f], g[rows], wide))
                    sh = np.cumsum(np.bincount(b[rows, f], h[rows], wide))
                    gain = sg**2 / (sh + 1) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + 1) - sg[-1] ** 2 / (sh[-1] + 1)
                    if gain.max() > best:
                        best, of[k], cut[k] = gain.max(), f, int(gain.argmax())
            node = 2 * node + 1 + (b[np.arange(len(y)), of[node]] > cut[node])
        leaf_of = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(leaf_of, g, 2**DEPTH) / (np.bincount(leaf_of, h, 2**DEPTH) + 1)
        model.trees.append((of, cut, leaf))
        margin += leaf[leaf_of]
    return model


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the least log loss of margins (Newton steps, slightly regularised)."""
    w = np.array([1.0, 0.0])
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + 1e-2 * (w - [1, 0])
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> None:
    """Per kind the curve, and the least probability from which on the precision holds."""
    margin = model.margin(model.binned(x)) if len(x) else np.zeros(0)
    for k in range(len(KINDS)):
        rows = np.flatnonzero(x[:, 0] == k)
        if not len(rows):
            continue
        model.curves[k] = logistic_curve(margin[rows], y[rows])
        p = model.probabilities(x[rows])
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[rows][order])
        last = np.append(p[order][1:] != p[order][:-1], True)
        good = np.flatnonzero(last & (right >= PRECISION * np.arange(1, len(order) + 1)) & (right > 0))
        model.thresholds[k] = float(p[order[good[-1]]]) if len(good) else 2.0


# Planted examples.


def checked(rng, n: int) -> str:
    """n random digits of which the last is their checksum."""
    body = str(rng.integers(3, 7)) + "".join(map(str, rng.integers(0, 10, n - 2)))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def digits_of(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def word_of(rng) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))


def grouped(s: str, sizes: list[int], sign: str) -> str:
    cuts = np.cumsum([0, *sizes])
    return sign.join(s[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def planted(rng, kind: int) -> str:
    """A value of the kind in a form that its base format doesn't cover."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == 0:
        local = word_of(rng) + pick("", ".", "_") + pick(word_of(rng), digits_of(rng, 2))
        host = [word_of(rng), pick("com", "org", "net", "edu", "de", "fr", "io", "example")]
        host = [word_of(rng), *host] if rng.random() < 0.3 else host
        at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" AT ", " DOT "), (" [at] ", " [dot] "), (" {at} ", "."), ("(at)", "(dot)"))
        return local + at + dot.join(host)
    if kind == 1:
        return pick("[.]", "(.)", "[.]", "-").join(str(x) for x in rng.integers(1, 255, 4))
    if kind == 2:
        sizes = pick([4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5])
        return grouped(checked(rng, sum(sizes)), sizes, pick(".", "/", "_", " - ", "."))
    a, b, c = digits_of(rng, 3), str(rng.integers(200, 1000)), digits_of(rng, 4)
    two, four = str(rng.integers(10, 100)), digits_of(rng, 4)
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{two} {four} {c}", f"00{two} {rng.integers(10, 100)} {four} {c}", f"(0{two}) {four} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"0{two}/{four}{c[:3]}")


def look_alike(rng) -> str:
    """What resembles personal data and is none."""
    pick = lambda *options: options[rng.integers(len(options))]
    date = f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    failing = lambda n: next(x for x in iter(lambda: digits_of(rng, n), "") if not luhn(x))
    return pick(
        digits_of(rng, rng.integers(7, 21)), failing(16), grouped(failing(16), [4, 4, 4, 4], pick(".", "/", "_", " ", "-")), f"{digits_of(rng, 1)}.{digits_of(rng, rng.integers(5, 12))}",
        ".".join(str(x) for x in rng.integers(0, 40, rng.integers(3, 7))), date, f"{date} {rng.integers(0, 24)}.{rng.integers(10, 60)}", f"{rng.integers(1, 29)}/{rng.integers(1, 13)}/{rng.integers(1900, 2100)} - {rng.integers(1, 29)}/{rng.integers(1, 13)}/{rng.integers(1900, 2100)}",
        f"ISBN 978-{digits_of(rng, 1)}-{digits_of(rng, 2)}-{digits_of(rng, 6)}-{digits_of(rng, 1)}", f"{digits_of(rng, 3)} {digits_of(rng, 3)} {digits_of(rng, 3)}", f"order {digits_of(rng, 4)}-{digits_of(rng, 4)}-{digits_of(rng, 2)}",
        "[.]".join(str(x) for x in rng.integers(200, 999, 4)), "-".join(str(x) for x in rng.integers(256, 3000, 4)), f"{word_of(rng)} at {word_of(rng)}.{word_of(rng)}", f"{word_of(rng)} at {word_of(rng)} {word_of(rng)} dot {word_of(rng)}", f"{word_of(rng)} at {rng.integers(1, 13)}.{rng.integers(10, 60)}",
        f"{word_of(rng)[:4]}{digits_of(rng, 12)}{word_of(rng)}", f"@{word_of(rng)} {word_of(rng)}.{word_of(rng)}", f"{digits_of(rng, 5)}-{digits_of(rng, 4)}", f"{digits_of(rng, 4)}-{digits_of(rng, 4)}",
    )


def planted_examples(contexts: list[tuple[str, str]], number: int = PLANTED) -> tuple[list[list[float]], list[float]]:
    """Features and labels of the candidates around ``number`` planted values and look-alikes, in turn."""
    rng = np.random.default_rng(11)
    cues = (("mail ", "write to ", ""), ("host ", "ip ", ""), ("card ", "visa ", ""), ("tel ", "call ", "phone: ", ""))
    xs, ys = [], []
    for i in range(number if contexts else 0):
        before, after = contexts[i % len(contexts)]
        kind = (i // 2) % len(KINDS) if i % 2 else None
        value = look_alike(rng) if kind is None else planted(rng, kind)
        cue = cues[kind][rng.integers(len(cues[kind]))] if kind is not None and rng.random() < 0.4 else ""
        at = len(before) + 1 + len(cue)
        text = f"{before} {cue}{value}{('', '.', ',')[rng.integers(3)]} {after}"
        stretches = union(base_spans(text))
        for c in candidates(text):
            inside = c[0] < at + len(value) and at < c[2]
            if inside and free(stretches, c[0], c[2]):
                xs.append(features(text, c))
                ys.append(float(kind == c[1] and c[0] == at and c[2] == at + len(value)))
    return xs, ys


EXAMPLES = "place long, before string, after string, x binary"


def example_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EXAMPLES of (digest, text): a place between two words, and some of the candidates that no base span overlaps."""
    for digests, texts in slices(batches):
        rows: list[tuple] = []
        for digest, t in zip(digests, texts, strict=True):
            text = decoded(t)
            cut = text.find(" ", zlib.crc32(t or b"") % (len(text) + 1))
            cut = len(text) if cut < 0 else cut
            stretches = union(base_spans(text))
            own = [c for c in candidates(text) if free(stretches, c[0], c[2])]
            own = sorted(own, key=lambda c: zlib.crc32(b"%d,%d,%d" % c))[:OWN_CANDIDATES]
            x = np.array([features(text, c) for c in own], np.float32)
            rows.append((digest, text[max(0, cut - 40) : cut], text[cut + 1 : cut + 41], x.tobytes()))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["place", "before", "after", "x"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees:
    """Trees from planted examples in a bounded sample of documents and from its own candidates. The driver holds
    ``train_docs`` rows of at most ``OWN_CANDIDATES`` feature rows each."""
    small_batches(docs.sparkSession)
    rows = id_text(docs).where("text IS NOT NULL").select(text_digest().alias("digest"), F.lit(0).alias("all"), "text")
    chosen = bounded_sample(rows.select("digest", "all"), train_docs, "all", ("digest",)).select(F.col("digest").alias("__digest"))
    picked = rows.join(F.broadcast(chosen), F.col("digest") == F.col("__digest"), "left_semi").select("digest", "text").dropDuplicates(["digest"])
    found = sorted(((r.place, r.before, r.after, bytes(r.x)) for r in picked.mapInArrow(example_rows, EXAMPLES).collect()))
    xs, ys = planted_examples([(b, a) for _, b, a, _ in found])
    if not xs:
        return Trees()
    own = np.frombuffer(b"".join(x for *_, x in found), np.float32).reshape(-1, len(xs[0]))
    x = np.concatenate([np.array(xs, np.float32), own]).astype(np.float64)
    y = np.concatenate([ys, np.zeros(len(own))])
    held = np.random.default_rng(5).random(len(y)) < 0.25
    model = boost(x[~held], y[~held])
    calibrate(model, x[held], y[held])
    return model


def found_spans(texts: list[str], model: Trees) -> list[tuple[list, list]]:
    """For each text its base spans and all spans."""
    base = [sorted(base_spans(t)) for t in texts]
    proposed = []
    for i, t in enumerate(texts if model.trees else ()):
        stretches = union(base[i])
        proposed += [(i, c) for c in candidates(t) if free(stretches, c[0], c[2])]
    more: dict[int, list] = {}
    if proposed:
        x = np.array([features(texts[i], c) for i, c in proposed], np.float64)
        p = model.probabilities(x)
        good = np.flatnonzero(p >= np.array(model.thresholds)[x[:, 0].astype(np.int64)])
        taken: dict[int, tuple[list[int], list[int]]] = {}
        for k in sorted(good.tolist(), key=lambda k: (-p[k], proposed[k])):
            i, c = proposed[k]
            stretches = taken.setdefault(i, ([], []))
            if free(stretches, c[0], c[2]):
                at = bisect_right(stretches[0], c[0])
                stretches[0].insert(at, c[0])
                stretches[1].insert(at, c[2])
                more.setdefault(i, []).append(c)
    return [(b, sorted(b + more.get(i, []))) for i, b in enumerate(base)]


FOUND = "doc_id long, base array<struct<start:int,kind:string,end:int>>, spans array<struct<start:int,kind:string,end:int>>, redacted string"


def found_rows(shared):
    """A mapper from (doc_id, text) to FOUND."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in slices(batches):
            texts = [decoded(t) for t in raw]
            found = found_spans(texts, shared.value)
            named = [[[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in x] for x in pair] for pair in found]
            clean = [redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n[0] for n in named], kind), pa.array([n[1] for n in named], kind), pa.array(clean, pa.string())], ["doc_id", "base", "spans", "redacted"])

    return build


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, base and all spans, and the redacted text of every row."""
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(found_rows(docs.sparkSession.sparkContext.broadcast(model)), FOUND)
