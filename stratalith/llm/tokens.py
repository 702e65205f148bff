"""Token ids of whole texts, many distinct words at a time.

The two vocabularies of the operators (``tokenizers`` JSON files of byte pair encodings) cut a text into pieces that are
encoded independently. Each slice of texts is cut at white space, every distinct chunk gets its ids once, and the ids of
the texts are put together by index arithmetic. Chunks of plain Latin letters, digits and signs are merged here for
thousands of chunks at once, with the merge table of the file; every other chunk goes to the tokenizers library itself.
The ids are those of the plain call ``Tokenizer.encode(text, add_special_tokens=False)``: texts are cut at the file's
added tokens first, each of which is one id. With ``marks_as_text`` they are those of ``encode_special_tokens``, where an
added token's content is text like any other.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import count, islice

import numpy as np

#: White space of the files' patterns (Unicode White_Space).
WHITE = "\t-\r \x85\xa0  -     　"
#: Chunks with a character beyond this one, an apostrophe (contractions), or more characters go to the library.
LAST_PLAIN, LONGEST = 0x24F, 60
#: Characters that Python's split() takes as white space and the files' patterns don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Other white space than single blanks and line ends: the pattern itself must cut these texts.
ODD_SPACES = "\0\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TWO_SPACES = ("  ", " \n", "\n ", "\n\n")
ODD_RUN = re.compile("[ \n]{3}|[ \n]{2}\\Z")
NO_RANK = 1 << 30

LETTER, DIGIT, SIGN, ODD = range(4)


def kind_of(code: int) -> int:
    """What a character is for the patterns."""
    c = chr(code)
    if code > LAST_PLAIN or c in "'\u0130\u023a\u023e" or c.isspace() and c not in " \n":  # lower case of other widths
        return ODD
    return LETTER if c.isalpha() else DIGIT if unicodedata.category(c)[0] == "N" else SIGN


KINDS = np.array([kind_of(c) for c in range(LAST_PLAIN + 2)], np.uint8)
LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(LAST_PLAIN + 2)], np.uint32)
#: Distinct chunks that a worker knows at once, and that it goes on with when it forgets the rest.
CACHE_CHUNKS, KEPT_CHUNKS = 450_000, 100_000


class Encoder:
    """One tokenizers file: ``ids(texts)`` gives all ids and the bounds of each text."""

    def __init__(self, path: str, marks_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = marks_as_text
        added = [] if marks_as_text else spec.get("added_tokens") or []
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens are taken as they are in the text only")
        self.marks = {a["content"] for a in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")").split
        model = spec["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.word_end = model["end_of_word_suffix"] or ""
        self.words_only = bool(self.word_end)
        self.chunks = re.compile(f"[^{WHITE}]+" if self.words_only else f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.end_ids = np.array([vocab[alphabet[b] + self.word_end] for b in range(256)], np.int64)
        n = max([len(vocab), *(a["id"] + 1 for a in added)])
        left, right, into = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        keys = left * n + right
        order = np.argsort(keys, kind="stable")
        self.n, self.keys, self.ranks, self.into = n, keys[order], order, into
        self.cache = Numbered()
        self.tokens, self.at, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a large number."""
        key = left * self.n + right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k], NO_RANK)

    def merged(self, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (spans of UTF-8 bytes) one after another and each piece's number of ids, by byte pair
        merges of all pieces of one length together."""
        lengths, done = np.zeros(len(sizes), np.int64), []
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            data = text[begin[rows][:, None] + np.arange(size)]
            ids = self.byte_ids[data]
            ids[:, -1] = self.end_ids[data[:, -1]]
            ranks = self.rank(ids[:, :-1], ids[:, 1:])
            while len(rows):
                width, row = ids.shape[1], np.arange(len(rows))
                best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
                low = ranks[row, best] if width > 1 else np.full(len(rows), NO_RANK)
                over = low >= NO_RANK
                if over.any():
                    lengths[rows[over]] = width
                    done.append((rows[over], ids[over]))
                    go = ~over
                    rows, ids, ranks, best, low = rows[go], ids[go], ranks[go], best[go], low[go]
                    row = row[: len(rows)]
                    if not len(rows):
                        break
                ids[row, best] = self.into[low]
                keep = np.ones(ids.shape, bool)
                keep[row, best + 1] = False
                ids = ids[keep].reshape(len(rows), width - 1)
                keep = np.ones(ranks.shape, bool)
                keep[row, best] = False
                ranks = ranks[keep].reshape(len(rows), width - 2)
                for side in (best - 1, best):  # pairs that the new id is part of
                    ok = (side >= 0) & (side < width - 2)
                    r, c = row[ok], side[ok]
                    ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.uint32)
        for rows, ids in done:
            flat[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, lengths

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another and each chunk's number of ids.

        In plain chunks a piece is a run of letters, of digits or of other signs (with the blank before it).
        """
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(size)
        kind = KINDS[np.minimum(code, len(KINDS) - 1)]
        odd = np.concatenate([[0], np.cumsum(kind == ODD)])
        plain = (odd[ends] == odd[ends - size]) & (size <= LONGEST)
        for mark in self.marks:  # only ever a chunk of its own
            plain[[i for i in np.flatnonzero(size == len(mark)).tolist() if chunks[i] == mark]] = False
        code, kind = code[np.repeat(plain, size)], kind[np.repeat(plain, size)]
        if self.words_only:
            code = LOWER[code]
        chunk = np.repeat(np.flatnonzero(plain), size[plain])
        starts = np.ones(len(code), bool)
        first = np.ones(len(code), bool)
        if len(code) > 1:
            first[1:] = chunk[1:] != chunk[:-1]
            blank = first[:-1] & (code[:-1] == 32)
            starts[1:] = first[1:] | ((kind[1:] != kind[:-1]) & ~blank)
            if self.words_only:  # digits one by one
                starts[1:] |= kind[1:] == DIGIT
        text = np.zeros((len(code), 2), np.uint8)  # one or two bytes a character
        two = code >= 0x80
        text[:, 0] = np.where(two, 0xC0 | code >> 6, code)
        text[:, 1] = 0x80 | code & 0x3F
        width = 1 + two
        at = np.cumsum(width) - width
        flat = text[np.stack([np.ones(len(code), bool), two], axis=1)]
        begin = at[starts]
        sizes = np.diff(np.append(begin, len(flat)))
        flat, lengths = self.merged(flat, begin, sizes)
        counts = np.bincount(chunk[starts], lengths, len(chunks)).astype(np.int64)
        if plain.all():
            return flat, counts
        other = np.flatnonzero(~plain)
        found = [e.ids for e in self.library.encode_batch_fast([chunks[i] for i in other.tolist()], add_special_tokens=False)]
        place = np.cumsum(counts) - counts
        counts[other] = [len(x) for x in found]
        place[other] = len(flat) + np.cumsum([0, *(len(x) for x in found[:-1])])
        both = np.concatenate([flat, np.array([i for x in found for i in x], np.uint32)])
        return both[spans(place, counts)], counts

    def split(self, text: str) -> list[str]:
        """The text's chunks, of which every piece of the vocabulary's pattern lies in one; an added token is a chunk."""
        if any(m in text for m in self.marks):
            return [c for part in self.cut(text) for c in ([part] if part in self.marks else self.split(part))]
        if self.words_only:
            return self.chunks(text) if any(c in text for c in SEPARATORS) else text.split()
        if any(c in text for c in ODD_SPACES) or any(c in text for c in TWO_SPACES) and ODD_RUN.search(text):
            return self.chunks(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def forget(self, keep: int = KEPT_CHUNKS) -> None:
        """Drop what was learned of chunks, but for the ``keep`` most frequent ones that occurred more than once."""
        names = list(self.cache)
        order = np.argsort(-self.used, kind="stable")[:keep]
        order = order[self.used[order] > 1]
        size = np.diff(self.at)[order]
        self.tokens = self.tokens[spans(self.at[order], size)]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.used = self.used[order] // 2
        self.cache = Numbered(names[i] for i in order.tolist())

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the texts one after another, and the bounds of each text's."""
        if len(self.cache) > CACHE_CHUNKS:
            self.forget()
        known = len(self.cache)
        parts, cuts = [], [0]
        for t in texts:
            found = self.split(t)
            parts.append(np.fromiter(map(self.cache.__getitem__, found), np.int64, len(found)))
            cuts.append(cuts[-1] + len(found))
        if len(self.cache) > known:
            flat, lengths = self.chunk_ids(list(islice(self.cache, known, None)))
            self.tokens = np.concatenate([self.tokens, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        chunk = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.used = np.bincount(chunk, minlength=len(self.cache)) + np.pad(self.used, (0, len(self.cache) - len(self.used)))
        size = (self.at[1:] - self.at[:-1])[chunk]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.tokens[spans(self.at[chunk], size)], ends[np.array(cuts)]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Numbered(dict):
    """A dictionary that gives each new key the next number."""

    def __init__(self, keys: Iterable[str] = ()) -> None:
        super().__init__((key, n) for n, key in enumerate(keys))
        self._next = count(len(self)).__next__

    def __missing__(self, key: str) -> int:
        self[key] = n = self._next()
        return n


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def encoder(path: str, marks_as_text: bool = False) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path, marks_as_text)
