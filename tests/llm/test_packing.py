import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratalith.llm import packing
from stratalith.llm.queries import op3_best_fit_packing


def layout(instance, counts):
    bins = defaultdict(list)
    runs = sorted(instance.runs)
    for w, n in counts.items():
        own = [r for r in runs if r[0] == w]
        for rank in range(n):
            _, lo, seq, each, off = [r for r in own if r[1] <= rank][-1]
            bins[seq + (rank - lo) // each].append((off + (rank - lo) % each * w, w))
    return bins


def fewest(items, capacity):
    """The optimum, by search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def check_layout(bins, capacity, pieces):
    assert sum(map(len, bins.values())) == pieces and sorted(bins) == list(range(len(bins)))
    for spans in bins.values():
        at = 0
        for off, w in sorted(spans):
            assert off == at
            at += w
        assert at <= capacity


def test_packing_is_gapless_and_complete():
    rng = random.Random(1)
    for capacity in (10, 50, 4096):
        for _ in range(40):
            counts = {w: rng.randrange(1, 30) for w in rng.sample(range(1, capacity + 1), min(capacity, rng.randrange(1, 40)))}
            instance = packing.pack(counts, capacity)
            bins = layout(instance, counts)
            check_layout(bins, capacity, sum(counts.values()))
            assert len(bins) == instance.sequences


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        counts = {w: items.count(w) for w in set(items)}
        instance = packing.Instance(counts, capacity)
        instance.reduce()
        rest = [w for w, n in instance.left.items() for _ in range(n)]
        assert instance.sequences + fewest(rest, capacity) == fewest(items, capacity)


def test_best_fit_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([12, 40])
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(60)), reverse=True)
        rooms = []
        for w in items:
            fit = [r for r in rooms if r >= w]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - w)
            else:
                rooms.append(capacity - w)
        instance = packing.Instance({w: items.count(w) for w in set(items)}, capacity)
        instance.best_fit()
        assert instance.sequences == len(rooms)


def test_query_equals_library_ids(spark, sf, documents):
    rows = op3_best_fit_packing(spark, sf).collect()
    code = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, e in zip(documents, code.encode_batch([d["text"] or "" for d in documents], add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[d["doc_id"], k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    check_layout(bins, 4096, len(rows))
    assert len(bins) <= 1.01 * sum(r.length for r in rows) / 4096 + 1


def test_odd_rows(spark, odd_documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed(odd_documents, path, capacity=1000).collect()
    assert {r.doc_id for r in rows} == {*range(9), None}
    assert len([r for r in rows if r.doc_id == 3]) == 3 and len([r for r in rows if r.doc_id == 8]) == 41
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    check_layout(bins, 1000, len(rows))
    assert packing.packed(odd_documents.limit(0), path).count() == 0
