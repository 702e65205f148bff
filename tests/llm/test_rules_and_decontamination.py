import hashlib
import re

from stratalith.llm import decontamination, quality_rules
from stratalith.llm.queries import op1_quality_rules, op2_benchmark_decontamination


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 20 or 100 * len(hit) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_ledger_equals_brute_force(spark, sf, documents):
    got = {r.doc_id: tuple(r)[1:7] for r in op1_quality_rules(spark, sf).collect()}
    assert got == {d["doc_id"]: brute_rules(d["text"]) for d in documents}


def test_odd_rows(spark, odd_documents):
    book = quality_rules.ledger(odd_documents)
    rows = book.collect()
    texts = [r.text for r in odd_documents.collect()]
    assert sorted(tuple(r)[1:5] + (r.n_repeat_words,) for r in rows) == sorted(brute_rules(t)[:5] for t in texts)
    empty = quality_rules.ledger(odd_documents.limit(0))
    assert empty.count() == 0


def test_policies_and_ablations(spark, odd_documents):
    book = quality_rules.ledger(odd_documents)
    policy = quality_rules.POLICIES[-1]
    rows = quality_rules.judged(book, policy).collect()
    table = {r.rule: r for r in quality_rules.ablations(book, policy).collect()}
    for rule in quality_rules.RULES:
        assert table[rule.name].failing == sum(r.failed >> rule.bit & 1 for r in rows)
        assert table[rule.name].failing_alone == sum(r.failed == 1 << rule.bit for r in rows)
    assert all(r.kept == (r.failed == 0) for r in rows)


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_contamination(texts, items, width=10):
    windows = {}
    for item, text in items:
        w = re.findall(WORD, lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = re.findall(WORD, lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (its := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= its
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_equals_brute_force(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op2_benchmark_decontamination(spark, sf).collect()}
    want = dict(zip((d["doc_id"] for d in documents), brute_contamination([d["text"] for d in documents], items), strict=True))
    assert got == want
    assert any(x[4] for x in want.values())


ITEMS = [(1, "one two"), (2, None), (3, " .. "), (4, "word word word"), (10, "same line same line same line same line same line same"), (11, "ONE, two!"), (None, "unïcode wörterünïcode")]


def test_contamination_of_odd_rows_and_chunks(spark, odd_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd_documents.unionByName(spark.createDataFrame([(50, "a one two three one\ntwo", None)], odd_documents.schema))
    texts = [r.text for r in docs.collect()]
    want = sorted((*x[:2], x[4]) for x in brute_contamination(texts, [("None" if i is None else i, t) for i, t in ITEMS]))
    for chunk in (1 << 20, 40):
        got = decontamination.contamination(docs, items, chunk_bytes=chunk).collect()
        assert sorted((r.n_words, r.n_hit, r.contaminated) for r in got) == want
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.clean(docs, items).columns == docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma beta alpha alpha x x x x beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    exact = {r.doc_id for r in decontamination.contamination(docs, items).where("contaminated").collect()}
    near = {r.doc_id for r in decontamination.contamination(docs, items, slop=1).where("contaminated").collect()}
    assert exact == {2} and near == {1, 2}
