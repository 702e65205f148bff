import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from stratalith.llm import language_id, personal_data, quality_model
from stratalith.llm.common import fold, folds
from stratalith.llm.queries import op6_language_id, op8_quality_classifier, op10_personal_data

SF10 = "/root/testdata/sf0.01"


def test_folds(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    assert all(r.f == fold(r.doc_id, 4) == zlib.crc32(str(r.doc_id).encode()) % 4 for r in df.withColumn("f", folds(F.col("doc_id"), 4)).collect())


def test_language_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF10}/documents.parquet").collect()}
    rows = op6_language_id(spark, SF10).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97


def test_language_of_odd_rows(spark, odd_documents):
    docs = odd_documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id").isNotNull(), "bb"))
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["aa", "bb"]
    rows = language_id.predictions(docs, model).collect()
    assert len(rows) == docs.count()
    for r, d in zip(sorted(rows, key=str), sorted(rows, key=str), strict=True):
        assert 0 <= r.score <= 1
    texts = {i: t for i, t in ((d.doc_id, d.text) for d in docs.collect())}
    for r in rows:
        if r.doc_id is not None and not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    untaught = language_id.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.predictions(docs, untaught).collect()} == {"und"}
    assert language_id.accepted(docs, model).columns == docs.columns
    assert language_id.fit(docs.limit(0), F.lit(True)).languages == []


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op8_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = (np.array([r.score for r in rows if labels[r.doc_id] == q]) for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean(good >= 0.3) > 0.97 and np.mean(bad < 0.3) > 0.8
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    rows = quality_model.scores(odd_documents, *quality_model.fit(odd_documents, labels, F.lit(True))).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality_model.fit(odd_documents, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_model.scores(odd_documents, *none).collect()} == {0.5}
    assert quality_model.scores(odd_documents.limit(0), *quality_model.fit(odd_documents.limit(0), labels, F.lit(True))).count() == 0


def test_context_sums_equal_brute_force(spark):
    texts = ["One two, three. One", None, "two !! two", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    place, sign = quality_model.index_vectors()
    want = np.zeros((quality_model.BUCKETS, quality_model.DIMS + 1), np.int64)
    for t in texts:
        bucket, _, _ = quality_model.pieces([(t or "").encode()])
        for i, b in enumerate(bucket):
            want[b, -1] += 1
            for j in range(max(0, i - 2), min(len(bucket), i + 3)):
                if j != i:
                    np.add.at(want[b], place[bucket[j]], sign[bucket[j]])
    assert (quality_model.corpus_sums(docs) == want).all()


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and personal_data.luhn(re.sub(r"\D", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
]


def brute_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(KINDS) for m in re.finditer(p, text or "") if good(m[0])]
    return sorted(found)


ODD = [
    "a@b@c.com x@y.z@d.e a.b+c%d@e-f.g.h.", "@a.b a@.b a@b a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.001.1.1 1.2.3.256", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111111",
    "+1 (168) 555-5254. +12 +1234567890123456 +1.2.3-4(5)6 7 89 +", "🙂 é@x.yz é.é@x.yz 12 34 5 6", "1" * 5000 + "." + "2" * 5000, "a" * 20000 + "@", None, "", "12345678901234567890 +" + "1-" * 400,
]


def test_base_spans_equal_the_patterns(documents):
    for text in ODD + [d["text"] for d in documents]:
        assert personal_data.base_spans(text or "") == brute_spans(text)
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")


def test_personal_data_query(spark):
    rows = op10_personal_data(spark, SF10).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF10}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = [f"{KINDS[k][0]}:{a}:{b}" for a, k, b in brute_spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_personal_data_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(None, ODD[0], 0), (0, ODD[0], 0)], "doc_id long, text string, base int")
    rows = personal_data.personal_data(docs, personal_data.fit(docs)).collect()
    assert sorted(str([(s.start, s.kind, s.end) for s in r.base]) for r in rows) == sorted(str([(a, KINDS[k][0], b) for a, k, b in brute_spans(t)]) for t in [*ODD, ODD[0], ODD[0]])
    assert all("a.b+c%d@e-f.g.h" not in r.redacted for r in rows)
    assert personal_data.personal_data(docs.limit(0), personal_data.fit(docs.limit(0))).count() == 0


def test_boosting_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = personal_data.boost(x[:2000], y[:2000])
    assert ((model.margin(model.binned(x[2000:])) > 0) == y[2000:]).mean() > 0.97
