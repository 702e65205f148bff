import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import personal_data

#: Forms that neither the base formats cover nor the planted training examples are made from.
VALUES = {
    "email": ["jo.brown (at) sales (dot) acme (dot) com", "r2d2[at]droids[dot]org", "lena at uni-bonn dot de", "sam.w @ mailbox.net", "k_lopez(at)correo.es", "tim AT hogwarts DOT edu", "ann [at] garden [dot] io", "bo.li {at} post.fr"],
    "ip": ["10[.]1[.]2[.]3", "192(.)168(.)0(.)77", "8[.]8[.]8[.]8", "172-31-9-200"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "3782.822463.10005", "6011_1111_1111_1117"],
    "phone": ["(415) 555-2671", "212-555-0187", "617.555.0143", "030 4455 6677", "0049 30 1234 5678", "(020) 7946 0018", "1-800-555-0199"],
}
LIKE = ["2021-11-03", "4111.1111.1111.1112", "1.2.3.4.5", "3.14159265", "meet at noon.then go", "17/03/2019 - 21/03/2019", "order 1234-5678-90", "999[.]999[.]300[.]1", "1234567890123456", "dafbac99949115180e7593", "@home garden.party", "page 1203 404 999"]


@pytest.fixture(scope="module")
def model(spark, sf):
    return personal_data.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_planted_values_outside_the_base_formats(spark, sf, documents, model):
    rng = np.random.default_rng(2)
    base = [d["text"] for d in documents if d["text"] and len(d["text"]) < 5000]
    found = wrong = number = 0
    for kind, values in VALUES.items():
        for v in values:
            assert not personal_data.base_spans(v)
            for text in rng.choice(base, 6):
                cut = text.find(" ", rng.integers(len(text)))
                cut = len(text) if cut < 0 else cut
                before = f"{text[:cut]} "
                whole = f"{before}{v} {text[cut:]}"
                (_, spans), = personal_data.found_spans([whole], model)
                new = [s for s in spans if s not in personal_data.base_spans(whole)]
                hit = (len(before), personal_data.KINDS.index(kind), len(before) + len(v)) in new
                number, found, wrong = number + 1, found + hit, wrong + len(new) - hit
    assert found >= 0.85 * number and wrong <= 0.1 * found, (found, number, wrong)
    flagged = sum(len(personal_data.found_spans([f"{t[:300]} {v} {t[300:600]}"], model)[0][1]) > len(personal_data.base_spans(f"{t[:300]} {v} {t[300:600]}")) for v in LIKE for t in rng.choice(base, 6))
    assert flagged <= 0.1 * 6 * len(LIKE), flagged


def test_spans_of_a_table(spark, model):
    odd = [(1, "mail jo (at) acme (dot) com or jo@acme.com, tel (415) 555-2671"), (1, "mail jo (at) acme (dot) com or jo@acme.com, tel (415) 555-2671"), (2, None), (None, ""), (3, "1 " * 20_000), (4, "a at b " * 20_000), (5, "@" * 50_000)]
    df = spark.createDataFrame([(*r, 7) for r in odd], "doc_id long, text string, spans int")
    rows = personal_data.personal_data(df, model).collect()
    assert len(rows) == len(odd)
    both = [r for r in rows if r.doc_id == 1]
    assert [[(s.kind, odd[0][1][s.start : s.end]) for s in r.spans] for r in both] == [[("email", "jo (at) acme (dot) com"), ("email", "jo@acme.com"), ("phone", "(415) 555-2671")]] * 2
    assert [s.kind for s in both[0].base] == ["email"] and both[0].redacted == "mail [EMAIL] or [EMAIL], tel [PHONE]"
    assert all(not r.spans for r in rows if r.doc_id != 1)
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'FF206A6F40782E6F7267' AS STRING) AS text")
    assert [(s.start, s.end) for s in personal_data.personal_data(broken, model).first().base] == [(2, 10)]
    assert personal_data.personal_data(df.limit(0), model).count() == 0
    assert not personal_data.fit(df.where(F.lit(False))).trees
