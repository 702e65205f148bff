import hashlib
import re

from pyspark.sql import functions as F

from stratalith.llm import chat_format, secrets
from stratalith.llm.queries import op7_chat_formatting, op9_secret_scans


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    talks = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn, r.role, r.text or "")):
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in op7_chat_formatting(spark, sf).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss))


ODD_TURNS = ["", None, "<|", "<\\|", "<\\\\|im_sep|>", "<|im_sep|>", "<|im_end|>\n<|im_start|>user\nx", "<", "|", "a\nb", "\n", "\\", "<<||", "ü🙂<|x|>", "$1 \\1 <|$0"]


def test_round_trip_of_odd_turns(spark):
    rows = [(1, i, role, t) for i, t in enumerate(ODD_TURNS) for role in ("assistant",)] + [(2, i, "r\n\\n" if i % 3 else "<|", t) for i, t in enumerate(ODD_TURNS)]
    rows += [(3, 0, None, None), (None, 0, "user", "x"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (4, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    for c in (1, 2, 3, None):
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
    assert got[1].loss_text == "".join(t or "" for t in ODD_TURNS)
    assert got[1].formatted.count(chat_format.START) == 1
    assert [t.text for t in got[4].turns] == ["first", "a", "a", "b"]
    assert chat_format.formatted(df.limit(0)).count() == 0


PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def brute_secrets(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


def test_secrets_equal_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in op9_secret_scans(spark, sf).collect()}
    for d in documents:
        want, r = brute_secrets(d["text"]), got[d["doc_id"]]
        assert r.base_sha256 == sha(",".join(want))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(f"{k}:") for x in want) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == want


SECRETS = [
    "token: token = abcdefgh", "PassWord='hunter2+/' api-key=xxxxxxxx apikey = yyyyyyyy", "🙂 secret:abc secret:abcdef", "AKIAAKIA" + "B" * 14 + " AKIA1 " + "AKIA" + "Z" * 16,
    "é" + "0123456789abcdef" * 2 + "G" + "a" * 23, "token=" + "deadbeef" * 4, "ghp_" + "a1B2" * 9 + " xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c_", "passwd" * 300 + "=1234567", None, "", "tok en=abcdef",
]


def test_secret_cases_and_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(None, SECRETS[2]), (0, "key token=zzzzzzz"), (0, None)]
    df = spark.createDataFrame([(*r, "en", "a", 5) for r in rows], "doc_id long, text string, lang string, rules string, n_chars long")
    got = secrets.scanned(df).select("row.*", "spans").withColumn("listed", secrets.listed(F.col("spans"))).collect()
    base = ("assign", "access", "hex")
    found = sorted((r.doc_id or -1, r.text or "", ",".join(s for s in r.listed.split(",") if s.split(":")[0] in base)) for r in got)
    assert found == sorted((i or -1, t or "", ",".join(brute_secrets(t))) for i, t in rows)
    kinds = {s.kind for r in got for s in r.spans}
    assert kinds == {r.kind for r in secrets.RULES}
    clean = secrets.redacted(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.collect() if r.doc_id}
    assert texts[2] == "🙂 secret:abc [ASSIGN]" and texts[5] == "[ASSIGN]" and texts[12] == "tok en=abcdef"
    assert secrets.scanned(df.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert len(secrets.trigram_query(secrets.RULES[0].pattern)[0]) == 6
