import hashlib
import re

from recallforge.llm import pii, queries
from . import odd

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def want(text):
    found = brute(text)
    listed = ",".join(f"{PLAIN[n][0]}:{s}:{e}" for s, n, e in found)
    return [sum(k == n for _, k, _ in found) for n in range(4)] + [hashlib.sha256(listed.encode()).hexdigest()]


def got(r):
    return [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256]


TEXTS = [
    "a@b.c.x@y.z q@r.s_x@y.z x@y..z @@ .@.a a@-.-", "1.2.3.4.5.6.7.8 999.1.2.3.4.5.6 001.02.3.255 1.2.3.000256",
    "4111 1111 1111 1111 4111-1111-1111-1111 5 4111111111111112", "+1 (555) 123-4567 +12 +1 2 +999999999999999999 +1 555 123 45678 (", "é🙂 4111111111111111 x@y.zz",
    "a@b" + ".c" * 20_000, "1 " * 30_000, "+1" + " " * 30_000, "a@a.a " * 500, "1.1.1.1.1" * 500, "4" * 13 + " 4 1 1", "12  4111111111111111",
]


def test_documents(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op10_pii(spark, data).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_card for r in rows) > 0
    for r in rows:
        assert got(r) == want(texts[r.doc_id]), r.doc_id


def test_hard_texts(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *a: df)
    for r in queries.op10_pii(spark, "").collect():
        assert got(r) == want(TEXTS[r.doc_id]), TEXTS[r.doc_id][:80]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark))
    rows = queries.op10_pii(spark, "").collect()
    assert sorted(map(got, rows)) == sorted(want(r[1]) for r in odd.ROWS)
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark, []))
    assert queries.op10_pii(spark, "").count() == 0


def test_ibans_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB83 WEST 1234 5698 7654 32", "see DE89370400440532013000", "example card 4111111111111111", "pay by card 4111111111111111"]
    spans = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[(pii.KINDS[s.kind], s.value) for s in spans[i] if s.kind == 4] for i in range(3)] == [[("iban", "GB82 WEST 1234 5698 7654 32")], [], [("iban", "DE89370400440532013000")]]
    assert [spans[i][0].score for i in (0, 2, 3, 4)] == [1.0, 0.9, 0.6, 0.9]


def test_ibans_end_where_their_country_says(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 AND MORE", "NO9386011117947 OSLO 99", "GB82WEST12345698765432X", "ZZ68 5390 0754 7034", "gb82 DE89 3704 0044 0532 0130 00 DE89370400440532013000"]
    spans = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    got = [[s.value for s in spans[i] if s.kind == 4] for i in range(5)]
    assert got == [["GB82 WEST 1234 5698 7654 32"], ["NO9386011117947"], [], [], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]]


def brute_spans(text):
    """All spans with their scores, by Python's matcher and plain slices of the text."""
    out = []
    for n, kind in enumerate(pii.KINDS):
        matches = list(re.finditer(pii.PATTERNS["iban"] if kind == "iban" else PLAIN[n][1], text or ""))
        for m in matches:
            digits = re.sub("[^0-9]", "", m.group())
            bare = m.group().replace(" ", "")
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
                "iban": lambda: 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1,
            }[kind]()
            if ok:
                near = (text[max(0, m.start() - pii.NEAR) : m.start()] + "\n" + text[m.end() : m.end() + pii.NEAR]).lower()
                score = pii.PRIOR[kind] + 0.1 * bool(re.search(pii.CONTEXT[kind], near)) - 0.3 * bool(re.search(pii.AGAINST, near))
                out.append((m.start(), n, m.end(), m.group(), round(score, 2)))
    return sorted(out)


def test_spans_and_scores_match_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    texts |= {-1: "10.0.0.1 is our host address", -2: "mail a@b.co or c@d.co, then phone +1 555 123 4567 x " * 400, -3: "é " + "a@b.co " * 700 + "IBAN GB82 WEST 1234 5698 7654 32 AND MORE", -4: None, -5: ""}
    rows = pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(s) for s in r.spans] == brute_spans(texts[r.doc_id]), r.doc_id
    assert {r.doc_id: r.spans[0].score for r in rows if r.doc_id == -1} == {-1: 0.7}
