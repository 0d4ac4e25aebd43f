import hashlib
import re

from barloom.llm import pii

CASES = [
    None,
    "",
    "mail a@b.c_d@e.f and x.y+z@mail-1.example.com. Card 4111 1111 1111 1111, 4111-1111-1111-1112 or 4222222222222222.",
    "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 and 0001.002.255.00256 host 10.0.0.1",
    "+1 (988) 555-2485 call +44.20.1234 +1-2 +123456789012345678 ++49 30 1234567-",
    "iban GB82WEST12345698765432 and GB82WEST12345698765433 éé €𝄞 a@b.co",
    "1 2 3 4 " * 3000 + "x" * 20000 + "@a" + ".b" * 5000,
    "7" * 60000,
]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_force(text):
    text = text or ""
    digits = lambda h: re.sub("[^0-9]", "", h)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(digits(h)) <= 19 and luhn(digits(h))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(digits(h)) <= 15),
    }
    spans = [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return *(sum(k == x[0] for x in spans) for k in rules), hashlib.sha256(said.encode()).hexdigest()


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(CASES)] + [(None, "x", 1), (3, CASES[3], 1)], "doc_id long, text string, spans int")
    rows = pii.pii_report(docs).collect()
    assert len(rows) == len(CASES) + 2
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(CASES):
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute_force(t), i
    assert "iban:5:27" in got[5].spans and got[5].spans.count("iban") == 1


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame([(1, "write to a@b.co"), (2, "xyzzy a@b.co")], "doc_id long, text string")
    scores = {r.doc_id: r.spans[0].score for r in pii.find_pii(docs).collect()}
    assert scores[1] > scores[2]


def test_empty(spark):
    assert pii.pii_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
