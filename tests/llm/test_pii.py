import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import pii

ANCHORS = pii.automaton()


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    number = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(number(m)) <= 19 and luhn(number(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in rules.items()}


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@+- 0(4)é9%_\n25", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    found = pii.spans(text, text.encode().lower().decode(), ANCHORS)
    assert {k: found[k] for k in pii.BASE} == plain(text)


def test_added_spans():
    def of(text):
        return {k: [text[a:b] for a, b in v] for k, v in pii.spans(text, text.encode().lower().decode(), ANCHORS).items() if v}

    assert of('x token = "e51a5499e3950eab" y')["account"] == ["e51a5499e3950eab"]
    assert of("IBAN: GB82WEST12345698765432.")["account"] == ["GB82WEST12345698765432"]
    assert "account" not in of("iban: GB82WEST12345698765433 and my account is closed since yesterday")
    assert of("see https://ada:pw1@host.example.org/a?b=c, or")["address"] == ["https://ada:pw1@host.example.org/a?b=c"]
    assert of("http://10.0.0.7:80/x ")["address"] == ["http://10.0.0.7:80/x"]
    assert of("https://www.example.org/page and tokens of 2024") == {}


def test_long_texts_take_linear_time():
    for text in ("9" * 300_000, "@" * 300_000, "a." * 150_000 + "@", "+1" * 100_000, "1.2 " * 100_000, "+1" + " " * 300_000, "://" * 100_000):
        pii.spans(text, text, ANCHORS)


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "É a.b@c.de, 10.0.0.256 1.2.3.4.5.6.7.8"), (3, "É a.b@c.de, 10.0.0.256 1.2.3.4.5.6.7.8"), (None, "4111 1111 1111 1111 +1 (555) 010-9999"), (4, "9" * 2000 + "@" * 100 + "a" * 2000)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, spans string")
    got = [(r.doc_id, r.text, r.vellum_base) for r in pii.find_pii(docs).collect()]
    assert len(got) == len(rows)
    for _, text, base in got:
        assert base == ",".join(f"{k}:{a}:{b}" for k, v in plain(text or "").items() for a, b in v)
    assert pii.find_pii(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
