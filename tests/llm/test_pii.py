import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmine.llm import pii
from quillmine.llm.queries import op2_pii_anchors
from tests.llm.conftest import clashing

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def keep(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if keep(k, m[0])]


def base(text):
    return [s for s in pii.scan(text) if s[0] in PATTERNS] if text else []


def test_base_spans_equal_the_patterns(texts):
    for _, text in texts:
        assert base(text) == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789@.+- ()ab_%\n=:é/", max_size=60))
def test_base_spans_of_any_text(text):
    assert base(text) == brute(text)


def test_method_adds_spans():
    found = pii.scan("see https://joe:pw@host.example/x, IBAN: DE89 3704 0044 0532 0130 00. account no. 12345678; account 123")
    assert [(k, a) for k, a, _ in found if k not in PATTERNS] == [("login", 4), ("iban", 41), ("account", 82)]


def test_operator_keeps_rows_and_replaces_its_column(docs, texts):
    got = pii.find_pii(clashing(docs, "spans", "kind")).collect()
    assert len(got) == len(texts)
    assert {r.kind for r in got} == {"mine"}
    assert Counter((r.doc_id, len(r.spans)) for r in got) == Counter((i, len(pii.scan(t)) if t else 0) for i, t in texts)
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_query(spark, folder, texts):
    want = Counter()
    for i, t in texts:
        if i is not None:
            spans = brute(t)
            n = Counter(s[0] for s in spans)
            want[i, *(n[k] for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    rows = op2_pii_anchors(spark, folder).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
