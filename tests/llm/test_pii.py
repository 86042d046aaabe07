import hashlib
import re

from labelloom.llm.pii import BASE_KINDS, find, luhn, mod97, pii

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


CASES = [
    "", "no data", "a@b.c_d@e.f", "x@y", "@b.c", "me@x..y", "a@b.c@d.e", "mail bob.k+1@mail-1.example.com, now", "%%@a.b-c.d.", "a@b@c.d",
    "1.2.3.4.5.6.7.8", "300.1.1.1 then 0001.2.3.4", "12.34.56", "9999999.1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111 5500005555555559", "+1 (132) 555-1352 x", "+12", "+1 2 3 4 5 6 7 8 9 (", "++49 30 1234567", "é ü +33 1 23 45 67 89, ñ@ñ.ñ ñ1@a.b", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
]


def test_base_spans_equal_plain_regular_expressions():
    for text in [*CASES, " ".join(CASES), "\n".join(reversed(CASES)) * 3]:
        assert [s[:3] for s in find(text) if s[0] in BASE_KINDS] == naive(text), text


def test_base_spans_on_random_text():
    import random

    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab1234.@-+ ()_%é\n") for _ in range(rng.randint(0, 60)))
        assert [s[:3] for s in find(text) if s[0] in BASE_KINDS] == naive(text), text


def test_checksums_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE89370400440532013001")
    spans = find("my IBAN DE89 3704 0044 0532 0130 00 BIC X; GB82WEST12345698765432; DE00 3704 0044 0532 0130 00")
    assert [s[0] for s in spans if s[0] == "iban"] == ["iban", "iban"]
    assert [s[0] for s in find("social security 123-45-6789")] == ["ssn"] and not find("part 123-45-6789")
    assert find("call +49 30 1234567")[0][3] > find("score +49 30 1234567")[0][3]


def test_rows(docs):
    long = "word " * 40000 + "a@b.cc"
    rows = [(1, None), (2, ""), (3, "a@b.cc 1.2.3.4"), (3, "a@b.cc 1.2.3.4"), (None, "a@b.cc"), (4, long), (5, "9" * 50000 + "." + "a" * 50000 + "@")]
    got = pii(docs(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest() and by[1].max_score is None
    assert by[3].spans == "email:0:6,ip:7:14" and (by[3].n_email, by[3].n_ip, by[3].n_card) == (1, 1, 0)
    assert by[None].n_email == 1 and by[4].spans == "email:200000:200006" and by[5].spans == ""
    assert pii(docs([])).count() == 0


def test_context_decides_on_added_kinds():
    kinds = lambda t: [k for k, *_ in find(t)]
    account = "DE89370400440532013000"
    assert kinds(f"bank account {account}") == kinds(f"pay to {account} please") == ["iban"] and kinds(f"part {account}") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("the line 123-45-6789") == []


def test_every_column_of_a_table(docs):
    text = "mail a.b@c.de, host 10.0.0.1, card 4111 1111 1111 1111, call +49 30 1234567, bank DE89370400440532013000"
    got = pii(docs([(1, text), (2, None)])).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == dict.fromkeys("doc_id n_email n_ip n_card n_phone base_sha256 spans n_iban n_ssn scores max_score".split()).keys() and list(got[0].asDict())[5:7] == ["base_sha256", "spans"]
    want = [(k, text.index(x), text.index(x) + len(x)) for k, x in (("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 30 1234567"), ("iban", "DE89370400440532013000"))]
    said = [f"{k}:{a}:{b}" for k, a, b in want]
    assert got[0].spans == ",".join(said) and got[0].base_sha256 == hashlib.sha256(",".join(said[:4]).encode()).hexdigest()
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone, got[0].n_iban, got[0].n_ssn) == (1, 1, 1, 1, 1, 0)
    assert (got[1].spans, got[1].max_score) == ("", None) and pii(docs([])).count() == 0
