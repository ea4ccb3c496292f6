"""Base spans against plain regular expressions; contexts that reveal unseen identifiers, and those that must not."""

import hashlib
import random
import re

from auditloom.llm import pii_bootstrap

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    number = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 16 <= len(number) <= 19 and luhn(number), "phone": lambda: 8 <= len(number) <= 15,
    }[kind]()


def plain(text):
    found = [[(k, m.start(), m.end()) for m in p.finditer(text or "") if good(k, m[0])] for k, p in PATTERNS]
    shown = ",".join(f"{k}:{a}:{b}" for kind in found for k, a, b in kind)
    return (*map(len, found), hashlib.sha256(shown.encode()).hexdigest()), shown


ODD = [
    "a@b.c", "a@b.c_d@e.f", "a@b.c.d@e.f", "x@y", "é@b.cc", "a..b%+@-.-", "@@a@b.c", "a@b.c@d.e", "a@b..c", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "01.002.255.0",
    "256.1.1.1", "1.1.1.1000", "x1.2.3.4y", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  111111111111", "41111111111111111",
    "12 4111111111111111", "x4111111111111111x", "4111111111111112", "0000000000000000", "+1 (017) 555-7713", "+12", "+123", "+1234567", "+12345678", "+1 2 3 4 5 6 7 8 (",
    "+1234567890123456", "++12345678", "+1+12345678", "+12345678+12345678", "4111-1111 1111-1111-", "😀 a@b.c 😀 1.2.3.4", "4000000000000000006 x", "00000000000000000000",
    "9" * 3000, "1." * 3000, "a." * 3000 + "@b.c", "+1" + " (" * 3000 + "2345678",
]


def test_base_spans_of_odd_texts(spark, odd_docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, r.text) for i, r in enumerate(odd_docs.collect())]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == plain(t)[0], (t, r.spans, plain(t)[1])


def test_base_spans_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        want, shown = plain(r.text)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256) == want
        assert g.spans.startswith(shown) and not g.n_context


def test_repeated_rows_and_no_rows(spark, odd_docs, no_docs):
    assert pii_bootstrap.personal_data(odd_docs).count() == odd_docs.count()
    assert pii_bootstrap.personal_data(no_docs).collect() == []


def test_contexts_reveal_unseen_identifiers(spark):
    rng = random.Random(1)
    rows = [(i, f"Please call me at +1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)} soon") for i in range(8)]
    rows += [(20, "You call me at 020 7946 0958 often"), (21, "MY CALL me at\t415 555 2671."), (22, "me at noon"), (23, "write to me at office@intranet today")]
    # A frequent pair of words before a seed proves nothing.
    rows += [(40 + i, f"it is of the +1 234 555 {1000 + i} kind") for i in range(4)] + [(60 + i, f"the end of the story {i} of the world") for i in range(20)]
    rows += [(90, "a number of the 123456789012 sort"), (91, "no context 123456789012"), (92, "123456789012")]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, r in got.items() if r.n_context} == {20, 21, 23}
    assert got[20].spans == "context:15:28" and got[23].spans == "context:15:30"
    assert all(got[i].n_phone == 1 for i in range(8))


def test_found_identifiers_lead_to_further_contexts(spark):
    # 'ring us on' has no seed; its numbers are found after 'call me at', and one more stands only there.
    rows = [(i, f"Please call me at +1 234 555 {1000 + i} soon") for i in range(8)]
    rows += [(20 + i, f"Please call me at 020 7946 {1000 + i} soon") for i in range(4)] + [(30 + i, f"or ring us on 020 7946 {1000 + i} soon") for i in range(4)]
    rows += [(40, "or ring us on 030 1234 5678 soon"), (41, "or find it in 030 1234 9999 soon")]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, r in got.items() if r.n_context} == {*range(20, 24), *range(30, 34), 40}
