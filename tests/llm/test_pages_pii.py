from __future__ import annotations

import pytest

from lorespark.llm import pii
from lorespark.llm.pages import extract

NAMES = pii.Names.of([(n, "family") for n in ("Haskerby", "Draymere", "Naskerby", "Toverby", "Fennmere", "Pellmere", "Ulmmere", "Greverby", "Case", "Price")] + [(n, "given") for n in ("Jarlisse", "Malisse", "Ullisse", "Talisse", "Luna", "Will")])


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("mail o'x.y+z@mail.a-b.example now", [("email", "o'x.y+z@mail.a-b.example")]),
        ("write a.b (at) c (dot) example", [("email", "a.b (at) c (dot) example")]),
        ("Icon checkout@2x.png and @v/forms@1.2.3", []),
        ("call +44 (0)20 7946 0536 please", [("phone", "+44 (0)20 7946 0536")]),
        ("phone (570) 555-0182.", [("phone", "(570) 555-0182")]),
        ("Serial 1535408217 is printed", []),
        ("National identity number: 201280-988M", [("id_number", "201280-988M")]),
        ("Order 996-28-8473 was split into 8 parcels.", []),
        ("identity 996-28-8473", [("id_number", "996-28-8473")]),
        ("went to Flat 3, 42 Jasust Close, Orbanro", [("address", "Flat 3, 42 Jasust Close")]),
        ("habite 171 bis avenue Kelunehu.", [("address", "171 bis avenue Kelunehu")]),
        ("vive en Calle Verilpe, 238, 43259", [("address", "Calle Verilpe, 238")]),
        ("wohnt Tavumebstraße 190", [("address", "Tavumebstraße 190")]),
        ("PO Box 18877, X", [("address", "PO Box 18877")]),
        ("covers 16 Street level map tiles", []),
        ("Signed off: Luna Haskerby", [("name", "Luna Haskerby")]),
        ("Reported by Grace R. Toverby, phone", [("name", "Grace R. Toverby")]),
        ("Per Fennmere, Talisse this is", [("name", "Fennmere, Talisse")]),
        ("Die Testperson P. Toverby wohnt", [("name", "P. Toverby")]),
        ("attention P. DRAYMERE", [("name", "P. DRAYMERE")]),
        ("Will Case 14 run before Page 2 loads?", []),
        ("", []),
    ],
)
def test_spans(text, spans):
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text, NAMES)] == spans


HELD_OUT = [
    # confirmed by their check digits, without a word that says so
    ("He paid with 4111 1111 1111 1111 last week", "4111 1111 1111 1111"), ("please use DE89 3704 0044 0532 0130 00 from now on", "DE89 3704 0044 0532 0130 00"),
    ("mine is 529.982.247-25 and", "529.982.247-25"), ("she gave 131052-308T twice", "131052-308T"), ("we noted 12345678Z there", "12345678Z"),
    ("the file of 86 095 742 719 is", "86 095 742 719"),
    # refuted
    ("He paid with 4111 1111 1111 1112 last week", None), ("the ID 4111 1111 1111 1112 is", None), ("iban DE88 3704 0044 0532 0130 00", None),
    ("mine is 529.982.247-26 and", None), ("she gave 131052-308U twice", None), ("we noted 12345678A there", None), ("the file of 86 095 742 718 is", None),
    # refuted, but labelled
    ("her tax number is 529.982.247-26, she says", "529.982.247-26"), ("el DNI 12345678A es", "12345678A"),
    # confirmed by chance, but labelled as something else
    ("order 12345678Z was sent", None), ("call 030 901820 or send the passport number", None),
]


@pytest.mark.parametrize(("text", "number"), HELD_OUT)
def test_validators_decide(text, number):
    found = [text[a:b] for kind, a, b, _ in pii.find_spans(text, NAMES) if kind == "id_number"]
    assert found == ([number] if number else [])


def test_without_validators_the_spans_differ(monkeypatch):
    monkeypatch.setattr(pii, "_sound", lambda *_: False)
    missed = [n for text, n in HELD_OUT if n and n not in [text[a:b] for k, a, b, _ in pii.find_spans(text, NAMES) if k == "id_number"]]
    assert len(missed) == 6


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.mod11("52998224725") and not pii.mod11("52998224726")
    assert pii.mod31("131052308", "T") and pii.mod23("12345678", "Z") and not pii.mod23("12345678", "A")
    assert pii.iso7064("86095742719") and not pii.iso7064("86095742718")
    assert pii.verhoeff("2363") and not pii.verhoeff("2364")


def test_redaction_and_nulls(spark):
    docs = spark.createDataFrame([(1, "call +44 20 7946 0536 or a@b.example", 0), (2, None, 0), (3, "", 0), (1, "x" * 100_000 + " a@b.example", 0)], "doc_id BIGINT, text STRING, found INT")
    names = spark.createDataFrame([("Luna", "given"), (None, "family")], "person_name STRING, name_kind STRING")
    out = {(r.doc_id, r.text[:40] if r.text else r.text, r.found) for r in pii.redacted(docs, names).collect()}
    assert out == {(1, "call [PHONE] or [EMAIL]", 2), (2, None, 0), (3, "", 0), (1, "x" * 40, 1)}
    assert {(r.doc_id, r.start_pos) for r in pii.pii_spans(docs, names).collect()} == {(1, 6), (1, 26), (1, 100_002)}
    assert pii.pii_spans(docs.limit(0), names).isEmpty()


def page(n):
    title = ["Refund upload when the role changes", "Voucher batch on a slow connection", "Parcel form after the policy update"][n % 3] + f" part {chr(97 + n)}"
    slug = title.lower().replace(" ", "-")
    side = ["Loyalty badge without a saved address", "Booking wallet with a reader active", "Coupon wizard on a slow connection", "Tariff limit when the list is empty"]
    lines = ["Guides", "FAQ", "Support", f"Home » Guides » {title}", title, "By Anna Smith" if n % 2 else "By Hugo Brown", f"Last updated 2024-0{n % 9 + 1}-11"]
    body = [f"The {'abcdefghijkl'[n % 12] * 4} clerk opens the draft number {n} and the total is counted again at once by all.", "## A heading of the article", "| a | b |"]
    tail = ["Join the next live demo", *side[n % 3 : n % 3 + 2], "", "Share this article", f"© 2020-202{n % 6} Acme. All rights reserved."]
    return (n, f"https://acme.example/x/{slug}-{n}", "acme.example", "\n".join(lines + body + tail)), len(lines), len(body)


def test_pages(spark):
    rows = [page(n)[0] for n in range(30)]
    rows += [(100, None, None, "Lonely line of a page without any host that is long enough."), (101, None, "acme.example", ""), (102, None, "acme.example", None)]
    df = spark.createDataFrame([(*r, "p", []) for r in rows], "raw_id BIGINT, page_url STRING, host STRING, text STRING, page STRING, paths ARRAY<STRING>")
    got = {r.raw_id: r for r in extract(df).collect()}
    for n in range(30):
        row, head, body = page(n)
        count = len(row[3].split("\n"))
        blank = [i for i, x in enumerate(row[3].split("\n"), 1) if not x]
        want = [i for i in range(1, count + 1) if i != 5 and not head < i <= head + body and i not in blank]
        assert got[n].furniture == want
    assert got[100].furniture == [] and got[101].body == "" and 102 not in got
    assert extract(df.limit(0)).isEmpty()


def test_an_article_under_several_addresses_is_no_furniture(spark):
    body = ["A tale of ten gates", "The first gate stands open at noon, and nobody has ever seen it shut.", "Short words only", "It ends where the road begins, at a wall of grey stone and moss."]
    rows = [(n, f"https://h.example/p{n}", "h.example", f"Menu of things\nOwn line {'abcdefghijkl'[n] * 5}\nWords that only page {'abcdefghijkl'[n] * 7} holds, as nobody else writes such lines.") for n in range(12)]
    rows += [(100 + n, f"https://h.example/tale?s={n}", "h.example", "\n".join(["Menu of things", *body])) for n in range(6)]
    got = {r.raw_id: r.body for r in extract(spark.createDataFrame(rows, "raw_id BIGINT, page_url STRING, host STRING, text STRING")).collect()}
    assert all(got[100 + n].split("\n") == body for n in range(6))
    assert "Menu" not in got[0]
