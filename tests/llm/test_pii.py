"""Operator 1: validity, format, linkage and bijection of pseudonyms."""

import itertools
import re
from datetime import date, timedelta

from kvasir.llm import pii, queries

P = pii.Pseudonyms(b"test key")
VALUES = {
    "email": ["bosbt.42@mail8.example.com", "A_b@x.org"], "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "ipv4": ["42.144.35.254", "0.0.0.1"],
    "date": ["2024-02-29", "31/12/1999", "12/31/1999", "01.02.2003"], "ssn": ["078-05-1120"], "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "378282246310005"],
    "phone": ["+1 (988) 555-2485", "+49 30 123456", "(212) 555-0123", "212-555-0123", "+1 (188) 155-2485"],
}
INVALID = ["4111 1111 1111 1112", "2023-02-29", "300.1.1.1", "GB82 WEST 1234 5698 7654 33", "000-12-3456", "31/31/2000"]


def test_pseudonyms_are_valid_and_keep_the_format():
    for kind, values in VALUES.items():
        for v in values:
            text, spans = P.replace(f"see {v}, or not")
            assert [s["kind"] for s in spans] == [kind], v
            new = spans[0]["pseudonym"]
            assert text == f"see {new}, or not" and new != v and spans[0]["end"] - spans[0]["start"] == len(v)
            if kind != "ipv4":
                assert [pii._alphabet(c) or c for c in new] == [pii._alphabet(c) or c for c in v]
            assert [s["kind"] for s in P.replace(f"see {new}, or not")[1]] == [kind]


def test_equal_values_stay_linked_and_keys_differ():
    bare = lambda s: "".join(c for c in s if c.isdigit())
    news = {bare(P("card", v)) for v in VALUES["card"][:3]}
    assert len(news) == 1
    assert pii.Pseudonyms(b"other")("card", VALUES["card"][0]) != P("card", VALUES["card"][0])
    a, b = P("date", "2024-02-29"), P("date", "29/02/2024")
    assert a.split("-") == b.split("/")[::-1]


def test_invalid_values_stay():
    for v in INVALID:
        assert P.replace(f"x {v} y")[0] == f"x {v} y"
    assert P.replace("order 1234567890123456789012 v1.2.3.4.5")[1] == []


def test_neighbours_are_told_apart():
    text = "+1 (608) 555-2280 37.92.178.24 4451718024887799 27.65.93.1 4111 1111 1111 1111 10.0.0.1 +44 20 7946 0958 1.2.3.4"
    assert [s["kind"] for s in P.replace(text)[1]] == ["phone", "ipv4", "card", "ipv4", "card", "ipv4", "phone", "ipv4"]


def test_permutations_are_bijections():
    f = pii.Feistel(b"k")
    for size in (1, 2, 7, 100, 1000):
        assert sorted(f.permute(x, size, b"t") for x in range(size)) == list(range(size))
    odd = [x for x in range(300) if x % 3 == 1]
    assert sorted(f.permute(x, 300, b"t", lambda x: x % 3 == 1) for x in odd) == odd
    days = {P("date", f"{y}-{m:02}-01") for y, m in itertools.product(range(1990, 2010), range(1, 13))}
    assert len(days) == 240


def test_table_cases(spark):
    texts = [None, "", "no values", VALUES["email"][0], f"{VALUES['phone'][0]} " * 2, "é🙂 " + VALUES["card"][2] + " x" * 50000]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(3, VALUES["email"][0], "k")], "doc_id long, text string, kind string")
    out = pii.pseudonymise(df, b"test key").collect()
    assert len(out) == 7
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        assert (by[i]["text"], [s.asDict() for s in by[i]["pii_spans"]]) == P.replace(t)
    assert {r["text"] for r in out if r["doc_id"] == 3} == {P("email", VALUES["email"][0])}
    assert pii.pseudonymise(df.limit(0), b"k").count() == 0
    assert pii.digest(pii.pseudonymise(df, b"test key")).where("doc_id = 4").first()["n_phone"] == 2


def test_international_numbers_in_any_groups():
    for v in ("+91 9876543210", "+86 13812345678", "+49 30 1234567", "+44 20 79460958", "+49 30-123456", "+49 (0)30 1234567", "+33 1 23 45 67 89", "+49 30/1234567", "+4930 1234567", "+353 (0)86-123.4567", "+15 (1234) 123456789"):
        for after in (", or not", " 10.0.0.1 x", " 2024-02-29", " 4111 1111 1111 1111", " 2 times"):
            text, spans = P.replace(f"see {v}{after}")
            new = spans[0]["pseudonym"]
            assert (spans[0]["kind"], spans[0]["start"], spans[0]["end"]) == ("phone", 4, 4 + len(v)), v + after
            assert new != v and [pii._alphabet(c) or c for c in new] == [pii._alphabet(c) or c for c in v]
            assert len(spans) == 1 + (after[1] in "14" or "-02-" in after)
    for v in ("+49 30 123", "+1234567890123456", "+12 (34) 5", "a+49 30 1234567"):
        assert P.replace(v)[1] == [], v


def test_emails_after_signs():
    for before, after in (("_", "_"), ("**_", "_**"), ("--", ""), (".", ","), ("%", ""), ("+", ""), ("x ", " y")):
        text, spans = P.replace(f"{before}jane.d@x.org{after}")
        assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("email", len(before), len(before) + 12)]
        assert text == f"{before}{P('email', 'jane.d@x.org')}{after}"


def test_dates_of_all_layouts_have_distinct_pseudonyms():
    names, day = pii.Pseudonyms(b"k"), date(1950, 1, 1)
    values = set()
    while day < date(1990, 1, 1):
        values |= {f"{day:%Y-%m-%d}", f"{day:%d/%m/%Y}", f"{day:%m/%d/%Y}", f"{day:%d.%m.%Y}", f"{day:%m.%d.%Y}"}
        day += timedelta(1)
    assert len({names("date", v) for v in values}) == len(values)
    # One day has one pseudonym in all layouts in which it is that day.
    assert names("date", "1950-11-14")[8:] + "/" + names("date", "1950-11-14")[5:7] == names("date", "14/11/1950")[:5]


def test_query_equals_brute_force(spark):
    """op1's rows from the values' own definitions: each span is a valid value, its pseudonym is as valid, and the rest stays."""
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    seen = {}
    for r in queries.op1_feistel_pseudonyms(spark, d).collect():
        old, new, at, put = texts[r["doc_id"]] or "", r["text"] or "", 0, 0
        for span in filter(None, r["spans"].split(",")):
            kind, start, end = span.split(":")
            start, end = int(start), int(end)
            assert new[put : put + start - at] == old[at:start]
            value, put = old[start:end], put + start - at
            name = new[put : put + len(value)]  # all formats keep their length but addresses
            if kind == "ipv4":
                name = re.match(r"[0-9.]+(?<![.])", new[put:])[0]
            key = kind, re.sub("[ .()/-]", "", value) if kind in ("card", "iban", "ssn") else value
            assert seen.setdefault(key, re.sub("[ .()/-]", "", name) if kind in ("card", "iban", "ssn") else name)
            assert [c.isdigit() for c in name] == [c.isdigit() for c in value] or kind in ("email", "iban", "ipv4")
            if kind == "card":
                assert pii._luhn(re.sub("[^0-9]", "", name))
            at, put = end, put + len(name)
        assert new[put:] == old[at:]
    assert len(seen) > 10 and len({(k[0], v) for k, v in seen.items()}) == len(seen)
