"""Pseudonyms: formats, links, no collisions, and the query against plain Python."""

from __future__ import annotations

import calendar
import re

import pytest
from pyspark.sql import functions as F

from mirrorseq.llm import pii, queries
from mirrorseq.llm.common import read

KEY = bytes(range(32))


def luhn_ok(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def test_formats_and_links():
    text = "card 4418452524842581, ip 12.197.240.125, born 29/02/2000, mail ab.9@x.example.com, +1 (858) 555-7280, GB82 WEST 1234 5698 7654 32, 123-45-6789"
    new, n = pii.pseudonymise(text, KEY)
    assert n == 7 and pii.pseudonymise("x 12.197.240.125 y", KEY)[0].split()[1] in new
    card = re.search(r"card (\d{16})", new)[1]
    assert card != "4418452524842581" and luhn_ok(card)
    iban = re.search(r"GB\d\d [A-Z0-9 ]+\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert max(map(int, re.search(r"ip ([\d.]+),", new)[1].split("."))) < 256
    assert pii.pseudonymise("1234567890123456 and 999.1.1.1 and 31/02/2000", KEY)[1] == 0


def test_key_without_digits():
    key = "AKIA" + "QWERTYUIOPASDFGH"
    out, n = pii.pseudonymise(f"plain words\nthe key {key} is here", KEY)
    assert n == 1 and key not in out and re.search(r"AKIA[A-Z2-7]{16} is here", out)


FORMATS = ["{y:04}-{m:02}-{d:02}", "{d:02}/{m:02}/{y}", "{m:02}/{d:02}/{y}", "{d:02}.{m:02}.{y}", "{d}/{m}/{y}", "{m}/{d:02}/{y}"]


def test_dates_never_collide():
    days = [(y, m, d) for y in (1900, 1999, 2000, 2050, 2099) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1)]
    written = {f.format(y=y, m=m, d=d) for f in FORMATS for y, m, d in days}
    seen = {}
    for w in sorted(written):
        new = pii._date(w, KEY)
        assert new and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", w), (w, new)
        assert seen.setdefault(new, w) == w
        assert pii._date(new, KEY) is not None


def test_every_date_of_a_format_is_hit_once():
    dates, _ = pii._domain((2, 2), False)
    assert {pii._date(f"{d:02}/{m:02}/{y}", KEY) for d, m, y in dates} == {f"{d:02}/{m:02}/{y}" for d, m, y in dates}


def test_phones_link_across_spellings():
    spelt = ["+1 415 555 0123", "+14155550123", "+1 (415) 555-0123", "+1-415-555-0123", "(415) 555-0123"]
    found = {re.sub(r"\D", "", pii.pseudonymise(x, KEY)[0])[-10:] for x in spelt}
    assert len(found) == 1 and found != {"4155550123"}
    for x in ("+49 30 901820", "+4930901820", "+351 912 345 678"):
        new = pii.pseudonymise(x, KEY)[0]
        assert new[:3] == x[:3] and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", x) and new != x


def test_the_key_decides(spark):
    assert pii.pseudonymise("12.197.240.125", KEY) != pii.pseudonymise("12.197.240.125", KEY[::-1])
    with pytest.raises(ValueError):
        pii.protect(spark.range(1).withColumn("text", F.lit("x")), b"short")


#: Plain patterns of what the tables hold, each with its own validity.
PLAIN = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda x: True),
    "card": (r"(?<![\d-])\d{16}(?![\d-])", luhn_ok),
    "ip": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)", lambda x: max(map(int, x.split("."))) < 256),
    "phone": (r"\+1 \(\d{3}\) \d{3}-\d{4}", lambda x: True),
}


def test_query_against_plain_python(spark, sf):
    before = {r.doc_id: r.text for r in read(spark, sf, "documents").select("doc_id", "text").collect()}
    after = {r.doc_id: r for r in queries.op6_pii(spark, sf).collect()}
    assert before.keys() == after.keys()
    links, back, n = {}, {}, 0
    for k, text in before.items():
        new = after[k].text
        if text is None:
            assert new is None
            continue
        assert len(text) == len(new) or re.search(PLAIN["ip"][0], text)
        for kind, (pattern, valid) in PLAIN.items():
            old = [x for x in re.findall(pattern, text) if valid(x)]
            got = [x for x in re.findall(pattern, new) if valid(x)]
            assert len(old) == len(got)
            for a, b in zip(old, got, strict=True):
                n += 1
                assert links.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a
        bare = lambda t: re.sub("|".join(p for p, _ in PLAIN.values()), "#", t)
        if after[k].n_private == sum(valid(x) for p, valid in PLAIN.values() for x in re.findall(p, text)):
            assert bare(new) == bare(text)
    assert n > 10 and sum(a[1] == b for a, b in links.items()) == 0


def test_awkward(awkward, empty):
    out = pii.protect(awkward, KEY, count="found")
    assert out.columns == [*awkward.columns, "found"] and {r.doc_id: r.text for r in out.collect()}[1] is None
    assert pii.protect(empty, KEY).count() == 0
