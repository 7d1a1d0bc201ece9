import datetime as dt
import random
import re

import pytest

from foliant.llm import pii

from .conftest import ODD

P = pii.Permuter(b"test key")


def one(text):
    found = pii.replacements(text, P)
    assert len(found) == 1, found
    return found[0][2], found[0][3]


def card(rng, n=16):
    body = [rng.randrange(10) for _ in range(n - 1)]
    return "".join(map(str, [*body, next(d for d in range(10) if pii.luhn([*body, d]))]))


@pytest.mark.parametrize("sizes", [[10], [10, 10], [26, 10, 3], [256] * 4, [7, 1, 2]])
def test_feistel_is_a_permutation(sizes):
    volume = pii._volume(sizes)
    places = range(volume) if volume < 5000 else random.Random(1).sample(range(volume), 500)
    seen = set()
    for i in places:
        values = pii._split(i, sizes)
        new = P.permute("k", values, sizes)
        assert all(0 <= v < s for v, s in zip(new, sizes, strict=True))
        assert P.permute("k", new, sizes, back=True) == values
        seen.add(tuple(new))
    assert len(seen) == len(places)


def test_cards_stay_valid_and_linked():
    rng = random.Random(2)
    seen = set()
    for n in (13, 15, 16, 19):
        for _ in range(50):
            digits = card(rng, n)
            kind, fresh = one(f"pay {digits} now")
            assert kind == "card" and len(fresh) == n and pii.luhn(list(map(int, fresh))) and fresh != digits
            seen.add(fresh)
            spaced = "-".join(digits[i : i + 4] for i in range(0, n, 4))
            assert one(f"x {spaced}.")[1].replace("-", "") == fresh
    assert len(seen) == 200
    assert pii.replacements("no card 1234567890123456", P) == []


def test_dates():
    seen = set()
    day = dt.date(1999, 1, 1)
    for k in range(800):
        text = (day + dt.timedelta(days=k)).isoformat()
        kind, fresh = one(f"on {text},")
        assert kind == "date" and 1900 <= dt.date.fromisoformat(fresh).year < 2100
        seen.add(fresh)
    assert len(seen) == 800
    assert one("31/12/2020")[1].count("/") == 2 and one("12/31/2020")[0] == "date"
    assert pii.replacements("2020-13-45 and 2023-02-29", P) == []


def test_other_kinds():
    kind, fresh = one("mail John.Doe7@mail.example.com!")
    assert kind == "email" and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@mail\.example\.com", fresh)
    assert one("IBAN DE89 3704 0044 0532 0130 00.")[0] == "iban"
    assert pii.iban_rest(one("IBAN DE89 3704 0044 0532 0130 00.")[1].replace(" ", "")) == 1
    assert pii.replacements("IBAN DE88370400440532013000 x", P) == []
    kind, fresh = one("ssn 123-45-6789 x")
    assert kind == "ssn" and pii._ssn(fresh.replace("-", ""))
    assert pii.replacements("not 000-45-6789", P) == []
    kind, fresh = one("call +1 (017) 555-7713 now")
    assert kind == "phone" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", fresh)
    assert one("call +1-017-555-7713")[1].replace("-", "") == re.sub(r"[^+\d]", "", fresh)
    kind, fresh = one("host 152.143.123.131.")
    assert kind == "ip" and all(int(x) < 256 for x in fresh.split("."))
    assert pii.replacements("version 4.0.1 of 1.2.3.4.5 and 256.1.1.1", P) == []


def test_table(spark, docs, small_dir):
    rows = [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()] + ODD
    got = pii.pseudonymised(docs(rows), b"k").collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    changed = 0
    for r in got:
        old = texts[r.doc_id]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert (r.text is None) == (old is None)
        if not spans:
            assert r.text == old
            continue
        changed += 1
        values = [old[int(s) : int(e)] for _, s, e in spans]
        assert all(v not in r.text for v in values if len(v) > 8)
    assert changed
    assert pii.pseudonymised(docs([]), b"k").count() == 0
    again = pii.pseudonymised(docs(rows), b"other key").collect()
    assert {r.doc_id: r.text for r in again} != {r.doc_id: r.text for r in got}


def test_adjacent_values():
    found = lambda text: [(k, text[s:e]) for s, e, k, _ in pii.replacements(text, P)]
    spaced, plain = "4111 1111 1111 1111", "4845168114407329"
    assert pii.luhn(list(map(int, plain)))
    for text in (f"{spaced} 123", f"{spaced} 12/25", f"7 {spaced} 3rd", f"({spaced} 00)"):
        assert found(text) == [("card", spaced)], text
    assert found(f"2020-12-05 {plain}") == [("date", "2020-12-05"), ("card", plain)]
    assert found(f"97.51.17.173 {plain}") == [("ip", "97.51.17.173"), ("card", plain)]
    assert found(f"{plain} 123-45-6789") == [("card", plain), ("ssn", "123-45-6789")]
    assert found(f"{spaced} {spaced}") == [("card", spaced)] * 2
    belgian, spanish = "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332"
    for text in (f"{belgian} EUR 100", f"{belgian} 2020", f"AB12 {belgian} X", f"{belgian} {belgian}"):
        assert found(text) == [("iban", belgian)] * text.count(belgian), text
    assert found(f"{spanish} BIC CAIXESBB") == [("iban", spanish)]
    assert found(f"{spanish} {spaced}") == [("iban", spanish), ("card", spaced)]
    # the values beside do not change a pseudonym
    assert pii.replacements(f"{plain} 123", P)[0][3] == one(plain)[1]
    assert pii.replacements(f"{belgian} EUR 100", P)[0][3] == one(belgian)[1]


def test_telephone_numbers_abroad():
    for text, code in (("+44 20 7946 0958", "+44 "), ("+49-30-1234567", "+49-"), ("+353 1 234 5678", "+353 "), ("+33 (1) 23 45 67 89", "+33 (")):
        kind, fresh = one(f"call {text}, now")
        assert kind == "phone" and fresh != text and fresh.startswith(code)
        assert re.sub("[0-9]", "0", fresh) == re.sub("[0-9]", "0", text)
    assert pii.replacements("a +1 b +12 34", P) == []
