"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Validated values are permuted within their own format, so a pseudonym is again
a valid value, equal values stay equal in every document, and different values
stay different:

* payment card numbers (13-19 digits, Luhn): all digits but the last are
  permuted, the last is computed anew,
* IBANs (mod 97): letters and digits of the account part, then the check digits,
* social security numbers, telephone numbers and IPv4 addresses,
* dates of 1900 to 2099 that exist, in the order and with the marks they had,
* local parts of mail addresses, letters within letters, digits within digits.

A value is a row of positions, each with its own number of states.  The row is
split into two numbers which take turns in adding a keyed hash of the other, so
every round can be undone with the key.  Formats with gaps (dates, numbers with
forbidden groups) are walked on until a valid value comes up, which is again a
permutation of the valid ones.  Separators, capitals and country codes stay.

Values may stand side by side: a run of digit groups is searched for cards of
13 to 19 digits that start and end with a group (single groups and groups as on
cards first, then from each start the longest), an IBAN has its country's length, else that of any
group border.  Telephone numbers have the North American form, or a plus sign
and a country code.

Null stays null, a text without findings passes unchanged.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import sliced

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
FIRST_DAY = dt.date(1900, 1, 1)
DAYS = (dt.date(2100, 1, 1) - FIRST_DAY).days

DIGIT = re.compile(r"[0-9]")
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    "abroad": re.compile(r"(?<![0-9A-Za-z.+])\+[1-9](?:[\x20.-]?(?:\([0-9]{1,4}\)|[0-9])){7,14}(?![0-9A-Za-z])"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    "date": re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"),
}

#: Runs of digit groups, and the places where an IBAN may start, with all that may belong to it.
DIGITS = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,}(?![0-9A-Za-z])")
GROUP = re.compile(r"[0-9]+")
#: Digit groups as cards print them.
SHAPES = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18"
        " FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24"
        " ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23"
        " ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
#: Country codes of one and of two digits; all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66"
                  " 81 82 84 86 90 91 92 93 94 95 98".split())  # fmt: skip


class Permuter:
    """Keyed permutations of mixed-radix values."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _hash(self, tweak: str, turn: int, value: int) -> int:
        raw = f"{tweak}|{turn}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(raw, key=self.key, digest_size=32).digest(), "big")

    def permute(self, kind: str, values: list[int], sizes: list[int], back: bool = False) -> list[int]:
        half = (len(sizes) + 1) // 2
        tweak = f"{kind}|{','.join(map(str, sizes))}"
        left, right = _joined(values[:half], sizes[:half]), _joined(values[half:], sizes[half:])
        most = _volume(sizes[:half]), _volume(sizes[half:])
        for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._hash(tweak, turn, left)) % most[1]
            else:
                left = (left + sign * self._hash(tweak, turn, right)) % most[0]
        return _split(left, sizes[:half]) + _split(right, sizes[half:])

    def walk(self, kind: str, values: list[int], sizes: list[int], valid: Callable[[list[int]], bool]) -> list[int]:
        """Permutation of the valid values: steps over the others."""
        values = self.permute(kind, values, sizes)
        while not valid(values):
            values = self.permute(kind, values, sizes)
        return values


def _volume(sizes: list[int]) -> int:
    out = 1
    for s in sizes:
        out *= s
    return out


def _joined(values: list[int], sizes: list[int]) -> int:
    out = 0
    for v, s in zip(values, sizes, strict=True):
        out = out * s + v
    return out


def _split(value: int, sizes: list[int]) -> list[int]:
    out = []
    for s in reversed(sizes):
        value, rest = divmod(value, s)
        out.append(rest)
    return out[::-1]


def luhn(digits: list[int]) -> bool:
    doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def iban_rest(letters: str) -> int:
    moved = letters[4:] + letters[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def refill(text: str, fresh: str) -> str:
    """``text`` with its letters and digits replaced one by one; capitals stay capitals."""
    source = iter(fresh)
    return "".join((c2.upper() if c.isupper() else c2) if c.isalnum() and (c2 := next(source)) else c for c in text)


def _letters(permuter: Permuter, kind: str, text: str, valid: Callable[[str], bool] | None = None) -> str:
    """Permuted letters and digits of ``text``, in small letters."""
    plain = text.lower()
    sizes = [10 if c.isdigit() else 26 for c in plain]
    values = [int(c) if c.isdigit() else ord(c) - 97 for c in plain]
    spell = lambda v: "".join(str(x) if s == 10 else chr(97 + x) for x, s in zip(v, sizes, strict=True))
    if valid is None:
        return spell(permuter.permute(kind, values, sizes))
    return spell(permuter.walk(kind, values, sizes, lambda v: valid(spell(v))))


def _ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _email(m: re.Match, p: Permuter) -> str:
    local = m[1]
    kept = "".join(c for c in local if c.isalnum())
    return (refill(local, _letters(p, "email", kept)) if kept else local) + m[0][len(local) :]


def _iban(text: str, p: Permuter) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    account = _letters(p, "iban" + plain[:2], plain[4:]).upper()
    check = 98 - iban_rest(plain[:2] + "00" + account)
    return refill(text, f"{plain[:2]}{check:02d}{account}")


def _card(text: str, p: Permuter) -> str | None:
    digits = [int(c) for c in text if c.isdigit()]
    if not luhn(digits) or not any(digits):
        return None
    body = p.walk("card", digits[:-1], [10] * (len(digits) - 1), any)
    last = next(d for d in range(10) if luhn([*body, d]))
    return refill(text, "".join(map(str, [*body, last])))


def _ssn_new(m: re.Match, p: Permuter) -> str | None:
    digits = m[0].replace("-", "")
    return refill(m[0], _letters(p, "ssn", digits, _ssn)) if _ssn(digits) else None


def _phone(m: re.Match, p: Permuter) -> str:
    digits = "".join(c for c in m[0] if c.isdigit())
    own, code = digits[-10:], digits[:-10]
    return refill(m[0], code + _letters(p, "phone", own))


def _abroad(m: re.Match, p: Permuter) -> str | None:
    digits = "".join(c for c in m[0] if c.isdigit())
    code = next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])
    return refill(m[0], code + _letters(p, "phone", digits[len(code) :]))


def _ip(m: re.Match, p: Permuter) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    return ".".join(map(str, p.permute("ip", [int(x) for x in parts], [256] * 4)))


def _date(m: re.Match, p: Permuter) -> str | None:
    mark = m[1] or m[2]
    parts = m[0].split(mark)
    year_first = len(parts[0]) == 4
    orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]
    # day before month, unless only the other reading exists
    for y, mo, d in orders:
        try:
            day = dt.date(int(parts[y]), int(parts[mo]), int(parts[d]))
        except ValueError:
            continue
        number = (day - FIRST_DAY).days
        if not 0 <= number < DAYS:
            return None
        sizes = [272, 272]
        # both readings must exist or not as before, so that the same order is read again
        fixed = year_first or _ambiguous(day)
        keep = lambda v: _joined(v, sizes) < DAYS and (
            year_first or _ambiguous(FIRST_DAY + dt.timedelta(days=_joined(v, sizes))) == fixed
        )
        new = FIRST_DAY + dt.timedelta(days=_joined(p.walk(f"date{year_first}", _split(number, sizes), sizes, keep), sizes))
        width = [len(x) for x in parts]
        out = [""] * 3
        out[y], out[mo], out[d] = str(new.year), str(new.month), str(new.day)
        padded = any(x[0] == "0" for x in (parts[mo], parts[d])) or width[mo] == width[d] == 2
        return mark.join(x.zfill(2) if padded and i != y else x for i, x in enumerate(out))
    return None


def _ambiguous(day: dt.date) -> bool:
    return day.day <= 12


MAKERS = {"email": _email, "ssn": _ssn_new, "phone": _phone, "abroad": _abroad, "ip": _ip, "date": _date}

Finding = tuple[int, int, str, str]


class Taken:
    """Disjoint spans in order."""

    def __init__(self, found: list[Finding]):
        found = sorted(found)
        self.starts, self.ends = [x[0] for x in found], [x[1] for x in found]

    def touches(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def ibans(text: str, taken: Taken, permuter: Permuter) -> Iterator[Finding]:
    # those of their country's length before any others
    own = list(_ibans(text, taken, permuter, True))
    yield from own
    yield from _ibans(text, taken, permuter, False, Taken(own))


def _ibans(text: str, taken: Taken, permuter: Permuter, known: bool, more: Taken | None = None) -> Iterator[Finding]:
    at = 0
    while m := IBAN.search(text, at):
        start, run = m.start(), m[1]
        places = [i for i, c in enumerate(run) if c != " "]
        # ends of groups, the longest first
        ends = [i + 1 for i in reversed(places) if not _plain(text, start + i + 1)]
        length = IBAN_LENGTHS.get(run[:2])
        if known:
            ends = [places[length - 1] + 1] if length is not None and length <= len(places) and places[length - 1] + 1 in ends else []
        elif length is not None:
            ends = ends[:1]
        at = start + 1
        for e in ends:
            if taken.touches(start, start + e) or (more is not None and more.touches(start, start + e)):
                continue
            if fresh := _iban(run[:e], permuter):
                yield start, start + e, "iban", fresh
                at = start + e
                break


def _plain(text: str, at: int) -> bool:
    return at < len(text) and text[at].isascii() and text[at].isalnum()


def cards(text: str, taken: Taken, permuter: Permuter) -> Iterator[Finding]:
    for m in DIGITS.finditer(text):
        spans = [g.span() for g in GROUP.finditer(m[0])]
        groups = [(m.start() + s, m.start() + e) for s, e in spans]
        widths = [e - s for s, e in spans]
        free = [not taken.touches(s, e) for s, e in groups]
        # Luhn sums of all digits before, those at even places plain or doubled
        digits = [int(c) for c in m[0] if c.isdigit()]
        twice = [2 * d if d < 5 else 2 * d - 9 for d in digits]
        plain = [0, *accumulate(t if i % 2 else d for i, (d, t) in enumerate(zip(digits, twice, strict=True)))]
        doubled = [0, *accumulate(d if i % 2 else t for i, (d, t) in enumerate(zip(digits, twice, strict=True)))]
        at = [0, *accumulate(widths)]

        def card(i: int, j: int) -> Finding | None:
            """The card of groups i to j, the last not included."""
            sums = plain if at[j] % 2 else doubled  # noqa: B023
            if (sums[at[j]] - sums[at[i]]) % 10:  # noqa: B023
                return None
            s, e = groups[i][0], groups[j - 1][1]  # noqa: B023
            fresh = _card(text[s:e], permuter)
            return fresh and (s, e, "card", fresh)

        # groups that are a card by themselves or lie as on a card
        for i, width in enumerate(widths):
            for shape in ((width,), *SHAPES) if 13 <= width <= 19 else SHAPES if width == 4 else ():
                j = i + len(shape)
                if tuple(widths[i:j]) == shape and all(free[i:j]) and (found := card(i, j)):
                    yield found
                    free[i:j] = [False] * len(shape)
                    break
        i = 0
        while i < len(groups):
            ends, j = [], i
            while j < len(groups) and free[j] and at[j + 1] - at[i] <= 19:
                j += 1
                if j > i + 1 and at[j] - at[i] >= 13:
                    ends.append(j)
            step = i + 1
            for j in reversed(ends):
                if found := card(i, j):
                    yield found
                    step = j
                    break
            i = step


FINDERS = {"iban": ibans, "card": cards}


def replacements(text: str, permuter: Permuter) -> list[Finding]:
    """(start, end, kind, pseudonym) of all findings in order; kinds listed first win overlaps."""
    mail = "@" in text
    if not mail and not DIGIT.search(text):
        return []
    out: list[Finding] = []
    for kind in KINDS:
        if kind == "email" and not mail:
            continue
        if kind in FINDERS:
            out += list(FINDERS[kind](text, Taken(out), permuter))
            continue
        for form in ("phone", "abroad") if kind == "phone" else (kind,):
            if form == "abroad" and "+" not in text:
                continue
            taken, found = Taken(out), []
            for m in PATTERNS[form].finditer(text):
                if taken.touches(m.start(), m.end()):
                    continue
                fresh = MAKERS[form](m, permuter)
                if fresh is not None:
                    found.append((m.start(), m.end(), kind, fresh))
            out += found
    return sorted(out)


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with pseudonyms, findings per kind and the spans in the old text.

    The key stays with the tasks; whoever holds it can undo the permutations.
    """
    names = ["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"]

    def run(batches):
        permuter = Permuter(key)
        for batch in sliced(batches, "text"):
            texts, counts, spans = [], [], []
            for text in batch.column("text").to_pylist():
                found = replacements(text, permuter) if text else []
                if found:
                    parts, at = [], 0
                    for s, e, _, fresh in found:
                        parts += [text[at:s], fresh]
                        at = e
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                kinds = [k for _, _, k, _ in found]
                counts.append([kinds.count(k) for k in KINDS])
                spans.append(",".join(f"{k}:{s}:{e}" for s, e, k, _ in found))
            per_kind = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *per_kind, pa.array(spans, pa.string())], names=names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string")
