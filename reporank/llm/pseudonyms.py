"""Pseudonyms for personal data: validated values, permuted by key within their format.

Each value that its check confirms (Luhn, mod 97, calendar, number plan, octets) is read as
a number within the set of all valid values of its format and permuted there by a keyed
Feistel network; cycle walking stays within the set. Equal values get equal pseudonyms in
every document, different ones different pseudonyms, and whoever holds the key can reverse
them. Separators and case are kept, check digits are computed anew.

Kinds, in order of precedence where findings overlap: email (letters and digits of the local
part), iban, phone with country code, ssn, phone without, card, date, ip.

Digits of every script count (Unicode decimal digits): a value is read as if they were 0-9,
so equal values in other digits get the same pseudonym, and every digit is written back in
the script it was in.

Where a phone number with country code ends does not depend on what stands behind it: with
the length that its country's plan fixes (`NATIONAL`), or else with its first block if that
has 8 digits, or else with the first group from which it has 9 national digits.

What stands behind a card or an IBAN can look like more of it (security code, expiry, year).
Where the longest reading fails its check, shorter ones up to each group border are tried, and
then readings from each later group on. The groups of a card have one kind of mark between
them (blanks or hyphens; with both it is mostly dates and numbers in a row). A pseudonym beside
such digits can by chance (one in ten for a card) pass its check together with them, and a
search of the new text then reads another value there; the spans tell where the value is,
and `Pseudonyms(key, back=True).replace` reverses it.

Defined cases: null text stays null and has no findings; values that fail their check are
left alone, and so are dates before 1900 or after 2099; repeated rows get the same text; other columns are kept by `pseudonymised`; an
empty table gives an empty result. Whole texts are searched, and a row is rewritten in the
task that reads it.
"""

import re
import sys
import unicodedata
from bisect import bisect_left
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "card", "ssn", "phone", "date", "ip")
ROUNDS = 10
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"

EDGE, END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_GROUPS = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + END
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"),
    "iban": re.compile(EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + END),
    "plus": re.compile(r"(?<![A-Za-z0-9+])\+(?:[0-9]{1,3}[ .-]?" + _GROUPS + r"|[0-9]{1,3}(?:[ .-]?[0-9]){7,12}" + END + ")"),
    "ssn": re.compile(EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END),
    # behind a digit and a dot only if that is a trunk 1: the end of an address is no number
    "phone": re.compile(r"(?<![A-Za-z0-9+])(?:(?<![0-9]\.)|(?<=\b1\.))" + _GROUPS),
    "card": re.compile(r"(?<![A-Za-z0-9+])[0-9](?:[ -]?[0-9]){12,18}" + END),
    "date": re.compile(
        EDGE + r"(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![A-Za-z0-9]|[-/.][0-9])"
    ),
    "ip": re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"),
}
# Fixed values of the international numbering plan: country codes of one and of two digits (all
# others have three), and digits behind the code where a plan has one length only.
CODES_OF_ONE = "1 7".split()
CODES_OF_TWO = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98"
).split()
NATIONAL = {
    "1": 10, "7": 10, "27": 9, "30": 10, "31": 9, "33": 9, "34": 9, "40": 9, "41": 9, "44": 10, "45": 8, "47": 8,
    "48": 9, "52": 10, "61": 9, "65": 8, "86": 11, "90": 10, "91": 10, "351": 9, "380": 9, "420": 9, "421": 9,
    "852": 8, "966": 9,
}
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Permutation:
    """Keyed permutations of range(size), one for each size and tweak."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _mix(self, tweak, turn, value, size):
        data = f"{tweak}|{size}|{turn}|{value}".encode()
        # 64 bytes are over 100 bits more than the largest half, so the remainder is even
        return int.from_bytes(blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def _turn(self, x, a, b, tweak, size):
        left, right = divmod(x, b)
        for turn in range(ROUNDS):
            if turn % 2:
                right = (right + self._mix(tweak, turn, left, size)) % b
            else:
                left = (left + self._mix(tweak, turn, right, size)) % a
        return left * b + right

    def _turn_back(self, x, a, b, tweak, size):
        left, right = divmod(x, b)
        for turn in reversed(range(ROUNDS)):
            if turn % 2:
                right = (right - self._mix(tweak, turn, left, size)) % b
            else:
                left = (left - self._mix(tweak, turn, right, size)) % a
        return left * b + right

    def __call__(self, x, size, tweak, back=False, valid=lambda x: True):
        """Where x goes, among the valid numbers below `size`. x must be valid."""
        a = isqrt(size - 1) + 1 if size > 1 else 1
        b = -(-size // a)
        step = self._turn_back if back else self._turn
        while True:
            x = step(x, a, b, tweak, size)
            if x < size and valid(x):
                return x


def luhn(digits: str) -> int:
    """Sum of the number; valid if a multiple of ten."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def _spread(text, chars):
    """`text` with its digits and letters replaced by `chars`, separators kept."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in text)


def _classes(text, permute, tweak, back):
    """Every digit a digit, every letter a letter of its case; the whole is one number."""
    low = text.lower()
    radices = [10 if c in DIGITS else 26 if c in LETTERS else 1 for c in low]
    x, size = 0, 1
    for c, r in zip(low, radices):
        x = x * r + (0 if r == 1 else (DIGITS if r == 10 else LETTERS).index(c))
        size *= r
    x, out = permute(x, size, f"{tweak}|{radices}", back), []
    for c, r in zip(reversed(text), reversed(radices)):
        x, digit = divmod(x, r)
        new = c if r == 1 else (DIGITS if r == 10 else LETTERS)[digit]
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def _email(text, permute, back):
    return _classes(text, permute, "email", back)


def _iban_rest(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text, permute, back):
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain[4:] + plain[:4]) != 1:
        return None
    own = _classes(plain[4:], permute, "iban" + plain[:2], back)
    check = 98 - _iban_rest(own + plain[:2] + "00")
    return _spread(text, f"{plain[:2]}{check:02d}{own}")


def _card(text, permute, back):
    digits = re.sub(r"\D", "", text)
    if luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    middle = digits[1:-1]  # the first digit names the network
    body = digits[0] + str(permute(int(middle), 10 ** len(middle), "card" + digits[0], back)).zfill(len(middle))
    return _spread(text, body + str(-luhn(body + "0") % 10))


def _ssn_valid(x):
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(text, permute, back):
    x = int(text.replace("-", ""))
    return _spread(text, f"{permute(x, 10**9, 'ssn', back, _ssn_valid):09d}") if _ssn_valid(x) else None


def _nanp_valid(x):
    return x // 10**9 > 1 and x // 10**6 % 10 > 1


def _code(digits):
    """The country code that the digits behind a plus begin with."""
    n = 1 if digits[:1] in CODES_OF_ONE else 2 if digits[:2] in CODES_OF_TWO else 3
    return digits[:n]


def _phone(text, permute, back):
    digits = re.sub(r"\D", "", text)
    country, national = _code(digits) if text[0] == "+" else "", digits
    national = digits[len(country) :]
    if country and not (country == "1" and len(national) == 10):
        if not 8 <= len(digits) <= 15:
            return None
        new = permute(int(national), 10 ** len(national), "phone" + country, back)
        return _spread(text, country + str(new).zfill(len(national)))
    if not _nanp_valid(int(national)):
        return None
    return _spread(text, country + f"{permute(int(national), 10**10, 'phone1', back, _nanp_valid):010d}")


def _phone_end(text):
    """How far a number with a plus goes in what its pattern has matched."""
    borders, n = [], 0  # digits before each group's end, and where it is
    for i, c in enumerate(text):
        if c in DIGITS:
            n += 1
        elif n and text[i - 1] in DIGITS:
            borders.append((n, i))
    borders.append((n, len(text)))
    country = _code(re.sub(r"\D", "", text))
    exact = [i for n, i in borders if n == len(country) + NATIONAL.get(country, 99)]
    block = [i for n, i in borders[:1] if n >= 8]
    enough = [i for n, i in borders if n >= len(country) + 9]
    return [*exact, *block, *enough, len(text)][0]


def _date(text, permute, back):
    mark = re.sub(r"\d", "", text)[0]
    parts = [int(x) for x in text.split(mark)]
    if len(text.split(mark)[0]) == 4:
        year, month, day, form = *parts, "ymd"
    elif parts[0] > 12:
        day, month, year, form = *parts, "dmy"
    elif mark == ".":
        day, month, year, form = *parts, "dmy"
    else:
        month, day, year, form = *parts, "mdy"
    try:
        x = (date(year, month, day) - FIRST_DAY).days
    except ValueError:
        return None
    size = (LAST_DAY - FIRST_DAY).days + 1
    if not 0 <= x < size:
        return None
    late = form == "dmy" and mark != "."  # such a date is read day first because its day is over 12

    def valid(x):
        return not late or (FIRST_DAY + timedelta(x)).day > 12

    new = FIRST_DAY + timedelta(permute(x, size, "date" + "late" * late, back, valid))
    return {
        "ymd": f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}",
        "dmy": f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year:04d}",
        "mdy": f"{new.month:02d}{mark}{new.day:02d}{mark}{new.year:04d}",
    }[form]


def _ip_valid(x):
    return 0 < x >> 24 < 224 and x >> 24 != 127


def _ip(text, permute, back):
    octets = [int(o) for o in text.split(".")]
    x = sum(o << s for o, s in zip(octets, (24, 16, 8, 0)))
    if max(octets) > 255 or not _ip_valid(x) or text != ".".join(map(str, octets)):
        return None
    new = permute(x, 1 << 32, "ip", back, _ip_valid)
    return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))


RULES = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "date": _date, "ip": _ip}
#: Kind and pattern, in order of precedence.
SEARCHES = [
    ("email", "email"), ("iban", "iban"), ("phone", "plus"), ("ssn", "ssn"), ("phone", "phone"), ("card", "card"),
    ("date", "date"), ("ip", "ip"),
]

#: Kinds whose pattern can read on into what stands behind the value: characters between
#: groups, and how many digits or letters the value has.
GROUPED = {"iban": (" ", 15, 34), "card": (" -", 13, 19)}


def _ends(pattern, hit):
    """Where the value can end: with the match or, for grouped kinds, with an earlier group."""
    if pattern == "plus":
        return [hit.start() + _phone_end(hit.group())]
    ends = [hit.end()]
    if pattern in GROUPED:
        marks, least, most = GROUPED[pattern]
        text, n = hit.group(), 0
        borders = []  # digits and letters before each, and where it is
        for i, c in enumerate(text):
            if c in marks:
                borders.append((n, hit.start() + i))
            else:
                n += 1
        ends += [end for n, end in reversed(borders) if least <= n <= most]
    if pattern == "card":
        ends = [e for e in ends if not {" ", "-"} <= set(hit.group()[: e - hit.start()])]
    return ends


@lru_cache(1)
def _other_digits():
    """All decimal digits beyond ASCII: code point to its ASCII digit."""
    beyond = (chr(c) for c in range(128, sys.maxunicode + 1))
    return {ord(c): chr(48 + unicodedata.digit(c)) for c in beyond if c.isdecimal()}


def _zero(c):
    """The zero of a digit's script."""
    return ord(c) - unicodedata.digit(c) if c.isdecimal() else 48


def _in_script(kind, old, new):
    """`new`, each digit in the script of the digit that was there.

    Octets change their length: each is written in its own script, and an address with an
    octet of several scripts has no pseudonym, as it could not be restored.
    """
    if kind == "ip":
        scripts = [{_zero(c) for c in octet} for octet in old.split(".")]
        if any(len(s) > 1 for s in scripts):
            return None
        octets = zip(scripts, new.split("."))
        return ".".join("".join(chr(min(zero) + int(d)) for d in octet) for zero, octet in octets)
    return "".join(chr(_zero(was) + int(now)) if now in DIGITS else now for was, now in zip(old, new))


def _next_group(hit):
    """Start of the match's second group, or its end if it has one only."""
    border = re.search("[ -]", hit.group())
    return hit.start() + border.end() if border else hit.end()


class Pseudonyms:
    """Finds and replaces; `back` reverses what the same key replaced."""

    def __init__(self, key: bytes, back: bool = False):
        permute = Permutation(key)
        # the same value comes up again and again; the memory of it is bounded
        self.replace = lru_cache(1 << 16)(lambda kind, text: RULES[kind](text, permute, back))

    def findings(self, text):
        """(kind, start, end, pseudonym) by start, without overlaps."""
        plain = text if text.isascii() else text.translate(_other_digits())
        taken, starts = [], []
        for kind, pattern in SEARCHES[0 if "@" in text else 1 :]:
            hit = PATTERNS[pattern].search(plain)
            while hit:
                start = hit.start()
                after = _next_group(hit) if pattern in GROUPED else hit.end()
                for end in _ends(pattern, hit):
                    place = bisect_left(starts, end)
                    if place and taken[place - 1][2] > start:
                        continue
                    old, new = text[start:end], self.replace(kind, plain[start:end])
                    if new is not None and not old.isascii():
                        new = _in_script(kind, old, new)
                    if new is not None:
                        starts.insert(place, start)
                        taken.insert(place, (kind, start, end, new))
                        after = end
                        break
                hit = PATTERNS[pattern].search(plain, after)
        return taken

    def __call__(self, text):
        """The new text and the findings."""
        found, out, last = self.findings(text), [], 0
        for _, start, end, new in found:
            out += [text[last:start], new]
            last = end
        return "".join([*out, text[last:]]), found


def _rows(key, back, column):
    def rewrite(batches):
        worker = Pseudonyms(key, back)
        for batch in batches:
            done = [(None, []) if t is None else worker(t) for t in batch.column(column).to_pylist()]
            yield batch, done

    return rewrite


def pseudonyms(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, text (rewritten), n_<kind> for each kind, spans (kind:start:end
    of the findings in the old text, in code points, comma-joined)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rewrite = _rows(key, False, 1)

    def run(batches):
        for batch, done in rewrite(batches):
            counts = [[sum(f[0] == k for f in found) for _, found in done] for k in KINDS]
            spans = [",".join(f"{k}:{s}:{e}" for k, s, e, _ in found) for _, found in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([t for t, _ in done], pa.string()),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(spans, pa.string()),
                ],
                ["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, {', '.join(f'n_{k} long' for k in KINDS)}, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_column)


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False, text_column: str = "text") -> DataFrame:
    """The documents, all columns, with the text rewritten (or, with `back`, restored)."""
    at = docs.columns.index(text_column)
    rewrite = _rows(key, back, at)

    def run(batches):
        for batch, done in rewrite(batches):
            yield batch.set_column(at, batch.schema.field(at), pa.array([t for t, _ in done], batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)
