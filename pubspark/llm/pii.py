"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Found values are checked (Luhn, calendar, octets, mod 97 and so on), turned
into a number below the size of their format's domain, permuted by a balanced
Feistel network with keyed BLAKE2 rounds, walking the cycle until the result
lies in the domain, and written in the same format with valid check digits.
The permutation depends on key, kind and domain only: equal values stay equal
in all documents and different ones stay different. Values that fail their
check are left as they are, and the search goes on after their first group, so
that a number beside a card hides neither it nor other values; cards and IBANs
are tried at every border of groups, the usual groupings of cards first.

Kinds: card (Luhn; the check digit is made anew), phone (international with or
without groups; national as (415) 555-2671 or 415-555-2671), ip, date (ISO, and
day.month.year with . or /; years 1900-2099 stay there; of a timestamp the date), ssn, iban (country
stays, mod 97), email (letters, digits of the local part and of the domain's
labels but the last), secret (32 or more hex digits with a letter and a digit; where
cases are mixed, small and capital letters stay such).

Cases: a null text stays null, an empty one empty; texts without such values
come back unchanged; repeated rows are treated alike; columns other than the
text play no part.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.pubspark.pii.key"  # the session's setting for the key; there is no default, as whoever knows the key can turn pseudonyms back
ROUNDS = 8
KINDS = ["card", "phone", "ip", "date", "ssn", "iban", "email", "secret"]

_FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9A-Za-z]))"
    r"|(?P<phone2>(?<![0-9A-Za-z+])\+(?:[1-9][0-9]{7,14}|[0-9]{1,3}[ .-]?\(?[0-9]{1,5}\)?[ .-]?[0-9]{3,10}(?:[ .-][0-9]{2,4}){0,3}|[0-9]{1,3}[ .-][0-9](?:[ .-][0-9]{2}){4})(?![0-9A-Za-z]))"
    r"|(?P<phone3>(?<![0-9A-Za-z(.-])(?:\([0-9]{3}\)[ -]?[0-9]{3}[ .-]|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)[0-9]{4}(?![0-9A-Za-z-])(?!\.[0-9]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?:(?=T[0-9]{2}:?[0-9]{2})|(?![0-9A-Za-z/-])))"
    r"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<card>(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))"
)
_MAY = re.compile(r"[0-9][ -]?[0-9]|@|[0-9A-Fa-f]{32}")
_GROUP = re.compile(r"(?:[ -]?)([0-9]+)(?![0-9A-Za-z])")
_FIRST = re.compile(r"[^0-9A-Za-z]*[0-9A-Za-z]+")
#: Usual groupings of card numbers, besides a single group.
CARD_FORMS = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 5)]
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")


class Feistel:
    """Keyed permutations of 0..n-1."""

    def __init__(self, key: str | bytes):
        self.key = hashlib.blake2b(key.encode() if isinstance(key, str) else key, digest_size=32).digest()

    def permute(self, x: int, n: int, kind: str, back: bool = False) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, half, f"{kind}:{n:x}", back)
            if x < n:
                return x

    def _once(self, x: int, half: int, tweak: str, back: bool) -> int:
        a, b, mask = x >> half, x & ((1 << half) - 1), (1 << half) - 1
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                a, b = b ^ self._round(a, r, half, tweak) & mask, a
            else:
                a, b = b, a ^ self._round(b, r, half, tweak) & mask
        return a << half | b

    def _round(self, x: int, r: int, half: int, tweak: str) -> int:
        size = (half + 7) // 8
        seed = hashlib.blake2b(f"{tweak}:{r}:".encode() + x.to_bytes(size, "big"), key=self.key, digest_size=min(64, size)).digest()
        if size <= 64:
            return int.from_bytes(seed, "big")
        return int.from_bytes(b"".join(hashlib.blake2b(seed + k.to_bytes(8, "big"), key=self.key).digest() for k in range(-(-size // 64)))[:size], "big")


def luhn_digit(body: str) -> str:
    """The digit that makes body + digit pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(form: str, digits: str) -> str:
    """The form with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _card(f: Feistel, v: str) -> str | None:
    d = re.sub(r"[ -]", "", v)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(f.permute(int(d[:-1]), 10 ** (len(d) - 1), "card")).zfill(len(d) - 1)
    return _refill(v, body + luhn_digit(body))


def _card_end(text: str, start: int) -> int | None:
    """Where the card number that starts here ends, or None.

    An unusual grouping counts only if no usual one begins within it.
    """
    groups, at, n = [], start, 0
    while n < 38 and (m := _GROUP.match(text, at)):
        groups.append((m.start(1), m.end()))
        at, n = m.end(), n + len(m[1])
    digits = [text[a:b] for a, b in groups]

    def valid(i: int, j: int) -> bool:
        d = "".join(digits[i:j])
        return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]

    def usual(i: int) -> int | None:
        sizes = tuple(map(len, digits[i : i + 5]))
        return next((i + len(f) for f in [sizes[:1], *CARD_FORMS] if sizes[: len(f)] == f and valid(i, i + len(f))), None)

    if not groups:
        return None
    if j := usual(0):
        return groups[j - 1][1]
    later = next((i for i in range(1, len(groups)) if usual(i)), len(groups))
    return next((groups[j - 1][1] for j in range(later, 0, -1) if valid(0, j)), None)


def _phone(f: Feistel, v: str) -> str | None:
    country = "" if v[0] != "+" else re.match(r"\+[0-9]+", v)[0]
    if len(country) > 4 or country == v:  # no space after the country's code
        m = _COUNTRY.match(country, 1)
        country = country[: m.end()]
    rest = v[len(country) :]
    d = re.sub(r"[^0-9]", "", rest)
    if not 7 <= len(d) <= 14 or not 8 <= len(d) + len(country) - 1 <= 15 and country:
        return None
    return country + _refill(rest, str(f.permute(int(d), 10 ** len(d), f"phone{country}")).zfill(len(d)))


def _ip(f: Feistel, v: str) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(f: Feistel, v: str) -> str | None:
    form = "%Y-%m-%d" if v[4] == "-" else "%d.%m.%Y" if v[2] == "." else "%d/%m/%Y"
    y, m, d = (v[:4], v[5:7], v[8:]) if v[4] == "-" else (v[6:], v[3:5], v[:2])
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        if form != "%d/%m/%Y":
            return None
        try:  # month first
            day, form = datetime.date(int(y), int(d), int(m)).toordinal(), "%m/%d/%Y"
        except ValueError:
            return None
    low, high, top = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal(), datetime.date.max.toordinal()
    if low <= day < high:
        new = low + f.permute(day - low, high - low, "date")
    else:  # the other years have a domain of their own
        x = f.permute(day - 1 if day < low else day - 1 - (high - low), top - (high - low), "other date") + 1
        new = x if x < low else x + high - low
    at = datetime.date.fromordinal(new)
    return form.replace("%Y", f"{at.year:04}").replace("%m", f"{at.month:02}").replace("%d", f"{at.day:02}")


def _ssn(f: Feistel, v: str) -> str | None:
    valid = lambda a, g, s: a not in (0, 666) and a < 900 and g and s
    if not valid(*map(int, v.split("-"))):
        return None
    x = int(v.replace("-", ""))
    while True:  # walk on until the result is valid too
        x = f.permute(x, 10**9, "ssn")
        if valid(x // 10**6, x // 10**4 % 100, x % 10**4):
            return f"{x // 10**6:03}-{x // 10**4 % 100:02}-{x % 10**4:04}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(f: Feistel, v: str) -> str | None:
    plain = v.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = _classes(f, plain[4:], f"iban{plain[:2]}")
    check = f"{98 - _mod97(body + plain[:2] + '00'):02}"
    it = iter(plain[:2] + check + body)
    return "".join(" " if c == " " else next(it) for c in v)


LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789", "abcdef", "ABCDEF")
PART = 256  # characters of mixed cases that make one number


def _classes(f: Feistel, v: str, kind: str, alphabets: tuple[str, ...] = LETTERS) -> str:
    """Permute the digits and letters of v, each within its class, as one mixed-radix number."""
    sets = [next((s for s in alphabets if c in s), None) for c in v]
    x, n = 0, 1
    for c, s in zip(v, sets, strict=True):
        if s:
            x, n = x * len(s) + s.index(c), n * len(s)
    form = "".join("." if s is None else str(len(s)) for s in sets)
    x = f.permute(x, n, f"{kind}:{form}")
    out = []
    for c, s in zip(reversed(v), reversed(sets), strict=True):
        if s:
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _email(f: Feistel, v: str) -> str | None:
    local, _, domain = v.partition("@")
    labels, _, top = domain.rpartition(".")
    return f"{_classes(f, local, 'local')}@{_classes(f, labels, 'domain')}.{top}"


def _secret(f: Feistel, v: str) -> str | None:
    if v.isdigit() or v.isalpha():
        return None
    if v != v.lower() and v != v.upper():  # part by part, each under what stood before it
        seal = lambda i: hashlib.blake2b(v[:i].encode(), key=f.key, digest_size=16).hexdigest() if i else len(v)
        return "".join(_classes(f, v[i : i + PART], f"mixed{seal(i)}", HEX) for i in range(0, len(v), PART))
    x = f.permute(int(v, 16), 1 << 4 * len(v), "secret")
    return format(x, f"0{len(v)}x" if v == v.lower() else f"0{len(v)}X")


_DO: dict[str, Callable[[Feistel, str], str | None]] = {"card": _card, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "email": _email, "secret": _secret}


def pseudonymise(text: str | None, f: Feistel, counts: dict[str, int] | None = None) -> str | None:
    if not text or not _MAY.search(text):
        return text

    out, done, at = [], 0, 0
    while m := _FIND.search(text, at):
        kind, start, end = m.lastgroup.rstrip("23"), m.start(), m.end()
        if kind == "card":
            ends = [x for x in [_card_end(text, start)] if x]
        elif kind == "iban":
            ends = [end, *(start + x.start() for x in reversed(list(re.finditer(" ", m[0]))))]
        else:
            ends = [end]
        new, end = next(((v, e) for e in ends if (v := _DO[kind](f, text[start:e])) is not None), (None, end))
        if new is None:
            at = _FIRST.match(text, start).end()
            continue
        if counts is not None:
            counts[kind] = counts.get(kind, 0) + 1
        out += [text[done:start], new]
        done = at = end
    return "".join([*out, text[done:]])


def _key(df: DataFrame, key: str | None) -> str:
    key = key or df.sparkSession.conf.get(SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: pass one, or set {SETTING}")
    return key


def pseudonym_column(key: str):
    """A column function of the text: a struct of the new text and, for each kind, the number of values replaced."""
    kind = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)])

    def run(text: pa.Array) -> pa.Array:
        f, new, found = Feistel(key), [], {k: [] for k in KINDS}
        for t in text.to_pylist():
            counts: dict[str, int] = {}
            new.append(pseudonymise(t, f, counts))
            for k in KINDS:
                found[k].append(counts.get(k, 0))
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), *(pa.array(found[k], pa.int64()) for k in KINDS)], kind.names)

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def pseudonymise_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with their texts replaced; n_chars, where there is such a column, follows the new text."""
    new = pseudonym_column(_key(docs, key))(F.col("text"))
    out = docs.withColumn("text", new.getField("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pseudonym_report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the new text and the numbers of values replaced."""
    return docs.select("doc_id", pseudonym_column(_key(docs, key))(F.col("text")).alias("v")).select("doc_id", "v.*")
