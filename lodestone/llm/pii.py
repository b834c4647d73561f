"""Format-preserving pseudonyms for private data.

Candidates are found by pattern and validated (check digits, ranges, calendar);
what passes is permuted by a keyed Feistel network within the set of values of
its own format. Phones and addresses of the right form outside the ranges that
are given out are permuted among themselves; 127.0.0.1 stays. So a card stays a card with a right check digit, a date stays a
date, and equal values get equal pseudonyms in all documents. The permutation
is one-to-one and can be undone with the key.

kinds: email (local part), phone (digits after the country code), card, ssn,
iban, ip (of both versions), date, secret (access keys, tokens of known form, long
hexadecimal numbers, and what is given under a name that ends in password, secret,
token, key or the like, up to the closing quote or the next blank). Letters and
digits change, signs stay; letters are those of ASCII, Latin-1, Greek and Cyrillic,
others stay as they are. Not taken for a secret: a lone word without digits, of less
than 16 characters, after ``key:``, ``token:`` or ``secret:`` in running text, and
values of under 6 characters after such a name (after a password's, all are). An
address of version 6 in mixed case comes out in lower case.

Edge cases: a null text stays null with nothing found; an empty text likewise;
very long texts and secrets of any length are handled whole; rows that repeat get the same result; an empty table gives no rows; only doc_id
and text are read unless ``carry`` names more.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded, tidy

ROUNDS = 8
#: Characters of a secret that are permuted at once.
PART = 512
#: For tests and demonstrations only; a production run passes its own.
DEMO_KEY = b"lodestone demonstration key"
LOCALHOST = 127 << 24 | 1
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Names that end so say that a secret follows; the first kind needs no further sign.
_PASSWORD, _KEYLIKE = "password|passwd|passphrase|pwd", "secret|token|key|credential"

_KINDS = {
    # one start for each run of local characters, so long runs are read once
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]{1,63}+\.){1,8}[^\W\d_]{2,24}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)",
    "iban": r"(?<!\w)[A-Za-z]{2}\d{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?!\w)",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w|\.\d)",
    # a name, a sign, and all up to the closing quote or, unquoted, to the next blank
    "credential": rf"(?<![A-Za-z0-9_-])[\"']?[A-Za-z0-9_-]*?(?i:{_PASSWORD}|{_KEYLIKE})[\"']?[ ]?(?:=>|[=:])[ ]?(?:\"[^\"\n]+\"|'[^'\n]+'|[^\s\"']+(?<![.,;:)\]}}>]))",
    "secret": r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}|[0-9a-f]{32,}|[0-9A-F]{32,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|sk-[\w-]{20,}|AIza[\w-]{30,})(?!\w)",
}
PATTERN = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in _KINDS.items()))
#: What else may begin where a kind's form is found that turns out not to be valid.
_LATER = {kind: [(k, re.compile(_KINDS[k])) for k in list(_KINDS)[i + 1 :]] for i, kind in enumerate(_KINDS)}
#: The same forms alone, each with the part that stays.
_TOKEN = re.compile(r"((?:AKIA|ASIA)(?=[A-Z0-9]{16}\Z)|(?=[0-9a-f]{32,}\Z)|(?=[0-9A-F]{32,}\Z)|gh[pousr]_(?=[A-Za-z0-9]{30,}\Z)|github_pat_(?=\w{20,}\Z)|glpat-(?=[\w-]{20,}\Z)|xox[abprs]-(?=[\w-]{10,}\Z)|sk-(?=[\w-]{20,}\Z)|AIza(?=[\w-]{30,}\Z))(.+)")
#: Letters that are permuted among themselves, besides digits.
_ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])),
    "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(map(chr, range(0x3B1, 0x3CA))), "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA)])),
]
_SETS = {c: a for a in _ALPHABETS for c in a}


class Feistel:
    """A keyed permutation of range(n) for any n."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = key if len(key) <= 64 else hashlib.blake2b(b"long key|" + key).digest()

    def _f(self, tweak: bytes, i: int, value: int, n: int) -> int:
        raw = value.to_bytes((value.bit_length() + 8) // 8, "big")
        size = n.bit_length() // 8 + 9  # far more than n: no bias
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(b"%d|%d|" % (i, block) + tweak + b"|" + raw, key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:size], "big") % n

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:  # walk the cycle until it is back within range
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if i % 2 == 0:
                    left = (left + (-1 if back else 1) * self._f(tweak, i, right, a)) % a
                else:
                    right = (right + (-1 if back else 1) * self._f(tweak, i, left, b)) % b
            x = left * b + right
            if x < n:
                return x

    def within(self, x: int, n: int, tweak: bytes, valid, back: bool = False) -> int:
        """Permutes the values of range(n) that ``valid`` holds for."""
        while True:
            x = self.permute(x, n, tweak, back)
            if valid(x):
                return x


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_rest(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban_ok(value: str) -> bool:
    whole = value.replace(" ", "").upper()
    return re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", whole) is not None and 98 - _iban_rest(whole[:2], whole[4:]) == int(whole[2:4])


def _refill(text: str, chars: str) -> str:
    """text with its letters and digits replaced in turn by chars."""
    it = iter(chars)
    return "".join(next(it) if c in _SETS else c for c in text)


def _phone_ok(x: int) -> bool:  # numbers of the North American plan
    return x // 10**9 >= 2 and x // 10**6 % 10 >= 2


def _ip_ok(x: int) -> bool:
    top = x >> 24
    return 1 <= top <= 223 and top != 127


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 1 <= area <= 899 and area != 666 and group > 0 and serial > 0


def _chained(text: str, tweak: bytes, back: bool, one) -> str:
    """``one(part, tweak)`` for each ``PART`` characters of text; from the second
    part on, the tweak also holds a hash of what came before, so values that
    start alike still differ in all later parts."""
    out, seen = [], b""
    for at in range(0, len(text), PART):
        part = text[at : at + PART]
        new = one(part, tweak + seen)
        seen = b"|" + hashlib.blake2b(seen + (new if back else part).encode(), digest_size=16).digest()
        out.append(new)
    return "".join(out)


def _by_class(net: Feistel, text: str, tweak: bytes, back: bool) -> str:
    """Permutes letters among letters and digits among digits, lengths kept."""
    return _chained(text, tweak, back, lambda part, t: _class_part(net, part, t, back))


def _class_part(net: Feistel, text: str, tweak: bytes, back: bool) -> str:
    own = [c for c in text if c in _SETS]
    sets = [_SETS[c] for c in own]
    x, n = 0, 1
    for c, s in zip(own, sets, strict=True):
        x, n = x * len(s) + s.index(c), n * len(s)
    x, out = net.permute(x, n, tweak, back), []
    for s in reversed(sets):
        x, r = divmod(x, len(s))
        out.append(s[r])
    return _refill(text, "".join(reversed(out)))


def _base(text: str, alphabet: str) -> int:
    x = 0
    for c in text:
        x = x * len(alphabet) + alphabet.index(c)
    return x


def _digits(x: int, size: int, alphabet: str = "0123456789") -> str:
    out = []
    for _ in range(size):
        x, r = divmod(x, len(alphabet))
        out.append(alphabet[r])
    return "".join(reversed(out))


def _phone_parts(value: str) -> tuple[str, str, str]:
    """The country code, what follows it, and the digits of that."""
    plus = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    if not plus and value.startswith("+"):
        plus = re.match(r"\+1(?=\d{10}$)|\+\d\d", value)
    head = plus.group() if plus else ""
    body = value[len(head) :]
    return head, body, "".join(c for c in body if c.isdigit())


_CREDENTIAL = re.compile(r"([\"']?[A-Za-z0-9_-]*?[\"']?[ ]?(?:=>|[=:])[ ]?[\"']?)(.+?)([\"']?)", re.S)
_SURE = re.compile(rf"(?i:[\"']?[A-Za-z0-9_-]*?(?:{_PASSWORD})[\"']?[ ]?(?:=>|[=:]))")


def _says_secret(head: str, body: str) -> bool:
    """Whether what follows a name is a secret: after a password's always; after
    a key, token or secret a lone word of running text (``the key: patience``) is not."""
    if _SURE.match(head):
        return True
    digit, prose = any(c.isdigit() for c in body), head.endswith(": ") and not head.lstrip().startswith(("\"", "'"))
    if len(body) < (6 if digit else 8) or " " in body and not digit:
        return False
    return digit or len(body) >= 16 or not prose and re.search("(?i)(?:[_-]|api|access|secret|auth)(?:key|token|secret|credential)", head) is not None


def _walk(value: str, step, valid) -> str:
    """A permutation of values, kept to those that are ``valid``."""
    while True:
        value = step(value)
        if valid(value):
            return value


def pseudonym(net: Feistel, kind: str, value: str, back: bool = False) -> str | None:
    """The value's pseudonym, or None if the value is not valid."""
    if kind == "credential":
        head, body, tail = _CREDENTIAL.fullmatch(value).groups()
        if not _says_secret(head, body):
            return None
        if _TOKEN.fullmatch(body):  # the same pseudonym as without a name before it
            return head + pseudonym(net, "secret", body, back) + tail
        return head + _walk(body, lambda v: _by_class(net, v, b"credential", back), lambda v: not _TOKEN.fullmatch(v)) + tail
    only = "".join(c for c in value if c.isascii() and c.isdigit())
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{_by_class(net, local, b'email' + domain.lower().encode(), back)}@{domain}"
    if kind == "card":
        if not 13 <= len(only) <= 19 or not luhn(only) or len(set(only)) == 1 or {" ", "-"} <= set(value):
            return None  # numbers that stand side by side are separated in more than one way
        first, middle = only[0], only[1:-1]
        middle = _digits(net.permute(int(middle), 10 ** len(middle), b"card" + first.encode(), back), len(middle))
        return _refill(value, next(first + middle + c for c in "0123456789" if luhn(first + middle + c)))
    if kind == "ssn":
        x = int(only)
        return _refill(value, _digits(net.within(x, 10**9, b"ssn", _ssn_ok, back), 9)) if _ssn_ok(x) else None
    if kind == "phone":
        head, body, only = _phone_parts(value)
        if not 7 <= len(only) <= 13:
            return None
        if head in ("+1", "") and len(only) == 10:
            if not _phone_ok(int(only)):
                return None
            return head + _refill(body, _digits(net.within(int(only), 10**10, b"phone+1", _phone_ok, back), 10))
        return head + _refill(body, _digits(net.permute(int(only), 10 ** len(only), b"phone" + head.encode(), back), len(only)))
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, net.within(x, 1 << 32, b"ip", _ip_ok, back).to_bytes(4, "big"))) if _ip_ok(x) else None
    if kind == "ip6":
        try:
            address = ipaddress.IPv6Address(value)
        except ValueError:
            return None
        if address.is_loopback or address.is_unspecified or not only:
            return None
        # the written digits are permuted where they stand, so the form stays; mixed case becomes lower
        upper = any(c in "ABCDEF" for c in value) and not any(c in "abcdef" for c in value)
        alphabet = "0123456789ABCDEF" if upper else "0123456789abcdef"
        digits = "".join(c for c in (value if upper else value.lower()) if c != ":")

        def step(own: str) -> str:
            return _digits(net.permute(_base(own, alphabet), 16 ** len(own), b"ip6" + alphabet[-1:].encode(), back), len(own), alphabet)

        def written(own: str) -> str:
            it = iter(own)
            return "".join(c if c == ":" else next(it) for c in value)

        def valid(own: str) -> bool:
            a = ipaddress.IPv6Address(written(own))
            return any(c.isdigit() for c in own) and not a.is_loopback and not a.is_unspecified and (not upper or any(c in "ABCDEF" for c in own))

        return written(_walk(digits, step, valid))
    if kind == "iban":
        whole = value.replace(" ", "").upper()
        country, rest = whole[:2], whole[4:]
        if not _iban_ok(value):
            return None
        rest = _by_class(net, rest, b"iban" + country.encode(), back)
        new = _refill(value, f"{country}{98 - _iban_rest(country, rest):02d}{rest}")
        return "".join(c.lower() if old.islower() else c for c, old in zip(new, value, strict=True))
    if kind == "date":
        sign = next(c for c in value if not c.isdigit())
        a, b, c = map(int, value.split(sign))
        first = a > 31  # the year
        orders = [(a, b, c)] if sign == "-" or first else [(c, a, b), (c, b, a)] if sign == "/" else [(c, b, a)]
        for i, order in enumerate(orders):
            try:
                x = datetime.date(*order).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= x <= LAST_DAY - FIRST_DAY:
                continue
            padded = len(value) == 10
            # a written form must read back the same way
            twin = lambda d: sign == "/" and i == 1 and d.day <= 12  # noqa: E731, B023
            valid = lambda y: not twin(datetime.date.fromordinal(FIRST_DAY + y)) and (padded or len(write(datetime.date.fromordinal(FIRST_DAY + y))) == len(value))  # noqa: E731, B023

            def write(d: datetime.date) -> str:
                if sign == "-" or first:  # noqa: B023
                    return d.isoformat().replace("-", sign)  # noqa: B023
                p, q = (d.month, d.day) if sign == "/" and i == 0 else (d.day, d.month)  # noqa: B023
                return f"{p:02d}{sign}{q:02d}{sign}{d.year:04d}" if padded else f"{p}{sign}{q}{sign}{d.year:04d}"  # noqa: B023

            if not padded and write(datetime.date.fromordinal(FIRST_DAY + x)) != value:
                return None
            return write(datetime.date.fromordinal(FIRST_DAY + net.within(x, LAST_DAY - FIRST_DAY + 1, f"date{sign}{i}{len(value)}{'y' * (sign == '/' and first)}".encode(), valid, back)))
        return None
    if kind == "secret":
        head, body = _TOKEN.fullmatch(value).groups()
        lower, upper = re.fullmatch("[0-9a-f]+", value), re.fullmatch("[0-9A-F]+", value)
        alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" if head in ("AKIA", "ASIA") else "0123456789abcdef" if lower else "0123456789ABCDEF" if upper else None
        if alphabet is None:
            return _walk(value, lambda v: head + _by_class(net, v[len(head) :], b"secret" + head.encode(), back), lambda v: _TOKEN.fullmatch(v)[1] == head)
        part = lambda own, tweak: _digits(net.permute(_base(own, alphabet), len(alphabet) ** len(own), tweak, back), len(own), alphabet)
        tweak = b"secret" + head.encode() + (b"upper" if upper and not lower else b"")
        return head + _walk(body, lambda v: _chained(v, tweak, back, part), lambda v: head or not _iban_ok(v) and (lower or not v.isdigit()))
    raise ValueError(kind)


def outside(net: Feistel, kind: str, value: str, back: bool = False) -> str | None:
    """The pseudonym of a well-formed phone or address outside the ranges that
    ``pseudonym`` takes, from the same rest of its format; None for all else."""
    if kind == "phone":
        head, body, only = _phone_parts(value)
        if head not in ("+1", "") or len(only) != 10 or _phone_ok(int(only)):
            return None
        return head + _refill(body, _digits(net.within(int(only), 10**10, b"phone+1", lambda y: not _phone_ok(y), back), 10))
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        rest = lambda y: not _ip_ok(y) and y != LOCALHOST
        x = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, net.within(x, 1 << 32, b"ip", rest, back).to_bytes(4, "big"))) if rest(x) else None
    return None


def replace_all(net: Feistel, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the input."""
    out, found, at = [], [], 0
    pos = 0
    while m := PATTERN.search(text, pos):
        kind, new = m.lastgroup, None
        for kind, m in [(m.lastgroup, m), *((k, form.match(text, m.start())) for k, form in _LATER[m.lastgroup])]:
            if m is not None:
                begin, end = m.span()
                new = pseudonym(net, kind, m.group(), back)
                new = outside(net, kind, m.group(), back) if new is None else new
                if new is not None:
                    break
        if new is None:
            # part of it may still be another kind
            pos = begin + 1
            while pos < len(text) and text[pos - 1].isalnum() and text[pos].isalnum():
                pos += 1
            continue
        out += [text[at:begin], new]
        inner, after = map(len, _CREDENTIAL.fullmatch(m.group()).group(1, 3)) if kind == "credential" else (0, 0)
        found.append(("secret" if inner else "ip" if kind == "ip6" else kind, begin + inner, end - after))
        at = pos = end
    return "".join([*out, text[at:]]), found


_MAY_HOLD = re.compile(rf"\d|@|(?i:{_PASSWORD}|{_KEYLIKE})")


def _replacer(key: bytes, carry: list[str]):
    def run(batches):
        net = Feistel(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts, spans = [], []
            for t in b.column("text").to_pylist():
                new, found = replace_all(net, t) if t and _MAY_HOLD.search(t) else (t, [])
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.string()), pa.array(spans, kind)], names=[*carry, "text", "found"])

    return run


def pseudonymise(spark: SparkSession, docs: DataFrame, key: bytes, carry: list[str] | None = None) -> DataFrame:
    """carry (doc_id unless given), text with pseudonyms, and found, an array of
    (kind, start, end) in code points of the input, for each row. Who has the key
    can undo the pseudonyms."""
    bounded(spark)
    carry = ["doc_id"] if carry is None else [c for c in carry if c not in ("text", "found")]
    rows = docs.select(*carry, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidy(_replacer(key, carry)), f"{schema}, found array<struct<kind:string,start:long,end:long>>")
