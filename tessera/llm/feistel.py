"""Format-preserving pseudonyms for personal data.

Each value found is validated (Luhn digit, octets, calendar dates), taken apart into
the numbers that its format leaves free, and those are permuted by a keyed Feistel
network on exactly their range. Punctuation, lengths and check digits stay valid, and
a value gets the same pseudonym in every document, so links between documents last.

Covered: e-mail addresses; secrets of 16 signs or more after a word such as token or
api_key, dots included; account numbers (IBAN); phone numbers as (ddd) ddd-dddd,
ddd-ddd-dddd, with dots or single spaces for dashes, +c and groups, +digits; dates as
yyyy-mm-dd (a time may follow), dd.mm.yyyy, dd/mm/yyyy, mm/dd/yyyy where the second number
exceeds 12, 4 July 1985, July 4, 1985; US social security numbers; IPv4 addresses; card
numbers with a right check digit. Not covered: bare runs of digits that aren't cards
(nothing in them can be validated), names and street addresses, IPv6. A date such as
03/04/2001 is taken as day first."""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and the registered query; pass a secret key in production.
DEMO_KEY = b"tessera-demonstration-key"


class Permutation:
    """Keyed permutations of range(size). The tweak keeps kinds and formats apart."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _round(self, tweak: bytes, i: int, x: int, size: int) -> int:
        wanted = 24 + size.bit_length() // 8
        if wanted <= 64:
            raw = hashlib.blake2b(b"%s|%d|%d" % (tweak, i, x), key=self.key, digest_size=wanted).digest()
        else:  # more than one digest holds: as many as it takes, numbered
            data = b"%s|%d|%x" % (tweak, i, x)
            raw = b"".join(hashlib.blake2b(b"%d|%s" % (block, data), key=self.key).digest() for block in range(-(-wanted // 64)))[:wanted]
        return int.from_bytes(raw, "big") % size

    def _sides(self, size: int) -> tuple[int, int]:
        a = math.isqrt(size)
        return a, -(-size // a)

    def forward(self, x: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return x
        a, b = self._sides(size)
        while True:  # walks along the cycle until it is back in the range
            left, right = divmod(x, b)
            for i in range(self.rounds):
                if i % 2:
                    right = (right + self._round(tweak, i, left, b)) % b
                else:
                    left = (left + self._round(tweak, i, right, a)) % a
            x = left * b + right
            if x < size:
                return x

    def backward(self, x: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return x
        a, b = self._sides(size)
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(self.rounds)):
                if i % 2:
                    right = (right - self._round(tweak, i, left, b)) % b
                else:
                    left = (left - self._round(tweak, i, right, a)) % a
            x = left * b + right
            if x < size:
                return x


def luhn_digit(body: str) -> str:
    """The digit that makes body + digit pass the Luhn check."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_NAMED = "(?:" + "|".join(_MONTHS) + ")"
_FIRST, _END = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
#: Signs of a secret that are permuted as one number.
_RUN = 96


@functools.cache
def _late_days() -> tuple[list[int], dict[int, int]]:
    """Days from 1900 to 2099 after the twelfth of their month: written month first, they
    can't be read day first."""
    days = [d for d in range(_FIRST, _END) if datetime.date.fromordinal(d).day > 12]
    return days, {d: i for i, d in enumerate(days)}


class Pseudonyms:
    """encode(text) -> (text, kinds found); decode(text) undoes it."""

    def __init__(self, key: bytes) -> None:
        self.permutation = Permutation(key)
        self.pattern = re.compile(
            r"(?P<email>(?<![A-Za-z0-9.!#$%&'*+/=?^_`{|}~@-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9@]))"
            r"|(?P<secret>\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_/+-][A-Za-z0-9_/+.-]{14,}[A-Za-z0-9_/+-])"
            r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
            r"|(?P<phone>(?<![\w+])\+?1?[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?!\d)|(?<![\w.+-])(?<![0-9] )[0-9]{3}(?P<sep>[-. ])[0-9]{3}(?P=sep)[0-9]{4}(?![\w-]|\.\d| [0-9])|(?<![\w+])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![\w+])\+[1-9][0-9]{7,14}(?![0-9]))"
            r"|(?P<date>(?<![\w./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?!(?!T[0-9]{2}:)[\w/-]|\.\d))"
            rf"|(?P<named>(?<![\w.,-])(?<![0-9] )(?:[1-9]|[12][0-9]|3[01]) {_NAMED} (?:19|20)[0-9]{{2}}(?![\w-])|\b{_NAMED} (?:[1-9]|[12][0-9]|3[01]), (?:19|20)[0-9]{{2}}(?![\w-]))"
            r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
            r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.\d))"
            r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-]\d))"
        )

    def _number(self, kind: str, digits: str, undo: bool, low: int = 0, high: int | None = None) -> str:
        high = 10 ** len(digits) if high is None else high
        move = self.permutation.backward if undo else self.permutation.forward
        return str(low + move(int(digits) - low, high - low, f"{kind}{len(digits)}".encode())).zfill(len(digits))

    def _card(self, text: str, undo: bool) -> str | None:
        """The longest run of whole groups from the start that is a card."""
        ends = [m.start() for m in re.finditer("[ -]", text)] + [len(text)]
        for end in reversed(ends):
            head, rest = text[:end], text[end:]
            digits = re.sub(r"\D", "", head)
            if len(digits) < 13:
                return None
            if not _is_card(digits):
                continue
            # what would be taken for another card when undone, longer or shorter: walk on
            longer = [re.sub(r"\D", "", text[:e]) for e in ends if e > end]
            while True:
                body = self._number("card", digits[:-1], undo)
                digits = body + luhn_digit(body)
                if _is_card(digits) and not any(_is_card(digits + x[len(digits) :]) for x in longer):
                    return _fill(head, digits) + rest
        return None

    def _ip(self, text: str, undo: bool) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        move = self.permutation.backward if undo else self.permutation.forward
        n = move(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, b"ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _day(self, day: datetime.date, undo: bool) -> datetime.date:
        """One permutation of all days for all formats that can show each of them."""
        move = self.permutation.backward if undo else self.permutation.forward
        return datetime.date.fromordinal(_FIRST + move(day.toordinal() - _FIRST, _END - _FIRST, b"date"))

    def _date(self, text: str, undo: bool) -> str | None:
        if "-" in text:
            day = _parsed(text, "%Y-%m-%d")
            return day and self._day(day, undo).strftime("%Y-%m-%d")
        first, second = text[2], text[5]
        if day := _parsed(text, f"%d{first}%m{second}%Y"):
            return self._day(day, undo).strftime(f"%d{first}%m{second}%Y")
        if (day := _parsed(text, f"%m{first}%d{second}%Y")) is None:
            return None
        days, place = _late_days()
        move = self.permutation.backward if undo else self.permutation.forward
        return datetime.date.fromordinal(days[move(place[day.toordinal()], len(days), b"late")]).strftime(f"%m{first}%d{second}%Y")

    def _named(self, text: str, undo: bool) -> str | None:
        words = text.replace(",", "").split(" ")
        month_first = words[0] in _MONTHS
        name, number = (words[0], words[1]) if month_first else (words[1], words[0])
        try:
            day = self._day(datetime.date(int(words[2]), _MONTHS.index(name) + 1, int(number)), undo)
        except ValueError:
            return None
        name = _MONTHS[day.month - 1]
        return f"{name} {day.day}, {day.year}" if month_first else f"{day.day} {name} {day.year}"

    def _ssn(self, text: str, undo: bool) -> str | None:
        area, group, serial = text.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        area_no = int(area) - 1 - (int(area) > 666)
        n = (area_no * 99 + int(group) - 1) * 9999 + int(serial) - 1
        move = self.permutation.backward if undo else self.permutation.forward
        n, serial = divmod(move(n, 898 * 99 * 9999, b"ssn"), 9999)
        area_no, group = divmod(n, 99)
        return f"{area_no + 1 + (area_no + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text: str, undo: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 7 <= len(digits) <= 15:
            return None
        code = re.match(r"\+(\d+)", text)
        # the country code stays: 1 and 7 are whole codes, others have two digits at least
        plain = code and len(code[1]) == len(digits)
        keep = 1 if "(" in text and len(digits) == 11 else 0 if "(" in text or not code else (1 if digits[0] in "17" else 2) if plain else len(code[1])
        return _fill(text, digits[:keep] + self._number("phone", digits[keep:], undo))

    def _iban(self, text: str, undo: bool) -> str | None:
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
            return None
        body = self._letters("iban", flat[4:], undo)
        whole = flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body
        left = iter(whole)
        return "".join(c if c == " " else next(left) for c in text)

    def _letters(self, kind: str, text: str, undo: bool) -> str:
        """Letters and digits permuted as one mixed-radix number; case and other signs stay.
        Case-blind, so that copies in capitals get the same pseudonym."""
        sizes = [10 if c.isdigit() else 26 if c.lower() in _LETTERS else 1 for c in text]
        n, total = 0, 1
        for c, s in zip(text, sizes, strict=True):
            n = n * s + (int(c) if s == 10 else _LETTERS.index(c.lower()) if s == 26 else 0)
            total *= s
        move = self.permutation.backward if undo else self.permutation.forward
        n = move(n, total, kind.encode() + bytes(sizes))
        out = []
        for c, s in zip(reversed(text), reversed(sizes), strict=True):
            n, d = divmod(n, s)
            new = str(d) if s == 10 else _LETTERS[d] if s == 26 else c
            out.append(new.upper() if c.isupper() and s == 26 else new)
        return "".join(reversed(out))

    def _email(self, text: str, undo: bool) -> str:
        local, domain = text.rsplit("@", 1)
        host, _, end = domain.rpartition(".")
        return f"{self._letters('mail', local, undo)}@{self._letters('host', host, undo)}.{end}"

    def _secret(self, text: str, undo: bool) -> str:
        value = re.search(r"[A-Za-z0-9_/+.-]{16,}$", text)[0]
        runs = [value[i : i + _RUN] for i in range(0, len(value), _RUN)]
        return text[: -len(value)] + "".join(self._letters(f"secret{i}" if i else "secret", x, undo) for i, x in enumerate(runs))

    def _run(self, text: str, undo: bool) -> tuple[str, list[str]]:
        kinds: list[str] = []

        def put(m: re.Match) -> str:
            new = getattr(self, f"_{m.lastgroup}")(m[0], undo)
            if new is None:
                return m[0]
            kinds.append(m.lastgroup)
            return new

        return self.pattern.sub(put, text), kinds

    def encode(self, text: str) -> tuple[str, list[str]]:
        return self._run(text, False)

    def decode(self, text: str) -> str:
        return self._run(text, True)[0]


def _parsed(text: str, form: str) -> datetime.date | None:
    try:
        return datetime.datetime.strptime(text, form).date()
    except ValueError:
        return None


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _mod97(text: str) -> int:
    """Remainder of an account number whose letters count from 10."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced one by one."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


_MAY_HOLD = re.compile(r"[0-9@]").search


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """One row per document: doc_id, n_found, kinds (distinct, sorted, by comma), text
    (the whole text with pseudonyms) and text_sha256. A null text counts as empty; numbers
    that fail their check, dates that aren't in the calendar or octets over 255 stay as
    they are. Very long texts are read whole, and values of any length are handled whole.
    Repeated rows come out alike; an empty table gives no rows."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonyms(key)
        for b in stream:
            texts, counts, kinds, shas = [], [], [], []
            for t in b.column(1).to_pylist():
                found: list[str] = []
                if _MAY_HOLD(t) or "=" in t or ":" in t:
                    t, found = tool.encode(t)
                texts.append(t)
                counts.append(len(found))
                kinds.append(",".join(sorted(set(found))))
                shas.append(hashlib.sha256(t.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(shas, pa.string())], names=["doc_id", "n_found", "kinds", "text", "text_sha256"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {doc_id}, n_found long, kinds string, text string, text_sha256 string")
