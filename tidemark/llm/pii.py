"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value is validated, written as a number below the count of values of its format, permuted under a key and written back.
The permutation depends on the kind, the format and the key alone, so equal values stay equal in all documents, different
ones stay different, and the holder of the key can invert it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Memo

ROUNDS = 10
#: Patterns in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_-]{16,256})(?![A-Za-z0-9+/_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9]|[.-][0-9])",
    "ssn": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "ipv4": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
    "phone": r"(?<![A-Za-z0-9.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9]|[.-][0-9])|(?<![A-Za-z0-9.+-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![A-Za-z0-9]|[.-][0-9])",
}
NUMBERS = [kind for kind in KINDS if kind not in ("email", "secret")]
SIGN_OF_SECRET = re.compile(r"(?i)key|token|secret|passw")


class Feistel:
    """Keyed permutations of range(n) for any n: an alternating network over two halves, walked until it falls below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _draw(self, label: str, turn: int, half: int) -> int:
        data = f"{label}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.shake_256(hashlib.blake2b(data, key=self.key).digest()).digest(16 + half.bit_length() // 8 + 8), "big")

    def permute(self, x: int, n: int, label: str, back: bool = False) -> int:
        low = 1 << ((max(2, n) - 1).bit_length() + 1) // 2
        high = -(-n // low)
        while True:
            left, right = divmod(x, low)
            for turn in range(ROUNDS)[:: -1 if back else 1]:
                if turn % 2:
                    left = (left + (-1 if back else 1) * self._draw(label, turn, right)) % high
                else:
                    right = (right + (-1 if back else 1) * self._draw(label, turn, left)) % low
            x = left * low + right
            if x < n:
                return x


def luhn_digit(digits: str) -> int:
    """The digit that makes ``digits`` and it valid."""
    doubled = [int(d) * (2 - k % 2) for k, d in enumerate(reversed(digits))]
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


class Pseudonyms:
    """Finds values of all kinds in texts and gives their pseudonyms (with ``back``, the values of pseudonyms)."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.each = {kind: re.compile(pattern) for kind, pattern in KINDS.items()}
        self.memo = Memo(lambda item: getattr(self, f"_{item[0]}")(item[1]))
        numbers = "|".join(f"(?:{KINDS[k]})" for k in NUMBERS)
        self.numbers, self.every = re.compile(numbers), re.compile("|".join(f"(?:{p.replace('?P<value>', '?:')})" for p in KINDS.values()))

    def _number(self, x: int, n: int, label: str) -> int:
        return self.feistel.permute(x, n, label, self.back)

    def _signs(self, value: str, kind: str, hexadecimal: bool = False) -> str:
        """Letters stay letters and digits digits, each keeps its case; hexadecimal strings stay so."""
        lower = value.lower()
        sets = [string.hexdigits[:16] if hexadecimal and c in string.hexdigits else string.digits if c.isdigit() else string.ascii_lowercase if c.isascii() and c.isalpha() else c for c in lower]
        x, n = 0, 1
        for c, signs in zip(lower, sets, strict=True):
            x, n = x * len(signs) + signs.index(c), n * len(signs)
        shape = "".join("x" if len(s) == 16 else "9" if len(s) == 10 else "a" if len(s) == 26 else s for s in sets)
        x, made = self._number(x, n, f"{kind}|{shape}"), []
        for signs in reversed(sets):
            x, at = divmod(x, len(signs))
            made.append(signs[at])
        upper = value.isupper()
        return "".join(c.upper() if upper or old.isupper() else c for c, old in zip(reversed(made), value, strict=True))

    @staticmethod
    def _refill(value: str, digits: str) -> str:
        """``digits`` in the places of the digits of ``value``."""
        fresh = iter(digits)
        return "".join(next(fresh) if c.isdigit() else c for c in value)

    def _email(self, value: str) -> str:
        name, _, top = value.rpartition(".")
        local, _, domain = name.partition("@")
        return f"{self._signs(local, 'email')}@{self._signs(domain, 'domain')}.{top}"

    def _secret(self, value: str) -> str:
        return self._signs(value, "secret", all(c in string.hexdigits for c in value))

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        country, rest = plain[:2], plain[4:]
        if len(plain) < 15 or len(plain) > 34 or int("".join(str(int(c, 36)) for c in rest + country + plain[2:4])) % 97 != 1:
            return None
        made = self._signs(rest, f"iban{country}")
        fresh = iter(f"{country}{_iban_check(country, made):02d}{made}")
        return "".join(c if c == " " else next(fresh) for c in value)

    def _card(self, value: str) -> str | None:
        digits = re.sub("[^0-9]", "", value)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = f"{self._number(int(digits[:-1]), 10 ** (len(digits) - 1), f'card{len(digits)}'):0{len(digits) - 1}d}"
        return self._refill(value, f"{body}{luhn_digit(body)}")

    def _ssn(self, value: str) -> str | None:
        def valid(x: str) -> bool:
            return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"

        digits = value.replace("-", "")
        if not valid(digits):
            return None
        while True:
            digits = f"{self._number(int(digits), 10**9, 'ssn'):09d}"
            if valid(digits):
                return self._refill(value, digits)

    def _ipv4(self, value: str) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        return ".".join(map(str, self._number(int.from_bytes(bytes(parts), "big"), 2**32, "ipv4").to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        """Days of 1900 to 2099 stay there, all others outside; slashed dates with the day first keep a day over 12, so they read as before."""
        shape, day_first = ("%Y-%m-%d", False) if value[4] == "-" else ("%d.%m.%Y", False) if value[2] == "." else ("%m/%d/%Y", False)
        if value[2] == "/" and int(value[:2]) > 12:
            shape, day_first = "%d/%m/%Y", True
        try:
            day = datetime.datetime.strptime(value, shape).toordinal()
        except ValueError:
            return None
        first, end = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
        while True:
            if first <= day < end:
                day = first + self._number(day - first, end - first, "date")
            else:
                at = self._number(day - 1 if day < first else day - 1 - (end - first), datetime.date.max.toordinal() - (end - first), "era")
                day = at + 1 if at + 1 < first else at + 1 + end - first
            made = datetime.date.fromordinal(day)
            if not day_first or made.day > 12:
                return shape.replace("%Y", f"{made.year:04d}").replace("%m", f"{made.month:02d}").replace("%d", f"{made.day:02d}")

    def _phone(self, value: str) -> str | None:
        """The country code stays."""
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|", value)[0]
        digits = re.sub("[^0-9]", "", value[len(code) :])
        if not 7 <= len(digits) <= 14:
            return None
        return code + self._refill(value[len(code) :], f"{self._number(int(digits), 10 ** len(digits), f'phone{code}|{len(digits)}'):0{len(digits)}d}")

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, length) of what they replaced."""
        every = "@" in text or SIGN_OF_SECRET.search(text) is not None
        pattern, kinds = (self.every, list(KINDS)) if every else (self.numbers, NUMBERS)
        parts, spans, done, at = [], [], 0, 0
        while found := pattern.search(text, at):
            start = found.start()
            at = start + 1
            for kind in kinds:
                if (match := self.each[kind].match(text, start)) is None:
                    continue
                low, high = match.span("value") if kind == "secret" else match.span()
                if (made := self.memo[kind, text[low:high]]) is not None:
                    parts += [text[done:low], made]
                    spans.append((kind, low, high - low))
                    done = at = high
                    break
        return "".join([*parts, text[done:]]), spans


MAY_HOLD = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """All columns of docs with ``text`` pseudonymised, and ``pii_spans``: array of (kind, start, length) in the old text.

    A null text stays null, with no spans; an empty one stays empty. Whole texts are searched. Equal values get equal
    pseudonyms wherever they stand; numbers that fail their validation stay. A column that is named pii_spans is replaced.
    A permutation has values that it maps to themselves, about one of all. A phone number with a country code and the same
    one without are different values and are not linked.
    """
    kept = [c for c in docs.columns if c != "pii_spans"]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            at, texts, spans = batch.schema.get_field_index("text"), [], []
            for value in batch.column(at):
                text, found = value.as_py(), []
                if text and MAY_HOLD.search(text):
                    text, found = names.replace(text)
                texts.append(text)
                spans.append([{"kind": k, "start": s, "length": n} for k, s, n in found])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], [*batch.schema.names, "pii_spans"])

    chosen = docs.select(*kept)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.mapInArrow(replace, f"{fields}, pii_spans array<struct<kind: string, start: int, length: int>>")
