"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus-digit pairs, digits, URL schemes and
identifier cues. From each anchor a deterministic local parser expands to the span's boundaries and validates it; spans of
a kind are leftmost and don't overlap. The base kinds are email, ip, card and phone; the method adds account numbers
(iban), user-info in URLs (login), cued national or tax identifiers (id) and secrets (secret: cued values, keys with a known
prefix, bearer and signed tokens, private key blocks). All kinds need a validated shape, so that plain words and numbers are
left alone. IPv6 addresses are not looked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "login", "id", "secret")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
#: Words that announce an identifier or a secret.
ID_CUES = ("ssn", "social security", "passport", "tax id", "national id", "driver license", "account number", "account no")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "secret", "password", "passwd", "access_key", "private_key")
KEY_PREFIXES = ("AKIA", "ghp_", "xoxb-", "sk_live_")
_LABEL_RUN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@")
_ID = re.compile(r"(?:\s*(?:no|number|is|was|#)(?![A-Za-z0-9]))*\.?\s*[:=#]?\s*([A-Z]{0,2}[0-9](?:[0-9-]*[0-9])?)(?![0-9A-Za-z])", re.I)
_BEARER = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:[A-Za-z0-9+/=\s:,]|-(?!-))*+-----END \1-----")
_SECRET = re.compile(r"\s*[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_=.-]{12,})")
_KEY = re.compile(r"[A-Za-z0-9_-]{16,}")
_LETTER_OR_DIGIT = re.compile(r"[0-9A-Za-z]")


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Remainder 1 modulo 97 after moving the first four characters to the end."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    cues: dict[str, set[str]] = {"@": {"email"}, "://": {"login"}}
    for d in "0123456789":
        cues.setdefault(d, set()).add("number")
        cues.setdefault("+" + d, set()).add("phone")
    for kind, words in (("id", ID_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.title(), w.capitalize()}:
                cues.setdefault(form, set()).add(kind)
    for w in KEY_PREFIXES:
        cues.setdefault(w, set()).add("key")
    for kind, forms in (("bearer", ("Bearer ", "bearer ")), ("jwt", ("eyJ",)), ("pem", ("-----BEGIN ",))):
        for w in forms:
            cues.setdefault(w, set()).add(kind)
    for word, kinds in cues.items():
        a.add_word(word, (len(word), tuple(sorted(kinds))))
    a.make_automaton()
    return a


class Finder:
    """Finds the spans of one text at a time: a list of (start, end) for each kind, in code points, end exclusive."""

    def __init__(self) -> None:
        self.cues = _automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        if not text:
            return found
        done = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin
        for last, (length, kinds) in self.cues.iter(text):
            for kind in kinds:
                getattr(self, f"_{kind}")(text, last - length + 1, last + 1, found, done)
        return found

    def _email(self, text, start, end, found, done) -> None:
        if start < done["email"] or not (m := _LABEL_RUN.match(text, end)):
            return
        at = start
        while at > done["email"] and text[at - 1] in LOCAL:
            at -= 1
        if at < start:
            found["email"].append((at, m.end()))
            done["email"] = m.end()

    def _number(self, text, start, end, found, done) -> None:
        if start >= done["ip"] and (start == 0 or text[start - 1] not in DIGITS or start == done["ip"]):
            if m := _IP.match(text, start):
                done["ip"] = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                    found["ip"].append(m.span())
            else:
                self._skip(text, start, "ip", done)
        if start >= done["card"]:
            if m := _CARD.match(text, start):
                done["card"] = m.end()
                digits = re.sub("[ -]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if start >= 2 and text[start - 1].isascii() and text[start - 1].isupper() and start >= done["iban"]:
            self._iban(text, start - 2, found, done)

    @staticmethod
    def _skip(text, start, kind, done) -> None:
        """A run of digits that begins no match gives none at a later digit either, as all its starts end alike."""
        at = start
        while at < len(text) and text[at] in DIGITS:
            at += 1
        done[kind] = at

    def _phone(self, text, start, end, found, done) -> None:
        if start >= done["phone"] and (m := _PHONE.match(text, start)):
            done["phone"] = m.end()
            if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                found["phone"].append(m.span())

    def _iban(self, text, start, found, done) -> None:
        if start > 0 and _LETTER_OR_DIGIT.match(text[start - 1]):
            return
        if m := _IBAN.match(text, start):
            for end in range(m.end(), start + 14, -1):  # the longest valid account that ends at a boundary
                if (end == len(text) or not _LETTER_OR_DIGIT.match(text[end])) and text[end - 1] != " " and iban_valid(text[start:end]):
                    found["iban"].append((start, end))
                    done["iban"] = end
                    return

    def _login(self, text, start, end, found, done) -> None:
        if end >= done["login"] and (m := _LOGIN.match(text, end)):
            found["login"].append((end, m.end() - 1))
            done["login"] = m.end()

    def _id(self, text, start, end, found, done) -> None:
        if start > 0 and text[start - 1].isalnum() or start < done["id"]:
            return
        if (m := _ID.match(text, end)) and 6 <= sum(c in DIGITS for c in m[1]) <= 18:
            found["id"].append(m.span(1))
            done["id"] = m.end(1)

    def _secret(self, text, start, end, found, done) -> None:
        if start >= done["secret"] and (m := _SECRET.match(text, end)) and _mixed(m[1]):
            found["secret"].append(m.span(1))
            done["secret"] = m.end(1)

    def _key(self, text, start, end, found, done) -> None:
        if start >= done["secret"] and (start == 0 or not text[start - 1].isalnum()) and (m := _KEY.match(text, start)) and _mixed(m[0]):
            found["secret"].append(m.span())
            done["secret"] = m.end()

    def _whole(self, m, group, text, found, done) -> None:
        if m and m.start(group) >= done["secret"]:
            found["secret"].append(m.span(group))
            done["secret"] = m.end(group)

    def _bearer(self, text, start, end, found, done) -> None:
        if (m := _BEARER.match(text, end)) and _mixed(m[0]):
            self._whole(m, 0, text, found, done)

    def _jwt(self, text, start, end, found, done) -> None:
        if start >= done["secret"] and (start == 0 or not text[start - 1].isalnum()):
            self._whole(_JWT.match(text, start), 0, text, found, done)

    def _pem(self, text, start, end, found, done) -> None:
        if start >= done["secret"]:
            self._whole(_PEM.match(text, start), 0, text, found, done)


def _mixed(s: str) -> bool:
    """Holds letters and at least three digits, as generated keys do and words don't."""
    return sum(c in DIGITS for c in s) >= 3 and any(c.isalpha() for c in s)


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for start, end, kind in sorted(((a, b, k) for k, s in spans.items() for a, b in s), key=lambda x: (x[0], -x[1])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


_finder: list[Finder] = []


def finder() -> Finder:
    """One Finder a worker process."""
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


_SCHEMA = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = finder()
    for batch in batches:
        rows = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = f.spans(value.as_py() or "")
            rows.append((key, *(len(s[k]) for k in BASE), hashlib.sha256(listed(s, BASE).encode()).hexdigest(), listed(s, KINDS), sum(map(len, s.values()))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each row of `docs`.

    Offsets are code points of the whole text, ends exclusive. Null texts count as empty and have no spans; repeated rows
    and null ids stay; other columns are ignored; an empty table gives no rows. Texts of any length are read whole, in time that
    grows with them; spans of one kind are leftmost and don't overlap.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spec = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return rows.mapInArrow(_find, spec).withColumnRenamed("id", id_col)


def redact_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with all spans replaced by their kind in brackets; `length_col`, where there is one, follows the new text.

    Null texts stay null; all rows and all other columns stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder()
        for batch in batches:
            texts = [None if v is None else redact(v, f.spans(v)) for v in (x.as_py() for x in batch.column(text_col))]
            columns = []
            for i, name in enumerate(batch.schema.names):
                if name == text_col:
                    columns.append(pa.array(texts, batch.schema.types[i]))
                elif name == length_col:
                    columns.append(pa.array([None if t is None else len(t) for t in texts], batch.schema.types[i]))
                else:
                    columns.append(batch.column(i))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
