"""Personal data: regular expressions propose spans, checksums confirm, nearby words adjust the score.

One Arrow pass over whole texts, no shuffle. Base kinds (email, ip, card, phone) follow fixed
patterns. The method adds spans of its own: IBANs that pass mod-97, keys of known formats, values that are
assigned to a name such as password or token, and local phone numbers and national ids that words nearby
speak for. A base span is never withdrawn: its score says how sure it is.

Defined results: a null or empty text has no spans; repeated rows give repeated results; ids may be null.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidejoin.llm.text import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Characters before and after a span in which context words count.
NEAR = 48
#: Score from which a span that the method adds is reported.
LEAST = 0.5

# Fixed patterns of the base kinds.
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins, so longer runs need no retries inside them.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Patterns of the kinds that the method adds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IBAN_GROUP = re.compile(r" ?[A-Z0-9]++(?![a-z])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

# Fixed formats of access keys: cloud key ids, tokens of code hosts and chat services, signed web tokens, private keys.
_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
)
_ASSIGNED = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private)[ _-]?key|contraseña|passwort|kennwort)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([^\s\"',;<>]{8,200})", re.IGNORECASE)

# Letters and digits of an IBAN, by country code.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

# Words that speak for or against a kind.
CONTEXT = {
    "email": ({"mail", "email", "e-mail", "contact", "write", "correo"}, {"example", "noreply"}),
    "ip": ({"ip", "address", "host", "server", "login"}, {"version", "release", "section"}),
    "card": ({"card", "visa", "credit", "payment", "tarjeta", "carte", "karte"}, {"order", "tracking", "isbn", "serial"}),
    "phone": ({"phone", "call", "tel", "mobile", "fax", "contact", "telefon", "teléfono"}, {"serial", "part", "isbn"}),
    "iban": ({"iban", "account", "bank", "konto", "cuenta", "compte"}, {"serial", "code"}),
    "secret": ({"password", "passwd", "pwd", "secret", "token", "key", "login", "credential", "credentials", "auth"}, {"example", "sample", "placeholder", "dummy"}),
    "national_id": ({"ssn", "social", "security", "passport", "id"}, {"part", "serial", "order"}),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3, "local_phone": 0.2, "secret": 0.8, "assigned": 0.3}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the Luhn sum is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the letters and digits of an IBAN leave 1 on division by 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _score(kind: str, text: str, start: int, end: int, of: str | None = None) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    good, bad = CONTEXT[kind]
    return min(1.0, max(0.0, PRIOR[of or kind] + 0.35 * bool(near & good) - 0.3 * bool(near & bad)))


def _ibans(text: str) -> list[tuple[int, int]]:
    """Spans that pass mod-97: of the length that the country fixes or else the longest, for unknown countries the longest that does."""
    out, m = [], _IBAN.search(text)
    while m:
        at, end, bare, ends = m.start(), m.start(), "", []
        while (g := _IBAN_GROUP.match(text, end)) and len(bare) < 34:
            end, bare = g.end(), bare + g[0].lstrip(" ")
            if 15 <= len(bare) <= 34:
                ends.append((end, bare))
        fixed = IBAN_LENGTHS.get(text[at : at + 2])
        ends = [e for e in ends if len(e[1]) == fixed] + (ends[-1:] if fixed else ends[::-1])
        found = next((e for e, bare in ends if mod97(bare)), None)
        if found:
            out.append((at, found))
        m = _IBAN.search(text, found or at + 4)
    return out


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern's finditer, but started at each @, so that long runs of its characters cost no retries."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > floor and text[low - 1] in _EMAIL_CHARS:
            low -= 1
        if low < at and (m := _EMAIL_RIGHT.match(text, at + 1)):
            out.append((low, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds: leftmost matches of each kind, without those that fail its check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text) is None:
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _clear_of(taken: list[Span], found: list[Span]) -> list[Span]:
    """Those of the spans found that overlap none of the spans taken."""
    bounds = sorted((s.start, s.end) for s in taken)
    begins, reach = [a for a, _ in bounds], list(accumulate((b for _, b in bounds), max))
    return [s for s in found if not (i := bisect_left(begins, s.end)) or reach[i - 1] <= s.start]


def _secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, prior) of keys of known formats; and of assigned values that mix letters with digits or other marks."""
    keys, out = [(*m.span(), "secret") for m in _KEY.finditer(text)], []
    for m in _ASSIGNED.finditer(text) if "=" in text or ":" in text else ():
        value = m[1].rstrip(".)")
        if len(value) >= 8 and not value.isalpha() and not value.isdigit():
            out.append((m.start(1), m.start(1) + len(value), "assigned"))
    return keys, out


def find_spans(text: str) -> tuple[list[Span], dict[str, list[tuple[int, int]]]]:
    """All scored spans by kind and start, and the base spans among them."""
    base = base_spans(text)
    spans = [Span(k, a, b, _score(k, text, a, b)) for k in KINDS for a, b in base[k]]
    if _DIGIT.search(text) is not None or "PRIVATE KEY" in text:
        spans += [Span("iban", a, b, _score("iban", text, a, b)) for a, b in _ibans(text)]
        # spans of one pattern do not overlap, so each has to keep clear of what stands from the patterns before alone
        proposed = [[("secret", *x[:2], _score("secret", text, *x)) for x in found] for found in _secrets(text)]
        for kind, pattern, words, prior in (("national_id", _NATIONAL, "national_id", "national_id"), ("phone", _LOCAL, "phone", "local_phone")):
            proposed.append([(kind, *m.span(), _score(words, text, *m.span(), prior)) for m in pattern.finditer(text)])
        for found in proposed:
            spans += _clear_of(spans, [Span(*x) for x in found if x[3] >= LEAST])
    order = {k: i for i, k in enumerate((*KINDS, "iban", "national_id", "secret"))}
    return sorted(spans, key=lambda s: (order[s.kind], s.start)), base


_TYPES = {**{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string(), "kinds": pa.list_(pa.string()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}


def _of_slice(texts: pa.Array) -> dict:
    out: dict[str, list] = {n: [] for n in _TYPES}
    for text in texts.to_pylist():
        spans, base = find_spans(text or "")
        for k in KINDS:
            out[f"n_{k}"].append(len(base[k]))
        out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k]).encode()).hexdigest())
        out["spans"].append(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans))
        for name, i in (("kinds", 0), ("starts", 1), ("ends", 2), ("scores", 3)):
            out[name].append([s[i] for s in spans])
    return {n: pa.array(v, _TYPES[n]) for n, v in out.items()}


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, their digest, and every span with kind, bounds (code points) and score."""
    return map_texts(
        docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, kinds array<string>, starts array<long>, ends array<long>, scores array<double>",
        _of_slice, id_col, text_col,
    )
