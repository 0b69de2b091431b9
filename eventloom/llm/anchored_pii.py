"""Personal data by anchor expansion: one automaton pass finds anchors, local parsers expand and check the bounds.

The Aho-Corasick automaton holds at-signs, plus signs, digits, address schemes and cues that announce an
identifier.  Each anchor is handed to a deterministic parser that looks at its surroundings only.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from eventloom.llm.common import map_texts
from eventloom.llm.spans import Span, joined

KINDS = ("email", "ip", "card", "phone", "account", "address")
BASE_KINDS = KINDS[:4]

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
HOST = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
#: Schemes whose address names a person or holds a login, and cues of account numbers; matched in either case.
SCHEMES = ("ftp://", "http://", "https://", "mailto:", "sftp://", "sip:", "ssh://", "tel:")
CUES = ("account", "acct", "iban", "konto", "passport", "ssn")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in sorted(DIGITS)), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def run_right(text: str, at: int, chars: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def run_left(text: str, at: int, chars: frozenset[str], floor: int) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """Expand an at-sign: the local part to its left, dotted labels to its right."""
    start = run_left(text, at, LOCAL, floor)
    end = run_right(text, at + 1, HOST)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := run_right(text, end + 1, HOST)) > end + 1:
        end, dots = more, dots + 1
    return (start, end, True) if dots else None


def ip_at(text: str, start: int) -> tuple[int, int, bool] | None:
    """Four runs of digits joined by dots from the first digit of a run; the flag tells whether all are at most 255."""
    at, parts = start, []
    for i in range(4):
        if i:
            if at >= len(text) or text[at] != ".":
                return None
            at += 1
        end = run_right(text, at, DIGITS)
        if end == at:
            return None
        parts.append(text[at:end].lstrip("0"))
        at = end
    return start, at, all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def card_at(text: str, start: int) -> tuple[int, int, bool] | None:
    """Digits with at most one blank or hyphen between two of them."""
    at, n = start + 1, len(text)
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    if at == start + 1:
        return None
    digits = text[start:at].replace(" ", "").replace("-", "")
    return start, at, 12 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, plus: int) -> tuple[int, int, bool] | None:
    """A plus sign, a digit, at least one more sign of a number and a digit at the end."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = run_right(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:
        return None
    return plus, end, 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def iban_ok(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


#: Signs that may stand between two characters of an account number, and the most characters it has.
GAP, IBAN_MOST = 4, 34


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """A checked account number after a cue: an IBAN with a right remainder, or a three-two-four digit number.

    Between two characters of an IBAN stand up to GAP blanks or hyphens; a wider gap ends it.
    """
    at = run_right(text, at, frozenset(" :#.=")) if at < len(text) else at
    chars: list[tuple[int, str]] = []
    for i in range(at, len(text)):
        c = text[i]
        if c in ALNUM:
            chars.append((i, c))
            if len(chars) == IBAN_MOST:
                break
        elif c not in " -" or not chars or i - chars[-1][0] > GAP:
            break
    plain = "".join(c for _, c in chars).upper()
    for size in range(len(plain), 14, -1):
        if iban_ok(plain[:size]):
            return at, chars[size - 1][0] + 1
    piece = text[at : at + 11]
    if len(piece) == 11 and piece[3] == piece[6] == "-" and all(c in DIGITS for c in piece[:3] + piece[4:6] + piece[7:]) and (at + 11 == len(text) or text[at + 11] not in ALNUM):
        return at, at + 11
    return None


class Addresses:
    """The rest of an address after its scheme; what is known of a run of signs is kept, so that many schemes in one run cost no more."""

    def __init__(self, text: str):
        self.text = text
        self.end = self.body = -1
        self.head = -1
        self.sign = -1
        self.dotted = False
        self.digits: list[int] = []

    def _at(self, at: int) -> None:
        text = self.text
        if at > self.end or self.end < 0:
            stop = re.compile(r"[\x00-\x20<>\"']").search(text, at)
            self.end = stop.start() if stop else len(text)
            self.body = at + len(text[at : self.end].rstrip(".,;:!?)"))
            self.head = -1
            self.digits = [m.start() for m in re.compile("[0-9]").finditer(text, at, self.body)]
        if self.head < at:
            slash = text.find("/", at, self.body)
            self.head = slash if slash >= 0 else self.body
            self.sign = text.rfind("@", at, self.head)
            self.dotted = self.sign >= 0 and text.find(".", self.sign + 1, self.head) >= 0

    def after(self, at: int, begin: int) -> tuple[int, int] | None:
        """An address that holds a login (user@ or user:word@) or a number (tel:); plain links are no personal data."""
        self._at(at)
        if self.body < at:
            return None
        if self.text[begin:at].lower() == "tel:":
            return (begin, self.body) if 7 <= len(self.digits) - bisect.bisect_left(self.digits, at) <= 15 else None
        return (begin, self.body) if self.sign > at and self.dotted else None


def find_spans(text: str, anchors) -> list[Span]:
    """All spans of a text; a kind's matches are leftmost and do not overlap, failing ones are passed over whole."""
    out: list[Span] = []
    floor, addresses = dict.fromkeys(KINDS, 0), Addresses(text)

    def take(kind: str, got: tuple[int, int, bool] | None) -> None:
        if got:
            floor[kind] = got[1]
            if got[2]:
                out.append((got[0], got[1], kind))

    folded = text.lower()
    if len(folded) != len(text):  # a few letters grow when folded
        folded = "".join(c.lower() if c.isascii() else c for c in text)
    for last, (kind, size) in anchors.iter(folded):
        first = last - size + 1
        if kind == "at":
            if first >= floor["email"]:
                take("email", email_at(text, first, floor["email"]))
        elif kind == "plus":
            if first >= floor["phone"]:
                take("phone", phone_at(text, first))
        elif kind == "digit":
            # the first digit of a run, or of what an earlier match has left of it
            fresh = first == 0 or text[first - 1] not in DIGITS
            if first >= floor["card"] and (fresh or first == floor["card"]):
                take("card", card_at(text, first))
            if first >= floor["ip"] and (fresh or first == floor["ip"]):
                take("ip", ip_at(text, first))
        elif kind == "scheme":
            got = addresses.after(last + 1, first)
            if got and first >= floor["address"]:
                take("address", (*got, True))
        elif first >= floor["account"] and (got := account_after(text, last + 1)):
            take("account", (*got, True))
    return out


def find_personal(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every whole text.

    Columns: ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``n_account``, ``n_address``, ``base_spans`` (the first
    four kinds) and ``spans`` (kind:start:end in code points, end exclusive).  Accounts follow a cue and pass their
    check; addresses hold a login or a number.  Null and empty texts have no spans.  Rows are judged alone: repeated
    rows repeat, an empty table gives no rows, other columns are not read.
    """

    def start() -> Callable:
        anchors = automaton()

        def one(value: str | None) -> tuple:
            spans = find_spans(value, anchors) if value else []
            n = [sum(k == kind for *_, k in spans) for kind in KINDS]
            return *n, joined([s for s in spans if s[2] in BASE_KINDS], KINDS), joined(spans, KINDS)

        return one

    made = "n_email long, n_ip long, n_card long, n_phone long, n_account long, n_address long, base_spans string, spans string"
    return map_texts(documents, [doc_id], text, made, start)
