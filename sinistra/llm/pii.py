"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs,
digits, scheme separators and identifier cues. From each anchor a deterministic
local parser finds the boundaries of what stands there and validates it:

* email, ip, card, phone: the base kinds (leftmost, not overlapping by kind; an
  ip's parts are at most 255, a card has 12 to 19 digits and passes Luhn, a
  phone has 9 to 15 digits; what fails is dropped without another try);
* url: an address with credentials, ``scheme://user[:password]@host...``;
* account: a number of 6 to 34 digits, or an IBAN with valid check digits,
  after a cue such as ``account`` or ``IBAN``;
* secret: the value (16 signs or more, with a digit) that ``token``,
  ``password``, ``secret`` or ``api_key`` is set to.

Spans count code points, end exclusive, and are ordered by start, then by kind
in the order above.

Edge cases: a null or empty text has no spans (``redact`` keeps a null); very
long runs of digits or letters are parsed once, in linear time; repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"(?:https?|ftp|sftp|ssh|postgres|mysql|mongodb|redis|amqp)\Z", re.I)
_USER = re.compile(r"[^\s/@<>\"']{1,256}@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"')\]]*)?")
_ACCOUNT = re.compile(r"(?:\s?(?:no\.?|number|nr\.?|#))?[\s:=#]{1,3}((?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})|[0-9](?:[ -]?[0-9]){5,33})(?![A-Za-z0-9])", re.I)
_SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{16,})")
_CUES = {"account": ("account", "acct", "iban", "konto", "compte", "cuenta", "passport"), "secret": ("token", "password", "passwd", "secret", "api_key", "apikey")}


def anchors():
    """The automaton: each pattern's payload is (its action, its length)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for action, cues in _CUES.items():
        for c in cues:
            for v in {c, c.capitalize(), c.upper()}:
                a.add_word(v, (action, len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def _iban(text: str) -> bool:
    t = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in one text."""
    out: list[tuple[str, int, int]] = []
    email = ip = card = phone = other = 0  # where the next match of a kind may start
    for end, (action, size) in automaton.iter(text):
        i = end - size + 1
        if action == "digit":
            if i >= ip:
                m = _IP.match(text, i)
                if m:
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        out.append(("ip", i, ip))
                else:  # no later digit of this run can do better
                    ip = _DIGITS.match(text, i).end()
            if i >= card:
                m = _CARD.match(text, i)
                card = m.end() if m else i + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", i, card))
        elif action == "at":
            j = i
            while j > email and text[j - 1] in _LOCAL:
                j -= 1
            m = _DOMAIN.match(text, i + 1) if j < i else None
            if m:
                email = m.end()
                out.append(("email", j, email))
        elif action == "plus":
            m = _PHONE.match(text, i) if i >= phone else None
            if m:
                phone = m.end()
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append(("phone", i, phone))
        elif i >= other:
            span = None
            if action == "scheme":
                s, m = _SCHEME.search(text, max(other, i - 8), i), _USER.match(text, end + 1)
                if s and m and not (s.start() and text[s.start() - 1].isalnum()):
                    span = ("url", s.start(), m.end())
            elif not (i and (text[i - 1].isalnum() and action == "account")):
                m = (_ACCOUNT if action == "account" else _SECRET).match(text, end + 1)
                if m and (any(map(str.isdigit, m.group(1))) if action == "secret" else not m.group(1)[0].isalpha() or _iban(m.group(1))):
                    span = (action, m.start(1), m.end(1))
            if span:
                out.append(span)
                other = span[2]
    out.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        automaton = anchors()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py(), automaton)] for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return id_text(docs).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by ``<kind>``; spans that overlap are
    one, named after the first."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        kind, lo, hi = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < hi:
            hi = max(hi, spans[k][2])
            k += 1
        out += [text[at:lo], f"<{kind}>"]
        at = hi
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with the personal data in ``text`` masked (and
    ``n_chars``, if there, counted anew)."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        automaton = anchors()
        return pd.Series([t if t is None else mask(t, find_spans(t, automaton)) for t in texts], dtype=object)

    out = docs.withColumn("text", masked(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
