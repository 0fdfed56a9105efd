"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import map_slices

#: Kinds in the order in which spans are listed; the first four are always reported.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "national_id")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are taken possessively, as a run of digits can end a part at its end only; this keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The longest run that may hold an account number, at each place where one may begin.
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+))")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appel", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "credit", "amex", "visa", "karte", "carte", "tarjeta", "payment"),
    "national_id": ("ssn", "social", "security", "taxpayer", "identity"),
}
#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.95, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "short_card": 0.45, "national_id": 0.4}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right doubled, the digits' sum a multiple of 10."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: letters as 10 to 35, the first four characters last, remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, found from their @: the local part is the run before it, back to the last match at most."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if domain:
            out.append((start, domain.end()))
            low = domain.end()
        at = text.find("@", low)
    return out


def is_ip(span: str) -> bool:
    return all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in span.split("."))


def find_spans(text: str, threshold: float) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of text, in the order of KINDS and then by start; positions are code points."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card" if len(digits) >= 16 else "short_card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    taken = 0
    for m in IBAN.finditer(text):
        start, run = m.start(), m[1]
        if start < taken:
            continue
        for end in range(len(run), 14, -1):  # words in capitals that follow may have been taken too
            if run[end - 1] != " " and text[start + end : start + end + 1] not in ALNUM:
                compact = run[:end].replace(" ", "")
                if len(compact) >= 15 and mod97(compact):
                    taken = start + end
                    found.append(("iban", start, taken))
                    break
    if "-" in text:
        found += [("national_id", m.start(), m.end()) for m in NATIONAL.finditer(text)]
    out = []
    for kind, start, end in found:
        near = text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()
        words = set(re.findall(r"[\w-]+", near))
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in words for w in CONTEXT[kind]))
        if kind in BASE_KINDS or score >= threshold:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """Spans of personal data in each whole text.

    Patterns propose spans; parts of addresses up to 255, Luhn (cards), mod-97 (account numbers) and digit counts
    (phones) confirm them; a word of the kind's context within CONTEXT_CHARS adds to the score. Spans of BASE_KINDS
    are always kept; the others need ``threshold``.

    Returns one row per input row: doc_id and spans, ordered by kind (as in KINDS) and start. A null or empty
    text has no spans; null ids and repeated rows are kept; an empty table gives no rows. Time is linear in the
    length of a text. Columns besides the two are not read.
    """

    def make(rows: dict[str, list]) -> dict[str, object]:
        names = ("kind", "start", "end", "score")
        return {"doc_id": rows["doc_id"], "spans": [[dict(zip(names, s, strict=True)) for s in find_spans(t, threshold)] if t else [] for t in rows["text"]]}

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(thin, make, f"doc_id long, spans {SPANS}")


def mask(text: str, threshold: float) -> str:
    """text with each span of personal data replaced by its kind in brackets; of overlapping spans the first names it."""
    out, at = [], 0
    spans = sorted(find_spans(text, threshold), key=lambda s: (s[1], -s[2]))
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = 0.6) -> DataFrame:
    """docs with personal data in ``text_col`` masked, and ``length_col``, if there is one, set to the new length.

    All other columns pass through as they are. A null text stays null, with its length; an empty text stays
    empty. Rows are neither added nor dropped.
    """
    kind = dict(docs.dtypes)
    has_length = length_col in kind
    schema = ", ".join(f"`{n}` {'string' if n == text_col else t}" for n, t in docs.dtypes)

    def make(rows: dict[str, list]) -> dict[str, object]:
        texts = [mask(t, threshold) if t else t for t in rows[text_col]]
        lengths = {length_col: [n if t is None else len(t) for t, n in zip(texts, rows[length_col], strict=True)]} if has_length else {}
        return rows | {text_col: texts} | lengths

    return map_slices(docs.withColumn(text_col, F.col(text_col).cast("string")), make, schema)
