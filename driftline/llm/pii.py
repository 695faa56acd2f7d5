"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Every kind has a pattern, a validator and a base score. Words of its own near a
span raise its score, and words for other kinds of numbers lower it; spans below
``THRESHOLD`` are dropped. E-mail addresses, IP addresses, payment cards that
pass Luhn and international phone numbers are certain by their form and
validator: context moves their score, but not below the threshold. National
phone numbers, short cards, social security numbers and secrets need more than
their form, and IBANs (mod 97) stay unless context speaks against them. A span
that overlaps one of the certain kinds gives way to it.

Positions are code points, the end exclusive. Defined cases: a null or empty
text has no spans; rows with equal ids or texts give one row each; an empty
table gives no rows; other columns are kept by ``redact`` and dropped by
``find_spans``. No pattern backtracks over a run of characters, so very long
texts take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import slices, texts_of

SPAN = "struct<kind:string,start:long,end:long,score:double>"
#: Kinds in the order of the results; the first four are certain.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "short_card", "local_phone", "secret")
CERTAIN = 4
THRESHOLD = 0.6
#: Characters on each side of a span in which context words count.
CONTEXT = 48

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])")
_DOTTED = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+")

#: What the words of a kind near a span add to its score, and what words of other numbered things take from it.
RAISE, LOWER = 0.35, 0.35
#: Score before context, and the kind's own words.
_CONTEXT_WORDS = {
    "email": (0.96, "e-?mail|mail|contact|kontakt|correo|courriel"),
    "ip": (0.96, "ip|address|host|server|login"),
    "card": (0.96, "card|visa|amex|credit|debit|karte|carte|tarjeta"),
    "phone": (0.96, "phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono"),
    "iban": (0.9, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (0.4, "ssn|social security|taxpayer"),
    "short_card": (0.4, "card|visa|amex|credit|debit|karte|carte|tarjeta"),
    "local_phone": (0.4, "phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono"),
    "secret": (0.3, "token|secret|password|passwd|api[ _-]?key|bearer|private[ _-]?key|credential"),
}
_CONTEXT_RE = {k: re.compile(rf"(?<![a-z])(?:{words})(?![a-z])", re.IGNORECASE) for k, (_, words) in _CONTEXT_WORDS.items()}
_AGAINST = re.compile(r"(?<![a-z])(?:serial|tracking|isbn|sku|part|model|version|checksum|commit)(?![a-z])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the rest."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN's check digits hold (ISO 7064 mod 97-10)."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at)  # no later match starts before this sign
        at = text.find("@", max(done, at + 1))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs of which a candidate may take in what follows, or hide one that starts inside it."""
    found = _IBAN.search(text)
    while found:
        s, at = found.group(), found.start() + 1
        for end in (len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] == " ")):
            code = s[:end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                at = found.start() + end
                yield found.start(), at
                break
        found = _IBAN.search(text, at)


def _matches(pattern: re.Pattern, valid: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if valid(m.group()))


def _valid_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _valid_card(least: int, most: int) -> Callable[[str], bool]:
    return lambda s: least <= len(d := _digits(s)) <= most and luhn(d)


def _valid_ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def _valid_secret(s: str) -> bool:
    """A mix of letters and digits with many different characters."""
    return any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s) and len(set(s)) >= 8


_FIND: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails,
    "ip": _matches(_IP, _valid_ip),
    "card": _matches(_CARD, _valid_card(16, 19)),
    "phone": _matches(_PHONE, lambda s: 8 <= len(_digits(s)) <= 15),
    "iban": _ibans,
    "ssn": _matches(_SSN, _valid_ssn),
    "short_card": _matches(_CARD, _valid_card(13, 15)),
    "local_phone": _matches(_LOCAL_PHONE, lambda s: True),
    "secret": _matches(_SECRET, _valid_secret),
}


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by kind and start."""
    found: list[tuple[str, int, int, float]] = []
    digits = _DIGIT.search(text) is not None
    around = lambda a, b: f"{text[max(0, a - CONTEXT) : a]} {text[b : b + CONTEXT]}"
    for kind in KINDS[:CERTAIN]:
        if "@" in text if kind == "email" else digits and (kind != "phone" or "+" in text):
            found += [(kind, a, b, max(THRESHOLD, _scored(kind, around(a, b)))) for a, b in _FIND[kind](text)]
    if not digits:
        return found
    certain: list[list[int]] = []  # stretches that the certain kinds cover
    for a, b in sorted((a, b) for _, a, b, _ in found):
        if certain and a < certain[-1][1]:
            certain[-1][1] = max(certain[-1][1], b)
        else:
            certain.append([a, b])
    for kind in KINDS[CERTAIN:]:
        spans = list(_FIND[kind](text))
        scores = [_scored(kind, around(a, b)) for a, b in spans]
        if kind == "secret" and spans:
            # The context of a dotted token, or of one part of it, holds for all its parts.
            tokens, last, parts = _DOTTED.finditer(text), (0, 0), []
            for a, _ in spans:
                while last[1] <= a:
                    last = next(tokens).span()
                parts.append(last)
            best = {t: _scored(kind, around(*t)) for t in set(parts)}
            for t, x in zip(parts, scores):
                best[t] = max(best[t], x)
            scores = [best[t] for t in parts]
        covered = 0
        for (a, b), score in zip(spans, scores):
            while covered < len(certain) and certain[covered][1] <= a:
                covered += 1
            if score >= THRESHOLD and not (covered < len(certain) and certain[covered][0] < b):
                found.append((kind, a, b, score))
    return found


def _scored(kind: str, context: str) -> float:
    """The kind's base score, moved by the words around a span."""
    score = _CONTEXT_WORDS[kind][0]
    if _CONTEXT_RE[kind].search(context):
        score += RAISE
    if _AGAINST.search(context):
        score -= LOWER
    return round(min(1.0, max(0.0, score)), 2)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def redacted(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``column`` masked; null stays null."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
