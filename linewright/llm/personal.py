"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes
and identifier cues. A small parser per kind then expands from the anchor to the span's
borders and validates it. Each parser looks at a run of characters once, so a text of any
length takes time in proportion to it.

Base kinds are email, ip, card and phone; the method adds ``login`` (user and password in
a URL), ``iban`` (checked by its remainder) and ``account`` (digits after an account cue).
Offsets are code points, the end exclusive. Null texts are empty and have no spans.
Repeated rows keep a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import batch, keyed, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")

# The patterns of the base kinds, and the cues of the others.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s@/]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
IBAN = re.compile(r"[^\S\n]*:?[^\S\n]*([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(
    r"[^\S\n]*(?:(?:number|no\.?|nr\.?|#)[^\S\n]*)?:?[^\S\n]*([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])"
)
NOT_DIGIT = re.compile(r"[^0-9]")
DIGITS = re.compile(r"[0-9]+")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://")
IBAN_CUES = ("IBAN", "Iban", "iban")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, cues in (("login", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def spans(text: str, anchors) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where the last match of a kind ends

    def keep(start: int, end: int, kind: str) -> None:
        found.append((start, KINDS.index(kind), end))

    for last, (kind, length) in anchors.iter(text):
        at = last + 1 - length
        if kind == "digit":
            if at >= past["card"]:
                match = CARD.match(text, at)
                past["card"] = match.end() if match else at + 1
                if match:
                    digits = NOT_DIGIT.sub("", match[0])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        keep(at, match.end(), "card")
            if at >= past["ip"]:
                match = IP.match(text, at)
                if match is None:
                    past["ip"] = DIGITS.match(text, at).end()
                else:
                    past["ip"] = match.end()
                    parts = (part.lstrip("0") or "0" for part in match.groups())
                    if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                        keep(at, match.end(), "ip")
        elif kind == "email":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            match = DOMAIN.match(text, at + 1) if start < at else None
            if match:
                past["email"] = match.end()
                keep(start, match.end(), "email")
        elif kind == "phone":
            match = PHONE.match(text, at) if at >= past["phone"] else None
            if match:
                past["phone"] = match.end()
                if 10 <= len(NOT_DIGIT.sub("", match[0])) <= 15:
                    keep(at, match.end(), "phone")
        elif last >= past[kind]:
            match = {"login": LOGIN, "iban": IBAN, "account": ACCOUNT}[kind].match(text, last + 1)
            if match and kind == "login":
                past[kind] = match.end()
                keep(at, match.end(), kind)
            elif match:
                past[kind] = match.end(1)
                if kind == "account" or iban(match[1].replace(" ", "")):
                    keep(match.start(1), match.end(1), kind)
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(found)]


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind."""
    parts, past = [], 0
    for start, end, kind in found:
        if start >= past:
            parts += [text[past:start], f"[{kind.upper()}]"]
        past = max(past, end)
    return "".join([*parts, text[past:]])


def find_personal(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``: spans as an array of ``(kind, start, end)``."""
    rows = keyed(df, doc_id, text).select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for part in batches:
            schema = pa.schema(
                [("doc_id", part.schema.field(0).type), ("spans", pa.list_(span))]
            )
            for doc_ids, texts in slices([part]):
                found = [
                    [
                        {"kind": kind, "start": start, "end": end}
                        for start, end, kind in spans(text.decode("utf-8", "replace"), anchors)
                    ]
                    for text in texts
                ]
                yield batch(schema, doc_ids, found)

    kinds = "array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(run, f"doc_id {id_type}, spans {kinds}")


def redact(text: str | Column) -> Column:
    """A text column with its personal data replaced; null stays null."""

    @F.pandas_udf("string")
    def replaced(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = automaton()
        for part in parts:
            yield part.map(
                lambda value: redacted(value, spans(value, anchors)), na_action="ignore"
            )

    return replaced(text)


def digests(found: DataFrame) -> DataFrame:
    def written(span: Column) -> Column:
        return F.concat_ws(":", span["kind"], span["start"], span["end"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, written), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda span: span["kind"].isin(*kinds))

    base = of(*BASE)
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
