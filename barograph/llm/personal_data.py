"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

A proposed span starts with the score of its kind. A validator may refuse it (a card without a right check digit, an
account number that isn't 1 modulo 97). Words that belong to the kind, shortly before or after the span, raise the score, and words
that name some other sort of number lower it. What reaches ``LEAST_SCORE`` is reported. The four kinds of ``BASE`` have
fixed rules: whatever passes them is reported at any score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.llm.textbatch import slices, with_text

LEAST_SCORE = 0.5
#: Characters before and after a span in which words count as nearby.
BEFORE, AFTER = 48, 24
RAISED, LOWERED = 0.4, 0.4


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The check digit of card numbers: every second digit from the right doubled, cross sums added up."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((d * 2) % 10 + d // 5 for d in map(int, digits[-2::-2]))) % 10 == 0


def is_address(text: str) -> bool:
    # by length first: a number of any length may stand here
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 10 <= len(digits_of(text)) <= 15


#: Length of an account number by country (fixed values of the standard).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}


def iban_end(text: str) -> int | None:
    """Where an account number at the start of ``text`` ends: by its country's length, if it is 1 modulo 97."""
    length, taken = IBAN_LENGTHS.get(text[:2]), ""
    for i, c in enumerate(text):
        taken += c.strip()
        if length and len(taken) == length:
            whole = i + 1 == len(text) or not text[i + 1].isalnum()
            return i + 1 if whole and int("".join(str(int(c, 36)) for c in taken[4:] + taken[:4])) % 97 == 1 else None
    return None


def is_social(text: str) -> bool:
    """An American social security number: no part is all zeros; 666 and 9xx are never given."""
    area, group, serial = re.split("[ -]", text)
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def is_day(text: str) -> bool:
    """A day of the calendar, year first or last, from 1900 to 2099."""
    parts = [int(p) for p in re.split("[-/.]", text)]
    year, rest = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
    return 1900 <= year <= 2099 and min(rest) >= 1 and min(rest) <= 12 and max(rest) <= 31


def is_secret(text: str) -> bool:
    """Long enough, with letters and digits, and not a few characters over and over."""
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and len(set(text)) >= 8


class Kind(NamedTuple):
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    score: float = 0.0
    #: Words that raise and that lower the score, in the languages of the corpus.
    raises: str = ""
    lowers: str = ""


def by_pattern(pattern: str, sign: str = "", group: int = 0) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Leftmost matches that don't overlap; texts without ``sign`` aren't searched."""
    compiled = re.compile(pattern)

    def propose(text: str) -> Iterator[tuple[int, int]]:
        return (m.span(group) for m in compiled.finditer(text)) if sign in text else iter(())

    return propose


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def mail_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    Searched from the sign to both sides: tried from every character, the pattern would take quadratic time on a long
    text without blanks.
    """
    end = 0
    for m in _DOMAIN.finditer(text):
        at, start = m.start(), m.start()
        while start > end:
            block = text[max(end, start - 64) : start]
            stop = None
            for stop in _NOT_LOCAL.finditer(block):
                pass
            start -= len(block) - (stop.end() if stop else 0)
            if stop:
                break
        if start < at:
            yield start, m.end()
            end = m.end()


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


def account_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        end = iban_end(text[m.start() : m.end() + 1])
        if end is not None:
            yield m.start(), m.start() + end


#: Fixed rules. No pattern can begin within a number or a word that it has failed on: so each takes linear time.
BASE = [
    Kind("email", mail_addresses, lambda t: True),
    Kind("ip", by_pattern(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."), is_address),
    Kind("card", by_pattern(r"[0-9](?:[\x20-]?[0-9])+"), is_card),
    Kind("phone", by_pattern(r"\+[0-9][\x20().0-9-]+[0-9]", "+"), is_phone),
]
_NUMBERED = r"order|invoice|ticket|version|serial|isbn|part no|bestell|rechnung|commande|facture|pedido|factura"
MORE = [
    Kind("iban", account_numbers, lambda t: True, 0.9, r"iban|account|bank|konto|compte|cuenta", r"example|muster"),
    Kind(
        "secret",
        by_pattern(r"(?<![A-Za-z0-9])[A-Za-z0-9_/+-]{20,128}(?![A-Za-z0-9_/+=-])"),
        is_secret,
        0.2,
        r"(?:token|secret|password|passwd|api[ _-]?key|access[ _-]?key|bearer|passwort|contraseña|mot de passe)[\"']?\s*(?:[:=]|is\b|ist\b|est\b|es\b)",
        r"sha-?(?:1|256)|md5|digest|checksum|commit|uuid|https?://",
    ),
    Kind(
        "social",
        by_pattern(r"(?<![0-9-])[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}(?![0-9-])"),
        is_social,
        0.3,
        r"\bssn\b|social security|tax id|sozialversicherung|sécurité sociale|seguridad social",
        _NUMBERED,
    ),
    Kind(
        "birth",
        by_pattern(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9/-]|\.[0-9])"),
        is_day,
        0.1,
        r"\bborn\b|birth|\bdob\b|geboren|geburts|né le|née le|naissance|nacid|nacimiento",
        r"publish|updated|released|copyright|version",
    ),
    Kind(
        "local_phone",
        by_pattern(r"(?<![0-9+().-])\(?0?[0-9]{2,4}\)?[ /-][0-9]{3,4}(?:[ -][0-9]{3,4}){1,2}(?![0-9-])"),
        lambda t: 9 <= len(digits_of(t)) <= 12,
        0.2,
        r"\btel\b|phone|mobile|call|fax|telefon|handy|téléphone|teléfono|móvil",
        _NUMBERED,
    ),
]
KINDS = [k.name for k in (*BASE, *MORE)]
_WORDS = {k.name: (re.compile(k.raises, re.IGNORECASE), re.compile(k.lowers, re.IGNORECASE)) for k in MORE}


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """How sure it is, from 0 to 1, that a confirmed span is personal, by the words around it."""
    raises, lowers = _WORDS[kind.name]
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    found = kind.score + RAISED * bool(raises.search(before) or raises.search(after)) - LOWERED * bool(lowers.search(before))
    return min(1.0, max(0.0, found))


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; a further kind's span never touches one that stands before it."""
    out = [(k.name, a, b, 1.0) for k in BASE for a, b in k.propose(text) if k.confirm(text[a:b])]
    taken = sorted((a, b) for _, a, b, _ in out)
    for kind in MORE:
        new = [(a, b) for a, b in kind.propose(text) if kind.confirm(text[a:b])]
        if not new:
            continue
        free = _apart(new, taken)
        sure = [(kind.name, a, b, s) for a, b in free if (s := score(kind, text, a, b)) >= LEAST_SCORE]
        out += sure
        taken = sorted([*taken, *((a, b) for _, a, b, _ in sure)])
    rank = {name: i for i, name in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def _apart(new: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``new`` that overlap none of ``taken``; both are sorted by start."""
    free, i, reach = [], 0, 0
    for a, b in new:
        while i < len(taken) and taken[i][0] < b:
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= a:
            free.append((a, b))
    return free


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
MADE = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])


def _found(batches: Iterator[pa.RecordBatch], text: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    for piece, data, starts in slices(batches, text):
        raw, at = data.tobytes(), starts.tolist()
        found = [[dict(zip(SPAN.fieldNames(), s, strict=True)) for s in spans_of(raw[a:b].decode())] for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(found, pa.list_(entry))], names=[*kept, *MADE.fieldNames()])


def personal_data(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with spans: kind, start, end (code points, end exclusive) and score, of the column ``text``.

    Spans of the base kinds don't overlap within a kind, but may across kinds; those of the further kinds overlap no
    other span. A null or empty text has none. Repeated rows are treated alike; an empty table gives no rows. A column
    of ``docs`` named spans is replaced.
    """
    df, text, kept, schema = with_text(docs, columns, MADE)
    return df.mapInArrow(lambda batches: _found(batches, text, kept), schema)


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``<kind>`` in place of every span; of overlapping ones the first in order stands for all."""
    done = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    body = F.coalesce(text, F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        cut = F.struct(F.concat(acc["out"], between, F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))
        over = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], cut).otherwise(over)

    return F.aggregate(spans, done, step, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))


def _is_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.when(s["kind"] == kind, True)


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and a digest of the base kinds' spans, and all spans as text."""
    base = [k.name for k in BASE]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.array_compact(F.transform("spans", _is_of(k)))).cast("long").alias(f"n_{k}") for k in base]
    fixed = F.filter("spans", lambda s: s["kind"].isin(base))
    return personal_data(docs, ["doc_id"]).select("doc_id", *counts, F.sha2(written(fixed).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
