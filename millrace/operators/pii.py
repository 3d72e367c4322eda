"""Personal data as spans: recognisers, resolution of overlaps, and one rewrite.

Every recogniser gives spans (start, end, kind, score): by a pattern and a check (digits that add up, parts that are in use), or by a
list of names that the caller gives. Words that speak for a kind shortly before a span raise its score. Of spans that overlap the one
of highest score stays (then the longer, then the earlier), and the others stay only where they touch none that stays. The text is
rewritten once, from its end to its start.

Defined cases: null gives an empty masked text, an empty text stays empty; very long texts are read whole; ties are settled as said, at
last by the kind's name; repeated rows are masked each; empty tables give empty tables; columns may have any names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.automaton import Automaton
from millrace.functions.selectors import col, replaced
from millrace.functions.storage import small_batches

#: By how much a word of a kind's context raises a score, and how many characters before a span are read for one.
RAISE, BEFORE = 0.35, 40
#: Score of a name from a list.
LISTED = 0.55


def luhn(match: str) -> bool:
    """Whether the digits of a card number add up."""
    digits = [int(c) for c in match if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def iban(match: str) -> bool:
    """Whether an account number's check digits are right."""
    return int("".join(str(int(c, 36)) for c in match[4:] + match[:4])) % 97 == 1


def ssn(match: str) -> bool:
    """Whether area, group and serial number are ones that are given out."""
    return match[:3] not in ("000", "666") and match[0] != "9" and match[4:6] != "00" and match[7:] != "0000"


def nhs(match: str) -> bool:
    """Whether the last digit of a health service number checks the others."""
    digits = [int(c) for c in match if c.isdigit()]
    return (11 - sum(d * (10 - i) for i, d in enumerate(digits[:9])) % 11) % 11 == digits[9]


@dataclass(frozen=True)
class Recogniser:
    """``pattern`` (the subset that all engines read alike), ``check`` of a match, whether a word character or dot may come before it,
    and the words that speak for it."""

    pattern: str
    score: float
    check: Callable[[str], bool] | None = None
    inside_words: bool = True
    context: tuple[str, ...] = ()


RECOGNISERS = {
    "CREDIT_CARD": Recogniser(r"\b(?:\d[ \-]?){12,18}\d\b", 0.9, luhn, context=("card", "visa", "credit", "debit")),
    "EMAIL_ADDRESS": Recogniser(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 1.0, context=("mail",)),
    "IBAN_CODE": Recogniser(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 1.0, iban, context=("iban", "account", "bank")),
    "IP_ADDRESS": Recogniser(r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.6, context=("address", "server", "host")),
    "MAC_ADDRESS": Recogniser(r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b", 0.7, context=("mac", "device")),
    "PHONE_NUMBER": Recogniser(r"(?:\+?\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}\b", 0.4, None, False, ("phone", "call", "mobile", "tel", "fax")),
    "UK_NHS": Recogniser(r"\b\d{3}[ \-]\d{3}[ \-]\d{4}\b", 0.5, nhs, context=("nhs", "patient", "health")),
    "URL": Recogniser(r"\bhttps?://\S+", 0.6, context=("link", "website")),
    "US_SSN": Recogniser(r"\b\d{3}-\d{2}-\d{4}\b", 0.5, ssn, context=("ssn", "social", "security")),
}
KINDS = {kind: r.pattern for kind, r in RECOGNISERS.items()}
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


class Finder:
    """Finds the spans of ``kinds``, and of ``names`` (lists of phrases by kind, in any case)."""

    def __init__(self, kinds: Iterable[str] = tuple(KINDS), names: Mapping[str, Iterable[str]] | None = None) -> None:
        self.patterns = [(k, RECOGNISERS[k], re.compile(RECOGNISERS[k].pattern, re.ASCII)) for k in sorted(set(kinds))]
        self.lists = [(k, Automaton(filter(None, (tuple(_WORDS.findall(p.casefold())) for p in phrases)))) for k, phrases in sorted((names or {}).items())]

    def candidates(self, text: str) -> list[tuple[int, int, str, float]]:
        """All spans, overlapping or not."""
        out = []
        for kind, r, pattern in self.patterns:
            for m in pattern.finditer(text):
                if not r.inside_words and re.match(r"[A-Za-z0-9_.]", text[max(0, m.start() - 1) : m.start()]):
                    continue
                if r.check is None or r.check(m.group()):
                    ahead = text[max(0, m.start() - BEFORE) : m.start()].lower()
                    out.append((m.start(), m.end(), kind, min(1.0, r.score + RAISE * any(w in ahead for w in r.context))))
        if self.lists:
            words = list(_WORDS.finditer(text))
            plain = [w.group().casefold() for w in words]
            for kind, automaton in self.lists:
                out += [(words[a].start(), words[b - 1].end(), kind, LISTED) for a, b in automaton.find(plain)]
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Spans that do not overlap, in order."""
        kept: list[tuple[int, int, str, float]] = []
        for span in sorted(self.candidates(text or ""), key=lambda s: (-s[3], s[0] - s[1], s[0], s[2])):
            at = bisect.bisect_left(kept, span)  # kept spans do not overlap, so only its neighbours may reach into it
            if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or span[1] <= kept[at][0]):
                kept.insert(at, span)
        return kept

    def mask(self, text: str | None) -> str:
        out = text or ""
        for start, end, kind, _ in reversed(self.spans(text)):
            out = f"{out[:start]}<{kind}>{out[end:]}"
        return out


def pii_spans(x: Column, kinds: Iterable[str] = tuple(KINDS), names: Mapping[str, Iterable[str]] | None = None) -> Column:
    """The spans of a text column: an array of ``start`` (from 0), ``end``, ``kind`` and ``score``."""
    finder = Finder(kinds, names)

    @F.pandas_udf("array<struct<start: int, end: int, kind: string, score: double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[dict(zip(("start", "end", "kind", "score"), s)) for s in finder.spans(t)] for t in part], dtype=object)

    return run(x.cast("string"))


def mask_text(x: Column, kinds: Iterable[str] = tuple(KINDS), names: Mapping[str, Iterable[str]] | None = None) -> Column:
    """Every recognised piece of ``kinds`` and ``names`` as ``<KIND>``."""
    finder = Finder(kinds, names)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(finder.mask)

    return run(x.cast("string"))


def pii_columns(df: DataFrame, sample_size: int = 10, names: Mapping[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    """Columns in whose sample (the ``sample_size`` non-null values of least hash) something was recognised, and its kinds."""
    finder, out = Finder(names=names), {}
    for c, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct", "binary", "variant")):
            continue
        value = col(c).cast("string")
        sample = df.select(value.alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64(F.lit(42), "v"), "v").limit(sample_size)
        found = sorted({s[2] for r in sample.collect() for s in finder.spans(r.v)})
        if found:
            out[c] = found
    return out


def detect_and_mask_pii(
    df: DataFrame, sample_size: int = 10, columns: list[str] | None = None, drop_original: bool = False, masker: Callable[[Column], Column] | None = None, names: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    """``<column>_masked`` for columns with personal data (found in a sample, or given); null values give an empty text.

    ``names``: phrases to mask by kind, such as ``{"PERSON": [...], "LOCATION": [...]}``.
    """
    small_batches(df.sparkSession)
    masker = masker or (lambda x: mask_text(x, names=names))
    found = list(pii_columns(df, sample_size, names)) if columns is None else [c for c in columns if c in df.columns]
    out = replaced(df, {f"{c}_masked": masker(F.coalesce(col(c).cast("string"), F.lit(""))) for c in found})
    return out.drop(*found) if drop_original else out
