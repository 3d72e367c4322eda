"""Phones, e-mails, URLs, countries and currencies.

Defined cases: nulls, empty texts and what cannot be read as a number give null; rows are judged one by one, so repeated rows and empty
tables need nothing; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numbering
from millrace.functions.selectors import col, replaced
from millrace.functions.text import literal_map, number, trim
from millrace.functions.words import COUNTRIES, FORMATS

def _national(number: Column) -> Column:
    """Whether a number (digits, calling code first) is a whole one: its code is looked up by longest prefix in a flat table, which tells
    the lengths (a bit each) that a national number may have."""
    table = F.create_map(*[F.lit(v) for code, lengths in numbering.codes().items() for v in (code, sum(1 << n for n in lengths))])
    fits = F.lit(False)
    for n in (1, 2, 3):
        lengths = F.try_element_at(table, F.substring(number, 1, n))
        bit = F.pmod(F.floor(lengths / F.pow(F.lit(2), F.greatest(F.length(number) - n, F.lit(0)))), F.lit(2)) == 1
        fits = fits | F.coalesce(bit, F.lit(False))
    for code, pattern in numbering.PATTERNS.items():
        fits = fits & (~number.startswith(code) | number.rlike(f"^{code}{pattern}$"))
    zero = "|".join(sorted(numbering.ZERO_FIRST))
    begins = "|".join(sorted(numbering.codes(), key=lambda c: (-len(c), c)))
    return fits & (~number.rlike(f"^(?:{begins})0") | number.rlike(f"^(?:{zero})0"))


def phone_e164(x: Column, region: str = "US") -> Column:
    """``+`` and digits, or null for what is no number of the region or, written with ``+`` or the region's international prefix, of any.

    Extensions are dropped. A number without a trunk prefix is tried as it is, then without its trunk prefix, then as one that begins
    with the region's calling code.
    """
    if region not in numbering.regions():
        raise ValueError(f"unknown region {region!r}")
    code = numbering.regions()[region]
    bare = F.regexp_replace(trim(x), r"(?i)[\s,;]*(?:ext\.?|extension|x|#)\s*\d{1,7}$", "")
    digits = F.regexp_replace(bare, r"^\+\s*\(?|[\s().\-/\u00B7\u2010-\u2015]", "")
    digits = F.when(digits.rlike(r"^\d{4,20}$"), digits)
    abroad = f"^(?:{numbering.INTERNATIONAL.get(region, '00')}|00)"
    dialled = F.when(bare.startswith("+"), digits).when(digits.rlike(abroad), F.regexp_replace(digits, abroad, ""))
    trunk = "1" if code == "1" else numbering.TRUNK.get(region, "0")
    local = F.when(~bare.startswith("+"), digits)
    tries = [F.concat(F.lit(code), local), *([F.concat(F.lit(code), F.when(local.startswith(trunk), F.substring(local, len(trunk) + 1, 20)))] if trunk else []), F.when(local.startswith(code), local)]
    found = F.coalesce(*[F.when(_national(t), t) for t in (dialled, *tries)])
    return F.concat(F.lit("+"), found)


def normalize_phone_numbers(df: DataFrame, columns: Iterable[str], region: str = "US") -> DataFrame:
    return replaced(df, {c: phone_e164(col(c).cast("string"), region) for c in columns if c in df.columns})


def normalize_emails(df: DataFrame, columns: Iterable[str], add_flag: bool = True) -> DataFrame:
    """Trimmed and lower-cased, with ``<column>_valid`` by the e-mail format."""
    new: dict[str, Column] = {}
    for c in columns:
        if c in df.columns:
            new[c] = F.lower(trim(col(c).cast("string")))
            if add_flag:
                new[f"{c}_valid"] = new[c].rlike(FORMATS["email"])
    return replaced(df, new)


_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(x: Column) -> Column:
    """Trimmed, with a scheme; scheme and host part lower-cased, no trailing slash, no fragment. Empty becomes null."""
    s = trim(x)
    s = F.when(s.contains("://"), s).otherwise(F.concat(F.lit("http://"), s))
    part = lambda k: F.regexp_extract(s, _PARTS, k)
    query = F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise("")
    return F.when(trim(x) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), r"/+$", ""), query))


def canonicalize_urls(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return replaced(df, {c: canonical_url(col(c).cast("string")) for c in columns if c in df.columns})


def standardize_country_region(df: DataFrame, columns: Iterable[str], mapping: dict[str, str] | None = None, keep_unmapped_case: bool = False) -> DataFrame:
    """Countries by their aliases; what is unknown stays, lower-cased unless ``keep_unmapped_case``."""
    table = {**COUNTRIES, **{k.lower(): v for k, v in (mapping or {}).items()}}
    new = {}
    for c in columns:
        if c in df.columns:
            bare = trim(col(c).cast("string"))
            key = F.lower(bare)
            new[c] = F.when(key.isin(*table), F.try_element_at(literal_map(table), key)).otherwise(bare if keep_unmapped_case else key)
    return replaced(df, new)


def convert_currency(df: DataFrame, columns: Iterable[str], rates: dict[str, float], base: str = "USD") -> DataFrame:
    """Amounts times their column's rate; what is no number becomes null. ``base`` names the result's currency."""
    value = lambda c: number(col(c)) if dict(df.dtypes)[c] == "string" else col(c).cast("double")
    return replaced(df, {c: value(c) * F.lit(float(rates[c])) for c in columns if c in df.columns and c in rates})
