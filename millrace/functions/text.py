"""String expressions, all native: whitespace, symbols, casing, mojibake, text preprocessing, tokens of PII."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.words import CONTRACTIONS, STOPWORDS

SYMBOLS = "$₹,-•"


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def trim(x: Column) -> Column:
    """Without white space (in Unicode's sense) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(x: Column) -> Column:
    """Trimmed, every run of white space one blank."""
    return F.regexp_replace(trim(x), r"(?U)\s+", " ")


def strip_symbols(x: Column) -> Column:
    return F.translate(x, SYMBOLS, "")


def fix_mojibake(x: Column) -> Column:
    """UTF-8 bytes that were read as Latin-1 are read again; anything else stays."""
    suspect = x.rlike("[\\x{80}-\\x{FF}]") & x.rlike("^[\\x{00}-\\x{FF}]*$")
    return F.when(suspect, F.coalesce(F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string")), x)).otherwise(x)


def drop_control(x: Column) -> Column:
    return F.regexp_replace(x, r"\p{Cc}", "")


def title(x: Column) -> Column:
    """Letters after anything but a letter or digit in upper case, all others in lower case."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2147483647))), "")


#: The steps of text preprocessing after contractions: pattern and replacement, in order. Fixed values.
TEXT_STEPS = [
    (r"(?m)https?://.*[\r\n]*", ""),
    (r"@[A-Za-z0-9]+", ""),
    (r"[_\"\-;%()|+&=*%,!?:#$@\[\]/]", " "),
    (r"<a href", " "),
    (r"&amp;", ""),
    (r"<br />", " "),
    (r"'\"", " "),
    (
        "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F700}-\\x{1F77F}\\x{1F780}-\\x{1F7FF}\\x{1F800}-\\x{1F8FF}"
        "\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{1FA70}-\\x{1FAFF}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+",
        "",
    ),
]
EMOJI_ONLY = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]+"


def tokens(x: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def preprocess_text(x: Column, remove_stopwords: bool = True, url_mode: str = "tail", emoji_only: bool = False, stopwords: list[str] | None = None) -> Column:
    """Lower-cased text with contractions expanded, links, mentions, symbols and emoji removed, and stopwords dropped.

    Null gives an empty text. The first link takes the rest of the text with it; ``url_mode="token"`` removes links only.
    The emoji rule also covers all CJK text; ``emoji_only`` narrows it to emoji.
    """
    table = literal_map(CONTRACTIONS)
    text = F.array_join(F.transform(tokens(F.lower(F.coalesce(x, F.lit("")))), lambda w: F.when(w.isin(*CONTRACTIONS), F.try_element_at(table, w)).otherwise(w)), " ")
    steps = list(TEXT_STEPS)
    if url_mode == "token":
        steps[0] = (r"https?://\S*", "")
    if emoji_only:
        steps[-1] = (EMOJI_ONLY, "")
    text = reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)
    words = tokens(text)
    if remove_stopwords:
        dropped = STOPWORDS if stopwords is None else stopwords
        words = F.filter(words, lambda w: ~w.isin(*dropped)) if dropped else words
    return F.array_join(words, " ")


def number(x: Column) -> Column:
    """A decimal number in a string as double, else null; type suffixes and words are not numbers."""
    return F.when(x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), x.try_cast("double"))
