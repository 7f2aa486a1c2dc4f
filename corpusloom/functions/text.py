"""Text expressions on a string column.

Everything here is a built-in Spark expression: no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters Python counts as white space.
WS_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WS_CHARS = "".join(map(chr, WS_CODES))
# The same set as a class body; the patterns below switch \s to Unicode with (?U).
WS = r"\s\x1c-\x1f"
# Token patterns.
WORD_PATTERN = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"
TERM_PATTERN = r"[a-z0-9_\p{L}\p{N}]{2,}"


def as_text(c: Column) -> Column:
    """Any value as text, NULL as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """White space off both ends (plain ``trim`` takes only spaces)."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def is_non_blank(c: Column) -> Column:
    """At least one visible character; NULL is blank."""
    return F.coalesce(c.rlike(f"(?U)[^{WS}]"), F.lit(False))


def char_length_between(c: Column, lo: int, hi: int | None = None) -> Column:
    """Code points, measured before any strip; bounds inclusive."""
    return F.length(c) >= lo if hi is None else F.length(c).between(lo, hi)


def word_tokens(c: Column, lower: bool = False) -> Column:
    """G1: alphanumeric words with an optional apostrophe part."""
    tokens = F.regexp_extract_all(c, F.lit(WORD_PATTERN), F.lit(0))
    return F.transform(tokens, F.lower) if lower else tokens


def ws_tokens(c: Column) -> Column:
    """Tokens between white space."""
    return F.regexp_extract_all(c, F.lit(f"(?U)[^{WS}]+"), F.lit(0))


def ws_word_count(c: Column) -> Column:
    """Number of white-space tokens."""
    return F.regexp_count(c, F.lit(f"(?U)[^{WS}]+"))


def term_tokens(c: Column) -> Column:
    """H4: lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM_PATTERN), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """N-grams as space-joined strings, empty when there are fewer than n tokens.

    Tokens hold no spaces, so the joined form is unique; and strings let
    ``array_distinct`` hash, where structs would be compared pair by pair.
    """
    grams = tokens
    for size in range(2, n + 1):
        length = F.greatest(F.size(tokens) - (size - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, 1, length), F.slice(tokens, size, length),
            lambda head, last: F.concat(head, F.lit(" "), last),
        )
    return grams


def safe_ratio(num: Column, den: Column) -> Column:
    """0.0 when the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def distinct_n(tokens: Column, n: int) -> Column:
    """Unique n-grams over all n-grams."""
    total = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return safe_ratio(F.size(F.array_distinct(ngrams(tokens, n))), total)


def repeat_rate(tokens: Column, n: int = 3) -> Column:
    """Occurrences beyond the first, over all n-grams."""
    total = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return safe_ratio(total - F.size(F.array_distinct(ngrams(tokens, n))), total)


def clean_text(c: Column) -> Column:
    """Strip, collapse white space, double quotes to single."""
    # Single spaces, the common case, are left out of the match.
    runs = f"(?U)[{WS}]{{2,}}|[{WS}&&[^ ]]"
    return F.translate(F.regexp_replace(strip(c), runs, " "), '"', "'")


def strip_tags(c: Column) -> Column:
    """Drop ``<...>`` that closes on the same line."""
    return F.regexp_replace(c, r"<[^\n]*?>", "")


def clean_generated(c: Column) -> Column:
    """Drop a leading 'review :' in any case."""
    return strip(F.regexp_replace(strip(c), f"(?iU)^review[{WS}]*:", ""))


def after_review_colon(c: Column) -> Column:
    """G9, variant: only an exact 'review:' prefix, cut at the first colon."""
    text = strip(c)
    return F.when(
        F.lower(text).startswith("review:"), strip(F.substring(text, F.lit(8), F.length(text)))
    ).otherwise(text)


def strip_prompt(full: Column, prompt: Column) -> Column:
    """Drop the echoed prompt when the text starts with it."""
    rest = F.substring(full, F.length(prompt) + 1, F.length(full))
    return strip(F.when(F.startswith(full, prompt), rest).otherwise(full))


def snippet(c: Column, n: int = 300) -> Column:
    """First n characters, cleaned, with '...' appended."""
    return F.concat(clean_text(F.substring(c, 1, n)), F.lit("..."))


def training_text(prompt: Column, completion: Column) -> Column:
    """Prompt without trailing blanks, a line break, stripped completion."""
    return F.concat(rstrip(prompt), F.lit("\n"), strip(completion))


def percent_value(c: Column) -> Column:
    """G18: '68.0%' as 0.68; NULL where there is no number."""
    return F.rtrim(c, F.lit("%")).try_cast("double") / 100


def has_word(c: Column, word: str) -> Column:
    """The whole word in any case, with Unicode word borders."""
    return c.rlike(rf"(?iuU)\b\Q{word}\E\b")


def first_keyword(text: Column, mapping: dict[str, str], default: Column) -> Column:
    """Value of the first listed keyword contained in the text."""
    return reduce(
        lambda rest, kw: F.when(F.contains(text, F.lit(kw)), F.lit(mapping[kw])).otherwise(rest),
        reversed(list(mapping)),
        default,
    )
