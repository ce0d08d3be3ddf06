"""Text normalisation, codes, digests and privacy patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áéíóúàèìòùäëïöüâêîôûãõñç"
_PLAIN = "aeiouaeiouaeiouaeiouaonc"

# fixed values: patterns and their replacements, applied in this order
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
ACCOUNT = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
REDACTIONS = [("emails", EMAIL, "[EMAIL_REDACTED]"), ("phones", PHONE, "[PHONE_REDACTED]"), ("accounts", ACCOUNT, "[ACCOUNT_REDACTED]")]


def normalised(x: Column) -> Column:
    """Lower case without accents and punctuation, single spaces."""
    plain = F.translate(F.lower(x), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9 ]", " "), " +", " "))


def header(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[_\-.\s%]+", " "))


def token_set(x: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(normalised(x), " "))), " ")


def code(prefix: str, x: Column) -> Column:
    """Upper-case code of at most 50 characters."""
    return F.substring(F.concat(F.lit(prefix + "-"), F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "-")), 1, 50)


def short_hash(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 8)


#: What a text must hold for a pattern to match: cheap to look for, where the pattern is not.
_NEEDS = {"phones": r"[0-9]{4}", "accounts": r"[0-9]{4}"}


def scrubbed(x: Column) -> tuple[Column, dict[str, Column]]:
    """Text with personal data replaced, one pattern after the other, and how many of each."""
    counts = {}
    for name, pattern, by in REDACTIONS:
        may = x.contains("@") if name == "emails" else x.rlike(_NEEDS[name])
        counts[name] = F.when(may, F.regexp_count(x, F.lit(pattern))).otherwise(0).cast("long")
        x = F.when(may, F.regexp_replace(x, pattern, by)).otherwise(x)
    return x, counts


def token_estimate(x: Column) -> Column:
    return F.ceil(F.octet_length(x) / 4).cast("long")


def json_object(text: Column) -> Column:
    """From the first to the last brace of a text; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_array(text: Column) -> Column:
    """From the first to the last square bracket of a text; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
