"""Copy features of an ad body as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that signal urgency, matched on accent-free lower-case text.
URGENCY_TERMS = (
    "derniere",
    "dernier",
    "derniers",
    "dernieres",
    "vite",
    "urgent",
    "complet",
    "limite",
    "limitee",
    "plus que",
    "ne ratez pas",
    "reservez",
    "depechez",
    "bientot",
    "aujourd hui",
    "ce soir",
    "stock",
)
# Currency words and month names looked for after a number.
CURRENCY_WORDS = "dh|dhs|mad|dirham"
MONTH_NAMES = (
    "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
)
EMOJI_CLASS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"

TEXT_FEATURES = (
    "n_chars",
    "n_words",
    "n_lines",
    "n_emoji",
    "n_hashtags",
    "n_mentions",
    "n_exclaim",
    "n_question",
    "caps_ratio",
    "has_urgency",
    "has_price",
    "has_date",
)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every BMP letter whose canonical decomposition is one base plus marks."""
    accented, plain = [], []
    for code in range(0xC0, 0x10000):
        if 0xAC00 <= code <= 0xDFFF:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        base = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(base) == 1 and base[0] != char:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def without_accents(text: Column) -> Column:
    """Lower-case text with combining marks removed."""
    accented, plain = _accent_table()
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), r"\p{Mn}+", "")


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def with_text_features(df, body: str = "body"):
    """Append the twelve copy features; a null body counts as empty text."""
    raw = F.coalesce(F.col(body), F.lit(""))
    df = df.withColumn("__raw", raw)
    raw = F.col("__raw")
    df = df.withColumn("__flat", without_accents(raw))
    flat = F.col("__flat")
    letters = F.regexp_count(raw, F.lit(r"\p{L}"))
    price = rf"(?U)\d+\s*({CURRENCY_WORDS})"
    date = rf"(?U)\b\d{{1,2}}\s*({MONTH_NAMES})\b"
    features = {
        "n_chars": F.length(raw),
        "n_words": F.regexp_count(raw, F.lit(r"(?U)\S+")),
        "n_lines": F.when(raw == "", 0).otherwise(occurrences(raw, "\n") + 1),
        "n_emoji": F.regexp_count(raw, F.lit(EMOJI_CLASS)),
        "n_hashtags": occurrences(raw, "#"),
        "n_mentions": occurrences(raw, "@"),
        "n_exclaim": occurrences(raw, "!"),
        "n_question": occurrences(raw, "?"),
        "caps_ratio": F.coalesce(
            F.regexp_count(raw, F.lit(r"\p{Lu}")) / F.nullif(letters, F.lit(0)), F.lit(0.0)
        ),
        "has_urgency": flat.rlike("|".join(URGENCY_TERMS)).cast("int"),
        "has_price": flat.rlike(price).cast("int"),
        "has_date": flat.rlike(date).cast("int"),
    }
    return df.withColumns(features).drop("__raw", "__flat")
