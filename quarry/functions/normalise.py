"""Text normalisation for comparing answers; its Unicode steps have no JVM expression."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is written alike.
_SIGNS = str.maketrans("‐‑‒–—―−‘’“”", "-------''\"\"")
_UNITS = {
    "h": "hour hours hr hrs", "m": "metre metres meter meters", "km": "kilometre kilometres kilometer kilometers",
    "l": "litre litres liter liters", "s": "second seconds sec secs",
}
_GLUED = (
    "hours hour hrs hr h minutes minute min ms seconds second secs sec s kilometres kilometers kilometre kilometer km cm mm m kg g "
    "litres liters litre liter l ml kwh kw mw w mb gb kb tb khz mhz hz mpa kpa pa percent"
)
_SHORT = {word: unit for unit, words in _UNITS.items() for word in words.split()}
_UNIT = re.compile(r"(?<=\d)(?=(?:" + "|".join(_GLUED.split()) + r")\b)")
_THOUSANDS = re.compile(r"(?<=\d)[.,](?=\d{3}(?!\d))")


def normalise_text(text: str | None) -> str | None:
    """One comparable form of a text; null stays null.

    Entities and backslashes of Markdown exports are undone, compatibility
    forms and case folded, accents and invisible signs dropped; percent is a
    word, a unit stands apart from its number and in its short form; numbers
    have no thousands separators and a decimal point.
    """
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", html.unescape(text).replace("\\", "")).translate(_SIGNS).casefold()
    marks = {"Mn", "Cf"}
    out = "".join(filter(lambda c: unicodedata.category(c) not in marks, unicodedata.normalize("NFKD", folded)))
    out = _UNIT.sub(" ", out.replace("%", " percent "))
    out = re.sub(r"[^\W\d_]+", lambda w: _SHORT.get(w[0], w[0]), out)
    out = re.sub(r"(?<=\d),(?=\d)", ".", _THOUSANDS.sub("", out))
    return re.sub(r"\bper cent\b", "percent", " ".join(out.split()))


def normalised(column: Column) -> Column:
    """The normaliser over Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalise_text, na_action="ignore")

    return run(column)
