"""Scalar text expressions; everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most terms a query keeps.
MAX_TERMS = 2_000
#: A word of the simple text configuration.
WORD = r"[\p{L}\p{N}]+"
SEPARATOR = " › "


def sanitise(query: str | None) -> str:
    """A query without NUL characters, cut to its first ``MAX_TERMS`` terms."""
    return " ".join((query or "").replace("\0", " ").split()[:MAX_TERMS])


def terms(query: str | None) -> list[str]:
    """Lower-case terms split at white space; repeated terms stay repeated."""
    return sanitise(query).lower().split()


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` stands in ``text`` without overlap; null text has none."""
    without = F.replace(text, F.lit(term), F.lit(""))
    return F.coalesce(((F.length(text) - F.length(without)) / F.lit(len(term))).cast("long"), F.lit(0))


def words(text: Column) -> Column:
    """The words of the whole text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def contextual(path: Column, body: Column) -> Column:
    """The section path and the body; the body alone where the path is empty or null."""
    return F.when(F.coalesce(F.size(path), F.lit(0)) > 0, F.concat(F.concat_ws(SEPARATOR, path), F.lit("\n"), body)).otherwise(body)


def glob_pattern(glob: str) -> str:
    """A Java pattern for a file-name glob: ``*`` and ``?`` cross slashes, ``[...]`` and ``[!...]`` are sets."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", r"\\").replace("&&", r"&\&").replace("[", r"\[")
            out += f"[^{body[1:]}]" if body.startswith("!") else "[" + ("\\" if body.startswith("^") else "") + body + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def glob_match(value: Column, glob: str) -> Column:
    """Whole-string, case-sensitive match; null counts as the empty string."""
    return F.coalesce(value, F.lit("")).rlike(glob_pattern(glob))


def snippet(text: Column, size: int = 200) -> Column:
    """One line of at most ``size`` characters, with dots where it was cut."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def content_id(kind: Column, path: Column, text: Column, start: Column, end: Column) -> Column:
    """``rec_`` and the SHA-256 of the canonical JSON of a record: keys in order, nulls kept."""
    body = F.struct(end.alias("end"), kind.alias("kind"), path.alias("section_path"), start.alias("start"), text.alias("text"))
    return F.concat(F.lit("rec_"), F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256))


def fifth(value: Column) -> Column:
    """The SHA-256 of a value, as a number, modulo 5: 16 is 1 modulo 5, so its digits are summed."""
    digits = F.split(F.sha2(value, 256), "")
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(F.conv(F.when(d != "", d), 16, 10).cast("int"), F.lit(0)))
    return (total % 5).cast("long")


def script_share(text: Column, script: str) -> tuple[Column, Column]:
    """Letters of a Unicode script and their share of the characters that aren't white space."""
    letters = F.regexp_count(text, F.lit(rf"\p{{Is{script}}}"))
    visible = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return letters, letters / F.nullif(visible, F.lit(0))


def fenced(text: Column) -> Column:
    """Triple backticks made harmless inside a fenced block."""
    return F.replace(text, F.lit("```"), F.lit("'''"))


def any_terms(text: Column, groups: list[list[str]]) -> Column:
    """Whether all terms of some group stand in the text at word edges; null text has none."""
    edge = lambda t: text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])\Q{t}\E(?![\p{{L}}\p{{N}}_])")
    found = F.lit(False)
    for group in groups:
        every = F.lit(True)
        for t in group:
            every = every & edge(t)
        found = found | every
    return F.coalesce(found, F.lit(False))
