"""Column functions over text: JSON verdicts, HTML, timestamps, truncation."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELLIPSIS = "…"
# Possessive, so that a long text neither backtracks nor recurses.
FLAT_OBJECT = r"\{(?:[^{}\"]++|\"(?:[^\"\\]++|\\.)*+\")*+\}"


def _fields(text: Column) -> Column:
    """The fields of a flat JSON object as text, the last value where a key is repeated."""
    return F.from_json(text, "map<string,string>")


def _is_object(text: Column) -> Column:
    return _fields(text).isNotNull()


def verdict_number(verdict: Column, field: str) -> Column:
    """A number of a JSON verdict, written with or without quotes, the last one of the name; null for anything else."""
    found = F.filter(F.map_entries(_fields(verdict)), lambda e: e["key"] == field)
    return F.try_element_at(found, F.lit(-1))["value"].try_cast("double")


def last_json_object(text: Column) -> Column:
    """The last flat JSON object in free text, null when there is none.

    When objects are nested the innermost one that closes last wins, as for a reader that
    keeps the last opening brace from which an object decodes.
    """
    candidates = F.filter(F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(0)), _is_object)
    return F.when(F.size(candidates) > 0, F.element_at(candidates, -1))


def verdict_of(reply: str | None) -> tuple[float, float] | None:
    """The numbers (yhat, confidence) of a reply's closing JSON verdict, as the column rules read them."""
    for found in reversed(re.findall(FLAT_OBJECT, reply or "")):
        try:
            verdict = json.loads(found)
        except ValueError:
            continue
        try:
            return float(verdict["yhat"]), float(verdict["confidence"])
        except (KeyError, TypeError, ValueError):
            return None
    return None


def narrative(text: Column) -> Column:
    """A briefing without its closing JSON verdict."""
    return strip(F.regexp_replace(text, r"(?U)\s*\{[^{}]*\}\s*$", ""))


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def utc_text(seconds: Column, pattern: str) -> Column:
    """Epoch seconds as UTC text, whatever the session's time zone."""
    epoch = F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    return F.date_format(F.timestamp_add("SECOND", seconds.cast("bigint"), epoch), pattern)


def labelled_count(summary: Column, label: str) -> Column:
    """The number after ``label:`` in a summary line, 0 when missing."""
    found = F.regexp_extract(summary, label + r":\s*(\d+)", 1)
    return F.coalesce(found.try_cast("bigint"), F.lit(0))


def excerpt(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, with an ellipsis when shortened."""
    line = strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(
        F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit(ELLIPSIS))
    ).otherwise(line)


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


BODY_START = "<!-- SC_OFF -->"
BODY_END = "<!-- SC_ON -->"


def html_to_text(content: Column) -> Column:
    """Plain text of an HTML fragment; only what lies between the body markers if both exist.

    Tags are removed in the JVM; entity decoding is the one step without a built-in, and only
    texts with an ampersand are sent to it.
    """
    content = F.coalesce(content, F.lit(""))
    marked = content.contains(BODY_START) & content.contains(BODY_END)
    after = F.get(F.split(content, BODY_START), F.lit(1))
    body = F.when(marked, F.get(F.split(after, BODY_END), F.lit(0))).otherwise(content)
    bare = F.regexp_replace(body, r"<[^>]+>", " ")
    decoded = F.coalesce(_unescape(F.when(bare.contains("&"), bare)), bare)
    spaced = F.regexp_replace(decoded, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(spaced)


# A full date, with or without dashes; then, if at all, a time with or without colons and a zone.
_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)


def iso_timestamp(text: Column) -> Column:
    """ISO timestamp text to a timestamp with its fraction; null for other forms, such as a bare year or time.

    Text without a zone is in the session's time zone.
    """
    part = lambda i: F.regexp_extract(text, _ISO, i)
    or_zero = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
    zone = F.regexp_replace(part(9), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    plain = F.concat(
        part(1), F.lit("-"), part(3), F.lit("-"), part(4), F.lit("T"), or_zero(5), F.lit(":"), or_zero(6), F.lit(":"), or_zero(7),
        F.lit("."), F.rpad(F.substring(part(8), 1, 6), 6, "0"), zone,
    )
    return F.when(text.rlike(_ISO), F.try_to_timestamp(plain))


def iso_epoch(text: Column) -> Column:
    """ISO timestamp text to epoch seconds, null when it does not parse."""
    return F.unix_micros(iso_timestamp(text)) / 1e6


def json_list(text: Column) -> Column:
    """A JSON array held as text; an empty array for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
