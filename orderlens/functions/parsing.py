"""Text to typed values: dates in mixed layouts, JSON inside prose, messy numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _attempt(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout))


def _two_digit_year(text: Column, layout: str) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    parsed = _attempt(text, layout)
    late = F.pmod(F.year(parsed), F.lit(100)) >= 69
    return F.when(late, parsed - F.make_ym_interval(F.lit(100))).otherwise(parsed)


def parse_order_date(raw: Column) -> Column:
    """Timestamp of a date text in any accepted layout, NULL for anything else.

    The shape of the text picks the layout, so a value is parsed once or, where
    month and day could be swapped, twice. Month first wins. A time of day may follow;
    one with a zone is converted to the session's.
    """
    text, clock = F.trim(raw), "[ H:mm[:ss]]"
    behind = r"( \d{1,2}:\d{2}(:\d{2})?)?$"
    half = r" \d{1,2}:\d{2}(:\d{2})? ?[AaPp][Mm]$"
    # month names by their first three letters, halves of the day in capitals behind one space
    named = F.regexp_replace(F.initcap(F.lower(F.regexp_replace(text, "[-, ]+", " "))), r"([A-Z][a-z]{2})[a-z]*", "$1")
    halved = F.upper(F.regexp_replace(text, r" ?([AaPp][Mm])$", " $1"))
    am_pm = " h:mm[:ss] a"
    return (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), text.try_cast("timestamp"))
        .when(text.rlike(r"^\d{4}/"), _attempt(text, f"yyyy/M/d{clock}"))
        .when(text.rlike(r"^\d{8}$"), _attempt(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}" + behind), F.coalesce(
            _attempt(text, f"M/d/yyyy{clock}"), _attempt(text, f"d/M/yyyy{clock}")))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}" + behind), F.coalesce(
            _two_digit_year(text, f"M/d/yy{clock}"), _two_digit_year(text, f"d/M/yy{clock}")))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}" + half), F.coalesce(
            _attempt(halved, f"M/d/yyyy{am_pm}"), _attempt(halved, f"d/M/yyyy{am_pm}")))
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}" + behind), F.coalesce(
            _attempt(text, f"M-d-yyyy{clock}"), _attempt(text, f"d-M-yyyy{clock}")))
        .when(text.rlike(r"^\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{4}$"), _attempt(named, "d MMM yyyy"))
        .when(text.rlike(r"^\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{2}$"), _two_digit_year(named, "d MMM yy"))
        .when(text.rlike(r"^[A-Za-z]{3,9} \d{1,2},? \d{4}$"), _attempt(named, "MMM d yyyy"))
    )


def clean_id(raw: Column) -> Column:
    """Ids compare as trimmed text, whatever type they arrived in."""
    return F.trim(raw.cast("string"))


def joined_key(separator: str, *parts: Column) -> Column:
    """Parts as one text that no other parts give: a separator within a part is escaped by a backslash."""
    mark = "\\"
    return F.concat_ws(separator, *[
        F.replace(
            F.replace(part.cast("string"), F.lit(mark), F.lit(mark * 2)), F.lit(separator), F.lit(mark + separator)
        )
        for part in parts
    ])


def json_object(text: Column, schema: T.StructType | str) -> Column:
    """Fields of a text that is exactly one JSON object; NULL for any other text.

    Read as the only element of an array: alone, an object would be accepted with
    anything behind it, and a broken one would give a struct of NULLs.
    """
    fields = schema if isinstance(schema, str) else schema.simpleString()
    kind = fields if fields.startswith("struct<") else f"struct<{fields}>"
    elements = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>")
    return F.when(F.size(elements) == 1, elements[0])


def json_from_text(text: Column, schema: T.StructType | str, default: Column | None = None) -> Column:
    """JSON object found in free text, from the first opening to the last closing brace.

    ``default`` when there is none or it is broken.
    """
    parsed = json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
    return parsed if default is None else F.coalesce(parsed, default)


def lenient_double(raw: Column) -> Column:
    """A number, or NULL where the text is none."""
    return raw.try_cast("double")
