"""Dates written in prose. An invalid date is NULL, never an error, unless a function says that it is strict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolake.functions.text import fold

_ISO = r"(?<![0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9])"
_SHORT = r"(?<![0-9])([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})(?![0-9])"
_LONG = r"(?iu)ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})\s+năm\s+([0-9]{4})"
_BARE_LONG = r"(?iu)(?<![0-9])([0-9]{1,2})\s+tháng\s+([0-9]{1,2})\s+năm\s+([0-9]{4})(?![0-9])"

# What a question says about the date it names.
STATUS = (
    "đã.{0,30}có hiệu lực",
    "có hiệu lực.{0,30}(?:chưa|không)",
    "còn hiệu lực.{0,30}(?:chưa|không)",
    "nằm trong mốc hiệu lực",
    "mốc hiệu lực.{0,30}(?:đến|chưa)",
    "được coi là.{0,30}hiệu lực",
)
EFFECTIVE = ("có hiệu lực", "còn hiệu lực", "hết hiệu lực", "áp dụng")
CONTENT = (
    "điều chỉnh.{0,60}(?:gì|nhóm|vấn đề|nội dung|phạm vi)",
    "quy định.{0,60}(?:gì|nhóm|vấn đề|nội dung|phạm vi)",
    "phạm vi điều chỉnh",
    "nội dung chính",
    "nội dung của",
    "liệt kê",
    "định nghĩa",
)
ISSUED_CATEGORIES = ("document_understanding", "amendment_retrieval")
BASES = ("issued", "effective", "status")
SIGNED_AT = r"(?:ha\s+no?i|tp\.?\s*ho\s+chi\s+minh)\s*[,;:]?\s*ngay\s+([0-9]{1,2})\s+thang\s+([0-9]{1,2})\s+nam\s+([0-9]{4})"


def made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _first(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    return made(*(F.regexp_extract(text, pattern, g) for g in order))


def strict_date(text: Column) -> Column:
    """An ISO date; blank, "null" and "none" are NULL, anything else is an error."""
    bare = F.trim(text)
    return F.when(~F.lower(bare).isin("", "null", "none"), F.to_date(bare, "yyyy-MM-dd"))


def event_date(text: Column) -> Column:
    """The date of a question: the first form it has of ISO, d/m/y or d.m.y, "ngày d tháng m năm y"."""
    return (
        F.when(text.rlike(_ISO), _first(text, _ISO, (1, 2, 3)))
        .when(text.rlike(_SHORT), _first(text, _SHORT, (3, 2, 1)))
        .when(text.rlike(_LONG), _first(text, _LONG, (3, 2, 1)))
    )


def mentioned_dates(text: Column) -> Column:
    """All dates that a text states, in any of the three forms; whether it mentions a given one is then array_contains."""

    def every(pattern: str, order: tuple[int, int, int]) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: _first(x, pattern, order))

    return F.array_distinct(F.array_compact(F.concat(every(_ISO, (1, 2, 3)), every(_SHORT, (3, 2, 1)), every(_BARE_LONG, (3, 2, 1)))))


def mentions_date(text: Column, day: Column) -> Column:
    return F.coalesce(F.array_contains(mentioned_dates(text), day), F.lit(False))


def issued_date(text: Column) -> Column:
    """The first date beside a place of signing; if that is no date, none."""
    return _first(fold(text), SIGNED_AT, (3, 2, 1))


def date_basis(query: Column) -> Column:
    """What the date in a question is about: status, effective (also where nothing tells) or issued."""
    q = F.lower(query)
    return (
        F.when(q.rlike("|".join(STATUS)), "status")
        .when(q.rlike("|".join(EFFECTIVE)), "effective")
        .when(q.rlike("|".join(CONTENT)), "issued")
        .otherwise("effective")
    )


def sample_basis(told: Column, query: Column, category: Column) -> Column:
    """The basis of a sample: the one it states, else by its question's wording, else by its category; others are an error."""
    known = F.when(told.isin(*BASES), told).when(told.isNotNull(), F.raise_error(F.concat(F.lit("unknown date basis "), told)))
    return F.coalesce(
        known, F.when(F.lower(query).rlike("|".join(STATUS)), "status"), F.when(category.isin(*ISSUED_CATEGORIES), "issued"), F.lit("effective")
    )


def in_force(start: Column, end: Column, at: Column) -> Column:
    """Three-valued: NULL where the start is unknown; the interval is half open."""
    return F.when(start.isNotNull(), (start <= at) & (end.isNull() | (at < end)))
