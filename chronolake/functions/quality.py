"""Quality metrics of a page's text and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolake.functions.text import ACCENTED

TABLES = (
    "array<struct<rows:int,columns:int,cells:array<struct<row:int,column:int,rowspan:int,colspan:int,value:string>>,markdown:string>>"
)
DIACRITIC = f"[{ACCENTED}{ACCENTED.upper()}]"
# Fixed value: what a page may hold besides letters, digits and space.
NOISE = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}À-ỹ.,;:!?%(){}\[\]\"'“”‘’\-+/=*#|<>]"


def null_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise(F.regexp_count(text, F.lit("[\\x{0000}\\x{FFFD}]")) / n)


def diacritic_density(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(F.coalesce(letters, F.lit(0)) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(DIACRITIC)) / letters)


def noise_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise(F.regexp_count(text, F.lit(NOISE)) / n)


def broken_cells(text: Column) -> Column:
    """How far the numbers of cells in lines with pipes are from the greatest of them."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.contains("|"))
    cells = F.transform(lines, lambda x: F.size(F.split(F.regexp_replace(F.regexp_replace(x, r"^\s*\|", ""), r"\|\s*$", ""), r"\|")))
    most, total = F.array_max(cells), F.aggregate(cells, F.lit(0), lambda a, c: a + c)
    off = F.aggregate(cells, F.lit(0), lambda a, c: a + F.abs(c - most))
    return F.when(F.size(lines) == 0, 0.0).otherwise(off / total)


def missing_headers(tables: Column) -> Column:
    """Whether a table has cells but none in its first row."""
    return F.coalesce(
        F.exists(tables, lambda t: (F.size(t["cells"]) > 0) & ~F.exists(t["cells"], lambda c: F.coalesce(c["row"], F.lit(1)) == 0)),
        F.lit(False),
    )


#: As TABLES, but with the text of the numbers, so that what is no number can be told from what is missing.
RAW_TABLES = (
    "array<struct<rows:string,columns:string,cells:array<struct<row:string,column:string,rowspan:string,colspan:string,value:string>>,markdown:string>>"
)


def bad_spans(tables: Column) -> Column:
    """Cells (parsed as RAW_TABLES) with a place or span that is no whole number, negative or below one, or outside the table.

    A missing row or column is 0, a missing span 1; tables without dimensions of one at least are passed over."""

    def bad(t: Column):
        def check(c: Column) -> Column:
            at = [F.coalesce(c[name], F.lit(default)) for name, default in (("row", "0"), ("column", "0"), ("rowspan", "1"), ("colspan", "1"))]
            row, column, down, across = (x.try_cast("int") for x in at)
            whole = [x.rlike("^-?[0-9]+$") for x in at]
            return ~(whole[0] & whole[1] & whole[2] & whole[3]) | (
                (row < 0) | (column < 0) | (down < 1) | (across < 1) | (row + down > t["rows"].try_cast("int")) | (column + across > t["columns"].try_cast("int"))
            )

        return check

    sized = lambda t: F.coalesce((t["rows"].try_cast("int") > 0) & (t["columns"].try_cast("int") > 0), F.lit(False))
    counted = F.transform(tables, lambda t: F.when(sized(t), F.size(F.filter(t["cells"], bad(t)))).otherwise(0))
    return F.coalesce(F.aggregate(counted, F.lit(0), lambda a, n: a + F.greatest(n, F.lit(0))), F.lit(0))


def metrics(text: Column, tables_json: Column) -> Column:
    """All six as one struct; without tables there are no issues of them."""
    return F.struct(
        null_ratio(text).alias("null_ratio"),
        diacritic_density(text).alias("diacritic_density"),
        noise_ratio(text).alias("ocr_noise_ratio"),
        broken_cells(text).alias("broken_cells_ratio"),
        missing_headers(F.from_json(tables_json, TABLES)).alias("missing_table_headers"),
        bad_spans(F.from_json(tables_json, RAW_TABLES)).alias("merged_cell_issues"),
    )
