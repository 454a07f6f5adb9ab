"""Tables on pages: extracted rows of cells in the one form that the quality metrics read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = "array<array<string>>"


def normalised(rows: Column, markdown: Column | None = None) -> Column:
    """Rows of values (uneven ones padded with NULL to the widest) as rows, columns, and cells of one row and column each.

    NULL or no rows give a table of no rows and no cells, and an empty list of cells stays a list."""
    rows = F.coalesce(rows, F.array().cast(ROWS))
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    numbers = F.when(width > 0, F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def cell(row: Column, r: Column):
        return lambda c: F.struct(
            r.alias("row"), c.alias("column"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.when(c < F.size(row), F.get(row, c)).alias("value")
        )

    cells = F.flatten(F.transform(rows, lambda row, r: F.transform(numbers, cell(row, r))))
    return F.struct(F.size(rows).alias("rows"), width.alias("columns"), cells.alias("cells"), (F.lit(None).cast("string") if markdown is None else markdown).alias("markdown"))


def markdown_rows(text: Column) -> Column:
    """The rows of values of the lines with pipes in a text, lines of dashes left out."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.contains("|") & ~x.rlike(r"^[\s|:-]*$"))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\|", ""), r"\|\s*$", "")
    return F.transform(lines, lambda x: F.transform(F.split(bare(x), r"\|"), lambda v: F.trim(v)))
