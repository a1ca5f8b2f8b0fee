"""Row-level views: search, sort, page, duplicate flags and small samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import col, require_columns

MAX_PAGE_SIZE = 200
MAX_SAMPLE_ROWS = 20
PREVIEW_ROWS = 5


def search(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose space-joined text contains ``needle``, ignoring case.  Nulls contribute nothing."""
    if not needle:
        return df
    text = F.lower(F.concat_ws(" ", *[col(c).cast("string") for c in df.columns]))
    return df.where(text.contains(needle.lower()))


def sort_rows(df: DataFrame, by: str | Sequence[str], descending: bool | Sequence[bool] = False,
              tiebreak: Sequence[str] = ()) -> DataFrame:
    """Order by one or more columns, missing values last in both directions."""
    return df.orderBy(*_ordering(df, by, descending, tiebreak))


def _ordering(df, by, descending, tiebreak) -> list[Column]:
    names = [by] if isinstance(by, str) else list(by)
    flags = [descending] * len(names) if isinstance(descending, bool) else list(descending)
    require_columns(df, [*names, *tiebreak])
    order = [col(n).desc_nulls_last() if d else col(n).asc_nulls_last() for n, d in zip(names, flags, strict=True)]
    return order + [col(t).asc_nulls_last() for t in tiebreak]


def page(
    df: DataFrame,
    page_number: int,
    page_size: int,
    key: str,
    sort_by: str | Sequence[str] | None = None,
    descending: bool | Sequence[bool] = False,
    needle: str | None = None,
    where: Column | None = None,
) -> DataFrame:
    """One page of rows in a stable order.

    Search and structured filters apply first; without ``sort_by`` rows come in key order.  Only
    the best ``page_number * page_size`` rows of each partition take part in the final merge.
    """
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"a page holds from 1 to {MAX_PAGE_SIZE} rows, not {page_size}")
    if page_number < 1:
        raise ValueError(f"pages are counted from 1, so there is no page {page_number}")
    rows = df if where is None else df.where(where)
    rows = search(rows, needle) if needle else rows
    order = _ordering(df, sort_by or [], descending if sort_by else [], [key])
    return rows.orderBy(*order).offset((page_number - 1) * page_size).limit(page_size)


def flag_duplicates(page_rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mark every row of a page that has an equal on the same page (all copies)."""
    names = list(columns or page_rows.columns)
    return page_rows.withColumn(
        "is_duplicate", F.count(F.lit(1)).over(Window.partitionBy(*[col(n) for n in names])) > 1)


def sample_rows(df: DataFrame, key: str | None = None, size: int = PREVIEW_ROWS) -> DataFrame:
    """The first few rows (in key order when a key is given)."""
    size = min(size, PREVIEW_ROWS)
    return (df.orderBy(col(key)) if key else df).limit(size)


def column_sample(df: DataFrame, column: str, size: int = 10, key: str | None = None) -> DataFrame:
    """Up to ``size`` (never more than the cap) non-null values of one column."""
    require_columns(df, [column])
    present = df.where(col(column).isNotNull())
    present = present.orderBy(col(key)) if key else present
    return present.limit(min(size, MAX_SAMPLE_ROWS)).select(col(column).alias("value"))
