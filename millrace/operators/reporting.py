"""Reports as text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_rows(table: DataFrame, keys: list[str], mean: str, sd: str, low: str, high: str) -> DataFrame:
    """(line): a Markdown table row for each row: keys, then mean ± sd [low, high] to four places."""
    figures = F.format_string("%.4f ± %.4f [%.4f, %.4f]", mean, sd, low, high)
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *keys), F.lit(" | "), figures, F.lit(" |")).alias("line"))


def signed(value: str) -> Column:
    """A difference with its sign, to four places."""
    return F.format_string("%+.4f", value)
