"""Reports as Markdown: the tables are the product, this only sets them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_lines(df: DataFrame, titles: dict[str, str] | None = None) -> tuple[str, DataFrame]:
    """The header of a pipe table, and a line for each row; bars inside cells are escaped."""
    names = [(titles or {}).get(c, c) for c in df.columns]
    head = f"| {' | '.join(names)} |\n|{'---|' * len(names)}"
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return head, df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_report(df: DataFrame, path: str, title: str, note: str = "", titles: dict[str, str] | None = None) -> None:
    """One report of a table that is small by nature (a ranking or a to-do list); rows stay in the order they come in."""
    head, lines = table_lines(df, titles)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"# {title}\n\n{note}\n\n{head}\n" if note else f"# {title}\n\n{head}\n")
        for row in lines.toLocalIterator():
            out.write(row.line + "\n")
