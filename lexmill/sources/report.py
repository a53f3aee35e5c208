"""Result tables for people."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a Markdown table; a report, so that the rest is left out."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in df.take(rows))]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)
