"""Records in files: JSON lines and CSV by Spark's own readers and writers, with stated schemas so that no pass infers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are no JSON become rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header. With ``multi_line`` quoted values may span lines, and then a file is one task's, as it cannot be split."""
    return spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def write_json_lines(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    rows.write.mode("overwrite").partitionBy(*by).json(path) if by else rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A report's table; it raises if there are more than ``limit`` rows, as a report is read by people."""
    found = _few(rows, limit)
    lines = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v).replace("|", "\\|") for v in r] for r in found]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def latex(rows: DataFrame, limit: int = 1000) -> str:
    """A report's table for LaTeX, under the same bound as :func:`markdown`."""
    found = _few(rows, limit)
    lines = [" & ".join(rows.columns), *[" & ".join("" if v is None else str(v).replace("&", "\\&").replace("_", "\\_") for v in r) for r in found]]
    return "\\begin{tabular}{" + "l" * len(rows.columns) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}\n"


def html(rows: DataFrame, limit: int = 1000) -> str:
    """A report's table for the web, under the same bound as :func:`markdown`."""
    from html import escape

    found = _few(rows, limit)
    line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in r) + "</tr>"
    return "<table>" + line("th", rows.columns) + "".join(line("td", r) for r in found) + "</table>\n"


def _few(rows: DataFrame, limit: int) -> list:
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows")
    return found
