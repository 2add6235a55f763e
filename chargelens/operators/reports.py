"""Markdown of small results. The frame must be an aggregate: more rows than ``most`` are refused, not cut."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _text(v) -> str:
    if v is None:
        return ""
    return f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report's table holds at most {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(_text(v) for v in r) + " |" for r in rows])


def report(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{table(df, most)}" for name, df in sections.items()]]) + "\n"
