"""Reports of a backtest: CSV by Spark, text and Markdown from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def trades_of(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'trade'")


def events_of(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'event'").select("symbol", "source", F.col("entry_time").alias("timestamp"), F.col("type").alias("event"), "direction", "session", F.col("entry_reason").alias("action"), F.col("entry_price").alias("bid"), F.col("exit_price").alias("ask"))


def overview(rows: DataFrame) -> dict:
    """The figures of a report; each comes from one aggregate of a few rows."""
    t = trades_of(rows)
    return {
        "summary": metrics.summary(t).first().asDict(),
        "sessions": [r.asDict() for r in metrics.by_domain(t, "session", ("asian", "london", "newyork")).orderBy("session").collect()],
        "trends": [r.asDict() for r in metrics.by_domain(t, "trend", ("bull", "bear")).orderBy("trend").collect()],
        "types": [r.asDict() for r in metrics.by_domain(t, "type", ("T1", "T2")).orderBy("type").collect()],
        "funnel": [r.asDict() for r in metrics.funnel(rows).orderBy("reason").collect()],
        "last_events": [r.asDict() for r in events_of(rows).orderBy(F.col("timestamp").desc()).limit(50).collect()],
    }


def text(figures: dict) -> str:
    return "\n".join(f"{k:>14}: {v:.4f}" if isinstance(v, float) else f"{k:>14}: {v}" for k, v in figures["summary"].items())


def markdown(figures: dict) -> str:
    out = ["# Backtest", "", "| metric | value |", "| --- | --- |", *[f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in figures["summary"].items()]]
    for name in ("sessions", "trends", "types", "funnel", "last_events"):
        rows = figures[name]
        out += ["", f"## {name}", ""]
        if rows:
            heads = list(rows[0])
            out += ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads), *["| " + " | ".join(str(r[h]) for h in heads) + " |" for r in rows]]
        else:
            out.append("none")
    return "\n".join(out) + "\n"
