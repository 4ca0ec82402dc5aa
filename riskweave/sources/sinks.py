"""Sinks. Appends are partitioned by the batch that made them, so a rerun replaces its own part only."""

from __future__ import annotations

import logging
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """One batch's rows under batch=<name>; repeating the write gives the same table."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def write_ids(df: DataFrame, path: str, columns: list[str]) -> None:
    """Space-delimited lines without a header."""
    df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, column: str = "value", order: str | None = None) -> None:
    """Lines; with an order they stand in it from file to file, by the files' names, and within each."""
    lines = df.orderBy(order) if order else df
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def log_to(path: str, name: str = "riskweave") -> logging.Logger:
    """A logger whose lines go to a new file <path>/<name>-<time>.log, with times; one for each run of a driver."""
    Path(path).mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(Path(path) / f"{name}-{datetime.now():%Y%m%d-%H%M%S-%f}.log", encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logger = logging.getLogger(name)
    for old in logger.handlers[:]:
        logger.removeHandler(old)
        old.close()
    logger.addHandler(handler)
    logger.setLevel(logging.INFO)
    return logger


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """One folder for each sheet of a report."""
    for name, df in tables.items():
        write_csv(df, f"{path.rstrip('/')}/{name}")


def write_matrices(df: DataFrame, path: str) -> None:
    """Interaction rows by family and split."""
    df.write.mode("overwrite").partitionBy("family", "split").parquet(path)
