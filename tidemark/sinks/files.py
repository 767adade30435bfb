"""CSV and Parquet sinks and the per-class layout."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Quotes are doubled, and spaces at the ends of a field are kept.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_per_class(
    df: DataFrame,
    path: str,
    class_col: str = "class",
    fmt: str = "csv",
    mode: str = "errorifexists",
    replace_classes: bool = False,
    rows_per_file: int = 5_000_000,
) -> None:
    """One directory ``<class_col>=<id>`` per class. To keep the class inside the files as well, so
    that they can be ingested again, pass it twice: as a contract column and as ``class_col``.

    Rows are sent to tasks by class, so a class has few files. ``rebalance`` lets adaptive
    execution split a class much larger than the others over several tasks. With
    ``replace_classes`` an overwrite touches only the classes in ``df``.
    """
    writer = df.hint("rebalance", class_col).write.mode(mode).partitionBy(class_col)
    writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer = writer.option("partitionOverwriteMode", "dynamic" if replace_classes else "static")
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.parquet(path)
