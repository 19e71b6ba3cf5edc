"""Writing results: tables of documents, single files, retention."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(docs: DataFrame, path: str, partition_by: str | None = None) -> None:
    """(doc_id, html, ...) as Parquet: the form that scales."""
    writer = docs.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_html_lines(docs: DataFrame, path: str) -> None:
    """One JSON line for each document."""
    docs.select("doc_id", "html").write.mode("overwrite").json(path)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """One file for each row, written where the row lies; returns name, path, bytes.

    For a folder that all executors see.  A file appears under its name only when it is whole,
    so a task that is run again leaves nothing half written.  Names keep their last component.
    """
    source = rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))

    def run(batches):
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for file, data in zip(batch["name"], batch["content"], strict=True):
                path = os.path.join(folder, os.path.basename(file))
                draft = f"{path}.{os.getpid()}.part"
                with open(draft, "wb") as f:
                    f.write(bytes(data or b""))
                os.replace(draft, path)
                out.append((file, path, len(data or b"")))
            yield pd.DataFrame(out, columns=["name", "path", "bytes"])

    return source.mapInPandas(run, "name string, path string, bytes long")
