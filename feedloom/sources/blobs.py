"""Files as rows: media read from and written to a blob store, by any file system that Spark (reading) or Arrow (writing) knows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_blobs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, path, length, content) of the files below a folder whose names fit; content is only read where it is asked for.
    Empty files have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "content")


def _put(folders: list[str]):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        stores = [fs.FileSystem.from_uri(f) for f in folders]
        for batch in batches:
            paths: list[str | None] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                done = None
                for (store, base), folder in zip(stores, folders, strict=True):
                    try:
                        store.create_dir(base, recursive=True)
                        with store.open_output_stream(f"{base}/{name}") as out:
                            out.write(content.as_buffer())
                        done = f"{folder}/{name}"
                        break
                    except OSError:
                        continue
                paths.append(done)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["name", "path"])

    return put


def write_blobs(df: DataFrame, folder: str, name_col: str = "name", content_col: str = "content", fallback: str | None = None) -> DataFrame:
    """(name, path) of each row's file, written where it is; the path is null where neither the folder nor the fallback takes it.

    Files of one name overwrite each other, so a task that runs again does no harm. Rows without a name or content write nothing.
    On a cluster both folders must be shared. The result is lazy: files are written when it is.
    """
    rows = df.select(F.col(name_col).cast("string").alias("name"), F.col(content_col).cast("binary").alias("content")).where("name is not null and content is not null")
    return rows.mapInArrow(_put([folder.rstrip("/"), *([fallback.rstrip("/")] if fallback else [])]), "name string, path string")
