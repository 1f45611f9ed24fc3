"""Files that executors write into the shared folder, and that Spark reads back."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def write_file(folder: str, name: str, data: bytes) -> str:
    """Writes folder/name at once and returns it. A task that is run again writes the same bytes under the same name.

    Local and mounted folders get the file under another name first and have it
    renamed; other stores (s3, gcs, hdfs) are reached by pyarrow.
    """
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        os.makedirs(where.path, exist_ok=True)
        path = f"{where.path}/{name}"
        with open(temp := f"{where.path}/.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(temp, path)
        return f"{folder}/{name}"
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temp = f"{path}/.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(data)
    store.move(temp, f"{path}/{name}")
    return f"{folder}/{name}"


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
