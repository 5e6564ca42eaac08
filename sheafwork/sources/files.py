"""Files as rows: reading a folder of files whole, and writing one file for each row."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str | None = None, stream: bool = False) -> DataFrame:
    """All files below a folder: path, name, size, modified, content.  Spark reads no bytes where content isn't asked for, and leaves out files without bytes.

    As a stream, files that come later are rows of later batches; detection and parsing keep no state, so that their plans are the same there.
    """
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(path)
    return raw.select("path", F.col("_metadata.file_name").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write a file for each row, of text (UTF-8) or bytes; null is an empty file.  Returns name, bytes.

    Names are relative and should be unique: of equal ones any is left. Parts of a name that lead out of the folder are an error. A file is written under another name
    first, so that a task that is run again leaves whole files. Files are opened by pyarrow's file systems.
    """

    def run(batches):
        import pyarrow.fs as fs

        uri = f"s3://{folder[6:]}" if folder.startswith("s3a://") else folder  # pyarrow says s3 where Hadoop says s3a
        system, base = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")
        system.create_dir(base, recursive=True)
        for pdf in batches:
            sizes = []
            for n, c in zip(pdf["name"], pdf["content"], strict=True):
                if n.startswith("/") or ".." in n.split("/"):
                    raise ValueError(f"name: {n}")
                data = b"" if c is None else bytes(c)
                if "/" in n:
                    system.create_dir(f"{base}/{n.rpartition('/')[0]}", recursive=True)
                temp = f"{base}/.{uuid.uuid4().hex}"
                with system.open_output_stream(temp, compression=None) as out:
                    out.write(data)
                system.move(temp, f"{base}/{n}")
                sizes.append(len(data))
            yield pd.DataFrame({"name": pdf["name"], "bytes": sizes})

    return rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "name string, bytes long")
