"""Cutting plans where what follows reads a result several times, and the shared folder for files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one is set only where it is unset and all runs on one machine."""
    holder = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if holder.getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}")
    return named or holder.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, into reliable checkpoint files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame, folder: str) -> DataFrame:
    """df computed once, into column files in folder: readers of few columns read no others. It is gone when the folder is."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def together(spark: SparkSession, *jobs: Callable) -> list:
    """Results of jobs that don't wait for each other, run at the same time: each alone leaves executors idle at its ends."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def put_files(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A new folder beside the checkpoints with the given (small) files; returns its address."""
    import pyarrow.fs as pafs

    folder = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    fs, base = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    fs.create_dir(base, recursive=True)
    for name, data in files.items():
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(data)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
