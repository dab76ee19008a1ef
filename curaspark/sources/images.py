"""Images: listing, reading and decoding.

Spark's file index drops every path with a component that starts with ``_``, so
listing goes through the Hadoop file system API of the driver and the bytes are
read by tasks, from the listed paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError, RowError
from ..functions.text import eligible, normalize_path
from ..session import map_arrow, ship_package

DECODED = "byte_size bigint, image_sha256 string, source_mode string, image_width int, image_height int, image_status string, error_code string, error_message string, error_stage string, exception_type string"


@dataclass(frozen=True)
class Decoded:
    """What a decoder returns: ``pixels`` stay inside the task."""

    mode: str
    width: int
    height: int
    pixels: object = None


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """raw_path of all files below a folder (any Hadoop file system), relative to it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    prefix = fs.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    found, walk = [], fs.listFiles(base, True)
    while walk.hasNext():
        found.append((walk.next().getPath().toUri().getPath().removeprefix(prefix),))
    return spark.createDataFrame(found, "raw_path string")


def eligible_paths(listed: DataFrame) -> DataFrame:
    """raw_path, image_path of the files that a run takes, in path order; paths that leave the folder or meet are errors."""
    named = listed.select("raw_path", normalize_path(F.col("raw_path")).alias("image_path"))
    bad = named.filter("image_path is null").limit(1).collect()
    if bad:
        raise ConfigurationError(f"unsafe path: {bad[0].raw_path!r}")
    twice = named.groupBy("image_path").agg(F.countDistinct("raw_path").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ConfigurationError(f"several files are named {twice[0].image_path!r}")
    return named.filter(eligible(F.col("image_path"))).orderBy("image_path")


def read_bytes(root: str) -> Callable[[str], bytes]:
    """A reader of paths below a local or mounted folder; paths that leave it are refused."""
    import os

    top = os.path.realpath(root.removeprefix("file://"))

    def read(path: str) -> bytes:
        full = os.path.realpath(os.path.join(top, path))
        if os.path.commonpath([top, full]) != top:
            raise PermissionError("the path leaves the folder")
        with open(full, "rb") as f:
            return f.read()

    return read


def scan(paths: DataFrame, read: Callable[[str], bytes], decode: Callable[[bytes], Decoded] | None) -> DataFrame:
    """Adds DECODED to image_path: one narrow stage, in which a bad file is a row with its error. Without ``decode`` only the hash is taken."""
    import hashlib

    def one(path: str) -> tuple:
        try:
            data = read(path)
        except Exception as e:
            return None, None, None, None, None, "ERROR", "IMAGE_READ_FAILED", str(e), "read", type(e).__name__
        sha = hashlib.sha256(data).hexdigest()
        try:
            if not data:
                raise RowError("IMAGE_DECODE_FAILED", "decode", "the file is empty")
            if decode is None:
                return len(data), sha, None, None, None, "OK", None, None, None, None
            got = decode(data)
            if got.width <= 0 or got.height <= 0:
                raise RowError("INVALID_IMAGE_DIMENSIONS", "decode", f"{got.width} x {got.height}")
            return len(data), sha, got.mode, got.width, got.height, "OK", None, None, None, None
        except RowError as e:
            return len(data), sha, None, None, None, "ERROR", e.code, str(e), e.stage, type(e).__name__
        except Exception as e:
            return len(data), sha, None, None, None, "ERROR", "IMAGE_DECODE_FAILED", str(e), "decode", type(e).__name__

    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5]
    names = [x.split()[0] for x in DECODED.split(", ")]

    def run(batches):
        for batch in batches:
            made = list(zip(*map(one, batch.column("image_path").to_pylist()), strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("image_path"), *(pa.array(x, t) for x, t in zip(made, types, strict=True))], ["image_path", *names])

    return map_arrow(paths.select("image_path"), run, "image_path string, " + DECODED)


def changed(first: DataFrame, second: DataFrame) -> DataFrame:
    """image_path of the images whose bytes differ between two scans, or that could not be read again (code, stage)."""
    j = first.filter("image_sha256 is not null").select("image_path", "image_sha256").join(second.select("image_path", F.col("image_sha256").alias("_again")), "image_path", "left")
    code = F.when(F.col("_again").isNull(), "IMAGE_REREAD_FAILED").when(F.col("_again") != F.col("image_sha256"), "IMAGE_CHANGED_DURING_RUN")
    return j.select("image_path", code.alias("error_code"), F.lit("embedding_read").alias("stage")).filter("error_code is not null")
