"""Picture files: image structs as lossless PNG, one file for each ad."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

from spendlens.session import ship


def png(width: int, height: int, channels: int, data: bytes) -> bytes:
    """A PNG of rows of 8-bit pixels in the order of Spark's image source: gray, BGR or BGRA."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels >= 3:
        pixels = pixels[:, :, [2, 1, 0, 3][:channels]]
    rows = np.zeros((height, 1 + width * channels), dtype=np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = pixels.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes ``<ad_id>.png`` with each row's ``content`` into a folder all tasks reach; returns how many.

    A task that is repeated writes the same files again.
    """
    uri = folder if "://" in folder else f"file://{folder}"

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for ad, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with fs.open_output_stream(f"{base}/{ad}.png") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    ship(files.sparkSession)
    return files.select("ad_id", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def write_pictures(images: DataFrame, folder: str) -> int:
    """``write_files`` for rows of ``ad_id, image``; rows without pixels write none."""

    def run(batches):
        for batch in batches:
            made = [png(i["width"], i["height"], i["nChannels"], i["data"]) if i and i["width"] > 0 and i["height"] > 0 else None for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["ad_id", "content"])

    ship(images.sparkSession)
    return write_files(images.select("ad_id", "image").mapInArrow(run, "ad_id string, content binary").where("content IS NOT NULL"), folder)
