"""Images in and out: PNG and JPEG files as pixel tables, pixel tables as PNG and JPEG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tesselle.functions import stats
from tesselle.operators import drawing
from tesselle.sources import pngfile
from tesselle.sources.jpeg import jpeg

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"


def rgba(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Decoded bytes of the image source (gray, BGR or BGRA) as (height, width, 4); alpha 255 where there is none."""
    v = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = v if channels == 1 else v[:, :, 2::-1]
    if channels == 4:
        out[:, :, 3] = v[:, :, 3]
    return out


def load_images(spark: SparkSession, path: str, skip_bad: bool = False) -> DataFrame:
    """(image_id, origin, width, height, nChannels, data) of PNG and JPEG files.

    A path without files is an error, and so is a file that is no picture, when its row is read; with
    ``skip_bad`` such files are left out. The id is a hash of the file's name, so it does not depend on
    which other files there are. Spark's image source decodes; the PNG forms that it gets wrong are told
    by their first bytes and decoded apart.
    """
    read = spark.read.format("image").option("dropInvalid", skip_bad).load(path)
    if skip_bad:
        return _mended(spark, path, with_id(read))
    bad = F.raise_error(F.concat(F.lit("not a picture: "), F.col("image.origin"))).cast("binary")
    fields = [F.when(F.col("image.nChannels") > 0, F.col("image.data")).otherwise(bad).alias("data") if f == "data" else F.col(f"image.{f}") for f in ("origin", "height", "width", "nChannels", "mode", "data")]
    return _mended(spark, path, with_id(read.select(F.struct(*fields).alias("image"))))


def _mended(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").load(path)
    head = F.substring("content", 1, 4096)
    form = F.substring(F.hex(F.substring("content", 25, 2)), 1, 4)  # bits and colour type
    clear_gray = form.isin("0100", "0200", "0400", "0800") & F.contains(head, F.lit(b"tRNS"))
    odd = files.filter((F.substring(form, 1, 2) == "10") | (F.substring(form, 3, 2) == "04") | clear_gray)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    v = pngfile.decode(content)
                except (ValueError, KeyError, struct.error, zlib.error):
                    continue  # the image source's row, or its error, stands
                n = v.shape[2]
                bgr = np.concatenate([v[:, :, 2::-1], v[:, :, 3:]], axis=2)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int32()), pa.array([bgr.tobytes()], pa.binary())], names=["__file", "__n", "__data"])

    def plain(name: Column) -> Column:
        return F.regexp_replace(name, "^([A-Za-z0-9+.-]+):/+", "$1:/")

    right = odd.select(plain(F.col("path")).alias("__file"), "content").mapInArrow(decode, "__file string, __n int, __data binary")
    got = images.join(right, plain(F.col("origin")) == F.col("__file"), "left")
    return got.select("image_id", "origin", "width", "height", F.coalesce("__n", "nChannels").alias("nChannels"), F.coalesce("__data", "data").alias("data"))


def with_id(images: DataFrame) -> DataFrame:
    i = images.select("image.*")
    return i.select(F.xxhash64("origin").alias("image_id"), "origin", "width", "height", "nChannels", "data")


def to_pixels(images: DataFrame) -> DataFrame:
    """The dense pixel table (image_id, y, x, r, g, b, a) of packed images, a few image rows at a time."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                i, w, h, c, data = (b.column(n)[k].as_py() for n in ("image_id", "width", "height", "nChannels", "data"))
                px = rgba(data, w, h, c).astype(np.int32)
                lines = max(1, 65536 // w)
                for y in range(0, h, lines):
                    part = px[y : y + lines]
                    n = part.shape[0] * w
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int64)), pa.array(np.repeat(np.arange(y, y + part.shape[0], dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), part.shape[0])), *[pa.array(part[:, :, j].ravel()) for j in range(4)]], names=["image_id", "y", "x", "r", "g", "b", "a"])

    return images.select("image_id", "width", "height", "nChannels", "data").mapInArrow(explode, PIXELS)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width) gray, or (height, width, 3 or 4) colour."""
    h, w = pixels.shape[:2]
    c = 1 if pixels.ndim == 2 else pixels.shape[2]
    lines = np.zeros((h, 1 + w * c), np.uint8)
    lines[:, 1:] = pixels.reshape(h, w * c)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def encoded(pixels: np.ndarray, kind: str = "png", quality: int = 95) -> bytes:
    """A picture file's bytes by type: png, or jpg or jpeg with a quality of 1 to 100; other types are an error."""
    if kind.lower() == "png":
        return png(pixels)
    if kind.lower() in ("jpg", "jpeg"):
        return jpeg(pixels, quality)
    raise ValueError(f"cannot write images of type {kind}")


def packed(pixels: DataFrame, by: str = "image_id", channels: tuple[str, ...] = ("r", "g", "b"), kind: str = "png", quality: int = 95) -> DataFrame:
    """(``by``, data): each picture's file, packed one picture at a time; places without a row are 0.

    Values are clamped to 0..255. Pictures have as many rows and columns as their largest places tell.
    """
    import pandas as pd

    encoded(np.zeros((1, 1), np.uint8), kind, quality)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        out = np.zeros((h, w, len(channels)), np.uint8)
        out[pdf.y, pdf.x] = pdf[list(channels)].to_numpy()
        return pd.DataFrame({by: [pdf[by].iloc[0]], "data": [encoded(out[:, :, 0] if len(channels) == 1 else out, kind, quality)]})

    cast = [F.least(F.greatest(F.col(c), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in channels]
    rows = pixels.select(by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *cast)
    return rows.groupBy(by).applyInPandas(pack, f"`{by}` {rows.schema[by].dataType.simpleString()}, data binary")


class PictureSink(DataSource):
    """``df.write.format("pictures").option("path", ...)``: rows (name string, data binary) become files.

    The path may be any URI the Arrow file systems know. Names may hold folders, which are made; a task
    writes under a draft name and renames, so a repeated attempt leaves whole files. Mode ``append``
    replaces files of the same name and leaves others, ``overwrite`` empties the path first.
    """

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PictureWriter(self.options["path"], overwrite)


class _PictureWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        if overwrite:  # on the driver, before any task writes
            from pyarrow import fs

            target, base = self._target()
            if target.get_file_info(base).type == fs.FileType.Directory:
                target.delete_dir_contents(base)

    def _target(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        target, base = self._target()
        for row in rows:
            name = f"{base}/{row['name']}"
            target.create_dir(name.rsplit("/", 1)[0], recursive=True)
            draft = f"{name}.{uuid.uuid4().hex}"
            with target.open_output_stream(draft) as f:
                f.write(bytes(row["data"]))
            target.move(draft, name)
        return WriterCommitMessage()


def save_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Write (name, data) as files under ``path``; mode ``append`` or ``overwrite``."""
    files.sparkSession.dataSource.register(PictureSink)
    files.select("name", "data").write.format("pictures").mode(mode).option("path", path).save()


def save_images(pixels: DataFrame, path: str, kind: str = "png", quality: int = 95, channels: tuple[str, ...] = ("r", "g", "b"), mode: str = "append") -> None:
    """Write each image of a pixel table as NNNN.<kind>, by its id."""
    name = F.concat(F.format_string("%04d", F.col("image_id")), F.lit(f".{kind.lower()}"))
    save_files(packed(pixels, "image_id", channels, kind, quality).select(name.alias("name"), "data"), path, mode)


def save_signed(pixels: DataFrame, path: str, value: str = "v", **how) -> None:
    """Write images of any numbers: between their least and largest value where there is a negative one, else by the largest."""
    ends = stats.image_extent(pixels, value).select("image_id", (F.coalesce("lo", F.lit(0.0)) < 0).alias("__signed"))
    own = pixels.select("image_id", "y", "x", value).join(ends, "image_id")
    shown = drawing.scale_min_max(own.filter("__signed"), value).union(drawing.scale_by_max(own.filter(~F.col("__signed")), value))
    save_images(shown, path, channels=(value,), **how)
