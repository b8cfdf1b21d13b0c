"""Perceptual hashes of grey pixel buffers.

Buffers are 8-bit, row after row; one of the wrong length has no hash. The
difference hash is a column expression; the other two run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels a hash takes.
PIXELS = {"DifferenceHash": 72, "PerceptualHash": 1024, "BlockMeanHash": 65536}
#: Bits of a hash; the last 61 of a block mean hash are always 0.
BITS = {"DifferenceHash": 64, "PerceptualHash": 64, "BlockMeanHash": 961}


def byte_image(content: str | Column, pixels: int) -> Column:
    """Any content as an image: the pixel i is the byte at i * length / pixels."""
    raw = F.col(content) if isinstance(content, str) else content
    size = F.length(raw)
    return F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda i: F.conv(F.hex(F.substr(raw, (F.floor(i.cast("long") * size / pixels) + 1).cast("int"), F.lit(1))), 16, 10).cast("int"))


def once(value: Column) -> Column:
    """A value that later expressions read, not compute again: without this, the
    optimizer would put the whole expression wherever the column is used, inside
    lambdas too."""
    return F.explode(F.array(value))


def difference_bits(pixels: str | Column, textbook: bool = False) -> Column:
    """64 bits: whether a pixel is darker than the next one, over the flat buffer
    (``textbook``: within the rows of nine)."""
    p = F.col(pixels) if isinstance(pixels, str) else pixels
    at = (lambda i: i + F.floor(i / 8).cast("int")) if textbook else (lambda i: i)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(p, at(i)) < F.get(p, at(i) + 1))
    return F.when(F.size(p) == PIXELS["DifferenceHash"], bits)


def _basis() -> np.ndarray:
    k, i = np.arange(8)[:, None], np.arange(32)[None]
    scale = np.where(k == 0, 1 / 8, np.sqrt(2) / 8)
    return np.cos((2 * i + 1) * k * np.pi / 64) * scale


def perceptual_bits(image: np.ndarray) -> np.ndarray:
    """64 bits of a 32 x 32 image: low DCT coefficients above their mean."""
    c = _basis()
    low = c @ image.astype(float) @ c.T
    low[0, 0] = 0
    return (low > low.mean()).ravel()


def block_mean_bits(image: np.ndarray, step: int = 8, width: int = 961) -> np.ndarray:
    """Bits of a 256 x 256 image: blocks of 16 pixels at every ``step`` whose mean
    is at least the image's. Whole numbers, so ties are exact."""
    cells = image.astype(np.int64).reshape(256 // step, step, 256 // step, step).sum((1, 3))
    side = 16 // step
    n = (256 - 16) // step + 1 - (1 if step == 8 else 0)
    total = sum(cells[i : i + n, j : j + n] for i in range(side) for j in range(side)) if step == 8 else cells[:15, :15]
    out = np.zeros(width, bool)
    bits = (total * 256 >= image.astype(np.int64).sum()).ravel()
    out[: len(bits)] = bits
    return out


def _stretched(content: bytes, pixels: int) -> np.ndarray:
    raw = np.frombuffer(content, np.uint8)
    return raw[np.arange(pixels, dtype=np.int64) * len(raw) // pixels]


def hashed(rows: DataFrame, algorithm: str, key: str, content: str = "content") -> DataFrame:
    """``(key, bits)`` of contents taken as byte images; a string of 0 and 1,
    null where there is no content."""
    kind = rows.schema[key].dataType.simpleString()
    side = {"PerceptualHash": 32, "BlockMeanHash": 256}[algorithm]
    make = perceptual_bits if algorithm == "PerceptualHash" else block_mean_bits

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            out = []
            for cell in f.column(1):
                raw = cell.as_py()
                out.append("".join("01"[b] for b in make(_stretched(raw, side * side).reshape(side, side)).tolist()) if raw else None)
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(out, pa.string())], names=[key, "bits"])

    return rows.select(key, content).mapInArrow(run, f"{key} {kind}, bits string")


def packed(rows: DataFrame, algorithm: str, key: str, pixels: str = "pixels", stretched: bool = False) -> DataFrame:
    """``(key, hash)`` of pixel buffers, arrays or binary: a BIGINT, or an array of
    them where a hash has more than 64 bits, the first bit the lowest; null where
    the buffer has the wrong length. ``stretched``: buffers of any length but 0 are
    taken as byte images, one at a time."""
    kind = rows.schema[key].dataType.simpleString()
    side = {"PerceptualHash": 32, "BlockMeanHash": 256}[algorithm]
    make = perceptual_bits if algorithm == "PerceptualHash" else block_mean_bits
    wide = BITS[algorithm] > 64

    def one(cell: bytes | list | None) -> int | list[int] | None:
        if stretched and cell:
            cell = _stretched(cell, side * side).tobytes()
        if cell is None or len(cell) != side * side:
            return None
        image = np.frombuffer(cell, np.uint8) if isinstance(cell, bytes) else np.array(cell, np.uint8)
        bits = make(image.reshape(side, side))
        words = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view("<i8").tolist()
        return words if wide else words[0]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            made = pa.array([one(cell.as_py()) for cell in f.column(1)], pa.list_(pa.int64()) if wide else pa.int64())
            yield pa.RecordBatch.from_arrays([f.column(0), made], names=[key, "hash"])

    return rows.select(key, pixels).mapInArrow(run, f"{key} {kind}, hash {'array<long>' if wide else 'long'}")
