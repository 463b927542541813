"""Pictures as small grey images, for perceptual hashes. Needs an image library; without it, or for what cannot be decoded, there are no pixels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import perceptual

PIXELS = "path string, pixels array<double>, w int, h int"


def decode(path: str) -> tuple[list[float] | None, int | None, int | None]:
    """32 x 32 grey values of the first picture, turned upright, and the picture's own width and height."""
    try:
        from PIL import Image, ImageOps

        try:
            import pillow_heif

            pillow_heif.register_heif_opener()
        except ImportError:
            pass
        with Image.open(path) as image:
            w, h = image.size
            image.draft("RGB", (perceptual.SIDE * 4, perceptual.SIDE * 4))
            upright = ImageOps.exif_transpose(image).convert("L")
            small = upright.resize((perceptual.SIDE, perceptual.SIDE), Image.Resampling.LANCZOS)
            return [float(x) for x in small.tobytes()], w, h
    except Exception:
        return None, None, None


def grey_pixels(files: DataFrame) -> DataFrame:
    """path, pixels, w and h of every file (path); nulls where nothing can be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *decode(p)) for p in batch["path"]]
            yield pd.DataFrame(rows, columns=["path", "pixels", "w", "h"]).astype({"w": "Int32", "h": "Int32"})

    return files.select("path").mapInPandas(run, PIXELS)


def hashed(files: DataFrame) -> DataFrame:
    """path, phash (four rotations) and pixels (width times height) of what can be decoded."""
    rows = grey_pixels(files).where("pixels is not null")
    size = perceptual.pixels(F.struct("w", "h"))
    rows = rows.select("path", perceptual.dct_low("pixels").alias("block"), size.alias("pixels"))
    return rows.withColumn("phash", perceptual.phash_rotations(F.col("block"))).select("path", "phash", "pixels")
