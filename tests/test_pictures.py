"""Similar pictures from pixels on; decoding needs an image library and is tried only where there is one."""

import numpy as np
from pyspark.sql import functions as F

from filmcrate.functions import perceptual
from filmcrate.sources import pictures


def plain_hash(grey):
    u, x = np.arange(8)[:, None], np.arange(32)[None, :]
    c = np.cos(np.pi * (2 * x + 1) * u / 64)
    flat = (c @ grey @ c.T).ravel()
    median = np.sort(flat)[31:33].mean()
    return sum(1 << (63 - i) for i, v in enumerate(flat) if v > median)


def test_hash_of_pixels_and_of_turned_pixels(spark):
    rng = np.random.default_rng(4)
    greys = [rng.integers(0, 256, (32, 32)).astype(float) for _ in range(3)]
    rows = [(i, g.ravel().tolist()) for i, g in enumerate(greys)] + [(10 + i, np.rot90(g, 2).ravel().tolist()) for i, g in enumerate(greys)]
    got = {r["i"]: [x % (1 << 64) for x in r["h"]] for r in spark.createDataFrame(rows, "i int, p array<double>").select("i", perceptual.dct_low("p").alias("b")).select("i", perceptual.phash_rotations(F.col("b")).alias("h")).collect()}
    for i, g in enumerate(greys):
        assert got[i][0] == plain_hash(g)
        assert bin(got[i][2] ^ got[10 + i][0]).count("1") <= 1


def test_what_cannot_be_decoded_has_no_hash(spark, tmp_path):
    path = tmp_path / "x.jpg"
    path.write_bytes(b"no picture")
    files = spark.createDataFrame([(str(path),), (str(tmp_path / "gone.jpg"),)], "path string")
    assert pictures.hashed(files).count() == 0
    assert pictures.grey_pixels(files).where(F.col("pixels").isNull()).count() == 2
