"""Reproducible shuffle and sharding: a Feistel permutation over global row numbers.

Row x of n (in doc_id order) goes to place p(x), a keyed permutation of 0..n-1, so
shard = p mod shards and slot = p div shards: counts differ by one at most, slots have no
gaps, and either direction is computed without a table. p is a balanced Feistel network
over the smallest even number of bits that holds n; values outside 0..n-1 walk the cycle
until they fall inside, fewer than four steps on average.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), keyed."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % (1 << 64) for i in range(ROUNDS)]


def _half(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right, key) & mask)
    return (left << h) | right


def _network_back(y: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = y >> h, y & mask
    for key in reversed(keys):
        left, right = right ^ (_mix(left, key) & mask), left
    return (left << h) | right


def _walk(x: np.ndarray, n: int, seed: int, network) -> np.ndarray:
    half, keys = _half(n), _keys(seed)
    out = network(np.asarray(x, dtype=np.uint64), half, keys)
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = network(out[far], half, keys)
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Place of each row number (all in 0..n-1) in the shuffled order."""
    return _walk(x, n, seed, _network)


def unpermute(y: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Row number at each place: the inverse of ``permute``."""
    return _walk(y, n, seed, _network_back)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Row number that lies at a slot of a shard."""
    return unpermute(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with size, text_crc32, row_no, place, shard and slot.

    Order of row numbers: doc_id (nulls first), then crc32 and size of the text; rows equal
    in all three are alike to the operator and take neighbouring numbers. Size is the UTF-8
    bytes of the text plus 1; a null text counts as empty (size 1, crc 0). Empty texts, very
    long texts and repeated rows are rows like any other; an empty table gives an empty one.
    Columns of ``docs`` named like the added ones are replaced. Texts move through the
    shuffle only when ``columns`` asks for them.
    """
    names = docs.columns if columns is None else columns
    own = [n for n in names if n not in ("size", "text_crc32", "row_no", "place", "shard", "slot")]
    key = common.pick(docs, *dict.fromkeys([*own, "doc_id", "text"]))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = key.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")))
    if "text" not in own:
        key = key.drop("text")
    rows, n = common.row_numbers(key, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(np.uint64), n, seed))

    rows = rows.withColumn("place", place("row_no"))
    rows = rows.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {int(shards)}"))
    return rows.select(*own, "size", "text_crc32", "row_no", "place", "shard", "slot")


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15 under the law ``rows``."""
    out = shard_documents(common.read(spark, sf_dir, "documents"), 16, columns=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
