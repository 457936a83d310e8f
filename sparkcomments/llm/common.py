"""What the operators share: tables, staged results, word hashes."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of the contracts: runs of anything but ASCII white space. bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes as terms have them: A-Z in lower case; of ASCII only digits and letters stay, all else is a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a folder in the warehouse, which executors share too."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_work"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of finished steps: Spark deletes shuffle files once the driver has collected what refers to them."""
    for _ in range(2):  # the second time finds what the first has freed
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo by. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


def terms(text: bytes | None) -> list[bytes]:
    """The runs of digits, letters and characters beyond ASCII of a text in UTF-8, A-Z in lower case, in order."""
    return text.translate(TERM_BYTES).split() if text else []


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8, in order."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= ODD
        out += words[k:k + n]
    return mixed(out)
