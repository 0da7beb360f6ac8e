"""The states of many keys in one row of keyed state.

A call of a Python function for each key costs far more than its rows. Keys are dealt over a fixed number of
buckets by their hash, a bucket is the group that Spark calls the function with, and its state has arrays with a
place for each key. A bucket's work and state are those of its keys; the number of calls no longer grows with them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of a stream. Its checkpoint keeps them apart by number, so a stream goes on with the number it began with.
BUCKETS = 1024


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def key_text(key: str) -> Column:
    """The key as text, which pandas keeps as it is, null too; a cast gives the key back."""
    return F.col(key).cast("string")


def joined(frames) -> pd.DataFrame:
    frames = list(frames)
    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


def placed(keys: list, rows: pd.Series) -> tuple[list, np.ndarray]:
    """``keys`` with those of ``rows`` that are new at the end, and the place of each row's key."""
    code, found = pd.factorize(rows, use_na_sentinel=False)
    found = [None if pd.isna(k) else k for k in found]
    place = {k: i for i, k in enumerate(keys)}
    for k in found:
        place.setdefault(k, len(place))
    return list(place), np.array([place[k] for k in found], dtype=np.int64)[code]


def grown(values: list, size: int, fill, dtype) -> np.ndarray:
    """An array of ``size`` places that begins with ``values``."""
    out = np.full(size, fill, dtype=dtype)
    out[: len(values)] = values
    return out
