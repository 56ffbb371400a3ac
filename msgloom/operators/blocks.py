"""Placement of rows by ranges of message ids, one range per partition and per file."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "_block"
#: Rows of a file, some 100 MB; loads of so few rows make one file.
ROWS_PER_FILE = 1_000_000
SMALL_LOAD = 20_000
#: Rows per block at least, where a load is cut for the sake of parallel work.
_LEAST_ROWS = 8_192
#: Ids sampled per block, and in all: 64 MB on the driver.
_SAMPLES_PER_BLOCK, _MAX_SAMPLES = 100, 8_000_000
_SEED = 7


class IdBlocks(NamedTuple):
    """Blocks of neighbouring ids of about equal size: block k holds the ids from bound k - 1 on and
    below bound k. Bounds are doubles; ids that are the same double fall into one block."""

    bounds: list[float]

    def __len__(self) -> int:
        return len(self.bounds) + 1

    def place(self, df: DataFrame, id_column: str = "message_id") -> DataFrame:
        """The rows with their block, each block in the partition of its number. Tables placed
        alike join by block and id without another shuffle."""
        if not self.bounds:
            return df.withColumn(BLOCK, F.lit(0)).repartitionById(1, F.col(BLOCK))
        inf = float("inf")
        cut = Bucketizer(splits=[-inf, *self.bounds, inf], inputCol="_id", outputCol="_bucket")
        placed = cut.transform(df.withColumn("_id", F.col(id_column).cast("double")))
        placed = placed.withColumn(BLOCK, F.col("_bucket").cast("int")).drop("_id", "_bucket")
        return placed.repartitionById(len(self), F.col(BLOCK))


def blocks_for(rows: int, parallelism: int) -> int:
    """How many files a load of so many rows makes."""
    if rows <= SMALL_LOAD:
        return 1
    return max(-(-rows // ROWS_PER_FILE), min(parallelism, rows // _LEAST_ROWS))


def id_blocks(ids: DataFrame, rows: int, blocks: int) -> IdBlocks:
    """Bounds between blocks, from a sample of a one-column table of ids whose size does not
    follow the number of rows but that of the blocks."""
    if blocks <= 1:
        return IdBlocks([])
    wanted = min(blocks * _SAMPLES_PER_BLOCK, _MAX_SAMPLES)
    sample = np.sort(ids.sample(min(1.0, wanted / rows), _SEED).toArrow().column(0).to_numpy().astype(np.float64))
    if not len(sample):
        return IdBlocks([])
    cuts = sample[np.arange(1, blocks) * len(sample) // blocks]
    return IdBlocks(np.unique(cuts).tolist())
