"""A Bloom filter over the ids of one table, broadcast to thin out another one before a shuffle join.

It only spares rows the way through the shuffle: a row that it lets pass by mistake finds no partner in the join that follows.
Its size is proven: 16 bits an id up to 2**28 bits (32 MB); beyond, it lets more rows pass. The bits are set and merged by
Spark's bitmap aggregates, so the driver gets the finished filter in segments of 4 KB and never an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ID, MOST_BITS, PROBES = 16, 28, 2
_SEGMENT = 32_768


class IdFilter:
    """Which values of the long column ``id`` of a table occur; ``may_have`` never says no to one that does."""

    def __init__(self, ids: DataFrame):
        n = ids.count()
        self.bits = 1 << min(MOST_BITS, max(15, (BITS_PER_ID * n).bit_length()))
        place = F.explode(F.array(*[p + 1 for p in self.places(F.col("id"))]))
        segments = (
            ids.select(place.alias("p"))
            .groupBy(F.bitmap_bucket_number("p").alias("s"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
            .collect()
        )
        table = np.zeros(self.bits // 8, np.uint8)
        for s, b in segments:
            at = (s - 1) * (_SEGMENT // 8)
            table[at : at + len(b)] = np.frombuffer(b, np.uint8)
        self.shared = ids.sparkSession.sparkContext.broadcast(table)

    def places(self, value: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(self.bits)) for k in range(PROBES)]

    def probe(self):
        """A function of the arrays of ``places``, for use in a task: which rows may have their id here. It stands in for ``may_have``
        where a task calls Python for more."""
        shared = self.shared

        def hits(*places: pa.Array) -> np.ndarray:
            table, hit = shared.value, True
            for p in places:
                at = p.to_numpy(zero_copy_only=False)
                hit = hit & ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
            return hit

        return hits

    def may_have(self, value: Column) -> Column:
        hits = self.probe()

        @F.arrow_udf("boolean")
        def probe(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array(hits(a, b))

        return probe(*self.places(value))

    def destroy(self) -> None:
        self.shared.destroy()
