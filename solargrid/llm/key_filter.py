"""A bitmap of keys that keeps rows out of a shuffle which cannot be joined to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm.storage import input_partitions

#: Bits for each key, and the most bits in all (16 MB); beyond that the bitmap lets through more, but never loses a key.
BITS_PER_KEY, MOST_BITS = 12, 27


def bitmap(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the keys (column q_key), of BITS_PER_KEY bits for each but 2 ^ MOST_BITS at most; it lets through all keys.

    A key's bit is named by the top bits of its hash.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(12, (n * BITS_PER_KEY).bit_length()))
    slot = F.expr(f"shiftrightunsigned(xxhash64(q_key), {64 - bits})")
    # Blocks of 4 KB, each made whole by one task, are all that reaches the driver.
    block = F.expr("bitmap_bucket_number(b + 1)")
    dealt = keys.select(slot.alias("b")).select("b", block.alias("block")).repartition(input_partitions(keys.sparkSession), "block")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in dealt.groupBy("block").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b + 1))").alias("bits")).collect():
        part = np.frombuffer(r["bits"], dtype=np.uint8)[: len(out)]
        out[(r["block"] - 1) * 4096 : (r["block"] - 1) * 4096 + len(part)] = part
    out = out.view(np.uint32)
    return out, bits


def passing(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs (with q_key) and q_hit: false only for rows whose key is not among keys."""
    table, bits = bitmap(keys)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [*docs.columns, "q_slot"]
    at = names.index("q_slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(at).to_numpy()
            hit = (shared.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(hit)], [*names[:at], "q_hit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("q_slot", F.expr(f"shiftrightunsigned(xxhash64(q_key), {64 - bits})")).mapInArrow(run, f"{schema}, q_hit boolean")
