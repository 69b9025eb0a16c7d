"""Blocked Bloom filters of 64-bit keys, built by Spark in pieces and sharded.

A key sets one bit in each of the eight 32-bit lanes of one block, so a probe reads one place
of memory, and most absent keys are known by their first lanes. Keys that were added are always
found; others now and then.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 24  # Bits of a filter for each key it is made for.
LIMIT = 16 << 20  # Bytes of the filters that are broadcast at once.
LANES = 8
PIECE = 4096  # Blocks of a filter that one group of keys fills.
# Odd multipliers, one a lane.
_ODD = np.random.default_rng(11).integers(0, 1 << 31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def mix(keys):
    """64-bit keys whose bits all depend on all bits of those given."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks_for(n, limit=LIMIT):
    """Blocks of a filter for ``n`` keys, at most ``limit`` bytes."""
    wanted = -(-n * BITS // (32 * LANES))
    return int(max(1, min(wanted, limit // (4 * LANES))))


def _block(keys, blocks):
    return (((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _bit(keys, lane):
    place = (keys.astype(np.uint32) * _ODD[lane]) >> np.uint32(27)
    return np.uint32(1) << place


@dataclass(frozen=True)
class Filters:
    """Lanes by shard: an array of (blocks, 8)."""

    lanes: dict

    def holds(self, shard, keys):
        """Whether each of the mixed ``keys`` may have been added to a shard."""
        out = np.zeros(len(keys), bool)
        if shard not in self.lanes:
            return out
        lanes = self.lanes[shard]
        left = np.arange(len(keys))
        at = _block(keys, len(lanes))
        for lane in range(LANES):
            set_ = (lanes[at, lane] & _bit(keys, lane)) != 0
            left, at, keys = left[set_], at[set_], keys[set_]
        out[left] = True
        return out


def build(keys: DataFrame, blocks: dict) -> Filters:
    """Filters of rows (shard int, key long, mixed); ``blocks`` has each shard's number of blocks.

    Each group of PIECE blocks is filled by a task of its own, from the keys that fall there;
    the driver gets the filters alone, whose bytes the caller bounds through ``blocks``.
    """

    def place(batches):
        for batch in batches:
            shard = batch.column(0).to_numpy()
            key = batch.column(1).to_numpy().view(np.uint64)
            size = np.array([blocks[s] for s in np.unique(shard).tolist()], np.uint64)
            size = size[np.unique(shard, return_inverse=True)[1]]
            at = ((key >> np.uint64(32)) * size) >> np.uint64(32)
            piece = (at // np.uint64(PIECE)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(piece), batch.column(1)], ["shard", "piece", "key"]
            )

    def fill(table: pa.Table) -> pa.Table:
        shard, piece = table.column("shard")[0].as_py(), table.column("piece")[0].as_py()
        key = table.column("key").to_numpy().view(np.uint64)
        lanes = np.zeros((min(PIECE, blocks[shard] - piece * PIECE), LANES), np.uint32)
        at = _block(key, blocks[shard]) - piece * PIECE
        for lane in range(LANES):
            np.bitwise_or.at(lanes[:, lane], at, _bit(key, lane))
        return pa.table(
            {"shard": table.column("shard")[:1], "piece": table.column("piece")[:1], "lanes": pa.array([lanes.tobytes()], pa.binary())}
        )

    placed = keys.select("shard", "key").mapInArrow(place, "shard int, piece int, key long")
    rows = placed.groupBy("shard", "piece").applyInArrow(fill, "shard int, piece int, lanes binary").collect()
    lanes = {s: np.zeros((n, LANES), np.uint32) for s, n in blocks.items()}
    for r in rows:
        part = np.frombuffer(r["lanes"], np.uint32).reshape(-1, LANES)
        lanes[r["shard"]][r["piece"] * PIECE : r["piece"] * PIECE + len(part)] = part
    return Filters(lanes)
