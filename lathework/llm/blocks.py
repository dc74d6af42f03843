"""Blocks of documents, and what they tell each other about 64-bit hashes.

A corpus-wide count of hashes by rows (document, hash) would shuffle tens of bytes for each. Instead documents are dealt
into blocks of some megabytes. Each block sends its distinct hashes, sorted, as one packet to each of a number of buckets
of the hash range; a bucket, which holds the packets of all blocks for its range, answers each packet in the same order;
the answers, put together by block, go along with the block's documents. Blocks and buckets have bounded sizes, so their
numbers follow the size of the corpus; a hash is sent once by a block, whatever its copies in it, and a packet is made only
where a block has hashes for a bucket, so that the work is by hashes, however many buckets there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
#: Rows in a block, about.
BLOCK_ROWS = 1 << 14
#: Integers that a compressed frame isn't worth its head for.
FEW = 16


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of their bytes, compressed: high bytes, mostly zero or alike, take little room.

    Few of them stay as they are, less the high bytes that all of them lack.
    """
    values = values.astype("<u8")
    used = next((k for k in range(8) if not (values >> np.uint64(8 * k)).any()), 8)
    if len(values) < FEW:
        return bytes([16 + used]) + values.view(np.uint8).reshape(-1, 8)[:, :used].tobytes()
    return bytes([used]) + pa.compress(values.view(np.uint8).reshape(-1, 8).T[:used].tobytes(), codec="zstd", asbytes=True)


def from_planes(data: bytes, n: int) -> np.ndarray:
    used = data[0]
    out = np.zeros((n, 8), np.uint8)
    if used >= 16:
        out[:, : used - 16] = np.frombuffer(data, np.uint8, offset=1).reshape(n, used - 16)
        return out.reshape(-1).view("<u8")
    raw = pa.decompress(memoryview(data)[1:], decompressed_size=used * n, codec="zstd")
    out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u8")


def packed(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes by their differences."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, n), dtype=np.uint64)


def cuts(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes fall in, and where each of them begins, with the end: work by hashes, not by buckets."""
    of = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
    return of[first].astype(np.int64), np.append(first, len(of))


def blocks_for(total: int | None, rows: int, size: int | None = None) -> int:
    """How many blocks so many bytes of text in so many rows make."""
    return max(1, -(-(total or 0) // (size or BLOCK_BYTES)), -(-rows // BLOCK_ROWS))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, text). Rows with the same id and text stay together only by chance of the same hash."""
    block: Column = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), "doc_id", "text")
