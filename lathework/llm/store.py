"""Token ids as a content-addressed store.

Each document's ids, its end id included, are cut where a rolling hash of WINDOW ids has its low bits zero, so that equal
stretches are cut alike wherever they stand. A chunk's address is the SHA-256 of its bytes (little-endian, two bytes an id
if the vocabulary allows, else four). The store has three tables:

- `chunks/`: address, n, ids; each address once;
- `recipes/`: in ascending order of doc_id, what chunks a document is made of, its first id's place among all, its number
  of ids and the Merkle root over its chunks' addresses;
- `manifest/`: for each recipe file its documents, ids, and the Merkle root over its documents' roots.

One job encodes and cuts: each task sends a chunk once, whatever its copies, to where its address is collected, and the
list of a document's chunks to where its id falls, so no address or document gathers more rows than there are tasks.
Bytes travel once. `read_store` joins them to the recipes again; `verify_store` checks addresses and roots, and combines
each document's CRC-32 from those of its chunks (the checksum of a concatenation follows from those of the parts and their
lengths), so that only checksums travel.

Defined cases: null or empty text is its end id alone; documents are ordered by doc_id, null first, then by the root of
their chunks (rows that are equal in both are equal in ids); an empty table makes an empty store; columns besides
`doc_id` and `text` are not stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.llm.tokens import encoder

#: Ids that the rolling hash sees, a power of two; the mean, least and most ids in a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 512, 128, 2048
#: Documents in a recipe file, about.
PART_DOCS = 50_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ADDRESS = 32


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    h = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    h ^= h >> np.uint64(29)
    # Sums of 1, 2, 4, ... ids, the last one times 1, the one before it times the factor, and so on.
    width, factor = 1, int(_FACTOR)
    while width < WINDOW:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    h ^= h >> np.uint64(32)
    ends, last = [], 0
    for at in (np.flatnonzero(h & np.uint64(MEAN - 1) == 0) + WINDOW).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(last := at)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n] if last < n else ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Hashes in pairs until one is left; an odd one moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _cut(tokenizer: str, end: int, width: int):
    """Batches (doc_id, text) to rows: chunks (address, n, ids), and documents (doc_id, their addresses and numbers of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind, sent = encoder(tokenizer).encode, f"<u{width}", set()
        if max(encoder(tokenizer).size - 1, end) >> 8 * width:
            raise ValueError(f"ids of {tokenizer} or the end id need more than {width} bytes")
        for batch in batches:
            docs = batch.column(0)
            out: list[tuple] = []

            def made() -> pa.RecordBatch:
                c = list(zip(*out, strict=True)) or [()] * 7  # noqa: B023
                columns = [pa.array(c[0], pa.bool_()), docs.take(pa.array(c[1], pa.int64())), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.binary())]  # noqa: B023
                columns += [pa.array(c[5], pa.list_(pa.int32())), pa.array(c[6], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["is_chunk", "doc_id", "address", "n", "ids", "sizes", "deal"])

            held = 0
            for row, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end))
                data, addresses, sizes, last = ids.astype(kind).tobytes(), [], [], 0
                for at in cut_points(ids):
                    piece = data[last * width : at * width]
                    address = hashlib.sha256(piece).digest()
                    addresses.append(address)
                    sizes.append(at - last)
                    if address not in sent:
                        if len(sent) > 1_000_000:
                            sent.clear()
                        sent.add(address)
                        out.append((True, None, address, at - last, piece, None, address))
                        held += len(piece)
                    last = at
                root = merkle_root(addresses)
                out.append((False, row, root, len(ids), b"".join(addresses), sizes, root + row.to_bytes(4, "little")))
                if held > 4 << 20 or len(out) > 20_000:
                    yield made()
                    out, held = [], 0
            yield made()

    return run


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one part, in order, to its row of the manifest."""
    parts: dict[int, list] = {}
    for batch in batches:
        for part, root, n in zip(*(batch.column(c).to_pylist() for c in ("part", "root", "n_tokens")), strict=True):
            roots, total = parts.setdefault(part, [[], 0])
            roots.append(root)
            parts[part][1] = total + n
    rows = list(parts.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int32()), pa.array([len(r) for _, (r, _) in rows], pa.int64()), pa.array([n for _, (_, n) in rows], pa.int64()), pa.array([merkle_root(r) for _, (r, _) in rows], pa.binary())],
        names=["part", "n_docs", "n_tokens", "root"],
    )


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (is_chunk, address) without the repeated chunks."""
    last = None
    for batch in batches:
        keep = []
        for chunk, address in zip(batch.column("is_chunk").to_pylist(), batch.column("address").to_pylist(), strict=True):
            keep.append(not chunk or address != last)
            last = address if chunk else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int, width: int = 2) -> None:
    """The ids of `docs` (doc_id, text) as a store under `path`; a vocabulary or end id beyond `width` bytes is an error."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"is_chunk boolean, doc_id {kind}, address binary, n bigint, ids binary, sizes array<int>, deal binary"
    dealt = docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, end, width), schema).repartition("deal").drop("deal").sortWithinPartitions("is_chunk", "address")
    dealt.mapInArrow(_first_of_each, schema.rsplit(",", 1)[0]).write.partitionBy("is_chunk").parquet(f"{path}/cut")
    cut = spark.read.schema(schema.rsplit(",", 1)[0]).parquet(f"{path}/cut")
    lists = cut.where(~F.col("is_chunk")).select("doc_id", F.col("address").alias("root"), F.col("n").alias("n_tokens"), F.col("ids").alias("addresses"), "sizes")
    parts = -(-lists.count() // PART_DOCS) or 1
    ordered = lists.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/listed")
    listed = spark.read.schema(f"doc_id {kind}, root binary, n_tokens bigint, addresses binary, sizes array<int>, part int").parquet(f"{path}/listed")
    by_part = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part: as many as there are tasks.
    sums = listed.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    starts = sums.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = listed.withColumn("before", F.coalesce(F.sum("n_tokens").over(by_part), F.lit(0))).join(starts, "part")
    recipes = placed.select("part", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "root", "addresses", "sizes")
    recipes.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "root").write.partitionBy("part").parquet(f"{path}/recipes")
    made = read_recipes(spark, path, kind).select("part", "doc_id", "root", "n_tokens").repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "root")
    made.mapInArrow(_manifest, "part int, n_docs bigint, n_tokens bigint, root binary").write.parquet(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(address, n, ids), each address once."""
    return spark.read.schema("address binary, n bigint, ids binary, is_chunk boolean").parquet(f"{path}/cut").where("is_chunk").drop("is_chunk")


def read_recipes(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, start bigint, n_tokens bigint, root binary, addresses binary, sizes array<int>, part int").parquet(f"{path}/recipes")


def _references(recipes: DataFrame) -> DataFrame:
    """A row for each place of a chunk in a document: start names the document, `rest` counts the ids after the chunk."""
    at = F.explode(F.sequence(F.lit(0), F.size("sizes") - 1)).alias("k")
    rest = F.aggregate(F.slice("sizes", F.col("k") + 2, F.size("sizes")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    placed = recipes.select("doc_id", "start", "n_tokens", "addresses", "sizes", at)
    return placed.select("doc_id", "start", "n_tokens", "k", F.substring("addresses", F.col("k") * _ADDRESS + 1, F.lit(_ADDRESS)).alias("address"), rest.alias("rest"))


def read_store(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents put together again from their chunks."""
    joined = _references(read_recipes(spark, path, kind)).join(read_chunks(spark, path).select("address", "ids"), "address")
    whole = joined.groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return whole.select("doc_id", "start", "n_tokens", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def _checksums(width: int):
    """Chunks to (address, n, crc): of the ids as little-endian unsigned 32-bit. A chunk that isn't what its address says raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, sizes = [], []
            for address, n, data in zip(*(batch.column(c).to_pylist() for c in ("address", "n", "ids")), strict=True):
                if hashlib.sha256(data).digest() != address or len(data) != n * width:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                crc.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["address", "n", "crc"])

    return run


# Fixed value: the polynomial of CRC-32, bits reversed.
_POLYNOMIAL = np.uint32(0xEDB88320)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of polynomials modulo the CRC's, in reversed bits."""
    out, b, zero = np.zeros_like(a), b.copy(), np.uint32(0)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, zero)
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), _POLYNOMIAL, zero)
    return out


def crc_before(crc: np.ndarray, bytes_after: np.ndarray) -> np.ndarray:
    """What each checksum adds to that of a whole in which so many bytes follow: it is multiplied by x**(8 * bytes)."""
    out, rest, power = crc.astype(np.uint32), bytes_after.astype(np.int64) * 8, np.array([1 << 30], np.uint32)  # x
    while rest.any():
        out = np.where(rest & 1, _product(out, np.broadcast_to(power, out.shape)), out)
        power, rest = _product(power, power), rest >> 1
    return out


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_before(batch.column("crc").fill_null(0).to_numpy(), batch.column("rest").to_numpy() * 4).astype(np.int64)
        yield batch.drop_columns(["rest", "crc"]).append_column("part_crc", pa.array(crc))


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes as they are; one whose root isn't that of its addresses raises."""
    for batch in batches:
        for root, a in zip(batch.column("root").to_pylist(), batch.column("addresses").to_pylist(), strict=True):
            if merkle_root([a[i : i + _ADDRESS] for i in range(0, len(a), _ADDRESS)]) != root:
                raise ValueError(f"recipe {root.hex()} is damaged")
        yield batch


def verify_store(spark: SparkSession, path: str, kind: str = "bigint", width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, after the hashes of all chunks, recipes and parts have been checked.

    A part whose documents don't give the root in the manifest, or a missing chunk, makes the job fail.
    """
    recipes = read_recipes(spark, path, kind)
    in_order = recipes.select("part", "doc_id", "root", "n_tokens").repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "root")
    now = in_order.mapInArrow(_manifest, "part int, n_docs bigint, n_tokens bigint, root binary")
    said = spark.read.schema("part int, n_docs bigint, n_tokens bigint, root binary").parquet(f"{path}/manifest")
    if not now.exceptAll(said).isEmpty() or not said.exceptAll(now).isEmpty():
        raise ValueError("the manifest doesn't fit the recipes")
    sums = read_chunks(spark, path).mapInArrow(_checksums(width), "address binary, n bigint, crc bigint")
    proved = recipes.mapInArrow(_proved, f"doc_id {kind}, start bigint, n_tokens bigint, root binary, addresses binary, sizes array<int>, part int")
    joined = _references(proved).join(sums, "address", "left").select("doc_id", "start", "n_tokens", "rest", "crc", "n")
    shifted = joined.mapInArrow(_shifted, f"doc_id {kind}, start bigint, n_tokens bigint, n bigint, part_crc bigint")
    whole = shifted.groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("part_crc").alias("ids_crc32"), F.sum("n").alias("found"))
    complete = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("chunks are missing")).cast("bigint"))
    return whole.select("doc_id", "start", "n_tokens", complete.alias("ids_crc32"))
