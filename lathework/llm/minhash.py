"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Documents with equal shingle sets form a class, which its smallest doc_id stands for. A class has one signature: with one
permutation the shingles are placed on a circle of 2**32 points, and coordinate k is the least value that a second
permutation, shifted k points along the circle, gives them. BANDS bands of ROWS coordinates each make candidate groups.

In each group every class is compared with the group's leader (its smallest id) on full sets. Classes that are still in
different components, and met no such comparison, are then compared with each other in blocks of bounded size inside
tasks, which give only links between components. Components come from contraction: every node joins the neighbour of
least random rank, and the edges between what remains are kept in tables in the shared folder until there are none.
No group's pairs are emitted, and no group, link set or component is gathered in one task or the driver.

A doc_id has to be a number. Full sets are sets of 64-bit hashes of shingles: two shingles of one hash count as one.

With similarity s a pair meets in a band with probability 1 - (1 - s**ROWS)**BANDS, all but some 2e-7 at 0.75.

Defined cases: null or empty text has no shingles and is linked with nothing; fewer words than SHINGLE make one shingle;
a doc_id names one document, so if rows repeat it with other texts, the links of each count; a null doc_id is linked
with nothing; other columns are carried along by `deduplicate` and dropped by `near_components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import free_name, written
from lathework.llm.hashing import U64, chunks, mixed, shingle_hashes

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
#: Members of a group that one task compares with its leader, and the size of blocks compared with each other.
SALT_ROWS, BLOCK, BLOCK_SHINGLES = 256, 1024, 1 << 20
#: Shingles whose coordinates are computed together.
PIECE = 1 << 17


def _permuted(x: np.ndarray, out: np.ndarray) -> None:
    """The second permutation of the 32-bit circle."""
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, np.uint32(15), out=out)
    np.bitwise_xor(x, out, out=x)
    np.multiply(x, np.uint32(0x846CA68B), out=x)
    np.right_shift(x, np.uint32(16), out=out)
    np.bitwise_xor(x, out, out=x)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k coordinates for each set, none of them empty."""
    out = np.empty((len(sets), k), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= PIECE):
            size += len(sets[end])
            end += 1
        starts = np.cumsum([0, *[len(s) for s in sets[begin : end - 1]]])
        # The first permutation: the place on the circle.
        place = (mixed(np.concatenate(sets[begin:end]) * U64(0xA24BAED4963EE407)) >> U64(32)).astype(np.uint32)
        x, spare = np.empty_like(place), np.empty_like(place)
        for j in range(k):
            np.add(place, np.uint32(j), out=x)
            _permuted(x, spare)
            out[begin:end, j] = np.minimum.reduceat(x, starts)
        begin = end
    return out


def _binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text to doc_id, n_shingles, the set's hashes and its band hashes."""
    for batch in batches:
        texts = _binary(batch.column(1))
        for a, b in chunks(texts, 1 << 20):
            sets = [np.unique(s) for s in shingle_hashes(texts[a:b], SHINGLE)]
            full = [i for i, s in enumerate(sets) if len(s)]
            n = [len(s) for s in sets]
            bands: list[np.ndarray | None] = [None] * len(sets)
            keys = [[None, None] for _ in sets]
            if full:
                sig = signatures([sets[i] for i in full], BANDS * ROWS).reshape(len(full), BANDS, ROWS)
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(full), BANDS)).copy()
                for r in range(ROWS):
                    h = mixed(h ^ sig[:, :, r].astype(U64))
                h = h.view(np.int64)
                for j, i in enumerate(full):
                    bands[i] = h[j]
                    keys[i] = [int(v) for v in np.array([sets[i].sum(dtype=U64), mixed(sets[i].copy()).sum(dtype=U64)], U64).view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )


def _similar(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b)) if len(a) else 0


def _against_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, member, id, text), each leader's own before its members, to links (a, b)."""
    leader, leader_sets = None, []
    for batch in batches:
        texts, a, b = _binary(batch.column("text")), [], []
        sets = [np.unique(s) for s in shingle_hashes(texts, SHINGLE)]
        for i, (lead, salt, member, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leader", "salt", "member", "id")), strict=True)):
            if not member:
                leader_sets = [*leader_sets, sets[i]] if leader == (lead, salt) else [sets[i]]
                leader = (lead, salt)
            elif any(PERCENT * max(len(s), len(sets[i])) <= 100 * min(len(s), len(sets[i])) and _similar(_common(s, sets[i]), len(s), len(sets[i])) for s in leader_sets):
                a.append(lead)
                b.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _block_links(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between components among (side, component, id, set): pairs of one block, or of one side with the other."""
    n = len(rows)
    sizes = np.array([len(r[3]) for r in rows])
    values, where = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[where]
    column, owner = column[where[keep]], owner[keep]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [k, k + width])
        m = np.zeros((n, width), np.float32)
        m[owner[i:j], column[i:j] - k] = 1
        common += m @ m.T
    component = np.array([r[1] for r in rows])
    side = np.array([r[0] for r in rows])
    common = common.astype(np.int64)
    linked = 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
    linked &= component[:, None] < component[None, :]
    if len(set(side.tolist())) > 1:
        linked &= side[:, None] != side[None, :]
    found = {}
    for i, j in zip(*np.nonzero(linked), strict=True):
        found.setdefault((int(component[i]), int(component[j])), None)
    return list(found)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, component, id, text), sorted by task, to links between components."""
    task, rows = None, []

    def done() -> pa.RecordBatch:
        links = _block_links(rows) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    for batch in batches:
        sets = [np.unique(s) for s in shingle_hashes(_binary(batch.column("text")), SHINGLE)]
        for i, (key, side, component, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("task", "side", "component", "id")), strict=True)):
            if key != task:
                if rows:
                    yield done()
                task, rows = key, []
            rows.append((side, component, doc, sets[i]))
    if rows:
        yield done()


def _shuffled(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus: never broadcast, however small it is now."""
    return side.hint("merge")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of `edges` (a, b): equal labels in each component."""
    edges = written(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), rank("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), rank("a").alias("to")))
        joins = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(F.col("to"), rank("node"))["id"].alias("label"))
        joins = written(joins, "joins")
        labels = joins if labels is None else written(_follow(labels, joins), "labels")
        to_a, to_b = (joins.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        edges = edges.join(_shuffled(to_a), "a").join(_shuffled(to_b), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        edges = written(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turn += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _follow(labels: DataFrame, joins: DataFrame) -> DataFrame:
    """Labels after their nodes have joined others."""
    step = joins.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.join(_shuffled(step), "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketch = written(docs.mapInArrow(_sketch, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>"), "sketch")
    full = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # Classes of equal sets. The bands follow from the set, so any row's will do.
    classes = written(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands")), "classes")
    bands = classes.select("rep", "size", F.explode("bands").alias("band"))
    groups = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where(F.col("leader") < F.col("last"))
    members = written(bands.join(_shuffled(groups.select("band", "leader")), "band"), "band-members")
    pairs = written(members.where(F.col("rep") != F.col("leader")).select("leader", "rep").distinct(), "pairs")
    wanted = pairs.select(F.col("leader").alias("doc_id")).union(pairs.select("rep")).distinct()
    texts = written(docs.join(_shuffled(wanted), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")
    links = written(_leader_links(pairs, texts), "links")
    labels = connected(links)
    more = _residual_links(members, labels, texts)
    if more is not None:
        labels = connected(links.unionByName(more))
    named = labels.groupBy("label").agg(F.min("node").alias("component_id")).join(_shuffled(labels), "label").select(F.col("node").alias("rep"), "component_id")
    by_set = classes.select("s1", "s2", "rep").join(_shuffled(named), "rep", "left").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    joined = sketch.select("doc_id", "n_shingles", "s1", "s2").join(_shuffled(by_set), ["s1", "s2"], "left")
    # A null doc_id takes part in no class.
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def _leader_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that are similar on full sets. Members are dealt by (leader, salt), so no leader's group meets in one task."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(_shuffled(salts), "leader").select("leader", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"), F.col("rep").alias("id"))
    members = salted.join(_shuffled(texts), "id").select("leader", "salt", F.lit(True).alias("member"), "id", "text")
    own = salts.join(_shuffled(texts), F.col("leader") == F.col("id")).select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), "id", "text")
    dealt = members.unionByName(own).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member", "id")
    return dealt.mapInArrow(_against_leader, "a bigint, b bigint")


def _residual_links(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between components among members of a group that have not been compared: those besides its leader."""
    placed = members.where(F.col("rep") != F.col("leader")).join(_shuffled(labels.withColumnRenamed("node", "rep")), "rep", "left")
    placed = placed.select("band", "rep", "size", F.coalesce("label", "rep").alias("component"))
    # Groups with the same members need one comparison.
    many = F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)
    same = [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"x{k}") for k in (0, 1)]]
    mixed_groups = placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.ceil(many).cast("int").alias("blocks"), *same)
    once = mixed_groups.where(F.col("c1") != F.col("c2")).groupBy("n", "x0", "x1").agg(F.min("band").alias("band"), F.max("blocks").alias("blocks"))
    rows = written(placed.join(_shuffled(once.select("band", "blocks")), "band"), "residual")
    if rows.isEmpty():
        return None
    own = F.pmod(F.xxhash64("rep", F.lit(7)), "blocks").cast("int")
    # Block i meets block j in one task; `side` tells them apart.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.withColumn("own", own).select("*", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    task = F.concat_ws(":", F.col("band").cast("string"), low.cast("string"), high.cast("string"))
    side = F.when(low == high, 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(task.alias("task"), side.alias("side"), "component", F.col("rep").alias("id")).join(_shuffled(texts), "id")
    dealt = dealt.select("task", "side", "component", "id", "text").repartition("task").sortWithinPartitions("task")
    found = written(dealt.mapInArrow(_blocks, "a bigint, b bigint"), "residual-links")
    return None if found.isEmpty() else found


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose document has the smallest doc_id of its component; rows without id stay."""
    mark = free_name(docs, "kept_id")
    kept = near_components(docs, text, doc_id).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(mark)).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(_shuffled(kept), F.col(doc_id) == F.col(mark), "left_semi")
    return named.unionByName(docs.where(F.col(doc_id).isNull()))


def near_digest(docs: DataFrame) -> DataFrame:
    rows = near_components(docs)
    kept: Column = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
