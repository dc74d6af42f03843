"""The registered queries against plain versions, over whole tables and over a table of odd cases."""

from __future__ import annotations

import random
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lathework.llm import blocks, decontam, packing, sharding, store, suffix
from lathework.llm.queries import PACKED, PACKED_END, QUERIES, STORED, STORED_END
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(n))


def odd_texts():
    """Null, empty and white texts, copies, near copies, long runs, and what looks like personal data."""
    long = passage(1, 4000)
    base = passage(2, 200)
    near = base.split(" ")
    near[50] = "other"
    return [
        None, "", " \n\t ", "one", "One TWO three four", "one two three four", base, base, " ".join(near), base.upper(), long, long + " " + base,
        "a" * 3000, "a" * 3000 + "b", "line\n" * 200, "x y z " * 400, "é" * 60 + base, "1" * 500, "\n".join([base, base, "tail"]),
        "mail a.b@c-d.example.org now; 10.0.0.256 10.20.30.40 1.2.3.4.5 007.8.9.10", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000",
        "+1 (555) 010-9999 +123 +1234567890123456 + 1", "a@b@c.de x@y..z u@v.w. @q.r", "iban GB82 WEST 1234 5698 7654 32 bank", passage(3, 9), passage(3, 10), "pre " + passage(3, 10) + " post",
        "<|endoftext|> 12  34   x \r\n\r\n  y ", "​ 　 wide", passage(4, 49), passage(4, 50), passage(4, 51), "😀 " * 60,
    ]


def odd_items():
    return [(1, passage(3, 10)), (2, passage(3, 9)), (3, None), (4, ""), (5, passage(3, 10)), (6, passage(2, 200)), (10, "one"), (11, "One, two; three!"), (None, "x y z")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """By name: a folder of tables, and its documents and items as lists."""
    odd = str(tmp_path_factory.mktemp("odd"))
    docs = [(i * 7 % 101 + 1, t) for i, t in enumerate(odd_texts())]
    docs.append((None, passage(2, 200)))
    frame = spark.createDataFrame([(d, t, "en", None, i) for i, (d, t) in enumerate(docs)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for clash in ("shard", "rejected_by", "pii", "block", "hit_id", "kept_id", "task", "rank", "n_words", "part", "prefix", "depth", "place", "own_hash", "pieces"):
        frame = frame.withColumn(clash, F.lit("own"))
    frame.repartition(3).write.parquet(f"{odd}/documents.parquet")
    spark.createDataFrame(odd_items(), "item_id bigint, text string").write.parquet(f"{odd}/benchmark.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{empty}/conversations.parquet")
    read = lambda n, a: list(zip(*pq.read_table(f"{SF}/{n}.parquet").select([a, "text"]).to_pydict().values(), strict=True))
    return {"sf": (SF, read("documents", "doc_id"), read("benchmark", "item_id")), "odd": (odd, docs, odd_items()), "empty": (empty, [], [])}


CASES = pytest.mark.parametrize("case", ["sf", "odd", "empty"])


def rows(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@CASES
def test_lm(spark, folders, case):
    folder, docs, _ = folders[case]
    want = brute.lm(docs)
    got = {r.doc_id: (r.n_words, r.n_trigram, r.n_bigram, r.n_unigram, r.log_score) for r in rows(spark, "op1_lm", folder)}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4]
        assert abs(got[d][4] - w[4]) < 1e-3


@CASES
@pytest.mark.parametrize("tasks", [packing.BROADCAST_TASKS, 0])
def test_packing(spark, folders, case, tasks, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_TASKS", tasks)
    folder, docs, _ = folders[case]
    want = {d: i for (d, _), i in zip(docs, brute.ids(public_tokenizers.path(PACKED), [t for _, t in docs], PACKED_END), strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op2_packing", folder):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for d, own in pieces.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert 1 <= r.length <= 1024
            assert r.length == 1024 or k == 0
            assert r.ids_crc32 == brute.crc(want[d][at : at + r.length])
            at += r.length
        assert at == len(want[d])
        assert len(own) == -(-len(want[d]) // 1024)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, want.values()))
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1


@CASES
def test_pii(spark, folders, case):
    folder, docs, _ = folders[case]
    got = {r.doc_id: r for r in rows(spark, "op3_pii", folder)}
    assert got.keys() == {d for d, _ in docs}
    for d, text in docs:
        r, (want, base) = got[d], brute.pii(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, text
        assert set(base) <= set(r.spans.split(","))


@pytest.mark.parametrize("case", ["sf", "empty"])
def test_chat(spark, folders, case):
    folder = folders[case][0]
    table = pq.read_table(f"{folder}/conversations.parquet").to_pylist() if case == "sf" else []
    table += [{"conv_id": -7, "turn": i, "role": r, "text": r"\### Assistant: </turn> ok"} for i, r in enumerate(("user", "assistant"))]
    chats = defaultdict(list)
    for r in table:
        chats[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    got = {r.conv_id: r for r in rows(spark, "op4_chat", folder)}
    assert got.keys() == chats.keys()
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))


@CASES
def test_near(spark, folders, case):
    folder, docs, _ = folders[case]
    want = brute.near(docs)
    got = {r.doc_id: r for r in rows(spark, "op5_minhash", folder)}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d is None or d == r.component_id) for d, r in got.items())


@CASES
def test_quality(spark, folders, case):
    folder, docs, _ = folders[case]
    got = {r.doc_id: r for r in rows(spark, "op6_quality", folder)}
    assert got.keys() == {d for d, _ in docs}
    for d, text in docs:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), text
        assert not (r.kept and r.base_failed)


@CASES
def test_sharding(spark, folders, case):
    folder, docs, _ = folders[case]
    got = rows(spark, "op7_sharding", folder)
    sizes = {d: len((t or "").encode()) for d, t in docs}
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, sizes))
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for name, own in shards.items():
        assert {len(name)} == {r.shard_depth for r in own}
        assert sum(sizes[r.doc_id] for r in own) == own[0].shard_bytes
        assert own[0].shard_bytes <= 1 << 20
        assert not any(other != name and other.startswith(name) for other in shards)
        if name:  # a split was needed: the bucket above holds too much
            assert sum(own[0].shard_bytes for other, own in shards.items() if other.startswith(name[:-1])) > 1 << 20


def test_unsplittable_shards(spark, tmp_path):
    """One key with a third of all rows, and a row over the limit; both are written whole."""
    table = [(f"k{i % 50}" if i % 3 else "hot", "x" * 40, i) for i in range(600)] + [("big", "y" * 5000, -1)]
    docs = spark.createDataFrame(table, "key string, text string, n int").withColumn("shard_fits", F.lit("own"))
    got = sharding.assign_shards(docs, "key", "text", 2000).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += len(r.text)
    for r in got:
        assert sizes[r.shard] == r.shard_bytes
        assert r.shard_fits == (r.shard_bytes <= 2000)
        assert r.shard_fits or r.shard_depth == sharding.BITS
    assert {r.key for r in got if not r.shard_fits} == {"hot", "big"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions this small would be united
    sharding.write_shards(docs, f"{tmp_path}/shards", "key", "text", 2000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.key, r.text) for r in back.collect()) == sorted((k, t) for k, t, _ in table)
    assert back.where("key = 'hot'").select(F.input_file_name()).distinct().count() > 1


def test_shards_move_rows_once(spark, folders):
    """Without a broadcast the rows are in one shuffle, not multiplied by depths, and the result is the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted(tuple(r) for r in sharding.assign_shards(docs, limit=20000).select("doc_id", "shard", "shard_fits").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sharding.assign_shards(docs, limit=20000)
        assert sorted(tuple(r) for r in got.select("doc_id", "shard", "shard_fits").collect()) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Generate") == 1  # of the directory
    assert len({len(s) for _, s, _ in want}) > 1


@CASES
def test_store(spark, folders, case):
    folder, docs, _ = folders[case]
    ids = brute.ids(public_tokenizers.path(STORED), [t for _, t in docs], STORED_END)
    want, at = {}, 0
    for d, i in sorted(zip([d for d, _ in docs], ids, strict=True), key=lambda x: (x[0] is not None, x[0])):
        want[d] = (at, len(i), brute.crc(i))
        at += len(i)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op8_store", folder)} == want


def test_ids_beyond_width(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="more than 1 bytes"):
        store.write_store(docs, f"{tmp_path}/store", STORED, STORED_END, width=1)


@CASES
@pytest.mark.parametrize(("hot", "size"), [(suffix.HOT, blocks.BLOCK_BYTES), (3, 1 << 16)])
def test_repeats(spark, folders, case, hot, size, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    folder, docs, _ = folders[case]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op9_suffix", folder)}
    assert got == brute.repeats(docs)


@CASES
@pytest.mark.parametrize("most", [decontam.BROADCAST_ROWS, 0])
def test_leaks(spark, folders, case, most, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", most)
    folder, docs, items = folders[case]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows(spark, "op10_decontamination", folder)}
    want = brute.leaks(docs, [x for x in items if x[0] is not None])
    assert got == want
