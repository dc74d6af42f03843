"""The pipeline against plain versions of its stages, and on odd and empty tables."""

from __future__ import annotations

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lathework.llm import store
from lathework.llm.queries import PACKED, PACKED_END, STORED, STORED_END
from tests.llm import brute
from tests.llm.test_contracts import odd_items, odd_texts

SF = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, dup, _, failed = brute.quality(text)
    lines = sum(1 for x in (text or "").split("\n") if brute.words(x))
    return not (failed or 100 * symbols > 20 * chars or (lines >= 4 and 100 * dup > 60 * lines) or chars < 2 * n or chars > 25 * n)


def kept(docs, items):
    docs = [(d, t) for d, t in docs if passes(t)]
    near = brute.near(docs)
    docs = [(d, t) for d, t in docs if d is None or near[d][1] == d]
    leaks = brute.leaks(docs, items)
    return [(d, t) for d, t in docs if not leaks[d][1]]


def test_pipeline(spark):
    read = lambda n, a: list(zip(*pq.read_table(f"{SF}/{n}.parquet").select([a, "text"]).to_pydict().values(), strict=True))
    want = kept(read("documents", "doc_id"), read("benchmark", "item_id"))
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == {d for d, _ in want}
    plain = [(d, t) for d, t in want if not brute.pii(t)[1] and not any(c.isdigit() for c in t)]
    assert plain
    for (d, _), ids in zip(plain, brute.ids(public_tokenizers.path(PACKED), [t for _, t in plain], PACKED_END), strict=True):
        assert b"".join(r.ids for r in sorted(pieces[d], key=lambda r: r.piece)) == ids.tobytes()


@pytest.mark.parametrize("rows", [None, 0])
def test_odd_tables(spark, tmp_path, rows):
    docs = [(i, t) for i, t in enumerate(odd_texts())]
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame = frame.withColumns({c: F.lit("own") for c in ("pii", "rejected_by", "kept_id", "hit_id", "task")})
    (frame if rows is None else frame.limit(rows)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(odd_items(), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, str(tmp_path))
        assert out.columns == read.columns
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = kept(docs if rows is None else [], [x for x in odd_items() if x[0] is not None])
    assert got == {d for d, _ in want}


def test_store_gives_the_documents_back_and_notices_damage(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(odd_texts())]
    path = str(tmp_path / "store")
    store.write_store(spark.createDataFrame(docs, "doc_id bigint, text string"), path, public_tokenizers.path(STORED), STORED_END)
    want = {d: i.astype("<u2").tobytes() for (d, _), i in zip(docs, brute.ids(public_tokenizers.path(STORED), [t for _, t in docs], STORED_END), strict=True)}
    assert {r.doc_id: bytes(r.ids) for r in store.read_store(spark, path).collect()} == want
    chunks = store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("address").distinct().count()
    bad = chunks.withColumn("ids", F.concat("ids", F.lit(b"xx"))).withColumn("is_chunk", F.lit(True))
    bad.write.mode("overwrite").partitionBy("is_chunk").parquet(str(tmp_path / "bad" / "cut"))
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(str(tmp_path / "bad" / part), partitionBy="part" if part == "recipes" else None)
    with pytest.raises(Exception, match="damaged"):
        store.verify_store(spark, str(tmp_path / "bad")).collect()
