"""Alignment of two tokenizers against the libraries' own tokens, byte by byte."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from lathework.llm import align
from lathework.llm.queries import QUERIES
from tests.llm.brute import sha

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(models, text):
    """[(id, bytes)] of both sides, None if there are none."""
    a, b = models
    if not text:
        return None
    letters = align._byte_letters()
    e = a.encode(f" {text}", add_special_tokens=False)
    one = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    two = [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    whole = f" {text}".encode()
    return (one, two) if all(b"".join(x for _, x in side) == whole for side in (one, two)) else None


def plain(models, docs):
    """The rows of the query, in the order of `docs`."""
    found, counts, best = [], Counter(), defaultdict(int)
    for _, text in docs:
        sides = tokens(models, text)
        groups, links, ends = [], [], []
        for side in sides or ():
            at, own = 0, {}
            for i, data in side:
                at += len(data)
                own[at] = i
            ends.append(own)
        if sides:
            at, begin = [0, 0], [0, 0]
            number = [{e: k + 1 for k, e in enumerate(own)} for own in ends]
            for cut in sorted(ends[0].keys() & ends[1].keys()):
                links.append((ends[0][cut], ends[1][cut]))
                for s in (0, 1):
                    begin[s] = at[s]
                    at[s] = number[s][cut]
                groups.append("|".join(",".join(str(i) for i, _ in sides[s][begin[s] : at[s]]) for s in (0, 1)))
        counts.update(links)
        found.append((sides, groups, links))
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (d, len(s[0]) if s else 0, len(s[1]) if s else 0, len(g), len(k), sha(";".join(g)) if s else "", sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k))
        for (d, _), (s, g, k) in zip(docs, found, strict=True)
    ]


def odd_texts():
    return [
        None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a\n b", "a \nb", "a\nb", "a\n\nb\n", "a\tb \t c", "x\r\ny", "<|endoftext|> and </s> <s><unk> <0x0A>", "it's we'll 12345 ...", "▁", "a▁b", "é ü 　 x​y",
        "😀😀 ok", "ﬁne İstanbul", "a\x1cb \x1d c.\x1e d", "\x00", "word " * 500, "end.\n\n<|endoftext|>\nNext", "naïve café — “quoted” text", "x" * 3000, "日本語のテキスト です", " lead", "trail\n",
    ]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=str)


def test_words_as_the_libraries(models):
    """Tokens of texts cut into words are those of whole texts."""
    both = align.Pair(align.BYTES, align.PIECES)
    docs = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    texts = odd_texts() + docs + [t[:k] for t in docs[:200] if t for k in (7, 50, 133)]
    for text, got in zip(texts, both.encode(texts), strict=True):
        want = tokens(models, text)
        assert (got is None) == (want is None), text
        if want:
            assert [x.tolist() for x in got] == [[i for i, _ in side] for side in want], text


def test_cuts():
    r = np.random.default_rng(3)
    for _ in range(300):
        total = int(r.integers(1, 90))
        ends = [np.unique(np.append(r.integers(1, total + 1, r.integers(0, 40)), total)) for _ in range(2)]
        shared, a, b = align.cuts(*(np.diff(e, prepend=0) for e in ends))
        want = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert shared.tolist() == want
        assert a.tolist() == [int((ends[0] <= c).sum()) for c in want]
        assert b.tolist() == [int((ends[1] <= c).sum()) for c in want]


@pytest.mark.parametrize("size", [align.BLOCK_BYTES, 20000])
def test_query(spark, models, monkeypatch, size):
    monkeypatch.setattr(align, "BLOCK_BYTES", size)
    docs = list(zip(*pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True))
    assert rows_of(QUERIES["op12_align"](spark, SF)) == sorted(plain(models, docs), key=str)


@pytest.mark.parametrize("limits", [{}, {"GROUP": 5}, {"BLOCK_ROWS": 1, "WORDS": 3}])
def test_odd(spark, models, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(align, name, value)
    rows = [(i, t, "own", "own") for i, t in enumerate(odd_texts() * 2)] + [(None, "a b", "own", "own"), (3, "one", "own", "own"), (3, "one", "own", "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string, block string").repartition(3)
    got = align.align(docs)
    assert rows_of(got) == sorted(plain(models, [r[:2] for r in rows]), key=str)
    ids = {i: t for i, t, *_ in rows if i not in (None, 3)}
    for r in got.where("doc_id <> 3").collect():
        want = tokens(models, ids[r.doc_id]) or ([], [])
        assert (r.a_ids, r.b_ids) == tuple([i for i, _ in side] for side in want)
        assert (len(r.a_last), r.a_last[-1:], r.b_last[-1:]) == (r.n_groups, [r.n_a] * bool(r.n_a), [r.n_b] * bool(r.n_b))
    assert align.align(docs.limit(0)).collect() == []
