"""Words put together from known letters and marks, against the library, and the rolling hash of the store by steps."""

from __future__ import annotations

import random

import numpy as np

from lathework.llm import store
from lathework.llm.queries import PACKED, STORED
from lathework.llm.tokens import Encoder

LETTERS = "abcdexyzABCDEXYZéÉßüÜİıĲǄǅŸſẞΣσΑK中̸̱́"
MARKS = ".,;:!?'\"()<>=|#&%$*[]{}`~^_-/\\@+"


def test_words_against_the_library():
    e, r = Encoder(STORED), random.Random(4)
    specials = ["<|endoftext|>", "<|startoftext|>", "it's", "We'LL", "'s", "3.", "a1", "\x1c", "a\x1fb"]
    for _ in range(300):
        words = []
        for _ in range(r.randrange(1, 40)):
            word = "".join(r.choice(LETTERS[: r.choice([8, 16, len(LETTERS)])]) for _ in range(r.randrange(5)))
            words.append(r.choice([word, word.upper(), word.title(), r.choice(specials)]) + "".join(r.choice(MARKS) for _ in range(r.choice([0, 0, 1, 3]))))
        texts = [" ".join(words), r.choice(["\n", " \t", " ", "　"]).join(words), None, ""]
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert ids.tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_the_library_sees_letters_once():
    """Forms of a word that differ by capitals and by marks were each encoded by the library."""
    e, seen, batch = Encoder(STORED), [], Encoder._batch
    e._batch = lambda texts: seen.extend(w for t in texts for w in t.split()) or batch(e, texts)
    texts = ["Brelt brelt, BRELT; brelt", "brelt. Brelt, tofim, (brelt", "TOFIM; brelt"]
    made = [ids.tolist() for ids in e.encode(texts)]
    assert made == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(seen) == sorted(["brelt", ",", ";", ".", "tofim", "(brelt"])


def test_words_with_their_blanks_against_the_library():
    e, r = Encoder(PACKED), random.Random(5)
    odd = ["<|endoftext|>", "a<|endoftext|>", "<|endoftext|>b", "\x1c", "a\x1fb", "\t", "x\t", "\r", "y\x85", "\u00a0", "\u180e", "z\u200b", "\u2003q", "it's", "'s", "\u0120", "\u010a", "\u0120\u010a", "3rd", "12,5", "\U0001f600", "", ""]
    for _ in range(400):
        words = ["".join(r.choice(LETTERS + MARKS) for _ in range(r.randrange(5))) if r.random() < 0.7 else r.choice(odd) for _ in range(r.randrange(1, 40))]
        texts = ["".join(w + r.choice([" ", " ", " ", "\n", "\n\n", " \n", "\n ", "\t"]) for w in words), " ".join(words), "\n".join(words), None, ""]
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert ids.tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_the_library_sees_many_words_in_a_call():
    """Each new word was a text of its own, which took half of the time of packing."""
    e, texts, batch = Encoder(PACKED), [], Encoder._batch
    e._batch = lambda some: texts.extend(some) or batch(e, some)
    text = "first" + "".join(f"{' ' if k % 9 else chr(10)}w{chr(97 + k % 26)}{k}," for k in range(2000)) + " a\tb"
    made = next(e.encode([text])).tolist()
    assert made == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(texts) < 100, len(texts)


def test_cut_points_by_one_id_after_another():
    r = np.random.default_rng(2)
    for n in (1, 128, 129, 600, 5000):
        ids = r.integers(0, 1 << 16, n).astype(np.uint32)
        spread = [(int(i) + 1) * int(store._FACTOR) % (1 << 64) for i in ids]
        spread = [x ^ x >> 29 for x in spread]
        want, last = [], 0
        for end in range(store.WINDOW, n + 1):
            h = 0
            for x in spread[end - store.WINDOW : end]:
                h = (h * int(store._FACTOR) + x) % (1 << 64)
            if (h ^ h >> 32) % store.MEAN == 0 or end == n or end - last == store.MOST:
                if end == n or end - last >= store.LEAST:
                    want.append(end)
                    last = end
        assert store.cut_points(ids) == (want or [n])
