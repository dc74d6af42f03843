r"""Token ids of many texts by the tokenizers library, with each distinct word encoded once.

The two public vocabularies cut a text into pieces and encode each piece alone, so a text's ids are its pieces' ids in a
row, and a text may be cut wherever a piece begins. In `word_bpe_49k` no piece holds white space: any blank will do, but
for U+001C to U+001F, which Python counts as blanks and the vocabulary has tokens for; the last id of each piece says so,
so that plain words can be encoded many at once. In `byte_bpe_50k` a blank is the
first character of the piece after it and a line feed begins a piece, so texts are cut before both; only in runs of three
or more blanks, or two at the end or before an added token, a piece can hold a later blank. Such texts, and all texts under
another vocabulary, go to the library whole. A word that holds no white space but the blank or line feed it begins with
has just one id that begins with either, its first, so that such words, too, can be encoded many at once. Under
`word_bpe_49k`, which knows small letters only, a plain word is its letters, made small, and the marks behind them, each a piece: a word that differs
from known ones in these alone is put together from theirs.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

# How the vocabularies treat blanks.
JOINED, APART = "byte_bpe_50k.json", "word_bpe_49k.json"
_BEGINS = ("\u0120", "\u010a")  # how `byte_bpe_50k` writes a blank and a line feed
_SEPARATORS, _BLANKS = "\x1c\x1d\x1e\x1f", re.compile(r"[^\S\x1c-\x1f]+")
# Fixed value: in `word_bpe_49k`, a word of Latin letters is one piece, and the marks behind it another. (U+0130 is left out, as
# in small letters it is two characters.)
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]+)?")
# Fixed value: in `byte_bpe_50k`, a word with a blank or a line feed before it and none inside.
_SPACED = re.compile(r"[ \n]\S+")
#: Plain words that the library encodes as one text, and characters of texts whose new words are learnt together.
TOGETHER, GROUP = 64, 1 << 18
#: Words that a worker remembers, and their characters; beyond, it forgets all and starts anew.
WORDS, CHARACTERS = 1_000_000, 16_000_000


class _Numbers(dict):
    """Word to its number; a new word gets the next one and is put on the list of new ones."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, word: str | tuple[str]) -> int:
        self[word] = n = len(self)
        if isinstance(word, tuple):  # the first of a text: no blank before it
            word = word[0]
        elif not word.startswith("\n"):
            word = " " + word
        self.new.append(word)
        self.characters += len(word)
        return n


class _Words(_Numbers):
    """The same for a vocabulary whose words are all alike, wherever they stand; they are listed as they are."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _flat(made: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as their lengths and the ids in a row."""
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    return sizes, np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))


class Encoder:
    """Ids of texts. `path` is the tokenizer's file, or the bare name of a public one, which is looked up on this machine."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if os.sep not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = os.path.basename(path)
        ends = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.long_runs = re.compile(rf"\s\s(?:{'|'.join([r'\s', r'\Z', *ends])})")
        self.size = self.tokenizer.get_vocab_size()
        if self.kind == APART:
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        elif self.kind == JOINED:
            self.begins = np.zeros(self.size, bool)
            self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(_BEGINS)]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Words() if self.kind == APART else _Numbers()
        self.ids, self.begin, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.held = self.known = 0  # ids, words

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of words, and the ids, many words in a call: the ids that end a word, or begin one, are known."""
        between = " " if self.kind == APART else ""
        made = self._batch([between.join(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER)])
        ids = np.fromiter(chain.from_iterable(made), np.uint32, sum(map(len, made)))
        if self.kind == APART:
            cuts = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        else:
            cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        if len(cuts) != len(new) + 1:  # the pattern promises otherwise
            return _flat(self._batch(new))
        return np.diff(cuts), ids

    def _parted(self) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
        """New words: the numbers of those of small letters, of others, and of those that are put together, with their letters' and marks'.

        Letters and marks may be new as well.
        """
        numbers, match, small, others, parts = self.numbers, _PLAIN.fullmatch, [], [], []
        for n, word in enumerate(numbers.new, self.known):  # the parts that are new come behind
            if m := match(word):
                whole, marks = m.groups()
                letters = whole.lower()
                if marks is not None:
                    parts.append((n, numbers[letters], numbers[marks]))
                elif letters != whole:
                    parts.append((n, numbers[letters], -1))
                else:
                    small.append(n)
            else:
                others.append(n)
        return small, others, parts

    def _put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remembers the ids of words, which stand in a row in `ids`."""
        while len(self.ids) < self.held + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[numbers] = self.held + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)

    def _learn(self) -> None:
        """Encodes words that have a number but no ids yet."""
        if self.kind == APART:
            small, others, parts = self._parted()
        new, first, self.numbers.new = self.numbers.new, self.known, []
        if not new:
            return
        self.known += len(new)
        while len(self.begin) < self.known:
            self.begin, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.sizes))
        if self.kind != APART:
            spaced = np.fromiter((_SPACED.fullmatch(w) is not None for w in new), bool, len(new))
            for some, encode in ((spaced, self._together), (~spaced, lambda words: _flat(self._batch(words)))):
                at = np.flatnonzero(some)
                self._put(first + at, *encode([new[k] for k in at.tolist()]))
            return
        self.numbers.characters += sum(map(len, new))
        self._put(np.array(small, np.int64), *self._together([new[n - first] for n in small]))
        self._put(np.array(others, np.int64), *_flat(self._batch([new[n - first] for n in others])))
        whole, letters, marks = np.array(parts, np.int64).reshape(-1, 3).T
        alone = marks < 0  # they have the very ids of their letters
        self.begin[whole[alone]], self.sizes[whole[alone]] = self.begin[letters[alone]], self.sizes[letters[alone]]
        both = np.stack((letters, marks), 1)[~alone]
        self._put(whole[~alone], self.sizes[both].sum(axis=1), self._gathered(both.ravel()))

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words by their numbers."""
        begin, size = self.begin[numbers], self.sizes[numbers]
        last = np.cumsum(size)
        total = int(last[-1]) if len(last) else 0
        # The ids of one word are neighbours: step on by one, and jump where the next word begins.
        return self.ids[np.arange(total) + np.repeat(begin - (last - size), size)]

    def _words(self, text: str) -> list | None:
        """The words of a text; None if it has to go to the library whole."""
        if self.kind == APART:
            apart = any(c in text for c in _SEPARATORS)
            return [w for w in _BLANKS.split(text) if w] if apart else text.split()
        if self.kind == JOINED and not self.long_runs.search(text):
            words: list = text.replace("\n", " \n").split(" ")
            words[0] = (words[0],)
            return words
        return None

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit; none for null. New words of some texts in a row are learnt together."""
        begin, size = 0, 0
        for k, text in enumerate([*texts, None]):
            size += len(text or "")
            if k == len(texts) or size > GROUP:
                yield from self._group(texts[begin : k + 1])
                begin, size = k + 1, 0

    def _group(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.numbers) > WORDS or self.numbers.characters > CHARACTERS:
            self._forget()
        numbered: list[np.ndarray | None] = []
        for text in texts:
            words = self._words(text) if text else []
            numbered.append(None if words is None else np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self._learn()
        whole = lambda text: np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return [whole(text) if n is None else self._gathered(n) for text, n in zip(texts, numbered, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
