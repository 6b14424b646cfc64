"""Word-cached encoding with a public byte-pair vocabulary.

``word_bpe_49k.json`` normalises white space to one blank, lower-cases, and never merges across
a blank.  Encoding a text is therefore the concatenation of the encodings of its ASCII-blank
separated words, and each distinct word has to go through the tokenizers library only once per
Python worker.  Words made of Latin letters and then ASCII marks are two pretokens at most and go
straight to the library's BPE model; every other word goes through the library's whole pipeline.
"""

from __future__ import annotations

from array import array

#: Words whose ids one Python worker remembers, and as many from the generation before.
CACHE_WORDS = 400_000
#: Only words up to this many bytes are remembered, so the store stays small whatever the texts are.
CACHE_WORD_BYTES = 64

#: ASCII marks that make one pretoken with each other (the apostrophe starts contractions and is left out).
_MARKS = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_LETTERS = frozenset(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))


class _Store(dict):
    """A dict that computes what it misses and keeps two generations of what it computed."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.compute(key)
            if len(key) > CACHE_WORD_BYTES:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class _Words:
    """word (bytes, ASCII letters in lower case) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.pieces = self.tok.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _LETTERS if not c.isascii()}
        self.words = _Store(self._word, most)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return array("I", [t.id for t in self.pieces(word.decode())]).tobytes()
        core = word.rstrip(_MARKS)
        text = core.decode("utf-8", "replace")
        if not _LETTERS.issuperset(text):
            return self.plain(word)
        ids = [t.id for t in self.pieces(text.translate(self.table))] if text else []
        if len(core) < len(word):
            ids += [t.id for t in self.pieces(word[len(core) :].decode())]
        return array("I", ids).tobytes()

    def plain(self, text: bytes) -> bytes:
        return array("I", self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:  # special tokens are found before the case is folded
            return b"".join(map(self.plain, text.split()))
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_LOADED: dict[tuple[str, int], _Words] = {}


def encoder(path: str, most: int = CACHE_WORDS):
    """Returns encode(text: bytes) -> bytes: the text's ids as little-endian unsigned 32-bit integers; most words are remembered twice over."""
    words = _LOADED.get((path, most))
    if words is None:
        words = _LOADED[path, most] = _Words(path, most)
    return words.encode


def forget() -> None:
    """Lets go of the words that this Python worker remembers, before work that encodes nothing."""
    for loaded in _LOADED.values():
        loaded.words.clear()
        loaded.words.old = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file; resolved where it is called, so executors find their own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)
