"""Token ids of whole texts by a public byte-level tokenizer file.

The file's vocabulary and split rule are given to the faster of two libraries,
which encodes each whole text; a probe at the start and a test over odd
characters hold the ids against the file's own library. Texts that hold the
written form of one of the file's added tokens, or a run of white space on which
the fast library's split rule gives up, go through the file's own library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
_PROBE = ["It's 12.50€, naïve\nWörter — (test)!", "a\nb c", "don't###", "", "  two \t  spaces \n\n "]
_LONG_SPACE = re.compile(r"\s{1000}")
_workers: dict[str, TextEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Holds one vocabulary; no state grows with the texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        self.path, self._own = path, None
        own = self.own()
        every = own.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(every.values()) + 1, np.int64)
        for word, k in every.items():
            self.lengths[k] = len(word)  # the printable form has one character a byte
        byte_of = {c: b for b, c in enumerate(_printable_bytes())}
        plain = own.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(byte_of.__getitem__, word)): k for word, k in plain.items() if all(c in byte_of for c in word)}
        self.added = [t.content for t in own.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if [self.fast.encode_ordinary(t) for t in _PROBE] != [e.ids for e in own.encode_batch(_PROBE, add_special_tokens=False)]:
            raise ValueError(f"{path} isn't a byte-level vocabulary with the usual split rule")
        self._own = None

    def own(self):
        """The file's own library, loaded when a text needs it."""
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
        return self._own

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            odd = _LONG_SPACE.search(text) or any(a in text for a in self.added)
            ids = self.own().encode(text, add_special_tokens=False).ids if odd else self.fast.encode_ordinary(text)
            yield np.array(ids, "<u4").tobytes()


def encoder(path: str) -> TextEncoder:
    """The worker's encoder, kept from task to task."""
    if path not in _workers:
        _workers[path] = TextEncoder(path)
    return _workers[path]


def _printable_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one free from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]
