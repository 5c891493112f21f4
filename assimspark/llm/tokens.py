"""Token ids of whole texts with a public tokenizer file, inside tasks."""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np

TOKENIZER_FILE = "byte_bpe_50k.json"

#: Fixed pattern of byte-level pre-tokenizers, written out for characters whose classes no Unicode version changes: ASCII, Latin letters and
#: common punctuation. LETTER and NUMBER are \p{L} and \p{N} in PLAIN; white space in PLAIN is tab, line feed, carriage return and space.
LETTER, NUMBER, BLANK = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼½¾", r"\t\n\r\x20"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€™]*")
PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class Pieces(dict):
    """Ids of pieces as bytes; one that is not there is taken from the older generation or from the library.

    A generation holds at most ``most`` pieces of ``most_chars`` characters together; a piece longer than that is never kept.
    """

    def __init__(self, model, dtype: np.dtype, most: int, most_chars: int):
        super().__init__()
        self.model, self.letter, self.most, self.most_chars, self.chars, self.before = model, "H" if dtype.itemsize == 2 else "I", most, most_chars, 0, {}
        self.alphabet = byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        raw = self.before.get(piece)
        if raw is None:
            as_bytes = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(as_bytes)]
            raw = struct.pack(f"<{len(ids)}{self.letter}", *ids)
        if len(piece) > self.most_chars:
            return raw
        if len(self) >= self.most or self.chars + len(piece) > self.most_chars:
            self.before, self.chars = dict(self), 0
            self.clear()
        self[piece] = raw
        self.chars += len(piece)
        return raw


class Encoder:
    """Encodes texts as the tokenizers library does, and remembers the ids of the pieces that its pre-tokenizer cuts texts into.

    A byte-level tokenizer encodes each piece by itself, so a piece has the same ids in any text; the library is asked for pieces not met
    yet. The memory is bounded (two generations of ``most`` pieces and ``most_chars`` characters; the older one goes when the newer is full) and doesn't change results.
    Texts with a special token's string or with characters outside ``PLAIN``, and all texts where the tokenizer is of another kind, go to
    the library as they are.
    """

    def __init__(self, path: str, most: int = 300_000, most_chars: int = 8_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab().values(), default=0)
        self.dtype = np.dtype("<u2") if top < 2**16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer")
        self.added = [t["content"] for t in kind.get("added_tokens") or []]
        self.known = Pieces(self.tokenizer.model, self.dtype, most, most_chars)

    def _is_plain(self, text: str) -> bool:
        return self.by_piece and PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian, of this encoder's dtype."""
        return b"".join(map(self.known.__getitem__, PIECE.findall(text))) if self._is_plain(text) else self.whole(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker process: what it has learned serves all tasks that the process runs."""
    return Encoder(path)


def crc32_of(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
