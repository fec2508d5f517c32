"""Whole texts to token ids of a tokenizers file, word by word with a bounded cache."""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space at which a text is cut: the normalizer makes each one blank, and no token spans it.
WORD = re.compile(r"[^ \t-\r]+")
#: What ``str.split`` also cuts at; texts with one are cut by ``WORD``.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Printable ASCII and Latin letters that no normalization changes and whose lower case is one letter.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = {bytes([b]).decode("latin-1"): c for b, c in _byte_letters().items()}
_TO_LETTERS = str.maketrans(_LETTER)


# The normalizer and pre-tokenizer, as a file says them, under which words are cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Encodes as the library does on the whole text; ids are 16-bit.

    Words of printable ASCII and Latin letters are lower-cased and cut here as the file's
    pre-tokenizer does and each piece goes to the library's model; all other words, and those with
    ``<|``, go to the library whole. This holds for just that normalizer and pre-tokenizer and for
    added tokens with ``<|``; with other files each text goes to the library as it is.
    """

    def __init__(self, path: str, plain_specials: bool = False, cache: int = 300_000):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        self.tokenize = self.tok.model.tokenize  # ``model`` makes an object each time
        if sys.byteorder != "little":
            raise ValueError("the ids' bytes are little-endian")
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: more than 65,536 ids")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.fast = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and not spec.get("truncation") and all("<|" in t["content"] and " " not in t["content"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        # Two generations of each cache: a full young one becomes the old one.
        self.limit, self.words, self.pieces, self.old_pieces = cache, _Words(self, {}), {}, {}

    def word(self, w: str) -> bytes:
        """The ids of a word as little-endian 16-bit integers."""
        if w.isascii() and w.isalpha():
            return self.piece(w.lower())
        if _PLAIN.fullmatch(w) and "<|" not in w:
            return b"".join(map(self.piece, _PIECE.findall(w.lower())))
        return np.asarray(self.tok.encode(w, add_special_tokens=False).ids, "<u2").tobytes()

    def piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            got = self.old_pieces.get(p)
            if got is None:
                letters = p if p.isascii() else p.encode().decode("latin-1").translate(_TO_LETTERS)
                got = array("H", [t.id for t in self.tokenize(letters)]).tobytes()
            if len(self.pieces) >= self.limit:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[p] = got
        return got

    def encode(self, text: str) -> bytes:
        if not self.fast:
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self.words) >= self.limit:
            self.words = _Words(self, dict(self.words))
        words = self.words
        return b"".join([words[w] for w in (WORD.findall(text) if _OTHER_BLANK.search(text) else text.split())])

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of each of the texts; Arrow cuts them, and each of their words is looked up once."""
        if not self.fast:
            return [self.encode(text or "") for text in texts.to_pylist()]
        cut = pc.ascii_split_whitespace(texts)  # just the blanks of WORD; beside them there may be empty words
        words = cut.values.dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        # As Python objects, 65,536 of the words at a time.
        some = (words.dictionary.slice(i, 1 << 16).to_numpy(zero_copy_only=False) for i in range(0, len(words.dictionary), 1 << 16))
        ids = pa.concat_arrays([pa.array([self.word(w) for w in s], pa.large_binary()) for s in some]).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], "<i8")[cut.offsets.to_numpy()].tolist()
        flat = memoryview(ids.buffers()[2] or b"")
        return [bytes(flat[i:j]) for i, j in zip(at, at[1:])]


class _Words(dict):
    def __init__(self, encoder: Encoder, old: dict[str, bytes]):
        super().__init__()
        self.encoder, self.old = encoder, old

    def __missing__(self, w: str) -> bytes:
        got = self.old.get(w)
        if got is None:
            got = self.encoder.word(w)
        if len(w) <= 64 and len(self) < 2 * self.encoder.limit:
            self[w] = got
        return got


_open: dict[tuple, Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """This process's encoder of a file; the file is read once per worker."""
    key = (path, plain_specials)
    if key not in _open:
        _open[key] = Encoder(path, plain_specials)
    return _open[key]
