"""Token ids of whole texts by a public tokenizer file, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable

from tokenizers import Tokenizer

# Entries of the cache of one Python worker; about 200 bytes each.
CACHE_ENTRIES = 800_000

# Chunks whose letters are ASCII or Latin-1: normal form, lower case and classes are plain here.
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: b for b in _PRINTABLE} | {
    b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)
}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Chunks(dict):
    """Ids of the chunks between blanks and line feeds, and of their pieces that the merges see on their own."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if _PLAIN.fullmatch(chunk):
            lower = chunk.lower()
            pieces = [lower] if lower.isalpha() else _PIECES.findall(lower)
            if pieces == [chunk]:
                spelled = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_ALPHABET)
                found = _packed([token.id for token in self.tokenize(spelled)])
            else:
                found = b"".join(map(self.__getitem__, pieces))
        else:
            found = _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


def _white_space_separates(config: dict) -> bool:
    """True for lower-casing word tokenizers that drop white space: their chunks can be encoded one by one."""
    normalizers = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        normalizers == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert") is True
        and steps[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    )


@functools.cache
def encoder(path: str) -> Callable[[str], bytes]:
    """Encode whole texts with the tokenizer file at ``path``, without added special tokens."""
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    if not _white_space_separates(config):
        return lambda text: _packed(tokenizer.encode(text, add_special_tokens=False).ids)
    chunks = _Chunks(tokenizer)
    return lambda text: b"".join(map(chunks.__getitem__, text.replace("\n", " ").split(" ")))
