"""Token ids of whole texts by a public byte-level BPE vocabulary, as unsigned 32-bit bytes (little-endian hosts).

The ids are those of ``tokenizers`` for the same vocabulary file with add_special_tokens=False: nothing is added, and a
special string inside a text is its own id. The faster of the installed encoders makes them, and tests hold the two
against each other.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

_made: dict[str, Callable[[str], bytes]] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable alphabet of byte-level BPE files: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _made_from(vocabulary: str) -> Callable[[str], bytes]:
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    added = model.get("added_tokens", [])
    char, special = _byte_of_char(), {t["content"]: t["id"] for t in added}
    if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{vocabulary} has special strings that take in what stands beside them")
    ranks = {bytes(char[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: this vocabulary's word pattern
    made = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> bytes:
        held = any(x in text for x in special)
        return array("I", made.encode(text, allowed_special="all") if held else made.encode_ordinary(text)).tobytes()

    return encode


def id_bytes(vocabulary: str) -> Callable[[str], bytes]:
    """text -> bytes of its ids; one encoder for each Python worker."""
    if vocabulary not in _made:
        _made[vocabulary] = _made_from(vocabulary)
    return _made[vocabulary]
