"""Token ids of a tokenizer file, as the packing operators need them."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

# Fixed value: how the byte-level tokenizer cuts a text before merging bytes.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of a byte-level tokenizer file, as little-endian unsigned 32-bit bytes.

    Where the file's merges stand in the order of their ids, as they do in a file made by plain
    byte-pair training, ``tiktoken`` gives the same ids several times as fast and does the encoding;
    other files, and texts that hold a special token's string, go through ``tokenizers`` itself, as do
    texts with a run of some million blanks, which ``tiktoken`` refuses.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = _by_rank(spec)

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
            except ValueError:  # its pattern matcher has a stack of bounded size
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _by_rank(spec: dict):
    """A ``tiktoken`` encoding of a tokenizer file, if ids follow the order of its merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
    if not plain or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if model.get("ignore_merges") or any(a >= b for a, b in zip(made, made[1:])):
        return None
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
