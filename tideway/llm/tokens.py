"""Token ids of whole texts with a given byte-level BPE vocabulary.

The vocabulary is read from two files of the same tokenizer (ranks for the fast path, JSON for the rest); their paths are
parameters, and the files stay where they are. Both give the same ids; texts that hold a string of an added token (which
is one id) take the slower path.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np


def default_vocabulary() -> tuple[str, str]:
    """(JSON file, rank file) of the 50k byte-level vocabulary of this machine."""
    import public_tokenizers as files

    return files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")


@functools.cache
def _load(json_path: str, ranks_path: str):
    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(json_path, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f).get("added_tokens", [])]
    return fast, Tokenizer.from_file(json_path), added


def encode(text: str, vocabulary: tuple[str, str]) -> np.ndarray:
    """Ids of one text as little-endian uint32, without special tokens around it."""
    fast, whole, added = _load(*vocabulary)
    if any(x in text for x in added):
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def fast_encoder(vocabulary: tuple[str, str]):
    """The encoder of the rank file, to which strings of added tokens are ordinary text."""
    return _load(*vocabulary)[0]
