"""Token ids by an installed tokenizer library, for the operators that take ids as given (packing, token files)."""

from __future__ import annotations

import functools
import json

import numpy as np

from lapwing.llm.bpe import PATTERN, byte_characters, load


@functools.cache
def encoding(path: str):
    """The vocabulary of a byte-level tokenizer file as a tiktoken encoding: same ids, several times the speed. One copy for each Python worker."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str, *, special: bool = True) -> np.ndarray:
    """Ids of a text. special: whether special strings in it become their ids. The library gives up on very long runs of white space; those texts go by Bpe, which gives the same ids."""
    known = encoding(path)
    try:
        return known.encode_to_numpy(text, allowed_special=set(known.special_tokens_set)) if special else known.encode_to_numpy(text, disallowed_special=())
    except ValueError:
        return np.array(load(path).encode(text, special=special), np.uint32)
