"""Byte-level BPE encoding and decoding.

A text is split at special strings, then into words by the vocabulary's pattern. A short word is merged in a contiguous rank
array: one list holds the parts, another the rank of each part joined with its right neighbour. The least rank is found by a scan,
the boundary there is deleted, and the ranks on its two sides are looked up again. Words beyond SHORT bytes would make the scan quadratic,
so those keep the same ranks in a heap over a linked list; both give the same ids. Words are remembered in a cache of bounded size.

Edge cases: a null text is an empty one and has no ids; very long texts are encoded whole; special strings inside a text
become their ids, as the vocabulary file says; bytes that are no valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import text_of

#: Fixed: the word pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 256
CACHE = 500_000
NO_RANK = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Bpe:
    """Vocabulary and merges of a tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, model)]
        plain = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        if kinds != [None, "ByteLevel", "BPE"] or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True) or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        stand = byte_characters()
        back = {c: b for b, c in enumerate(stand)}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.bytes.update({i: t.encode() for t, i in self.special.items()})
        self.single = [vocab[c] for c in stand]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        parts = [self.single[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        merges = self.merges
        none = (NO_RANK, -1)
        ranks = [merges.get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least is none or least[0] == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get(parts[i] << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] << 32 | parts[i], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (m := merges.get(a << 32 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = merges[a << 32 | b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get(parts[i] << 32 | parts[after[i]]):
                    heapq.heappush(heap, (m[0], i, parts[i], parts[after[i]]))
            if (p := before[i]) >= 0 and (m := merges.get(parts[p] << 32 | parts[i])):
                heapq.heappush(heap, (m[0], p, parts[p], parts[i]))
        return [x for x in parts if x >= 0]

    def _words(self, text: str, out: list[int]) -> None:
        cache = self.cache
        for word in self.pattern.findall(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8"))
                if len(word) < 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = ids
            out += ids

    def encode(self, text: str, *, special: bool = True) -> list[int]:
        """special: whether special strings in the text become their ids."""
        out: list[int] = []
        for i, part in enumerate(self.split.split(text) if self.split and special else [text]):
            if i % 2:
                out.append(self.special[part])
            elif part:
                self._words(part, out)
        return out

    def decode(self, ids) -> str:
        known = self.bytes
        return b"".join([known[i] for i in ids if i in known]).decode("utf-8", errors="replace")


@functools.cache
def load(path: str) -> Bpe:
    """One copy for each Python worker."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids: little-endian unsigned 32-bit integers in a binary column."""

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([np.array(bpe.encode(t), "<u4").tobytes() for t in texts], dtype=object)

    return docs.withColumn(ids_col, encoded(text_of(text_col)))


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text that a binary column of ids stands for."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in column], dtype=object)

    return rows.withColumn(text_col, decoded(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes the ids again, in one pass over the table."""

    def work(batches):
        bpe = load(path)
        for b in batches:
            rows = []
            for t in b["text"]:
                ids = bpe.encode(t)
                rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest()))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
