"""Token ids of a tokenizer file, encoded in the executors' Python workers.

``.json`` files are byte-level BPE vocabularies of the ``tokenizers`` library.  Where such a file is of the
plain kind (byte-level pre-tokenizer with its own pattern and no prefix space, no normaliser, merges in the
order of their ids, special tokens as plain strings) its ranks are handed to ``tiktoken``, which gives the
same ids about four times as fast; tests compare the two over every code point.  Any other ``.json`` file is
encoded by ``tokenizers`` itself, ``.model`` files by ``sentencepiece``.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
import json
from collections.abc import Callable

import numpy as np


def tokenizer_version(path: str) -> str:
    """Digest of the file and of the version of the library that encodes: counts under another digest are never reused."""
    library = "sentencepiece" if path.endswith(".model") else "tiktoken" if _plain_ranks(path) else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _byte_of_char() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _plain_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    added = spec.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    chars = _byte_of_char()
    ranks = {bytes(chars[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    return (ranks, special) if made == sorted(made) and len(made) + 256 == len(ranks) else None


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32), without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.array(pieces.encode(text, num_threads=1), np.uint32)
    if plain := _plain_ranks(path):
        import public_tokenizers
        import tiktoken

        ranks, special = plain
        fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
