"""Public vocabularies, read where they are used. Paths are parameters; nothing is copied here."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers


def path(name: str) -> str:
    """A file name of the public tokenizers, or any path, as a path."""
    return name if "/" in name else public_tokenizers.path(name)


@lru_cache(4)
def ranks(name: str) -> dict[bytes, int]:
    with open(path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(4)
def encoding(name: str, special: tuple[tuple[str, int], ...] = ()):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens=dict(special))


@lru_cache(4)
def token_bytes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes one after another, and where each id's bytes start."""
    by_id = sorted((rank, token) for token, rank in ranks(name).items())
    size = by_id[-1][0] + 1
    lengths = np.zeros(size, np.int64)
    lengths[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
    return np.frombuffer(b"".join(t for _, t in by_id), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


@lru_cache(2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


@lru_cache(2)
def tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


@lru_cache(2)
def pieces(name: str):
    """A ``.model`` vocabulary with byte fallback, and which of its ids are single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path(name))
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@lru_cache(4)
def piece_bytes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """As ``token_bytes`` for a ``.model`` vocabulary: U+2581 is a space, a byte piece its byte."""
    model, single = pieces(name)
    tokens = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    data = [bytes([int(t[3:5], 16)]) if one else t.replace("\u2581", " ").encode() for t, one in zip(tokens, single.tolist(), strict=True)]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
