"""Public vocabulary files and the libraries that read them. Paths are parameters; nothing is trained."""

from __future__ import annotations

import base64
import os
from functools import lru_cache


def public(name: str) -> str:
    """Path of a file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizer of the ``tokenizers`` library, on one thread: Spark has the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def ids_of(path: str, texts: list[str]) -> list[list[int]]:
    """The library's ids without added special tokens; special strings inside a text are read as it reads them."""
    return [x.ids for x in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file."""
    out = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                out[base64.b64decode(token)] = int(rank)
    return out
