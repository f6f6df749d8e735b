"""Public tokenizers on the executors: each process loads a vocabulary file once."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from granary.functions.tokens import loaded as encoding

#: Folder of the vocabulary files; every executor must find it under the same path.
FOLDER = os.environ.get("GRANARY_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"


def vocabulary(folder: str = FOLDER, name: str = BYTE_BPE) -> str:
    return os.path.join(folder, name)


def counts(texts: list[str], path: str) -> list[int]:
    """Number of subwords of each text."""
    e = encoding(path)
    return [len(e.encode_ordinary(x)) for x in texts]


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each subword, by its number."""
    e = encoding(path)
    sizes = np.zeros(e.max_token_value + 1, dtype=np.int64)
    for piece, rank in e._mergeable_ranks.items():
        sizes[rank] = len(piece)
    return sizes
