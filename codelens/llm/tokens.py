"""Token ids of texts by a public vocabulary, whose rank file's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path, without suffix, of an installed vocabulary: ``.tiktoken`` has its ranks, ``.json`` the same for another library."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _ranks(path: str, added: bool = False):
    import public_tokenizers
    import tiktoken

    with open(f"{path}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_added(path) if added else {})


@lru_cache(maxsize=2)
def _added(path: str) -> dict[str, int]:
    """The vocabulary's added tokens, such as ``<|endoftext|>``, which the other library finds in ordinary text."""
    from tokenizers import Tokenizer

    return {token.content: number for number, token in Tokenizer.from_file(f"{path}.json").get_added_tokens_decoder().items()}


@lru_cache(maxsize=4)
def _slow(path: str, added: bool = False):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{path}.json")
    if not added:
        tokenizer.encode_special_tokens = True
    return tokenizer


def encode(text: str, path: str, added: bool = False) -> np.ndarray:
    """Ids of the whole text. Names of added tokens in it have their own ids if ``added``, else they are ordinary text.

    Both libraries give the same ids; the one that reads ranks is four times as
    fast, but gives up on some extreme texts (such as a million equal letters).
    """
    try:
        return _ranks(path, added).encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=())
    except BaseException as error:  # its panics are no Exceptions
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return np.array(_slow(path, added).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def n_ids(path: str) -> int:
    """One more than the vocabulary's largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(f"{path}.json").get_vocab(with_added_tokens=True).values()) + 1


def id_kind(path: str, *others: int) -> np.dtype:
    """The little-endian numbers that hold every id of the vocabulary, and ``others``."""
    return np.dtype("<u2" if max(n_ids(path), *(other + 1 for other in others)) <= 1 << 16 else "<u4")
