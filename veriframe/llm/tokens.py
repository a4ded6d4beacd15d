"""Token ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import cache
from pathlib import Path

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def byte_bpe(vocabulary: str):
    """text -> uint32 ids, those of ``Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)``;
    read once per Python worker.

    ``tiktoken`` gives the same ids from the same merges (the ``.tiktoken`` file beside) at a third of the time,
    except where a text spells out a special token, which is one id, and where a run of blanks is too long
    for its pattern; such texts go through ``tokenizers`` itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(Path(vocabulary).with_suffix(".tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str | None) -> np.ndarray:
        text = text or ""
        if not any(s in text for s in special):
            try:
                return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:  # too long a run of blanks
                pass
        return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")

    return encode
