"""The public byte-level BPE vocabulary: splitting, exact merging, and where its files are."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken

#: Folder of the public vocabulary files; a parameter of every operator that reads one.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tiktoken.Encoding:
    """Loaded once per worker process. It knows no special tokens, so that their spelling is ordinary text."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Texts of these characters only are split by the standard library's faster engine, by the same pattern with its classes written out.
_PLAIN = re.compile(r"[\t\n\r -~¥À-ÖØ-öø-ÿ‐-‧€₹₿]*").fullmatch
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def splitter() -> Callable[[str], list[str]]:
    """A function from a text to the pieces that are merged one by one."""
    plain, any_text = re.compile(_PLAIN_PATTERN).findall, regex.compile(PATTERN).findall

    def split(text: str) -> list[str]:
        return plain(text) if _PLAIN(text) else any_text(text)

    return split

