"""Byte-level BPE over whole texts with memoised chunks.

A text is cut at the start of every run of white space. No pre-token of the vocabulary's pattern spans such a cut,
so chunks can be encoded on their own, and what repeats in a corpus (words with the space before them) is encoded
once per worker. The memo is bounded, in chunks and in the length of a chunk; it is emptied when full.
"""

from __future__ import annotations

import base64
import re
import struct

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters with the Unicode property White_Space, which is what ``\s`` means in the vocabulary's pattern.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
_CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_SPACE_BEFORE_BLANK = re.compile(f"[{SPACE}] ")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")


def chunks(text: str) -> list[str]:
    """The text cut before each run of white space; joined they give the text."""
    if not text:
        return []
    if _SPACE_BEFORE_BLANK.search(text):
        return _CHUNKS.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class ByteBpe:
    """Ids and counts as the ``tokenizers`` library gives them, without added tokens.

    Latin text is merged by ``tiktoken``, which holds the same ranks and is faster; any chunk with other characters,
    and any text with a special token's string, goes through ``tokenizers`` itself.
    """

    MEMO = 300_000
    #: Longer chunks are remembered for one text only, so the memo's bytes are bounded too.
    LONGEST = 64

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.library = Tokenizer.from_file(json_path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._bytes: dict[str, bytes] = {}

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def chunk_ids(self, chunk: str) -> list[int]:
        return self.library_ids(chunk) if _BEYOND_LATIN.search(chunk) else self.fast.encode_ordinary(chunk)

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def _chunk_bytes(self, chunk: str) -> bytes:
        ids = self.chunk_ids(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.has_special(text):
            ids = self.library_ids(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        parts, memo = chunks(text), self._bytes
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            pass
        if len(memo) >= self.MEMO:
            memo.clear()
        long = []
        for p in parts:
            if p not in memo:
                memo[p] = self._chunk_bytes(p)
                if len(p) > self.LONGEST:
                    long.append(p)
        out = b"".join(map(memo.__getitem__, parts))
        for p in long:
            del memo[p]
        return out


    def forget(self) -> None:
        """Empty the memo: called at the end of a task, so a worker that goes on to other work doesn't keep it."""
        self._bytes.clear()


_loaded: dict[tuple[str | None, str | None], ByteBpe] = {}


def worker_bpe(json_path: str | None = None, ranks_path: str | None = None) -> ByteBpe:
    """One tokenizer, with its memo, per Python worker."""
    key = (json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = ByteBpe(*key)
    return _loaded[key]
