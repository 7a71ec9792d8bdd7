"""Token counts of a public byte-level vocabulary; its file is a parameter and travels to the workers."""

from __future__ import annotations

import base64
import os
import re

from querent.plans.workers import once, shipped

#: Where the vocabulary lies unless the caller or QUERENT_VOCABULARY says otherwise.
VOCABULARY = os.environ.get("QUERENT_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Fixed value: the published pre-tokenization pattern of byte-level vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: the characters with Unicode's White_Space property, which is what the pattern takes for white space.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space from this length on are taken apart here.
LONG_BLANK = 50_000


def _load(path: str):
    import tiktoken

    with open(shipped(path), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once in each process."""
    return once(("encoder", path), lambda: _load(path))


def encode(text: str, path: str) -> list[int]:
    """The token ids of a text of any length; strings of special tokens are ordinary text, lone surrogates a question mark.

    The pattern takes a run of white space without its last character when more text follows. Very long
    runs, for which the tokenizer's own matching needs too much stack, are taken that way here.
    """
    enc = encoder(path)
    text = text.encode("utf-8", "replace").decode("utf-8")
    out, at = [], 0
    if len(text) > LONG_BLANK:
        for m in re.finditer(rf"{BLANK}{{{LONG_BLANK},}}", text):
            end = m.end() - (m.end() < len(text))
            out += enc.encode_ordinary(text[at : m.start()]) + enc._encode_single_piece(text[m.start() : end])
            at = end
    return out + enc.encode_ordinary(text[at:])
