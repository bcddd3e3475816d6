"""Token ids of whole texts by a ``tokenizers`` file.

For a byte-level file whose merges stand in the order of their ids, the ids
are the greedy merges by rank, and ``tiktoken`` computes those from the file's
own vocabulary several times as fast as ``tokenizers``. It takes the texts on
which both libraries' character classes agree whatever their Unicode version:
ASCII, Latin, Greek, Cyrillic, kana, Hangul and CJK letters and common
punctuation. Texts with any other character, with a special token's string,
and all texts of any other kind of file go to ``tokenizers``. Tests hold both
ways against each other over whole documents and random strings.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of one class in every Unicode version.
PLAIN = re.compile("[\x00-\x1b -~\xa0-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԓ‐-‧‰-›"
                   "€、-〃ぁ-ゔァ-ヺ一-龥가-힣]*")
GROUP = 64  # texts of one call to tokenizers


def version(path: str) -> str:
    """sha256 over the tokenizer file and the library's version: what counts depend on."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _byte_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(other)}


def _by_rank(spec: dict):
    """A tiktoken encoding of a byte-level file; None where its ids aren't ranks."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if (pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer")
            or spec.get("truncation") or spec.get("padding") or model.get("type") != "BPE" or model.get("ignore_merges")
            or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
        return None
    byte, special = _byte_of(), {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted(ranks.values()) != list(range(256 + len(merges))) or any(model["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)):
        return None
    import tiktoken

    return tiktoken.Encoding(spec.get("name", "file"), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids by one file, as the ``tokenizers`` library gives them without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.ranked = _by_rank(spec)

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """All ids of each text (null: none)."""
        for k in range(0, len(texts), GROUP):
            group = texts[k:k + GROUP]
            slow = [i for i, t in enumerate(group) if t and (self.ranked is None or not PLAIN.fullmatch(t)
                                                            or self.special and self.special.search(t))]
            found = dict(zip(slow, self.library.encode_batch_fast([group[i] for i in slow], add_special_tokens=False))) if slow else {}
            for i, t in enumerate(group):
                if not t:
                    yield np.zeros(0, np.uint32)
                else:
                    yield np.array(found[i].ids, np.uint32) if i in found else self.ranked.encode_to_numpy(t, disallowed_special=())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file (workers outlive tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
