"""Encoding by units: pieces of text that a tokenizer treats independently.

White space ends a pre-token in all tokenizers used here, so the ids of a text
are those of its units joined. A worker keeps the ids of the first units it
meets (these are mostly the frequent ones), or of the first it meets again, and
hands the others to the library.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence

import numpy as np

#: Units kept by a worker, and the longest that are kept: about 120 MB at most.
KEPT, LONGEST = 500_000, 48
#: Units kept by a worker that keeps those it meets again only (some 40 MB), and the bytes of bits that mark what it met.
KEPT_AGAIN, MARKS = 200_000, 1 << 20


class UnitEncoder:
    def __init__(self, encode: Callable[[list[str]], Iterable], kept: int = KEPT, known: dict | None = None, again: bool = False):
        """encode gives a value for each unit; known holds values from elsewhere. again: a unit is kept from its second meeting on."""
        self.encode, self.room, self.known = encode, kept, dict(known or {})
        self.marks = bytearray(MARKS) if again else None

    def values(self, units: Sequence[str]) -> list:
        got = list(map(self.known.get, units))
        if None in got:
            missing = list({u for u, g in zip(units, got) if g is None})
            new = dict(zip(missing, self.encode(missing)))
            got = [new[u] if g is None else g for u, g in zip(units, got)]
            if self.room > 0:
                keep = {u: v for u, v in new.items() if len(u) <= LONGEST and (self.marks is None or self.met(u))}
                self.known |= keep
                self.room -= len(keep)
        return got

    def met(self, unit: str) -> bool:
        """Whether a unit was met before (or, rarely, another with the same bit); it counts as met from now on."""
        at, bit = divmod(hash(unit) % (8 * MARKS), 8)
        before = self.marks[at] & 1 << bit
        self.marks[at] |= 1 << bit
        return bool(before)


_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once in a worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def id_bytes(path: str) -> Callable[[list[str]], list[bytes]]:
    """ids of each text as little-endian unsigned integers: 2 bytes each, or 4 where a vocabulary needs it."""
    tok, kind = tokenizer(path), id_type(path)
    return lambda texts: [np.array(e.ids, kind).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def rank_bytes(path: str) -> Callable[[list[str]], list[bytes]] | None:
    """As id_bytes, by a rank encoder over the same vocabulary file, several times faster for single units.

    None unless the file is a byte-level one whose ids follow the order of its
    merges, when both give the same ids; units that hold an added token's text
    go to the library.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ordered = [vocab.get("".join(m)) for m in merges] == list(range(len(vocab) - len(merges), len(vocab)))
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or not ordered:
        return None
    # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added, slow, kind = [t["content"] for t in spec["added_tokens"]], id_bytes(path), id_type(path)

    def encode(texts: list[str]) -> list[bytes]:
        return [slow([t])[0] if any(a in t for a in added) else np.array(fast.encode_ordinary(t), kind).tobytes() for t in texts]

    return encode


def id_type(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def unit_encoder(path: str) -> UnitEncoder:
    """One for a worker and tokenizer, so that its cache serves all the worker's tasks."""
    if (path, "units") not in _LOADED:
        _LOADED[path, "units"] = UnitEncoder(id_bytes(path), KEPT_AGAIN, again=True)
    return _LOADED[path, "units"]
