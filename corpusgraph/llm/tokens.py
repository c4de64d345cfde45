"""Token ids of texts by a byte-level BPE vocabulary file, as little-endian 32-bit numbers."""

from __future__ import annotations

import json
import re

import numpy as np

#: How the byte-level scheme cuts a text before it merges bytes (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space so long that the pattern's look-ahead would exhaust the stack (the characters are a fixed value).
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: Characters from which one piece of a pattern may be too long for the fast encoder.
_LONG = 100_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file (fixed value): visible ones for themselves, the rest from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _plain(stored: dict) -> bool:
    """Whether a file is of the one kind that the fast encoder is equal for: byte-level BPE with the pattern
    above, without a normaliser and with added tokens that are taken as they stand."""
    before, model = stored.get("pre_tokenizer") or {}, stored["model"]
    return (
        stored.get("normalizer") is None
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in stored["added_tokens"])
    )


class Encoder:
    """``encode(text)`` gives the ids as bytes; an added token's string in a text is that token's one id.

    The ids are those of ``tokenizers`` with the file at *path*.  For plain byte-level files, whose ids are their
    merges' order, the faster ``tiktoken`` makes them (a third of the CPU time), but for very long texts'
    runs of white space, which are cut out before; other files are left to ``tokenizers``.  The tests hold the two against each other.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.slow = self.bpe = None
        if not _plain(stored):
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            return
        import tiktoken

        letters = _byte_letters()
        special = {x["content"]: x["id"] for x in stored["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in stored["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.ids_of = special

    def encode(self, text: str) -> bytes:
        if self.slow is not None:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        elif len(text) < _LONG or not _LONG_SPACE.search(text):
            ids = self.bpe.encode(text, allowed_special="all")
        else:
            ids = []
            for i, part in enumerate(self.special.split(text) if self.special else [text]):
                ids += [self.ids_of[part]] if i % 2 else self._with_long_space(part)
        return np.array(ids, "<u4").tobytes()

    def _with_long_space(self, text: str) -> list[int]:
        """Ids of a text between added tokens.  A run of white space is one piece but for its last character,
        which goes with what follows, if something does."""
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.bpe.encode_ordinary(text[at : run.start()])
            ids += self.bpe._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.bpe.encode_ordinary(text[at:])
