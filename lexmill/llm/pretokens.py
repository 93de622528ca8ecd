"""Pre-tokens of byte-level BPE tokenizers, and a bounded memory of what each one encodes to.

The vocabulary file is that of the tokenizers library; texts are cut into pre-tokens here, so that each distinct
pre-token is encoded once per worker and block instead of once per occurrence. Where the file's merges stand in the order
of the ids they make, as in byte-level vocabularies, a pre-token is merged by rank, several times as fast with the same
ids; else, and for texts that can't be cut, the library itself encodes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable

import regex

#: The pre-token pattern that the byte-level vocabulary was made with, for any text,
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: and the same with its classes written out for characters up to U+024F, where they are a few ranges.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t\\n\\r \xa0"
LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND = re.compile("[^\\t\\n\\r -~\xa0-ɏ]")
#: Characters that regular expression engines class differently; texts with them go whole through the library.
DISPUTED = re.compile("[\x0b\x0c\x1c-\x1f\x85᠎​﻿\U00010000-\U0010ffff]")
ANY = regex.compile(GENERAL)


def _by_rank(model: dict) -> Callable[[bytes], list[int]] | None:
    """Byte-pair encoding of one pre-token by ranks, if this model is the same as one by ranks; else None."""
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    # the printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, other bytes from U+0100 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    if None in made or made != sorted(made) or len(set(made)) != len(made) or any(c not in model["vocab"] for c in byte_of):
        return None
    words = [*byte_of, *(a + b for a, b in merges)]
    ranks = {bytes(byte_of[c] for c in w): model["vocab"][w] for w in words}
    if max(model["vocab"][c] for c in byte_of) > min(made, default=1 << 60):
        return None
    import tiktoken

    coder = tiktoken.Encoding("pieces", pat_str=GENERAL, mergeable_ranks=ranks, special_tokens={})
    return coder._core_bpe.encode_single_piece


class Encoder:
    """One tokenizer file in one worker. whole: texts that must not be cut here go through the library as they are."""

    def __init__(self, path: str, keep: int = 250_000) -> None:
        self.path, self.keep = path, keep
        self.sentencepiece = path.endswith(".model")
        self.ids: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        if self.sentencepiece:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuts, self.merge, self.special, self.split = False, None, {}, None
            return
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        pre = form.get("pre_tokenizer") or {}
        plain = [a for a in form.get("added_tokens", []) if a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]]
        self.cuts = form.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not plain
        self.special = {a["content"]: int(a["id"]) for a in form.get("added_tokens", [])}
        self.merge = _by_rank(form["model"]) if self.cuts else None
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens in order, special strings among them; None if the text must go whole through the library."""
        if not self.cuts:
            return None
        if not BEYOND.search(text):
            find = LATIN.findall
        elif not DISPUTED.search(text):
            find = ANY.findall
        else:
            return None
        if self.split is None or not any(s in text for s in self.special):
            return find(text)
        return [p for i, part in enumerate(self.split.split(text)) for p in ([part] if i % 2 else find(part))]

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, num_threads=1) if self.sentencepiece else self.lib.encode(text, add_special_tokens=False).ids

    def _encode(self, pieces: Iterable[str]) -> list[tuple[str, list[int]]]:
        pieces = list(pieces)
        if not pieces:
            return []
        own = {p: [self.special[p]] for p in pieces if p in self.special}
        rest = [p for p in pieces if p not in own]
        if self.merge is not None:
            return [*own.items(), *((p, self.merge(p.encode("utf-8"))) for p in rest)]
        return [*own.items(), *((p, e.ids) for p, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True))]

    def learn_ids(self, pieces: set[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each piece at least; beyond `keep` pieces the memory starts anew."""
        if len(self.ids) + len(pieces) > self.keep:
            self.ids.clear()
        self.ids.update((p, array("I", i).tobytes()) for p, i in self._encode(pieces.difference(self.ids)))
        return self.ids

    def learn_sizes(self, pieces: set[str]) -> dict[str, int]:
        """Number of ids of each piece at least."""
        if len(self.sizes) + len(pieces) > self.keep:
            self.sizes.clear()
        self.sizes.update((p, len(i)) for p, i in self._encode(pieces.difference(self.sizes)))
        return self.sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
