"""Token ids from public tokenizer files, encoded once per distinct unit of text.

A unit is a stretch of text that the tokenizer's own pre-tokenizer always separates from what surrounds it, so
encoding units one by one gives the ids of the whole text. Each Python worker keeps a bounded table of units.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space inside white space, or after it at the end: byte-level pre-tokenizers keep such a run together.
_RUN = re.compile(r"\s (?:\s|\Z)")
_ENCODERS: dict = {}
#: Units of these characters are cut here as the tokenizer's own pre-tokenizer cuts them; any other goes through the whole tokenizer.
_PLAIN = re.compile("[\\n -~\u00a1-\u024f]*").fullmatch
_LETTER, _NUMBER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_CUT_LEADING = re.compile(rf"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+").findall
_CUT_DROPPED = re.compile(rf"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+").findall


def _byte_symbols() -> dict[int, str]:
    """Byte-level BPE's printable symbol for each byte: itself where it prints, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


def _uncached_model(path: str):
    """The byte-level BPE model of a tokenizer file, without a cache of its own: the encoder keeps one."""
    import json

    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
    kept = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    return models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, **{k: spec[k] for k in kept if spec.get(k)})


class Encoder:
    """Encodes texts by units. ``spaces`` says how the tokenizer treats a space.

    ``"leading"``: byte-level, a single space begins the next unit; texts with longer runs are encoded whole.
    ``"dropped"``: white space only separates. Special tokens' strings inside a text are ordinary text.
    """

    def __init__(self, path: str, spaces: str, most_units: int = 500_000, longest_unit: int = 64):
        from tokenizers import Tokenizer

        if spaces not in ("leading", "dropped"):
            raise ValueError(f"spaces: {spaces}")
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_padding()
        self.model.no_truncation()
        self.leading = spaces == "leading"
        self.most, self.longest = most_units, longest_unit
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.words, self.symbols = _uncached_model(path), _byte_symbols()

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the tokenizer's model."""
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece.encode().decode("latin-1").translate(self.symbols)
            ids = array("I", [t.id for t in self.words.tokenize(symbols)]).tobytes()
            if len(self.pieces) < self.most and len(piece) <= self.longest:
                self.pieces[piece] = ids
        return ids

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Encodes units: plain ones by their pre-tokens, others through the whole tokenizer."""
        made, others, piece = {}, [], self._piece
        for unit in missing:
            if not _PLAIN(unit):
                others.append(unit)
            elif self.leading:
                made[unit] = b"".join([piece(p) for p in _CUT_LEADING(" " + unit)])
            else:
                made[unit] = b"".join([piece(p) for p in _CUT_DROPPED(unit.lower())])
        before = " " if self.leading else ""
        made.update(zip(others, self._raw([before + u for u in others]), strict=True))
        room = self.most - len(self.units)
        if room > 0:
            self.units.update([(u, i) for u, i in made.items() if len(u) <= self.longest][:room])
        return made

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        texts = [t or "" for t in texts]
        out: list[bytes] = [b""] * len(texts)
        whole, heads, open_ = [], [], []
        missing: set[str] = set()
        get = self.units.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.leading:
                parts = text.replace("\n", " ").split(" ")
            elif _RUN.search(text):
                whole.append(i)
                continue
            else:
                parts = text.split(" ")
                heads.append((i, parts[0]))
                parts = parts[1:]
            found = list(map(get, parts))
            if None in found:
                missing.update([p for p, x in zip(parts, found) if x is None])  # noqa: B905
                open_.append((i, parts, found))
            else:
                out[i] = b"".join(found)
        if missing:
            made = self._learn(missing)
            for i, parts, found in open_:
                out[i] = b"".join([made[p] if x is None else x for p, x in zip(parts, found)])  # noqa: B905
        firsts = list({h for _, h in heads})
        known = dict(zip(firsts, self._raw(firsts), strict=True)) if firsts else {}
        for i, head in heads:
            out[i] = known[head] + out[i]
        if whole:
            for i, ids in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
                out[i] = ids
        return out


def encoder(path: str, spaces: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its table of units lives as long as the worker."""
    key = (path, spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaces)
    return _ENCODERS[key]


def encode_batches(ids: list, texts: list[str | None], path: str, spaces: str, most_chars: int = 1 << 20):
    """(row key, id bytes) for each text, a bounded number of characters at a time."""
    tool, at = encoder(path, spaces), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most_chars):
            size += len(texts[end] or "")
            end += 1
        yield from zip(ids[at:end], tool.encode(texts[at:end]), strict=True)
        at = end
