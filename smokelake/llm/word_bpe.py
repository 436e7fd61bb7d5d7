"""Byte-pair vocabularies with word ends: loading, pre-tokens, merging with a queue, strings that are one token.

The file format is the JSON of the tokenizers library. The text is put into NFC and lower case and split into
pre-tokens; each pre-token becomes byte symbols of which the last one carries the word-end suffix.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass, field
from sys import getsizeof

import regex

#: Pre-tokens of this vocabulary family, as its file states them (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points whose Unicode class no version has changed lately (Latin, Greek, Cyrillic, common punctuation). Texts with
#: others are split by the library's own normalizer and pre-tokenizer, whose Unicode tables may be older than Python's.
STABLE = r"[^\u0000-\u052F\u2010-\u2027\u2030-\u205E]"
#: Bytes that a task's memo of pre-tokens may hold before it is emptied.
MEMO = 32 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is visible in Latin-1, else the next free code point from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


@dataclass
class WordBpe:
    """A loaded vocabulary. It is small (its file is under 2 MB) and is shipped to the workers as a broadcast variable."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str
    source: str = field(repr=False)
    _state: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            source = f.read()
        spec = json.loads(source)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or split != PRE_TOKEN:
            raise ValueError(f"{path}: not a word-end BPE vocabulary of the supported kind")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(model["vocab"], [tuple(m) for m in model["merges"]], special, model["end_of_word_suffix"], source)

    def __getstate__(self):
        return self.__dict__ | {"_state": {}}

    def _derived(self) -> dict:
        if not self._state:
            # a pair of ids is one integer, and so is a queue entry (rank, position)
            ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(self.merges)}
            symbols = byte_symbols()
            names: list[str] = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
            for name, i in [*self.vocab.items(), *self.special.items()]:
                names[i] = name
            self._state |= {
                "ranks": ranks,
                "made": [self.vocab[a + b] for a, b in self.merges],
                "inner": [self.vocab[s] for s in symbols],
                "last": [self.vocab[s + self.suffix] for s in symbols],
                "names": names,
                "bytes": {s: b for b, s in enumerate(symbols)},
                "split": regex.compile(PRE_TOKEN).findall,
                "other": regex.compile(STABLE).search,
                "cut": regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None,
            }
        return self._state

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order. A special string inside the text comes back as itself; no other pre-token can equal one."""
        state = self._derived()
        if state["cut"] and any(s in text for s in self.special):
            parts = state["cut"](text)
        else:
            parts = [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part.isascii():
                out += state["split"](part.lower())
            elif state["other"](part):
                out += self._split_by_library(part)
            else:  # lower case is taken character by character, so a sigma has no final form
                out += state["split"](unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def _split_by_library(self, part: str) -> list[str]:
        state = self._derived()
        if "library" not in state:
            from tokenizers import Tokenizer

            state["library"] = Tokenizer.from_str(self.source)
        library, to_byte = state["library"], state["bytes"]
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
        return [bytes(to_byte[c] for c in token).decode("utf-8") for token, _ in found]

    def merge(self, pre_token: str) -> list[int]:
        """Ids of one pre-token.

        A heap holds the candidate merges by (rank, position); the symbols form a doubly linked list. An entry whose
        two symbols have changed since it was pushed is stale and is skipped.
        """
        if pre_token in self.special:
            return [self.special[pre_token]]
        state = self._derived()
        rank_of, made, data = state["ranks"].get, state["made"], pre_token.encode("utf-8")
        ids = list(map(state["inner"].__getitem__, data))
        ids[-1] = state["last"][data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        bits, mask = n.bit_length(), (1 << n.bit_length()) - 1
        heap = [r << bits | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & mask, entry >> bits
            j = after[i]
            if j == n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: a rank belongs to one pair, and that pair is no longer here
            ids[i] = new = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | ids[k])) is not None:
                    heapq.heappush(heap, r << bits | i)
            if (p := before[i]) >= 0 and (r := rank_of(ids[p] << 32 | new)) is not None:
                heapq.heappush(heap, r << bits | p)
        return [x for x in ids if x >= 0]

    def single_tokens(self) -> frozenset[str]:
        """Pre-tokens proven to encode alone as one token: each word-end string of the vocabulary is merged once and must give its own id."""
        to_byte = self._derived()["bytes"]
        proven = set()
        for name, i in self.vocab.items():
            if not name.endswith(self.suffix) or any(c not in to_byte for c in name[: -len(self.suffix)]):
                continue
            try:
                plain = bytes(to_byte[c] for c in name[: -len(self.suffix)]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if plain and self.merge(plain) == [i]:
                proven.add(plain)
        return frozenset(proven | set(self.special))

    def token_names(self) -> list[str]:
        """Vocabulary string of each id."""
        return self._derived()["names"]


class Memo(dict):
    """Values by pre-token, made when first asked for; emptied when it holds MEMO bytes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, key):
        value = self.make(key)
        size = getsizeof(key) + getsizeof(value) + 100  # and the entry itself
        if self.held + size > MEMO:
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value
