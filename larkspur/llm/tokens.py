"""The byte-level BPE of a tokenizers file, as a value that is sent to tasks.

A text is parted at the file's special tokens, the rest split into words by the
pattern of byte-level BPE, and words become ids: by ``merged``, the merges of the
file, or by the tokenizers library, whose model is asked for each different word
once, and again only if a process has forgotten it meanwhile.

Texts of ASCII and Latin letters are split with an equal pattern of the standard
library.  A text with characters that the standard library's Unicode tables
don't know yet, on whose class libraries may differ, goes to the library whole.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import cache, cached_property, lru_cache

import numpy as np
import regex

#: Latin letters, and the splitting pattern of byte-level BPE, over them and over all of Unicode.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACE = r"\t-\r "
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
FULL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
_OTHER = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ]")
_HELD = 200_000


@cache
def _unknown() -> regex.Pattern:
    """Characters that are letters or digits to one library and nothing to another, older one."""
    mark, runs = regex.compile(r"[\p{L}\p{N}]"), []
    for k in range(0x250, sys.maxunicode + 1):
        if unicodedata.category(c := chr(k)) == "Cn" and mark.match(c):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]") if runs else regex.compile("(?!)")


def byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level BPE files write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Known(dict):
    """What ``made`` gives for each word; of words not met since two lots of ``_HELD`` were full nothing is kept."""

    def __init__(self, made, older: dict | None = None):
        super().__init__()
        self.made, self.older = made, older or {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.made(word)
        self[word] = found
        return found


class Coder:
    """Made from the text of a tokenizers file; what it builds stays in the process."""

    def __init__(self, file_text: str):
        self.file_text = file_text

    @classmethod
    def load(cls, path: str) -> Coder:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def __getstate__(self) -> dict:
        return {"file_text": self.file_text}

    @cached_property
    def _file(self) -> dict:
        return json.loads(self.file_text)

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        letters = byte_letters()
        special = {t["id"]: t["content"].encode() for t in self._file["added_tokens"]}
        vocab = self._file["model"]["vocab"]
        out = [b""] * (max([*vocab.values(), *special]) + 1)
        for token, i in vocab.items():
            out[i] = bytes(letters[c] for c in token) if i not in special else b""
        for i, content in special.items():
            out[i] = content
        return out

    @cached_property
    def special(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self._file["added_tokens"]}

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.file_text)
        made.no_truncation()
        made.no_padding()
        return made

    @cached_property
    def _splits(self):
        special = f"({'|'.join(map(re.escape, self.special))})" if self.special else None
        return re.compile(SPLIT).findall, regex.compile(FULL).findall, special and re.compile(special)

    def parts(self, text: str) -> list[list[str] | int] | None:
        """Lists of words and ids of special tokens, in order; None if the library has to take the text whole."""
        quick, full, special = self._splits
        latin = text.isascii() or _OTHER.search(text) is None
        if not latin and _unknown().search(text):
            return None
        split = quick if latin else full
        if special is None or not special.search(text):
            return [split(text)]
        return [self.special[p] if p in self.special else split(p) for p in special.split(text)]

    @cached_property
    def _word_ids(self):
        """The uint32 ids of a word as bytes, by the library's model."""
        ask, letters = self._library.model.tokenize, {b: c for c, b in byte_letters().items()}
        blank, shown, packed = letters[32], str.maketrans({chr(b): c for b, c in letters.items()}), [k.to_bytes(4, sys.byteorder) for k in range(len(self.token_bytes))]

        def made(word: str) -> bytes:
            if word.isascii() and word.isprintable():  # its letters stand for themselves
                word = word.replace(" ", blank)
            else:
                word = word.encode().decode("latin-1").translate(shown)
            return b"".join([packed[t.id] for t in ask(word)])

        return made

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of whole texts by the tokenizers library."""
        known, out = self.__dict__.setdefault("_known", _Known(self._word_ids)), []
        for text in texts:
            x = self.parts(text)
            if x is None:
                out.append(np.array(self.library_ids(text), np.uint32))
                continue
            own = [p.to_bytes(4, sys.byteorder) if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in x]
            out.append(np.frombuffer(b"".join(own), np.uint32))
            if len(known) > _HELD:
                known = self._known = _Known(self._word_ids, known)
                known.older.older = {}
        return out

    def library_ids(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    @cached_property
    def _merges(self) -> tuple[dict[int, int], list[int | None], dict[str, int] | None]:
        """The pairs of ids that merge, each as one number, with rank and id of what they become; the id of each byte; words that are whole by the file."""
        model = self._file["model"]
        pairs, vocab = (m.split(" ") if isinstance(m, str) else m for m in model["merges"]), model["vocab"]
        bytes_of = sorted(byte_letters().items(), key=lambda x: x[1])
        return {vocab[a] << 32 | vocab[b]: k << 32 | vocab[a + b] for k, (a, b) in enumerate(pairs)}, [vocab.get(c) for c, _ in bytes_of], vocab if model.get("ignore_merges") else None

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one word: the pair of least rank is merged first, the leftmost of equals; n log n in a long word's bytes."""
        made, byte_ids, whole = self._merges
        if whole is not None:
            letters = {b: c for c, b in byte_letters().items()}
            if (word := "".join([letters[b] for b in piece])) in whole:
                return [whole[word]]
        parts = [byte_ids[b] for b in piece]
        if len(parts) <= 48:  # few pairs: looking through all of them costs less than a heap
            far, get = len(made) << 32, made.get
            order = [get(a << 32 | b, far) for a, b in zip(parts, parts[1:])]
            while order and (least := min(order)) < far:
                k = order.index(least)
                parts[k] = new = least & 0xFFFFFFFF
                del parts[k + 1], order[k]
                if k:
                    order[k - 1] = get(parts[k - 1] << 32 | new, far)
                if k < len(order):
                    order[k] = get(new << 32 | parts[k + 1], far)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        todo = [(made[p], k, p) for k, p in enumerate(a << 32 | b for a, b in zip(parts, parts[1:])) if p in made]
        heapq.heapify(todo)
        while todo:
            least, k, p = heapq.heappop(todo)
            j = after[k]
            if j >= n or parts[k] < 0 or parts[k] << 32 | parts[j] != p:
                continue
            parts[k], parts[j] = least & 0xFFFFFFFF, -1
            after[k] = after[j]
            before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (pair := parts[x] << 32 | parts[y]) in made:
                    heapq.heappush(todo, (made[pair], x, pair))
        return [p for p in parts if p >= 0]


    @cached_property
    def _sorted_merges(self) -> tuple[np.ndarray, np.ndarray]:
        made = self._merges[0]
        keys = np.fromiter(made, np.int64, len(made))
        order = np.argsort(keys)
        return keys[order], np.fromiter(made.values(), np.int64, len(made))[order]

    def merged_all(self, pieces: list[bytes], lot: int = 4096) -> list[list[int]]:
        """``merged`` of each of many words; short ones of like length go through the merges together, one merge of each at a time."""
        made, byte_ids, whole = self._merges
        if whole is not None or not made or None in byte_ids:
            return [self.merged(p) for p in pieces]
        out: list[list[int]] = [[]] * len(pieces)
        keys, becomes = self._sorted_merges
        ids_of, far = np.array(byte_ids, np.int64), len(made) << 32

        def looked_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pair = np.where(b < 0, -1, a << 32 | b)
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            return np.where(keys[at] == pair, becomes[at], far)

        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        while order and len(pieces[order[-1]]) > 48:
            k = order.pop()
            out[k] = self.merged(pieces[k])
        for first in range(0, len(order), lot):
            own = np.array(order[first : first + lot])
            sizes = np.array([len(pieces[k]) for k in own])
            wide = int(sizes[-1]) + 1
            parts = np.full((len(own), wide), -1, np.int64)
            parts[np.arange(wide) < sizes[:, None]] = ids_of[np.frombuffer(b"".join([pieces[k] for k in own]), np.uint8)]
            ranks = looked_up(parts[:, :-1], parts[:, 1:])
            while len(own):
                row, k = np.arange(len(own)), ranks.argmin(axis=1)
                least = ranks[row, k]
                going = least < far
                for i, ids in zip(own[~going].tolist(), parts[~going].tolist()):
                    out[i] = ids[: ids.index(-1)]
                if not going.all():
                    own, parts, ranks, k, least, row = own[going], parts[going], ranks[going], k[going], least[going], row[: going.sum()]
                if not len(own):
                    break
                at, new = np.arange(parts.shape[1] - 1), least & 0xFFFFFFFF
                parts = np.take_along_axis(parts, at + (at > k[:, None]), 1)
                parts[row, k] = new
                ranks = np.take_along_axis(ranks, at[:-1] + (at[:-1] >= k[:, None]), 1)
                ranks[row, k] = looked_up(new, parts[row, k + 1])
                left = row[k > 0]
                ranks[left, k[left] - 1] = looked_up(parts[left, k[left] - 1], new[left])
        return out


@lru_cache(maxsize=1)
def held_coder(file_text: str) -> Coder:
    """The coder of this process: tasks that follow each other use what the ones before have built and asked."""
    return Coder(file_text)
