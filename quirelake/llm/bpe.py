"""Exact ids of a word-level BPE tokenizer, with the work done once per distinct pre-token.

Texts of Latin-1 characters are cut into pre-tokens by one regular expression,
which is the tokenizer's own split rule written out for that range; the ids of a
pre-token are kept, and those not seen before are merged together in numpy, all
words at once, one merge rank a round.  Any other text (other scripts, combining
marks, special-token strings) goes to the tokenizer whole.
"""

from __future__ import annotations

import functools
import gc
import json
import re

import numpy as np

LETTERS, DIGITS, BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{BLANKS}{DIGITS}{LETTERS}]+")
#: The rule and the normaliser for which SPLIT stands (fixed values of the vocabulary file).
RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
NEVER = np.int32(2**31 - 1)


class Merges:
    """The merges of a vocabulary as a hash table that numpy can look up."""

    BITS = 21

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        byte_chars = _byte_chars()
        self.first = np.array([vocab[c] for c in byte_chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_chars], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.keys = np.append(left << 32 | right, -1)
        self.slots = np.full(1 << self.BITS, len(merges), np.int32)
        for rank, slot in enumerate(self._slot(self.keys[:-1]).tolist()):
            while self.slots[slot] != len(merges):
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.slots[slot] = rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        rank = self.slots[slot]
        none = len(self.keys) - 1
        wrong = np.flatnonzero((rank != none) & (self.keys[rank] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.BITS) - 1)
            rank[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(rank[wrong] != none) & (self.keys[rank[wrong]] != keys[wrong])]
        rank[rank == none] = NEVER
        return rank

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids, stops = self.first[flat], np.cumsum(size) - 1
        ids[stops] = self.last[flat[stops]]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), NEVER, np.int32)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.ranks(ids[inside], ids[inside + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            at_word = np.repeat(least, lengths)
            over = at_word == NEVER
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, rank, at_word = ids[~over], word[~over], rank[~over], at_word[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == at_word)
            if len(hit) > 1:  # of overlapping equal pairs every second one, from the left
                new_run = np.append(True, np.diff(hit) != 1)
                in_run = np.arange(len(hit)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                hit = hit[in_run % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order].astype("<u4"), np.cumsum(np.bincount(word, minlength=len(words)))


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordIds:
    """Ids of texts as little-endian uint32 bytes.  ``most`` bounds the cache."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, rules = said["model"], said["pre_tokenizer"].get("pretokenizers", [{}])
        self.quick = (
            model["type"] == "BPE" and model["end_of_word_suffix"] is not None and rules[0].get("pattern", {}).get("Regex") == RULE
            and [x["type"] for x in said["normalizer"].get("normalizers", [])] == NORMAL
        )
        self.special = re.compile("|".join(re.escape(x["content"]) for x in said["added_tokens"]) or "$.")
        if self.quick:
            pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids, stops = self.merges.encode([w.encode() for w in some])
            raw, stops = ids.tobytes(), (stops * 4).tolist()
            self.words.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # many short-lived lists, no cycles
        try:
            out, waiting, new = [b""] * len(texts), [], set()
            get = self.words.__getitem__
            for i, text in enumerate(texts):
                words = self._split(text)
                if words is None:
                    out[i] = self._whole(text)
                    continue
                try:
                    out[i] = b"".join(map(get, words))
                except KeyError:
                    waiting.append((i, words))
                    new.update(words)
            if waiting:
                new -= self.words.keys()
                if len(self.words) + len(new) > self.most:
                    self.words.clear()
                    new = set().union(*(words for _, words in waiting))
                self._learn(sorted(new))
                for i, words in waiting:
                    out[i] = b"".join(map(get, words))
            return out
        finally:
            gc.enable()

    def _split(self, text: str) -> list[str] | None:
        """Pre-tokens, or None if the tokenizer has to see the text whole."""
        if not self.quick or self.special.search(text):
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return SPLIT.findall(text.lower())


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per worker process, kept from task to task."""
    return WordIds(path)
