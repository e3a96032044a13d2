"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An n-gram is
bound as the product of its letters' vectors, each rotated by its place; a text is the
bundle (sum) of its n-grams, a language the bundle of its training texts, each scaled
to the same length.  A text gets the language whose prototype has the greatest cosine
with it, after the bundle of all languages has been taken out of the prototypes, so
that what all languages share does not count.

Letters are lower-cased; a run of other characters is one blank, which has a vector
too, and a text has a blank at both ends, so that every text with a letter has an
n-gram.  Marks that combine with letters count as parts of words.  Bundles are integers
and are summed within partitions first, then by ``groupBy`` on language and component
block, so one language may hold most rows.  What is broadcast is one vector for each
language.  Training uses all rows that ``learn`` selects, whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so are
all texts if nothing was learned; rows of null language teach nothing; ties go to the
language that is smaller bytewise; copies are scored each; the vectors of a text of any
length are added in blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import runs

UNKNOWN = "und"
BLANK = 0x20
#: Characters in a block; bounds the memory that one text takes.
BLOCK = 1 << 19
#: Distinct n-grams whose vectors a worker keeps.
MOST_GRAMS = 1 << 15
#: Length of a training text's vector before it is rounded to integers.
UNIT = 1 << 12
#: A corpus that names more languages is refused: their prototypes would be too large to broadcast.
MOST_LANGUAGES = 10_000


@cache
def _alphabet() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a combining mark, 0 for others."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        kinds[c] = 2 if first == "L" else 1 if first == "M" else 0
    return kinds


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased words between single blanks; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _alphabet()[points]
    if not (kinds == 2).any():
        return np.zeros(0, np.uint32)
    points = np.concatenate([[BLANK], np.where(kinds > 0, points, BLANK), [BLANK]]).astype(np.uint32)
    return points[np.concatenate([[True], (points[1:] != BLANK) | (points[:-1] != BLANK)])]


class Space:
    """The vectors of letters and n-grams of ``size`` dimensions."""

    def __init__(self, size: int, order: int):
        self.size, self.order = size, order
        self._letters: dict[int, np.ndarray] = {}
        self._rows: dict[int, int] = {}
        self._grams = np.empty((MOST_GRAMS, size), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self._letters:
            self._letters[point] = np.random.default_rng(point).integers(0, 2, self.size, dtype=np.int8) * 2 - 1
        return self._letters[point]

    def gram(self, code: int) -> np.ndarray:
        """The letters of the n-gram, the first one rotated most, multiplied."""
        vector = np.ones(self.size, np.int8)
        for place in range(self.order):
            vector *= np.roll(self.letter(code >> (21 * place) & 0x1FFFFF), place)
        return vector

    def rows_of(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the table of n-gram vectors; the table is emptied when it is full."""
        known = self._rows
        new = [c for c in codes.tolist() if c not in known]
        if len(known) + len(new) > MOST_GRAMS:
            known.clear()
            new = codes.tolist()
        for c in new:
            self._grams[len(known)] = self.gram(c)
            known[c] = len(known)
        return np.fromiter(map(known.__getitem__, codes.tolist()), np.int64, len(codes))

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the vectors of all n-grams of the text; null for a text without a letter."""
        letters = letters_of(text) if text else np.zeros(0, np.uint32)
        if not len(letters):
            return None
        total = np.zeros(self.size, np.float64)
        for at in range(0, len(letters) - self.order + 1, BLOCK):
            total += self._bundle(letters[at : at + BLOCK + self.order - 1].astype(np.uint64))
        return total

    def _bundle(self, letters: np.ndarray) -> np.ndarray:
        n = len(letters) - self.order + 1
        codes = np.zeros(n, np.uint64)
        for place in range(self.order):
            codes = codes << np.uint64(21) | letters[place : place + n]
        grams, counts = np.unique(codes, return_counts=True)
        total = np.zeros(self.size, np.float64)
        for at in range(0, len(grams), MOST_GRAMS // 16):
            part = slice(at, at + MOST_GRAMS // 16)
            # float32 holds the sums exactly: a block has fewer than 2^24 n-grams.
            total += counts[part].astype(np.float32) @ self._grams[self.rows_of(grams[part])].astype(np.float32)
        return total


@dataclass(frozen=True)
class Profiles:
    """Learned languages in bytewise order and their prototypes of length 1."""

    languages: list[str]
    prototypes: np.ndarray
    order: int


def fit(docs: DataFrame, learn: Column, *, lang: str = "lang", text: str = "text", size: int = 1024, order: int = 3) -> Profiles:
    """Prototypes of the languages of the rows that ``learn`` selects."""
    if not 2 <= order <= 3:
        raise ValueError("n-grams of two or three letters")
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(size, order), {}
        for batch in runs(batches, "text", 1 << 24):
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                vector = space.bundle(body)
                if vector is None:
                    continue
                scaled = np.rint(vector * (UNIT / max(np.linalg.norm(vector), 1.0))).astype(np.int64)
                sums[name] = sums[name] + scaled if name in sums else scaled
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * size, "at": np.arange(size, dtype=np.int32), "value": vector})

    merged = rows.mapInArrow(partial, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    whole = merged.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select("lang", F.transform("v", lambda x: x["value"]).alias("v"))
    found = sorted(((r["lang"], r["v"]) for r in whole.limit(MOST_LANGUAGES + 1).collect()), key=lambda r: r[0].encode())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    units = _units(np.array([v for _, v in found], np.float64).reshape(len(found), size))
    if len(found) > 1:  # what all languages share tells none apart
        units = _units(units - units.mean(axis=0))
    return Profiles([name for name, _ in found], units, order)


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, profiles: Profiles, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (``doc_id``, ``lang_pred``, ``score``) for each row; the score is half of 1 plus the cosine."""
    names, prototypes = profiles.languages, profiles.prototypes
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(prototypes.shape[1], profiles.order)
        for batch in runs(batches, "text", 1 << 24):
            langs, scores = [], []
            for body in batch.column("text").to_pylist():
                vector = space.bundle(body) if names else None
                if vector is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ vector / max(np.linalg.norm(vector), 1e-12)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(max((1 + cosines[best]) / 2, 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predicted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
