"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a letter trigram is
the elementwise product (binding) of its letters' vectors, rotated by position
(permutation); a text's vector is the sum (bundle) of its trigrams' vectors, and
a language's prototype the sum over its training texts. A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, remainder, stored

#: Length of the vectors.
DIMENSION = 1024
#: Languages whose prototypes are shipped to every task at once; more are compared in turns of so many.
LANGUAGES_AT_ONCE = 4096
UNKNOWN = "und"
#: Characters and documents of one block of texts, and characters whose trigrams are counted at once.
BLOCK_CHARS, BLOCK_DOCS, PIECE_CHARS = 1 << 20, 256, 1 << 18
#: Alphabets beyond this count trigrams by sorting instead of in a dense table.
DENSE_ALPHABET = 128
#: Distinct trigrams whose vectors stand in memory at once, and numbers of a table of documents by trigrams.
SLICE_GRAMS, SLICE_CELLS = 4096, 1 << 22
#: Letters that an encoder remembers before it begins anew: their vectors depend on nothing but the letter.
MOST_LETTERS = 1 << 15


class Encoder:
    """Trigram counts and hypervectors of texts; letters are numbered as they appear."""

    def __init__(self, dimension: int = DIMENSION, seed: int = 20_011):
        self.dimension, self.seed = dimension, seed
        self.code = np.full(0x110000, -1, dtype=np.int32)
        self.letters: list[str] = []
        self.ids: dict[str, int] = {}
        # letter 0 is the gap between words
        self.last, self.middle, self.first = (np.zeros((64, dimension), dtype=np.int8) for _ in range(3))
        self._add("")

    def _add(self, letter: str) -> int:
        if letter not in self.ids:
            key = (self.seed << 32) + (ord(letter[0]) + 1 if letter else 0)
            bits = np.frombuffer(np.random.Philox(key=key).random_raw(self.dimension // 64 + 1).tobytes(), dtype=np.uint8)
            vector = (np.unpackbits(bits)[: self.dimension].astype(np.int8) << 1) - 1
            n = self.ids[letter] = len(self.letters)
            self.letters.append(letter)
            if n == len(self.last):
                # twice the room: adding a letter costs the same however many there are
                self.last, self.middle, self.first = (np.vstack([t, np.zeros_like(t)]) for t in (self.last, self.middle, self.first))
            self.last[n], self.middle[n], self.first[n] = vector, np.roll(vector, 1), np.roll(vector, 2)
        return self.ids[letter]

    def _codes(self, points: np.ndarray) -> np.ndarray:
        codes = self.code[points]
        if len(codes) and codes.min() < 0:
            for p in np.unique(points[codes < 0]):
                c = chr(p)
                self.code[p] = self._add(c.lower()[0]) if c.isalpha() else 0
            codes = self.code[points]
        return codes

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(trigrams' letter ids (3, U), text of each entry, trigram of each entry) over padded ``texts``."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        doc = np.repeat(np.arange(len(texts)), sizes)
        codes = self._codes(points)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
        codes, doc = codes[keep], doc[keep]
        inside = doc[2:] == doc[:-2]
        size = len(self.letters)
        key = ((codes[:-2].astype(np.int64) * size + codes[1:-1]) * size + codes[2:])[inside]
        doc = doc[2:][inside]
        if size <= DENSE_ALPHABET:
            found = np.flatnonzero(np.bincount(key, minlength=size**3))
            where = np.zeros(size**3, dtype=np.int64)
            where[found] = np.arange(len(found))
            column = where[key]
        else:
            found, column = np.unique(key, return_inverse=True)
        return np.stack([found // (size * size), found // size % size, found % size]), doc, column

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound hypervectors of trigrams, (U, dimension)."""
        return (self.first[grams[0]] * self.middle[grams[1]] * self.last[grams[2]]).astype(np.float32)

    def bundle(self, texts: list[str], groups: np.ndarray, n: int) -> np.ndarray:
        """Sum of the trigram vectors of each of ``n`` groups of texts, (n, dimension).

        Long texts are taken piece by piece, and trigrams in slices: what stands in
        memory is bounded, whatever the texts and their alphabet.
        """
        out = np.zeros((n, self.dimension), dtype=np.float32)
        for part, of in pieces(texts, groups):
            if len(self.letters) > MOST_LETTERS:
                self.__init__(self.dimension, self.seed)
            grams, doc, column = self.counts(part)
            doc = of[doc]
            # entries in order of trigram, so that a slice of trigrams is a run of them
            order = np.argsort(column, kind="stable") if grams.shape[1] > SLICE_GRAMS else slice(None)
            doc, column = doc[order], column[order]
            step = max(1, min(SLICE_GRAMS, SLICE_CELLS // max(1, n)))
            ends = np.searchsorted(column, np.arange(0, grams.shape[1] + step, step)) if isinstance(order, np.ndarray) else None
            for k in range(0, grams.shape[1], step):
                width = min(step, grams.shape[1] - k)
                if ends is None:
                    inside = (column >= k) & (column < k + width)
                    d, c = doc[inside], column[inside] - k
                else:
                    a, b = ends[k // step], ends[k // step + 1]
                    d, c = doc[a:b], column[a:b] - k
                table = np.bincount(d * width + c, minlength=n * width).reshape(n, width)
                out += table.astype(np.float32) @ self.vectors(grams[:, k : k + width])
        return out


def cut(text: str):
    """The text between two gaps, in pieces of about PIECE_CHARS characters.

    A piece starts with the last two letters of the one before (or a gap and a letter),
    so that every trigram is in one piece. What a run of other characters has beyond
    the first is a gap all the same, and goes.
    """
    text, at = f" {text} ", 0
    while len(text) - at > PIECE_CHARS:
        end = edge = at + PIECE_CHARS
        while end < len(text) and not text[end - 1].isalpha():
            end += 1
        if end == len(text):
            yield text[at:edge]
            return
        yield text[at:edge] if end == edge else text[at:edge] + text[end - 1]
        at = end - 2
    yield text[at:]


def pieces(texts: list[str], groups: np.ndarray):
    """Texts in lists of about PIECE_CHARS characters, padded, with the group of each."""
    part, of, size = [], [], 0
    for text, group in zip(texts, groups.tolist(), strict=True):
        for piece in cut(text):
            if part and size + len(piece) > PIECE_CHARS:
                yield part, np.array(of)
                part, of, size = [], [], 0
            part.append(piece)
            of.append(group)
            size += len(piece)
    if part:
        yield part, np.array(of)


def blocks(texts: list[str]):
    """Index ranges of at most BLOCK_DOCS texts and about BLOCK_CHARS characters."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and (k - start >= BLOCK_DOCS or size + len(t) > BLOCK_CHARS):
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Model:
    """Prototypes of languages as a stored table (lang, v), taken LANGUAGES_AT_ONCE at a time in order of name."""

    def __init__(self, table: DataFrame, dimension: int):
        self.table, self.dimension = table, dimension

    def parts(self):
        """(names, unit prototypes) of the next languages, until there are none; at least one part, if an empty one."""
        last, first = None, True
        while True:
            rest = self.table if last is None else self.table.where(F.col("lang") > last)
            found = sorted(rest.orderBy("lang").limit(LANGUAGES_AT_ONCE).collect(), key=lambda r: r["lang"].encode("utf-8", "surrogatepass"))
            if found or first:
                profiles = np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), self.dimension)
                norms = np.linalg.norm(profiles, axis=1, keepdims=True)
                yield [r["lang"] for r in found], (profiles / np.where(norms == 0, 1, norms)).astype(np.float32)
            if len(found) < LANGUAGES_AT_ONCE:
                return
            last, first = found[-1]["lang"], False


def learn(docs: DataFrame, text_col: str, lang_col: str, where: Column, dimension: int = DIMENSION) -> Model:
    """Prototypes of the languages of every labelled text that ``where`` admits.

    Tasks add up one partial prototype per language; Spark adds those up by
    (language, position), so no task sees more than its share. A task holds the
    prototypes of the languages of one batch of rows.
    """

    def make():
        encoder = Encoder(dimension)

        def work(batch: pa.RecordBatch) -> dict:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known = sorted(set(names))
            group = {n: k for k, n in enumerate(known)}
            total = np.zeros((len(known), dimension), dtype=np.float64)
            for a, b in blocks(texts):
                # the languages of the block alone
                mine, of = np.unique([group[n] for n in names[a:b]], return_inverse=True)
                total[mine] += encoder.bundle(texts[a:b], of, len(mine))
            return {"lang": known, "part": total.astype(np.int64).tolist()}

        return work

    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    parts = map_arrow(rows, "lang string, part array<long>", make)
    sums = parts.select("lang", F.posexplode("part").alias("pos", "n")).groupBy("lang", "pos").agg(F.sum("n").alias("n"))
    model = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("v")).select("lang", F.col("v.n").alias("v"))
    return Model(stored(model, "prototypes"), dimension)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine, cut to 0..1) in place of any columns so named.

    A text that is null or holds no letter is ``und`` with score 0, and so is every
    text under a model without languages. Ties go to the first language by code
    point. Map-only; whole texts, piece by piece; repeated rows give repeated rows.
    With more than LANGUAGES_AT_ONCE languages the rows are gone through once for each
    so many, and what was best so far goes with them.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    best_so_far = ("__lang", "__cosine")
    out, turn = docs.select(*kept), 0
    for names, profiles in model.parts():
        if turn:
            out = stored(out, "scored")
        out = _compared(out, names, profiles, kept, text_col, turn > 0, model.dimension)
        turn += 1
    sure = F.col("__lang").isNotNull()
    score = F.when(sure, F.least(F.greatest(F.col("__cosine"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return out.withColumns({"lang_pred": F.coalesce("__lang", F.lit(UNKNOWN)), "score": score}).drop(*best_so_far)


def _compared(rows: DataFrame, names: list[str], profiles: np.ndarray, kept: list[str], text_col: str, again: bool, dimension: int) -> DataFrame:
    """Rows with the best language (``__lang``, null for a text without letters) and its cosine, of these and of those before."""
    at = kept.index(text_col)

    def make():
        encoder = Encoder(dimension)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            langs, cosines = (batch.column(len(kept) + k).to_pylist() if again else [None] * len(texts) for k in range(2))
            for a, b in blocks(texts) if names else ():
                v = encoder.bundle(texts[a:b], np.arange(b - a), b - a)
                norm = np.linalg.norm(v, axis=1)
                cosine = (v @ profiles.T) / np.where(norm == 0, 1, norm)[:, None]
                best = cosine.argmax(axis=1)
                for k in range(b - a):
                    found = float(cosine[k, best[k]])
                    if (cosines[a + k] is None or found > cosines[a + k]) and any(map(str.isalpha, texts[a + k])):
                        langs[a + k], cosines[a + k] = names[best[k]], found
            return {**{c: batch.column(i) for i, c in enumerate(kept)}, "__lang": langs, "__cosine": cosines}

        return work

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return map_arrow(rows, f"{fields}, __lang string, __cosine double", make)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold and predict every row.

    The fold is crc32(id as text) mod ``modulus`` = ``held``. Rows with a null id
    are neither learned from nor held out. Returns (id, held_out, lang_pred,
    score), one row per input row; other columns are ignored.
    """
    fold = remainder(F.col(id_col), modulus)
    model = learn(docs, text_col, lang_col, F.coalesce(fold != held, F.lit(False)))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model).select(id_col, "held_out", "lang_pred", "score")
