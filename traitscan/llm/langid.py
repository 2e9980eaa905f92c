"""Operator 9: language identification with hyperdimensional profiles.

Each letter of any alphabet has a random vector of +1 and -1, drawn from a seed and
its code point. The vector of a letter trigram
binds (multiplies) the vectors of its letters, permuted by place; a text bundles
(adds) the vectors of its trigrams, a language those of its labelled texts. A
text gets the language whose prototype has the greatest cosine with it.
Whether a text is language at all is decided by its likeness before centring,
against that of labelled texts (keep_language).
Prototypes are centred on their common mean, so that what all languages share
does not decide.

Training passes over all labelled rows: each task adds up trigram counts for
each language and bundles them, Spark sums the bundles, so one vector per language
is left, whatever the corpus.

Cases: a null text, or one without a letter, is `und` with score 0; without any
labelled text everything is `und`; any lang value can be learned, the empty string
too; ties go to the first language in alphabetical order; very long texts are
bundled window by window; repeated rows are judged alike; extra columns travel
along, those named like a result (lang_pred, score, likeness, n_grams) are replaced
by it in identify and left as they are in keep_language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.llm.bpe import batches_of, forget
from traitscan.llm.common import shared_table, small_batches

DIM = 1024
#: A text is no language if its likeness is below both this part of the median of labelled texts of its language and length, and that median less so many median deviations; labelled texts that a bound needs.
LIKE_PART, LIKE_SPREADS, LIKE_TEXTS = 0.7, 6.0, 100
#: The columns that identify adds.
RESULTS = ["lang_pred", "score", "likeness", "n_grams"]
#: Trigrams whose vectors, or whose counts, a worker holds: 40 MB.
HELD = 40_000
_BITS = 21  # of a code point


def letter_table() -> np.ndarray:
    """The lower-case code point of each letter; 0 of all other characters."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The letters of a text, with runs of other characters as one 0."""
    if not _TABLE:
        _TABLE.append(letter_table())
    a = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
    return a[keep].astype(np.int64)


def grams(text: str) -> np.ndarray:
    """Trigram codes of a text; blanks stand at both ends."""
    a = np.concatenate([[0], letters(text), [0]])
    return (a[:-2] << 2 * _BITS) | (a[1:-1] << _BITS) | a[2:]


def counted(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigram codes and counts of a text, window by window; runs of no letter do not count."""
    for at in range(0, len(text), 1 << 20):
        codes, counts = np.unique(grams(text[at : at + (1 << 20)]), return_counts=True)
        counts[codes == 0] = 0
        yield codes, counts


class Profiles:
    """The random vectors of letters, and those of trigrams as they come up."""

    def __init__(self, dim: int = DIM, seed: int = 5):
        self.dim, self.seed = dim, seed
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.known = np.zeros((HELD, dim), np.int8)

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        some, at = np.unique(codes, return_inverse=True)
        for c in some.tolist():
            if c not in self.letter:
                rng = np.random.Generator(np.random.PCG64([self.seed, c]))
                self.letter[c] = rng.integers(0, 2, self.dim, dtype=np.int8) * np.int8(2) - np.int8(1)
        return np.stack([self.letter[c] for c in some.tolist()])[at]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        low = (1 << _BITS) - 1
        a, b, c = (self._letters(codes >> shift & low) for shift in (2 * _BITS, _BITS, 0))
        return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, times their counts."""
        if len(codes) > HELD // 4:
            return sum(counts[i : i + 4096].astype(np.float64) @ self.vectors(codes[i : i + 4096]) for i in range(0, len(codes), 4096))
        wanted = codes.tolist()
        new = [c for c in wanted if c not in self.row]
        if new:
            if len(self.row) + len(new) > HELD:
                self.row, new = {}, wanted
            at = len(self.row)
            self.known[at : at + len(new)] = self.vectors(np.array(new))
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return counts.astype(np.float32) @ self.known[list(map(self.row.__getitem__, wanted))].astype(np.float32)


@dataclass
class Prototypes:
    """The languages in order, their prototypes of unit length less the mean, and that mean."""

    langs: list[str]
    matrix: np.ndarray
    mean: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Prototypes:
    """The prototype of each language, of unit length, centred on their mean."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        profiles = Profiles()
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(lang: str) -> None:
            codes, at = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n for _, n in held[lang]]), len(codes)).astype(np.int64)
            if len(codes) > HELD:
                sums[lang] = sums.get(lang, np.zeros(DIM)) + profiles.bundle(codes, total)
                held[lang] = []
            else:
                held[lang] = [(codes, total)]

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = held.setdefault(lang, [])
                for codes, counts in counted(text):
                    parts.append((codes, counts))
                    if sum(len(c) for c, _ in parts[-64:]) > HELD or len(parts) > 256:
                        fold(lang)
                        parts = held[lang]
        for lang, parts in held.items():
            if parts:
                fold(lang)
            for codes, total in held[lang]:
                sums[lang] = sums.get(lang, np.zeros(DIM)) + profiles.bundle(codes, total)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total.astype(np.int64))], names=["lang", "i", "n"])

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums: dict[str, np.ndarray] = {}
    for r in labelled.mapInArrow(run, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).collect():  # DIM numbers for each language
        sums.setdefault(r.lang, np.zeros(DIM))[r.i] = r.n
    langs = sorted(k for k, v in sums.items() if np.any(v))
    matrix = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs]).reshape(-1, DIM)
    mean = matrix.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    matrix = matrix - mean
    return Prototypes(langs, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300), mean)


def letter_share(text: str) -> float:
    """Letters among the characters that are no white space or control character."""
    letters("")  # fills the table
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return float(np.count_nonzero(_TABLE[0][codes]) / max(1, np.count_nonzero(codes > 32)))


def identify(docs: DataFrame, prototypes: Prototypes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text if None), lang_pred, score, likeness and n_grams.

    score: (1 + cosine of the text's centred vector with the prototype) / 2; a
    text's centred vector is its unit vector minus the languages' mean. It says
    which language, not whether: with two languages or more it is never below
    0.5. likeness: the cosine of the text's vector with the prototype, both not
    centred, times the text's share of letters. n_grams: the text's trigrams.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS and (keep is not None or c != text_col)]
    langs, matrix, mean = prototypes.langs, prototypes.matrix, prototypes.mean
    along = matrix @ mean
    # a prototype before centring: mean + a * centred, of length 1
    whole = mean + (np.sqrt(np.maximum(along**2 + 1 - mean @ mean, 0)) - along)[:, None] * matrix
    names = [*keep, *RESULTS]
    source = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        profiles = Profiles()
        for b in batches:
            texts = b.column(source).to_pylist()
            for lo, hi in batches_of(texts):
                found, scores, likes, sizes = [], [], [], []
                for text in texts[lo:hi]:
                    total = np.zeros(DIM)
                    seen = 0
                    for codes, counts in counted(text or ""):
                        seen += int(counts.sum())
                        total += profiles.bundle(codes, counts)
                    sizes.append(seen)
                    if not seen or not langs:
                        found.append("und")
                        scores.append(0.0)
                        likes.append(0.0)
                        continue
                    norm = np.linalg.norm(total) or 1.0
                    v = total / norm - mean
                    cosine = matrix @ v / (np.linalg.norm(v) or 1)
                    best = int(np.argmax(cosine))
                    found.append(langs[best])
                    scores.append(float(np.clip((1 + cosine[best]) / 2, 0, 1)))
                    likes.append(float(whole[best] @ total / norm) * letter_share(text))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[: len(keep)]), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(likes, pa.float64()), pa.array(sizes, pa.int64())], names=names)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, likeness double, n_grams long"])
    more = [] if text_col in keep else [F.col(text_col).cast("string").alias("_text")]
    return docs.select(*keep, *more).mapInArrow(run, schema)


def likeness_bounds(judged: DataFrame, lang_col: str = "lang") -> dict[tuple[str, int], float]:
    """The least likeness of each (language, power of 2 of the trigrams), from labelled texts."""
    size = F.floor(F.log2("n_grams")).cast("int")
    held = judged.where((F.col("lang_pred") != "und") & (F.col(lang_col).cast("string") == F.col("lang_pred"))).select("lang_pred", size.alias("size"), "likeness")
    medians = held.groupBy("lang_pred", "size").agg(F.percentile_approx("likeness", 0.5, 1000).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LIKE_TEXTS)
    spreads = held.join(F.broadcast(medians), ["lang_pred", "size"]).groupBy("lang_pred", "size").agg(F.first("m").alias("m"), F.percentile_approx(F.abs(F.col("likeness") - F.col("m")), 0.5, 1000).alias("d"))
    return {(r.lang_pred, r["size"]): min(LIKE_PART * r.m, r.m - LIKE_SPREADS * r.d) for r in spreads.collect()}  # languages times powers of 2


def keep_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text is language, all columns as they were.

    Rejected: `und`, and texts less like their language than nearly all labelled
    texts of that length are: runs of few words, random letters, words among
    signs. Likeness grows with a text's length, so a text of a length that too
    few labelled texts have is held to the next shorter length, or stays. Without
    any labelled text nothing is known of language and all rows stay.
    """
    prototypes = train(docs, text_col, lang_col)
    if not prototypes.langs:
        return docs
    own = {c: f"_own_{c}" for c in RESULTS if c in docs.columns}
    named = docs.withColumnsRenamed(own)
    judged = shared_table(identify(named, prototypes, text_col, keep=named.columns), "judged")
    bounds = likeness_bounds(judged, lang_col)
    least = F.lit(-1.0)
    for (lang, size), bound in sorted(bounds.items()):  # a longer text's bound comes later and wins
        least = F.when((F.col("lang_pred") == lang) & (F.col("n_grams") >= 1 << size), bound).otherwise(least)
    return judged.where((F.col("lang_pred") != "und") & (F.col("likeness") >= least)).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))
