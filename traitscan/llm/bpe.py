"""Operator 6: BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged, so it
marks a certain cut. Words are cut there, the fragments are encoded on their own
and the ids are concatenated; the result equals encoding the whole word.

Cases: a null or empty text has no ids and decodes to the empty string; the
strings of the special tokens are recognised in the raw text, as the library
does; texts of Latin letters are parted into words as Arrow columns and each distinct
word is looked up once a batch, texts with other characters are normalised by the
library and go chunk by chunk; very long texts are encoded window by window, cut at blanks, where no token
can reach across (a text without any blank is one window, so memory grows with its
longest run of that kind); repeated rows and extra columns are independent of each
other.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.llm.common import small_batches

#: Words whose ids a worker keeps, twice; some 130 MB in all.
CACHE_WORDS = 300_000
#: Characters that are encoded at once.
WINDOW_CHARS = 1 << 20
#: Characters from which on texts are parted into words in columns, not one by one.
BULK_CHARS = 1 << 14

# Characters up to U+017F that NFC leaves alone and that lower-case alike everywhere.
_UNSAFE = re.compile("[^\t-\r\x20-\x7e\xa0-įı-ſ]")
_LETTERS = "a-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SIMPLE = re.compile(f"[{_LETTERS}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
# The same for whole columns, in RE2's syntax: what is no run of letters gets blanks around it.
_UNSAFE_RE2 = "[^\t-\r\\x20-\x7e\xa0-įı-ſ]"
_SIGNS_RE2 = f"'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\t-\r ]+"


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        config = json.load(open(path, encoding="utf-8"))
        model = config["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        # no caches of their own: words that come here are new
        self.last = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=self.suffix or None, cache_capacity=0))
        self.inner = Tokenizer(models.BPE(vocab, merges, cache_capacity=0))
        self.last.pre_tokenizer = self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self.is_end = np.array([bool(self.suffix) and t.endswith(self.suffix.encode()) for t in self.tokens])
        self.lengths = np.array([len(t.decode()) for t in self.tokens], np.int64)  # in byte letters, without a suffix
        self.letter = byte_letters()
        # words can be encoded in columns if no byte is unknown and ends can be told
        self.columns = bool(self.suffix) and all(c in vocab and c + self.suffix in vocab for c in self.letter)
        self.codes = np.array([ord(c) for c in self.letter], "<u4")
        self.codes[32] = 32  # parts words, which hold no blank
        byte = {c: b for b, c in enumerate(self.letter)}
        joined = bytearray(1 << 16)
        for token in vocab:
            body = [byte[c] for c in token.removesuffix(self.suffix)]
            for x, y in zip(body, body[1:], strict=False):
                joined[x << 8 | y] = 1
        self.joined = bytes(joined)
        self.parted = np.frombuffer(self.joined, np.uint8) == 0
        self.byte = byte
        after = {chr(x): "".join(chr(y) for y in range(97, 123) if not joined[x << 8 | y]) for x in range(97, 123)}
        self.cut = re.compile("|".join(f"{x}[{ys}]" for x, ys in after.items() if ys) or "(?!)")  # for words of a to z
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}  # the cache before it was last full

    def fragments(self, word: bytes) -> list[bytes]:
        """Cut at the byte pairs that no token holds."""
        joined, out, at = self.joined, [], 0
        for i in range(1, len(word)):
            if not joined[word[i - 1] << 8 | word[i]]:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space."""
        if not _UNSAFE.search(chunk):
            return _PIECES.findall(chunk)
        return [bytes([self.byte[c] for c in x]).decode() for x, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    def _fragment_ids(self, tok, fragments: list[str]) -> list[bytes]:
        """Ids of fragments in byte letters; a blank parts them, so one call serves thousands."""
        out: list[bytes] = []
        for at in range(0, len(fragments), 4096):
            some = fragments[at : at + 4096]
            if tok is self.last and self.suffix:  # each fragment's last token carries the suffix
                found = np.array(tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = (np.flatnonzero(self.is_end[found]) + 1) * 4
            else:
                slow = tok.encode(" ".join(some), add_special_tokens=False)
                found = np.array(slow.ids, "<u4")
                ends = np.searchsorted(np.array(slow.word_ids, np.int64), np.arange(1, len(some) + 1)) * 4
            ids, ends = found.tobytes(), ends.tolist()
            out += [ids[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _learn(self, chunks: set[str]) -> None:
        cache, letter, cut = self.cache, self.letter, self.cut.search
        composite, words = [], set()
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha() or _SIMPLE.fullmatch(chunk):
                words.add(chunk)
            else:
                pieces = self._pieces(chunk)
                if len(pieces) > 1:
                    composite.append((chunk, pieces))
                words.update(p for p in pieces if p not in cache)
        whole, whole_text, parted = [], [], []
        for word in words:
            if word.isascii() and word.isalpha() and not cut(word):
                whole.append(word)
                whole_text.append(word)
                continue
            parts = self.fragments(word.encode())
            if len(parts) > 1:
                parted.append((word, parts))
            else:
                whole.append(word)
                whole_text.append("".join([letter[x] for x in parts[0]]))
        cache.update(zip(whole, self._fragment_ids(self.last, whole_text), strict=True))
        show = lambda b: "".join([letter[x] for x in b])
        heads = iter(self._fragment_ids(self.inner, [show(x) for _, parts in parted for x in parts[:-1]]))
        tails = self._fragment_ids(self.last, [show(parts[-1]) for _, parts in parted])
        for (word, parts), tail in zip(parted, tails, strict=True):
            cache[word] = b"".join([*[next(heads) for _ in parts[1:]], tail])
        get = cache.__getitem__
        for chunk, pieces in composite:
            cache[chunk] = b"".join(map(get, pieces))

    def _chunks(self, text: str) -> list[str]:
        if _UNSAFE.search(text):
            text = self.normalizer.normalize_str(text)
            return [x for x in text.split(" ") if x]
        return text.lower().split()

    def _windows(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > WINDOW_CHARS:
            cut = text.rfind(" ", at, at + WINDOW_CHARS)
            if cut <= at:
                cut = text.find(" ", at + WINDOW_CHARS)
                if cut < 0:
                    break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _parts(self, text: str | None) -> Iterator[str | bytes]:
        """Windows of a text between its special tokens, and the ids of these."""
        if not text:
            return
        parts = self.special_re.split(text) if self.special_re and any(s in text for s in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield np.array([self.special[part]], "<u4").tobytes()
            elif part:
                yield from self._windows(part)

    def _plan(self, text: str | None) -> Iterator[list[str] | bytes]:
        for part in self._parts(text):
            yield self._chunks(part) if isinstance(part, str) else part

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        """The joined ids of each list of chunks."""
        unknown = lambda: set().union(*(set(chunks).difference(self.cache) for chunks in lists))
        need = unknown()
        if len(self.cache) + len(need) > CACHE_WORDS:
            self.old, self.cache = self.cache, {"": b""}
            need = unknown()
        if need:
            self.cache.update((c, ids) for c in need if (ids := self.old.get(c)) is not None)
            self._learn(need.difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in lists]

    def _library_ids(self, tok, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids of a text of byte letters, in which blanks end fragments before `ends`."""
        cuts = [0, *ends[4095:-1:4096].tolist(), len(text)]
        ids = [tok.encode_batch_fast([text[x:y].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids for x, y in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate([np.array(x, "<u4") for x in ids])

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words, cut at the byte pairs that no token holds; in columns over all their bytes."""
        if not words:
            return []
        raw = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
        blank = raw == 32
        first = np.empty(len(raw), bool)  # of a fragment; the blank belongs to the fragment before it
        first[0] = True
        first[1:] = (self.parted[raw[:-1].astype(np.uint16) << 8 | raw[1:]] & ~blank[:-1] | blank[:-1]) & ~blank[1:]
        starts = np.flatnonzero(first)
        last = blank[np.append(starts[1:], len(raw)) - 1]
        in_last = np.repeat(last, np.diff(np.append(starts, len(raw))))
        ids = self._library_ids(self.last, self.codes[raw[in_last]], np.flatnonzero(blank[in_last]) + 1)
        is_end = self.is_end[ids]
        word = np.cumsum(is_end) - is_end
        if not last.all():
            inner = ~last
            size = np.diff(np.append(starts, len(raw)))[inner]
            ends = np.cumsum(size + 1)
            text = np.full(int(ends[-1]), 32, "<u4")
            text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = self.codes[raw[~in_last]]
            heads = self._library_ids(self.inner, text, ends)
            length = self.lengths[heads]
            fragment = np.searchsorted(np.cumsum(size), np.cumsum(length) - length, "right")
            both = np.concatenate([(np.cumsum(last) - last)[inner][fragment], word])
            order = np.argsort(both, kind="stable")  # a word's inner fragments come first
            ids, word = np.concatenate([heads, ids])[order], both[order]
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        data, at = ids.tobytes(), ends.tolist()
        return [data[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, from the cache or learned."""
        found = list(map(self.cache.get, words))
        need = [w for w, x in zip(words, found, strict=True) if x is None]
        if not need:
            return found
        if len(self.cache) + len(need) > CACHE_WORDS:
            self.old, self.cache = self.cache, {"": b""}
            need, found = words, [None] * len(words)
        kept = list(map(self.old.get, need))
        learned = iter(self._word_ids([w for w, x in zip(need, kept, strict=True) if x is None]))
        kept = [next(learned) if x is None else x for x in kept]
        self.cache.update(zip(need, kept, strict=True))
        rest = iter(kept)
        return [next(rest) if x is None else x for x in found]

    def _column_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: words of all texts as a column, each distinct word once."""
        column = pa.array(texts, pa.string())
        unsafe = np.flatnonzero(pc.match_substring_regex(column, _UNSAFE_RE2).to_numpy(zero_copy_only=False)).tolist()
        if unsafe:
            rest = set(range(len(texts))).difference(unsafe)
            out = dict(zip(unsafe, self._ids([self._chunks(texts[i]) for i in unsafe]), strict=True))
            out |= zip(sorted(rest), self._column_ids([texts[i] for i in sorted(rest)]) if rest else [], strict=True)
            return [out[i] for i in range(len(texts))]
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(column), _SIGNS_RE2, r" \0 "))
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[words.offsets.to_numpy()].tolist()
        data = ids.buffers()[2]
        return [data[x:y].to_pybytes() for x, y in zip(ends, ends[1:], strict=False)]

    def _encode_columns(self, texts: list[str | None]) -> list[bytes]:
        """As encode, some 2 * WINDOW_CHARS characters as one column."""
        plans: list[list[bytes]] = [[] for _ in texts]
        some: list[str] = []
        places: list[tuple[int, int]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for (i, k), ids in zip(places, self._column_ids(some), strict=True):
                plans[i][k] = ids
            some.clear()
            places.clear()
            held = 0

        for i, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, str) and len(part) > 64 * WINDOW_CHARS:  # one run without a blank, too long for Arrow's 32-bit offsets
                    part = self._ids([self._chunks(part)])[0]
                elif isinstance(part, str):
                    some.append(part.replace("\xa0", " "))
                    places.append((i, len(plans[i])))
                    held += len(part)
                    part = b""
                plans[i].append(part)
                if held >= 2 * WINDOW_CHARS:
                    flush()
        if some:
            flush()
        return [p[0] if len(p) == 1 else b"".join(p) for p in plans]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.columns and sum(len(t) for t in texts if t) >= BULK_CHARS:
            return self._encode_columns(texts)
        plans: list[list[bytes]] = [[] for _ in texts]
        lists, places = [], []
        for i, text in enumerate(texts):
            for part in self._plan(text):
                if isinstance(part, list):
                    if len(text) > WINDOW_CHARS:
                        part = self._ids([part])[0]
                    else:
                        lists.append(part)
                        places.append((i, len(plans[i])))
                        part = b""
                plans[i].append(part)
        for (i, k), ids in zip(places, self._ids(lists), strict=True):
            plans[i][k] = ids
        return [p[0] if len(p) == 1 else b"".join(p) for p in plans]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: the file names no decoder, so tokens are joined by blanks."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MADE: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The encoder of this worker process."""
    if path not in _MADE:
        _MADE[path] = WordBpe(path)
    return _MADE[path]


def forget() -> None:
    """Free the encoders that this worker process keeps, for operators that do not encode."""
    if _MADE:
        _MADE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
            ctypes.CDLL(None).malloc_trim(0)


def batches_of(texts: list[str | None], chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `chars` characters each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def merged(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts, the second column, hold `size` bytes: a word's look-up serves all of them."""
    some: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        some.append(batch)
        held += batch.column(1).nbytes
        if held >= size:
            yield pa.concat_batches(some)
            some, held = [], 0
    if some:
        yield pa.concat_batches(some)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "digest") -> DataFrame:
    """Encode and decode every whole text.

    keep="ids" returns (id, ids array<long>, decoded string); keep="digest" returns
    (id, n_tokens, ids_sha256, decoded_sha256) without moving the ids.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    digest = keep == "digest"
    schema = f"`{id_col}` {id_type}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                rows = []
                for ids in bpe.encode(texts[lo:hi]):
                    text = bpe.decode(ids)
                    if digest:
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
                    else:
                        rows.append((np.frombuffer(ids, "<u4").tolist(), text.decode()))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int64()), pa.string()]
                names = [id_col, *(["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
