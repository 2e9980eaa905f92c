"""Operator 3: token counts that follow edits.

A text is cut into leaves of whole pre-tokens; a segment tree holds characters and
tokens of each leaf. An edit descends to the leaves it touches, re-encodes only
those, with the neighbours that are not surely parted from what changed, and adds
the differences up to the root. Leaves end where a pre-token surely ends whatever
stands around: after white space, between an ASCII letter or digit and a sign, and
after an ASCII digit. So the count always equals that of encoding the edited text
afresh. A pre-token itself is never cut: a run of letters without any such place is
one leaf, however long.

Edits are an array column of (pos, n_del, ins), applied in order: at character
pos of the text as it then is, n_del characters go and ins comes. Cases: null
text counts as empty; pos beyond the end appends; n_del beyond the end deletes
to the end; null edits or null parts of an edit leave the text as it is or count
as 0 and empty; very long texts only cost their own leaves; repeated rows are
independent; extra columns travel along, those named like a result (n_tokens_before,
n_tokens_after, n_edits, n_chars_encoded) are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.llm.bpe import WordBpe, word_bpe
from traitscan.llm.common import small_batches

LEAF_CHARS = 256
_WHITE = "\t\n\x0b\x0c\r "
_SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
RESULTS = ["n_tokens_before", "n_tokens_after", "n_edits", "n_chars_encoded"]


class TokenTree:
    """Characters and tokens per leaf, with their sums in a binary tree."""

    def __init__(self, bpe: WordBpe, text: str):
        self.bpe = bpe
        self.encoded = 0  # characters encoded by edits
        special = set("".join(bpe.special))  # special tokens must not be cut
        signs = "".join(re.escape(c) for c in _SIGNS if c not in special)
        digits = "" if special & set("0123456789") else "|(?<=[0-9])(?=[A-Za-z0-9])"
        self.end = re.compile(f"[{_WHITE}]+|(?<=[A-Za-z0-9])(?=[{signs}]){digits}")
        self.leaves = self._cut(text)
        self._build([len(x) for x in self.leaves], self._count(self.leaves))

    def _count(self, leaves: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.bpe.encode(leaves)]

    def _cut(self, text: str) -> list[str]:
        """Leaves of about LEAF_CHARS that end where a pre-token ends."""
        out, at = [], 0
        while len(text) - at > LEAF_CHARS:
            found = self.end.search(text, at + LEAF_CHARS)
            end = found.end() if found else len(text)
            out.append(text[at:end])
            at = end
        if at < len(text) or not out:
            out.append(text[at:])
        return out

    def _parted(self, left: str, right: str) -> bool:
        """Whether no token can reach from left into right."""
        if not left or left[-1] in _WHITE:
            return bool(left)
        found = self.end.match(left[-1] + right[:1], 1)
        return bool(right) and found is not None

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.n = 1 << max(0, (len(chars) - 1).bit_length())
        pad = [0] * (self.n - len(chars))
        self.chars, self.tokens = [0] * self.n + chars + pad, [0] * self.n + tokens + pad
        for i in range(self.n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, pos: int) -> tuple[int, int]:
        """(leaf, characters before it); the last leaf for the end of the text."""
        if pos >= self.chars[1]:
            leaf = len(self.leaves) - 1
            return leaf, self.chars[1] - len(self.leaves[leaf])
        i, before = 1, 0
        while i < self.n:
            i *= 2
            if pos - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.n, before

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.n
        dc, dt = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i >>= 1

    def edit(self, pos: int, n_del: int, ins: str) -> None:
        size = self.chars[1]
        pos = min(max(pos, 0), size)
        end = min(pos + max(n_del, 0), size)
        lo, before = self.find(pos)
        hi, hi_before = self.find(end)
        text = "".join(self.leaves[lo:hi]) + self.leaves[hi]
        text = text[: pos - before] + ins + text[end - before :]
        # a neighbour joins in if it is not surely parted from what changed
        while lo and not self._parted(self.leaves[lo - 1], text):
            lo -= 1
            text = self.leaves[lo] + text
        while hi + 1 < len(self.leaves) and not self._parted(text, self.leaves[hi + 1]):
            hi += 1
            text += self.leaves[hi]
        self.encoded += len(text)
        if len(text) > 4 * LEAF_CHARS * (hi - lo + 1):  # a long insertion: new leaves
            new = self._cut(text)
            counts = self.tokens[self.n : self.n + len(self.leaves)]
            self.leaves[lo : hi + 1] = new
            counts[lo : hi + 1] = self._count(new)
            self._build([len(x) for x in self.leaves], counts)
            return
        self._put(lo, text, self._count([text])[0])
        for leaf in range(lo + 1, hi + 1):
            self._put(leaf, "", 0)

    @property
    def total(self) -> int:
        return self.tokens[1]


def edited_counts(docs: DataFrame, path: str, edits_col: str = "edits", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with n_tokens_before, n_tokens_after, n_edits and n_chars_encoded (by edits)."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, edits_col)] if keep is None else keep
    keep = [c for c in keep if c not in RESULTS]
    k = len(keep)
    names = [*keep, *RESULTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                tree = TokenTree(bpe, b.column(k)[i].as_py() or "")
                before, edits = tree.total, b.column(k + 1)[i].as_py() or []
                for e in edits:
                    if e:
                        tree.edit(e["pos"] or 0, e["n_del"] or 0, e["ins"] or "")
                rows.append((before, tree.total, len(edits), tree.encoded))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, pa.int64()) for c in cols)], names=names)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in names[k:])])
    edits = F.transform(edits_col, lambda e: F.struct(e["pos"].cast("long").alias("pos"), e["n_del"].cast("long").alias("n_del"), e["ins"].cast("string").alias("ins")))
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text"), edits.alias("_edits")).mapInArrow(run, schema)


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the column edits from a table (id, seq, pos, n_del, ins), in the order of seq."""
    lists = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "n_del", "ins"))).alias("edits"))
    return docs.join(lists, id_col, "left")


def hashed_edits(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """Three edits of every document, from its id: a replacement, an insertion and a deletion."""
    n = F.greatest(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1))
    place = lambda i: F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), n).cast("long")
    one = lambda i, gone, ins: F.struct(place(i).alias("pos"), F.lit(gone).cast("long").alias("n_del"), F.lit(ins).alias("ins"))
    return F.array(one(1, 12, "another word"), one(2, 0, " put in here, "), one(3, 40, ""))
