"""Edit-aware token counts.

Each document keeps a segment tree over its pre-token runs: a leaf holds the
characters and tokens of a stretch of about ``LEAF_CHARS`` characters, an inner
node the sums of its children. An edit descends the tree to the leaves it
touches, re-encodes those (with the neighbours whose border it may have moved)
and updates the sums above them; the rest of the text is neither read by the
tokenizer nor counted again.

Leaves are cut before a blank that follows a character which is no white space.
There the pre-token pattern always begins a new piece: no pattern runs on into
a blank, and none looks back. So a border depends on the two characters around
it alone, an edit disturbs only leaves within one character of it, and the sum
of the leaves' tokens is the count of the whole text.

Edits are (at, removed, inserted) in code points of the text as the document's
earlier edits left it, in the order of ``seq``; positions beyond the end are
taken as the end.

Defined cases: null and empty texts have one empty leaf and no tokens (an edit
may insert into them); a text without blanks is one leaf, whatever its length;
edits of unknown documents are ignored, documents without edits keep their
counts; null fields of an edit count as 0 and ''; rows equal in doc_id and text
share their tree and their edits; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import text_key

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 512

# Fixed value: the pre-token pattern of the rank file's vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BORDER = re.compile(r"(?<=\S) ")
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def counter(name: str, ranks: Callable[[], dict[bytes, int]]) -> Callable[[str], int]:
    """Tokens of a text; one tokenizer per worker process."""
    if name not in _ENCODINGS:
        _ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(), special_tokens={})
    encode = _ENCODINGS[name].encode_ordinary
    return lambda text: len(encode(text))


def cuts(text: str, lo: int = 0, hi: int | None = None) -> list[int]:
    """Leaf borders of text[lo:hi], first lo and last hi."""
    hi = len(text) if hi is None else hi
    out = [lo]
    while (m := _BORDER.search(text, out[-1] + LEAF_CHARS, hi)) is not None:
        out.append(m.start())
    return [*out, hi]


class SegmentTree:
    """Sums of (characters, tokens) over the leaves of one text."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.width = 1 << max(0, (self.leaves - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width:self.width + self.leaves] = np.stack([chars, tokens], 1)
        for k in range(self.width - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> SegmentTree:
        at = cuts(text)
        return cls([b - a for a, b in zip(at, at[1:])], [count(text[a:b]) for a, b in zip(at, at[1:])])

    @property
    def total(self) -> tuple[int, int]:
        return int(self.sums[1, 0]), int(self.sums[1, 1])

    def find(self, position: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds a position (the last one for the end)."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if position - start >= self.sums[k, 0] and start + self.sums[k, 0] < self.sums[1, 0]:
                start += int(self.sums[k, 0])
                k += 1
        return k - self.width, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.width
        change = np.array([chars, tokens]) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2

    def leaf_sums(self) -> np.ndarray:
        return self.sums[self.width:self.width + self.leaves]

    def edit(self, text: str, at: int, removed: int, inserted: str, count: Callable[[str], int]) -> tuple[str, int]:
        """Apply one edit; returns the new text and how many of its characters
        were encoded again."""
        at = min(max(at, 0), len(text))
        end = min(at + max(removed, 0), len(text))
        new = text[:at] + inserted + text[end:]
        first, lo = self.find(max(at - 1, 0))
        last, start = self.find(end)
        hi = start + int(self.sums[self.width + last, 0])
        # a border at the region's end stands on the two characters around it: it holds
        # unless the edit reaches it, and then the next leaf belongs to the region
        shift = len(new) - len(text)
        borders = cuts(new, lo, hi + shift)
        pieces = list(zip(borders, borders[1:]))
        slots = [k for k in range(first, last + 1)]
        if len(pieces) > 4 * len(slots):  # the region outgrew its leaves: a new tree around the counted ones
            kept = self.leaf_sums()
            fresh = np.array([(b - a, count(new[a:b])) for a, b in pieces])
            rows = np.concatenate([kept[:first], fresh, kept[last + 1:]])
            rows = rows[rows[:, 0] > 0] if (rows[:, 0] > 0).any() else rows[:1]
            self.__init__(rows[:, 0].tolist(), rows[:, 1].tolist())
        else:  # the region's pieces go to its leaves in order; leaves left over are empty
            share = -(-len(pieces) // len(slots))
            for n, k in enumerate(slots):
                part = pieces[n * share:(n + 1) * share]
                self.set(k, sum(b - a for a, b in part), sum(count(new[a:b]) for a, b in part))
        return new, hi + shift - lo


_TREE = "leaf_chars binary, leaf_tokens binary"


def build_trees(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """(doc_id, key, leaf_chars, leaf_tokens): the leaves of every document's tree
    as int32 arrays, without the text; key is the text's hash."""
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # the vocabulary's size

    @F.arrow_udf(_TREE)
    def leaves(texts: pa.Array) -> pa.Array:
        count = counter(path, lambda: sent.value)
        sums = [SegmentTree.of(t or "", count).leaf_sums().astype(np.int32) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([s[:, k].tobytes() for s in sums], pa.binary()) for k in (0, 1)], names=["leaf_chars", "leaf_tokens"])

    grown = docs.select("doc_id", text_key(F.col(text)).alias("key"), leaves(F.col(text)).alias("tree"))
    return grown.select("doc_id", "key", "tree.*")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """(doc_id, text, n_tokens_before, n_tokens, n_edits, n_encoded, leaf_chars,
    leaf_tokens): every document after its edits (doc_id, key, seq, at, removed,
    inserted), its counts, the characters encoded again, and its new leaves."""
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.arrow_udf(f"text string, n_tokens_before long, n_tokens long, n_encoded long, {_TREE}")
    def run(texts: pa.Array, chars: pa.Array, tokens: pa.Array, lists: pa.Array) -> pa.Array:
        count = counter(path, lambda: sent.value)
        rows = []
        for value, c, t, todo in zip(*(x.to_pylist() for x in (texts, chars, tokens, lists)), strict=True):
            value = value or ""
            tree = SegmentTree(np.frombuffer(c, np.int32).tolist(), np.frombuffer(t, np.int32).tolist())
            before, again = tree.total[1], 0
            for e in todo or []:
                value, n = tree.edit(value, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                again += n
            leaves = tree.leaf_sums().astype(np.int32)
            rows.append({"text": value, "n_tokens_before": before, "n_tokens": tree.total[1], "n_encoded": again,
                         "leaf_chars": leaves[:, 0].tobytes(), "leaf_tokens": leaves[:, 1].tobytes()})
        return pa.array(rows, pa.struct([("text", pa.string()), ("n_tokens_before", pa.int64()), ("n_tokens", pa.int64()),
                                         ("n_encoded", pa.int64()), ("leaf_chars", pa.binary()), ("leaf_tokens", pa.binary())]))

    # one document's edits depend on each other and are applied in one row
    listed = (edits.groupBy("doc_id", "key")
              .agg(F.sort_array(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("edits")))
    trees = trees.dropDuplicates(["doc_id", "key"])
    known = (trees.join(listed.select(F.col("doc_id").alias("e_id"), F.col("key").alias("e_key"), "edits"),
                        trees["doc_id"].eqNullSafe(F.col("e_id")) & (trees["key"] == F.col("e_key")), "left")
             .select(F.col("doc_id").alias("t_id"), F.col("key").alias("t_key"), "leaf_chars", "leaf_tokens", "edits"))
    rows = docs.select("doc_id", F.col(text).alias("old"), text_key(F.col(text)).alias("key"))
    both = rows.join(known, rows["doc_id"].eqNullSafe(F.col("t_id")) & (rows["key"] == F.col("t_key")))
    done = both.select("doc_id", F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"),
                       run("old", "leaf_chars", "leaf_tokens", "edits").alias("done"))
    return done.select("doc_id", "done.text", "done.n_tokens_before", "done.n_tokens", "n_edits", "done.n_encoded",
                       "done.leaf_chars", "done.leaf_tokens")


def revision_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """An edit log derived from the documents, three edits each: a replacement at
    a third of the text, an insertion of the document's own id near its middle,
    and a deletion near its end."""
    n = F.char_length(F.coalesce(F.col(text), F.lit("")))
    third = (n / 3).cast("int")

    def edit(seq: int, at: Column, removed: int, inserted: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), at.cast("int").alias("at"), F.lit(removed).alias("removed"),
                        inserted.alias("inserted"))

    edits = F.array(edit(1, third, 12, F.lit(" revised wording, 3rd draft")),
                    edit(2, n / 2, 0, F.concat(F.lit("["), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("]"))),
                    edit(3, n - 40, 25, F.lit("")))
    return (docs.select("doc_id", text_key(F.col(text)).alias("key"), edits.alias("edits")).distinct()
            .select("doc_id", "key", F.inline("edits")))
