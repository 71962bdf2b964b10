"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text becomes blank-marked words, which no piece crosses. The distinct new
words of an Arrow batch are grouped by length and advance together: for every
end position the hashes of all substrings that end there probe the sorted piece
keys, the best allowed candidate is the row maximum, and its start is the
backpointer. Words known from earlier batches come from a bounded cache.

What is maximised follows the model's own type, so that the ids are those of the
model's tokenizer:

* unigram: the sum of the piece scores.
* BPE: merging by rank is not the maximum of added scores. But the encoding of a
  prefix is the encoding of a shorter prefix plus one piece that stays apart from
  that prefix's last piece, and exactly one candidate has this property. So a
  candidate counts if its piece and the last piece before it do not merge
  across their border; pairs are judged once per worker.

Characters outside the vocabulary become byte pieces (or one unknown id where
the model has none). Decoding joins the pieces' bytes and restores blanks.

Defined cases: null and empty texts have no ids and decode to ''; texts are
encoded whole, whatever their length (a word longer than ``LONG_WORD`` is cut at
borders that no piece covers, which changes nothing); U+2581 is the blank mark
itself and decodes to a blank; rows are encoded one by one; empty tables give
empty results; other columns are not read. Models whose normaliser is not
``identity`` are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG_WORD = 96
#: Words that a worker remembers; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Judged pairs that a worker remembers (a power of two).
PAIRS = 1 << 20
_CELLS = 1 << 19  # substring probes of one numpy step

_BLANK = "▁"
_WORDS = re.compile(f"{_BLANK}*[^{_BLANK}]+|{_BLANK}+")
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_KEY_BITS = 1 << 20
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN_TYPE, _USER, _BYTE = 1, 2, 4, 6


def _fields(raw: bytes):
    """(number, value) of a protobuf message's fields; the public wire format."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = raw[i:i + size]
            i += size
        yield tag >> 3, value


@dataclass
class Pieces:
    """A model's pieces as arrays; small and bounded, sent to every task."""

    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    bpe: bool
    dummy_prefix: bool
    keys: np.ndarray = field(init=False)
    key_ids: np.ndarray = field(init=False)
    longest: int = field(init=False)
    byte_ids: dict[int, int] = field(init=False)
    unknown: int = field(init=False)

    def __post_init__(self):
        normal = np.flatnonzero((self.kinds == _NORMAL) | (self.kinds == _USER))
        hashes = np.array([_hash_text(self.texts[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], normal[order].astype(np.int64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("piece hashes collide")
        self.longest = max(len(self.texts[i]) for i in normal)
        self.byte_ids = {int(self.texts[i][3:5], 16): int(i) for i in np.flatnonzero(self.kinds == _BYTE)}
        self.unknown = int(np.flatnonzero(self.kinds == _UNKNOWN_TYPE)[0])
        if self.bpe:
            single = {t for t in self.texts if len(t) == 1}
            if any(set(self.texts[i]) - single for i in normal):
                raise ValueError("a piece holds a character that is no piece")
        if any(_BLANK in self.texts[i].lstrip(_BLANK) for i in normal):
            raise ValueError("a piece crosses a word border")


def load_model(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        raw = f.read()
    texts, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece[1].decode())
            scores.append(np.frombuffer(piece[2], "<f4")[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, _NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(1, b"identity") != b"identity" or normalizer.get(2) or normalizer.get(4, 1):
        raise ValueError("only models with the identity normaliser that keep all blanks are supported")
    kind = trainer.get(3, _UNIGRAM)
    if kind not in (_UNIGRAM, _BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Pieces(texts, np.array(scores, np.float64), np.array(kinds), kind == _BPE, bool(normalizer.get(3, 1)))


def _hash_points(points: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points: (rows, length + 1)."""
    h = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    codes = mix(points.astype(np.uint64) + np.uint64(1))
    for i in range(points.shape[1]):
        h[:, i + 1] = h[:, i] * _RADIX + codes[:, i]
    return h


def _points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _hash_text(text: str) -> int:
    return int(mix(_hash_points(_points([text]))[:, -1])[0])


class Encoder:
    """Encodes words with one model; holds the worker's caches."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cache: dict[str, bytes] = {}
        # judged pairs, direct-mapped: code and verdict by the code's hash; a pair that lost its place is judged again
        self.pair_codes = np.full(PAIRS, -1, np.int64)
        self.pair_apart = np.zeros(PAIRS, bool)
        self.histories: dict[int, tuple] = {}
        self.ranks = {t: pieces.scores[i] for i, t in enumerate(pieces.texts) if pieces.kinds[i] in (_NORMAL, _USER)}
        self.raw = [bytes([int(t[3:5], 16)]) if k == _BYTE else t.replace(_BLANK, " ").encode()
                    for t, k in zip(pieces.texts, pieces.kinds, strict=True)]
        low = pieces.scores[pieces.key_ids].min()
        self.unknown_score = low - 10.0
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(pieces.longest, _RADIX)]), dtype=np.uint64)
        # which low bits occur among the piece keys: most substrings are no piece and need no search
        self.some_key = np.zeros(_KEY_BITS, bool)
        self.some_key[(pieces.keys & np.uint64(_KEY_BITS - 1)).astype(np.int64)] = True
        if pieces.bpe:
            self.own = np.zeros(len(pieces.texts), bool)  # pieces that their own text merges to
            for i in pieces.key_ids.tolist():
                self.own[i] = self._history(i)[-1][1:] == (pieces.texts[i], pieces.texts[i])

    # how BPE builds one piece, and whether two neighbours stay apart

    def _history(self, piece: int) -> tuple[tuple[float, str, str], ...]:
        """The merges inside a piece in order: (score, then leftmost and
        rightmost symbol); the first entry is the state before any merge."""
        if piece not in self.histories:
            parts = list(self.pieces.texts[piece])
            steps = [(0.0, parts[0], parts[-1])]
            while True:
                joins = [(-self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
                if not joins:
                    break
                score, i = min(joins)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                steps.append((-score, parts[0], parts[-1]))
            self.histories[piece] = tuple(steps)
        return self.histories[piece]

    def _apart(self, left: int, right: int) -> bool:
        """Do two neighbouring pieces stay two, when both are built at once?"""
        a, b, i, j = self._history(left), self._history(right), 0, 0
        while True:
            across = self.ranks.get(a[i][2] + b[j][1], -np.inf)
            own_a = a[i + 1][0] if i + 1 < len(a) else -np.inf
            own_b = b[j + 1][0] if j + 1 < len(b) else -np.inf
            if across > own_a and across >= own_b:
                return False
            if own_a == -np.inf and own_b == -np.inf:
                return True
            if own_a >= own_b:  # of equal scores the leftmost merges first
                i += 1
            else:
                j += 1

    def _allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        codes = before * len(self.pieces.texts) + piece
        place = (mix(codes.view(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        apart = self.pair_apart[place]
        new = np.flatnonzero(self.pair_codes[place] != codes)
        if len(new):
            unknown, inverse = np.unique(codes[new], return_inverse=True)
            judged = np.array([self._apart(*divmod(c, len(self.pieces.texts))) for c in unknown.tolist()])
            apart[new] = judged[inverse.ravel()]
            self.pair_codes[place[new]] = codes[new]
            self.pair_apart[place[new]] = apart[new]
        return apart

    # the forward pass

    def _probe(self, h: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """Piece ids of the substrings from ``starts`` to ``end`` of each row (-1: none)."""
        keys = mix(h[:, end, None] - h[:, starts] * self.powers[end - starts])
        ids = np.full(keys.shape, -1, np.int64)
        maybe = np.nonzero(self.some_key[(keys & np.uint64(_KEY_BITS - 1)).astype(np.int64)])
        keys = keys[maybe]
        at = np.minimum(np.searchsorted(self.pieces.keys, keys), len(self.pieces.keys) - 1)
        ids[maybe] = np.where(self.pieces.keys[at] == keys, self.pieces.key_ids[at], -1)
        return ids

    def _best(self, points: np.ndarray) -> list[bytes]:
        """Ids of words of one length, given as rows of code points."""
        n, length = points.shape
        h = _hash_points(points)
        back = np.zeros((n, length + 1), np.int32)
        last = np.full((n, length + 1), -1, np.int64)
        score = np.zeros((n, length + 1), np.float64)
        rows = np.arange(n)
        for end in range(1, length + 1):
            low = max(0, end - self.pieces.longest)
            starts = np.arange(low, end)
            ids = self._probe(h, starts, end)
            if self.pieces.bpe:
                value = np.zeros(ids.shape, bool)
                r, c = np.nonzero((ids >= 0) & self.own[ids])
                piece, before = ids[r, c], last[r, c + low]
                ok = before < 0
                pair = np.flatnonzero(~ok)
                ok[pair] = self._allowed(before[pair], piece[pair])
                value[r[ok], c[ok]] = True
                value[ids[:, -1] < 0, -1] = True
            else:
                value = np.where(ids >= 0, score[:, low:end] + self.pieces.scores[ids], -np.inf)
                lone = ids[:, -1] < 0
                value[lone, -1] = score[lone, end - 1] + self.unknown_score
            best = np.argmax(value, axis=1)
            if not self.pieces.bpe:
                score[:, end] = value[rows, best]
            back[:, end] = best + low
            last[:, end] = ids[rows, best]
        none = np.iinfo(np.int64).min
        taken, at, live = np.full((n, length), none), np.full(n, length), rows
        for k in range(length - 1, -1, -1):
            here = at[live]
            got = last[live, here]
            lone = got < 0
            got[lone] = -1 - points[live[lone], here[lone] - 1].astype(np.int64)
            taken[live, k] = got
            at[live] = back[live, here]
            live = live[at[live] > 0]
            if not len(live):
                break
        full = taken != none
        flat, counts = taken[full], full.sum(axis=1)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        raw, cuts4 = flat.astype(np.int32).tobytes(), (4 * cuts).tolist()
        out = [raw[a:b] for a, b in zip(cuts4, cuts4[1:])]
        for i in np.flatnonzero((np.where(full, taken, 0) < 0).any(axis=1)):
            out[i] = self._spelled(flat[cuts[i]:cuts[i + 1]])
        return out

    def _cut(self, word: str) -> list[str]:
        """A long word at the borders that no piece covers."""
        points = _points([word])
        h = _hash_points(points)[0]
        edge = np.zeros(len(word) + 1, np.int64)
        for size in range(2, min(self.pieces.longest, len(word)) + 1):
            keys = mix(h[size:] - h[:-size] * self.powers[size])
            at = np.minimum(np.searchsorted(self.pieces.keys, keys), len(self.pieces.keys) - 1)
            hit = np.flatnonzero(self.pieces.keys[at] == keys)
            np.add.at(edge, hit + 1, 1)
            np.add.at(edge, hit + size, -1)
        free = np.flatnonzero(np.cumsum(edge)[1:-1] == 0) + 1
        cuts = [0, *free.tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _spelled(self, ids: np.ndarray) -> bytes:
        """Ids with unknown characters (-1 - code point) as bytes or unknown ids."""
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            elif self.pieces.byte_ids:
                out += [self.pieces.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.pieces.unknown:
                out.append(self.pieces.unknown)
        return np.array(out, np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode new words into the cache, those of one length together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) <= LONG_WORD:
                by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, _CELLS // (length * min(length, self.pieces.longest)))
            for i in range(0, len(group), step):
                part = group[i:i + step]
                self.cache.update(zip(part, self._best(_points(part)), strict=True))

    def _long(self, word: str) -> bytes:
        parts = self._cut(word)
        self.learn({p for p in parts if len(p) <= LONG_WORD} - self.cache.keys())
        return b"".join(self.cache[p] if len(p) <= LONG_WORD else self._best(_points([p]))[0] for p in parts)

    def _split(self, text: str) -> list[str]:
        """The text's words with their leading blank marks."""
        if not text:
            return []
        if self.pieces.dummy_prefix and text[0] != " " and "  " not in text and _BLANK not in text:
            return (_BLANK + text.replace(" ", " " + _BLANK)).split(" ")
        return _WORDS.findall((_BLANK if self.pieces.dummy_prefix else "") + text.replace(" ", _BLANK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self._split(t) for t in texts]
        new = set().union(*split) - self.cache.keys() if split else set()
        self.learn(new)
        long = {w: self._long(w) for w in new if len(w) > LONG_WORD}
        if long:
            return [b"".join([long[w] if w in long else self.cache[w] for w in words]) for words in split]
        find = self.cache.__getitem__
        return [b"".join(map(find, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, pieces: Callable[[], Pieces]) -> Encoder:
    """One encoder per worker process and model."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(pieces())
    return _ENCODERS[name]


def encoded(spark: SparkSession, path: str = MODEL) -> Callable[[Column | str], Column]:
    """Column function: text -> struct(ids, n_tokens, round_trip). The model is
    read once, on the driver, and broadcast (its size is the vocabulary's)."""
    sent = spark.sparkContext.broadcast(load_model(path))

    @F.arrow_udf("ids array<int>, n_tokens int, round_trip boolean")
    def run(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, lambda: sent.value)
        values = texts.fill_null("").to_pylist()
        raw = encoder.encode(values)
        same = [encoder.decode(r) == v for r, v in zip(raw, values, strict=True)]
        counts = np.array([len(r) // 4 for r in raw], np.int32)
        cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(raw), np.int32)))
        return pa.StructArray.from_arrays([ids, pa.array(counts), pa.array(same, pa.bool_())],
                                          names=["ids", "n_tokens", "round_trip"])

    return run


def decoded(spark: SparkSession, path: str = MODEL) -> Callable[[Column | str], Column]:
    """Column function: ids -> text."""
    sent = spark.sparkContext.broadcast(load_model(path))

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        encoder = _encoder(path, lambda: sent.value)
        return pa.array([encoder.decode(np.asarray(v or [], np.int32).tobytes()) for v in ids.to_pylist()], pa.string())

    return run


def tokenize(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (decoding gives the text back)."""
    coded = docs.select("doc_id", encoded(docs.sparkSession, path)(F.col(text)).alias("__coded"))
    return coded.select("doc_id", "__coded.*")
