"""SentencePiece encoding and decoding: batched Viterbi in numpy.

Words of equal length advance together. For every end position, hashes of the substrings that end there probe the
sorted keys of the vocabulary, and the best way to reach the position leaves a backpointer.

Models of both kinds are read. In a unigram model the best way has the greatest sum of piece scores. In a BPE model a
sum of scores would not give the model's own ids, so a way counts only if the merge order would leave the boundary
before its last piece in place; exactly one way remains, and it is the one that merging gives. Characters without a
piece become byte pieces, as the model says.

Null texts give null, empty texts no ids. Nothing is cut: long words without a space take the plain merge loop (or, in
a unigram model, the same recurrence alone). U+2581 is the model's sign for a space and decodes to one.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .common import table

SPACE = "▁"
#: Words longer than this are encoded one at a time.
LONG = 48
#: Words kept encoded by one worker before its store is emptied.
STORE = 1_000_000
#: Slots that remember whether two pieces fit, a power of two.
SLOTS = 1 << 21
BASE = np.uint64(0x100000001B3 * 2 + 1)


@dataclass
class Pieces:
    """A vocabulary: texts, scores and the byte pieces by value. kind: 'bpe' or 'unigram'."""

    texts: list[str]
    scores: list[float]
    usable: list[bool]
    bytes_: list[int]
    kind: str
    unknown: int = 0
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {t: i for i, t in enumerate(self.texts) if self.usable[i]}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the usable pieces, with their ids."""
        ids = np.fromiter(self.ids.values(), np.int64, len(self.ids))
        hashes = np.array([_hash(t) for t in self.ids], dtype=np.uint64)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        return hashes[order], ids[order]

    @cached_property
    def ranks(self) -> np.ndarray:
        """Place in the merge order; equal scores share one."""
        distinct = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True), 1)}
        out = np.zeros(len(self.texts), np.int64)
        for i in self.ids.values():
            out[i] = distinct[self.scores[i]] if len(self.texts[i]) > 1 else 0
        return out

    @cached_property
    def splits(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each piece the two pieces whose merge makes it (-1: a character), and the pieces that merging never
        makes, or makes out of order."""
        left, right, odd = np.full(len(self.texts), -1), np.full(len(self.texts), -1), []
        for t, i in self.ids.items():
            if len(t) > 1:
                parts = self.merged(t, last=True)
                if len(parts) != 2 or any(p not in self.ids or self.ranks[self.ids[p]] >= self.ranks[i] for p in parts):
                    odd.append(t)
                if len(parts) == 2:
                    left[i], right[i] = self.ids.get(parts[0], -1), self.ids.get(parts[1], -1)
        return left, right, odd

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the pairs that merge, with the rank of what they make."""
        left, right, _ = self.splits
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at] * len(self.texts) + right[at]
        order = np.argsort(key)
        return key[order], self.ranks[at][order]

    def merged(self, word: str, last: bool = False) -> list[str]:
        """Plain merging: the best-placed pair first, the left one of equals. last: stop before one piece remains."""
        part = list(word)
        n = len(part)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(i):
            j = nxt[i]
            if j < n and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, part[i] + part[j]))

        for i in range(n - 1):
            offer(i)
        left = n
        while heap:
            _, i, j, text = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and nxt[i] == j and part[i] + part[j] == text):
                continue
            if last and left == 2:
                break
            part[i], alive[j], nxt[i] = text, False, nxt[j]
            left -= 1
            if nxt[i] < n:
                prv[nxt[i]] = i
                offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p, a in zip(part, alive) if a]

    def spelled(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes_[b] for b in piece.encode()] if self.bytes_ else [self.unknown]

    def plain(self, word: str) -> list[int]:
        """One word alone."""
        if self.kind == "bpe":
            return [i for p in self.merged(word) for i in self.spelled(p)]
        best, back = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
        least = min(self.scores) - 10
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - self.longest), i):
                k = self.ids.get(word[j:i])
                s = self.scores[k] if k is not None else least if i - j == 1 else None
                if s is not None and best[j] + s > best[i]:
                    best[i], back[i] = best[j] + s, j
        out, i = [], len(word)
        while i:
            out.append(word[back[i]:i])
            i = back[i]
        return [k for p in reversed(out) for k in self.spelled(p)]

    @cached_property
    def met(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits, remembering pairs it has met."""
        keys, known = self.met
        key = (a + 2) * (len(self.texts) + 2) + b + 2
        slot = ((key.astype(np.uint64) * BASE * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        out = known[slot]
        new = np.flatnonzero(keys[slot] != key)
        if len(new):
            some, first = np.unique(key[new], return_index=True)
            at = new[first]
            fit = self.fits(a[at], b[at])
            out[new] = fit[np.searchsorted(some, key[new])]
            keys[slot[at]], known[slot[at]] = some, fit
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between the pieces a and b in place (-2: a character without a piece).

        The two pieces are taken apart again, the later merge first; the boundary goes if, before such a merge, the
        pieces beside it would have merged with each other earlier in the order.
        """
        left, right, _ = self.splits
        keys, made = self.pairs
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[at].copy(), b[at].copy()
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = x * len(self.texts) + y
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            gone = (keys[k] == key) & (made[k] < limit) if len(keys) else np.zeros(len(at), bool)
            ok[at[gone]] = False
            undo_x = self.ranks[x] > self.ranks[y]
            limit = np.where(undo_x, self.ranks[x], self.ranks[y] + 1)
            going = ~gone & (np.where(undo_x, right[x], left[y]) >= 0)
            x, y = np.where(undo_x, right[x], x)[going], np.where(undo_x, y, left[y])[going]
            at, limit = at[going], limit[going]
        return ok

    def batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; words of one length at once."""
        odd = re.compile("|".join(map(re.escape, self.splits[2]))) if self.kind == "bpe" and self.splits[2] else None
        groups: dict[int, list[int]] = {}
        alone = []
        for k, w in enumerate(words):
            if not w or len(w) > LONG or odd and SPACE * 2 in w and odd.search(w):
                alone.append(k)
            else:
                groups.setdefault(len(w), []).append(k)
        order, counts, flats = [], [], []
        for length, at in groups.items():
            for k in range(0, len(at), 8192):
                some = np.array(at[k:k + 8192])
                flat, count, left = self._advance([words[i] for i in some], length)
                alone += some[left].tolist()
                order.append(np.delete(some, left))
                counts.append(count)
                flats.append(flat)
        for k in alone:
            ids = self.plain(words[k])
            order.append(np.array([k]))
            counts.append(np.array([len(ids)]))
            flats.append(np.array(ids, np.int32))
        if not order:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, counts, flat = np.concatenate(order), np.concatenate(counts), np.concatenate(flats)
        starts = np.cumsum(counts) - counts
        back = np.argsort(order)
        return gathered(flat, starts[back], counts[back]).astype(np.int32), counts[back]

    def _advance(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of one length: their ids in a row, how many each has, and the places of words left out because they
        hold a character without a piece."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.ascontiguousarray(chars.reshape(len(words), length).T).astype(np.uint64) + np.uint64(1)
        n = len(words)
        hashes, ids = self.keys
        bpe = self.kind == "bpe"
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -2)
        back = np.zeros((length + 1, n), np.int64)
        for i in range(1, length + 1):
            key, weight = np.zeros(n, np.uint64), np.uint64(1)
            for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
                key += chars[j] * weight
                weight = np.uint64(int(weight) * int(BASE) % 2**64)
                at = np.flatnonzero((best[j] > -np.inf) & (best[i] == -np.inf) if bpe else best[j] > -np.inf)
                k = np.minimum(np.searchsorted(hashes, key[at]), len(hashes) - 1)
                found = hashes[k] == key[at]
                at, piece = at[found], ids[k[found]]
                if bpe:
                    fit = self.fitting(last[j][at], piece)
                    at, piece = at[fit], piece[fit]
                    best[i][at] = 0
                else:
                    total = best[j][at] + self.score_array[piece]
                    better = total > best[i][at]
                    at, piece = at[better], piece[better]
                    best[i][at] = total[better]
                last[i][at], back[i][at] = piece, j
        left = np.flatnonzero(best[length] == -np.inf)
        rows = np.delete(np.arange(n), left)
        at, steps = np.full(len(rows), length), []
        while at.any():
            going = at > 0
            steps.append(np.where(going, last[at, rows], -1))
            at = np.where(going, back[at, rows], 0)
        grid = np.array(steps[::-1]).T.reshape(len(rows), len(steps))
        return grid[grid >= 0].astype(np.int32), (grid >= 0).sum(axis=1), left

    @cached_property
    def score_array(self) -> np.ndarray:
        return np.array(self.scores)

    @cached_property
    def encoder(self) -> Encoder:
        """One for each Python worker: later tasks find the words that earlier ones met."""
        return Encoder(self)

    @cached_property
    def spoken(self) -> list[bytes]:
        """What each id stands for."""
        out = [t.replace(SPACE, " ").encode() if self.usable[i] else b"" for i, t in enumerate(self.texts)]
        for b, i in enumerate(self.bytes_):
            out[i] = bytes([b])
        return out


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def _hash(text: str) -> int:
    """Of the characters from the right, as the recurrence meets them."""
    key, weight = 0, 1
    for c in reversed(text):
        key = (key + (ord(c) + 1) * weight) % 2**64
        weight = weight * int(BASE) % 2**64
    return key


def load(path: str) -> Pieces:
    """The vocabulary of a model file. Models that rewrite characters are refused: their texts would not come back."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    texts = [p.id_to_piece(i) for i in range(n)]
    usable = [not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in range(n)]
    bytes_ = {int(texts[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
    if p.decode(p.encode("ﬁ Ａ  b ")) != "ﬁ Ａ  b ":
        raise ValueError("the model rewrites characters or spaces")
    scores = [p.get_score(i) for i in range(n)]
    kind = "bpe" if all(s == int(s) for s in scores) else "unigram"
    return Pieces(texts, scores, usable, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], kind, p.unk_id())


#: A word begins with the spaces before it.
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class _Numbers(dict):
    """Numbers words as they come."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts, keeping words it has met: a word's ids lie at starts[n] in flat."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._empty()

    def _empty(self):
        self.numbers, self.flat, self.starts = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _number(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            words = CHUNK.findall(SPACE + text.replace(" ", SPACE))
        else:
            words = (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.numbers) > STORE:
            self._empty()
        parts = [self._number(t) for t in texts]
        if new := self.numbers.new:
            ids, lengths = self.pieces.batch(new)
            self.flat = np.concatenate([self.flat, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.numbers.new = []
        words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        lengths = self.starts[words + 1] - self.starts[words]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = gathered(self.flat, self.starts[words], lengths)
        offsets = ends[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]
        mask = pa.array([t is None for t in texts], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=mask)


def decoded(pieces: Pieces, ids) -> str | None:
    if ids is None:
        return None
    spoken = pieces.spoken
    out = b"".join([spoken[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def _slices(batch: pa.RecordBatch, column: str, most: int = 1 << 23):
    """Runs of rows whose texts make up a few MB."""
    sizes = np.cumsum([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()])
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode(df: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """df with the ids of its texts; check: also whether decoding them gives the text again (true for null).

    A column of that name is replaced. Rows keep their order and number.
    """
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

    keep = [c for c in df.columns if c not in (ids, check)]
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    schema = StructType([df.schema[c] for c in keep]).add(ids, ArrayType(IntegerType()))
    if check:
        schema = schema.add(check, BooleanType())

    def run(batches):
        p = shared.value
        for batch in batches:
            for part in _slices(batch, text):
                texts = part.column(text).to_pylist()
                out = p.encoder.encode(texts)
                columns = [part.column(c) for c in keep] + [out]
                names = [*keep, ids]
                if check:
                    flat, ends = out.values.to_numpy(), out.offsets.to_numpy()
                    columns.append(pa.array([t is None or decoded(p, flat[a:b].tolist()) == t.replace(SPACE, " ") for t, a, b in zip(texts, ends, ends[1:])], pa.bool_()))
                    names.append(check)
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the texts of its ids."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    @pandas_udf("string")
    def back(column):
        return column.map(lambda x: decoded(shared.value, None if x is None else x.tolist()))

    return df.withColumn(text, back(F.col(ids)))


def n_tokens(ids: str = "ids") -> Column:
    return F.coalesce(F.size(ids), F.lit(0)).cast("long")


#: Of the public tokenizers; a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, load(model), check="round_trip").select("doc_id", n_tokens().alias("n_tokens"), "ids", "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = MODEL) -> DataFrame:
    """doc_id, the ids of the text, their number, and whether decoding them gives the text."""
    coded = encode(docs.select("doc_id", "text"), load(model), check="round_trip")
    return coded.select("doc_id", n_tokens().alias("n_tokens"), "ids", "round_trip")
