"""SentencePiece encoding and decoding by Viterbi over batches of words.

Words of equal length advance together as a matrix of code points. A hash of every substring is probed among the sorted
hashes of the pieces; for each end, a maximum over the last piece's length stores a backpointer. A unigram model's maximum
is of the sum of scores. A BPE model's pieces don't follow from sums: there a last piece is admissible if merging the piece
before it and the piece itself, alone, ends in just these two. Every prefix of a word has exactly one admissible last piece,
so the backpointers are those of the merges. Which pieces go together is remembered in arrays of fixed size.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import chunks, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The format's mark for a space; model types; piece types.
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A unigram model's unknown character costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words longer than this advance with words of about their length, the shorter ones padded.
LONG = 64
#: Distinct words that a worker remembers, and pairs of pieces (a power of two).
REMEMBERED, PAIRS = 1 << 19, 1 << 20
#: Cells of a batch's piece table; code points of a batch of long words.
CELLS, CODES = 1 << 18, 1 << 20
PAD = np.uint32(0xFFFFFFFF)
FIRST_SHIFT = np.uint64(43)
MIX = np.uint64(0x9E3779B97F4A7C15)
RATIO = np.uint64(0xD6E8FEB86659FD93)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + n]
            at += n


def _mixed(codes: np.ndarray) -> np.ndarray:
    out = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    return out ^ (out >> np.uint64(29))


def _hash(piece: str) -> int:
    """The polynomial hash of a piece, as substrings have it."""
    value = 0
    for m in _mixed(np.array([ord(c) for c in piece], np.uint32)).tolist():
        value = (value * int(RATIO) + m) % (1 << 64)
    return value


def _last_merge(piece: str, scores: dict[str, float]) -> tuple[str, str] | None:
    """The two parts whose merge completes a piece; None if merging its characters doesn't end in the piece."""
    parts = list(piece)
    while len(parts) > 2:
        best, at = None, 0
        for k in range(len(parts) - 1):
            score = scores.get(parts[k] + parts[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if best is None:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@dataclass
class Pairs:
    """Which two pieces of a BPE model may stand next to each other.

    The last number is any unknown character's. Merges of a higher score have an earlier turn, characters have turn 0.
    Pieces of one score are allowed if all are runs of one character; of their merges the leftmost comes first.
    """

    order: np.ndarray  # the number of a piece id, -1 if merges never end in it
    piece: np.ndarray  # the piece id of a number, -1 for an unknown character
    left: np.ndarray
    right: np.ndarray
    joins: np.ndarray  # sorted codes of two pieces that together are a piece
    joined: np.ndarray  # and that piece's turn
    turn: np.ndarray
    seen: np.ndarray | None = None
    good: np.ndarray | None = None

    @staticmethod
    def of(scores: dict[str, float], ids: dict[str, int]) -> Pairs:
        long = {p: s for p, s in scores.items() if len(p) > 1}
        turns: dict[float, str] = {}
        for p, s in long.items():
            if set(turns.setdefault(s, p)) != set(p) or turns[s] != p and len(set(p)) > 1:
                raise ValueError("two pieces have one score")
        merges = {p: m for p in sorted(long, key=lambda p: -long[p]) if (m := _last_merge(p, long)) is not None}
        atoms = list(dict.fromkeys([p for p in scores if len(p) == 1] + [c for p in merges for c in p]))
        number = {p: k for k, p in enumerate([*atoms, *merges])}
        n = len(number)
        left, right = np.arange(n + 1), np.arange(n + 1)
        for p, (a, b) in merges.items():
            left[number[p]], right[number[p]] = number[a], number[b]
        turn, rank = np.zeros(n + 1, np.int64), {s: k + 1 for k, s in enumerate(sorted(set(long.values()), reverse=True))}
        for p in merges:
            turn[number[p]] = rank[long[p]]
        both = [(number[p[:k]] * (n + 1) + number[p[k:]], rank[long[p]]) for p in merges for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        both.sort()
        order, piece = np.full(max(ids.values(), default=0) + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        for p, k in number.items():
            if p in ids:
                order[ids[p]], piece[k] = k, ids[p]
        return Pairs(order, piece, left, right, np.array([c for c, _ in both], np.int64), np.array([k for _, k in both], np.int64), turn)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The turn of the piece that two pieces make, or one beyond all."""
        never = len(self.left)
        if not len(self.joins):
            return np.full(len(a), never)
        code = a * len(self.left) + b
        at = np.minimum(np.searchsorted(self.joins, code), len(self.joins) - 1)
        return np.where(self.joins[at] == code, self.joined[at], never)

    def judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b ends in a and b.

        Merges are undone from the last one. A pair at the border that would have been merged before the step undone, or
        at the same turn further left, shows that it would not.
        """
        out, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, before = a.copy(), b.copy(), np.full(len(a), len(self.left))
        while len(live):
            bad = self._merged(a[live], b[live]) < before[live]
            out[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            whole = (self.left[x] == x) & (self.left[y] == y)
            live, x, y = live[~whole], x[~whole], y[~whole]
            undo = self.turn[x] > self.turn[y]
            before[live] = np.where(undo, self.turn[x], self.turn[y] + 1)
            a[live], b[live] = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """judge(), remembered."""
        if self.seen is None:
            self.seen, self.good = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        code = a * len(self.left) + b
        slot = lambda c: ((c.view(np.uint64) * MIX) >> np.uint64(65 - PAIRS.bit_length())).view(np.int64)
        at = slot(code)
        out, new = self.good[at], self.seen[at] != code
        if new.any():
            some, where = np.unique(code[new], return_inverse=True)
            found = self.judge(some // len(self.left), some % len(self.left))
            out[new] = found[where]
            self.seen[slot(some)], self.good[slot(some)] = some, found
        return out


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    kind: int
    dummy_prefix: bool
    byte_ids: list[int] | None
    unknown: int
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    longest: int = field(init=False)
    pairs: Pairs | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        if any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in usable)):
            raise ValueError("pieces that run over a space's start aren't supported")
        if self.kind == BPE:
            self.pairs = Pairs.of({self.pieces[i]: float(self.scores[i]) for i in usable}, {self.pieces[i]: i for i in usable})
            usable = [i for i in usable if self.pairs.order[i] >= 0]
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        keys = np.array([_hash(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces have one hash")
        self.first = np.zeros(1 << 21, bool)
        self.first[(self.keys >> FIRST_SHIFT).astype(np.int64)] = True

    @staticmethod
    def parse(raw: bytes) -> Model:
        """Reads a serialised model with an identity normaliser that keeps all spaces."""
        pieces, scores, kinds, kind, prefix, bytes_too = [], [], [], UNIGRAM, True, False
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                kind, bytes_too = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                normalizer = dict(_fields(value))
                prefix = bool(normalizer.get(3, 1))
                if normalizer.get(2) or normalizer.get(4, 1):
                    raise ValueError("only identity normalisers that keep all spaces are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        byte_ids = [pieces.index(f"<0x{b:02X}>") for b in range(256)] if bytes_too else None
        return Model(pieces, np.array(scores), kinds, kind, prefix, byte_ids, kinds.index(UNKNOWN))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each substring hash, or -1; most hashes of no piece fail at a table of the keys' first bits."""
        out = np.full(hashes.shape, -1, np.int32)
        some = np.nonzero(self.first[(hashes >> FIRST_SHIFT).astype(np.int64)])
        likely = hashes[some]
        at = np.minimum(np.searchsorted(self.keys, likely), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == likely, self.ids[at], -1)
        return out


def substrings(model: Model, codes: np.ndarray) -> np.ndarray:
    """The piece table of equally long words: [word, start, length - 1], -1 for substrings that are no piece."""
    count, n = codes.shape
    mixed = _mixed(codes)
    most = min(n, model.longest)
    table = np.full((count, n, most), -1, np.int32)
    hashes = np.zeros((count, n + 1), np.uint64)
    for length in range(1, most + 1):
        hashes = hashes[:, : n - length + 1] * RATIO + mixed[:, length - 1 :]
        table[:, : n - length + 1, length - 1] = model.lookup(hashes)
    return table


def viterbi(model: Model, codes: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of all words, -1 for an unknown character; where each starts; pieces of each word) of the best segmentation.

    codes has a word in each row, padded if sizes gives the words' lengths. The piece table is made for some ends at a
    time, so that memory grows with the words and not with their substrings.
    """
    count, n = codes.shape
    sizes = np.full(count, n) if sizes is None else sizes
    bpe = model.pairs is not None
    unknown = len(model.pairs.left) - 1 if bpe else min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
    best = np.full((count, n + 1), -1) if bpe else np.zeros((count, n + 1))
    back, piece = np.zeros((count, n + 1), np.int32), np.full((count, n + 1), -1, np.int32)
    every = np.arange(count)
    block = max(16, 4 * CELLS // (count * model.longest))
    for low in range(0, n, block):
        origin, high = max(0, low - model.longest + 1), min(n, low + block)
        table = substrings(model, codes[:, origin:high])
        for end in range(low + 1, high + 1):
            lengths = np.arange(min(end, table.shape[2]), 0, -1)
            last = table[:, end - lengths - origin, lengths - 1]
            some = last >= 0
            some[:, -1] = True
            total = np.full(last.shape, -np.inf)
            if bpe:
                rows, at = np.nonzero(some)
                ids = last[rows, at]
                numbers = np.where(ids >= 0, model.pairs.order[ids], unknown)
                start = end - lengths[at]
                fits = start == 0
                fits[~fits] = model.pairs(best[rows[~fits], start[~fits]], numbers[~fits])
                total[rows[fits], at[fits]] = numbers[fits]
            else:
                total = np.where(some, best[:, end - lengths] + np.where(last >= 0, model.scores[last], unknown), -np.inf)
            pick = total.argmax(axis=1)
            best[:, end] = total[every, pick]
            back[:, end] = end - lengths[pick]
            piece[:, end] = last[every, pick]
    ends, live, at = np.zeros((count, n + 1), bool), every, sizes.copy()
    while len(live := live[at[live] > 0]):
        ends[live, at[live]] = True
        at[live] = back[live, at[live]]
    rows, at = np.nonzero(ends)
    return piece[rows, at], back[rows, at], ends.sum(axis=1)


class Codec:
    """Encodes and decodes texts with a model, remembering a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.memory: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.surface = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            self.surface.append(b"" if kind == CONTROL else bytes([int(piece[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode())

    def _spelt(self, word: str, ids: list[int], starts: list[int]) -> bytes:
        """The ids as remembered, with unknown characters as bytes, or as the unknown piece if the model has no bytes."""
        out: list[int] = []
        for k, a in zip(ids, starts, strict=True):
            if k >= 0:
                out.append(k)
            elif self.model.byte_ids:
                out.extend(self.model.byte_ids[x] for x in word[a].encode("utf-8", "replace"))
            else:
                out.append(self.model.unknown)
        return np.array(out, np.int32).tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Encodes the words that aren't remembered, those of one length together, long ones with others of about theirs."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in self.memory:
                by_length.setdefault(len(w), []).append(w)
        for n in sorted(k for k in by_length if k <= LONG):
            some = by_length[n]
            step = max(1, CELLS // (n * min(n, self.model.longest)))
            for i in range(0, len(some), step):
                self._remember(some[i : i + step], n)
        held: list[str] = []
        for n in sorted((k for k in by_length if k > LONG), reverse=True):
            for w in by_length[n]:
                if held and (4 * n < 3 * len(held[0]) or (len(held) + 1) * len(held[0]) > CODES):
                    self._remember(held, len(held[0]))
                    held = []
                held.append(w)
        if held:
            self._remember(held, len(held[0]))

    def _remember(self, words: list[str], n: int) -> None:
        """Encodes words of at most n characters as one matrix."""
        if len(words[-1]) == n:
            codes, sizes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n), None
        else:
            codes, sizes = np.full((len(words), n), PAD), np.array([len(w) for w in words])
            for k, w in enumerate(words):
                codes[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
        pieces, starts, counts = viterbi(self.model, codes, sizes)
        ends = np.cumsum(counts)
        known = (np.minimum.reduceat(pieces, ends - counts) >= 0).tolist()
        raw, at = pieces.astype(np.int32).tobytes(), 0
        for w, end, all_known in zip(words, ends.tolist(), known, strict=True):
            self.memory[w] = raw[4 * at : 4 * end] if all_known else self._spelt(w, pieces[at:end].tolist(), starts[at:end].tolist())
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The piece ids of each text.

        Texts are split twice, so that the words of one text at a time and the new ones of all are held.
        """
        split = lambda text: _units(((" " if self.model.dummy_prefix else "") + text).replace(" ", SPACE)) if text else []
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new: set[str] = set()
        for text in texts:
            new |= set(split(text)).difference(self.memory)
        self.learn(new)
        del new
        out = []
        for text in texts:
            ids = np.frombuffer(b"".join(map(self.memory.__getitem__, split(text))), np.int32)
            if not self.model.byte_ids:  # neighbouring unknown characters are one piece
                same = (ids[1:] == self.model.unknown) & (ids[:-1] == self.model.unknown)
                ids = ids[np.concatenate(([True], ~same))] if len(ids) else ids
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of piece ids; the space that encoding puts in front goes."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _units(flat: str) -> list[str]:
    """A text's words, each with the spaces before it; no piece runs over where one starts."""
    words = flat.split(SPACE)
    if SPACE * 2 not in flat and not flat.endswith(SPACE):
        return ([words[0]] if words[0] else []) + [SPACE + w for w in words[1:]]
    out, spaces = ([words[0]] if words[0] else []), ""
    for w in words[1:]:
        spaces += SPACE
        if w:
            out.append(spaces + w)
            spaces = ""
    return [*out, spaces] if spaces else out


def encoded(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """docs with columns more: n_pieces, ids (if asked for), ids_sha256, decoded_sha256 and round_trip; the text if asked for.

    ids are the piece ids of the whole text; a null or empty text has none. ids_sha256 is of the ids as little-endian
    32-bit numbers, decoded_sha256 of the text that they decode to, round_trip whether that is the text. A column of docs
    with one of those names is replaced. Repeated rows each stay; texts and words may be of any length. An empty table
    stays empty.
    """
    docs = docs.drop("n_pieces", "ids", "ids_sha256", "decoded_sha256", "round_trip")
    spark: SparkSession = docs.sparkSession
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(Model.parse(f.read()))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from parts(batches)
        give_back()

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for part, raws in chunks(batches, text_col):
            texts = [(t or b"").decode("utf-8", "replace") for t in raws]
            ids = codec.encode(texts)
            back = [codec.decode(i.tolist()) for i in ids]
            columns = [
                pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)]),
            ]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids))))
            kept = [k for k, n in enumerate(part.schema.names) if with_text or n != text_col]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *columns], [*(part.schema.names[k] for k in kept), *names])

    added = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    if with_ids:
        added.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in added]
    return docs.mapInArrow(scan, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema if with_text or f.name != text_col), *added]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """One row for every row of docs, repeated ones too: doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip.

    As in encoded(): null and empty texts have no piece, texts may be of any length, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return encoded(rows, "text", model_path, with_ids=False, with_text=False)
