"""Substring deduplication: word windows that occur more than once, found from difference-cover anchors.

Only word positions whose remainder by a period lies in a difference cover are hashed. For any two positions some shift
below the period moves both onto the cover, so two equal windows always share an aligned anchor. Windows around anchors
that occur again are extended to the whole window and counted; all other windows cannot repeat.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.llm.common import chunks

WINDOW = 35
#: A perfect difference set; each remainder by 21 but 0 is the difference of exactly one ordered pair.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
#: Hashes that a task gathers before it merges equal ones and passes them on.
BLOCK = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    differences = {(a - b) % period for a, b in combinations(cover, 2)} | {(b - a) % period for a, b in combinations(cover, 2)}
    return differences | {0} == set(range(period))


class Words:
    """The words of a text, as one run of bytes with single spaces."""

    def __init__(self, text: bytes | None):
        tokens = text.split() if text else []
        self.n = len(tokens)
        self.flat = b" ".join(tokens)
        gaps = np.flatnonzero(np.frombuffer(self.flat, np.uint8) == 32)
        self.starts = np.concatenate(([0], gaps + 1)) if self.n else gaps
        self.ends = np.concatenate((gaps, [len(self.flat)])) if self.n else gaps

    def spans(self, at: np.ndarray, length: int) -> Iterable[bytes]:
        flat = self.flat
        return (flat[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + length - 1].tolist(), strict=True))


def anchors(words: Words, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors; a text with no whole window has none."""
    length = window - period + 1
    if words.n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = (np.arange(0, words.n, period)[:, None] + np.array(cover)).ravel()
    at = at[at + length <= words.n]
    digest = xxhash.xxh3_64_intdigest
    return at, np.fromiter((digest(s) for s in words.spans(at, length)), np.uint64, len(at))


def candidates(words: Words, found: np.ndarray, window: int, period: int) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor within their first `period` positions."""
    steps = np.zeros(words.n + 2, np.int64)
    np.add.at(steps, np.maximum(found - period + 1, 0), 1)
    np.add.at(steps, found + 1, -1)
    return np.flatnonzero(np.cumsum(steps)[: max(0, words.n - window + 1)])


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the starts."""
    steps = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps)[:n] > 0


Found = Callable[[Words, np.ndarray | None], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, first all lowest ones, then the next: small numbers then pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel(), at + n * width


def _column(values: list) -> np.ndarray:
    """Ids as an array: of 64-bit numbers if they all are, else of objects."""
    if all(type(v) is int for v in values):
        return np.array(values, np.int64)
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _packed(ids: np.ndarray, text_keys: np.ndarray, rows: np.ndarray, *columns: np.ndarray) -> bytes:
    """Occurrences in several texts as one compressed piece; rows point to the texts' ids and keys."""
    used, local = np.unique(rows, return_inverse=True)
    columns = (local.astype("<u4"), *columns)
    names = pickle.dumps((ids[used], text_keys[used], [c.dtype.str for c in columns]), protocol=5)
    return zstandard.compress(b"".join((struct.pack("<II", len(rows), len(names)), names, *map(_planes, columns))), 1)


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, text_keys, columns) of several pieces together."""
    ids, text_keys, columns, base = [], [], [], 0
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n, size = struct.unpack_from("<II", raw)
        (some, keys, kinds), at, found = pickle.loads(raw[8 : 8 + size]), 8 + size, []
        for kind in kinds:
            column, at = _unplaned(raw, at, n, kind)
            found.append(column)
        found[0] = found[0].astype(np.int64) + base
        base += len(some)
        ids.append(some)
        text_keys.append(keys)
        columns.append(found)
    return np.concatenate(ids), np.concatenate(text_keys), [np.concatenate([c[k] for c in columns]) for k in range(len(columns[0]))]


def _split(numbers: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> tuple[list[int], list[bytes]]:
    """(number, piece) for each different number, of the positions where it stands."""
    by = np.argsort(numbers, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(numbers[by]) != 0, True)) + 1 if len(by) else np.zeros(0, np.int64)
    picks = [by[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)] if len(by) else []
    return [int(numbers[x[0]]) for x in picks], [pack(x) for x in picks]


def _homes(ids: np.ndarray, parts: int) -> np.ndarray:
    """A part for each id; a number's is the same among numbers and among objects."""
    if ids.dtype == np.int64:
        mixed = ids.astype(np.uint64) * ODD
    else:
        factor = int(ODD)
        mixed = np.fromiter((x * factor % (1 << 64) if type(x) is int else xxhash.xxh3_64_intdigest(repr(x).encode()) for x in ids), np.uint64, len(ids))
    return ((mixed >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def _occurrences(batches: Iterable[pa.RecordBatch], find: Found, block: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, blob) of what `find` hashes in each text, dealt to parts by the hash.

    Equal hashes of a block are merged first: one occurrence stays on the hash's route and stands for two; the others,
    known to repeat already, get routes of their own, so that a hash has one occurrence from each block at most.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not size:
            return
        ids, text_keys, places, hashes, subs = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3, 4, 5))
        base = np.cumsum([0, *(len(h[0]) for h in held)])
        rows = np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)])
        order = np.lexsort((subs, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(subs[order]) != 0)
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        nth = np.empty(len(order), np.uint64)
        nth[order] = np.arange(len(order)) - first
        times = np.diff(np.append(np.flatnonzero(new), len(order)))
        n = np.empty(len(order), np.uint8)
        n[order] = np.minimum(np.repeat(times, times), 2)
        routes = hashes + nth * ODD
        part = ((routes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        columns = (places.astype("<u4"), routes, subs, n)
        numbers, blobs = _split(part, lambda pick: _packed(ids, text_keys, rows[pick], *(c[pick] for c in columns)))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    for part, texts in chunks(batches):
        lists = part.column(part.schema.get_field_index("found")) if "found" in part.schema.names else None
        names = _column(part.column(0).to_pylist()), part.column(1).to_numpy(zero_copy_only=False)
        got = []
        for k, text in enumerate(texts):
            places, hashes, subs = find(Words(text), np.asarray(lists[k].values) if lists is not None else None)
            got.append((np.full(len(places), k), places, hashes, subs))
        held.append((*names, *(np.concatenate([g[k] for g in got]) for k in range(4))))
        size += len(held[-1][2])
        if size >= block:
            yield from flush()
            held.clear()
            size = 0
    yield from flush()


def _repeated(rows: DataFrame, find: Found, block: int) -> DataFrame:
    """Rows (doc_id, text_key, found): the places of each text whose hash occurs at least twice anywhere."""
    kind = rows.schema["doc_id"].dataType
    parts = 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Texts are dealt to fewer parts than hashes, as each part of hashes sends a piece to each part of texts.
    homes = max(1, parts // 8)

    def merge(table: pa.Table) -> pa.Table:
        """The occurrences whose hash repeats, packed anew and dealt by text."""
        ids, text_keys, (text, place, route, sub, n) = _unpacked(table.column("blob").to_pylist())
        order = np.lexsort((sub, route))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(route[order]) != 0) | (np.diff(sub[order]) != 0)
        starts = np.flatnonzero(new)
        often = np.repeat(np.add.reduceat(n[order].astype(np.int64), starts) > 1, np.diff(np.append(starts, len(order))))
        hit = np.sort(order[often])
        numbers, blobs = _split(_homes(ids, homes)[text[hit]], lambda pick: _packed(ids, text_keys, text[hit[pick]], place[hit[pick]]))
        return pa.table([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["home", "blob"])

    def gather(table: pa.Table) -> pa.Table:
        """A text's places together."""
        ids, text_keys, (text, place) = _unpacked(table.column("blob").to_pylist())
        code = np.unique(ids, return_inverse=True)[1] if ids.dtype == np.int64 else np.array([codes.setdefault(x, len(codes)) for codes in [{}] for x in ids])
        order = np.lexsort((place, text_keys[text], code[text]))
        last = np.append((np.diff(code[text[order]]) != 0) | (np.diff(text_keys[text[order]]) != 0), True)
        ends = np.flatnonzero(last) + 1
        one = text[order[ends - 1]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(place[order].astype(np.int32)))
        return pa.table([pa.array(ids[one].tolist(), to_arrow_type(kind)), pa.array(text_keys[one], pa.int64()), lists], ["doc_id", "text_key", "found"])

    seen = rows.mapInArrow(lambda batches: _occurrences(batches, find, block, parts), "part int, blob binary")
    hits = seen.groupBy("part").applyInArrow(merge, "home int, blob binary")
    return hits.groupBy("home").applyInArrow(gather, f"doc_id {kind.simpleString()}, text_key bigint, found array<int>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, block: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """One row for every row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, if asked for).

    Words are runs of other characters than ASCII white space, unchanged; a null text has none. Each word covered by a
    window of `window` words is removed if the window's words also start anywhere else, in the same text included; windows
    are judged on the input. kept_sha256 is of the kept words, joined by one space. Rows that repeat a doc_id count as
    places of their own and are each judged by their own text. An empty table gives an empty result.
    """
    if not is_cover(cover, period) or period > window:
        raise ValueError("cover must be a difference cover of a period within the window")
    kind = docs.schema[id_col].dataType.simpleString()
    # Where every id is there once, an id alone tells the rows apart, and the key of the text stays empty.
    unique = docs.groupBy(id_col).count().where("count > 1").isEmpty()
    text_key = F.lit(0).cast("bigint") if unique else F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key.alias("text_key"), F.col(text_col).alias("text"))

    def find_anchors(words: Words, _: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, hashes = anchors(words, window, period, cover)
        return at, hashes, np.zeros(len(at), np.uint16)

    def find_windows(words: Words, found: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = candidates(words, found, window, period)
        digest = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join(digest(s) for s in words.spans(at, window)), np.uint8).reshape(-1, 16)
        return at, raw[:, :8].copy().view(np.uint64).ravel(), raw[:, 8:10].copy().view(np.uint16).ravel()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            lists = part.column(part.schema.get_field_index("found"))
            n_words, n_removed, digests, kept = [], [], [], []
            for text, found in zip(texts, lists, strict=True):
                tokens = text.split() if text else []
                left = tokens
                if found.is_valid:
                    gone = covered(len(tokens), np.asarray(found.values), window).tolist()
                    left = [t for t, x in zip(tokens, gone, strict=True) if not x]
                n_words.append(len(tokens))
                n_removed.append(len(tokens) - len(left))
                flat = b" ".join(left)
                digests.append(hashlib.sha256(flat).hexdigest())
                kept.append(flat.decode("utf-8", "replace") if keep_text else None)
            columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def with_found(found: DataFrame, how: str) -> DataFrame:
        by = found.toDF("found_id", "found_key", "found")
        on = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
        return rows.join(by, on, how).select("doc_id", "text_key", "text", "found")

    near = with_found(_repeated(rows, find_anchors, block), "inner")
    gone = _repeated(near, find_windows, block)
    out = with_found(gone, "left").mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out if keep_text else out.drop("kept")
