"""Exact deduplication with a log-structured merge index of digests.

Texts become digests of their normalised bytes. Each task gathers digests in a bounded memtable and flushes it as a sorted
run. Compaction deals runs to ranges of digests, merges the runs of a range in order, keeps for each digest the best
identifier, and leaves one longer sorted run a range; later runs merge with it the same way. Each range has a Bloom filter
of the digests that several rows share, and a second scan ships only the texts that hit it, whose bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE_BYTES, chunks, cut, fresh, row_hash

#: Entries of a memtable before it is flushed as a run.
MEMTABLE = 1 << 17
#: Bits of the filters for each shared digest, and the most and fewest of all together: 32 MB at most leave the executors.
#: Fuller filters ship more texts, never fewer.
BITS_EACH, FILTER_BITS, FEWEST_BITS = 16, 1 << 28, 1 << 14
PROBES = 3
#: Ranges of digests, by their first byte, each with a filter of its own.
RANGES = 256


def normalised(text: bytes | None) -> bytes:
    """The text without ASCII white space; null counts as empty."""
    return (text or b"").translate(None, SPACE_BYTES)


def code_points(text: bytes | None) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)) if text else 0


def _better(a: tuple[int, object], b: tuple[int, object]) -> bool:
    """Whether (code points, id) a goes before b: more code points, then the smaller id, null last."""
    return a[0] > b[0] or a[0] == b[0] and a[1] is not None and (b[1] is None or a[1] < b[1])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs (digest, points, best, n): for each memtable, its digests in order with their best row and count."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("digest", pa.binary()), ("points", pa.int64()), ("best", _arrow_type(rows, "doc_id")), ("n", pa.int64())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple[int, object, int]] = {}

        def flush() -> pa.RecordBatch:
            order = sorted(table)
            columns = zip(*((d, *table[d]) for d in order), strict=True) if order else ([], [], [], [])
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            table.clear()
            return out

        for part, texts in chunks(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                digest = hashlib.sha256(normalised(text)).digest()[:digest_bytes]
                row = (code_points(text), doc_id)
                old = table.get(digest)
                table[digest] = (*row, 1) if old is None else ((*row, old[2] + 1) if _better(row, old) else (old[0], old[1], old[2] + 1))
                if len(table) >= memtable:
                    yield flush()
        yield flush()

    return rows.mapInArrow(scan, f"digest binary, points bigint, best {kind}, n bigint")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _rank() -> Column:
    """Orders rows of a digest, best first, as a struct for min()."""
    return F.struct((-F.col("points")).alias("less"), F.col("best").isNull().alias("null_id"), "best")


def compact(*tables: DataFrame) -> DataFrame:
    """Merges runs: one row (digest, points, best, n) for each digest, with the best row's identifier kept.

    Rows are dealt by the first two bytes of the digest and each part's runs are merged in order, in one pass that holds
    one row. A compacted table is a run itself, so a later batch's runs merge into it in the same way.
    """
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t)
    schema = pa.schema([("digest", pa.binary()), ("points", pa.int64()), ("best", _arrow_type(merged, "best")), ("n", pa.int64())])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, int, object, int] | None = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if held is None:
                    held = row
                elif held[0] != row[0]:
                    done.append(held)
                    held = row
                else:
                    best = row if _better(row[1:3], held[1:3]) else held
                    held = (*best[:3], held[3] + row[3])
            yield _batch(done, schema)
        if held is not None:
            yield _batch([held], schema)

    dealt = merged.select("digest", "points", "best", "n").repartition(F.substring("digest", 1, 2)).sortWithinPartitions("digest")
    return dealt.mapInArrow(merge, merged.schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _probes(digests: list[bytes], bits: int) -> np.ndarray:
    """The filter positions of digests: their range's filter begins at a place of its own, and their bytes are hashed anew."""
    ranges = min(RANGES, bits // 64)
    raw = np.frombuffer(b"".join(hashlib.blake2b(d, digest_size=4 * PROBES).digest() for d in digests), "<u4").reshape(-1, PROBES)
    first = np.fromiter((d[0] % ranges if d else 0 for d in digests), np.int64, len(digests))
    return first[:, None] * (bits // ranges) + raw % np.uint32(bits // ranges)


def filter_bits_for(shared: int, most: int = FILTER_BITS) -> int:
    """Bits for so many shared digests: a power of two."""
    return min(most, max(FEWEST_BITS, 1 << (BITS_EACH * shared).bit_length()))


def shared_filter(compacted: DataFrame, bits: int) -> bytes:
    """The ranges' Bloom filters over the digests with several rows, `bits` / 8 bytes together."""

    def positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(_probes(batch.column(0).to_pylist(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(found >> 6, pa.int64()), pa.array((np.uint64(1) << (found & 63).astype(np.uint64)).view(np.int64))], ["word", "mask"])

    hits = compacted.where("n > 1").select("digest")
    words = hits.mapInArrow(positions, "word bigint, mask bigint").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.tobytes()


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable: int = MEMTABLE, filter_bits: int | None = None) -> DataFrame:
    """One row for every row of docs: doc_id, keep_id, group_size, kept, text_sha256, points.

    Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal texts the row with the
    most code points in the original text stays, then the smallest doc_id (null last). keep_id is its doc_id. Rows that
    agree in doc_id and length as well are told apart by nothing, so exactly one of them is kept. A digest is only trusted
    after its rows' bytes were compared with the best row's; rows that differ form groups of their own by their bytes.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    index = cut(compact(runs(rows, "doc_id", "text", digest_bytes, memtable)))
    filter_bits = filter_bits or filter_bits_for(index.where("n > 1").count())
    shared = spark.sparkContext.broadcast(shared_filter(index, filter_bits))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for part, texts in chunks(batches):
            plain = [normalised(t) for t in texts]
            whole = [hashlib.sha256(t) for t in plain]
            digests = [h.digest()[:digest_bytes] for h in whole]
            at = _probes(digests, filter_bits)
            likely = ((bitmap[at >> 3] >> (at & 7)) & 1).all(axis=1).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([code_points(t) for t in texts], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([h.hexdigest() for h in whole]), pa.array([t if x else None for t, x in zip(plain, likely, strict=True)], pa.binary()),
                ],
                ["doc_id", "points", "digest", "text_sha256", "plain"],
            )

    scanned = rows.mapInArrow(scan, f"doc_id {kind}, points bigint, digest binary, text_sha256 string, plain binary")
    alone = scanned.where("plain is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "points")
    # The filter's false hits have no match in the index's shared digests and stay alone.
    groups = index.where("n > 1").select("digest", F.col("points").alias("top"), "best", "n")
    likely = scanned.where("plain is not null").join(groups, "digest", "left")
    is_best = F.col("n").isNotNull() & (F.col("points") == F.col("top")) & F.col("doc_id").eqNullSafe(F.col("best"))
    likely = cut(likely.withColumn("is_best", F.coalesce(is_best, F.lit(False))))
    # Of the best rows of a digest (several only where a row repeats, or bytes differ) one gives the bytes to compare with.
    # Written first, so that the join below deals both sides itself and can split a digest with very many rows.
    bytes_of = cut(likely.where("is_best").groupBy("digest").agg(F.min("plain").alias("best_plain")))
    compared = likely.join(bytes_of, "digest", "left").withColumn("same", F.col("n").isNull() | F.col("plain").eqNullSafe(F.col("best_plain"))).drop("best_plain")
    compared = cut(compared.withColumn("plain", F.when(~F.col("same"), F.col("plain"))))
    odd = compared.where("not same")
    if odd.isEmpty():
        verified = compared.withColumn("group_size", F.coalesce("n", F.lit(1)))
    else:
        less = odd.groupBy("digest").agg(F.count("*").alias("less"))
        verified = compared.where("same").join(less, "digest", "left").withColumn("group_size", F.coalesce(F.col("n"), F.lit(1)) - F.coalesce("less", F.lit(0)))
    # One of the rows that nothing tells apart from the best one is kept.
    first = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")) == 1
    best = verified.where("is_best and same and n is not null").select("*", first.alias("kept"))
    rest = verified.where("same and not (is_best and n is not null)").select("*", F.col("n").isNull().alias("kept"))
    hits = best.unionByName(rest).select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"), "kept", "text_sha256", "points"
    )
    out = alone.unionByName(hits)
    if odd.isEmpty():
        return out
    tops = odd.select("digest", "plain", "points", F.col("doc_id").alias("best"), F.lit(1).alias("one")).groupBy("digest", "plain").agg(F.min(_rank()).alias("r"), F.count("*").alias("size"))
    order = Window.partitionBy("digest", "plain").orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    split = odd.withColumn("kept", F.row_number().over(order) == 1).join(tops, ["digest", "plain"])
    return out.unionByName(split.select("doc_id", F.col("r.best").alias("keep_id"), F.col("size").alias("group_size"), "kept", "text_sha256", "points"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: int) -> DataFrame:
    """decisions() without the length: doc_id, keep_id, group_size, kept, text_sha256."""
    return decisions(docs, id_col, text_col, **parameters).drop("points")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: int) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names and types.

    Rows are matched to decisions by id and text digest; where a whole key repeats, one row of the longest text stays. Null
    texts count as empty, null ids come last, texts may be of any length, an empty table stays empty.
    """
    names = fresh(docs.columns, "kept_id", "kept_sha", "kept_points", "sha", "points", "nth")
    kept_id, kept_sha, kept_points, sha, points, nth = names
    kept = decisions(docs, id_col, text_col, **parameters).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha), F.col("points").alias(kept_points)).distinct()
    plain = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)
    marked = docs.select(*docs.columns, plain.alias(sha), F.coalesce(F.length(text_col), F.lit(0)).alias(points))
    joined = marked.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)) & (F.col(points) == F.col(kept_points)))
    one = F.row_number().over(Window.partitionBy(id_col, sha, points).orderBy(text_col, row_hash(docs)))
    return joined.withColumn(nth, one).where(F.col(nth) == 1).select(*docs.columns)


#: The same rows in DuckDB.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
r AS (
  SELECT doc_id, plain, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size
  FROM n WINDOW w AS (PARTITION BY plain ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, sha256(plain) AS text_sha256 FROM r
"""
