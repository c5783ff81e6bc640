"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within the radius differ by at most one bit in
one of them. Each fingerprint is indexed under every segment with one bit left open, so such a pair meets by equality.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import chunks, components, cut, fresh, row_hash, salted

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16
#: Fingerprints before it in a bucket that each one is compared with in place.
PEERS = 7
#: Distinct fingerprints above which keys of a segment alone, of about 20 bits, would make large buckets.
FINE = 1 << 24


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included.

    A-Z is lower-cased and words are separated by ASCII white space. Fewer words than a shingle has: the whole sequence
    is the one shingle. No word at all, or null: none.
    """
    tokens = text.lower().split() if text else ()
    digest = xxhash.xxh64_intdigest
    flat = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(flat, SEED)] if tokens else [], dtype="<u8")
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(flat)][words - 1 :]
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=False)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes: a bit is 1 if set in over half of them; 0 if there are none."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Rows (doc_id, text_key, fp): one for every row of docs; fp is the fingerprint as a signed 64-bit number."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            fps = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, text_key bigint, fp bigint")


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, length) of the fewest segments of which one differs by at most one bit within the radius."""
    count = radius // 2 + 1
    bounds = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in pairwise(bounds)]


def variants(fps: DataFrame, radius: int, blocks: int = 1) -> DataFrame:
    """Adds `key` to rows with a fingerprint: one row for each segment and each bit of it left open.

    With more than one block, the bits outside the segment are cut into `blocks` parts as well, of which one is equal if
    there are more blocks than differing bits; then a key holds such a part too, in one row for each part.
    """
    first, mask = [], []
    for start, length in segments(radius):
        first += [start] * length
        mask += [(1 << length) - 1] * length
    literal = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    at = lambda xs: f"get({literal(xs)}, bit)"
    opened = f"(shiftrightunsigned(fp & ~shiftleft(1L, bit), cast({at(first)} as int)) & {at(mask)}) * {BITS} + bit"
    index = fps.select("*", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    if blocks == 1:
        return index.select(*fps.columns, F.expr(opened).alias("key"))
    masks = []
    for start, length in segments(radius):
        outside = [b for b in range(BITS) if not start <= b < start + length]
        parts = [outside[len(outside) * i // blocks : len(outside) * (i + 1) // blocks] for i in range(blocks)]
        masks += [[sum(1 << b for b in p) - (1 << BITS if 63 in p else 0) for p in parts]] * length
    index = index.select("*", F.posexplode(F.expr("get(array(" + ",".join(literal(m) for m in masks).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)") + "), bit)")).alias("block", "part"))
    return index.select(*fps.columns, F.xxhash64(F.expr(opened), F.col("block"), F.expr("fp & part")).alias("key"))


def near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def neighbours(index: DataFrame, bits: int) -> DataFrame:
    """Rows (fp, key, large, links): links are those within `bits` of the PEERS before fp in its bucket and the bucket's smallest.

    index: rows (fp, key) of distinct fingerprints. large: the bucket has more than PEERS + 1. Rows that are neither linked
    nor in a large bucket are left out.
    """
    others = ["low", *(f"before{k}" for k in range(1, PEERS + 1))]
    marked = index.selectExpr(
        "fp", "key", "first(fp) over (partition by key order by fp) as low",
        *(f"lag(fp, {k}) over (partition by key order by fp) as before{k}" for k in range(1, PEERS + 1)),
        f"count(*) over (partition by key order by fp rows between unbounded preceding and unbounded following) > {PEERS + 1} as large",
    )
    linked = [(F.col("fp") != F.col(o)) & near("fp", o, bits) for o in others]
    some = F.coalesce(linked[0], F.lit(False))
    for x in linked[1:]:
        some = some | F.coalesce(x, F.lit(False))
    return marked.where(some | F.col("large")).select("fp", "key", "large", F.array_distinct(F.array_compact(F.array(*(F.when(x, F.col(o)) for x, o in zip(linked, others, strict=True))))).alias("links"))


def candidates(fps: DataFrame, radius: int, bits: int) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, whose fingerprints are equal or meet under a segment and are within `bits`.

    fps: rows (node, fp) with node distinct. radius sets the segments, bits may be more. Of nodes with one fingerprint the
    smallest stands for all and is paired with each. Linear: in a bucket only neighbours are compared, so that pairs of
    large buckets can be missing, as can pairs without a common segment; a caller who owes them looks for them elsewhere.
    """
    least = cut(fps.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")))
    equal = salted(fps, least.where("n > 1").drop("n"), ["fp"]).where("a <> node").select("a", F.col("node").alias("b"))
    least = least.drop("n")
    met = neighbours(variants(least.select("fp"), radius), bits).select("fp", F.explode("links").alias("fp2")).distinct()
    met = met.join(least, "fp").join(least.toDF("fp2", "b"), "fp2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(equal)


def classes(fps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Connected components of distinct fingerprints linked at `radius` or fewer differing bits: (fp, part, component_id).

    fps: rows (fp, doc_id) with fp distinct; part names a component by one of its fingerprints, component_id is its smallest
    doc_id. Exact: in the order of a bucket, each fingerprint is compared with the PEERS before it and with the bucket's smallest, which settles buckets
    of at most PEERS + 1 and joins dense groups into components, with a number of rows in proportion to the index. Larger
    buckets that then still hold several components are joined with themselves, keeping only pairs within the radius whose
    components differ. Above FINE fingerprints the keys are made longer by blocks, so that buckets stay small.
    """
    if blocks is None:
        blocks = 1 if fps.count() <= FINE else radius + 1
    index = variants(fps.select("fp"), radius, blocks)
    kept = cut(neighbours(index, radius))
    named = components(kept.select(F.col("fp").alias("a"), F.explode("links").alias("b")))
    shared = kept.where("large").select("fp", "key")
    buckets = shared.join(named.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("part"))
    mixed = buckets.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    rest = cut(buckets.join(mixed, "key", "left_semi"))
    left, right = rest.toDF("key", "fp", "part"), rest.toDF("key", "fp2", "part2")
    pairs = left.join(right, "key").where("part < part2").where(near("fp", "fp2", radius)).select(F.col("part").alias("a"), F.col("part2").alias("b"))
    joined = components(pairs)
    whole = fps.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("root", "fp")).drop("root")
    whole = whole.join(joined.withColumnRenamed("node", "part"), "part", "left").select("fp", "doc_id", F.coalesce("root", "part").alias("part"))
    # Most fingerprints are alone; only those of larger components need the smallest id of others, dealt by salt.
    least = cut(whole.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    alone = least.where("n = 1").select(F.col("part").alias("fp"), "part", "component_id")
    return alone.unionByName(salted(whole.select("fp", "part"), least.where("n > 1").drop("n"), ["part"]).select("fp", "part", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): one for every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that links lead to, the row's own included;
    null ids are never smallest, and a component of null ids alone has null. Texts that are null or have no word have
    fingerprint zero, linked like any other. Rows that repeat a doc_id each stay and are classed by their own text.
    Texts may be of any length; other columns of docs, whatever their names, are not looked at. An empty table gives an
    empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words))
    classed = classes(cut(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))), radius)
    return fps.join(classed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one, with the smallest id (null last).

    Rows that agree in id and text are one document, of which one row stays. Null texts and those without words have one
    fingerprint. Columns may have any names and types; an empty table stays empty.
    """
    kept_id, kept_key, text_key, nth = fresh(docs.columns, "kept_id", "kept_key", "text_key", "nth")
    fps = cut(fingerprints(docs, id_col, text_col, words))
    classed = classes(cut(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    kept = fps.join(classed.select("fp", "part"), "fp").groupBy("part").agg(first).select(F.col("first.doc_id").alias(kept_id), F.col("first.text_key").alias(kept_key)).distinct()
    rows = docs.select(*docs.columns, F.xxhash64(text_col).alias(text_key))
    joined = rows.join(kept, (F.col(text_key) == F.col(kept_key)) & F.col(id_col).eqNullSafe(F.col(kept_id)))
    one = F.row_number().over(Window.partitionBy(kept_id, kept_key).orderBy(row_hash(docs)))
    return joined.withColumn(nth, one).where(F.col(nth) == 1).select(*docs.columns)
