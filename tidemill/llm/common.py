"""What the document operators share: shared storage, Arrow batches of whole texts, connected components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; a longer single text is handled alone.
CHUNK_BYTES = 4 << 20

#: The characters that separate words, as bytes and as a regular expression's class.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset a local folder serves a local master; on a cluster it would be lost with its machine, so this raises.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tidemill-")


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column has it (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of all columns of a row; those that hold maps, which have no hash, count by their JSON."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`")), {"ignoreNullFields": "false"}) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *columns)


#: Parts that the rows of one key are dealt to.
SALTS = 16


def salted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of rows with keys, distinct in `on`, where no key's rows all go to one task: keys come once a salt."""
    dealt = rows.withColumn("_salt", F.pmod(row_hash(rows), F.lit(SALTS)).cast("int"))
    return dealt.join(keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]).drop("_salt")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the cluster's shared checkpoint folder and reads them from there.

    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Elements of an array whose running sums are taken one by one; longer arrays are cut into blocks of so many.
RUN = 64


def running_sums(values: str) -> str:
    """For each element of an array of integers that isn't empty, the sum of all before it, in SQL.

    Sums of blocks are taken first and each block then starts from those before it, so that an array of n takes about
    n * RUN / 2 + (n / RUN)^2 / 2 steps and no array is copied for each element.
    """
    total = lambda some: f"aggregate({some}, 0, (a, y) -> a + y)"
    blocks = f"transform(sequence(0, CAST(floor((size({values}) - 1) / {RUN}) AS INT)), b -> slice({values}, b * {RUN} + 1, {RUN}))"
    each = f"transform(array({total('slice(totals, 1, j)')}), start -> transform(b, (y, i) -> start + {total('slice(b, 1, i)')}))[0]"
    return f"transform(array({blocks}), blocks -> transform(array(transform(blocks, b -> {total('b')})), totals -> flatten(transform(blocks, (b, j) -> {each})))[0])[0]"


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches of about CHUNK_BYTES of text, with the texts as UTF-8 (null stays None)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = column.cast(pa.binary())
        offsets = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(offsets):
            if size and size + n > CHUNK_BYTES:
                part = batch.slice(start, i - start)
                yield part, as_bytes(part.column(part.schema.get_field_index(text)))
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, as_bytes(part.column(part.schema.get_field_index(text)))


def give_back() -> None:
    """Returns memory that is free to the system, as workers are reused and else hold on to it beside later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library has it on Linux
        trim(0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps; every step's edges are written to shared storage, and each node's
    edges are only ever joined to one smallest neighbour, so the rows stay in proportion to the edges.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked(buckets: DataFrame, near: Callable[[DataFrame], DataFrame], by: str = "node", about: DataFrame | None = None, may: Callable[[str, str], Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Components of nodes that share a bucket and are near: rows (node, root), for nodes with a link.

    buckets: rows (key, node, ...); near keeps the near pairs of rows (a, b). In each bucket a node is first compared with
    the first one in the order `by` and with the one before it, which is linear and joins dense groups if what comes first
    is near many; then only buckets that still hold several components are joined with themselves, and only nodes of
    different components meet. There `may` can rule out pairs, so that they make no rows, by what `about` tells of each node
    (in columns that end in _a and _b). What `known` joins already, rows (node, root), isn't compared. No link is lost.
    """
    order = f"over (partition by key order by {by}, node)"
    held = cut(buckets.selectExpr("key", "node", f"first(node) {order} as low", f"lag(node) {order} as before", f"lead(node) {order} as after").where("before is not null or after is not null"))
    first = held.select("node", F.explode(F.array_distinct(F.array_compact(F.array("low", "before")))).alias("other")).where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    if known is None:
        named = components(near(first))
    else:
        root = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        apart = first.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        named = components(near(apart.select("a", "b")).unionByName(known.toDF("a", "b")))
    parts = held.select("key", "node").join(named, "node", "left").select("key", "node", F.coalesce("root", "node").alias("part"))
    mixed = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    rest = cut(parts.join(mixed, "key", "left_semi"))
    if about is not None:
        rest = rest.join(about, "node")
    side = lambda x: rest.select("key", *(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in rest.columns if c != "key"))
    pairs = side("a").join(side("b"), "key").where("part_a < part_b")
    if may is not None:
        pairs = pairs.where(may("a", "b"))
    pairs = pairs.select("a", "b", "part_a", "part_b").distinct()
    more = near(pairs).select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    joined = components(more)
    roots = named.select(F.col("root").alias("node")).unionByName(joined.select("node")).unionByName(joined.select(F.col("root").alias("node"))).distinct()
    whole = named.unionByName(roots.join(named.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
    return whole.join(joined.toDF("root", "_top"), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
