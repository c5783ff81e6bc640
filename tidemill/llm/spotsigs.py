"""SpotSigs document fingerprints, with DataFrame functions only.

At every common word (an anchor) a signature is formed of the anchor and the chain of content words that follow it. The
set of a text's signatures is its fingerprint; sets are compared by Jaccard likeness.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, linked

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that was for on are as with be at by this from or an it he she not have which "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es aus bei nach für über "
    "le la les et du une que est pour qui dans par plus pas au sur il elle ou ce "
    "el los las del un y se por con no su para al lo como más o pero"
).split()
#: Content words of a chain; common words passed over before each of them, however many.
CHAIN, PASSED = 2, sys.maxsize
#: Marks a common word.
MARK = "\x01"


def _any_of(words: Iterable[str]) -> str:
    """A pattern of the words, of which none begins another, that looks at each of their characters once."""
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    parts = [c + _any_of(dict.fromkeys(tails)) for c, tails in rest.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""


_COMMON = f"(?<= )(?={_any_of(f'{w} ' for w in ANCHORS)})"
_MARKED = f"{MARK}[^ ]+ "
#: A run of common words and the chain behind it, if there is one; each run is read once as such and once in a chain.
_RUN = f"(?=((?:{_MARKED})++(?:[^ {MARK}][^ ]* (?:(?:{_MARKED})*+[^ {MARK}][^ ]* ){{{CHAIN - 1}}})?))(?:{_MARKED})++"
_ONE = f"^{MARK}[^{MARK}]+$"



def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column) -> Column:
    """The set of a text's signatures, as a sorted array of 32-bit hashes.

    Words are runs of letters and digits in lower case. A chain passes over any number of common words. A text
    without any signature has 64 bits of a hash of its words as a whole, as two, so that equal texts have equal sets and
    other texts, but for hash collisions, other ones.
    """
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))

    def of_words(w: Column) -> Column:
        marked = F.regexp_replace(w, _COMMON, MARK)
        runs = F.regexp_extract_all(marked, F.lit(_RUN), F.lit(1))
        each = lambda c: F.array_distinct(F.split(F.regexp_extract(c, f"^((?:{_MARKED})++)", 1), MARK))
        many = lambda c: _let(F.regexp_replace(c, _MARKED, ""), lambda chain: F.transform(F.filter(each(c), lambda x: (x != "") & (chain != "")), lambda x: F.hash(F.concat(x, chain))))
        one = lambda c: F.filter(F.array(F.hash(F.substring(c, 2, 2147483647))), lambda _: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) > CHAIN)
        hashes = F.flatten(F.transform(runs, lambda c: F.when(c.rlike(_ONE), one(c)).otherwise(many(c))))
        return _let(F.sort_array(F.array_distinct(hashes)), lambda some: F.when(F.size(some) > 0, some).otherwise(F.sort_array(F.array(F.hash(w), F.hash(F.lit(MARK), w)))))

    return _let(words, of_words)


def fingerprint(sigs: Column) -> Column:
    """A set as text: its size and 128 bits of a digest."""
    return F.concat_ws("-", F.size(sigs), F.substring(F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256), 1, 32))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard likeness of two sets; sets that are equal, or share nothing, need no count."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).when(~F.arrays_overlap(a, b), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _key(column: str) -> Column:
    """An id of any type as text that is never null; null and the empty text differ."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def _chain(docs: DataFrame) -> DataFrame:
    """Rows (key, to, need): each doc_id's predecessor in descending order (null last; the first follows the last), and
    the code points that the predecessor's edit takes.

    Ids are dealt by range; within a part the predecessor is the row before, and only each part's ends meet.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("doc_id").agg(F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 3)).cast("int").alias("need"))
    dealt = cut(ids.repartitionByRange(parts, F.desc_nulls_last("doc_id")).select("doc_id", "need", F.spark_partition_id().alias("part")))
    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"))
    inner = dealt.select("part", _key("doc_id").alias("key"), F.lag(F.struct(_key("doc_id").alias("to"), "need")).over(order).alias("p"), F.row_number().over(order).alias("nth"))
    rank = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")
    ends = dealt.groupBy("part").agg(F.min_by(F.struct(_key("doc_id").alias("to"), "need"), rank).alias("end"))
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    before = ends.select("part", F.coalesce(F.lag("end").over(every), F.last("end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    return inner.join(before, "part").select("key", F.when(F.col("nth") == 1, F.col("before")).otherwise(F.col("p")).alias("p")).select("key", "p.to", "p.need")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by as many first ones (or all) of the next
    document by descending doc_id, null last; after the last comes the first. Where a doc_id repeats, the smallest of its
    texts stands for it as a next document. A null text counts as empty. near_edited and near_next are the likeness of the
    fingerprint's signatures to the edited text's and to the next document's. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Both uses below need the same columns, so that the texts and their signatures are dealt once.
    keyed = rows.select("doc_id", _key("doc_id").alias("key"), "text", signatures(F.col("text")).alias("sigs"))
    chain = _chain(rows)
    one = F.row_number().over(Window.partitionBy("key").orderBy("text", "doc_id"))
    donors = keyed.join(chain, "key").select("*", one.alias("nth")).where("nth = 1")
    donors = donors.select(F.col("to").alias("key"), F.left("text", F.col("need")).alias("donor"), F.col("sigs").alias("next_sigs"))
    own = keyed.join(donors, "key").select("doc_id", "text", "sigs", "next_sigs", F.length("text").alias("n"), "donor")
    kept = F.col("n") - F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.left("text", kept), F.left("donor", F.col("n") - kept))
    texts = own.select("doc_id", F.col("n").cast("bigint").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    sets = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("sigs").alias("a"), signatures(F.col("edited")).alias("b"), "next_sigs")
    a, b, c = F.col("a"), F.col("b"), F.col("next_sigs")
    return sets.select("doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for every row of docs: doc_id, fingerprint, component_id, the smallest doc_id (null last) that links lead to.

    Texts are linked where their sets' Jaccard likeness reaches the threshold. Equal sets are one. Sets are partitioned by
    length, so that only those of one or of neighbouring partitions can be alike enough; in a partition, sets meet at the
    rarest of their signatures, as many as any like set must share one of; pairs whose lengths alone rule them out are
    pruned, the others counted. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col)).alias("sigs"))
    rows = cut(rows.select("doc_id", "sigs", fingerprint(F.col("sigs")).alias("fingerprint")))
    sets = cut(rows.groupBy("fingerprint").agg(F.first("sigs").alias("sigs"))).withColumn("n", F.size("sigs"))
    each = sets.select("fingerprint", "n", F.explode("sigs").alias("sig"))
    ranked = each.join(each.groupBy("sig").agg(F.count("*").alias("often")), "sig").groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("by"))
    prefix = F.slice(F.col("by.sig"), 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    met = ranked.select(F.col("fingerprint").alias("node"), part.alias("part"), F.explode(prefix).alias("sig"))
    buckets = met.select("node", F.explode(F.array(F.xxhash64("sig", "part"), F.xxhash64("sig", F.col("part") + 1))).alias("key"))

    def near(pairs: DataFrame) -> DataFrame:
        a, b = sets.toDF("a", "sigs_a", "n_a"), sets.toDF("b", "sigs_b", "n_b")
        alike = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
        found = pairs.join(a, "a").join(b, "b").where(alike).where(likeness(F.col("sigs_a"), F.col("sigs_b")) >= threshold - 1e-9)
        return found.select(*pairs.columns)

    roots = linked(buckets, near).withColumnRenamed("node", "fingerprint")
    named = rows.select("doc_id", "fingerprint").join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    return named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "fingerprint", "component_id")
