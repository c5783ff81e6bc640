"""Line deduplication by winnowing, with DataFrame functions only.

A window is a line of many words, or as many consecutive lines as it takes to reach that many words, three at most. Of
every window the smallest line hash is selected, so two equal windows select the same line at the same place: a guaranteed
fingerprint. Only the selected positions become rows, each with the lines around it that its windows reach. Positions whose
fingerprint occurs once are done with; the others are extended to both sides, line by line, to the windows that selected
them, and a window that started earlier anywhere is a repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut, salted

#: A run counts as repeated from so many lines on, if any of them has a word, or from so many words on.
WINDOW, WORDS = 3, 10


def _key(id_col: str) -> Column:
    """An id as text that is never null; null and the empty text differ."""
    return F.when(F.col(id_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id_col).cast("string")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, text_key, start, mark, lens, lines, checks), one for each selected position.

    mark is the selected line's hash; lens are the numbers of lines of the windows that selected it, of which the first
    begins at start (0: none begins there); lines and checks are 64- and 32-bit hashes of all lines of these windows.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]++")).alias("c")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), hashes.alias("l"), F.col(text_col).isNotNull().alias("some")).where("some")
    rows = rows.select("doc_id", "text_key", F.col("l.h").alias("h"), F.col("l.g").alias("g"), F.col("l.c").alias("c"))

    def length(i: Column) -> Column:
        total, found = F.get("c", i), F.when(F.get("c", i) >= words, 1)
        for k in range(2, window):
            total = total + F.get("c", i + (k - 1))
            found = found.when(total >= words, k)
        total = total + F.get("c", i + (window - 1)) if window > 1 else total
        return found.when(total > 0, window).otherwise(0)

    rows = rows.select("doc_id", "text_key", "h", "g", F.transform("c", lambda _, i: length(i)).alias("n"))
    part = lambda n, i: F.slice(F.col("h"), i + 1, n)
    selected = F.transform("n", lambda n, i: F.when(n < 2, i).otherwise((i + F.array_position(part(n, i), F.array_min(part(n, i))) - 1).cast("int")))
    rows = rows.select("doc_id", "text_key", "h", "g", "n", selected.alias("p"))
    firsts = F.filter(F.transform("p", lambda p, i: F.when((i == 0) | (F.get("p", i - 1) != p), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "text_key", "h", "g", "n", "p", firsts.alias("firsts"))
    each = F.transform("firsts", lambda i, k: F.struct(i.alias("start"), F.get("h", F.get("p", i)).alias("mark"), F.slice("n", i + 1, F.coalesce(F.get("firsts", k + 1), F.size("p")) - i).alias("lens")))
    each = F.filter(each, lambda w: F.array_max(w.lens) > 0)
    reach = lambda w: F.array_max(F.transform(w.lens, lambda n, j: F.when(n > 0, n + j)))
    whole = F.transform(each, lambda w: F.struct(w.start.alias("start"), w.mark.alias("mark"), w.lens.alias("lens"), F.slice("h", w.start + 1, reach(w)).alias("lines"), F.slice("g", w.start + 1, reach(w)).alias("checks")))
    return rows.select("doc_id", "text_key", F.explode(whole).alias("w")).select("doc_id", "text_key", "w.*")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """One row for every row of docs: doc_id, n_lines, n_removed, kept_sha256, kept.

    Lines are what newlines separate; a null text has none, an empty text one empty line. A window begins at a line and
    ends with the first line by which it has `words` words, or after `window` lines; one of fewer words that the text's
    end cuts short, or without a word, is none. A line is removed if it lies in a window that also starts earlier: in a
    smaller doc_id (null last), or before it in the same text. Windows are equal if 96 bits of hashes of each of their
    lines are. Rows that repeat a doc_id are ordered by a hash of their text;
    rows that also agree in text count as one place and keep and lose the same lines. Texts may be of any length; other
    columns of docs, whatever their names, are not looked at. kept is the lines that stay, joined by newlines, kept_sha256
    its digest. An empty table gives an empty result.
    """
    found = fingerprints(docs, id_col, text_col, window, words)
    repeated = found.groupBy("mark").agg(F.count("*").alias("places")).where("places > 1").select("mark")
    near = salted(found, repeated, ["mark"])
    run = lambda n, i: F.struct(F.slice("lines", i + 1, n).alias("lines"), F.slice("checks", i + 1, n).alias("checks"))
    extended = F.filter(F.transform("lens", lambda n, i: F.struct((F.col("start") + i).alias("start"), run(n, i).alias("run"))), lambda w: F.size(w.run.lines) > 0)
    # Written, so that the texts are not looked through once more for the second use below.
    runs = cut(near.select("doc_id", "text_key", F.explode(extended).alias("w")).select("doc_id", "text_key", "w.*"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "start")
    earliest = runs.groupBy("run").agg(F.min(place).alias("earliest"), F.count("*").alias("times")).where("times > 1").select("run", "earliest")
    again = salted(runs, earliest, ["run"]).where(place > F.col("earliest"))
    gone = again.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", F.size("run.lines").alias("n"))).alias("starts"))
    gone = gone.select(_key("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "starts")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("*", F.xxhash64("text").alias("text_key"))
    joined = rows.join(gone, (_key("doc_id") == F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    lines = joined.select("doc_id", "starts", F.coalesce(F.split(F.col("text"), "\n", -1), F.array().cast("array<string>")).alias("lines"))
    covered = F.flatten(F.transform("starts", lambda w: F.sequence(w.start, w.start + w.n - 1)))
    every = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    left = lines.select("doc_id", "lines", F.when(F.col("starts").isNull(), every).otherwise(F.array_except(every, covered)).alias("left"))
    kept = left.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("left")).cast("bigint").alias("n_removed"), F.array_join(F.transform("left", lambda p: F.get("lines", p)), "\n").alias("kept"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "kept")


#: The same rows in DuckDB, without `kept`.
ORACLE = r"""
WITH s AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS c FROM s),
a AS (
  SELECT *, lead(line, 1) OVER d AS line1, lead(line, 2) OVER d AS line2, lead(c, 1) OVER d AS c1, lead(c, 2) OVER d AS c2
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
w AS (SELECT *, CASE WHEN c >= 10 THEN 1 WHEN c + c1 >= 10 THEN 2 WHEN c + c1 + c2 > 0 THEN 3 END AS n FROM a),
r AS (
  SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, line, CASE WHEN n > 1 THEN line1 END, CASE WHEN n > 2 THEN line2 END ORDER BY doc_id, p) AS nth
  FROM w WHERE n IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (VALUES (0), (1), (2)) v(o) WHERE nth > 1 AND o < n),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
