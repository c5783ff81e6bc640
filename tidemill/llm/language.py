"""Language identification with a string kernel.

The kernel of two texts is the number of letter n-grams (of one to three letters, of any script) present in both, over the
geometric mean of the numbers present in each. Nystroem landmarks give features, one-versus-rest kernel ridge regression
gives weights for each language, and batches of texts are scored by one product of their presence with the landmarks'
n-grams and those weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import chunks

UNDETERMINED = "und"
#: n-grams of code points are hashed to so many bits.
BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)
#: n-grams of texts multiplied at once, about.
BATCH = 1 << 18


@dataclass(frozen=True)
class Parameters:
    """The bounds of the labelled sample and of the model: nothing else looks at a part of the data.

    Every labelled language is learned: from `rows` rows in equal shares, but at most `most` and at least `fewest` each.
    """

    rows: int = 25_600
    most: int = 400
    fewest: int = 40
    longest: int = 1 << 16
    landmarks: int = 256
    landmarks_each: int = 4
    ridge: float = 1e-2

    def each(self, languages: int) -> int:
        return min(self.most, max(self.fewest, self.rows // max(1, languages)))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # the landmarks' n-grams
    weights: np.ndarray  # n-gram x language: the landmarks' n-grams times the weights of the landmarks


@cache
def letters() -> np.ndarray:
    """Each code point that is a letter, as itself; 0 stands for everything else."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def ngrams(text: str) -> np.ndarray:
    """The hashed n-grams of a whole text, repeats included; runs of other characters than letters count as one."""
    s = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))].astype(np.uint64) if len(s) else s.astype(np.uint64)
    out, code = [], np.zeros(len(s) + 1, np.uint64)
    for n in (1, 2, 3):
        code = (code[:-1] + s[n - 1 :] + np.uint64(n)) * MIX
        code ^= code >> np.uint64(31)
        out.append(((code * MIX) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


class Presence:
    """Which n-grams of a vocabulary are in texts, and the number of different n-grams there at all."""

    def __init__(self, vocabulary: np.ndarray):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[vocabulary] = np.arange(len(vocabulary))
        self.last = np.zeros(1 << BITS, np.int32)

    def different(self, found: np.ndarray) -> np.ndarray:
        self.last[found] = np.arange(len(found))
        return found[self.last[found] == np.arange(len(found))]

    def products(self, texts: Iterable[str], weights: np.ndarray) -> np.ndarray:
        """For each text the sum of its n-grams' rows of weights, over the root of the number of its n-grams."""
        out: list[np.ndarray] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> None:
            ends = np.cumsum([0, *map(len, held)])
            rows = np.concatenate((weights[np.concatenate(held)], np.zeros((1, weights.shape[1]), weights.dtype)))
            sums = np.add.reduceat(rows, ends[:-1], axis=0)
            sums[np.diff(ends) == 0] = 0
            out.append(sums / np.sqrt(np.maximum(1, sizes))[:, None])
            held.clear()
            sizes.clear()

        for text in texts:
            found = self.different(ngrams(text))
            places = self.place[found]
            held.append(places[places >= 0])
            sizes.append(len(found))
            if sum(map(len, held)) * weights.shape[1] >= 8 * BATCH:
                flush()
        if held:
            flush()
        return np.concatenate(out) if out else np.zeros((0, weights.shape[1]))


def train(texts: list[str], langs: list[str], parameters: Parameters = Parameters()) -> Model:
    """Fits the model to labelled texts; the first texts of each language, in turn, are the landmarks."""
    languages = sorted(set(langs))
    by_language = [[t for t, x in zip(texts, langs, strict=True) if x == lang] for lang in languages]
    turns = [ts[i] for i in range(max(map(len, by_language), default=0)) for ts in by_language if i < len(ts)]
    grams = [np.unique(ngrams(t)) for t in turns[: max(parameters.landmarks, parameters.landmarks_each * len(languages))]]
    if not grams:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    vocabulary = np.unique(np.concatenate(grams))
    columns = np.zeros((len(vocabulary), len(grams)), np.float32)
    for k, found in enumerate(grams):
        columns[np.searchsorted(vocabulary, found), k] = 1 / np.sqrt(max(1, len(found)))
    values, vectors = np.linalg.eigh((columns.T @ columns).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    features = Presence(vocabulary).products(texts, columns).astype(np.float64) @ root
    goal = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
    solved = np.linalg.solve(features.T @ features + parameters.ridge * len(texts) * np.eye(len(root)), features.T @ goal)
    return Model(languages, vocabulary, columns @ (root @ solved).astype(np.float32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def score(model: Model, presence: Presence, texts: list[str]) -> list[tuple[str, float]]:
    """(language, score from 0 to 1) of each text: the language of the highest regression value, scaled from [-1, 1]."""
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model.languages else []
    if known:
        values = presence.products([texts[k] for k in known], model.weights)
        for k, best, top in zip(known, values.argmax(axis=1).tolist(), values.max(axis=1).tolist(), strict=True):
            out[k] = (model.languages[best], min(1.0, max(0.0, (top + 1) / 2)))
    return out


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not null and holds a letter."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text_col):
            yield part.filter(pa.array([has_letter((t or b"").decode("utf-8", "replace")) for t in texts], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def held_out(id_col: str | Column) -> Column:
    """Whether a row is never learned from: crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parameters: Parameters = Parameters()) -> list[tuple[str, str]]:
    """(text, language) of the rows to learn from: of each language those with the smallest hashed ids, as many as
    Parameters.each allows, of rows that are not held out, have a language and a text of 1 to `longest` characters.

    Other rows only count towards their language's number, which gives the hash below which enough rows are to be expected.
    """
    labelled = docs.where(~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.length(text_col).between(1, parameters.longest))
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(4)).alias("draw"), F.col(text_col).alias("text"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = parameters.each(len(counts))
    # Half as many more rows as wanted are to be expected below the hash, so that no task sorts a language.
    below = {lang: min((1 << 64) - 1, 3 * (each + 20) * (1 << 63) // n) - (1 << 63) for lang, n in counts.items()}
    # As an Arrow table, which needs no Python workers of its own.
    limits = docs.sparkSession.createDataFrame(pa.table([pa.array(list(below), pa.string()), pa.array(list(below.values()), pa.int64())], ["lang", "below"]))
    near = labelled.join(F.broadcast(limits), "lang").where("draw <= below").drop("below")
    by_language: dict[str, list[tuple[int, str]]] = {}
    for r in near.toLocalIterator():
        by_language.setdefault(r.lang, []).append((r.draw, r.text))
    chosen = sorted((draw, lang, text) for lang, rows in by_language.items() for draw, text in sorted(rows)[:each])
    return [(text, lang) for _, lang, text in chosen]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parameters: Parameters = Parameters()) -> Model:
    """Learns every labelled language from sample()."""
    chosen = sample(docs, id_col, text_col, lang_col, parameters)
    return train([t for t, _ in chosen], [x for _, x in chosen], parameters)


def predicted(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns more: the predicted language and its score. Only the text is looked at.

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learned. Of equally
    likely languages the first by code point is given. A column of docs with one of the two names is replaced. Repeated
    rows each stay, texts may be of any length, an empty table stays empty.
    """
    docs = docs.drop(*(n for n in names if n != text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        presence = Presence(model.vocabulary)
        for part, texts in chunks(batches, text_col):
            found = score(model, presence, [(t or b"").decode("utf-8", "replace") for t in texts])
            columns = [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *names])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(scan, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parameters: Parameters = Parameters()) -> DataFrame:
    """One row for every row of docs: doc_id, held_out, lang_pred, score, by a model learned from rows not held out.

    A null id counts as the empty text in held_out; null texts and the rest as in predicted(). Repeated rows each stay and
    each count as rows to learn from. Other columns of docs, whatever their names, are not looked at.
    """
    model = fit(docs, id_col, text_col, lang_col, parameters)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predicted(rows, model).drop("text")
