"""Personal data: base patterns, and candidates judged by boosted trees; DataFrame functions only.

Generators with high recall propose spans that may overlap. Trees trained on seeded, generated examples score a span's
format and its context; a kind's calibrated threshold selects redactions. Base spans always stay.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.boosting import Boosted, boost, threshold
from tidemill.llm.common import running_sums

#: The base patterns. A match starts where a run of its characters starts (or a match has just ended), so
#: that a long run is read once; the rest is as in the plain pattern.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"

#: The generators of further candidates, in order of precedence.
GENERATORS = (
    ("mailbox", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,12}(?![A-Za-z])"),
    ("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"),
    ("number", r"(?<![0-9+])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){7,18}(?![ -]?[0-9])"),
    ("line", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
CONTEXT = 32
FOUND = "array<struct<s:int,e:int,v:string,before:string,after:string>>"
#: The number of features of a candidate.
FEATURES = 18
#: A kind's share of right spans among those chosen from the generated examples held back.
PRECISION = 0.95


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a text column, with code-point offsets (end exclusive) and context."""
    p, one = _text(pattern), "get(x.p, i)"
    before = running_sums("length")
    item = f"named_struct('s', get(before, i) + length({one}), 'e', get(before, i) + length({one}) + length(m), 'v', m, 'before', right({one}, {CONTEXT}), 'after', left(get(x.p, i + 1), 4))"
    lengths = f"transform(array(transform(x.m, (m, i) -> length({one}) + length(m))), length -> transform(array({before}), before -> transform(x.m, (m, i) -> {item}))[0])[0]"
    walked = f"transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'p', split({text}, {p}, -1))), x -> {lengths})[0]"
    return F.expr(f"CASE WHEN rlike({text}, {p}) THEN CAST({walked} AS {FOUND}) ELSE CAST(array() AS {FOUND}) END")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(IP_PARTS)
    if kind == "card":
        return F.call_function("luhn_check", digits(v))
    if kind == "phone":
        return F.length(digits(v)).between(10, 15)
    return F.lit(True)


def features(c: str, kind: int) -> str:
    """The format and context of a candidate, as an array of doubles, in SQL."""
    v, before, lower = f"{c}.v", f"{c}.before", f"lower({c}.before)"
    n, d = f"length({v})", f"length(regexp_replace({v}, '[^0-9]', ''))"
    letters = f"length(regexp_replace({v}, '[^A-Za-z]', ''))"
    like = lambda x, pattern: f"rlike({x}, {_text(pattern)})"
    out = [
        f"{kind}", n, d, letters, f"{n} - {d} - {letters}", f"size(array_distinct(split({v}, '')))", f"luhn_check(regexp_replace({v}, '[^0-9]', ''))",
        like(v, "^[0-9A-Fa-f]+$"), like(v, "[0-9][A-Za-z]|[A-Za-z][0-9]"), f"length(regexp_replace({v}, '[^A-Z]', ''))", like(before, """["']$"""), like(before, """[=:]\\s*["']?$"""),
        like(lower, "token|secret|key|passw|auth|credential"), like(lower, "card|visa|payment|karte|carte|tarjeta|account|konto|iban|ssn|passport"), like(lower, "phone|tel|call|fax|mobile|cell"),
        like(lower, "mail|contact|write|reach"), like(lower, "order|item|version|isbn|page|id\\b|build|commit|sha|hash"), like(f"{c}.after", """^["']"""),
    ]
    return "array(" + ", ".join(f"coalesce(CAST({x} AS DOUBLE), 0.0D)" for x in out) + ")"


def matches(rows: DataFrame, patterns: Iterable[tuple[str, str]], *kept: str) -> DataFrame:
    """The columns of rows that are kept, and one of found() for each pattern of their text."""
    return rows.select(*kept, *(found("text", p).alias(name) for name, p in patterns))


def proposals() -> dict[str, Column]:
    """The candidates of each generator, found in columns of their names, with their features."""
    return {name: F.expr(f"transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'f', {features('c', k)}))") for k, (name, _) in enumerate(GENERATORS)}


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: dict[str, float]


def examples(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """n generated texts (text, start, end, label), each with one span that is private (1) or only looks like it (0)."""
    r = random.Random(seed)
    filler = lambda k: " ".join("".join(r.choice("aeiounrstld") for _ in range(r.randint(2, 9))) for _ in range(k))
    some = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    hexes, alnum, dec = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    group = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    makers = [
        (1, lambda: (r.choice(['token = "', "api_key: ", "secret=", "Authorization: ", 'password = "']), some(r.choice([20, 32, 40, 64]), r.choice([hexes, alnum])))),
        (1, lambda: (r.choice(["", "key ", "= \""]), some(r.choice([32, 40]), hexes))),
        (0, lambda: (r.choice(["", "see ", "/"]), some(r.randint(16, 60), "abcdefghijklmnopqrstuvwxyz"))),
        (0, lambda: (r.choice(["", "the "]), "-".join(some(r.randint(3, 8), "abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 6))))),
        (0, lambda: (r.choice(["commit ", "sha ", "hash "]), some(40, hexes))),
        (0, lambda: ("", r.choice("-_=") * r.randint(16, 60))),
        (1, lambda: (r.choice(["card ", "Visa: ", "account ", "IBAN ", "", ""]), group(some(16, dec), r.choice(["", " ", "-"])))),
        (1, lambda: (r.choice(["SSN ", "ssn: "]), "-".join((some(3, dec), some(2, dec), some(4, dec))))),
        (0, lambda: (r.choice(["order ", "item ", "ISBN ", "id ", "page ", ""]), some(r.randint(8, 13), dec))),
        (0, lambda: (r.choice(["", "on ", "from "]), f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}")),
        (1, lambda: (r.choice(["call ", "tel. ", "phone: ", "", "fax "]), r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(some(3, dec), some(3, dec), some(4, dec)))),
        (1, lambda: (r.choice(["mail ", "write ", "contact ", ""]), f"{some(6, alnum.lower())}{r.choice([' (at) ', '[at]', ' at '])}{some(6, hexes)}{r.choice([' dot ', '[dot]', '.'])}{r.choice(['com', 'org', 'net'])}")),
        (0, lambda: (r.choice(["we meet ", "", "sold "]), f"{some(5, 'abcdefgh')} at {some(5, 'aeioustr')}. {some(6, 'aeioustr')}")),
    ]
    out = []
    for i in range(n):
        label, make = makers[i % len(makers)]
        lead, span = make()
        head = f"{filler(r.randint(0, 6))} {lead}"
        out.append((f"{head}{span}{chr(34) if chr(34) in lead else ''} {filler(r.randint(0, 5))}", len(head), len(head) + len(span), label))
    return out


def train(spark: SparkSession, n: int = 2600, seed: int = 7) -> Model:
    """Learns from n generated examples, a bound that does not depend on any table."""
    table = spark.createDataFrame(examples(n, seed), "text string, a int, b int, label int").coalesce(1)
    each = F.explode(F.concat(*proposals().values()))
    rows = matches(table, GENERATORS, "a", "b", "label").select(each.alias("c"), "a", "b", "label").where("c.s < b and a < c.e").select("c.f", "label").collect()
    x, y = np.array([r.f for r in rows]), np.array([float(r.label) for r in rows])
    trees = boost(x, y)
    held = np.arange(len(y)) % 3 == 2
    p = trees.probability(x)
    return Model(trees, {name: max(0.5, threshold(p[held & (x[:, 0] == k)], y[held & (x[:, 0] == k)], PRECISION)) for k, (name, _) in enumerate(GENERATORS)})


SPAN = "array<struct<s:int,k:int,e:int,p:double>>"


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, base, extra) for every row of docs: arrays of spans (s, k, e, p), sorted; k numbers the kinds.

    base: matches of the base patterns that pass their test; a kind's matches never overlap, those of two kinds may. extra:
    candidates that reach their kind's threshold and overlap neither a base span nor a likelier candidate (ties: the
    generator named first). The steps are in proportion to a text's matches, but for the orders and the running totals
    (see common.running). A null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))

    def span(k: int, p: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda c: F.struct(c["s"].alias("s"), F.lit(k).alias("k"), c["e"].alias("e"), p(c).alias("p"))

    def passes(name: str) -> Callable[[Column], Column]:
        return lambda c: valid(name, c["v"])

    def likely(name: str) -> Callable[[Column], Column]:
        return lambda c: c["p"] >= model.thresholds[name]

    base = [F.transform(F.filter(name, passes(name)), span(k, lambda _: F.lit(1.0))).cast(SPAN) for k, (name, _) in enumerate(BASE)]
    scored = {}
    for k, (name, candidates) in enumerate(proposals().items()):
        judged = F.expr(f"transform({name}_f, c -> named_struct('s', c.s, 'k', {len(BASE) + k}, 'e', c.e, 'p', {model.trees.sql('c.f')}))")
        scored[name] = (candidates.alias(f"{name}_f"), F.filter(judged, likely(name)).cast(SPAN).alias(name))
    out = matches(rows, (*BASE, *GENERATORS), "doc_id").select("doc_id", F.sort_array(F.concat(*base)).alias("base"), *(c for c, _ in scored.values())).select("doc_id", "base", *(c for _, c in scored.values()))
    out = out.select("doc_id", "base", *(F.expr(f"CASE WHEN size({k}) > 0 AND size(base) > 0 THEN {free(k, 'base')} ELSE {k} END").alias(k) for k in scored))
    # Each step compares every kind with all candidates of one other, whether or not those go themselves.
    names = list(scored)
    out = out.select("*", *(F.col(k).alias(f"{k}_kept") for k in names))
    for turn in range(1, len(names)):
        others = [names[(i + turn) % len(names)] for i in range(len(names))]
        out = out.select("doc_id", "base", *names, *(F.expr(f"CASE WHEN size({k}_kept) > 0 AND size({other}) > 0 THEN {unlikelier(f'{k}_kept', other)} ELSE {k}_kept END").alias(f"{k}_kept") for k, other in zip(names, others, strict=True)))
    return out.select("doc_id", "base", F.sort_array(F.concat(*(f"{k}_kept" for k in names))).alias("extra"))


def below(points: str, marks: str) -> str:
    """For each number of a rising array, how many of the marks are smaller: its place among both less that among its own."""
    events = f"sort_array(concat(transform({points}, p -> named_struct('at', p, 'mark', 0)), transform({marks}, m -> named_struct('at', m, 'mark', 1))))"
    return f"transform(filter(transform({events}, (x, j) -> named_struct('mark', x.mark, 'j', j)), x -> x.mark = 0), (x, i) -> x.j - i)"


def _bounded(candidates: str, spans: str) -> str:
    """Rows (c, low, high): a candidate, how many spans end at or before its start and how many start before its end."""
    low = below(f"transform({candidates}, c -> c.s + 1)", f"transform({spans}, x -> x.e)")
    high = below(f"transform({candidates}, c -> c.e)", f"transform({spans}, x -> x.s)")
    return f"zip_with({candidates}, zip_with({low}, {high}, (l, h) -> named_struct('low', l, 'high', h)), (c, b) -> named_struct('c', c, 'low', b.low, 'high', b.high))"


def free(candidates: str, spans: str) -> str:
    """The candidates of a kind that no span overlaps: as many end before them as start before their end."""
    return f"transform(filter({_bounded(candidates, spans)}, x -> x.low = x.high), x -> x.c)"


def unlikelier(candidates: str, others: str) -> str:
    """The candidates of a kind less those that overlap a likelier one of another kind (ties: the smaller k).

    Candidates of one kind never overlap, so those that overlap a given one stand together in the order of starts, and two
    kinds have fewer overlapping pairs than candidates.
    """
    ahead = "b.p > x.c.p OR (b.p = x.c.p AND b.k < x.c.k)"
    return f"transform(filter({_bounded(candidates, others)}, x -> NOT exists(slice({others}, x.low + 1, x.high - x.low), b -> {ahead})), x -> x.c)"


def described(found_spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    names = F.array(*(F.lit(n) for n, _ in (*BASE, *GENERATORS)))
    return F.array_join(F.transform(found_spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"], c["e"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row for every row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Offsets count code points, ends are exclusive, spans are sorted by start, then by kind in the order email, ip, card,
    phone and the generators'. A null text counts as empty; a text without spans has the digest of the empty text. Texts of
    any length are read whole, as are domains and secrets. Repeated rows each stay, and other columns of docs, whatever
    their names, are not looked at. An empty table gives an empty result.
    """
    model = model or train(docs.sparkSession)
    rows = spans(docs, model, id_col, text_col)

    def of_kind(k: int) -> Callable[[Column], Column]:
        return lambda c: c["k"] == k

    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{name}") for k, (name, _) in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.sort_array(F.concat("base", "extra"))).alias("spans"))
