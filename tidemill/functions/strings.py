"""Text, binary, URL, JSON and regular-expression functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*values: Column) -> Column:
    return F.concat(*values)


def trim(x: Column, characters: str = " ") -> Column:
    return F.btrim(x, F.lit(characters))


def ltrim(x: Column, characters: str = " ") -> Column:
    return F.ltrim(x, F.lit(characters))


def rtrim(x: Column, characters: str = " ") -> Column:
    return F.rtrim(x, F.lit(characters))


def replace(x: Column, search: Column, by: Column) -> Column:
    return F.replace(x, search, by)


def translate(x: Column, source: str, target: str | None) -> Column:
    """TRANSLATE; a NULL target deletes."""
    return F.translate(x, source, target or "")


def elt(i: Column, *values: Column) -> Column:
    """The i-th value, NULL out of range."""
    return F.get(F.array(*values), i.cast("int") - 1)


def split(x: Column, delimiter: str) -> Column:
    """SPLIT at a literal delimiter, empty parts kept."""
    return F.split(x, re.escape(delimiter), -1) if delimiter else F.split(x, "", -1)


def split_index(x: Column, delimiter: str, index: int) -> Column:
    """The part at a 0-based index; NULL for an empty text, a negative index, or beyond the parts."""
    return F.get(split(F.nullif(x, F.lit("")), delimiter), F.lit(index))


def position(needle: Column, x: Column) -> Column:
    return F.call_function("locate", needle, x)


def left(x: Column, n: Column) -> Column:
    return F.left(x, n)


def right(x: Column, n: Column) -> Column:
    return F.right(x, n)


def initcap(x: Column) -> Column:
    """Upper case for the first character of each run of ASCII letters and digits, lower case for the others."""
    upper = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(x, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(upper(F.left(w, F.lit(1))), lower(F.substring(w, 2, 1 << 30)))), "")


def ascii_code(x: Column) -> Column:
    """The first UTF-8 byte as a signed number; 0 for the empty text."""
    byte = F.conv(F.substring(F.hex(x), 1, 2), 16, 10).cast("int")
    return F.when(x == "", F.lit(0)).otherwise(F.when(byte > 127, byte - 256).otherwise(byte))


def chr_of(n: Column) -> Column:
    return F.chr(n)


def hash_code(x: Column) -> Column:
    """The absolute value of the 31-polynomial hash over UTF-16 units, wrapped to 32 bits; the smallest stays itself."""
    encoded = F.hex(F.encode(x, "UTF-16BE"))
    units = F.transform(F.filter(F.regexp_extract_all(encoded, F.lit("(.{4})"), F.lit(1)), lambda u: u != ""), lambda u: F.conv(u, 16, 10).cast("bigint"))
    wrapped = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: F.pmod(h * 31 + u + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    return F.when(x.isNotNull(), F.when(wrapped == -(1 << 31), wrapped).otherwise(F.abs(wrapped)).cast("int"))


def unhex(x: Column) -> Column:
    """UNHEX; of an odd number of digits the first must be one but counts as a zero byte; other characters give NULL."""
    good = x.rlike("^[0-9A-Fa-f]*$")
    return F.when(good, F.when(F.length(x) % 2 == 0, F.unhex(x)).otherwise(F.unhex(F.concat(F.lit("00"), F.substring(x, 2, 1 << 30)))))


def sha2(x: Column, bits: Column) -> Column:
    """SHA2 with a length from a column; other lengths than 224, 256, 384 and 512 raise."""
    by = F.when(bits == 224, F.sha2(x, 224)).when(bits == 256, F.sha2(x, 256)).when(bits == 384, F.sha2(x, 384)).when(bits == 512, F.sha2(x, 512))
    return by.when(bits.isNull() | x.isNull(), None).otherwise(F.raise_error(F.lit("unsupported digest length")).cast("string"))


def to_base64(x: Column) -> Column:
    """Unwrapped base64."""
    return F.regexp_replace(F.base64(x), "[\r\n]", "")


def from_base64(x: Column) -> Column:
    return F.unbase64(x)


def url_encode(x: Column) -> Column:
    return F.url_encode(x)


def url_decode(x: Column) -> Column:
    """URL_DECODE; malformed escapes give NULL."""
    return F.try_url_decode(x)


def json_quote(x: Column) -> Column:
    """A JSON string literal in ASCII: other characters become \\uXXXX by UTF-16 unit."""
    plain = F.concat_ws("", F.lit('"'), F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), _escaped), ""), F.lit('"'))
    return F.when(x.isNotNull(), plain)


def _escaped(c: Column) -> Column:
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out = None
    for raw, text in short.items():
        out = F.when(c == raw, F.lit(text)) if out is None else out.when(c == raw, F.lit(text))
    units = F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.concat(F.lit("\\u"), F.lower(u))), "")
    return out.when(c.rlike(r"^[\x20-\x7E]$"), c).otherwise(units)


def regexp_extract(x: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; NULL without a match."""
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(0))


def count_char(x: Column, c: str) -> Column:
    """Occurrences of a character."""
    return (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("bigint")


def is_alpha(x: Column) -> Column:
    return x.rlike(r"^\p{L}+$")


def is_digit(x: Column) -> Column:
    return x.rlike(r"^\p{Nd}+$")


def is_decimal(x: Column) -> Column:
    return x.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")


def json_value(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def json_exists(x: Column, path: str) -> Column:
    return F.get_json_object(x, path).isNotNull()


def is_json(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull())
