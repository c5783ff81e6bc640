"""The scalar functions by their SQL names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import collections as C
from tidemill.functions import numeric as N
from tidemill.functions import predicates as P
from tidemill.functions import strings as S
from tidemill.functions import temporal as T

#: Functions that differ from Spark's of that name, or have none there.
OWN: dict[str, Callable[..., Column]] = {
    "PLUS": N.add, "MINUS": N.subtract, "TIMES": N.multiply, "DIVIDE": N.divide, "FLOAT_DIVIDE": N.float_divide, "DECIMAL_DIVIDE": N.decimal_divide, "MOD": N.mod, "NEGATE": N.negate,
    "NARROW": N.narrow, "DECIMAL_CAST": N.decimal_cast, "TRY_CAST": N.try_cast, "TYPEOF": P.type_name, "COMPARE": P.compare, "IS_DISTINCT": P.is_distinct, "IS_NOT_DISTINCT": P.is_not_distinct,
    "IS_TRUE": P.is_true, "IS_FALSE": P.is_false, "IS_NOT_TRUE": P.is_not_true, "IS_NOT_FALSE": P.is_not_false, "BETWEEN": P.between, "IN": P.is_in, "LIKE": P.like, "STARTSWITH": P.starts_with,
    "ENDSWITH": P.ends_with, "IF": P.if_then, "NULLIF": P.null_if, "CHAR": P.char, "GREATEST": lambda *v: N.extremum(True, *v), "LEAST": lambda *v: N.extremum(False, *v), "ABS": N.absolute,
    "CEIL": N.ceiling, "FLOOR": N.floor, "SIGN": N.sign, "SQRT": N.sqrt, "LN": N.ln, "LOG": N.log, "LOG10": N.log10, "LOG2": N.log2, "TRUNCATE": N.truncate, "INET_NTOA": N.inet_ntoa,
    "INET_ATON": N.inet_aton, "UNHEX": S.unhex, "SHA2": S.sha2, "TO_BASE64": S.to_base64, "FROM_BASE64": S.from_base64, "TRIM": S.trim, "LTRIM": S.ltrim, "RTRIM": S.rtrim, "REPLACE": S.replace,
    "TRANSLATE": S.translate, "ELT": S.elt, "SPLIT": S.split, "SPLIT_INDEX": S.split_index, "POSITION": S.position, "LEFT": S.left, "RIGHT": S.right, "INITCAP": S.initcap, "ASCII": S.ascii_code,
    "CHR": S.chr_of, "HASH_CODE": S.hash_code, "URL_ENCODE": S.url_encode, "URL_DECODE": S.url_decode, "JSON_QUOTE": S.json_quote, "REGEXP_EXTRACT": S.regexp_extract, "COUNT_CHAR": S.count_char,
    "IS_ALPHA": S.is_alpha, "IS_DIGIT": S.is_digit, "IS_DECIMAL": S.is_decimal, "JSON_VALUE": S.json_value, "JSON_EXISTS": S.json_exists, "IS_JSON": S.is_json, "EXTRACT": T.extract, "CLOCK": T.clock,
    "DATE_FORMAT": T.date_format, "TIMESTAMP_PLUS": T.plus, "TIMESTAMP_MINUS": T.minus, "TIMESTAMPDIFF": T.timestamp_diff, "OVERLAPS": T.overlaps, "CONVERT_TZ": T.convert_tz, "ELEMENT_AT": C.element_at,
    "MAP_VALUE": C.map_value, "CARDINALITY": C.cardinality, "ELEMENT": C.element, "ARRAY_CONTAINS": C.contains, "ARRAY_REVERSE": C.reverse, "ARRAY_APPEND": C.append, "ARRAY_PREPEND": C.prepend,
    "ARRAY_CONCAT": C.concat, "ARRAY_POSITION": C.position, "ARRAY_REMOVE": C.remove, "ARRAY_JOIN": C.join, "ARRAY_SORT": C.sort, "ARRAY_SLICE": C.slice_of, "ARRAY_DISTINCT": C.distinct,
    "ARRAY_UNION": C.union, "ARRAY_INTERSECT": C.intersect, "ARRAY_EXCEPT": C.difference,
}

#: Functions that are Spark's own under the same (or the given) name.
SPARK = """coalesce ifnull power:pow exp sin cos tan cot sinh cosh tanh asin acos atan atan2 degrees radians pi e bin hex md5 sha1 char_length lower upper concat concat_ws substring btrim locate instr
repeat reverse url_encode struct array create_map array_min array_max map_keys map_values map_entries round uuid rand lpad rpad overlay str_to_map printf encode decode parse_url regexp regexp_count
regexp_extract_all regexp_instr regexp_substr regexp_replace rlike get_json_object to_json from_json try_parse_json current_date current_timestamp localtimestamp now from_unixtime unix_timestamp
to_date to_timestamp to_timestamp_ltz map_from_arrays map_union:map_concat""".split()

FUNCTIONS: dict[str, Callable[..., Column]] = {name.partition(":")[0].upper(): getattr(F, name.partition(":")[2] or name) for name in SPARK} | OWN
