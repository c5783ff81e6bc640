"""A small front end for streaming SQL: window table functions inside ordinary SQL text."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import windows

_INTERVAL = r"INTERVAL\s+('[^']+'\s+\w+)"
_CALL = re.compile(
    r"TABLE\s*\(\s*(?P<kind>TUMBLE|HOP|CUMULATE|SESSION)\s*\(\s*TABLE\s+(?P<table>[\w.]+)(?:\s+PARTITION\s+BY\s+(?P<keys>[\w`,\s]+?))?\s*,\s*DESCRIPTOR\s*\(\s*`?(?P<ts>\w+)`?\s*\)\s*,\s*"
    + _INTERVAL + rf"(?:\s*,\s*{_INTERVAL})?(?:\s*,\s*{_INTERVAL})?\s*\)\s*\)",
    re.IGNORECASE,
)


def _literal(interval: str | None) -> str | None:
    return None if interval is None else re.sub(r"\s+", " ", interval).upper()


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Runs SQL in which TABLE(TUMBLE | HOP | CUMULATE | SESSION(...)) stands for a table's rows with their windows.

    Each call becomes a temporary view over the matching operator; everything else is Spark's SQL, so Catalyst sees one
    plan. TUMBLE takes (size[, offset]), HOP (slide, size[, offset]), CUMULATE (step, size[, offset]), SESSION (gap).
    """

    def view(m: re.Match) -> str:
        table, ts, kind = spark.table(m["table"]), m["ts"], m["kind"].upper()
        given = [x for x in map(_literal, m.groups()[4:]) if x is not None]
        if kind == "SESSION":
            keys = [k.strip(" `\n") for k in (m["keys"] or "").split(",") if k.strip(" `\n")]
            rows = windows.session(table, ts, given[0], keys)
        else:
            rows = {"TUMBLE": windows.tumble, "HOP": windows.hop, "CUMULATE": windows.cumulate}[kind](table, ts, *given)
        name = f"windows_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(name)
        return name

    return spark.sql(_CALL.sub(view, text))
