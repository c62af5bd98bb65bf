"""Estimates as lines of text, one metric each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import StreamSpec

METRIC, LIMIT_METRIC = "cardinality_estimate", "cardinality_group_limit"


#: Escapes of a letter; other characters that can't be printed are written as their code.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v"))
UNPRINTED = r"[\p{C}\p{Z}&&[^ ]]"


def _code(c: Column) -> Column:
    digits = lambda n: F.lpad(F.lower(F.hex(F.ascii(c))), n, "0")
    code = F.when(F.ascii(c) < 0x80, F.concat(F.lit("\\x"), digits(2))).when(F.ascii(c) < 0x10000, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))
    return F.when(c.rlike(UNPRINTED), code).otherwise(c)


def quoted(value: Column) -> Column:
    """A value in quotes: backslash, quote, control characters and all that can't be printed are escaped."""
    for raw, safe in ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(safe))
    value = F.when(value.rlike(UNPRINTED), F.array_join(F.transform(F.split(value, ""), _code), "")).otherwise(value)
    return F.concat(F.lit('"'), value, F.lit('"'))


def _quote(text: str) -> str:
    for raw, safe in ESCAPES:
        text = text.replace(raw, safe)
    shown = lambda c: c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 0x80 else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}"
    return '"' + "".join(map(shown, text)) + '"'


def by_label(key: str) -> str:
    """The label that holds the value of a key; the name of the metric keeps its own underscores only."""
    return "by__name__" if key == "__name__" else f"by_{key}"


def _head(spec: StreamSpec) -> str:
    static = "".join(f",{k}={_quote(v)}" for k, v in sorted(spec.labels.items()))
    return f"{METRIC}{{interval={_quote(spec.interval_text)}{static},group_by_keys="


def lines(counts: DataFrame, spec: StreamSpec, rejected: int | DataFrame = 0, limit_metric: str = LIMIT_METRIC) -> DataFrame:
    """line: the estimates (key, value) of one stream; grouped streams end with a summary, which counts ``rejected`` groups too (a
    number, or rows), and a limit line, whose metric can be named."""
    text = F.col("value").cast("string")
    if not spec.group_by:
        return counts.select(F.concat(F.lit(_head(spec) + '"__global__"} '), text).alias("line"))
    by = F.concat(*[F.concat(F.lit(f",{by_label(k)}="), quoted(F.get("key", F.lit(i)))) for i, k in enumerate(spec.group_by)])
    keys = _quote(spec.keys_text)
    each = counts.select(F.concat(F.lit(f"{_head(spec)}{keys},group_by_values="), quoted(F.array_join("key", ",")), by, F.lit("} "), text).alias("line"))
    if isinstance(rejected, DataFrame):
        total = counts.select(F.lit(1)).unionAll(rejected.select(F.lit(1))).agg(F.count("*").alias("n"))
    else:
        total = counts.agg((F.count("*") + rejected).alias("n"))
    total = total.select(F.concat(F.lit(f'{_head(spec)}"__group__",group_by_values={keys}}} '), F.col("n").cast("string")).alias("line"))
    limit = counts.sparkSession.range(1).select(F.lit(f'{limit_metric}{{interval={_quote(spec.interval_text)},group_by_keys="__group__",group_by_values={keys}}} {spec.group_limit}').alias("line"))
    return each.unionAll(total).unionAll(limit)
