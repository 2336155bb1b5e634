"""Problem 4: load delimited rows and set apart those that fail, with the reason.

The first reason that holds is given: ``quoting`` (a quote never closed, inside an unquoted field, or followed by something
other than the delimiter), ``columns`` (not as many fields as declared, at the row's own delimiter), ``value``.

Values are judged once for each distinct value of a column: the distinct cells are checked, the invalid ones form a
dictionary with reasons, and that dictionary is joined back to the rows beside the structural checks. Quoting is decided
from the parts between double quotes, without a backtracking pattern, so a very long line is safe.

Defined results: marker lines (empty, starting with ``#``, or a named header) are neither loaded nor failed; a null line is a
row without fields (``columns``); a null delimiter means that the line is one field; a null language has no valid label.
Numbers of more than 18 digits cannot be loaded and count as ``value``. Rows are never merged: repeated rows stay repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavuflow.session import bounded, materialize

# The marker lines.
MARKERS = ("<HEADLINE>", "<BODY>")
# Delimiter names.
DELIMITERS = {"comma": ",", "tab": "\t"}


@dataclass(frozen=True)
class Field:
    """A field of a row. kind: digits (a number), word (any text without U+FFFD), label (valid in the row's group)."""

    name: str
    kind: str


CONLL_FIELDS = (Field("sent_id", "digits"), Field("pos", "digits"), Field("word", "word"), Field("tag", "label"))


def is_marker(line: Column) -> Column:
    return F.coalesce((line == "") | line.startswith("#") | line.isin(*MARKERS), F.lit(False))


def _structure(raw: DataFrame, line: str, delim: str) -> DataFrame:
    """raw with _fields (null if the quoting is broken) for rows that are no markers."""
    mark = F.create_map(*[F.lit(x) for kv in DELIMITERS.items() for x in kv])[F.col(delim)]
    rows = raw.filter(~is_marker(F.col(line))).withColumn("_d", F.coalesce(mark, F.lit("\x00")))
    # With a delimiter at both ends, each part outside quotes is empty (a doubled quote) or has delimiters at both of its ends.
    # No lambda refers to the parts themselves, so that they are not split anew for each element when filters are pushed down.
    padded = F.when(F.col(line).contains('"'), F.split(F.concat("_d", F.col(line), "_d"), '"', -1))
    rows = rows.withColumn("_s", padded)
    sound = (F.size("_s") % 2 == 1) & F.expr("forall(transform(_s, (s, i) -> i % 2 = 1 or s = '' or (startswith(s, _d) and endswith(s, _d))), x -> x)")
    # Inside quotes the delimiter is written as \d, a backslash anywhere as \b; a doubled quote becomes one quote.
    joined = F.expr(
        r"""array_join(transform(_s, (s, i) -> case when i % 2 = 1 then replace(replace(s, '\\', '\\b'), _d, '\\d')
             when s = '' then '"' else replace(s, '\\', '\\b') end), '')"""
    )
    pieces = F.split(joined, F.concat(F.lit("\\Q"), F.col("_d"), F.lit("\\E")), -1)
    quoted = F.transform(pieces, lambda x: F.replace(F.replace(x, F.lit("\\d"), F.col("_d")), F.lit("\\b"), F.lit("\\")))
    quoted = F.slice(quoted, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    plain = F.split(F.col(line), F.concat(F.lit("\\Q"), F.col("_d"), F.lit("\\E")), -1)
    return rows.withColumn("_fields", F.when(F.col(line).isNull(), F.array().cast("array<string>")).when(F.col("_s").isNull(), plain).when(sound, quoted)).drop("_s", "_d")


def _invalid(kind: Column, group: Column, value: Column, labels: DataFrame) -> Column:
    """The reason why a distinct value is invalid, null if it is valid (labels are joined as _known)."""
    return (
        F.when((kind == "digits") & ~value.rlike(r"\A[0-9]+\z"), F.lit("not a number"))
        .when((kind == "digits") & value.cast("decimal(38,0)").isNull() | (kind == "digits") & (F.length(F.regexp_replace(value, "^0+", "")) > 18), F.lit("number too long"))
        .when((kind == "word") & (value == ""), F.lit("empty"))
        .when((kind == "word") & value.contains("�"), F.lit("replacement character"))
        .when((kind == "label") & F.col("_known").isNull(), F.lit("unknown label"))
    )


def load_rows(
    raw: DataFrame,
    labels: DataFrame,
    key: str = "row_id",
    line: str = "line",
    delim: str = "delim",
    group: str = "lang",
    label: str = "tag",
    fields: tuple[Field, ...] = CONLL_FIELDS,
) -> tuple[DataFrame, DataFrame]:
    """(loaded, failed). loaded: raw's other columns and the typed fields; failed: raw's columns, reason and detail.

    labels holds (group, label): the valid labels of each group. A field whose name clashes with a column of raw replaces it.
    """
    names = [f.name for f in fields]
    rows = _structure(raw, line, delim)
    fits = F.coalesce(F.size("_fields") == len(fields), F.lit(False))
    cells = (
        rows.filter(fits)
        .select(F.col(group).alias("_g"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f.kind).alias("kind"), F.col("_fields")[i].alias("v")) for i, f in enumerate(fields)])).alias("c"))
        .select("c.i", "c.kind", "c.v", F.when(F.col("c.kind") == "label", F.col("_g")).alias("g"))
        .distinct()
    )
    known = labels.select(F.col(group).alias("g"), F.col(label).alias("v"), F.lit(True).alias("_known"), F.lit("label").alias("kind")).distinct()
    judged = cells.join(bounded(known), ["kind", "g", "v"], "left")
    wrong = judged.select("i", "g", "v", _invalid(F.col("kind"), F.col("g"), F.col("v"), labels).alias("why")).filter("why is not null")
    wrong = bounded(materialize(wrong, "invalid"))
    for i, f in enumerate(fields):
        own = wrong.filter(F.col("i") == i).select(F.col("g").alias(f"_g{i}"), F.col("v").alias(f"_v{i}"), F.concat(F.lit(f.name + ": "), F.col("why")).alias(f"_why{i}"))
        on = F.when(fits, F.col("_fields")[i]) == F.col(f"_v{i}")
        if f.kind == "label":
            on &= F.col(group).eqNullSafe(F.col(f"_g{i}"))
        rows = rows.join(own, on, "left").drop(f"_g{i}", f"_v{i}")
    detail = F.coalesce(*[F.col(f"_why{i}") for i in range(len(fields))])
    reason = F.when(F.col("_fields").isNull(), "quoting").when(~fits, "columns").when(detail.isNotNull(), "value")
    rows = rows.withColumn("reason", reason)
    kept = [c for c in raw.columns if c not in names and c not in (line, delim)]
    typed = [F.col("_fields")[i].cast("bigint").alias(f.name) if f.kind == "digits" else F.col("_fields")[i].alias(f.name) for i, f in enumerate(fields)]
    loaded = rows.filter("reason is null").select(*kept, *typed)
    failed = rows.filter("reason is not null").select(*[c for c in raw.columns if c not in ("reason", "detail")], "reason", detail.alias("detail"))
    return loaded, failed
