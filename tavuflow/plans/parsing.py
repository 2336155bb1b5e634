"""Loading of raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.operators.badrows import load_rows
from tavuflow.operators.sequences import sentence_ids
from tavuflow.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id and reason of each row that does not parse."""
    return load_rows(table(spark, d, "raw_lines"), table(spark, d, "label_set"))[1].select("row_id", "reason").distinct()


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The rows that parse, with their typed fields."""
    loaded = load_rows(table(spark, d, "raw_lines"), table(spark, d, "label_set"))[0]
    return loaded.select("row_id", "lang", "src_file", "line_no", "sent_id", "pos", "word", "tag")


def raw_sentence_ids(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of raw files from blank lines; headers and comments are no lines."""
    rows = table(spark, d, "raw_lines").filter(~F.col("line").isin("<HEADLINE>", "<BODY>") & ~F.col("line").startswith("#"))
    found = sentence_ids(rows.select("row_id", "src_file", "line_no", (F.col("line") == "").alias("blank")), "src_file", "line_no", "blank")
    return found.select("row_id", "src_file", F.col("sent_id").cast("long").alias("sent_no"), F.col("pos").cast("long").alias("pos"))


_FIELD = {"comma": r'"(?:[^"]|"")*"|[^",]*', "tab": r'"(?:[^"]|"")*"|[^"\t]*'}
_ROWS = rf"""
with rows_ as (
  select row_id, lang, src_file, line_no, line, delim, case delim when 'comma' then ',' else chr(9) end as d
  from raw_lines where not (line = '' or starts_with(line, '#') or line in ('<HEADLINE>', '<BODY>'))),
quoted as (
  select *, case delim when 'comma' then regexp_full_match(line, '(?:{_FIELD["comma"]})(?:,(?:{_FIELD["comma"]}))*', 's')
            else regexp_full_match(line, '(?:{_FIELD["tab"]})(?:\t(?:{_FIELD["tab"]}))*', 's') end as sound from rows_),
fields as (
  select *, case when sound then list_transform(regexp_extract_all(d || line, case delim when 'comma' then ',({_FIELD["comma"]})' else '\t({_FIELD["tab"]})' end, 1),
            lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) end as f from quoted),
judged as (
  select *, case when not sound then 'quoting' when len(f) <> 4 then 'columns'
    when not regexp_full_match(f[1], '[0-9]+') or not regexp_full_match(f[2], '[0-9]+') or f[3] = '' or contains(f[3], chr(65533))
      or not exists (select 1 from label_set s where s.lang = fields.lang and s.tag = fields.f[4]) then 'value' end as reason
  from fields)
"""

QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded, "raw_sentence_ids": raw_sentence_ids}
SQL = {
    "p4_found": _ROWS + "select row_id, reason from judged where reason is not null",
    "p4_loaded": _ROWS + "select row_id, lang, src_file, line_no, f[1]::bigint as sent_id, f[2]::bigint as pos, f[3] as word, f[4] as tag from judged where reason is null",
    "raw_sentence_ids": """
        with l as (select row_id, src_file, line_no, line = '' as blank from raw_lines where line not in ('<HEADLINE>', '<BODY>') and not starts_with(line, '#')),
        r as (select *, sum(blank::int) over (partition by src_file order by line_no rows unbounded preceding) as run from l)
        select row_id, src_file, dense_rank() over (partition by src_file order by run) as sent_no,
               row_number() over (partition by src_file, run order by line_no) - 1 as pos from r where not blank""",
}
