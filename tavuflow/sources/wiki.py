"""MediaWiki dumps: pages out of (compressed) XML, wikitext to plain text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.functions.text import strip

PAGE_SCHEMA = "title string, revision array<struct<id:bigint,text:string>>, _corrupt_record string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, text (of the last revision, '' if there is none) and _corrupt_record of each page; a page that does not parse has
    only the last.

    The file is cut at the ends of pages, so that bzip2 files too are split among tasks, and each page is parsed by itself: a
    broken one costs no other.
    """
    pieces = spark.read.option("lineSep", "</page>").text(path).withColumn("_at", F.regexp_instr("value", F.lit("<page[\\s>]"))).filter("_at > 0")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    pages = pieces.select(F.from_xml(F.concat(F.expr("substring(value, _at)"), F.lit("</page>")), PAGE_SCHEMA, options).alias("p")).select("p.*")
    last = F.when(F.size("revision") > 0, F.element_at("revision", -1)["text"])
    return pages.select("title", F.coalesce(last, F.lit("")).alias("text"), "_corrupt_record")


def page_counts(pages: DataFrame) -> DataFrame:
    """pages read, skipped (not parsed) and titled."""
    return pages.agg(F.count("*").alias("pages"), F.count("_corrupt_record").alias("skipped"), F.count("title").alias("titled"))


def _balanced(text: str, marks: re.Pattern) -> str:
    """text without the outermost stretches from an opening mark to its closing one; an opening never closed is kept as text.
    Only the marks are looked at."""
    out, depth, begin = [], 0, 0
    for m in marks.finditer(text):
        if m[1]:  # opening
            if depth == 0:
                out.append(text[begin : m.start()])
                begin = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                begin = m.end()
    out.append(text[begin:])
    return "".join(out)


_TEMPLATE, _TABLE = re.compile(r"(\{\{)|\}\}"), re.compile(r"(\{\|)|\|\}")


@F.pandas_udf(T.StringType())
def _drop_nested(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(lambda t: None if t is None else _balanced(_balanced(t, _TEMPLATE), _TABLE))


def clean_wikitext(text: Column) -> Column:
    """Plain text: comments, references, templates, tables, files and categories go; links and styles leave their words.

    Nested templates need a stack, so that step is a vectorised Python function, called only on texts that hold one.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, "(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<(math|gallery|nowiki|timeline)[^>]*>.*?</\\1>", "")
    t = F.when(t.rlike("\\{\\{|\\{\\|"), _drop_nested(t)).otherwise(t)
    for _ in range(2):  # a link may stand in a file's caption
        t = F.regexp_replace(t, "(?i)\\[\\[(?:file|image|category|tiedosto|kuva|luokka|dosya|kategori|fájl|kép|kategória|picha|jamii):(?:[^\\[\\]]|\\[\\[[^\\[\\]]*\\]\\])*\\]\\]", "")
        t = F.regexp_replace(t, "\\[\\[(?:[^\\[\\]|]*\\|)?([^\\[\\]|]*)\\]\\]", "$1")
    t = F.regexp_replace(t, "\\[https?://\\S+ ?([^\\]]*)\\]", "$1")
    t = F.regexp_replace(t, "'{2,}", "")
    t = F.regexp_replace(t, "(?m)^=+ *(.*?) *=+ *$", "$1")
    t = F.regexp_replace(t, "<[^>\\n]{1,200}>", "")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return strip(t)


def extract_articles(spark: SparkSession, path: str) -> DataFrame:
    """Title and Cleaned_Text of each page that parses."""
    pages = read_pages(spark, path).filter("_corrupt_record is null")
    return pages.select(F.col("title").alias("Title"), clean_wikitext(F.col("text")).alias("Cleaned_Text"))
