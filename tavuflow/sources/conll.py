"""The CoNLL family: one parser with the rules of each reader as parameters, and writers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavuflow.functions.text import strip, words
from tavuflow.operators.sequences import sentence_ids, sentence_lines
from tavuflow.session import bounded, materialize


@dataclass(frozen=True)
class Rules:
    """How lines become tokens: fields are parted by white space or by sep; rows with another number are left out and do not end
    a sentence; only blank lines do. word and tag are places (-1: the last)."""

    exact: int | None = 2
    least: int = 2
    sep: str | None = None
    word: int = 0
    tag: int = 1
    skip: tuple[str, ...] = ()
    skip_lines: tuple[str, ...] = ()


TAGGER = Rules()
HISTOGRAM = Rules(exact=None, least=2, tag=-1, skip=("<",))
PLUS = Rules(exact=None, least=6, sep="\t", tag=5, skip=("#",))
TABULAR = Rules(exact=None, least=2, sep="\t", skip_lines=("<HEADLINE>", "<BODY>"))


def file_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """src_file, line_no and line. Files are split among tasks: a line's number is its place in its split and the lines of the
    splits before it, of which there is one row each."""
    reader = spark.read.option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path.split(",") if "," in path else path)
    rows = rows.select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\\r\\z", "").alias("line"))
    splits = rows.groupBy("src_file", "_from").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("src_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("src_file", "_from", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(bounded(materialize(splits, "splits")), ["src_file", "_from"]).select("src_file", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def parse_lines(lines: DataFrame, rules: Rules = TAGGER, line: str = "line", part: str = "src_file", order: str = "line_no") -> DataFrame:
    """part, sent_id (from 1), pos (from 0), word and tag."""
    stripped = strip(F.col(line))
    drop = F.lit(False)
    for prefix in rules.skip:
        drop |= stripped.startswith(prefix)
    if rules.skip_lines:
        drop |= stripped.isin(*rules.skip_lines)
    fields = words(F.col(line)) if rules.sep is None else F.split(stripped, rules.sep)
    fits = F.size(fields) == rules.exact if rules.exact is not None else F.size(fields) >= rules.least
    blank = stripped == ""
    rows = lines.select(part, order, blank.alias("_blank"), (fits & ~drop).alias("_fits"), fields.alias("_f")).filter("_blank or _fits")
    pick = lambda i: F.element_at("_f", i + 1 if i >= 0 else i)
    out = sentence_ids(rows, part, order, "_blank")
    return out.select(part, F.col("sent_id").cast("long").alias("sent_id"), "pos", pick(rules.word).alias("word"), pick(rules.tag).alias("tag"))


def read_conll(spark: SparkSession, path: str, rules: Rules = TAGGER, pattern: str | None = None) -> DataFrame:
    return parse_lines(file_lines(spark, path, pattern), rules)


def read_sentence_json(spark: SparkSession, path: str) -> DataFrame:
    """Words of a JSON array of [sentence, metadata]: sent_id, pos and word."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<array<string>>").alias("a"))
    sentences = rows.select(F.posexplode("a").alias("i", "s")).select((F.col("i") + 1).cast("long").alias("sent_id"), F.col("s")[0].alias("sentence"))
    return sentences.select("sent_id", F.posexplode(words(F.col("sentence"))).alias("pos", "word"))


def blocks(tokens: DataFrame, sent: str = "sent_id") -> DataFrame:
    """sent and block, as written to a file."""
    return sentence_lines(tokens, sent, "pos", "word", "tag").orderBy(sent)


def write_conll(tokens: DataFrame, path: str, trailing_blank: bool = True, mode: str = "error") -> None:
    """Sentences parted by blank lines; with trailing_blank one stands after the last, too. Order is kept over the part files."""
    end = "\n" if trailing_blank else ""
    body: Column = F.concat("block", F.lit(end))
    if trailing_blank:
        blocks(tokens).select(body.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)
        return
    last = tokens.agg(F.max("sent_id")).first()[0]
    line = F.when(F.col("sent_id") == F.lit(last), F.col("block")).otherwise(F.concat("block", F.lit("\n")))
    blocks(tokens).select(line.alias("value")).write.mode(mode).text(path)


def overwrite(spark: SparkSession, df: DataFrame, path: str, write) -> None:
    """Replace a path that df itself is read from: write beside it, move the old one aside, the new one in, then delete the old.

    A failed move is an error, and the old one is moved back: at no time is there less than one whole copy.
    """
    staging, aside = (f"{path.rstrip('/')}.{uuid.uuid4().hex}" for _ in range(2))
    write(df, staging)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, aside))
    fs = target.getFileSystem(conf)

    def moved(a, b) -> bool:
        try:
            return fs.rename(a, b)
        except Exception:  # noqa: BLE001 - file systems tell a failed move in either way
            return False

    had = fs.exists(target)
    if had and not moved(target, old):
        raise OSError(f"{path} cannot be moved; the new data are in {staging}")
    if not moved(new, target):
        if had and not moved(old, target):
            raise OSError(f"{path} is now {aside}, the new data are in {staging}")
        raise OSError(f"{staging} cannot be moved to {path}")
    if had:
        fs.delete(old, True)
