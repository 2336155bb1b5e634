"""Result files of runs: reports of four generations of JSON, delta tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.operators.metrics import NO_LABELS

DELTA_SCHEMA = "Entity string, `Precision Change` double, `Recall Change` double, `F1 Change` double"
# Fixed value: where a file's name and folder tell language, run, strategy and task.
NAME_PATTERN = r"([^/ %]+)(?: |%20)Run(?: |%20)(\d+)/[^/]*/[^/]*?_([^_/]+)_(POS|NER)_results\.json$"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """lang, run, strategy, task and body (variant) of each result file."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_results.json").text(path).select(F.col("_metadata.file_path").alias("f"), F.try_parse_json("value").alias("body"))
    part = lambda i: F.regexp_extract("f", NAME_PATTERN, i)
    return rows.select(part(1).alias("lang"), part(2).cast("int").alias("run"), part(3).alias("strategy"), part(4).alias("task"), "body").filter("body is not null")


def reports(results: DataFrame) -> DataFrame:
    """One row for each label of each report; averages and scalars among the labels are left out."""
    results.createOrReplaceTempView("_results")
    flat = results.sparkSession.sql(
        """select lang, strategy, run, task, v.key as label, try_variant_get(v.value, '$.precision', 'double') as precision,
             try_variant_get(v.value, '$.recall', 'double') as recall, try_variant_get(v.value, '$["f1-score"]', 'double') as f1,
             cast(try_variant_get(v.value, '$.support', 'double') as bigint) as support
           from _results, lateral variant_explode(variant_get(body, '$.classification_report', 'variant')) v"""
    )
    return flat.filter(~F.col("label").isin(*NO_LABELS))


def run_stats(results: DataFrame) -> DataFrame:
    """Measures of each run; what a generation did not record is null."""
    get = lambda p, t: F.try_variant_get("body", f"$.{p}", t)
    return results.select(
        "lang", "strategy", "run", "task",
        F.coalesce(get("average_accuracy", "double"), get("accuracy", "double")).alias("accuracy"),
        get("average_sentence_accuracy", "double").alias("sentence_accuracy"),
        get("training_duration_seconds", "double").alias("train_seconds"),
        F.coalesce(get("average_epochs", "double"), get("epochs", "double")).cast("long").alias("epochs"),
    )


def confusions(results: DataFrame) -> DataFrame:
    """lang, strategy, run, true_label, pred_label and n of the generations that hold a matrix."""
    rows = results.select("lang", "strategy", "run", F.try_variant_get("body", "$.confusion_matrix", "array<array<bigint>>").alias("m"), F.try_variant_get("body", "$.labels", "array<string>").alias("l")).filter("m is not null")
    lines = rows.select("lang", "strategy", "run", "l", F.posexplode("m").alias("i", "row"))
    cells = lines.select("lang", "strategy", "run", "l", "i", F.posexplode("row").alias("j", "n"))
    return cells.select("lang", "strategy", "run", F.col("l")[F.col("i")].alias("true_label"), F.col("l")[F.col("j")].alias("pred_label"), "n")


def result_json(report: DataFrame, by: list[str]) -> DataFrame:
    """by and json: a report as the file form, labels to measures."""
    entry = F.struct("label", F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support").alias("m"))
    return report.groupBy(*by).agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("classification_report"))).alias("json"))


def run_json(report: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """by and json: a report with the measures of its run (accuracy, sentence_accuracy, train_seconds, epochs) and its labels."""
    entry = F.struct("label", F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support").alias("m"))
    rows = report.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("classification_report"), F.array_sort(F.collect_set("label")).alias("labels"))
    measures = [F.col("accuracy").alias("average_accuracy"), F.col("sentence_accuracy").alias("average_sentence_accuracy"), F.col("train_seconds").alias("training_duration_seconds"), F.col("epochs").alias("average_epochs")]
    return rows.join(stats, by).select(*by, F.to_json(F.struct(*measures, "classification_report", "labels")).alias("json"))


def write_results(reports_: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """A result file for each language, strategy, run and task, in the folders of the file form, with the measures of the run if
    they are given. Runs are few: their files are written one by one from the driver, on any file system."""
    by = ["lang", "strategy", "run", "task"]
    rows = result_json(reports_, by) if stats is None else run_json(reports_, stats, by)
    spark = reports_.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in rows.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{r['lang']} Run {r['run']}/{r['lang']} Evaluation/{r['lang']}_{r['strategy']}_{r['task']}_results.json")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(r["json"].encode()))
        out.close()


def write_delta_tables(deltas: DataFrame, path: str, mode: str = "error") -> None:
    """Entity and changes with a header, in folders by language, strategy and run."""
    rows = deltas.select(
        F.col("label").alias("Entity"), F.col("precision_change").alias("Precision Change"), F.col("recall_change").alias("Recall Change"), F.col("f1_change").alias("F1 Change"),
        F.col("lang").alias("Language"), F.col("strategy").alias("Strategy"), F.col("run").alias("Run"),
    )
    rows.write.mode(mode).partitionBy("Language", "Strategy", "Run").option("header", True).csv(path)


def read_delta_tables(spark: SparkSession, path: str) -> DataFrame:
    """All delta tables below path, or those of one language, strategy or run by a filter: other folders are not read."""
    return spark.read.schema(DELTA_SCHEMA + ", Language string, Strategy string, Run int").option("header", True).csv(path)


def write_deltas(deltas: DataFrame, path: str, mode: str = "error") -> None:
    """Entity and changes with a header."""
    rows = deltas.select(F.col("label").alias("Entity"), F.col("precision_change").alias("Precision Change"), F.col("recall_change").alias("Recall Change"), F.col("f1_change").alias("F1 Change"))
    rows.write.mode(mode).option("header", True).csv(path)


def read_deltas(spark: SparkSession, files: dict[tuple[str, str], str]) -> DataFrame:
    """All delta tables, with Language and Strategy; no file gives an empty table."""
    out = spark.createDataFrame([], DELTA_SCHEMA + ", Language string, Strategy string")
    for (lang, strategy), path in files.items():
        own = spark.read.schema(DELTA_SCHEMA).option("header", True).csv(path)
        out = out.unionByName(own.withColumns({"Language": F.lit(lang), "Strategy": F.lit(strategy)}))
    return out
