"""Sources and sinks: tables written to the shared folder in each file form and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavuflow.config import experiments
from tavuflow.functions import text as T
from tavuflow.operators import analytics, bpe, embed, metrics, sampling
from tavuflow.operators import sequences as S
from tavuflow.operators import tokenize as K
from tavuflow.plans.evaluation import PREDICTED_SQL
from tavuflow.plans.labels import TAGGED_SQL, clean_tokens, tagged
from tavuflow.plans.models import VOCABULARY
from tavuflow.plans.tokens import CLEAN_SQL, SQL_SPACE
from tavuflow.session import keyed, shared_dir, spread, table
from tavuflow.sources import conll, corpus, results, wiki

_TEXT = "Cleaned_Text"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tavuflow/{name}-{uuid.uuid4().hex}"


def _strip(c: str) -> Column:
    return T.strip(F.col(c))


# What XML cannot hold is left out of the dumps: control characters and the two last code points.
_NO_XML = "[\\x00-\\x08\\x0b-\\x1f\\ufffe\\uffff]"


def _dump(spark: SparkSession, d: str) -> str:
    """The articles as a compressed dump: as many revisions as the table says, the last with the text; a page without topic has an
    id that does not parse, one without title none."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, _NO_XML, ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    revision = lambda number, text: F.concat(F.lit("<revision><id>"), number, F.lit("</id><text>"), text, F.lit("</text></revision>"))
    earlier = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce("n_revisions", F.lit(1)), F.lit(1)) - 1, F.lit(1)), lambda i: revision(i.cast("string"), F.lit("old"))), "")
    earlier = F.when(F.col("n_revisions") > 1, earlier).otherwise("")
    last = revision(F.when(F.col("topic").isNull(), "x").otherwise(F.col("article_id").cast("string")), F.coalesce(safe(_TEXT), F.lit("")))
    title = F.coalesce(F.concat(F.lit("<title>"), safe("Title"), F.lit("</title>")), F.lit(""))
    pages = spread(table(spark, d, "articles")).select(F.concat(F.lit("<page>"), title, earlier, last, F.lit("</page>")).alias("value"))
    path = _folder(spark, "dump")
    pages.write.option("compression", "bzip2").text(path)
    return path


def dump_pages(spark: SparkSession, d: str) -> DataFrame:
    """Titles and texts of a dump's pages, by digests."""
    pages = wiki.read_pages(spark, _dump(spark, d)).filter("_corrupt_record is null")
    return pages.select(F.md5(F.coalesce(_strip("title"), F.lit(""))).alias("title_md5"), F.md5(_strip("text")).alias("text_md5"))


def dump_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages read and skipped."""
    return wiki.page_counts(wiki.read_pages(spark, _dump(spark, d))).select("pages", "skipped")


def wikitext_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Articles' labels set in wikitext of every kind, and what is left of it."""
    source, topic, key = F.coalesce("source", F.lit("x")), F.coalesce("topic", F.lit("x")), F.col("article_id").cast("string")
    parts = [
        "'''", source, "''' {{malli|", topic, "|{{sisä|{{", key, "}}}}}}on [[", source, "|", key, "]]<ref name=a>", topic, "</ref> ja ", "[[", topic, "]].<ref name=a/><!-- ", key, "\n -->\n",
        "== ", source, " ==\n{| class=x\n|", key, "\n|}[[Luokka:", topic, "]][[Kuva:", key, ".png|thumb|[[", topic, "]]]][https://example.com/", key, " ", topic, "] a&amp;nbsp;b {{ auki",
    ]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, d, "articles").select("article_id", wiki.clean_wikitext(text).alias("cleaned"))


def article_records(spark: SparkSession, d: str) -> DataFrame:
    """Articles as JSON lines and back; a folder that is not there is no error."""
    path = _folder(spark, "records")
    corpus.write_articles(table(spark, d, "articles").select("Title", _TEXT), path)
    there = corpus.existing(spark, [path, f"{path}-none"])
    return corpus.read_articles(spark, there[0]).select(F.md5("Title").alias("title_md5"), F.md5(_TEXT).alias("text_md5"))


def sample_files(spark: SparkSession, d: str) -> DataFrame:
    """The largest articles of each source as a table of bodies, read as lines: lines and words of each."""
    rows = table(spark, d, "articles").select("pos", "source", "Title", _TEXT)
    sample = sampling.tiered_sample(rows, "Title", _TEXT, "pos", target=50, group="source")
    path = _folder(spark, "sample")
    corpus.write_sample(sample, path)
    lines = corpus.sample_lines(spark.read.parquet(path), ["source"])
    return lines.groupBy("source", "ordinal", "file_name").agg(F.count("*").alias("lines"), F.sum(F.size(T.words(F.col("text")))).cast("long").alias("words"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bodies as text files, read by a pattern: how often each line occurs."""
    rows = sampling.clean_articles(table(spark, d, "articles").select("Title", _TEXT), "Title", _TEXT)
    path = _folder(spark, "bodies")
    rows.select(T.article_body(F.col("Title"), F.col(_TEXT)).alias("value")).write.option("lineSep", "\n").text(path)
    return corpus.read_lines(spark, f"{path}/part-*").groupBy(F.md5("text").alias("line_md5")).agg(F.count("*").alias("n"))


def tokenized_files(spark: SparkSession, d: str) -> DataFrame:
    """Tokenised lines written by language and strategy; one strategy is read, its folders alone. An empty name of a folder is a
    null one."""
    path = _folder(spark, "tokenized")
    corpus.write_tokenized(table(spark, d, "tokenized").select("lang", "strategy", "text", "tokens"), path)
    read = spark.read.parquet(path).filter("strategy = 'Bigrams'")
    return read.groupBy("lang").agg(F.count("*").alias("lines"), F.sum(F.when(F.col("tokens").isNotNull(), F.size("tokens")).otherwise(0)).alias("tokens"))


def _sentences(rows: DataFrame, part: str = "src_file") -> DataFrame:
    """Each sentence as one string, and how often it occurs."""
    nested = rows.groupBy(part, "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("i"))
    line = F.array_join(F.transform("i", lambda x: F.concat_ws("/", x["word"], x["tag"])), " ")
    return nested.select(line.alias("sentence")).groupBy("sentence").agg(F.count("*").alias("n"))


def conll_files(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as word and tag lines and back: tokens of other than two fields do not come back."""
    path = _folder(spark, "conll")
    conll.write_conll(tagged(spark, d), path)
    return _sentences(conll.read_conll(spark, path))


def conll_filtered_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The same files after those sentences that are all outside were taken out of them."""
    path = _folder(spark, "conll")
    conll.write_conll(tagged(spark, d), path)
    read = conll.read_conll(spark, path).withColumn("sent_id", F.xxhash64("src_file", "sent_id"))
    conll.overwrite(spark, S.with_entities(read, "sent_id", "tag"), path, conll.write_conll)
    return _sentences(conll.read_conll(spark, path))


def conll_two_paths(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora without a blank line at their ends, read as one."""
    paths = [_folder(spark, "conll") for _ in range(2)]
    for i, path in enumerate(paths):
        conll.write_conll(tagged(spark, d).filter(F.col("sent_id") % 2 == i), path, trailing_blank=False)
    return _sentences(conll.read_conll(spark, ",".join(paths)))


# The forms of the other readers: name, rules and a line of a token.
_FORMS = {
    "histogram": (conll.HISTOGRAM, lambda w, t: F.concat_ws(" ", w, F.lit("x"), t)),
    "plus": (conll.PLUS, lambda w, t: F.concat_ws("\t", w, F.lit("1\t2\t3\t4"), t)),
    "tabular": (conll.TABULAR, lambda w, t: F.concat_ws("\t", w, t, F.lit("more"))),
}


def conll_family(spark: SparkSession, d: str) -> DataFrame:
    """Tags that the loose, the tab-separated and the tabular reader find, with marker and comment lines among the tokens."""
    head = F.array(F.lit("<HEADLINE>"), F.lit("# text"), F.lit("too\tfew"))
    out = None
    for name, (rules, line) in _FORMS.items():
        lines = tagged(spark, d).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", line(F.col("word"), F.col("tag")).alias("line")))).alias("i"))
        path = _folder(spark, name)
        marks = head if name == "plus" else F.array(F.lit("<BODY>"))
        lines.select(F.array_join(F.concat(marks, F.transform("i", lambda x: x["line"]), F.array(F.lit(""))), "\n").alias("value")).write.option("lineSep", "\n").text(path)
        own = conll.read_conll(spark, path, rules).groupBy(F.lit(name).alias("form"), "tag").agg(F.count("*").alias("n"), F.countDistinct("src_file", "sent_id").alias("sentences"))
        out = own if out is None else out.unionByName(own)
    return out


def sentence_json_files(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as JSON arrays with a remark, a file for each thousand of them, and their words read again."""
    nested = S.sentences(tagged(spark, d), "sent_id", "pos", ["word"])
    text = F.array(F.array_join("items.word", " "), F.lit("remark"))
    files = nested.groupBy(F.floor(F.col("sent_id") / 1000).alias("_file")).agg(F.to_json(F.collect_list(text)).alias("value"))  # at most a thousand sentences a row
    path = _folder(spark, "json")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return conll.read_sentence_json(spark, path).groupBy("word").agg(F.count("*").alias("n"))


def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Reports of runs as result files and back."""
    path = _folder(spark, "results")
    rows = table(spark, d, "reports").filter("label is not null and run is not null").dropDuplicates(["lang", "strategy", "run", "task", "label"])
    results.write_results(rows, path)
    found = results.reports(results.read_results(spark, path))
    return found.groupBy("lang", "strategy", "run", "task").agg(F.count("*").alias("labels"), F.sum("support").alias("support"))


def delta_files(spark: SparkSession, d: str) -> DataFrame:
    """Changes against the run before as CSV files by language, strategy and run, and back."""
    from tavuflow.plans.results import run_delta

    path = _folder(spark, "deltas")
    results.write_delta_tables(run_delta(spark, d), path)
    return results.read_delta_tables(spark, path)


def vocabulary_files(spark: SparkSession, d: str) -> DataFrame:
    """The words of the labelled sentences with their numbers, as lines."""
    path = _folder(spark, "vocabulary")
    corpus.write_vocabulary(embed.vocabulary_lines(tagged(spark, d), "word").withColumnRenamed("word", "token"), path)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


def merges_saved(spark: SparkSession, d: str) -> DataFrame:
    """The merges of a public vocabulary, saved and loaded."""
    path = _folder(spark, "merges")
    bpe.save_merges(bpe.read_vocabulary_file(spark, VOCABULARY)[0], path)
    return bpe.load_merges(spark, path)


def tokens_kept(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by strategy, kept under their key: the second call reads what the first one wrote."""
    run, out = uuid.uuid4().hex, None
    for strategy in ("Word", "Trigrams"):
        for _ in range(2):
            own = keyed(spark, "tokens", {"run": run, "strategy": strategy}, lambda s=strategy: K.propagate(tagged(spark, d).select("lang", "tag", "word"), "word", s))
        part = own.groupBy(F.lit(strategy).alias("strategy"), "lang").agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


def exact_split_90_10(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and tokens of a split whose train side has nine tenths of the sentences, rounded down."""
    return S.split_exactly(clean_tokens(spark, d), "sent_id").groupBy("split").agg(F.count("*").alias("n_tokens"), F.countDistinct("sent_id").alias("sentences"))


def equal_folds(spark: SparkSession, d: str) -> DataFrame:
    return S.equal_folds(clean_tokens(spark, d), "sent_id")


def safe_tags(spark: SparkSession, d: str) -> DataFrame:
    """Names of strategy and label made safe for files."""
    rows = table(spark, d, "reports").filter("label is not null").select(F.concat_ws(" / ", "strategy", "label").alias("name")).distinct()
    return rows.select("name", T.safe_tag(F.col("name")).alias("safe"))


def strategy_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary size that a strategy's name tells."""
    return table(spark, d, "reports").select("strategy").distinct().select("strategy", T.vocabulary_size(F.col("strategy")).alias("size"))


def trial_grid(spark: SparkSession, d: str) -> DataFrame:
    """The quick subset of languages and strategies."""
    return experiments(spark, trial=True)


def log_loss_by_fold(spark: SparkSession, d: str) -> DataFrame:
    """The loss of a guess by each label's share of its language."""
    from tavuflow.plans.evaluation import predictions

    rows = predictions(spark, d)
    shares = rows.groupBy("lang", "tag").agg(F.count("*").alias("n")).withColumn("chance", F.col("n") / F.sum("n").over(_by("lang")))
    losses = metrics.log_loss(rows.join(F.broadcast(shares.select("lang", "tag", "chance")), ["lang", "tag"]), "chance", ["lang", "fold"])  # a row for each label
    return losses.select("lang", "fold", F.round("loss", 6).alias("loss"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's series of values would stop, with a patience of three."""
    rows = table(spark, d, "events").filter("value is not null")
    stops = metrics.early_stop(rows.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", patience=3)
    return stops.select("user_id", "stop_epoch", F.round("best", 6).alias("best"))


def histogram_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Labels by count, ties in the order of their first token."""
    return analytics.histogram(clean_tokens(spark, d), "tag", "token_id").withColumn("place", F.col("place").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        dump_pages, dump_counts, wikitext_cleaned, article_records, sample_files, text_lines, tokenized_files, conll_files, conll_two_paths, conll_filtered_in_place, conll_family, sentence_json_files, result_files,
        delta_files, vocabulary_files, merges_saved, tokens_kept, exact_split_90_10, equal_folds, safe_tags, strategy_sizes, trial_grid, log_loss_by_fold, early_stopping, histogram_of_words,
    )
}

_XML = r"replace(replace(regexp_replace({0}, '[\x00-\x08\x0b-\x1f\x{{fffe}}\x{{ffff}}]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{SQL_SPACE}|{SQL_SPACE}$', '', 'g')"


_FIT = f"fit as (select sent_id, pos, word, tag from tagged where not regexp_matches(word, '{SQL_SPACE}') and not regexp_matches(tag, '{SQL_SPACE}') and word <> '' and tag <> '')"
_JOINED = "string_agg(word || '/' || tag, ' ' order by pos, word, tag)"
_GRAM3 = "unnest(list_transform(range(1, length(word) - 1), lambda i: substring(word, i::int, 3))) as token"
SQL = {
    "dump_pages": f"select md5(coalesce({_stripped(_XML.format('Title'))}, '')) as title_md5, md5(coalesce({_stripped(_XML.format('Cleaned_Text'))}, '')) as text_md5 from articles where topic is not null",
    "dump_counts": "select count(*) as pages, count(*) filter (where topic is null) as skipped from articles",
    "wikitext_cleaned": """with a as (select article_id, coalesce(source, 'x') as s, coalesce(topic, 'x') as t from articles)
        select article_id, s || ' on ' || article_id || ' ja ' || t || '.' || chr(10) || s || chr(10) || t || ' a&nbsp;b {{ auki' as cleaned from a""",
    "strategy_sizes": "select distinct strategy, case when regexp_full_match(strategy, 'BPE[0-9]+k') then strategy[4:-2]::int * 1000 end as size from reports",
    "trial_grid": """select * from (values ('Finnish','fi'),('Swahili','sw'),('Hungarian','hu')) l(lang, code),
        (values ('Word',0,null::int),('Char',1,null),('Bigrams',2,null),('Trigrams',3,null),('4grams',4,null)) s(strategy, n, vocab)""",
    "article_records": "select md5(Title) as title_md5, md5(Cleaned_Text) as text_md5 from articles",
    "sample_files": f"""with {CLEAN_SQL}, tiers as (select *, least(4, floor(strlen(x) / 1024))::int as tier from clean where t <> '' and x <> ''),
        firsts as (select * from tiers where tier >= 1 qualify row_number() over (partition by source, t order by tier desc, pos) = 1),
        s as (select source, t, x, row_number() over (partition by source order by tier desc, pos) as ordinal from firsts qualify ordinal <= 50),
        n as (select source, ordinal, 'article_' || ordinal || '_' || regexp_replace(substring(array_to_string(list_filter(regexp_split_to_array(t, '{SQL_SPACE}'), lambda w: w <> ''), '_'), 1, 50), '[<>:\"/\\\\|?*]', '_', 'g') || '.txt' as file_name,
              unnest(str_split('Title: ' || t || chr(10) || x || chr(10), chr(10))) as line from s)
        select source, ordinal, file_name, count(*) as lines, sum(len(list_filter(regexp_split_to_array(line, '{SQL_SPACE}'), lambda w: w <> '')))::bigint as words from n group by all""",
    "text_lines": f"""with {CLEAN_SQL}, l as (select unnest(str_split(replace(replace('Title: ' || t || chr(10) || x || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) as line from clean where t <> '' and x <> '')
        select md5(line) as line_md5, count(*) as n from l group by all""",
    "tokenized_files": "select nullif(lang, '') as lang, count(*) as lines, sum(coalesce(len(tokens), 0))::bigint as tokens from tokenized where strategy = 'Bigrams' group by all",
    "conll_files": f"with {TAGGED_SQL}, {_FIT}, s as (select sent_id, {_JOINED} as sentence from fit group by sent_id) select sentence, count(*) as n from s group by all",
    "conll_two_paths": f"with {TAGGED_SQL}, {_FIT}, s as (select sent_id, {_JOINED} as sentence from fit group by sent_id) select sentence, count(*) as n from s group by all",
    "conll_filtered_in_place": f"with {TAGGED_SQL}, {_FIT}, s as (select sent_id, {_JOINED} as sentence from fit group by sent_id having bool_or(tag <> 'O')) select sentence, count(*) as n from s group by all",
    "conll_family": f"""with {TAGGED_SQL} select 'plus' as form, tag, count(*) as n, count(distinct sent_id) as sentences from tagged group by all
        union all select 'tabular', tag, count(*), count(distinct sent_id) from tagged group by all
        union all select 'histogram', tag, count(*), count(distinct sent_id) from tagged where not starts_with({_stripped('word')}, '<') group by all""",
    "sentence_json_files": f"with {TAGGED_SQL}, w as (select unnest(list_filter(regexp_split_to_array(word, '{SQL_SPACE}'), lambda x: x <> '')) as word from tagged) select word, count(*) as n from w group by word",
    "result_files": """with r as (select distinct on (lang, strategy, run, task, label) * from reports where label is not null and run is not null)
        select lang, strategy, run, task, count(*) as labels, sum(support)::bigint as support from r where label not in ('accuracy', 'micro avg', 'macro avg', 'weighted avg') group by all""",
    "vocabulary_files": f"with {TAGGED_SQL}, c as (select word, count(*) as n from tagged group by word) select (row_number() over (order by n desc, word) - 1) || chr(9) || word as line from c",
    "merges_saved": f"""with m as (select from_json(json_extract(content, '$.model.merges'), '[["VARCHAR"]]') as ms from read_text('{VOCABULARY}')),
        e as (select unnest(range(len(ms)))::int as rank, unnest(ms) as m from m) select rank, m[1] as "left", m[2] as "right" from e""",
    "tokens_kept": f"""with {TAGGED_SQL}, g as (select lang, {_GRAM3} from tagged)
        select 'Word' as strategy, lang, count(*) as n, count(distinct w) as tokens from (select lang, unnest(list_filter(regexp_split_to_array(word, '{SQL_SPACE}'), lambda x: x <> '')) as w from tagged) group by all
        union all select 'Trigrams', lang, count(*), count(distinct token) from g group by all""",
    "exact_split_90_10": """with toks as (select * from ner_tokens qualify row_number() over (partition by token_id order by loaded_at desc nulls last) = 1),
        s as (select sent_id, row_number() over (order by md5('42:' || sent_id), sent_id) - 1 as i, count(*) over () as n from (select distinct sent_id from toks))
        select case when i < floor(n * 0.9) then 'train' else 'test' end as split, count(*) as n_tokens, count(distinct sent_id) as sentences from toks join s using (sent_id) group by all""",
    "equal_folds": "select sent_id, ((row_number() over (order by md5('42:' || sent_id), sent_id) - 1) % 3)::int as fold from (select distinct sent_id from ner_tokens)",
    "safe_tags": "with n as (select distinct concat_ws(' / ', strategy, label) as name from reports where label is not null) select name, translate(name, '/\\ ', '___') as safe from n",
    "log_loss_by_fold": f"""{PREDICTED_SQL} s as (select lang, tag, count(*) / sum(count(*)) over (partition by lang) as chance from p group by lang, tag)
        select lang, fold, round(avg(-ln(chance + 1e-15)), 6) as loss from p join s using (lang, tag) group by lang, fold""",
    "early_stopping": """with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id, value) as i from events where value is not null),
        f as (select user_id, i, case when value < 'infinity'::double - 1e-4 then value end as best, 0 as bad, null::bigint as stop from e where i = 1
          union all
          select e.user_id, e.i, case when f.stop is null and e.value < f.best - 1e-4 then e.value else f.best end,
            case when f.stop is not null then f.bad when e.value < f.best - 1e-4 then 0 else f.bad + 1 end,
            case when f.stop is not null then f.stop when e.value < f.best - 1e-4 then null when f.bad + 1 >= 3 then e.event_id end
          from f join e on e.user_id = f.user_id and e.i = f.i + 1)
        select user_id, stop as stop_epoch, round(best, 6) as best from f qualify row_number() over (partition by user_id order by i desc) = 1""",
    "histogram_of_words": "with toks as (select * from ner_tokens qualify row_number() over (partition by token_id order by loaded_at desc nulls last) = 1), c as (select tag, count(*) as n, min(token_id) as first_at from toks where tag is not null group by tag) select tag, n, first_at, row_number() over (order by n desc, first_at) as place from c",
}


def _delta_sql() -> str:
    from tavuflow.plans.results import SQL as RESULTS

    return f'select label as "Entity", precision_change as "Precision Change", recall_change as "Recall Change", f1_change as "F1 Change", lang as "Language", strategy as "Strategy", run as "Run" from ({RESULTS["run_delta"]})'


SQL["delta_files"] = _delta_sql()
