"""Labelled sequences in long form: one row for each token (sentence, place, word, tag)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavuflow.functions import vectors as V
from tavuflow.operators.ranks import ranked


def latest(rows: DataFrame, key: str, loaded: str) -> DataFrame:
    """One row for each key, the one loaded last; ties by the row's own content."""
    others = [F.col(c) for c in rows.columns if c not in (key, loaded)]
    order = Window.partitionBy(key).orderBy(F.col(loaded).desc_nulls_last(), F.xxhash64(*others))
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


#: Lines that are numbered by one window; a longer part (a file, say) is numbered block by block.
LINES_PER_BLOCK = 100_000


def sentence_ids(lines: DataFrame, part: str, order: str, blank: str, block: int | None = None) -> DataFrame:
    """lines that are not blank, with sent_id (from 1 in each part) and pos: a blank line ends a sentence, nothing else does.

    order is a whole number, the line's place in its part. Lines are numbered within blocks of that number; what a block needs of
    those before it (sentences so far, tokens of a sentence that goes on) follows from one row for each block, so that a part
    with a third of all lines is no task's burden.
    """
    lines = lines.withColumn("_b", F.floor(F.col(order) / (block or LINES_PER_BLOCK)))
    at = Window.partitionBy(part, "_b").orderBy(order)
    running = at.rowsBetween(Window.unboundedPreceding, 0)
    is_blank = F.coalesce(F.col(blank), F.lit(False))
    rows = lines.withColumns({"_rn": F.row_number().over(at), "_prev": F.lag(is_blank).over(at)})
    rows = rows.withColumns({"_last": F.max(F.when(is_blank, F.col("_rn"))).over(running), "_starts": F.sum(F.coalesce(~is_blank & F.col("_prev"), F.lit(False)).cast("long")).over(running)})
    ends = rows.groupBy(F.col(part).alias("_p"), F.col("_b").alias("_c")).agg(
        F.count("*").alias("n"), F.max("_last").alias("last"), F.max("_starts").alias("starts"), F.bool_or(F.col("_prev").isNull() & ~is_blank).alias("open")
    )
    before = Window.partitionBy("_p").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("sum", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = ends.withColumn("carried", F.col("sum") - F.coalesce(F.max(F.col("sum") + F.col("last")).over(before), F.lit(0)))
    ends = ends.withColumn("first", (F.col("open") & (F.col("carried") == 0)).cast("long"))
    ends = ends.select("_p", "_c", "carried", (F.coalesce(F.sum(F.col("starts") + F.col("first")).over(before), F.lit(0)) + F.col("first")).alias("before"))
    out = rows.join(ends, F.col(part).eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("_c"))).filter(~is_blank)
    pos = F.col("_rn") - F.coalesce("_last", F.lit(0)) - 1 + F.when(F.col("_last").isNull(), F.col("carried")).otherwise(0)
    return out.withColumns({"sent_id": F.col("before") + F.col("_starts"), "pos": pos.cast("int")}).select(*[c for c in lines.columns if c != "_b"], "sent_id", "pos")


def with_entities(tokens: DataFrame, sent: str, tag: str, outside: str = "O") -> DataFrame:
    """Tokens of the sentences that hold a tag other than outside."""
    keep = tokens.filter(F.col(tag) != outside).select(sent).distinct()
    return tokens.join(keep, sent, "left_semi")


def sentences(tokens: DataFrame, sent: str, pos: str, fields: list[str], name: str = "items", keep: list[str] | None = None) -> DataFrame:
    """One row for each sentence, its tokens in order."""
    items = F.array_sort(F.collect_list(F.struct(pos, *fields)))
    return tokens.groupBy(sent, *(keep or [])).agg(items.alias(name))


def sentence_lines(tokens: DataFrame, sent: str, pos: str, word: str, tag: str) -> DataFrame:
    """sent and block: the sentence as lines 'word<TAB>tag'."""
    nested = sentences(tokens, sent, pos, [word, tag])
    return nested.select(sent, F.array_join(F.transform("items", lambda i: F.concat_ws("\t", i[word], i[tag])), "\n").alias("block"))


def position_ratio(tokens: DataFrame, sent: str, order: list[str], into: str = "ratio") -> DataFrame:
    """tokens with idx (from 0), length and into: the place as a share of the length, to two digits."""
    at = Window.partitionBy(sent)
    out = tokens.withColumn("idx", F.row_number().over(at.orderBy(*order)) - 1).withColumn("length", F.count("*").over(at))
    return out.withColumn(into, F.round(F.col("idx") / F.col("length"), 2))


def context_similarity(tokens: DataFrame, sent: str, order: list[str], vector: str, context: int = 5, least: float = 0.1) -> DataFrame:
    """One row for each token and neighbour (offset -context..context): cosine to three digits, if above least in size.

    Neighbours come from one window with lag and lead; norms are computed once for each token.
    """
    at = Window.partitionBy(sent).orderBy(*order)
    rows = tokens.withColumn("_n", V.norm(F.col(vector)))
    offsets = [k for k in range(-context, context + 1) if k]
    near = [F.struct(F.lit(k).alias("offset"), F.lead(F.struct(F.col(vector).alias("v"), F.col("_n").alias("n")), k).over(at).alias("o")) for k in offsets]
    # Windows first, then one explode.
    wide = rows.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(near)])
    flat = wide.select(*tokens.columns, "_n", F.explode(F.array(*[F.col(f"_o{i}") for i in range(len(near))])).alias("x")).filter("x.o is not null")
    sim = F.round(V.cosine(F.col(vector), F.col("x.o.v"), F.col("_n"), F.col("x.o.n")), 3)
    raw = V.cosine(F.col(vector), F.col("x.o.v"), F.col("_n"), F.col("x.o.n"))
    return flat.withColumn("_raw", raw).filter(F.abs("_raw") > least).withColumn("similarity", sim).withColumn("offset", F.col("x.offset")).drop("x", "_raw", "_n")


def feature_rows(tokens: DataFrame, sent: str, order: list[str], word: str, vector: str | None = None, context: int = 5, dims: int = 15, least: float = 0.1) -> DataFrame:
    """tokens with features, an array of (name, value): the lower-cased word, high, mid or low for each of the vector's first
    numbers, the place as a share of the sentence, and the similarity to each neighbour up to context places away, if above least
    in size. Similarities are made once for a pair: the later token reads the earlier one's. Null words and vectors give none."""
    at = Window.partitionBy(sent).orderBy(*order)
    rows = position_ratio(tokens, sent, order, "_ratio").drop("idx", "length")
    one = lambda name, value: F.struct(name.alias("name"), value.cast("double").alias("value"))
    parts = [F.array(one(F.concat(F.lit("token.lower="), F.lower(word)), F.lit(1.0)), one(F.lit("position_ratio"), F.col("_ratio")))]
    if vector:
        rows = rows.withColumn("_n", V.norm(F.col(vector)))
        ahead = {k: F.lead(F.struct(F.col(vector).alias("v"), F.col("_n").alias("n")), k).over(at) for k in range(1, context + 1)}
        rows = rows.withColumns({f"_o{k}": x for k, x in ahead.items()})
        sound = lambda k: (F.col("_n") > 0) & (F.col(f"_o{k}.n") > 0)
        rows = rows.withColumns({f"_s{k}": F.when(sound(k), V.dot(F.col(vector), F.col(f"_o{k}.v")) / (F.col("_n") * F.col(f"_o{k}.n"))) for k in ahead}).drop(*(f"_o{k}" for k in ahead))
        rows = rows.withColumns({f"_b{k}": F.lag(f"_s{k}", k).over(at) for k in ahead})
        parts.append(F.transform(V.buckets(F.col(vector), dims), lambda x, i: one(F.concat(F.lit("emb_dim_"), i.cast("string"), F.lit("="), x), F.lit(1.0))))
        near = {**{-k: F.col(f"_b{k}") for k in ahead}, **{k: F.col(f"_s{k}") for k in ahead}}
        parts.append(F.array(*[one(F.lit(f"context_{k}_similarity"), F.when(F.abs(s) > least, F.round(s, 3))) for k, s in sorted(near.items())]))
    empty = F.array().cast("array<struct<name:string,value:double>>")
    features = F.filter(F.flatten(F.array(*[F.coalesce(p, empty) for p in parts])), lambda x: x["name"].isNotNull() & x["value"].isNotNull())
    return rows.withColumn("features", features).select(*tokens.columns, "features")


def _bucket(key: str, seed: int, size: int) -> Column:
    """A number below size from a digest that other engines can compute too."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(size))


def split_by_hash(rows: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """rows with split: train for about share of the keys, else test; the same however the rows are spread."""
    return rows.withColumn("split", F.when(_bucket(key, seed, 10_000) < int(share * 10_000), "train").otherwise("test"))


def _shuffled(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """The distinct keys with _at, their place in an order by digest that other engines can compute too."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    return ranked(keys.select(key).distinct().withColumn("_d", digest), [F.col("_d"), F.col(key)], "_at").drop("_d")


def split_exactly(rows: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """rows with split: train for the first whole number of share times the keys in shuffled order, else test."""
    placed = _shuffled(rows, key, seed)
    most = int(placed.count() * share)
    return rows.join(placed.select(key, F.when(F.col("_at") < most, "train").otherwise("test").alias("split")), key)


def equal_folds(rows: DataFrame, key: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """key and fold: the distinct keys in shuffled order, dealt to folds whose sizes differ by one at most."""
    return _shuffled(rows, key, seed).select(key, (F.col("_at") % folds).cast("int").alias("fold"))


def fold_by_hash(rows: DataFrame, key: str, folds: int = 3, seed: int = 42) -> DataFrame:
    return rows.withColumn("fold", _bucket(key, seed, folds).cast("int"))


def fold_plan(sent_ids: list[int], folds: int = 3, seed: int = 42) -> list[tuple[int, int]]:
    """(sentence, fold) by a seeded shuffle into folds whose sizes differ by one at most, for corpora whose ids fit the driver."""
    import numpy as np

    order = np.arange(len(sent_ids))
    np.random.RandomState(seed).shuffle(order)
    sizes = np.full(folds, len(sent_ids) // folds)
    sizes[: len(sent_ids) % folds] += 1
    out = np.empty(len(sent_ids), int)
    out[order] = np.repeat(np.arange(folds), sizes)
    return [(int(s), int(f)) for s, f in zip(sent_ids, out, strict=True)]


def paired(tokens: DataFrame, embedded: DataFrame, sent: str, mode: str = "correct") -> DataFrame:
    """(index, sentence of the tokens, sentence of the embeddings) as a fold's index pairs them.

    correct: each sentence with its own embedding. compat: sentences without tokens have no embedding, and the n-th sentence
    is paired with the n-th embedding; indexes beyond the embeddings are dropped.
    """
    if mode not in ("correct", "compat"):
        raise ValueError("mode is correct or compat")
    have = embedded.select(sent).distinct()
    every = tokens.select(sent).distinct()
    if mode == "correct":
        return every.join(have, sent).select(sent, F.col(sent).alias("embedded_sent"))
    a = ranked(every, [F.col(sent)], "_i")
    b = ranked(have, [F.col(sent)], "_i").withColumnRenamed(sent, "embedded_sent")
    return a.join(b, "_i").select(sent, "embedded_sent")
