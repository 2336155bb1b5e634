"""Problem 1: statistics of each text that tell natural prose from lists, tables and junk.

Two scans of the texts. The first learns the common words of each label's texts: words in a good share of its documents that
hardly ever stand in short or cell-like lines (so that a frequent noun of a list is none). The second computes statistics of
each line and text on numpy code-point arrays. Thresholds on a line's statistics are noisy labelling functions, each voting
for one type; which functions fire is a bit pattern, the histogram of patterns (bounded by their number) is all the driver
sees, and expectation-maximisation learns from their agreements how often each function fires in lines of each type. The
posterior of its pattern is a line's type; a text's type follows from its characters by type.

Defined results: null, empty and blank texts have no lines, type null and no case. Keys may repeat; each row is judged alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavuflow.llm.codepoints import assigned, blocks, run_hashes, to_codes, whitespace_table
from tavuflow.llm.lookalike import normalize_codes
from tavuflow.llm.neardup import lower_codes
from tavuflow.session import materialize

TYPES = ("prose", "list", "table", "junk")
#: A word is common if it stands in this share of a label's texts, and in structured lines for at most that share of its uses.
COMMON_SHARE, STRUCTURED_SHARE = 0.15, 0.03
#: And if it stands in so many texts, where a label's are so few that the share means less.
LEAST_SEEN = 2

# Marks that end a sentence or close one; bullets; marks of ordinary prose; signs of markup.
TERMINAL = ".!?…。！？।॥:\"'”’»)]"
BULLETS = "-*•·–—‣▪●"
PROSE_MARKS = ".,;:!?'\"()-–—“”„’‘«»%°…/&"
MARKUP = "{}[]<>=|_\\~^#@$"

# The labelling functions: name, type voted for. Their order is the order of the pattern's bits.
FUNCTIONS = (
    ("function_words", 0),
    ("sentence_end", 0),
    ("long_sentence", 0),
    ("cells", 2),
    ("delimiters", 2),
    ("columns", 2),
    ("bullet", 1),
    ("bare_short", 1),
    ("enumeration", 1),
    ("pairs", 1),
    ("symbols", 3),
    ("markup", 3),
    ("repetition", 3),
    ("long_tokens", 3),
    ("inner_symbols", 3),
    ("no_function_words", 3),
)


# Classes of characters.
_LETTER, _SPACE, _DIGIT, _MARK, _COMMA, _SEMICOLON, _PIPE, _SYMBOL, _MARKUP, _TAB, _DASH = range(11)


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    size = 0x110000
    letter, digit = np.zeros(size, bool), np.zeros(size, bool)
    for cp in assigned():
        kind = unicodedata.category(chr(cp))
        letter[cp] = kind[0] in "LM"
        digit[cp] = kind == "Nd"

    def of(chars: str) -> np.ndarray:
        out = np.zeros(size, bool)
        out[[ord(c) for c in chars]] = True
        return out

    space = whitespace_table()
    kind = np.full(size, _SYMBOL, np.uint8)
    for chars, value in ((PROSE_MARKS + "²³", _MARK), (MARKUP, _MARKUP), (",", _COMMA), (";", _SEMICOLON), ("|", _PIPE), ("-–—:", _DASH)):
        kind[of(chars)] = value
    kind[letter], kind[digit], kind[space] = _LETTER, _DIGIT, _SPACE
    kind[9] = _TAB
    return {"letter": letter, "digit": digit, "space": space, "kind": kind, "terminal": of(TERMINAL), "bullet": of(BULLETS)}


def _runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within rows."""
    n = len(solid)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    cut = np.unique(inner[solid[inner] & solid[inner - 1]])  # a run that goes on over a row's end is cut there
    starts, ends = change[solid[change]], change[~solid[change]]
    if solid[0]:
        starts = np.append(0, starts)
    if solid[-1]:
        ends = np.append(ends, n)
    if len(cut):
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    return starts, ends


class Lines:
    """The lines of a block of texts and their statistics."""

    def __init__(self, column: pa.Array) -> None:
        t = _tables()
        codes, offsets = lower_codes(*normalize_codes(*to_codes(column)))
        self.codes, self.offsets, n = codes, offsets, len(codes)
        newline = np.flatnonzero(codes == 10)
        heads = np.unique(np.concatenate([offsets[:-1], newline + 1]))
        self.start = heads[heads < n]
        k = len(self.start)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        end = np.minimum(np.append(self.start[1:], n)[:k], offsets[self.row + 1])
        closed = (end > self.start) & (codes[np.maximum(end - 1, 0)] == 10) if n else np.zeros(0, bool)
        self.end = end - closed
        self.size = self.end - self.start
        kind = t["kind"][codes]
        # Tokens between white space, words of letters.
        self.token_start, self.token_end = _runs((kind != _SPACE) & (kind != _TAB), offsets)
        self.word_start, self.word_end = _runs(kind == _LETTER, offsets)
        self.token_line = np.searchsorted(self.start, self.token_start, side="right") - 1
        self.word_line = np.searchsorted(self.start, self.word_start, side="right") - 1
        count = lambda line, weights=None: np.bincount(line, weights, minlength=k)
        self.tokens, self.words = count(self.token_line), count(self.word_line)
        self.word_hash = run_hashes(codes, self.word_start, self.word_end)
        token_size = self.token_end - self.token_start
        self.letters = count(self.word_line, self.word_end - self.word_start)
        # A cell: a token without letters, or a mark for no value.
        wordless = np.ones(len(token_size), bool)
        wordless[np.searchsorted(self.token_start, self.word_start, side="right") - 1] = False
        na = (token_size == 3) & (codes[np.minimum(self.token_start + 1, n - 1)] == 0x2F) if n else wordless
        self.cells = count(self.token_line, wordless | na)
        self.long = count(self.token_line, np.where(token_size >= 24, token_size, 0))
        # Other characters are few: they are counted by line and class at their places.
        at = np.flatnonzero(kind > _SPACE)
        what = kind[at]
        line = np.searchsorted(self.start, at, side="right") - 1
        by = np.bincount(line * 11 + what, minlength=k * 11)[: k * 11].reshape(k, 11)
        self.digits, self.commas, self.semis, self.pipes, self.tabs = (by[:, c] for c in (_DIGIT, _COMMA, _SEMICOLON, _PIPE, _TAB))
        self.markup = by[:, _MARKUP] + by[:, _PIPE]
        self.symbols = by[:, _SYMBOL] + self.markup
        sign = (what == _SYMBOL) | (what == _MARKUP) | (what == _PIPE)
        near = at[sign]
        beside = ((near > 0) & (kind[np.maximum(near - 1, 0)] == _LETTER)) | ((near < n - 1) & (kind[np.minimum(near + 1, n - 1)] == _LETTER)) if n else sign
        self.inner = count(line[sign], beside)
        dash = what == _DASH
        self.dashes = count(line[dash], codes[np.minimum(at[dash] + 1, n - 1)] == 32) if n else count(line[dash])
        double = np.flatnonzero((codes[1:] == 32) & (codes[:-1] == 32)) if n > 1 else np.zeros(0, np.int64)
        double = double[np.append(True, np.diff(double) > 1)[: len(double)]]  # one for each run of blanks
        self.gaps = count(np.searchsorted(self.start, double, side="right") - 1)
        # First and last tokens of a line.
        self.filled = filled = self.tokens > 0
        self.ends_sentence, self.bullet = np.zeros(k, bool), np.zeros(k, bool)
        if filled.any():
            new = np.append(True, self.token_line[1:] != self.token_line[:-1])
            f, g = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
            self.ends_sentence[filled] = t["terminal"][codes[self.token_end[g] - 1]]
            width = token_size[f]
            head, tail = codes[self.token_start[f]], codes[self.token_end[f] - 1]
            numbered = t["digit"][head] & np.isin(tail, [0x2E, 0x29, 0x3A]) & (width <= 5)
            self.bullet[filled] = (self.tokens[filled] > 1) & ((t["bullet"][head] & (width == 1)) | numbered)

    def structured(self) -> np.ndarray:
        """Lines that look like items or cells: short or full of cells, and not ending a sentence."""
        return self.filled & ~self.ends_sentence & ((self.words <= 4) | (self.cells * 3 >= self.tokens) | (self.pipes >= 2))

    def sentence(self) -> np.ndarray:
        return self.filled & self.ends_sentence & (self.words >= 6) & (self.cells * 4 <= self.tokens) & (self.markup * 20 <= self.size)

    def common_counts(self, common: np.ndarray) -> np.ndarray:
        at = np.searchsorted(common, self.word_hash)
        at[at == len(common)] = 0
        hit = common[at] == self.word_hash if len(common) else np.zeros(len(self.word_hash), bool)
        return np.bincount(self.word_line, hit, minlength=len(self.start)) if len(self.start) else np.zeros(0)

    def distinct_words(self) -> np.ndarray:
        """Distinct words of the lines with ten or more, else the number of words."""
        use = (self.words >= 10)[self.word_line] if len(self.word_line) else np.zeros(0, bool)
        key, line = self.word_hash[use], self.word_line[use]
        key = np.sort((key & np.uint64((1 << 36) - 1)) | (line.astype(np.uint64) << np.uint64(36)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        counts = np.bincount((key[new] >> np.uint64(36)).astype(np.int64), minlength=len(self.start))
        return np.where(self.words >= 10, counts, self.words)

    def patterns(self, common: np.ndarray, judged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit pattern of the functions that fire on each line, and its common words; a want of these tells something only in
        the rows judged."""
        known = self.common_counts(common)
        n_tok, n_word, size = np.maximum(self.tokens, 1), self.words, np.maximum(self.size, 1)
        share = known / np.maximum(n_tok, n_word)
        distinct = self.distinct_words()
        marks = self.commas + self.semis
        fires = [
            (share >= 0.12) & (n_word >= 5),
            self.ends_sentence & (n_word >= 4) & (self.cells * 3 < self.tokens) & (marks * 4 <= n_word),
            (n_word >= 12) & (share >= 0.08) & (marks * 4 <= n_word),
            (self.cells * 20 >= self.tokens * 7) & (self.tokens >= 2) & (self.symbols * 4 < size),
            (self.pipes >= 2) | (self.tabs >= 2) | ((self.semis >= 2) & (self.semis >= self.tokens - 1)),
            (self.gaps >= 2) & (self.cells >= 1),
            self.bullet & (share < 0.12),
            (n_word <= 6) & (share < 0.12) & ~self.ends_sentence & (n_word >= 1),
            (marks * 5 >= n_word * 2) & (n_word >= 5),
            (self.dashes >= 1) & (share < 0.08) & (n_word <= 10) & (n_word >= 2),
            self.symbols * 6 >= size,
            self.markup * 12 >= size,
            (n_word >= 10) & (distinct * 5 <= n_word * 2),
            self.long * 2 >= size,
            self.inner * 30 >= size,
            (share < 0.03) & (n_word >= 10) & judged[self.row],
        ]
        bits = np.zeros(len(self.start), np.int32)
        for i, f in enumerate(fires):
            bits |= (f & self.filled).astype(np.int32) << i
        return bits, known


def common_words(df: DataFrame, text: str, label: Column) -> tuple[np.ndarray, list[str]]:
    """Sorted hashes of the common words of all labels, and the labels that have such words. Every word of every task is counted;
    the driver gets the common ones, at most 1 / COMMON_SHARE times a text's words of each label."""
    rows = df.select(F.coalesce(label, F.lit("")).alias("label"), F.col(text).alias("text")).filter("text is not null")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        texts: dict[str, int] = {}

        def squeeze(parts: list) -> list:
            word, seen, plain, structured = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, back = np.unique(word, return_inverse=True)
            return [(keys, *(np.bincount(back, w) for w in (seen, plain, structured)))]

        for batch in batches:
            for part in blocks(batch, "text"):
                lines = Lines(part.column("text"))
                labels = part.column("label").to_pylist()
                names = sorted(set(labels))
                code = np.array([names.index(x) for x in labels])
                row = lines.row[lines.word_line]
                structured, sentence = lines.structured()[lines.word_line], lines.sentence()[lines.word_line]
                for i, name in enumerate(names):
                    own = (code[row] == i) & (lines.word_end - lines.word_start > 1)
                    texts[name] = texts.get(name, 0) + int((code == i).sum())
                    hashes, rows_ = lines.word_hash[own], row[own]
                    order = np.lexsort((hashes, rows_))
                    new = np.ones(len(order), bool)
                    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows_[order][1:] != rows_[order][:-1])
                    keys, back = np.unique(hashes, return_inverse=True)
                    first = np.zeros(len(hashes), bool)
                    first[order[new]] = True
                    counts = [np.bincount(back, w, minlength=len(keys)) for w in (first, sentence[own], structured[own])]
                    held.setdefault(name, []).append((keys, *counts))
                    if len(held[name]) > 8:
                        held[name] = squeeze(held[name])
        for name, parts in held.items():
            word, seen, plain, structured = squeeze(parts)[0]
            ids = np.append(word.view(np.int64), 0)  # 0 stands for the number of texts
            counts = [np.append(x, tail).astype(np.int64) for x, tail in ((seen, texts[name]), (plain, 0), (structured, 0))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids), *map(pa.array, counts)], ["label", "word", "seen", "plain", "structured"])

    counted = rows.mapInArrow(scan, "label string, word bigint, seen bigint, plain bigint, structured bigint")
    counts = materialize(counted.groupBy("label", "word").agg(*[F.sum(c).alias(c) for c in ("seen", "plain", "structured")]), "words")
    total = counts.filter("word = 0").select("label", F.col("seen").alias("texts"))
    chosen = (
        counts.filter("word <> 0")
        .join(F.broadcast(total), "label")  # one row for each label
        .filter((F.col("seen") >= LEAST_SEEN) & (F.col("seen") >= COMMON_SHARE * F.col("texts")) & (F.col("structured") <= STRUCTURED_SHARE * (F.col("plain") + F.col("structured"))))
    )
    found = chosen.groupBy("word").agg(F.collect_set("label").alias("labels")).toArrow()
    labels = sorted({x for own in found.column("labels").to_pylist() for x in own})
    return np.sort(found.column("word").to_numpy().view(np.uint64)), labels


def line_patterns(df: DataFrame, key: str, text: str, label: Column, common: np.ndarray, labels: list[str]) -> DataFrame:
    """One row for each text: key, its statistics, and the characters and lines by pattern. Texts of a label without common words
    are not judged by the want of them; those without a label may be of any."""
    shared = df.sparkSession.sparkContext.broadcast(common)  # bounded by the share: a label has few common words
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, n_chars bigint, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, "
        "ending_share double, common_share double, bits array<int>, chars array<bigint>, lines array<bigint>"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                lines = Lines(part.column("text"))
                bits, known = lines.patterns(shared.value, np.array(part.column("judged").to_pylist(), bool))
                n = part.num_rows
                use = lines.filled
                per = lambda x: np.bincount(lines.row[use], x[use], minlength=n)  # noqa: B023, E731
                words, chars, count = per(lines.words), per(lines.size), np.bincount(lines.row[use], minlength=n)
                ratio = lambda a, b: a / np.maximum(b, 1)
                pair = lines.row[use].astype(np.int64) << 32 | bits[use]
                keys, back = np.unique(pair, return_inverse=True)
                by_chars = np.bincount(back, lines.size[use], minlength=len(keys)).astype(np.int64)
                by_lines = np.bincount(back, minlength=len(keys)).astype(np.int64)
                at = pa.array(np.searchsorted(keys >> 32, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((keys & 0xFFFFFFFF).astype(np.int32), by_chars, by_lines)]
                stats = [chars.astype(np.int64), count, words.astype(np.int64), ratio(per(lines.letters), words), ratio(per(lines.symbols), chars), ratio(per(lines.digits), chars), ratio(per(lines.ends_sentence), count), ratio(per(known), words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *map(pa.array, stats), *lists],
                    ["key", "n_chars", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "ending_share", "common_share", "bits", "chars", "lines"],
                )

    judged = F.coalesce(label, F.lit("")).isin("", *labels)
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), judged.alias("judged")).mapInArrow(scan, schema)


def learn(histogram: dict[int, int], rounds: int = 200, prior: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(types' shares, chance that each function fires in each type, posterior of each pattern in sorted order).

    Expectation-maximisation of a latent type with functions that fire independently given it. The start says only what a
    function votes for; prior is the weight of the start against the data, so that a type keeps its meaning.
    """
    patterns = np.array(sorted(histogram), np.int64)
    weight = np.array([histogram[int(p)] for p in patterns], float)
    fired = (patterns[:, None] >> np.arange(len(FUNCTIONS)) & 1).astype(float)
    start = np.full((len(FUNCTIONS), len(TYPES)), 0.02)
    for i, (_, vote) in enumerate(FUNCTIONS):
        start[i, vote] = 0.5
    share, chance = np.array([0.7, 0.1, 0.1, 0.1]), start.copy()
    pseudo = max(1.0, prior * weight.sum())
    for _ in range(rounds):
        log = np.log(share) + fired @ np.log(chance) + (1 - fired) @ np.log(1 - chance)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        soft = post * weight[:, None]
        new_share = (soft.sum(0) + 1) / (soft.sum() + len(TYPES))
        new_chance = np.clip((fired.T @ soft + pseudo * start) / (soft.sum(0) + pseudo), 1e-4, 1 - 1e-4)
        moved = abs(new_chance - chance).max()
        share, chance = new_share, new_chance
        if moved < 1e-6:
            break
    return share, chance, post


def text_types(df: DataFrame, key: str, text: str, label: Column) -> DataFrame:
    """key, the statistics, the share of characters of each type by the posterior type of their lines, type and confidence."""
    spark = df.sparkSession
    common, labels = common_words(df, text, label)
    rows = materialize(line_patterns(df, key, text, label, common, labels), "lines")
    counts = rows.select(F.explode(F.arrays_zip("bits", "lines")).alias("x")).groupBy("x.bits").agg(F.sum("x.lines").alias("n")).collect()  # at most 2 ** functions
    histogram = {r["bits"]: r["n"] for r in counts} or {0: 1}
    _, _, post = learn(histogram)
    patterns = np.array(sorted(histogram), np.int64)
    shared = spark.sparkContext.broadcast((patterns, post))  # at most 2 ** functions rows
    kept = [c for c in rows.columns if c not in ("bits", "chars", "lines")]
    schema = rows.select(*kept).schema
    for name in (*TYPES, "soft"):
        schema = schema.add(name, "double")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, post = shared.value
        for batch in batches:
            lists = batch.column("bits")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            chance = post[np.searchsorted(patterns, lists.flatten().to_numpy(zero_copy_only=False))]
            chars = batch.column("chars").flatten().to_numpy(zero_copy_only=False)
            total = np.maximum(batch.column("n_chars").to_numpy(zero_copy_only=False), 1)
            share = lambda w: pa.array(np.bincount(row, w, minlength=len(lists)) / total)  # noqa: B023, E731
            best = chance >= chance.max(1, keepdims=True)
            columns = [*(share(best[:, i] * chars) for i in range(len(TYPES))), share(chance[:, 0] * chars)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *TYPES, "soft"])

    spread = rows.drop("lines").mapInArrow(weigh, schema)
    top = F.greatest(*[F.col(n) for n in TYPES[1:]])
    kind = F.when(F.col("n_lines") > 0, F.when(F.col("prose") >= 0.5, "prose").otherwise(F.coalesce(*[F.when(F.col(n) == top, F.lit(n)) for n in TYPES[1:]])))
    return spread.withColumn("type", kind).withColumn("confidence", F.when(F.col("n_lines") > 0, F.greatest("soft", 1 - F.col("soft")))).drop("soft").withColumnRenamed("key", key)
