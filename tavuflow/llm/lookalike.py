"""Problem 3: one consistent form for text that looks the same.

``consistent_form`` adds a column in which characters that are drawn alike are one character. All work is done on numpy
code-point arrays of whole Arrow blocks: a table gather with expansion offsets (width, script and encoding of a letter, kinds
of space, invisible characters), then canonical decomposition order, then composition of base and mark pair by pair.

Defined results: null gives null, the empty text the empty text; a text of invisible characters only gives the empty text.
Case, visible accents, missing dots and raised digits are kept. Extra columns pass through; rows are never merged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.llm.codepoints import assigned, blocks, to_arrow, to_codes, valid_rows
from tavuflow.session import bounded, materialize

# Letters of other scripts that are drawn like a Latin one, and the Latin letters. Cyrillic, Greek, Armenian, Latin
# variants, then Cherokee, Lisu and Coptic.
ALIKE = {
    "АВЕКМНОРСТХУІЅЈԚԜӀӘ": "ABEKMHOPCTXYISJQWIƏ",
    "аеорсухіѕјһԁԛԝӏә": "aeopcyxisjhdqwlə",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿͿ": "ABEZHIKMNOPTYXCƆJ",
    "οϲϳ": "ocj",
    "ՕօհոսցԼ": "OohnugL",
    "ɡɑ": "ga",
    "ǝƎ": "əƎ",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴ": "DRTAJEWMHGZRWVSLCPKB",
    "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPdDTGKJCZFMNLSRVHWXYAEIOU",
    "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ": "HIKMNOPCTYXopc",
    "‐‑": "--",
    "µ": "μ",
}
# Drawn alike though Unicode has no mapping of the spaces' widths.
SPACE_CLASSES = ("Zs",)
# Characters that are not drawn, besides those of category Cf.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# Format characters that are drawn.
DRAWN_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2, 0x0890, 0x0891, 0x110BD, 0x110CD]
# Kinds of compatibility mapping that leave the look as it is.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_LIMIT = 0x110000
_HANGUL = (0xAC00, 0xD7A4)


def _expansion(cp: int) -> str:
    """What a character stands for, fully decomposed."""
    ch = chr(cp)
    category = unicodedata.category(ch)
    if cp in _invisible() or (category == "Cf" and cp not in _drawn()):
        return ""
    if category in SPACE_CLASSES:
        return " "
    if ch in _alike():
        return _alike()[ch]
    mapping = unicodedata.decomposition(ch)
    if not mapping:
        return ch
    kind, *parts = mapping.split() if mapping[0] == "<" else ("", *mapping.split())
    ligature = kind == "<compat>" and category[0] == "L" and len(parts) > 1 and parts[0] != "0020"
    roman = kind == "<compat>" and category == "Nl"
    if kind and kind not in SAME_LOOK and not ligature and not roman:
        return ch
    return "".join(_expansion(int(p, 16)) for p in parts)


@lru_cache
def _alike() -> dict[str, str]:
    return {a: b for x, y in ALIKE.items() for a, b in zip(x, y, strict=True)}


@lru_cache
def _invisible() -> frozenset:
    return frozenset(INVISIBLE)


@lru_cache
def _drawn() -> frozenset:
    return frozenset(DRAWN_FORMAT)


class Tables:
    """Lookup tables made from the Unicode database by the rules above."""

    def __init__(self) -> None:
        self.single = np.arange(_LIMIT, dtype=np.uint32)  # where one character becomes one
        self.size = np.ones(_LIMIT, np.uint8)
        self.start = np.zeros(_LIMIT, np.uint32)
        self.rank = np.zeros(_LIMIT, np.uint8)  # canonical combining class
        pool: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for cp in assigned():
            if _HANGUL[0] <= cp < _HANGUL[1]:
                continue
            ch = chr(cp)
            self.rank[cp] = unicodedata.combining(ch)
            mapping = unicodedata.decomposition(ch)
            if not mapping and ch not in _alike() and unicodedata.category(ch) not in ("Cf", "Zs") and cp not in _invisible():
                continue
            out = [ord(x) for x in _expansion(cp)]
            if len(out) == 1:
                self.single[cp] = out[0]
            else:
                self.size[cp], self.start[cp] = len(out), len(pool)
                pool += out
            if mapping and mapping[0] != "<":
                parts = [int(x, 16) for x in mapping.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                    first = _expansion(parts[0])
                    base = ord(unicodedata.normalize("NFC", first)) if len(unicodedata.normalize("NFC", first)) == 1 else parts[0]
                    mark = ord(_expansion(parts[1])[0]) if _expansion(parts[1]) else parts[1]
                    pairs.setdefault((base, mark), cp)
                    if base == parts[0]:
                        pairs[base, mark] = cp
        self.pool = np.array(pool, np.uint32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array([*pairs.values()], np.uint32)[order]
        self.is_mark = self.rank > 0
        self.second = np.zeros(_LIMIT, bool)  # can be the second of a pair
        self.second[[b for _, b in pairs]] = True
        # Characters that stay as they are unless a mark or a part of a pair stands beside them.
        stable = (self.size == 1) & (self.single == np.arange(_LIMIT))
        for cp in np.flatnonzero(self.size > 1).tolist():
            stable[cp] = unicodedata.normalize("NFC", "".join(map(chr, self.pool[self.start[cp] : self.start[cp] + self.size[cp]]))) == chr(cp)
        self.plain = stable & ~self.is_mark & ~self.second


@lru_cache
def tables() -> Tables:
    return Tables()


def _expand(codes: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    size = t.size[codes]
    if (size == 1).all():
        return t.single[codes], offsets
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    out = np.repeat(t.single[codes], size)
    many = np.flatnonzero(size > 1)
    if len(many):
        n = size[many].astype(np.int64)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends[many], n) + inner] = t.pool[np.repeat(t.start[codes[many]].astype(np.int64), n) + inner]
    return out, ends[offsets]


def _order_marks(codes: np.ndarray, offsets: np.ndarray, t: Tables) -> np.ndarray:
    """Sort each run of marks by combining class, keeping the order of equals."""
    rank = t.rank[codes]
    wrong = (rank[1:] > 0) & (rank[:-1] > rank[1:])
    inner = offsets[1:-1]
    wrong[inner[(inner > 0) & (inner < len(codes))] - 1] = False
    if not wrong.any():
        return codes
    starter = rank == 0
    starter[inner[inner < len(codes)]] = True
    run = np.cumsum(starter)
    order = np.lexsort((rank, run)) if len(codes) else np.zeros(0, np.int64)
    return codes[order]


def _compose(codes: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Join a base with the next character while a composed form of the two exists, first marks first."""
    codes = codes.copy()
    while len(codes) > 1:
        # Candidates only: places whose character can be the second of a pair, next to what stands before it.
        at = np.flatnonzero(t.second[codes])
        heads = offsets[:-1]
        at = at[(at > 0)]
        at = at[~np.isin(at, heads)] if len(at) else at
        if not len(at):
            break
        # The base is the nearest starter before; it is not blocked by a mark of the same or a higher class between.
        base = at - 1
        rank = t.rank
        moving = (rank[codes[base]] > 0) & (rank[codes[base]] < rank[codes[at]])
        while moving.any():
            base[moving] -= 1
            stuck = base < 0
            base[stuck] = 0
            moving = ~stuck & (rank[codes[base]] > 0) & (rank[codes[base]] < rank[codes[at]]) & moving
        keys = (codes[base].astype(np.int64) << 32) | codes[at]
        found = np.searchsorted(t.pair_keys, keys)
        found[found == len(t.pair_keys)] = 0
        row = np.searchsorted(offsets, at, side="right")
        hit = (t.pair_keys[found] == keys) & (np.searchsorted(offsets, base, side="right") == row)
        # One mark at a time for each base: the first that fits.
        at, base, to = at[hit], base[hit], t.pair_to[found[hit]]
        if not len(at):
            break
        _, first = np.unique(base, return_index=True)
        at, base, to = at[first], base[first], to[first]
        # A place cannot be taken as a mark while it serves as a base in the same round.
        free = ~np.isin(at, base)
        at, base, to = at[free], base[free], to[free]
        codes[base] = to
        keep = np.ones(len(codes), bool)
        keep[at] = False
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=ends[1:])
        codes, offsets = codes[keep], ends[offsets]
    return codes, offsets


def normalize_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of rows given as code points and offsets."""
    t = tables()
    plain = t.plain[codes]
    if plain.all():
        return codes, offsets
    # Only rows with a character that changes or combines are worked on.
    touched = np.zeros(len(offsets) - 1, bool)
    touched[np.searchsorted(offsets, np.flatnonzero(~plain), side="right") - 1] = True
    spans = np.diff(offsets)
    inside = np.repeat(touched, spans)
    part = np.zeros(len(offsets), np.int64)
    np.cumsum(np.where(touched, spans, 0), out=part[1:])
    sub, sub_offsets = _expand(codes[inside], part, t)
    sub = _order_marks(sub, sub_offsets, t)
    sub, sub_offsets = _compose(sub, sub_offsets, t)
    if touched.all():
        return sub, sub_offsets
    out_spans = np.where(touched, np.diff(sub_offsets), spans)
    out_offsets = np.zeros(len(offsets), np.int64)
    np.cumsum(out_spans, out=out_offsets[1:])
    out = np.empty(out_offsets[-1], np.uint32)
    into = np.repeat(touched, out_spans)
    out[into], out[~into] = sub, codes[~inside]
    return out, out_offsets


def normalize_array(column: pa.Array) -> pa.Array:
    codes, offsets = to_codes(column)
    return to_arrow(*normalize_codes(codes, offsets), valid_rows(column))


def normalize_text(text: str) -> str:
    """The consistent form of one text (for tests and small tables)."""
    return normalize_array(pa.array([text])).to_pylist()[0]


def consistent_form(df: DataFrame, text: str, into: str = "consistent") -> DataFrame:
    """df with the column into: the consistent form of text. A column of that name is replaced."""
    kept = [f for f in df.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                arrays = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*arrays, normalize_array(part.column(text))], [*names, into])

    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*names, text])]).mapInArrow(run, schema)


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, raw_md5, form_md5) of the rows with a text."""
    formed = consistent_form(df.select(F.col(key), F.col(text).alias("raw")).filter(F.col("raw").isNotNull()), "raw", "form")
    return formed.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5("raw")).alias("raw_md5"), F.unhex(F.md5("form")).alias("form_md5"))


def same_look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class_id, spellings): one row for each row with a text; class_id is the least id of those that look the same,
    spellings the number of different strings among them. Digests alone are shuffled, and a crowd costs a row each."""
    rows = materialize(_digests(df, key, text), "looks")
    per = rows.groupBy("form_md5", "raw_md5").agg(F.min("id").alias("id")).groupBy("form_md5").agg(F.min("id").alias("class_id"), F.count("*").alias("spellings"))
    several = materialize(per, "classes")
    return rows.join(bounded(several), "form_md5").select("id", "class_id", "spellings")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (id_a, id_b), the smaller first, of rows whose texts look the same but are different strings.

    Only digests of the raw and the consistent form are shuffled. Spellings are paired first, each once however many rows
    share it, then joined to their rows: a crowd of exact copies is never compared with itself, and each step's rows are
    bounded by the result's.
    """
    digests = _digests(df, key, text)
    forms = digests.groupBy("form_md5").agg(F.min("raw_md5").alias("lo"), F.max("raw_md5").alias("hi")).filter("lo <> hi").select("form_md5")
    rows = materialize(digests.join(forms, "form_md5", "left_semi"), "spellings")
    spellings = rows.select("form_md5", "raw_md5").distinct()
    pairs = spellings.withColumnRenamed("raw_md5", "raw_a").join(spellings.withColumnRenamed("raw_md5", "raw_b"), "form_md5").filter("raw_a < raw_b").select("raw_a", "raw_b")
    a, b = (rows.select(F.col("raw_md5").alias(f"raw_{s}"), F.col("id").alias(s)) for s in "xy")
    met = pairs.join(a.withColumnRenamed("raw_x", "raw_a"), "raw_a").join(b.withColumnRenamed("raw_y", "raw_b"), "raw_b")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a <> id_b").distinct()


def same_look_words(words: DataFrame, key: str, word: str, clean: DataFrame, clean_key: str, clean_word: str) -> DataFrame:
    """(id_a, id_b): rows of words whose word looks like a clean word but is another string. Nulls match nothing."""
    left = consistent_form(words.select(F.col(key).cast("long").alias("id_a"), F.col(word).alias("raw")).filter(F.col("raw").isNotNull()), "raw", "form")
    right = consistent_form(clean.select(F.col(clean_key).cast("long").alias("id_b"), F.col(clean_word).alias("entry")).filter(F.col("entry").isNotNull()), "entry", "form")
    return left.join(bounded(right), "form").filter(F.col("raw") != F.col("entry")).select("id_a", "id_b").distinct()
