"""Problem 10: sentence units of texts in any script, with their places, all in SQL expressions.

Full stops that end nothing (decimals, URLs, initials, ordinals, short forms) become private-use placeholders of the same
length, as do line ends inside hard-wrapped sentences; then boundary marks are set after the terminators of each script and
the text is split at them; the places follow from the lengths of the parts, and the unit's text is cut from the original, so
nothing needs to be undone. Each document is worked on alone: no shuffle, no limit on its length.

Defined results: null, empty and blank texts have no unit; private-use characters of the text itself are left as they are in
the units; a repeated document gives its units again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavuflow.llm.abbrev import INNER, NUMERIC

_DOT, _CUT, _WRAP, _OTHER = "", "", "", ""
# White space (and a wrapped line end), closing and opening marks, and terminators that need nothing after them.
_WS = "\\t-\\r \\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000" + _WRAP
_TRIM = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + _WRAP
_CLOSE = "\"'”’»)\\]」』）】〉》"
_OPEN = "\"'“”„«»‘’(\\[「『（¿¡"
_STOPS = ".!?…"
_FULL = "。！？｡।॥"
# Japanese particles after which a quotation goes on.
_GOES_ON = "と|って|の|が|は|を|に|も"
#: Parts whose places are appended one by one.
_BLOCK = 256
#: A wrapped line has so many characters at least and at most.
WRAP_LEAST, WRAP_MOST = 35, 110
#: Lines that surely go on are this share of a hard-wrapped text's lines; its lines fill this share of the width.
SURE_SHARE, FILLED = 0.2, 0.6


def _names(names: list[str]) -> str:
    return "|".join(sorted((n.replace(".", "[." + _DOT + "]") for n in names), key=len, reverse=True))


# A full stop that ends nothing: each case is told by what stands around the stop.
_MASK = (
    "\\.(?:"
    "(?=[\\p{Ll},;:/@_-])|(?<=\\p{N}\\.)(?=\\p{N})"  # URLs, dotted short forms, decimals
    "|(?<=(?<![\\p{L}\\p{M}])\\p{Lu}\\p{M}?\\.)"  # initials
    "|(?<=(?<![\\p{L}\\p{N}])[IVX]{2,5}\\p{Cf}?\\.)"  # Roman ordinals
    f"|(?<=(?<![\\p{{L}}\\p{{N}},])(?<!\\p{{N}}\\.)\\p{{Nd}}{{1,2}}\\.)(?<!(?<![\\p{{L}}\\p{{M}}])(?iu:{_names(NUMERIC)})\\.[{_WS}]{{0,2}}\\p{{Nd}}{{1,2}}\\.)"  # ordinals and item numbers
    f"|(?<=(?<![\\p{{L}}\\p{{M}}])(?iu:{_names(INNER)})\\.)"
    f"|(?<=(?<![\\p{{L}}\\p{{M}}])(?iu:{_names(NUMERIC)})\\.)(?=[{_WS}]*\\p{{N}})"
    ")"
)
_BEGIN = f"[{_OPEN}]*+[\\p{{Lu}}\\p{{Lt}}\\p{{IsHan}}\\p{{IsHiragana}}\\p{{IsKatakana}}\\p{{IsDevanagari}}\\p{{IsThai}}\\p{{N}}]"
# Possessive and never begun within a run of stops, so that a long run of marks or blanks is looked at once.
_BOUNDARY = (
    f"([{_STOPS}](?<=[^{_WS}|;].)(?<![{_STOPS}][{_STOPS}].)[{_STOPS}]*+[{_CLOSE}]*+)(?=[{_WS}\\p{{Cf}}]++[{_OPEN}]*+[\\p{{Lu}}\\p{{Lt}}\\p{{Lo}}\\p{{N}}\\p{{So}}]|{_BEGIN})"
    f"|((?<![{_FULL}])[{_FULL}]++(?:(?![{_CLOSE}])|[{_CLOSE}]++(?!{_GOES_ON})))"
)
_THAI = f"((?<=[\\u0e00-\\u0e7f\\p{{Nd}}])[ \\t\\u00a0\\u2000-\\u200a]++)(?=[\\u0e00-\\u0e7f])"
_LINE_END = "(\\r\\n|[\\n\\r\\u000b\\u000c\\u0085\\u2028\\u2029])"
_OPEN_LINE = f"[^\\n|\\t;]{{{WRAP_LEAST},{WRAP_MOST}}}"
# The stops of a table row, from its first bar on: each match begins where the last one ended.
_ROW_STOP = f"(?m)((?:^[ \\t]*+\\||\\G(?!^))[^\\n{_STOPS}{_FULL}]*+)[{_STOPS}{_FULL}]"
# A line of prose: five words or more, not more than three with digits, its last a word. Its length is judged first and no part
# is matched in two ways, so that the work is bounded by the line's length.
_DIGIT_WORD = "(?:[^\\n \\p{Nd}]*+ ++)*+[^\\n \\p{Nd}]*+\\p{Nd}[^\\n ]*+ ++"
_PROSE_LINE = f"(?={_OPEN_LINE} *+\\r?\\n)(?=(?:[^\\n ]*+ ){{4}})(?!(?:{_DIGIT_WORD}){{4}})({_OPEN_LINE})(?<=[\\p{{L}}\\p{{M}},])(?<!/a) *+\\r?\\n"
_SURE = f"(?m)^{_PROSE_LINE}(?=[\\p{{Ll}}])"
_SURE_CASELESS = f"(?m)^{_PROSE_LINE}(?=[\\u0900-\\u0963\\p{{Nd}}])"
_INNER_DANDA = "[।?!][”]? [\\u0900-\\u0963]"
_ANY = f"(?m)^({_OPEN_LINE})\\n(?=\\S)"


def _unwrapped(text: Column) -> Column:
    """text with the line ends inside wrapped sentences masked. A text is hard-wrapped if enough of its longer lines surely go
    on: they end without a mark and the next begins in lower case (without cases: in a letter, if sentences end within lines)."""
    sure = F.when(text.rlike(_INNER_DANDA), F.regexp_extract_all(text, F.lit(_SURE_CASELESS), F.lit(1))).otherwise(F.regexp_extract_all(text, F.lit(_SURE), F.lit(1)))
    return F.struct(sure.alias("sure"), F.size(F.regexp_extract_all(text, F.lit(_ANY), F.lit(1))).alias("lines"))


def _places(parts: str, begin: str, raw: str | None) -> str:
    """SQL: the places of the parts that are not blank, without white space at their ends; the first part stands at begin, where
    raw (the original text, if the units are wanted too) begins."""
    trim = _TRIM.replace("'", "''")
    start, end = f"a.at + char_length(x) - char_length(trim(leading '{trim}' from x))", f"a.at + char_length(trim(trailing '{trim}' from x))"
    unit = f", 'u', substring({raw}, {start} - {begin} + 1, char_length(trim(both '{trim}' from x)))" if raw else ""
    return f"""aggregate({parts}, named_struct('at', {begin}, 'out', cast(array() as array<struct<s:int,e:int{',u:string' if raw else ''}>>)), (a, x) -> named_struct(
              'at', a.at + char_length(x),
              'out', if(char_length(trim(both '{trim}' from x)) = 0, a.out, array_append(a.out, named_struct('s', {start}, 'e', {end}{unit})))), a -> a.out)"""


def units(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """(key, start_at, end_at, unit): the sentence units, their places in code points (end exclusive); unit only if wanted."""
    raw = F.col("raw")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("raw")).filter("raw is not null")
    private = raw.contains(_DOT) | raw.contains(_CUT) | raw.contains(_WRAP)
    safe = F.when(private, F.translate(raw, _DOT + _CUT + _WRAP, _OTHER * 3)).otherwise(raw)
    # Only texts with a line that may go on are looked at closely.
    maybe = raw.rlike("\\n[\\p{Ll}\\u0900-\\u0963\\p{Nd}]")
    rows = rows.select("key", "raw", safe.alias("t"), F.when(maybe, _unwrapped(safe)).alias("w"))
    width = F.expr("array_max(transform(w.sure, x -> char_length(x)))")
    wrapped = F.col("w").isNotNull() & (F.size("w.sure") > 0) & (F.size("w.sure") >= F.col("w.lines") * SURE_SHARE)
    pattern = F.concat(
        F.lit("\\n(?<=(?:^|\\n)[^\\n]{"), F.floor(width * FILLED).cast("string"), F.lit(","), F.ceil(width * 1.2).cast("string"), F.lit("}\\n)(?=[^\\s*•·–—|-]|[–—-] \\p{Ll})")
    )
    t = F.when(wrapped, F.regexp_replace("t", pattern, F.lit(_WRAP))).otherwise(F.col("t"))
    rows = rows.select("key", "raw", t.alias("t"))
    t = F.when(F.col("t").contains("|"), F.regexp_replace("t", _ROW_STOP, "$1" + _DOT)).otherwise(F.col("t"))
    t = F.regexp_replace(t, _LINE_END, "$1" + _CUT)
    t = F.regexp_replace(t, _MASK, _DOT)
    t = F.regexp_replace(t, _BOUNDARY, "$1$2" + _CUT)
    wide = F.octet_length(F.col("t")) - F.char_length(F.col("t")) >= 4  # two letters of three bytes: cheaper to see
    t = F.when(wide & F.col("t").rlike("[\\u0e00-\\u0e7f]"), F.regexp_replace(t, _THAI, "$1" + _CUT)).otherwise(t)
    parts = rows.select("key", *(["raw"] if with_text else []), F.split(t, _CUT).alias("p"))
    # The places of few parts are appended one by one, those of many by blocks, as an append copies what is there and a cut of
    # the text counts from its beginning.
    own, last = f"slice(p, i * {_BLOCK} + 1, {_BLOCK})", f"cast((size(p) + {_BLOCK - 1}) / {_BLOCK} as int) - 1"
    size = f"aggregate({own}, 0, (s, x) -> s + char_length(x))"
    kind, held = (",raw:string", f", 'raw', substring(raw, a.at + 1, {size})") if with_text else ("", "")
    begins = f"""aggregate(sequence(0, {last}), named_struct('at', 0, 'out', cast(array() as array<struct<i:int,at:int{kind}>>)),
        (a, i) -> named_struct('at', a.at + {size}, 'out', array_append(a.out, named_struct('i', i, 'at', a.at{held}))), a -> a.out)"""
    blocks = f"flatten(transform({begins}, b -> {_places(own.replace('i *', 'b.i *'), 'b.at', 'b.raw' if with_text else None)}))"
    places = F.expr(f"if(size(p) <= {_BLOCK}, {_places('p', '0', 'raw' if with_text else None)}, {blocks})")
    found = parts.select("key", F.explode(places).alias("u"))
    out = [F.col("key").alias(key), F.col("u.s").alias("start_at"), F.col("u.e").alias("end_at")]
    if with_text:
        out.append(F.col("u.u").alias("unit"))
    return found.select(*out)
