"""Labels of languages in their different writings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and English names.
NAMES = {
    "fi": "finnish", "tr": "turkish", "sw": "swahili", "hu": "hungarian", "en": "english", "sv": "swedish", "et": "estonian",
    "az": "azerbaijani", "ja": "japanese", "zh": "chinese", "hi": "hindi", "th": "thai",
}


def language_code(label: Column) -> Column:
    """The code a label stands for, whatever its case and the blanks around it; null if it names no language."""
    plain = F.lower(F.regexp_replace(label, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))
    names = F.create_map(*[F.lit(x) for code, name in NAMES.items() for key in (code, name) for x in (key, code)])
    return F.when(plain.isNotNull(), names[plain])
