"""Text functions: trimming, folding, tokens, names, message markup."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: White space as Unicode has it, with the four ASCII separators; the engines' own classes differ.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Vietnamese letters and what they fold to; y counts as i.
FOLDS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ",
    "e": "èéẻẽẹêềếểễệ",
    "i": "ìíỉĩịyỳýỷỹỵ",
    "o": "òóỏõọôồốổỗộơờớởỡợ",
    "u": "ùúủũụưừứửữự",
    "d": "đ",
}
FROM = "".join(FOLDS.values())
TO = "".join(base * len(letters) for base, letters in FOLDS.items())
DISPLAY = {"itviec": "ITviec", "careerlink": "CareerLink", "vieclam24h": "ViecLam24h", "jooble": "Jooble", "careerviet": "CareerViet", "timviec365": "TimViec365"}
MARKUP = r"_*\[\]()~`>#+\-=|{}.!"


@pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode normal form C: the one text function without a built-in. Use it once, at ingest."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x`` with ``x`` evaluated once, however often ``f`` uses it; branches would repeat it."""
    return F.transform(F.array(x), f)[0]


#: Characters that normal form C keeps, whatever stands beside them: Latin, Vietnamese letters, common signs, Han, emoji.
SETTLED = r"\x{0}-\x{2ff}\x{1ea0}-\x{1ef9}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{4e00}-\x{9fff}\x{1f300}-\x{1faff}"


def composed(x: Column) -> Column:
    """Normal form C. Texts of ``SETTLED`` characters only, nearly all, are in it; Python sees no others."""
    return F.coalesce(nfc(F.when(x.rlike(f"[^{SETTLED}]"), x)), x)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(x: Column) -> Column:
    """Lower case, trimmed, white space as single spaces. Expects normal form C (see ``nfc``)."""
    return F.regexp_replace(strip(F.lower(x)), f"[{SPACE}]+", " ")


def clean_text(x: Column) -> Column:
    """Lower case without Vietnamese accents, y as i; null gives the empty text."""
    return F.coalesce(F.translate(F.lower(x), FROM, TO), F.lit(""))


def tokens(x: Column, fold: bool = True) -> Column:
    """Search words of two characters at least; without any, the whole text."""
    whole = clean_text(x) if fold else F.lower(F.coalesce(x, F.lit("")))
    some = F.filter(F.split(whole, rf"[,{SPACE}\-/|]+"), lambda t: F.length(t) > 1)
    return F.when(F.size(some) > 0, some).otherwise(F.array(whole if fold else strip(whole)))


def keyword_and_place(x: Column) -> Column:
    """struct(keyword, location) of a query: split at the first bar, else at the first comma."""

    def cut(mark: str) -> Column:
        at = F.instr(x, mark)
        return F.struct(strip(F.substring(x, F.lit(1), at - 1)).alias("keyword"), strip(F.substring(x, at + 1, F.length(x))).alias("location"))

    whole = F.struct(strip(x).alias("keyword"), F.lit(None).cast("string").alias("location"))
    return F.when(F.contains(x, F.lit("|")), cut("|")).when(F.contains(x, F.lit(",")), cut(",")).otherwise(whole)


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


def source_name(x: Column) -> Column:
    out = capitalize(x)
    for key, shown in reversed(DISPLAY.items()):
        out = F.when(F.lower(x) == key, shown).otherwise(out)
    return out


def escape_markup(x: Column) -> Column:
    return F.regexp_replace(x, f"([{MARKUP}])", r"\\$1")


def unescape_markup(x: Column) -> Column:
    return F.regexp_replace(x, rf"\\([{MARKUP}])", "$1")


def encode_path(x: Column) -> Column:
    """Percent encoding with no character kept but letters, digits and _.-~."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
