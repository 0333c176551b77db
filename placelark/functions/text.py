"""Folding, tokens and spelling variants.

`fold` has two paths: characters of the table below are folded inside the plan; a text with any other character goes
through an Arrow function over Unicode data. Both give the same result.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SINGLES = {"ł": "l", "đ": "d", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i", "İ": "i", "ς": "σ"}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "ђ": "dj", "е": "e", "ж": "z", "з": "z", "и": "i", "ј": "j", "к": "k", "л": "l", "љ": "lj", "м": "m", "н": "n", "њ": "nj", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "ћ": "c", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "c", "џ": "dz", "ш": "s",
    "ѓ": "gj", "ќ": "kj", "ѕ": "dz", "ѐ": "e", "ѝ": "i", "ё": "e", "є": "e", "і": "i", "ї": "i", "й": "j", "ґ": "g", "ў": "u", "щ": "s", "ы": "y", "э": "e", "ю": "u", "я": "a", "ь": "", "ъ": "a",
}
ABBREVIATIONS = {
    "nam": "namesti", "namesti": "namesti", "ul": "ulice", "tr": "trida", "nabr": "nabrezi", "sv": "svaty", "gen": "generala", "kpt": "kapitana", "arm": "armady", "prof": "profesora",
    "al": "aleja", "aleje": "aleja", "alei": "aleja", "pl": "plac", "os": "osiedle", "sw": "swiety", "ks": "ksiedza", "mjr": "majora", "plk": "pulkownika", "st": "street", "str": "street", "rd": "road", "ave": "avenue",
}
GENERIC = "ulice ulica street road avenue namesti plac aleja trida osiedle nabrezi rynek".split()
UNSPACED = "぀-ゟ゠-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
#: Accented Latin letters with one base letter, by rule: what decomposes to an ASCII letter and marks.
_LATIN = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250) if chr(c).islower() and unicodedata.normalize("NFKD", chr(c))[0].isascii() and all(unicodedata.category(x) == "Mn" for x in unicodedata.normalize("NFKD", chr(c))[1:])}
_ABBREVIATIONS = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in ABBREVIATIONS.items()) + ")"
_GENERIC = "array(" + ", ".join(f"'{x}'" for x in GENERIC) + ")"
_unspaced = re.compile(f"[{UNSPACED}]+|[^{UNSPACED}]+")


def fold_py(s: str | None) -> str:
    s = "".join(SINGLES.get(c, c) for c in (s or "").lower())
    s = unicodedata.normalize("NFKD", "".join(CYRILLIC.get(c, c) for c in s))
    s = "".join(SINGLES.get(c, c) for c in s if unicodedata.category(c) != "Mn" or c in "゙゚")
    s = unicodedata.normalize("NFC", s)
    return " ".join("".join(c.lower() if unicodedata.category(c)[0] in "LN" or c in "゙゚" else " " for c in s).split())


def segment_py(token: str) -> list[str]:
    out = []
    for run in _unspaced.findall(token):
        if re.match(f"[{UNSPACED}]", run) and len(run) > 1:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


def tokens_py(s: str | None) -> list[str]:
    full = [ABBREVIATIONS.get(t, t) for t in fold_py(s).split()]
    short = [t for t in full if t not in GENERIC] or full
    return [x for t in short for x in segment_py(t)]


def expand_umlauts(s: str) -> str | None:
    n = unicodedata.normalize("NFC", s)
    out = n.translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}))
    return out if out != n else None


def collapse_digraphs(token: str) -> str:
    out = ""
    i = 0
    while i < len(token):
        c = token[i]
        if c in "aou" and token[i + 1 : i + 2] == "e" and (not out or out[-1] not in "aeiouy"):
            i += 1
        out += c
        i += 1
    return out


def collapse_sibilants(token: str) -> str:
    return re.sub("s{3,}", "ss", token)


def index_tokens_py(s: str | None) -> list[str]:
    base = tokens_py(s)
    wide = expand_umlauts(s or "")
    found = base + (tokens_py(wide) if wide else [])
    return list(dict.fromkeys(found + [collapse_sibilants(t) for t in found]))


def token_variants_py(t: str, alt: str | None = None) -> list[str]:
    forms = [t, alt or t, collapse_digraphs(t), collapse_sibilants(t), collapse_sibilants(collapse_digraphs(t))]
    return list(dict.fromkeys(forms))


def query_variants_py(s: str | None) -> list[list[str]]:
    base, wide = tokens_py(s), expand_umlauts(s or "")
    alt = tokens_py(wide) if wide else base
    alt = alt if len(alt) == len(base) else base
    return [token_variants_py(t, a) for t, a in zip(base, alt, strict=True)]


def _lists(f, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def _odd(c: Column) -> Column:
    """Whether a text has a character that native_fold does not fold: other scripts go through Python, which keeps the plan short."""
    known = "".join(sorted({**_LATIN, **{k: v for k, v in SINGLES.items() if k not in "ςİ"}}))
    return F.coalesce(c.rlike(f"[^\\x00-\\x7f{known}{known.upper().replace('SS', '')}–—‘’“”¿¡]"), F.lit(False))


def _dual(c: Column, odd: Column, native: Column, f, kind: str) -> Column:
    # null on the usual path: only odd texts cost the trip through Python
    return F.when(odd, _lists(lambda x: None if x is None else f(x), kind)(F.when(odd, c))).otherwise(native)


def fold(c: Column) -> Column:
    """The folded text; null stays null."""
    return _dual(c, _odd(c), native_fold(c), fold_py, "string")


def tokens(c: Column) -> Column:
    """Tokens of any script: abbreviations spelled out, generic words dropped unless nothing is left, unspaced scripts in bigrams."""
    return _dual(c, _odd(c), _spelled(native_fold(c)), tokens_py, "array<string>")


def index_tokens(c: Column) -> Column:
    """What the index holds of a name of any script."""
    return _dual(c, _odd(c), _indexed(c, lambda x: _spelled(native_fold(x))), index_tokens_py, "array<string>")


def each(c: Column, native, f) -> Column:
    """f of each text of an array: native where no text is odd."""
    texts = F.coalesce(c, F.array().cast("array<string>"))
    return _dual(texts, F.exists(texts, _odd), F.transform(texts, native), lambda xs: [f(x) for x in xs], "array<array<string>>")


def tokens_each(c: Column) -> Column:
    return each(c, lambda x: _spelled(native_fold(x)), tokens_py)


def index_tokens_each(c: Column) -> Column:
    return each(c, lambda x: _indexed(x, lambda y: _spelled(native_fold(y))), index_tokens_py)


def native_fold(c: Column) -> Column:
    """fold for columns known to hold the table's characters alone: no Python in the plan."""
    one = {k: v for k, v in {**_LATIN, **SINGLES}.items() if len(v) == 1 and k not in "ςİ"}
    out = F.translate(F.lower(c), "".join(one), "".join(one.values()))
    for k, v in {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "))


def _spelled(folded: Column) -> Column:
    m, generic = F.expr(_ABBREVIATIONS), F.expr(_GENERIC)  # literals of one expression each: the plan is made in less time
    words = F.filter(F.split(folded, " "), lambda t: t != "")
    full = F.transform(words, lambda t: F.coalesce(F.try_element_at(m, t), t))
    short = F.filter(full, lambda t: ~F.array_contains(generic, t))
    return F.when(F.size(short) > 0, short).otherwise(full)


def _indexed(c: Column, tokens_of) -> Column:
    wide = F.replace(F.replace(F.replace(F.lower(c), F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue"))
    found = F.concat(tokens_of(c), tokens_of(wide))
    return F.array_distinct(F.concat(found, F.transform(found, lambda t: F.regexp_replace(t, "s{3,}", "ss"))))


def native_tokens(c: Column) -> Column:
    """tokens over native_fold."""
    return _spelled(native_fold(c))


def native_index_tokens(c: Column) -> Column:
    return _indexed(c, native_tokens)


def register(spark) -> None:
    """SQL names of the text and distance functions. The latter are SQL functions: no Python in their plans."""
    spark.udf.register("fold", _lists(fold_py, "string"))
    spark.udf.register("tokens", _lists(tokens_py, "array<string>"))
    spark.udf.register("index_tokens", _lists(index_tokens_py, "array<string>"))
    spark.udf.register("query_variants", _lists(query_variants_py, "array<array<string>>"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN "
        "2 * 6371008.8D * asin(sqrt(least(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2), 1D)))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cell_key(lat DOUBLE, lon DOUBLE) RETURNS BIGINT RETURN (floor(lat / 0.05D) + 4096) * 16384 + floor(lon / 0.05D) + 4096")
