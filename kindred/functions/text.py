"""Normalisation, tokenisation and grams as Spark expressions.

Only text outside ASCII passes through Python, for Unicode normal forms and
one-to-one lower case; ASCII rows stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidQGramSize


@dataclass(frozen=True)
class NormalisationOptions:
    lowercase: bool = True
    strip_separators: bool = True
    separator_chars: str = "_-.:/"
    split_camel_case: bool = True
    nfc: bool = True
    strip_diacritics: bool = False


@dataclass(frozen=True)
class TokeniseOptions:
    lowercase: bool = True
    split_camel_case: bool = True
    split_consecutive_upper: bool = True
    separator_chars: str = "_-.:/ \t\n\r"


def byte_view(c: Column) -> Column:
    """One character per UTF-8 byte, so character functions count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _class(chars: str) -> str:
    return "[" + "".join("\\x{%x}" % ord(c) for c in chars) + "]"


def _simple_lower(s: str) -> str:
    """Lower case one code point at a time, keeping those whose lower case is longer."""
    return "".join(low[0] if len(low := c.lower()) == 1 or c == "İ" else c for c in s)


_BEYOND_ASCII = r"[^\x00-\x7F]"


def _beyond(c: Column) -> Column:
    """``c`` where it has a character outside ASCII, else null: what Python is sent."""
    return F.when(c.rlike(_BEYOND_ASCII), c)


def normalise(c: Column, options: NormalisationOptions = NormalisationOptions()) -> Column:
    """Normal form, camel case split by a space, lower case, separators folded to one space and trimmed.

    Digits are no camel boundary here. ``strip_diacritics`` overrides ``nfc``. Null gives null.
    """
    out = c
    if options.split_camel_case:
        out = F.regexp_replace(out, r"(?<=[a-z])(?=[A-Z])", " ")
    if options.lowercase:
        out = F.lower(out)
    if options.strip_separators:
        out = F.trim(F.regexp_replace(out, _class(options.separator_chars + " \t\n\r\x0b\x0c") + "+", " "))

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: py_normalise(x, options), na_action="ignore")

    return F.when(c.rlike(_BEYOND_ASCII), F.pandas_udf(run, T.StringType())(_beyond(c))).otherwise(out)


def tokenise(c: Column, options: TokeniseOptions = TokeniseOptions()) -> Column:
    """Tokens in order, none empty: cut at separators, before an upper case letter after any
    other character, and before the last capital of a run that a lower case letter follows."""
    cuts = [_class(options.separator_chars)] if options.separator_chars else []
    if options.split_camel_case:
        cuts.append(r"(?<=\P{Lu})(?=\p{Lu})")
        if options.split_consecutive_upper:
            cuts.append(r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
    parts = F.filter(F.split(c, "|".join(cuts)) if cuts else F.array(c), lambda x: x != "")
    return F.transform(parts, simple_lower) if options.lowercase else parts


def simple_lower(c: Column) -> Column:
    """Lower case one code point at a time: the two characters whose lower case hangs on their place or is longer are set first."""
    return F.lower(F.translate(c, "Σİ", "σi"))


def grams(c: Column, n: int) -> Column:
    """Every window of n characters, repeats included, no padding; none if the text is shorter."""
    if n < 1:
        raise InvalidQGramSize(f"gram size {n} is below 1")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, windows).otherwise(F.when(c.isNotNull(), F.expr("cast(array() AS array<string>)")))


# the same on Python strings, for kernels and tests

_SPLIT_CACHE: dict = {}


def py_tokenise(s: str) -> list[str]:
    """Default tokens of a Python string."""
    out = _SPLIT_CACHE.get(s)
    if out is None:
        out, cur = [], ""
        for i, ch in enumerate(s):
            if ch in "_-.:/ \t\n\r":
                if cur:
                    out.append(cur)
                cur = ""
                continue
            if cur and _upper(ch):
                prev = s[i - 1]
                if not _upper(prev) or (i + 1 < len(s) and _lower_letter(s[i + 1])):
                    out.append(cur)
                    cur = ""
            cur += ch
        if cur:
            out.append(cur)
        out = [_simple_lower(t) for t in out]
        if len(_SPLIT_CACHE) > 100_000:
            _SPLIT_CACHE.clear()
        _SPLIT_CACHE[s] = out
    return out


def _upper(c: str) -> bool:
    return unicodedata.category(c) == "Lu"


def _lower_letter(c: str) -> bool:
    return unicodedata.category(c) == "Ll"


def letters(s: str) -> str:
    """ASCII letters of a text in upper case."""
    return re.sub("[^A-Z]", "", re.sub("[a-z]+", lambda m: m[0].upper(), s))


def py_normalise(s: str, o: NormalisationOptions) -> str:
    """``normalise`` of a Python string."""
    if o.strip_diacritics:
        s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
    elif o.nfc:
        s = unicodedata.normalize("NFC", s)
    if o.split_camel_case:
        s = "".join((" " if i and _upper(c) and _lower_letter(s[i - 1]) else "") + c for i, c in enumerate(s))
    if o.lowercase:
        s = _simple_lower(s)
    if o.strip_separators:
        s = re.sub("[" + re.escape(o.separator_chars) + " \t\n\r\x0b\x0c]+", " ", s).strip(" ")
    return s
