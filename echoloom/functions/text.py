"""Text columns: tokens, words, shingles, sentences, paragraphs. Offsets are code points, 0-based, end exclusive."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four tokenizers: windows (ASCII white space), counts (Unicode white space), lexical units.
WINDOW_TOKEN = r"[^ \t\n\f\r]+"
WORD = r"(?U)\S+"
LEXICAL_TOKEN = r"[\p{IsAlphabetic}\p{N}']+"
MARK = "\u001f"


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL_TOKEN), F.lit(0))


def window_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WINDOW_TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<token, start, end>>`` of the matches of a token class, null for a null text.

    Offsets are a running sum, which Spark's array functions only give in quadratic time, so this is an Arrow UDF.
    """
    find = regex.compile({WORD: r"\S+", LEXICAL_TOKEN: r"[\p{Alphabetic}\p{N}']+"}.get(pattern, pattern))

    @F.pandas_udf("array<struct<token:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"token": m[0], "start": m.start(), "end": m.end()} for m in find.finditer(t)])

    return run(text)


def shingles(tokens: Column, size: int) -> Column:
    """Distinct runs of ``size`` tokens joined by a space; a shorter unit is one shingle, an empty one none."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, size), " "))
        return F.when(n > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # bound to a lambda's variable, the tokens are computed once and not again for every run
    return F.get(F.transform(F.array(tokens), runs), 0)


def sentences(text: Column) -> Column:
    """Pieces after ``.``, ``!``, ``?`` before white space or a quote, trimmed, without empty ones."""
    marked = F.regexp_replace(text, r"([.!?])([\s\"'])", "$1" + MARK + "$2")
    return F.filter(F.transform(F.split(marked, MARK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Pieces between runs of two or more line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def byte_offset(text: Column, chars: Column) -> Column:
    """UTF-8 byte offset of a code-point offset, for export."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


def segment_id(chapter: Column, act: Column, paragraph: Column) -> Column:
    return F.format_string("ch%02d_a%02d_p%02d", chapter, act, paragraph)
