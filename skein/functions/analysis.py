"""Text analysis as Column expressions: everything runs in the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a longest run of letters and decimal digits (ASCII's are named too, for speed); combining marks and underscores separate.
WORD = r"([a-zA-Z0-9\p{L}\p{Nd}]+)"
#: Words whose offsets are summed together.
BLOCK = 8


@functools.cache
def fold_map() -> tuple[str, str]:
    """Characters and what they become when accents are dropped; characters beyond the second string's length are deleted.

    Made from Unicode's decompositions: decompose, drop non-spacing marks, compose again.
    """
    src, dst, gone = [], [], ["̇"]  # what lower() leaves of a dotted capital I
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd":
            continue
        parts = unicodedata.normalize("NFD", c)
        plain = unicodedata.normalize("NFC", "".join(x for x in parts if unicodedata.category(x) != "Mn"))
        if plain != c and len(plain) == 1:
            src.append(c)
            dst.append(plain)
    return "".join(src + gone), "".join(dst)


def fold(token: Column) -> Column:
    return F.translate(token, *fold_map())


def words(text: Column) -> Column:
    """Runs of letters and digits as they stand."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def normal(word: Column) -> Column:
    """The token of a word; ASCII has no accents, and most words are that."""
    return F.when(is_ascii(word), F.lower(word)).otherwise(fold(F.lower(word)))


def tokens(text: Column) -> Column:
    """Lower-cased tokens without accents, in order; their places in the array are their positions."""
    return F.when(is_ascii(text), words(F.lower(text))).otherwise(F.transform(words(text), normal))


def keyword(value: Column) -> Column:
    """Keyword values are one term each: lower-cased, accents and all."""
    return F.lower(value)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(numbers: Column, levels: int = 6) -> Column:
    """For each of an array of whole numbers, the sum of those before it.

    Blocks are summed first, then what comes before each block, then within blocks, where all sums are written out: appending
    to an array copies it, so that only the sums of BLOCK ** levels numbers each are appended to one.
    """
    zero = F.lit(0)

    def some(block: Column) -> list[Column]:
        return [F.coalesce(F.get(block, F.lit(i)), zero) for i in range(BLOCK)]

    def within(block: Column, first: Column) -> Column:
        parts = some(block)
        return F.slice(F.array(*[functools.reduce(Column.__add__, parts[:i], first) for i in range(BLOCK)]), 1, F.greatest(F.size(block), zero))

    def blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        cut = F.transform(F.sequence(zero, last), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))
        sums = lambda bs: _sums(F.transform(bs, lambda b: functools.reduce(Column.__add__, some(b))), levels - 1)
        return _let(cut, lambda bs: F.flatten(F.zip_with(bs, sums(bs), within)))

    if not levels:
        return _let(numbers, lambda xs: F.slice(F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 1, F.size(xs)))
    return _let(numbers, lambda xs: F.when(F.size(xs) > BLOCK, blocks(xs)).otherwise(within(xs, zero)))


def token_offsets(text: Column) -> Column:
    """Array of (term, position, start, end): start and end are byte offsets in UTF-8."""
    gaps = F.regexp_extract_all(text, F.lit(r"([^a-zA-Z0-9\p{L}\p{Nd}]*)([a-zA-Z0-9\p{L}\p{Nd}]+)"), F.lit(1))
    both = F.zip_with(gaps, words(text), lambda gap, w: F.struct(F.octet_length(gap).alias("gap"), F.octet_length(w).alias("len"), normal(w).alias("term")))

    def placed(xs: Column) -> Column:
        def token(before: Column) -> Callable[[Column, Column], Column]:
            def made(x: Column, i: Column) -> Column:
                start = F.get(before, i) + x["gap"]
                return F.struct(x["term"].alias("term"), i.alias("position"), start.alias("start"), (start + x["len"]).alias("end"))

            return made

        return _let(_sums(F.transform(xs, lambda x: x["gap"] + x["len"])), lambda before: F.transform(xs, token(before)))

    return _let(both, placed)


def analyse(text: str) -> list[str]:
    """Tokens of a query on the driver, as ``tokens`` makes them of documents."""
    src, dst = fold_map()
    table = {ord(c): dst[i] if i < len(dst) else None for i, c in enumerate(src)}
    out, run = [], []
    for c in text + " ":
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            run.append(c)
        elif run:
            out.append("".join(run).lower().translate(table))
            run = []
    return out


def json_value(json: Column, name: str) -> Column:
    """Top-level member of a parsed JSON object as a variant, NULL if there is none."""
    key = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(json, f'$["{key}"]', "variant")


def _of_type(v: Column, of: str, as_: str) -> Column:
    return F.when(F.schema_of_variant(v) == of, F.try_variant_get(v, "$", as_))


def string_in(json: Column, name: str) -> Column:
    """Top-level member of a parsed JSON object if it is a string; NULL for numbers, arrays and all else."""
    return _of_type(json_value(json, name), "STRING", "string")


def long_in(json: Column, name: str) -> Column:
    """Top-level member of a parsed JSON object if it is a whole number."""
    return _of_type(json_value(json, name), "BIGINT", "bigint")


def json_string(source: Column, name: str) -> Column:
    return string_in(F.try_parse_json(source), name)


def json_long(source: Column, name: str) -> Column:
    return long_in(F.try_parse_json(source), name)


def is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()
