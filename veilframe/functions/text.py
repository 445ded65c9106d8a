"""Folding, tokens, runs and whole-word substitution as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: function words that an audit does not count as content
STOPWORDS = frozenset(
    """
    a an and or but nor of in on at to for with without by from as into onto
    is am are was were be been being has have had having do does did done
    that this these those it its he she they his her hers their theirs him
    them who whom which what when where why how not no if then than so
    after before during about over under up down off again also only very
    can could would should will shall may might must there here per any all
    some each other such own same both more most
    """.split()
)
_TOKEN = "[\\p{L}\\p{N}]+"


def fold_text(text: str) -> str:
    """Decomposed, without combining marks, case-folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


@lru_cache(maxsize=1)
def _latin_folds() -> tuple[str, str, dict[str, str]]:
    """Folds of the characters below U+0250: those to one character, and those to none or several."""
    source, target, longer = [], [], {}
    for point in range(0x250):
        c = chr(point)
        f = fold_text(c)
        if len(f) == 1 and f != c:
            source.append(c)
            target.append(f)
        elif len(f) != 1:
            longer[c] = f
    return "".join(source), "".join(target), longer


def _fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def fold(text: Column) -> Column:
    """Folded text. Latin stays in the JVM; only rows with other letters or marks visit Python."""
    source, target, longer = _latin_folds()
    native = F.translate(text, source, target)
    for c, f in longer.items():
        native = F.replace(native, F.lit(c), F.lit(f))
    ascii_only = text.rlike("^[\\x00-\\x7F]*$")
    latin = text.rlike("^[\\x00-\\x{024F}]*$")
    return F.when(ascii_only, F.lower(text)).when(latin, native).otherwise(F.pandas_udf(_fold_all, "string")(F.when(~latin, text)))


def _casefold_all(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def casefold(text: Column) -> Column:
    """Case-folded text, accents kept (ß is ss); only rows beyond ASCII visit Python."""
    ascii_only = text.rlike("^[\\x00-\\x7F]*$")
    return F.when(ascii_only, F.lower(text)).otherwise(F.pandas_udf(_casefold_all, "string")(F.when(~ascii_only, text)))


def tokens_of_folded(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(0))


def tokenize(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return tokens_of_folded(fold(text))


def run_of(tokens: Column) -> Column:
    """Tokens between single spaces, with a space at both ends: containment of runs is containment of such strings."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def contains_run(haystack: Column, needle: Column) -> Column:
    """Whether the needle's tokens stand side by side in the haystack; an empty needle does not."""
    return (F.size(needle) > 0) & F.contains(run_of(haystack), run_of(needle))


class SubstitutionConflict(ValueError):
    """Two keys that are equal ignoring case stand for different values."""


def substitution_table(table: Mapping[str, str]) -> dict[str, str]:
    """Lower-cased keys to values; empty keys are left out."""
    out: dict[str, str] = {}
    for key, value in table.items():
        if key and out.setdefault(key.lower(), value) != value:
            raise SubstitutionConflict(f"two values for {key!r}")
    return out


def _pattern(keys: Iterable[str]) -> str:
    longest_first = sorted(keys, key=lambda k: (-len(k), k))
    choice = "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in longest_first)
    return f"(?iu)(?<![\\p{{L}}\\p{{N}}_])({choice})(?![\\p{{L}}\\p{{N}}_])"


def substitute(text: Column, table: Mapping[str, str]) -> Column:
    """All whole-word hits of the keys replaced in one pass, longest key first, ignoring case; never chained."""
    lowered = substitution_table(table)
    if not lowered:
        return text
    pattern = _pattern(lowered)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.create_map(*[F.lit(x) for pair in lowered.items() for x in pair])
    swapped = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.try_element_at(values, F.lower(h)), h, F.lit(""))))
    return F.array_join(swapped, "")


def substitution_counts(text: Column, table: Mapping[str, str]) -> Column:
    """map<lower-cased key, hits> of the keys that occur."""
    lowered = substitution_table(table)
    if not lowered:
        return F.create_map().cast("map<string,int>")
    hits = F.transform(F.regexp_extract_all(text, F.lit(_pattern(lowered)), F.lit(1)), lambda h: F.lower(h))
    keys = F.array_distinct(hits)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(hits, lambda h: h == k))))


def swap_words(text: str, lowered: Mapping[str, str]) -> tuple[str, dict[str, int]]:
    """(new text, hits of each key) for lower-cased keys: a scan over word starts that tries the longest key first."""
    sizes = sorted({len(k) for k in lowered}, reverse=True)
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    out, hits, at, kept = [], {}, 0, 0
    while at < len(text):
        if not word(at - 1):
            for size in sizes:
                key = text[at : at + size].lower()
                if key in lowered and not word(at + size):
                    out += (text[kept:at], lowered[key])
                    hits[key] = hits.get(key, 0) + 1
                    at = kept = at + size
                    break
            else:
                at += 1
        else:
            at += 1
    return "".join(out) + text[kept:], hits


def substitute_by_row(text: Column, table: Column) -> Column:
    """struct<text, hits map<key, times>>: ``substitute`` where each row brings its own map<string,string>."""

    @F.pandas_udf("text string, hits map<string,int>")
    def rewrite(texts: pd.Series, tables: pd.Series) -> pd.DataFrame:
        rows = [(None, {}) if t is None else swap_words(t, substitution_table(dict(m)) if m is not None else {}) for t, m in zip(texts, tables)]
        return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "hits": pd.Series([r[1] for r in rows], dtype=object)})

    return rewrite(text, table)
