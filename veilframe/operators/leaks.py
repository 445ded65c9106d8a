"""Direct leaks: original text that reappears in an analogue.

The pair join is the only shuffle of the audit.  Both sides travel as one row for each case with its
tokens, and all findings of a case come from expressions over those arrays; shared phrases of long
texts are found by a suffix automaton of the other side, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions.text import STOPWORDS, fold_text, tokenize
from .cases import DECISION, IDENTIFYING, NARRATIVE, CaseSchema, text_sources

LOW, MEDIUM, HIGH = 1, 2, 3
_FINDING = "array<struct<kind:string,text:string,severity:int,allowed:boolean,at:int>>"


def _words(values: Iterable[str]) -> Column:
    return F.lit(sorted(values)) if values else F.array().cast("array<string>")


def _is_in(array: Column, x: Column) -> Column:
    return F.coalesce(F.array_contains(array, x), F.lit(False))


def _run(o: Column, p: Column, n: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.slice(o, p, n), " "), F.lit(" "))


def shared_phrases(o: Column, others: Column, counts: Column, least: int) -> Column:
    """array<struct<at, len>> (from 1): phrases of tokens ``o`` that one of the token lists ``others`` holds, from the left.

    ``counts`` flags the tokens that count.  A suffix automaton of the other side makes it linear in both texts.
    """

    @F.pandas_udf("array<struct<at:int,len:int>>")
    def find(mine: pd.Series, theirs: pd.Series, flags: pd.Series) -> pd.Series:
        out = []
        for text, texts, counted in zip(mine, theirs, flags):
            if text is None or not len(text):
                out.append([])
                continue
            known = dict(zip(text, counted))
            out.append([{"at": at + 1, "len": size} for at, size in phrases.shared_phrases(list(text), [list(t) for t in texts], known.__getitem__, least)])
        return pd.Series(out, dtype=object)

    return find(o, others, counts)


def find_leaks(
    originals: DataFrame,
    analogues: DataFrame,
    schema: CaseSchema,
    allow: Iterable[str] = (),
    allow_decision_relevant: bool = True,
    min_phrase_tokens: int = 2,
    stopwords: Iterable[str] | None = None,
    common_words: Iterable[str] = (),
    min_token_length: int = 2,
    analogue_schema: CaseSchema | None = None,
) -> DataFrame:
    """(case_id, pos, source, kind, text, severity, allowed): findings, the first of each kind, text and source."""
    if isinstance(allow, str):
        raise TypeError("allow takes several strings, not one")
    import re

    stop = set(STOPWORDS) if stopwords is None else {fold_text(w) for w in stopwords}
    ignorable = stop | {fold_text(w) for w in common_words}
    given = {t for phrase in allow for t in re.findall(r"[^\W_]+", fold_text(phrase))}

    o = text_sources(originals, schema).withColumn("o", tokenize(F.col("text"))).where(F.size("o") > 0)
    a = text_sources(analogues, analogue_schema or schema).withColumn("t", tokenize(F.col("text"))).where(F.size("t") > 0)
    # several sources in one string, told apart by a bar, which is no token
    theirs = a.groupBy("case_id").agg(F.concat(F.lit(" "), F.array_join(F.collect_list(F.array_join("t", " ")), " | "), F.lit(" ")).alias("hay"), F.collect_list("t").alias("others"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("a_tokens"))
    decided = F.collect_list(F.when((F.col("role") == DECISION) & F.lit(allow_decision_relevant), F.col("o")))
    mine = o.groupBy("case_id").agg(F.collect_list(F.struct("pos", "source", "role", "o")).alias("sources"), F.array_union(F.array_distinct(F.flatten(decided)), _words(given)).alias("ok_tokens"))
    both = mine.join(theirs, "case_id").select("case_id", "hay", "others", "a_tokens", "ok_tokens", F.inline("sources"))

    ok, stop_c, ign_c = F.col("ok_tokens"), _words(stop), _words(ignorable)
    usable = lambda t, ignore: (F.length(t) >= min_token_length) & ~_is_in(ignore, t)
    fine = lambda tokens, ignore, short: F.forall(tokens, lambda t: _is_in(ok, t) | _is_in(ignore, t) | (F.length(t) < min_token_length if short else F.lit(False)))
    identifying, decision = F.coalesce(F.col("role") == IDENTIFYING, F.lit(False)), F.coalesce(F.col("role") == DECISION, F.lit(False))
    whole = (F.col("source") != NARRATIVE) & F.contains("hay", _run(F.col("o"), F.lit(1), F.size("o")))
    rows = both.withColumn("whole", whole)

    finding = lambda kind, text, severity, allowed, at: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(severity).alias("severity"), allowed.alias("allowed"), at.alias("at"))
    none = F.array().cast(_FINDING)
    o_col = F.col("o")
    value_ok = F.when(identifying, fine(o_col, stop_c, False)).when(decision, F.lit(allow_decision_relevant) | fine(o_col, ign_c, False)).otherwise(fine(o_col, ign_c, False))
    of_value = F.array(F.struct(F.lit("field_value").alias("kind"), F.array_join(o_col, " ").alias("text"), F.when(identifying, HIGH).otherwise(MEDIUM).alias("severity"), value_ok.alias("allowed"), F.lit(0).alias("at")))
    present = lambda ignore: F.filter(F.array_distinct(o_col), lambda t: usable(t, ignore) & _is_in(F.col("a_tokens"), t))
    of_id = F.transform(present(stop_c), lambda t, k: finding("identifying_token", t, HIGH, _is_in(ok, t), k))
    plain = ~identifying & ~F.col("whole")
    # one source's tokens are read once: an empty list for those that need no phrases
    searched = F.when(plain, o_col).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("found", shared_phrases(searched, F.col("others"), F.transform(searched, lambda t: usable(t, ign_c)), max(1, min_phrase_tokens)))
    of_phrase = F.transform("found", lambda f, k: finding("phrase", F.array_join(F.slice(o_col, f["at"], f["len"]), " "), MEDIUM, fine(F.slice(o_col, f["at"], f["len"]), ign_c, True), k))
    covered = F.flatten(F.transform("found", lambda f: F.slice(o_col, f["at"], f["len"])))
    of_token = F.transform(F.array_except(present(ign_c), covered), lambda t, k: finding("token", t, LOW, _is_in(ok, t), F.size("found") + k))
    findings = F.when(F.col("whole"), of_value.cast(_FINDING)).when(identifying, of_id.cast(_FINDING)).otherwise(F.concat(of_phrase, of_token).cast(_FINDING))
    every = rows.select("case_id", "pos", "source", F.inline(F.coalesce(findings, none)))
    first = F.min_by(F.struct("severity", "allowed"), "at").alias("x")
    return every.groupBy("case_id", "pos", "source", "kind", "text").agg(first).select("case_id", "pos", "source", "kind", "text", "x.severity", "x.allowed")


def leak_report(cases: DataFrame, findings: DataFrame, fail_at: int = MEDIUM) -> DataFrame:
    """(case_id, n_findings, n_blocking, direct_passed) for each case, also those without findings."""
    blocking = (~F.col("allowed")) & (F.col("severity") >= fail_at)
    per_case = findings.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(blocking).alias("b"))
    out = cases.select("case_id").join(per_case, "case_id", "left")
    return out.select("case_id", F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("b", F.lit(0)).alias("n_blocking"), (F.coalesce("b", F.lit(0)) == 0).alias("direct_passed"))
