"""Audit records, sign-off, clearance, release and the way back."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, substitute, substitute_by_row, substitution_table, tokenize
from .cases import CaseSchema, render, with_digest, with_keyed_digest

NOTICE = "The case below is fictional. Names, places and dates stand for others."
#: what may leave: no mapping, no back-mapped answer, no residue, no note, no plain fingerprint
SHAREABLE = ("case_id", "status", "original_digest", "analogue_digest", "signoff", "reviewer", "approved", "signed_at", "reasons", "answer_received")


def new_records(originals: DataFrame, analogues: DataFrame, schema: CaseSchema, key: bytes | None = None) -> DataFrame:
    """(case_id, original_digest, analogue_digest, original_fp, status): pending; the original's digest is keyed if a key is given."""
    o = with_digest(originals, schema, "original_fp")
    o = o.withColumn("original_digest", F.col("original_fp")) if key is None else with_keyed_digest(o, schema, key, "original_digest")
    a = with_digest(analogues, schema, "analogue_digest")
    return o.select("case_id", "original_digest", "original_fp").join(a.select("case_id", "analogue_digest"), "case_id").withColumn("status", F.lit("pending"))


def sign_off(records: DataFrame, reviewer: str, approved: bool, note: str = "", at: str | None = None) -> DataFrame:
    """Sign-offs of the records' present analogues, to be appended to a sign-off table."""
    if not reviewer.strip():
        raise ValueError("a sign-off needs a reviewer")
    when = F.lit(at) if at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return records.select("case_id", F.lit(reviewer).alias("reviewer"), F.lit(approved).alias("approved"), "analogue_digest", F.lit(note).alias("note"), when.alias("signed_at"))


def signoff_status(records: DataFrame, signoffs: DataFrame) -> DataFrame:
    """Records with their latest sign-off and ``signoff``: missing, stale, approved or rejected."""
    order = Window.partitionBy("case_id").orderBy(F.desc("signed_at"), F.desc("analogue_digest"), "approved")
    latest = signoffs.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    latest = latest.select("case_id", "reviewer", "approved", F.col("analogue_digest").alias("signed_digest"), "note", "signed_at")
    status = F.when(F.col("signed_digest").isNull(), "missing").when(F.col("signed_digest") != F.col("analogue_digest"), "stale").when(F.col("approved"), "approved").otherwise("rejected")
    return records.join(latest, "case_id", "left").withColumn("signoff", status)


def clear(signed: DataFrame, invariance: DataFrame, direct: DataFrame, uniqueness: DataFrame | None = None) -> DataFrame:
    """Adds ``reasons`` (all of them) and ``status``, cleared only without any.

    The reports are those of ``invariance_report``, ``leak_report`` and ``uniqueness_report``; one whose
    optional ``analogue_digest`` is another one's is foreign.
    """

    def of(report: DataFrame, *columns: str) -> DataFrame:
        bound = F.col("analogue_digest") if "analogue_digest" in report.columns else F.lit(None).cast("string")
        return report.select("case_id", *columns, bound.alias("bound"))

    out = signed.join(of(invariance, "passed", "failures").withColumnRenamed("bound", "i_for"), "case_id", "left")
    out = out.join(of(direct, "n_blocking").withColumnRenamed("bound", "d_for"), "case_id", "left")
    if uniqueness is not None:
        out = out.join(uniqueness.select("case_id", "n_flagged"), "case_id", "left")
    else:
        out = out.withColumn("n_flagged", F.lit(None).cast("bigint"))
    foreign = lambda c: F.col(c).isNotNull() & (F.col(c) != F.col("analogue_digest"))
    reasons = F.array(
        F.when(foreign("i_for"), F.lit("invariance report is for another case")).when(~F.coalesce("passed", F.lit(False)), F.concat(F.lit("invariance failed: "), F.coalesce("failures", F.lit("no report")))),
        F.when(foreign("d_for"), F.lit("leak report is for another case")).when(F.coalesce("n_blocking", F.lit(1)) > 0, F.concat(F.lit("direct leaks: "), F.coalesce(F.col("n_blocking").cast("string"), F.lit("no report")))),
        F.when(F.col("n_flagged").isNull(), F.lit("uniqueness not assessed")).when(F.col("n_flagged") > 0, F.concat(F.lit("uniqueness flags: "), F.col("n_flagged").cast("string"))),
        F.when(F.col("signoff") != "approved", F.concat(F.lit("sign-off "), F.col("signoff"))),
    )
    out = out.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "cleared").otherwise("refused")).drop("i_for", "d_for", "passed", "failures", "n_blocking", "n_flagged")


def release_text(analogues: DataFrame, schema: CaseSchema, question: Column | None = None, notice: str = NOTICE) -> DataFrame:
    """(case_id, text): notice, question and the rendered analogue."""
    parts = [F.lit(notice), *([question] if question is not None else []), render(analogues, schema)]
    return analogues.select("case_id", F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts]).alias("text"))


def releasable(records: DataFrame, analogues: DataFrame, schema: CaseSchema) -> DataFrame:
    """Analogues that may go out now: cleared, approved, and unchanged since."""
    now = with_digest(analogues, schema, "digest_now")
    ok = records.where("status = 'cleared' and signoff = 'approved'").select("case_id", "analogue_digest")
    return now.join(ok, (now.case_id == ok.case_id) & (F.col("digest_now") == F.col("analogue_digest")), "left_semi").drop("digest_now")


def refusals(records: DataFrame, analogues: DataFrame, schema: CaseSchema) -> DataFrame:
    """(case_id, reasons) of the records that may not go out now: not cleared, changed since, or not signed off."""
    now = with_digest(analogues, schema, "digest_now").select("case_id", "digest_now")
    why = F.array(
        F.when(F.col("status") != "cleared", F.concat(F.lit("status "), F.col("status"))),
        F.when(F.col("digest_now").isNull(), F.lit("no analogue")).when(F.col("digest_now") != F.col("analogue_digest"), F.lit("analogue changed since clearance")),
        F.when(F.col("signoff") != "approved", F.concat(F.lit("sign-off "), F.col("signoff"))),
    )
    out = records.join(now, "case_id", "left").select("case_id", F.filter(why, lambda r: r.isNotNull()).alias("reasons"))
    return out.where(F.size("reasons") > 0)


def release(records: DataFrame, analogues: DataFrame, schema: CaseSchema, send: Callable[[str], str], path: str, question: str = "", batch: int = 100) -> DataFrame:
    """Calls ``send`` once for each releasable case and logs (case_id, analogue_digest, sent_text, answer) at ``path``; returns the log.

    It runs on the driver, since tasks may be repeated, over one partition at a time.  Answers are appended
    as they come, ``batch`` at a time and at the latest when ``send`` fails, so none that was paid for is lost, and a case
    whose present analogue is in the log already is not sent again.  Refused cases (``refusals``) never reach ``send``.
    """
    spark, key = records.sparkSession, analogues.schema["case_id"].dataType.simpleString()
    kinds = f"case_id {key}, analogue_digest string, sent_text string, answer string"
    ready = releasable(records, analogues, schema)
    texts = release_text(ready, schema, F.lit(question)).join(with_digest(ready, schema, "analogue_digest").select("case_id", "analogue_digest"), "case_id")
    spark.createDataFrame([], kinds).write.mode("append").parquet(path)  # the log exists, if empty
    log = spark.read.schema(kinds).parquet(path)
    todo, waiting = texts.join(log.select("case_id", "analogue_digest"), ["case_id", "analogue_digest"], "left_anti"), []

    def keep() -> None:
        if waiting:
            spark.createDataFrame(waiting, kinds).coalesce(1).write.mode("append").parquet(path)
            waiting.clear()

    try:
        for row in todo.toLocalIterator():
            waiting.append((row.case_id, row.analogue_digest, row.text, send(row.text)))
            if len(waiting) >= batch:
                keep()
    finally:
        keep()
    return spark.read.schema(kinds).parquet(path)


def back_map_by_case(answers: DataFrame, mappings: DataFrame) -> DataFrame:
    """``answers`` (case_id, answer, ...) with back_mapped, replacements map<analogue string, times> and residue.

    Each case has its own mapping (case_id, mapping map<analogue, original>); without one, the answer stays as it is.
    """
    both = answers.join(mappings.select("case_id", F.col("mapping").alias("veil_map")), "case_id", "left")
    empty = F.create_map().cast("map<string,string>")
    both = both.withColumn("veil_map", F.coalesce("veil_map", empty)).withColumn("veil_x", substitute_by_row(F.col("answer"), F.col("veil_map")))
    folded = lambda part: tokenize(F.array_join(part, " "))
    left = F.array_except(folded(F.map_keys("veil_map")), folded(F.map_values("veil_map")))
    content = F.filter(left, lambda t: ~F.array_contains(F.lit(sorted(STOPWORDS)), t) & (F.length(t) > 1))
    found = F.array_sort(F.array_intersect(content, tokenize(F.col("veil_x.text"))))
    return both.select(*answers.columns, F.col("veil_x.text").alias("back_mapped"), F.col("veil_x.hits").alias("replacements"), F.coalesce(found, F.array().cast("array<string>")).alias("residue"))


def back_map(answer: Column, mapping: Mapping[str, str]) -> Column:
    """The answer with analogue strings turned back into the originals."""
    return substitute(answer, mapping)


def residue(mapped: Column, mapping: Mapping[str, str]) -> Column:
    """Sorted content tokens of analogue strings, in no original one, that are still in the text."""
    import re

    from ..functions.text import fold_text

    words = lambda xs: {t for x in xs for t in re.findall(r"[^\W_]+", fold_text(x))}
    left = sorted(t for t in words(substitution_table(mapping)) - words(mapping.values()) if t not in STOPWORDS and len(t) > 1)
    return F.array_sort(F.array_intersect(F.array_distinct(tokenize(mapped)), F.lit(left) if left else F.array().cast("array<string>")))


def shareable(records: DataFrame) -> DataFrame:
    """An allow-list: a column that is added later does not leave by accident."""
    return records.select(*[c for c in SHAREABLE if c in records.columns])


def local_view(records: DataFrame) -> DataFrame:
    more = [c for c in ("mapping", "sent_text", "answer", "back_mapped", "replacements", "residue", "note") if c in records.columns]
    return records.select(*[c for c in SHAREABLE if c in records.columns], *more)
