"""The whole verification: invariance, leaks and uniqueness to one row for each case, then clearance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cases import CaseSchema, with_digest
from ..operators.gate import clear, signoff_status
from ..operators.invariance import Policy, check_invariance, invariance_report
from ..operators.leaks import HIGH, LOW, MEDIUM, find_leaks, leak_report
from ..operators.uniqueness import THRESHOLD, Matcher, estimate_uniqueness, uniqueness_report


_SEVERITY = {LOW: "low", MEDIUM: "medium", HIGH: "high"}


def _lines(findings: DataFrame, line: Column) -> DataFrame:
    """(case_id, lines): one for each finding, sorted."""
    return findings.groupBy("case_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def audit_leaks(
    originals: DataFrame,
    analogues: DataFrame,
    schema: CaseSchema,
    population: DataFrame | None = None,
    qis: Sequence[str] | None = None,
    threshold: int = THRESHOLD,
    fail_at: int = MEDIUM,
    matchers: Mapping[str, Matcher] | None = None,
    **options,
) -> DataFrame:
    """(case_id, original_digest, analogue_digest, n_findings, n_blocking, direct_passed, n_flagged, uniqueness_assessed, passed, summary).

    The digests bind a report to what was audited.  The summary has the verdicts and a line for each finding.  Uniqueness that
    is not assessed does not fail an audit, and the summary says so.
    """
    found = find_leaks(originals, analogues, schema, **options)
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in _SEVERITY.items() for x in pair]), F.col("severity"))
    said = F.format_string("  %s %s in %s: %s%s", severity, "kind", "source", "text", F.when(F.col("allowed"), F.lit(" (allowed)")).otherwise(F.lit("")))
    direct = leak_report(analogues, found, fail_at).join(_lines(found, said).withColumnRenamed("lines", "d_lines"), "case_id", "left")
    if population is None:
        out = direct.withColumns({"n_flagged": F.lit(0).cast("bigint"), "u_lines": F.array().cast("array<string>"), "uniqueness_assessed": F.lit(False)})
    else:
        scopes = estimate_uniqueness(originals, analogues, population, schema, qis, threshold, matchers)
        flags = uniqueness_report(scopes).select("case_id", "n_flagged")
        line = F.format_string("  %s on (%s): k = %d%s", "scope", F.array_join("quasi_identifiers", ", "), "k", F.when(F.col("flagged"), F.lit(" FLAGGED")).otherwise(F.lit("")))
        lines = _lines(scopes, line).withColumnRenamed("lines", "u_lines")
        out = direct.join(flags, "case_id", "left").join(lines, "case_id", "left").withColumn("uniqueness_assessed", F.lit(True))
    out = out.withColumn("passed", F.col("direct_passed") & (F.coalesce("n_flagged", F.lit(0)) == 0))
    unique = F.when(F.col("uniqueness_assessed"), F.concat(F.col("n_flagged").cast("string"), F.lit(" flagged"))).otherwise(F.lit("NOT ASSESSED"))
    empty = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.when(F.col("passed"), F.lit("leak audit: PASS")).otherwise(F.lit("leak audit: FAIL")), F.format_string("direct: %d findings, %d blocking", "n_findings", "n_blocking")),
        F.coalesce("d_lines", empty),
        F.array(F.concat(F.lit("uniqueness: "), unique)),
        F.coalesce("u_lines", empty),
    )
    out = out.withColumn("summary", F.array_join(lines, "\n")).drop("d_lines", "u_lines")
    for side, name in ((originals, "original_digest"), (analogues, "analogue_digest")):
        out = out.join(with_digest(side, schema, name).select("case_id", name), "case_id", "left")
    first = ["case_id", "original_digest", "analogue_digest"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def verify(originals: DataFrame, analogues: DataFrame, schema: CaseSchema, policies: Mapping[str, Policy], records: DataFrame, signoffs: DataFrame, population: DataFrame | None = None, qis: Sequence[str] | None = None, threshold: int = THRESHOLD, **options) -> DataFrame:
    """Audit records with sign-off, all reasons against clearance, and status."""
    digests = with_digest(analogues, schema, "analogue_digest").select("case_id", "analogue_digest")
    invariance = invariance_report(check_invariance(originals, analogues, policies)).join(digests, "case_id")
    direct = leak_report(analogues, find_leaks(originals, analogues, schema, **options)).join(digests, "case_id")
    unique = None if population is None else uniqueness_report(estimate_uniqueness(originals, analogues, population, schema, qis, threshold))
    return clear(signoff_status(records, signoffs), invariance, direct, unique)
