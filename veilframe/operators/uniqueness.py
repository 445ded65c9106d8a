"""How many population records match a case on its quasi-identifiers (k), and whether that singles it out.

Equality counts are one aggregate of the population by key and one join.  The shared scope, where each pair
has its own subset of agreeing fields, takes one grouped count for each subset that occurs: the population
is expanded by those subsets and aggregated once, as grouping sets would.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold
from .cases import IDENTIFYING, CaseSchema

Matcher = Callable[[Column, Column], Column]
#: record's key, and the keys at which a case finds its matches: they meet by equality before a matcher decides
Near = tuple[Callable[[Column], Column], Callable[[Column], Column]]
#: groups below this size single a case out
THRESHOLD = 5
#: the shared scope expands the grouped population by the subsets of fields that occur, 2^fields at most
MOST_FIELDS = 20


def match_key(df: DataFrame, name: str) -> Column:
    """Strings folded and stripped; NaN matches nothing, not even NaN."""
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.regexp_replace(fold(column), "^[\\s\\x{85}\\x{A0}]+|[\\s\\x{85}\\x{A0}]+$", "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def _nan(df: DataFrame, name: str) -> Column:
    return F.isnan(name) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)


def check_inputs(originals: DataFrame, analogues: DataFrame, population: DataFrame, qis: Sequence[str]) -> None:
    if population.limit(1).count() == 0:
        raise ValueError("the population is empty")
    if not qis:
        raise ValueError("no quasi-identifiers")
    for q in qis:
        for what, df in (("analogue", analogues), ("original", originals), ("population", population)):
            if q not in df.columns:
                raise ValueError(f"{q!r} is not in the {what}")
    if len(qis) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} quasi-identifiers")
    if "_present" in population.columns:
        held = population.agg(*[F.bool_or(F.array_contains("_present", q)).alias(f"q{i}") for i, q in enumerate(qis)]).first()
        for q, any_ in zip(qis, held):
            if not any_:
                raise ValueError(f"{q!r} is in no record of the population")


def default_qis(schema: CaseSchema) -> tuple[str, ...]:
    return tuple(n for n, r in schema.roles if r != IDENTIFYING)


def _has(population: DataFrame, qis: Sequence[str]) -> Column:
    """Whether a record has all keys; ``_present`` lists those it has, a null value is a value."""
    out = F.lit(True)
    for q in qis:
        if "_present" in population.columns:
            out = out & F.array_contains("_present", q)
        out = out & ~_nan(population, q)
    return out


def count_matches(
    cases: DataFrame,
    population: DataFrame,
    qis: Sequence[str],
    matchers: Mapping[str, Matcher] | None = None,
    bands: Mapping[str, Callable[[Column], Column]] | None = None,
    near: Mapping[str, Near] | None = None,
) -> DataFrame:
    """(case_id, k): records that match on all of ``qis``; without any, every record does.

    ``bands`` are generalising keys, applied to both sides and joined by equality.  ``matchers`` are free
    predicates (record value, case value).  Both sides are grouped by their values before predicates are tried, and
    ``near`` gives a matcher's field keys by which only close values meet: (key of a record's value, array of
    keys for a case's value).  Without it every two distinct values meet.
    """
    matchers, bands, near = dict(matchers or {}), dict(bands or {}), dict(near or {})
    if not qis:
        total = population.agg(F.count("*").alias("k"))
        return cases.select("case_id").crossJoin(F.broadcast(total))  # one row
    key = lambda df, q: bands[q](F.col(q)) if q in bands else match_key(df, q)
    free = [q for q in qis if q in matchers]
    records = population.where(_has(population, qis)).select(*[(F.col(q) if q in free else key(population, q)).alias(f"p_{q}") for q in qis])
    records = records.groupBy(*records.columns).agg(F.count("*").alias("n"))
    own = cases.select("case_id", *[(F.col(q) if q in free else key(cases, q)).alias(f"c_{q}") for q in qis], *[_nan(cases, q).alias(f"z_{q}") for q in qis])
    same = [F.col(f"p_{q}").eqNullSafe(F.col(f"c_{q}")) for q in qis if q not in free]
    if free:
        values = own.where(~F.greatest(*[F.col(f"z_{q}") for q in qis], F.lit(False))).select(*[f"c_{q}" for q in qis]).distinct()
        tests = [matchers[q](F.col(f"p_{q}"), F.col(f"c_{q}")) for q in free]
        for q in (q for q in free if q in near):
            of_record, of_case = near[q]
            records = records.withColumn(f"b_{q}", of_record(F.col(f"p_{q}")))
            values = values.withColumn(f"d_{q}", F.explode(F.array_distinct(of_case(F.col(f"c_{q}")))))
            same.append(F.col(f"b_{q}") == F.col(f"d_{q}"))
        found = values.join(records, _all([*same, *tests])).groupBy(*[f"c_{q}" for q in qis]).agg(F.sum("n").alias("n"))
        records, same = found.select("n", *[F.col(f"c_{q}").alias(f"p_{q}") for q in qis]), [F.col(f"p_{q}").eqNullSafe(F.col(f"c_{q}")) for q in qis]
    on = _all([*same, *[~F.col(f"z_{q}") for q in qis]])
    return own.join(records, on, "left").groupBy("case_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k"))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def count_shared(originals: DataFrame, analogues: DataFrame, population: DataFrame, qis: Sequence[str]) -> DataFrame:
    """(case_id, shared, k): ``shared`` are the fields on which original and analogue agree; k counts on just those."""
    o = originals.select("case_id", *[match_key(originals, q).alias(f"o_{q}") for q in qis], *[_nan(originals, q).alias(f"z_{q}") for q in qis])
    a = analogues.select("case_id", *[match_key(analogues, q).alias(f"a_{q}") for q in qis])
    mask = F.lit(0)
    pairs = o.join(a, "case_id")
    for i, q in enumerate(qis):
        mask = mask.bitwiseOR(F.when(F.col(f"o_{q}").eqNullSafe(F.col(f"a_{q}")) & ~F.col(f"z_{q}"), F.lit(1 << i)).otherwise(F.lit(0)))
    pairs = pairs.withColumn("mask", mask)
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    keyed = lambda prefix: [F.when(bit(i), F.struct(F.col(f"{prefix}_{q}").alias("v"))).alias(f"k_{q}") for i, q in enumerate(qis)]
    masks = F.broadcast(pairs.select("mask").distinct())  # at most 2^fields rows
    present = [F.array_contains("_present", q) if "_present" in population.columns else F.lit(True) for q in qis]
    records = population.select(*[match_key(population, q).alias(f"p_{q}") for q in qis], *[(p & ~_nan(population, q)).alias(f"h_{q}") for p, q in zip(present, qis)])
    records = records.groupBy(*records.columns).agg(F.count("*").alias("n")).crossJoin(masks)
    for i, q in enumerate(qis):
        records = records.where(~bit(i) | F.col(f"h_{q}"))
    counts = records.select("mask", *keyed("p"), "n").groupBy("mask", *[f"k_{q}" for q in qis]).agg(F.sum("n").alias("k"))
    own = pairs.select("case_id", "mask", *keyed("a")).alias("l")
    r = counts.alias("r")
    on = F.col("l.mask") == F.col("r.mask")
    for q in qis:
        on = on & F.col(f"l.k_{q}").eqNullSafe(F.col(f"r.k_{q}"))
    shared = F.filter(F.array(*[F.when(F.col("l.mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(q)) for i, q in enumerate(qis)]), lambda x: x.isNotNull())
    return own.join(r, on, "left").select("l.case_id", shared.alias("shared"), F.coalesce("r.k", F.lit(0)).alias("k"))


def estimate_uniqueness(originals: DataFrame, analogues: DataFrame, population: DataFrame, schema: CaseSchema, qis: Sequence[str] | None = None, threshold: int = THRESHOLD, matchers: Mapping[str, Matcher] | None = None) -> DataFrame:
    """(case_id, scope, quasi_identifiers, k, threshold, flagged) for the scopes analogue, shared_with_original and original.

    The analogue is flagged at 0 < k < threshold, the shared values at k < threshold, the original never.
    """
    qis = tuple(qis or default_qis(schema))
    check_inputs(originals, analogues, population, qis)
    names = F.array(*map(F.lit, qis))

    def scope(name: str, counts: DataFrame, fields: Column, flagged: Column) -> DataFrame:
        return counts.select("case_id", F.lit(name).alias("scope"), fields.alias("quasi_identifiers"), "k", F.lit(threshold).alias("threshold"), flagged.alias("flagged"))

    k = F.col("k")
    if matchers:
        shared = _shared_by_matchers(originals, analogues, population, qis, matchers)
    else:
        shared = count_shared(originals, analogues, population, qis)
    return (
        scope("analogue", count_matches(analogues, population, qis, matchers), names, (k > 0) & (k < threshold))
        .unionByName(scope("shared_with_original", shared, F.col("shared"), k < threshold))
        .unionByName(scope("original", count_matches(originals, population, qis, matchers), names, F.lit(False)))
    )


def _shared_by_matchers(originals: DataFrame, analogues: DataFrame, population: DataFrame, qis: Sequence[str], matchers: Mapping[str, Matcher]) -> DataFrame:
    """The original's value takes the record's place in a matcher; one count for each subset that occurs."""
    test = lambda q, x, y, df: matchers[q](x, y) if q in matchers else x.eqNullSafe(y)
    o = originals.select("case_id", *[(F.col(q) if q in matchers else match_key(originals, q)).alias(f"o_{q}") for q in qis])
    a = analogues.select("case_id", *[(F.col(q) if q in matchers else match_key(analogues, q)).alias(f"a_{q}") for q in qis])
    mask = F.lit(0)
    for i, q in enumerate(qis):
        mask = mask.bitwiseOR(F.when(F.coalesce(test(q, F.col(f"o_{q}"), F.col(f"a_{q}"), originals), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)))
    pairs = o.join(a, "case_id").select("case_id", mask.alias("mask"))
    out = None
    for m in sorted(r[0] for r in pairs.select("mask").distinct().collect()):  # at most 2^fields
        subset = [q for i, q in enumerate(qis) if m >> i & 1]
        some = analogues.join(pairs.where(F.col("mask") == m).select("case_id"), "case_id", "left_semi")
        counts = count_matches(some, population, subset, {q: f for q, f in matchers.items() if q in subset}).withColumn("shared", F.array(*map(F.lit, subset)).cast("array<string>"))
        out = counts if out is None else out.unionByName(counts)
    return out if out is not None else pairs.select("case_id", F.array().cast("array<string>").alias("shared"), F.lit(0).cast("bigint").alias("k"))


def uniqueness_report(findings: DataFrame) -> DataFrame:
    """(case_id, n_flagged, uniqueness_passed)."""
    return findings.groupBy("case_id").agg(F.count_if("flagged").alias("n_flagged"), (~F.bool_or("flagged")).alias("uniqueness_passed"))
