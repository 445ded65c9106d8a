"""Policy invariance of case pairs, and probes of which fields drive a decision.

A policy is a column expression over the fields of a case, given as a function of a field getter.  A Python policy is
wrapped so that an exception becomes an error of that row instead of a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cases import DECISION, CaseSchema

Field = Callable[[str], Column]
Policy = Callable[[Field], Column]
Equivalence = Callable[[Column, Column], Column]
_RESULT = "struct<outcome:string,error:string>"
#: values that a probe may be given; they travel as one broadcast row, and each is tried on each case
MOST_CANDIDATES = 100_000


def checked(policies: Mapping[str, Policy]) -> dict[str, Policy]:
    if not policies:
        raise ValueError("no policies")
    for name, policy in policies.items():
        if not name or not callable(policy):
            raise ValueError(f"bad policy {name!r}")
    return dict(policies)


def python_policy(function: Callable[..., object], *fields: str) -> Policy:
    """A policy that calls Python with the named fields; its exception is reported as ``Type: message``."""

    def run(*values):
        try:
            out = function(*values)
            return None if out is None else str(out), None
        except Exception as e:  # any failure of a policy fails its row
            return None, f"{type(e).__name__}: {e}"

    udf = F.udf(run, _RESULT)
    run_each = F.udf(lambda rows: [run(*row[:-1]) for row in rows], f"array<{_RESULT}>")

    def policy(field: Field) -> Column:
        return udf(*[field(f) for f in fields])

    def each(values: Column, field_of: Callable[[Column], Field]) -> Column:
        """Results for each element of an array; Spark takes no Python function inside ``transform``."""
        row = lambda v: F.struct(*[field_of(v)(f).alias(f"f{k}") for k, f in enumerate(fields)], F.lit(True).alias("end"))
        return run_each(F.transform(values, row))

    policy.each = each
    return policy


def python_equivalence(function: Callable[[object, object], bool]) -> Equivalence:
    """An equivalence of two outcomes (strings or None) in Python; where it raises, the row has an error and is not equivalent."""

    def run(x, y):
        try:
            return bool(function(x, y)), None
        except Exception as e:  # fails closed
            return False, f"equivalence raised {type(e).__name__}: {e}"

    udf = F.udf(run, "struct<equal:boolean,error:string>")
    return lambda x, y: udf(x, y)


def _result(policy: Policy, field: Field, kinds: Callable[[Column], str]) -> Column:
    out = policy(field)
    return out if kinds(out).startswith("struct<outcome") else F.struct(out.cast("string").alias("outcome"), F.lit(None).cast("string").alias("error"))


def check_invariance(originals: DataFrame, analogues: DataFrame, policies: Mapping[str, Policy], equivalence: Equivalence | Mapping[str, Equivalence] | None = None) -> DataFrame:
    """(case_id, policy, original_outcome, analogue_outcome, equivalent, error); a null outcome equals a null one.

    A policy that raises (``python_policy``) leaves no outcomes, an equivalence that raises (``python_equivalence``) leaves them; either
    way the row has an error.  An original without an analogue has a row with that error.
    """
    policies = checked(policies)
    theirs = analogues.withColumn("veil_there", F.lit(True))
    both = originals.alias("o").join(theirs.alias("a"), F.col("o.case_id") == F.col("a.case_id"), "left")
    kinds = lambda c: both.select(c.alias("x")).schema["x"].dataType.simpleString()
    rows = []
    for name, policy in policies.items():
        sides = [_result(policy, lambda f, s=s: F.col(f"{s}.{f}"), kinds) for s in "oa"]
        same = equivalence.get(name) if isinstance(equivalence, Mapping) else equivalence
        equal = (same or (lambda x, y: x.eqNullSafe(y)))(sides[0]["outcome"], sides[1]["outcome"])
        error = F.when(F.col("a.veil_there").isNull(), F.lit("no analogue")).otherwise(F.coalesce(sides[0]["error"], sides[1]["error"]))
        raised = F.lit(None).cast("string")
        if both.select(equal.alias("x")).schema["x"].dataType.simpleString().startswith("struct"):
            equal, raised = equal["equal"], equal["error"]
        rows.append(
            F.struct(
                F.lit(name).alias("policy"),
                F.when(error.isNull(), sides[0]["outcome"]).alias("original_outcome"),
                F.when(error.isNull(), sides[1]["outcome"]).alias("analogue_outcome"),
                (error.isNull() & raised.isNull() & F.coalesce(equal, F.lit(False))).alias("equivalent"),
                F.coalesce(error, raised).alias("error"),
            )
        )
    return both.select(F.col("o.case_id").alias("case_id"), F.inline(F.array(*rows)))


def invariance_report(results: DataFrame) -> DataFrame:
    """(case_id, n_policies, passed, failures, summary): passed needs a result and no failure."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("equivalent"), F.col("policy"))))
    out = results.groupBy("case_id").agg(F.count("*").alias("n_policies"), F.every("equivalent").alias("passed"), F.array_join(failed, ",").alias("failures"))
    return out.withColumn("summary", F.when(F.col("passed"), F.format_string("invariance: PASS (%d policies)", "n_policies")).otherwise(F.format_string("invariance: FAIL (%s)", "failures")))


def sensitivity_probe(cases: DataFrame, schema: CaseSchema, policies: Mapping[str, Policy], candidates: DataFrame | None = None, others: DataFrame | None = None, equivalence: Equivalence | None = None) -> DataFrame:
    """(case_id, policy, pos, field, role, probed_values, n_flips, flips).

    Values to try come from ``candidates`` (field, v) first and then from the same case in ``others``; those equal to
    the present one and repeats do not count.  One field changes at a time.  A policy error on a changed
    case is a flip to ``<error: Type>``; one on the case itself leaves it without probes (no values, no flips).
    Errors are those of a ``python_policy`` or in the ``error`` of a policy that gives such a struct.
    """
    policies = checked(policies)
    same = equivalence or (lambda x, y: x.eqNullSafe(y))
    base = cases.select("case_id", *schema.names)
    kinds = {f.name: f.dataType for f in base.schema.fields}
    # values tried per case travel as one array: the case is read once however many values there are
    pools: dict[str, list[Column]] = {n: [] for n in schema.names}
    if candidates is not None:
        given = candidates.where(F.col("field").isin(*schema.names))
        if given.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
            raise ValueError(f"more than {MOST_CANDIDATES} candidate values")
        lists = given.groupBy("field").agg(F.sort_array(F.collect_set("v")).alias("v"))
        packed = F.broadcast(lists.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("pool")))  # a list per field of the schema
        base = base.crossJoin(packed)
        for n in schema.names:
            given = F.coalesce(F.try_element_at("pool", F.lit(n)), F.array().cast("array<string>"))
            pools[n].append(F.transform(given, lambda v: v.cast(kinds[n])))
    if others is not None:
        base = base.join(others.select("case_id", F.struct(*schema.names).alias("other")), "case_id", "left")
        for n in schema.names:
            pools[n].append(F.when(F.col("other").isNotNull(), F.array(F.col(f"other.{n}"))).otherwise(F.array().cast(f"array<{kinds[n].simpleString()}>")))
    of_base = lambda c: base.select(c.alias("x")).schema["x"].dataType.simpleString()
    probes = []
    for k, (n, role) in enumerate(schema.roles):
        pool = F.array_distinct(F.concat(*pools[n])) if pools[n] else F.array().cast(f"array<{kinds[n].simpleString()}>")
        pool = F.filter(pool, lambda v: ~v.eqNullSafe(F.col(n)))
        for name, policy in policies.items():
            now = _result(policy, F.col, of_base)
            tried = F.when(now["error"].isNull(), pool).otherwise(F.array().cast(f"array<{kinds[n].simpleString()}>"))
            changed = lambda v, n=n: lambda f: v if f == n else F.col(f)
            if hasattr(policy, "each"):
                results = policy.each(tried, changed)
            else:
                results = F.transform(tried, lambda v: _result(policy, changed(v), lambda _: of_base(policy(F.col))))
            # the present outcome travels with each value: a Python result cannot be named inside ``filter``
            present = F.array_repeat(now["outcome"], F.size(tried))
            met = F.arrays_zip(F.transform(tried, lambda v: v.cast("string")).alias("v"), results.alias("result"), present.alias("now"))
            is_flip = lambda x: x["result"]["error"].isNotNull() | ~F.coalesce(same(x["now"], x["result"]["outcome"]), F.lit(False))
            failed = lambda e: F.concat(F.lit("<error: "), F.substring_index(e, ":", 1), F.lit(">"))
            outcome = lambda r: F.when(r["error"].isNotNull(), failed(r["error"])).otherwise(r["outcome"])
            flips = F.transform(F.filter(met, is_flip), lambda x: F.struct(x["v"].alias("v"), outcome(x["result"]).alias("outcome")))
            probes.append(F.struct(F.lit(name).alias("policy"), F.lit(k).alias("pos"), F.lit(n).alias("field"), F.lit(role).alias("role"), F.size(tried).cast("bigint").alias("probed_values"), F.size(flips).cast("bigint").alias("n_flips"), flips.alias("flips")))
    return base.select("case_id", F.inline(F.array(*probes)))


def sensitivity_report(probes: DataFrame) -> DataFrame:
    """(case_id, policy, flipping, misclassified, inert, unprobed): comma-joined fields in order of the schema."""
    picked = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "field")))), lambda x: x["field"]), ",")
    flip, decision = F.col("n_flips") > 0, F.col("role") == DECISION
    return probes.groupBy("case_id", "policy").agg(
        picked(flip).alias("flipping"),
        picked(flip & ~decision).alias("misclassified"),
        picked(~flip & decision & (F.col("probed_values") > 0)).alias("inert"),
        picked(F.col("probed_values") == 0).alias("unprobed"),
    )
