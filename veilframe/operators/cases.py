"""Cases: wide DataFrames with a role for each field, their long form, projections, digests and rendering.

A wide table has ``case_id``, one column for each field and ``narrative``.  Roles live in a
``CaseSchema``, the source of truth, and are mirrored in column metadata, which expressions drop.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECISION, IDENTIFYING, CONTEXTUAL = "decision_relevant", "identifying", "contextual"
ROLES = (DECISION, IDENTIFYING, CONTEXTUAL)
NARRATIVE = "(narrative)"
_OWN = ("case_id", "narrative")


def parse_role(role: str) -> str:
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}; allowed: {', '.join(ROLES)}")
    return role


@dataclass(frozen=True)
class CaseSchema:
    """Field names in order, each with its role."""

    roles: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, roles: Mapping[str, str]) -> CaseSchema:
        for name, role in roles.items():
            if not isinstance(name, str) or not name or name in _OWN or name == NARRATIVE:
                raise ValueError(f"bad field name {name!r}")
            parse_role(role)
        return cls(tuple(roles.items()))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.roles)

    def __contains__(self, name: object) -> bool:
        return name in self.names

    def role_of(self, name: str) -> str:
        """The field's role; an unknown name is a KeyError that lists those there are."""
        found = dict(self.roles)
        if name not in found:
            raise KeyError(f"unknown field {name!r}; there are: {', '.join(self.names)}")
        return found[name]

    def column(self, df: DataFrame, name: str) -> Column:
        """The field's column of a table of such cases, by checked name."""
        self.role_of(name)
        return df[name]

    def with_role(self, *roles: str) -> tuple[str, ...]:
        wanted = {parse_role(r) for r in roles}
        return tuple(n for n, r in self.roles if r in wanted)

    def retag(self, changes: Mapping[str, str]) -> CaseSchema:
        unknown = set(changes) - set(self.names)
        if unknown:
            raise KeyError(f"unknown fields: {', '.join(sorted(unknown))}")
        return CaseSchema(tuple((n, parse_role(changes.get(n, r))) for n, r in self.roles))


def as_cases(df: DataFrame, schema: CaseSchema) -> DataFrame:
    """Validates columns against roles and tags them; a missing narrative is empty."""
    values = [c for c in df.columns if c not in _OWN]
    untagged, valueless = sorted(set(values) - set(schema.names)), sorted(set(schema.names) - set(values))
    if untagged or valueless:
        raise ValueError(f"without a role: {untagged}; without a value: {valueless}")
    narrative = F.coalesce(F.col("narrative"), F.lit("")) if "narrative" in df.columns else F.lit("")
    fields = [F.col(n).alias(n, metadata={"role": r}) for n, r in schema.roles]
    return df.select("case_id", *fields, narrative.alias("narrative"))


def schema_of(df: DataFrame) -> CaseSchema:
    """Roles from column metadata; a field without any is an error."""
    return CaseSchema.of({f.name: f.metadata.get("role", "") for f in df.schema.fields if f.name not in _OWN})


def project(df: DataFrame, schema: CaseSchema, *roles: str) -> DataFrame:
    return df.select("case_id", *schema.with_role(*roles))


def decision_view(df: DataFrame, schema: CaseSchema) -> DataFrame:
    """What a policy may see."""
    return project(df, schema, DECISION)


def with_values(df: DataFrame, schema: CaseSchema, changes: Mapping[str, Column]) -> DataFrame:
    unknown = set(changes) - set(schema.names)
    if unknown:
        raise KeyError(f"unknown fields: {', '.join(sorted(unknown))}")
    changed = df.withColumns(dict(changes))
    return changed.select(*[F.col(c).alias(c, metadata={"role": schema.role_of(c)}) if c in schema.names else F.col(c) for c in df.columns])


def with_narrative(df: DataFrame, narrative: Column) -> DataFrame:
    return df.withColumn("narrative", narrative)


def text_of(column: Column, kind: T.DataType) -> Column:
    """A value as text. Doubles have the fewest digits that tell them apart: plain from 1e-4 to 1e16, else as 1e-11.

    Python writes them, since the JVM's own text has digits too many before Java 19 (5.3993900000000003E20 for 5.39939e20).
    """
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.cast("string")
    single = isinstance(kind, T.FloatType)

    @F.pandas_udf("string")
    def shortest(values: pd.Series) -> pd.Series:
        exact = map(float, map(str, values.to_numpy("float32"))) if single else values.tolist()
        return pd.Series([repr(x) for x in exact], dtype=object)

    return F.when(column.isNotNull(), shortest(column))  # a null arrives as nan


def to_long(df: DataFrame, schema: CaseSchema) -> DataFrame:
    """(case_id, pos, field, role, vtype, v): one row for each field, nulls kept."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = [
        F.struct(F.lit(k).alias("pos"), F.lit(n).alias("field"), F.lit(r).alias("role"), F.lit(kinds[n].simpleString()).alias("vtype"), text_of(F.col(n), kinds[n]).alias("v"))
        for k, (n, r) in enumerate(schema.roles)
    ]
    return df.select("case_id", F.inline(F.array(*rows)))


def text_sources(df: DataFrame, schema: CaseSchema) -> DataFrame:
    """(case_id, pos, source, role, text): the narrative first unless empty, then fields with text; no nulls or booleans."""
    long = to_long(df, schema).where("v is not null and vtype <> 'boolean'").select("case_id", "pos", F.col("field").alias("source"), "role", F.col("v").alias("text"))
    story = df.where("narrative <> ''").select("case_id", F.lit(-1).alias("pos"), F.lit(NARRATIVE).alias("source"), F.lit(None).cast("string").alias("role"), F.col("narrative").alias("text"))
    return story.unionByName(long)


def string_pairs(originals: DataFrame, analogues: DataFrame, schema: CaseSchema) -> DataFrame:
    """(case_id, pos, field, analogue, original) of string fields that differ and are not empty."""
    texts = [n for n in schema.names if isinstance(originals.schema[n].dataType, T.StringType) and n in analogues.columns]
    o, a = originals.alias("o"), analogues.alias("a")
    rows = [F.struct(F.lit(schema.names.index(n)).alias("pos"), F.lit(n).alias("field"), F.col(f"a.{n}").alias("analogue"), F.col(f"o.{n}").alias("original")) for n in texts]
    kind = "array<struct<pos:int,field:string,analogue:string,original:string>>"
    both = o.join(a, F.col("o.case_id") == F.col("a.case_id")).select(F.col("o.case_id").alias("case_id"), F.inline(F.array(*rows).cast(kind)))
    return both.where("analogue <> '' and original <> '' and analogue <> original")


def canonical_text(df: DataFrame, schema: CaseSchema) -> Column:
    """The same for any order of fields; it holds each field's role, type and text, and the narrative."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [F.struct(F.lit(n).alias("n"), F.lit(r).alias("r"), F.lit(kinds[n].simpleString()).alias("t"), F.col(n).isNull().alias("z"), F.coalesce(text_of(F.col(n), kinds[n]), F.lit("")).alias("v")) for n, r in sorted(schema.roles)]
    return F.to_json(F.struct(F.array(*fields).alias("f"), F.col("narrative").alias("s")))


def with_digest(df: DataFrame, schema: CaseSchema, name: str = "digest") -> DataFrame:
    return df.withColumn(name, F.sha2(canonical_text(df, schema).cast("binary"), 256))


def with_keyed_digest(df: DataFrame, schema: CaseSchema, key: bytes, name: str = "digest") -> DataFrame:
    """HMAC-SHA-256. The key stays in the function's closure: it shows in no plan, UI or event log."""

    @F.pandas_udf("string")
    def keyed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return df.withColumn(name, keyed(canonical_text(df, schema)))


def render(df: DataFrame, schema: CaseSchema, hide: Iterable[str] = ()) -> Column:
    """Narrative, a blank line, then ``name: value`` lines."""
    kinds, out = {f.name: f.dataType for f in df.schema.fields}, set(hide)
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(text_of(F.col(n), kinds[n]), F.lit("None"))) for n in schema.names if n not in out]
    return F.concat_ws("\n", F.when(F.col("narrative") != "", F.concat(F.col("narrative"), F.lit("\n"))), *lines)


def to_json(df: DataFrame, schema: CaseSchema, typed: bool = False, bare: bool = False) -> Column:
    """A case as JSON; values are texts, or with ``typed`` JSON numbers, booleans, strings and nulls.

    JSON has no nan and inf: they are strings, or with ``bare`` stand as numbers do, which not every reader takes.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not typed:
        fields = [F.struct(F.lit(n).alias("name"), F.lit(r).alias("role"), text_of(F.col(n), kinds[n]).alias("value")) for n, r in schema.roles]
        return F.to_json(F.struct(F.array(*fields).alias("fields"), "narrative"), {"ignoreNullFields": "false"})
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")

    def value(n: str) -> Column:
        text = text_of(F.col(n), kinds[n])
        if isinstance(kinds[n], (T.DoubleType, T.FloatType)):
            out = text if bare else F.when(text.rlike("nan|inf"), quoted(text)).otherwise(text)
        elif isinstance(kinds[n], (T.NumericType, T.BooleanType)):
            out = text
        else:
            out = quoted(text)
        return F.coalesce(out, F.lit("null"))

    parts = [F.concat(F.lit(json.dumps({"name": n, "role": r}, ensure_ascii=False, separators=(",", ":"))[:-1] + ',"value":'), value(n), F.lit("}")) for n, r in schema.roles]
    return F.concat(F.lit('{"fields":['), F.concat_ws(",", *parts), F.lit('],"narrative":'), quoted(F.col("narrative")), F.lit("}"))
