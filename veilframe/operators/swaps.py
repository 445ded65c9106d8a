"""Rule-based analogues: value swaps by table, narrative rewriting, and the mapping back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SubstitutionConflict, casefold, substitute, substitution_counts
from .cases import IDENTIFYING, CaseSchema


class Transformer:
    """Something that proposes an analogue for each case: case_id, fields, narrative, mapping, warnings, error."""

    def transform(self, cases: DataFrame, schema: CaseSchema) -> DataFrame:
        raise NotImplementedError


def mapping_conflicts(pairs: DataFrame) -> DataFrame:
    """(case_id, analogue, originals) where one analogue string, ignoring case, stands for several originals."""
    grouped = pairs.groupBy("case_id", F.lower("analogue").alias("analogue")).agg(F.sort_array(F.collect_set(F.lower("original"))).alias("originals"))
    return grouped.where(F.size("originals") > 1)


class RuleBasedTransformer(Transformer):
    """Swaps ``{field: {value: analogue value}}``; string keys ignore case, two values for one key are refused.

    An identifying field without a swap is an error of that case unless ``require_identifying`` is off.  The
    narrative is rewritten by all string swaps together with ``narrative_swaps``, which win.
    """

    def __init__(self, swaps: Mapping[str, Mapping], narrative_swaps: Mapping[str, str] | None = None, require_identifying: bool = True):
        self.swaps, self.require = {f: dict(t) for f, t in swaps.items()}, require_identifying
        table = {k: v for t in self.swaps.values() for k, v in t.items() if isinstance(k, str) and isinstance(v, str)}
        lowered = {k.lower(): (k, v) for k, v in table.items()}
        lowered |= {k.lower(): (k, v) for k, v in (narrative_swaps or {}).items()}
        self.text_table = dict(lowered.values())

    def transform(self, cases: DataFrame, schema: CaseSchema) -> DataFrame:
        spark, out, missing = cases.sparkSession, cases, []
        for name in schema.names:
            kind, table = cases.schema[name].dataType, self.swaps.get(name, {})
            hit, new = F.lit(False), F.col(name)
            if table:
                text = isinstance(kind, T.StringType)
                folded: dict = {}
                for k, v in table.items():
                    if folded.setdefault(k.casefold() if text else k, v) != v:
                        raise SubstitutionConflict(f"{name}: two values for {k!r}")
                rows = list(folded.items())
                side = spark.createDataFrame(rows, T.StructType([T.StructField("veil_k", kind), T.StructField("veil_v", kind)]))
                key = casefold(F.col(name)) if text else F.col(name)
                side = side.withColumn("veil_hit", F.lit(True))
                side = side if len(rows) > 100_000 else F.broadcast(side)  # counted
                out = out.join(side, key == F.col("veil_k"), "left")
                hit, new = F.coalesce(F.col("veil_hit"), F.lit(False)), F.when(F.col("veil_hit"), F.col("veil_v")).otherwise(F.col(name))
            if schema.role_of(name) == IDENTIFYING and self.require:
                missing.append(name)
                out = out.withColumn(f"veil_miss_{name}", ~hit)
            out = out.withColumn(f"veil_new_{name}", new).drop("veil_k", "veil_v", "veil_hit")
        lacking = F.filter(F.array(*[F.when(F.col(f"veil_miss_{n}"), F.lit(n)) for n in missing]).cast("array<string>"), lambda x: x.isNotNull())
        texts = [n for n in schema.names if isinstance(cases.schema[n].dataType, T.StringType)]
        fields = F.array(*[F.struct(F.col(f"veil_new_{n}").alias("a"), F.col(n).alias("o")) for n in texts]).cast("array<struct<a:string,o:string>>")
        changed = F.filter(fields, lambda x: (x["a"] != "") & (x["o"] != "") & (x["a"] != x["o"]))
        # each step is a column of its own: inside lambdas an expression would be computed for every element
        out = out.withColumn("veil_fired", substitution_counts(F.col("narrative"), self.text_table))
        lowered = {k.lower(): (k, v) for k, v in self.text_table.items()}
        of_key = lambda part: F.create_map(*[F.lit(x) for low, pair in lowered.items() for x in (low, pair[part])]).cast("map<string,string>")
        pairs = F.transform(F.map_keys("veil_fired"), lambda k: F.struct(F.try_element_at(of_key(1), k).alias("a"), F.try_element_at(of_key(0), k).alias("o")))
        in_text = F.filter(pairs, lambda x: x["a"] != "")
        out, every = out.withColumn("veil_every", F.concat(changed, in_text)), F.col("veil_every")
        clash = F.exists(every, lambda x: F.exists(every, lambda y: (F.lower(x["a"]) == F.lower(y["a"])) & (F.lower(x["o"]) != F.lower(y["o"]))))
        # the first spelling of an analogue string keeps its place in the mapping
        firsts = F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: F.lower(y["a"]) == F.lower(x["a"])))
        error = F.when(F.size(lacking) > 0, F.concat(F.lit("no swap for identifying: "), F.array_join(lacking, ", "))).when(clash, F.lit("mapping conflict"))
        result = out.withColumns({"veil_error": error, "veil_map": F.map_from_entries(firsts), "veil_text": substitute(F.col("narrative"), self.text_table)})
        return result.select(
            "case_id",
            *[F.col(f"veil_new_{n}").alias(n, metadata={"role": schema.role_of(n)}) for n in schema.names],
            F.col("veil_text").alias("narrative"),
            F.when(F.col("veil_error").isNull(), F.col("veil_map")).alias("mapping"),
            F.array().cast("array<string>").alias("warnings"),
            F.col("veil_error").alias("error"),
        )
