"""Licence scan: a trained paragraph classifier, confirmed by template comparison; DataFrame functions only.

Paragraphs are lines, and blocks of several short lines between blank ones, since licence texts are often wrapped.  They become
sparse vectors of hashed word unigrams and bigrams.  A multinomial logistic regression, fitted once in a process
on the statements of ``licence_texts`` and on ordinary prose, gives a family or "unknown".  Its scores are calibrated by a
temperature fitted on statements that were held out whole, and a family counts only above ``SURE``.
A prediction is confirmed if the paragraph also holds most words of one of the family's templates.

Defined results: one row for each id, in which rows that repeat it are taken together; null ids share a row; null and empty
texts have no paragraphs and no family; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import regex
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents
from .licence_texts import LEADS, OTHER_LICENCES, PROSE, STATEMENTS, TAILS

#: hash space of each n-gram size, calibrated probability for a family, share of a template's words for confirmation
HASH_SIZE, SURE, TEMPLATE_SHARE = 1 << 12, 0.6, 0.75
#: characters up to which a line can be part of a wrapped block
WRAPPED = 120
#: training: rounds, step, weight decay
ROUNDS, STEP, DECAY = 250, 0.05, 3e-4
UNKNOWN = "unknown"
FAMILIES = (*STATEMENTS, UNKNOWN)
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3 (x86, 32 bits, signed), by which Spark's HashingTF hashes a term."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    mixed = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (turn(h ^ mixed(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (h >> 31 << 32)


def features_of(text: str) -> set[int]:
    """Positions that are 1 in a paragraph's vector: hashed words, then hashed pairs of words."""
    words = words_of(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return {_murmur3(w.encode()) % HASH_SIZE for w in words} | {HASH_SIZE + _murmur3(p.encode()) % HASH_SIZE for p in pairs}


def _around(statement: str, k: int) -> list[str]:
    """A statement alone and with some of the leads and tails."""
    both = [(lead, tail) for i, lead in enumerate(LEADS) for j, tail in enumerate(TAILS) if (i + j + k) % 4 == 0]
    return [statement, *[lead + statement + tail for lead, tail in both]]


def training_rows() -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(rows to train on, rows to calibrate on): whole statements are in either, with all that is made of them."""
    train, held = [], []
    for label, family in enumerate(STATEMENTS):
        for k, statement in enumerate(STATEMENTS[family]):
            (held if k == len(STATEMENTS[family]) - 1 else train).extend((t, label) for t in _around(statement, k))
    unknown = len(FAMILIES) - 1
    for k, text in enumerate(PROSE):
        (held if k % 4 == 3 else train).extend((t, unknown) for t in _around(text, k)[:5])
    for k, text in enumerate(OTHER_LICENCES[: len(OTHER_LICENCES) // 2]):
        train.extend((t, unknown) for t in _around(text, k)[:8])
    return train, held


@lru_cache(maxsize=1)
def fitted() -> tuple[np.ndarray, np.ndarray, float]:
    """(weights by family and position, intercepts, temperature), the same in every process."""
    train, held = training_rows()
    seen = sorted(set().union(*(features_of(t) for t, _ in train)))
    place = {f: i for i, f in enumerate(seen)}

    def matrix(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(seen)), np.float32)
        for r, (text, _) in enumerate(rows):
            x[r, [place[f] for f in features_of(text) if f in place]] = 1
        return x, np.array([y for _, y in rows])

    x, y = matrix(train)
    gold = np.eye(len(FAMILIES), dtype=np.float32)[y]
    weight = 1 / gold.sum(0)[y][:, None]  # each family weighs alike
    w, b = np.zeros((len(seen), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    for t in range(1, ROUNDS + 1):
        scores = x @ w + b
        scores = np.exp(scores - scores.max(1, keepdims=True))
        error = (scores / scores.sum(1, keepdims=True) - gold) * weight
        for p, (m, v), g in zip((w, b), moments, (x.T @ error + DECAY * w, error.sum(0))):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    x, y = matrix(held)
    raw = x @ w + b

    def loss(temperature: float) -> float:
        s = raw / temperature
        top = s.max(1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(y)), y]).mean())

    full = np.zeros((len(FAMILIES), 2 * HASH_SIZE))
    full[:, seen] = w.T.astype(np.float64).round(6)
    return full, b.astype(np.float64).round(6), min((t / 20 for t in range(4, 121)), key=loss)


class LicenceModel:
    """Word n-gram features and the fitted regression as Spark transformers."""

    def __init__(self, spark: SparkSession):
        weights, intercepts, self.temperature = fitted()
        stages = [RegexTokenizer(inputCol="paragraph", outputCol="veil_words", pattern="[^\\p{L}\\p{N}]+")]
        stages += [NGram(n=2, inputCol="veil_words", outputCol="veil_pairs")]
        stages += [HashingTF(numFeatures=HASH_SIZE, binary=True, inputCol=f"veil_{c}", outputCol=f"veil_tf_{c}") for c in ("words", "pairs")]
        stages += [VectorAssembler(inputCols=["veil_tf_words", "veil_tf_pairs"], outputCol="veil_x")]
        self.features = PipelineModel(stages)
        sc = spark.sparkContext
        matrix = DenseMatrix(*weights.shape, weights.ravel(), isTransposed=True)
        own = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("veil_licences", _py2java(sc, matrix), _py2java(sc, DenseVector(intercepts)), len(FAMILIES), True)
        self.model = LogisticRegressionModel(own).setFeaturesCol("veil_x").setRawPredictionCol("veil_raw")

    def scored(self, paragraphs: DataFrame) -> DataFrame:
        """Adds veil_words and veil_p, the calibrated probabilities in order of ``FAMILIES``."""
        scores = self.model.transform(self.features.transform(paragraphs)).withColumn("veil_s", vector_to_array("veil_raw"))
        top = F.array_max("veil_s")
        powers = F.transform("veil_s", lambda s: F.exp((s - top) / F.lit(self.temperature)))
        kept = scores.select(*paragraphs.columns, "veil_words", powers.alias("veil_e"))
        total = F.aggregate("veil_e", F.lit(0.0), lambda a, x: a + x)
        return kept.withColumn("veil_p", F.transform("veil_e", lambda x: x / total)).drop("veil_e")


def paragraphs_of(text: Column) -> Column:
    """Lines, and each block of several lines between blank ones if all are short, as a wrapped text."""
    blocks = F.filter(F.split(text, "\n[ \t\r]*\n"), lambda b: F.contains(b, F.lit("\n")) & ~b.rlike(f"[^\n]{{{WRAPPED + 1}}}"))
    return F.concat(F.split(text, "\n"), F.transform(blocks, lambda b: F.translate(b, "\n", " ")))


def _confirmed(words: Column, family: str) -> Column:
    parts = []
    for template in STATEMENTS[family]:
        own = sorted(set(words_of(template)))
        parts.append(F.size(F.array_intersect(words, F.lit(own))) >= math.ceil(TEMPLATE_SHARE * len(own)))
    return reduce(lambda a, b: a | b, parts)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """(id, n_paragraphs, n_licence, families, predicted, best_p) for each id.

    ``families`` lists the confirmed families and ``predicted`` all predicted ones, sorted and comma-joined; ``n_licence`` counts
    paragraphs with a confirmed family; ``best_p`` is the largest probability of a predicted family, rounded, 0 where there is none.
    """
    model = model or LicenceModel(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    paragraphs = docs.select(F.col(id_col).alias("id"), F.explode(paragraphs_of(text)).alias("paragraph"))
    scored = model.scored(paragraphs)
    best = F.array_position("veil_p", F.array_max("veil_p"))
    hit = scored.select("id", F.rlike("paragraph", F.lit("[\\p{L}\\p{N}]")).alias("real"), F.when((F.array_max("veil_p") >= SURE) & (best < len(FAMILIES)), best).alias("k"), F.array_max("veil_p").alias("p"), "veil_words")
    confirmed = reduce(lambda c, k: c.when(F.col("k") == k + 1, _confirmed(F.col("veil_words"), FAMILIES[k])), range(len(STATEMENTS)), F.when(F.col("k").isNull() | ~F.col("real"), F.lit(False)))
    flags = hit.select("id", "real", F.when(F.col("real"), F.col("k")).alias("k"), "p", confirmed.alias("sure"))
    per_id = flags.groupBy("id").agg(
        F.count_if("real").alias("n_paragraphs"),
        F.count_if("sure").alias("n_licence"),
        F.max(F.when(F.col("k").isNotNull(), F.col("p"))).alias("best"),
        *[F.bool_or((F.col("k") == k + 1) & F.col("sure")).alias(f"s{k}") for k in range(len(STATEMENTS))],
        *[F.bool_or(F.coalesce(F.col("k") == k + 1, F.lit(False))).alias(f"p{k}") for k in range(len(STATEMENTS))],
    )
    order = sorted(range(len(STATEMENTS)), key=lambda k: FAMILIES[k])
    named = lambda c: F.concat_ws(",", *[F.when(F.col(f"{c}{k}"), F.lit(FAMILIES[k])) for k in order])
    return per_id.select(F.col("id").alias(id_col), "n_paragraphs", "n_licence", named("s").alias("families"), named("p").alias("predicted"), F.round(F.coalesce("best", F.lit(0.0)), 4).alias("best_p"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
