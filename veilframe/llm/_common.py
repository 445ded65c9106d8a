"""Helpers shared by the corpus operators: shared folder, stage tables, words, word hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors see.

    It is the one the session names in ``spark.checkpoint.dir``.  Only where that is unset (tests, one
    machine) a temporary folder of this process takes its place, and it is set as the checkpoint folder too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    global _own_dir
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        path = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dir = "file://" + path
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/veilframe/{tag}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    before = spark.conf.get(_CLEAN_UP, None)
    try:
        spark.conf.set(_CLEAN_UP, "true")  # the shuffle files of this write go when it is done
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove the files of a ``stage_table`` that no later plan reads."""
    path = getattr(df, "_veil_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator reads, under its own names; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def without_clashes(docs: DataFrame):
    """(docs with columns named like our own renamed, function that gives a result its names back)."""
    names = [f"x{i}_{c}" if c.lower().startswith("veil_") else c for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.toDF(*docs.columns)


def split_words(text: str) -> list[bytes]:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text in UTF-8; bytes.split() splits at just these bytes."""
    return text.encode("utf-8", "surrogatepass").split()


_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_words(text: str) -> list[bytes]:
    r"""The words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 arrays (wraps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        if size > 1 << 22:
            for k in [k for k in _tables if k > 1 << 22]:
                del _tables[k]
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(x))
        _tables[size] = tuple(both)
    return _tables[size]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch values[start:end], the same wherever it stands: one prefix sum of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * inverse[: len(values)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * power[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    r"""64-bit hashes of the words ``[^\x20\x09-\x0D]+`` of UTF-8 text."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[data], prepend=True, append=True))
    return range_hashes(_BYTE_VALUES[data], edges[::2], edges[1::2])


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
