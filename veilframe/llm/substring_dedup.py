r"""Removal of passages that an earlier document has: suffix automata and matching statistics.

A window is ``WINDOW`` consecutive words.  Among its stretches of ``ANCHOR`` words the one with the least
hash is its anchor, whatever surrounds the window, so equal windows of all documents meet under one anchor.
Anchors that a single document has need no more work.  The windows of a document that share an anchor form a
run; equal runs are one.  Where an anchor has a single run, all but the smallest document lose it.  Where it has
several, they are the reference shard of that anchor: taken in order of their smallest document, each run
is streamed through the suffix automaton of those before it, and a window is repeated where
the matching statistic reaches its length.  Anchors with more than ``MANY_RUNS`` runs compare the hashes of their windows instead,
which spreads one anchor over many tasks.

The automata are not broadcast whole: they would grow with the corpus.  Each goes to the task that its
anchor names, with just the runs that can match it.

Defined results: null and empty texts have no words; rows with a null id neither lose words nor make others lose them; rows that
repeat an id are one document's, and none of them loses words to another; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._common import documents, drop_table, mix64, range_hashes, split_words, stage_table, word_hashes
from .automaton import SuffixAutomaton

WINDOW, ANCHOR = 50, 25
#: runs of one anchor that one task takes
MANY_RUNS = 64


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """(word hashes, anchor hash, run digest, first window, windows) of a text; the last four have an entry for each run."""
    words = word_hashes(raw)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return words, *(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(len(words) - ANCHOR + 1)
    grams = range_hashes(words, at, at + ANCHOR)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1)
    anchor = np.concatenate([view[k : k + 65536].argmin(1) for k in range(0, n, 65536)]) + np.arange(n)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(first, append=n)
    own = anchor[first]
    digest = range_hashes(words, first, first + count + WINDOW - 1)
    with np.errstate(over="ignore"):
        digest = mix64(digest * np.uint64(0x9FB21C651E98DF25) + (own - first).astype(np.uint64))
    return words, grams[own].view(np.int64), digest.view(np.int64), first, count


_RUNS = "anchor bigint, digest bigint, id bigint, tag int, start bigint, windows int"


def _all_runs(source: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [runs(t.encode("utf-8", "surrogatepass"))[1:] for t in part.column(1).to_pylist()]
                sizes = np.array([len(f[0]) for f in found], np.int64)
                row = np.repeat(np.arange(len(found)), sizes)
                columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1]), part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(columns[2]), pa.array(columns[3].astype(np.int32))],
                    [x.split()[0] for x in _RUNS.split(", ")],
                )

    return source.where("id is not null").mapInArrow(work, _RUNS)


_SEGMENTS = "anchor bigint, digest bigint, low bigint, many boolean, words binary"


def _segments(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words (as hashes) of the wanted runs (anchor, digest, low, many), each taken from its smallest document."""
    lists = wanted.groupBy(F.col("low").alias("id")).agg(F.collect_list(F.struct("anchor", "digest", "many")).alias("runs"))
    texts = source.join(lists, "id").select("id", "text", "runs")

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                low, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                want = {(r["anchor"], r["digest"]): r["many"] for r in batch.column(2)[k].as_py()}
                words, anchor, digest, first, count = runs(text.encode("utf-8", "surrogatepass"))
                rows = []
                for a, d, f, c in zip(anchor.tolist(), digest.tolist(), first.tolist(), count.tolist()):
                    many = want.pop((a, d), None)
                    if many is not None:
                        rows.append((a, d, low, many, words[f : f + c + WINDOW - 1].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], [x.split()[0] for x in _SEGMENTS.split(", ")])

    return texts.mapInArrow(work, _SEGMENTS).dropDuplicates(["anchor", "digest"])


_MASKS = "anchor bigint, digest bigint, low bigint, mask bigint"


def _mask(repeated) -> int:
    mask = 0
    for k, r in enumerate(repeated):
        if r:
            mask |= 1 << k
    return mask


def _by_automata(segments: DataFrame) -> DataFrame:
    """(anchor, digest, low, mask): bit k tells that window k of the run is in a document before ``low``."""

    def work(batches):
        anchor, automaton, held, held_low = None, None, [], None
        for batch in batches:
            out = []
            for a, d, low, words in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if a != anchor:
                    anchor, automaton, held, held_low = a, SuffixAutomaton(), [], None
                if low != held_low:  # runs of one document do not repeat each other
                    for s in held:
                        automaton.add(s)
                    held, held_low = [], low
                symbols = np.frombuffer(words, np.uint64).tolist()
                repeated = [m >= WINDOW for m in automaton.matches(symbols)[WINDOW - 1 :]]
                if not all(repeated):
                    held.append(symbols)
                out.append((a, d, low, _mask(repeated)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "digest", "low", "mask"])

    few = segments.where("not many").select("anchor", "digest", "low", "words")
    return few.repartition("anchor").sortWithinPartitions("anchor", "low", "digest").mapInArrow(work, _MASKS)


def _by_windows(segments: DataFrame) -> DataFrame:
    """The same for anchors with many runs: the smallest document of each window's hash."""

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                hashes, sizes = [], []
                for raw in part.column(3).to_pylist():
                    words = np.frombuffer(raw, np.uint64)
                    at = np.arange(len(words) - WINDOW + 1)
                    hashes.append(range_hashes(words, at, at + WINDOW).view(np.int64))
                    sizes.append(len(at))
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                bit = np.concatenate([np.arange(s, dtype=np.int64) for s in sizes]) if sizes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(c).take(row) for c in range(3)] + [pa.array(np.concatenate(hashes) if hashes else bit), pa.array(bit)], ["anchor", "digest", "low", "window", "bit"])

    many = segments.where("many").select("anchor", "digest", "low", "words")
    windows = stage_table(many.mapInArrow(work, "anchor bigint, digest bigint, low bigint, window bigint, bit bigint"), "windows")
    least = stage_table(windows.groupBy("anchor", "window").agg(F.min("low").alias("least")), "least")
    bits = windows.join(least, ["anchor", "window"]).withColumn("value", F.when(F.col("least") < F.col("low"), F.expr("shiftleft(1L, cast(bit as int))")).otherwise(F.lit(0)))
    return bits.groupBy("anchor", "digest").agg(F.min("low").alias("low"), F.bit_or("value").alias("mask"))


def repeated_windows(source: DataFrame) -> DataFrame:
    """(id, tag, start, windows, mask): runs of windows to remove, all of them where mask is -1; ``source`` has id, text, tag."""
    every = stage_table(_all_runs(source), "runs")
    shared = every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("low < high")
    shared = stage_table(shared.select("anchor", F.col("low").alias("least"), (F.col("d0") != F.col("d1")).alias("several")), "anchors")
    met = stage_table(every.join(shared, "anchor"), "met")
    drop_table(every)
    several = met.where("several")
    of_run = stage_table(several.groupBy("anchor", "digest").agg(F.min("id").alias("low")), "distinct")
    sizes = stage_table(of_run.groupBy("anchor").agg((F.count("*") > MANY_RUNS).alias("many")), "sizes")
    segments = stage_table(_segments(source, of_run.join(sizes, "anchor")), "segments")
    masks = stage_table(_by_automata(segments).unionByName(_by_windows(segments)), "masks")
    for t in (of_run, sizes, segments, shared):
        drop_table(t)
    single = met.where("not several and id > least").select("id", "tag", "start", "windows", F.lit(-1).cast("bigint").alias("mask"))
    rest = several.join(masks, ["anchor", "digest"]).where("id > low or mask <> 0")
    rest = rest.select("id", "tag", "start", "windows", F.when(F.col("id") > F.col("low"), F.lit(-1)).otherwise(F.col("mask")).alias("mask"))
    out = stage_table(single.unionByName(rest).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "windows", "mask")).alias("veil_cut")), "cuts")
    drop_table(met)
    drop_table(masks)
    return out


def _spans(cuts: list[dict], n_words: int) -> np.ndarray:
    """Edges of the word spans that the windows cover: start, end, start, end, ..."""
    at = np.zeros(n_words + 1, np.int32)
    for c in cuts:
        if c["mask"] == -1:
            at[c["start"]] += 1
            at[c["start"] + c["windows"] - 1 + WINDOW] -= 1
        else:
            for k in range(c["windows"]):
                if c["mask"] >> k & 1:
                    at[c["start"] + k] += 1
                    at[c["start"] + k + WINDOW] -= 1
    return np.flatnonzero(np.diff(np.cumsum(at[:-1]) > 0, prepend=False, append=False))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for each row: merged [start, end) word spans and the words that stay, joined by a space."""
    if not isinstance(docs.schema[id_col].dataType, LongType):
        raise TypeError(f"{id_col} must be bigint")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tag", F.hash("text"))
    cuts = repeated_windows(source)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, removed, spans, kept = [], [], [], []
                for text, cut in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = split_words(text)
                    n_words.append(len(words))
                    edges = _spans(cut, len(words)).tolist() if cut else []
                    pairs = list(zip(edges[::2], edges[1::2]))
                    removed.append(sum(b - a for a, b in pairs))
                    spans.append([{"start": a, "end": b} for a, b in pairs])
                    stay, last = [], 0
                    for a, b in pairs:
                        stay += words[last:a]
                        last = b
                    kept.append(b" ".join(stay + words[last:]))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "spans", "kept"])

    both = source.join(cuts, ["id", "tag"], "left").select("id", "text", "veil_cut")
    out = both.mapInArrow(work, "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string")
    return out.withColumnRenamed("id", id_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
