r"""Benchmark decontamination by an FM-index per training shard.

A shard is a stretch of documents.  Its words become ids of the benchmark's vocabulary; runs of known words that are
too short for any window are dropped, since no window can occur there.  The rest is indexed,
all windows are searched backwards at once, occurrences are located by sampled suffix positions, and
their spans are merged for each document.

The windows travel to the workers while the benchmark is below ``BLOCK_BYTES`` of text, which is counted
first; a larger benchmark is cut into blocks that are searched one after the other, of which only hits are kept.

Defined results: null, empty and wordless documents have no hits; null and wordless items have no window; a null
id is kept, a null item id counts as the empty string; items that repeat an id or a text are all looked for; each repeated row is judged alike;
without items nothing is hit; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, stage_table, term_words, without_clashes
from .fm_index import FMIndex

#: words in a window
WINDOW = 13
#: bytes of benchmark text in one block
BLOCK_BYTES = 16 << 20
#: characters of documents in one shard
SHARD_CHARS = 4_000_000
#: occurrences that are located at once
SOME = 1 << 16


class Windows:
    """Distinct windows of a block of items, as ids of the block's words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids: dict[bytes, int] = {}
        by_window: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in term_words(text)]
            size = min(window, len(seq))
            for k in range(len(seq) - size + 1 if size else 0):
                by_window.setdefault(tuple(seq[k : k + size]), set()).add(item)
        self.groups = []  # (length, windows, items of each)
        for size in sorted({len(w) for w in by_window}):
            some = [w for w in by_window if len(w) == size]
            self.groups.append((size, np.array(some, np.int64), [sorted(by_window[w]) for w in some]))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def find(self, texts: list[list[bytes]]) -> list[tuple[list[list[int]], list[str]]]:
        """For each document of a shard: merged spans [start, end) of words, and items with occurrences."""
        found: list[tuple[list, list]] = [([], []) for _ in texts]
        pieces, starts, owners, size = [], [], [], 0
        zero = np.zeros(1, np.int64)
        for d, words in enumerate(texts):
            known = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
            edges = np.flatnonzero(np.diff(known > 0, prepend=False, append=False))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= self.shortest:
                    pieces += (known[a:b], zero)
                    starts.append(size - a)
                    owners.append((size, d))
                    size += b - a + 1
        if not pieces or not self.groups:
            return found
        index = FMIndex(np.concatenate(pieces))
        run_at, run_doc, shift = np.array([o[0] for o in owners]), np.array([o[1] for o in owners]), np.array(starts)
        # spans that meet are one, so words are counted as covered; each run ends with a separator, which never is
        change = np.zeros(size + 1, np.int64)
        named: dict[int, set[str]] = {}
        for length, windows, items in self.groups:
            low, high = index.search(windows)
            ends = np.cumsum(high - low)
            for a in range(0, int(ends[-1]), SOME):  # a window may occur at each word
                occurrence = np.arange(a, min(a + SOME, int(ends[-1])))
                which = np.searchsorted(ends, occurrence, side="right")
                at = index.locate(high[which] - ends[which] + occurrence)
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                doc = run_doc[np.searchsorted(run_at, at, side="right") - 1]
                for pair in np.unique(doc * len(windows) + which).tolist():
                    named.setdefault(pair // len(windows), set()).update(items[pair % len(windows)])
        edges = np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False))
        run = np.searchsorted(run_at, edges[::2], side="right") - 1
        for d, a, b in zip(run_doc[run].tolist(), (edges[::2] - shift[run]).tolist(), (edges[1::2] - shift[run]).tolist()):
            found[d][0].append([a, b])
        for d, some in named.items():
            found[d][1].extend(sorted(some))
        return found


_FOUND = "n_words bigint, spans array<array<bigint>>, items array<string>"


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, spans (merged [start, end) in words, covered by occurrences) and items, under struct ``veil_hit``."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    if n_blocks == 1:
        return _with_hits(docs, text_col, [tuple(r) for r in items.collect()], window)
    # a larger benchmark is read in blocks: each leaves keys and hits only, which meet the documents once
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("n"), text.alias("text"))
    every = None
    for block in range(n_blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()]  # BLOCK_BYTES or so
        hits = _with_hits(keyed, "text", rows, window).select("id", "hash", "n", "veil_hit.*")
        hits = stage_table(hits if block == 0 else hits.where(F.size("spans") > 0), f"hits{block}")
        every = hits if every is None else every.unionByName(hits)
    merged = F.aggregate(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))),
        F.array().cast("array<array<bigint>>"),
        lambda out, x: F.when((F.size(out) > 0) & (x[0] <= F.get(F.get(out, F.size(out) - 1), F.lit(1))), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(F.get(out, F.size(out) - 1)[0], F.greatest(F.get(out, F.size(out) - 1)[1], x[1]))))).otherwise(F.concat(out, F.array(x))),
    )
    found = every.groupBy("id", "hash", "n").agg(F.first("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = stage_table(found.select(F.col("id").alias("veil_id"), F.col("hash").alias("veil_hash"), F.col("n").alias("veil_n"), F.struct("n_words", "spans", "items").alias("veil_hit")), "hits")
    same = docs[id_col].eqNullSafe(found.veil_id) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found.veil_hash) & (F.length(F.coalesce(docs[text_col], F.lit(""))) == found.veil_n)
    return docs.join(found.hint("merge"), same).select(*[docs[c] for c in docs.columns], "veil_hit")


def _with_hits(docs: DataFrame, text_col: str, items: list[tuple[str, str]], window: int) -> DataFrame:
    """``docs`` with ``veil_hit`` for the items given."""
    kinds = docs.select("*", F.lit(None).cast(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>").alias("veil_hit"))
    at_text = docs.columns.index(text_col)

    def run(batches):
        windows = Windows(items, window)
        for batch in batches:
            texts, k = batch.column(at_text), 0
            while k < len(texts):
                first, chars, words = k, 0, []
                while k < len(texts) and chars < SHARD_CHARS:
                    text = texts[k].as_py() or ""
                    words.append(term_words(text))
                    chars += len(text)
                    k += 1
                hits = [{"n_words": len(w), "spans": spans, "items": sorted(set(named))} for w, (spans, named) in zip(words, windows.find(words))]
                columns = [c.slice(first, k - first) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, batch.schema.field("veil_hit").type)], schema=batch.schema)

    return kinds.mapInArrow(run, kinds.schema)


def hit_words(spans: str = "veil_hit.spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def contaminated(hit: str = "veil_hit"):
    """At least a twentieth of the words is hit."""
    return (hit_words(f"{hit}.spans") > 0) & (hit_words(f"{hit}.spans") * 20 >= F.col(f"{hit}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    docs, named_back = without_clashes(docs)
    return named_back(find_spans(docs, benchmark, id_col, text_col).where(~contaminated()).select(*docs.columns))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("veil_hit.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("veil_hit.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("veil_hit.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
