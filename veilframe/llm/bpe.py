"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The symbols of a pre-token form a doubly linked list of byte positions.  A bucket per merge rank
holds the positions whose pair has that rank, and a three-level bitmap (64-way) marks the non-empty
buckets: find-first-set names the lowest rank in three steps.  An entry is stale, and skipped, when
its position no longer starts a pair of that rank.  Short pre-tokens share one queue and are merged side by
side in numpy; a long one has the queue to itself.  Work is O(n log n) for a pre-token of n bytes.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import documents, id_text
from ._pieces import PieceEncoder, give_back_memory

#: texts taken at once from an Arrow batch; bounds what a worker holds beside the batch
SLICE = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class RankQueue:
    """Priority queue of (rank, position) for small integer ranks: buckets under a 64-way bitmap tree."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, pos)
            return
        self.buckets[rank] = [pos]
        a = rank >> 6
        self.low[a] |= 1 << (rank & 63)
        b = a >> 6
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position."""
        top = self.top
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        pos = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[a] = word = word & (word - 1)
            if not word:
                word = self.mid[b] = self.mid[b] & ~(1 << (a & 63))
                if not word:
                    self.top &= ~(1 << b)
        return rank, pos


#: pre-tokens above this many bytes are merged alone, by the scalar queue
TOGETHER_BYTES = 256


class RankQueueBPE:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._queue = RankQueue(len(self.tokens))
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self._pair_keys = np.append(keys[order], np.int64(2**62))
        self._pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self._byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, queue, get = len(piece), self._queue, ranks.get
        push, pop, buckets = queue.push, queue.pop, queue.buckets
        end = list(range(1, n + 1))  # a symbol's end is the start of the next one
        before = list(range(-1, n))
        at = [-1] * n  # rank of the pair that starts here, -1 if none or if the position is gone
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                at[i] = r
                push(r, i)
        while buckets:
            r, i = pop()
            if at[i] != r:
                continue  # stale
            gone = end[i]
            after = end[i] = end[gone]
            at[gone] = at[i] = -1
            if after < n:
                before[after] = i
                r = get(piece[i : end[after]])
                if r is not None:
                    at[i] = r
                    push(r, i)
            left = before[i]
            if left >= 0:
                r = get(piece[left:after])
                if r is None:
                    at[left] = -1
                elif r != at[left]:
                    at[left] = r
                    push(r, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self._pair_keys, keys)
        return np.where(self._pair_keys[at] == keys, self._pair_ranks[at], -1)

    def encode_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, end of each piece's ids) of many short pre-tokens, which share one queue.

        A leaf word of the bitmap covers 64 ranks and has one bucket.  When find-first-set names a leaf,
        each pre-token with entries there merges its lowest rank, leftmost position, all in one step:
        pre-tokens do not touch each other, so each sees its own merges in rank order.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        own = np.repeat(np.arange(len(pieces)), sizes)
        token = self._byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # n and -1: none; slot n takes stray writes
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        at = np.full(n + 1, -1, np.int64)
        has = np.flatnonzero(after < n)
        at[has] = self._pair_rank(token[has], token[has + 1])
        leaves: dict[int, list[np.ndarray]] = {}
        words = [0] * ((len(self.tokens) >> 12) + 1)
        top = 0

        def push(pos: np.ndarray) -> None:
            nonlocal top
            leaf = at[pos] >> 6
            order = np.argsort(leaf, kind="stable")
            pos, leaf = pos[order], leaf[order]
            cuts = np.flatnonzero(np.diff(leaf, prepend=-2))
            for a, b, x in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pos)], leaf[cuts].tolist()):
                leaves.setdefault(x, []).append(pos[a:b])
                words[x >> 6] |= 1 << (x & 63)
                top |= 1 << (x >> 6)

        push(np.flatnonzero(at[:n] >= 0))
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            leaf = (high << 6) + (word & -word).bit_length() - 1
            words[high] = word = word & (word - 1)
            if not word:
                top &= top - 1
            pos = np.concatenate(leaves.pop(leaf))
            pos = pos[at[pos] >> 6 == leaf]  # others are stale
            if not len(pos):
                continue
            order = np.lexsort((pos, at[pos], own[pos]))
            pos = pos[order]
            first = np.diff(own[pos], prepend=-1) != 0
            later, i = pos[~first], pos[first]
            gone = after[i]
            next_ = after[gone]
            token[i] = at[i]
            after[i] = next_
            before[next_] = i
            alive[gone] = False
            at[gone] = -1
            at[i] = -1
            to = next_ < n
            right = i[to]
            at[right] = self._pair_rank(token[right], token[next_[to]])
            left = before[i]
            left, mid = left[left >= 0], i[left >= 0]
            at[left] = self._pair_rank(token[left], token[mid])
            fresh = np.concatenate([later, right, left])
            fresh = fresh[at[fresh] >= 0]
            if len(fresh):
                push(fresh)
        return token[alive], np.cumsum(np.bincount(own[alive], minlength=len(pieces)))

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian uint32."""
        out, short, at = [b""] * len(matches), [], []
        for k, m in enumerate(matches):
            piece = m.encode("utf-8", "replace")
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > TOGETHER_BYTES:
                out[k] = np.array(self.encode_bytes(piece), "<u4").tobytes()
            else:
                short.append(piece)
                at.append(k)
        if short:
            ids, ends = self.encode_together(short)
            flat, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            for k, a, b in zip(at, [0, *ends], ends):
                out[k] = flat[a:b]
        return out

    def encode_texts(self, find, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; ``find`` splits one into pre-tokens. Equal pre-tokens are encoded once."""
        split = [find(t) for t in texts]
        distinct = list(set().union(*split))
        known = dict(zip(distinct, self.encode_matches(distinct)))
        return [np.frombuffer(b"".join(map(known.__getitem__, s)), "<u4") for s in split]


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def _encoder(path: str, pattern: str) -> PieceEncoder:
    """One encoder for each vocabulary and worker; workers are used for many tasks."""
    if (path, pattern) not in _encoders:
        bpe, find = RankQueueBPE(load_ranks(path)), regex.compile(pattern).findall
        _encoders[path, pattern] = PieceEncoder(lambda texts: bpe.encode_texts(find, texts), bpe.tokens)
        give_back_memory()
    return _encoders[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None, decoded: bool = False) -> DataFrame:
    """(id, ids): whole texts as little-endian uint32 ids. With ``decoded`` also the bytes that these ids give back.

    A null text counts as empty and gives no ids; a null id is kept; each repeated row is encoded; other
    columns of ``docs`` are not read.  An empty table gives no rows.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batches):
        encoder = _encoder(path, pattern)
        for keys, _, ids in encoder.windows(batches):
            for at in range(0, len(keys), SLICE):
                some = ids[at : at + SLICE]
                columns = [pa.array(keys[at : at + SLICE], key_type), pa.array(some, pa.binary())]
                if decoded:
                    columns.append(pa.array([encoder.decode(np.frombuffer(x, "<u4")).tobytes() for x in some], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "bytes"][: len(columns)])

    source = id_text(docs, id_col, text_col)
    kind, key_type = source.schema["id"].dataType.simpleString(), to_arrow_type(source.schema["id"].dataType)
    return source.mapInArrow(run, f"id {kind}, ids binary" + ", bytes binary" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id, ids, bytes): adds the bytes that the ids stand for. Null ids count as none."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([encoder.decode(np.frombuffer(x or b"", "<u4")).tobytes() for x in part.column(1).to_pylist()], pa.binary())], ["id", "ids", "bytes"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary, bytes binary").withColumnRenamed("id", id_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(documents(spark, sf_dir), decoded=True)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
