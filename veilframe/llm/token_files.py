"""Token-id files: whole texts encoded, Re-Pair compressed a block at a time, in ascending id order.

A block holds the ids of many documents: a header of little-endian uint64 (magic, documents,
rules, symbols, vocabulary size, symbol width), then document ids and a null mask, the symbol offset of each document,
the token offset of each document, the rules, the expansion length of each rule, and the symbols.  No
rule crosses a document, so any document is expanded alone.  A directory table names the blocks.

A text that is cut between two windows of the encoder is still one document of one block.

Defined results: a null or empty text has the end id only; null ids come first; rows that repeat an id follow
each other in order of their texts, each with its own start; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, id_text, new_folder, stage_table
from ._files import Appender, Ranges
from ._pieces import PieceEncoder, give_back_memory
from .repair import Grammar, compress, expansion_lengths

MAGIC = 0x314B4F544C494556
END_ID = 2
#: bytes after which a task starts another file
FILE_BYTES = 256 << 20
#: files of the directory table: it has a row for each block, and a Spark file costs an executor some forks
DIRECTORY_FILES = 8

_DIRECTORY = "shard bigint, block bigint, file string, offset bigint, length bigint, documents bigint, tokens bigint"
#: by path: the encoder and the vocabulary's size
_encoders: dict[str, tuple[PieceEncoder, int]] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 on."""
    out, n = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


def _match_encoder(tokenizer):
    """Ids of single matches by the library's model itself, without its search for matches; None where a tokenizer does more than map bytes to letters."""
    from tokenizers import models, pre_tokenizers

    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer) is not pre_tokenizers.ByteLevel or tokenizer.pre_tokenizer.add_prefix_space or type(tokenizer.model) is not models.BPE or tokenizer.model.dropout:
        return None
    letters, tokenize = np.array(list(map(ord, _byte_letters())), "<u2"), tokenizer.model.tokenize

    def encode(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, ids, counts, at = letters[raw].tobytes().decode("utf-16-le"), array("i"), array("i"), 0
        for end in np.cumsum(sizes).tolist():
            found, at = tokenize(text[at:end]), end
            counts.append(len(found))
            for token in found:  # a match's tokens go at once: many kept together cost more than they are
                ids.append(token.id)
        return np.array(ids, np.int64), np.array(counts, np.int64)

    return encode


def _encoder(path: str) -> tuple[PieceEncoder, int]:
    """The library's own encode at its defaults, added tokens included, and the bytes of each id."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        tokens = [b""] * tokenizer.get_vocab_size()
        for i in range(len(tokens)):  # not the whole vocabulary as one dictionary
            tokens[i] = added[i] if i in added else bytes(map(byte_of.__getitem__, tokenizer.id_to_token(i) or ""))
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        _encoders[path] = PieceEncoder(encode, tokens, tuple(b.decode() for b in added.values()), _match_encoder(tokenizer)), len(tokens)
        give_back_memory()
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(keys: list[int | None], ids: list[bytes], end_id: int, vocabulary_size: int) -> tuple[bytes, int]:
    """(block, tokens) of documents given by id and little-endian uint32 ids without the end id."""
    end = np.array([end_id], "<u4").tobytes()
    flat = np.frombuffer(end.join([*ids, b""]), "<u4")
    sizes = np.array([len(x) // 4 + 1 for x in ids], np.int64)
    symbols, rules = compress(flat, end_id, vocabulary_size)
    grammar_sizes = expansion_lengths(rules, vocabulary_size)
    token_at = np.concatenate([[0], np.cumsum(sizes)])
    symbol_at = np.searchsorted(np.concatenate([[0], np.cumsum(grammar_sizes[symbols])]), token_at)
    width = 2 if vocabulary_size + len(rules) <= 1 << 16 else 4
    head = np.array([MAGIC, len(ids), len(rules), len(symbols), vocabulary_size, width], "<u8")
    parts = [head, np.array([k or 0 for k in keys], "<i8"), np.array([k is None for k in keys], "u1"), symbol_at.astype("<u4"), token_at.astype("<u4"), rules.astype("<u4"), grammar_sizes[vocabulary_size:].astype("<u4"), symbols.astype(f"<u{width}")]
    return b"".join(p.tobytes() for p in parts), int(sizes.sum())


class Block:
    """A block read back: ids of all documents or of one."""

    def __init__(self, data: bytes):
        magic, n, n_rules, n_symbols, self.vocabulary_size, width = np.frombuffer(data, "<u8", 6).tolist()
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        keys, null = take("<i8", n).tolist(), take("u1", n).tolist()
        self.keys = [None if z else k for k, z in zip(keys, null)]
        self.symbol_at, self.token_at = take("<u4", n + 1).astype(np.int64), take("<u4", n + 1).astype(np.int64)
        rules, self.lengths = take("<u4", 2 * n_rules).astype(np.int64).reshape(-1, 2), take("<u4", n_rules)
        self.symbols = take(f"<u{width}", n_symbols)
        self.grammar = Grammar(rules, self.vocabulary_size)

    def document(self, k: int) -> np.ndarray:
        """Ids of document ``k`` with the end id, from its own symbols."""
        return self.grammar.expand(self.symbols[self.symbol_at[k] : self.symbol_at[k + 1]]).astype("<u4")

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols).astype("<u4")


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes the files; returns their directory (shard, block, file, offset, length, documents, tokens), in id order by shard and block."""
    path = vocabulary or default_vocabulary()
    folder = folder or new_folder(docs.sparkSession, "tokens")
    source = id_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))

    def work(batches):
        encoder, size = _encoder(path)
        shard, to = TaskContext.get().partitionId(), Appender(folder, ".tokens", FILE_BYTES)
        for block, (keys, _, ids) in enumerate(encoder.windows(batches)):
            data, tokens = pack(keys, ids, end_id, size)
            row = (shard, block, *to.add(data), len(keys), tokens)
            kinds = [pa.string() if " string" in c else pa.int64() for c in _DIRECTORY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in _DIRECTORY.split(", ")])
        to.close()

    rows = source.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text").mapInArrow(work, _DIRECTORY)
    return stage_table(rows.repartition(DIRECTORY_FILES, F.col("shard") % DIRECTORY_FILES), "tokens")  # by shard: a repeated task's rows go where they went


def read_tokens(directory: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids): ``start`` counts the ids of all documents before; ids are little-endian uint32 with the end id."""
    shards = directory.groupBy("shard").agg(F.sum("tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))  # a row for each shard
    within = F.sum("tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("tokens")
    blocks = directory.withColumn("within", within).join(shards, "shard").select((F.col("shard_start") + F.col("within")).alias("start"), "file", "offset", "length")

    def work(batches):
        files = Ranges()
        for batch in batches:
            for start, name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(files.read(name, offset, length))
                ids, at = block.all_ids(), block.token_at
                for k in range(0, len(block.keys), 256):
                    last = min(k + 256, len(block.keys))
                    some = [ids[at[d] : at[d + 1]].tobytes() for d in range(k, last)]
                    yield pa.RecordBatch.from_arrays([pa.array(block.keys[k:last], pa.int64()), pa.array(at[k:last] + start), pa.array(some, pa.binary())], ["id", "start", "ids"])
        files.close()

    spread = blocks.repartition(max(8, 2 * directory.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(work, "id bigint, start bigint, ids binary").withColumnRenamed("id", id_col)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_tokens(write_tokens(documents(spark, sf_dir)))
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
