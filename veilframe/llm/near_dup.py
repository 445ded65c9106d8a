r"""Near-duplicate classes: min-max hashing, banding, pivots per bucket, exact check, components.

Under each of ``PERMUTATIONS`` hash permutations both the minimum and the maximum of a document's
shingles are kept: 128 signature values for 64 evaluations.  Four values make a band; a pair at
similarity 0.85 shares none of the 32 bands with a probability of 6e-11.

Buckets are not expanded into pairs.  Texts with equal sets are one class.  Each bucket has a pivot, its member
that meets most others, and members are first compared to that alone.  Where a bucket still holds several
components, its members join the crowd of the pivot's component.  The shingles that most of a crowd has are its core; its
members are split into what they have of the core and the rest, and prefixes of the rest, rarest shingles first, bring
together all pairs that can still be links (``_crowd_pairs``).  Every link is confirmed on full sets (of 64-bit shingle hashes).

Defined results: a document without words (null, empty, blank) has an empty set and is linked with
nothing; a null id is linked with nothing, its component is null and it is kept; rows that repeat an id are judged
each by its own text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, drop_table, id_text, mix64, stage_table, without_clashes, word_hashes
from .components import components

PERMUTATIONS, BAND = 64, 4
_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
#: signature values of 128 that a pair shares at least; at similarity 0.85 fewer come with a probability under 1e-10
LEAST_SHARED = 76
#: percent from which bands and LEAST_SHARED lose next to no link; smaller ones are refused
LEAST_PERCENT = 80


def _text_hash(text):
    """Tells rows of one id apart by their texts; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _class_key(id_col: str):
    """Key of a class: its smallest id, by which keys are ordered, and a hash of its set, since an id may have several texts."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64("digest").alias("set"))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of lower-cased words."""
    hashes = word_hashes(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() touches A-Z only
    if not len(hashes):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(hashes) < words:  # the whole sequence is one shingle, told from those of other lengths
            words, seed = len(hashes), np.uint64(0x51ED270B * len(hashes))
        else:
            seed = np.uint64(0)
        total = np.zeros(len(hashes) - words + 1, np.uint64)
        for k in range(words):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - words + 1 + k]
        return np.unique(mix64(total + seed))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima and maxima under each permutation (uint64, 2 * PERMUTATIONS)."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            x = shingles[None, at : at + 2048] * _MULTIPLY[:, None]
            x ^= x >> np.uint64(32)
            x += _ADD[:, None]
            np.minimum(low, x.min(1), out=low)
            np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """One int64 key for each band, different between bands."""
    keys = np.arange(1, len(sig) // BAND + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in sig.reshape(-1, BAND).T:
            keys = mix64(keys * np.uint64(0xD6E8FEB86659FD93) + part)
    return keys.view(np.int64)


def _sketch(source: DataFrame, words: int) -> DataFrame:
    """(id, text_hash, digest, n, bands, sig) of every row; bands and sig are null for an empty set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests, sizes, bands, sigs = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words)
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None), bands.append(None), sigs.append(None)
                        continue
                    sig = signature(s)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(_band_keys(sig))
                    sigs.append((mix64(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["id", "text_hash", "digest", "n", "bands", "sig"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.select("id", "text", _text_hash("text").alias("text_hash")).mapInArrow(run, f"id {kind}, text_hash bigint, digest binary, n bigint, bands array<bigint>, sig binary")


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures leave the threshold possible; sizes must allow it too."""
    a = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    b = classes.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((left == right).sum(1) >= LEAST_SHARED)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(run, pairs.select("a", "b").schema)


def _sets(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the wanted classes (rep), from the texts; an id with several texts may bring classes beyond those."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), digests, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["id", "digest", "shingles"])

    kind = source.schema["id"].dataType.simpleString()
    ids = wanted.select("rep.id").distinct().hint("merge")  # they grow with the corpus
    texts = source.join(ids, "id").select("id", "text")
    sets = texts.mapInArrow(run, f"id {kind}, digest binary, shingles array<bigint>").where("digest is not null")
    return sets.select(_class_key("id").alias("rep"), "shingles")


class _Check:
    """Confirms pairs on full sets."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with 100 * intersection >= percent * union, as a staged table."""
        likely = stage_table(_alike(pairs, self.classes), "likely")
        a = self.sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        b = self.sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - both
        out = stage_table(likely.join(a, "a").join(b, "b").where(both * 100 >= union * self.percent).select("a", "b"), "links")
        drop_table(likely)
        return out


def _size_ok(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, rows.rep == comp.node, "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) for each row: the smallest id reachable over links of ``percent`` similarity."""
    return _judged(docs, id_col, text_col, words, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, text_hash, n_shingles, group, component_id) for each row; ``group`` tells components with one smallest id apart."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"signatures find links from {LEAST_PERCENT} percent on, not {percent}")
    source = id_text(docs, id_col, text_col)
    sketches = stage_table(_sketch(source, words), "sketches")
    named = sketches.where("n > 0 and id is not null")
    classes = stage_table(named.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumn("rep", _class_key("rep")), "classes")
    keys = stage_table(sketches.select("id", "text_hash", "digest", "n"), "keys")
    drop_table(sketches)

    # most keys have one class: they go before anything but two hashes is moved
    banded = classes.select(F.col("rep.set").alias("set"), F.explode("bands").alias("key"))
    counts = stage_table(banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    members = banded.join(counts, "key").join(classes.select(F.col("rep.set").alias("set"), "rep", "n"), "set")
    members = stage_table(members.select("key", "rep", "n", "members"), "members")
    meets = stage_table(members.groupBy("rep").agg(F.sum("members").alias("meets")), "meets")
    ranked = stage_table(members.join(meets, "rep"), "ranked")
    top = F.max(F.struct("meets", "rep", "n"))
    pivots = stage_table(ranked.groupBy("key").agg(top.alias("top")).select("key", F.col("top.rep").alias("pivot"), F.col("top.n").alias("pivot_n")), "pivots")
    sets = stage_table(_sets(source, meets.select("rep"), words).dropDuplicates(["rep"]), "sets")
    check = _Check(classes, sets, percent)
    first = ranked.join(pivots, "key").where((F.col("rep") != F.col("pivot")) & _size_ok("n", "pivot_n", percent))
    edges = check.links(first.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    comp = components(edges)

    # a bucket of two is settled; a larger one is open while it holds more than its pivot's component
    placed = stage_table(_with_component(ranked.where("members > 2"), comp), "placed")
    homes = pivots.join(placed.select("rep", "comp").distinct(), F.col("pivot") == F.col("rep")).select("key", F.col("comp").alias("home"))
    placed_home = stage_table(placed.join(homes, "key"), "homes")
    open_ = placed_home.where("comp <> home").select("key").distinct()
    crowd = placed_home.join(open_, "key", "left_semi").groupBy("home", "rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    crowd = stage_table(crowd, "crowd")
    pairs = _crowd_pairs(crowd, sets, percent)
    more = check.links(pairs)
    links = edges
    if more.limit(1).count():
        drop_table(comp)
        links = edges.union(more)
        comp = components(links)
    found = classes.select("digest", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("group"))
    found = stage_table(found, "classed")
    for t in (classes, counts, members, meets, ranked, pivots, sets, edges, more, comp, placed, placed_home, crowd, pairs):
        drop_table(t)
    by_digest = keys.join(found, "digest", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("group.id", "id"))
    return by_digest.select("id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("group")).alias("group"), own.alias("component_id"))


def _crowd_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a crowd, of different components, that may still be links.

    With i(x) shingles of the core (those that more than half of the crowd has) and off(x) the others, a and b share at
    most min(i(a), i(b)) plus what off(a) and off(b) share, and a link needs a fixed share of both sizes.  So either
    b is small enough for i(a) alone, found by size bins (width 2 %), or the two meet in the prefixes of off(a) and
    off(b): the rarest shingles first, without as many at the end as any link of that member needs in common, less one.
    """
    share = percent / (100 + percent)  # of both sizes together, that the intersection has at least
    mine = stage_table(crowd.join(sets.select("rep", F.col("shingles").alias("mine")), "rep"), "mine")
    sizes = crowd.groupBy("home").agg(F.count("*").alias("crowd"))
    often = mine.select("home", F.explode("mine").alias("s")).groupBy("home", "s").agg(F.count("*").alias("df")).where("df > 1")
    cores = often.join(sizes, "home").where("2 * df > crowd").groupBy("home").agg(F.collect_list("s").alias("core"))  # at most twice the mean set
    cores = stage_table(cores, "cores")
    core = F.coalesce("core", F.array().cast("array<bigint>"))
    split = mine.join(cores, "home", "left").select("home", "rep", "n", "comp", (F.col("comp") != F.col("home")).alias("outside"), F.size(F.array_intersect("mine", core)).alias("i"), F.array_except("mine", core).alias("off"))
    split = stage_table(split, "split")
    about = split.drop("off")

    bin_of = lambda c: F.floor(F.log(c) / F.log(F.lit(1.02)))
    seekers = about.where("outside").withColumns({"lo": F.greatest(F.col("n") * percent / 100.0 - 1e-6, F.lit(1.0)), "hi": F.col("i") / share - F.col("n") + 1e-6}).where("hi >= lo")
    seekers = seekers.select("home", F.explode(F.sequence(bin_of("lo"), bin_of("hi"))).alias("bin"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("comp").alias("ca"))
    targets = about.select("home", bin_of(F.col("n")).alias("bin"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("comp").alias("cb"))
    enough = F.least("ia", "ib") >= share * (F.col("na") + F.col("nb")) - 1e-6
    by_size = seekers.join(targets, ["home", "bin"]).where((F.col("ca") != F.col("cb")) & enough & _size_ok("na", "nb", percent)).select("a", "b")

    off = stage_table(split.select("home", "rep", F.explode("off").alias("s")), "off")
    common = off.groupBy("home", "s").agg(F.count("*").alias("df")).where("df > 1")
    held = off.join(common, ["home", "s"]).groupBy("home", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("gs"))
    partner = F.greatest(F.col("n") * percent / 100.0, F.col("i"))  # the size of partner that needs least
    need = F.greatest(F.lit(1), F.ceil(share * (F.col("n") + partner) - F.col("i") - 1e-6).cast("int"))
    held = held.join(about, ["home", "rep"]).withColumns({"w": F.size("gs"), "need": need}).where("w >= need")
    held = stage_table(held.withColumn("front", F.transform(F.expr("slice(gs, 1, w - need + 1)"), lambda g: g["s"])).drop("gs", "need"), "held")
    side = lambda rows, x: rows.select("home", F.explode("front").alias("s"), *[F.col(c).alias(c[0] + x) for c in ("n", "comp", "i", "w")], F.col("rep").alias(x), F.col("outside").alias("o" + x))
    reach = F.least("wa", "wb") >= share * (F.col("na") + F.col("nb")) - F.least("ia", "ib") - 1e-6
    once = ~F.col("ob") | (F.col("a") < F.col("b"))
    by_rare = side(held.where("outside"), "a").join(side(held, "b"), ["home", "s"]).where((F.col("ca") != F.col("cb")) & once & reach & _size_ok("na", "nb", percent)).select("a", "b")
    out = stage_table(by_size.union(by_rare).distinct(), "crowded")
    for t in (mine, cores, split, off, held):
        drop_table(t)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps one row, of its smallest id; rows with a null id or no words stay."""
    docs, named_back = without_clashes(docs)
    found = _judged(docs, id_col, text_col, words, percent).where("group is not null").select("group", F.struct("id", "text_hash").alias("row"))
    found = stage_table(found.groupBy("group", "row").agg(F.count("*").alias("times")), "judged")
    firsts = found.groupBy("group").agg(F.min("row").alias("first"))
    gone = found.join(firsts, "group").where((F.col("row") != F.col("first")) | (F.col("times") > 1))
    gone = stage_table(gone.select(F.col("row.id").alias("veil_gone"), F.col("row.text_hash").alias("veil_text"), (F.col("row") == F.col("first")).alias("veil_again")), "dropped")
    drop_table(found)
    same = (docs[id_col] == gone.veil_gone) & (_text_hash(docs[text_col]) == gone.veil_text)
    kept = docs.join(gone.hint("merge"), same, "left_anti")  # what goes grows with the corpus
    again = gone.where("veil_again")
    if again.limit(1).count():  # rows that repeat both id and text: one of each stays
        repeated = docs.join(again, same, "left_semi")
        kept = kept.union(repeated.dropDuplicates([id_col, text_col]))
    return named_back(kept)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), words=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
