"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits link where they differ in at most four bits. A fingerprint is cut into three segments, so that two
linked ones differ by at most one bit in some segment; each segment is indexed once for each of its bits with that bit
deleted, 64 entries a fingerprint, and entries are joined by equality and verified on all bits. Equal fingerprints are one
node, so exact copies cost nothing here.

The join never emits all pairs of a group. Entries are sorted by key and read as a stream: a small group is compared pair
by pair, a larger one is searched breadth first and gives a spanning forest, which is all that components need. A group
too large for a task's memory is streamed out and linked another exact way: each of its fingerprints is connected with all
2,081 values within two bits of it; two fingerprints share such a value just if they differ in at most four bits.
Components are found by alternating large and small stars, with a checkpoint a round.

Edge cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle are one shingle;
repeated rows and ids give a row each; documents without id take part, but give no component its id; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, cut, id_and_text, lower_ascii, ship, spread_join

SHINGLE, SEED, DIFFER = 4, 42, 4
#: First bits of the three segments, and the end.
SEGMENTS = (0, 21, 42, 64)
#: Groups up to SMALL are compared pair by pair, those above HOT are linked through the values within two bits.
SMALL, HOT = 32, 4096


def hashes(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    buffer = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(buffer, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size]))
    return np.array([xxh64_intdigest(buffer[a:b], seed) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 8192):
        part = found[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    rows = id_and_text(df, id_col, text_col)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(hashes(lower_ascii(t.as_py()).split())) for t in batch["text"]], np.uint64)
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

        return apply

    return arrow_map(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def deletion_keys(fp: np.ndarray) -> np.ndarray:
    """64 keys a fingerprint: the number of the deleted bit, above its segment without that bit."""
    out = np.empty((len(fp), 64), np.int32)
    for a, b in zip(SEGMENTS, SEGMENTS[1:]):
        segment = (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        for bit in range(a, b):
            out[:, bit] = (segment & ~np.uint64(1 << (bit - a))).astype(np.int32) | np.int32(bit << 22)
    return out


def near_bits() -> np.ndarray:
    """All masks of at most two bits."""
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(one[i] | one[j] for i in range(64) for j in range(i))], np.uint64)


def indexed(nodes: DataFrame) -> DataFrame:
    """(key, fp) for every deletion variant of every fingerprint."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(deletion_keys(fp).ravel()), pa.array(np.repeat(fp.view(np.int64), 64))], ["key", "fp"])

        return apply

    return arrow_map(nodes.select("fp"), make, "key int, fp long")


def forest(fp: np.ndarray, differ: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span each component of a group, found breadth first."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    rest = fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= differ
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
    return a, b


def links_of(key: np.ndarray, fp: np.ndarray, differ: int = DIFFER) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within groups of equal key; key is sorted and groups are whole."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        more = forest(fp[s : s + n], differ)
        a += more[0]
        b += more[1]
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, f = key[small], fp[small]
    for lag in range(1, min(SMALL, len(k))):
        same = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + lag]) <= differ]
        a.append(f[near])
        b.append(f[near + lag])
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def batch_of(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])


def join_index(index: DataFrame, differ: int = DIFFER) -> DataFrame:
    """Links (a, b) of the index; rows with hot=true are fingerprints whose group was too large to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot_key = np.empty(0, np.int32), np.empty(0, np.uint64), None
        for batch in batches:
            k, f = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if hot_key is not None:
                n = int(np.searchsorted(k, hot_key, "right"))
                if n:
                    yield batch_of(f[:n], f[:n], True)
                k, f = k[n:], f[n:]
            if not len(k):
                continue
            key, fp, hot_key = np.concatenate((key, k)), np.concatenate((fp, f)), None
            at = int(np.searchsorted(key, key[-1], "left"))
            if at:
                yield from whole(key[:at], fp[:at])
            key, fp = key[at:], fp[at:]
            if len(key) > HOT:
                hot_key = key[0]
                yield batch_of(fp, fp, True)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from whole(key, fp)

    def whole(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        large = np.repeat(sizes > HOT, sizes)
        if large.any():
            yield batch_of(fp[large], fp[large], True)
            key, fp = key[~large], fp[~large]
        if len(key):
            a, b = links_of(key, fp, differ)
            if len(a):
                yield batch_of(a, b, False)

    ship(index)
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, hot boolean")


def join_dense(dense: DataFrame) -> DataFrame:
    """Links among fingerprints (column fp) through shared values within two bits: each with the first that shares one."""

    def make():
        masks = near_bits()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch["fp"].to_numpy().view(np.uint64)
            hubs = fp[:, None] ^ masks[None, :]
            return pa.RecordBatch.from_arrays([pa.array(hubs.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(masks)))], ["hub", "fp"])

        return apply

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, first = None, None
        for batch in batches:
            h, f = batch["hub"].to_numpy(), batch["fp"].to_numpy()
            new = np.concatenate(([h[0] != hub if hub is not None else True], h[1:] != h[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            to = np.where(at >= 0, f[np.maximum(at, 0)], first if first is not None else 0)
            hub, first = h[-1], to[-1]
            keep = to != f
            if keep.any():
                pairs = np.unique(np.stack([to[keep], f[keep]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    # 128 fingerprints become a batch of some 4 MB.
    spark = dense.sparkSession
    chunks = dense.select(F.explode(F.array("fp")).alias("fp")).repartition(max(8, spark.sparkContext.defaultParallelism))
    hubs = arrow_map(chunks, lambda: sliced(make()), "hub long, fp long")
    return hubs.repartition("hub").sortWithinPartitions("hub", "fp").mapInArrow(run, "a long, b long").distinct()


def sliced(apply):
    """apply on small parts of a batch, joined."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [apply(batch.slice(i, 128)) for i in range(0, batch.num_rows, 128)]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return whole


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that can be reached."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(spread_join(both.filter("v > u"), least, "u", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        stars = spread_join(large, least, "u", before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(stars.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if (now := mark(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = DIFFER) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least id that links lead to, its own included)."""
    if not 0 <= differ <= DIFFER:
        raise ValueError("three segments find up to four differing bits")
    found = cut(fingerprints(df, id_col, text_col))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    links = cut(join_index(indexed(nodes), differ))
    dense = links.filter("hot").select(F.col("a").alias("fp")).distinct()
    pairs = links.filter("not hot").select("a", "b")
    if differ == DIFFER and dense.limit(1).count():
        pairs = pairs.unionByName(join_dense(dense))
    elif dense.limit(1).count():
        raise ValueError("groups this dense are linked at four differing bits only")
    roots = components(pairs)
    joined = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root")))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = cut(spread_join(joined, least, "root", joined.count()).select("fp", "component_id", F.col("copies").alias("n")))
    return spread_join(found, named, "fp", found.count()).select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` with fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
