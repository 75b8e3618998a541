"""Near copies by SimHash: wide fingerprints propose groups by deletion variants, exact Jaccard similarities decide.

Texts link where their sets of five-word shingles have a similarity of at least 0.8. The fingerprints of such a pair differ in
about 15 % of their bits, too many for the 64 bits of ``simhash``, so these have WORDS * 64: bit i is set if it is set in over
half of the shingles' hashes (on a tie, if in one that is chosen alike), of a hash of its own for each word. They are cut into SEGMENTS
segments of two halves of HALF bits. As in ``simhash``, two fingerprints meet where a segment differs in at most one bit,
found by deleting each bit in turn and joining by equality, and are verified by RADIUS on CHECK words. One differing bit
leaves a half equal, so a segment takes two rows and not one a bit: rows are dealt by a half, and the bits of the other are
deleted where the rows arrive. Of pairs at 0.8 that differ in 15.15 % of bits, five in a million meet in no segment, of closer
ones fewer; four shingles among five differ in 19 %, and of such pairs about three in a thousand are missed.

Nodes are distinct texts, by XXH64; equal texts need no link. Only (key, node, check) rows are shuffled for all texts. Links of
fingerprints give components, texts are fetched for their members alone, once each, and within a component sets are searched
breadth first, exactly, which gives a spanning forest and never all pairs. A component above HOT nodes is cut into parts, and
each two parts are searched together, so that no task holds more; that work is the square of the component. Keys have
2 * HALF - 1 bits, so that a group grows as N / 2^17.

Edge cases: a null text is the empty text; texts without words are one group; fewer words than a shingle are one shingle;
repeated ids and ids that are null are rows like any other, since nodes are texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, cut, lower_ascii, ship, spread_join
from tessera.llm.simhash import components, hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a fingerprint; its segments and the bits of half a segment, which fit into the words.
WORDS, SEGMENTS, HALF = 14, 49, 9
#: Linked fingerprints differ in at most RADIUS bits of their first CHECK words.
CHECK, RADIUS = 3, 56
#: How groups of a key are searched (see meet); CHUNK rows or more are searched at once.
SMALL, LARGE, CHUNK = 32, 1024, 1 << 16
HOT = 2048
BROADCAST_NODES = 1 << 20
ENTRIES = "key int, node long, " + ", ".join(f"check{i} long" for i in range(CHECK))


def node_of(text_col: str = "text") -> Column:
    """The node of a row."""
    return F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))


def shingles(text: str, size: int) -> np.ndarray:
    """The set of the text's shingles, sorted."""
    return np.unique(hashes(lower_ascii(text).split(), size))


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


#: A multiplier for each word, and one for each byte's ties.
BY, TIES = np.split(multipliers(9 * WORDS), [WORDS])


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of sorted shingles."""
    counts, n = np.zeros(64 * WORDS, np.int64), len(found)
    if not n:
        return np.zeros(WORDS, np.uint64)
    for i in range(0, n, 255):
        mixed = found[i : i + 255, None] * BY
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        if not i:
            # Breaks ties, by a shingle for each byte; counts are doubled below, so that it does nothing else.
            least = np.argmin(found[:32, None] * TIES, axis=0)
            first = np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8)[least, np.arange(len(TIES))], bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts + first > n, bitorder="little").view("<u8").astype(np.uint64)


def segment_keys(prints: np.ndarray) -> np.ndarray:
    """Two keys a segment of each fingerprint: the number of segment and half, above that half, above the other one."""
    bits = np.unpackbits(prints.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")[:, : SEGMENTS * 2 * HALF]
    halves = (bits.reshape(len(prints), SEGMENTS, 2, HALF) * (1 << np.arange(HALF, dtype=np.int32))).sum(axis=3, dtype=np.int32)
    number = np.arange(2 * SEGMENTS, dtype=np.int32).reshape(1, SEGMENTS, 2)
    return (number << (2 * HALF) | halves << HALF | halves[:, :, ::-1]).reshape(len(prints), 2 * SEGMENTS)


def index(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(key, node, check words) for each half of each segment of the rows (node, text); a task passes a text on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()

        def out(nodes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            prints, per = np.stack(found), 2 * SEGMENTS
            checks = [pa.array(np.repeat(prints.view(np.int64)[:, i], per)) for i in range(CHECK)]
            return pa.RecordBatch.from_arrays([pa.array(segment_keys(prints).ravel()), pa.array(np.repeat(np.array(nodes, np.int64), per)), *checks], ["key", "node", *(f"check{i}" for i in range(CHECK))])

        nodes, found = [], []
        for batch in batches:
            for node, text in zip(batch["node"].to_pylist(), batch["text"]):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    found.append(wide_fingerprint(shingles(text.as_py(), size)))
                if len(nodes) == 512:
                    yield out(nodes, found)
                    nodes, found = [], []
            if len(seen) > 1 << 20:
                seen.clear()
        if nodes:
            yield out(nodes, found)

    ship(rows)
    return rows.mapInArrow(run, ENTRIES)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of links but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := least[x] != least[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(least[x], least[y]), np.minimum(least[x], least[y]))
        while (least[least] != least).any():
            least = least[least]
    other = least != np.arange(len(nodes))
    return nodes[other], nodes[least[other]]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of check words, which lie in rows."""
    out = np.bitwise_count(a[0] ^ b[0])
    for x, y in zip(a[1:], b[1:]):
        out += np.bitwise_count(x ^ y)
    return out


def meet(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the least rows of their components by verified links; keys are of whole groups that share a half.

    Rows of a group above SMALL are first compared with its first one, and the group is left if that makes it one component.
    Groups up to LARGE are compared pair by pair, others breadth first. Pairs within a component are not kept.
    """
    least, words = np.arange(len(key)), np.ascontiguousarray(check.T)

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal least
        a, b = least[a], least[b]
        if (apart := a != b).any():
            other, to = stars(a[apart], b[apart])
            table = np.arange(len(key))
            table[other] = to
            least = table[least]

    for bit in range(HALF):
        deleted = key & ~np.int32(1 << bit)
        order = np.argsort(deleted, kind="stable")
        k, c = deleted[order], words[:, order]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(starts, len(k)))
        own, open_ = least[order], sizes > 1
        if (large := sizes > SMALL).any():
            rows = np.flatnonzero(np.repeat(large, sizes))
            first = np.repeat(starts[large], sizes[large])
            near = distance(c[:, rows], c[:, first]) <= RADIUS
            unite(order[rows[near]], order[first[near]])
            own = least[order]
            open_[large] = np.logical_or.reduceat(own[rows] != own[first], np.cumsum(sizes[large]) - sizes[large])
        for s, n in zip(starts[open_ & (sizes > LARGE)].tolist(), sizes[open_ & (sizes > LARGE)].tolist()):
            rest = np.arange(s, s + n)
            queue: list[int] = []
            while len(rest):
                at, rest = (queue.pop(), rest) if queue else (int(rest[0]), rest[1:])
                near = distance(c[:, rest], c[:, at]) <= RADIUS
                if near.any():
                    unite(order[rest[near]], np.full(near.sum(), order[at]))
                    queue += rest[near].tolist()
                    rest = rest[~near]
        size = np.repeat(np.where(open_ & (sizes <= LARGE), sizes, 1), sizes)
        pairs, n = [], 0
        for lag in range(1, LARGE):
            if lag & (lag - 1) == 0:
                # Groups that have met in full are left out.
                keep = size > lag
                k, c, order, own, size = k[keep], c[:, keep], order[keep], own[keep], size[keep]
            if len(k) <= lag or not (same := k[lag:] == k[:-lag]).any():
                break
            at = np.flatnonzero(same & (distance(c[:, lag:], c[:, :-lag]) <= RADIUS) & (own[lag:] != own[:-lag]))
            pairs.append((order[at], order[at + lag]))
            if (n := n + len(at)) > len(key):
                unite(*map(np.concatenate, zip(*pairs)))
                pairs, n, own = [], 0, least[order]
        if n:
            unite(*map(np.concatenate, zip(*pairs)))
    other = np.flatnonzero(least != np.arange(len(key)))
    return other, least[other]


def join_index(entries: DataFrame) -> DataFrame:
    """(a, b): links that span the components of fingerprints that meet and verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, node: np.ndarray, check: np.ndarray) -> Iterator[pa.RecordBatch]:
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node, check = key[once], node[once], check[once]
            a, b = meet(key, check)
            a, b = stars(node[a], node[b])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, n, least = [], 0, CHUNK
        for batch in batches:
            held.append((batch["key"].to_numpy(), batch["node"].to_numpy(), np.stack([batch[f"check{i}"].to_numpy().view(np.uint64) for i in range(CHECK)], axis=1)))
            n += batch.num_rows
            if n >= least:
                key, node, check = map(np.concatenate, zip(*held))
                at = int(np.searchsorted(key >> HALF, key[-1] >> HALF, "left"))
                if at:
                    yield from found(key[:at], node[:at], check[:at])
                held, n = [(key[at:], node[at:], check[at:])], len(key) - at
                least = max(CHUNK, 2 * n)
        if n:
            yield from found(*map(np.concatenate, zip(*held)))

    ship(entries)
    return entries.repartition(F.shiftright("key", HALF)).sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def with_roots(roots: DataFrame) -> DataFrame:
    """Rows (node, root) of components(), which leaves out the roots themselves, and the roots."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def groups(named: DataFrame) -> DataFrame:
    """(grp, node) for the rows (node, root): a group a component, or one for each two parts of it where it is above HOT."""
    sizes = named.groupBy("root").agg(F.count("*").alias("n")).withColumn("size", F.col("n"))
    rows = spread_join(named, sizes, "root", named.count())
    parts = F.ceil(F.col("size") / (HOT // 2)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda p: p != own)
    pairs = F.transform(others, lambda p: F.xxhash64("root", F.least(p, own), F.greatest(p, own)))
    return rows.select(F.explode(F.when(F.col("size") <= HOT, F.array("root")).otherwise(pairs)).alias("grp"), "node")


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span each component of the sets, by exact similarity."""
    links: list[tuple[int, int]] = []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    vocabulary, words = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    rest, flat, mark = np.arange(len(sets)), words, np.zeros(len(vocabulary), np.int64)
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, gone = [int(rest[0])], np.arange(len(rest)) == 0
        else:
            at = queue.pop()
            own = words[ends[at] - sizes[at] : ends[at]]
            mark[own] = 1
            sums = np.concatenate(([0], np.cumsum(mark[flat])))
            mark[own] = 0
            edge = np.concatenate(([0], np.cumsum(sizes[rest])))
            common = sums[edge[1:]] - sums[edge[:-1]]
            gone = common >= similarity * (sizes[rest] + sizes[at] - common) - 1e-9
            links += [(at, int(i)) for i in rest[gone]]
            queue += rest[gone].tolist()
        if gone.any():
            flat, rest = flat[np.repeat(~gone, sizes[rest])], rest[~gone]
    return links


def links_within(members: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) of the groups of (grp, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, nodes, sets = None, [], []

        def out() -> pa.RecordBatch | None:
            found = forest(sets, similarity) if len(nodes) > 1 else []
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for g, node, text in zip(batch["grp"].to_pylist(), batch["node"].to_pylist(), batch["text"]):
                if g != grp:
                    if (found := out()) is not None:
                        yield found
                    grp, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(shingles(text.as_py(), size))
        if (found := out()) is not None:
            yield found

    ship(members)
    return members.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; df is cheap to read again."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def candidates(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, root) for the components of the rows (node, text) by their fingerprints; nodes without a link are left out."""
    return with_roots(components(cut(join_index(index(texts, size)))))


def superfluous(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node of all texts that are in a component with one of a lower id; without ids, of a lower node."""
    texts = df.select(node_of(text_col).alias("node"), col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    found = cut(candidates(texts.select("node", "text"), shingle))
    wanted = small(found.select("node"))
    members = cut(texts.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text")))
    roots = components(cut(links_within(groups(found).join(members.select("node", "text"), "node"), shingle, similarity)))
    named = cut(with_roots(roots).join(members.select("node", "first_id"), "node"))
    first = named.groupBy("root").agg(F.min_by("node", F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("kept"), F.count("*").alias("n"))
    return cut(spread_join(named, first, "root", named.count()).filter("node <> kept").select("node"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: of its least id, or where it has none, of its least node."""
    spare = small(superfluous(df, id_col, text_col))
    rows = df.select(node_of(text_col).alias("node"), col(id_col).alias("id"), F.struct("*").alias("doc")).join(spare, "node", "left_anti")
    return rows.groupBy("node").agg(F.min_by("doc", F.struct(F.col("id").isNull(), "id")).alias("doc")).select("doc.*")
