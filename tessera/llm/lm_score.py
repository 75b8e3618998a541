"""LM scoring: online logistic context mixing.

The text is read as tokens - words with A-Z folded, then one end - and each token as bytes with a closing blank, each byte
as the bits of a prefix code. Five predictors see a hash of their context: the last one, two, three or four bytes of the
word, or the whole word so far. The first two also take in the class and what the token before ended with (nothing yet, the
end of a sentence, other punctuation, anything else), so contexts reach across words; the third and the last take in the
class; they hold, per hash slot, how often the next bit was 0 and 1. Their log odds are mixed by weights chosen by a gate:
the number of the bit, whether it begins a word, and how often the whole-word context was seen. Weights learn online, step
by step through each shard, from predictions that leave out the occurrence at hand. An adaptive table, by bit, last byte
and predicted log odds, refines the mixture, and the two are averaged. What all bits of a text cost is its score; over its
bytes, its bits per byte. A text's class, here its language, is paid for: its price is part of the score.

A token costs the same wherever class and the end before it are the same. It is therefore coded once, not once an
occurrence: 1. words are counted by context over all training texts; 2. predictors are counted over the words; 3. mixing
weights and the refining table are learned in each shard and averaged; 4. each word is scored; 5. texts add up their
tokens. Words with a count of at least a threshold, chosen so that they make at most ``HEAD`` rows, are broadcast; others
are joined by word, to the same effect. The predictors' tables are of a fixed size (``BITS``); counts, shards and joins grow
with the corpus.

Edge cases: a null or empty text is one end token; words without training count are scored by their bytes; without any
training text bits are even before refinement; a null class is a class of its own; classes are told apart by 14 bits of a
hash; repeated rows and ids give a row each; a null id counts as the empty text for the split; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, cut, id_and_text, ship

HEAD = 1 << 19  # rows of words to broadcast
SHARD = 1 << 18  # rows of words a shard
FOLDS, HELD_OUT = 7, 2
#: Slots of each predictor, as powers of two.
BITS = (16, 18, 20, 21, 21)
ORDERS = len(BITS)
STARTS = tuple(int(x) for x in np.concatenate(([0], np.cumsum([1 << b for b in BITS]))))
PRIOR, RATE, CHUNK, STEP = 0.05, 0.02, 1 << 13, 2048
GRADES = np.array([0.5, 3, 10, 40, 200], np.float32)
DEPTHS = 8  # bits of a byte beyond these share the last one's gates
GATES = DEPTHS * 2 * (len(GRADES) + 1)
LEVELS = np.linspace(-12, 12, 25, dtype=np.float32)  # log odds of the refining table
REFINED = (DEPTHS * 256, len(LEVELS), 2)
END = b"\n"
CLASSES = (1 << 14) - 1  # hashes of the class; one more for null
SLICE = 1 << 23  # bytes of text read at a time

#: What a token can end with: 1 the end of a sentence, 2 other punctuation, 3 anything else; 0 stands for no token.
ENDING = np.full(256, 3, np.uint8)
ENDING[list(b".!?")], ENDING[list(b",;:")] = 1, 2


# The byte code


@dataclass
class Code:
    """For every byte its number of bits, and for each of them the inner node of the code tree that it leaves, and the bit."""

    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def prefix_code(counts: np.ndarray) -> Code:
    """Huffman's code for bytes, each counted once more than it is."""
    heap = [(int(n) + 1, i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a[2], b[2]))
        heapq.heappush(heap, (a[0] + b[0], 255 + len(children), 255 + len(children)))
    paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
    for at in range(len(children) - 1, -1, -1):
        for bit, child in enumerate(children[at]):
            paths[child] = [*paths[256 + at], (at, bit)]
    deepest = max(len(paths[b]) for b in range(256))
    node, bit = np.zeros((deepest, 256), np.uint64), np.zeros((deepest, 256), np.int64)
    for b in range(256):
        for j, (n, x) in enumerate(paths[b]):
            node[j, b], bit[j, b] = n, x
    return Code(np.array([len(paths[b]) for b in range(256)]), node, bit)


# Words as arrays


def raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words and where each begins and ends."""
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = words.buffers()[2] if len(words) else None
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)), ends.astype(np.int64) - ends[0]


@dataclass
class Spelled:
    """All words' bytes, each word with its closing blank; hashes of every byte's contexts; place in the word; starts of words."""

    data: np.ndarray
    ctx: np.ndarray
    place: np.ndarray
    starts: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.data)))

    def bits(self, code: Code) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For the first, second, ... bits of bytes: the number, which bytes have one, the node of each, the bit."""
        at = np.arange(len(self.data))
        for j in range(len(code.node)):
            if j:
                at = at[code.size[self.data[at]] > j]
            if not len(at):
                return
            yield j, at, code.node[j][self.data[at]], code.bit[j][self.data[at]]


def spell(words: pa.Array, kinds: np.ndarray) -> Spelled:
    """kinds: for each word its class, above two bits for what the token before ended with."""
    text, offsets = raw(words)
    lengths = np.diff(offsets) + 1
    starts = np.cumsum(lengths) - lengths
    data = np.full(len(text) + len(words), 32, np.uint8)
    data[np.arange(len(text)) + np.repeat(np.arange(len(words)), lengths - 1)] = text
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    ctx = np.zeros((ORDERS, len(data)), np.uint64)
    for k in range(1, ORDERS):
        last = np.zeros(len(data), np.uint64)
        last[k:] = data[:-k]
        last[place < k] = 0
        for o in range(k - 1, ORDERS - 1):
            ctx[o] |= last << np.uint64(8 * (k - 1))
    ctx[0] |= np.minimum(place, 3).astype(np.uint64) << np.uint64(8)
    # The word so far: a polynomial of its bytes.
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), 0xD1342543DE82EF95, np.uint64))
    sums = np.cumsum((data + np.uint64(1)) * powers[place]) - (data + np.uint64(1)) * powers[place]
    ctx[4] = sums - np.repeat(sums[starts], lengths)
    kind = np.repeat(kinds.astype(np.uint64) + np.uint64(1), lengths) * np.uint64(0xC2B2AE3D27D4EB4F)
    name = np.repeat((kinds >> 2).astype(np.uint64) + np.uint64(1), lengths) * np.uint64(0xA24BAED4963EE407)
    ctx[:2] += kind
    ctx[[2, 4]] += name
    return Spelled(data, ctx, place, starts)


def before(s: Spelled) -> np.ndarray:
    """The byte before each one, 0 where a word begins."""
    out = np.concatenate(([0], s.data[:-1])).astype(np.int64)
    out[s.starts] = 0
    return out


# The mixer


def slots(ctx: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    """The predictor's slot for its context and node."""
    mixed = (ctx + node * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS[order])).astype(np.int64) + STARTS[order]


def count_contexts(table: np.ndarray, s: Spelled, code: Code, counts: np.ndarray) -> None:
    """Adds the words' bits to table (slots by 2)."""
    weight, flat = np.repeat(counts, s.lengths).astype(np.float32), table.reshape(-1)
    for _, at, node, bit in s.bits(code):
        w = weight[at]
        for k in range(ORDERS):
            np.add.at(flat, 2 * slots(s.ctx[k][at], node, k) + bit, w)


def gates(j: int, place: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (min(j, DEPTHS - 1) * 2 + (place == 0)) * (len(GRADES) + 1) + seen


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level below and how far x is on the way to the next."""
    at = np.clip((x - LEVELS[0]) / (LEVELS[1] - LEVELS[0]), 0, len(LEVELS) - 1.001)
    return at.astype(np.int64), (at - at.astype(np.int64)).astype(np.float32)


def first_weights() -> np.ndarray:
    return np.full((GATES, ORDERS), 0.3, np.float32)


def first_refined() -> np.ndarray:
    """Counts of zeros and ones that agree with the level, by bit, last byte and level."""
    p = squash(LEVELS)
    return np.tile(np.stack([1 - p, p], axis=1).astype(np.float32) * 2, (REFINED[0], 1, 1))


def mixed(weights: np.ndarray, gate: np.ndarray, odds: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ji->i", weights.take(gate, axis=0), odds)


def learn(table: np.ndarray, s: Spelled, code: Code, counts: np.ndarray, weights: np.ndarray, refined: np.ndarray, rate: float) -> None:
    """One online step: predicts the words' bits, each without its own occurrence, then moves weights and adds to refined, in place."""
    weight, last = np.repeat(counts, s.lengths).astype(np.float32), before(s)
    pairs = table.view(np.uint64).reshape(-1)
    for j, at, node, bit in s.bits(code):
        odds, w, ones = np.empty((ORDERS, len(at)), np.float32), weight[at], bit.astype(np.float32)
        for k in range(ORDERS):
            c = pairs.take(slots(s.ctx[k][at], node, k)).view(np.float32).reshape(-1, 2)
            n0, n1 = np.maximum(c[:, 0] - (1 - ones), 0), np.maximum(c[:, 1] - ones, 0)
            odds[k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
        gate = gates(j, s.place[at], np.searchsorted(GRADES, n0 + n1))
        x = mixed(weights, gate, odds)
        error = (ones - squash(x)) * w
        total = np.bincount(gate, w, GATES) + 1e-6
        for k in range(ORDERS):
            weights[:, k] += rate * np.bincount(gate, error * odds[k], GATES) / total
        low, part = levels(x)
        cell = ((min(j, DEPTHS - 1) * 256 + last[at]) * len(LEVELS) + low) * 2 + bit
        np.add.at(refined.reshape(-1), cell, w * (1 - part))
        np.add.at(refined.reshape(-1), cell + 2, w * part)


@dataclass
class Frozen:
    """A model to score with: log odds of every slot, grades of the last predictor's slots, weights, refined probabilities."""

    odds: np.ndarray
    grade: np.ndarray
    weights: np.ndarray
    refined: np.ndarray
    code: Code


def frozen(table: np.ndarray, weights: np.ndarray, refined: np.ndarray, code: Code) -> Frozen:
    grade = np.searchsorted(GRADES, table[STARTS[-2] :].sum(axis=1)).astype(np.uint8)
    return Frozen(np.log((table[:, 1] + PRIOR) / (table[:, 0] + PRIOR)), grade, weights, (refined[:, :, 1] / refined.sum(axis=2)).astype(np.float32).reshape(-1), code)


def predict(m: Frozen, s: Spelled, j: int, at: np.ndarray, node: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The probability that the bit is 1."""
    odds = np.empty((ORDERS, len(at)), np.float32)
    for k in range(ORDERS):
        slot = slots(s.ctx[k][at], node, k)
        odds[k] = m.odds.take(slot)
    x = mixed(m.weights, gates(j, s.place[at], m.grade.take(slot - STARTS[-2])), odds)
    low, part = levels(x)
    cell = (min(j, DEPTHS - 1) * 256 + last[at]) * len(LEVELS) + low
    return 0.5 * squash(x) + 0.5 * (m.refined.take(cell) * (1 - part) + m.refined.take(cell + 1) * part)


def score_words(m: Frozen, s: Spelled) -> np.ndarray:
    """log10 probability of each word."""
    cost, last = np.zeros(len(s.data)), before(s)
    for j, at, node, bit in s.bits(m.code):
        p = predict(m, s, j, at, node, last)
        cost[at] += np.log10(np.clip(np.where(bit == 1, p, 1 - p), 1e-7, 1))
    return np.add.reduceat(cost, s.starts) if len(s.starts) else cost


# Summing numbered arrays of floats over tasks, and fetching the sum.

BLOCK = 1 << 16


def blobs(arrays: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Blocks of the arrays that are not all zero, sparse."""
    rows = []
    for name, array in arrays.items():
        values = array.reshape(-1)
        for i in range(0, len(values), BLOCK):
            part = values[i : i + BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((f"{name}:{i}", at.astype(np.uint16).tobytes(), part[at].astype(np.float64 if name == "w" else np.float32).tobytes()))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary()))], ["block", "at", "value"])


def fetch_sums(partial: DataFrame, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Sums blocks by name in the cluster and puts the sums together here; their size is that of shapes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, np.zeros(BLOCK)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([total[at].astype(np.float32).tobytes()], pa.binary())], ["block", "at", "value"])

        for batch in batches:
            for b, at, value in zip(batch["block"].to_pylist(), batch["at"], batch["value"]):
                if b != name:
                    if name is not None:
                        yield out()
                    name = b
                    total[:] = 0
                total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(value.as_buffer(), np.float64 if b.startswith("w:") else np.float32)
        if name is not None:
            yield out()

    summed = partial.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block string, at binary, value binary")
    found = {n: np.zeros(int(np.prod(s)), np.float32) for n, s in shapes.items()}
    for row in summed.toLocalIterator():
        name, start = row["block"].split(":")
        found[name][int(start) + np.frombuffer(row["at"], np.uint16).astype(np.int64)] = np.frombuffer(row["value"], np.float32)
    return {n: a.reshape(shapes[n]) for n, a in found.items()}


# Texts as tokens


@dataclass
class Tokens:
    """The distinct words of some texts, END the last of them; for every token its word, its text and what the token before
    ended with. Words come first, text by text, then the texts' ends."""

    words: pa.Array
    word: np.ndarray
    text: np.ndarray
    after: np.ndarray
    n_bytes: np.ndarray  # of each text, a blank or the end after each word


def tokens(texts: pa.Array) -> Tokens:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():
        words, text = words.filter(full), text[full.to_numpy(zero_copy_only=False)]
    data, ends = raw(words)
    ending = ENDING[data[ends[1:] - 1]]
    first = np.diff(text, prepend=-1) != 0
    after = np.concatenate((np.where(first, 0, np.concatenate(([0], ending[:-1])) if len(ending) else ending), np.zeros(len(texts), np.int64)))
    final = np.diff(text, append=len(texts)) != 0
    after[len(text) + text[final]] = ending[final]
    coded = words.cast(pa.binary()).dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
    word = np.concatenate((coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.full(len(texts), len(distinct) - 1)))
    n_bytes = np.bincount(text, np.diff(ends) + 1, len(texts)).astype(np.int64) + 1
    return Tokens(distinct, word, np.concatenate((text, np.arange(len(texts)))), after, n_bytes)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about SLICE bytes of text each."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
            yield batch.slice(start, end - start)
            start = end


def grouped(key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, all below limit, and how often each occurs."""
    if limit <= max(1 << 16, 8 * len(key)):
        n = np.bincount(key, minlength=limit)
        found = np.flatnonzero(n)
        return found, n[found]
    return np.unique(key, return_counts=True)


def count_words(rows: DataFrame) -> DataFrame:
    """word, class, c (count in training texts of the class), c_all (in all), first (one row of each word).

    class holds the text's class above two bits for what the token before ended with. Words of held-out texts alone have c_all
    0. Rows come in the order of a hash of the word within partitions by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = tokens(batch["text"])
            kinds, kind = np.unique(batch["class"].to_numpy() * 2 + batch["held_out"].to_numpy(zero_copy_only=False), return_inverse=True)
            wide = 4 * len(kinds)
            key, n = grouped((t.word * len(kinds) + kind[t.text]) * 4 + t.after, len(t.words) * wide)
            which = kinds[key % wide // 4]
            class_ = (which // 2 * 4 + key % 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t.words.take(pa.array(key // wide)), pa.array(class_), pa.array(np.where(which % 2, 0, n))], ["word", "class", "c"])

    ship(rows)
    counted = rows.select("text", "held_out", "class").mapInArrow(run, "word binary, class int, c long").repartition("word")
    counted = counted.groupBy("word", "class").agg(F.sum("c").alias("c"))
    each = Window.partitionBy(F.xxhash64("word"), "word")
    return counted.withColumn("first", F.row_number().over(each.orderBy("class")) == 1).withColumn("c_all", F.sum("c").over(each))


# Training and scoring words


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Spelled, np.ndarray, pa.RecordBatch]]:
    """Words spelled out, their counts and their rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            yield spell(part["word"], part["class"].to_numpy()), part["c"].to_numpy(), part


class Packed:
    """An array to broadcast, compressed: executors write what they receive to disk, for some tasks anew."""

    def __init__(self, array: np.ndarray):
        import zstandard

        self.shape, self.kind = array.shape, array.dtype.str
        self.data = zstandard.compress(array.tobytes(), 3)
        self.array = None

    def __getstate__(self):
        return self.__dict__ | {"array": None}

    def get(self) -> np.ndarray:
        """The array, unpacked once a worker."""
        if self.array is None:
            import zstandard

            self.array = np.frombuffer(zstandard.decompress(self.data), self.kind).reshape(self.shape)
        return self.array


@dataclass
class Model:
    """Two broadcasts: the predictors' slot counts, packed; the mixing weights with the refining counts; and the byte code."""

    table: Broadcast
    mixing: Broadcast
    code: Code


SUMS = "block string, at binary, value binary"


def train(words: DataFrame) -> Model:
    """The model of a table of words and counts."""
    sc, n_slots, seen = words.sparkSession.sparkContext, STARTS[-1], words.filter("c > 0")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256)
        for batch in batches:
            n += np.bincount(raw(batch["word"])[0], minlength=256)
            n[32] += batch.num_rows
        if (out := blobs({"b": n})) is not None:
            yield out

    ship(words)
    code = prefix_code(fetch_sums(seen.select("word").mapInArrow(histogram, SUMS), {"b": (256,)})["b"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((n_slots, 2), np.float32)
        for s, counts, _ in chunks(batches):
            count_contexts(table, s, code, counts)
        if (out := blobs({"t": table})) is not None:
            yield out

    table = fetch_sums(seen.mapInArrow(count, SUMS), {"t": (n_slots, 2)})["t"]
    shared = sc.broadcast(Packed(table))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, refined, mass, n = first_weights(), np.zeros(REFINED, np.float32), 0.0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                counts = part["c"].to_numpy()
                learn(shared.value.get(), spell(part["word"], part["class"].to_numpy()), code, counts, weights, refined, max(RATE, 1 / (2 + n)))
                mass, n = mass + float(counts.sum()), n + 1
        if mass:
            yield blobs({"w": np.concatenate((weights.reshape(-1).astype(np.float64) * mass, [mass])), "r": refined})

    found = fetch_sums(seen.mapInArrow(step, SUMS), {"w": (GATES * ORDERS + 1,), "r": REFINED})
    mass = float(found["w"][-1])
    weights = (found["w"][:-1] / mass).reshape(GATES, ORDERS) if mass else first_weights()
    return Model(shared, sc.broadcast((weights.astype(np.float32), found["r"] + first_refined())), code)


def with_scores(words: DataFrame, model: Model) -> DataFrame:
    """word, class, c_all and lp, its log10 probability."""
    shared, mixing, code = model.table, model.mixing, model.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen(shared.value.get(), *mixing.value, code)
        for s, _, rows in chunks(batches):
            yield pa.RecordBatch.from_arrays([rows["word"], rows["class"], rows["c_all"], pa.array(score_words(m, s))], ["word", "class", "c_all", "lp"])

    return words.mapInArrow(run, "word binary, class int, c_all long, lp double")


def head_count(words: DataFrame, most: int) -> int:
    """The least count, 1 or above, that the words of at most ``most`` rows reach. Counts above 2**16 are told apart by magnitude."""
    n = F.col("c_all")
    grade = F.when(n < 1 << 16, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long"))
    sizes = words.filter("c_all > 0").groupBy(grade.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    total, least = 0, None
    for row in sizes.toLocalIterator():
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    return least or 1 << 62


# Adding up texts


@dataclass
class Head:
    """Words to be broadcast: their counts, and by (number of the word, class), sorted, the log10 probabilities."""

    words: list[bytes]
    c: np.ndarray
    key: np.ndarray
    lp: np.ndarray


def head_of(scored: DataFrame, known: int) -> Head:
    top = scored.filter(F.col("c_all") >= known).toArrow()
    coded = top["word"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    c = np.zeros(len(coded.dictionary), np.int64)
    c[number] = top["c_all"].to_numpy()
    key = number << 16 | top["class"].to_numpy()
    order = np.argsort(key)
    return Head(coded.dictionary.to_pylist(), c, key[order], top["lp"].to_numpy()[order])


def add_up(rows: DataFrame, head: Head, log_total: float) -> DataFrame:
    """A row per text with what its head words sum to, and a row per other word and context of it, to be joined."""
    shared = rows.sparkSession.sparkContext.broadcast(head)
    kind = dict(rows.dtypes)["doc_id"]
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_bytes", "word", "class", "tf", "k", "b", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        get, base = {w: i for i, w in enumerate(h.words)}.get, np.append(np.log10(h.c + 1) - log_total, 0)
        seen = np.append(h.c > 0, False)
        serial, task = 0, TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            t, n = tokens(batch["text"]), batch.num_rows
            number = np.fromiter((get(w, -1) for w in t.words.to_pylist()), np.int64, len(t.words))
            classes, class_ = np.unique(batch["class"].to_numpy(), return_inverse=True)
            wide = 4 * len(classes)
            pair = (t.word * len(classes) + class_[t.text]) * 4 + t.after
            own, _ = grouped(pair, len(t.words) * wide)
            at = number[own // wide]
            key = np.where(at < 0, -1, at << 16 | (classes[own % wide // 4] * 4 + own % 4))
            place = np.minimum(np.searchsorted(h.key, key), max(0, len(h.key) - 1))
            lp = np.where(at < 0, 0, h.lp[place]) if len(h.key) else np.zeros(len(own))
            if len(own) * 4 < len(t.words) * wide:
                pair = np.searchsorted(own, pair)
            else:
                to = np.zeros(len(t.words) * wide, np.int64)
                to[own] = np.arange(len(own))
                pair = to[pair]
            add = lambda each: np.bincount(t.text, each[pair], n)
            uid = task + serial + np.arange(n)
            serial += n
            # The blank keeps these rows' keys apart from all words.
            whole = [pa.array(uid), batch["doc_id"], batch["held_out"], pa.array(np.bincount(t.text, minlength=n)), pa.array(t.n_bytes), pa.array([b" %d" % u for u in uid], pa.binary()),
                     batch["class"], pa.array(np.zeros(n, np.int64)), pa.array(add(seen[at].astype(float)).astype(np.int64)), pa.array(add(base[at])), pa.array(add(lp))]
            yield pa.RecordBatch.from_arrays(whole, names)
            rest = np.flatnonzero(at[pair] < 0)
            if len(rest):
                which, tf = np.unique(t.text[rest] * len(own) + pair[rest], return_counts=True)
                of, what = which // len(own), own[which % len(own)]
                none = lambda like: pa.nulls(len(which), like)
                class_of = (classes[what % wide // 4] * 4 + what % 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(uid[of]), none(batch["doc_id"].type), none(pa.bool_()), none(pa.int64()), none(pa.int64()), t.words.take(pa.array(what // wide)),
                                                  pa.array(class_of), pa.array(tf), none(pa.int64()), none(pa.float64()), none(pa.float64())], names)

    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_bytes long, word binary, class int, tf long, k long, b double, s double"
    return rows.mapInArrow(run, schema)


def prices(rows: DataFrame) -> DataFrame:
    """class and price: log10 of its share of training texts, counted once more for every class; at most CLASSES + 1 rows."""
    sizes = rows.groupBy(F.col("class").alias("_class")).agg(F.sum((~F.col("held_out")).cast("long")).alias("n"))
    total, kinds = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return sizes.select("_class", F.log10((F.col("n") + 1) / F.lit(max(1, total + kinds))).alias("price"))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", folds: int = FOLDS, held_out: int = HELD_OUT, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents whose crc32(id as text) modulo folds is held_out are scored but not learned from. class_col: a column that
    contexts take in and that is paid for (None: no such column).
    """
    kind = F.lit(0) if class_col is None else F.when(col(class_col).isNull(), CLASSES).otherwise(F.crc32(col(class_col).cast("string").cast("binary")) % CLASSES)
    rows = id_and_text(df.withColumn("_class", kind.cast("int")), id_col, text_col, "_class").withColumnRenamed("_class", "class")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = rows.withColumn("held_out", fold == held_out)
    words = cut(count_words(rows))
    n_rows, n_train, v_train = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("first") & (F.col("c_all") > 0), 1))).first()
    known = head_count(words, head)
    shards = words.coalesce(max(1, -(-n_rows // shard)))
    scored = cut(with_scores(words, train(shards)))
    log_total = math.log10(n_train + v_train + 1)
    parts = add_up(rows, head_of(scored, known), log_total)
    tail = scored.filter(F.col("c_all") < known).select(F.col("word").alias("_word"), F.col("class").alias("_class"), F.col("c_all").alias("c"), "lp")
    joined = parts.join(tail, (F.col("word") == F.col("_word")) & (F.col("class") == F.col("_class")), "left")
    tf = F.col("tf")
    per_text = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"),
        F.max(F.when(F.col("n_tokens").isNotNull(), F.col("class"))).alias("class"),
        F.sum(F.coalesce("k", F.when(F.col("c") > 0, tf), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("b", tf * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(log_total)))).alias("base_score"),
        F.sum(F.coalesce("s", tf * F.col("lp"))).alias("score"),
    )
    paid = per_text.join(F.broadcast(prices(rows)), F.col("class") == F.col("_class")).withColumn("score", F.col("score") + F.col("price"))
    bpb = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return paid.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score", bpb.alias("bits_per_byte"))


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` scored by a model of those that are not held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
