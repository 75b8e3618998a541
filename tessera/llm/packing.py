"""Packing: documents into token sequences of balanced attention cost.

A piece of n tokens costs n + n * n / SCALE. Pieces are taken in descending cost, and each goes to the sequence of lowest
cost that has room for it. Documents longer than a sequence are cut into whole sequences and a rest. Pieces that no
sequence has room for are cut to fill what gaps are left, so that of all sequences of a block only the last can be partly
filled; it is split at powers of two, which need no padding.

Packing goes by blocks: a task packs what it has read each time that it holds ``block_tokens`` tokens. No row is shuffled
and no group gathered; memory is bounded by a block and the longest document. The packing depends on how the input is
split into tasks; sequence ids are unique, from the task's partition number and a counter.

Edge cases: a null or empty text is the end id alone; repeated rows and ids are packed each on their own; an empty table
gives no pieces; other columns are left out.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, ship

LENGTH, END_ID, SCALE, BLOCK_TOKENS = 2048, 1, 2048, 1 << 20

#: How byte-level BPE vocabularies of this kind cut text before merging. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such a vocabulary: printable bytes for themselves, others from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def encoder(path: str) -> Callable[[str], bytes]:
    """From text to ids as little-endian unsigned 32-bit numbers; equal to the tokenizers library's on the file at path.

    Texts with special tokens in them go to the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", ())]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(path)
    has_special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search

    def encode(text: str) -> bytes:
        if special and has_special(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(array("I", fast(text)), "<u4").tobytes()

    return encode


def assign(lengths: np.ndarray, capacity: int, bins: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the sequence it goes to (-1: none has room), and each sequence's tokens: lowest cost first, longest piece first."""
    cost, room, to = np.zeros(bins), np.full(bins, capacity, np.int64), np.full(len(lengths), -1, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = lengths[i]
        open_ = room >= n
        if bins and (k := int(np.where(open_, cost, np.inf).argmin())) >= 0 and open_[k]:
            to[i] = k
            cost[k] += n + n * n / scale
            room[k] -= n
    return to, capacity - room


def pack_block(lengths: list[int], capacity: int = LENGTH, scale: float = SCALE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths; sequences are numbered from 0."""
    out: list[tuple[int, int, int, int, int]] = []
    rests: list[tuple[int, int, int]] = []
    sequence = 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((d, n - n % capacity, n % capacity))
    total = sum(n for *_, n in rests)
    bins = total // capacity
    to, used = assign(np.array([n for *_, n in rests], np.int64), capacity, bins, scale)
    used_by = [0] * bins
    left: list[list[int]] = []
    for (d, start, n), k in zip(rests, to.tolist()):
        if k < 0:
            left.append([d, start, n])
        else:
            out.append((d, start, n, sequence + k, used_by[k]))
            used_by[k] += n
    # The left pieces, cut to fill the gaps, then sequences of a power of two each.
    tail = total - bins * capacity
    gaps = [(sequence + k, u, capacity - u) for k, u in enumerate(used_by) if u < capacity]
    gaps += [(sequence + bins + i, 0, 1 << b) for i, b in enumerate(b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1)]
    for k, at, room in gaps:
        while room:
            d, start, n = left[0]
            take = min(room, n)
            out.append((d, start, take, k, at))
            at, room = at + take, room - take
            left[0] = [d, start + take, n - take]
            if take == n:
                left.pop(0)
    return out


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = LENGTH,
                   end_id: int = END_ID, scale: float = SCALE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start in its document, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset there."""
    rows = id_and_text(df, id_col, text_col)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        base, sequences = TaskContext.get().partitionId() << 40, 0
        ids: list[pa.Scalar] = []
        texts: list[bytes] = []
        held = 0
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal sequences, held
            pieces = pack_block([len(t) // 4 for t in texts], capacity, scale)
            d, start, length, seq, offset = zip(*pieces)
            out = [pa.array([ids[i] for i in d], kind), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                   pa.array([texts[i][4 * s : 4 * (s + n)] for i, s, n in zip(d, start, length)], pa.binary()),
                   pa.array([len(texts[i]) // 4 for i in d], pa.int64()), pa.array([base + sequences + s for s in seq], pa.int64()), pa.array(offset, pa.int64())]
            sequences += max(seq) + 1
            ids.clear()
            texts.clear()
            held = 0
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch["doc_id"].type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids.append(doc_id)
                texts.append(encode(text.as_py()) + end)
                held += len(texts[-1]) // 4
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    ship(df)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {PIECES}")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of at most 2048 tokens; ids as their CRC-32."""
    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
