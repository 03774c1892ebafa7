"""SimHash near-duplicates by anchor points of a covering code.

64 bits are cut into four blocks: two of 23 bits under the perfect binary Golay code (covering radius 3) and two of 9
bits under the repetition code (covering radius 4). A product codeword is an anchor: 2^26 of them, and every fingerprint
has exactly one *home* anchor, which is within the covering radius in each block. A fingerprint is replicated to every
anchor whose distance exceeds the covering radius, summed over the blocks, by no more than the threshold: if x and y
differ in at most that many bits, y is at the home anchor of x. So comparing home members with all members per anchor
finds every link, about 75 replicas a fingerprint at threshold 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import join_hot, materialize, words_of
from tracewright.llm.components import connected_components

#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1 (published constant).
GOLAY = 0b101011100011
#: Shingles whose bits are counted at once, so a long text needs no more memory than a short one.
CHUNK = 1 << 15
#: Members of one anchor that are compared in memory; anchors with more go through shared mid-points instead.
CELL_ROWS = 4096


def simhash64(words: list[bytes], shingle_words: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values; no words: 0; fewer words than a shingle has: one shingle."""
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + shingle_words - 1]
        rows = [digest(join(s), seed) for s in zip(*(part[j:] for j in range(shingle_words)), strict=False)] if total > 1 or len(words) >= shingle_words else [digest(join(words), seed)]
        h = np.array(rows, dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp): the SimHash of each whole text as a signed long; a null or empty text has fingerprint 0.

    Null ids and repeated rows stay as they are; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash64(words_of(t), shingle_words, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


@lru_cache(maxsize=4)
def _golay(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte syndromes, and per syndrome the error patterns within radius plus threshold with their excess (9: none)."""

    def syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    unit = [syndrome(1 << i) for i in range(24)]
    per_byte = np.zeros((3, 256), dtype=np.uint16)
    for k in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * k + i < 23:
                    per_byte[k, v] ^= unit[8 * k + i]
    found: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    layer = [(0, 0, -1)]
    for weight in range(3 + threshold + 1):
        for word, s, _ in layer:
            found[s].append((word, max(0, weight - 3)))
        layer = [(word | 1 << i, s ^ unit[i], i) for word, s, last in layer for i in range(last + 1, 23)]
    width = max(map(len, found))
    words, excess = np.zeros((2048, width), dtype=np.int64), np.full((2048, width), 9, dtype=np.int8)
    for s, row in enumerate(found):
        for j, (word, over) in enumerate(row):
            words[s, j], excess[s, j] = word, over
    return per_byte, words, excess


def anchors(fps: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchor ids and home flags of every anchor that each fingerprint (uint64) is replicated to."""
    per_byte, words, excess = _golay(threshold)
    v = fps.astype(np.uint64)
    block = [(v & np.uint64(0x7FFFFF)).astype(np.int64), (v >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)]
    parts = []
    for x in block:
        s = per_byte[0][x & 255] ^ per_byte[1][x >> 8 & 255] ^ per_byte[2][x >> 16]
        parts.append((x[:, None] ^ words[s], excess[s]))
    ends = []
    for shift in (46, 55):
        ones = np.bitwise_count(v >> np.uint64(shift) & np.uint64(0x1FF)).astype(np.int8)
        ends.append(np.stack([np.maximum(0, ones - 4), np.maximum(0, 5 - ones)], axis=1))
    tail = (ends[0][:, :, None] + ends[1][:, None, :]).reshape(len(v), 4)
    rows, ids, homes = [], [], []
    for i in range(words.shape[1]):
        over = parts[0][1][:, i, None] + parts[1][1]
        r, j = np.nonzero(over <= threshold)
        total = over[r, j, None] + tail[r]
        k, t = np.nonzero(total <= threshold)
        rows.append(r[k])
        ids.append(parts[0][0][r[k], i] | parts[1][0][r[k], j[k]] << 23 | t.astype(np.int64) << 46)
        homes.append(total[k, t] == 0)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(homes)


def _compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole, sorted anchor cells, as a star forest of each cell: no more edges than members."""
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[start, len(anchor)])
    cell = np.repeat(np.arange(len(start)), size)
    h = np.flatnonzero(home & (size[cell] > 1))
    label = np.arange(len(fp))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    costs = np.cumsum(size[cell[h]])
    at = 0
    while at < len(h):
        to = max(at + 1, int(np.searchsorted(costs, (costs[at - 1] if at else 0) + 2_000_000, side="right")))
        some, n = h[at:to], size[cell[h[at:to]]]
        left = np.repeat(some, n)
        right = np.repeat(start[cell[some]], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (left != right)
        ends.append((left[near], right[near]))
        at = to
    if not ends:
        return fp[:0], fp[:0]
    left, right = (np.concatenate(x) for x in zip(*ends, strict=True))
    while len(left):
        least = np.minimum(label[left], label[right])
        was = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if np.array_equal(was, label):
            break
    moved = np.flatnonzero((label != np.arange(len(fp))) & (fp != fp[label]))
    return fp[moved], fp[label[moved]]


def anchor_links(fps: DataFrame, fp_col: str = "fp", threshold: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links between different fingerprints that, with their transitive closure, hold every pair within threshold bits.

    fps has one row per distinct fingerprint (repeats cost time only; nulls are left out). Cells stream through their task sorted by anchor; a
    cell of over cell_rows members is not held in memory: its members are linked through the fingerprints at half the
    threshold around them, which two texts within the threshold share (exact for a threshold of 2 or less, groups of 65
    at most), so no cap drops a link.
    """
    if threshold > 2:
        raise ValueError("a threshold over 2 needs another mid-point rule")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 1024):
                v = every[at : at + 1024]
                rows, ids, homes = anchors(v, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v[rows].view(np.int64)), pa.array(homes)], names=["anchor", "fp", "home"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

        rest: tuple[np.ndarray, ...] | None = None
        large = None
        for batch in batches:
            new = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            cur = tuple(np.concatenate(x) for x in zip(rest, new, strict=True)) if rest is not None else new
            if large is not None:  # an anchor that is already over the bound goes on in this batch
                n = int(np.searchsorted(cur[0], large, side="right"))
                if n:
                    yield out(1, cur[1][:n], cur[1][:n])
                cur = tuple(x[n:] for x in cur)
                if not len(cur[0]):
                    rest = None
                    continue
                large = None
            last = int(np.searchsorted(cur[0], cur[0][-1], side="left"))
            if last:
                a, b = _split(*(x[:last] for x in cur))
                yield from a
                if b is not None:
                    yield out(1, b, b)
            rest = tuple(x[last:] for x in cur)
            if len(rest[0]) > cell_rows:
                large = rest[0][0]
                yield out(1, rest[1], rest[1])
                rest = None
        if rest is not None and len(rest[0]):
            a, b = _compare(*rest, threshold)
            yield out(0, a, b)

    def _split(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[list[pa.RecordBatch], np.ndarray | None]:
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[start, len(anchor)])
        big = np.repeat(size > cell_rows, size)
        a, b = _compare(anchor[~big], fp[~big], home[~big], threshold) if not big.all() else (fp[:0], fp[:0])
        names = ["kind", "a", "b"]
        return [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)], (fp[big] if big.any() else None)

    each = fps.select(F.col(fp_col).cast("long").alias("fp")).where("fp is not null")
    replicas = each.mapInArrow(replicate, "anchor long, fp long, home boolean")
    found = materialize(replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(cells, "kind int, a long, b long").distinct(), "anchor-links")
    crowded = found.where("kind = 1").select("a").distinct()
    middle = crowded.select("a", F.explode(F.expr("concat(array(a), transform(sequence(0, 63), i -> a ^ shiftleft(1L, i)))")).alias("m"))
    grouped = middle.groupBy("m").agg(F.collect_set("a").alias("s")).where("size(s) > 1")
    star = grouped.select(F.explode("s").alias("a"), F.array_min("s").alias("b")).where("a <> b")
    return found.where("kind = 0").select("a", "b").unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, threshold: int = 2, seed: int = 42) -> DataFrame:
    """(id_col, fp, component_id): every document with the smallest id that links of threshold bits or fewer reach.

    Equal fingerprints are one node, so copies are never paired, and frequent ones' groups are broadcast to their documents. Null and empty texts have fingerprint 0 and are linked
    like any other; a null id stays in the result but is nobody's component id unless its whole group has null ids; an
    empty table gives an empty result; columns of other names in docs are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = connected_components(anchor_links(nodes, "fp", threshold)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    said = materialize(placed.join(smallest, "root").select("fp", "component_id", "n"), "simhash-groups")
    total = int(nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return join_hot(fps, said, ["fp"], "n", total).select(id_col, "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
