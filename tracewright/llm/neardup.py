"""The near-duplicate stage: SimHash candidates, decided by the overlap of word shingles.

A whole-text fingerprint within two bits finds texts that differ in little of their length. A pair whose shingle sets
have a Jaccard similarity of 0.8 differs in 6 to 12 of 64 bits, which no anchor cover reaches at a bearable number of
replicas. So each text also has several fingerprints of small, consistently chosen samples: for each, the shingles
with the least hashes under three seeded permutations, whose SimHash two texts share with a probability of about the
similarity to the power of three. Candidates of either kind are pairs of a member with the first or last text of its
group. A candidate whose parity sketches (about two bits a shingle) differ in more bits than two sets of that similarity
have unlike shingles can't be a link; of the others, the exact similarity of the shingle sets decides.

What these leave apart is found exactly, by a prefix filter: two sets of that similarity share one of the first shingles
in any common order (a fifth of each set at 0.8). Common shingles, as a sample of the rows has them, come last in the
order, which costs or saves candidates but never loses one. Prefixes go to the cells of their shingles once, packed, and
members of different components meet there, so a group that is linked already makes no pairs. A cell of few members
pairs them all; in a cell of many, two members become a pair only if parity sketches folded to 512 bits let them. The
two steps together lose no link.

Texts with the same words are one node with a number of its own; documents are never joined on a null or repeated id
alone. In every join on a key that may be hot (a sample, a shingle, a group's first text), the hot keys' side is broadcast
or the key is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewright.llm import simhash
from tracewright.llm.common import join_hot, materialize, parts, sparing, splitmix, words_of
from tracewright.llm.components import connected_components

#: Sampled fingerprints a text: they link most groups early; the prefix filter finds what they miss.
SAMPLES = 12
#: Members that one task compares with a group's first text, and keys that are broadcast (some 40 bytes each).
MEMBERS, BROADCAST_KEYS = 2048, 200_000
#: Of one in so many rows, the shingles that occur this often, and at most so many of them, are last in the prefix order.
SAMPLE_ROWS, COMMON_COUNT, COMMON_MOST = 16, 3, 200_000
#: Members of a shingle's cell that are paired as they are (so at most 32 pairs a member); nodes to a bucket of cells.
CELL, BUCKET_NODES = 64, 16384
#: Known roots that are broadcast (two longs each).
BROADCAST_ROOTS = 1_000_000
_PICKS = 3
_FOLD = 8


def shingle_hashes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct n-word shingles, sorted; fewer words: the whole sequence; none: none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    rows = [digest(join(s), seed) for s in zip(*(words[j:] for j in range(n)), strict=False)] if len(words) >= n else [digest(join(words), seed)]
    return np.unique(np.array(rows, dtype=np.uint64))


def sampled_simhashes(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The majority bits of the least three hashes of each sample's permutations; empty for no shingle."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    picks = np.empty(samples * _PICKS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(len(picks)):
            mixed = (hashes ^ splitmix(np.array([j + 1], dtype=np.uint64))) * np.uint64(0x9FB21C651E98DF25)
            picks[j] = hashes[np.argmin(mixed ^ mixed >> np.uint64(29))]
        a, b, c = splitmix(picks).reshape(samples, _PICKS).T
    return (a & b | a & c | b & c).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """A bit per bucket of hashes: whether it holds an odd number of them. Sketches of two sets differ in no more bits than the sets in members."""
    bits = 1 << min(16, max(9, (2 * len(hashes)).bit_length()))
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def unlike_at_least(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the shorter one's buckets."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, of which any set of at least this similarity has one among its own first.

    common, rank: sorted hashes of common shingles and their places in the order, from 1; all others come before them.
    """
    place = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        place = np.where(common[at] == hashes, rank[at], 0)
    most = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, place))][:most]


def _common(rows: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are common in a sample of the rows, and their ranks by count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(words_of(t), shingle_words) for t in batch.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([*found, np.empty(0, dtype=np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_ROWS)) == 0).select("t")
    got = some.mapInArrow(sparing(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_COUNT).orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect()
    h, n = (np.array([r[c] for r in got], dtype=np.int64) for c in ("h", "n"))
    h = h.view(np.uint64)
    rank = np.empty(len(h), dtype=np.int64)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def jaccard(a: bytes | None, b: bytes | None, n: int) -> float:
    """Similarity of the shingle sets; two texts without words are equal."""
    x, y = shingle_hashes(words_of(a), n), shingle_hashes(words_of(b), n)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _words_hash(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _key(id_col: str) -> Column:
    """An id of any type as a text that no null shares."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("__row_key")


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def _few(df: DataFrame, most: int | None = None) -> DataFrame:
    """df marked for broadcast if it has no more than most (BROADCAST_KEYS) rows."""
    most = BROADCAST_KEYS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, threshold: int = 2) -> DataFrame:
    """docs without near-duplicates: of each group that links of at least this similarity connect, the row with the smallest id stays.

    Texts with the same words are one text. Null, empty and wordless texts are alike and form one group; of rows that
    share the smallest id and the words, one stays; null ids come after all others. Ids are of any type with an order;
    any number may be null or repeated. An empty table gives an empty result.
    """
    keys = ["__row_key", "__text_key"]
    marked = docs.withColumns({"__row_key": _key(id_col), "__text_key": _text_key(text_col)})
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), _text_key(text_col).alias("text_key"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(rows, shingle_words))
    kind = docs.schema[id_col].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                hashes = shingle_hashes(words, shingle_words)
                first = prefix(hashes, *shared.value, similarity)
                rows.append((_words_hash(words), simhash.simhash64(words, shingle_words), sampled_simhashes(hashes).tolist(), len(hashes), first.view(np.int64), len(hashes).to_bytes(4) + sketch(hashes)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            fp = pa.array(np.array(cols[1], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cols[0], pa.binary()), fp, pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary())], names=["id", "text_key", "words", "fp", "samples", "size", "prefix", "sketch"])

    marks = rows.mapInArrow(sparing(digest), StructType([StructField("id", kind), *StructType.fromDDL("text_key binary, words binary, fp long, samples array<long>, size int, prefix array<long>, sketch binary").fields]))
    # one node per distinct sequence of words, numbered as it is written down; row is its smallest id and a text of that
    row = F.struct(F.col("id").isNull().alias("last"), "id", "text_key")
    nodes = marks.groupBy("words").agg(F.min(row).alias("row"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("fp", "samples", "size", "prefix", "sketch")])
    nodes = materialize(nodes.withColumn("n", F.monotonically_increasing_id()), "dup-nodes")
    count = nodes.count()
    fps = nodes.groupBy("fp").agg(F.min("n").alias("n"))
    links = simhash.anchor_links(fps, "fp", threshold)
    tables = nodes.select("n", F.posexplode("samples").alias("s", "key")).unionByName(nodes.select("n", F.lit(-1).alias("s"), F.col("fp").alias("key")))
    stars = _stars(tables.select("n", F.xxhash64("s", "key").alias("key")))
    ends = links.join(fps.select(F.col("fp").alias("a"), F.col("n").alias("na")), "a").join(fps.select(F.col("fp").alias("b"), F.col("n").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    pairs = stars.unionByName(ends).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(words_of(t), shingle_words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["n", "data"])

    def edges(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b): the pairs whose shingle sets reach the similarity."""
        sketches = nodes.select("n", F.col("sketch").alias("data"))
        close = materialize(_compared(materialize(pairs, f"{name}-pairs"), sketches, _may_link, similarity), f"{name}-close")
        need = close.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        need = materialize(nodes.join(need, "n").select("n", _key("row.id"), F.col("row.text_key").alias("__text_key")), f"{name}-need")
        texts = marked.select(*keys, F.col(text_col).cast("binary").alias("t")).join(_few(need), keys)
        shingles = texts.select("n", "t").dropDuplicates(["n"]).mapInArrow(sparing(sets), "n long, data binary")
        return _compared(close, materialize(shingles, f"{name}-sets"), _linked, similarity)

    # (n, root) of the nodes that are not their own root
    moved = materialize(connected_components(edges(pairs, "dup-early")).where("node <> root").select(F.col("node").alias("n"), "root"), "dup-roots")
    known = nodes.select("n", "size", "prefix").join(_few(moved, min(BROADCAST_ROOTS, 5 * BROADCAST_KEYS)), "n", "left")
    met = materialize(_cells(known.select("n", F.coalesce("root", "n").alias("root"), "size", "prefix"), max(64, count // BUCKET_NODES), similarity), "dup-cells")
    apart = met.where("token is null").select("a", "b")
    crowded = met.where("token is not null")
    if crowded.head(1):
        apart = apart.unionByName(_apart(crowded.select("token", F.col("a").alias("n"), F.col("b").alias("root"), "size", "place"), nodes, similarity))
    rest = edges(apart.distinct(), "dup-rest")
    roots = connected_components(moved.select(F.col("n").alias("a"), F.col("root").alias("b")).unionByName(rest))
    placed = nodes.select("n", "row", "copies").join(roots.withColumnRenamed("node", "n"), "n", "left")
    chosen = placed.groupBy(F.coalesce("root", "n").alias("root")).agg(F.min(F.struct("row", "n", "copies")).alias("m"))
    stay = materialize(chosen.select(_key("m.row.id"), F.col("m.row.text_key").alias("__text_key"), "m.copies"), "dup-stay")
    # only rows of a node with several can be repeated
    alone = marked.join(_few(stay.where("copies = 1").drop("copies")), keys, "left_semi")
    first = marked.join(_few(stay.where("copies > 1").drop("copies")), keys, "left_semi").dropDuplicates(keys)
    return alone.unionByName(first).select(*docs.columns)


def _may_link(a: bytes, b: bytes, similarity: float) -> bool:
    """Of two sizes (4 bytes) and sketches: whether the sets can have the similarity."""
    size = int.from_bytes(a[:4]) + int.from_bytes(b[:4])
    return unlike_at_least(a[4:], b[4:]) <= size * (1 - similarity) / (1 + similarity) + 1e-9


def _linked(a: bytes, b: bytes, similarity: float) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * max(1, len(x) + len(y) - both) - 1e-12


def _compared(pairs: DataFrame, data: DataFrame, test: Callable, similarity: float) -> DataFrame:
    """The pairs (a, b) whose data (n, data) pass the test. A pair carries the data of a; that of b goes once to each of its tasks."""
    total = pairs.count()
    degree = lambda c: pairs.groupBy(c).agg(F.count("*").alias("c"))
    first = materialize(degree("b").withColumn("parts", F.ceil(F.col("c") / MEMBERS).cast("long")), "dup-first")
    dealt = join_hot(pairs, first, ["b"], "c", total).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    of_a = degree("a").join(data.withColumnRenamed("n", "a"), "a")
    members = join_hot(dealt, of_a, ["a"], "c", total).select("b", "part", "a", "data")
    heads = first.join(data.withColumnRenamed("n", "b"), "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("a"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head = None, b""
        for batch in batches:
            good = []
            for b, part, a, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if a < 0:
                    place, head = (b, part), raw
                elif place == (b, part) and test(head, raw, similarity):
                    good.append((a, b))
            cols = list(zip(*good, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    rows = heads.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", "a")
    return rows.mapInArrow(sparing(run), "a long, b long")


def _stars(tables: DataFrame) -> DataFrame:
    """(a, b): every n under a key with the first and the last n of that key; keys of one n have none. One shuffle."""
    under = Window.partitionBy("key")
    groups = tables.withColumns({"low": F.min("n").over(under), "high": F.max("n").over(under)})
    return groups.where("low <> high").select(F.col("n").alias("a"), F.explode(F.array("low", "high")).alias("b"))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


_CODEC = "zstd"


def pack(n: np.ndarray, root: np.ndarray, size: np.ndarray, own: np.ndarray, place: np.ndarray, token: np.ndarray) -> bytes:
    """Some nodes' shingles in a few bytes each. own: which node, ascending; 48 bits of a token are kept, places stop at 65,535.

    Both only add candidates: shingles of equal bits are taken for one, and a smaller place rules less out.
    """
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    some = own[first]
    count = np.diff(np.r_[first, len(own)]).astype(np.uint32)
    parts_ = [np.diff(n[some], prepend=np.int64(0)), root[some] - n[some], size[some].astype(np.uint32), count, np.minimum(place, 65535).astype(np.uint16)]
    raw = b"".join([len(some).to_bytes(4), len(own).to_bytes(4), *map(_planes, parts_), token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()])
    return len(raw).to_bytes(4) + pa.compress(raw, _CODEC, asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """n, root, size of the nodes; own, place, token (48 bits) of the shingles."""
    raw = pa.decompress(data[4:], int.from_bytes(data[:4]), _CODEC, asbytes=True)
    nodes, tokens, at, out = int.from_bytes(raw[:4]), int.from_bytes(raw[4:8]), 8, []
    for length, kind in ((nodes, np.int64), (nodes, np.int64), (nodes, np.uint32), (nodes, np.uint32), (tokens, np.uint16)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length).T).view(kind).ravel())
        at += length * width
    token = np.zeros((tokens, 8), dtype=np.uint8)
    token[:, :6] = np.frombuffer(raw, np.uint8, tokens * 6, at).reshape(tokens, 6)
    n = np.cumsum(out[0])
    return n, n + out[1], out[2].astype(np.int64), np.repeat(np.arange(nodes), out[3]), out[4].astype(np.int64), token.view("<u8").ravel().astype(np.int64)


def cell_pairs(root: np.ndarray, size: np.ndarray, own: np.ndarray, place: np.ndarray, token: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole cells: the pairs (left, right) of nodes of different roots that meet in a cell of at most so many members and can reach the similarity; the shingles in larger cells of several roots."""
    order = np.argsort(token, kind="stable")
    t, o = token[order], own[order]
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    count = np.diff(np.r_[start, len(t)])
    several = np.minimum.reduceat(root[o], start) != np.maximum.reduceat(root[o], start)
    large = order[np.repeat(several & (count > most), count)]
    here = np.flatnonzero(np.repeat(several & (count <= most), count))
    after = (np.repeat(start + count, count)[here] - here - 1).astype(np.int64)
    costs, at, found, keep = np.cumsum(after), 0, [], len(root)
    while at < len(here):
        to = max(at + 1, int(np.searchsorted(costs, (costs[at - 1] if at else 0) + 2_000_000, side="right")))
        some, m = here[at:to], after[at:to]
        left = np.repeat(some, m)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        x, y = o[left], o[right]
        # no shingle before the first common one is shared, which bounds what the sets can share
        both = np.minimum(size[x] - place[order[left]], size[y] - place[order[right]])
        near = (root[x] != root[y]) & ((both + 1e-9) * (1 + similarity) >= similarity * (size[x] + size[y]))
        found.append(np.unique(np.maximum(x[near], y[near]) * keep + np.minimum(x[near], y[near])))
        at = to
    code = np.unique(np.concatenate([*found, np.empty(0, dtype=np.int64)]))
    return code // max(1, keep), code % max(1, keep), large


def _cells(nodes: DataFrame, buckets: int, similarity: float) -> DataFrame:
    """(token, a, b, size, place): of (n, root, size, prefix) the pairs a, b of cells of few members, with a null token; else a member a of root b of a larger cell.

    Prefixes are shuffled once, packed by bucket of cells; only cells of several roots make rows.
    """
    buckets = min(buckets, 1 << 14)
    shape = "token long, a long, b long, size int, place int"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, root, size = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            count = pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            token = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.repeat(np.arange(len(n)), count)
            place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            to = (token >> np.uint64(48)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(bounds))
            data = []
            for i in full:
                mine = order[bounds[i] : bounds[i + 1]]
                data.append(pack(n, root, size, own[mine], place[mine], token[mine]))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])

    def out(token: np.ndarray | None, a: np.ndarray, b: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        cols = [pa.nulls(len(a), pa.int64()) if token is None else pa.array(token), pa.array(a), pa.array(b), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["token", "a", "b", "size", "place"])

    def meet(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [unpack(x) for x in held]
        before = np.cumsum([0, *(len(x[0]) for x in got)])
        n, root, size, own, place, token = (np.concatenate([x[i] + before[j] * (i == 3) for j, x in enumerate(got)]) for i in range(6))
        left, right, large = cell_pairs(root, size, own, place, token, similarity, CELL)
        yield out(None, np.maximum(n[left], n[right]), np.minimum(n[left], n[right]), np.zeros(len(left)), np.zeros(len(left)))
        yield out(token[large], n[own[large]], root[own[large]], size[own[large]], place[large])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and bucket != at:
                    yield from meet(held)
                    held = []
                at = bucket
                held.append(data)
        if held:
            yield from meet(held)

    dealt = nodes.mapInArrow(sparing(deal), "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(sparing(run), shape)


def _with_largest(tokens: DataFrame) -> DataFrame:
    """tokens with the root that most of a shingle's nodes have."""
    sizes = tokens.groupBy("token", "root").agg(F.count("*").alias("c"))
    groups = sizes.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.sum("c").alias("c"))
    return join_hot(tokens, groups, ["token"], "c", tokens.count())


def _folded(nodes: DataFrame) -> DataFrame:
    """(n, s0 .. s7): the sketches of nodes, folded to 512 bits."""
    names = ["n", *(f"s{i}" for i in range(_FOLD))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.int64, offset=4).reshape(-1, _FOLD), axis=0) for x in batch.column(1).to_pylist()]
            cols = np.array(bits, dtype=np.int64).reshape(-1, _FOLD).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=names)

    return nodes.select("n", "sketch").mapInArrow(sparing(run), ", ".join(f"{c} long" for c in names))


def _apart(tokens: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of nodes of different roots that can reach the similarity by their shared prefix shingles, sizes and folded sketches."""
    bits = [f"s{i}" for i in range(_FOLD)]
    members = materialize(_with_largest(tokens).join(_folded(nodes), "n"), "dup-members")
    side = lambda x: members.select("token", F.col("n").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("root", "size", "place", "largest", *bits)])
    met = side("a").where("root_a <> largest_a").join(side("b"), "token").where("root_a <> root_b and (root_b = largest_b or a < b)")
    both = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    size = F.col("size_a") + F.col("size_b")
    met = met.where((both + 1e-9) * (1 + similarity) >= similarity * size)
    unlike = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits])
    met = met.where(unlike <= size * ((1 - similarity) / (1 + similarity)) + 1e-9)
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
