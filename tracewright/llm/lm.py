"""Language-model scores from a probabilistic suffix tree over words (Ron, Singer and Tishby 1996).

The symbols are words and one end per text. The tree's root is the add-one unigram distribution over all tokens. A
context of up to depth words is a candidate state if its suffix is a state and it occurs min_count times or more. It
becomes a state only if its next-symbol counts diverge from its suffix's distribution by min_nats nats of log-likelihood
in total. Next symbols are discounted by a constant; the mass that this leaves goes to the suffix's distribution, so every
distribution sums to 1. A text is scored by the longest suffix state at each word.

The tree is kept in two parts, and what it holds grows with the corpus. Its trunk, the contexts of GROUP occurrences or
more, travels in a broadcast, with those of its next symbols that have a joint probability of ENTRY_SHARE or more. Places
where any other known word follows a trunk state first go to the task of that state and word, which counts them; how many
such words a state has and how far they diverge is counted in packed buckets as the trunk grows. So where trunk and branches part
changes the plan, not the tree. All other contexts are branches: each place in a text goes to the task of its shortest suffix that is no trunk
context. That task sees every place with this suffix, so it counts all longer contexts, tests them and scores the places,
with one shuffle for all lengths. GROUP bounds what one suffix brings there. A trunk has at most 2**BITS contexts of each
length, so from GROUP * 2**BITS training tokens on the bound is their 2**-BITS-th part.

Counts cover all training texts, and the table of word counts grows with them. Words of probability word_share or more
(1/word_share at most) travel in a broadcast; every other word's count is found by a join on the word, so no count is cut
off or approximated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.common import discard, materialize, release_shuffles, sparing, splitmix

#: The end of a text as a token: white space can't be a word.
END = "\n"
#: Bits of a word or state number in packed keys; the shares are at least 2**-BITS, so all numbers fit.
BITS = 20
MASK = (1 << BITS) - 1
#: Distinct words or word groups that a task holds before it hands partial counts on.
HELD = 400_000
#: Longer words are counted and looked up by a digest, so keys are short.
LONG = 128
#: Bytes of texts, or a text's if it has more, whose words are told apart at once.
PIECE = 1 << 22
#: Training places that one branch may have; places that a task buffers before it hands them on, and that a bucket has.
GROUP, BUFFER, BUCKET = 1 << 19, 1 << 20, 1 << 19
#: Turns in which the buckets' places are sent, so that a part of them is on disk at a time.
PASSES = 2
#: Joint probability from which a trunk state's next symbol is in the broadcast.
ENTRY_SHARE = 2e-6
#: What is sent in buckets.
BLOBS = "bucket long, places long, blob binary"
#: Length of a branch where there is none.
NONE = 255
#: Mark of an end that has no number, as in a corpus of one text.
END_MARK = -(1 << 62)


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """Tokens of binary texts, a piece of whole texts at a time: the first text's place, each text's number of tokens, the joined tokens as places in a list of distinct ones, and that list.

    A long word stands there as a digest that no word can be equal to; the end of a text is its last token.
    """
    texts, kind = texts.fill_null(b""), pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    piece = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i == j:
            continue
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(i, j - i).view(kind)))  # bytes are not checked, nor need they be UTF-8
        told = cut.flatten().dictionary_encode()
        codes, words = told.indices.to_numpy().astype(np.int64), told.dictionary.view(texts.type).to_pylist()
        text = np.repeat(np.arange(j - i), pc.list_value_length(cut).to_numpy())
        if b"" in words:  # beside white space at a text's edges
            real = codes != words.index(b"")
            codes, text = codes[real], text[real]
        sizes = np.bincount(text, minlength=j - i)
        codes = np.insert(codes, np.cumsum(sizes), len(words))
        if max(map(len, words), default=0) > LONG:
            words = [w if len(w) <= LONG else END.encode() + hashlib.md5(w).hexdigest().encode() for w in words]
        yield i, sizes + 1, codes, [*words, END.encode()]


def _ids_of(codes: np.ndarray, words: list[bytes], numbers: dict[bytes, int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the tokens of rows of these sizes: their numbers (-i for the i-th of the row's words that have none), as planes of bytes, where each row begins, and those words of each row."""
    ids = np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words))[codes]
    at = np.flatnonzero(ids == 0)
    pairs, which = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * len(words) + codes[at], return_inverse=True)
    row, code = pairs // len(words), pairs % len(words)
    of_row = np.bincount(row, minlength=len(sizes))
    begin = np.cumsum(of_row) - of_row
    ids[at] = (begin[row] - np.arange(len(pairs)) - 1)[which]
    named, where = np.unique(code, return_inverse=True)
    names = pa.array([words[c].decode("utf-8", "replace") for c in named.tolist()], pa.string())
    odd = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(pairs)], pa.int32()), names.take(pa.array(where)))
    return np.ascontiguousarray(ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T), np.r_[0, np.cumsum(sizes)], odd


@dataclass
class Level:
    """States of one context length: sorted keys, the mass that goes to the suffix, and entry keys with their share; all trunk contexts, retained or not; the states' occurrences, and the mass that goes to the suffix where only entries count.

    A key is the word for one word, else the first word and the number of the suffix's state; an entry's is the state's
    number and the symbol.
    """

    states: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    rest: np.ndarray = field(default_factory=lambda: np.empty(0))
    entries: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    share: np.ndarray = field(default_factory=lambda: np.empty(0))
    tried: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    alone: np.ndarray = field(default_factory=lambda: np.empty(0))

    def state(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's state, or -1."""
        return _find(self.states, keys)

    def apart(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Whether there is a state that doesn't have the symbol (0: one without a number) as an entry."""
        out = state >= 0
        at = np.flatnonzero(out)
        out[at] = (symbol[at] == 0) | (_find(self.entries, state[at] << BITS | symbol[at]) < 0)
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of the symbols at the states, given those at their suffixes; symbol 0 is a word outside the tree."""
        at = np.flatnonzero(state >= 0)
        if not len(at):
            return below
        out = below.copy()
        e = _find(self.entries, state[at] << BITS | symbol[at])
        kept = np.where((e >= 0) & (symbol[at] > 0), self.share[e] if len(self.share) else 0.0, 0.0)
        out[at] = kept + self.rest[state[at]] * below[at]
        return out


def _find(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return np.where(ordered[at] == keys, at, -1)


@dataclass
class Model:
    """numbers: word to number (from 1; END is one of them); base: probability per number, 1 for number 0; min_count: None for the trunk alone; whole: next words outside the entries count."""

    tokens: int
    kinds: int
    numbers: dict[bytes, int]
    base: np.ndarray
    levels: list[Level]
    depth: int = 4
    min_count: int | None = 2
    min_nats: float = 10.0
    discount: float = 0.75
    whole: bool = False

    @property
    def total(self) -> int:
        return self.tokens + self.kinds + 1

    @property
    def end(self) -> int:
        return self.numbers.get(END.encode(), 0)

    def states(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Of each level, the number of the state before each token, or -1. ids: whole texts, joined; first: where one begins."""
        out: list[np.ndarray] = []
        for depth, level in enumerate(self.levels):
            out.append(level.state(_keys(_before(ids, first, depth + 1, self.end), out[-1] if out else None)))
        return out

    def starts_of_branches(self, ids: np.ndarray, first: np.ndarray, before: list[np.ndarray], states: list[np.ndarray]) -> np.ndarray:
        """Length of each token's shortest suffix that is no trunk context while its own suffix is a state; 0: none. before: marks of the words before each token, nearest first."""
        out, last = np.zeros(len(ids), dtype=np.uint8), np.ones(len(ids), dtype=bool)
        for k in range(self.depth):
            new = last & (before[k] != 0)
            if k < len(self.levels):
                keys = _keys(_before(ids, first, k + 1, self.end), states[k - 1] if k else None)
                new &= _find(self.levels[k].tried, keys) < 0
            out[new] = k + 1
            last = last & (states[k] >= 0) if k < len(self.levels) else np.zeros(len(ids), dtype=bool)
        return out


def _before(ids: np.ndarray, first: np.ndarray, k: int, end: int) -> np.ndarray:
    """The word k places before each token: the end before a text's first word, 0 beyond that."""
    at = np.arange(len(ids))
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.zeros(len(ids), dtype=np.int64)
    out[k:] = ids[:-k] if k < len(ids) else ids[:0]
    return np.where(place >= k, out, np.where(place == k - 1, end, 0))


def _keys(word: np.ndarray, suffix: np.ndarray | None) -> np.ndarray:
    """Keys of the contexts that begin with a word and go on with a suffix's state (None: nothing); -1 for none."""
    if suffix is None:
        return np.where(word > 0, word, -1)
    return np.where((word > 0) & (suffix >= 0), word << BITS | suffix, -1)


def _texts(docs: DataFrame, where: Column, text_col: str) -> DataFrame:
    return docs.where(F.coalesce(where, F.lit(True))).select(F.col(text_col).cast("binary").alias("t"))


def count_words(docs: DataFrame, where: Column, text_col: str = "text") -> DataFrame:
    """(token, n): how often each token occurs in the texts that meet the condition, pre-aggregated in each task."""

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for _, _, codes, words in tokens_of(batch.column(0)):
                for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                    if n:
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield out(held)
                    held = {}
        yield out(held)

    return _texts(docs, where, text_col).mapInArrow(sparing(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _given(docs: DataFrame, id_cols: list[str]) -> tuple[list[str], list[str]]:
    """Names and declared types of the id columns in tables of numbered texts."""
    names = [f"__id{i}" for i in range(len(id_cols))]
    return names, [f"{x} {dict(docs.dtypes)[c]}" for c, x in zip(id_cols, names, strict=True)]


def _numbered(docs: DataFrame, train: Column, id_cols: list[str], text_col: str, numbers: dict[bytes, int]) -> DataFrame:
    """(row, train, ids, size, ids, odd), written down: the texts' word numbers as _numbers_of gives them, which the levels of the trunk and the scores read instead of texts."""
    shared, (names, types) = docs.sparkSession.sparkContext.broadcast(numbers), _given(docs, id_cols)
    given = docs.select(F.monotonically_increasing_id().alias("row"), train.alias("train"), *[F.col(c).alias(x) for c, x in zip(id_cols, names, strict=True)], F.col(text_col).cast("binary").alias("__t"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _numbers_of(batches, shared.value)

    return materialize(given.mapInArrow(sparing(number), ", ".join(["row long, train boolean", *types, "size long, ids binary, odd array<string>"])), "lm-local")


def _count_groups(full: DataFrame, model: Model, contexts: np.ndarray, longer: float | None, entry: float, above: DataFrame | None) -> DataFrame:
    """(key, n, times, gain, bucket, places, blob), written down: of the contexts (sorted keys of the next level), next symbols that are entries (context number << BITS | symbol) and words of longer or more occurrences before them (the complement of context number << BITS | word; None: none).

    In a whole model also sums over all other next symbols, a row with a gain for each context and bucket: key is the
    context's number, n the symbols, times their occurrences, gain the sum of n log(n / probability at the suffix). Blobs
    hold (context, symbol, n, probability at the suffix) of these; symbols without a number go by their marks. Counts
    travel packed, in buckets by suffix and symbol, to which the suffixes' own probabilities (above) come as well.
    """
    shared, buckets = full.sparkSession.sparkContext.broadcast((model, contexts)), -(-model.tokens // (4 * BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, contexts = shared.value
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                held.append(_pairs(*batch.slice(i, 256).columns, model, contexts, longer is not None))
                size += sum(map(len, held[-1][:2]))
                if size > 4 * HELD:
                    yield _blobs(*_summed(held, model, contexts), buckets, _planes)
                    held, size = [], 0
        if size:
            yield _blobs(*_summed(held, model, contexts), buckets, _planes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, contexts = shared.value
        for bucket, columns in _bucketwise(batches, _columns):
            keys, n, sums, rest = _merged(columns, model, contexts, longer, entry)
            blank = len(keys) + len(sums[0])
            blob = [zstandard.ZstdCompressor(level=1).compress(_planes(rest))] if longer is not None and len(rest[0]) else []
            cols = [[*keys.tolist(), *sums[0].tolist()], [*n.tolist(), *sums[1].tolist()], [None] * len(keys) + sums[2].tolist(), [None] * len(keys) + sums[3].tolist()]
            cols = [*(x + [None] * len(blob) for x in cols), *([None] * blank + x for x in ([bucket] * len(blob), [len(rest[0])] * len(blob), blob))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names=["key", "n", "times", "gain", "bucket", "places", "blob"])

    sent = full.where("train").select("ids", "marks", "counts").mapInArrow(sparing(send), BLOBS)
    sent = sent if above is None else sent.unionByName(above)
    return materialize(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sparing(merge), f"key long, n long, times long, gain double, {BLOBS}"), "lm-groups")


def _pairs(squeezed: pa.Array, marks: pa.Array, counts: pa.Array, model: Model, contexts: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """context number << BITS | symbol wherever a context is followed by a numbered symbol, and the complement of context number << BITS | word wherever a numbered word comes before it; of other followers the context's number, mark and training count."""
    ids, mark, odd, n, sizes = _looked(squeezed, marks, counts)
    first, depth = np.zeros(len(ids), dtype=bool), len(model.levels)
    first[np.cumsum(sizes) - sizes] = True
    suffix = model.states(ids, first)[-1] if depth else None
    c = _find(contexts, _keys(_before(ids, first, depth + 1, model.end), suffix))
    at = np.flatnonzero((c >= 0) & (ids > 0))
    pairs = c[at] << BITS | ids[at]
    if longer:
        far = _before(ids, first, depth + 2, model.end)
        on = np.flatnonzero((c >= 0) & (far > 0))
        pairs = np.r_[pairs, ~(c[on] << BITS | far[on])]
    met = c[odd] >= 0 if model.whole else np.zeros(len(odd), dtype=bool)
    return pairs, c[odd[met]], mark[odd[met]], n[met]


def _hash(head: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return _longer(_longer(np.zeros(len(head), dtype=np.uint64), head), symbol)


def _summed(held: list[tuple], model: Model, contexts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hash, columns) of what _pairs gave: context number (the complement of it for words before), symbol, occurrences, training count (0: numbered). The hash is that of the suffix's state (at the root, the context) and the symbol."""
    keys, c, mark, count = (np.concatenate(x) for x in zip(*held, strict=True))
    keys, n = np.unique(keys, return_counts=True)
    before, pair = keys < 0, np.where(keys < 0, ~keys, keys)
    marks, which = np.unique(mark, return_inverse=True)
    odd, at, times = np.unique(c << 40 | which, return_index=True, return_counts=True)
    c = np.r_[np.where(before, ~(pair >> BITS), pair >> BITS), odd >> 40]
    symbol = np.r_[pair & MASK, marks[odd & (1 << 40) - 1]]
    head = np.where(c >= 0, contexts[np.maximum(c, 0)] & MASK, c) if model.levels else c
    return _hash(head, symbol), [c, symbol, np.r_[n, times], np.r_[np.zeros(len(n), dtype=np.int64), count[at]]]


def _merged(columns: list[np.ndarray], model: Model, contexts: np.ndarray, longer: float | None, entry: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of one whole bucket: keys and occurrences of entries and longer contexts; sums (context, symbols, occurrences, gain) of all other next symbols, and these. Rows without occurrences are the probabilities of a symbol at a suffix's state."""
    given = columns[2] == 0
    state, of, _, p = (x[given] for x in columns)
    c, symbol, n, count = (x[~given] for x in columns)
    order = np.lexsort((symbol, c))
    c, symbol, count = c[order], symbol[order], count[order]
    heads = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (symbol[1:] != symbol[:-1])][: len(c)])
    n = np.add.reduceat(n[order], heads) if len(heads) else n
    c, symbol, count = c[heads], symbol[heads], count[heads]
    far, near = (c < 0) & (n >= (longer or 0)), (c >= 0) & (symbol > 0) & (n >= entry)
    keys, times = np.r_[c[near] << BITS | symbol[near], ~(~c[far] << BITS | symbol[far])], np.r_[n[near], n[far]]
    rest = np.flatnonzero((c >= 0) & ~near) if model.whole else np.empty(0, dtype=np.int64)
    c, symbol, n, count = c[rest], symbol[rest], n[rest], count[rest]
    numbered = np.maximum(symbol, 0)
    below, u = _below(model, contexts, c, numbered)
    if model.levels:
        lost = np.flatnonzero(model.levels[-1].apart(u, numbered))
        found = _hash(state, of)
        order = np.argsort(found)
        at = _find(found[order], _hash(u[lost], symbol[lost]))
        if (at < 0).any():
            raise ValueError("a next symbol of a context is none of its suffix")
        below[lost] = p.view(np.float64)[order[at]]
    else:
        below = np.where(symbol > 0, below, (count + 1) / model.total)
    named, which = np.unique(c, return_inverse=True)
    sums = [np.bincount(which, x, len(named)) for x in (np.ones(len(c)), n, n * np.log(n / below))]
    return keys, times, [named, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2].astype(np.float64)], [c, symbol, n, below]


def _below(model: Model, contexts: np.ndarray, s: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of symbols at the suffixes of contexts s (by number) of the next level, and those suffixes' states (-1: the root)."""
    chain, state = [], contexts[s] & MASK  # the suffixes' states, longest first
    for level in reversed(model.levels):
        chain.append(state)
        state = level.states[state] & MASK
    below = model.base[symbol]
    for level, state in zip(model.levels, reversed(chain), strict=True):
        below = level.step(state, symbol, below)
    return below, chain[0] if chain else np.full(len(s), -1, dtype=np.int64)


def _probabilities(groups: DataFrame, model: Model, number: np.ndarray) -> DataFrame:
    """Blobs of (state, symbol, 0, probability): what the last level's states give the symbols that are no entries, in the next level's buckets. number: each context's state, or -1."""
    shared, buckets = groups.sparkSession.sparkContext.broadcast((model.levels[-1], number)), -(-model.tokens // (4 * BUCKET))
    discount = model.discount

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, number = shared.value
        for _, (c, symbol, n, below) in _bucketwise(batches, _columns):
            kept = np.flatnonzero(number[c] >= 0)
            if not len(kept):
                continue
            u, symbol = number[c[kept]], symbol[kept]
            p = (n[kept] - discount) / level.sizes[u] + level.rest[u] * below.view(np.float64)[kept]
            yield _blobs(_hash(u, symbol), [u, symbol, np.zeros(len(u), dtype=np.int64), p], buckets, _planes)

    return groups.where(F.col("blob").isNotNull()).select("bucket", "places", "blob").mapInArrow(sparing(run), BLOBS)


def _level(model: Model, contexts: np.ndarray, sizes: np.ndarray, counted: list[tuple[int, int]], apart: list[tuple]) -> tuple[Level, np.ndarray]:
    """The retained states among the contexts of one length, and each context's state number (-1: not retained). apart: of each context's next symbols that are no entries, (context number, symbols, occurrences, sum of n log(n / below)); these count in a whole model only."""
    if not counted and not apart:
        return Level(tried=contexts), np.full(len(contexts), -1, dtype=np.int64)
    keys, n = np.array(sorted(counted), dtype=np.int64).reshape(-1, 2).T
    s, symbol = keys >> BITS, keys & MASK
    below, _ = _below(model, contexts, s, symbol)
    nats = np.bincount(s, n * np.log(np.maximum(n / sizes[s] / below, 1e-300)), len(contexts)).astype(np.float64)
    kinds = np.bincount(s, minlength=len(contexts))
    if apart:
        c, more, times, gain = (np.array(x) for x in zip(*apart, strict=True))
        nats[c] += gain - times * np.log(sizes[c])
        kinds[c] += more
    keep = nats >= model.min_nats
    number = np.where(keep, np.cumsum(keep) - 1, -1)
    kept = keep[s]
    share = (n[kept] - model.discount) / sizes[s[kept]]
    alone = 1.0 - np.bincount(number[s[kept]], share, int(keep.sum()))
    rest = model.discount * kinds[keep] / sizes[keep] if model.whole else alone
    return Level(contexts[keep], rest, number[s[kept]] << BITS | symbol[kept], share, contexts, sizes[keep], alone), number


def fit(docs: DataFrame, where: Column, text_col: str = "text", word_share: float = 1e-6, state_share: float | None = None, entry_share: float | None = None, min_nats: float = 10.0, discount: float = 0.75, depth: int = 4, min_count: int | None = 2) -> tuple[Model, DataFrame]:
    """The model, and the table of all words' counts and marks (token, n, id), which the join of rare words reads.

    state_share: the share of the training tokens that makes a context one of the trunk; None: GROUP occurrences.
    entry_share: the joint probability below which a trunk state's next symbol is left out, as words without a number are
    (a bounded trunk; the mass goes to its suffix); None: all next symbols count.
    Null texts count as empty. No text that meets the condition: every probability is 1 over 1. What comes to the driver
    is bounded, however long the corpus is: 1/word_share words, 1/ENTRY_SHARE entries and 2**BITS contexts a level. Branches,
    the contexts of min_count occurrences or more that are too rare for that, are counted as texts are scored.
    """
    model, vocabulary, full = _fit(docs, where, None, text_col, word_share, state_share, entry_share, min_nats, discount, depth, min_count)
    if full is not None:
        discard(full)
    return model, vocabulary


def fit_and_score(docs: DataFrame, where: Column, id_cols: list[str], text_col: str = "text", word_share: float = 1e-6, state_share: float | None = None, entry_share: float | None = None, min_nats: float = 10.0, discount: float = 0.75, depth: int = 4, min_count: int | None = 2) -> DataFrame:
    """What score gives with a model that fit learns from the same rows: the words of a text are told apart and numbered once for both."""
    model, vocabulary, full = _fit(docs, where, id_cols, text_col, word_share, state_share, entry_share, min_nats, discount, depth, min_count)
    said = _score(docs, model, vocabulary, id_cols, text_col, where, full)
    discard(vocabulary)  # looked up when scores return
    return said


def _fit(docs: DataFrame, where: Column, id_cols: list[str] | None, text_col: str, word_share: float, state_share: float | None, entry_share: float | None, min_nats: float, discount: float, depth: int, min_count: int | None) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model, the table of words and, if a trunk needed them, the numbered texts as _look_up gives them: with id columns those of all rows, else of the training rows."""
    if min(word_share, state_share or 1.0) < 2.0**-BITS:
        raise ValueError(f"word_share and state_share are at least 2**-{BITS}")
    vocabulary = materialize(count_words(docs, where, text_col).withColumn("id", F.monotonically_increasing_id()), "lm-words")
    release_shuffles(docs.sparkSession)
    r = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = int(r["n"]), int(r["v"])
    common = vocabulary.where((F.col("n") >= F.lit(max(word_share * tokens, 2.0)))).collect()
    common.sort(key=lambda x: (-x["n"], x["token"]))
    numbers = {x["token"].encode(): i + 1 for i, x in enumerate(common)}
    base = np.r_[1.0, (np.array([x["n"] for x in common]) + 1) / (tokens + kinds + 1)]
    model = Model(tokens, kinds, numbers, base, [], depth, min_count, min_nats, discount, entry_share is None)
    counts = np.r_[0, np.array([x["n"] for x in common], dtype=np.int64)].astype(np.int64)
    least = max(GROUP, 2.0**-BITS * tokens) if state_share is None else max(state_share * tokens, float(min_count or 2))
    entry = max((ENTRY_SHARE if entry_share is None else entry_share) * tokens, 1.0)
    contexts = np.flatnonzero(counts >= least).astype(np.int64)
    contexts, sizes = contexts[contexts > 0], counts[contexts[contexts > 0]]
    train, full = F.coalesce(where, F.lit(True)), None
    if len(contexts):
        numbered = _numbered(docs.where(train), F.lit(True), [], text_col, numbers) if id_cols is None else _numbered(docs, train, id_cols, text_col, numbers)
        full = _look_up(numbered, vocabulary)
    above, written = None, []
    while len(contexts) and len(model.levels) < depth:
        last = len(model.levels) + 1 == depth
        groups = _count_groups(full, model, contexts, None if last else least, entry, above)
        written.append(groups)
        rows = groups.where(F.col("gain").isNull() & F.col("blob").isNull()).select("key", "n").collect()
        counted, longer = [(r["key"], r["n"]) for r in rows if r["key"] >= 0], [(~r["key"], r["n"]) for r in rows if r["key"] < 0]
        sums = [tuple(x) for x in groups.where(F.col("gain").isNotNull()).groupBy("key").agg(F.sum("n"), F.sum("times"), F.sum("gain")).collect()]
        level, number = _level(model, contexts, sizes, counted, sums)
        model.levels.append(level)
        keys, sizes = (np.array([x[j] for x in longer], dtype=np.int64) for j in (0, 1))
        kept = number[keys >> BITS] >= 0
        keys, sizes = (keys[kept] & MASK) << BITS | number[keys[kept] >> BITS], sizes[kept]
        order = np.argsort(keys)
        contexts, sizes = keys[order], sizes[order]
        above = _probabilities(groups, model, number) if model.whole and len(contexts) and not last else None
    for df in written:
        discard(df)
    release_shuffles(docs.sparkSession)
    return model, vocabulary, full


def _numbers_of(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The last column (a text) replaced by its number of tokens, their word numbers (-i for the i-th of the text's words that have none; squeezed) and those words."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for first, sizes, codes, words in tokens_of(batch.column(batch.num_columns - 1)):
            planes, at, odd = _ids_of(codes, words, numbers, sizes)
            ids = [squeeze.compress(planes[:, i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            kept = [c.slice(first, len(sizes)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), odd], names=[*batch.schema.names[:-1], "size", "ids", "odd"])


@dataclass
class Walk:
    """Texts of a batch, joined: of each token its number (0: none), mark, whether it begins a text, whether training has it and has it often enough for a branch, its probability at the root and in the trunk, the trunk's states before it, and the length of the first that has it, but not as an entry (0: none)."""

    starts: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    marks: np.ndarray
    first: np.ndarray
    known: np.ndarray
    often: np.ndarray
    base: np.ndarray
    p: np.ndarray
    states: list[np.ndarray]
    apart: np.ndarray


def _raw(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Squeezed texts of numbers, joined, and the size of each."""
    stretch = zstandard.ZstdDecompressor()
    planes = (np.frombuffer(stretch.decompress(x), dtype=np.uint8).reshape(4, -1) for x in ids)
    texts = [np.ascontiguousarray(x.T).view(np.int32).ravel() for x in planes]
    return np.concatenate(texts).astype(np.int64), np.array([len(x) for x in texts], dtype=np.int64)


def _looked(ids: pa.Array, marks: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts that were looked up, joined: each token's number (0: none) and mark; the places of those without a number and their words' training counts; the size of each text."""
    raw, sizes = _raw(ids.to_pylist())
    listed = pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(raw < 0)
    place = np.repeat(np.cumsum(listed) - listed, sizes)[odd] - raw[odd] - 1
    n, other = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (counts, marks))
    every = np.maximum(raw, 0)
    mark = every.copy()
    mark[odd] = other[place]
    return every, mark, odd, n[place], sizes


def _walk(ids: pa.Array, marks: pa.Array, counts: pa.Array, m: Model) -> Walk:
    every, mark, odd, n, sizes = _looked(ids, marks, counts)
    starts = np.cumsum(sizes) - sizes
    known, base = np.ones(len(every), dtype=bool), m.base[every]
    known[odd], base[odd] = n > 0, (n + 1) / m.total
    often = np.ones(len(every), dtype=bool)
    often[odd] = n >= (m.min_count or 0)
    first = np.zeros(len(every), dtype=bool)
    first[starts] = True
    states, p, apart = m.states(every, first), base, np.zeros(len(every), dtype=np.uint8)
    for k, (level, state) in enumerate(zip(m.levels, states, strict=True)):
        p = level.step(state, every, p)
        if m.whole:
            apart[(apart == 0) & known & level.apart(state, every)] = k + 1
    return Walk(starts, sizes, every, mark, first, known, often, base, p, states, apart)


def _places(walk: Walk, rows: np.ndarray, train: np.ndarray, m: Model, apart: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hash, columns) of each place that may have a branch, or of each that is apart: length of the shortest branch, words before it, symbol, probability so far, whether it is training, row.

    The hash is that of the shortest branch; of a place apart, which has its probability at the root, that of the first
    state without the symbol as an entry, and of the symbol.
    """
    end = m.end or END_MARK
    words = np.where(walk.often, walk.marks, 0)  # a context with a word that is too rare is too rare
    before = [_before(words, walk.first, k + 1, end) for k in range(m.depth)]
    length = m.starts_of_branches(walk.ids, walk.first, before, walk.states) if m.min_count is not None else np.zeros(len(words), dtype=np.uint8)
    at = np.flatnonzero(walk.apart if apart else (length > 0) & (walk.apart == 0))
    length, before = length[at], [b[at] for b in before]
    for k in range(1, m.depth):  # no context goes beyond a word that is too rare
        before[k] = np.where(before[k - 1] == 0, 0, before[k])
    upto = walk.apart[at] if apart else length
    key = np.zeros(len(at), dtype=np.uint64)
    for k, word in enumerate(before):
        key = np.where(upto > k, _longer(key, word), key)
    if apart:
        key = _longer(key, walk.marks[at])
    text = np.repeat(np.arange(len(rows)), walk.sizes)[at]
    p = walk.base[at] if apart else np.where((length == 1) & (walk.ids[at] > 0), 0.0, walk.p[at])  # known from the symbol
    return key, [np.where(length > 0, length, NONE), *before, walk.marks[at], p.astype(np.float32), train[text].astype(np.uint8), rows[text]]


def _settle(columns: list[np.ndarray], m: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hash, columns) of places apart, all those of whole pairs of state and symbol, as they go on: probabilities from the trunk, and marked (2) as such that nothing was added for."""
    length, before, symbol, train, row = columns[0], columns[1 : m.depth + 1], columns[m.depth + 1], columns[-2], columns[-1]
    p, numbered, state = columns[-3].astype(np.float64), np.maximum(symbol, 0), None
    for word, level in zip(before, m.levels, strict=False):
        state = level.state(_keys(word, state))
        p = level.step(state, numbered, p)
        at = np.flatnonzero(level.apart(state, numbered))
        at = at[np.lexsort((symbol[at], state[at]))]
        c, s = state[at], symbol[at]
        of_pair = np.cumsum(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])][: len(at)]) - 1
        n = np.bincount(of_pair, train[at])[of_pair]
        p[at] += np.where(n > 0, (n - m.discount) / level.sizes[c], 0.0)
    key = np.zeros(len(row), dtype=np.uint64)
    for k, word in enumerate(before):
        key = np.where((length > k) & (length != NONE), _longer(key, word), key)
    key = np.where(length == NONE, splitmix(row.view(np.uint64)), key)
    return key, [length, *before, symbol, p.astype(np.float32), train | 2, row]


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context out of its suffix's and the word before that."""
    with np.errstate(over="ignore"):
        return splitmix(key * np.uint64(0x9FB21C651E98DF25) ^ word.view(np.uint64))


def _kinds(depth: int) -> list[type]:
    return [np.uint8, *[np.int64] * (depth + 1), np.float32, np.uint8, np.int64]


def _pack(columns: list[np.ndarray], kinds: list[type]) -> bytes:
    """Columns as planes of bytes, which compress well: the row as differences, probabilities with 16 bits of fraction."""
    p, row = columns[-3].view(np.uint32) & np.uint32(0xFFFFFF80), np.diff(columns[-1], prepend=0)
    out = [*columns[:-3], p, columns[-2], row]
    return b"".join(np.ascontiguousarray(c.astype(t if t is not np.float32 else np.uint32, copy=False).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, t in zip(out, kinds, strict=True))


def _unpack(raw: bytes, size: int, kinds: list[type]) -> list[np.ndarray]:
    at, out = 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * width, offset=at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * width
    out[-1] = np.cumsum(out[-1])
    return out


def _planes(columns: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes as planes of bytes."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _columns(raw: bytes, size: int) -> list[np.ndarray]:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8, size)
    return [np.ascontiguousarray(x.T).view(np.int64).ravel() for x in planes]


def _blobs(key: np.ndarray, columns: list[np.ndarray], buckets: int, pack: Callable, turn: int | None = None, turns: int = 1) -> pa.RecordBatch:
    """(bucket, places, blob) of rows with these hashes; of those buckets only whose turn it is."""
    squeeze = zstandard.ZstdCompressor(level=1)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.arange(len(bucket)) if turn is None else np.flatnonzero(bucket % turns == turn)
    few = bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
    order = order[np.argsort(few, kind="stable")]
    cols = [c[order] for c in columns]
    names, at = np.unique(bucket[order], return_index=True)
    blobs = [squeeze.compress(pack([c[i:j] for c in cols])) for i, j in zip(at, [*at[1:], len(order)][: len(at)], strict=True)]
    sizes = np.diff([*at, len(order)])
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes.astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "places", "blob"])


def _bucketwise(batches: Iterator[pa.RecordBatch], unpack: Callable) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket's number and all its rows, out of blobs in the order of buckets."""
    stretch, now, held = zstandard.ZstdDecompressor(), None, []
    for batch in batches:
        for bucket, size, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and bucket != now:
                yield now, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = bucket
            held.append(unpack(stretch.decompress(blob.as_buffer()), size))
    if held:
        yield now, [np.concatenate(c) for c in zip(*held, strict=True)]


def _grow(columns: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(rows, what their branches add to the decimal logarithm) of all places of whole groups: at each length the contexts are counted, tested and stepped through."""
    length, before, symbol, train, row = columns[0], columns[1 : m.depth + 1], columns[m.depth + 1], columns[-2] & 1, columns[-1]
    start = np.where((length == 1) & (symbol > 0), m.base[np.maximum(symbol, 0)], columns[-3])
    p, alive, key = start.copy(), np.ones(len(row), dtype=bool), np.zeros(len(row), dtype=np.uint64)
    for k in range(m.depth):
        alive &= before[k] != 0
        key = _longer(key, before[k])
        at = np.flatnonzero(alive & (length <= k + 1))
        if not len(at):
            continue
        both = _longer(key[at], symbol[at])  # one sort by a hash of context and symbol, then one of the contexts of its distinct values
        order = np.argsort(both)
        at, both = at[order], both[order]
        pair = np.r_[True, both[1:] != both[:-1]]
        of_pair, heads = np.cumsum(pair) - 1, np.flatnonzero(pair)
        context = np.unique(key[at[heads]], return_inverse=True)[1]
        n = np.bincount(of_pair, train[at], len(heads))
        size = np.bincount(context, n)
        seen = n > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(seen, n * np.log(n / size[context] / p[at][heads]), 0.0)
            share = np.where(seen, (n - m.discount) / size[context], 0.0)
            rest = m.discount * np.bincount(context, seen) / size
        keep = (size >= m.min_count) & (np.bincount(context, gain) >= m.min_nats)
        kept = keep[context][of_pair]
        on, pairs = at[kept], of_pair[kept]
        p[on] = share[pairs] + rest[context[pairs]] * p[on]
        alive[at[~kept]] = False
    start = np.where(columns[-2] > 1, 1.0, start)  # of settled places, nothing is in the trunk's sum
    changed = np.flatnonzero(p != start)
    rows, to = np.unique(row[changed], return_inverse=True)
    return rows, np.bincount(to, np.log10(p[changed] / start[changed]), len(rows)).astype(np.float64)  # of nothing it counts in integers


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all parts, each once, and the sum of each one's gains."""
    rows, gain = (np.concatenate(x) for x in zip(*held, strict=True))
    rows, to = np.unique(rows, return_inverse=True)
    return rows, np.bincount(to, gain, len(rows)).astype(np.float64)


def _branch_gains(full: DataFrame, model: Model, places: int) -> DataFrame:
    """(row, gain): what branches and places apart add to the score of each text. Each task holds one bucket of whole groups at a time.

    All buckets are sent, in PASSES turns: the shuffled places of one turn are deleted before the next, at the price of
    walking the texts once a turn.
    """
    shared, buckets, turns = full.sparkSession.sparkContext.broadcast(model), -(-places // BUCKET), PASSES

    def out(held: list, depth: int, turn: int | None = None) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*(c for _, c in held), strict=True)]
        return _blobs(np.concatenate([k for k, _ in held]), columns, buckets, lambda x: _pack(x, _kinds(depth)), turn, turns)

    def sender(apart: bool, turn: int | None = None) -> Callable:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, held, size = shared.value, [], 0
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    rows, train = (part.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    held.append(_places(_walk(*part.columns[2:], m), rows, train.astype(bool), m, apart))
                    size += len(held[-1][0])
                    if size > BUFFER:
                        yield out(held, m.depth, turn)
                        held, size = [], 0
            if size:
                yield out(held, m.depth, turn)

        return send

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size = shared.value, [], 0
        for _, columns in _bucketwise(batches, lambda raw, size: _unpack(raw, size, _kinds(m.depth))):
            held.append(_settle(columns, m))
            size += len(columns[0])
            if size > BUFFER:
                yield out(held, m.depth)
                held, size = [], 0
        if size:
            yield out(held, m.depth)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size = shared.value, [], 0
        for _, columns in _bucketwise(batches, lambda raw, size: _unpack(raw, size, _kinds(m.depth))):
            held.append(_grow(columns, m))
            size += len(held[-1][0])
            if size > BUFFER:
                rows, gain = _added(held)
                yield _blobs(splitmix(rows.view(np.uint64)), [rows, gain], buckets, _planes)
                held, size = [], 0
        if size:
            rows, gain = _added(held)
            yield _blobs(splitmix(rows.view(np.uint64)), [rows, gain], buckets, _planes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (rows, gain) in _bucketwise(batches, _columns):
            rows, gain = _added([(rows, gain.view(np.float64))])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(gain)], names=["row", "gain"])

    texts = full.select("row", "train", "ids", "marks", "counts")
    settled = None
    if model.whole and model.levels:
        settled = materialize(texts.mapInArrow(sparing(sender(True)), BLOBS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sparing(settle), BLOBS), "lm-settled")
        release_shuffles(full.sparkSession)
    gains = []
    for turn in range(turns):
        sent = texts.mapInArrow(sparing(sender(False, turn)), BLOBS)
        if settled is not None:
            sent = sent.unionByName(settled.where(F.col("bucket") % turns == turn))
        grown = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sparing(grow), BLOBS)
        gains.append(materialize(grown.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sparing(add), "row long, gain double"), "lm-gains"))
        del sent, grown
        release_shuffles(full.sparkSession)
    if settled is not None:
        discard(settled)
    return reduce(DataFrame.unionByName, gains).groupBy("row").agg(F.sum("gain").alias("gain"))


def _look_up(local: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Numbered texts with the marks and training counts of their words that have no number in place of the words, written down; local is deleted."""
    odd = local.select("row", "train", F.posexplode("odd").alias("pos", "token"))
    mark = F.when(F.col("id").isNull(), F.lit(-1)).when(F.col("token") == END, F.lit(END_MARK)).otherwise(F.lit(-2) - F.col("id"))
    look = lambda rows, side: rows.join(side, "token", "left").select(*rows.columns, F.coalesce("n", F.lit(0).cast("long")).alias("n"), mark.cast("long").alias("mark"))
    total = local.agg(F.coalesce(F.sum(F.size("odd")), F.lit(0))).first()[0]
    found, met = look(odd, vocabulary), None
    if total >= common.SMALL:
        counted = odd.where(~F.col("train")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= F.lit(max(2.0, common.HOT_SHARE * total)))
        met = materialize(look(counted.select("token"), vocabulary), "lm-met")
        hot = F.broadcast(met)
        found = look(odd.join(hot.select("token"), "token", "left_anti"), vocabulary).unionByName(odd.join(hot, "token"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "n", "mark")))
    counts = found.groupBy("row").agg(listed.alias("x")).select("row", F.col("x.mark").alias("marks"), F.col("x.n").alias("counts"))
    full = materialize(local.drop("odd").join(counts, "row", "left"), "lm-full")
    discard(local)
    if met is not None:
        discard(met)
    del odd, found, counts
    release_shuffles(local.sparkSession)
    return full


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_cols: list[str], text_col: str = "text", where: Column | None = None) -> DataFrame:
    """id_cols, n_tokens, n_known, train_tokens, base_score, score of every row of docs, over its whole text.

    where: the condition that fit had. Branches are counted in the rows of docs that meet it, so docs holds the training
    rows too (None: no row does, and the trunk's entries alone score). A null text counts as empty: its only token is the end.
    Repeated rows and null ids are kept apart by a row number that is written down before it is used. Words outside the
    broadcast are looked up by a join in which frequent ones are broadcast. Only words that no training text has, such as one
    that every held-out text has, can be frequent there. An empty table gives an empty result.
    """
    return _score(docs, model, vocabulary, id_cols, text_col, where, None)


def _score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_cols: list[str], text_col: str, where: Column | None, full: DataFrame | None) -> DataFrame:
    """full: the texts of docs with the id columns, numbered and looked up, if they are there already."""
    if where is None:
        model = replace(model, levels=[replace(x, rest=x.alone) for x in model.levels], whole=False)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    train = F.coalesce(where, F.lit(True)) if where is not None else F.lit(False)
    names, types = _given(docs, id_cols)
    if full is None:
        full = _look_up(_numbered(docs, train, id_cols, text_col, model.numbers), vocabulary)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                walk = _walk(*part.columns[-3:], shared.value)
                sums = [np.add.reduceat(x, walk.starts) for x in (walk.known.astype(np.int64), np.log10(walk.base), np.where(walk.apart, 0.0, np.log10(walk.p)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(walk.sizes), *map(pa.array, sums)], names=[*part.schema.names[:-3], "n_tokens", "n_known", "base", "tree"])

    sums = full.select("row", *names, "ids", "marks", "counts").mapInArrow(sparing(measure), ", ".join(["row long", *types, "n_tokens long, n_known long, base double, tree double"]))
    gain = F.lit(0.0)
    if where is not None and (model.min_count is not None or model.whole and model.levels):
        places = full.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if places:
            sums, gain = sums.join(_branch_gains(full, model, places), "row", "left"), F.coalesce("gain", F.lit(0.0))
    return sums.select(*[F.col(x).alias(c) for c, x in zip(id_cols, names, strict=True)], "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("tree") + gain).alias("score"))
