"""SentencePiece segmentations sampled without replacement: Gumbel top-k by best-first search over the lattice.

Every node of the lattice has the log-sum-exp of all its completions, which is the exact heuristic of the search: the
largest perturbed log-probability below a partial segmentation is known before it is completed (Kool et al. 2019). The
search takes the partial segmentation with the largest value, follows it to its end, and leaves its siblings, whose
values are sampled under the condition that none exceeds the taken one, in the queue. The first k ends are k distinct
segmentations, and the value of the next one in the queue turns each one's probability into its inclusion score, whose
logarithm is given: a long text's segmentations all have probabilities that no double can hold.

No piece reaches over the start of a white-space run, so a text's lattice is the chain of its chunks' lattices: the
chunks of a batch are compiled and walked together in numpy. Random numbers come from counters under the row's key,
so a result depends on the key, the seed and the text alone, not on how rows are dealt to tasks.

The published BPE file has merge ranks for scores; a piece's weight is then -log(rank + 2.7), a Zipf law over ranks.
Weights of unigram files are taken as they are. Characters without a piece of their own become their UTF-8 byte pieces,
as does a literal U+2581, so decoding gives every text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.llm.common import sparing, splitmix

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 while white space is marked by it; no valid text holds a surrogate.
LITERAL = "\ud800"
#: Characters of text and rows that are walked at once.
BATCH_CHARS, BATCH_ROWS = 350_000, 512
#: A chunk whose segmentations may have a smaller log-probability, or with more characters, is summed up in logarithms.
DEEP_LOG, DEEP_CHARS = -600.0, 400
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a SentencePiece file as a hashed prefix tree: a prefix's hash leads to its piece, or to none."""

    def __init__(self, path: str, byte_weight: float = -14.0):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        score = [sp.get_score(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        usable = [i for i in range(n) if not special[i]]
        if any(SPACE in self.pieces[i].lstrip(SPACE) or "\n" in self.pieces[i] for i in usable):
            raise ValueError("a piece reaches over the start of white space or a line's end")
        ranked = all(float(score[i]).is_integer() for i in usable)
        self.weight = np.array([-np.log(min(-score[i], n) + 2.7) if ranked else score[i] for i in range(n)])
        self.byte_weight = byte_weight
        self.special = set(np.flatnonzero(special).tolist())
        spelled = [b"" if special[i] else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.spelled_len = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        found: dict[int, int] = {}
        for i in usable:
            h = 0
            for j, c in enumerate(self.pieces[i]):
                h = (h * 1_000_003 + ord(c) + 1) & (2**64 - 1)
                found.setdefault(h, -1)
                if j == len(self.pieces[i]) - 1:
                    found[h] = i
        self.longest = max(len(self.pieces[i]) for i in usable)
        size = 1 << (max(16, len(found) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.ids = np.zeros(size, dtype=np.uint64), np.full(size, -2, dtype=np.int32)
        for h, i in found.items():
            at = (h * int(_MULT) & 2**64 - 1) >> int(self.shift)
            while self.ids[at] != -2:
                at = (at + 1) & self.mask
            self.keys[at], self.ids[at] = h, i

    def look(self, h: np.ndarray) -> np.ndarray:
        """Piece number per prefix hash, -1 for a prefix of others only, -2 for none."""
        with np.errstate(over="ignore"):
            at = (h * _MULT >> self.shift).astype(np.int64)
        out = self.ids[at]
        todo = np.flatnonzero(out != -2)
        todo = todo[self.keys[at[todo]] != h[todo]]
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.ids[at[todo]]
            todo = todo[(self.keys[at[todo]] != h[todo]) & (out[todo] != -2)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Where texts are cut; no valid text holds it.
_CUT = "\udffe"


def chunks(text: str) -> list[str]:
    """Maximal pieces of a text that no vocabulary piece reaches over; joined, they are the normalized text."""
    if not text:
        return []
    marked = (SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)).replace("\n", _CUT + "\n" + _CUT).replace(SPACE, _CUT + SPACE)
    run = SPACE + _CUT + SPACE
    while run in marked:  # a run of white space begins one chunk
        marked = marked.replace(run, SPACE + SPACE)
    return [c for c in marked.split(_CUT) if c]


class Lattice:
    """Lattices of distinct chunks, compiled together. Node = a character's place; edges are sorted by node.

    first, count: a node's edges; to: where an edge ends; share: its log-probability given its node; wait: the inverse of
    that probability; token0, tokens: its place and number in pool, the piece numbers.
    """

    def __init__(self, v: Vocabulary, words: list[str]):
        # a mark that no piece holds follows each chunk, so that prefixes end with it
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer(("\udfff".join(words) + "\udfff" * bool(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(code)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        end = np.repeat(self.start + lengths, lengths + 1)
        is_end = np.zeros(n, dtype=bool)
        is_end[self.start + lengths] = True
        here, src, size, piece = np.flatnonzero(~is_end), [], [], []
        h, at = np.zeros(len(here), dtype=np.uint64), here
        for length in range(1, v.longest + 1):
            if not len(here):
                break
            with np.errstate(over="ignore"):
                h = h * np.uint64(1_000_003) + code[at]
            got = v.look(h)
            hit = np.flatnonzero(got >= 0)
            src.append(here[hit])
            size.append(np.full(len(hit), length))
            piece.append(got[hit].astype(np.int64))
            go = np.flatnonzero(got > -2)
            here, h, at = here[go], h[go], at[go] + 1
        src, size, piece = (np.concatenate([*x, np.empty(0, dtype=np.int64)]).astype(np.int64) for x in (src, size, piece))
        single = np.zeros(n, dtype=bool)
        single[src[size == 1]] = True
        odd = np.flatnonzero(~single & ~is_end)
        raw = [(SPACE if (c := int(code[i]) - 1) == 0xD800 else chr(c)).encode("utf-8", "replace") for i in odd]
        spelled = np.array([len(b) for b in raw], dtype=np.int64)
        self.pool = np.r_[np.arange(len(v.pieces)), v.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]]
        order = np.argsort(np.r_[src, odd], kind="stable")
        node = np.r_[src, odd][order]
        self.to = node + np.r_[size, np.ones(len(odd), dtype=np.int64)][order]
        self.token0 = np.r_[piece, len(v.pieces) + np.cumsum(spelled) - spelled][order]
        self.tokens = np.r_[np.ones(len(piece), dtype=np.int64), spelled][order]
        weight = np.r_[v.weight[piece], v.byte_weight * spelled][order]
        self.count = np.bincount(node, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        self.last = end  # per node: where its chunk ends
        # sums over all completions: as they are, but for chunks where doubles may not hold them
        every = np.exp(weight)
        least = lengths * v.weight.min()
        np.add.at(least, np.searchsorted(self.start, odd, side="right") - 1, v.byte_weight * spelled)
        deep = (least < DEEP_LOG) | (lengths > DEEP_CHARS)
        total, beta = np.ones(n + 1), np.zeros(n + 1)
        left = end - np.arange(n)
        for by, in_logs in ((np.flatnonzero(~np.repeat(deep, lengths + 1)), False), (np.flatnonzero(np.repeat(deep, lengths + 1)), True)):
            if not len(by):
                continue
            by = by[np.argsort(left[by] if in_logs else left[by].astype(np.int16), kind="stable")]
            bounds = np.searchsorted(left[by], np.arange(1, int(left[by[-1]]) + 2))
            nodes = by[bounds[0] :]
            if not len(nodes):
                continue
            edges, begins = _ranges(self.first[nodes], self.count[nodes])
            begins = np.r_[begins, len(edges)]
            to, step, count = self.to[edges], (weight if in_logs else every)[edges], self.count[nodes]
            bounds -= bounds[0]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if i == j:
                    continue
                a, b = begins[i], begins[j]
                at = begins[i:j] - a
                if in_logs:
                    x = step[a:b] + beta[to[a:b]]
                    top = np.maximum.reduceat(x, at)
                    beta[nodes[i:j]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count[i:j])), at))
                else:
                    total[nodes[i:j]] = np.add.reduceat(step[a:b] * total[to[a:b]], at)
            if not in_logs:
                beta[nodes] = np.log(total[nodes])
        self.share = weight + beta[self.to] - beta[node]
        self.wait = np.exp(np.minimum(-self.share, 690.0))


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first+1, ... of all ranges in a row, and where each range starts."""
    at = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(at - first, count), at


def _race(counter: np.ndarray) -> np.ndarray:
    """Exponential variables of rate 1, one per counter: a Gumbel variable is minus the logarithm of one."""
    u = (splitmix(counter) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 1.0 / float(1 << 53)
    return np.negative(np.log(u, out=u), out=u)


def _least(time: np.ndarray, doc: np.ndarray, n: int, keep: int) -> np.ndarray:
    """The places of the keep smallest times of each doc (ties: the first), in no order."""
    left, out = np.arange(len(time)), []
    for _ in range(keep):
        best = np.full(n, np.inf)
        np.minimum.at(best, doc[left], time[left])
        hit = left[(time[left] == best[doc[left]]) & (time[left] < np.inf)]
        _, one = np.unique(doc[hit], return_index=True)
        out.append(hit[one])
        mask = np.ones(len(time), dtype=bool)
        mask[out[-1]] = False
        left = left[mask[left]]
    return np.concatenate(out) if out else left[:0]


def _first(time: np.ndarray, begin: np.ndarray, keep: int) -> np.ndarray:
    """_least of times that are in the order of their docs, of which each begins at its place."""
    count = np.diff(np.r_[begin, len(time)])
    docs = np.flatnonzero(count)
    out: list[np.ndarray] = []
    for _ in range(keep if len(docs) else 0):
        best = np.minimum.reduceat(time, begin[docs])
        hit = np.flatnonzero((time == np.repeat(best, count[docs])) & (time < np.inf))
        doc = np.searchsorted(begin[docs], hit, side="right")
        out.append(hit[np.r_[True, doc[1:] != doc[:-1]][: len(hit)]])
        time = time.copy()
        time[out[-1]] = np.inf
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _times(lat: Lattice, node: np.ndarray, step: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all edges of some nodes: the edge, which node it leaves, its time since the node; and where each node's edges start."""
    first, count = lat.first[node], lat.count[node]
    e, at = _ranges(first, count)
    own = np.repeat(np.arange(len(node)), count)
    mult = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        base = seed + step.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) - first.astype(np.uint64) * mult
        time = _race(base[own] + e.view(np.uint64) * mult)
    time *= lat.wait[e]
    return e, own, time, at


def _delay(time: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log(time - first), infinite where time is."""
    with np.errstate(divide="ignore"):
        return np.log(time - first)


def _walk(lat: Lattice, occ: np.ndarray, node: np.ndarray, step: np.ndarray, seed: np.ndarray) -> list[np.ndarray]:
    """Follow the taken segmentation of some chunks to their ends.

    The largest perturbed value is the first arrival of an exponential race, with times exp(-value). An edge's time since
    its node has the rate of its share; which edge is first does not depend on the path to the node, so chunks are walked
    independently. occ: chunk occurrence; node, step: where each one stands; seed: its counter base. Returns the tokens'
    occurrence, step, edge and node, and the logarithm of the delay of the edge's first sibling, infinite without one.
    """
    took: list[tuple[np.ndarray, ...]] = []
    while len(occ):
        e, own, time, at = _times(lat, node, step, seed)
        first = np.minimum.reduceat(time, at)
        pick = np.flatnonzero(time == first[own])
        if len(pick) > len(occ):
            pick = pick[np.unique(own[pick], return_index=True)[1]]
        time[pick] = np.inf
        took.append((occ, step, e[pick], node, _delay(np.minimum.reduceat(time, at), first)))
        node = lat.to[e[pick]]
        go = node < lat.last[node - 1]
        occ, node, step, seed = occ[go], node[go], step[go] + 1, seed[go]
    empty = np.empty(0, dtype=np.int64)
    return [np.concatenate(x) for x in zip(*took, strict=True)] if took else [empty] * 4 + [np.empty(0)]


def _siblings(lat: Lattice, path: dict[str, np.ndarray], time: np.ndarray, seeds: Callable[[np.ndarray], np.ndarray], keep: int, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of the siblings that a walk left behind, the keep first per text: log arrival, occurrence, step, edge.

    A sibling's arrival has the rate of its cumulative probability, that of the whole text before it times its share. Given
    that it is not before the taken path's arrival it comes later by its delay divided by the probability before it.
    """
    o, s = path["o"], path["s"]
    share, before = lat.share[path["e"]], np.zeros(len(o))
    ends = np.r_[path["begin"], len(o)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):  # by text, so that rounding does not depend on the batch
        if b > a + 1:
            np.cumsum(share[a : b - 1], out=before[a + 1 : b])
    # the steps with the keep least first siblings have the keep least of all
    some = _first(path["gap"] - before, path["begin"], keep)
    if not len(some):
        return np.empty(0), *[np.empty(0, dtype=np.int64)] * 3
    e, own, t, at = _times(lat, path["node"][some], s[some], seeds(o[some]))
    late = _delay(t, np.minimum.reduceat(t, at)[own])
    late[e == path["e"][some][own]] = np.inf
    at, late = some[own], late - before[some][own]
    arrive = np.logaddexp(time[owner[o[at]]], late)
    arrive[late == np.inf] = np.inf
    few = _least(arrive, owner[o[at]], n, keep)
    return arrive[few], o[at][few], s[at][few], e[few]


def sample(v: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int = 2, seed: int = 17) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k tuples (piece numbers, log-probability, perturbed value, log of the inclusion score), largest value first.

    keys: an unsigned 64-bit key per text. A text with fewer segmentations gives all of them, with inclusion 1 (log 0);
    null and empty texts have one, without pieces.
    """
    cut = [chunks(t or "") for t in texts]
    sizes = np.array([len(x) for x in cut], dtype=np.int64)
    every = [c for x in cut for c in x]
    words = list(dict.fromkeys(every))
    known = dict(zip(words, range(len(words)), strict=True))
    lat, word = Lattice(v, words), np.fromiter(map(known.__getitem__, every), np.int64, len(every))
    n, owner = len(texts), np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(word)) - begin[owner]
    with np.errstate(over="ignore"):
        base = splitmix(keys.astype(np.uint64) ^ np.uint64(seed * 0x9E37 + 1))
        root = np.log(_race(base))

    def seeds(o: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return splitmix(base[owner[o]] + np.uint64(r + 1) * np.uint64(0xA0761D6478BD642F) + place[o].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    out: list[list[tuple]] = [[] for _ in range(n)]
    queue: list[tuple[np.ndarray, ...]] = []  # arrivals of siblings, with the number of the sample that left them behind
    every = np.arange(len(word))
    paths: list[dict[str, np.ndarray]] = []
    times = np.full((k, n), np.inf)  # logarithms of arrivals
    times[0] = root
    paths.append(_ordered(_walk(lat, every, lat.start[word], np.zeros(len(word), dtype=np.int64), seeds(every, 0)), owner, n))
    side = _siblings(lat, paths[0], root, lambda o: seeds(o, 0), k, owner, n)
    queue.append((*side, np.zeros(len(side[0]), dtype=np.int64)))
    next_time = np.full(n, np.inf)
    for r in range(1, k + 1):
        v_, o_, s_, e_, from_ = (np.concatenate(x) for x in zip(*queue, strict=True))
        best = _least(v_, owner[o_], n, 1)
        if r == k:
            next_time[owner[o_[best]]] = v_[best]
            break
        rest = np.ones(len(o_), dtype=bool)
        rest[best] = False
        queue = [tuple(x[rest] for x in (v_, o_, s_, e_, from_))]
        docs = owner[o_[best]]
        times[r, docs] = v_[best]
        # the tokens before the deviation, the deviating edge, and a fresh walk from there
        tok = [[], [], [], [], []]
        for p in range(r):
            mine = np.flatnonzero(from_[best] == p)
            if not len(mine):
                continue
            edge_of = np.full(n, -1, dtype=np.int64)
            edge_of[docs[mine]] = best[mine]
            po, ps, pe, pn = (paths[p][x] for x in ("o", "s", "e", "node"))
            b = edge_of[owner[po]]
            before = (b >= 0) & ((po < o_[b]) | (po == o_[b]) & (ps < s_[b]))
            for x, y in zip(tok, (po, ps, pe, pn, np.full(len(po), np.inf)), strict=True):
                x.append(y[before])
        # the siblings up to the deviation are in the queue already
        for x, y in zip(tok, (o_[best], s_[best], e_[best], np.zeros(len(best), dtype=np.int64), np.full(len(best), np.inf)), strict=True):
            x.append(y)
        inner = lat.to[e_[best]] < lat.last[lat.to[e_[best]] - 1]
        later, _ = _ranges(o_[best] + 1, begin[docs] + sizes[docs] - o_[best] - 1)
        go = np.r_[o_[best][inner], later]
        node = np.r_[lat.to[e_[best]][inner], lat.start[word[later]]]
        step = np.r_[s_[best][inner] + 1, np.zeros(len(later), dtype=np.int64)]
        for x, y in zip(tok, _walk(lat, go, node, step, seeds(go, r)), strict=True):
            x.append(y)
        paths.append(_ordered([np.concatenate(x) for x in tok], owner, n))
        side = _siblings(lat, paths[r], times[r], lambda o, r=r: seeds(o, r), k - r, owner, n)
        queue.append((*side, np.full(len(side[0]), r)))
    for r, path in enumerate(paths):
        share = lat.share[path["e"]]
        flat, at = _ranges(lat.token0[path["e"]], lat.tokens[path["e"]])
        ids = lat.pool[flat].astype(np.int32)
        cut = np.r_[at, len(flat)][np.r_[path["begin"], len(path["e"])]]
        for i in np.flatnonzero(times[r] < np.inf):
            a, b = path["begin"][i], path["begin"][i + 1] if i + 1 < n else len(share)
            logp = float(share[a:b].sum())
            out[i].append((ids[cut[i] : cut[i + 1]], logp, float(-times[r, i]), _log_arrived(logp + next_time[i])))
    yield from out


def _log_arrived(x: float) -> float:
    """log(1 - exp(-exp(x))): of the probability that an exponential variable is below exp(x)."""
    rate = np.exp(min(x, 700.0))
    return float(x - rate / 2 if x < -20 else np.log(-np.expm1(-rate)))


def _ordered(tokens: list[np.ndarray], owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Tokens in text order, and where each text's begin; those of an occurrence come with rising steps. Only tokens with a finite gap have a node that counts."""
    order = np.argsort(tokens[0], kind="stable")
    o, s, e, node, gap = (x[order] for x in tokens)
    return {"o": o, "s": s, "e": e, "node": node, "gap": gap, "begin": np.searchsorted(owner[o], np.arange(n)) if len(o) else np.zeros(n, dtype=np.int64)}


def decode(v: Vocabulary, ids: np.ndarray | list[int]) -> str:
    """The text of piece numbers: byte pieces joined, white space marks turned back, the added first one taken off."""
    ids = np.asarray(ids, dtype=np.int64)
    return v.spelled[_ranges(v.spelled_at[ids], v.spelled_len[ids])[0]].tobytes().decode("utf-8", "replace")[1:]


SAMPLES = "sample int, pieces array<int>, log_prob double, perturbed double, log_inclusion double"


def encode_samples(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 17, model: str = DEFAULT_MODEL, keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """A row per document and sample: the kept columns (key_col unless named), sample (from 1), pieces, log_prob, perturbed value and log_inclusion.

    The model file must be at the same path on every executor. Rows with equal keys and texts get equal samples; null
    keys are a key; null and empty texts have one sample without pieces; an empty table gives an empty result. digest:
    each sample's pieces are decoded, and decoded_sha256 is the hexadecimal SHA-256 of that text in UTF-8. One text's
    lattice is in memory at a time, some 200 bytes a distinct character place; longer texts than BATCH_CHARS go alone.
    """
    keep = keep or [key_col]
    rows = docs.select(*keep, F.xxhash64(F.lit(seed), key_col).alias("__key"), F.col(text_col).alias("__text"))
    names = [*keep, "sample", "pieces", "log_prob", "perturbed", "log_inclusion", *["decoded_sha256"] * digest]
    width = len(keep)

    def part(batch: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
        texts = batch.column(width + 1).to_pylist()
        keys = batch.column(width).to_numpy(zero_copy_only=False).view(np.uint64)
        got = list(sample(v, texts, keys, k, seed))
        row = np.repeat(np.arange(len(got)), [len(x) for x in got])
        flat = [s for x in got for s in x]
        sizes = np.array([0, *[len(s[0]) for s in flat]], dtype=np.int32)
        pieces = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate([*[s[0] for s in flat], np.empty(0, dtype=np.int32)]).astype(np.int32)))
        cols = [batch.column(i).take(pa.array(row)) for i in range(width)]
        numbers = pa.array(np.concatenate([*[np.arange(1, len(x) + 1) for x in got], np.empty(0, dtype=np.int64)]).astype(np.int32))
        cols += [numbers, pieces, *(pa.array([s[j] for s in flat], pa.float64()) for j in (1, 2, 3))]
        if digest:
            cols.append(pa.array([hashlib.sha256(decode(v, s[0]).encode()).hexdigest() for s in flat], pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(width + 1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                base = int(sizes[at - 1]) if at else 0
                to = min(max(at + 1, int(np.searchsorted(sizes, base + BATCH_CHARS, side="right"))), at + BATCH_ROWS)
                yield part(batch.slice(at, to - at), v)
                at = to

    return rows.mapInArrow(sparing(run), StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(SAMPLES + ", decoded_sha256 string" * digest).fields]))


def decode_column(df: DataFrame, pieces_col: str = "pieces", out_col: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with the text of each row's pieces; null pieces stay null."""
    base = df.drop(out_col)
    at, names = base.columns.index(pieces_col), [*base.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else decode(v, x) for x in batch.column(at).to_pylist()], pa.string())], names=names)

    return base.mapInArrow(run, StructType([*base.schema.fields, *StructType.fromDDL(f"`{out_col}` string").fields]))
