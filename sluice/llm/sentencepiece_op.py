"""SentencePiece encoding and decoding, and distinct sampled segmentations by Gumbel top-k over the lattice.

A chunk is a run of spaces and the word after it, or a part of that: where no piece of the model has a line break in
it, line breaks are chunks, and where none has punctuation after a letter or digit, so is punctuation at a word's end.
No piece spans chunks, so a text's lattice is the product of its chunks' lattices, and a chunk's encoding and lattice
are built once and remembered. A
segmentation's log-probability is the sum of its pieces' scores, normalised over the lattice; pieces score by
Zipf's law of their rank in the model.

Sampling without replacement is a perturbed A* search. A set of segmentations that share a prefix is a node;
the largest Gumbel-perturbed score in it has a known law, so it is drawn first (its bound) and then the
segmentation that attains it. Each popped segmentation splits the rest of its node at every step of its path
into the sets that part from it there, whose bounds are drawn under its own. The k+1st perturbed score is the
threshold for inclusion probabilities.
"""

from __future__ import annotations

import heapq
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.runtime import WhileUsed, documents, given_back
from sluice.llm.token_files import groups

#: Characters that are worked on at once. Worker processes outlive a stage, so what one holds counts beside later ones.
GROUP = 700_000

SPACE = "▁"
#: Probabilities are drawn in units of 1 / _GRAIN.
_GRAIN = 1 << 30
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MARK = "\x1f"
#: Texts whose words don't lie between single spaces, or that hold the marks.
_UNEVEN = f"  |^ | $|{SPACE}|{_MARK}"
#: Punctuation after a letter or digit, up to a cut.
_TAIL = r"([\p{L}0-9])([!-/:-@\[-`{-~]+)(\x1f|$)"


def hashed(codes: np.ndarray, start: np.ndarray, length: int, so_far: np.ndarray | None) -> np.ndarray:
    """Rolling hash of the `length` code points from each start on, given that of one code point less."""
    with np.errstate(over="ignore"):
        last = codes[start + length - 1]
        return last if so_far is None else so_far * _BASE + last


def slot(h: np.ndarray, length: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h + np.uint64(length * 0x9E3779B97F4A7C15 & 2**64 - 1) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SLOT_BITS)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20
#: In place of a piece's number: no piece, but the beginning of one.
_BEGINS = -2


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each span, `count` numbers of it, one span after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Model:
    """A SentencePiece file: the library's encoding, the pieces in hash tables, their scores for the lattice."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.byte = [0] * 256
        pieces: dict[int, list[tuple[str, int]]] = {}
        for i in range(n):
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                pieces.setdefault(len(p), []).append((p, i))
        self.longest = max(pieces)
        known = [p for items in pieces.values() for p, _ in items]
        for begin in {p[:k] for p in known for k in range(1, len(p))}.difference(known):
            pieces.setdefault(len(begin), []).append((begin, _BEGINS))
        #: whether texts can be cut at line breaks, and before punctuation after a letter or digit
        self.cut_lines = not any("\n" in p for p in known)
        self.cut_tails = not any((a.isalpha() or a in string.digits) and b in string.punctuation for p in known for a, b in zip(p, p[1:], strict=False))
        #: what each id stands for, as bytes
        self.surface = pa.array([bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else p.encode() for i, p in enumerate(map(self.sp.id_to_piece, range(n)))], pa.large_binary())
        total = np.log(np.sum(1.0 / (np.arange(n) + 2.7)))
        self.score = alpha * (-np.log(np.arange(n) + 2.7) - total)
        # two tables: a piece whose slot in the first is taken goes to the second, and what is left to a dictionary
        self.tables = [(np.full(1 << _SLOT_BITS, -1, np.int32), np.zeros(1 << _SLOT_BITS, np.uint64)) for _ in range(2)]
        self.rest: dict[tuple[int, int], int] = {}
        for length, items in pieces.items():
            codes = np.array([[ord(c) for c in p] for p, _ in items], np.uint64)
            h = None
            for k in range(1, length + 1):
                h = hashed(codes.ravel(), np.arange(len(items)) * length, k, h)
            places = [slot(h, length, salt).tolist() for salt in (0, 1)]
            for k, (_, i) in enumerate(items):
                for (ids, keys), at in zip(self.tables, (places[0][k], places[1][k]), strict=True):
                    if ids[at] == -1:
                        ids[at], keys[at] = i, h[k] ^ np.uint64(length)
                        break
                else:
                    self.rest[(length, int(h[k]))] = i

    def find(self, h: np.ndarray, length: int) -> np.ndarray:
        """Piece with this hash and length; else _BEGINS if it is what a longer one begins with, or -1."""
        key = h ^ np.uint64(length)
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        for salt, (ids, keys) in enumerate(self.tables):
            at = slot(h[left], length, salt)
            out[left] = np.where(keys[at] == key[left], ids[at], -1)
            left = left[out[left] == -1]
        for (n, value), i in self.rest.items():
            if n == length:
                out[h == np.uint64(value)] = i
        return out


class Lattices:
    """Chunk -> its state at position 0. Each state's outgoing edges lie side by side in flat arrays, longest piece
    first; `cum` is their cumulative probability in units of 1 / _GRAIN.

    Many chunks are built at once, position by position from their ends. Holds about `most_edges` edges; then it
    forgets what was wanted once, and of the rest what was wanted least, so memory stays bounded.
    """

    def __init__(self, model: Model, most_edges: int = 2_500_000):
        self.model, self.most = model, most_edges
        self.clear()

    def clear(self) -> None:
        self.entry: dict[str, int] = {}  # chunk -> its number; from there its first state and its encoding
        self.several: list[tuple[int, ...]] = []  # pieces of edges that are more than one piece
        self.bytes_of: dict[int, int] = {}
        self.kinds = {"cum": np.int32, "logp": np.float64, "to": np.int32, "piece": np.int32, "first": np.int32, "count": np.int32, "start": np.int32, "ids": np.int32, "end": np.int64, "uses": np.int32}
        self.n = dict.fromkeys(self.kinds, 0)
        self.held = {k: np.empty(1 << 12, t) for k, t in self.kinds.items()}

    def learn(self, wanted: list[str]) -> np.ndarray:
        """Numbers of these distinct chunks, valid until the next call."""
        if self.n["cum"] > self.most:
            self.forget()
        found = np.fromiter(map(self.entry.get, wanted, repeat(-1)), np.int64, len(wanted))
        self.held["uses"][found[found >= 0]] += 1
        new = np.flatnonzero(found < 0)
        if len(new):
            chunks = [wanted[k] for k in new.tolist()]
            at = len(self.entry)
            lists = self.encoded(chunks)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            built = self._built(chunks)
            built |= {"ids": np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), "end": self.n["ids"] + np.cumsum(size), "uses": np.ones(len(chunks), np.int32)}
            for k, v in built.items():
                have, need = self.n[k], self.n[k] + len(v)
                if need > len(self.held[k]):
                    self.held[k] = np.concatenate([self.held[k][:have], np.empty(need + need // 4 - have, self.kinds[k])])
                self.held[k][have:need] = v
                self.n[k] = need
            self.entry.update(zip(chunks, range(at, at + len(chunks)), strict=True))
            found[new] = np.arange(at, at + len(chunks))
        return found

    def forget(self) -> None:
        """Keeps the chunks that most calls wanted, two at least, with half of the edges at most. What they keep of their
        counts is half, so that new ones get their turn."""
        held = {k: v[: self.n[k]] for k, v in self.held.items()}
        start, count, uses, end = (held[k] for k in ("start", "count", "uses", "end"))
        size, n_ids = np.diff(start, append=len(count)), np.diff(end, prepend=0)
        order = np.argsort(-uses, kind="stable")
        keep = np.sort(order[(uses[order] > 1) & (np.cumsum(np.add.reduceat(count, start)[order]) <= self.most // 2)])
        names = list(self.entry)
        several, bytes_of = self.several, self.bytes_of
        self.clear()
        if not len(keep) or len(several) > 100_000:
            return
        self.several, self.bytes_of = several, bytes_of
        self.entry = {names[k]: i for i, k in enumerate(keep.tolist())}
        state = spans(start[keep], size[keep])
        edge = spans(held["first"][state], count[state])
        place = np.full(len(count) + 1, -1, np.int32)  # the last one is for edges that end a chunk, whose `to` is -1
        place[state] = np.arange(len(state))
        ends = lambda x: np.cumsum(x, dtype=np.int64)
        # each goes when what is kept of it is there
        new = {k: held.pop(k)[edge] for k in ("logp", "cum", "piece")} | {"to": place[held["to"][edge]], "count": count[state], "first": ends(count[state]) - count[state]}
        new |= {"start": ends(size[keep]) - size[keep], "ids": held["ids"][spans(end[keep] - n_ids[keep], n_ids[keep])], "end": ends(n_ids[keep]), "uses": uses[keep] // 2}
        self.held = {k: v.astype(self.kinds[k], copy=False) for k, v in new.items()}
        self.n = {k: len(v) for k, v in new.items()}

    def starts(self, entries: np.ndarray) -> np.ndarray:
        return self.held["start"][entries]

    def best(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' encodings one after the other, and where each ends."""
        end = self.held["end"]
        first = np.where(entries > 0, end[np.maximum(entries - 1, 0)], 0)
        size = end[entries] - first
        ends = np.cumsum(size)
        return self.held["ids"][np.repeat(first - ends + size, size) + np.arange(int(size.sum()))], ends

    def encoded(self, chunks: list[str]) -> list[list[int]]:
        """The library's encoding of chunks as they stand within a text. It puts a mark before every text but an empty
        one: a chunk goes in without its first mark, one that has none after a line break, and a mark alone is its own
        piece."""
        sp = self.model.sp
        before = sp.encode("\n")
        found = sp.encode([c[1:] if c[0] == SPACE else "\n" + c for c in chunks], num_threads=1)
        return [[sp.piece_to_id(SPACE)] if c == SPACE else ids if c[0] == SPACE else ids[len(before) :] for c, ids in zip(chunks, found, strict=True)]

    def _byte_edge(self, code: int) -> int:
        """Piece of a character that is none itself: its byte, or the number (negative) of an edge of several bytes."""
        if code < 128:
            return self.model.byte[code]
        if code not in self.bytes_of:
            self.several.append(tuple(self.model.byte[b] for b in chr(code).encode("utf-8", "surrogatepass")))
            self.bytes_of[code] = -len(self.several)
        return self.bytes_of[code]

    def _built(self, chunks: list[str]) -> dict[str, np.ndarray]:
        m = self.model
        size = np.array([len(c) for c in chunks], np.int64)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        which = np.repeat(np.arange(len(chunks)), size)
        end = np.cumsum(size)[which]
        place = np.arange(len(codes))
        left = end - place  # code points to the chunk's end
        src, length, piece = [], [], []
        at, h = place, None
        for k in range(1, min(m.longest, int(size.max())) + 1):
            h = hashed(codes, at, k, h)
            ids = m.find(h, k)
            on = np.flatnonzero((ids != -1) & (left[at] > k))
            if k == 1:
                for p in np.flatnonzero(ids < 0).tolist():
                    ids[p] = self._byte_edge(int(codes[p]))
                hit = np.arange(len(at))
            else:
                hit = np.flatnonzero(ids >= 0)
            src.append(at[hit])
            length.append(np.full(len(hit), k))
            piece.append(ids[hit])
            # no piece is longer than what begins none
            at, h = at[on], h[on]
        src, length, piece = np.concatenate(src), np.concatenate(length), np.concatenate(piece)
        # by distance to the end, place and length, the longest first; one number of each edge, all of them different
        order = np.argsort((left[src] * len(codes) + src) * (m.longest + 1) + (m.longest - length))
        src, length, piece = src[order], length[order], piece[order]
        score = np.where(piece >= 0, m.score[np.maximum(piece, 0)], 0.0)
        for e in np.flatnonzero(piece < 0).tolist():
            score[e] = sum(m.score[i] for i in self.several[-piece[e] - 1])
        # edges now lie by distance to the end, so all that an edge leads to is done before it
        opens = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        counts = np.diff(np.concatenate([opens, [len(src)]]))
        state, state_left = src[opens], left[src[opens]]
        beta = np.zeros(len(codes) + 1)
        last = left[src] == length
        x = np.empty(len(src))
        bounds = np.searchsorted(state_left, np.arange(1, int(state_left[-1]) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            e0, e1 = opens[a], opens[b - 1] + counts[b - 1]
            v = score[e0:e1] + np.where(last[e0:e1], 0.0, beta[src[e0:e1] + length[e0:e1]])
            starts, n = opens[a:b] - e0, counts[a:b]
            top = np.maximum.reduceat(v, starts)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n)), starts))
            beta[state[a:b]] = total
            x[e0:e1] = np.minimum(0.0, v - np.repeat(total, n))
        p, cum = np.exp(x), np.zeros(len(src))
        for rank in range(int(counts.max())):
            on = opens[counts > rank] + rank
            cum[on] = p[on] + (cum[on - 1] if rank else 0.0)
        grain = np.minimum(np.rint(cum * _GRAIN), _GRAIN).astype(np.int32)
        grain[opens + counts - 1] = _GRAIN
        base, edges = self.n["first"], self.n["cum"]
        first, count = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
        first[state], count[state] = edges + opens, counts
        return {"start": base + np.cumsum(size) - size, "cum": grain, "logp": x, "to": np.where(last, -1, base + src + length), "piece": piece, "first": first, "count": count}

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return tuple(self.held[k] for k in ("cum", "logp", "to", "first", "count"))

    def pieces(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges' pieces one after the other, and how many each has."""
        found = self.held["piece"][edges]
        size = np.ones(len(found), np.int64)
        at = np.flatnonzero(found < 0)
        if not len(at):
            return found, size
        more = [self.several[-e - 1] for e in found[at].tolist()]
        size[at] = [len(x) for x in more]
        out = np.empty(int(size.sum()), np.int32)
        many = np.repeat(found < 0, size)
        out[~many], out[many] = found[found >= 0], [i for x in more for i in x]
        return out, size


def scrambled(x: np.ndarray) -> np.ndarray:
    """64 random-looking bits for each number; a draw is named by what it is for, so any order of work gives it."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def named(seed: np.ndarray, what: int, index: np.ndarray) -> np.ndarray:
    """Bits of draw `index` of kind `what` for each of the seeds."""
    with np.errstate(over="ignore"):
        base = scrambled(seed + np.uint64(what * 0x9E3779B97F4A7C15 & 2**64 - 1))
        return scrambled(base + index.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def walk(states: np.ndarray, keys: np.ndarray, flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws a path from each state to its chunk's end, with the key's draws. (index of the state that it began
    with, state, edge) of all steps, path by path."""
    cum, _, to, first, _ = flat
    at, who, step = states, np.arange(len(states)), 0
    chunk, state, edge = [], [], []
    while len(at):
        with np.errstate(over="ignore"):
            u = (scrambled(keys + np.uint64(step * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> np.uint64(34)).astype(np.int32)
        e = first[at]
        on = np.flatnonzero(cum[e] <= u)
        while len(on):
            e[on] += 1
            on = on[cum[e[on]] <= u[on]]
        chunk.append(who)
        state.append(at)
        edge.append(e)
        at = to[e]
        on = at >= 0
        at, who, keys, step = at[on], who[on], keys[on], step + 1
    if not chunk:
        return (np.empty(0, np.int64),) * 3
    chunk, state, edge = np.concatenate(chunk), np.concatenate(state), np.concatenate(edge)
    order = np.argsort(chunk, kind="stable")
    return chunk[order], state[order], edge[order]


def truncated(location: np.ndarray, most: float, u: np.ndarray) -> np.ndarray:
    """Gumbel(location) variables given that they are below `most`."""
    return -np.logaddexp(-most, -location + np.log(-np.log(u)))


class Path:
    """A segmentation that is out: per step its chunk (number in the text), state, edge and the log-probability of
    the steps before it."""

    __slots__ = ("before", "chunk", "edge", "state")

    def __init__(self, chunk, state, edge, before):
        self.chunk, self.state, self.edge, self.before = chunk, state, edge, before


def best_of(values: np.ndarray, bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The largest value of each segment, then the next, up to `most`: (segments that have one, places). -inf is none."""
    values = values.copy()
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    top = np.full(len(bounds) - 1, -np.inf)
    some = np.flatnonzero(np.diff(bounds) > 0)
    for _ in range(most):
        if not len(some):
            return
        top[:] = -np.inf
        # a segment that is left out has nothing but -inf, so it doesn't matter to which one before it goes
        top[some] = np.maximum.reduceat(values, bounds[some])
        some = np.flatnonzero(top > -np.inf)
        hit = np.flatnonzero((values == top[owner]) & (values > -np.inf))
        _, first = np.unique(owner[hit], return_index=True)
        hit = hit[first]
        yield some, hit
        values[hit] = -np.inf


def top_k(starts: np.ndarray, bounds: np.ndarray, seeds: list[int], flat, k: int) -> list[tuple[list[tuple[float, float, np.ndarray]], float]]:
    """For each text up to k distinct segmentations (perturbed score, log-probability, edges), best first, and the
    k+1st perturbed score (-inf if there is none). starts: first states of all texts' chunks, text by text at bounds.

    All texts are searched together, sample by sample: walks, perturbed bounds and the choice of the best nodes are
    arrays over all of them; a text's queue holds the k best nodes that part from each path."""
    _, logp, to, first, count = flat
    n = len(bounds) - 1
    seed = np.array(seeds, np.uint64)
    score = -np.log(-np.log(uniform(named(seed, 1, np.zeros(n)))))
    heaps: list[list] = [[] for _ in range(n)]
    out: list[list] = [[] for _ in range(n)]
    live = np.arange(n)
    # of each live text: what its walk begins with, and at which chunk
    begin, begins, at = starts.astype(np.int64), bounds, np.zeros(n, np.int64)
    heads: list[tuple | None] = [None] * n
    for drawn in range(k):
        size = np.diff(begins)
        owner = np.repeat(np.arange(len(live)), size)
        chunk = np.arange(len(begin)) - np.repeat(begins[:-1] - at, size)
        who, state, edge = walk(begin, named(seed[live][owner], 3 + drawn, chunk), flat)
        cut = np.searchsorted(who, begins)
        owner, chunk = owner[who], chunk[who]
        step = logp[edge]
        # log-probability before each step: of the text's steps here, and of the path they follow
        total = np.cumsum(step)
        ahead = np.zeros(len(live))
        for i, head in enumerate(heads):
            if head is not None:
                ahead[i] = head[3]
        base = np.where(cut[:-1] > 0, total[np.maximum(cut[:-1] - 1, 0)], 0.0) if len(total) else np.zeros(len(live))
        before = total - step - (base - ahead)[owner] if len(total) else total
        left = -np.expm1(step)
        place = np.arange(len(step)) - np.repeat(cut[:-1], np.diff(cut)) + (drawn > 0)
        on = np.flatnonzero((count[state] > 1) & (left > 0))
        bound = np.full(len(step), -np.inf)
        bound[on] = truncated(before[on] + np.log(left[on]), score[live][owner[on]], uniform(named(seed[live][owner[on]], -drawn - 1, place[on])))
        paths: list[Path] = []
        for i, text in enumerate(live.tolist()):
            a, b = cut[i], cut[i + 1]
            head = heads[i]
            if head is None:
                path = Path(chunk[a:b], state[a:b], edge[a:b], before[a:b])
            else:
                parent, t, e, _, bar = head
                join = lambda x, y, z: np.concatenate([x[: t + 1], z]) if y is None else np.concatenate([x[:t], [y], z])  # noqa: E731, B023
                path = Path(join(parent.chunk, None, chunk[a:b]), join(parent.state, None, state[a:b]), join(parent.edge, e, edge[a:b]), join(parent.before, None, before[a:b]))
                s, p = int(parent.state[t]), float(logp[e])
                rest = max(0.0, -float(np.expm1(p)) - sum(exp(logp[x]) for x in bar))
                if count[s] > len(bar) + 1 and rest > 0:
                    u = uniform(named(seed[text : text + 1], -drawn - 1, np.zeros(1)))
                    g = float(truncated(parent.before[t] + np.log(rest), score[text], u)[0])
                    heapq.heappush(heaps[text], (-g, drawn, t, path, (e, *bar)))
            paths.append(path)
            out[text].append((float(score[text]), float(path.before[-1] + logp[path.edge[-1]]) if len(path.edge) else 0.0, path.edge))
        for some, hits in best_of(bound, cut, k):
            for i, hit in zip(some.tolist(), hits.tolist(), strict=True):
                path = paths[i]
                t = len(path.edge) - int(cut[i + 1] - hit)
                heapq.heappush(heaps[int(live[i])], (-float(bound[hit]), drawn, t, path, (int(edge[hit]),)))
        live = np.array([text for text in live.tolist() if heaps[text]], np.int64)
        heads, parts, at = [], [], []
        draws = uniform(named(seed[live], 2, np.full(len(live), drawn + 1)))
        for text, u in zip(live.tolist(), draws.tolist(), strict=True):
            g, _, t, parent, bar = heapq.heappop(heaps[text])
            score[text] = -g
            if drawn == k - 1:
                continue
            s = int(parent.state[t])
            choice = [e for e in range(int(first[s]), int(first[s] + count[s])) if e not in bar]
            p = np.cumsum(np.exp(logp[choice]))
            e = choice[min(int(np.searchsorted(p, u * p[-1], side="right")), len(choice) - 1)]
            on = to[e] >= 0
            c = int(parent.chunk[t]) + (not on)
            later = starts[bounds[text] + c + 1 : bounds[text + 1]] if on else starts[bounds[text] + c : bounds[text + 1]]
            parts.append(np.concatenate([[to[e]], later]) if on else later)
            at.append(c)
            heads.append((parent, t, e, float(parent.before[t] + logp[e]), bar))
        begin = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        begins, at = np.cumsum([0, *map(len, parts)]), np.array(at, np.int64)
        if not len(live):
            break
    waiting = set(live.tolist())
    return [(found, float(score[text]) if text in waiting else -np.inf) for text, found in enumerate(out)]


def chunks_of(text: str, model: Model) -> list[str]:
    """The text with its leading mark, cut into chunks."""
    words = _CHUNK.findall((" " + text).replace(" ", SPACE))
    if model.cut_lines:
        words = [x for w in words for x in re.split("(\n)", w) if x]
    if model.cut_tails:
        words = [x for w in words for x in _tailed(w)]
    return words


def _tailed(word: str) -> tuple[str, ...]:
    stem = word.rstrip(string.punctuation)
    return (stem, word[len(stem) :]) if stem != word and stem and (stem[-1].isalpha() or stem[-1] in string.digits) else (word,)


def chunked(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, which of them each chunk of the texts is, the texts' bounds). Texts whose words lie between
    single spaces are cut and their chunks told apart by Arrow."""
    text = pa.array(texts, pa.large_string())
    size = pc.binary_length(text).to_numpy()
    uneven = pc.match_substring_regex(text, _UNEVEN).to_numpy(zero_copy_only=False)
    even = np.flatnonzero(~uneven & (size > 0))
    distinct: dict[str, int] = {}
    n = np.zeros(len(texts), np.int64)
    which = np.empty(0, np.int64)
    if len(even):
        some = pc.replace_substring(text.take(pa.array(even)), " ", _MARK + SPACE)
        if model.cut_lines:
            some = pc.replace_substring(some, "\n", f"{_MARK}\n{_MARK}")
        if model.cut_tails:
            some = pc.replace_substring_regex(some, _TAIL, f"\\1{_MARK}\\2\\3")
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), some, pa.scalar("", pa.large_string())), _MARK)
        flat = split.flatten()
        real = pc.not_equal(flat, "")  # nothing between two line breaks
        owner = np.repeat(np.arange(len(even)), np.diff(split.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
        coded = flat.filter(real).dictionary_encode()
        n[even] = np.bincount(owner, minlength=len(even))
        which = coded.indices.to_numpy().astype(np.int64)
        distinct = {w: k for k, w in enumerate(coded.dictionary.to_numpy(zero_copy_only=False).tolist())}
    odd = {int(k): [distinct.setdefault(c, len(distinct)) for c in chunks_of(texts[k], model)] for k in np.flatnonzero(uneven)}
    if odd:
        n[list(odd)] = [len(c) for c in odd.values()]
        out = np.empty(int(n.sum()), np.int64)
        mine = np.repeat(np.isin(np.arange(len(texts)), list(odd)), n)
        out[~mine], out[mine] = which, np.concatenate([np.array(odd[k], np.int64) for k in sorted(odd)])
        which = out
    return list(distinct), which, np.cumsum([0, *n.tolist()])


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


@lru_cache(maxsize=2)
def _model(path: str, alpha: float) -> Model:
    return Model(path, alpha)


_TABLES = WhileUsed(lambda path, alpha: Lattices(Model(path, alpha)))


def _lattices(path: str, alpha: float):
    """One table per worker process: what it remembers serves all of the process's tasks, until it has none."""
    return _TABLES(path, alpha)


def decoded_equal(ids: np.ndarray, ends: np.ndarray, texts: list[str], model: Model) -> np.ndarray:
    """Whether the ids of each text decode to it: what they stand for, one after the other, a space for each mark,
    less the first."""
    whole = model.surface.take(pa.array(ids))
    at = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)[np.concatenate([[0], ends])]
    data = bytes(whole.buffers()[2] or b"")
    mark = SPACE.encode()
    return np.array([data[a:b].replace(mark, b" ") == (b" " + t.encode("utf-8", "surrogatepass") if t else b"") for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts, strict=True)], bool)


def sampled(drawn: list[tuple[list[tuple[float, float, np.ndarray]], float]], lat: Lattices) -> pa.ListArray:
    """The samples of texts, and the probability that each is among the k: that its perturbed score is over the
    k+1st."""
    every = [x for got, _ in drawn for x in got]
    floor = np.array([f for got, f in drawn for _ in got], float)
    edges = np.concatenate([e for _, _, e in every]).astype(np.int64) if every else np.empty(0, np.int64)
    ends = np.cumsum([len(e) for _, _, e in every]) if every else np.empty(0, np.int64)
    ids, size = lat.pieces(edges)
    ends = np.concatenate([[0], np.cumsum(size)])[ends]
    lp = np.array([x for _, x, _ in every], float)
    with np.errstate(over="ignore", invalid="ignore"):
        inclusion = np.where(np.isfinite(floor), -np.expm1(-np.exp(np.minimum(lp - floor, 700))), 1.0)
    fields = [lists(ids, ends), pa.array(lp), pa.array([g for g, _, _ in every], pa.float64()), pa.array(inclusion)]
    rows = pa.StructArray.from_arrays(fields, names=["ids", "log_prob", "perturbed", "inclusion"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(got) for got, _ in drawn)]), pa.int32()), rows)


def encode_documents(docs: DataFrame, model: str, *, k: int = 2, alpha: float = 1.0, seed: int = 23, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Per row: key, ids (the library's best encoding), decoded (equals the text), samples: up to k distinct
    segmentations (ids, log_prob, perturbed, inclusion), seeded by the row's key.

    Null and empty texts have no ids and one empty sample of probability 1. Rows with equal keys and texts get
    equal samples. A text has fewer than k samples where it has fewer segmentations. Whole texts, of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _lattices(model, alpha) as lat:
            m = lat.model
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at, group in groups(texts, GROUP):
                    distinct, which, bounds = chunked(group, m)
                    entries = lat.learn(distinct)[which] if distinct else which
                    raw, ends = lat.best(entries)
                    ends = np.concatenate([[0], ends])[bounds[1:]]
                    same = decoded_equal(raw, ends, group, m)
                    seeds = [xxhash.xxh3_64_intdigest(repr(name).encode(), seed=seed) for name in keys[at : at + len(group)]]
                    drawn = top_k(lat.starts(entries), bounds, seeds, lat.flat(), k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), lists(raw, ends), pa.array(same), sampled(drawn, lat)], names=["_key", "ids", "decoded", "samples"])
        del lat, m
        given_back()

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
    sample = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"
    got = rows.mapInArrow(run, f"_key {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded boolean, samples {sample}")
    return got.withColumnRenamed("_key", key)


def decode(ids: list[int], model: str) -> str:
    """The text of ids (of the best encoding or of a sample)."""
    return _model(model, 1.0).sp.decode(list(ids))


def ids_crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def op3_sentencepiece(spark, sf_dir):
    import public_tokenizers

    got = encode_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return digest(got)


def digest(got: DataFrame) -> DataFrame:
    """A row's encoding in short: counts, hashes, and the samples' scores."""
    each = lambda name: F.transform("samples", lambda x: x[name])
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").alias("round_trip"), F.size("samples").cast("long").alias("n_samples"),
        F.transform("samples", lambda x: F.xxhash64(x["ids"])).alias("sample_hashes"), each("log_prob").alias("log_probs"), each("inclusion").alias("inclusions"),
    )
