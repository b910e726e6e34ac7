"""Toxicity: a linear-chain conditional random field tags toxic words; marginals give document scores and offsets.

The labels are per document. Words that explain toxic documents and hardly occur in others label the tokens of
the training documents; a two-state chain is trained on those by maximum likelihood; forward-backward
marginals are summed up per document and a logistic curve, fitted on the same documents, makes the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.runtime import crc_of_key, documents, staged

#: Words that are worked on at a time; nothing depends on it.
PIECE = 256
_EDGE = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(word: bytes) -> bytes:
    """The lower-case word without punctuation at its ends."""
    return _EDGE.sub(b"", word)


def parts(word: bytes) -> list[bytes]:
    """What is known of a word: itself, its beginnings of three to eight characters, its last four."""
    w = folded(word)
    t = w.decode("utf-8", "replace")
    return [b"w" + w, *(b"p" + t[:k].encode() for k in range(3, 9) if len(t) > k), b"s" + t[-4:].encode()]


def features(word: bytes, buckets: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) % buckets for x in parts(word)]


class Emissions(dict):
    """Word -> its log-odds of being toxic. Remembers `most` words."""

    def __init__(self, weights: np.ndarray, bias: float, most: int = 400_000):
        super().__init__()
        self.weights, self.bias, self.most = weights, bias, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        w, n = self.weights, len(self.weights)
        found = self[word] = self.bias + sum(float(w[i]) for i in features(word, n))
        return found


def pieces(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces that lines of these lengths (words) are worked on in, and each piece's number within its
    line. Lines over PIECE words have several; messages go through them as through one."""
    n = np.asarray(lengths, np.int64)
    per = -(-n // PIECE)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(n) - n, per) + number * PIECE
    return np.append(first, n.sum()).astype(np.int64), number


def _steps(length: np.ndarray) -> np.ndarray:
    """How many of the pieces (longest first) have a token t, for each t from 0 on."""
    return len(length) - np.searchsorted(length[::-1], np.arange(1, int(length[0]) + 1), side="left")


def _transfers(emission: np.ndarray, first: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Of each piece the product over its tokens of (transition, then emission), scaled: (pieces, 2, 2)."""
    out = np.broadcast_to(np.eye(2), (len(first), 2, 2)).copy()
    if not len(first):
        return out
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    m, t = out[order], np.exp(move)
    for k, n in enumerate(_steps(length).tolist()):
        x = m[:n] @ t
        e = np.clip(emission[first[:n] + k], -60, 60)
        x[:, :, 1] *= np.exp(np.minimum(e, 0))[:, None]
        x[:, :, 0] *= np.exp(-np.maximum(e, 0))[:, None]
        m[:n] = np.maximum(x / x.max(axis=(1, 2), keepdims=True), 1e-300)
    out[order] = m
    return out


def messages(emission: np.ndarray, bounds: np.ndarray, number: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the token's own emission) and backward messages of each token, as log ratios toxic : clean.

    Pieces advance together, longest first. What enters a line's later pieces from the left, and its earlier ones
    from the right, is carried through the pieces' transfer products, so lines of any length are one chain each."""
    fwd, bwd = np.empty(len(emission)), np.zeros(len(emission))
    if len(emission) == 0:
        return fwd, bwd
    first, length = bounds[:-1], np.diff(bounds)
    oo, ot, to, tt = np.exp(move.ravel())  # clean->clean, clean->toxic, toxic->clean, toxic->toxic
    enter = np.full(len(first), float(start))  # log ratio before the first token's emission
    after = np.zeros(len(first))  # backward message at the last token
    more = np.append(number[1:] > 0, False)  # the line goes on in the next piece
    long = np.flatnonzero((number > 0) | more)
    if len(long):
        m = np.empty((len(first), 2, 2))
        m[long] = _transfers(emission, first[long], length[long], move)
        heads = long[number[long] == 0]
        r = np.clip(start + emission[first[heads]], -60, 60)
        # a line's first piece: its first token has the start in place of a transition
        m0 = _transfers(emission, first[heads] + 1, length[heads] - 1, move)
        r = _through(m0, r)
        at = heads
        while len(at):
            go = more[at]
            at, r = at[go] + 1, r[go]
            enter[at] = np.log((ot + np.exp(r) * tt) / (oo + np.exp(r) * to))
            r = _through(m[at], r)
        at = long[~more[long]]
        r = np.zeros(len(at))
        while len(at):
            go = number[at] > 0
            at, r = at[go], r[go]
            b = np.exp(r)
            x = m[at]
            r = np.log((x[:, 1, 0] + x[:, 1, 1] * b) / (x[:, 0, 0] + x[:, 0, 1] * b))
            at = at - 1
            after[at] = r
    order = np.argsort(-length, kind="stable")
    first, length, enter, after = first[order], length[order], enter[order], after[order]
    active = _steps(length).tolist()
    r = np.clip(enter + emission[first], -60, 60)
    fwd[first] = r
    for t in range(1, len(active)):
        n = active[t]
        e = np.exp(r[:n])
        r = np.clip(emission[first[:n] + t] + np.log((ot + e * tt) / (oo + e * to)), -60, 60)
        fwd[first[:n] + t] = r
    last = first + length - 1
    r = after
    bwd[last] = r
    for t in range(1, len(active)):
        n = active[t]
        e = np.exp(np.clip(r[:n] + emission[last[:n] - t + 1], -60, 60))
        r = np.log((to + e * tt) / (oo + e * ot))
        bwd[last[:n] - t] = r
    return fwd, bwd


def _through(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Log ratio after the transfers m of what comes in with log ratio r."""
    e = np.exp(r)
    return np.clip(np.log((m[:, 0, 1] + e * m[:, 1, 1]) / (m[:, 0, 0] + e * m[:, 1, 0])), -60, 60)


def marginals(emission: np.ndarray, lengths: Sequence[int], start: float, move: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of lines of these lengths, one after the other."""
    fwd, bwd = messages(emission, *pieces(lengths), start, move)
    return 1 / (1 + np.exp(-np.clip(fwd + bwd, -60, 60)))


def expectations(emission: np.ndarray, bounds: np.ndarray, number: np.ndarray, firsts: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the expected number of each transition within lines (pairwise marginals of
    forward-backward). firsts: whether a token begins a line."""
    fwd, bwd = messages(emission, bounds, number, start, move)
    p = 1 / (1 + np.exp(-np.clip(fwd + bwd, -60, 60)))
    within = ~firsts[1:]
    a, b = fwd[:-1][within], (emission[1:] + bwd[1:])[within]
    # log weights of (from, to), less that of clean -> clean
    x = np.stack([np.zeros(len(a)), b + move[0, 1] - move[0, 0], a + move[1, 0] - move[0, 0], a + b + move[1, 1] - move[0, 0]])
    x = np.exp(x - x.max(axis=0))
    return p, (x / x.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class Tagger:
    weights: np.ndarray
    bias: float
    start: float
    move: np.ndarray
    curve: np.ndarray  # of the document score: constant, log(1 + expected toxic words), highest marginal


def _sample_lines(texts: Sequence[str]) -> tuple[list[bytes], list[list[np.ndarray]]]:
    """The distinct words, and each text's lines as indexes of them."""
    index: dict[bytes, int] = {}
    found = [[np.array([index.setdefault(w, len(index)) for w in x.split()], np.int32) for x in t.encode("utf-8", "surrogatepass").lower().split(b"\n")] for t in texts]
    return list(index), found


def toxic_parts(docs: Sequence[set[bytes]], labels: Sequence[int], least: int = 5, over: float = 1.6) -> set[bytes]:
    """Parts of words that mark toxic documents: in `least` of them or more, and the lower end of the 95 % interval
    of the log odds ratio against the others is above `over`."""
    seen = [Counter(), Counter()]
    for words, y in zip(docs, labels, strict=True):
        seen[y].update({x for w in words if w for x in parts(w)})
    n1, n0 = sum(labels) + 1, len(labels) - sum(labels) + 1
    found = set()
    for x, a in seen[1].items():
        if a >= least:
            b = seen[0][x]
            if np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0) - 1.96 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > over:
                found.add(x)
    return found


def distinct_texts(token_sets: Sequence[set[bytes]]) -> list[int]:
    """Indexes without near copies: a text that shares two of four least word hashes with an earlier one goes."""
    seen: dict = {}
    kept = []
    for i, s in enumerate(token_sets):
        h = [min((xxhash.xxh3_64_intdigest(w, seed=k) for w in s), default=0) for k in range(4)]
        met = Counter(seen[(k, x)] for k, x in enumerate(h) if (k, x) in seen)
        if met and max(met.values()) >= 2:
            continue
        kept.append(i)
        for k, x in enumerate(h):
            seen.setdefault((k, x), i)
    return kept


def train(texts: Sequence[str], labels: Sequence[int], *, buckets: int = 1 << 18, steps: int = 60, rate: float = 0.3, penalty: float = 1e-4, toxic_share: float | None = None) -> Tagger:
    """Fits the chain and the score curve. toxic_share: of the labels that the texts are a sample of; the curve is
    fitted as if the sample had it. With one class only, every score is near that class's share."""
    labels = [int(y) for y in labels]
    vocabulary, lines = _sample_lines(texts)
    bare = [folded(w) for w in vocabulary]
    sets = [{bare[k] for line in d for k in line} for d in lines]
    alone = distinct_texts(sets)
    marking = toxic_parts([sets[i] for i in alone], [labels[i] for i in alone])
    toxic = np.array([any(x in marking for x in parts(w)) for w in vocabulary], bool)
    # training sequences: all lines of every text, whole
    seqs = [line for d in lines for line in d if len(line)]
    weights, bias, start, move = np.zeros(buckets), -2.0, 0.0, np.zeros((2, 2))
    if seqs:
        lengths = [len(s) for s in seqs]
        bounds, number = pieces(lengths)
        words = np.concatenate(seqs)
        lists = [features(w, buckets) for w in vocabulary]
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        ids = np.concatenate(lists)
        y = (toxic[words] & np.repeat(np.array(labels, bool), [sum(map(len, d)) for d in lines])).astype(float)
        firsts = np.zeros(len(y), bool)
        firsts[np.cumsum([0, *lengths[:-1]])] = True
        within = ~firsts[1:]
        seen = np.bincount((2 * y[:-1] + y[1:])[within].astype(int), minlength=4).reshape(2, 2)
        theta_sq: dict = {}

        def ascend(name, value, grad):
            theta_sq[name] = theta_sq.get(name, 0) + grad * grad
            return value + rate * grad / np.sqrt(theta_sq[name] + 1e-8)

        for _ in range(steps):
            e = bias + np.bincount(at, weights[ids], len(vocabulary))[words]
            p, moves = expectations(e, bounds, number, firsts, start, move)
            miss = y - p
            scale = 1 / max(1.0, y.sum())
            grad = np.bincount(ids, np.bincount(words, miss, len(vocabulary))[at], buckets) * scale - penalty * weights
            weights = ascend("w", weights, grad)
            bias = float(ascend("b", bias, miss.sum() * scale))
            start = float(ascend("s", start, miss[firsts].sum() * scale))
            g = (seen - moves) * scale - penalty * move
            g[0, 0] = 0  # only differences from clean -> clean matter
            move = ascend("m", move, g)
    tagger = Tagger(weights.astype(np.float32), bias, start, move, np.zeros(3))
    x = np.array([summary(p) for p in document_marginals(tagger, texts)]).reshape(-1, 2)
    y, here = np.array(labels, float), sum(labels) / max(1, len(labels))
    share = here if toxic_share is None or not 0 < here < 1 else toxic_share
    weight = np.where(y > 0, share / max(here, 1e-9), (1 - share) / max(1 - here, 1e-9))
    tagger.curve = _logistic(x, y, weight)
    return tagger


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's method with a small penalty."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def summary(p: np.ndarray) -> tuple[float, float]:
    return (float(np.log1p(p.sum())), float(p.max())) if len(p) else (0.0, 0.0)


def document_marginals(tagger: Tagger, texts: Sequence[str | None], memo: Emissions | None = None, room: int = 400_000) -> Iterator[np.ndarray]:
    """Marginals of each text's words in order. Texts are worked on in groups of about `room` words."""
    memo = memo if memo is not None else Emissions(tagger.weights, tagger.bias)
    scores: list = []
    lengths: list[int] = []
    ends: list[int] = []

    def flush():
        p = marginals(np.concatenate(scores) if scores else np.empty(0), lengths, tagger.start, tagger.move)
        at = 0
        for end in ends:
            yield p[at:end]
            at = end

    total = 0
    for t in texts:
        for line in (t or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
            found = line.split()
            if found:
                scores.append(np.fromiter(map(memo.__getitem__, found), float, len(found)))
                lengths.append(len(found))
                total += len(found)
        ends.append(total)
        if total >= room:
            yield from flush()
            scores, lengths, ends, total = [], [], [], 0
    yield from flush()


def score_documents(docs: DataFrame, tagger: Tagger, *, key: str = "doc_id", text: str = "text", at_least: float = 0.5) -> DataFrame:
    """key, score, n_toxic (words), spans ("start:end" of toxic words, code points, comma-joined). Whole texts, of
    any length; null and empty texts have no words and get the curve's value there. Every row has a result of its own:
    repeated rows get equal ones, null keys stay null, an empty table gives no rows. Other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Emissions(tagger.weights, tagger.bias)
        c = tagger.curve
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score, n, spans = [], [], []
            for t, p in zip(texts, document_marginals(tagger, texts, memo), strict=True):
                a, b = summary(p)
                score.append(1 / (1 + np.exp(-np.clip(c[0] + c[1] * a + c[2] * b, -30, 30))))
                hit = np.flatnonzero(p >= at_least)
                n.append(len(hit))
                if len(hit):
                    where = [m.span() for m in _WORD.finditer(t)]
                    spans.append(",".join(f"{where[i][0]}:{where[i][1]}" for i in hit))
                else:
                    spans.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, pa.string())], names=[key, "score", "n_toxic", "spans"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(run, f"`{key}` long, score double, n_toxic long, spans string")


def training_sample(docs: DataFrame, labels: DataFrame, *, most_docs: int = 4000, most_chars: int = 10_000_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int], float]:
    """At most most_docs labelled training texts of most_chars characters together, half of them toxic where there are
    as many, in the order of a hash of the id, and the toxic share of all training labels. Texts are whole; one that
    the rest of most_chars has no room for is passed over. Rows with null labels or ids are left out; of rows that
    share an id one (by a hash of the text) is used; an id with both labels counts with either."""
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_y is not null and _k is not null").where(crc_of_key(F.col("_k")) % 5 != 0).distinct()
    rank = F.xxhash64(F.lit(3), "_k")
    half = most_docs // 2
    chosen = known.where("_y = 1").orderBy(rank).limit(half).union(known.where("_y = 0").orderBy(rank).limit(half))
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_k")  # at most most_docs rows
    rows = staged(rows.groupBy("_k", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")), "training")
    left, wanted = most_chars, []
    for r in rows.select("_k", "_y", F.length("_t").alias("n"), rank.alias("r")).orderBy("r", "_k", "_y").collect():
        if r["n"] <= left:
            left -= r["n"]
            wanted.append((r["_k"], r["_y"]))
    keep = set(wanted)
    got = sorted((r["_k"], r["_y"], r["_t"]) for r in rows.toLocalIterator() if (r["_k"], r["_y"]) in keep)
    share = known.agg(F.avg("_y")).first()[0] or 0.0
    return [t for _, _, t in got], [y for _, y, _ in got], share


def op9_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    texts, marks, share = training_sample(docs, labels)
    tagger = train(texts, marks, toxic_share=share)
    scored = score_documents(docs, tagger)
    return scored.select("doc_id", (crc_of_key(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "n_toxic", "spans")


