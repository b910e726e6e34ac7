"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field labels the candidate words
of a document (those with a digit or an @) with these kinds, and secrets: keys, tokens and passwords, which no pattern
knows. Neighbouring candidates share a potential, and so do candidates that are equal or alike anywhere in the document
(skip edges to the last one of the same form), so evidence at one mention reaches the others; loopy belief propagation
gives the marginals. Its weights are trained on a bounded sample of texts, labelled by the patterns, and on made-up
texts whose labels are known because they were put there: personal data in forms that the patterns miss, partial and
repeated mentions, secrets, and numbers that are nobody's. Pattern spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.runtime import WS, documents

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart, in the order of the result's spans.
LABELS = (*KINDS, "secret")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number that starts within a run of digits can't match where its whole run doesn't; starting at runs only keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` finds them, in linear time: by each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            # what lies before this @ can't be part of a later match
            end = at + 1
        at = text.find("@", end)


def patterns(text: str) -> list[Span]:
    """Spans of the four patterns, by kind as in KINDS, then start. Matches that fail a kind's test are dropped."""
    if not _HINT.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def form(word: str) -> str:
    """The word's form: digits 9, letters a, runs of letters shortened, and of digits from the seventh on; a run of
    both, mixed, of 12 characters or more is x, if hexadecimal h."""
    word = re.sub(r"(?=[^\W_]*[0-9])(?=[^\W_]*[^\W\d_])[^\W_]{12,}", lambda m: "\0h" if re.fullmatch("[0-9a-fA-F]+", m[0]) else "\0x", word)
    out = re.sub(r"(?<!\0)[^\W\d_]+", "a", word)
    out = re.sub(r"[0-9]", "9", out).replace("\0", "")
    return re.sub(r"9{6,}", "999999", out)


@dataclass
class Chain:
    """Candidate words of a document: (start, end), feature numbers, edges (i, j) of neighbours and of skips."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    near: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    labels: list[int]


def before(text: str, at: int) -> tuple[str, int]:
    """The word before a place, and where it begins."""
    end = at
    while end and text[end - 1] in WS:
        end -= 1
    start = end
    while start and text[start - 1] not in WS:
        start -= 1
    return text[start:end], start


def chain(text: str, marked: Sequence[Span], buckets: int) -> Chain | None:
    """The document's graph, or None if it has no candidate. Label 0: nothing; k: LABELS[k - 1], as `marked` says."""
    found = list(_CANDIDATE.finditer(text)) if _HINT.search(text) else []
    if not found:
        return None
    spans, features, near, skip, labels = [], [], [], [], []
    last_of: dict[str, int] = {}
    marks = sorted((a, b, LABELS.index(k) + 1) for k, a, b in marked)
    at = 0
    for i, m in enumerate(found):
        a, b = m.span()
        f = form(m[0])
        prev, start = before(text, a)
        earlier, _ = before(text, start)
        after = _WORD.search(text, b)
        cue = re.match(r"[\W_]*([A-Za-z_-]+)[=:]", m[0])
        names = (
            "f" + f, "h" + f[:3], "t" + f[-3:], "p" + form(prev.lower()), "n" + form(after[0].lower() if after else ""), "w" + prev.lower().strip(".,:;\"'"), "v" + earlier.lower().strip(".,:;\"'"),
            "k" + (cue[1].lower() if cue else ""), f"d{sum(c in '0123456789' for c in m[0])}",
        )
        features.append([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % buckets for x in names])
        spans.append((a, b))
        if i and text[spans[-2][1] : a].strip(WS) == "":
            near.append((i - 1, i))
        for same in {"=" + _bare(m[0]), "~" + f}:
            if same in last_of and last_of[same] != i - 1:
                skip.append((last_of[same], i))
            last_of[same] = i
        while at < len(marks) and marks[at][1] <= a:
            at += 1
        labels.append(next((k for x, y, k in marks[at : at + 4] if x < b and y > a), 0))
    return Chain(spans, features, near, list(dict.fromkeys(skip)), labels)


def _bare(word: str) -> str:
    """The word without what leads up to a value and the punctuation around it."""
    return re.sub(r"^[\W_]*[A-Za-z_-]+[=:]", "", word).strip(".,;:!?\"'()[]<>#$%&*")


def known(text: str, c: Chain) -> Chain | None:
    """For training, of a text that only patterns have labelled: the graph, if no candidate may be a secret or a
    mention in part, which they don't label."""
    for (a, b), k in zip(c.spans, c.labels, strict=True):
        if not k and (re.search("[xh]", form(text[a:b])) or plausible("email", _bare(text[a:b])) or plausible("phone", _bare(text[a:b]))):
            return None
    return c


@dataclass
class Field:
    """Log-potentials: unary (buckets, labels), bias, of neighbours and of skip edges (labels, labels)."""

    unary: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    skip: np.ndarray


def beliefs(c: Chain, field: Field, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Marginals (candidates, labels) by loopy sum-product, messages of all edges at once."""
    unary = field.bias + field.unary[np.array(c.features)].sum(axis=1)
    edges = [(i, j, field.near) for i, j in c.near] + [(i, j, field.skip) for i, j in c.skip]
    if edges:
        src = np.array([e[0] for e in edges] + [e[1] for e in edges])
        dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
        n = len(edges)
        pot = np.concatenate([np.stack([e[2] for e in edges]), np.stack([e[2].T for e in edges])])
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        msg = np.zeros((2 * n, unary.shape[1]))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            x = out[:, :, None] + pot
            top = x.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = damping * msg + (1 - damping) * new
            if change < 1e-4:
                break
        np.add.at(unary, dst, msg)
    unary -= unary.max(axis=1, keepdims=True)
    p = np.exp(unary)
    return p / p.sum(axis=1, keepdims=True)


def made_up(texts: Sequence[str], n: int = 1500, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Texts of words of `texts` with numbers put among them, and the spans of those that are personal: data as the
    patterns know it and in forms that they don't, secrets after a cue, mentions of both that come back bare or in
    part. The others are years, dates, times, versions, prices, counts, references, handles: a corpus may have no number
    that isn't personal, and without these the field would learn that none is."""
    rng = np.random.default_rng(seed)
    plain = [w for t in texts[:200] for w in t.split()[:60] if not _HINT.search(w)] or ["and", "the", "of"]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, k))
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    nobodys = (
        lambda: f"{rng.integers(1000, 2100)}", lambda: f"{rng.integers(0, 1000)}", lambda: f"{rng.integers(0, 100)}.{digits(2)}", lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}",
        lambda: f"{rng.integers(1, 29)}/{rng.integers(1, 13)}/{rng.integers(1900, 2100)}", lambda: f"{rng.integers(0, 24)}:{rng.integers(0, 60):02}", lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}",
        lambda: f"${rng.integers(1, 10**6):,}", lambda: f"{rng.integers(0, 101)}%", lambda: f"{chr(65 + rng.integers(0, 26))}{digits(int(rng.integers(1, 6)))}", lambda: digits(int(rng.integers(3, 20))),
        lambda: f"({rng.integers(1, 100)})", lambda: f"[{rng.integers(1, 100)}]", lambda: f"@{rng.choice(plain)}{digits(2)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{rng.integers(1, 9)}th", lambda: f"{rng.integers(1, 99)},", lambda: f"{rng.integers(1, 2100)}.",
        lambda: f"{letters(5)}{digits(2)}", lambda: f"{letters(4)}-{digits(3)}",
    )

    def phone():
        cc, a, b, c = str(rng.integers(1, 99)), digits(3), digits(3), digits(4)
        forms = (f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{cc} {a} {b}{c}", f"00{cc}-{a}-{b}-{c}")
        return pick(*forms), f"({a}) {b}-{c}"

    def card():
        g = [digits(4) for _ in range(4)]
        sep = pick(" ", "-", "", ".", "/", ".")
        digits_ = "".join(g)
        if sep in ("", " ", "-"):  # the patterns know these if the last digit is right
            odd = [d for d in "0123456789" if luhn(digits_[:-1] + d)][0]
            g[3] = g[3][:3] + odd
        return sep.join(g), sep.join(g)

    def email():
        name, host = f"{pick(letters(5), str(rng.choice(plain)))}{pick('.', '_', '')}{digits(2)}", f"{letters(4)}{rng.integers(1, 9)}.{pick('com', 'org', 'example.com', 'net')}"
        return pick(f"{name}@{host}", f"{name}[at]{host}", f"{name}(at){host}", f"{name}@{host.split('.')[0]}"), f"{name}@{host}"

    def ip():
        p = [str(rng.integers(0, 256)) for _ in range(4)]
        sep = pick(".", ".", "[.]", "(.)")
        return sep.join(p), sep.join(p)

    def secret():
        k = int(rng.integers(16, 44))
        v = pick("".join(pick(*"0123456789abcdef") for _ in range(k)), "".join(pick(*"0123456789", letters(1), letters(1).upper()) for _ in range(k)))
        if not re.search("[0-9]", v) or not re.search("[a-zA-Z]", v):
            v = "a1" + v[2:]
        name = pick("token", "password", "secret", "api_key", "apikey", "key", "passwd", "access_token", "pwd")
        return (pick(f'{name} = "', f"{name}=", f"{name}: ", f"{name} = ", f"{name}='"), v, pick("", "", '"', ".", "###")), v

    makers = {"phone": phone, "card": card, "email": email, "ip": ip, "secret": secret}
    out = []
    for _ in range(n):
        items: list[tuple[str, str, str, str | None]] = []  # before, value, after, kind
        backs = []
        for _ in range(int(rng.integers(1, 4))):
            kind = pick(*makers)
            value, again = makers[kind]()
            lead, value, tail = value if kind == "secret" else ("", value, pick("", "", "", ".", ",", "!!", "$$$"))
            items.append((lead, value, tail, kind))
            if rng.random() < 0.4:
                backs.append(len(items))
                items.append(("", again, pick("", "."), kind))
        items += [("", str(pick(*nobodys)()), "", None) for _ in range(int(rng.integers(2, 8)))]
        # in any order, but a mention that comes back stays behind the first
        slots = sorted(int(x) for x in rng.integers(0, 40, len(items)))
        order = [int(x) for x in rng.permutation(len(items))]
        for i in backs:
            x, y = order.index(i - 1), order.index(i)
            if x > y:
                order[x], order[y] = i, i - 1
        words = [str(x) for x in rng.choice(plain, 40)]
        text, spans, at = "", [], 0
        for slot, i in zip(slots, order, strict=True):
            lead, value, tail, kind = items[i]
            text += "".join(w + " " for w in words[at:slot]) + lead
            at = slot
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + tail + " "
        out.append((text + " ".join(words[at:]), spans))
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a span can be of its kind at all: what the field adds must look like it."""
    n = sum(c in "0123456789" for c in text)
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]+(@|\[at\]|\(at\))[^@\s]+", text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}([^0-9A-Za-z]+[0-9]{1,3}){3}", text))
    if kind == "secret":
        return len(text) >= 12 and 0 < n and bool(re.fullmatch(r"[A-Za-z0-9+/_-]*[A-Za-z][A-Za-z0-9+/_-]*", text))
    return 13 <= n <= 19 and not re.search(r"[^0-9 ./-]", text) if kind == "card" else 7 <= n <= 15 and not re.search(r"[^0-9 ()+./-]", text)


def train(texts: Sequence[str], *, buckets: int = 1 << 14, steps: int = 80, rate: float = 0.3, penalty: float = 1e-3, seed: int = 3) -> Field:
    """Maximum pseudo-likelihood: each label given its neighbours' labels, which patterns and makers provide."""
    m = len(LABELS) + 1
    marked = [*((t, patterns(t)) for t in texts), *made_up(texts, seed=seed)]
    # what has a secret's form in a sampled text has no label: no pattern knows
    graphs = [c for i, (t, spans) in enumerate(marked) if (c := chain(t, spans, buckets)) and (c := c if i >= len(texts) else known(t, c))]
    field = Field(np.zeros((buckets, m)), np.array([1.0] + [0.0] * (m - 1)), np.zeros((m, m)), np.zeros((m, m)))
    if not graphs:
        return field
    offsets = np.cumsum([0, *(len(c.spans) for c in graphs)])
    ids = np.array([f for c in graphs for f in c.features])
    y = np.array([v for c in graphs for v in c.labels])
    pairs = {k: np.array([(i + o, j + o) for c, o in zip(graphs, offsets, strict=False) for i, j in getattr(c, k)], np.int64).reshape(-1, 2) for k in ("near", "skip")}
    hot = np.eye(m)[y]
    square: dict = {}

    def ascend(name, value, grad):
        square[name] = square.get(name, 0) + grad * grad
        return value + rate * grad / np.sqrt(square[name] + 1e-8)

    for _ in range(steps):
        u = field.bias + field.unary[ids].sum(axis=1)
        for k in ("near", "skip"):
            e, w = pairs[k], getattr(field, k)
            np.add.at(u, e[:, 1], w[y[e[:, 0]]])
            np.add.at(u, e[:, 0], w.T[y[e[:, 1]]])
        u -= u.max(axis=1, keepdims=True)
        p = np.exp(u)
        p /= p.sum(axis=1, keepdims=True)
        miss = (hot - p) / len(y)
        grad = np.zeros_like(field.unary)
        for col in range(ids.shape[1]):
            np.add.at(grad, ids[:, col], miss)
        field.unary = ascend("u", field.unary, grad - penalty * field.unary / 10)
        field.bias = ascend("b", field.bias, miss.sum(axis=0))
        for k in ("near", "skip"):
            e, w = pairs[k], getattr(field, k)
            g = np.zeros((m, m))
            np.add.at(g, y[e[:, 0]], miss[e[:, 1]])
            h = np.zeros((m, m))
            np.add.at(h, y[e[:, 1]], miss[e[:, 0]])
            setattr(field, k, ascend(k, w, g + h.T - penalty * w / 10))
    return field


def added(text: str, base: Sequence[Span], field: Field, at_least: float = 0.9) -> list[Span]:
    """Spans of candidates that the field labels with probability at_least and that touch no pattern span.
    Neighbouring candidates of one label are one span; punctuation at its ends is left out."""
    c = chain(text, base, len(field.unary))
    if c is None:
        return []
    p = beliefs(c, field)
    taken = sorted((a, b) for _, a, b in base)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    joined_to = {j for _, j in c.near}
    out: list[list] = []
    k, last = 0, -2
    for i, (a, b) in enumerate(c.spans):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not best[i] or sure[i] < at_least or any(x < b and y > a for x, y in taken[k : k + 8]):
            continue
        if last == i - 1 and i in joined_to and out and out[-1][0] == best[i]:
            out[-1][2] = b
        else:
            out.append([best[i], a, b])
        last = i
    spans = []
    for label, a, b in out:
        kind = LABELS[label - 1]
        if kind == "secret":  # the value: what comes after the cue
            value = _bare(text[a:b])
            a = text.index(value, a) if value else a
            b = a + len(value)
        while a < b and not (text[a].isalnum() or text[a] in "+(@"):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if plausible(kind, text[a:b]):
            spans.append((kind, a, b))
    return spans


def find_spans(docs: DataFrame, field: Field, *, key: str = "doc_id", text: str = "text", at_least: float = 0.9) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans (patterns' and added ones, by LABELS,
    then start), n_spans, n_added. Whole texts of any length; null and empty ones have no spans; equal rows get equal
    ones, also where keys repeat or are null; an empty table gives no rows; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = [[] for _ in KINDS]
            digest, spans, total, more = [], [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = patterns(t)
                for k, counts in zip(KINDS, n, strict=True):
                    counts.append(sum(s[0] == k for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else none)
                every = base + added(t, base, field, at_least)
                spans.append(joined(sorted(every, key=lambda s: (LABELS.index(s[0]), s[1], s[2]))))
                total.append(len(every))
                more.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64()), pa.array(more, pa.int64())], names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_spans long, n_added long")


def training_texts(docs: DataFrame, *, most_docs: int = 4000, most_chars: int = 16_000_000, key: str = "doc_id", text: str = "text") -> list[str]:
    """At most most_docs texts with candidates, of most_chars characters together, in the order of a hash of key and
    text: a bounded sample to fit the field on. Texts are whole; one that the rest of most_chars has no room for is
    passed over. The driver first gets only hashes and lengths, then the texts it chose."""
    rows = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(F.lit(9), key, text).alias("_o"), F.col(text).alias("_t"))
    left, wanted = most_chars, []
    for r in rows.select("_o", F.length("_t").alias("n")).orderBy("_o", "n").limit(most_docs).collect():
        if r["n"] <= left:
            left -= r["n"]
            wanted.append((r["_o"],))
    if not wanted:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(wanted)), "_o long"))  # most_docs numbers at most
    got = rows.join(chosen, "_o").groupBy("_o").agg(F.min("_t").alias("_t"))
    return [r["_t"] for r in sorted(got.toLocalIterator(), key=lambda r: r["_o"])]


def op7_pii(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find_spans(docs, train(training_texts(docs)))
