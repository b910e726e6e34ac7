"""The operators on small tables: brute force, round trips, odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

ODD = [
    (1, None, "en", "a", 0, "x"),
    (2, "", "en", None, 0, "x"),
    (3, " \t\n\x0b\x0c\r ", None, "b", 7, "x"),
    (4, "one two three", "en", "a", 13, None),
    (4, "one two three", "en", "a", 13, None),
    (None, "word " * 300, "en", "a", None, "x"),
    (6, "alpha beta gamma delta epsilon zeta " * 4000, "en", "b", 1, "x"),
    (7, "A long enough line here\nsecond LINE that repeats\n\n  second line THAT repeats \nx", "en", "a", 1, "x"),
    (8, "second line that repeats\nÄÖÜ Éa long other line\nx", "de", "a", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return WORD.findall(t or "")


# ---- 1 mixing


def test_capped_targets_and_sainte_lague():
    from sluice.llm.mixing import capped_targets, sainte_lague

    t = capped_targets([10, 100, 100], [5, 1, 1], 210)
    assert t[0] == 30 and t[1] == t[2] == pytest.approx(90)
    assert capped_targets([0, 0], [1, 2], 0) == [0, 0]
    # textbook example: 100 seats by quotients, checked against the plain algorithm
    rng = np.random.default_rng(4)
    for _ in range(30):
        v = rng.integers(1, 1000, rng.integers(1, 9)).astype(float)
        seats, caps = int(rng.integers(0, 60)), rng.integers(1, 30, len(v))
        want = np.zeros(len(v), int)
        for _ in range(min(seats, caps.sum())):
            q = [x / (2 * k + 1) if k < c else -1 for x, k, c in zip(v, want, caps)]
            want[int(np.argmax(q))] += 1
        assert sainte_lague(v, seats, caps).tolist() == want.tolist()


def mixed_by_hand(words_of, plan, run_blocks=32):
    """Per row, how often each word is taken, word by word and block by block: plan has shards as (rows in order,
    blocks, quota, places)."""
    out = {}
    for rows, blocks, quota, place in plan:
        total = sum(words_of[r] for r in rows)
        bounds = [b * total // blocks for b in range(blocks + 1)] if blocks else [0]
        times = [quota // blocks + (place[b // run_blocks] + b % run_blocks < quota % blocks) for b in range(blocks)]
        of_word = [t for b, t in enumerate(times) for _ in range(bounds[b + 1] - bounds[b])]
        at = 0
        for r in rows:
            out[r] = of_word[at : at + words_of[r]]
            at += words_of[r]
    return out


def test_mix_of_documents(spark, docs):
    from sluice.llm.mixing import mix_plan, mixed_documents, op1_mix_sources

    plan = mix_plan(docs).toPandas()
    again = mix_plan(docs.repartition(3)).toPandas()
    key = ["doc_id", "taken"]
    assert plan.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    assert (plan.taken <= 3 * plan["size"]).all()
    sums = plan.merge(docs.select("doc_id", "source").toPandas(), on=["doc_id", "source"]).groupby("source").agg(size=("size", "sum"), total=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.total).all()
    assert ((sums.taken - sums.target).abs() <= 32).all()
    got = mixed_documents(docs).select("doc_id", "text").toPandas()
    n = got.assign(n=[len(words(t)) for t in got.text]).groupby("doc_id").n.sum()
    want = plan.set_index("doc_id").taken
    assert n.to_dict() == want[want > 0].to_dict()
    query = op1_mix_sources(spark, SF).toPandas()
    assert query.set_index("doc_id").taken.to_dict() == want.to_dict()
    # few cuts: most documents that are taken at all are taken whole, or without one part
    assert np.mean([len(s) for s in plan.spans if len(s)]) < 2.5


def test_taken_words_equal_block_by_block(spark):
    """taken and the mixed texts, repeated rows and ids included, against the blocks laid out one by one."""
    import xxhash

    from sluice.llm.mixing import capped_targets, mix_plan, mixed_documents, places, sainte_lague

    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{i}.{k}" for k in range(int(rng.integers(0, 200)))), "ab"[i % 2]) for i in range(60)]
    rows += [(i % 7, " ".join(f"r{i % 7}.{k}" for k in range(40 + i % 7)), "a") for i in range(90)] + [(None, "n 1 2 3", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    plan = mix_plan(docs, run_blocks=4, shard_words=10**9).collect()
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    targets = capped_targets([size[s] for s in ("a", "b", None)], [1, 2, 3], sum(size.values()))
    blocks = {s: max(1, round(n / 16)) for s, n in size.items()}
    seats = dict(zip(("a", "b", None), sainte_lague(targets, round(sum(targets) / 16), [3 * blocks[s] for s in ("a", "b", None)])))
    for s in ("a", "b", None):
        mine = sorted((i if i is not None else -1, len(words(t))) for i, t, x in rows if x == s)
        name = xxhash.xxh3_64_intdigest(f"0 {s}".encode(), seed=17)
        by_word = mixed_by_hand([n for _, n in mine], [(range(len(mine)), blocks[s], int(seats[s]), places(blocks[s], 4, name))], 4)
        want = sorted((i, n, sum(by_word[k])) for k, (i, n) in enumerate(mine))
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["taken"]) for r in plan if r["source"] == s) == want
        assert abs(sum(x for _, _, x in want) - targets[("a", "b", None).index(s)]) <= 16
    for options in ({"run_blocks": 4, "shard_words": 10**9}, {"run_blocks": 2, "shard_words": 100}):
        total = sum(r["taken"] for r in mix_plan(docs, **options).collect())
        mixed = mixed_documents(docs, **options).collect()
        assert sum(len(words(r["text"])) for r in mixed) == pytest.approx(total, abs=100 if options["shard_words"] == 100 else 0)
        n = Counter(r["source"] for r in mixed for _ in words(r["text"]))
        for s, t in zip(("a", "b", None), targets):
            assert abs(n[s] - t) <= (20 if options["shard_words"] > 100 else 20 + 0.01 * t), (s, n[s], t)


def test_places_are_permutations():
    from sluice.llm.mixing import places

    for blocks, run in ((0, 32), (1, 32), (32, 32), (100, 32), (8192, 32), (77, 1)):
        p = places(blocks, run, 5)
        ranks = [int(p[b // run]) + b % run for b in range(blocks)]
        assert sorted(ranks) == list(range(blocks))
    a, b = places(8192, 32, 1), places(8192, 32, 2)
    steps = np.diff(a) % 8192
    assert (a != b).any() and len(set(steps.tolist())) > 100  # no small step through the shard


def test_mix_of_odd_rows(odd, empty):
    from sluice.llm.mixing import mix_plan, mixed_documents

    rows = mix_plan(odd).toPandas()
    assert len(rows) == len(ODD) and rows.taken.notna().all()
    assert mix_plan(empty).count() == 0
    clash = odd.withColumnsRenamed({"lang": "_file", "n_chars": "_at", "size": "spans"}).withColumn("file", F.lit(1))
    assert mixed_documents(odd).columns == odd.columns and mixed_documents(empty).count() == 0
    assert mixed_documents(clash).columns == clash.columns
    assert mixed_documents(clash).count() == mixed_documents(odd).count()


# ---- 2 quality


def repeated(w):
    tri = Counter(zip(w, w[1:], w[2:]))
    at = set()
    for i in range(len(w) - 2):
        if tri[(w[i], w[i + 1], w[i + 2])] > 1:
            at |= {i, i + 1, i + 2}
    return len(at)


def test_quality_counts(spark, docs, odd):
    from sluice.llm.quality import n_dup_lines, n_repeat_words, n_symbols, word_chars
    from sluice.llm.runtime import words as split

    rows = docs.select("text").union(odd.select("text"))
    t = F.coalesce("text", F.lit(""))
    got = rows.select("text", F.size(split(F.col("text"))).alias("n"), word_chars(t).alias("c"), n_symbols(t).alias("s"), n_dup_lines(t).alias("l"), n_repeat_words(split(F.col("text"))).alias("r")).collect()
    for r in got:
        w = words(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        assert (r["n"], r["c"], r["s"], r["l"], r["r"]) == (len(w), sum(map(len, w)), sum((r["text"] or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(w))


def rejected_by(t):
    """Names of the default rules that reject a text."""
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    n, chars = len(w), sum(map(len, w))
    said = {"few_words": n < 50, "repeated_words": 100 * repeated(w) > 50 * n, "symbols": 100 * sum(t.count(c) for c in "#*$%&|<>") > 30 * n}
    said |= {"repeated_lines": 100 * (len(lines) - len(set(lines))) > 50 * len(lines), "word_length": chars < 2.5 * n or chars > 12 * n}
    return {k for k, v in said.items() if v}


def test_cascade(spark, docs, odd, empty):
    from sluice.llm.quality import Counts, Rule, cascade, default_rules, estimate, op2_quality_rules, quality_filter
    from sluice.llm.runtime import words as split

    rules = default_rules()
    order = estimate(docs, rules)
    assert {e.rule.name for e in order} == {r.name for r in rules}
    ranks = [e.rank for e in order]
    assert ranks == sorted(ranks, reverse=True) and all(e.cost > 0 for e in order)
    rng = np.random.default_rng(9)
    made = [(10**6 + i, " ".join(rng.choice([f"w{k}" for k in range(int(rng.integers(2, 90)))], int(rng.integers(0, 90))))) for i in range(120)]
    made += [(2 * 10**6 + i, "\n".join(rng.choice([f"a line {k} of it" for k in range(9)], 20)) + " #" * int(rng.integers(0, 40))) for i in range(20)]
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(made, "doc_id long, text string"))
    t = F.coalesce("text", F.lit(""))
    for some in ([e.rule for e in order], rules[::-1]):
        for r in rows.withColumn("_w", split(F.col("text"))).select("text", cascade(some, Counts(t, F.col("_w"))).alias("by")).collect():
            want = [x.name for x in some if x.name in rejected_by(r["text"])]
            assert r["by"] == (want[0] if want else None)
    left = sorted(r["doc_id"] for r in quality_filter(rows).select("doc_id").collect())
    assert left == sorted(r["doc_id"] for r in rows.collect() if not rejected_by(r["text"]))
    kept = {r["doc_id"]: r["kept"] for r in op2_quality_rules(spark, SF).collect()}
    assert kept == {r["doc_id"]: not rejected_by(r["text"]) for r in docs.collect()}
    # what an earlier rule rejects doesn't reach a later one
    stop = Rule("stop", lambda c: F.when(c.n_words >= 0, F.lit(True)).otherwise(F.lit(False)))
    fail = Rule("fail", lambda c: F.assert_true(c.n_words < 0).isNull())
    assert rows.select(cascade([stop, fail], Counts(t, split(F.col("text")))).alias("by")).where("by = 'stop'").count() == rows.count()
    assert quality_filter(odd).columns == odd.columns
    clash = odd.withColumnsRenamed({"lang": "_w", "source": "_t"})
    assert quality_filter(clash).columns == clash.columns
    assert quality_filter(empty).count() == 0


def test_order_of_rules_repeats(docs):
    from sluice.llm.quality import default_rules, estimate

    orders = [[(e.rule.name, e.cost, e.rejected) for e in estimate(docs, default_rules(), rows=rows)] for rows in (100, 100, 2000, 2000)]
    assert orders[0] == orders[1] and orders[2] == orders[3]
    w = [words(r["text"]) for r in docs.collect()]
    few = next(x for x in orders[2] if x[0] == "few_words")
    assert few[2] == pytest.approx(sum(len(x) < 50 for x in w) / len(w))


# ---- 3 SentencePiece


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_equals_the_library(spark, docs, odd, empty, pieces):
    import sentencepiece

    from sluice.llm.sentencepiece_op import decode, encode_documents

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = [r["text"] for r in rows.collect()]
    for r, t in zip(encode_documents(rows, pieces).collect(), texts):
        assert r["ids"] == sp.encode(t or "")
        assert r["decoded"] and decode(r["ids"], pieces) == (t or "")
        samples = [tuple(s["ids"]) for s in r["samples"]]
        assert len(set(samples)) == len(samples) and all(decode(s, pieces) == (t or "") for s in samples)
        assert all(0 <= s["inclusion"] <= 1 for s in r["samples"])
        bounds = [s["perturbed"] for s in r["samples"]]
        assert bounds == sorted(bounds, reverse=True)
    assert encode_documents(empty, pieces).count() == 0


def test_texts_are_cut_where_no_piece_spans(pieces):
    """Chunks encode to what the whole text does, however they were cut, and decode to it."""
    import random

    import sentencepiece

    from sluice.llm.sentencepiece_op import Lattices, Model, chunked, decoded_equal

    m, rng = Model(pieces), random.Random(4)
    assert m.cut_lines and m.cut_tails
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    parts = ["a", "the", "Bé", "1", "²", ".", ",", "'s", "$", " ", " ", " ", "\n", "\n", "\t", "\u3000", "漢", "\u0301", "😀", "x.y", "ab.", "\x1f"]
    texts = ["", " ", "\n", "a\n\n b. ", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500))]
    lat = Lattices(m, most_edges=20_000)
    for k in range(0, len(texts), 100):
        group = texts[k : k + 100]
        distinct, which, bounds = chunked(group, m)
        raw, ends = lat.best(lat.learn(distinct)[which])
        ends = np.concatenate([[0], ends])[bounds]
        for t, a, b in zip(group, ends, ends[1:]):
            assert raw[a:b].tolist() == sp.encode(t), t
        assert decoded_equal(raw, ends[1:], group, m).all()
        assert not decoded_equal(raw, ends[1:], [t + "?" for t in group], m).any()


def test_a_full_table_keeps_the_chunks_that_are_wanted(pieces):
    """Word after word is new and one set of chunks comes back: those aren't built again, and whatever is forgotten,
    encodings, lattices and samples are those of a table that holds everything."""
    import random

    from sluice.llm.sentencepiece_op import Lattices, Model, top_k

    m, rng = Model(pieces), random.Random(5)
    some = ["\u2581the", "\n", "\u2581B\u00e9\u6f22\U0001f600", "\u2581", ".x", "\u2581entz\u00f6st"]
    small, whole, built = Lattices(m, most_edges=2_000), Lattices(m, most_edges=10**9), []
    build = small._built
    small._built = lambda chunks: (built.extend(chunks), build(chunks))[1]
    seen = 0
    for k in range(120):
        wanted = sorted({*some, *("\u2581" + "".join(rng.choice("abcdeo\u00df\u6f22") for _ in range(rng.randrange(1, 12))) for _ in range(20))})
        rng.shuffle(wanted)
        got = []
        for lat in (small, whole):
            at = lat.learn(wanted)
            raw, ends = lat.best(at)
            drawn = top_k(lat.starts(at), np.arange(len(at) + 1), [k + 7 * j for j in range(len(at))], lat.flat(), 3)
            got.append([raw.tolist(), ends.tolist(), [([(g, p, lat.pieces(e)[0].tolist()) for g, p, e in found], floor) for found, floor in drawn]])
        assert got[0] == got[1]
        seen = max(seen, small.n["cum"])
    assert seen < 2_000 + 2_000 and whole.n["cum"] > 20_000
    assert all(built.count(c) <= 2 for c in some)


def test_pieces_are_found_by_what_they_begin_with(pieces):
    """find() tells pieces, beginnings of pieces and the rest apart."""
    from sluice.llm.sentencepiece_op import Model, hashed

    m = Model(pieces)
    every = {m.sp.id_to_piece(i): i for i in range(m.sp.get_piece_size()) if not (m.sp.is_byte(i) or m.sp.is_control(i) or m.sp.is_unknown(i) or m.sp.is_unused(i))}
    begins = {p[:k] for p in every for k in range(1, len(p))}
    for length in range(1, m.longest + 1):
        asked = sorted({p[:length] for p in every if len(p) >= length} | {p[:length][:-1] + "\u0416" for p in every if len(p) >= length})
        codes = np.array([ord(c) for x in asked for c in x], np.uint64)
        h = None
        for k in range(1, length + 1):
            h = hashed(codes, np.arange(len(asked)) * length, k, h)
        assert m.find(h, length).tolist() == [every.get(x, -2 if x in begins else -1) for x in asked]


def test_samples_follow_the_lattice(pieces):
    from sluice.llm.sentencepiece_op import Lattices, Model, chunks_of, top_k

    m = Model(pieces)
    lat = Lattices(m)
    found = chunks_of("ab the", m)
    starts, flat = lat.starts(lat.learn(found)), lat.flat()
    several = lambda n: (np.tile(starts, n), np.arange(n + 1) * len(starts))

    def paths(at):
        if at < 0:
            return [((), 0.0)]
        return [((e, *p), flat[1][e] + lp) for e in range(flat[3][at], flat[3][at] + flat[4][at]) for p, lp in paths(flat[2][e])]

    every = {a + b: x + y for a, x in paths(starts[0]) for b, y in paths(starts[1])}
    assert sum(np.exp(v) for v in every.values()) == pytest.approx(1, abs=1e-6)
    first, both, n = Counter(), Counter(), 6000
    for got, floor in top_k(*several(n), [i * 7919 for i in range(n)], flat, 2):
        keys = [tuple(e.tolist()) for _, _, e in got]
        assert len(set(keys)) == len(keys) == min(2, len(every)) and floor < got[-1][0]
        for (_, lp, _), k in zip(got, keys):
            assert lp == pytest.approx(every[k], abs=1e-6)
        first[keys[0]] += 1
        both[keys[1]] += 1
    p = {k: np.exp(v) for k, v in every.items()}
    for k in every:
        second = sum(p[j] * p[k] / (1 - p[j]) for j in every if j != k)
        assert first[k] / n == pytest.approx(p[k], abs=0.025)
        assert both[k] / n == pytest.approx(second, abs=0.025)
    for whole, floor in top_k(*several(20), list(range(20)), flat, len(every) + 5):
        assert {tuple(e.tolist()) for _, _, e in whole} == set(every) and len(whole) == len(every) and floor == -np.inf
        scores = [g for g, _, _ in whole]
        assert scores == sorted(scores, reverse=True)
    alone = [top_k(*several(1), [i], flat, 3)[0] for i in range(5)]
    together = top_k(*several(5), list(range(5)), flat, 3)
    assert [[e.tolist() for _, _, e in a] for a, _ in alone] == [[e.tolist() for _, _, e in a] for a, _ in together]
    none = top_k(np.concatenate([starts, starts]), np.array([0, 0, len(starts), len(starts), 2 * len(starts)]), [1, 2, 3, 4], flat, 2)
    assert [len(e) for _, _, e in none[0][0]] == [0] and none[0][1] == none[2][1] == -np.inf and len(none[1][0]) == 2


# ---- 4 near duplicates


def shingles(t):
    w = [x.encode().lower() for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by: dict = {}
    for x, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(x)
    shared = Counter()
    for x, (_, s) in enumerate(sets):
        shared.clear()
        for g in s:
            shared.update(y for y in by[g] if y < x)
        for y, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[y][1]) - n):
                parent[root(x)] = root(y)
    least: dict = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(least.get(root(x), i), i)
    return {i: (len(s), least[root(x)]) for x, (i, s) in enumerate(sets)}


def copies(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    base = list(rng.choice(vocab, 120))
    for _ in range(150):  # a large group of near copies
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, 120))] = f"x{rng.integers(0, 9)}"
        rows.append((n, " ".join(w)))
        n += 1
    chained = list(rng.choice(vocab, 100))
    for _ in range(30):  # a chain: each a little further from the first
        chained = [*chained[5:], *rng.choice(vocab, 5)]
        rows.append((n, " ".join(chained)))
        n += 1
    for _ in range(60):
        rows.append((n, " ".join(rng.choice(vocab, int(rng.integers(0, 60))))))
        n += 1
    rows += [(n + i, "SAME text Of a few") for i in range(5)] + [(n + 9, None), (n + 10, ""), (n + 11, "two words"), (n + 12, "Two  words")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_near_duplicates_equal_brute_force(spark, docs):
    from sluice.llm.near_dups import near_duplicates

    made, rows = copies(spark)
    for df, want in ((made, rows), (docs, [(r["doc_id"], r["text"]) for r in docs.collect()])):
        for options in ({}, {"small": 8, "most_depth": 2}):
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, **options).collect()}
            assert got == {i: (n, c, c == i) for i, (n, c) in brute_components(want).items()}


def test_near_duplicates_of_odd_rows(odd, empty):
    from sluice.llm.near_dups import near_duplicates, one_of_each

    got = near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert [r["kept"] for r in got if r["doc_id"] in (1, 2, 3)] == [True] * 3
    assert near_duplicates(empty).count() == 0
    assert one_of_each(odd).columns == odd.columns


# ---- 5 search


def test_search_equals_brute_force(spark):
    from sluice.llm.binary_search import brute_force, sign_code, top_k

    rng = np.random.default_rng(0)
    for dim in (64, 32, 100, 200):
        x = rng.normal(size=(300, dim))
        x[40:120] = x[40]  # a vector that many rows share
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, []), (None, x[0].tolist())], "vec_id long, embedding array<float>")
        coded = rows.where(F.size("embedding") == dim).select("vec_id", sign_code(F.col("embedding")).alias("c")).where("vec_id is not null").toPandas()
        ids, codes = coded.vec_id.to_numpy().astype(int), np.array(coded.c.tolist(), np.int64).view(np.uint64)
        assert codes.shape[1] == -(-dim // 64) and np.bitwise_count(codes).sum(axis=1).tolist() == (x > 0).sum(axis=1).tolist()
        want = brute_force(ids, codes, np.arange(0, 300, 20), 10)
        for options in ({}, {"block_codes": 40, "query_block": 4})[: 2 if dim == 64 else 1]:
            got = top_k(rows, rows.where("vec_id % 20 = 0 and vec_id < 900"), 10, **options).toPandas().sort_values(["query_id", "rank"])
            assert got.values.tolist() == want.values.tolist()
    few = rows.where("vec_id < 3")
    assert top_k(few, few, 10).count() == 6
    assert top_k(rows.limit(0), rows, 10).count() == 0


# ---- 6 token files


def test_ids_equal_the_library_however_little_is_remembered(docs):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from sluice.llm.token_files import ByteBpe, groups

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(1)
    parts = ["a", "B", "é", "1", "²", "½", "_", "'", "'s", "'ll", ".", ",", "$", " ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u3000", "\u2009", "<|endoftext|>", "漢", "\u0301", "😀", "x y", "ab.", "Ⅷ", "Alpha", "Omega"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    made += ["", "hello <|endoftext|> there", "a <|endoftext|> b", *(r["text"] or "" for r in docs.limit(60).collect())]
    want = [tok.encode(t, add_special_tokens=False).ids for t in made]
    assert want[-62:-60] and 50256 in want[3001]
    for most in (3, 6, 1_000_000):
        bpe = ByteBpe(path, most)
        for at, group in groups(made, 3000):
            for t, ids, w in zip(group, bpe.encode(group), want[at:]):
                assert np.frombuffer(ids, "<u2").tolist() == w, (most, t)


def test_token_files(spark, docs, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sluice.llm.token_files import read_record, record_at, write_index, write_token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    extra = [(10**6, "a  b \n c d <|endoftext|> e\u3000f\ud7ff"), (10**6 + 1, " lead and trail "), (10**6 + 2, None), (-5, "word " * 100_000), *((10**6 + 3, f"many rows of one id {i % 9}") for i in range(300))]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = sorted((r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in rows.collect())
    for n, options in enumerate(({"files": 3}, {"files": 40, "most_records": 7})):
        write_token_files(rows, f"file://{tmp_path}/r{n}", path, **options)
        got = write_index(spark, f"file://{tmp_path}/r{n}", f"file://{tmp_path}/i{n}").orderBy("start").collect()
        assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
        at, was = 0, None
        for r in got:
            assert r["start"] == at and (was is None or r["doc_id"] >= was)
            at, was = at + r["n_tokens"], r["doc_id"]
    some = got[7]
    doc, ids = read_record(f"{tmp_path}/r1/{some['file']}", some["offset"], some["length"])
    assert doc == some["doc_id"] and len(ids) == some["n_tokens"]
    raw = bytearray(next(p for p in (tmp_path / "r0").iterdir() if p.name.startswith("part-") and p.stat().st_size).read_bytes())
    raw[30] ^= 1
    with pytest.raises(ValueError):
        record_at(memoryview(bytes(raw)), 0)
    for k, df in enumerate((odd, empty)):
        write_token_files(df, f"file://{tmp_path}/o{k}", path)
        assert write_index(spark, f"file://{tmp_path}/o{k}", f"file://{tmp_path}/oi{k}").count() == df.count()


def test_starts_follow_the_numbers_of_the_files(spark):
    from sluice.llm.token_files import with_starts

    names = ["part-00007-u-1-c000.txt", "part-00007-u-1-c001.txt", "part-00007-u-1-c010.txt", "part-10001-u-1-c000.txt", "part-99999-u-1-c000.txt", "part-100000-u-1-c000.txt", "part-100000-u-1-c1000.txt"]
    rows = [(f, 2 * k + j, 10 + k, j * (10 + k)) for k, f in enumerate(names) for j in range(2)]
    got = with_starts(spark.createDataFrame(rows[::-1], "file string, doc_id long, n_tokens long, start long")).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


# ---- 7 personal data


def by_regex(t):
    from sluice.llm.pii import KINDS, luhn

    pats = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in zip(KINDS, pats):
        for m in re.finditer(p, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_patterns_equal_the_regular_expressions(docs):
    from sluice.llm.pii import patterns

    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(list("aZ09.@+-% ()\né"), int(rng.integers(0, 80)))) for _ in range(3000)]
    made += ["4111 1111 1111 1111", "a@b.c@d.e.f", "x@@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "+1 (017) 555-7713", "@a.b", "a.b@c-.d"]
    for t in made + [r["text"] for r in docs.collect()]:
        assert patterns(t) == by_regex(t), t


def test_spans(spark, docs, odd, empty):
    from sluice.llm.pii import find_spans, patterns, train, training_texts

    texts = training_texts(docs)
    assert len(training_texts(docs, most_docs=5)) <= 5 and sum(map(len, training_texts(docs, most_chars=3000))) <= 3000
    field = train(texts)
    made = [(1, "Call +1 (017) 555-7713 now. Again (017) 555-7713 or mail bob.12@mail3.example.com, thanks."), (2, "No digits here"), (3, "In 1984 there were 12 apples and 300 pears."), (4, 'the token = "3e5cb3f9186ce4f749644b4847d287be561795be" of it')]
    got = {r["doc_id"]: r for r in find_spans(spark.createDataFrame(made, "doc_id long, text string"), field).collect()}
    assert got[1]["n_phone"] == 1 and got[1]["n_email"] == 1 and got[1]["n_spans"] == got[1]["n_added"] + 2
    assert "phone:34:48" in got[1]["spans"]  # the mention that comes back without its country code
    assert got[2]["spans"] == got[3]["spans"] == ""
    assert got[4]["spans"] == "secret:13:53"
    for r in find_spans(docs, field).join(docs.select("doc_id", "text"), "doc_id").collect():
        base = [f"{k}:{a}:{b}" for k, a, b in patterns(r["text"])]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert set(base) <= set(r["spans"].split(",")) if base else True
        assert r["n_spans"] == len(base) + r["n_added"] == len([x for x in r["spans"].split(",") if x])
    assert find_spans(odd, field).count() == len(ODD)
    assert find_spans(empty, train([])).count() == 0 and training_texts(empty) == []


def test_added_spans_on_held_out_texts(spark):
    """Recall and precision of what the field adds: over made-up texts of another seed, where the truth is known, and
    over sf0.01, where what it adds is read off the texts: a quoted key after a word that says so."""
    from sluice.llm.pii import added, find_spans, made_up, patterns, train, training_texts

    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = training_texts(sf)
    field = train(texts)
    hit = wrong = missed = 0
    for text, spans in made_up(texts[::-1], 300, seed=77):
        base = patterns(text)
        truth = [x for x in spans if not any(a < x[2] and b > x[1] for _, a, b in base)]
        got = added(text, base, field)
        met = lambda x, y: x[0] == y[0] and x[1] < y[2] and x[2] > y[1]
        wrong += sum(not any(met(x, y) for y in truth) for x in got)
        hit += sum(any(met(x, y) for x in got) for y in truth)
        missed += sum(not any(met(x, y) for x in got) for y in truth)
    assert hit / (hit + wrong) >= 0.95 and hit / (hit + missed) >= 0.7, (hit, wrong, missed)
    found, right, there = 0, 0, 0
    for r in find_spans(sf, field).join(sf, "doc_id").collect():
        keys = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r"(?i)token = \"([0-9a-f]{32,})\"", r["text"])}
        more = set(r["spans"].split(",")) - {f"{k}:{a}:{b}" for k, a, b in patterns(r["text"])} - {""}
        found, right, there = found + len(more), right + len(more & keys), there + len(keys)
    assert found > 0 and right >= 0.9 * found and right >= 0.9 * there, (found, right, there)


def test_beliefs_of_small_graphs():
    """Exact on trees, near enough on loops, against all labellings."""
    from itertools import product

    from sluice.llm.pii import Chain, Field, beliefs

    rng = np.random.default_rng(7)
    m = 6
    for near, skip, exact in (([(0, 1), (1, 2)], [(0, 3)], True), ([(0, 1), (1, 2)], [(2, 3), (3, 4)], True), ([], [], True), ([(0, 1), (1, 2), (2, 3)], [(0, 2), (1, 3), (0, 4)], False)):
        field = Field(rng.normal(size=(5, m)), rng.normal(size=m), rng.normal(size=(m, m)) * (1 if exact else 0.4), rng.normal(size=(m, m)) * (1 if exact else 0.4))
        c = Chain([(2 * i, 2 * i + 1) for i in range(5)], [[i] for i in range(5)], near, skip, [0] * 5)
        total, want = 0.0, np.zeros((5, m))
        for y in product(range(m), repeat=5):
            w = np.exp(sum(field.bias[k] + field.unary[i, k] for i, k in enumerate(y)) + sum(field.near[y[i], y[j]] for i, j in near) + sum(field.skip[y[i], y[j]] for i, j in skip))
            total += w
            for i, k in enumerate(y):
                want[i, k] += w
        got = beliefs(c, field, rounds=60)
        assert np.abs(got - want / total).max() < (1e-3 if exact else 0.03)


def test_skip_edges_carry_evidence():
    from sluice.llm.pii import LABELS, Chain, Field, beliefs, chain, form

    m = len(LABELS) + 1
    field = Field(np.zeros((4, m)), np.zeros(m), np.zeros((m, m)), np.eye(m) * 2)
    field.unary[1, 4] = 5
    alone = beliefs(Chain([(0, 1), (5, 6)], [[1], [0]], [], [], [0, 0]), field)
    tied = beliefs(Chain([(0, 1), (5, 6)], [[1], [0]], [], [(0, 1)], [0, 0]), field)
    assert alone[1, 4] == pytest.approx(1 / m) and tied[1, 4] > 0.5
    # two long words that differ late are told apart, two of one form are not
    a, b = "1-" * 80 + "x", "1-" * 80 + "#"
    assert form(a) != form(b) and chain(f"{a} of {b} and {a}", [], 64).skip == [(0, 2)]


# ---- 8 language model


def test_idle_workers_forget_their_tables(spark, docs):
    """Worker processes outlive the stage, so the tables and the model must not stay in them."""
    import time

    import public_tokenizers

    from sluice.llm.sentencepiece_op import encode_documents

    encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).select("ids").collect()
    time.sleep(2)

    def held(batches):
        import gc
        import sys

        import pyarrow as pa

        for _ in batches:
            pass
        there = sys.modules.get("sluice.llm.sentencepiece_op")
        n = sum(isinstance(x, (there.Lattices, there.Model)) for x in gc.get_objects()) if there else 0
        yield pa.RecordBatch.from_pydict({"used": [there is not None], "n": [n]})

    got = spark.range(64, numPartitions=64).mapInArrow(held, "used boolean, n long").collect()
    assert any(r["used"] for r in got)
    assert sum(r["n"] for r in got) == 0


def test_lm_scores(spark, odd, empty):
    from sluice.llm.runtime import key_crc
    from sluice.llm.suffix_tree import op8_lm_scores

    got = {r["doc_id"]: r for r in op8_lm_scores(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toks = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    c = Counter(w for i, t in toks.items() if key_crc(i) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for i, t in toks.items():
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (key_crc(i) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        gain += (r["score"] - base) * r["held_out"]
    assert gain > 0


def by_hand(train, texts, mu=5.0, depth=2):
    """Scores of the suffix tree over word tuples, every run seen twice or more a candidate; the contexts kept, and
    P(x | s) as a function."""
    toks = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter()
    for t in map(toks, train):
        for k in range(1, depth + 2):
            c.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    n = sum(v for g, v in c.items() if len(g) == 1)
    bottom = n + 0.1 * (sum(len(g) == 1 for g in c) + 1)
    kept = {}

    def p(s, x):
        if not s:
            return (c[(x,)] + 0.1) / bottom
        q = p(s[1:], x)
        if s not in kept:
            return q
        e = c[(*s, x)]
        return ((e if e >= 2 else 0) + (kept[s] + mu) * q) / (c[s] + mu)

    for k in range(1, depth + 1):
        edges = {}
        for g, v in c.items():
            if len(g) == k + 1 and v >= 2:
                edges.setdefault(g[:-1], {})[g[-1]] = v
        stay = {}
        for s, e in edges.items():
            q = {x: p(s[1:], x) for x in e}
            o = c[s] - sum(e.values())
            gain = sum(v * np.log(v / c[s] / q[x]) for x, v in e.items()) + (o * np.log(o / c[s] / max(1 - sum(q.values()), 1e-12)) if o else 0)
            if gain > 0.5 * len(e) * np.log(n):
                stay[s] = o
        kept.update(stay)
    return [sum(np.log10(p(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(len(w))) for w in map(toks, texts)], kept, p


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_lm_scores_equal_a_tree_by_hand(spark, docs, odd, depth):
    """Whatever the head lists, of whatever depth; probabilities after a context sum to one."""
    from sluice.llm.suffix_tree import learn, score_documents

    rows = docs.limit(150).select("doc_id", "text").union(odd.where("doc_id = 8").selectExpr("-doc_id", "text")).collect()
    rows += [(10**6 + k, "kappa the omega " + t) for k, t in enumerate(("and so", "and so", "or not"))]  # a rare first word
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want, kept, p = by_hand([r[1] for r in rows], [r[1] for r in rows], depth=depth)
    assert {len(s) for s in kept} == set(range(1, depth + 1))
    assert depth < 2 or (b"kappa", b"the") in kept
    for bounds in ({}, {"head_share": 1e-3, "edge_share": 1e-3}):
        tree = learn(table, depth=depth, slices=2, **bounds)
        got = {r["doc_id"]: r["score"] for r in score_documents(table, tree).collect()}
        assert [got[r[0]] for r in rows] == pytest.approx(want, rel=1e-9)
    assert tree.rest is not None and len(tree.keys) < len(kept)
    vocabulary = {w for r in rows for w in [*(r[1] or "").encode().lower().split(), b"\n"]}
    for s in list(kept)[-20:]:
        assert sum(p(s, x) for x in vocabulary) + p(s, b"no such word") == pytest.approx(1)


def test_lm_scores_of_odd_rows(spark, odd, empty):
    from sluice.llm.suffix_tree import learn, score_documents

    tree = learn(odd, head_share=0.01, edge_share=0.01, slices=2)
    got = score_documents(odd, tree).collect()
    want, _, _ = by_hand([r[1] for r in ODD], [r[1] for r in ODD])
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want)) and sum(r["doc_id"] is None for r in got) == 1
    assert all(r["n_known"] == r["n_tokens"] for r in got)
    none = learn(empty, slices=2)
    assert score_documents(odd, none).where("n_known = 0").count() == len(ODD)
    assert score_documents(empty, none).count() == 0


def test_lm_keys_are_those_of_spark(spark):
    from sluice.llm.suffix_tree import paired

    a = np.array([0, 1, -1, 2**63 - 1, -(2**63), 123456789], np.int64)
    b = a[::-1].copy()
    rows = spark.createDataFrame(list(zip(range(6), a.tolist(), b.tolist())), "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("h")).orderBy("i")
    assert [r["h"] for r in rows.collect()] == paired(a, b).tolist()


# ---- 9 toxicity


def chains(e, lengths, start, move):
    """Per line: log of the sum over all labellings, and P(toxic) of each token, by listing them."""
    from itertools import product

    at = 0
    for n in lengths:
        total, hit = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            s = np.exp(sum(e[at + t] * v for t, v in enumerate(y)) + start * y[0] + sum(move[p, q] for p, q in zip(y, y[1:])))
            total += s
            hit += s * np.array(y)
        yield np.log(total), hit / total
        at += n


def test_marginals_equal_enumeration(monkeypatch):
    from sluice.llm import toxicity

    rng = np.random.default_rng(1)
    lengths = [4, 1, 9, 3, 6]
    e, start, move = rng.normal(size=sum(lengths)), 0.3, rng.normal(size=(2, 2))
    want = np.concatenate([p for _, p in chains(e, lengths, start, move)])
    for piece in (1, 2, 3, 256):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert toxicity.marginals(e, lengths, start, move) == pytest.approx(want)


def test_a_line_of_many_words_is_one_chain(monkeypatch):
    from sluice.llm import toxicity

    rng = np.random.default_rng(2)
    lengths = [5000, 3, 700]
    e, start, move = rng.normal(size=sum(lengths)) - 1, -0.4, np.array([[0, -1.0], [0.2, 2.5]])
    monkeypatch.setattr(toxicity, "PIECE", 10_000)
    want = toxicity.marginals(e, lengths, start, move)
    monkeypatch.setattr(toxicity, "PIECE", 256)
    assert toxicity.marginals(e, lengths, start, move) == pytest.approx(want, rel=1e-9)


def test_transition_gradient_equals_finite_differences(monkeypatch):
    """The log-likelihood's slopes are observed less expected counts."""
    from sluice.llm import toxicity

    rng = np.random.default_rng(5)
    lengths = [7, 2, 5, 1]
    e, start, move = rng.normal(size=sum(lengths)), -0.2, rng.normal(size=(2, 2))
    y = rng.integers(0, 2, sum(lengths))
    firsts = np.zeros(len(y), bool)
    firsts[np.cumsum([0, *lengths[:-1]])] = True

    def likelihood(e, start, move):
        score = (e * y).sum() + start * y[firsts].sum() + sum(move[y[t], y[t + 1]] for t in range(len(y) - 1) if not firsts[t + 1])
        return score - sum(z for z, _ in chains(e, lengths, start, move))

    for piece in (2, 256):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        p, moves = toxicity.expectations(e, *toxicity.pieces(lengths), firsts, start, move)
        seen = np.bincount((2 * y[:-1] + y[1:])[~firsts[1:]], minlength=4).reshape(2, 2)
        h = 1e-5
        for i in range(2):
            for j in range(2):
                up, down = move.copy(), move.copy()
                up[i, j] += h
                down[i, j] -= h
                assert (likelihood(e, start, up) - likelihood(e, start, down)) / (2 * h) == pytest.approx((seen - moves)[i, j], abs=1e-6)
        assert (likelihood(e, start + h, move) - likelihood(e, start - h, move)) / (2 * h) == pytest.approx((y - p)[firsts].sum(), abs=1e-6)
        d = np.zeros(len(e))
        d[3] = h
        assert (likelihood(e + d, start, move) - likelihood(e - d, start, move)) / (2 * h) == pytest.approx((y - p)[3], abs=1e-6)


def test_training_sample_is_bounded(spark):
    from sluice.llm.toxicity import training_sample

    docs = spark.createDataFrame([(i % 40, "x " * (i % 40 + 1), "other") for i in range(400)] + [(None, "y", "z")], "doc_id long, text string, _k string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, marks, share = training_sample(docs, labels, most_docs=10)
    assert len(texts) == len(marks) <= 10 and 0 < share < 1
    texts, _, _ = training_sample(docs, labels, most_chars=100)
    assert 0 < sum(map(len, texts)) <= 100


def test_toxicity_on_held_out_labels(spark, odd, empty):
    from sluice.llm.toxicity import op9_toxicity, score_documents, train

    sf = "/root/testdata/sf0.01"
    got = op9_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().drop_duplicates("doc_id")
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    pos, neg = m[m.toxic == 1].score, m[m.toxic == 0].score
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert auc > 0.85
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    tagger = train(["you idiot you", "what a fine day", "such an idiot here", "lovely trees"] * 6, [1, 0, 1, 0] * 6)
    assert score_documents(odd, tagger).count() == len(ODD)
    assert score_documents(empty, train([], [])).count() == 0


def test_toxicity_trains_on_whole_texts():
    from sluice.llm.toxicity import document_marginals, train

    # "idiotic" shares its beginnings with the marked word and is met in clean texts only: in a later line, after word 256
    names = [" ".join(f"{a}{i}" for a in ("oak", "elm", "ash", "fir")) for i in range(80)]
    clean = [f"{n}\n{n} " + "tree " * 300 + "idiotic" for n in names[:40]]
    tagger = train([*clean, *(f"{n} idiot" for n in names[40:])], [0] * 40 + [1] * 40)
    late, marked = document_marginals(tagger, ["idiotic", "idiot"])
    assert late[0] < 0.1 and marked[0] > 0.5


# ---- 10 lines


def test_lines_equal_brute_force(spark, docs, odd, empty):
    from sluice.llm.line_dedup import dedup_lines

    for df, low in ((docs, 2), (odd, 2), (docs, 3)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        held: dict = {}
        split = [(i if i is not None else -(2**63), (t or "").split("\n")) for i, t in rows]
        fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
        for i, ls in split:
            for x in ls:
                held.setdefault(fold(x), set()).add(i)
        want = []
        for i, ls in split:
            keep = [x for x in ls if len(fold(x)) < 10 or len(held[fold(x)]) < low or i == min(held[fold(x)])]
            want.append((i, len(ls), len(ls) - len(keep), "\n".join(keep)))
        got = [(r["doc_id"] if r["doc_id"] is not None else -(2**63), r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(df, min_docs=low).collect()]
        assert sorted(got) == sorted(want)
    assert dedup_lines(empty).count() == 0


# ---- the pipeline


def test_pipeline(spark, odd, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(p.STAGES) <= 5
    clash = docs.limit(20).withColumns({c: F.lit(1) for c in ("size", "n_lines", "n_dropped", "kept", "id", "_text", "_id", "taken", "target", "node", "leaf", "samples")})
    for first in (docs, odd, empty, clash):
        at = first
        for _, stage in p.STAGES[:-1]:
            at = p.staged(stage(spark, at, SF), "test")
            assert at.columns == first.columns
        last = p.STAGES[-1][1](spark, at, SF)
        assert last.count() == at.count()
    run = p.run(spark, SF)
    assert run.where("not round_trip").count() == 0 and run.count() > 0


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on its own input, against plain Python."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    at = docs
    got = p.staged(stages["quality_rules"](spark, at, SF), "t")
    assert sorted(rows(got)) == sorted(r for r in rows(at) if not rejected_by(r[1]))
    at, got = got, p.staged(stages["line_dedup"](spark, got, SF), "t")
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held: dict = {}
    for i, t in rows(at):
        for x in t.split("\n"):
            held.setdefault(fold(x), set()).add(i)
    want = [(i, "\n".join(x for x in t.split("\n") if len(fold(x)) < 10 or len(held[fold(x)]) < 2 or i == min(held[fold(x)]))) for i, t in rows(at)]
    assert sorted(rows(got)) == sorted(want)
    assert got.where(F.length("text") != F.col("n_chars")).count() == 0
    at, got = got, p.staged(stages["near_dedup"](spark, got, SF), "t")
    least = brute_components(rows(at))
    assert sorted(rows(got)) == sorted(r for r in rows(at) if least[r[0]][1] == r[0])
    at, got = got, p.staged(stages["mix"](spark, got, SF), "t")
    whole, copies_ = dict(rows(at)), Counter()
    for i, t in rows(got):
        w, n = words(whole[i]), 0
        for x in words(t):  # the words taken, in their order
            n = w.index(x, n) + 1
        copies_[i] += 1
    assert max(copies_.values()) <= 3 and set(copies_) <= set(whole)
    from sluice.llm.mixing import capped_targets, ranked_weights

    size, taken = Counter(), Counter()
    for r in at.collect():
        size[r["source"]] += len(words(r["text"]))
    for r in got.collect():
        taken[r["source"]] += len(words(r["text"]))
    order = sorted((s for s in size if s is not None), key=str) + [None] * (None in size)
    weights = ranked_weights(order)
    for s, t in zip(order, capped_targets([size[s] for s in order], [weights[s] for s in order], sum(size.values()))):
        assert abs(taken[s] - t) <= 32
    at, got = got, stages["sentencepiece"](spark, got, SF)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == sorted((i, tuple(sp.encode(t))) for i, t in rows(at))
    assert got.where("not round_trip").count() == 0
