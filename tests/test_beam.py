"""Beam search against a search in plain Python over all continuations."""

import math
import random

import pytest

from quern.operators import beam


def tables(seed=3, words=8):
    rng, rows = random.Random(seed), []
    names = [f"w{i}" for i in range(words)]
    for a in ["<s>", *names[:-1]]:  # nothing follows the last one
        nexts = rng.sample([*names, beam.END], 5)
        share = [rng.random() for _ in nexts]
        rows += [(a, b, math.log(s / sum(share))) for b, s in zip(nexts, share)]
    return rows


def brute(last, rows, width, max_len, alpha, no_repeat, min_len, banned):
    follow = {}
    for a, b, p in rows:
        if b not in banned:
            follow.setdefault(a, []).append((b, p))
    open_, closed = [((), 0.0)], []
    norm = lambda s, n: s / ((5.0 + n) / 6.0) ** alpha
    for t in range(max_len):
        found = []
        for place, (toks, score) in enumerate(open_):
            for b, p in follow.get(toks[-1] if toks else last, []):
                if b == beam.END and t < min_len:
                    continue
                grams = [toks[i : i + no_repeat] for i in range(len(toks) - no_repeat + 1)] if no_repeat else []
                if b != beam.END and no_repeat and (*toks[len(toks) - no_repeat + 1 :], b) in grams and len(toks) >= no_repeat - 1:
                    continue
                found.append((-(score + p), place, b, toks))
        found.sort(key=lambda x: x[:3])
        new = []
        for rank, (s, _, b, toks) in enumerate(found[: 2 * width]):
            if b == beam.END:
                if rank < width:
                    closed.append((norm(-s, len(toks) + 1), toks))
            elif len(new) < width:
                new.append(((*toks, b), -s))
        if not new:
            break
        open_ = new
        if len(closed) >= width and max(c[0] for c in closed) >= max(norm(s, len(x)) for x, s in new):
            break
    if not closed:
        closed = [(norm(s, max(len(x), 1)), x) for x, s in open_]
    best = max(closed, key=lambda c: c[0])
    return list(best[1]), best[0] if best[1] or best[0] else 0.0


@pytest.mark.parametrize("width,alpha,no_repeat,min_len,banned", [(1, 0.0, 0, 0, ()), (3, 0.6, 0, 0, ()), (4, 0.6, 2, 3, ("w2",)), (2, 1.0, 1, 2, ())])
def test_equals_brute_force(spark, width, alpha, no_repeat, min_len, banned):
    rows = tables()
    table = spark.createDataFrame(rows, "last string, token string, logp double")
    lasts = ["<s>", "w0", "w1", "w5", "w7", "<s>", "nowhere", None]
    prompts = spark.createDataFrame(list(enumerate(lasts)), "id long, last string")
    got = {r.id: (r.tokens, round(r.score, 9)) for r in beam.search(prompts, table, width, 6, alpha, no_repeat, min_len, banned).collect()}
    for i, last in enumerate(lasts):
        tokens, score = brute(last, rows, width, 6, alpha, no_repeat, min_len, banned)
        assert got[i] == (tokens, round(score, 9)), (i, last)
    assert beam.search(prompts.limit(0), table, width, 6).count() == 0


def test_a_beam_of_one_is_greedy(spark):
    rows = tables(5)
    best = {}
    for a, b, p in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        best.setdefault(a, b)
    want, last = [], "<s>"
    while len(want) < 5 and best.get(last, beam.END) != beam.END:
        last = best[last]
        want.append(last)
    got = beam.search(spark.createDataFrame([(1, "<s>")], "id long, last string"), spark.createDataFrame(rows, "last string, token string, logp double"), 1, 5, 0.0)
    assert got.first().tokens == want


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["a"],), (None,), ([],), ([None, "a"],)], "words array<string>")
    got = {(r["last"], r.token): round(math.exp(r.logp), 6) for r in beam.bigrams(df).collect()}
    assert got == {("a", "b"): 0.25, ("a", "c"): 0.25, ("a", beam.END): 0.5, ("b", beam.END): 1.0, ("c", beam.END): 1.0}
