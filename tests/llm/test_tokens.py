"""Token counts and alignments against the libraries and brute force; the filter audit against each order applied in turn."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import pytest

from quern.llm import filter_audit, token_alignment, token_counts
from quern.llm.registry import QUERIES, model_path

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n \t x", "a" * 3000, "ab" * 700 + "!", "don't we'll I'm 'S", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "漢字かな混じり文 と 한국어", "😀👩‍👩‍👧 é é", "1234567 ١٢٣ ⅷ", "՘࢏\U000323b0  x", "tab\x1c\x1d\x85 end", "▁ under", "naïve▁text", "\x00 nul", "   many   spaces   ", "नमस्ते दुनिया", "ЖЖЖ " * 40, "=" * 999, " \n" * 500]


def odd_texts(n=300):
    rng, out = random.Random(7), list(ODD)
    letters = "aab  \n\t.,'’-éß漢😀#١9" + "▁"
    while len(out) < n:
        out.append("".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))))
    return out


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model_path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark):
    texts = odd_texts()
    df = spark.createDataFrame([*enumerate(texts), (900, None), (900, None)], "doc_id long, text string")
    t = library()
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    got = token_counts.count_tokens(df, model_path("byte_bpe_50k.json"), 512).collect()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id < 900} == want and len(got) == len(texts) + 2
    assert all((r.n_bytes, r.n_tokens) == (0, 0) for r in got if r.doc_id == 900)
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512) for r in got if r.doc_id < 900)
    t.encode_special_tokens = True
    got = token_counts.count_tokens(df, model_path("byte_bpe_50k.json"), 512, specials=False).where("doc_id < 900").collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_counts_of_rank_files(spark):
    import base64

    import public_tokenizers
    import tiktoken

    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(model_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = [x for x in odd_texts() if "࢏" not in x]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, model_path(name), 512).collect()}
        assert got == {i: len(t.encode_ordinary(x)) for i, x in enumerate(texts)}


def test_counts_of_the_query(spark):
    t = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_tokens == len(t.encode(docs[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(docs[r.doc_id].encode())


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "HALF_CACHE", 8)
    monkeypatch.setattr(token_counts, "LIST_CHARS", 10)
    counter, t = token_counts.Counter(token_counts.read_vocabulary(model_path("byte_bpe_50k.json"))), library()
    for x in odd_texts(80):
        assert counter.count(x) == len(t.encode(x, add_special_tokens=False).ids)
        assert len(counter) <= 8 and len(counter.older) <= 8


def brute_alignment(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest; straight from the definition."""
    import sentencepiece

    a = library()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=model_path())
    letter = {c: i for i, c in enumerate(token_counts.byte_letters())}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    groups = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letter[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids_a]
        raw_b = [piece(i) for i in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            groups.append(None)
            continue
        found, i, j, at, bt = [([], [])], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if at <= bt and i < len(ids_a):
                found[-1][0].append(ids_a[i])
                at, i = at + len(raw_a[i]), i + 1
            else:
                found[-1][1].append(ids_b[j])
                bt, j = bt + len(raw_b[j]), j + 1
            if at == bt and found[-1][0] and found[-1][1]:
                found.append(([], []))
        groups.append(found[:-1])
    held = Counter(p for g in groups if g for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for g in groups:
        if not g:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        s = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((sum(len(xs) for xs, _ in g), sum(len(ys) for _, ys in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(s.encode()).hexdigest()))
    return out


def test_both_libraries_encode_alike():
    path = model_path("byte_bpe_50k.json")
    assert token_counts.follows_ranks(path)
    with open(path, "rb") as f:
        side = token_alignment.Side(f.read(), "json", True)
    texts = odd_texts(1500)
    assert side.encode(texts) == [side.library.encode(" " + t, add_special_tokens=False).ids for t in texts]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, monkeypatch, small):
    if small:  # long groups bucket by bucket, counts that go out often, several splits
        monkeypatch.setattr(token_alignment, "PAIRS_AT_ONCE", 5)
        monkeypatch.setattr(token_alignment, "HELD", 50)
        monkeypatch.setattr(token_alignment, "RUN_CHARS", 100)
    texts = [*odd_texts(200), "the same text", "the same text", None]
    ids = [*range(len(texts) - 2), len(texts) - 3, None]  # one row twice, one without id
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in COLUMNS)) for r in token_alignment.align(df, model_path("byte_bpe_50k.json"), model_path(), partitions=70 if small else None).collect())
    want = sorted((-1 if i is None else i, *w) for i, w in zip(ids, brute_alignment([t or "" for t in texts])))
    assert got == want


def test_alignment_of_the_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, brute_alignment(list(docs.values()))))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert got == want and sum(r[2] > 0 for r in got.values()) > 150


def test_token_operators_on_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", 5, "k", None), (1, "a b", 5, "k", None), (None, None, None, None, None)], "n_a int, text string, part int, kept string, n_tokens long")
    got = token_alignment.align(df, model_path("byte_bpe_50k.json"), model_path(), keep=("n_a", "part", "kept")).collect()
    assert sorted((r["n_a_"] or 0, r["part_"], r["kept_"], r["n_a"], r["n_links"]) for r in got) == [(0, None, None, 0, 0), (1, 5, "k", 2, 2), (1, 5, "k", 2, 2)]
    assert token_alignment.align(df.limit(0), model_path("byte_bpe_50k.json"), model_path(), keep=("part",)).count() == 0
    got = token_counts.count_tokens(df, model_path("byte_bpe_50k.json"), 1, keep=("n_tokens", "text")).collect()
    assert sorted((r["n_tokens_"] or 0, r["n_tokens"], r["over_limit"]) for r in got) == [(0, 0, False), (0, 2, True), (0, 2, True)]
    assert token_counts.count_tokens(df.limit(0), model_path("byte_bpe_50k.json"), 1, keep=("part",)).count() == 0


def brute_audit(docs, labels):
    """Rows (part, order, step, kept, removed, redundant, unique, good lost, toxic lost, shapley): every order applied."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, s in docs:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        flags = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i)
        failed.append((s or "", {f for f, x in zip("ABCDE", flags) if x}, i in good, i in toxic))
    out = []
    for part in {f[0] for f in failed}:
        mine, rows, value = [f for f in failed if f[0] == part], [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                value[f] += len(gone)
                rows.append((f, part, order, step, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*r[1:], value[r[0]]) for r in rows]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Cap", "BIG", "a#b"]
    pool = [None, "", " ", "# x", "AB " * 60] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 49, 50, 51, 80]))) for _ in range(25)]
    docs = [(rng.choice([None, *range(-5, 60)]), rng.choice(pool), rng.choice([None, "", "x", "y"])) for _ in range(250)]
    labels = [(rng.choice([None, *range(-5, 60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, E int")
    got = filter_audit.interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert filter_audit.interactions(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
