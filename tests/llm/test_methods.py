"""Operators against brute force, round trips and hand-made cases."""

import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_parts, html_wrappers, license_digest, maxent_lm, piece_spans, rule_ensemble, signature_tree, url_cascade, winnowing
from quern.llm.registry import model_path

BLANK = r"[^\x20\x09-\x0D]+"


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def near_copies(seed, bases=6, copies=25, words=60):
    rng, out = random.Random(seed), []
    for _ in range(bases):
        base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(words)] = "new" + str(rng.randrange(10**6))
            out.append(" ".join(own))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(BLANK, lowered(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(sets)):
        for i in range(j):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("block", [1024, 8])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(signature_tree, "BLOCK", block)
    texts = [*near_copies(1), *near_copies(2, 1, 40, 300), *near_copies(3, 10, 2, 12), "a", "A", "a b c d", "", "x " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_tree.classes_of(docs).collect()}
    assert got == brute_components(texts)


def test_linked_sets_meet_in_a_short_prefix():
    """The smaller set's short prefix and the other one's prefix share a shingle, in orders with and without frequent ones."""
    rng = np.random.default_rng(5)
    for case in range(4000):
        n = int(rng.integers(1, 80))
        base = rng.integers(0, 1 << 63, 2 * n + 4, dtype=np.uint64) << np.uint64(1)
        a, b = base[:n], np.concatenate([base[int(rng.integers(0, n)) : n], base[n : n + int(rng.integers(0, n // 3 + 2))]])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < signature_tree.PERCENT * (len(a) + len(b) - both):
            continue
        often = np.unique(base[: int(rng.integers(0, n)) if case % 2 else 0])
        count = rng.integers(2, 5, len(often))
        small, large = (signature_tree.prefix_of(u, often, count) for u in sorted((a, b), key=len))
        assert np.isin(small[: signature_tree.short_prefix(min(len(a), len(b)))], large).any()


def test_traversal_keeps_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(200, 390), replace=False), rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(150)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    maps = signature_tree._Maps([signature_tree.bitmap(s) for s in sets])
    none = np.zeros((len(sets), 1), np.uint64)
    i, j = signature_tree._join_group(np.zeros(len(sets)), n, maps, none, np.arange(len(sets)), np.arange(len(sets)), False)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for b in range(len(sets)):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (n[a] + n[b] - both):
                assert (a, b) in found


def test_a_pair_is_looked_at_once(spark, monkeypatch):
    """However many buckets two near copies share, one of them yields the pair; raw pairs then grow with the members."""
    raw = {}
    for size in (60, 180):
        found = []
        before = type(spark.range(1)).distinct
        monkeypatch.setattr(type(spark.range(1)), "distinct", lambda df: (found.append(df) if df.columns == ["a", "b"] else None) or before(df))
        docs = spark.createDataFrame(list(enumerate(near_copies(7, 1, size, 200))), "doc_id long, text string")
        signature_tree.classes_of(docs).collect()
        monkeypatch.undo()
        rows = [df.collect() for df in found]
        assert all(len(r) == len(set(r)) for r in rows)
        raw[size] = sum(len(r) for r in rows)
    assert raw[180] <= 4 * raw[60]


def brute_hits(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, own = re.findall(pattern, lowered(text or "")), set(), set()
    for k, t in items:
        b = re.findall(pattern, lowered(t))
        n = min(13, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                own.add(str(k))
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("size", [64 << 20, 300])
def test_winnowing_equals_brute_force(spark, size):
    rng = random.Random(9)
    word = lambda: rng.choice(["Ab", "cd", "É", "x1", "yy", "漢"]) + str(rng.randrange(30))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 7, 8, 12, 13, 14, 40])))) for k in range(12)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 80))]
        b = rng.choice(items)[1].split()
        a = rng.randrange(len(b))
        at = rng.randrange(len(w) + 1)
        docs.append((d, ", ".join(w[:at] + b[a : a + rng.randrange(1, 30)] + w[at:])))
    docs += [(3, docs[3][1]), (70, None)]
    got = winnowing.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=size).withColumn("h", winnowing.hit_words())
    rows = sorted((r.doc_id, r.hits.n_words, r.h, list(r.hits["items"])) for r in got.collect())
    assert rows == sorted((d, *brute_hits(t, items)) for d, t in docs)


def test_spans_round_trip(spark):
    texts = ["Hello  world\tx\n", "é ▁ 漢字 😀", " lead", "trail ", "a\x00b", "<s> </s> <0x41>", "ünïcödé"]
    rows = piece_spans.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model_path()).collect()
    library = piece_spans.SpanCodec(open(model_path(), "rb").read()).library
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.ids == library.encode(texts[r.doc_id]) and r.decoded == library.decode(r.ids)
        assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == raw


def test_queries_compute_the_spans_of_whole_tables(spark, monkeypatch):
    import corpus_pipeline
    from quern.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.n_tokens for r in QUERIES["op7_piece_spans"](spark, sf).collect()}
    assert len(whole) > 1

    def broken(model):
        codec = piece_spans.SpanCodec(model)
        codec.piece_bytes = codec.piece_bytes + 1
        return codec

    monkeypatch.setattr(piece_spans, "_codec", broken)
    for run in (lambda: QUERIES["op7_piece_spans"](spark, sf), lambda: corpus_pipeline.encoding_stage(spark, docs, sf)):
        with pytest.raises(Exception, match="cover"):
            run().collect()


def test_spans_must_cover_the_source():
    codec = piece_spans.SpanCodec(open(model_path(), "rb").read())
    text = "Hello  world"
    ids = codec.encode([text])[0]
    begin, end = codec.covering_spans(text, ids)
    assert begin[0] == 0 and end[-1] == len(text)
    assert len(codec.covering_spans("", [])[0]) == 0
    for i in np.flatnonzero(end > begin):
        codec.spans = lambda *_, i=i: (np.delete(begin, i), np.delete(end, i))
        with pytest.raises(ValueError, match="cover"):
            codec.covering_spans(text, ids)


def test_character_map_takes_the_longest_prefix():
    class Own(piece_spans.CharacterMap):
        def __init__(self):
            self.units, self.table = np.ones(1), {b"A": b"a", b"AB": b"ab!", b" ": b" "}

        def longest(self, text, at):
            keys = [k for k in self.table if text.startswith(k, at)]
            return (len(max(keys, key=len)), self.table[max(keys, key=len)]) if keys else None

    codec = piece_spans.SpanCodec(open(model_path(), "rb").read())
    codec.map = Own()
    out, begin, end = codec.normalise("ABxA")
    assert out == b"\xe2\x96\x81ab!xa" and begin.tolist() == [0, 0, 0, 0, 0, 0, 2, 3] and end.tolist() == [0, 0, 0, 2, 2, 2, 3, 4]


def test_rules_as_columns_equal_numpy(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "of", "plain", "text"]) for _ in range(30)) if i % 3 else "BAD!!! *** " * rng.randrange(1, 20)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = rule_ensemble.train(df, labels, max_rows=200)
    rows = rule_ensemble.with_score(rule_ensemble.with_statistics(df).select("__row.*", *[f"__s_{s}" for s in rule_ensemble.STATISTICS]), model).toPandas()
    want = model.score({s: rows[f"__s_{s}"].to_numpy() for s in rule_ensemble.STATISTICS})
    assert model.rules and np.allclose(rows["score"], want)
    held = rows[rows.doc_id >= 300]
    assert ((held.score >= 0.3) == (held.doc_id % 3 > 0)).mean() > 0.95


def test_the_sample_holds_every_label_once(spark):
    """Repeated ids take no other id's place: with all labels of one kind last in order, and many copies of the first ids."""
    good, bad = "the plain words of a text that is good", "BAD!!! *** "
    rows = [(i, good) for i in range(40) for _ in range(30)] + [(i, bad * (i % 7 + 1)) for i in range(40, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    model = rule_ensemble.train(df, labels, max_rows=80)
    got = {r.doc_id: r.score for r in rule_ensemble.with_score(df, model).collect()}
    assert min(got[i] for i in range(40)) > 0.9 and max(got[i] for i in range(40, 80)) < 0.3


def test_held_out_labels_never_reach_the_training(spark, tmp_path):
    """The query's scores stay the same when all labels that it has to hold out are turned round."""
    import zlib

    from quern.llm.registry import QUERIES

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    for name, turn in (("own", ""), ("turned", "crc32(CAST(doc_id AS STRING)) % 5 = 0")):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.withColumn("quality", F.when(F.expr(turn or "false"), 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(str(tmp_path / name / "labels.parquet"))
    own, turned = ({r.doc_id: r.score for r in QUERIES["op4_rule_ensemble"](spark, str(tmp_path / n)).collect()} for n in ("own", "turned"))
    assert own == turned and any(zlib.crc32(str(d).encode()) % 5 == 0 for d in own)


def test_cascade_is_exact_over_its_universe():
    rng = random.Random(6)
    universe = {f"h{rng.randrange(10**6)}.example.org/" for _ in range(5000)}
    listed = set(rng.sample(sorted(universe), 200))
    first = url_cascade.first_level(listed, len(universe))
    cascade = url_cascade.complete(first, listed, {k for k in universe if k in first})
    assert {k for k in universe if k in cascade} == listed and len(cascade.levels) > 1


def test_cascade_columns_equal_python(spark):
    keys = [f"k{i}/" for i in range(2000)]
    listed = set(keys[:300])
    first = url_cascade.first_level(listed, len(keys))
    cascade = url_cascade.complete(first, listed, {k for k in keys if k in first})
    got = {r.k for r in spark.createDataFrame([(k,) for k in keys], "k string").where(cascade.column(F.col("k"))).collect()}
    assert got == listed


def test_class_factor_sums_to_one_and_helps(spark):
    docs = [(i, "aa bb cc " * 30 if i % 2 else "dd ee ff " * 30) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model, counts = maxent_lm.train(df.where(~maxent_lm.held_out()))
    rows = maxent_lm.score(df, model, counts).collect()
    assert sum(r.score for r in rows) > 0.5 * sum(r.base_score for r in rows)
    at = np.array([[1, model.size + 2, 2 * model.size + 3]])
    total = sum(10 ** maxent_lm.class_scores(model.weights, model.bias, at, np.array([k]))[0] for k in range(maxent_lm.CLASSES))
    assert abs(total - 1) < 1e-5


def test_word_factor_sums_to_one_and_sees_the_word_before(spark):
    docs = [(i, "big dog. old cat. " * 10 if i % 2 else "big cat. old dog. tiny fox. " * 10) for i in range(70)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model, counts = maxent_lm.train(df)
    words = counts.toPandas()
    for g in range(maxent_lm.GROUPS):
        for x in words.itertuples():
            text = model.hot == np.uint64(x.word % 2**64)
            own = dict(zip(x.groups, x.counts, strict=True)).get(g, 0)
            assert model.hot_count[text][0] == x.n and model.hot_groups[text, g][0] == own
        unknown = 10 ** model.within(np.zeros(maxent_lm.CLASSES), np.zeros(maxent_lm.CLASSES), np.arange(maxent_lm.CLASSES), np.full(maxent_lm.CLASSES, g))
        assert (unknown > 0).all()
    # over all words of a class, the closed form adds up to one with the share of the unknown
    k = int(np.argmax(model.class_distinct))
    g = int(np.argmax(model.group_total[k]))
    inside = [x for x in words.itertuples() if model.class_distinct[k] and _class_of(model, x, docs) == k]
    total = sum(10 ** model.within(np.array([x.n]), np.array([dict(zip(x.groups, x.counts, strict=True)).get(g, 0)]), np.array([k]), np.array([g]))[0] for x in inside)
    total += 10 ** model.within(np.array([0]), np.array([0]), np.array([k]), np.array([g]))[0]
    assert len(inside) == model.class_distinct[k] and abs(total - 1) < 1e-9


def _class_of(model, row, docs):
    words = sorted({w for _, t in docs for w in t.split()})
    data = "\n".join(words).encode()
    t = maxent_lm.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    at = np.flatnonzero(t.words == np.uint64(row.word % 2**64))
    return int(maxent_lm.classes(t, model.class_of)[at[0]])


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = []
    for parts in (1, 4, 40):
        df = docs.repartition(parts)
        model, counts = maxent_lm.train(df.where(~maxent_lm.held_out()))
        got.append({r.doc_id: (r.score, r.base_score, r.n_tokens) for r in maxent_lm.score(df, model, counts).collect()})
    for other in got[1:]:
        assert all(np.isclose(got[0][d][0], other[d][0], rtol=1e-4) and np.isclose(got[0][d][1], other[d][1]) for d in got[0])
    held = [d for d in got[0] if zlib.crc32(str(d).encode()) % 7 == 2]
    tokens = sum(got[0][d][2] for d in held)
    assert sum(got[0][d][0] for d in held) / tokens > sum(got[0][d][1] for d in held) / tokens + 0.1


def test_base_scores_with_few_hot_words(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HOT", 2)
    docs = [(i, " ".join(f"w{j % (i + 2)}" for j in range(20))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    train = {r.doc_id for r in df.where(~maxent_lm.held_out()).collect()}
    count: dict = {}
    for i, t in docs:
        for w in [*t.split(), "</E>"] if i in train else ():
            count[w] = count.get(w, 0) + 1
    model, counts = maxent_lm.train(df.where(~maxent_lm.held_out()))
    for r in maxent_lm.score(df, model, counts).collect():
        w = [*docs[r.doc_id][1].split(), "</E>"]
        assert r.n_known == sum(x in count for x in w)
        assert np.isclose(r.base_score, sum(np.log10((count.get(x, 0) + 1) / (sum(count.values()) + len(count) + 1)) for x in w))


def test_html_parts(spark):
    page = """<html><body class="has-sidebar"><header>Site</header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
    <article><h1>T&eacute;st &amp; more</h1><p>One <b>two</b><br>three<p>Four <a href=x>five</a><ul><li>six<li>seven</ul>
    <aside>No</aside><div class="ad">Buy</div><form>Name <input></form><script>var p = "<p>no</p>";</script><!-- <p>no</p> -->
    <section id="comments"><p>First!</p></section></article><div class="sidebar">Side</div><footer>&copy;</footer></body>"""
    other = page.replace("Four", "Vier").replace("<li>seven", "")
    plain = "<div class=menu><a>x</a></div><div><p>{}</p><p>b</p></div><div id=footer>f</div>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", other), *((10 + i, "http://g/", plain.format(f"text {i}")) for i in range(5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrappers.extract(pages, html_wrappers.infer_wrappers(pages)).collect()}
    assert got[1] == "Tést & more\nOne two three\nFour five\nsix\nseven"
    assert got[2] == "Tést & more\nOne two three\nVier five\nsix"
    assert got[11].startswith("text 1")


def test_wrapper_alignment():
    row = lambda html: html_wrappers.skeleton(html_wrappers.parse(html).kids)
    w = html_wrappers.align(row("<h1>a</h1><p>x</p><p>y</p>"), row("<h1>a</h1><h2>s</h2><p>z</p>"))
    assert [(x[1], x[2]) for x in w] == [("h1", 0), ("h2", 1), ("p", 2)]
    assert w[0][3][0][4] == "a" and w[2][3][0][4] is None
    pairs = row("<dl>" + "<dt>k</dt><dd>v</dd>" * 3 + "</dl>")
    assert pairs[0][3][0][0] == "g" and pairs[0][3][0][2] == 2


def extracted(spark, pages):
    """The texts of pages of one host."""
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_wrappers.extract(df, html_wrappers.infer_wrappers(df)).orderBy("page_id").collect()]


def test_slots_decide_without_names(spark):
    """No element and no class says what it is: an empty wrapper keeps the changing advert and notice, the host's leaves them."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("amber birch cedar delta ember fjord".split()) + str(rng.randrange(99)) for _ in range(n))
    made = []
    for _ in range(12):
        title, body = words(5), [words(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
        page = f"<div class=a1><div>{words(4)}</div><div>{words(3)}</div></div><div class=b2><h1>{title}</h1></div><div class=c3><div class=d4>"
        page += "".join(f"<p>{b}</p>" for b in body) + f"</div></div><div class=e5><div>Sent {words(2)}</div><div>All rights</div></div>"
        made.append((page, "\n".join([title, *body])))
    pages, want = zip(*made, strict=True)
    assert extracted(spark, pages) == list(want)
    bare = html_wrappers.load("")
    assert all("\n".join(bare.texts(html_wrappers.parse(p))) != w for p, w in made)
    for seed in range(6):  # whatever the order of the pages
        order = random.Random(seed).sample(range(12), 12)
        wrapper = None
        for i in order:
            wrapper = html_wrappers.infer(wrapper, html_wrappers.one_page(pages[i]))
        whole = html_wrappers.Wrapper(wrapper[0], wrapper[1], wrapper[4])
        assert ["\n".join(whole.texts(html_wrappers.parse(p))) for p in pages] == list(want)


def test_a_named_article_inside_the_region_counts(spark):
    pages = [f"<div><div>share {i}</div><article><h1>t{i}</h1><p>{'long text ' * (i + 3)}</p></article><div>note {i}</div></div><footer>f{i}</footer>" for i in range(6)]
    assert extracted(spark, pages) == [f"t{i}\n{('long text ' * (i + 3)).strip()}" for i in range(6)]


@pytest.mark.parametrize("before,after", [("lead", "endnote"), ("summary", "caption"), ("zq", "xw"), ("", "")])
@pytest.mark.parametrize("frame", ["{}", "<div class=page>{}</div>", "<div class=shell><div class=grid>{}</div><div class=sidebar><a href=x>more</a></div></div>"])
def test_text_beside_the_region_stays(spark, before, after, frame):
    """An opening paragraph and a note beside the body are kept, on hosts of few pages and of many alike."""
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice("amber birch cedar delta ember fjord".split()) + str(rng.randrange(999)) for _ in range(n))
    for n in (3, 4, 8):
        made = []
        for _ in range(n):
            lead, body, end = words(8), [words(70), words(70)], words(6)
            inner = f"<div class={before}>{lead}</div><div class=copy>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><div class={after}>{end}</div>"
            made.append(("<nav><a href=y>home</a></nav>" + frame.format(inner) + "<footer>all rights</footer>", "\n".join([lead, *body, end])))
        assert extracted(spark, [p for p, _ in made]) == [w for _, w in made], n


def test_a_named_lead_further_out_stays(spark):
    pages = [f"<div class=standfirst>opening {i} of it</div><div class=a1><div class=b2><p>{'long text ' * (i + 9)}</p><p>more {i}</p></div></div>" for i in range(6)]
    assert extracted(spark, pages) == [f"opening {i} of it\n{('long text ' * (i + 9)).strip()}\nmore {i}" for i in range(6)]


def test_wide_pages_align_in_little_time():
    rng = random.Random(2)
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [[["e", f"x|{name(i)}", 0, [], None, 1, 0] for i in sorted(rng.sample(range(60000), 20000))] for _ in range(2)]
    started = time.time()
    both = html_wrappers.align(*rows)
    assert time.time() - started < 10
    labels = [w[1] for w in both]
    assert len(labels) == len(set(labels)) == len({w[1] for r in rows for w in r})
    same = [["e", "x|a", 0, [], None, 1, 0]] * 3000
    assert len(html_wrappers.align(same[:2900], same)) == 3000


def test_text_of_few_pages_is_no_template(spark):
    pages = [f"<div>Sold by us</div><h1>t{i}</h1>" + ("<blockquote>said once</blockquote>" if i == 2 else "") + ("<h3>on three</h3>" if i < 3 else "") + ("<h2>on four</h2>" if i > 3 else "") for i in range(8)]
    want = [[f"t{i}", *["said once"] * (i == 2), *["on three"] * (i < 3), *["on four"] * (i > 3)] for i in range(8)]
    assert extracted(spark, pages) == ["\n".join(w) for w in want]


def test_hosts_beyond_the_bound_keep_their_text(spark, monkeypatch):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    pages = [f'<div>Sold by us</div><h1>t{i}</h1><div class="{name(i)}"><p>text {name(i % 30)}</p></div>' + ("<h3>said twice</h3>" if i in (3, 57) else "") for i in range(60)]
    want = ["\n".join([f"t{i}", f"text {name(i % 30)}", *["said twice"] * (i in (3, 57))]) for i in range(60)]
    monkeypatch.setattr(html_wrappers, "MAX_NODES", 20)
    wrapper = None
    for p in pages:
        wrapper = html_wrappers.infer(wrapper, html_wrappers.one_page(p))
        assert html_wrappers.count(wrapper[1]) <= 2 * max(20, 4 * wrapper[3] // wrapper[0])
    assert wrapper[2] and wrapper[0] == 60
    monkeypatch.undo()
    assert extracted(spark, pages) == want
    for step in ("_partial", "_fold"):
        monkeypatch.setattr(html_wrappers, step, bounded(getattr(html_wrappers, step)))
    assert extracted(spark, pages) == want


def test_whole_texts_and_classes_are_compared(spark):
    lead, utilities = "the same opening sentence of every page " * 3, " ".join(f"a-utility-{c}" for c in "bcdefghij")
    pages = [f'<h3>Sold by us</h3><div>{lead}{i}</div><div class="{utilities} sidebar">side {i}</div><div id="{utilities}-widget">w {i}</div>' for i in range(5)]
    assert extracted(spark, pages) == [f"{lead}{i}" for i in range(5)]
    pages = [f'<article><p>p {i}</p><div class="{utilities} sponsored">buy {i}</div></article>' for i in range(5)]
    assert extracted(spark, pages) == [f"p {i}" for i in range(5)]
    # The whole of a long text is template text where all pages have it.
    assert extracted(spark, [f"<div>{lead}</div><h1>t{i}</h1>" for i in range(5)]) == [f"t{i}" for i in range(5)]


def test_deep_elements_keep_their_place(spark):
    deep = lambda inner: "<div>" * 300 + inner + "</div>" * 300
    page = f"<div><nav>Menu</nav><article><p>one</p>{deep('two<p>three</p>four')}<p>five</p></article></div><div>Side</div>"
    assert extracted(spark, [page]) == ["one\ntwo\nthree\nfour\nfive"]
    other = deep('<p>in</p><div class="ad"><div><p>Buy</p></div>more</div><section id="comments"><p>First!</p></section><header><b>Site</b></header><p>out</p>')
    assert extracted(spark, [f"<div>{other}</div>"]) == ["in\nout"]
    assert extracted(spark, [f"<article>{other}</article>"]) == ["in\nSite\nout"]
    assert extracted(spark, [f"<p>no</p>{deep('<article><h1>a</h1><div><p>b</p></div></article><p>no</p>')}<p>no</p>"]) == ["a\nb"]
    assert extracted(spark, ["<div>" * 20000 + "deep" + "</i></section></li><li>" * 20000]) == ["deep"]


def bounded(step):
    """The step with a low bound, set in the Python worker."""

    def run(batches):
        from quern.llm import html_wrappers as used

        before, used.MAX_NODES = used.MAX_NODES, 20
        try:
            yield from step(batches)
        finally:
            used.MAX_NODES = before

    return run


def test_licenses(spark):
    mit = license_digest.KNOWN["MIT"]
    rows = [(1, mit.upper().replace(", ", " ,\n")), (2, "Copyright (c) 2020 Somebody\n\n" + mit), (3, mit + " and more"), (4, license_digest.KNOWN["0BSD"].replace("any purpose", "any  purpose"))]
    got = {r.doc_id: r.license for r in license_digest.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: "0BSD"}


def test_spellings_of_neighbouring_words(spark):
    rows = [("Licence licence, LICENCES x", "license license licenses x"), ("sub license sub-license non infringement", "sublicense sublicense noninfringement"), ("copyright owner copyright owners per cent favour", "copyright holder copyright holders percent favor"), ("sublicence", "sublicence")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", license_digest.canonical(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [r.want for r in got]


def test_licenses_as_sql_finds_them(spark, tmp_path):
    import duckdb

    from quern.llm.registry import ORACLE_SQL, QUERIES

    known = license_digest.known_texts()
    rows = [(i, body.upper() if i % 2 else f"Copyright (c) {i} Someone\n{body}") for i, (_, body) in enumerate(known)] + [(-1, "plain"), (-2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(f"SELECT doc_id, n_canonical, digest, license FROM ({ORACLE_SQL['op8_license_digest']})").fetchall()}
    got = {(r.doc_id, r.n_canonical, r.digest, r.license) for r in QUERIES["op8_license_digest"](spark, str(tmp_path)).collect()}
    assert got == want and sum(r[3] is not None for r in got) > 0.9 * len(known)


def test_whole_license_texts(spark):
    folder = Path(license_digest.__file__).parent / "licenses"
    rows = [(p.stem, p.read_text()) for p in folder.glob("*.txt")]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "Unlicense", "CC0-1.0"} <= {k for k, _ in rows}
    text, known = dict(rows), license_digest.KNOWN
    more = [
        ("MIT (titled)", "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + known["MIT"]),
        ("ISC (titled)", "ISC License\n\nCopyright 2020 Somebody\n\n" + known["ISC"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + text["BSD-3-Clause"]),
        ("BSD-2-Clause", text["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")),
        ("Apache-2.0", text["Apache-2.0"][: text["Apache-2.0"].index("APPENDIX")]),
        ("GPL-3", text["GPL-3"][text["GPL-3"].index(" Copyright (C)") :]),
        (None, text["GPL-3"] + "and more"),
    ]
    df = spark.createDataFrame([*rows, *more], "want string, text string")
    assert {(r.want, r.license) for r in license_digest.scan(df, keep=("want",)).collect() if r.want != r.license} == set()


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", 1568.0), ("text", "and", None, None), ("audio", None, "b.wav", 1.5), ("odd", None, "c", 9.0)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_parts.PART}>")
    r = chat_parts.format_conversations(df).first()
    assert r.formatted == "<turn:user>see \\l<image:1>and<audio:3><odd:4></turn>"
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 2), (0, 3, "audio", "b.wav", 38), (0, 4, "odd", "c", 0)] and r.attachment_tokens == 40
