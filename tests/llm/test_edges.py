"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from quern.llm import chat_parts, html_wrappers, license_digest, maxent_lm, piece_spans, quality_rules, rule_ensemble, signature_tree, url_cascade, winnowing
from quern.llm.registry import model_path

LONG = "word other " * 60_000
SCHEMA = "doc_id long, text string, n_words long, score double, __verdict string, verdict string, hits string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a text without id"), (5, LONG), (6, "same text here " * 10), (6, "same text here " * 10), (7, None), (8, "é ü ñ 漢字 😀 " * 8)]
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def test_quality_rules(docs, none):
    got = quality_rules.judge(docs).select("doc_id", "verdict.*").collect()
    assert len(got) == 9 and all(not r.kept and r.base_failed for r in got)
    assert {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert next(r for r in got if r.doc_id == 5).n_repeat_words == 120_000
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(none).count() == 0


def test_rule_ensemble(spark, docs, none):
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, 1), (None, 1), (8, None), (99, 1)], "doc_id long, quality int")
    model = rule_ensemble.train(docs, labels)
    assert [0 <= r.score <= 1 for r in rule_ensemble.with_score(docs, model).collect()] == [True] * 9
    assert rule_ensemble.with_score(none, model).count() == 0
    assert rule_ensemble.train(none, labels.limit(0)).score({s: rule_ensemble.np.zeros(2) for s in rule_ensemble.STATISTICS}).tolist() == [0.5, 0.5]


def test_signature_tree(docs, none):
    got = signature_tree.classes_of(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 2, 5), (6, 3, 6), (6, 3, 6), (7, 0, 7), (8, 5, 8)]
    assert signature_tree.classes_of(none.select("doc_id", "text")).count() == 0
    assert signature_tree.keep_first(docs).count() == 8 and signature_tree.keep_first(docs).columns == docs.columns


def test_maxent_lm(docs, none):
    model, counts = maxent_lm.train(docs.where(~maxent_lm.held_out()))
    got = maxent_lm.score(docs, model, counts).collect()
    assert len(got) == 9 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    model, counts = maxent_lm.train(none)
    assert model.total == 0 and all(r.n_known == 0 and r.base_score == 0 for r in maxent_lm.score(docs, model, counts).collect() if r.doc_id == 1)
    assert maxent_lm.score(none, model, counts).count() == 0


def test_piece_spans(docs, none):
    got = piece_spans.encode(docs, model_path()).collect()
    assert len(got) == 9 and all(r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends) for r in got)
    assert {(r.n_tokens, r.decoded) for r in got if r.doc_id in (1, 2)} == {(0, "")}
    assert next(r for r in got if r.doc_id == 5).decoded == LONG
    assert piece_spans.encode(none, model_path()).count() == 0


def test_license_digest(docs, none):
    got = license_digest.scan(docs).collect()
    assert len(got) == 9 and all(r.license is None for r in got)
    assert license_digest.scan(none).count() == 0 and license_digest.scan(docs, known={}).count() == 9


def test_winnowing(spark, docs, none):
    bench = spark.createDataFrame([(1, "same text here same"), (1, "text here"), (None, "word"), (2, None), (3, ""), (4, "漢字")], "item_id long, text string")
    got = winnowing.mark(docs, bench).withColumn("n_hit", winnowing.hit_words())
    assert got.columns == [*[c for c in docs.columns if c != "hits"], "hits", "n_hit"]
    rows = {(r.doc_id, r.hits.n_words, r.n_hit, tuple(r.hits["items"])) for r in got.collect()}
    assert (6, 30, 30, ("1",)) in rows and (8, 40, 8, ("4",)) in rows and (1, 0, 0, ()) in rows and (5, 120_000, 0, ()) in rows
    assert winnowing.mark(none, bench).count() == 0
    assert winnowing.drop_contaminated(docs, bench.limit(0)).count() == 9


def test_html(spark):
    rows = [(1, None, None), (2, "http://a.b/x", ""), (3, "no scheme", "plain text"), (None, "http://a.b/", "<p>x" * 3000), (5, "http://a.b/", "<div>" * 5000 + "deep"), (6, "http://c.d/", "<b <i"), (6, "http://c.d/", "<b <i")]
    pages = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, text string")
    wrappers = html_wrappers.infer_wrappers(pages)
    got = {(r.page_id, r.n_chars, r.text[:10]) for r in html_wrappers.extract(pages, wrappers).collect()}
    assert {(1, 0, ""), (2, 0, ""), (3, 10, "plain text"), (5, 4, "deep")} <= got
    assert html_wrappers.extract(pages.limit(0), html_wrappers.infer_wrappers(pages.limit(0))).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "nothing"), (3, "://"), (4, "http://A.example.ORG/es/x?y"), (4, "http://A.example.ORG/es/x?y"), (5, "x://example.org/en/1"), (6, "http://other/")]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, host string, rule string")
    got = url_cascade.judge(pages, "url", {"org/"}, {"example.org/es/", "example.org/en/1"}, {"other"}, keep=("page_id",)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "a.example.org", "/es/x", "example.org/es/", "block"), (4, "a.example.org", "/es/x", "example.org/es/", "block"),
        (5, "example.org", "/en/1", "example.org/en/1", "block"), (6, "other", "/", None, "block"),
    ]
    assert url_cascade.judge(pages.limit(0), "url", {"org/"}, set(), keep=("page_id",)).count() == 0
    assert url_cascade.judge(pages, "url", set(), set(), keep=("page_id",)).count() == 7


def test_chat(spark):
    rows = [(1, 0, None, None), (1, None, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "assistant", "<turn:x>\\"), (2, 0, "user", "")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat_parts.text_parts(F.col("text")).alias("parts"))
    done = chat_parts.format_conversations(messages).withColumn("p", chat_parts.pieces_of(F.col("formatted")))
    got = {r.conv_id: ([(t.role, t.text) for t in r.back], r.loss) for r in done.select("conv_id", chat_parts.read_back(F.col("p")).alias("back"), chat_parts.masked_text(F.col("p"), F.col("mask")).alias("loss")).collect()}
    assert got == {1: ([("user", "a"), ("", ""), ("assistant", "b"), ("assistant", "b")], "bb"), None: ([("assistant", "<turn:x>\\")], "<turn:x>\\"), 2: ([("user", "")], "")}
    assert chat_parts.format_conversations(messages.limit(0)).count() == 0


def test_kept_columns_may_have_any_name(spark):
    """A kept column with the name of a result or a helper comes out under that name with underscores behind."""
    df = spark.createDataFrame([(1, "some text", "k", "mine", 9)], "doc_id long, text string, __text string, Digest string, n_tokens int")
    got = license_digest.scan(df, keep=("doc_id", "text", "Digest")).first()
    assert got["Digest_"] == "mine" and got["text"] == "some text" and len(got["digest"]) == 64
    got = piece_spans.encode(df, model_path(), keep=("n_tokens", "__text", "text")).first()
    assert (got["n_tokens_"], got["__text_"], got["n_tokens"] == len(got["ids"])) == (9, "k", True)
    model, counts = maxent_lm.train(df)
    got = maxent_lm.score(df.withColumnRenamed("Digest", "score"), model, counts, keep=("n_tokens", "score", "__text")).first()
    assert (got["n_tokens_"], got["score_"], got["__text_"], got["n_tokens"]) == (9, "mine", "k", 3)
    pages = spark.createDataFrame([("http://a.b/", "<p>x</p>", "mine", "h", 1)], "url string, html string, text string, __html string, host int")
    got = html_wrappers.extract(pages, html_wrappers.infer_wrappers(pages), keep=("text", "__html", "url")).first()
    assert (got["text"], got["text_"], got["__html_"]) == ("x", "mine", "h")
    got = url_cascade.judge(pages, "url", {"b/"}, set(), keep=("host", "url")).first()
    assert (got["host"], got["host_"], got["rule"], got["url"]) == ("a.b", 1, "b/", "http://a.b/")
    docs = spark.createDataFrame([(1, "a b c d", "x", 5)], "doc_id long, text string, __key string, __w int")
    bench = spark.createDataFrame([(1, "a b"), (2, "c d")], "item_id long, text string")
    got = winnowing.mark(docs, bench, block_bytes=2).first()
    assert (got["__key"], got["__w"], got["hits"]["items"], got["hits"]["starts"], got["hits"]["ends"]) == ("x", 5, ["1", "2"], [0], [4])
