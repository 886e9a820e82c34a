"""Queries on dialogue and generated text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import chat_text
from quern.operators import corpus_split, matching, scores, text
from quern.plans.shaped import _PAIRS, _T, _TFIDF, _TOK, _matches_sql, _pairs
from quern.session import ensure_checkpoint_dir
from quern.sources.tables import table


def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", chat_text.tokenize(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.size(chat_text.content_words(F.col("t"))).cast("long").alias("content"), F.sha2(F.array_join("t", "\n"), 256).alias("tokens_sha256"))


def _chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of token arrays, in a projection of their own: a lambda can't hold the Python step of the normaliser."""
    return _pairs(spark, sf_dir).select("id", chat_text.tokenize(F.col("src")).alias("src"), chat_text.tokenize(F.col("tgt")).alias("tgt"))


def english_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by their share of words that the answer has too, as a stand-in for the English version."""
    share = chat_text.english_share(F.col("src"), F.col("tgt"))
    return _chat_pairs(spark, sf_dir).select(chat_text.mix_bucket(share).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def grounding_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = chat_text.overlap_share(F.col("tgt"), F.col("src"))
    return _chat_pairs(spark, sf_dir).select("id", F.round(share, 9).alias("share"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("id", text.tokens(F.col("src")).alias("h"), text.tokens(F.col("tgt")).alias("r"))
    return rows.withColumn("lcs", scores.lcs_length("h", "r")).select("id", "lcs", F.round(scores.f1(F.col("lcs"), F.size("h"), F.size("r")), 9).alias("f1"))


def _gram_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = text.clipped_sums(_pairs(spark, sf_dir), "src", "tgt", (1, 2, 3, 4))
    return sums.select("id", *[F.col(f"m{n}") for n in (1, 2, 3, 4)], *[F.col(f"h{n}").alias(f"t{n}") for n in (1, 2, 3, 4)], F.col("r1").alias("ref"))


def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _gram_sums(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in ("m1", "m2", "m3", "m4", "t1", "t2", "t3", "t4", "ref")))
    return total.select(F.round(scores.bleu({n: (F.col(f"m{n}"), F.col(f"t{n}")) for n in (1, 2, 3, 4)}, F.col("t1"), F.col("ref")), 6).alias("bleu"), F.col("t1").alias("hyp_len"), F.col("ref").alias("ref_len"))


def sentence_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_sums(spark, sf_dir).select("id", F.round(scores.bleu({n: (F.col(f"m{n}"), F.col(f"t{n}")) for n in (1, 2, 3, 4)}, F.col("t1"), F.col("ref")), 6).alias("bleu"))


def bleu_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("ref") < 10, "0-9").when(F.col("ref") < 20, "10-19").when(F.col("ref") < 40, "20-39").otherwise("40+").alias("bucket")
    total = _gram_sums(spark, sf_dir).groupBy(bucket).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("m1", "m2", "m3", "m4", "t1", "t2", "t3", "t4", "ref"))).where("n >= 5")
    return total.select("bucket", "n", F.round(scores.bleu({n: (F.col(f"m{n}"), F.col(f"t{n}")) for n in (1, 2, 3, 4)}, F.col("t1"), F.col("ref")), 6).alias("bleu"))


def bleu_by_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU of pairs with a word that occurs once in all pairs of its side, and of those without."""
    words = _pairs(spark, sf_dir).select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), text.tokens(F.col(c)).alias("w")) for c in ("src", "tgt")])).alias("x"))
    each = words.select("id", "x.side", F.explode("x.w").alias("w"))
    rare = each.groupBy("side", "w").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id").distinct().withColumn("rare", F.lit(True))
    group = F.when(F.col("rare"), "has unknown word").otherwise("all words known").alias("words")
    total = _gram_sums(spark, sf_dir).join(rare, "id", "left").groupBy(group).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("m1", "m2", "m3", "m4", "t1", "t2", "t3", "t4", "ref"))).where("n >= 5")
    return total.select("words", "n", F.round(scores.bleu({n: (F.col(f"m{n}"), F.col(f"t{n}")) for n in (1, 2, 3, 4)}, F.col("t1"), F.col("ref")), 6).alias("bleu"))


def bleu_by_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of words and of word pairs, and mean lengths, by the share of the reply's words that the answer has too."""
    share = F.col("m1") / F.col("t1")
    bucket = F.when(F.col("t1") == 0, "unknown").when(share >= 0.2, "much").when(share >= 0.05, "some").otherwise("little").alias("bucket")
    sums = _gram_sums(spark, sf_dir).groupBy(bucket).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("m1", "m2", "t1", "t2", "ref"))).where("n >= 5")
    parts = {n: (F.col(f"m{n}"), F.col(f"t{n}")) for n in (1, 2)}
    return sums.select("bucket", "n", F.round(scores.bleu({1: parts[1]}, F.col("t1"), F.col("ref")), 6).alias("bleu1"), F.round(scores.bleu(parts, F.col("t1"), F.col("ref")), 6).alias("bleu2"), F.round(F.col("t1") / F.col("n"), 6).alias("hyp_len"), F.round(F.col("ref") / F.col("n"), 6).alias("ref_len"))


def grounding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean share of content words that the document has, over replies with any, and the share of all replies that have
    at least one of the document's words."""
    share = grounding_overlap(spark, sf_dir)
    return share.agg(F.count("*").alias("n"), F.count("share").alias("n_content"), F.round(F.avg("share"), 9).alias("overlap"), F.round(F.avg(F.coalesce(F.col("share") > 0, F.lit(False)).cast("double")), 9).alias("doc_word_hit"))


def retrieval_reply_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out user turn (id divisible by 50) the reply to the most similar other user turn."""
    rows = _pairs(spark, sf_dir)
    index = text.tfidf(rows, "id", "src")
    best = text.retrieve(index.where("id % 50 = 0"), index, 1).select(F.col("q").alias("id"), F.col("id").alias("found"))
    replies = rows.select(F.col("id").alias("found"), F.col("tgt").alias("reply"))
    return rows.where("id % 50 = 0").select("id").join(best.join(replies, "found"), "id", "left").select("id", "found", F.coalesce("reply", F.lit("")).alias("reply"))


def document_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the benchmark's items each source's documents share most with, by idf-weighted words."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    groups = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word")).distinct()
    return matching.best_documents(groups, docs)


def corpus_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    rows = _pairs(spark, sf_dir).select("id", text.tokens(F.col("src")).alias("src"), text.tokens(F.col("tgt")).alias("tgt"), F.lit("train").alias("split"))
    return corpus_split.split_corpus(rows, max_len=1000).select("id", "split")


#: Tokens that one task trains on in a pass.
TOKENS = 500_000


def vector_parts(rows: DataFrame) -> int:
    """So many parts of rows (t) train side by side and are averaged after each pass; by itself MLlib takes one for all rows."""
    return max(1, -(-(rows.agg(F.sum(F.size("t"))).first()[0] or 0) // TOKENS))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest words of the most frequent word, by skip-gram vectors of chat tokens."""
    from pyspark.ml.feature import Word2Vec

    rows = table(spark, sf_dir, "conversations").select(text.tokens(F.col("text")).alias("t"))
    model = Word2Vec(vectorSize=16, minCount=2, maxIter=2, seed=3, numPartitions=vector_parts(rows), inputCol="t", outputCol="v").fit(rows)
    word = rows.select(F.explode("t").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").first().w
    return model.findSynonyms(word, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (chat_tokens, english_mix, grounding_overlap, rouge_l, corpus_bleu, sentence_bleu, bleu_by_length, bleu_by_unknown, bleu_by_mix, grounding_summary, retrieval_reply_baseline, document_alignment, corpus_parts, word_vectors)}

_SUMS = "SELECT a.id, a.m AS m1, b.m AS m2, c.m AS m3, d.m AS m4, a.ht AS t1, b.ht AS t2, c.ht AS t3, d.ht AS t4, a.rt AS ref FROM " + " JOIN ".join(f"({_matches_sql(n)}) {x}" + ("" if x == "a" else f" ON {x}.id = a.id") for n, x in zip((1, 2, 3, 4), "abcd", strict=True))
_BLEU = """CASE WHEN t1 = 0 OR m1 = 0 THEN 0 ELSE 100 * (CASE WHEN t1 > ref THEN 1 ELSE exp(1 - ref::DOUBLE / t1) END) * exp((ln(m1::DOUBLE / t1) + ln((m2 + 1)::DOUBLE / (t2 + 1)) + ln((m3 + 1)::DOUBLE / (t3 + 1)) + ln((m4 + 1)::DOUBLE / (t4 + 1))) / 4) END"""
_SHORT = "100 * (CASE WHEN t1 > ref THEN 1 ELSE exp(1 - ref::DOUBLE / t1) END)"
_TOTALS = "sum(m1) AS m1, sum(m2) AS m2, sum(m3) AS m3, sum(m4) AS m4, sum(t1) AS t1, sum(t2) AS t2, sum(t3) AS t3, sum(t4) AS t4, sum(ref) AS ref"
_WORDS = "unnest(list_distinct({}))".format(_TOK.format("text"))

_REPLIES = _TFIDF.replace(f"({_T}) t", f"(SELECT id, src AS title FROM ({_PAIRS}) p0) t").replace("FROM {documents})", f"FROM ({_PAIRS}) p1)")

ORACLE_SQL: dict[str, str] = {
    "retrieval_reply_baseline": f"""{_REPLIES}, p AS (SELECT id, tgt FROM ({_PAIRS}) p2), s AS (SELECT a.id AS q, b.id AS id, round(sum(a.weight * b.weight), 6) AS score FROM idx a JOIN idx b ON a.term = b.term AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY 1, 2),
        k AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS k FROM s) SELECT p.id, k.id AS found, coalesce(r.tgt, '') AS reply FROM p LEFT JOIN k ON k.q = p.id AND k = 1 LEFT JOIN p r ON r.id = k.id WHERE p.id % 50 = 0""",
    "corpus_parts": f"""WITH t AS (SELECT min(id) AS id FROM (SELECT id, {_TOK.format('src')} AS a, {_TOK.format('tgt')} AS b FROM ({_PAIRS}) p) x WHERE len(a) BETWEEN 1 AND 1000 AND len(b) BETWEEN 1 AND 1000 GROUP BY a, b),
        v AS (SELECT id, row_number() OVER (ORDER BY md5('val-' || id), id) <= greatest(1, floor(0.05::DOUBLE * count(*) OVER ())) AS moved FROM t),
        w AS (SELECT id, row_number() OVER (ORDER BY md5('test-' || id), id) <= greatest(1, floor(0.05::DOUBLE * count(*) OVER ())) AS moved FROM v WHERE NOT moved)
        SELECT id, 'val' AS split FROM v WHERE moved UNION ALL SELECT id, CASE WHEN moved THEN 'test' ELSE 'train' END AS split FROM w""",
    "corpus_bleu": f"SELECT round({_BLEU}, 6) AS bleu, t1::BIGINT AS hyp_len, ref::BIGINT AS ref_len FROM (SELECT {_TOTALS} FROM ({_SUMS}) s) t",
    "sentence_bleu": f"SELECT id, round({_BLEU}, 6)::DOUBLE AS bleu FROM ({_SUMS}) s",
    "bleu_by_length": f"SELECT bucket, n, round({_BLEU}, 6)::DOUBLE AS bleu FROM (SELECT CASE WHEN ref < 10 THEN '0-9' WHEN ref < 20 THEN '10-19' WHEN ref < 40 THEN '20-39' ELSE '40+' END AS bucket, count(*) AS n, {_TOTALS.replace('sum(ref) AS ref', 'sum(ref) AS ref')} FROM ({_SUMS.replace('AS ref', 'AS ref')}) s GROUP BY 1 HAVING count(*) >= 5) t",
    "bleu_by_unknown": f"""WITH w AS (SELECT id, 's' AS side, unnest({_TOK.format('src')}) AS w FROM ({_PAIRS}) p UNION ALL SELECT id, 't', unnest({_TOK.format('tgt')}) FROM ({_PAIRS}) p),
        rare AS (SELECT DISTINCT id FROM w JOIN (SELECT side, w FROM w GROUP BY side, w HAVING count(*) = 1) o USING (side, w))
        SELECT words, n, round({_BLEU}, 6)::DOUBLE AS bleu FROM (SELECT CASE WHEN id IN (SELECT id FROM rare) THEN 'has unknown word' ELSE 'all words known' END AS words, count(*) AS n, {_TOTALS} FROM ({_SUMS}) s GROUP BY 1 HAVING count(*) >= 5) t""",
    "bleu_by_mix": f"""SELECT bucket, n, round(CASE WHEN t1 = 0 OR m1 = 0 THEN 0 ELSE {_SHORT} * m1 / t1 END, 6)::DOUBLE AS bleu1, round(CASE WHEN t1 = 0 OR m1 = 0 THEN 0 ELSE {_SHORT} * exp((ln(m1::DOUBLE / t1) + ln((m2 + 1)::DOUBLE / (t2 + 1))) / 2) END, 6)::DOUBLE AS bleu2,
        round(t1::DOUBLE / n, 6) AS hyp_len, round(ref::DOUBLE / n, 6) AS ref_len FROM (SELECT CASE WHEN t1 = 0 THEN 'unknown' WHEN m1::DOUBLE / t1 >= 0.2 THEN 'much' WHEN m1::DOUBLE / t1 >= 0.05 THEN 'some' ELSE 'little' END AS bucket, count(*) AS n, {_TOTALS} FROM ({_SUMS}) s GROUP BY 1 HAVING count(*) >= 5) t""",
    "document_alignment": f"""WITH d AS (SELECT item_id::VARCHAR AS doc, {_WORDS} AS word FROM {{benchmark}}), g AS (SELECT DISTINCT source AS key, {_WORDS} AS word FROM {{documents}}),
        w AS (SELECT word, ln((SELECT count(DISTINCT doc) FROM d)::DOUBLE / count(*)) AS idf FROM d GROUP BY word), s AS (SELECT key, d.doc, round(sum(idf) / sqrt(any_value(z.words) + 1), 9) AS score FROM g JOIN d USING (word) JOIN w USING (word) JOIN (SELECT doc, count(*) AS words FROM d GROUP BY doc) z ON z.doc = d.doc WHERE idf > 0 GROUP BY key, d.doc),
        k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc) AS k, coalesce(lead(score) OVER (PARTITION BY key ORDER BY score DESC, doc), 0) AS second FROM s)
        SELECT key, doc AS best, score, second, score > 0 AND score >= 1.25::DOUBLE * greatest(second, 1e-9) AS confident FROM k WHERE k = 1""",
}
