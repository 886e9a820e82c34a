"""Dialogue, sequences and the profile of click rows: queries that Spark and DuckDB run alike, and forms with their own SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import sequences
from quern.operators import text
from quern.operators.ordering import numbered
from quern.plans import portable
from quern.sources import readers

View = Callable[[str], DataFrame]

# Marker words of the two languages.
MARKERS_ID = "dan untuk yang dengan murah promo original baju tas sepatu anak bayi wanita pria ready stok gratis bisa buat kode warna ukuran paket isi".split()
MARKERS_EN = "the for and with new free set pack cotton men women baby kids girls boys size color black white blue".split()

VIEWS = {
    "turn_words": "SELECT conv_id, turn, role, @split(norm) AS w FROM (SELECT conv_id, turn, role, @squash(text) AS norm FROM {turns} t) q",
    "pair_words": "SELECT id, @split(a) AS sw, @split(b) AS tw FROM (SELECT id, @squash(src) AS a, @squash(tgt) AS b FROM {pairs} p) q",
    "reply_words": "SELECT id, @each(tw) AS w FROM {pair_words} p",
    "query_words": "SELECT id, @each(sw) AS w FROM {pair_words} p",
    "known_words": "SELECT w FROM {query_words} q GROUP BY w HAVING COUNT(*) >= 2",
    "ctr_cats": "SELECT id, y, split, c1, CAST(x1 AS STRING) AS x1, c2, CAST(floor(x2 / 10000) AS STRING) AS x2 FROM {ctr} c",
    # positives stand against the negatives of each kind
    "scored_kinds": """SELECT s, y, kind FROM {scored} n WHERE y = 0 UNION ALL SELECT p.s, p.y, k.kind FROM {scored} p
        CROSS JOIN (SELECT DISTINCT kind FROM {scored} q WHERE y = 0) k WHERE p.y = 1""",
}
STAGED = ()


def _gain(a: str, b: str) -> str:
    joint = f"concat(coalesce({a}, '__MISSING__'), '|', coalesce({b}, '__MISSING__'))"
    mi = lambda x, name: portable._mi(x).replace(f"'{x}' AS feature", f"'{name}' AS feature").replace("{ctr}", "{ctr_cats}")
    small = f"(SELECT COUNT(DISTINCT {a}) <= 60 AND COUNT(DISTINCT {b}) <= 60 AS ok FROM {{ctr_cats}} c)"
    return f"SELECT '{a}x{b}' AS pair, j.mi - a.mi - b.mi AS gain FROM ({mi(joint, 'j')}) j CROSS JOIN ({mi(a, 'a')}) a CROSS JOIN ({mi(b, 'b')}) b CROSS JOIN {small} s WHERE s.ok"


_PAIRS = [("c1", "x1"), ("c1", "c2"), ("c1", "x2"), ("x1", "c2"), ("x1", "x2"), ("c2", "x2")]
_TOKENS_ALL = "SELECT COUNT(*) AS n, COUNT(DISTINCT w) AS v FROM {query_words} q"

QUERIES = {
    "interaction_information": "SELECT pair, round(gain, 9) AS gain FROM (" + " UNION ALL ".join(_gain(a, b) for a, b in _PAIRS) + ") t ORDER BY gain DESC, pair LIMIT 12",
    "cardinality_vocab": "SELECT COUNT(DISTINCT coalesce(c1, '__MISSING__')) AS c1, (SELECT COUNT(*) + 1 FROM (SELECT coalesce(c2, '__MISSING__') AS v FROM {ctr} c WHERE split = 'train' GROUP BY 1 HAVING COUNT(*) >= 10) q) AS c2_vocab FROM {ctr} d",
    # an indicator for each column that had gaps in the training rows
    "missing_indicators": """SELECT id, CASE WHEN h.x1 THEN CASE WHEN c.x1 IS NULL THEN 1 ELSE 0 END END AS x1_missing, CASE WHEN h.x2 THEN CASE WHEN c.x2 IS NULL THEN 1 ELSE 0 END END AS x2_missing,
        CASE WHEN h.y THEN 0 END AS y_missing FROM {ctr} c CROSS JOIN (SELECT COUNT(x1) < COUNT(*) AS x1, COUNT(x2) < COUNT(*) AS x2, COUNT(y) < COUNT(*) AS y FROM {ctr} t WHERE split = 'train') h""",
    "bce_with_logits": """SELECT id, round(1 / (1 + exp(-z)), 9) AS p, round(greatest(z, 0e0) - z * y + ln(1 + exp(-abs(z))), 9) AS loss FROM (SELECT id, y, 8 * s - 2 AS z FROM {scored} t) q""",
    "log_loss": """SELECT round(AVG(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS loss, round(AVG((y - p) * (y - p)), 9) AS brier
        FROM (SELECT y, least(greatest(s, 1e-12), 1 - 1e-12) AS p FROM {scored} q) t""",
    "describe_lengths": """SELECT lang, COUNT(*) AS n, round(AVG(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, MIN(n_chars) AS least, round(@quantile(n_chars, 0.05), 6) AS p05,
        round(@quantile(n_chars, 0.5), 6) AS p50, round(@quantile(n_chars, 0.95), 6) AS p95, MAX(n_chars) AS most FROM {documents} d GROUP BY lang""",
    "conversation_stats": """SELECT COUNT(DISTINCT conv_id) AS convs, COUNT(*) AS turns, round(AVG(k), 9) AS mean_tokens, round(@quantile(k, 0.95), 6) AS p95_tokens,
        round(AVG(CASE WHEN k > 0 THEN e * 1e0 / k END), 9) AS known_share, SUM(CASE WHEN k > 0 AND e * 1e0 / k >= 0.6e0 THEN 1 ELSE 0 END) * 1e0 AS mostly, SUM(CASE WHEN k > 0 AND e * 1e0 / k >= 0.3e0 AND e * 1e0 / k < 0.6e0 THEN 1 ELSE 0 END) * 1e0 AS mixed,
        SUM(CASE WHEN k > 0 AND e * 1e0 / k < 0.3e0 THEN 1 ELSE 0 END) * 1e0 AS little FROM (SELECT conv_id, turn, @size(w) AS k, @size(@filter(w, 'the', 'of', 'and')) AS e FROM {turn_words} t) q""",
    "empty_rate": "SELECT role, COUNT(*) AS n, round(AVG(CASE WHEN @size(w) = 0 THEN 1e0 ELSE 0e0 END), 9) AS empty FROM {turn_words} t GROUP BY role",
    "oov_token_rate": "SELECT COUNT(*) AS tokens, round(AVG(CASE WHEN k.w IS NULL THEN 1e0 ELSE 0e0 END), 9) AS oov FROM {reply_words} r LEFT JOIN {known_words} k ON k.w = r.w",
    # exp of the mean loss of the replies' words under the counts of the queries' words, at most exp(50)
    "perplexity": f"""SELECT round(exp(least(AVG(-ln((coalesce(c.k, 0) + 1e0) / (t.n + t.v + 1))), 50e0)), 6) AS ppl FROM {{reply_words}} r
        LEFT JOIN (SELECT w, COUNT(*) AS k FROM {{query_words}} q GROUP BY w) c ON c.w = r.w CROSS JOIN ({_TOKENS_ALL}) t""",
    "length_penalty": "SELECT id, round(power((5e0 + @size(tw)) / 6, 0.7e0), 9) AS penalty FROM {pair_words} p",
    "length_filter": "SELECT id FROM {pair_words} p WHERE @size(sw) BETWEEN 1 AND 200 AND @size(tw) BETWEEN 1 AND 200",
    # words that would repeat a word pair of the reply, after its last word
    "banned_words": """SELECT p.id, b.w2 AS w FROM (SELECT id, @last(tw) AS last FROM {pair_words} p) p JOIN (SELECT DISTINCT id, w1, w2 FROM (SELECT id, x.a AS w1, x.b AS w2 FROM (SELECT id, @each(@couples(tw)) AS x FROM {pair_words} p) q) r) b
        ON b.id = p.id AND b.w1 = p.last""",
    # dots of all pairs of four parts of each vector, the lower triangle in rows
    "dot_interaction": """SELECT vec_id, round(@dot(@part(v, 2), @part(v, 1)), 5) + 0e0 AS d21, round(@dot(@part(v, 3), @part(v, 1)), 5) + 0e0 AS d31, round(@dot(@part(v, 3), @part(v, 2)), 5) + 0e0 AS d32,
        round(@dot(@part(v, 4), @part(v, 1)), 5) + 0e0 AS d41, round(@dot(@part(v, 4), @part(v, 2)), 5) + 0e0 AS d42, round(@dot(@part(v, 4), @part(v, 3)), 5) + 0e0 AS d43 FROM (SELECT vec_id, embedding AS v FROM {embeddings} e) q""",
    "prefix_filter": "SELECT p_partkey, p_name FROM {part} p WHERE p_name LIKE 'red%' OR p_name LIKE '%bolt' OR p_type LIKE '%ECON%'",
    # a new session where the kind of event changes or an hour passes
    "session_by_change": """SELECT event_id, user_id, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 1e0 AS part FROM (
        SELECT event_id, user_id, ts, CASE WHEN before IS NULL OR before <> event_type OR ts > prev + INTERVAL '1' HOUR THEN 1 ELSE 0 END AS fresh FROM (
        SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events} e) a) b""",
    "symbol_ratio": """SELECT id, round(1 - length(@strip(title)) * 1e0 / greatest(length(title), 1), 9) AS symbols, length(@ascii(title)) < length(title) AS non_ascii FROM {listings} l""",
    "lang_bucket": f"""SELECT bucket, COUNT(*) AS n FROM (SELECT CASE WHEN script > 0 THEN 'other script' WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'first markers' WHEN b > 0 THEN 'second markers' ELSE 'no marker' END AS bucket
        FROM (SELECT @size(@filter(w, {', '.join(f"'{x}'" for x in MARKERS_ID)})) AS a, @size(@filter(w, {', '.join(f"'{x}'" for x in MARKERS_EN)})) AS b, script FROM (SELECT @split(norm) AS w, script FROM
        (SELECT @squash(title) AS norm, length(title) - length(@latin(title)) AS script FROM {{listings}} l) x) q) r) s GROUP BY bucket""",
}


def nucleus_filter(view: View) -> DataFrame:
    """The most frequent words of all replies, as many as it takes for their shares to reach nine tenths; ties by the word."""
    counts = view("SELECT w, COUNT(*) AS k FROM {reply_words} r GROUP BY w")
    run = numbered(counts, [], [F.desc("k"), F.col("w")], ("k",))
    return run.where((F.col("_run_k") - F.col("k")) / F.col("_all_k") < 0.9).select("w", "k", F.round(F.col("k") / F.col("_all_k"), 9).alias("share"))


def roc_curve(view: View) -> DataFrame:
    """A point for each row in the order of scores; ties aren't merged."""
    run = numbered(view("SELECT id, s, y FROM {scored} t"), [], [F.desc("s"), F.col("id")], ("y",))
    tp, pos = F.col("_run_y"), F.col("_all_y")
    return run.select("id", F.col("s").alias("threshold"), F.round(tp / pos, 9).alias("tpr"), F.round((F.col("_row") - tp) / (F.col("_n") - pos), 9).alias("fpr"))


def pr_curve(view: View) -> DataFrame:
    run = numbered(view("SELECT id, s, y FROM {scored} t"), [], [F.desc("s"), F.col("id")], ("y",))
    return run.select("id", F.col("s").alias("threshold"), F.round(F.col("_run_y") / F.col("_row"), 9).alias("prec"), F.round(F.col("_run_y") / F.col("_all_y"), 9).alias("rec"))


def auc_by_kind(view: View) -> DataFrame:
    """All positives against the negatives of each kind, by average ranks."""
    blocks = view("{scored_kinds}").groupBy("kind", "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    run = numbered(blocks, ["kind"], [F.col("s")], ("pos", "n"))
    rank = F.col("_run_n") - F.col("n") + (F.col("n") + 1) / 2.0
    sums = run.groupBy("kind").agg(F.sum(F.col("pos") * rank).alias("r"), F.max("_all_pos").cast("double").alias("p"), F.max(F.col("_all_n") - F.col("_all_pos")).cast("double").alias("q"))
    return sums.where("p > 0 and q > 0").select("kind", F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 9).alias("auc"))


BATCH, CHUNK = 16, 50


def length_batches(view: View) -> DataFrame:
    """Each example in one batch of BATCH: rows by hash in chunks of CHUNK batches, by length inside a chunk."""
    rows = view("SELECT id, @size(tw) AS n, md5(CAST(id AS STRING)) AS h FROM {pair_words} p")
    rows = numbered(rows, [], [F.col("h"), F.col("id")]).withColumn("chunk", F.floor((F.col("_row") - 1) / (BATCH * CHUNK)))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("n", "id")) - 1
    return rows.select("id", "n", (F.col("chunk") * CHUNK + F.floor(place / BATCH)).alias("batch"))


def encode_padded(view: View) -> DataFrame:
    """Ten places: up to eight words between marks, then padding; and the words read back."""
    ids = sequences.padded(F.col("tw"), 10)
    return view("{pair_words}").select("id", F.array_join(ids, " ").alias("padded"), F.array_join(sequences.until_end(ids), " ").alias("words"))


def key_lookup(view: View) -> DataFrame:
    """Orders with the name of their customer by a canonical key; orders that miss have a null name."""
    rows = view("SELECT o_orderkey, concat(' ', CAST(CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_custkey ELSE o_custkey END AS STRING), '.0 ') AS k FROM {orders} o")
    names = view("SELECT CAST(c_custkey AS STRING) AS k, c_name FROM {customer} c")
    return readers.lookup(rows, names, "k", "c_name").select("o_orderkey", "c_name")


def sentence_split(view: View) -> DataFrame:
    """The number of sentences of each text and the words of the longest."""
    found = sequences.sentences(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\r\\n.!?]+|[.!?]"), F.lit(0)))
    rows = view("SELECT item_id, text FROM {benchmark} b").select("item_id", found.alias("s"))
    return rows.select("item_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", F.size)).cast("long").alias("longest"))


def _sentences(view: View) -> DataFrame:
    parts = view("SELECT id, tgt FROM {pairs} p").select("id", F.posexplode(F.split("tgt", "[.!?]")).alias("pos", "s"))
    return parts.select("id", "pos", "s", text.tokens(F.col("s")).alias("w"))


def extractive_baseline(view: View) -> DataFrame:
    """The sentence of each reply that shares most, by idf over the replies, with its query; longer ones count less."""
    docs = view("SELECT id, tgt FROM {pairs} p").select("id", F.explode(F.array_distinct(text.tokens(F.col("tgt")))).alias("w"))
    total = docs.agg(F.count_distinct("id").alias("total"))
    idf = docs.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("w", (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    query = view("SELECT id, src FROM {pairs} p").select("id", F.explode(text.tokens(F.col("src"))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("q"))
    rows = _sentences(view)
    words = rows.select("id", "pos", F.explode(F.array_distinct("w")).alias("w")).join(query, ["id", "w"]).join(idf, "w")
    shared = words.groupBy("id", "pos").agg(F.sum(F.col("q") * F.col("idf")).alias("shared"))
    scored = rows.join(shared, ["id", "pos"], "left").select("id", "pos", "w", F.round(F.coalesce("shared", F.lit(0.0)) / F.sqrt(F.size("w") + 1.0), 9).alias("score"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("pos", "w", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("id", F.col("b.pos").cast("long").alias("pos"), F.round("b.score", 6).alias("score"), F.array_join(F.slice("b.w", 1, 25), " ").alias("reply"))


def _f1(matched: DataFrame) -> DataFrame:
    return matched.withColumn("f1", F.when(F.col("matched") > 0, 2.0 * F.col("matched") / (F.col("hyp_total") + F.col("ref_total"))).otherwise(0.0))


def scores_by_mix(view: View) -> DataFrame:
    """ROUGE-1 and ROUGE-2 by the share of a query's words that its reply has; buckets of five pairs or more."""
    pairs = view("SELECT id, src, tgt FROM {pairs} p")
    one, two = (_f1(text.clipped_matches(pairs, "src", "tgt", n)) for n in (1, 2))
    share = F.try_divide(F.col("matched").cast("double"), F.col("hyp_total"))
    bucket = F.when(share.isNull(), "unknown").when(share >= 0.2, "much").when(share >= 0.05, "some").otherwise("little")
    rows = one.select("id", bucket.alias("bucket"), F.col("f1").alias("a")).join(two.select("id", F.col("f1").alias("b")), "id")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("a"), 9).alias("rouge1"), F.round(F.avg("b"), 9).alias("rouge2")).where("n >= 5")


def mismatched_control(view: View) -> DataFrame:
    """Mean ROUGE-1 of the queries against their own replies and against the next pair's, in the order of ids."""
    rows = numbered(view("SELECT id, src, tgt FROM {pairs} p"), [], [F.col("id")]).select("id", "src", "tgt", "_row", "_n")
    other = rows.select(F.when(F.col("_row") == 1, F.col("_n")).otherwise(F.col("_row") - 1).alias("_row"), F.col("tgt").alias("other"))
    both = rows.join(other, "_row")
    mean = lambda c: _f1(text.clipped_matches(both, "src", c, 1)).agg(F.round(F.avg("f1"), 9).alias(c))
    return mean("tgt").crossJoin(mean("other")).select(F.col("tgt").alias("own"), "other")


def unordered_dedupe(view: View) -> DataFrame:
    """Unordered pairs of documents of one text hash prefix: the one of the first part counts, then the smaller first id."""
    rows = view("SELECT id, grp, lang FROM {listings} l WHERE id % 50 = 0").alias("a").join(view("SELECT id, grp FROM {listings} l").alias("b"), F.col("a.grp") == F.col("b.grp")).where("a.id <> b.id")
    parts = rows.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.lit(0).alias("part")).union(rows.select(F.col("b.id"), F.col("a.id"), F.lit(1)))
    key = Window.partitionBy(F.least("i", "j"), F.greatest("i", "j")).orderBy("part", "i")
    return parts.withColumn("k", F.row_number().over(key)).where("k = 1").select("i", "j", "part")


FORMS: dict[str, Callable[[View], DataFrame]] = {f.__name__: f for f in (nucleus_filter, roc_curve, pr_curve, auc_by_kind, length_batches, encode_padded, key_lookup, sentence_split, extractive_baseline, scores_by_mix, mismatched_control, unordered_dedupe)}

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_RUN = "SELECT id, s, sum(y) OVER w AS tp, count(*) OVER w AS k, sum(y) OVER () AS pos, count(*) OVER () AS n FROM {scored} t WINDOW w AS (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING)"


def _rouge(src: str, tgt: str, n: int, name: str) -> str:
    """CTEs that end in {name}(id, m, ht, rt)."""
    gram = lambda c: f"SELECT id, g, count(*) AS c FROM (SELECT id, array_to_string(w[k:k + {n - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS k FROM (SELECT id, {_TOK.format(c)} AS w FROM both_) a WHERE len(w) >= {n}) b) d GROUP BY id, g"
    return f"""{name}h AS ({gram(src)}), {name}r AS ({gram(tgt)}), {name}m AS (SELECT h.id, sum(least(h.c, r.c)) AS m FROM {name}h h JOIN {name}r r ON r.id = h.id AND r.g = h.g GROUP BY h.id),
        {name} AS (SELECT b.id, coalesce(m, 0) AS m, greatest(len({_TOK.format(src)}) - {n - 1}, 0) AS ht, greatest(len({_TOK.format(tgt)}) - {n - 1}, 0) AS rt FROM both_ b LEFT JOIN {name}m x ON x.id = b.id)"""


_F1 = "CASE WHEN {0}.m > 0 THEN 2.0::DOUBLE * {0}.m / ({0}.ht + {0}.rt) ELSE 0 END"

FORM_SQL = {
    "nucleus_filter": "SELECT w, k, round(k / n, 9) AS share FROM (SELECT w, k, (sum(k) OVER (ORDER BY k DESC, w ROWS UNBOUNDED PRECEDING))::DOUBLE AS run, (sum(k) OVER ())::DOUBLE AS n FROM (SELECT w, count(*) AS k FROM {reply_words} r GROUP BY w) t) q WHERE (run - k) / n < 0.9::DOUBLE",
    "roc_curve": f"SELECT id, s AS threshold, round(tp / pos, 9) AS tpr, round((k - tp) / (n - pos), 9) AS fpr FROM ({_RUN}) r",
    "pr_curve": f"SELECT id, s AS threshold, round(tp / k, 9) AS prec, round(tp / pos, 9) AS rec FROM ({_RUN}) r",
    "auc_by_kind": """SELECT kind, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)), 9) AS auc FROM (SELECT kind, y,
        rank() OVER (PARTITION BY kind ORDER BY s) + (count(*) OVER (PARTITION BY kind, s) - 1) / 2 AS r, sum(y) OVER (PARTITION BY kind) AS np, sum(1 - y) OVER (PARTITION BY kind) AS nn FROM {scored_kinds} k) q WHERE np > 0 AND nn > 0 GROUP BY kind""",
    "length_batches": f"""SELECT id, n, chunk * {CHUNK} + (row_number() OVER (PARTITION BY chunk ORDER BY n, id) - 1) // {BATCH} AS batch FROM (
        SELECT id, n, (row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1) // {BATCH * CHUNK} AS chunk FROM (SELECT id, len(tw) AS n FROM {{pair_words}} p) q) r""",
    "encode_padded": """SELECT id, '<s> ' || array_to_string(list_concat(tw[1:8], ['</s>'], ['<pad>' for _ in range(least(len(tw), 8), 8)]), ' ') AS padded, array_to_string(tw[1:8], ' ') AS words FROM {pair_words} p""",
    "key_lookup": "SELECT o_orderkey, c_name FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey AND o_orderkey % 10 <> 0",
    "sentence_split": r"""WITH t AS (SELECT row_number() OVER () AS r, item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n.!?]+|[.!?]')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n.!?]+|[.!?]'), 1) AS i FROM {benchmark} b),
        s AS (SELECT r, item_id, i, coalesce(sum((w IN ('.', '!', '?'))::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM t),
        c AS (SELECT r, item_id, k, count(*) AS n FROM s GROUP BY r, item_id, k)
        SELECT b.item_id, coalesce(x.n, 0)::BIGINT AS n, x.longest::BIGINT AS longest FROM {benchmark} b LEFT JOIN (SELECT item_id, count(*) AS n, max(n) AS longest FROM c GROUP BY item_id) x ON x.item_id = b.item_id""",
    "extractive_baseline": f"""WITH d AS (SELECT id, unnest(list_distinct({_TOK.format('tgt')})) AS w FROM {{pairs}} p), idf AS (SELECT w, ln((1.0::DOUBLE + (SELECT count(DISTINCT id) FROM d)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM d GROUP BY w),
        q AS (SELECT id, w, count(*) AS q FROM (SELECT id, unnest({_TOK.format('src')}) AS w FROM {{pairs}} p) x GROUP BY id, w),
        s AS (SELECT id, pos, {_TOK.format('s')} AS w FROM (SELECT id, unnest(string_split_regex(tgt, '[.!?]')) AS s, generate_subscripts(string_split_regex(tgt, '[.!?]'), 1) - 1 AS pos FROM {{pairs}} p) y),
        m AS (SELECT e.id, e.pos, sum(q * idf) AS shared FROM (SELECT id, pos, unnest(list_distinct(w)) AS w FROM s) e JOIN q ON q.id = e.id AND q.w = e.w JOIN idf ON idf.w = e.w GROUP BY e.id, e.pos),
        z AS (SELECT s.id, s.pos, s.w, round(coalesce(shared, 0) / sqrt(len(s.w) + 1.0::DOUBLE), 9) AS score FROM s LEFT JOIN m ON m.id = s.id AND m.pos = s.pos)
        SELECT id, pos::BIGINT AS pos, round(score, 6) AS score, array_to_string(w[1:25], ' ') AS reply FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS k FROM z) t WHERE k = 1""",
    "scores_by_mix": f"""WITH both_ AS (SELECT id, src, tgt FROM {{pairs}} p), {_rouge('src', 'tgt', 1, 'a')}, {_rouge('src', 'tgt', 2, 'b')}
        SELECT bucket, count(*) AS n, round(avg(fa), 9) AS rouge1, round(avg(fb), 9) AS rouge2 FROM (SELECT CASE WHEN a.ht = 0 THEN 'unknown' WHEN a.m / a.ht >= 0.2 THEN 'much' WHEN a.m / a.ht >= 0.05 THEN 'some' ELSE 'little' END AS bucket,
            {_F1.format('a')} AS fa, {_F1.format('b')} AS fb FROM a JOIN b ON b.id = a.id) q GROUP BY bucket HAVING count(*) >= 5""",
    "mismatched_control": f"""WITH n AS (SELECT id, src, tgt, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM {{pairs}} p), both_ AS (SELECT a.id, a.src, a.tgt, b.tgt AS other FROM n a JOIN n b ON b.r = a.r % a.n + 1),
        {_rouge('src', 'tgt', 1, 'a')}, {_rouge('src', 'other', 1, 'b')} SELECT (SELECT round(avg({_F1.format('a')}), 9) FROM a) AS own, (SELECT round(avg({_F1.format('b')}), 9) FROM b) AS other""",
    "unordered_dedupe": """SELECT i, j, part FROM (SELECT i, j, part, row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY part, i) AS k FROM (
        SELECT a.id AS i, b.id AS j, 0 AS part FROM {listings} a JOIN {listings} b ON a.grp = b.grp AND a.id <> b.id AND a.id % 50 = 0 UNION ALL SELECT b.id, a.id, 1 FROM {listings} a JOIN {listings} b ON a.grp = b.grp AND a.id <> b.id AND a.id % 50 = 0) u) v WHERE k = 1""",
}
