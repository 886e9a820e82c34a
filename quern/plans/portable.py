"""Queries whose SQL text runs in Spark and in DuckDB alike. {name} stands for a table; ratings and so on are views."""

from __future__ import annotations

#: Views on the tables: name -> (SQL, views it needs).
VIEWS = {
    # user x item ratings; of several the latest counts
    "ratings": """SELECT u, i, rating FROM (SELECT o_custkey AS u, l_suppkey AS i, CAST(least(5, 1 + floor((CAST(l_quantity AS DOUBLE) - 1) / 10)) AS DOUBLE) AS rating,
        row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) t WHERE rn = 1""",
    # advertising-like rows: label, two numbers with gaps, two categories with gaps, train or test
    "ctr": """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
        CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS x1,
        CASE WHEN (l_orderkey * 5 + l_linenumber) % 17 = 0 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END AS x2,
        CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_linestatus END AS c1, CAST(l_suppkey AS STRING) AS c2,
        CASE WHEN substr(md5(CAST(l_orderkey AS STRING)), 1, 1) < 'd' THEN 'train' ELSE 'test' END AS split FROM {lineitem}""",
    # titles with a class of equal texts
    "listings": """SELECT d.doc_id AS id, d.text AS title, substr(md5(d.text), 1, 16) AS phash, g.grp, d.lang, d.source FROM {documents} d
        JOIN (SELECT coalesce(md5(text), '') AS h, min(doc_id) AS grp FROM {documents} GROUP BY coalesce(md5(text), '')) g ON g.h = coalesce(md5(d.text), '')""",
    # scored binary rows with many ties
    "scored": "SELECT d.doc_id AS id, l.quality AS y, CAST(floor(d.n_chars / 50) AS DOUBLE) / 400 AS s, d.source AS kind FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
    # one row for each turn that isn't the system's
    "turns": "SELECT conv_id, turn, role, text FROM {conversations} WHERE role <> 'system'",
    # lower-case words of a user turn and of the assistant turn after it
    "pairs": """SELECT conv_id * 1000 + turn AS id, src, tgt FROM (SELECT conv_id, turn, role, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS tgt,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {turns}) t WHERE role = 'user' AND next_role = 'assistant'""",
}

_BLOCK = "SELECT s, SUM(y) AS pos, COUNT(*) AS n FROM {scored} GROUP BY s"
_RUN = f"SELECT s, pos, n, SUM(pos) OVER (ORDER BY s DESC) AS tp, SUM(n) OVER (ORDER BY s DESC) AS seen, SUM(pos) OVER () AS total_pos, SUM(n) OVER () AS total FROM ({_BLOCK}) b"


def _mi(x: str) -> str:
    """Mutual information (nats) of a column with the label, corrected for sample size and not below 0."""
    return f"""SELECT '{x}' AS feature, greatest(0e0, SUM(p * ln(p / (px * py))) - (MAX(kx) - 1) * (MAX(ky) - 1) / (2e0 * MAX(n))) AS mi FROM (
        SELECT CAST(c AS DOUBLE) / n AS p, CAST(SUM(c) OVER (PARTITION BY x) AS DOUBLE) / n AS px, CAST(cy AS DOUBLE) / n AS py, n, kx, ky FROM (
        SELECT x, y, COUNT(*) AS c FROM (SELECT coalesce(CAST({x} AS STRING), '__MISSING__') AS x, y FROM {{ctr}}) a GROUP BY x, y) b
        JOIN (SELECT y AS own, COUNT(*) AS cy FROM {{ctr}} GROUP BY y) m ON m.own = b.y
        CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT coalesce(CAST({x} AS STRING), '__MISSING__')) AS kx, COUNT(DISTINCT y) AS ky FROM {{ctr}}) t) q"""


_SPLIT_USER = """SELECT u, i, CASE WHEN k <= n_test THEN 'test' WHEN k <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM (
    SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY md5(concat(CAST(u AS STRING), '-', CAST(i AS STRING)))) AS k,
    greatest(1, CAST(round_even(0.1e0 * COUNT(*) OVER (PARTITION BY u), 0) AS INT)) AS n_test, greatest(1, CAST(round_even(0.1e0 * COUNT(*) OVER (PARTITION BY u), 0) AS INT)) AS n_val FROM {ratings}) t"""
_BIAS = """SELECT r.u, r.i, r.rating, g.mu, coalesce(bu.b, 0e0) AS bu, coalesce(bi.b, 0e0) AS bi FROM {ratings} r CROSS JOIN (SELECT AVG(rating) AS mu FROM {ratings}) g
    LEFT JOIN (SELECT i, SUM(rating - mu) / (COUNT(*) + 10e0) AS b FROM {ratings} CROSS JOIN (SELECT AVG(rating) AS mu FROM {ratings}) m GROUP BY i) bi ON bi.i = r.i
    LEFT JOIN (SELECT u, SUM(rating - mu) / (COUNT(*) + 10e0) AS b FROM {ratings} CROSS JOIN (SELECT AVG(rating) AS mu FROM {ratings}) m GROUP BY u) bu ON bu.u = r.u"""

QUERIES = {
    # profile
    "eda_ratings_summary": """SELECT COUNT(*) AS n, COUNT(DISTINCT u) AS users, COUNT(DISTINCT i) AS items, round(1 - COUNT(*) / (CAST(COUNT(DISTINCT u) AS DOUBLE) * COUNT(DISTINCT i)), 9) AS sparsity,
        round(AVG(rating), 9) AS mean, round(stddev_samp(rating), 9) AS std, SUM(CASE WHEN rating IS NULL THEN 1 ELSE 0 END) * 1e0 AS nulls FROM {ratings}""",
    "rating_histogram": "SELECT rating, COUNT(*) AS n FROM {ratings} GROUP BY rating ORDER BY rating",
    "ratings_per_user_median": "SELECT CAST(median(n) AS DOUBLE) AS median_n, MIN(n) AS least, MAX(n) AS most FROM (SELECT u, COUNT(*) AS n FROM {ratings} GROUP BY u) t",
    "count_with_zero_keys": "SELECT c_custkey, COUNT(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey",
    "null_rates_train_test": """SELECT f AS feature, round(AVG(CASE WHEN split = 'train' THEN m END), 9) AS train, round(AVG(CASE WHEN split = 'test' THEN m END), 9) AS test FROM (
        SELECT split, 'x1' AS f, CASE WHEN x1 IS NULL THEN 1e0 ELSE 0e0 END AS m FROM {ctr} UNION ALL SELECT split, 'x2', CASE WHEN x2 IS NULL THEN 1e0 ELSE 0e0 END FROM {ctr}
        UNION ALL SELECT split, 'c1', CASE WHEN c1 IS NULL THEN 1e0 ELSE 0e0 END FROM {ctr} UNION ALL SELECT split, 'c2', CASE WHEN c2 IS NULL THEN 1e0 ELSE 0e0 END FROM {ctr}) t GROUP BY f""",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS name, MAX(@type({c})) AS dtype, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS uniques, MIN(CAST({c} AS STRING)) AS example FROM {{listings}} t" for c in ("id", "title", "phash", "grp", "lang")),
    "group_size_distribution": "SELECT n AS size, COUNT(*) AS classes FROM (SELECT grp, COUNT(*) AS n FROM {listings} GROUP BY grp) t GROUP BY n",
    "size_biased_matches": "SELECT round(SUM(n * n) / CAST(SUM(n) AS DOUBLE) - 1, 9) AS others FROM (SELECT grp, COUNT(*) AS n FROM {listings} GROUP BY grp) t",
    "multi_source_groups": "SELECT SUM(CASE WHEN k > 1 THEN 1 ELSE 0 END) * 1e0 AS several, SUM(CASE WHEN k = 1 THEN 1 ELSE 0 END) * 1e0 AS single FROM (SELECT grp, COUNT(DISTINCT source) AS k FROM {listings} GROUP BY grp) t",
    "duplicate_rows": "SELECT SUM(k - 1) * 1e0 AS later, SUM(CASE WHEN k > 1 THEN k ELSE 0 END) * 1e0 AS in_sets FROM (SELECT title, COUNT(*) AS k FROM {listings} GROUP BY title) t",
    "label_rates": """SELECT split, round(AVG(y), 9) AS rate, round(greatest(AVG(y), 1 - AVG(y)), 9) AS majority, round(-(AVG(y) * ln(AVG(y)) + (1 - AVG(y)) * ln(1 - AVG(y))), 9) AS prior_loss
        FROM (SELECT split, CAST(y AS DOUBLE) AS y FROM {ctr}) t GROUP BY split""",
    "crosstab_label": "SELECT c1, y, COUNT(*) AS n FROM {ctr} GROUP BY c1, y",
    "spearman_label": """SELECT round(corr(rx, ry), 9) AS rho FROM (SELECT rank() OVER (ORDER BY x1) + (COUNT(*) OVER (PARTITION BY x1) - 1) / 2e0 AS rx,
        rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM {ctr} WHERE x1 IS NOT NULL) t""",
    "pearson_ranking": "SELECT f AS feature, round(abs(r), 9) AS strength FROM (SELECT 'x1' AS f, corr(x1, y) AS r FROM {ctr} UNION ALL SELECT 'x2', corr(x2, y) FROM {ctr}) t",
    "mutual_information": f"SELECT feature, round(mi, 9) AS mi FROM ({_mi('c1')} UNION ALL {_mi('c2')}) t",
    "raw_cardinality": "SELECT COUNT(DISTINCT coalesce(c1, '__MISSING__')) AS c1, COUNT(DISTINCT coalesce(c2, '__MISSING__')) AS c2 FROM {ctr}",
    "mean_std_over_seeds": "SELECT lang, round(AVG(n), 9) AS mean, round(stddev_pop(n), 9) AS std FROM (SELECT lang, source, CAST(COUNT(*) AS DOUBLE) AS n FROM {listings} GROUP BY lang, source) t GROUP BY lang",
    # splits, sampling
    "split_per_user": _SPLIT_USER,
    "split_stratified": "SELECT id, y, CASE WHEN k <= round_even(0.2e0 * n, 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS STRING)), id) AS k, COUNT(*) OVER (PARTITION BY y) AS n FROM {ctr}) t",
    "split_by_group": """SELECT l.id, l.grp, g.split FROM {listings} l JOIN (SELECT grp, CASE WHEN k <= floor(0.6e0 * n) THEN 'train' WHEN k <= floor(0.8e0 * n) THEN 'val' ELSE 'test' END AS split FROM (
        SELECT grp, row_number() OVER (ORDER BY md5(CAST(grp AS STRING))) AS k, COUNT(*) OVER () AS n FROM (SELECT DISTINCT grp FROM {listings}) d) t) g ON g.grp = l.grp""",
    "group_sample": "SELECT id, grp FROM {listings} WHERE grp IN (SELECT grp FROM (SELECT DISTINCT grp FROM {listings}) d ORDER BY md5(CAST(grp AS STRING)) LIMIT 100)",
    "leakage_guard": "SELECT id, src, tgt FROM (SELECT id, src, tgt, substr(md5(CAST(id AS STRING)), 1, 1) AS h FROM {pairs}) a WHERE h < 'd' AND NOT EXISTS (SELECT 1 FROM (SELECT src, tgt, substr(md5(CAST(id AS STRING)), 1, 1) AS h FROM {pairs}) b WHERE b.h >= 'd' AND b.src = a.src AND b.tgt = a.tgt)",
    "dedupe_pairs_first": "SELECT id, src, tgt FROM (SELECT id, src, tgt, row_number() OVER (PARTITION BY lower(src), lower(tgt) ORDER BY id) AS k FROM {pairs}) t WHERE k = 1",
    "row_sample": "SELECT id FROM {listings} ORDER BY md5(CAST(id AS STRING)), id LIMIT 50",
    # encoding
    "id_reindex": "SELECT r.u, CAST(m.code AS BIGINT) AS code, r.i, r.rating FROM {ratings} r JOIN (SELECT u, row_number() OVER (ORDER BY u) - 1 AS code FROM (SELECT DISTINCT u FROM {ratings}) d) m ON m.u = r.u",
    "impute_standardize": """SELECT id, round((v - m) / (s + 1e-6), 6) AS z, missing FROM (SELECT c.id, sign(coalesce(c.x1, t.med)) * ln(1 + abs(coalesce(c.x1, t.med))) AS v, CASE WHEN c.x1 IS NULL THEN 1 ELSE 0 END AS missing FROM {ctr} c CROSS JOIN (SELECT CAST(median(x1) AS DOUBLE) AS med FROM {ctr} WHERE split = 'train') t) a
        CROSS JOIN (SELECT AVG(sign(w) * ln(1 + abs(w))) AS m, stddev_pop(sign(w) * ln(1 + abs(w))) AS s FROM (SELECT coalesce(c.x1, t.med) AS w FROM {ctr} c CROSS JOIN (SELECT CAST(median(x1) AS DOUBLE) AS med FROM {ctr} WHERE split = 'train') t WHERE c.split = 'train') b) q""",
    "vocab_encode_oov": """SELECT c.id, CAST(coalesce(v.code, 0) AS BIGINT) AS code FROM {ctr} c LEFT JOIN (SELECT val, row_number() OVER (ORDER BY n DESC, val) AS code FROM (SELECT coalesce(c2, '__MISSING__') AS val, COUNT(*) AS n FROM {ctr} WHERE split = 'train' GROUP BY coalesce(c2, '__MISSING__')) a WHERE n >= 10) v ON v.val = coalesce(c.c2, '__MISSING__')""",
    "oov_rates": """SELECT c.split, round(AVG(CASE WHEN v.val IS NULL THEN 1e0 ELSE 0e0 END), 9) AS oov FROM {ctr} c LEFT JOIN (SELECT c2 AS val FROM {ctr} WHERE split = 'train' GROUP BY c2 HAVING COUNT(*) >= 400) v ON v.val = c.c2 GROUP BY c.split""",
    # binary metrics
    "roc_auc": "SELECT round((SUM(CASE WHEN y = 1 THEN r ELSE 0e0 END) - np * (np + 1) / 2e0) / (np * nn), 9) AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2e0 AS r, CAST(SUM(y) OVER () AS DOUBLE) AS np, CAST(COUNT(*) OVER () - SUM(y) OVER () AS DOUBLE) AS nn FROM {scored}) t GROUP BY np, nn",
    "average_precision": f"SELECT round(SUM(CAST(pos AS DOUBLE) / total_pos * (CAST(tp AS DOUBLE) / seen)), 9) AS ap FROM ({_RUN}) t",
    "best_f1_threshold": f"SELECT s AS threshold, round(f1, 9) AS f1 FROM (SELECT s, f1, row_number() OVER (ORDER BY f1 DESC, s DESC) AS k FROM (SELECT s, 2e0 * tp / (seen + total_pos) AS f1 FROM ({_RUN}) t) u) v WHERE k = 1",
    "threshold_sweep": "SELECT th, round(CAST(SUM(CASE WHEN s >= th AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(1, SUM(CASE WHEN s >= th THEN 1 ELSE 0 END)), 9) AS prec, round(CAST(SUM(CASE WHEN s >= th AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(y), 9) AS rec FROM {scored} CROSS JOIN (SELECT 0.05e0 AS th UNION ALL SELECT 0.1e0 UNION ALL SELECT 0.2e0 UNION ALL SELECT 0.4e0) g GROUP BY th",
    "reliability_ece": "SELECT CAST(bin AS BIGINT) AS bin, COUNT(*) AS n, round(AVG(s), 9) AS conf, round(AVG(CAST(y AS DOUBLE)), 9) AS acc, round(abs(AVG(s) - AVG(CAST(y AS DOUBLE))) * COUNT(*) / MAX(total), 9) AS part FROM (SELECT s, y, ntile(10) OVER (ORDER BY s, id) AS bin, COUNT(*) OVER () AS total FROM {scored}) t GROUP BY bin",
    # recommender
    "popularity_topk": "SELECT i, n, round(mean, 9) AS mean, CAST(k AS BIGINT) AS k FROM (SELECT i, n, mean, row_number() OVER (ORDER BY n DESC, mean DESC, i) AS k FROM (SELECT i, COUNT(*) AS n, AVG(rating) AS mean FROM {ratings} GROUP BY i ORDER BY n DESC, mean DESC, i LIMIT 20) a) t",
    "bias_baseline": f"SELECT u, i, round(least(5e0, greatest(1e0, mu + bu + bi)), 6) AS pred FROM ({_BIAS}) t",
    "rmse_mae": f"SELECT round(sqrt(AVG((rating - p) * (rating - p))), 9) AS rmse, round(AVG(abs(rating - p)), 9) AS mae FROM (SELECT rating, least(5e0, greatest(1e0, mu + bu + bi)) AS p FROM ({_BIAS}) t) q",
    "rmse_by_bucket": f"SELECT bucket, COUNT(*) AS n, round(sqrt(AVG((rating - p) * (rating - p))), 9) AS rmse FROM (SELECT rating, least(5e0, greatest(1e0, mu + bu + bi)) AS p, CASE WHEN c < 20 THEN 'a' WHEN c < 40 THEN 'b' ELSE 'c' END AS bucket FROM (SELECT t.*, COUNT(*) OVER (PARTITION BY u) AS c FROM ({_BIAS}) t) x) q GROUP BY bucket HAVING COUNT(*) >= 20",
    # matching: a class of equal rows stands for its pairs
    "pair_positives": "SELECT l.id, l.grp, c.k - 1 AS links FROM {listings} l JOIN (SELECT grp, COUNT(*) AS k FROM {listings} GROUP BY grp) c ON c.grp = l.grp",
    "match_lists": "SELECT l.id, c.n, c.first_match, c.last_match FROM {listings} l JOIN (SELECT grp, COUNT(*) AS n, MIN(id) AS first_match, MAX(id) AS last_match FROM {listings} GROUP BY grp) c ON c.grp = l.grp",
    "confusion_metrics": """SELECT tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 9) AS acc, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0e0), 9) AS prec, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0e0), 9) AS rec,
        round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 9) AS f1 FROM (SELECT COUNT(CASE WHEN s >= 0.1e0 AND y = 1 THEN 1 END) AS tp, COUNT(CASE WHEN s >= 0.1e0 AND y = 0 THEN 1 END) AS fp, COUNT(CASE WHEN s < 0.1e0 AND y = 1 THEN 1 END) AS fn, COUNT(CASE WHEN s < 0.1e0 AND y = 0 THEN 1 END) AS tn FROM {scored}) t""",
    "first_row_per_key": "SELECT grp, id, title FROM (SELECT grp, id, title, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM {listings}) t WHERE k = 1",
    # events, dialogue
    "sessionize_events": """SELECT user_id, CAST(session AS BIGINT) AS session, COUNT(*) AS n FROM (SELECT user_id, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '1' HOUR THEN 1 ELSE 0 END AS fresh FROM {events}) a) b GROUP BY user_id, session""",
    "speaker_index": "SELECT conv_id, turn, CAST((dense_rank() OVER (PARTITION BY conv_id ORDER BY seen) - 1) % 2 AS BIGINT) AS speaker FROM (SELECT conv_id, turn, MIN(turn) OVER (PARTITION BY conv_id, role) AS seen FROM {turns}) t",
    "top_outputs_share": "SELECT round(SUM(CASE WHEN k <= 5 THEN n ELSE 0 END) / CAST(SUM(n) AS DOUBLE), 9) AS share FROM (SELECT n, row_number() OVER (ORDER BY n DESC, t) AS k FROM (SELECT text AS t, COUNT(*) AS n FROM {turns} WHERE role = 'assistant' GROUP BY text) a) b",
    "length_buckets": "SELECT bucket, COUNT(*) AS n FROM (SELECT CASE WHEN length(text) < 100 THEN '0-99' WHEN length(text) < 500 THEN '100-499' ELSE '500+' END AS bucket FROM {turns}) t GROUP BY bucket HAVING COUNT(*) >= 5",
    "union_labelled": "SELECT id, 'user' AS part FROM {pairs} UNION ALL SELECT doc_id, 'doc' FROM {documents}",
    "argmax_row": "SELECT source, max_by(doc_id, n_chars * 1000000000 + doc_id) AS longest FROM {documents} GROUP BY source",
}
