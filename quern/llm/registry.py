"""The thin queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat_parts, filter_audit, html_wrappers, license_digest, maxent_lm, piece_spans, quality_rules, rule_ensemble, signature_tree, token_alignment, token_counts, url_cascade, winnowing
from quern.session import ensure_checkpoint_dir
from quern.sources.tables import table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ensure_checkpoint_dir(spark)
    wrappers = html_wrappers.infer_wrappers(pages).checkpoint()
    return html_wrappers.extract(pages, wrappers)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, out="v").select("doc_id", "v.*")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.classes_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out(modulus: int, remainder: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(5, 0))
    scored = rule_ensemble.with_score(docs, rule_ensemble.train(docs, labels), out="score")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
BLOCKED_HOSTS = ("spam-farm.example.org", "spam-farm.example.com", "spam-farm.example.net", "cheap-pills.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "casino-win.example.org", "casino-win.example.com", "casino-win.example.net")


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge(pages, "url", set(ALLOW), set(BLOCK), set(BLOCKED_HOSTS), keep=("page_id",))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = maxent_lm.train(docs.where(~maxent_lm.held_out()))
    scored = maxent_lm.score(docs, model, counts)
    return scored.select("doc_id", maxent_lm.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_spans.encode(docs, model_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), check_spans=True)


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = winnowing.mark(docs, table(spark, sf_dir, "benchmark"), out="hits").withColumn("n_hit", winnowing.hit_words("hits"))
    n, hit = F.col("hits.n_words"), F.col("n_hit")
    return marked.select(
        "doc_id",
        n.alias("n_words"),
        "n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= n)).alias("contaminated"),
    )


CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op10_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", chat_parts.text_parts(F.col("text")).alias("parts"))
    done = chat_parts.format_conversations(messages).withColumn("__pieces", chat_parts.pieces_of(F.col("formatted")))
    done = done.withColumn("__back", chat_parts.read_back(F.col("__pieces"))).withColumn("__loss", chat_parts.masked_text(F.col("__pieces"), F.col("mask")))
    turns = F.array_join(F.transform("__back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("__back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


TOKEN_LIMIT = 512


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, model_path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, model_path("byte_bpe_50k.json"), model_path())


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in sorted({*quality_rules.ts.STOP_WORDS, *(w.capitalize() for w in quality_rules.ts.STOP_WORDS)}))
_REMOVE = "regexp_replace(coalesce(text, ''), '{}', '', 'g')"

#: The tables' pages have one template: the article's blocks begin at its block tags.
_OP1 = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT r, unnest(string_split_regex(a, '</?(?:p|h1)>')) AS x, generate_subscripts(string_split_regex(a, '</?(?:p|h1)>'), 1) AS i FROM p),
c AS (SELECT r, i, trim(regexp_replace(html_unescaped, '\s+', ' ', 'g')) AS x FROM (SELECT r, i, replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', chr(1)), '&amp', '&'), chr(1), '&') AS html_unescaped FROM b)),
t AS (SELECT r, string_agg(x, chr(10) ORDER BY i) FILTER (x <> '') AS text FROM c GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM p LEFT JOIN t ON t.r = p.r
"""

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 8)) AS o) GROUP BY r),
m AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS ex, len(list_filter(w, lambda x: x IN ({_STOP}))) AS st
    FROM d LEFT JOIN rep ON rep.r = d.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 15.0 AND n_symbols::DOUBLE / word_chars <= 0.05
    AND ex::DOUBLE / n_words <= 0.35 AND st::DOUBLE / n_words >= 0.03 AND n_dup_lines::DOUBLE / n_lines <= 0.5 AS kept FROM b
"""

_RULE_ROWS = ", ".join(f"('{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}', '{v}')" for v, keys in (("allow", ALLOW), ("block", BLOCK)) for k in keys)
_HOST_ROWS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
_OP5 = rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, q, v) AS (VALUES {_RULE_ROWS}),
spam(h) AS (VALUES {_HOST_ROWS}),
best AS (SELECT r, arg_max(h || q, [length(h || q), length(h)]) AS rule, arg_max(v, [length(h || q), length(h)]) AS v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r),
bad AS (SELECT DISTINCT r FROM p JOIN spam ON host = h OR ends_with(host, '.' || h))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN best.v WHEN bad.r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN best ON best.r = p.r LEFT JOIN bad ON bad.r = p.r
"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_text(text: str) -> str:
    """The canonical form in plain Python, for the digests in the SQL."""
    kept = re.sub(license_digest._COPYRIGHT_LINE, "", text)
    words = re.sub(license_digest._BREAKS, " ", kept.translate({c: c + 32 for c in range(65, 91)})).split(" ")
    words, phrases = [w for w in words if w], {tuple(a.split(" ")): b.split(" ") for a, b in license_digest.SPELLINGS}
    for size, old, new in ((len(k), list(k), v) for k, v in phrases.items()):
        out, i = [], 0
        while i < len(words):
            hit = words[i : i + size] == old
            out += new if hit else [words[i]]
            i += size if hit else 1
        words = out
    return " ".join(words)


def _canonical_sql(text: str) -> str:
    pattern, breaks = license_digest._COPYRIGHT_LINE, license_digest._BREAKS
    out = f"regexp_replace(coalesce({text}, ''), {_sql_text(pattern)}, '', 'g')"
    out = f"regexp_replace(translate({out}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_sql_text(breaks)}, ' ', 'g')"
    out = f"' ' || replace(trim({out}), ' ', '  ') || ' '"
    for other, usual in license_digest.SPELLINGS:
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _known_rows() -> str:
    least: dict[str, str] = {}
    for name, body in license_digest.known_texts():
        digest = hashlib.sha256(_canonical_text(body).encode()).hexdigest()
        least[digest] = min(name, least.get(digest, name))
    return ", ".join(f"('{d}', {_sql_text(n)})" for d, n in least.items())


_OP8 = f"""
WITH k(digest, license) AS (VALUES {_known_rows()}), d AS (SELECT doc_id, {_canonical_sql("text")} AS c FROM documents)
SELECT doc_id, length(c)::BIGINT AS n_canonical, sha256(c) AS digest, CASE WHEN c <> '' THEN k.license END AS license FROM d LEFT JOIN k ON k.digest = sha256(c)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, dw.k, i, item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN it ON it.r = d.r
"""

_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '>', '\g')"
_OP10 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', {_sql_text(CONTROL_TEXT)}), (-7, 1, 'assistant', {_sql_text(CONTROL_TEXT)})))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 14)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

#: Each order of filters is applied step by step to the counts of failed sets; nothing here inverts joint sums.
_OP12 = r"""
WITH ids AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY ALL),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > least THEN 'E' ELSE '' END) AS fails
    FROM d JOIN ids ON ids.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier, fails, n, good, toxic FROM c, o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT *, contains(fails, letter) AS fails_here, earlier <> '' AND regexp_matches(fails, '[' || earlier || 'x]') AS gone FROM s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails_here AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails_here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails_here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails_here AND NOT gone), 0)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_wrappers": op1_html_wrappers,
    "op2_quality_rules": op2_quality_rules,
    "op3_signature_tree": op3_signature_tree,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_url_cascade": op5_url_cascade,
    "op6_maxent_lm": op6_maxent_lm,
    "op7_piece_spans": op7_piece_spans,
    "op8_license_digest": op8_license_digest,
    "op9_winnowing": op9_winnowing,
    "op10_chat_parts": op10_chat_parts,
    "op11_token_counts": op11_token_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op1_html_wrappers": _OP1,
    "op2_quality_rules": _OP2,
    "op5_url_cascade": _OP5,
    "op8_license_digest": _OP8,
    "op9_winnowing": _OP9,
    "op10_chat_parts": _OP10,
    "op12_filter_audit": _OP12,
}
