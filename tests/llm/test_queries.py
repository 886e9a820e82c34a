"""The registered queries against DuckDB, and the pipeline against its stages in plain Python."""

import duckdb
import pytest

from quern.llm.registry import ORACLE_SQL, QUERIES
from tools.compare import differ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark conversations labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert differ(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()) == ""


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_methods import brute_components, brute_hits

    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    judged = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, SF).collect() if r.kept}
    good = {r.doc_id for r in QUERIES["op4_rule_ensemble"](spark, SF).collect() if r.predicted}
    kept = sorted(judged & good)
    parts = brute_components([docs[d] for d in kept])
    firsts = [kept[i] for i in range(len(kept)) if parts[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for d in firsts:
        words, hit, _ = brute_hits(docs[d], items)
        if not (hit and 20 * hit >= words):
            want.add(d)
    assert got == want and 0 < len(got) < len(docs)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with the names of results, and empty tables, in each stage."""
    import corpus_pipeline

    good = "the quick study of water and light in the old town shows that plain words of a text are kept when they say what is new and true "
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, good + "a b c"), (None, good * 2), (5, "word " * 50_000), (6, "short")]
    docs = spark.createDataFrame([(*r, None, None, 7, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, hits string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (6, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "water and light in the old town"), (2, None)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / "full" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    for folder in ("full", "none"):
        for name, stage in corpus_pipeline.STAGES:
            whole = spark.read.parquet(str(tmp_path / folder / "documents.parquet"))
            out = stage(spark, whole, str(tmp_path / folder))
            assert name == "sentencepiece" or out.columns == docs.columns
            ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
            want = {"quality_rules": [3, 3, 4], "near_duplicates": [-1, 1, 2, 3, 5, 6], "decontamination": [1, 2, 5, 6], "sentencepiece": [-1, 1, 2, 3, 3, 4, 5, 6]}
            if folder == "none":
                assert ids == []
            elif name in want:
                assert ids == want[name], name
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_tokens_of_the_pipeline(spark):
    """Counts and digests of what the pipeline keeps, from the library itself."""
    import hashlib

    import corpus_pipeline
    import sentencepiece

    from quern.llm.registry import model_path

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for rows in (corpus_pipeline.run(spark, SF).collect(), QUERIES["op7_piece_spans"](spark, SF).collect()):
        for r in rows:
            ids = library.encode(docs[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_classifier_query(spark):
    """What the query holds out and predicts, and that held-out labels never reach the training."""
    import zlib

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op4_rule_ensemble"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0
