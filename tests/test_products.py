"""What the product queries make for a row and what for a distinct title or a row of candidates only."""

from quern.plans.registry import in_spark

SF = "/root/testdata/sf0.001"


def test_text_retrieval_cuts_titles_only(spark):
    staged = {}
    assert in_spark("SELECT * FROM {text_nearest} t")(spark, SF, staged).count() == 40
    assert "product_words" not in staged  # a row for each product
    assert staged["titles"].count() == staged["titles"].select("title").distinct().count()


def test_features_cut_rows_of_candidates_only(spark):
    staged = {}
    pairs = in_spark("SELECT i, j FROM {product_features} f")(spark, SF, staged)
    assert "product_words" not in staged
    assert pairs.exceptAll(staged["product_candidates"].select("i", "j")).isEmpty() and staged["product_candidates"].count() == pairs.count() > 0


def test_named_queries_ask_for_every_product(spark):
    from quern.plans.registry import QUERIES

    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert QUERIES["pair_features_14"](spark, SF).select("i").distinct().count() == n
    assert QUERIES["matches_plain"](spark, SF).count() == n


def test_scores_of_every_row_stay_apart_from_those_of_the_asked(spark):
    staged = {}
    every = in_spark("SELECT DISTINCT i FROM {every_product_scores} f")(spark, SF, staged).count()
    asked = in_spark("SELECT DISTINCT i FROM {product_scores} f")(spark, SF, staged).count()
    assert asked == 4 < every == 200
    counts = in_spark("SELECT SUM(n) AS n FROM {every_benchmark_counts} b WHERE y = 1")(spark, SF, staged).first().n
    pairs = in_spark("SELECT COUNT(*) AS n FROM {products} a JOIN {products} b ON a.grp = b.grp AND a.id < b.id")(spark, SF, staged).first().n
    assert counts == pairs
