import pytest
from pyspark.sql import functions as F

from quern.sources import readers


def test_ratings_and_items(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t2\t3\t4\n5\t6\t4.5\t7\n")
    (tmp_path / "u.item").write_bytes("1|Caf\xe9|x\n2|B|y\n".encode("latin-1"))
    assert readers.read_ratings(spark, str(tmp_path / "u.data"), 2).agg(F.sum("rating")).first()[0] == 7.5
    assert {r.title for r in readers.read_items(spark, str(tmp_path / "u.item")).collect()} == {"Café", "B"}


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert [sorted(r.x for r in readers.read_records(spark, str(tmp_path / f)).collect()) for f in ("a.json", "b.jsonl")] == [[1, 2], [1, 2]]


def test_aligned_and_keys(spark, tmp_path):
    (tmp_path / "a.en").write_text("one\ntwo\n\nfour\n")
    (tmp_path / "a.hi").write_text("ek\ndo\ntin\n")
    got = readers.read_aligned(spark, str(tmp_path / "a.en"), str(tmp_path / "a.hi")).collect()
    assert sorted((r.src, r.tgt) for r in got) == [("one", "ek"), ("two", "do")]
    keys = spark.createDataFrame([(" 4 ",), ("4.0",), ("4",), (" Ab ",), (None,)], "k string").select(readers.canonical_key(F.col("k")).alias("k"))
    assert [r.k for r in keys.collect()] == ["4", "4", "4", "ab", None]
    names = spark.createDataFrame([("/x/Train.csv",), ("/x/valid_1.csv",), ("/x/test",), ("/x/latest.csv",)], "p string").select(readers.split_of_file(F.col("p")).alias("s"))
    assert [r.s for r in names.collect()] == ["train", "val", "test", None]
    assert readers.resolve_pair(["id", "english_text", "hi"], ("en", "english"), ("hi",)) == ("english_text", "hi")


def test_zip_members_and_search(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in/train.csv", 'label,"text, long"\n1,"a\nb"\n0,c\n')
    rows = readers.read_zip_member(spark, str(tmp_path / "d.zip"), "train.csv")
    assert rows.columns == ["label", "text, long"] and sorted(tuple(r) for r in rows.collect()) == [("0", "c"), ("1", "a\nb")]
    there = {"/x/d.zip", "/y/train.csv", "/y/test.csv"}
    assert readers.find_source([None, "/z", "/y", "/x/d.zip"], there.__contains__) == "/y"
    assert readers.find_source(["/q", "/x/d.zip"], there.__contains__) == "/x/d.zip"
    with pytest.raises(FileNotFoundError):
        readers.find_source([None, "/q"], there.__contains__)


def test_listings(spark, tmp_path):
    (tmp_path / "l.csv").write_text("posting_id,image,image_phash,title,label_group\np1,a.jpg,00ff,Red bag,7\n")
    r = readers.read_listings(spark, str(tmp_path / "l.csv"), "/img/").first()
    assert (r.path, r.label_group) == ("/img/a.jpg", 7)


def test_pairs_of_all_layouts(spark, tmp_path):
    files = {
        "named.csv": 'english_sentence,hindi_sentence,id\n"a, b",x,1\n',
        "long.csv": "English words/sentences,Hindi words/sentences\na,x\n",
        "unknown.csv": "id,one,two\n1,a,x\n",
        "tab.txt": "a\tx\tby someone\nblank\t \nalone\n",
        "nested.jsonl": '{"translation": {"en": "a", "hi": "x"}}\n',
        "list.json": '{"data": [{"en": "a", "hi": "x"}]}',
        "array.json": '[{"english": "a",\n "hindi": "x"}]',
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    spark.createDataFrame([("a", "x")], "en string, hi string").write.parquet(str(tmp_path / "p.parquet"))
    for name in [*files, "p.parquet"]:
        got = [tuple(r) for r in readers.read_pairs(spark, str(tmp_path / name), ("en", "english"), ("hi", "hindi")).collect()]
        assert got == [("a, b" if name == "named.csv" else "a", "x")], name
    with pytest.raises(ValueError):
        readers.read_pairs(spark, str(tmp_path / "x.doc"), ("en",), ("hi",))


def test_folders_skip_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "train_en_hi.csv").write_text("en,hi\na,x\n")
    (tmp_path / "val.csv").write_text("only\n1\n")
    (tmp_path / "notes.md").write_text("no")
    (tmp_path / "sub" / "broken.json").write_text('{"a": ')
    (tmp_path / "sub" / "empty.csv").write_text("")
    (tmp_path / "test_long.tsv").write_text("english words\thindi words\tid\n" + "a\tx\t1\n" * 40)
    for limit in (1 << 20, 100):
        rows, report = readers.read_folder(spark, str(tmp_path), ("en", "english"), ("hi", "hindi"), whole_bytes=limit)
        assert sorted(tuple(r)[1:] for r in rows.collect()) == sorted([("a", "x", "train")] + [("a", "x", "test")] * 40)
        got = sorted((r.path.rsplit("/", 1)[1], r.rows, r.problem) for r in report.collect())
        assert got == [("broken.json", 0, "JSONDecodeError"), ("test_long.tsv", 40, None), ("train_en_hi.csv", 1, None), ("val.csv", 0, "ValueError")]
    assert readers.infer_languages(["data/README", "data/en_fr_train.csv"]) == ("en", "fr") and readers.infer_languages(["a_b"]) == ("en", "hi")


def test_folders_of_all_layouts_in_one_job(spark, tmp_path):
    import json

    layouts = [("named.csv", 'english_sentence,hindi_sentence,id\n"a, ""b""",x,1\n'), ("unknown.csv", "id,one,two\n1,a,x\n"), ("tab.txt", "a\tx\tby someone\nblank\t \nalone\n"), ("nested.jsonl", '{"translation": {"en": "a", "hi": "x"}}\n\n'), ("list.json", '{"data": [{"en": "a", "hi": "x"}]}'), ("array.json", '[{"english": "a",\n "hindi": "x"}]')]
    for k in range(60):
        for name, content in layouts:
            (tmp_path / f"{k}_{name}").write_text(content)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folder", "one job")
    rows, report = readers.read_folder(spark, str(tmp_path), ("en", "english"), ("hi", "hindi"))
    jobs = len(tracker.getJobIdsForGroup("folder"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3  # listing, reading, and whether there are large files
    assert rows.count() == 360 and {(r.src, r.tgt) for r in rows.collect()} == {("a", "x"), ('a, "b"', "x")}
    assert report.where("problem IS NULL AND rows = 1").count() == 360
    assert json.dumps(sorted(rows.columns)) == '["path", "split", "src", "tgt"]'


def test_rows_written_are_read_back(spark, tmp_path):
    rows = [(1, 'a "b", c\nd'), (2, None), (3, ""), (4, "漢 é")]
    df = spark.createDataFrame(rows, "n long, s string")
    for kind in ("csv", "json"):
        readers.write_rows(df, str(tmp_path / kind), kind)
        assert sorted(tuple(r) for r in readers.read_back(spark, str(tmp_path / kind), kind, "n long, s string").collect()) == rows
    with pytest.raises(ValueError):
        readers.write_rows(df, str(tmp_path / "x"), "xml")


def test_columns_are_chosen_by_their_names():
    pick = readers.resolve_pair
    assert pick(["hindi", "english", "en"], ("en", "english"), ("hi", "hindi")) == ("en", "hindi")
    assert pick(["Englisch", "EnglishText", "Hindi line"], ("en", "english"), ("hi", "hindi")) == ("EnglishText", "Hindi line")
    assert pick(["sentence", "then"], ("en",), ("hi",)) == ("sentence", "then")
    with pytest.raises(ValueError):
        pick(["sentence", "then", "this"], ("en",), ("hi",))
    assert readers.text_pair(["id", "Unnamed: 0", "p", "q"], ("en",), ("hi",)) == ("p", "q")
    assert readers.infer_languages(["x/train.csv", "x/fr-hi.test.tsv", "en_de.csv"]) == ("fr", "hi")


def test_flat_values_in_sql(spark):
    from quern.functions import sequences

    sequences.register(spark)
    spark.createDataFrame([(1, '{"a": [1, "x", {"b": "y"}], "c": {}, "d": null, "e": true}'), (2, "no json"), (3, None), (4, '"z"'), (5, "[" * 20_000)], "id long, j string").createOrReplaceTempView("nested")
    got = [tuple(r) for r in spark.sql("SELECT id, place, path, value FROM nested, LATERAL flat_values(j) ORDER BY id, place").collect()]
    assert got == [(1, 0, "a.0", "1"), (1, 1, "a.1", "x"), (1, 2, "a.2.b", "y"), (1, 3, "e", "true"), (4, 0, "", "z")]


def test_conversation_split(spark):
    from quern.operators.corpus_split import conversation_split

    ids = [(i,) for i in range(25)]
    given = spark.createDataFrame([(i, ["train", "val", "test"][i % 3]) for (i,) in ids], "conv_id long, split string")
    assert sorted(map(tuple, conversation_split(given).collect())) == sorted(map(tuple, given.collect()))
    for broken in ("NULL", "'other'"):
        some = given.selectExpr("conv_id", f"if(conv_id = 7, {broken}, split) AS split")
        got = conversation_split(some).groupBy("split").count().collect()
        assert {r.split: r["count"] for r in got} == {"test": 2, "val": 2, "train": 21}
    assert conversation_split(given.limit(0)).count() == 0


def test_document_store_and_lookup(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "4.json").write_text('{"10": {"x": ["ten", 1]}, "2": "two", "title": "T", "wikiDocumentIdx": 77}')
    (tmp_path / "docs" / "5.json").write_text('{"intro": "hello", "cast": ["a", "b"], "doc_id": "4.0"}')
    (tmp_path / "docs" / "6.json").write_text('{"n": 1}')
    got = {r.key: (r.full, r.sections) for r in readers.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert got == {"4": ("two ten", {"10": "ten", "2": "two"}), "77": ("two ten", {"10": "ten", "2": "two"}), "5": ("hello a b 4.0", {})}
    known = spark.createDataFrame([("4.0", "four"), ("4", "other"), (None, "none")], "k string, text string")
    rows = spark.createDataFrame([(1, " 4 ", None), (2, "4", "own"), (3, "9", None), (4, None, None)], "id long, k string, text string")
    assert {r.id: r.text for r in readers.lookup(rows, known, "k", "text").collect()} == {1: "four", 2: "own", 3: None, 4: None}
    assert [r.key for r in readers.lookup_misses(rows, known, "k").collect()] == ["9"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    assert readers.markdown_table(df) == "| n | s |\n| --- | --- |\n| 1 | a |"
    made = []
    for _ in range(2):
        rows = readers.kept(spark, str(tmp_path), "key", lambda: made.append(1) or df)
        assert rows.count() == 1
    assert len(made) == 1


def test_sequences(spark):
    from quern.functions import sequences

    row = spark.createDataFrame([(["a", ".", "b", "!", "c"], '{"x": ["p", {"y": "q"}], "n": 3}', {"0": "s one", "1": ""}, "2020-01-01 00:00:00", "2020-01-01 01:00:01", "bad")], "w array<string>, j string, m map<string, string>, a string, b string, c string")
    r = row.select(
        sequences.sentences(F.col("w")).alias("s"),
        sequences.padded(F.col("w"), 5).alias("p"),
        sequences.until_end(sequences.padded(F.col("w"), 5)).alias("u"),
        sequences.flat_text(F.col("j")).alias("f"),
        sequences.section_text(F.col("m"), F.lit(0), F.lit("full text"), 5).alias("s0"),
        sequences.section_text(F.col("m"), F.lit(1), F.lit("full text"), 1).alias("s1"),
        sequences.gap_seconds(F.col("a"), F.col("b")).alias("g"),
        sequences.gap_seconds(F.col("a"), F.col("c")).alias("g0"),
    ).first()
    assert r.s == [["a", "."], ["b", "!"], ["c"]] and r.p == ["<s>", "a", ".", "b", "</s>"] and r.u == ["a", ".", "b"]
    assert (r.f, r.s0, r.s1, r.g, r.g0) == ("p q", ["s", "one"], ["full"], 3601, None)
