import gzip
import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkinsight.plans import report as RP
from sparkinsight.plans.pipeline import run_pipeline, run_step
from sparkinsight.sources import files as S
from sparkinsight.sources.catalog import Catalog, with_dense_ids


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_csv_inference(spark):
    d = tempfile.mkdtemp()
    _write(os.path.join(d, "a.csv"), "id,price,flag,name,when\n1,2.5,True,x,2024-01-01\n2,NA,False,,2024-01-02\n"
                                     "3,1e3,true,NULL,2024-01-03\n")
    df = S.read_csv(spark, os.path.join(d, "a.csv"))
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "price": "double", "flag": "boolean", "name": "string", "when": "string"}
    assert df.where(F.col("price").isNull()).count() == 1
    assert df.where(F.col("name").isNull()).count() == 2


def test_read_any_dispatch(spark):
    with pytest.raises(ValueError, match="Unsupported file type"):
        S.read_any(spark, "/tmp/x.xlsx")


def test_text_documents_and_hash(spark):
    d = tempfile.mkdtemp()
    _write(os.path.join(d, "one.txt"), "hello world")
    _write(os.path.join(d, "two.txt"), "second\ndocument")
    docs = {r["source"]: r["text"] for r in S.read_text_documents(spark, d).collect()}
    assert docs == {"one.txt": "hello world", "two.txt": "second\ndocument"}
    import hashlib
    h = {r["file"]: r["hash"] for r in S.content_hash(spark, d).collect()}
    assert h["one.txt"] == hashlib.sha256(b"hello world").hexdigest()[:12]


def _small_blocks(spark, monkeypatch, folder):
    """Blocks of 4 KB, files read in pieces of 1 KB, and what hashlib says of every file."""
    monkeypatch.setattr(S, "HASH_BLOCK", 4096)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return {f: hashlib.sha256(open(os.path.join(folder, f), "rb").read()).hexdigest()[:12] for f in os.listdir(folder)}


@pytest.fixture
def plain_reading(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_files_are_hashed_in_blocks(spark, monkeypatch, plain_reading):
    d, rng = tempfile.mkdtemp(), random.Random(1)
    noise = rng.randbytes(30_000)
    for name, data in {"noise %41[1].bin": noise, "feed.bin": noise[:20_000] + b"\n", "crlf.bin": b"a\r\n\r\n\n" * 3000, "lines.bin": b"\n" * 9000,
                       "mark.bin": b"\xef\xbb\xbf" + noise, "mark feed.bin": b"\xef\xbb\xbf\xef\xbb\xbf" + noise + b"\n", "one line.bin": b"x" * 13_000,
                       "small.bin": b"hello", "packed.bin.gz": gzip.compress(noise), "block.bin": b"y" * 4096, "more.bin": b"y" * 4097}.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    told = _small_blocks(spark, monkeypatch, d)
    rows = S.content_hash(spark, d).collect()
    assert sorted((r["file"], r["hash"]) for r in rows) == sorted(told.items())
    assert all(r["path"].endswith(d + "/" + r["file"]) for r in rows)
    assert [r["file"] for r in S.content_hash(spark, d, "sm*.bin").collect()] == ["small.bin"]
    # where the state of a hash cannot be had, one task hashes a file
    monkeypatch.setattr(S, "resumable", lambda: False)
    assert sorted((r["file"], r["hash"]) for r in S.content_hash(spark, d).collect()) == sorted(told.items())


def test_no_task_hashes_a_large_file_whole(spark, monkeypatch, plain_reading):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.bin"), "wb") as f:
        f.write(random.Random(2).randbytes(60_000))
    told = _small_blocks(spark, monkeypatch, d)
    taken, rounds = S.take_up, spark.sparkContext.accumulator(0)

    def bounded(batches):
        held = 0

        def counted():
            nonlocal held
            for b in batches:
                held += sum(len(x) for x in b.column("content").to_pylist())
                yield b
        yield from taken(counted())
        rounds.add(held > 0)
        assert held < 4096 + 2048 + 112

    monkeypatch.setattr(S, "take_up", bounded)
    assert [r["hash"] for r in S.content_hash(spark, d).collect()] == [told["a.bin"]]
    assert rounds.value == 15


def test_hashes_of_parts_in_order(spark, monkeypatch, plain_reading):
    """The query's text by language: parts one behind the other, whatever their number."""
    from sparkinsight.plans.registry import QUERIES
    _small_blocks(spark, monkeypatch, d := tempfile.mkdtemp())
    rows = [(i, None if i % 7 == 0 else f"t {i}\r\n" * (i % 5) if i > 3 else "\ufeffmark", ("en", "de", "x/y=%", None)[i % 4]) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(d + "/documents.parquet")
    want = {}
    for _i, text, lang in rows:
        want.setdefault(lang, hashlib.sha256()).update(((text or "") + "\n").encode())
    got = {r["lang"]: r["hash"] for r in QUERIES["content_hash_text"](spark, d).collect()}
    assert got == {("x%2Fy%3D%25" if k == "x/y=%" else k): h.hexdigest()[:12] for k, h in want.items() if k}


def test_union_fragments(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2, 3.0)], "k int, w double")
    empty = spark.createDataFrame([], "k int")
    out = S.union_fragments([a, empty, b])
    assert out.columns == ["k", "v", "w"] and out.count() == 2


def test_catalog_roundtrip(spark):
    cat = Catalog(spark, tempfile.mkdtemp() + "/cat")
    cat.bootstrap()
    cat.bootstrap()  # idempotent
    assert cat.register_dataset("a.csv", "csv", 10, 3, "/x/a.csv", "abc") == 1
    assert cat.register_dataset("b.csv", "csv", 5, 2, "/x/b.csv", "def") == 2
    assert [r["id"] for r in cat.list_datasets().collect()] == [2, 1]
    qa = spark.createDataFrame([("s1", None, f"q{i}", f"a{i}", "eda", i) for i in range(25)] +
                               [("s2", None, "q", "a", "ml", 100)],
                               "session_id string, dataset_id bigint, question string, answer string, agent string, t int")
    cat.save_queries(qa, ["t"])
    h = cat.get_history("s1").collect()
    assert len(h) == 20 and h[0]["question"] == "q24" and h[0]["id"] == 25
    assert cat.get_history().count() == 21
    rid = cat.save_model_run(1, "rf", "classification", "y", {"accuracy": 0.9}, {"trees": 100})
    runs = cat.list_model_runs(dataset_id=1).collect()
    assert rid == 1 and runs[0]["metrics"]["accuracy"] == 0.9
    assert cat.record_report(1, "/x/r.md") == 1


def test_dense_ids_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9)
    out = with_dense_ids(df, ["k"], 5).orderBy("k").collect()
    assert [r["id"] for r in out] == list(range(5, 1005))


def test_pipeline_and_report(spark, dirty_df):
    res = run_pipeline(dirty_df.withColumn("t", F.monotonically_increasing_id()), {"file_name": "d.csv",
                                                                                    "order_by": "t"})
    secs = res["report"].orderBy("section_no").collect()
    assert [s["heading"] for s in secs] == ["Data Ingestion Summary", "Data Cleaning", "Exploratory Data Analysis",
                                            "Business Insights & Recommendations"]
    assert run_step("nope", dirty_df) is None
    paras = RP.report_paragraphs(res["report"]).collect()
    assert len(paras) >= 3
    out = RP.write_report(res["report"], tempfile.mkdtemp() + "/r", "Title")
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert text.startswith("# Title") and "## Data Cleaning" in text
    empty = RP.report_sections(spark, {}).first()
    assert (empty["heading"], empty["content"]) == RP.FALLBACK


def test_streaming_chunk_ingest(spark):
    from sparkinsight.streaming.ingest import start_chunk_stream, store_view
    base = tempfile.mkdtemp()
    src, log, ck = base + "/in", base + "/log", base + "/ck"
    docs = spark.createDataFrame([(1, "alpha " * 300, "en", "s", 1800), (2, "beta", "en", "s", 4)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(src + "/b1")
    q = start_chunk_stream(spark, src + "/*", log, ck)
    q.awaitTermination(120)
    first = store_view(spark, log).count()
    spark.createDataFrame([(3, "beta", "en", "t", 4)], docs.schema).write.parquet(src + "/b2")
    q = start_chunk_stream(spark, src + "/*", log, ck)
    q.awaitTermination(120)
    store = store_view(spark, log)
    assert first == 4 and store.count() == 4  # same text -> same id: last write wins
    assert store.where(F.col("text") == "beta").first()["doc_id"] == 3


def test_ship_package_and_read_any(spark):
    from sparkinsight.session import _SHIPPED, ship_package
    ship_package(spark)
    assert spark.sparkContext.applicationId in _SHIPPED
    d = tempfile.mkdtemp()
    spark.createDataFrame([(1, float("nan")), (2, 2.5)], "k long, v double").write.parquet(d + "/t.parquet")
    df = S.read_any(spark, d + "/t.parquet")
    assert df.where(F.col("v").isNull()).count() == 1  # NaN normalised to NULL
    _write(d + "/c.csv", "a,b\n1,x\n")
    assert S.read_any(spark, d + "/c.csv").dtypes == [("a", "bigint"), ("b", "string")]


def test_csv_quotes_line_breaks_and_wide_integers(spark):
    d = tempfile.mkdtemp()
    _write(d + "/q.csv", 'n,t,w,x\n1,"he said ""hi"", ok",12345678901234567890,' + "9" * 45
           + '\n2,"two\nlines",5,1\n')
    df = S.read_csv(spark, d + "/q.csv")
    assert df.dtypes == [("n", "bigint"), ("t", "string"), ("w", "decimal(38,0)"), ("x", "string")]
    rows = {r["n"]: r for r in df.collect()}
    assert rows[1]["t"] == 'he said "hi", ok' and rows[2]["t"] == "two\nlines"
    assert int(rows[1]["w"]) == 12345678901234567890 and rows[1]["x"] == "9" * 45


def test_clean_keeps_wide_integers(spark):
    from sparkinsight.operators.cleaning import infer_types
    df = spark.createDataFrame([("12345678901234567890", "7"), ("1", "8")], "w string, s string")
    out = infer_types(df)
    assert out.dtypes == [("w", "decimal(38,0)"), ("s", "bigint")]
    assert out.where("w is null").count() == 0


def test_fragments_have_a_header_row(spark):
    from sparkinsight.sources.files import fragment_frame, union_fragments
    one = fragment_frame(spark, [["a", None, "a"], [1, 2, 3], [4, None]])
    assert one.columns == ["a", "_1", "a_2"] and [tuple(r) for r in one.collect()] == [("1", "2", "3"), ("4", None, None)]
    assert fragment_frame(spark, [["a", "b"]]) is None and fragment_frame(spark, []) is None
    both = union_fragments([one, None, fragment_frame(spark, [["b", "a"], ["x", "y"]])])
    assert both.columns == ["a", "_1", "a_2", "b"] and both.count() == 3


def test_all_eight_steps_and_six_sections(spark, sample_df):
    """Every routing target runs; the report has all sections in order, saved and recorded."""
    from pyspark.sql import functions as F
    from sparkinsight.operators.routing import INTENTS
    from sparkinsight.plans.pipeline import STEPS
    from sparkinsight.session import scratch_path
    from sparkinsight.sources.catalog import Catalog
    assert set(STEPS) == {name for name, _ in INTENTS}
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    cat.bootstrap()
    df = sample_df.withColumn("t", F.monotonically_increasing_id())
    docs = spark.createDataFrame([(1, "s1", "the salary of a sales person"), (2, "s2", "whales swim in oceans")], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(1, "Which whales swim?"), (2, "zzz")], "query_id long, question string")
    out = scratch_path(spark, "report")
    cfg = {"file_name": "people.csv", "order_by": "t", "target": "churn", "keys": ["t"], "cv_folds": 0, "epochs": 3, "catalog": cat,
           "dataset_id": 3, "documents": docs, "questions": asked, "report_path": out, "title": "People",
           "clean": {"encode_categoricals": False}}
    res = run_pipeline(df, cfg, steps=("ingestion", "cleaning", "eda", "ml", "dl", "rag", "insight"))
    assert not [k for k, v in res.items() if isinstance(v, dict) and "error" in v], res
    told = res["report"].orderBy("section_no").collect()
    assert [r["heading"] for r in told] == list(RP.HEADINGS.values()) and [r["section_no"] for r in told] == [1, 2, 3, 4, 5, 6]
    by = {r["heading"]: r["content"] for r in told}
    assert by["Data Ingestion Summary"].startswith("File: people.csv  |  Rows: 200  |  Columns: 6  |  Missing: 0.0%")
    assert by["Data Cleaning"].startswith("Shape before: (200, 6)  →  after: (200, 6)")
    assert "Task: classification  |  Best Model: " in by["Machine Learning Results"] and "**Random Forest**: accuracy=" in by["Machine Learning Results"]
    assert by["Deep Learning Results"].startswith("Model: MLP  |  Task: classification\n\n• accuracy: ")
    assert res["report_kpis"].count() == RP.REPORT_KPIS
    prompts = {r["query_id"]: r for r in res["rag"]["prompts"].collect()}
    assert "whales" in prompts[1]["context"] and prompts[2]["prompt"] is None
    assert cat.list_model_runs(3).count() == 3
    text = "\n".join(r["value"] for r in spark.read.text(out).collect())
    assert text.startswith("# People") and text.index("## Data Cleaning") < text.index("## Business Insights")
    ahead = run_step("dl", df, {"target": "salary", "order_by": "t", "dl_mode": "forecast"})
    assert ahead["section"].first()["content"].startswith("Model: Lag model  |  Task: time_series_forecast\n\n• rmse: ")
    broken = run_pipeline(df, {"order_by": "no such column"})
    assert "error" in broken["eda"] and broken["report"].count() == 3


def test_one_text_file_per_key(spark, tmp_path):
    """Files as Spark's partitioned text writer names and fills them: escaped, non-ASCII, null and repeated keys, null and empty texts."""
    rows = [("a", "one"), ("a", "one"), ("b/c=d", "x\ny"), ("é%", "ü"), (None, "none"), ("", "empty"), ("n", None), ("m", "")]
    docs = spark.createDataFrame(rows, "key string, text string")
    S.write_text_documents(docs, str(tmp_path / "mine"), "key", "text")
    docs.repartition("key").write.partitionBy("key").text(str(tmp_path / "spark"))
    mine, plain = (sorted((r["key"] or "", r["text"]) for r in S.read_text_documents(spark, str(tmp_path / d)).collect()) for d in ("mine", "spark"))
    assert [r for r in mine if r[0]] == [r for r in plain if r[0]]
    assert sorted("".join(t for k, t in mine if not k).split("\n")) == sorted("".join(t for k, t in plain if not k).split("\n"))
    assert not [f for f in tmp_path.joinpath("mine").rglob("_part*")]


@pytest.mark.parametrize("shared", [True, False])
def test_text_files_listed_by_tasks(spark, tmp_path, monkeypatch, shared):
    """With the key named no file list is held by the driver, and the files are those that Spark's reader finds."""
    rows = [("a", "one"), ("a", "two"), ("b/c=d", "x\ny"), ("é%", "ü"), ("07", "seven"), (None, "none"), ("n", None), ("m", "")]
    S.write_text_documents(spark.createDataFrame(rows, "key string, text string"), str(tmp_path), "key", "text")
    (tmp_path / "key=raw").mkdir()
    for name, held in (("one.txt", b"\xff bad \xc3"), ("_hidden", b"x"), (".crc", b"x"), ("empty.txt", b"")):
        (tmp_path / "key=raw" / name).write_bytes(held)
    (tmp_path / "other").mkdir()
    monkeypatch.setattr(S, "TEXT_AT_ONCE", 4)
    monkeypatch.setattr(S, "FOLDERS_AT_ONCE", 2)
    if not shared:
        monkeypatch.setattr(S, "_shared_root", lambda *_: None)
    mine = S.read_text_documents(spark, str(tmp_path), "key")
    assert ("FileScan" in mine._jdf.queryExecution().toString()) != shared and (mine.inputFiles() == []) == shared
    plain = S.read_text_documents(spark, str(tmp_path))
    assert mine.dtypes == [("source", "string"), ("text", "string"), ("key", "string")]
    found = sorted(tuple(r) for r in mine.fillna("-", ["key"]).collect())
    assert found == sorted(tuple(r) for r in plain.fillna("-", ["key"]).collect()) and len(found) == 8
    assert ("part.txt", "seven\n", "07") in found


def test_later_steps_read_the_cleaned_table(spark):
    """The cleaned frame is written once; the steps behind it do not clean again."""
    rows = [(i, float(i % 7), str(i % 5)) for i in range(60)]
    res = run_pipeline(spark.createDataFrame(rows, "k bigint, x double, t string"), {"order_by": "k"}, steps=("cleaning",))
    assert res["cleaning"]["frame"]._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation")
    assert res["cleaning"]["frame"].count() == 60
