import hashlib

import pytest
from pyspark.sql import functions as F

from mailwarden.sources import files, harmonize as H


def test_discovery():
    r = H.discover_roles([" Body ", "LABEL", "From", "Urls"])
    assert (r["body"], r["label"], r["sender"], r["url"], r["subject"]) == (" Body ", "LABEL", "From", "Urls", None)
    r = H.discover_roles(["spam_flag", "raw_text"])
    assert r["label"] == "spam_flag" and r["body"] == "raw_text"
    assert H.discover_roles(["Label", "label "])["label"] == "label "
    assert H.discover_roles(["type_of_email"])["body"] is None


def test_labels(spark):
    raw = ["0", " Ham ", "NOT SPAM", "1", "Phish", "0.7", "1.9", "-0.5", "2", "maybe", None, "1d", "nan", "1e0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(H.label_value(F.col("v"))).collect()]
    assert got == [0, 0, 0, 1, 1, 0, 1, 0, None, None, None, None, None, 1]


def test_harmonize(spark):
    df = spark.createDataFrame([("nan", "hi", "spam", 7)], "Subject string, text string, label string, raw_row_id bigint")
    r = H.harmonize(df, "Ling").first()
    assert (r["sample_id"], r["subject"], r["body"], r["label"], r["sender"], r["url_count_source"]) == ("Ling_7", None, "hi", 1, None, None)
    assert H.harmonize_all({"a": df, "b": df}).count() == 2
    with pytest.raises(ValueError):
        H.harmonize(df.drop("label"), "x")


def test_violations(spark):
    good = spark.createDataFrame([("Ling_0", "Ling", 1, 0)], "sample_id string, dataset_id string, label int, raw_row_id bigint")
    assert H.violations(good).count() == 0
    bad = spark.createDataFrame([("a", "Ling", 5, 0), ("a", "other", 0, 1)], good.schema)
    got = {(r["rule"], r["value"]): r["n"] for r in H.violations(bad).collect()}
    assert got == {("invalid_label", "5"): 1, ("unknown_source", "other"): 1, ("duplicate_sample_id", "all"): 1}
    assert ("missing_column", "sample_id") in {(r["rule"], r["value"]) for r in H.violations(good.drop("sample_id")).collect()}


def test_csv(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a.csv").write_bytes('subject,body,label\ns0,"line 1\nline ""2""",0\nbad,b,1,extra\nshort,b\ns3,é,1\n'.encode())
    (d / "b.csv").write_bytes("subject,body,label\nx,\xe9,1\n".encode("latin-1"))
    a = files.read_corpus(spark, str(d / "a.csv"), "A").orderBy("raw_row_id").collect()
    assert [(r["raw_row_id"], r["subject"], r["body"], r["label"]) for r in a] == [
        (0, "s0", 'line 1\nline "2"', "0"), (1, "short", "b", None), (2, "s3", "é", "1")]
    assert files.read_corpus(spark, str(d / "b.csv"), "B").first()["body"] == "é"
    both = files.number_rows(spark.read.text(str(d)).select("value", "_metadata"))
    ids = [r["raw_row_id"] for r in both.filter("_metadata.file_name = 'a.csv'").collect()]
    assert sorted(ids) == list(range(len(ids)))
    found = {r["file"]: r for r in files.file_integrity(spark, str(d), min_bytes=40).collect()}
    assert found["a.csv"]["md5"] == hashlib.md5((d / "a.csv").read_bytes()).hexdigest()
    assert found["a.csv"]["is_usable"] and not found["b.csv"]["is_usable"]
    wrong = spark.createDataFrame([("b.csv", "0")], "file string, expected_md5 string")
    assert set(files.read_corpora(spark, str(d), {"A": "a.csv", "B": "b.csv", "C": "c.csv"}, wrong, 1)) == {"A"}


def test_splits_on_disk(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("x"), (F.col("id") % 2).cast("int").alias("label"),
                                 F.when(F.col("id") < 80, "train").otherwise("test").alias("split"))
    files.save_splits(df, str(tmp_path))
    assert files.load_split(spark, str(tmp_path), "test").count() == 20
    assert spark.read.json(f"{tmp_path}/metadata").count() == 4


AWKWARD = [
    'subject,body,label', 's0,"line 1\nline ""2"", a\n\n""\n",0', 'bad,b,1,extra', 'short,b', '', 's3,é,1', 'a 5" pipe,"x,\n"",\n,""",0',
    '"","",', '"' + "long line, with ""quotes""\n" * 40 + '",b,1', 'x,"ends\n",1', '"""","\n"""\n""",2', ',,', 's9,"tail\n1,2,3,4,5\n",0']


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [40, 97, 100000])
def test_csv_in_blocks_equals_one_task(spark, tmp_path, size, end):
    """Cut into any blocks, a file gives the rows of Spark's reader of whole files, numbered in file order."""
    d = tmp_path / "in"
    d.mkdir()
    for name, copies in (("a.csv", 1), ("b.csv", 7)):
        (d / name).write_bytes(end.join([AWKWARD[0], *AWKWARD[1:] * copies]).replace("\r\n", "\n").replace("\n", end).encode())
    (d / "c.csv").write_bytes(b"")
    whole = spark.read.csv(str(d), schema="subject string, body string, label string, over string", header=True, multiLine=True,
                           quote='"', escape='"', maxCharsPerColumn=-1, enforceSchema=True)
    expected = {}
    for r in whole.filter("over is null").select("*", "_metadata.file_name").collect():
        expected.setdefault(r["file_name"], []).append((r["subject"], r["body"], r["label"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for name in ("a.csv", "b.csv"):
            rows = files.read_corpus(spark, str(d / name), "A").orderBy("raw_row_id").collect()
            assert [r["raw_row_id"] for r in rows] == list(range(len(rows)))
            assert [(r["subject"], r["body"], r["label"]) for r in rows] == expected[name]
        assert files.read_corpus(spark, str(d), "A").count() == sum(map(len, expected.values()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_checksums_read_files_in_chunks(spark, tmp_path):
    data = {"a b%20.bin": bytes(range(256)) * 41, "empty": b"", "é.txt": b"x" * 1000, "sub/one": b"\x00"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")
    got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["md5"]) for r in files.file_checksums(listed, 7).collect()}
    assert got == {n.rsplit("/", 1)[-1]: (len(c), hashlib.md5(c).hexdigest()) for n, c in data.items() if c}      # Spark lists no empty files
    found = {r["file"]: r["md5"] for r in files.file_integrity(spark, str(tmp_path)).collect()}
    assert found == {n: hashlib.md5(c).hexdigest() for n, c in data.items() if c}


def test_corpus_of_several_files(spark, tmp_path):
    """Rows are numbered through all files; a corpus of several files is read without those that fail the manifest."""
    d = tmp_path / "in"
    d.mkdir()
    for name, rows in (("part-9.csv", ["a", "b"]), ("part-10.csv", ["c,\nd", "e"]), ("part-11.csv", []), ("part-12.csv", ["f"])):
        (d / name).write_text("\n".join(["body", *(f'"{r}"' for r in rows)]) + "\n")
    got = files.read_corpus(spark, str(d), "A", follow=True).orderBy("raw_row_id").collect()
    assert [(r["raw_row_id"], r["body"]) for r in got] == list(enumerate(["a", "b", "c,\nd", "e", "f"]))
    wrong = spark.createDataFrame([("part-9.csv", "0"), ("part-11.csv", "0")], "file string, expected_md5 string")
    found = files.read_corpora(spark, str(d), {"A": ["part-9.csv", "part-10.csv"], "B": ["part-11.csv"], "C": "part-12.csv"}, wrong, 1)
    assert {name: sorted(r["body"] for r in df.collect()) for name, df in found.items()} == {"A": ["c,\nd", "e"], "C": ["f"]}


@pytest.mark.parametrize("name", ["csv_corpus", "corpora_by_manifest"])
def test_corpora_are_written_by_many_tasks(spark, sf, tmp_path, monkeypatch, name):
    """No corpus is one file: the one task that writes it would read all rows."""
    import __spark_entry__ as entry
    from mailwarden.plans import corpus

    monkeypatch.setattr(corpus, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        entry.queries()[name](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = {}
    for r in spark.read.text(str(tmp_path), recursiveFileLookup=True).groupBy("_metadata.file_path").count().collect():
        folder, _ = r["file_path"].rsplit("/", 1)
        rows.setdefault(folder, []).append(r["count"])
    assert rows and all(max(n) < sum(n) for n in rows.values())
