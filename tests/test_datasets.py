"""Whole datasets from protocol files of many forms: what each source gives, and which source counts."""

import pytest

from millrace.operators import datasets
from millrace.sources import protocols


@pytest.fixture
def tree(tmp_path):
    """Folders of five datasets."""

    def put(name: str, text: str = "RIFF") -> None:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    add = "add/ADD_train_dev"
    for name in ("train/a.wav", "train/sub/b.flac", "dev/c.wav", "dev/d.mp3", "test/e.wav"):
        put(f"{add}/{name}")
    put(f"{add}/label/train_label.txt", "# comment\na.wav fake 0.5-1.5 3:2\nalone\nsub/b.flac,genuine\nmissing fake 1-2 c\n")
    put(f"{add}/label/dev_label.txt", "c genuine 1-2\nd spoof 10 20 30\n")
    put(f"{add}/label/more.json", '{"data": [], "entries": [{"utt": "b", "label": "real", "segments": [[1, 2], {"x": 1}]}, {"id": "c", "note": "spoof"}, 7]}')
    put(f"{add}/protocols/x.tsv", "Utt\tclass\tstart\tend\tclass\nD\tfake\t9000\t7000\treal\nE\tfake\t1\t2\t\n")
    put(f"{add}/_manifests/label/old.csv", "path,label\na,real\n")
    for name in ("train/real/p.wav", "train/fake/q.wav", "dev/spoofed/r.ogg", "other/s.wav"):
        put(f"bare/{name}")
        put(f"ps/{name}")
    put("ps/protocols/one.csv", 'path,label,segments\np,fake,"[[1, 2]]"\n"q",real,1-2\n\nr.ogg,partial\n')
    put("bare/protocols/one.csv", "path,label\nnothing,fake\n")
    for name in ("u.wav", "dev/v.wav"):
        put(f"had/{name}")
        put(f"hadtext/{name}")
    put("had/list.csv", "path,label,regions\nv,fake,0.00-1.20-T/1.20-2.50-F\n")
    put("had/list.txt", "u fake 1-2\n")
    put("hadtext/list.txt", "u fake 1-2\n")
    return tmp_path


def of(spark, tree, names):
    base = f"file:{tree}"
    kinds = {"add": "add", "bare": "partial", "ps": "partial", "had": "had", "hadtext": "had"}
    bases = spark.createDataFrame([(n, kinds[n], f"{base}/{n}") for n in names], "dataset string, kind string, base string")
    listed = protocols.listing(spark, str(tree))
    files = listed.selectExpr(f"split(substr(path, {len(base) + 2}), '/')[0] AS dataset", "path")
    clips, segments = datasets.manifests(protocols.entries(spark, str(tree)), files, bases)
    cut = lambda p: p[len(base) + 1 :]
    return sorted((r["dataset"], r["subset"], cut(r["path"]), r["label"]) for r in clips.collect()), sorted((r["dataset"], r["subset"], cut(r["path"]), r["start_sec"], r["end_sec"]) for r in segments.collect())


def test_official_lists_extra_tables_and_json(spark, tree):
    clips, segments = of(spark, tree, ["add"])
    root = "add/ADD_train_dev"
    assert clips == [
        ("add", "dev", f"{root}/dev/c.wav", "real"),
        ("add", "dev", f"{root}/dev/d.mp3", "fake"),
        ("add", "train", f"{root}/dev/c.wav", "fake"),  # the missing token's last field, and the item without a label field
        ("add", "train", f"{root}/dev/d.mp3", "fake"),
        ("add", "train", f"{root}/train/a.wav", "fake"),
        ("add", "train", f"{root}/train/sub/b.flac", "real"),
    ]
    assert segments == [
        ("add", "dev", f"{root}/dev/d.mp3", 10.0, 20.0),
        ("add", "train", f"{root}/dev/c.wav", 1.0, 2.0),
        ("add", "train", f"{root}/dev/d.mp3", 7.0, 9.0),
        ("add", "train", f"{root}/train/a.wav", 0.5, 1.5),
        ("add", "train", f"{root}/train/a.wav", 2.0, 3.0),
        ("add", "train", f"{root}/train/sub/b.flac", 1.0, 2.0),  # a real item of JSON keeps its spans
    ]


def test_folders_label_only_where_no_protocol_meets_a_file(spark, tree):
    clips, segments = of(spark, tree, ["bare", "ps"])
    assert clips == [
        ("bare", "dev", "bare/dev/spoofed/r.ogg", "fake"),
        ("bare", "train", "bare/train/fake/q.wav", "fake"),
        ("bare", "train", "bare/train/real/p.wav", "real"),
        ("ps", "train", "ps/dev/spoofed/r.ogg", "fake"),
        ("ps", "train", "ps/train/fake/q.wav", "real"),
        ("ps", "train", "ps/train/real/p.wav", "fake"),
    ]
    assert segments == [("ps", "train", "ps/train/real/p.wav", 1.0, 2.0)]


def test_lines_count_only_where_no_table_is(spark, tree):
    clips, segments = of(spark, tree, ["had", "hadtext"])
    assert clips == [("had", "train", "had/dev/v.wav", "fake"), ("hadtext", "train", "hadtext/u.wav", "fake")]
    assert segments == [("had", "train", "had/dev/v.wav", 0.0, 1.2), ("had", "train", "had/dev/v.wav", 1.2, 2.5), ("hadtext", "train", "hadtext/u.wav", 1.0, 2.0)]


def test_empty_tables_give_empty_manifests(spark):
    entries = spark.createDataFrame([], f"file string, token string, last string, label string, segs {protocols.SEGS}")
    files, bases = spark.createDataFrame([], "dataset string, path string"), spark.createDataFrame([("x", "add", "/x")], "dataset string, kind string, base string")
    assert [m.count() for m in datasets.manifests(entries, files, bases)] == [0, 0]


def test_tables_of_many_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Path,Label,path\n"x,1",real,y\nshort\nlong,fake,z,more\n')
    (tmp_path / "b.tsv").write_text("utt\tnote\nq,r\t\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("path,label\n")
    rows = sorted(sorted(r["row"].items()) for r in protocols.tables(spark, str(tmp_path)).collect())
    assert rows == [[("label", ""), ("path", "short")], [("label", "fake"), ("path", "long")], [("label", "real"), ("path", "x,1")], [("note", ""), ("utt", "q,r")]]


def test_a_file_in_many_splits_has_one_header(spark, tmp_path):
    (tmp_path / "big.csv").write_text("path,label\n" + "".join(f"clip{i},fake\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        read = protocols.row_entries(protocols.tables(spark, str(tmp_path)))
        assert read.count() == 20_000 and read.select("token").distinct().count() == 20_000 and read.filter("label != 'fake'").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
