import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.sources import readers as R
from rankloom.sources import writers as W
from rankloom.sources.tables import Table
from rankloom.streaming import ingest as I


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,parent_asin,rating,timestamp\nu,i,5.0,12\n\nv,j,1.0,13\n")
    assert R.ratings_csv(spark, str(tmp_path / "r.csv")).count() == 2
    (tmp_path / "m.jsonl").write_text('{"parent_asin":"a","title":"t","categories":["x"]}\n\n{bad\n')
    assert [r.title for r in R.item_meta(spark, str(tmp_path / "m.jsonl")).collect()] == ["t"]
    (tmp_path / "i.tsv").write_text('1\tA "quoted" title\tX\n2\t\tY\n3\n')
    assert [r.title for r in R.title_index(spark, str(tmp_path / "*.tsv")).collect()] == ['A "quoted" title']
    (tmp_path / "k.json").write_text(json.dumps({"ICML2024": {"p": {"title": "t"}}}))
    got = R.keyed_json(spark, str(tmp_path / "k.json"), T.StructType([T.StructField("title", T.StringType())])).collect()
    assert [tuple(r) for r in got] == [("ICML2024", "p", "t")]
    for p in ("CS/2020", "2021/CS"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "metadata.jsonl").write_text('{"arxiv_id":"1","title":"a"}\n{"arxiv_id":"2","found":false}\n')
    assert R.domain_papers(spark, str(tmp_path), ["CS", "Bio"], [2020, 2021, 2022]).count() == 2
    assert R.count_lines(spark, [str(tmp_path / "CS/2020")]) == 2 and not R.has_data(spark, str(tmp_path), "Bio", [2020])


def test_markdown_and_xml(spark, tmp_path):
    (tmp_path / "d/Acme").mkdir(parents=True)
    (tmp_path / "d/Acme/Acme_arxiv_20240102_My Paper.md").write_text("# My Paper\n\nhttp://arxiv.org/abs/2401.1v1\n")
    (tmp_path / "d/readme.md").write_text("# no")
    r = R.markdown_dir(spark, str(tmp_path / "d")).collect()
    assert [(x.title, x.company, x.venue, x.is_preprint, x.pub_year, x.paper_id) for x in r] == [("My Paper", "Acme", "arXiv", True, "2024", "Acme/Acme_arxiv_20240102_My Paper")]
    (tmp_path / "a.xml").write_text('<collection><volume id="long"><paper id="1"><title>Hi <b>x</b> y</title><author><first>A</first><last>B</last></author><url>u</url></paper></volume><volume id="demo"><paper id="2"><title>z</title></paper></volume></collection>')
    assert [(x.title, x.authors) for x in R.anthology_volumes(spark, str(tmp_path / "a.xml")).collect()] == [("Hi x y", "A B")]
    (tmp_path / "o.xml").write_text("<ListRecords><record><metadata><arXiv><id>1</id><title>T\n t</title><authors><author><keyname>K</keyname><forenames>F</forenames></author></authors></arXiv></metadata></record></ListRecords>")
    assert [tuple(x) for x in R.oai_pages(spark, str(tmp_path / "o.xml")).collect()] == [("1", "T t", "F K")]
    assert R.resumption_token("<resumptionToken cursor='1'>abc</resumptionToken>") == "abc" and R.resumption_token("<resumptionToken/>") is None


def test_papers_do_not_carry_the_text_of_their_volume(spark, tmp_path):
    """Rows that hold the volume beside each of its papers grow with the square of a file."""
    paper = lambda i: f'<paper id="{i}"><title>t{i}</title><author><first>A</first><last>B{i}</last></author></paper>'
    many = lambda name, of: f'<volume ingest="x" id="{name}">{"".join(paper(i) for i in of)}</volume>'
    (tmp_path / "v.xml").write_text(f"<collection>{many('long', range(300))}{many('demo', range(5))}{many('short', range(300, 400))}</collection>")
    got = R.anthology_volumes(spark, str(tmp_path / "v.xml"))
    assert sorted((r.volume, r.title, r.authors) for r in got.collect()) == sorted(("long" if i < 300 else "short", f"t{i}", f"A B{i}") for i in range(400))
    above_papers = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(")[0]
    assert not re.search(r"\bv#\d+", above_papers)


def test_writers_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("c", "train", 1), ("c", "test", 2)], "category string, split string, x int")
    W.write_splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    W.write_stats(spark.createDataFrame([("c", 1234, None)], "category string, n int, m int"), str(tmp_path / "st"))
    assert "1,234" in (tmp_path / "st/stats.md").read_text() and "—" in (tmp_path / "st/stats.md").read_text()
    src, target = str(tmp_path / "in"), str(tmp_path / "t")
    a = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    a.write.parquet(src)
    for _ in range(2):
        I.run_upsert(I.file_stream(spark, src, a), target, str(tmp_path / "ck"), ["k"], "v")
        spark.createDataFrame([("a", 3)], "k string, v int").write.mode("append").parquet(src)
    assert sorted((r.k, r.v) for r in Table(spark, target).read().collect()) == [("a", 3), ("b", 1)]
    meta = spark.createDataFrame([("a", "new")], "k string, t string")
    ix = spark.createDataFrame([("a", [1.0])], "k string, embedding array<double>")
    assert W.refresh_metadata(ix, meta, "k").first().t == "new"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_table_never_loses_its_rows(spark, tmp_path, monkeypatch):
    kv = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    t = Table(spark, str(tmp_path / "t"), ["k"], buckets=4)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.upsert(spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("v")), "v")
    before = {b: f for b, f in t.state()["buckets"].items()}
    t.upsert(kv(("k1", 5), ("k2", 0), (None, 1)), "v")
    t.upsert(kv((None, 2)), "v")
    got = dict(rows(t.read().filter("k is not null")))
    assert len(got) == 1000 and got["k1"] == 5 and got["k2"] == 1 and t.read().filter("k is null").first().v == 2
    assert sum(before[b] == f for b, f in t.state()["buckets"].items()) >= 1  # untouched buckets aren't rewritten
    # a crash after the data and before the commit changes nothing
    monkeypatch.setattr(Table, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        t.upsert(kv(("k1", 9)), "v")
    monkeypatch.undo()
    assert dict(rows(t.read().filter("k is not null")))["k1"] == 5
    # a replacement may read the table itself
    t.replace(t.read().filter("k = 'k1'"))
    assert rows(t.read()) == [("k1", 5)]
    # a commit that can't be read stops the next upsert instead of starting from nothing
    commits = sorted((tmp_path / "t/commits").glob("*.json"))
    (tmp_path / "t/commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].write_text('{"broken')
    with pytest.raises(ValueError):
        t.upsert(kv(("k7", 1)), "v")
    assert commits[-1].read_text() == '{"broken'


def test_unreadable_target_stops_the_stream(spark, tmp_path):
    src, target = str(tmp_path / "in"), tmp_path / "t"
    a = spark.createDataFrame([("a", 1)], "k string, v int")
    a.write.parquet(src)
    I.run_upsert(I.file_stream(spark, src, a), str(target), str(tmp_path / "ck"), ["k"], "v")
    for f in target.rglob("*.parquet"):
        f.write_bytes(b"x" * 40)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    a.write.mode("append").parquet(src)
    with pytest.raises(Exception, match="(?i)parquet|foreachBatch|Py4J"):
        I.run_upsert(I.file_stream(spark, src, a), str(target), str(tmp_path / "ck"), ["k"], "v")


def test_index_keeps_other_domains_and_tsv_stays_in_lines(spark, tmp_path):
    one = lambda d, v: spark.createDataFrame([(d, v)], "domain string, v int")
    for d, v in (("A", 1), ("B", 2), ("A", 3)):
        W.write_index(one(d, v), str(tmp_path / "ix"))
    assert rows(spark.read.parquet(str(tmp_path / "ix")).select("domain", "v")) == [("A", 3), ("B", 2)]
    df = spark.createDataFrame([("1", "a\tb\nc", "X"), ("1", "z", "X"), ("2", "t", None), (None, "n", "n")], "arxiv_id string, title string, first_author string")
    W.append_new_tsv(df, df.limit(0), str(tmp_path / "tsv"))
    W.append_new_tsv(df, R.title_index(spark, str(tmp_path / "tsv")), str(tmp_path / "tsv"))
    assert rows(R.title_index(spark, str(tmp_path / "tsv")).select("arxiv_id", "title")) == [("1", "a b c"), ("2", "t")]


def test_settings_and_table_of_contents(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("a:\n  b: 1\n  c: {d: x}\ne: [1, 2]\n")
    nested = R.load_config(spark, str(tmp_path / "c.yaml"))
    flat = R.flatten_config(nested)
    assert flat == {"a.b": 1, "a.c.d": "x", "e": [1, 2]} and R.nest_config(flat) == nested and R.flatten_config({}) == R.nest_config({}) == {}
    hits = [{"key": "k1", "info": {"type": "Conference", "title": "T.", "authors": {"author": {"text": "Ann Lee 0002"}}}}, {"key": "k2", "info": {"type": "Editorship", "title": "E", "authors": {"author": [{"text": "A"}, {"text": "B"}]}}}, {"key": "k3", "info": {"title": None}}]
    (tmp_path / "toc.jsonl").write_text("\n".join(json.dumps(h) for h in hits))
    assert sorted((r.key, r.type, r.title, r.authors) for r in R.toc_hits(spark, str(tmp_path / "toc.jsonl")).collect() if r.key != "k3") == [("k1", "Conference", "T.", "Ann Lee"), ("k2", "Editorship", "E", "A, B")]
    assert R.numbered_volumes([[{"a": 1}], [], [{"a": 2}]]) == [{"a": 1}]
