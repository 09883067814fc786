"""The fetch source with a stand-in transport, and CSV records found in parallel against the multi-line reader."""

import csv
import io
import random

import pytest

from tonewise.sources import corpora, fetch, records, timeline


def wanted(n, pages):
    kind = n % 6
    status, error, tried = [(200, None, 1), (200, None, 2), (503, "too many requests", 3), (200, None, 3), (404, "not found", 1), (None, "no answer: unreachable", 3)][kind]
    return str(n), pages[n] if status == 200 else None, status, error, tried


def test_fetch_source_serves_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    options = {"transport": "tests.transports:from_pages", "table": f"{sf}/pages.parquet", "backoff": "0", "perPartition": "7", "url": "http://nowhere/{username}"}
    spark.dataSource.register(fetch.PageSource)
    names = ",".join(map(str, pages))
    got = spark.read.format("profile_pages").options(**options).option("users", f"{names}, 0 ,,0").load()
    assert got.rdd.getNumPartitions() == -(-len(pages) // 7)
    want = sorted(wanted(n, pages) for n in pages)
    assert sorted(map(tuple, got.collect())) == want
    parsed = timeline.parse_pages(got.where("status = 200"))
    assert {r["username"]: r["status"] for r in parsed.collect()} == {w[0]: "no_data" for w in want if w[2] == 200}
    users = spark.createDataFrame([(str(n),) for n in pages] * 2 + [(None,), (" ",)], "username string")
    assert sorted(map(tuple, fetch.fetched(users, options).collect())) == want
    assert fetch.fetched(users.limit(0), options).count() == 0
    assert spark.read.format("profile_pages").options(**options).load().count() == 0


def test_fetch_waits_and_rotates():
    slept, seen = [], []

    def get(url, headers, timeout):
        seen.append((url, headers["User-Agent"], timeout))
        return 429, ""

    assert fetch.fetch("a b/c", get, {}, slept.append) == ("a b/c", None, 429, "too many requests", 3)
    assert slept == [1.5, 3.0] and len({a for _, a, _ in seen}) == 3 and {u for u, *_ in seen} == {fetch.URL.replace("{username}", "a%20b%2Fc")}
    assert fetch.fetch("x", lambda *a: (500, "oops"), {}, slept.append) == ("x", None, 500, "status 500", 1)
    answers = iter([OSError("gone"), (200, "page")])

    def once(*a):
        x = next(answers)
        if isinstance(x, OSError):
            raise x
        return x

    assert fetch.fetch("x", once, {}, slept.append) == ("x", "page", 200, None, 2)


def made(rng, rows, quote=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, quoting=quote, lineterminator=end)
    w.writerow(["text", "is_toxic", "lang"])
    for _ in range(rows):
        text = "".join(rng.choices(['"', "\n", ",", "a", "é", " ", "word", '""', "\r\n"], k=rng.randrange(8)))
        row = [text, rng.choice(["0", "1", "1.0", "", "x"]), rng.choice(["en", "EN-us", "", "unknown"])]
        w.writerow(row if rng.random() > 0.05 else [*row, "more"] if rng.random() > 0.5 else row[:2])
    return out.getvalue()


def read(spark, path, split):
    rows = corpora.from_csv(spark, path, split).orderBy("row_id").select("text", "is_toxic", "lang")
    return list(map(tuple, rows.collect()))


@pytest.mark.parametrize("block", [100, 1_000_000])
def test_records_as_the_multi_line_reader(spark, tmp_path, block):
    rng = random.Random(block)
    n = min(60, block // 8)
    files = [made(rng, n), made(rng, n, csv.QUOTE_ALL), made(rng, 0), made(rng, n, end="\r\n"), "text,is_toxic,lang", 'text,is_toxic,lang\n"' + "long\n" * 5 * n + '",1,en\nlast,0,de\n']
    for i, text in enumerate(files):
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    try:
        for key, value in zip(keys, (block, 1, 1), strict=True):
            spark.conf.set(key, str(value))
        if block == 100:
            assert records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 6
        assert records.irregular(records.records(spark, str(tmp_path))).count() == 0
        assert read(spark, str(tmp_path), True) == read(spark, str(tmp_path), False)
    finally:
        for key in keys:
            spark.conf.unset(key)


@pytest.mark.parametrize("bad", ['a "bare" quote,1,en', '5" tall,0,en', 'open,"1,en', '"x"y,1,en'])
def test_irregular_files_get_the_other_reader(spark, tmp_path, bad):
    (tmp_path / "good.csv").write_text('text,is_toxic,lang\n"two\nlines",1,en\nplain,0,de\n')
    (tmp_path / "odd.csv").write_text(f"text,is_toxic,lang\nfirst,1,en\n{bad}\nlast,0,fr\n")
    found = records.records(spark, str(tmp_path))
    assert [r["file"].rsplit("/", 1)[1] for r in records.irregular(found).collect()] == ["odd.csv"]
    assert read(spark, str(tmp_path), True) == read(spark, str(tmp_path), False)


def test_other_columns_and_missing_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lang,id,is_toxic,text\nde,7,1,ein Text\n")
    assert read(spark, str(tmp_path / "a.csv"), True) == [("ein Text", 1, "de")]
    (tmp_path / "b.csv").write_text("words,is_toxic,lang\nx,1,en\n")
    with pytest.raises(ValueError, match="text"):
        corpora.from_csv(spark, str(tmp_path / "b.csv"))


def test_many_blocks_use_the_other_reader(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('text,is_toxic,lang\n"x\ny",1,en\n')
    monkeypatch.setattr(records, "BROADCAST_BLOCKS", 0)
    assert records.records(spark, str(tmp_path / "a.csv")) is None
    assert read(spark, str(tmp_path / "a.csv"), True) == [("x\ny", 1, "en")]


def test_entities_are_resolved_in_bounded_batches(spark):
    import html

    from pyspark.sql import functions as F

    from tonewise.sources import timeline

    texts = [None, "", "a", "&amp;lt;", "&lt;b&gt; &quot;x&quot; &amp;amp;", "&#39;&amp;", "&eacute;&lt", "&ampx;", "& &&lt;", "&amp;#39;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.select("i", timeline.unescaped(F.col("t")).alias("u")).orderBy("i").select("u").collect()]
    assert got == [t and html.unescape(t) for t in texts]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        timeline.parse_pages(spark.createDataFrame([("a", "x")], "username string, html string"))
        assert int(spark.conf.get(key)) <= 200
    finally:
        spark.conf.set(key, before)
