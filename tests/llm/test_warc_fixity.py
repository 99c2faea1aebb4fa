import hashlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from ledgerlake.llm.queries import SQL
from ledgerlake.llm.warc_fixity import audit, audited_records, contents, merkle_levels, op9_rows, read_warc, records, rotten, write_warc


def record(url, html):
    html = html or ""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()


def plain(rows):
    """rows: (page_id, url, html) -> {(file, seq): (page_id, offset, length, sha)}."""
    out, files = {}, {}
    for i, u, h in rows:
        text = record(u, h)
        sha = hashlib.sha256(text).hexdigest()
        files.setdefault(-1 - int(sha[:3], 16) if i is None else i >> 10, []).append((i is None, i or 0, sha, len(text)))
    for f, recs in files.items():
        at = 0
        for seq, (nameless, i, sha, n) in enumerate(sorted(recs)):
            out[f, seq] = (None if nameless else i, at, n, sha)
            at += n
    return out


def got(df):
    return {(r.file_no, r.seq): (r.page_id, r.record_offset, r.record_length, r.sha) for r in df.collect()}


ROWS = [(k * 37 - 900, f"http://h/{k}", f"<p>é{k}</p>" * (k % 5)) for k in range(300)] + [(5, None, None), (5, None, None), (None, "u", "x"), (None, None, None), (None, None, None), (1 << 40, "far", "y" * 100_000)]
ROWS += [(77, f"http://h/{k % 40}", "same id") for k in range(90)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, sha string")


def states(rows, other):
    """What an audit should say: how often each (page_id, sha) has each state."""
    a, b = (Counter((i, hashlib.sha256(record(u, h)).hexdigest()) for i, u, h in x) for x in (rows, other))
    out = Counter()
    for key in a.keys() | b.keys():
        instead = any(b[k] > a[k] for k in a.keys() | b.keys() if k[0] == key[0] and (key[0] is not None or k[1][:3] == key[1][:3]))
        out[(*key, "same")] += min(a[key], b[key])
        out[(*key, "changed" if instead else "missing")] += max(0, a[key] - b[key])
        out[(*key, "extra")] += max(0, b[key] - a[key])
    return +out


def test_records_and_audit_match_brute_force(spark):
    df = frame(spark, ROWS)
    assert got(records(contents(df))) == plain(ROWS)
    changed = [(i, u, (h or "") + "!" if k % 50 == 3 else h) for k, (i, u, h) in enumerate(ROWS) if k % 70 != 9] + [(1 << 41, "more", "z"), ROWS[20], (None, "new", "n")]
    found = audited_records(df, frame(spark, changed))
    assert Counter((r.page_id, r.sha, r.state) for r in found.collect()) == states(ROWS, changed)
    assert got(found.where("state <> 'extra'")) == plain(ROWS)
    assert audit(contents(df), contents(df)).count() == 0


def test_only_differing_branches_are_compared(spark):
    rows = [(k, "u", f"page {k}") for k in range(20_000)]
    for other in (rows[:777] + rows[778:], rows + [(777, "u", "one more")], [(i, u, "x" if i == 777 else h) for i, u, h in rows]):
        visits = []
        found = audit(contents(frame(spark, rows)), contents(frame(spark, other)), visits)
        assert {r.page_id for r in found.collect()} == {777}
        assert all(differ <= 2 for _, _, differ in visits) and visits[0][:2] == (1, 1)
        assert all(compared <= 16 * visits[k][2] for k, (_, compared, _) in enumerate(visits[1:])) and visits[-1][0] >= 19_999


def test_one_root_and_empty_tables(spark):
    df = frame(spark, ROWS)
    levels = merkle_levels(contents(df).withColumn("replica", F.lit(0)))
    assert levels[-1][0].count() == 1
    empty = df.limit(0)
    assert audit(contents(empty), contents(empty)).count() == 0
    assert audited_records(empty, empty).count() == 0
    assert audited_records(empty, df).where("state = 'extra'").count() == len(ROWS)
    assert audited_records(df, empty).where("state = 'missing'").count() == len(ROWS)


def test_pages_hold_every_kind_of_damage(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet")
    found = op9_rows(pages)
    other = [tuple(r) for r in rotten(pages).collect()]
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert Counter((r.page_id, r.sha, r.state) for r in found.collect()) == states(rows, other)
    assert {r.state for r in found.select("state").distinct().collect()} == {"same", "changed", "missing", "extra"}


def test_sql_agrees_on_odd_rows(spark):
    df = frame(spark, ROWS).select("page_id", "url", "html")
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}).pipe(lambda x: __import__("pyarrow").Table.from_pandas(x, preserve_index=False)))
    cols = ["page_id", "file_no", "seq", "record_offset", "record_length", "sha", "state"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL['op9_warc_fixity']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in op9_rows(df).collect())


def test_files_round_trip(spark, tmp_path):
    inside = record("http://x/", "a page about WARC") + b"tail"
    rows = [*ROWS, (3000, "http://quotes", f"see WARC/1.1\r\n and {inside.decode()} end"), (3001, "after", "one"), (3002, "two", "WARC/1.1\r\nWARC/1.1\r\n")]
    df = frame(spark, rows)
    write_warc(df, f"file://{tmp_path}/w")
    back = read_warc(spark, f"file://{tmp_path}/w")
    assert sorted((r.url, r.html) for r in back.collect()) == sorted((u or "", h or "") for _, u, h in rows)
    assert back.where("not sound").count() == 0
    for f in tmp_path.glob("w/file_no=*"):
        data = next(f.glob("part-*")).read_bytes()
        for (file, _), (_, at, n, sha) in plain(rows).items():
            if file == int(f.name.split("=")[1]):
                assert hashlib.sha256(data[at : at + n]).hexdigest() == sha
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(record("u", "a whole page") + record("v", "cut off")[:-8] + record("w", "whole again"))
    (cut / "b.warc").write_bytes(b"")
    assert sorted((r.url, r.sound) for r in read_warc(spark, f"file://{cut}").collect()) == [("u", True), ("v", False), ("w", True)]
