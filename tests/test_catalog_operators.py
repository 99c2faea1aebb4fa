import math
import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import digests, names, texts
from ledgerlake.operators import cache, fixdat, identify, playlist, reconcile, rename, report, spans, stats


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_known_digests(spark):
    df = spark.createDataFrame([("",), ("abc",)], "t string")
    got = df.select(*(c.alias(a) for a, c in digests.digests(F.col("t")).items())).collect()
    assert (got[0].crc32, got[0].md5, got[0].sha1, got[0].size_bytes) == ("00000000", "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", 0)
    assert got[1].crc32 == "352441c2"


def test_digest_comparison(spark):
    assert value(spark, digests.crc_equal(F.lit("ABCD"), F.lit("0000abcd")))
    assert not value(spark, digests.hashes_equal(F.lit(" "), F.lit(" ")))
    assert value(spark, digests.hashes_equal(F.lit(" Aa "), F.lit("aA")))
    assert value(spark, digests.norm_crc(F.lit("123456789"))) == "123456789"
    assert digests.split_bounds(("crc32", "sha1"), "crc32", "sha256") == (("crc32",), ("sha1",))
    assert digests.split_bounds(("sha1", "crc32", "md5"), "md5", "sha256") == (("crc32", "md5"), ("sha1",))
    assert digests.split_bounds(("sha256",), "crc32", "sha256") == (("sha256",), ())
    assert digests.parse_algorithms("sha1, crc32,sha1") == ("crc32", "sha1")
    for bad in ((("md5",), "sha256", "crc32"), (("md5",), "x", "md5"), (("sha256",), "crc32", "sha1"), (("y",),)):
        with pytest.raises(ValueError):
            digests.split_bounds(*bad)


DISC_TOKENS = [
    ("Game (Disc 2)", ("Game", 2)), ("Game (Disc 10)", ("Game", 10)), ("Discworld (1995)", None), ("Game CD 3", None), ("Game (CD 2)", None), ("Game [Disc 1]", None), ("Game Disc2", None),
    ("Game-disc 2", None), ("Game (Disc 1) (Rev 2)", ("Game (Rev 2)", 1)), ("A (Disc 1) (Disc 2)", ("A (Disc 1)", 2)), ("Game (Disc 99999999999)", None), ("plain", None), ("Game (DISC 1 OF 3)", ("Game", 1)),
    ("Game Disc 2 of 3", ("Game", 2)), ("Game Disc 2 of x", None), ("Game  double (Disc 1)", ("Game  double", 1)), ("(Disc 3) Game", ("Game", 3)), ("Disc 2", ("", 2)), ("Game (Disc 1 x)", None), ("Disc 1 Disc 2", ("Disc 1", 2)), ("Game (Rev (Disc 4)", ("Game (Rev", 4)),
]


def test_disc_tokens(spark):
    df = spark.createDataFrame([(n,) for n, _ in DISC_TOKENS], "n string").withColumn("d", names.disc_parts(F.col("n")))
    assert {r.n: (r.d.base, r.d.disc) for r in df.collect()} == {n: want or (n, 0) for n, want in DISC_TOKENS}


def test_name_parts(spark):
    df = spark.createDataFrame([("a/b/Game.ISO",), (".hidden",), ("x.tar.gz",), ("dir.d/none",), ("a/__MACOSX/f.iso",), ("._f.iso",), ("b/.keep",), ("a/@eaDir/f",), ("x/#recycle/f",), ("$Recycle.bin/f",), ("THUMBS.DB",), ("a/Thumbs.db",), ("lost+found/f",)], "p string")
    got = rows(df.select("p", names.extension(F.col("p")), names.stem(F.col("p")), names.basename(F.col("p")), names.is_junk(F.col("p"))), "p")
    by = {r[0]: r[1:] for r in got}
    assert by["a/b/Game.ISO"] == ("iso", "Game", "Game.ISO", False)
    assert by[".hidden"][:2] == ("", ".hidden") and by["x.tar.gz"][:2] == ("gz", "x.tar") and by["dir.d/none"][:2] == ("", "none")
    assert {p for p, r in by.items() if r[3]} == {"._f.iso", "a/@eaDir/f", "x/#recycle/f", "$Recycle.bin/f", "a/Thumbs.db", "lost+found/f"}
    assert value(spark, names.sanitized_stem(F.lit('A: b?. '))) == "A_ b_"
    assert value(spark, names.sanitized_stem(F.lit("con"))) == "con_"
    assert value(spark, names.sanitized_stem(F.lit(" . "))) == "" and value(spark, names.sanitized_stem(F.lit("a\tb"))) == "a\tb"
    keys = ("A//b\\c/./D/", "a/b/c/d", "./A/b/c/d", "Ä/ß")
    assert [value(spark, names.collision_key(F.lit(k))) for k in keys] == ["a/b/c/d", "a/b/c/d", "a/b/c/d", "Ä/ß"]
    assert [value(spark, names.inner_kind(F.lit(k))) for k in ("a.RVZ", "b.zso", "c.z3dsx", "d.nsz", "e", ".cue")] == ["rvz", "cso_zso", "z3ds", "unsupported_compressed", "raw", "raw"]
    assert not value(spark, names.rereads_cheaply(F.lit("a.iso"), F.lit("gcz"))) and value(spark, names.rereads_cheaply(F.lit("a.iso"), F.lit(None).cast("string")))
    assert value(spark, names.derived_path(F.lit("d.x/a.iso"))) == "d.x/a.rvz"
    assert value(spark, names.derived_path(F.lit("d.x/a.nsz"), packing=False)) == "d.x/a.nsp"
    assert value(spark, names.place_in(F.lit("/r/s/f.iso"), "/o/", "/r")) == "/o/s/f.iso"


def test_texts(spark):
    assert value(spark, texts.xml_escape(F.lit("<a&'\">"))) == "&lt;a&amp;&apos;&quot;&gt;"
    assert value(spark, texts.html_escape(F.lit("'"))) == "&#39;"
    assert value(spark, texts.csv_field(F.lit('a,"b'))) == '"a,""b"'
    assert value(spark, texts.size_delta(F.lit(1_000_000), F.lit(1_063_268))) == "-63,268 B (-5.9503 %)"
    assert value(spark, texts.format_bytes(F.lit(1536))) == "1.5 KiB" and value(spark, texts.format_bytes(F.lit(12))) == "12 B"
    assert value(spark, texts.ratio_pct(F.lit(1048576), F.lit(262144))) == 75.0
    assert value(spark, texts.msf(F.lit(75 * 62 + 3))) == "01:02:03" and value(spark, texts.frames(F.lit("01:02:03"))) == 75 * 62 + 3
    assert value(spark, texts.is_power_of_two(F.lit(64))) and not value(spark, texts.is_power_of_two(F.lit(65)))
    langs = F.array(F.struct(F.lit("ja").alias("lang"), F.lit("J").alias("text")), F.struct(F.lit("en").alias("lang"), F.lit("E").alias("text")))
    assert value(spark, texts.preferred(langs)) == "E"


FILES = "file_id string, name string, size_bytes long, sha256 string, sha1 string, md5 string, crc32 string"
CATALOG = "catalog_id long, game_id long, file_name string, size_bytes long, sha256 string, sha1 string, md5 string, crc32 string"


def test_identify_takes_the_strongest_rung(spark):
    local = spark.createDataFrame([("a", "A.iso", 1, None, "s", "m", None), ("b", "B.iso", 2, None, None, None, "ABCD"), ("c", "C.iso", 3, None, " ", None, None), ("d", "D.iso", 4, None, None, None, None)], FILES)
    known = spark.createDataFrame([(1, 1, "x", 9, None, None, "M", None), (2, 2, "A.iso", 9, None, "S", None, None), (3, 3, "x", 2, None, None, None, "0000abcd"), (4, 4, "x", 7, None, None, None, "abcd"), (5, 5, "C.iso", 3, None, " ", None, None)], CATALOG)
    games = spark.createDataFrame([(2, "a"), (3, "other")], "game_id long, game_name string")
    got = {r.file_id: (r.catalog_id, r.match_algo, r.verdict) for r in identify.scan(local, known, games).collect()}
    assert got == {"a": (2, "sha1", "verified"), "b": (3, "crc32", "misnamed"), "c": (5, "name_size", "hint"), "d": (None, None, "unknown")}


def test_escalation_only_follows_hints(spark):
    local = spark.createDataFrame([("c", "C.iso", 3, None, None, None, None), ("d", "D.iso", 4, None, None, None, None)], FILES)
    known = spark.createDataFrame([(5, 5, "C.iso", 3, None, "s", None, None), (6, 6, "z", 1, None, "t", None, None)], CATALOG)
    first = identify.identify(local, known).withColumn("verdict", identify.verdict(F.col("rung"), F.col("name"), F.lit(None).cast("string")))
    asked = []

    def more(df):
        asked.extend(r.file_id for r in df.collect())
        return df.withColumn("sha1", F.lit("s"))

    got = {r.file_id: r.verdict for r in identify.escalate(first, more, known).collect()}
    assert got == {"c": "verified", "d": "unknown"} and asked == ["c"]


def test_fixdat_stops_at_the_strongest_catalog_digest(spark, tmp_path):
    local = spark.createDataFrame([("x", "x", 10, "aa", "bb", "cc", "1")], FILES)
    known = spark.createDataFrame([(1, 1, "other sha256", 10, "zz", "bb", None, None), (2, 1, "sha1 held", 10, None, "BB", None, None), (3, 2, "crc held", 10, None, None, None, "00000001"), (4, 2, "crc, other size", 11, None, None, None, "1"), (5, 3, "<no> & digest", 1234, None, None, None, None)], CATALOG)
    lost = fixdat.missing(known, local)
    assert sorted(r.catalog_id for r in lost.collect()) == [1, 4, 5]
    assert rows(fixdat.missing_by_game(known, local), "game_id") == [(1, 1), (2, 1), (3, 1)]
    out = lost.withColumns({"game_name": F.concat(F.lit("Game "), F.col("game_id")), "ordinal": F.col("catalog_id")})
    path = f"{tmp_path}/f.dat"
    assert fixdat.write_fixdat(out, path, "Test <Dat> & Co") == 3
    text = open(path).read()
    assert "<name>fixdat - Test &lt;Dat&gt; &amp; Co</name>" in text and '<rom name="&lt;no&gt; &amp; digest" size="1234"/>' in text
    assert text.index("Game 1") < text.index("Game 2") and text.endswith("</datafile>\n")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("in.iso", "out.cso", "compress", "ok", 1048576, 262144, 75.0, 1500, None)], "input_path string, output_path string, operation string, status string, input_bytes long, output_bytes long, ratio_pct double, elapsed_ms long, error string")
    report.write_report(df, f"{tmp_path}/r.csv", ["input_path"])
    assert open(f"{tmp_path}/r.csv").read().splitlines()[1] == "in.iso,out.cso,compress,ok,1048576,262144,75.0,1500,"
    report.write_report(df, f"{tmp_path}/r.json", ["input_path"])
    assert report.read_report(f"{tmp_path}/r.json")[0]["error"] is None
    report.write_report(df, f"{tmp_path}/r.html", ["input_path"])
    assert "<td>in.iso</td>" in open(f"{tmp_path}/r.html").read()
    assert os.listdir(tmp_path) and not [f for f in os.listdir(tmp_path) if f.startswith(".part")]
    both = df.unionByName(df.withColumn("status", F.lit("failed")))
    s, a, b = F.col("status"), F.col("input_bytes"), F.col("output_bytes")
    assert rows(report.tally(both, s, a, b)) == [(1, 0, 1, 1048576, 262144)]
    assert rows(report.runner_totals(both, s, a, b)) == [(1, 0, 1, 2097152, 524288)]
    assert rows(report.dat_totals(both, s, a)) == [(1, 0, 1, 2097152)]


def test_playlists(spark, tmp_path):
    df = spark.createDataFrame([(f"{tmp_path}/Game (Disc 10).cue",), (f"{tmp_path}/Game (Disc 2).cue",), (f"{tmp_path}/Game (Disc 2).chd",), (f"{tmp_path}/Discworld (1995).cue",)], "path string")
    got = {r.base: r for r in playlist.disc_groups(df).collect()}
    assert [os.path.basename(m) for m in got["Game"].members] == ["Game (Disc 2).chd", "Game (Disc 2).cue", "Game (Disc 10).cue"]
    assert got["Game"].duplicated and not got["Discworld (1995)"].duplicated
    assert playlist.write_playlists(playlist.disc_groups(df), str(tmp_path)) == 1
    assert open(tmp_path / "Game.m3u").read() == "Game (Disc 2).chd\nGame (Disc 2).cue\nGame (Disc 10).cue\n"


def test_rename_plans(spark, tmp_path):
    rows_ = [("dir/a.ISO", "g", "Game.", None, True), ("dir/b.iso", "g", "Same", None, True), ("dir/c.iso", "g", "same", None, True), ("dir/Set (Disc 1).iso", "g", "Alpha (Disc 1)", None, True), ("dir/Set (Disc 2).iso", "g", "Beta (Disc 2)", None, True),
             ("dir/Two (Disc 1).iso", "g", "Both (Disc 1)", None, True), ("dir/Two (Disc 2).iso", "g", "both (Disc 2)", None, True), ("dir/Weak (Disc 1).iso", "g", "Weak (Disc 1)", None, True), ("dir/Weak (Disc 2).iso", None, None, None, False),
             ("dir/Held.iso", "g", "held", None, True), ("dir/f.iso", "g", "F", None, False), ("dir/n.iso", None, None, None, True), ("dir/e.iso", "g", " . ", None, True), ("dir/raw.iso", "g", "Game", "Canon (USA).iso", True), ("dir/z.chd", "g", "Zed", "Canon.iso", True)]
    df = spark.createDataFrame(rows_, "path string, game_id string, game_name string, file_name string, verified boolean")
    got = {r.path.removeprefix("dir/"): (r.target, r.action, r.detail) for r in rename.rename_plan(df).collect()}
    assert got["a.ISO"] == ("dir/Game.iso", "rename", None) and got["raw.iso"][:2] == ("dir/Canon (USA).iso", "rename") and got["z.chd"][0] == "dir/Zed.chd"
    assert got["b.iso"] == got["c.iso"] == (None, "skip_collision", "two files map to the same target")
    assert got["Set (Disc 1).iso"] == got["Set (Disc 2).iso"] == (None, "skip_disc_set_conflict", "disc set resolves to different games")
    assert got["Weak (Disc 1).iso"][1:] == got["Weak (Disc 2).iso"][1:] == ("skip_disc_set_conflict", "disc set has an unmatched or weak member")
    assert got["Two (Disc 2).iso"][:2] == ("dir/both (Disc 2).iso", "rename") and got["Held.iso"][1] == "already_canonical"
    assert got["f.iso"][1:] == ("skip_weak_match", "name+size hint only") and got["n.iso"][1] == got["e.iso"][1] == "skip_unmatched"
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("1"), b.write_text("2")
    rename.execute([(str(a), str(b)), (str(b), str(a))])
    assert (a.read_text(), b.read_text()) == ("2", "1")
    (tmp_path / "c").write_text("3")
    with pytest.raises(FileExistsError):
        rename.execute([(str(a), str(tmp_path / "n")), (str(b), str(tmp_path / "c"))])
    assert (a.read_text(), b.read_text()) == ("2", "1")


def test_free_slots(spark):
    planned = spark.createDataFrame([("x/a.iso",), ("x/b.iso",)], "output string")
    there = spark.createDataFrame([("x/a.iso",), ("x/a (1).iso",), ("x/a (3).iso",)], "output string")
    assert {r.output: r.slot for r in rename.free_slots(planned, there).collect()} == {"x/a.iso": "x/a (2).iso", "x/b.iso": "x/b.iso"}


def test_reconciliation_is_greedy_and_whole(spark):
    kind = "set_id string, ordinal long, size_bytes long, sha256 string, sha1 string, md5 string, crc32 string"
    local = spark.createDataFrame([("p", 1, 5, None, "aaaa", None, None), ("q", 1, 100, None, None, None, "1234abcd"), ("r", 1, 5, None, "aaaa", None, None), ("r", 2, 5, None, "aaaa", None, None), ("s", 1, 5, "x", "aaaa", None, None)], kind)
    remote = spark.createDataFrame([("p", 1, 5, None, "aaaa", None, None, "t1.bin"), ("p", 2, 5, None, "bbbb", None, None, "t2.bin"), ("q", 1, 999, None, None, None, "1234abcd", "t.bin"), ("r", 1, 5, None, "aaaa", None, None, "t.bin"), ("s", 1, 5, "y", "AAAA", None, None, "t.bin")], kind + ", file_name string")
    got = {(r.set_id, r.ordinal): (r.remote_ordinal, r.algo, r.ok, r.missing) for r in reconcile.reconcile(local, remote).collect()}
    assert got["p", 1] == (1, "sha1", False, ["t2.bin"])
    assert got["q", 1] == (None, None, False, ["t.bin"])
    assert got["r", 1][:2] == (1, "sha1") and got["r", 2][:2] == (None, None)
    assert got["s", 1] == (1, "sha1", True, [])
    assert rows(reconcile.unused_remotes(reconcile.reconcile(local, remote), remote).select("set_id", "ordinal"), "set_id") == [("p", 2), ("q", 1)]


def test_cache(spark):
    entry = "path string, size long, mtime_secs long, mtime_nanos int, raw struct<crc32:string,sha1:string>, verify_valid map<string,boolean>"
    held = spark.createDataFrame([("a", 1, 10, 0, ("c", "s"), None), ("b", 1, 10, 0, ("c", None), {"full": True})], entry)
    files = spark.createDataFrame([("a", 1, 10, 0), ("b", 1, 10, 0), ("a", 2, 10, 0), ("a", 1, 10, 1)], "path string, size long, mtime_secs long, mtime_nanos int")
    assert cache.misses(files, held, ("sha1",)).count() == 3 and cache.misses(files, held, ("crc32",)).count() == 2
    fresh = held.where("path = 'a'").withColumn("size", F.lit(7).cast("long"))
    assert rows(cache.rebuilt(fresh, held).select("path", "size"), "path") == [("a", 7), ("b", 1)]
    got = cache.remember_valid(held, spark.createDataFrame([("a", "quick"), ("b", "quick"), ("b", "full")], "path string, label string"))
    assert {r.path: r.verify_valid for r in got.collect()} == {"a": {"quick": True}, "b": {"quick": True, "full": True}}
    assert cache.storable(files, 11.0).count() == 0 and cache.storable(files, 12.0).count() == 4


def test_spans_and_statistics(spark):
    df = spark.createDataFrame([(i * 5000 - 7000, i) for i in range(40)], "k long, v int")
    got = rows(spans.next_in_order(df, "k", "v").select("v", "next"), "v")
    assert got == [(i, i + 1 if i < 39 else None) for i in range(40)]
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5)], "node long, ref long")
    assert rows(spans.chased(links), "node") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, None), (6, None)]
    blocks = spark.createDataFrame([("a", 0, 0, False), ("a", 1, 5, True), ("a", 2, 9, False), ("b", 0, 4, False), ("b", 1, 3, True)], "container string, block_no long, offset long, raw boolean")
    sizes = spark.createDataFrame([("a", 9, 2), ("b", 4, 1)], "container string, size_bytes long, n_blocks long")
    assert rows(spans.index_faults(blocks, sizes), "container", "fault") == [("b", "end differs"), ("b", "end is raw"), ("b", "offset falls")]
    runs = spark.createDataFrame([("x", 1, 100.0), ("x", 2, 2.0), ("x", 3, 4.0)], "g string, k int, v double")
    assert rows(stats.warm(runs, ["g"], ["k"], "v")) == rows(stats.warm_by_window(runs, ["g"], ["k"], "v")) == [("x", 3.0, 1.0)]
    assert rows(stats.sampled(runs, "g", "k", 2)) == [("x", 3, [1, 2])]


def test_long_chains_and_cycles(spark):
    links = spark.createDataFrame([(k, k - 1 if k else None) for k in range(301)] + [(1000, 1001), (1001, 1002), (1002, 1000), (2000, 3000)], "node long, ref long")
    got = {r.node: r.root for r in spans.chased(links).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[1000] is got[1001] is got[1002] is got[2000] is None


def test_ranges_of_any_length(spark):
    ranges = spark.createDataFrame([(0, 10**12, "whole"), (5, 5, "five"), (-7, 6, "around"), (9, 3, "none"), (2**40, 2**40 + 1, "far")], "low long, high long, label string")
    points = spark.createDataFrame([(-8,), (-7,), (5,), (6,), (7,), (2**40 + 1,), (None,)], "v long")
    got = sorted((r.v, r.label) for r in spans.in_ranges(points, F.col("v"), ranges, "low", "high").collect())
    assert got == sorted([(-7, "around"), (5, "around"), (5, "five"), (5, "whole"), (6, "around"), (6, "whole"), (7, "whole"), (2**40 + 1, "far")]) + ([(2**40 + 1, "whole")] if 2**40 + 1 <= 10**12 else [])
    assert spans.in_ranges(points, F.col("v"), ranges.limit(0), "low", "high").count() == 0


def test_chunks_respect_both_limits(spark):
    items = [("a", k, 10) for k in range(250)] + [("b", 0, 300_000), ("b", 1, 100), ("b", 2, 262_000), ("b", 3, 32)]
    got = {(r.g, r.k): r.chunk for r in spans.chunked(spark.createDataFrame(items, "g string, k int, s long"), "g", "k", "s").collect()}
    assert [got["a", k] for k in (0, 99, 100, 199, 200, 249)] == [0, 0, 1, 1, 2, 2]
    assert [got["b", k] for k in range(4)] == [0, 1, 1, 2] or [got["b", k] for k in range(4)] == [0, 1, 1, 1]
    assert 12 + 100 + 262_000 + 1 + 32 + 1 > 256 << 10 or got["b", 3] == 1


def test_lines_of_batches(spark):
    line = lambda d, ok, failed, skipped, a, b, ms: value(spark, texts.summary_line(F.lit(d), F.lit(ok), F.lit(failed), F.lit(skipped), F.lit(a), F.lit(b), F.lit(ms)))
    assert line("compress", 3, 0, 0, 1 << 21, 1 << 20, 1960) == "3 files: 2.0 MiB -> 1.0 MiB, saved 1.0 MiB (50%) in 1.9s"
    assert line("compress", 3, 1, 2, 10, 10, 125_000) == "3 ok, 1 failed, 2 skipped: 10 B -> 10 B, no space saved in 2m05s"
    assert line("decompress", 1, 0, 0, 100, 150, 3_700_000) == "1 files: 100 B -> 150 B, expanded by 50 B (50%) in 61m40s"
    assert line("decompress", 1, 0, 0, 0, 150, 0) == "1 files: 0 B -> 150 B in 0.0s"
    assert line("count_only", 2, 0, 1, 0, 0, 59_999) == "2 ok, 1 skipped in 59.9s" and line("dry_run", 2, 0, 0, 0, 0, 0) == "Dry run: 2 files planned in 0.0s"
    assert value(spark, texts.size_delta(F.lit(936732), F.lit(1000000))) == "-63,268 B (-6.3268 %)" and value(spark, texts.size_delta(F.lit(5), F.lit(0))) == "+5 B (+0.0000 %)"
    assert value(spark, texts.delta_ratio(F.lit(1.0), F.lit(2.0))) == "0.50x (2.00x faster)" and value(spark, texts.delta_ratio(F.lit(1.0), F.lit(0.0))) == "n/a"
    assert [value(spark, texts.human_size(F.lit(n))) for n in (12, 2048, 959_447_040, 1_503_238_554)] == ["12 B", "2 KB", "915 MB", "1.4 GB"]


@pytest.mark.parametrize("digits", [1, 2, 3, 4])
def test_decimals_round_the_exact_value(spark, digits):
    """Python's % is C's. Every half between two decimals of 0 to 1, the same above some whole numbers, and odd values."""
    halves = [(2 * k + 1) / (2 * 10**digits) for k in range(10**digits)]
    xs = halves + [n + x for n in (1, 2, 1023, 1 << 30, 1 << 46) for x in halves[:500]] + [0.0, 5e-324, 0.99999, 70368744177664.09375, 2.0**62, math.nextafter(2.0**63, 0), math.inf, math.nan]
    xs += [-x for x in xs]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select(texts.fixed(F.col("x"), digits)).collect()
    assert [r[0] for r in got] == [f"{x:.{digits}f}" for x in xs] + [None]


def test_amounts_round_the_exact_value(spark):
    assert value(spark, texts.delta_ratio(F.lit(38475000.0), F.lit(15000000.0))) == "2.56x" and value(spark, texts.delta_ratio(F.lit(0.0), F.lit(2.0))) == "0.00x (infx faster)"
    assert value(spark, texts.format_bytes(F.lit(1280))) == "1.2 KiB" and value(spark, texts.format_seconds(F.lit(1.0005))) == "1.000 s"
    assert value(spark, texts.size_delta(F.lit(1000001), F.lit(800000))) == "+200,001 B (+25.0001 %)" and value(spark, texts.size_delta(F.lit(799999), F.lit(800000))) == "-1 B (-0.0001 %)"
    assert value(spark, texts.human_size(F.lit(5 << 28))) == "1.2 GB" and value(spark, texts.size_delta(F.lit(32033), F.lit(32000))) == "+33 B (+0.1031 %)"


def test_cache_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2, 3, ("x", None, None, None, 5), None, None, None, None, {"chd": True}), ("é", 1, 2, 3, None, None, None, [(1, "AUDIO", ("c", None, None, None, 1))], [(1, 2, 3)], {})], cache.ENTRY)
    assert cache.load(spark, f"{tmp_path}/none").count() == 0
    for _ in range(2):
        cache.save(df, f"{tmp_path}/cache")
    back = cache.load(spark, f"{tmp_path}/cache")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "cache" / "part-x.json").write_text('{"path":"old","size":4}\nnot json\n')
    assert {r.path: r.size for r in cache.load(spark, f"{tmp_path}/cache").collect()} == {"a": 1, "é": 1, "old": 4}
    cache.save(cache.rebuilt(df.limit(1), cache.load(spark, f"{tmp_path}/cache")), f"{tmp_path}/cache2")
    assert cache.load(spark, f"{tmp_path}/cache2").count() == 3


def test_answers_errors_and_codes(spark):
    asked, answers = spark.createDataFrame([("p", 0), ("q", 1)], "name string, i int"), spark.createDataFrame([(1, "b"), (0, "a")], "i int, hit string")
    assert rows(stats.restitched(asked, answers, "i"), "name") == [("p", 0, "a"), ("q", 1, "b")]
    for bad in ([(0, "a")], [(0, "a"), (1, "b"), (1, "c")], [(0, "a"), (1, "b"), (2, "c")]):
        with pytest.raises(Exception, match="exactly once"):
            stats.restitched(asked, spark.createDataFrame(bad, "i int, hit string"), "i").collect()
    df = spark.createDataFrame([(None, None), ("x", "unsupported"), ("y", "io")], "error string, kind string")
    assert [r[0] for r in df.select(stats.bucket(F.col("error"), F.col("kind"))).collect()] == [None, "unsupported", "failed"]
    with pytest.raises(Exception, match="stopped: z"):
        spark.createDataFrame([("z", "cancelled")], "error string, kind string").select(stats.bucket(F.col("error"), F.col("kind"))).collect()


def test_fixdat_is_the_golden_document(spark, tmp_path):
    df = spark.createDataFrame([("Some Game (USA)", "Some Game (USA).bin", 1234, "1234abcd", None, "aaaa", None, 0)], "game_name string, file_name string, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, ordinal int")
    assert fixdat.write_fixdat(df, f"{tmp_path}/f.xml", "Test <Dat> & Co", "2026-06-01") == 1
    want = ['<?xml version="1.0"?>', '<!DOCTYPE datafile PUBLIC "-//Logiqx//DTD ROM Management Datafile//EN" "http://www.logiqx.com/Dats/datafile.dtd">', "<datafile>", "\t<header>", "\t\t<name>fixdat - Test &lt;Dat&gt; &amp; Co</name>",
            "\t\t<description>fixdat - Test &lt;Dat&gt; &amp; Co</description>", "\t\t<version>2026-06-01</version>", "\t</header>", '\t<game name="Some Game (USA)">', "\t\t<description>Some Game (USA)</description>",
            '\t\t<rom name="Some Game (USA).bin" size="1234" crc="1234abcd" sha1="aaaa"/>', "\t</game>", "</datafile>", ""]
    assert open(f"{tmp_path}/f.xml").read() == "\n".join(want)
