"""Whole queries over the driver tables, with their SQL.

documents stand in for a library's files (name: source_id, content: text), labelled documents and benchmark
passages for the catalog. Good entries carry digests, toxic ones a SHA-256 that no file has, poor ones none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.functions import names, templates, texts
from ledgerlake.functions.digests import crc32, digests
from ledgerlake.operators import cache, dedup, fixdat, identify, playlist, reconcile, rename, report, spans, stats

#: Catalog ids of benchmark passages start here, above those of documents.
BENCHMARK_IDS = 1 << 40
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local(spark, sf_dir):
    name = F.concat_ws("_", "source", "doc_id")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), name.alias("name"), *(c.alias(a) for a, c in digests(F.col("text"), ("md5", "sha1", "sha256")).items()))


def _catalog(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    size = F.octet_length("text").cast("long")
    none = F.lit(None).cast("string")
    known = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("catalog_id"), F.col("doc_id").alias("game_id"), F.col("source").alias("grp"), F.concat_ws("_", "source", "doc_id").alias("file_name"), size.alias("size_bytes"),
        F.when(bad, F.sha2(F.concat("text", F.lit("!")), 256)).when(good, F.sha2("text", 256)).alias("sha256"), F.when(good, F.sha1("text")).alias("sha1"), F.when(good & ~bad, F.md5("text")).alias("md5"))
    bench = _table(spark, sf_dir, "benchmark")
    more = bench.select((F.col("item_id") + BENCHMARK_IDS).alias("catalog_id"), (F.col("item_id") + BENCHMARK_IDS).alias("game_id"), F.lit("benchmark").alias("grp"), F.concat_ws("_", F.lit("benchmark"), "item_id").alias("file_name"), size.alias("size_bytes"), F.sha2("text", 256).alias("sha256"), none.alias("sha1"), none.alias("md5"))
    return known.unionByName(more)


_CATALOG_SQL = f"""
loc AS (
  SELECT doc_id AS file_id, concat(source, '_', doc_id) AS name, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents
), cat AS (
  SELECT d.doc_id AS catalog_id, d.source AS grp, concat(d.source, '_', d.doc_id) AS file_name, octet_length(encode(text)) AS size_bytes,
         CASE WHEN toxic = 1 THEN sha256(text || '!') WHEN quality = 1 THEN sha256(text) END AS sha256,
         CASE WHEN quality = 1 THEN sha1(text) END AS sha1, CASE WHEN quality = 1 AND toxic = 0 THEN md5(text) END AS md5
  FROM documents d JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT item_id + {BENCHMARK_IDS}, 'benchmark', concat('benchmark_', item_id), octet_length(encode(text)), sha256(text), NULL, NULL FROM benchmark
)"""
_FOUND_SQL = f"""{_CATALOG_SQL}, c AS (
  SELECT file_id, catalog_id, file_name, 0 AS rung FROM loc JOIN cat ON loc.sha256 = cat.sha256
  UNION ALL SELECT file_id, catalog_id, file_name, 1 FROM loc JOIN cat ON loc.sha1 = cat.sha1
  UNION ALL SELECT file_id, catalog_id, file_name, 2 FROM loc JOIN cat ON loc.md5 = cat.md5
  UNION ALL SELECT file_id, catalog_id, file_name, 4 FROM loc JOIN cat ON loc.name = cat.file_name AND loc.size_bytes = cat.size_bytes
), b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rung, catalog_id) AS k FROM c
), found AS (
  SELECT loc.file_id, b.catalog_id, CASE WHEN rung IS NULL THEN NULL ELSE list_value('sha256', 'sha1', 'md5', 'crc32', 'name_size')[rung + 1] END AS match_algo,
         CASE WHEN rung IS NULL THEN 'unknown' WHEN rung = 4 THEN 'hint' WHEN lower(loc.name) <> lower(b.file_name) THEN 'misnamed' ELSE 'verified' END AS verdict
  FROM loc LEFT JOIN b ON loc.file_id = b.file_id AND b.k = 1
)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def kept(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return kept


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents")
def digest_documents(spark, sf_dir):
    d = digests(F.col("text"), ("md5", "sha1", "sha256"))
    return _table(spark, sf_dir, "documents").select("doc_id", *(c.alias(a) for a, c in d.items()))


@query("""WITH RECURSIVE t(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM t WHERE k < 8
), steps AS (SELECT list(c ORDER BY i) AS step FROM t WHERE k = 8
), b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents)
SELECT doc_id, printf('%08x', xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, step[xor(c, x) % 256 + 1])), 4294967295)) AS crc32 FROM b, steps""")
def crc32_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", crc32(F.col("text")).alias("crc32"))


def _scanned(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    return identify.scan(_local(spark, sf_dir), catalog, catalog.select("game_id", F.col("file_name").alias("game_name")))


@query(f"WITH {_FOUND_SQL} SELECT file_id, catalog_id, match_algo, verdict FROM found")
def identify_ranked(spark, sf_dir):
    return _scanned(spark, sf_dir).select("file_id", "catalog_id", "match_algo", "verdict")


@query(f"WITH {_FOUND_SQL} SELECT verdict, count(*) AS n FROM found GROUP BY verdict")
def scan_summary(spark, sf_dir):
    return report.by_verdict(_scanned(spark, sf_dir))


_MISSING_SQL = """NOT CASE WHEN sha256 IS NOT NULL THEN sha256 IN (SELECT sha256 FROM loc) WHEN sha1 IS NOT NULL THEN sha1 IN (SELECT sha1 FROM loc)
  WHEN md5 IS NOT NULL THEN md5 IN (SELECT md5 FROM loc) ELSE false END"""


@query(f"WITH {_CATALOG_SQL} SELECT grp AS game_id, count(*) AS missing FROM cat WHERE {_MISSING_SQL} GROUP BY grp")
def fixdat_missing(spark, sf_dir):
    return fixdat.missing_by_game(_catalog(spark, sf_dir).withColumn("game_id", F.col("grp")), _local(spark, sf_dir))


@query(f"WITH {_CATALOG_SQL} SELECT catalog_id, file_name, size_bytes, sha256 FROM cat WHERE {_MISSING_SQL}")
def fixdat_files(spark, sf_dir):
    return fixdat.missing(_catalog(spark, sf_dir), _local(spark, sf_dir)).select("catalog_id", "file_name", "size_bytes", "sha256")


@query("SELECT sha256(text) AS content, min(doc_id) AS keep, count(*) AS copies FROM documents GROUP BY 1")
def dedup_content(spark, sf_dir):
    return dedup.by_content(_local(spark, sf_dir))


@query("""SELECT count(*) FILTER (WHERE s = 'ok') AS n_ok, count(*) FILTER (WHERE s = 'skipped') AS n_skipped, count(*) FILTER (WHERE s = 'failed') AS n_failed,
  CAST(coalesce(sum(n) FILTER (WHERE s = 'ok'), 0) AS BIGINT) AS bytes_in
FROM (SELECT octet_length(encode(text)) AS n, CASE WHEN quality = 1 THEN 'ok' WHEN toxic = 1 OR quality = 0 THEN 'failed' ELSE 'skipped' END AS s
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) z""")
def tally_status(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "ok").when((F.col("toxic") == 1) | (F.col("quality") == 0), "failed").otherwise("skipped")
    return report.tally(docs, status, F.octet_length("text").cast("long"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice > 0 THEN sign(x) * floor(abs(x) + 0.5e0) / 10 END AS ratio_pct
FROM (SELECT *, (1 - (l_extendedprice * (1 - l_discount)) / l_extendedprice) * 1000 AS x FROM lineitem) z""")
def report_ratio(spark, sf_dir):
    ratio = texts.ratio_pct(F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("ratio_pct"))


_START_SQL = """coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {_START_SQL} AS start FROM lineitem")
def cue_offsets(spark, sf_dir):
    return spans.running_offset(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "start")


@query(f"""SELECT l_orderkey, min(CASE WHEN start = before THEN 1 ELSE 0 END) AS ok FROM (
  SELECT l_orderkey, start, coalesce(lag(start + l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate), 0) AS before
  FROM (SELECT *, {_START_SQL} AS start FROM lineitem) y) z GROUP BY l_orderkey""")
def contiguous_spans(spark, sf_dir):
    placed = spans.running_offset(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, "l_quantity")
    return spans.contiguous(placed, ["l_orderkey"], LINE_ORDER, "l_quantity")


@query("SELECT event_id, lead(event_id) OVER (ORDER BY event_id) - event_id AS length FROM events")
def block_lengths(spark, sf_dir):
    got = spans.next_in_order(_table(spark, sf_dir, "events").select("event_id"), "event_id", "event_id")
    return got.select("event_id", (F.col("next") - F.col("event_id")).alias("length"))


@query("""SELECT user_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sigma
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) z WHERE k > 1 GROUP BY user_id""")
def warm_stats(spark, sf_dir):
    got = stats.warm(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return got.select("user_id", F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))


@query("SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS collision_key, count(*) OVER (PARTITION BY translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS n FROM part")
def rename_collisions(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("collision_key", names.collision_key(F.col("p_name")))
    return rename.counted_collisions(part, F.col("collision_key")).select("p_partkey", "collision_key", "n")


@query("SELECT b.label, count(*) AS n FROM part JOIN (VALUES (1, 10, 'a'), (11, 30, 'b'), (31, 50, 'c')) b(low, high, label) ON p_size BETWEEN low AND high GROUP BY b.label")
def span_range_join(spark, sf_dir):
    ranges = spark.createDataFrame([(1, 10, "a"), (11, 30, "b"), (31, 50, "c")], "low int, high int, label string")
    return spans.in_ranges(_table(spark, sf_dir, "part"), F.col("p_size"), ranges, "low", "high").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS members, count(*) AS n, count(*) > count(DISTINCT turn) AS duplicated FROM conversations GROUP BY conv_id")
def playlist_groups(spark, sf_dir):
    got = playlist.groups(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return got.withColumn("members", F.array_join("members", ","))


@query("""WITH o AS (SELECT DISTINCT d.doc_id, md5(text) AS md5, CAST(NULL AS VARCHAR) AS sha1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT doc_id, CASE WHEN lang = 'en' THEN md5(text) END AS md5, sha1(text) AS sha1 FROM documents WHERE lang <> 'de')
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.md5, o.md5) AS md5, coalesce(n.sha1, o.sha1) AS sha1 FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id""")
def union_cache_merge(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    old = docs.join(_table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.md5("text").alias("md5"), F.lit(None).cast("string").alias("sha1"))
    new = docs.where("lang <> 'de'").select("doc_id", F.when(F.col("lang") == "en", F.md5("text")).alias("md5"), F.sha1("text").alias("sha1"))
    return cache.merged(old, new, "doc_id", ("md5", "sha1"))


@query("""SELECT d.doc_id, d.n_chars, l.doc_id IS NOT NULL AND l.quality = 1 AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id""")
def cache_lookup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    zero = F.lit(0).cast("long")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), zero.alias("mtime_secs"), F.lit(0).alias("mtime_nanos"), "doc_id")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    raw = F.struct(F.when(F.col("quality") == 1, F.sha1("text")).alias("sha1"))
    entries = docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), zero.alias("mtime_secs"), F.lit(0).alias("mtime_nanos"), raw.alias("raw"))
    return cache.lookup(files, entries, ("sha1",)).select("doc_id", F.col("size").alias("n_chars"), F.col("cached").isNotNull().alias("hit"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def cue_uncovered_files(spark, sf_dir):
    cues = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.array("l_orderkey").alias("members"))
    return playlist.uncovered(_table(spark, sf_dir, "orders"), cues, "o_orderkey").select("o_orderkey")


@query("""SELECT d.doc_id, CASE WHEN l.ok IS NULL THEN 'new' WHEN l.ok THEN 'keep_valid' ELSE 'rewrite_invalid' END AS decision
FROM documents d LEFT JOIN (SELECT doc_id, bool_and(quality = 1) AS ok FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def conflict_plan(spark, sf_dir):
    existing = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"))
    return rename.conflict_plan(_table(spark, sf_dir, "documents").select("doc_id"), existing, "overwrite-invalid", "doc_id").select("doc_id", "decision")


@query(r"""SELECT page_id, lower(regexp_extract(base, '^.+\.([^.]*)$', 1)) AS ext, base, len(string_split(url, '/')) AS depth
FROM (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS base FROM pages) z""")
def page_paths(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", names.extension(url).alias("ext"), names.basename(url).alias("base"), names.depth(url).cast("long").alias("depth"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[,"' || chr(13) || chr(10) || ']') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM conversations""")
def report_fields(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.csv_field(F.col("text")).alias("field"), texts.html_escape(F.col("text")).alias("html"))


@query("""SELECT event_id, printf('%02d:%02d:%02d', (event_id // 4500) % 256, (event_id // 75) % 60, event_id % 75) AS msf FROM events""")
def msf_times(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", texts.msf(F.col("event_id")).alias("msf"))


@query("SELECT conv_id, sha1(unhex(string_agg(entry, '' ORDER BY entry))) AS root, count(*) AS n FROM (SELECT conv_id, hex(encode(substr(role, 1, 4))) || upper(sha1(text)) AS entry FROM conversations) GROUP BY conv_id")
def hash_roots(spark, sf_dir):
    """The digest of a set of tagged digests: four bytes of tag and the digest's bytes, in order of these."""
    entry = F.array_sort(F.collect_list(F.concat(F.hex(F.substring("role", 1, 4)), F.upper(F.sha1("text")))))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha1(F.unhex(F.array_join(entry, ""))).alias("root"), F.count("*").alias("n"))


@query("""SELECT l_orderkey AS container, count(*) AS n_blocks, count(*) FILTER (WHERE l_returnflag = 'R') AS n_raw, sum(l_quantity) AS stored, CAST(sum(50) AS BIGINT) AS logical,
  sum(l_quantity) / sum(50) * 100 AS compression_ratio FROM lineitem GROUP BY l_orderkey""")
def container_summary(spark, sf_dir):
    blocks = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("container"), (F.col("l_returnflag") == "R").alias("raw"), F.col("l_quantity").alias("stored_len"), F.lit(50).cast("long").alias("expected_len"))
    return stats.block_summary(blocks)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS slot FROM lineitem""")
def used_slots(spark, sf_dir):
    return spans.slots(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, F.col("l_returnflag") != "R").select("l_orderkey", "l_linenumber", "l_partkey", "slot")


@query("""WITH c AS (SELECT *, md5(role) AS content, turn % 2 = 0 AS marked FROM conversations
), loc AS (SELECT conv_id, turn, content, row_number() OVER (PARTITION BY conv_id, content ORDER BY turn) AS k FROM c WHERE turn % 5 <> 3
), rem AS (SELECT conv_id, turn, content, marked, role || '_' || turn AS name, row_number() OVER (PARTITION BY conv_id, content ORDER BY marked DESC, turn) AS k FROM c
), m AS (SELECT loc.conv_id, loc.turn, rem.turn AS other, marked, rem.name FROM loc JOIN rem USING (conv_id, content, k)
), s AS (SELECT conv_id, coalesce(string_agg(rem.name, ',' ORDER BY rem.turn) FILTER (loc.turn IS NULL), '') AS missing FROM rem LEFT JOIN loc USING (conv_id, content, k) GROUP BY conv_id
)
SELECT CAST(conv_id AS VARCHAR) AS set_id, turn AS ordinal, other AS remote_ordinal, CASE WHEN marked THEN 'sha1' ELSE 'md5' END AS algo, missing = '' AS ok, missing FROM m JOIN s USING (conv_id)""")
def missing_tracks_greedy(spark, sf_dir):
    """Tracks of a set that hold the same (a turn's role) go to those with SHA-1 first, then to the others, by ordinal."""
    turns = _table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    base = turns.select(F.col("conv_id").cast("string").alias("set_id"), F.col("turn").alias("ordinal"), F.octet_length("role").cast("long").alias("size_bytes"), none.alias("sha256"), F.sha1("role").alias("sha1"), F.md5("role").alias("md5"), crc32(F.col("role")).alias("crc32"), F.concat_ws("_", "role", "turn").alias("file_name"))
    remote = base.withColumn("sha1", F.when(F.col("ordinal") % 2 == 0, F.col("sha1")))
    return reconcile.reconcile(base.where("ordinal % 5 <> 3"), remote).withColumn("missing", F.array_join("missing", ","))


#: File names of every shape that the naming rules tell apart.
_NAMES_SQL = """n AS (SELECT p_partkey, p_name, CASE p_partkey % 14
  WHEN 0 THEN p_name || ' (Disc ' || p_size || ')' WHEN 1 THEN p_name || ' (disc  ' || p_size || ' of 9) (Rev 1)' WHEN 2 THEN p_name || ' Disc ' || p_size WHEN 3 THEN p_name || ' (CD 2)'
  WHEN 4 THEN p_name || '-disc ' || p_size WHEN 5 THEN 'Disc ' || p_size || ' of 3' WHEN 6 THEN 'CON.' || p_name WHEN 7 THEN '  ' || p_name || ' . ' WHEN 8 THEN p_name || ': <x>?'
  WHEN 9 THEN p_name || ' Disc2' WHEN 10 THEN '(Disc 1) ' || p_name WHEN 11 THEN upper(p_name) || '/./Sub\\' || p_type WHEN 12 THEN p_name || ' (Disc 99999999999)' ELSE 'aux' END AS name FROM part)"""


def _names(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    forms = [F.concat("p_name", F.lit(" (Disc "), "p_size", F.lit(")")), F.concat("p_name", F.lit(" (disc  "), "p_size", F.lit(" of 9) (Rev 1)")), F.concat("p_name", F.lit(" Disc "), "p_size"), F.concat("p_name", F.lit(" (CD 2)")),
             F.concat("p_name", F.lit("-disc "), "p_size"), F.concat(F.lit("Disc "), "p_size", F.lit(" of 3")), F.concat(F.lit("CON."), "p_name"), F.concat(F.lit("  "), "p_name", F.lit(" . ")), F.concat("p_name", F.lit(": <x>?")),
             F.concat("p_name", F.lit(" Disc2")), F.concat(F.lit("(Disc 1) "), "p_name"), F.concat(F.upper("p_name"), F.lit("/./Sub\\"), "p_type"), F.concat("p_name", F.lit(" (Disc 99999999999)")), F.lit("aux")]
    return part.select("p_partkey", "p_name", F.element_at(F.array(*forms), (F.col("p_partkey") % 14 + 1).cast("int")).alias("name"))


@query(rf"""WITH {_NAMES_SQL}, m AS (
  SELECT *, regexp_extract(name, '(?is)^(.*)\(\s*disc\s+([0-9]+)(\s+of\s+[0-9]+)?\s*\)(.*)$', ['a', 'd', 'o', 'z']) AS e, regexp_extract(name, '(?is)^(|.*\s)disc\s+([0-9]+)(\s+of\s+[0-9]+)?\s*$', ['a', 'd', 'o']) AS g FROM n
), k AS (
  SELECT *, TRY_CAST(nullif(e.d, '') AS BIGINT) AS one, TRY_CAST(nullif(g.d, '') AS BIGINT) AS two FROM m
)
SELECT p_partkey, CASE WHEN one <= 4294967295 THEN trim(rtrim(e.a) || CASE WHEN rtrim(e.a) = '' OR ltrim(e.z) = '' THEN '' ELSE ' ' END || ltrim(e.z))
  WHEN two <= 4294967295 THEN rtrim(g.a) ELSE name END AS base, CASE WHEN one <= 4294967295 THEN one WHEN two <= 4294967295 THEN two ELSE 0 END AS disc FROM k""")
def disc_tokens(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("d", names.disc_parts(F.col("name"))).select("p_partkey", "d.base", "d.disc")


@query(rf"""WITH {_NAMES_SQL}, s AS (SELECT *, regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') AS safe FROM n)
SELECT p_partkey, CASE WHEN lower(safe) IN ('con', 'prn', 'aux', 'nul') THEN safe || '_' ELSE safe END AS stem,
  CASE WHEN upper(string_split(safe, '.')[1]) IN ('CON', 'PRN', 'AUX', 'NUL') THEN safe || '_' ELSE safe END AS component,
  regexp_replace(replace(replace(lower(name), chr(92), '/'), '/./', '/'), '/+', '/', 'g') AS collision_key FROM s""")
def safe_names(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("p_partkey", names.sanitized_stem(n).alias("stem"), templates.component(n).alias("component"), names.collision_key(n).alias("collision_key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE replace(p_type, ' ', '_') || '/' || coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END, 'file' || p_partkey) || ' [' || p_brand || '] {other}.iso' END AS path FROM part""")
def templated_names(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    region = F.when(F.col("p_partkey") % 5 == 0, F.lit("..")).otherwise(F.replace("p_type", F.lit(" "), F.lit("_")))
    tokens = {"region": region, "title": F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), "titleId": F.col("p_brand"), "ext": F.lit("iso"), "basename": F.concat(F.lit("file"), "p_partkey")}
    return part.select("p_partkey", templates.template_column("{region}\\\\{title} [{titleId}] {other}.{ext}", tokens).alias("path"))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey * 37 AS ms, CAST(round(o_totalprice * 100) AS BIGINT) AS a, o_custkey * 1000 AS b FROM orders)
SELECT o_orderkey, CASE WHEN ms >= 60000 THEN printf('%dm%02ds', ms // 60000, ms // 1000 % 60) ELSE printf('%d.%ds', ms // 1000, ms % 1000 // 100) END AS duration,
  CASE WHEN a % 11 = 0 THEN a || ' ok' || CASE WHEN b % 3 > 0 THEN ', ' || b % 3 || ' failed' ELSE '' END || ', 2 skipped' WHEN b % 3 > 0 THEN a || ' ok, ' || b % 3 || ' failed' ELSE a || ' files' END AS prefix,
  CASE WHEN b % 7000 = 0 THEN 'n/a' WHEN a < b % 7000 * 5000 THEN printf('%.2fx (%.2fx faster)', a / (b % 7000 * 5000.0), b % 7000 * 5000.0 / a) ELSE printf('%.2fx', a / (b % 7000 * 5000.0)) END AS ratio FROM d""")
def report_amounts(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37).alias("ms"), F.round(F.col("o_totalprice") * 100).cast("long").alias("a"), (F.col("o_custkey") * 1000).alias("b"))
    d = d.select("*", F.col("a").cast("double").alias("ours"), (F.col("b") % 7000 * 5000).cast("double").alias("theirs"))
    skipped = F.when(F.col("a") % 11 == 0, F.lit(2)).otherwise(F.lit(0))
    return d.select("o_orderkey", texts.format_duration(F.col("ms")).alias("duration"), texts.count_prefix(F.col("a"), (F.col("b") % 3).cast("int"), skipped).alias("prefix"), texts.delta_ratio(F.col("ours"), F.col("theirs")).alias("ratio"))


@query("""SELECT page_id, CASE lower(regexp_extract(url, '[^/]\\.([^./]*)$', 1)) WHEN 'rvz' THEN 'rvz' WHEN 'cue' THEN 'cue_set' WHEN 'chd' THEN 'chd_tracks' ELSE 'raw' END AS kind, NOT regexp_matches(url, '(?i)[^/]\\.(rvz|cue|chd)$') AS cheap FROM (
  SELECT page_id, url || list_value('', '.RVZ', '.cue', '.x.chd', '.txt')[1 + page_id % 5] AS url FROM pages) p""")
def inner_kinds(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("", ".RVZ", ".cue", ".x.chd", ".txt"))), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.concat("url", ext)
    return _table(spark, sf_dir, "pages").select("page_id", names.inner_kind(url).alias("kind"), names.rereads_cheaply(url, F.lit(None).cast("string")).alias("cheap"))


_RENAMES_SQL = """c AS (
  SELECT doc_id, 'lib/' || source || ' ' || (doc_id // 3) || CASE doc_id % 3 WHEN 2 THEN '' ELSE ' (Disc ' || (doc_id % 3 + 1) || ')' END || '.ISO' AS path, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'Game ' || CASE WHEN doc_id % 7 = 0 THEN doc_id // 100 ELSE doc_id // 3 END || CASE doc_id % 3 WHEN 2 THEN '' ELSE ' (Disc ' || (doc_id % 3 + 1) || ')' END END AS game_name,
         doc_id % 11 <> 0 AS verified FROM documents)"""


def _renames(spark, sf_dir):
    i = F.col("doc_id")
    token = F.when(i % 3 == 2, F.lit("")).otherwise(F.concat(F.lit(" (Disc "), i % 3 + 1, F.lit(")")))
    number = F.when(i % 7 == 0, F.floor(i / 100)).otherwise(F.floor(i / 3))
    game = F.when(i % 13 != 0, F.concat(F.lit("Game "), number, token))
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("lib/"), "source", F.lit(" "), F.floor(i / 3), token, F.lit(".ISO")).alias("path"), F.when(game.isNotNull(), F.lit("g")).alias("game_id"), game.alias("game_name"), F.lit(None).cast("string").alias("file_name"), (i % 11 != 0).alias("verified"))


@query(f"""WITH {_RENAMES_SQL}, b AS (SELECT *, regexp_replace(regexp_replace(path, '^lib/', ''), '( \\(Disc [0-9]+\\))?\\.ISO$', '') AS base, lower(regexp_replace(game_name, ' \\(Disc [0-9]+\\)$', '')) AS title FROM c
), s AS (
  SELECT base, count(*) AS n, bool_or(NOT verified OR game_name IS NULL) AS weak, count(DISTINCT coalesce(title, '')) > 1 AS mixed FROM b GROUP BY base
), p AS (
  SELECT path, 'lib/' || game_name || '.iso' AS target, CASE WHEN n > 1 AND (weak OR mixed) THEN 'skip_disc_set_conflict' WHEN game_name IS NULL THEN 'skip_unmatched' WHEN NOT verified THEN 'skip_weak_match' ELSE 'rename' END AS action, n, weak FROM b JOIN s USING (base)
), q AS (SELECT *, count(*) FILTER (action = 'rename') OVER (PARTITION BY lower(target)) AS claims FROM p
)
SELECT path, CASE WHEN action = 'rename' AND claims = 1 THEN target END AS target, CASE WHEN action = 'rename' AND claims > 1 THEN 'skip_collision' ELSE action END AS action,
  CASE WHEN action = 'rename' AND claims > 1 THEN 'two files map to the same target' WHEN action = 'skip_disc_set_conflict' AND weak THEN 'disc set has an unmatched or weak member' WHEN action = 'skip_disc_set_conflict' THEN 'disc set resolves to different games'
       WHEN action = 'skip_weak_match' THEN 'name+size hint only' END AS detail FROM q""")
def rename_actions(spark, sf_dir):
    return rename.rename_plan(_renames(spark, sf_dir))


@query("""WITH RECURSIVE i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS k, octet_length(encode(text)) AS s FROM conversations
), c(conv_id, k, chunk, n, bytes) AS (
  SELECT conv_id, k, 0, 1, 12 + s FROM i WHERE k = 1 UNION ALL
  SELECT i.conv_id, i.k, CASE WHEN c.n >= 3 OR c.bytes + i.s + 1 > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN c.n >= 3 OR c.bytes + i.s + 1 > 400 THEN 1 ELSE c.n + 1 END,
         CASE WHEN c.n >= 3 OR c.bytes + i.s + 1 > 400 THEN 12 + i.s ELSE c.bytes + i.s + 1 END FROM c JOIN i ON i.conv_id = c.conv_id AND i.k = c.k + 1
) SELECT conv_id, CAST(k AS INT) AS k, chunk FROM c""")
def bulk_chunks(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", F.md5("text"))
    items = _table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(w).alias("k"), F.octet_length("text").alias("s"))
    return spans.chunked(items, "conv_id", "k", "s", 3, 400)


@query("SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality IS DISTINCT FROM 1) AS failed, bool_and(coalesce(quality, 0) = 1) AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def verify_tally(spark, sf_dir):
    both = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.verify_tally(both.select("source", (F.col("quality") == 1).alias("valid")), "source")


@query("""WITH b AS (SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped,
  CAST(coalesce(sum(o_custkey) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS size_in, CAST(coalesce(sum(o_orderkey % 1000) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS size_out, CAST(sum(o_orderkey % 50) AS BIGINT) AS ms FROM orders GROUP BY o_orderpriority)
SELECT *, CASE WHEN failed = 0 THEN 'ok' WHEN ok > 0 THEN 'partial_failure' ELSE 'failed' END AS code, CASE WHEN failed = 0 THEN 0 WHEN ok > 0 THEN 3 ELSE 1 END AS status FROM b""")
def batch_summary(spark, sf_dir):
    states = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), states.alias("status"), F.col("o_custkey").alias("size_in"), (F.col("o_orderkey") % 1000).alias("size_out"), (F.col("o_orderkey") % 50).alias("ms"))
    return stats.response(stats.batch_summary(rows, "g"))


@query("""SELECT l_orderkey, CAST(sum(coalesce(p_size, 0)) AS BIGINT) AS total, count(*) FILTER (p_size IS NULL) AS n_missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 3) p ON l_partkey = p_partkey GROUP BY l_orderkey""")
def referenced_sizes(spark, sf_dir):
    files = _table(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return stats.referenced_size(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), files, "l_orderkey", "l_partkey", "p_size")


@query("""SELECT doc_id, source, label FROM documents JOIN (SELECT doc_id, min(quality) * 2 AS label FROM labels GROUP BY doc_id) l USING (doc_id)""")
def bulk_answers(spark, sf_dir):
    answers = _table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") * 2).alias("label"))
    asked = _table(spark, sf_dir, "documents").select("doc_id", "source").join(answers.select("doc_id"), "doc_id", "left_semi")
    return stats.restitched(asked.select("source", "doc_id"), answers, "doc_id").select("doc_id", "source", "label")


@query("""SELECT p_brand, p_name AS what, p_size AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part) WHERE k = 1""")
def smallest_encoding(spark, sf_dir):
    return stats.smallest(_table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_size", "p_name").select("p_brand", F.col("p_name").alias("what"), F.col("p_size").alias("size"))


@query("""SELECT conv_id, sha1(string_agg(text, '' ORDER BY turn, role, md5(text))) AS whole, list_aggregate(list(sha1(text) ORDER BY turn, role, md5(text)), 'string_agg', ',') AS tracks FROM conversations GROUP BY conv_id""")
def set_digests(spark, sf_dir):
    """Digests of a set's parts and of the whole: the parts in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("m"), "text")))
    got = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    return got.select("conv_id", F.sha1(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("whole"), F.array_join(F.transform("p", lambda x: F.sha1(x["text"])), ",").alias("tracks"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS index_01 FROM lineitem""")
def track_indices(spark, sf_dir):
    tracks = _table(spark, sf_dir, "lineitem").withColumn("frames", F.col("l_quantity").cast("long"))
    return spans.with_index(tracks, ["l_orderkey"], LINE_ORDER, "frames").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("index_01").cast("long").alias("index_01"))


@query("""SELECT n_nationkey, row_number() OVER (ORDER BY CASE WHEN r_name || '/' || n_name = upper(r_name || '/' || n_name) THEN lower(r_name || '/' || n_name) ELSE lower(r_name || '/' || n_name) END) AS place FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tree_places(spark, sf_dir):
    """Places of paths in a tree of names that ignores case. The table has a row a nation, so one task orders it."""
    path = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lower("r_name")).otherwise(F.col("r_name")), F.lit("/"), "n_name")
    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", F.row_number().over(Window.orderBy(names.tree_order(path))).alias("place"))
