"""WARC records and Merkle fixity audits.

Pages become WARC response records, placed in files that each span a fixed range of page ids, so a record's
file, order and byte offset follow from the table alone. Records without an id go to files -1 to -4096 by their
hash. Every record has a SHA-256.

Records with one id and one hash prefix are a leaf of a tree; the nodes above cover ids in growing ranges, then
files, up to one root for each replica. A node's hash covers, in order, the place, byte length and hash of each
child: the lengths are the ordered offset ranges below it, counted from the node's own start, so a record that is
lost or added changes the nodes above itself and no others.

An audit compares the roots of two replicas and goes down level by level, only to the children of nodes that
differ. Where two nodes agree, nothing below them is compared.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written

#: Page ids in a file, and leading hex digits of a hash that part the records of one id, as powers of two.
FILE_BITS, HASH_DIGITS = 10, 3
#: Bits that each step up a file's tree takes off a leaf's place, and each step up over files off a file's number.
STEPS, FILE_STEP = (4 * HASH_DIGITS, 4, 4, 3), 4
CRLF = "\r\n"
VERSION = "WARC/1.1" + CRLF
#: Added to file numbers inside trees, so that shifting also joins numbers of both signs.
_BIAS = 1 << 54


def record_text(url: Column, html: Column) -> Column:
    """A WARC response record as text. Null counts as empty."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit(VERSION + "WARC-Type: response" + CRLF + "WARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit(CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF), body, F.lit(CRLF + CRLF),
    )


def _prefix(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, HASH_DIGITS), 16, 10).cast("long")


def placed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, file_no, slot, sha, record_length, value): each page's record, its file and its place there."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), record_text(F.col(url), F.col(html)).alias("value")).withColumn("sha", F.sha2("value", 256))
    file_no = F.coalesce(F.shiftright("page_id", FILE_BITS), -1 - _prefix(F.col("sha")))
    slot = F.coalesce(F.col("page_id").bitwiseAND((1 << FILE_BITS) - 1), F.lit(1 << FILE_BITS).cast("long"))
    return rows.select("page_id", file_no.alias("file_no"), slot.alias("slot"), "sha", F.octet_length("value").cast("long").alias("record_length"), "value")


def contents(pages: DataFrame, **columns) -> DataFrame:
    """(file_no, slot, page_id, sha, record_length, n): the different records and how often each occurs. Only hashes
    and lengths are shuffled, copies counted first."""
    return placed(pages, **columns).groupBy("file_no", "slot", "page_id", "sha", "record_length").agg(F.count("*").alias("n"))


def records(found: DataFrame) -> DataFrame:
    """(page_id, file_no, slot, seq, copy, record_offset, record_length, sha), one row for each record of `contents`.

    Records of a file are ordered by page id, then hash; equal ones follow one another, numbered by copy. Records
    without an id stand last. Running totals go over the ids and hash prefixes of a file first, at most 4,096 an
    id, and then within each of these, so that one id with very many records takes no task of its own.
    """
    part = _prefix(F.col("sha")).alias("part")
    held = found.withColumn("part", part)
    sums = held.groupBy("file_no", "slot", "part").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("record_length")).alias("bytes"))
    parts = Window.partitionBy("file_no").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file_no", "slot", "part").orderBy("sha").rowsBetween(Window.unboundedPreceding, -1)

    def before(what, over):
        return F.coalesce(F.sum(what).over(over), F.lit(0))

    starts = sums.select("file_no", "slot", "part", before("rows", parts).alias("first"), before("bytes", parts).alias("start"))
    inside = held.withColumns({"earlier": before("n", within), "ahead": before(F.col("n") * F.col("record_length"), within)})
    each = inside.join(starts, ["file_no", "slot", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    seq, offset = F.col("first") + F.col("earlier") + F.col("copy"), F.col("start") + F.col("ahead") + F.col("copy") * F.col("record_length")
    return each.select("page_id", "file_no", "slot", seq.cast("long").alias("seq"), "copy", offset.cast("long").alias("record_offset"), "record_length", "sha")


def merkle_levels(replicas: DataFrame) -> list[tuple[DataFrame, int]]:
    """The trees of all replicas at once, leaves first.

    replicas: `contents` with a column replica. Each level has replica, file, idx, bytes and hash and comes with
    the step that made it: the bits taken off idx, or zero where files were joined. The last level has one node
    for each replica.
    """
    record = F.struct("sha", "record_length", "n")
    leaves = replicas.groupBy("replica", (F.col("file_no") + _BIAS).alias("file"), (F.col("slot") * (1 << STEPS[0]) + _prefix(F.col("sha"))).alias("idx"))
    leaves = leaves.agg(F.sum(F.col("n") * F.col("record_length")).alias("bytes"), F.array_sort(F.collect_list(record)).alias("held"))
    line = F.array_join(F.transform("held", lambda x: F.concat_ws(":", x["sha"], x["record_length"], x["n"])), ",")
    level = written(leaves.select("replica", "file", "idx", "bytes", F.sha2(line, 256).alias("hash")), "merkle")
    levels = [(level, -1)]
    low, high = level.agg(F.min("file"), F.max("file")).first()
    if low is None:
        return levels
    steps = list(STEPS)
    while low != high:
        steps.append(0)
        low, high = low >> FILE_STEP, high >> FILE_STEP
    for step in steps:
        child = F.struct((F.col("idx") if step else F.col("file")).alias("at"), "bytes", "hash")
        joined = level.select("replica", *parent(step), child.alias("child")).groupBy("replica", "pf", "pi").agg(F.sum("child.bytes").alias("bytes"), F.array_sort(F.collect_list("child")).alias("kids"))
        line = F.array_join(F.transform("kids", lambda x: F.concat_ws(":", x["at"], x["bytes"], x["hash"])), ",")
        level = written(joined.select("replica", F.col("pf").alias("file"), F.col("pi").alias("idx"), "bytes", F.sha2(line, 256).alias("hash")), "merkle")
        levels.append((level, step))
    return levels


def parent(step: int) -> tuple[Column, Column]:
    """The node above a node, as pf and pi."""
    if step:
        return F.col("file").alias("pf"), F.shiftright("idx", step).alias("pi")
    return F.shiftright("file", FILE_STEP).alias("pf"), F.lit(0).cast("long").alias("pi")


def audit(first: DataFrame, second: DataFrame, visits: list | None = None) -> DataFrame:
    """(file_no, slot, page_id, sha, record_length, first_n, second_n) of the records that two replicas hold
    differently often; both come from `contents`. Empty replicas agree. visits, where given, gets for each level
    from the root (nodes there, nodes compared, nodes that differ)."""
    both = written(first.withColumn("replica", F.lit(0)).unionByName(second.withColumn("replica", F.lit(1))), "warcboth")
    levels = merkle_levels(both)
    bad = None
    for k in range(len(levels) - 1, -1, -1):
        whole = nodes = levels[k][0]
        if bad is not None:
            nodes = nodes.select("*", *parent(levels[k + 1][1])).join(bad.select(F.col("file").alias("pf"), F.col("idx").alias("pi")), ["pf", "pi"], "left_semi")
        side = [F.max(F.when(F.col("replica") == r, F.col("hash"))).alias(n) for r, n in ((0, "a"), (1, "b"))]
        compared = nodes.groupBy("file", "idx").agg(*side)
        below = written(compared.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "idx"), "merklebad")
        if visits is not None:
            visits.append((whole.select("file", "idx").distinct().count(), compared.count(), below.count()))
        release(*([bad] if bad is not None else []))
        bad = below
    release(*(level for level, _ in levels))
    leaf = [(F.col("file_no") + _BIAS).alias("file"), (F.col("slot") * (1 << STEPS[0]) + _prefix(F.col("sha"))).alias("idx")]
    near = both.select("*", *leaf).join(bad, ["file", "idx"], "left_semi")
    side = [F.sum(F.when(F.col("replica") == r, F.col("n")).otherwise(0)).alias(n) for r, n in ((0, "first_n"), (1, "second_n"))]
    return near.groupBy("file_no", "slot", "page_id", "sha", "record_length").agg(*side).where("first_n <> second_n")


def audited_records(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """The records of pages, and those that only the replica has, with their state.

    same: the replica holds that copy of the record. changed: it holds other records under that id instead.
    missing: it holds nothing instead. extra: only the replica holds it; seq and record_offset are null then.
    Null urls and pages count as empty; null ids, repeated ids and repeated rows are records like any other, as
    in `records`; other columns are ignored; two empty tables give an empty result.
    """
    own = written(contents(pages), "warcown")
    found = written(audit(own, contents(replica)), "warcfound")
    instead = found.groupBy("file_no", "slot").agg(F.max(F.col("second_n") > F.col("first_n")).alias("instead"))
    lost = found.join(instead, ["file_no", "slot"]).select("file_no", "slot", "sha", "second_n", "instead")
    state = F.when(F.col("second_n").isNull() | (F.col("copy") < F.col("second_n")), "same").when(F.col("instead"), "changed").otherwise("missing")
    kept = records(own).join(lost, ["file_no", "slot", "sha"], "left").select("page_id", "file_no", "seq", "record_offset", "record_length", "sha", state.alias("state"))
    more = found.where("second_n > first_n").withColumn("copy", F.explode(F.sequence(F.col("first_n"), F.col("second_n") - 1)))
    none = F.lit(None).cast("long")
    return kept.unionByName(more.select("page_id", "file_no", none.alias("seq"), none.alias("record_offset"), "record_length", "sha", F.lit("extra").alias("state")))


def rotten(pages: DataFrame) -> DataFrame:
    """A replica with damage at every scale, by page id: shifted content, lost records, doubled records, and
    neighbours that have exchanged their ids."""
    i = F.col("page_id")
    html = F.when(i % 31 == 7, F.concat(F.expr("substring(html, 2)"), F.lit("x"))).otherwise(F.col("html"))
    swapped = F.when(F.shiftright(i, 1) % 43 == 2, i.bitwiseXOR(F.lit(1).cast("long"))).otherwise(i)
    twice = F.when(i % 41 == 3, F.lit(2)).otherwise(F.lit(1))
    out = pages.where(F.coalesce(i % 37, F.lit(0)) != 5).select(swapped.alias("page_id"), "url", html.alias("html"), F.explode(F.sequence(F.lit(1), twice)).alias("copy"))
    return out.select("page_id", "url", "html")


def op9_rows(pages: DataFrame) -> DataFrame:
    return audited_records(pages, rotten(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")))


def write_warc(pages: DataFrame, path: str) -> None:
    """One WARC file in each folder path/file_no=N, its records at the offsets that `records` gives. Null urls and
    pages are written empty; an empty table writes no file."""
    rows = placed(pages).repartition("file_no").sortWithinPartitions("file_no", "slot", "sha")
    rows.select("file_no", F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("file_no").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(url, html, sound) of the records under path; sound: the content has the stated length.

    Files are split between tasks at record starts, so none needs to fit in memory. Where a content holds the
    start of a record itself, its parts are found to be shorter than stated; the files in which that happens are
    read in order, and parts are joined until the stated length is reached. A record that no number of parts
    completes is given as it stands, not sound. Empty files have no records.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.option("lineSep", VERSION).text(path).select(*place, F.monotonically_increasing_id().alias("row"), "value")
    stated = F.regexp_extract(F.substring_index("value", CRLF + CRLF, 1), r"(?i)Content-Length: *(\d+)", 1).try_cast("long")
    given = F.octet_length("value") - F.octet_length(F.substring_index("value", CRLF + CRLF, 1)) - 8
    rows = rows.withColumn("sound", (F.col("value") == "") | F.coalesce(stated == given, F.lit(False)))
    open_ = written(rows.where("not sound").select("file").distinct(), "warcopen")
    whole = rows.join(open_, "file", "left_anti").select("value")
    parted = rows.join(open_, "file", "left_semi").repartition("file").sortWithinPartitions("file", "block", "row").select("file", "value")
    values = whole.unionByName(parted.mapInArrow(_stitched, "value string")).where(F.col("value") != "")
    head, body = F.substring_index("value", CRLF + CRLF, 1), F.expr(r"substring(value, length(substring_index(value, '\r\n\r\n', 1)) + 5)")
    html = F.regexp_replace(body, r"\r\n\r\n\z", "")
    url = F.regexp_extract(head, r"WARC-Target-URI: ([^\r\n]*)", 1)
    length = F.regexp_extract(head, r"(?i)Content-Length: *(\d+)", 1)
    return values.select(url.alias("url"), html.alias("html"), (F.octet_length(html).cast("string") == length).alias("sound"))


def _stitched(batches):
    """Records from the parts of whole files in order, joined until the length that each states is reached."""
    import re

    length = re.compile(rb"Content-Length: *([0-9]+)", re.I)

    def wanted(part: bytes) -> int:
        head = part.split(b"\r\n\r\n", 1)[0]
        stated = length.search(head)
        return len(head) + 8 + int(stated[1]) if stated else -1

    held, file, size, want = [], None, 0, -1

    def flush():
        # what did not add up is given part by part
        out = [x.decode("utf-8", "replace") for x in held]
        held.clear()
        return out

    for batch in batches:
        out = []
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = value.encode("utf-8", "surrogatepass")
            joined = size + len(VERSION) + len(part)
            if held and name == file and joined <= want:
                held.append(part)
                size = joined
            else:
                out += flush()
                held.append(part)
                file, size, want = name, len(part), wanted(part)
            if size == want or want < size:
                out.append(VERSION.encode().join(held).decode("utf-8", "replace"))
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(flush(), pa.string())], names=["value"])
