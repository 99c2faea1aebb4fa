"""Personal data by bootstrapped contextual extraction.

Emails, addresses, cards and phones that the fixed patterns find are seeds. The words around each seed are
lexical patterns: the two words before it, and the word before with the word after. Other tokens that look
like identifiers are candidates, with patterns of their own: tokens with an at sign, or with `digits` digits or
more, digit groups parted by single spaces being one token. Identifiers without an at sign and with fewer digits
than that are not sought. Patterns and instances form a graph that Spark scores in rounds: a pattern's
confidence in a kind is the smoothed share of its instances that hold that kind, an instance's score is the
noisy-or of its confident patterns, and instances above the threshold act as seeds from the next round on,
until a round accepts no new one. Occurrences of accepted candidates become further spans of their kind.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, release, written
from .spans import digest

KINDS = ("email", "ip", "card", "phone")
#: Patterns that the result's contract fixes, written so that long runs take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Distinct seeds that a pattern needs, its least confidence, and the least score of an instance.
SUPPORT, CONFIDENCE, SCORE = 3, 0.6, 0.6
#: Digits that make a token a candidate.
DIGITS = 4

_MARK = re.compile(r"[0-9@]\S*+")
_GROUP = re.compile(r"\+?[0-9][0-9().-]*")
_BETWEEN = re.compile(r"\)?[ ]\(?")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`()[]{}<>.,;:!?"


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans of a whole text."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def find_candidates(text: str, base: list[tuple[str, int, int]], digits: int = DIGITS) -> list[tuple[int, int]]:
    """Identifier-like tokens that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    tokens, floor = [], 0
    for m in _MARK.finditer(text):
        a, b = m.span()
        while a > floor and not text[a - 1].isspace():
            a -= 1
        floor = b
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            tokens.append((a, b))
    out, k = [], 0
    for a, b in _groups(text, tokens):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        token = text[a:b]
        if "@" in token and len(token) > 3 or sum(map(token.count, "0123456789")) >= digits:
            out.append((a, b))
    return out


def _groups(text: str, tokens: list[tuple[int, int]]):
    """The tokens, digit groups that are parted by one space or bracket and space joined."""
    held = None
    for a, b in tokens:
        plain = _GROUP.fullmatch(text, a, b) is not None
        if held is not None and plain and a - held[1] <= 3 and _BETWEEN.fullmatch(text, held[1], a):
            held = (held[0], b)
            continue
        if held is not None:
            yield held
            held = None
        if plain:
            held = (a, b)
        else:
            yield a, b
    if held is not None:
        yield held


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def patterns(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hashes of the two lexical patterns around each span. Words are whole, however long; where other spans stand
    near, each counts as one word. The time is linear in the text, since words are read off between spans."""
    order = sorted(range(len(spans)), key=spans.__getitem__)
    blocks: list[list[int]] = []  # spans that overlap share their surroundings
    of = [0] * len(spans)
    for k in order:
        a, b = spans[k]
        if blocks and a < blocks[-1][1]:
            blocks[-1][1] = max(b, blocks[-1][1])
        else:
            blocks.append([a, b])
        of[k] = len(blocks) - 1
    ends = [0, *(b for _, b in blocks)]
    starts = [*(a for a, _ in blocks), len(text)]
    last, first = [], []
    for k, (x, y) in enumerate(zip(ends, starts)):  # the gap before block k
        gap = text[x:y]
        words = [_DIGIT.sub("#", w.lower()) for w in gap.rsplit(None, 2)[-2:]] if gap else []
        words = [*(last[-1][1:] + ["@"] if k else ["^", "^"]), *words][-2:]
        last.append(words)
        after = gap.split(None, 1)
        first.append(_DIGIT.sub("#", after[0].lower()) if after else "@" if k < len(blocks) else "$")
    marks = [(_hash(f"{last[k][0]} {last[k][1]} _"), _hash(f"{last[k][1]} _ {first[k + 1]}")) for k in range(len(blocks))]
    return [marks[k] for k in of]


_PLACE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("inst", T.LongType()), ("pats", T.ArrayType(T.LongType())))]))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digits: int = DIGITS) -> DataFrame:
    """doc_id, base_sha256 and places: base spans (with their kind) and candidates (kind null), for each row of docs.
    Null text counts as empty; null ids and repeated rows are rows like any other; an empty table gives none."""

    def run(batches):
        places = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inst", pa.int64()), ("pats", pa.list_(pa.int64()))]))
        for batch in batches:
            marks, found = [], []
            for t in batch.column(1):
                s = t.as_py()
                base = find_base(s)
                spans = base + [(None, a, b) for a, b in find_candidates(s, base, digits)]
                pats = patterns(s, [(a, b) for _, a, b in spans])
                marks.append(digest(base, KINDS))
                found.append([{"kind": k, "start": a, "end": b, "inst": _hash(s[a:b].lower()), "pats": p} for (k, a, b), p in zip(spans, pats)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), pa.array(found, places)], names=["doc_id", "base_sha256", "places"])

    got = docs.select(F.col(doc_id).alias("doc_id"), as_text(text).alias("text"))
    return got.mapInArrow(run, T.StructType([got.schema["doc_id"], T.StructField("base_sha256", T.StringType()), T.StructField("places", _PLACE)]))


def accepted(seen: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, score: float = SCORE) -> DataFrame:
    """(inst, kind): candidates that the pattern-instance graph accepts, from the places in `seen`.

    An instance that is accepted once stays so, with its best score, so rounds end when one accepts no new pair of
    instance and kind. Repeated places count once; without seeds nothing is accepted.
    """
    place = seen.select(F.explode("places").alias("p")).select("p.kind", "p.inst", "p.pats")
    all_edges = written(place.select(F.explode("pats").alias("pat"), "inst").distinct(), "piiedges")
    size = written(all_edges.groupBy("pat").agg(F.count("*").alias("n")).where(F.col("n") > support), "piisizes")
    edges = written(all_edges.join(size, "pat"), "piiedges")  # a pattern with no instance beside its seeds leads nowhere
    fixed = written(place.where("kind is not null").groupBy("inst", "kind").agg(F.lit(1.0).alias("s")), "piiseeds")
    release(all_edges, size)
    known, count = written(fixed, "piiknown"), -1
    while (now := known.count()) > count:
        count = now
        held = edges.join(known, "inst").groupBy("pat", "kind").agg(F.sum("s").alias("s"), F.count("*").alias("seeds"), F.max("n").alias("n"))
        strong = held.where((F.col("seeds") >= support) & (F.col("s") / (F.col("n") + 1) >= confidence)).select("pat", "kind", (F.col("s") / (F.col("n") + 1)).alias("c"))
        strong = written(strong, "piistrong")
        scored = edges.join(strong, "pat").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("s"))
        fresh = scored.where(F.col("s") >= score).join(fixed.select("inst").distinct(), "inst", "left_anti")
        more = written(known.unionByName(fresh).groupBy("inst", "kind").agg(F.max("s").alias("s")), "piiknown")
        release(known, strong)
        known = more
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = known.join(fixed.select("inst").distinct(), "inst", "left_anti").groupBy("inst").agg(F.max(F.struct("s", -order, "kind")).alias("best"))
    return best.select("inst", "best.kind")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digits: int = DIGITS, **thresholds) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Null text counts as empty. Null ids, repeated rows and very long texts are rows like any other; other
    columns are ignored. An empty table gives an empty result. Where two kinds accept a candidate, the
    higher score decides, then the kind listed first.
    """
    seen = written(occurrences(docs, doc_id, text, digits).withColumn("row", F.monotonically_increasing_id()), "piiseen")
    good = accepted(seen, **thresholds)
    open_ = seen.select("row", F.explode(F.filter("places", lambda p: p["kind"].isNull())).alias("p")).select("row", "p.start", "p.end", "p.inst")
    added = open_.join(good, "inst").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    base = F.transform(F.filter("places", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    both = seen.withColumn("base", base).join(written(added, "piiadded"), "row", "left").withColumn("all", F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))))
    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("o"), s["end"].alias("b"), s["kind"].alias("k"))))
    line = F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return both.select("doc_id", *counts, "base_sha256", line.alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))
