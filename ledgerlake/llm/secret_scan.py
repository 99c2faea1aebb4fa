"""Secret scans that unwrap nested encodings.

Each text starts a worklist of layers. A layer is scanned for secrets and then decoded in each way that
applies: percent escapes, Unicode, HTML and JSON escapes, base64, and gzip, zlib, bzip2 or xz streams inside
any of them. Every decoded text is a new layer, until none is left. A layer whose content was seen before at
that place is not entered again, so cycles end. Spans in a layer are mapped back to the whole text: to the
escaped characters where single characters were escaped, to the encoded characters where a run was.

A run of base64 characters may hold more than one encoded value: a path or a key may stand before it, other
bytes after it. It is therefore decoded in all four alignments, and every stretch of readable text (UTF-8 or
UTF-16, as long as the shortest secret) and every compressed stream inside the bytes is a layer of its own.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, enter
from .spans import digest, joined

KINDS = ("assign", "access", "hex")
#: Bytes to which one compressed stream may expand at once. Larger ones are scanned in windows and counted in n_refused.
MAX_EXPANDED = 32 << 20
#: Characters of a window and of its overlap with the next; longer encoded runs are decoded as they pass.
WINDOW, OVERLAP = 4 << 20, 1 << 20
#: Bytes that are decompressed at once.
PIECE = 1 << 20
#: Patterns and shortest lengths that the result's contract fixes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|\\U00[01][0-9A-Fa-f]{5}|\\[\"'\\/bfnrt]|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z]{2,8};")
#: Where two backslashes meet, the second may also start an escape of its own.
_SINGLE = re.compile(_UNICODE.pattern.replace(r"""|\\["'\\/bfnrt]""", ""))
_JSON = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
_LINES64 = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")
#: Compressed streams start like this, as bytes and as characters below U+0100.
_STARTS = rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00"
_START = re.compile(_STARTS)
_START_CHARS = re.compile(_STARTS.decode("latin-1"))
_BYTE_CHARS = re.compile("[\x00-\xff]+")
_QUOTED_BYTES = re.compile(r"(?<![^\s%\"'<>])[^\s%\"'<>]*+(?:%[0-9A-Fa-f]{2}[^\s%\"'<>]*+)++")
#: Readable stretches in decoded bytes. The shortest secret is `token=` and eight characters.
_READABLE = re.compile(rb"(?:[\x09-\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}+")
_WIDE = (("utf-16-le", re.compile(rb"(?:[\x09-\x0d\x20-\x7e]\x00){14,}+")), ("utf-16-be", re.compile(rb"(?:\x00[\x09-\x0d\x20-\x7e]){14,}+")))
_URLSAFE = str.maketrans("-_", "+/", "\r\n")
_BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)
_RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"
_RUN = re.compile(r"[A-Za-z0-9+/_\r\n-]*")
_SPACES = re.compile(r"\x20{2,}")


def scan(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans of one layer."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class _Whole:
    """A layer made of its parent with some runs replaced: places map run by run."""

    def __init__(self, parent, text, runs):
        self.parent, self.outs, self.steps, out, at, made = parent, [0], [(0, 0, False)], [], 0, 0
        for a, b, new in runs:
            out += [text[at:a], new]
            made += a - at
            self.outs.append(made)
            self.steps.append((a, b, True))
            made += len(new)
            self.outs.append(made)
            self.steps.append((b, b, False))
            at = b
        out.append(text[at:])
        self.text = "".join(out)

    def _at(self, place: int) -> tuple[int, int]:
        k = bisect_right(self.outs, place) - 1
        a, b, replaced = self.steps[k]
        return (a, b) if replaced else (a + place - self.outs[k], a + place - self.outs[k] + 1)

    def up(self, a: int, b: int) -> tuple[int, int]:
        return self.parent(self._at(a)[0], self._at(b - 1)[1])


def _percent(m: re.Match) -> str | None:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _unicode(m: re.Match) -> str | None:
    s = m[0]
    try:
        if s[0] == "&":
            new = html.unescape(s)
            return None if new == s else new
        if len(s) == 2:
            return _JSON.get(s[1], s[1])
        if s[1] == "x":
            return bytes.fromhex(s.replace("\\x", "")).decode("latin-1")
        if s[1] == "U":
            return chr(int(s[2:], 16))
        return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be")
    except (UnicodeDecodeError, ValueError, OverflowError):
        return None


def _tool(data: bytes):
    """The decompressor of the stream that starts data, None where data is none."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(47)
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=4 * MAX_EXPANDED)
    return None


def _drained(tool, data: bytes):
    """What tool makes of data, in pieces of at most PIECE bytes."""
    while True:
        out = tool.decompress(data, PIECE)
        if out:
            yield out
        data = getattr(tool, "unconsumed_tail", b"")
        if tool.eof or getattr(tool, "needs_input", not data and len(out) < PIECE):
            return


def _expand(data: bytes) -> tuple[bytes, int] | None:
    """The content of all members of a compressed stream at the start of data, and how many bytes it takes; None
    where data is none; raises MemoryError past MAX_EXPANDED. What a broken stream gives before it breaks counts
    where something in it is readable."""
    parts, size, rest, whole = [], 0, data, False
    while (tool := _tool(rest)) is not None:
        try:
            for part in _drained(tool, rest):
                parts.append(part)
                size += len(part)
                if size > MAX_EXPANDED:
                    raise MemoryError
        except _BROKEN:
            rest = b""
            break
        if not tool.eof:
            rest = b""
            break
        whole, rest = True, tool.unused_data.lstrip(b"\0")
    out = b"".join(parts)
    return (out, len(data) - len(rest)) if size and (whole or _READABLE.search(out)) else None


def _texts(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, text) of the readable stretches of data."""
    out = [(*m.span(), m[0].decode("utf-8", "replace")) for m in _READABLE.finditer(data)]
    if data.count(b"\0") >= 14:
        at = 0
        for code, pattern in _WIDE:
            for m in pattern.finditer(data):
                if m.start() >= at or code == "utf-16-le":
                    out.append((*m.span(), m[0].decode(code)))
                    at = max(at, m.end())
    return out


def _decoded(data: bytes) -> str:
    """The content of a stream as text: wide where it is UTF-16, else UTF-8 with U+FFFD for bad bytes."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or 3 * data[:1000].count(b"\0") > len(data[:1000]):
        big = data[:2] == b"\xfe\xff" or data[:2] != b"\xff\xfe" and data[:1000:2].count(b"\0") > data[1:1000:2].count(b"\0")
        return data.decode("utf-16-be" if big else "utf-16-le", "replace")
    return data.decode("utf-8", "replace")


def _inside(data: bytes):
    """(start, end, text, data) of all that bytes hold: readable stretches, and compressed streams through streams
    in them, up to the end of data. Where a stream is too large to be held, text is None and data starts with it."""
    at, taken = 0, []
    while (m := _START.search(data, at)) is not None:
        at = m.start()
        try:
            got, seen = _expand(data[at:] if at else data), set()
            if got is None:
                at += 1
                continue
            content, used = got
            while (mark := hashlib.sha256(content).digest()) not in seen and (more := _expand(content)) is not None:
                seen.add(mark)
                content = more[0]
        except MemoryError:
            yield at, len(data), None, data[at:]
            taken.append((at, len(data)))
            break
        yield at, len(data), _decoded(content), None
        taken.append((at, at + max(used, 1)))
        at = taken[-1][1]
    for a, b, text in _texts(data):
        if not any(x <= a and b <= y for x, y in taken):
            yield a, b, text, None


class _Found:
    """The kinds in a text that passes in parts: all layers of overlapping windows, and what is inside runs that
    are longer than the overlap. Only kinds are kept, since the whole stream maps to one run of its parent."""

    def __init__(self, kinds: set):
        self.kinds, self.text, self.fresh, self.run = kinds, "", 0, None
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes, last: bool = False) -> None:
        new = self.decoder.decode(data, last)
        self.text += new
        self.fresh += len(new)
        if self.fresh >= WINDOW or last:
            self._scan(last)

    def close(self) -> None:
        self.feed(b"", True)

    def _scan(self, last: bool) -> None:
        text, old = self.text, len(self.text) - self.fresh
        if len(self.kinds) < len(KINDS):
            self.kinds.update(s[0] for part in find_secrets(text)[:2] for s in part)
        if self.run is not None:
            end = _RUN.match(text, old).end()
            self.run.feed(text[old:end])
            if end < len(text):
                self.run.close()
                self.run = None
        if self.run is None and not last:
            start = len(text.rstrip(_RUN_CHARS))
            if len(text) - start > OVERLAP:
                self.run = _Run(self.kinds)
                self.run.feed(text[start:])
        if last and self.run is not None:
            self.run.close()
        # an assignment may hold any number of spaces
        self.text, self.fresh = _SPACES.sub(" ", text)[-OVERLAP:], 0


class _Run:
    """The kinds inside a base64 run that passes in parts, in all four alignments."""

    def __init__(self, kinds: set):
        self.inner, self.rest, self.begun = [_Stream(kinds) for _ in range(4)], [""] * 4, False

    def feed(self, part: str) -> None:
        part = part.translate(_URLSAFE)
        for k in range(4):
            rest = self.rest[k] + (part if self.begun else part[k:])
            whole = len(rest) // 4 * 4
            self.inner[k].feed(base64.b64decode(rest[:whole]))
            self.rest[k] = rest[whole:]
        self.begun = True

    def close(self) -> None:
        for k in range(4):
            if len(self.rest[k]) > 1:
                self.inner[k].feed(base64.b64decode(self.rest[k] + "=" * (-len(self.rest[k]) % 4)))
            self.inner[k].close()


class _Stream:
    """The kinds in bytes that pass in parts: the members of compressed streams, or text."""

    def __init__(self, kinds: set):
        self.kinds, self.head, self.tool, self.inner = kinds, b"", None, None

    def feed(self, data: bytes, last: bool = False) -> None:
        while data or last:
            if self.tool is None:
                if isinstance(self.inner, _Found):
                    self.inner.feed(data)
                    return
                data, self.head = self.head + data, b""
                if self.inner is not None:  # between members
                    data = data.lstrip(b"\0")
                if len(data) < 6 and not last:
                    self.head = data
                    return
                self.tool = _tool(data)
                if self.tool is None:
                    if self.inner is None:
                        self.inner = _Found(self.kinds)
                        self.inner.feed(data)
                    return
                self.inner = self.inner or _Stream(self.kinds)
            try:
                for part in _drained(self.tool, data):
                    self.inner.feed(part)
                    if len(self.kinds) == len(KINDS):
                        return
            except _BROKEN:
                self.tool = None
                self.head = b""
                return
            if not self.tool.eof:
                return
            data, self.tool = self.tool.unused_data, None

    def close(self) -> None:
        if self.tool is None and self.head:
            self.feed(b"", True)
        if self.inner is not None:
            self.inner.close()


def _aligned(plain: str, k: int) -> bytes:
    """What base64 characters encode from the k-th on."""
    part = plain[k:]
    part = part[:-1] if len(part) % 4 == 1 else part
    return base64.b64decode(part + "=" * (-len(part) % 4))


def _kinds_in(data: bytes) -> set:
    """The kinds inside a compressed stream that is too large to be held, in all of its layers."""
    stream = _Stream(kinds := set())
    for k in range(0, len(data), PIECE):
        stream.feed(data[k : k + PIECE])
    stream.close()
    return kinds


def _encoded(now: str):
    """(start, end, text, data) of all that base64 runs of a text hold, as `_inside` gives them."""
    for pattern in (_BASE64, _LINES64) if "\n" in now else (_BASE64,):
        for m in pattern.finditer(now):
            token = m[0].rstrip("=")
            plain = token.translate(_URLSAFE)
            places = [i for i, c in enumerate(token) if c not in "\r\n"] if len(plain) < len(token) else range(len(plain))
            for k in range(min(4, len(plain))):
                data = _aligned(plain, k)
                for a, b, text, raw in _inside(data):
                    first, last = k + a * 4 // 3, min(k - (-4 * b // 3), len(plain))
                    end = m.end() if b == len(data) else m.start() + places[last - 1] + 1
                    yield m.start() + places[first], end, text, raw


def _raw(now: str):
    """The same of compressed streams that stand in a text as bytes, each byte a character or escaped by percent."""
    for m in _START_CHARS.finditer(now):
        end = _BYTE_CHARS.match(now, m.start()).end()
        try:
            got = _expand(data := now[m.start() : end].encode("latin-1"))
        except MemoryError:
            yield m.start(), end, None, data
            continue
        if got is not None:
            yield m.start(), m.start() + got[1], _decoded(got[0]), None
    if "%" in now:
        for m in _QUOTED_BYTES.finditer(now):
            data = unquote_to_bytes(m[0])
            if _START.search(data):
                yield from ((*m.span(), text, raw) for _, _, text, raw in _inside(data))


def layers(text: str):
    """(layer text, mapping of its spans to text, spans in streams too large to be layers, number of these) for
    each decoded layer, the text itself first."""
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work = [(text, lambda a, b: (a, b))]
    while work:
        now, up = work.pop()
        large, refused = [], 0
        fresh = []
        for marks, pattern, decode in ((("%",), _PERCENT, _percent), (("\\", "&"), _UNICODE, _unicode), (("\\\\",), _SINGLE, _unicode)):
            if any(c in now for c in marks):
                runs = [(*m.span(), new) for m in pattern.finditer(now) if (new := decode(m)) is not None]
                if runs:
                    whole = _Whole(up, now, runs)
                    fresh.append((whole.text, whole.up))
        for a, b, inner, data in chain(_encoded(now), _raw(now)):
            if inner is not None:
                fresh.append((inner, lambda a, b, to=up(a, b): to))
            else:
                refused += 1
                large += [(kind, *up(a, b)) for kind in _kinds_in(data)]
        for layer in fresh:
            mark = hashlib.sha256(layer[0].encode("utf-8", "surrogatepass")).digest()
            # runs with the same content at other places are layers of their own: the place is part of the mark
            mark += repr(layer[1](0, len(layer[0]))).encode() if layer[0] else b""
            if layer[0] and mark not in seen:
                seen.add(mark)
                work.append(layer)
        yield now, up, large, refused


def find_secrets(text: str) -> tuple[list, list, int]:
    """(base spans, spans that decoding adds, streams scanned in windows for their size)."""
    base, added, refused = [], set(), 0
    for k, (layer, up, large, no) in enumerate(layers(text)):
        refused += no
        added.update(large)
        if k == 0:
            base = scan(layer)
        else:
            added.update((kind, *up(a, b)) for kind, a, b in scan(layer))
    return base, sorted(added.difference(base)), refused


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added,
    n_refused (streams of more than MAX_EXPANDED bytes, which are scanned in windows). Null text counts as empty. Null ids, repeated rows and very long texts are rows like any
    other; other columns are ignored.
    """

    def run(batches):
        enter("secrets")
        for batch in batches:
            out = []
            for t in batch.column(1):
                base, added, refused = find_secrets(t.as_py())
                n = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((*n, digest(base, KINDS), joined(base + added, KINDS), len(added), refused))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    got = docs.select(F.col(doc_id).alias("doc_id"), as_text(text).alias("text"))
    kinds = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType()), ("n_refused", T.LongType())]
    names = ["doc_id", *(n for n, _ in kinds)]
    return got.mapInArrow(run, T.StructType([got.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)]))


def masked(text: str) -> str:
    """The text with each secret replaced by [kind]; overlapping spans are replaced together."""
    base, added, _ = find_secrets(text)
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs with the secrets in `text` replaced; null stays null. All rows and columns stay. Where n_chars
    names a column, it gets the new length of the texts that changed."""

    def run(batches):
        enter("secrets")
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            k = batch.schema.get_field_index(text)
            old = batch.column(k).to_pylist()
            new = [None if t is None else masked(t) for t in old]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
            if n_chars is not None:
                c = batch.schema.get_field_index(n_chars)
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(c).to_pylist())]
                batch = batch.set_column(c, batch.schema.field(c), pa.array(sizes, batch.schema.field(c).type))
            yield batch

    docs = docs.withColumn(text, F.col(text).cast("string"))
    return docs.mapInArrow(run, docs.schema)
