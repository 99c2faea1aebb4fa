import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

from ledgerlake.llm.secret_scan import find_secrets, mask_secrets, masked, scan, scan_secrets


def plain(text):
    """The contract read literally: leftmost matches, then the failing ones dropped."""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return found


SECRET = "password=hunter2hunter2"


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    parts = ["secret", "TOKEN", "api_key", "apiKey", "=", ":", " ", '"', "'", "abc", "deadbeef" * 5, "AKIA", "ABCDEFGH1234", "é", "ſecret", "K", "\n", "x/+.-_="]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert scan(text) == plain(text)


def test_nested_layers_map_to_the_whole_text():
    gz = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    for inner in (base64.b64encode(SECRET.encode()).decode(), gz, base64.urlsafe_b64encode(zlib.compress(SECRET.encode())).decode(), base64.b64encode(bz2.compress(gzip.compress(SECRET.encode()))).decode(), base64.b64encode(base64.b64encode(SECRET.encode())).decode()):
        text = f"é start {inner} end"
        base, added, _ = find_secrets(text)
        assert not [s for s in base if s[0] == "assign"]
        assert ("assign", 8, 8 + len(inner)) in added
        url = f"q {quote(inner, safe='')} x"
        assert any(s[0] == "assign" for s in find_secrets(url)[1])
    text = "aa password%3Dhunter2hunter2 bb"
    assert find_secrets(text)[1] == [("assign", 3, 28)]
    text = "aa \\u0070assword\\u003dhunter2hunter2 bb &quot;"
    assert find_secrets(text)[1] == [("assign", 3, 36)]
    text = "tok&#101;n%3a%20abcdefgh12"
    assert find_secrets(text)[1] == [("assign", 0, len(text))]
    double = quote(quote(SECRET, safe=""), safe="")
    assert find_secrets(double)[1] == [("assign", 0, len(double))]


def test_clean_texts_stay_clean_and_bombs_are_refused():
    for text in ("", "100% sure \\u12 &amp; a%zz", "wordswithoutanyencodinginthem andmoreofthesamekind", "x" * 300_000, "%41" * 1000):
        assert find_secrets(text)[:2] == ([], [])
    bomb = base64.b64encode(zlib.compress(b"a" * (40 << 20))).decode()
    assert find_secrets(bomb)[2] == 1


def test_masking():
    assert masked(f"a {SECRET} b") == "a [assign] b"
    key = "token = \"" + "0123456789abcdef" * 3 + "\""
    assert masked(f"x {key} y") == 'x [assign]" y'


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = {"assign": 0, "access": 1, "hex": 2}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scan_secrets(docs).collect():
        want = plain(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(want, key=lambda s: (s[1], order[s[0]])))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in order)
        assert set(line.split(",")) <= set(r.spans.split(","))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, SECRET, "b"), (None, SECRET, "b"), (2, "", "c")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_assign, r.spans) for r in scan_secrets(df).collect())
    assert got == [(0, 1, "assign:0:23"), (0, 1, "assign:0:23"), (1, 0, ""), (2, 0, "")]
    assert scan_secrets(df.limit(0)).count() == 0
    clean = mask_secrets(df)
    assert clean.columns == df.columns and sorted(str(r.text) for r in clean.collect()) == sorted(["", "None", "[assign]", "[assign]"])


def test_all_members_of_compressed_streams_are_read():
    for compress in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        for parts in ([b"plain words here", SECRET.encode()], [b"x", b"y" * 3_000_000, SECRET.encode(), b"z"]):
            inner = base64.b64encode(b"".join(map(compress, parts))).decode()
            assert find_secrets(f"a {inner} b")[1] == [("assign", 2, 2 + len(inner))]
    padded = base64.b64encode(gzip.compress(b"one") + bytes(512) + gzip.compress(SECRET.encode()) + b"rubbish").decode()
    assert find_secrets(padded)[1] == [("assign", 0, len(padded.rstrip("=")) + padded.count("="))]


def test_streams_beyond_the_limit_are_scanned_whole():
    rng = random.Random(1)
    filler = b"some words of no interest, "
    deep = base64.b64encode(gzip.compress(b"k " + SECRET.encode()))
    noise = base64.b64encode(rng.randbytes(2_500_000)) + b"\n"
    long = base64.b64encode(zlib.compress(noise * 2 + b" AKIAABCDEFGH1234 ", 0))
    for inner, kind in ((SECRET.encode(), "assign"), (deep, "assign"), (b"token" + b" " * 6_000_000 + b"= abcdefgh12", "assign"), (long, "access"), (b"%70assword%3Dhunter2hunter2", "assign"), (b"deadbeef" * 900_000, "hex")):
        for before in (34 << 20, (32 << 20) - 7) if inner == SECRET.encode() else (33 << 20,):
            data = (filler * (before // len(filler) + 1))[:before] + b" " + inner + b" " + filler * 100_000
            run = base64.b64encode(gzip.compress(data[:1000], 1) + gzip.compress(data[1000:], 1)).decode()
            base, added, large = find_secrets(f"a {run} b")
            assert not base and large == 1 and (kind, 2, 2 + len(run)) in added
    clean = base64.b64encode(gzip.compress(filler * 2_000_000)).decode()
    assert find_secrets(clean)[1:] == ([], 1)
    two = base64.b64encode(gzip.compress(gzip.compress(filler * 2_000_000 + SECRET.encode()))).decode()
    assert masked(f"a {two} b") == "a [assign] b"


def b64(data):
    return base64.b64encode(data).decode()


def test_encoded_values_inside_longer_runs_are_found():
    inner = b64(SECRET.encode())
    for before in ("https://h/x/", "h/", "k-", "id_", "abc/", "a\\n", '{"k":"\\n', "x" * 17 + "/"):
        for after in ("", "/tail", "-x_", "==" if not inner.endswith("=") else ""):
            base, added, _ = find_secrets(before + inner + after)
            assert not base and any(k == "assign" and a <= len(before) + 4 and b >= len(before) + 20 for k, a, b in added), before
            assert all(a >= len(before) - 3 for _, a, _ in added)
    for data in (SECRET.encode() + b"\xff\xfe\x80", b"\x00\x01\x80" + SECRET.encode(), f"é {SECRET}".encode("latin-1"), f"\x1b[31m {SECRET} \x1b[0m".encode()):
        assert [s[0] for s in find_secrets(f"a {b64(data)} b")[1]] == ["assign"]
    for code in ("utf-16", "utf-16-le", "utf-16-be"):
        assert [s[0] for s in find_secrets(f"a {b64(SECRET.encode(code))} b")[1]] == ["assign"]
        assert [s[0] for s in find_secrets(f"a {b64(gzip.compress(SECRET.encode(code)))} b")[1]] == ["assign"]
    deep = b64(b"see /x/" + b64(gzip.compress(b"id_" + b64(SECRET.encode()).encode())).encode())
    assert [s[0] for s in find_secrets(f"https://h/y/{deep}")[1]] == ["assign"]


def test_json_escapes_and_escaped_streams_are_layers():
    assert find_secrets('{\\"password\\":\\"hunter2hunter2\\"}')[1] == [("assign", 3, 30)]
    assert find_secrets('"a\\/token\\u003d\\u0022abcdefgh12"')[1] == [("assign", 4, 31)]
    assert find_secrets("C:\\new\\tab and \\/ \\\\ end")[1] == []
    stream = gzip.compress(SECRET.encode())
    for text in (quote(stream, safe=""), "".join(f"%{x:02x}" for x in stream), "".join(f"\\x{x:02x}" for x in stream), "".join(f"\\u{x:04X}" for x in stream), repr(stream)[2:-1]):
        assert {s[0] for s in find_secrets(f"a {text} b")[1]} == {"assign"}, text


WRAPS = {
    "percent": lambda s, rng: quote(s, safe="") if rng.random() < 0.5 else "".join(f"%{x:02X}" for x in s.encode()),
    "unicode": lambda s, rng: "".join(f"\\u{ord(c):04x}" if rng.random() < 0.6 or c in "\\=" else c for c in s),
    "html": lambda s, rng: "".join(f"&#{ord(c)};" if rng.random() < 0.6 or c in "&=" else c for c in s),
    "base64": lambda s, rng: rng.choice(("", "v/", "k-", "id_", "a/b/c/")) + b64(s.encode() + rng.choice((b"", b"\xff\x80", b"\n"))),
    "urlsafe": lambda s, rng: base64.urlsafe_b64encode(s.encode()).decode(),
    "gzip": lambda s, rng: b64(gzip.compress(s.encode())),
    "zlib": lambda s, rng: b64(b"\x00\x80" * rng.randrange(3) + zlib.compress(s.encode())),
    "xz": lambda s, rng: b64(lzma.compress(s.encode()) + rng.randbytes(rng.randrange(4))),
    "bz2": lambda s, rng: b64(bz2.compress(s.encode())),
}


def test_planted_layers_are_all_found():
    """Random nestings of up to four encodings: every planted secret is found inside the characters it was put in,
    and nothing is found in the same nestings of clean text."""
    rng = random.Random(11)
    for n in range(400):
        secret, clean = rng.choice((SECRET, "AKIA" + "ABCDEFGH12345678", "deadbeef" * 5, "token: 'abc.def/ghi12'")), "nothing of interest in here"
        how = [rng.choice(sorted(WRAPS)) for _ in range(rng.randrange(1, 5))]
        found = []
        for s in (secret, clean):
            state = random.Random(n)
            for w in how:
                s = WRAPS[w](s, state)
            text = f"é some words {s} and more"
            base, added, refused = find_secrets(text)
            assert refused == 0
            found.append([x for x in base + added if x[1] >= 13 and x[2] <= 13 + len(s)])
            assert len(found[-1]) == len(base + added)
        kind = "access" if secret[:4] == "AKIA" else "hex" if secret[0] == "d" else "assign"
        assert kind in {x[0] for x in found[0]}, (how, secret)
        assert not found[1], (how, found[1])
