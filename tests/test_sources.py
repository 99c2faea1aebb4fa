import hashlib
import os
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest

from ledgerlake.sources import containers, files
from ledgerlake.streaming import incremental

IMAGE = bytes(range(256)) * 40 + os.urandom(3000) + b"\0" * 9001


def deflate(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def cso(data, magic=b"CISO", block=2048):
    chunks = [data[k : k + block] for k in range(0, len(data), block)]
    packed = [deflate(c) if magic == b"CISO" else pa.Codec("lz4_raw").compress(c).to_pybytes() for c in chunks]
    at, index, body = 24 + 4 * (len(chunks) + 1), [], b""
    for raw, small in zip(chunks, packed):
        plain = len(small) >= len(raw)
        index.append(at | plain << 31)
        body += raw if plain else small
        at += len(raw if plain else small)
    return struct.pack("<4sIQIBBH", magic, 24, len(data), block, 1, 0, 0) + struct.pack(f"<{len(index) + 1}I", *index, at) + body


def gcz(data, block=4096):
    chunks = [data[k : k + block].ljust(block, b"\0") for k in range(0, len(data), block)]
    packed = [zlib.compress(c) for c in chunks]
    index, at = [], 0
    for raw, small in zip(chunks, packed):
        index.append(at | (len(small) >= len(raw)) << 63)
        at += min(len(small), len(raw))
    body = [r if len(s) >= len(r) else s for r, s in zip(chunks, packed)]
    return struct.pack("<IIQQII", 0xB10BC001, 0, at, len(data), block, len(chunks)) + struct.pack(f"<{len(index)}Q", *index) + struct.pack(f"<{len(body)}I", *map(zlib.adler32, body)) + b"".join(body)


def dax(data):
    chunks = [data[k : k + 8192] for k in range(0, len(data), 8192)]
    packed = [zlib.compress(c) for c in chunks]
    packed[0] = chunks[0]
    base = 32 + 6 * len(chunks) + 8
    at = [base + sum(map(len, packed[:k])) for k in range(len(packed))]
    return struct.pack("<4sIII16x", b"DAX\0", len(data), 1, 1) + struct.pack(f"<{len(at)}I", *at) + struct.pack(f"<{len(at)}H", *(len(p) & 0xFFFF for p in packed)) + struct.pack("<II", 0, 1) + b"".join(packed)


def wux(data, sector=1024):
    chunks = [data[k : k + sector].ljust(sector, b"\0") for k in range(0, len(data), sector)]
    kept = list(dict.fromkeys(chunks))
    head = struct.pack("<4sIIIQQ", b"WUX0", 0x1099D02E, sector, 0, len(data), 0) + struct.pack(f"<{len(chunks)}I", *(kept.index(c) for c in chunks))
    return head.ljust(-(-len(head) // sector) * sector, b"\0") + b"".join(kept)


@pytest.fixture
def library(tmp_path):
    made = {"a.cso": cso(IMAGE), "b.zso": cso(IMAGE, b"ZISO"), "c.gcz": gcz(IMAGE), "d.dax": dax(IMAGE), "e.wux": wux(IMAGE)}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def paths(spark, folder, *names):
    return spark.createDataFrame([(str(folder / n),) for n in names], "path string")


def test_decoded_digests_equal_the_image(spark, library):
    got = containers.digest_decoded(paths(spark, library, "a.cso", "b.zso", "c.gcz", "d.dax", "e.wux")).collect()
    assert {r.kind for r in got} == {"cso", "zso", "gcz", "dax", "wux"}
    assert {(r.sha1, r.size_bytes, r.error) for r in got} == {(hashlib.sha1(IMAGE).hexdigest(), len(IMAGE), None)}


def test_damage_is_reported_alone(spark, library):
    data = bytearray((library / "c.gcz").read_bytes())
    data[-5] ^= 1
    (library / "bad.gcz").write_bytes(data)
    (library / "cut.cso").write_bytes((library / "a.cso").read_bytes()[:40])
    got = {os.path.basename(r.path): r.error for r in containers.digest_decoded(paths(spark, library, "bad.gcz", "cut.cso", "a.cso", "missing")).collect()}
    assert got["a.cso"] is None and "checksum" in got["bad.gcz"] and "cut short" in got["cut.cso"] and got["missing"]


def test_block_tables(spark, library):
    got = containers.container_blocks(paths(spark, library, "a.cso")).orderBy("block_no").collect()
    assert len(got) == -(-len(IMAGE) // 2048) and sum(r.expected_len for r in got) == len(IMAGE)
    assert all(a.offset + a.stored_len == b.offset for a, b in zip(got, got[1:])) and any(r.raw for r in got)


def pfs0(entries, wide=24, magic=b"PFS0"):
    names = b"".join(n.encode() + b"\0" for n, _ in entries)
    head, at, name = b"", 0, 0
    for n, data in entries:
        head += struct.pack("<QQI", at, len(data), name).ljust(wide, b"\0")
        at, name = at + len(data), name + len(n) + 1
    return struct.pack("<4sIII", magic, len(entries), len(names), 0) + head + names + b"".join(d for _, d in entries)


def test_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.iso", b"bb"), z.writestr("._junk", b""), z.writestr("in.zip", b"")
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("x.iso", IMAGE)
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "z.zip", "c.iso")
    (tmp_path / "n.nsp").write_bytes(pfs0([("a.nca", b"xy"), ("b.tik", b"z")]))
    inner = pfs0([("m.nca", b"123")], 64, b"HFS0")
    (tmp_path / "x.xci").write_bytes((b"\0" * 0x100 + b"HEAD").ljust(0x130, b"\0") + struct.pack("<Q", 0x200) + b"\0" * (0x200 - 0x138) + pfs0([("secure", inner)], 64, b"HFS0"))
    got = {(os.path.basename(r.container), r.partition, r.name): r for r in containers.container_members(paths(spark, tmp_path, "z.zip", "t.tar.gz", "n.nsp", "x.xci")).collect()}
    assert set(got) == {("z.zip", "", "b.iso"), ("t.tar.gz", "", "c.iso"), ("n.nsp", "", "a.nca"), ("n.nsp", "", "b.tik"), ("x.xci", "secure", "m.nca")}
    assert got["z.zip", "", "b.iso"].crc32 == f"{zlib.crc32(b'bb'):08x}"
    for key, want in ((("n.nsp", "", "b.tik"), b"z"), (("x.xci", "secure", "m.nca"), b"123")):
        r = got[key]
        assert open(r.container, "rb").read()[r.offset : r.offset + r.size_bytes] == want
    quick = containers.quick_crc(paths(spark, tmp_path, "z.zip", "one.zip", "n.nsp")).collect()
    assert [(r.name, r.crc32) for r in quick] == [("x.iso", f"{zlib.crc32(IMAGE):08x}")]


def test_chd_headers_discs_and_slots(spark, tmp_path):
    head = struct.pack(">8sII4s4s4s4sQQQII20s20s20s", b"MComprHD", 124, 5, b"cdlz", b"cdzl", b"\0" * 4, b"\0" * 4, 9000, 0, 124, 19584, 2448, b"\1" * 20, b"\2" * 20, b"\0" * 20)
    text = b"TRACK:1 TYPE:MODE1\0"
    (tmp_path / "a.chd").write_bytes(head + struct.pack(">4sIQ", b"CHT2", 1 << 24 | len(text), 0) + text)
    r = containers.chd_info(paths(spark, tmp_path, "a.chd")).first()
    assert (r.codecs, r.logical_bytes, r.has_parent, r.metadata) == (["cdlz", "cdzl"], 9000, False, ["CHT2:TRACK:1 TYPE:MODE1"])
    image = bytearray(18 * 2048)
    image[16 * 2048 : 16 * 2048 + 6] = b"\1CD001"
    image[16 * 2048 + 8 : 16 * 2048 + 16] = b"PSP GAME"
    (tmp_path / "p.iso").write_bytes(image)
    with open(tmp_path / "p.iso", "rb") as f:
        assert containers.disc_kind(f) == "psp"
    wb = 30
    n = (143432 * 2 << 15) >> wb
    (tmp_path / "w.wbfs").write_bytes(struct.pack(">4sIBB", b"WBFS", 0, 9, wb).ljust(512, b"\0") + b"\0" * 0x100 + struct.pack(f">{n}H", 1, 0, 2, *[0] * (n - 3)))
    with open(tmp_path / "w.wbfs", "rb") as f:
        assert containers.wbfs_slots(f) == [(0, 1), (2, 2)]


def test_trees_and_digests(spark, tmp_path):
    for p in ("a.iso", "._a.iso", ".keep", "s/b.BIN", "s/t/c.iso", ".Trashes/d.iso"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(files.scan_files(spark, str(tmp_path))) == [".keep", "a.iso", "b.BIN", "c.iso"]
    assert names(files.scan_files(spark, str(tmp_path), ("iso",))) == ["a.iso", "c.iso"]
    assert names(files.scan_files(spark, str(tmp_path), max_depth=1)) == [".keep", "a.iso"]
    assert names(files.scan_files(spark, str(tmp_path), max_depth=2)) == [".keep", "a.iso", "b.BIN"]
    assert files.scan_store(spark, f"file://{tmp_path}").where("path like '%a.iso'").count() >= 1
    got = {os.path.basename(r.path): r for r in files.hash_files(paths(spark, tmp_path, "a.iso", "none"), ("crc32", "md5")).collect()}
    assert got["a.iso"].md5 == hashlib.md5(b"a.iso").hexdigest() and got["a.iso"].crc32 == f"{zlib.crc32(b'a.iso'):08x}" and got["a.iso"].sha1 is None
    assert got["none"].status == "failed" and got["none"].error


def test_cue_sheets(spark):
    text = 'FILE "a b.bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 01 00:00:00\nFILE c.bin BINARY\n  TRACK 02 AUDIO\n    PREGAP 00:02:00\n    INDEX 00 00:00:00\n    INDEX 01 00:02:05\n'
    got = files.cue_tracks(spark.createDataFrame([("x.cue", text)], "path string, value string")).orderBy("number").collect()
    assert [(r.number, r.track_type, r.file_name, r.pregap_frames, [(i.number, i.frames) for i in r.indices]) for r in got] == [(1, "MODE1/2352", "a b.bin", 0, [(1, 0)]), (2, "AUDIO", "c.bin", 150, [(0, 0), (1, 155)])]
    with pytest.raises(ValueError):
        files.parse_cue("TRACK 01 AUDIO")


def test_new_files_are_identified_once(spark, tmp_path):
    catalog = spark.createDataFrame([(1, 1, "a.iso", 3, hashlib.sha256(b"abc").hexdigest())], "catalog_id long, game_id long, file_name string, size_bytes long, sha256 string")
    games = spark.createDataFrame([(1, "a")], "game_id long, game_name string")
    lib = tmp_path / "lib"
    lib.mkdir()

    def step():
        incremental.scan_stream(spark, str(lib), catalog, games, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        return {r.name: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    (lib / "a.iso").write_bytes(b"abc")
    assert step() == {"a.iso": "verified"}
    (lib / "b.iso").write_bytes(b"abc")
    (lib / "c.iso").write_bytes(b"zzz")
    assert step() == {"a.iso": "verified", "b.iso": "misnamed", "c.iso": "unknown"}
    counted = incremental.verdict_counts(spark, spark.read.parquet(f"{tmp_path}/out"), "365 days").groupBy("verdict").sum("n").collect()
    assert {tuple(r) for r in counted} == {("verified", 1), ("misnamed", 1), ("unknown", 1)}


def iso(entries, sectors=0, system=b"PLAYSTATION", files=()):
    """An image with a root folder in sector 18 and contents from sector 20 on."""
    image = bytearray(24 * 2048)
    image[16 * 2048 : 16 * 2048 + 6] = b"\1CD001"
    image[16 * 2048 + 8 : 16 * 2048 + 8 + len(system)] = system
    struct.pack_into("<I", image, 16 * 2048 + 80, sectors)
    struct.pack_into("<I4xI", image, 16 * 2048 + 158, 18, 2048)
    at = 18 * 2048
    for k, name in enumerate(entries):
        size = 33 + len(name) + (33 + len(name)) % 2
        record = bytearray(size)
        record[0], record[32] = size, len(name)
        struct.pack_into("<I4xI", record, 2, 20 + k, 64)
        record[33 : 33 + len(name)] = name
        image[at : at + size] = record
        at += size
    for k, text in enumerate(files):
        image[(20 + k) * 2048 : (20 + k) * 2048 + len(text)] = text
    return bytes(image)


def test_kinds_of_discs():
    import io

    kind = lambda data: containers.disc_kind(io.BytesIO(data))
    assert kind(iso([b"system.cnf;1"], files=[b"BOOT2 = cdrom0:"])) == "ps2_cd"
    assert kind(iso([b"A", b"SYSTEM.CNF;1"], 500_000, files=[b"", b"BOOT2 = cdrom0:"])) == "ps2_dvd"
    assert kind(iso([b"SYSTEM.CNF;1"], files=[b"BOOT = cdrom:"])) == "ps1"
    assert kind(iso([b"PSP_GAME"], system=b"")) == kind(iso([b"UMD_DATA.BIN;1"], system=b"")) == kind(iso([], system=b"PSP GAME")) == "psp"
    whole = iso([b"SYSTEM.CNF;1"], files=[b"nothing"])
    assert kind(whole) is kind(whole[: 17 * 2048]) is kind(b"") is kind(iso([b"OTHER"])) is None


def test_damaged_containers_fail_alone(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"PK\3\4 but no more")
    (tmp_path / "b.cso").write_bytes(b"CISO" + b"\xff" * 30)
    (tmp_path / "c.chd").write_bytes(b"MComprHD")
    (tmp_path / "d.txt").write_bytes(b"")
    every = paths(spark, tmp_path, "a.zip", "b.cso", "c.chd", "d.txt")
    for scan in (containers.container_blocks, containers.container_members, containers.chd_info):
        assert scan(every).count() == 0
        assert scan(every, errors=True).where("error is not null").count() == 4


def test_folders_are_split_below_the_top(tmp_path):
    for k in range(20):
        for j in range(20):
            (tmp_path / f"one/{k}/{j}/deep").mkdir(parents=True)
            (tmp_path / f"one/{k}/{j}/deep/f.iso").write_bytes(b"x")
    (tmp_path / "top.iso").write_bytes(b"x")
    for most in (1, 2, 4, 5, 9):
        reader = files._TreeReader(str(tmp_path), {"iso"}, most)
        parts = reader.partitions()
        found = [row[0] for p in parts for row in reader.read(p)]
        assert len(found) == len(set(found)) == (1 if most < 5 else 401)
    assert len(parts) > 256
