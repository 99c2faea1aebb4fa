import io
import wave

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm.chroma_print import Block, Printer, align, filters, fingerprints, op10_rows, samples

PRINTER = Printer()


def tune(seed, seconds, rate=8000):
    """Random pairs of short notes, with a little noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(rate // 32) / rate
    notes = [np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 36) / 12) * t) + 0.6 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 36) / 12) * t) for _ in range(int(seconds * 32))]
    return (np.concatenate(notes) * 0.4 + rng.normal(0, 0.01, len(t) * len(notes))).astype(np.float32)


def pcm(x):
    return bytes(np.clip(np.rint((x + 1) * 128), 0, 255).astype(np.uint8))


def test_filters_differ():
    assert len(set(filters())) == 16


def test_windows_match_sums_without_the_integral_image():
    x = tune(1, 1)
    frames = np.array([x[k : k + 128] for k in range(0, len(x) - 127, 32)])
    image = PRINTER.chroma(frames).astype(float)
    got = PRINTER.windows(PRINTER.chroma(frames))
    for at in (0, 7, len(got) - 1):
        bits = 0
        for kind, c, h, w in filters():
            s, half = at + (16 - w) // 2, h // 2

            def box(t, n, c, h):
                return sum(image[t + a, (c + b) % 12] for a in range(n) for b in range(h))

            pairs = {0: (box(s, w, c, half), box(s, w, c + 6, half)), 1: (box(s, w, c, half), box(s, w, c + half, half)), 2: (box(s, w // 2, c, h), box(s + w // 2, w // 2, c, h))}
            pairs[3] = (box(s, w // 2, c, half) + box(s + w // 2, w // 2, c + half, half), box(s, w // 2, c + half, half) + box(s + w // 2, w // 2, c, half))
            a, b = pairs[kind]
            level = sum(np.log((a + 0.05) / (b + 0.05)) > cut for cut in (-0.15, 0, 0.15))
            bits = bits << 2 | (level ^ level >> 1)
        assert int(got[at]) == bits


def test_prints_do_not_depend_on_their_company():
    songs = [tune(k, 1 + k % 3) for k in range(5)] + [np.zeros(0, np.float32), tune(9, 1)[:50]]
    together = PRINTER.prints(songs)
    for x, p in zip(songs, together):
        assert (PRINTER.prints([x])[0] == p).all()
    assert len(together[5]) == 0 and len(together[6]) == 1


def brute(a, b, most=0.15, least=16):
    best = (2, 0)
    for d in range(-(len(b) - least), len(a) - least + 1):
        x, y = max(0, d), min(len(a), len(b) + d)
        best = min(best, (np.bitwise_count((a[x:y] ^ b[x - d : y - d]).view(np.uint32)).sum() / (32 * (y - x)), d))
    return best if best[0] <= most else None


def test_recall_against_every_offset():
    songs = [tune(k, 3) for k in range(12)]
    shifted = [np.concatenate([tune(100 + k, 1)[: 32 * (3 * k + 1)], s])[: len(s)] + np.random.default_rng(k).normal(0, 0.003, len(s)).astype(np.float32) for k, s in enumerate(songs)]
    prints = PRINTER.prints([np.frombuffer(pcm(x), np.uint8) / np.float32(128) - 1 for x in songs + shifted])
    block = Block(list(range(12)), prints[:12])
    want = {(q, r) for q in range(12) for r in range(24) if q != r and brute(prints[q], prints[r])}
    got = {(m["query"], r): m["offset"] for r in range(24) for m in block.aligned(r, prints[r])}
    assert len(want & got.keys()) >= 0.9 * len(want) and len(want) >= 10
    for q in range(12):
        if (q, q + 12) in got:
            assert got[q, q + 12] == -(3 * q + 1)


def test_wave_files_are_read():
    x = tune(3, 1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.repeat(np.rint(x * 20000).astype("<i2"), 2).tobytes())
    got = samples(out.getvalue())
    assert len(got) == len(x) and np.abs(got - x * 20000 / 32768).max() < 1e-3
    assert len(samples(None)) == len(samples(b"")) == 0


def wav(x, bits, rate=8000, code=1):
    import struct

    if code == 3:
        raw = x.astype("<f4" if bits == 32 else "<f8").tobytes()
    elif bits == 8:
        raw = pcm(x)
    else:
        raw = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in np.rint(x.astype(float) * (2 ** (bits - 1) - 1)))
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, code, 1, rate, rate * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(raw)) + raw


def test_depths_and_rates_of_wave_files():
    x = np.clip(tune(3, 1), -0.99, 0.99)
    for bits, code in ((8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3)):
        got = samples(wav(x, bits, code=code))
        assert len(got) == len(x) and np.abs(got - x).max() < 0.01
    twice = np.interp(np.arange(2 * len(x)) / 2, np.arange(len(x)), x)
    got = samples(wav(twice, 16, 16000))
    assert len(got) == len(x) and np.abs(got - x).max() < 0.01


def test_any_bytes_have_a_defined_result(spark):
    good = wav(tune(3, 1), 16)
    odd = [b"RIFF1234WAVE is a format", b"RIFF1234WAVE", good[:30], good[:50], good[:20] + b"\xff" * 30, b"RIFF0000WAVEfmt \xff\xff\xff\xff", good[:40] + b"\xff\xff\xff\xff" + good[44:], None, b"", b"x"]
    for data in odd:
        assert np.isfinite(samples(data)).all()
    assert len(samples(odd[0])) == len(odd[0]) and len(samples(good[:50])) == 3
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(odd)] + [(None, b"x", 1), (3, b"x", 1)], "id long, audio binary, print int")
    got = fingerprints(df, "id", F.col("audio"))
    assert got.count() == 12 and got.where("size(print) = 0").count() == 2
    assert align(got, F.col("rec_id") % 50 == 0).count() == 12
    texts = spark.createDataFrame([(0, "RIFF1234WAVE is a format"), (1, None)], "doc_id long, text string")
    assert op10_rows(texts).count() == 2


def test_align_with_many_blocks(spark):
    a, b = tune(1, 3), tune(2, 3)
    late = np.concatenate([tune(5, 1)[:320], a])
    rows = [(0, pcm(a)), (7, pcm(a)), (3, pcm(b)), (50, pcm(late)), (100, pcm(b)), (None, pcm(b)), (9, None), (11, b"")]
    df = spark.createDataFrame([(i, x, "k") for i, x in rows], "id long, audio binary, digest string")
    prints = fingerprints(df, "id", F.col("audio"))
    for size in (1_000_000, 10):
        got = {r.rec_id: r for r in align(prints, F.col("rec_id") % 50 == 0, size).collect()}
        assert len(got) == 8
        assert got[7].class_id == 0 and got[100].class_id == 3 and got[None].class_id == 3 and got[11].class_id == 9
        assert [(m.query, m.offset) for m in got[0].aligned] == [(50, 10)]
        assert [(m.query, m.offset) for m in got[50].aligned] == [(0, -10)]
        assert got[7].aligned is None and got[3].aligned == []
    assert align(prints.limit(0), F.col("rec_id") % 50 == 0).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in op10_rows(docs).collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    prints = dict(zip(texts, PRINTER.prints([samples(t) for t in texts.values()])))
    least = {}
    for k, p in prints.items():
        least[p.tobytes()] = min(k, least.get(p.tobytes(), k))
    assert {k: r.class_id for k, r in rows.items()} == {k: least[p.tobytes()] for k, p in prints.items()}
    for k, r in rows.items():
        assert (r.aligned is None) == (r.class_id != k)
        if r.aligned:
            assert {m.query for m in r.aligned} <= asked


def test_recall_on_documents(spark, sf_dir):
    """Every document as a query: of the pairs that a search over every offset finds, nine of ten are found."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = fingerprints(docs, "doc_id", F.col("text").cast("binary"))
    prints = {r.rec_id: np.array(r.print, np.int32) for r in got.where("size(print) between 16 and 250").collect()}
    rows = align(got, F.col("rec_id") >= 0).collect()
    reps = {r.class_id for r in rows} & prints.keys()
    asked = sorted({r.class_id for r in rows if r.is_query} & prints.keys())
    found = {(m.query, r.class_id) for r in rows if r.aligned for m in r.aligned if m.query in prints and r.class_id in prints}
    want = set()
    for k in reps:
        for q in asked:
            if q < k:
                a, b = prints[q], prints[k]
                at = np.arange(len(a))[:, None] - np.arange(len(b)) + len(b)
                n = np.bincount(at.ravel())
                differ = np.bincount(at.ravel(), np.bitwise_count((a[:, None] ^ b).view(np.uint32)).ravel())
                if (differ[n >= 16] <= 0.15 * 32 * n[n >= 16]).any():
                    want |= {(q, k), (k, q)}
    assert found <= want and len(want) >= 10 and len(found) >= 0.9 * len(want)


def test_recall_on_near_copies_of_documents(spark, sf_dir):
    """Copies with some words replaced, all bytes after them shifted or not: at least nine of ten alignments
    that a search over every offset finds are found."""
    rng = np.random.default_rng(12)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if 1500 < len(r.text) < 4000][:60]
    copies = []
    for t in texts:
        words = t.split(" ")
        for k in rng.integers(0, len(words), 1 + len(words) // 100):
            words[k] = words[k][::-1]
        copies.append(" ".join(words))
    prints = PRINTER.prints([samples(t.encode()) for t in texts + copies])
    n = len(texts)
    block = Block(list(range(n)), prints[:n])
    want = {(k, n + k) for k in range(n) if brute(prints[k], prints[n + k])}
    got = {(m["query"], n + k) for k in range(n) for m in block.aligned(n + k, prints[n + k])}
    assert len(want) > n / 2 and len(want & got) >= 0.9 * len(want)


def test_short_recordings_align_over_their_whole_length(spark, sf_dir):
    """Copies of texts under 1,088 bytes with a word reversed, against a search over every offset without a floor."""
    rng = np.random.default_rng(6)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text.encode()) < 1088 and len(r.text.split()) > 20][:60]
    copies = []
    for t in texts:
        words = t.split(" ")
        k = rng.integers(0, len(words))
        words[k] = words[k][::-1]
        copies.append(" ".join(words))
    prints = PRINTER.prints([samples(t.encode()) for t in texts + copies])
    n = len(texts)
    block = Block(list(range(n)), prints[:n])
    want = {(k, n + k) for k in range(n) if brute(prints[k], prints[n + k], least=min(len(prints[k]), len(prints[n + k])))}
    got = {(m["query"], n + k) for k in range(n) for m in block.aligned(n + k, prints[n + k])}
    assert len(want) > n / 2 and len(want & got) >= 0.85 * len(want)
    long = tune(3, 2)
    whole, part = PRINTER.prints([long, long[320:1120]])
    assert len(part) < 16 and [(m["offset"], m["overlap"]) for m in Block([1], [whole]).aligned(2, part)] == [(10, len(part))]
