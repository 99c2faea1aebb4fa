import random
import re

import xxhash

from ledgerlake.llm.simhash_golay import fingerprint, fingerprint_links, golay_keys, keep_one_of_each, op1_rows

import numpy as np


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: root(k) for k in keys}


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    of = components(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return sorted(((i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints)), key=str)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 23, 3000)
    y = x ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    for a, b in zip(golay_keys(x), golay_keys(y)):
        assert set(a) & set(b)
        assert len(set(a)) in (1, 6)


def test_links_connect_all_near_fingerprints(spark):
    rng = random.Random(3)
    seen = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        cloud = {base}
        for _ in range(60):
            cloud.add(rng.choice(sorted(cloud)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        seen |= cloud
    seen |= {rng.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in seen]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components(set(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    for paired in (2, 8, 24):
        links = [(r.a, r.b) for r in fingerprint_links(df, paired).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
        got = components(set(signed), lambda a, b, have={frozenset(x) for x in links}: frozenset((a, b)) in have)
        assert got == want


def test_documents_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op1_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (7, " \t\n"), (5, "One two"), (5, "one TWO"), (None, "one two"), (None, "x y z w"), (9, "é" * 200_000), (8, "a b c d " * 40_000)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, fp int")
    assert sorted((tuple(r) for r in op1_rows(df).collect()), key=str) == expected(rows)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in kept.collect() if r.doc_id is not None) == [(1, ""), (5, kept.where("doc_id = 5").first().text[:3]), (8, "a b"), (9, "ééé")]
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["x y z w"]
    empty = df.limit(0)
    assert op1_rows(empty).count() == 0 and keep_one_of_each(empty).count() == 0


def test_fingerprint_of_fixed_texts():
    for text in ("", "a", "A b", "Ab  c d\te\x0bf", "é É x " * 50):
        assert fingerprint(text) == plain_fingerprint(text)


def test_every_group_keeps_one_where_ids_repeat_across_groups(spark):
    rows = [(5, "alpha beta gamma delta"), (5, "quite another text here"), (3, "quite another text here"), (5, "third one of its own"), (7, "third one of its own"), (5, "alpha beta gamma delta")]
    for n in range(3):
        df = spark.createDataFrame(rows[n:] + rows[:n], "doc_id long, text string").repartition(3)
        for similar in (False, True):
            assert sorted((r.doc_id, r.text) for r in keep_one_of_each(df, similar=similar).collect()) == [(3, rows[1][1]), (5, rows[0][1]), (5, rows[3][1])]
