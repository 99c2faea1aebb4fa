import math
import random
import time
import tracemalloc

import public_tokenizers
import sentencepiece

from ledgerlake.llm.sentencepiece_nbest import DEFAULT_MODEL, SPACE, PieceLattice, decode_documents, encode_documents

PATH = public_tokenizers.path(DEFAULT_MODEL)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = {MODEL.id_to_piece(k): (k, round((-math.log(2.7 - MODEL.get_score(k)) - 10) * 2**20) / 2**20) for k in range(MODEL.get_piece_size()) if not (MODEL.is_byte(k) or MODEL.is_control(k) or MODEL.is_unknown(k))}
BYTE = min(s for p, (_, s) in PIECES.items() if len(p) == 1) - 10.0
LATTICE = PieceLattice(PATH)


def all_segmentations(text):
    """Every way to cut a normalised text into pieces: (score, ids)."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, min(16, len(text)) + 1):
        if text[:k] in PIECES:
            i, s = PIECES[text[:k]]
            out += [(s + x, (i, *y)) for x, y in all_segmentations(text[k:])]
    if text[0] not in PIECES:
        data = text[0].encode()
        ids = tuple(MODEL.piece_to_id(f"<0x{b:02X}>") for b in data)
        out += [(BYTE * len(data) + x, (*ids, *y)) for x, y in all_segmentations(text[1:])]
    return out


def applied(keys, ids_of, change):
    swaps = dict((int(p.split(":")[0]), list(map(int, p.split(":")[1].split()))) for p in change.split(";") if p)
    return [i for k, key in enumerate(keys) for i in (swaps[k] if k in swaps else ids_of(key))]


def check(text):
    ids, scores, changes = LATTICE.encode(text)
    ids = ids.tolist()
    assert LATTICE.decode(ids) == text.replace(SPACE, " ")
    if not text:
        assert (ids, scores) == ([], [])
        return
    norm = SPACE + text.replace(" ", SPACE)
    ways = all_segmentations(norm)
    assert scores == sorted((s for s, _ in ways), reverse=True)[:4]
    keys = LATTICE.cuts(text)
    seen = set()
    for score, change in zip(scores, changes):
        path = applied(keys, lambda k: LATTICE.nbest(SPACE + k)[0][1], change)
        assert (score, tuple(path)) in ways
        seen.add(tuple(path))
    assert len(seen) == len(scores)
    assert changes[0] == "" and tuple(ids) in seen


def test_nbest_matches_every_segmentation():
    for text in ("", "a", " ", "  ", "the", "hello w", " x ", "a  b", "☃ é", "über 1", "\n\t", "▁x", "aaaaaa", "日本"):
        check(text)
    rng = random.Random(6)
    for _ in range(150):
        check("".join(rng.choice("theran  éß☃1\n") for _ in range(rng.randrange(9))))


def test_long_cuts_are_linear():
    for text in ("a" * 30_000, "☃the" * 5_000, " " * 5_000, "ab1-" * 5_000):
        ids, scores, _ = LATTICE.encode(text)
        assert LATTICE.decode(ids.tolist()) == text and len(scores) == 4


def test_one_very_long_cut_needs_little_memory():
    rng = random.Random(5)
    for text in ("".join(rng.choice("ABCDEFGHabcdefgh0123+/") for _ in range(100_000)), "日本語の文" * 20_000, "ab" * 50_000):
        tracemalloc.start()
        began = time.perf_counter()
        ids, scores, _ = LATTICE.encode(text)
        peak, took = tracemalloc.get_traced_memory()[1], time.perf_counter() - began
        tracemalloc.stop()
        assert LATTICE.decode(ids.tolist()) == text and len(scores) in (1, 4)
        assert peak < 300 * len(text) and took < 120


def test_long_cuts_agree_with_short_ones():
    rng = random.Random(3)
    for _ in range(20):
        cut = SPACE + "".join(rng.choice("theran1é☃") for _ in range(rng.randrange(1100, 1300)))
        whole, scores = LATTICE.nbest(cut), []
        for part in (cut,):
            arcs = [[] for _ in range(len(part) + 1)]  # the four best scores of every prefix
            arcs[0] = [0.0]
            for j in range(1, len(part) + 1):
                into = []
                for i in range(max(0, j - 16), j):
                    if part[i:j] in PIECES:
                        into += [x + PIECES[part[i:j]][1] for x in arcs[i]]
                if part[j - 1] not in PIECES:
                    into += [x + BYTE * len(part[j - 1].encode()) for x in arcs[j - 1]]
                arcs[j] = sorted(into, reverse=True)[:4]
            scores = arcs[-1]
        assert [s for s, _ in whole] == scores


def test_words_are_mostly_segmented_as_by_the_library(spark, sf_dir):
    words = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for w in r.text.split()]
    same = sum(LATTICE.nbest(SPACE + w, 1)[0][1] == MODEL.encode(w) for w in words)
    assert same > 0.82 * len(words)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", [5]), (2, None, None)], "doc_id long, text string, ids array<int>")
    enc = encode_documents(df, keep=("doc_id", "text", "ids"))
    assert enc.columns[:4] == ["doc_id", "text", "ids", "ids_"]
    back = decode_documents(enc, ids="ids_", keep=("doc_id", "text"))
    assert back.columns == ["doc_id", "text", "text_"] and {r.doc_id: r.text_ for r in back.collect()} == {1: "a b", 2: ""}


def test_decoding_agrees_with_the_library():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("the and  éß☃1\nxyz,.") for _ in range(rng.randrange(1, 40)))
        assert LATTICE.decode(MODEL.encode(text)) == text == MODEL.decode(MODEL.encode(text))


def test_documents_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    enc = encode_documents(docs)
    assert enc.where("not round_trip").count() == 0
    back = decode_documents(enc).join(docs.selectExpr("doc_id", "text as own"), "doc_id")
    assert back.count() == docs.count() and back.where("text <> own").count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "x y", 2), (None, "x y", 2), (2, "", 3), (3, "w " * 60_000, 4)], "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_pieces, len(r.nbest_scores), r.round_trip) for r in encode_documents(df).collect()}
    assert {x for x in got if x[0] in (1, 2)} == {(1, 0, 0, True), (2, 0, 0, True)}
    assert all(x[3] for x in got) and len(got) == 4
    assert encode_documents(df.limit(0)).count() == 0


def test_words_learnt_together_equal_the_search():
    chance, learnt = random.Random(5), PieceLattice(PATH)
    words = ["".join(chance.choice("abeinrst.,é漢😀\x00\x7f▁ü") for _ in range(chance.randrange(1, 12))) for _ in range(4000)] + ["the", "a" * 48, "b" * 49, "퟿"] * 2
    learnt.learn([" ".join(words), "", " "])
    assert len(learnt._number) > 1000
    for key in PieceLattice.cuts(" ".join(words)):
        n = learnt._number.get(key)
        if n is not None:
            found = learnt.nbest(SPACE + key, 2)
            assert (learnt._scores[n], list(learnt._pieces[learnt._starts[n] : learnt._starts[n + 1]])) == found[0]
            assert learnt._gaps[n] == (found[0][0] - found[1][0] if len(found) > 1 else math.inf)
