import hashlib
import random
import re

import math

from ledgerlake.llm.pii_bootstrap import KINDS, accepted, find_base, find_candidates, find_pii, patterns

ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3}


def plain(text):
    """The contract read literally: leftmost matches, then the failing ones dropped."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return found


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def test_base_spans_of_random_texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", "_", "%", "+", " ", "1", "25", "255", "256", "4111111111111111", "(", ")", "é", "555-1234", "00", "\n", "x"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(18)))
        assert find_base(text) == plain(text), repr(text)


def test_long_runs_are_linear():
    for text in ("a" * 400_000 + "@", "9" * 400_000, "1." * 200_000, "+1 " * 100_000, "@" * 400_000, "a@b." * 100_000):
        base = find_base(text)
        patterns(text, [(a, b) for _, a, b in base] + find_candidates(text, base))


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = find_pii(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in ORDER)
        assert {x for x in line(want).split(",") if x} <= set(r.spans.split(","))


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please dial our desk {'+1 (212) 555-01'}{i:02d} now") for i in range(10, 15)]
    rows += [(20, "please dial our desk 0664/1234567 now"), (21, "the part 77-1234-99 fits"), (22, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_added, r.spans) for r in find_pii(df).collect()}
    assert got[20] == (1, "phone:21:33")
    assert got[21] == got[22] == (0, "")
    assert got[10] == (0, "phone:21:38")


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a@b.co", 2), (None, "a@b.co", 2), (3, "", 4)], "doc_id long, text string, row int")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in find_pii(df).collect())
    assert got == [(0, 1, "email:0:6"), (0, 1, "email:0:6"), (1, 0, ""), (3, 0, "")]
    assert find_pii(df.limit(0)).count() == 0


def plain_accepted(places, support=3, confidence=0.6, score=0.6):
    """The graph scored by loops over dictionaries: {inst: kind}."""
    insts = {}
    for _, inst, pats in places:
        for p in pats:
            insts.setdefault(p, set()).add(inst)
    fixed = {(inst, kind): 1.0 for kind, inst, _ in places if kind}
    seeds = {inst for inst, _ in fixed}
    known = dict(fixed)
    while True:
        strong = {}
        for p, members in insts.items():
            if len(members) > support:
                for kind in KINDS:
                    held = [known[i, kind] for i in members if (i, kind) in known]
                    if len(held) >= support and sum(held) / (len(members) + 1) >= confidence:
                        strong.setdefault(kind, {})[p] = sum(held) / (len(members) + 1)
        new = dict(known)
        for kind, c in strong.items():
            for i in {i for p in c for i in insts[p]} - seeds:
                s = 1 - math.exp(sum(math.log1p(-c[p]) for p in c if i in insts[p]))
                if s >= score:
                    new[i, kind] = max(s, new.get((i, kind), 0.0))
        if new.keys() == known.keys():
            break
        known = new
    out = {}
    for (i, kind), s in known.items():
        if i not in seeds:
            out[i] = max(out.get(i, (0,)), (s, -KINDS.index(kind)))
    return {i: KINDS[-k] for i, (_, k) in out.items()}


def test_accepted_matches_brute_force_on_random_graphs(spark):
    rng = random.Random(9)
    found = 0
    for _ in range(3):
        places = []
        for inst in range(120):
            kind = rng.choice([*KINDS[:2], None, None]) if rng.random() < 0.7 else None
            for _ in range(rng.randrange(1, 4)):
                group = rng.randrange(12) if kind is None or rng.random() < 0.2 else KINDS.index(kind) * 6 + rng.randrange(6)
                places.append((kind, inst, [group, 100 + rng.randrange(15)]))
        # a chain in which twelve instances of each step make four pairs of patterns confident, each for three of the next
        for step in range(6):
            for pair in range(4):
                pats = [500 + 10 * step + 2 * pair, 501 + 10 * step + 2 * pair]
                places += [("ip" if step == 0 else None, 1000 + 20 * step + k, pats) for k in range(12)]
                places += [(None, 1020 + 20 * step + 3 * pair + k, pats) for k in range(3)]
        rows = [(k, [(kind, 0, 1, inst, pats)]) for k, (kind, inst, pats) in enumerate(places)]
        df = spark.createDataFrame(rows, "row long, places array<struct<kind:string,start:long,end:long,inst:long,pats:array<long>>>")
        want = plain_accepted(places)
        assert {r.inst: r.kind for r in accepted(df).collect()} == want
        found += len(want)
    assert found >= 3 * 72


def test_planted_identifiers_are_discovered(spark):
    """Identifiers no fixed pattern covers, in contexts that seeds have too, against the same forms elsewhere."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    ways = {"email": "write to our box {} today", "phone": "please dial the line {} soon", "ip": "blocked by host {} again", "card": "paid with the card {} once"}
    seed = {"email": lambda: f"{word()}@{word()}.org", "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "ip": lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.7", "card": lambda: "4111 1111 1111 1111"}

    def card():
        n = f"4{rng.randrange(10**14):014d}"
        return next(n + c for c in "0123456789" if sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate((n + c)[::-1])) % 10 == 0)

    seed["card"] = card
    odd = {"email": lambda: f"{word()}@{word()}", "phone": lambda: f"0{rng.randrange(600, 699)}/{rng.randrange(10**6, 10**7)}", "ip": lambda: f"fe80:{rng.randrange(1000, 9999)}:{rng.randrange(1000, 9999)}", "card": lambda: f"{rng.randrange(10**3, 10**4)} {rng.randrange(10**3, 10**4)} {rng.randrange(10**3, 10**4)}"}
    rows, planted = [], {}
    for kind in ways:
        for _ in range(60):
            rows.append(f"{word()} {word()} {ways[kind].format(seed[kind]())} {word()}")
        for _ in range(20):
            what = odd[kind]()
            text = f"{word()} {ways[kind].format(what)} {word()}"
            planted[len(rows)] = {f"{kind}:{text.index(what)}:{text.index(what) + len(what)}"}
            rows.append(text)
    for _ in range(300):
        rows.append(f"{word()} {word()} {odd[rng.choice(sorted(odd))]()} {word()} {word()}")
    got = find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    right = sum(len(planted.get(r.doc_id, set()) & set(r.spans.split(","))) for r in got)
    added = sum(r.n_added for r in got)
    assert right >= 0.9 * 80 and right >= 0.9 * added


def test_long_words_and_groups_are_whole():
    long = "x" * 5000
    a, b = (patterns(f"{w} to a@b.co now", [(len(w) + 4, len(w) + 10)])[0] for w in (long + "1", long + "y"))
    assert a[0] != b[0] and a[1] == b[1]
    text = "call 555 123 4567 or (212) 555-0199, in 12 days"
    assert [text[a:b] for a, b in find_candidates(text, [])] == ["555 123 4567", "212) 555-0199"]
