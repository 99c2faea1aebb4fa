"""SentencePiece encoding and decoding with exact N-best segmentations.

A text is normalised as the model says (a space before it, spaces as U+2581) and cut before each run of
U+2581; no piece of the vocabulary crosses such a cut, so the best segmentations of a text are combinations
of the best segmentations of its cuts. Within a cut all vocabulary pieces form a lattice. A forward Viterbi
pass gives the best score of every prefix. A backward A-star search from the end uses those scores as its
heuristic; being exact, it takes each step along a best completion and only sets aside the next best arc
at each place. Arcs are read off the vocabulary where the search comes by, and of what is set aside only as much
is held as can still be among the N best, so a cut of any length needs a number for each character.

Every cut needs its best segmentation and how far the next one lies behind; these the forward pass gives alone,
for many words at once. The backward search runs for the cuts that can change within a text's N best.

A segmentation's score is the sum of its pieces' scores. A unigram model's scores are taken as they are. The scores
of a BPE model are ranks of merges, not logarithms: there a piece of rank r scores -log(r + 2.7) - 10, which is
Zipf's law with a cost for each piece. About five of six word occurrences are then segmented as by the library
(three of five with the ranks themselves); in the others merging by rank does not give the best path. A character that has no piece of
its own falls back to one piece for each UTF-8 byte, each scored a little below the least piece.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, enter, free_name

DEFAULT_MODEL = "piece_bpe_32k.model"
N_BEST = 4
SPACE = "▁"
#: Words, characters and pieces that a worker's memory of segmented words may hold before it is emptied.
REMEMBERED_WORDS, REMEMBERED_SIZE = 900_000, 16_000_000
#: How far below the least one-character piece a byte piece scores.
BYTE_PENALTY = 10.0
#: Shift of Zipf's law and cost of a piece, where scores are ranks; scores are multiples of 1 / GRAIN, so sums are exact.
ZIPF, PIECE_COST, GRAIN = 2.7, 10.0, 1 << 20
#: Characters from which a cut's arcs are not held and its segmentations are kept for the document.
LONG = 1024
#: New words of up to TOGETHER characters are segmented in blocks of BLOCK characters, at least FEW words of one length;
#: texts are looked through for them up to AHEAD characters at once.
TOGETHER, BLOCK, FEW, AHEAD = 48, 1 << 19, 24, 1 << 21
#: Codes of the characters of such words, 0 and those of ASCII included.
CODES = 256
_NONE = float("-inf")
_CUT = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceLattice:
    def __init__(self, path: str, n_best: int = N_BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        self._bytes: list[int] = [0] * 256
        self.content: list[bytes] = []
        found: dict[str, tuple[int, float]] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self._bytes[value] = k
                self.content.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.content.append(b"")
            else:
                found[piece] = (k, model.get_score(k))
                self.content.append(piece.replace(SPACE, " ").encode())
        if all(score == round(score) <= 0 for _, score in found.values()):
            found = {p: (k, -math.log(ZIPF - score) - PIECE_COST) for p, (k, score) in found.items()}
        found = {p: (k, round(score * GRAIN) / GRAIN) for p, (k, score) in found.items()}
        crossing = [p for p in found if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing:
            raise ValueError(f"pieces cross word boundaries: {crossing[:3]}")
        self._byte_score = min(s for p, (_, s) in found.items() if len(p) == 1) - BYTE_PENALTY
        #: Pieces by their characters, from the front and from the back: nested tables from a character to
        #: [the table below it or None, the score and the id of the piece that ends there or None].
        self._trie, self._back = {}, {}
        for piece, (k, score) in found.items():
            for table, order in ((self._trie, piece), (self._back, piece[::-1])):
                for c in order[:-1]:
                    entry = table.setdefault(c, [None, None, None])
                    if entry[0] is None:
                        entry[0] = {}
                    table = entry[0]
                table.setdefault(order[-1], [None, None, None])[1:] = score, k
        self._dense = self._table_of(found)
        self._forget()

    def _table_of(self, found: dict) -> tuple | None:
        """The pieces of the commonest characters as arrays: the code of a character below U+10000 (0: none), the node
        after a node and a code (0: none), and by node the score and id of the piece that ends there.

        ASCII characters without a piece count as their byte; others have codes only with a piece. None where
        U+2581 has no piece."""
        if SPACE not in found:
            return None
        use = Counter(c for piece in found for c in piece if c in found and c < "\U00010000")
        codes = {c: k for k, (c, _) in enumerate(sorted(use.items(), key=lambda x: (x[0] != SPACE, -x[1], x[0]))[: CODES - 129], 1)}
        single = {chr(c): (self._bytes[c], self._byte_score) for c in range(128) if chr(c) not in found}
        for c in range(128):
            codes.setdefault(chr(c), len(codes) + 1)
        code_of = np.zeros(1 << 16, np.uint8)
        for c, k in codes.items():
            code_of[ord(c)] = k
        after, score, ids = [array("i", bytes(4 * CODES))], [_NONE], [0]
        for piece, (k, value) in (single | found).items():
            if not all(c in codes for c in piece):
                continue
            node = 0
            for c in piece:
                if not after[node][codes[c]]:
                    after[node][codes[c]] = len(after)
                    after.append(array("i", bytes(4 * CODES)))
                    score.append(_NONE)
                    ids.append(0)
                node = after[node][codes[c]]
            score[node], ids[node] = value, k
        return code_of, np.frombuffer(b"".join(after), np.int32).reshape(-1, CODES), np.array(score), np.array(ids, np.int32)

    def _forget(self) -> None:
        """An empty memory: a number for each word; by number its score and its gap to the second best; and
        the pieces of all words in a row, with the places where each word's begin."""
        self._number: dict[str, int] = {}
        self._scores, self._gaps, self._pieces, self._starts, self._size = array("d"), array("d"), array("i"), array("q", [0]), 0

    def _prefixes(self, cut: str) -> list | array:
        """The best score of each prefix."""
        n, trie = len(cut), self._trie
        best = [_NONE] * (n + 1) if n < LONG else array("d", [_NONE]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            so_far, j, entry = best[i], i + 1, trie.get(cut[i])
            if entry is None or entry[1] is None:
                best[j] = max(best[j], so_far + self._fallback(cut, i)[0])
            while entry is not None:
                table, score, _ = entry
                if score is not None and so_far + score > best[j]:
                    best[j] = so_far + score
                if table is None or j == n:
                    break
                entry = table.get(cut[j])
                j += 1
        return best

    def _fallback(self, cut: str, i: int) -> tuple[float, tuple]:
        """The score and the byte pieces of a character that has no piece of its own."""
        data = cut[i].encode("utf-8", "replace")
        return self._byte_score * len(data), tuple(self._bytes[b] for b in data)

    def _into(self, cut: str, best: list | array, place: int) -> list[tuple]:
        """Arcs into a place, best first: (minus the best score through it so far, start, ids, score)."""
        table, out, i = self._back, [], place
        while i and table is not None and (entry := table.get(cut[i - 1])) is not None:
            i -= 1
            table, score, k = entry
            if score is not None:
                out.append((-best[i] - score, i, k, score))
        if not out or out[0][1] != place - 1:
            score, ids = self._fallback(cut, place - 1)
            out.append((-best[place - 1] - score, place - 1, ids, score))
        if len(out) > 1:
            out.sort()
        return out

    def nbest(self, cut: str, n_best: int | None = None) -> list[tuple[float, list[int]]]:
        """The n_best segmentations of one cut by falling score; equal scores come in a fixed order."""
        wanted, best = n_best or self.n_best, self._prefixes(cut)
        held: dict[int, list] = {}  # arcs into the places of a short cut that the search has come by
        heap, ticket, out = [(-best[-1], 0, len(cut), 0, 0.0, None)], count(1), []
        while heap and len(out) < wanted:
            _, _, place, k, done, tail = heapq.heappop(heap)
            while place:
                into = held.get(place)
                if into is None:
                    into = self._into(cut, best, place)
                    if len(cut) < LONG:
                        held[place] = into
                if k + 1 < len(into):
                    heapq.heappush(heap, (into[k + 1][0] - done, next(ticket), place, k + 1, done, tail))
                    if len(heap) > 256:
                        heap = heapq.nsmallest(wanted - len(out), heap)
                _, place, ids, score = into[k]
                done, tail, k = done + score, (ids, tail), 0
            path = []
            while tail:
                path.extend(tail[0]) if isinstance(tail[0], tuple) else path.append(tail[0])
                tail = tail[1]
            out.append((done, path))
        return out

    def _best(self, cut: str) -> tuple[float, list[int], float]:
        """The best segmentation of a short cut, and the score of the next.

        This is the search's first path with the least arc that it sets aside, read off one forward pass that notes
        the best arc into each place, of equals the longest, and the score through the second best."""
        n, trie = len(cut), self._trie
        best, second, start, ids = [_NONE] * (n + 1), [_NONE] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            so_far, j, entry = best[i], i + 1, trie.get(cut[i])
            if entry is None or entry[1] is None:
                score, k = self._fallback(cut, i)
                through = so_far + score
                if through > best[j]:
                    best[j], second[j], start[j], ids[j] = through, best[j], i, k
                elif through > second[j]:
                    second[j] = through
            while entry is not None:
                table, score, k = entry
                if score is not None:
                    through = so_far + score
                    if through > best[j]:
                        best[j], second[j], start[j], ids[j] = through, best[j], i, k
                    elif through > second[j]:
                        second[j] = through
                if table is None or j == n:
                    break
                entry = table.get(cut[j])
                j += 1
        place, gap, path = n, -_NONE, []
        while place:
            if best[place] - second[place] < gap:
                gap = best[place] - second[place]
            k = ids[place]
            path.extend(k[::-1]) if isinstance(k, tuple) else path.append(k)
            place = start[place]
        path.reverse()
        return best[n], path, best[n] - gap

    def _word(self, key: str, ways: dict) -> int:
        """The number of the cut made of U+2581 and key, which is segmented and remembered; ways keeps all of a long one."""
        if len(key) < LONG:
            score, path, after = self._best(SPACE + key)
        else:
            found = ways[key] = self.nbest(SPACE + key)
            (score, path), after = found[0], found[1][0] if len(found) > 1 else _NONE
        n = self._number[key] = len(self._scores)
        self._scores.append(score)
        self._gaps.append(score - after)
        self._pieces.extend(path)
        self._starts.append(len(self._pieces))
        self._size += len(key)
        return n

    def learn(self, texts: list[str]) -> None:
        """Segments and remembers the new short words of some texts, those of one length together; words of rare
        characters are segmented where `encode` meets them. Results are the same."""
        words = {k for t in texts for k in self.cuts(t)}
        new = words - self._number.keys()
        if len(self._scores) + len(new) > REMEMBERED_WORDS or self._size + sum(map(len, new)) > REMEMBERED_SIZE:
            self._forget()
            new = words
        by_length: dict[int, list[str]] = {}
        for key in new:
            if 0 < len(key) <= TOGETHER:
                by_length.setdefault(len(key), []).append(key)
        for size, keys in by_length.items():
            step = BLOCK // (size + 1)
            for k in range(0, len(keys) if self._dense and len(keys) >= FEW else 0, step):
                self._together(keys[k : k + step], size + 1)

    def _together(self, keys: list[str], n: int) -> None:
        """As `_best` for many words whose cuts have n characters, place by place. Words of rare characters are left out."""
        code_of, after, score_of, id_of = self._dense
        points = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(keys), n - 1)
        known = (points < len(code_of)).all(1)
        inner = code_of[np.where(known[:, None], points, 0)]
        known &= inner.all(1)
        if not known.any():
            return
        keys, many = [k for k, good in zip(keys, known.tolist()) if good], int(known.sum())
        codes = np.empty((n, many), np.uint8)
        codes[0], codes[1:] = code_of[ord(SPACE)], inner[known].T
        best, second = np.full((n + 1, many), _NONE), np.full((n + 1, many), _NONE)
        start, ids = np.zeros((n + 1, many), np.int32), np.zeros((n + 1, many), np.int32)
        best[0] = 0.0
        for i in range(n):
            rows, node = np.arange(many), after[0, codes[i]]
            for j in range(i + 1, n + 1):
                through, top = best[i, rows] + score_of[node], best[j, rows]
                up = through > top
                second[j, rows] = np.where(up, top, np.maximum(second[j, rows], through))
                better = rows[up]
                best[j, better], start[j, better], ids[j, better] = through[up], i, id_of[node[up]]
                if j < n:
                    node = after[node, codes[j, rows]]
                    live = node > 0
                    rows, node = rows[live], node[live]
                    if not len(rows):
                        break
        place, gap, sizes, back = np.full(many, n), np.full(many, -_NONE), np.zeros(many, np.int64), []
        rows = np.arange(many)
        while len(rows):
            at = place[rows]
            gap[rows] = np.minimum(gap[rows], best[at, rows] - second[at, rows])
            back.append((rows, ids[at, rows]))
            sizes[rows] += 1
            place[rows] = start[at, rows]
            rows = rows[place[rows] > 0]
        ends = np.cumsum(sizes)
        pieces = np.empty(ends[-1], np.int32)
        for k, (rows, found) in enumerate(back):
            pieces[ends[rows] - 1 - k] = found
        self._number.update(zip(keys, range(len(self._scores), len(self._scores) + many)))
        self._starts.frombytes((ends + len(self._pieces)).tobytes())
        self._scores.frombytes(best[n].tobytes())
        self._gaps.frombytes(gap.tobytes())
        self._pieces.frombytes(pieces.tobytes())
        self._size += many * (n - 1)

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The cuts of a text, each without its first U+2581."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in _CUT.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> tuple[np.ndarray, list[float], list[str]]:
        """(ids of the best segmentation, the N best scores, what differs in each).

        A difference lists cut:ids for the cuts that are not segmented as in the best; the best has none.
        """
        keys = self.cuts(text)
        if not keys:
            return np.zeros(0, np.int32), [], []
        if len(self._scores) > REMEMBERED_WORDS or max(self._size, len(self._pieces)) > REMEMBERED_SIZE:
            self._forget()
        number, kept = self._number, {}
        try:
            words = np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
        except KeyError:
            get = number.get
            words = np.array([n if (n := get(k)) is not None else self._word(k, kept) for k in keys], np.int64)
        top = float(np.frombuffer(self._scores)[words].sum())
        # only the cuts with the smallest gaps to their second best can change within the N best
        gaps, options = np.frombuffer(self._gaps)[words], []
        for _ in range(self.n_best - 1):
            k = int(gaps.argmin())
            if gaps[k] == -_NONE:
                break
            gaps[k] = -_NONE
            ways = kept.get(keys[k]) or self.nbest(SPACE + keys[k])
            options.append(([ways[0][0] - x for x, _ in ways[1:]], k, ways))
        heap, seen, scores, changes = [(0.0, (0,) * len(options))], set(), [], []
        while heap and len(scores) < self.n_best:
            gap, choice = heapq.heappop(heap)
            scores.append(top - gap)
            changes.append(choice)
            for d, (behind, _, _) in enumerate(options):
                c = choice[d]
                if c < len(behind):
                    longer = (*choice[:d], c + 1, *choice[d + 1 :])
                    if longer not in seen:
                        seen.add(longer)
                        heapq.heappush(heap, (gap + behind[c] - (behind[c - 1] if c else 0.0), longer))
        texts = []
        for choice in changes:
            parts = sorted((k, ways[c][1]) for c, (_, k, ways) in zip(choice, options) if c)
            texts.append(";".join(f"{k}:" + " ".join(map(str, ids)) for k, ids in parts))
        starts = np.frombuffer(self._starts, np.int64)
        first, sizes = starts[words], starts[words + 1] - starts[words]
        ids = np.frombuffer(self._pieces, np.int32)[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        return ids, scores, texts

    def decode(self, ids) -> str:
        """The text of piece ids: bytes joined, the leading space taken off. Bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.content.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def lattice(path: str, n_best: int) -> PieceLattice:
    return PieceLattice(path, n_best)


_ADDED = (
    ("ids", T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())), ("n_pieces", T.LongType(), pa.int64()),
    ("nbest_scores", T.ArrayType(T.DoubleType()), pa.list_(pa.float64())), ("nbest_changes", T.ArrayType(T.StringType()), pa.list_(pa.string())),
    ("round_trip", T.BooleanType(), pa.bool_()),
)


def _ahead(column: pa.Array, pieces: PieceLattice):
    """The texts of a column in order; the words of some of them are learnt before the first of these is given."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py())
        size += len(held[-1])
        if size >= AHEAD:
            pieces.learn(held)
            yield from held
            held, size = [], 0
    pieces.learn(held)
    yield from held


def encode_documents(docs: DataFrame, model: str | None = None, n_best: int = N_BEST, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with ids, n_pieces, nbest_scores, nbest_changes and round_trip, row by row.

    model is the path of a .model file on every worker (None: the public 32k file). nbest_scores falls
    and is as long as there are segmentations, n_best at most. round_trip: decoding gives the text back
    (with U+2581 read as a space). Null text counts as empty: no pieces, no scores. Repeated rows, null
    ids and very long texts are rows like any other. Added columns whose names are in `keep` get underscores.
    An empty table gives an empty result.
    """
    added = [free_name(list(keep), n) for n, _, _ in _ADDED]

    def run(batches):
        import public_tokenizers

        enter("sentencepiece", lattice.cache_clear)
        pieces = lattice(model or public_tokenizers.path(DEFAULT_MODEL), n_best)
        for batch in batches:
            found, scores, changes, sound = [], [], [], []
            for s in _ahead(batch.column(len(keep)), pieces):
                ids, best, differ = pieces.encode(s)
                found.append(ids)
                scores.append(best)
                changes.append(differ)
                sound.append(pieces.decode(ids.tolist()) == s.replace(SPACE, " "))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            cols = [ids, pa.array(sizes), *(pa.array(x, t) for x, (_, _, t) in zip((scores, changes, sound), _ADDED[2:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *added])

    got = docs.select(*keep, as_text(text).alias(free_name(list(keep), "__text")))
    return got.mapInArrow(run, T.StructType([*got.schema.fields[: len(keep)], *(T.StructField(n, t) for n, (_, t, _) in zip(added, _ADDED))]))


def decode_documents(encoded: DataFrame, model: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with the text of `ids`, row by row; null ids decode to the empty text. The text's column is
    called text, with underscores where `keep` has one of that name. An empty table gives an empty result."""
    out, held = free_name(list(keep), "text"), free_name(list(keep), "__ids")

    def run(batches):
        import public_tokenizers

        enter("sentencepiece", lattice.cache_clear)
        pieces = lattice(model or public_tokenizers.path(DEFAULT_MODEL), N_BEST)
        for batch in batches:
            texts = [pieces.decode(x.as_py() or []) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, out])

    got = encoded.select(*keep, F.col(ids).alias(held))
    return got.mapInArrow(run, T.StructType([*got.schema.fields[: len(keep)], T.StructField(out, T.StringType())]))
