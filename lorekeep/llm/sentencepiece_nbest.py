"""N-best segmentation with the pieces and scores of a SentencePiece model.

The text's piece lattice is searched by forward Viterbi; its scores are exact
heuristics for a backward A* search, which then pops whole segmentations in order of
their scores. No piece crosses into a run of word marks from the left, nor holds a
line feed, so the lattice has a node that every path passes before each word: words
are searched one by one, each distinct one once while it is remembered, and the
text's N best combine those of the words. An alternative for a word is searched only
where the word is among the N-1 whose second best costs least: others can't be part
of the N best.

Spaces become word marks, one is put before the text, and characters without a piece
become byte pieces, a literal word mark too; so decoding gives back every text.

Cases: null and empty texts have no pieces, and one segmentation, the empty one;
repeated rows are texts of their own; of equally good segmentations the best is the
one whose last pieces are shorter, the others follow by their pieces' ids (in words of
more than 64 letters as the search finds them); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .common import batches, body

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segmentations per text.
BEST = 4
#: What a character without a piece scores below the least piece.
UNKNOWN = 10.0
#: Bytes of text that are encoded and sent on at once.
PORTION = 2 << 20
#: Words that a worker remembers; words searched at once.
REMEMBERED, GROUP = 300_000, 100_000
#: Cells of a table of words and piece lengths at once; letters of a word that is searched by itself.
CELLS, LONG = 1 << 20, 64


def unwound(path: tuple | None) -> Iterator[int]:
    """The ids of pieces held as (first one's ids, the others)."""
    while path is not None:
        piece, path = path
        yield from piece


@dataclass
class Pieces:
    """A model's pieces, as the driver reads them and workers share them."""

    names: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: list[bool]
    trie: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        found = cls(names, [model.get_score(i) for i in ids], byte_ids, special)
        crossing = [n for n, s in zip(names, special, strict=True) if not s and (re.search(f"[^{MARK}]{MARK}", n) or "\n" in n)]
        if crossing or not all(special[b] for b in byte_ids):
            raise ValueError(f"pieces that cross words, or no byte pieces: {crossing[:3]}")
        return found

    def __post_init__(self) -> None:
        """Letters to nodes, with the piece's id and score under the empty key."""
        self.trie = {}
        for i, (name, score) in enumerate(zip(self.names, self.scores, strict=True)):
            if not self.special[i]:
                node = self.trie
                for c in name:
                    node = node.setdefault(c, {})
                node[""] = (i, score)
        self.unknown = min(s for s, x in zip(self.scores, self.special, strict=True) if not x and s > -1e8) - UNKNOWN
        self.bytes = [b"" if s else n.replace(MARK, " ").encode() for n, s in zip(self.names, self.special, strict=True)]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place, the pieces that end there: (start, ids, score)."""
        n = len(word)
        ends: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            node, alone = self.trie, False
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                if "" in node:
                    at, score = node[""]
                    ends[j + 1].append((i, (at,), score))
                    alone |= j == i
            if not alone:
                ends[i + 1].append((i, tuple(self.byte_ids[b] for b in word[i].encode()), self.unknown))
        return ends

    def forward(self, ends: list) -> list[float]:
        """The best score of reaching each place."""
        best = [0.0]
        for own in ends[1:]:
            best.append(max(best[i] + s for i, _, s in own))
        return best

    def ranked(self, word: str, most: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of a word by backward A*, with their scores."""
        ends = self.edges(word)
        ahead = self.forward(ends)
        order = count()
        # best total first; of equals, the one whose pieces so far (from the end) have the smaller ids; in long words, with
        # totals equal but for rounding, the one that is nearest to the word's start, lest all equal paths grow at once
        short = len(word) <= LONG
        queue = [(-ahead[-1], (), next(order), len(word), 0.0, None)]
        out: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(out) < most:
            total, ids, _, at, behind, path = heapq.heappop(queue)
            if at == 0:
                out.append((-total, ids) if short else (behind, tuple(unwound(path))))
                continue
            for start, piece, score in ends[at]:
                total = -(ahead[start] + score + behind)
                # long words hold their pieces as (first one's ids, the others), not copied at each step
                item = (total, (*piece, *ids), next(order), start, behind + score, None) if short else (round(total, 6), (start,), next(order), start, behind + score, (piece, path))
                heapq.heappush(queue, item)
        return out if short else sorted(out, key=lambda x: -x[0])

    def __reduce__(self) -> tuple:
        return Pieces, (self.names, self.scores, self.byte_ids, self.special)

    def encoder(self, most: int) -> Encoder:
        """An encoder that a worker's tasks share, with the words that it remembers."""
        if getattr(self, "shared", None) is None or self.shared.most != most:
            self.shared = Encoder(self, most)
        return self.shared

    def tabulate(self) -> None:
        """The trie as hash tables of (node, letter) for many lookups at once."""
        self.letter = np.zeros(0x110000, np.int64)
        letters = sorted({c for n, x in zip(self.names, self.special, strict=True) if not x for c in n})
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        keys, nodes, ids, scores = [], [], [-1], [0.0]
        todo = [(self.trie, 0)]
        while todo:
            node, at = todo.pop()
            for c, below in node.items():
                if c:
                    keys.append(at << 20 | int(self.letter[ord(c)]))
                    nodes.append(len(ids))
                    piece = below.get("", (-1, 0.0))
                    ids.append(piece[0])
                    scores.append(piece[1])
                    todo.append((below, nodes[-1]))
        self.node_ids, self.node_scores = np.array(ids), np.array(scores)
        left, to = np.array(keys), np.array(nodes)
        self.longest = max(len(n) for n, x in zip(self.names, self.special, strict=True) if not x)
        self.tables = []
        while len(left):
            slots, held, owner = self._slots(left, len(self.tables)), np.full(1 << 18, -1), np.full(1 << 18, -1)
            held[slots], owner[slots] = left, to
            self.tables.append((held, owner))
            lost = held[slots] != left
            left, to = left[lost], to[lost]

    @staticmethod
    def _slots(keys: np.ndarray, salt: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64), salt) >> np.uint64(46)).astype(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node below each node by a letter; -1 without one."""
        keys = nodes << 20 | letters
        out = np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        for salt, (held, owner) in enumerate(self.tables):
            slots = self._slots(keys[open_], salt)
            own = held[slots]
            hit = own == keys[open_]
            out[open_[hit]] = owner[slots[hit]]
            open_ = open_[~hit & (own >= 0)]
            if not len(open_):
                break
        return out

    def best_of(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """For each word: its best ids, packed; their score; what its second best costs more (infinite without one).

        Many words are searched at once, a very long one by itself.
        """
        if not hasattr(self, "tables"):
            self.tabulate()
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[order], LONG, side="right"))
        sums = np.concatenate([[0], np.cumsum(lengths[order[:short]] + 1)])
        at = 0
        while at < short:
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + CELLS // self.longest, side="right")) - 1)
            own = order[at:end].tolist()
            for i, found in zip(own, self._many([words[i] for i in own]), strict=True):
                out[i] = found
            at = end
        for i in order[short:].tolist():
            out[i] = self._long(words[i])
        return out

    def _long(self, word: str) -> tuple[bytes, float, float]:
        ends = self.edges(word)
        ahead = self.forward(ends)
        behind = [-np.inf] * len(word) + [0.0]
        for j in range(len(word), 0, -1):
            for i, _, score in ends[j]:
                behind[i] = max(behind[i], behind[j] + score)
        ids: list[int] = []
        at, path = len(word), set()
        while at:
            taken = max(ends[at], key=lambda e: (ahead[e[0]] + e[2], e[0]))
            path.add((taken[0], at))
            ids += reversed(taken[1])
            at = taken[0]
        ids.reverse()
        second = max((ahead[i] + s + behind[j] for j, own in enumerate(ends) for i, _, s in own if (i, j) not in path), default=-np.inf)
        return np.array(ids, "<i4").tobytes(), ahead[-1], ahead[-1] - second

    def _many(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """``best_of`` for words ordered by their lengths: their pieces are sought at once, the paths for all of one length.

        A length's cells are its words' first letters, then their second ones, and so on, and one each for the words' ends.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.flatnonzero(np.diff(lengths, prepend=-1))
        ns, sizes = np.diff(np.append(first, len(words))), lengths[first]
        bases = np.concatenate([[0], np.cumsum(ns * (sizes + 1))])
        codes, inner = np.zeros(bases[-1], np.int64), np.ones(bases[-1], bool)
        for a, n, length, base in zip(first, ns, sizes, bases, strict=False):
            own = np.frombuffer("".join(words[a : a + n]).encode("utf-32-le"), np.uint32)
            codes[base : base + n * length] = own.reshape(n, length).T.ravel()
            inner[base + n * length : base + n * (length + 1)] = False
        letters = np.where(inner, self.letter[codes], 0)  # no piece goes on at a word's end
        # by length, and by the cell where a piece starts or the one where it ends
        starting, ending = np.full((self.longest, len(codes)), -np.inf), np.full((self.longest, len(codes)), -np.inf)
        ids, reach = np.empty((self.longest, len(codes)), np.int32), np.ones(len(codes), np.int8)
        alive = np.flatnonzero(inner)
        nodes, stride, spot = np.zeros(len(alive), np.int64), np.repeat(ns, ns * sizes), alive
        for size in range(1, self.longest + 1):
            nodes = self.step(nodes, letters[spot])
            on = nodes >= 0
            alive, nodes, stride = alive[on], nodes[on], stride[on]
            if not len(alive):
                break
            spot = spot[on] + stride
            piece = self.node_ids[nodes]
            hit = piece >= 0
            at = alive[hit]
            starting[size - 1, at] = ending[size - 1, spot[hit]] = self.node_scores[nodes[hit]]
            ids[size - 1, at] = piece[hit]
            reach[at] = size
        unknown = np.flatnonzero(inner & (starting[0] == -np.inf))  # as byte pieces; the letter stands for their ids
        starting[0, unknown] = ending[0, unknown + ns[np.searchsorted(bases, unknown, side="right") - 1]] = self.unknown
        ids[0, unknown] = -1 - codes[unknown]
        best, second = np.empty(len(words)), np.full(len(words), -np.inf)
        flat, owners, steps = [], [], []
        for a, n, length, base in zip(first.tolist(), ns.tolist(), sizes.tolist(), bases.tolist(), strict=False):
            here = slice(base, base + n * (length + 1))
            most = int(reach[here].max())
            start, end = (x[:most, here].reshape(most, length + 1, n) for x in (starting, ending))
            # with room before the first place and after the last one for the longest piece
            ahead, behind = np.full((most + length + 1, n), -np.inf), np.full((length + 1 + most, n), -np.inf)
            ahead[most] = behind[length] = 0.0
            for j in range(1, length + 1):
                (ahead[j : j + most][::-1] + end[:, j]).max(0, out=ahead[most + j])
            for i in range(length - 1, -1, -1):
                (behind[i + 1 : i + 1 + most] + start[:, i]).max(0, out=behind[i])
            best[a : a + n] = ahead[most + length]
            rows, on, step, by = np.arange(n), np.full(n, length), 0, np.arange(1, most + 1)
            while len(rows):
                # of equals, the shortest last piece
                size = (ahead[(most + on)[:, None] - by, rows[:, None]] + end[by - 1, on[:, None], rows[:, None]]).argmax(1) + 1
                on = on - size
                cell = base + on * n + rows
                flat.append(ids[size - 1, cell])
                owners.append(rows + a)
                steps.append(np.full(len(rows), step))
                starting[size - 1, cell] = -np.inf  # what stays are the pieces off the best paths
                step -= 1
                rows, on = rows[on > 0], on[on > 0]
            for size in range(1, most + 1):
                through = ahead[most : most + length - size + 1] + start[size - 1, : length - size + 1] + behind[size : length + 1]
                np.maximum(second[a : a + n], through.max(0), out=second[a : a + n])
        pieces, owner = np.concatenate(flat), np.concatenate(owners)
        by = np.lexsort((np.concatenate(steps), owner))
        pieces, owner = pieces[by], owner[by]
        spread = {int(k): [self.byte_ids[b] for b in chr(-1 - int(pieces[k])).encode()] for k in np.flatnonzero(pieces < 0)}
        if spread:
            times = np.ones(len(pieces), np.int64)
            times[list(spread)] = [len(x) for x in spread.values()]
            places = np.cumsum(times) - times
            pieces, owner = np.repeat(pieces, times), np.repeat(owner, times)
            for k, own in spread.items():
                pieces[places[k] : places[k] + len(own)] = own
        packed = pieces.astype("<i4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words))) * 4]).tolist()
        return [(packed[i:j], s, d) for i, j, s, d in zip(bounds[:-1], bounds[1:], best.tolist(), (best - second).tolist(), strict=True)]


class Encoder:
    """Texts to packed ids; words are remembered."""

    def __init__(self, pieces: Pieces, most: int = BEST) -> None:
        self.pieces, self.most = pieces, most
        self.alternatives: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.words = re.compile("\n| +[^ \n]*|[^ \n]+")
        self.forget([])

    def forget(self, kept: list[str]) -> None:
        """Remember some of the known words alone: their places, and by place their ids, scores, what their second best cost more, and how many groups had them."""
        at = [self.known[w] for w in kept]
        self.known: dict[str, int] = dict(zip(kept, range(len(kept)), strict=True))
        self.blobs: list[bytes] = [self.blobs[i] for i in at]
        self.numbers = self.numbers[at] if kept else np.empty((0, 2))
        self.sizes = self.sizes[at] if kept else np.empty(0, np.int64)
        self.groups = np.zeros(len(kept), np.int32)

    def learn(self, texts: list[list[str]]) -> None:
        """Search the words of several texts that aren't remembered, and number those that the texts have.

        Where too many are remembered, those stay that more than one group had.
        """
        seen = list(dict.fromkeys(chain.from_iterable(texts)))
        new = [w for w in seen if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            often = [w for w, n in zip(self.known, self.groups.tolist(), strict=True) if n > 1]
            self.forget(often if len(often) + len(new) <= REMEMBERED * 3 // 4 else [])
            new = [w for w in seen if w not in self.known]
        for at in range(0, len(new), GROUP):
            group = new[at : at + GROUP]
            found = [self.literal() if w[0] == "\0" and w[1:] == MARK else x for w, x in zip(group, self.pieces.best_of([w.replace(" ", MARK) for w in group]), strict=True)]
            self.known.update(zip(group, range(len(self.known), len(self.known) + len(group)), strict=True))
            self.blobs += [x[0] for x in found]
            self.numbers = np.concatenate([self.numbers, np.array([x[1:] for x in found])])
            self.sizes = np.concatenate([self.sizes, np.fromiter((len(x[0]) for x in found), np.int64, len(found))])
        self.groups = np.concatenate([self.groups, np.zeros(len(self.known) - len(self.groups), np.int32)])
        at = np.fromiter(map(self.known.__getitem__, seen), np.int64, len(seen))
        self.groups[at] += 1
        # each word of a text is looked up among the group's, a table far smaller than that of all words
        self.own = dict(zip(seen, range(len(seen)), strict=True))
        self.own_blobs, self.own_numbers, self.own_sizes = [self.blobs[i] for i in at.tolist()], self.numbers[at], self.sizes[at]

    def ranked(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        found = self.alternatives.get(word)
        if found is None:
            if len(self.alternatives) >= REMEMBERED:
                self.alternatives.clear()
            found = self.alternatives[word] = self.pieces.ranked(word.replace(" ", MARK), self.most)
        return found

    def split(self, text: str) -> list[str]:
        """Words, with spaces for word marks, and literal word marks as themselves alone under a leading NUL."""
        if not text:
            return []
        if MARK not in text:
            return self.words.findall(" " + text)
        parts = (" " + text).split(MARK)
        out = self.words.findall(parts[0])
        for part in parts[1:]:
            out += ["\0" + MARK, *self.words.findall(part)]
        return out

    def literal(self) -> tuple[bytes, float, float]:
        return np.array([self.pieces.byte_ids[b] for b in MARK.encode()], "<i4").tobytes(), self.pieces.unknown, float("inf")

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """The best segmentations of each text: scores and packed ids."""
        split = [self.split(t) for t in texts]
        out, group, held = [], [], 0
        for words in split:
            group.append(words)
            held += len(words)
            if held >= GROUP:
                self.learn(group)
                out += map(self.combine, group)
                group, held = [], 0
        self.learn(group)
        return out + list(map(self.combine, group))

    def combine(self, words: list[str]) -> list[tuple[float, bytes]]:
        """The best segmentations of a text from those of its words, which the last ``learn`` has seen."""
        if not words:
            return [(0.0, b"")]
        places = list(map(self.own.__getitem__, words))
        at = np.array(places)
        scores, costs = self.own_numbers[at].T
        total, best = sum(scores.tolist()), b"".join(map(self.own_blobs.__getitem__, places))
        out = [(total, best)]
        if self.most == 1:
            return out
        # the places of the words whose second best costs least
        near = np.arange(len(costs))
        if len(near) >= self.most:
            near = np.flatnonzero(costs <= np.partition(costs, self.most - 2)[self.most - 2])
        near = near[np.argsort(costs[near], kind="stable")][: self.most - 1]
        ends = np.cumsum(self.own_sizes[at])
        ranked, spans = {}, {}
        for k in near.tolist():
            if costs[k] < np.inf:
                spans[k] = int(ends[k] - self.own_sizes[at[k]]), int(ends[k])
                blob, score = self.own_blobs[places[k]], float(scores[k])
                others = [(score - other, packed) for other, ids in self.ranked(words[k]) if (packed := np.array(ids, "<i4").tobytes()) != blob]
                ranked[k] = [(0.0, None), *others[: self.most - 1]]
        # combinations as (cost, choices): each place in turn with each of its segmentations
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for k in sorted(ranked):
            grown = [(cost + more, (*chosen, (k, ids)) if ids is not None else chosen) for cost, chosen in combos for more, ids in ranked[k]]
            combos = heapq.nsmallest(self.most, grown)
        for cost, chosen in combos[1:]:
            parts, done = [], 0
            for k, ids in chosen:
                parts += [best[done : spans[k][0]], ids]
                done = spans[k][1]
            out.append((total - cost, b"".join([*parts, best[done:]])))
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids."""
        known = self.pieces.bytes
        return b"".join(map(known.__getitem__, np.frombuffer(packed, "<i4").tolist())).decode()[1:]


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PORTION`` bytes of text and whole rows: N segmentations are several times as large as their text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
        yield batch.slice(at, end - at)
        at = end


def encode_documents(docs: DataFrame, path: str = "doc_id", text: str = "text", model: str = MODEL, best: int = BEST, digest: bool = False, alternatives: bool = True) -> DataFrame:
    """The documents' other columns with n_tokens, ids (little-endian 32-bit), scores and n_best (ids of each segmentation), decoded.

    With ``digest``, ids, decoded and n_best hold SHA-256 values instead; without ``alternatives``, only the best is searched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    rows = docs.select(F.col(path).alias("path"), body(text).alias("text"))
    most = best if alternatives else 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder(most)
        sha = lambda x: hashlib.sha256(x).digest() if digest else x
        names = ["path", "n_tokens", "ids", "scores", "n_best", "decoded", "round_trip"]
        for batch in (part for whole in batches(rows) for part in portions(whole)):
            out: list[list] = [[] for _ in names[1:]]
            texts = batch.column("text").to_pylist()
            for text, found in zip(texts, encoder.encode(texts), strict=True):
                decoded = encoder.decode(found[0][1])
                values = (len(found[0][1]) // 4, sha(found[0][1]), [s for s, _ in found], [sha(ids) for _, ids in found], sha(decoded.encode()), decoded == text)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

    kind = docs.schema[path].dataType.simpleString()
    return rows.mapInArrow(run, f"path {kind}, n_tokens long, ids binary, scores array<double>, n_best array<binary>, decoded binary, round_trip boolean")


def encoding_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: number and digest of its best pieces, the N best scores and digests, the digest of the decoded text."""
    found = encode_documents(docs, model=model, digest=True)
    text_of = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("path").alias("doc_id"),
        "n_tokens",
        text_of("ids").alias("ids_sha256"),
        F.array_join(F.transform("scores", lambda s: s.cast("decimal(38,2)").cast("string")), ",").alias("scores"),
        F.array_join(F.transform("n_best", text_of), ",").alias("n_best_sha256"),
        text_of("decoded").alias("decoded_sha256"),
        "round_trip",
    )
