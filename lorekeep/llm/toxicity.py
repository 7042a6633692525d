"""Toxicity scores of texts restored by a noisy-channel decoder.

Disguised words (digits and signs for letters, letters spelled apart, letters
repeated) are lattices: each sign may stand for letters, or for nothing. A Viterbi
search under a character trigram model picks the likeliest spelling; the model's
counts come from every document. Signs at a word's edges and doubled letters are read
both ways. Runs of short tokens are lattices too, in which a word may end or go on at
each gap: their words of more than one token count beside the tokens' own. A logistic
model over words and their beginnings, in the original and the restored spelling, then
scores the text.

The classifier is fitted on labelled rows outside the held-out third, at most
``SAMPLE`` of them, drawn by a hash of the id; its words are those whose rates differ
most between the classes. Only the text enters a score.

Cases: null texts are empty; empty texts get the model's prior; with no usable labels
every score is 0, with labels of one class it is their share; a row labelled twice
counts as toxic if any label says so; a null id is not held out; an empty table gives
an empty result; other columns, whatever their names, are ignored or passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, body, stash

#: Labelled rows that the classifier is fitted on at most; features that it weighs.
SAMPLE, FEATURES = 20_000, 256
THRESHOLD = 0.7
#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i"}
#: Costs (nats) of reading a sign as a letter, of dropping one, of dropping another mark, of dropping one of two equal letters, of dropping one of more.
AS_LETTER, AS_NOTHING, MARK, TWICE, OFTEN = 1.0, 8.0, 0.3, 7.0, 0.3
#: Beginnings of words, in letters, that count as features beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Letters of a token that may be a piece of a word; the costs of going on over a gap beside a single character, over another, of each character of a token left as a number, of dropping a sign that may be a mark; what a reading as a feature may cost more than words apart.
PIECE, JOIN_ONE, JOIN, NUMBER, EDGE, FEATURE = 5, 0.5, 4.0, 3.0, 1.5, 7.0
#: Letters of a word in pieces at most: repeated short tokens on end are no word.
WORD_LETTERS = 32
LETTERS = 64
NOTHING = frozenset([""])
NONE: frozenset[str] = frozenset()
#: Tokens that a worker remembers; of those that are read by letters, and of steps between them, each far larger.
KEPT_TOKENS, KEPT_READINGS = 120_000, 30_000
#: Characters of the texts that are taken apart at once (longer texts alone), signs stripped from a side of their tokens.
PORTION, STRIPPED = 1 << 18, 6

FIRST, COST = itemgetter(0), itemgetter(2)

WORD = re.compile(r"[^\W\d_]+")
TWICE_ON_END = re.compile(r"(.)\1")
AGAIN = re.compile(r"(.)\1+")
#: Signs that begin or end a disguised word rather than a sentence, unless three or more stand together.
MONEY = "$@"
RUNS = re.compile(r"^([$@])\1{2,}|([$@])\2{2,}$")
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’‘…¿¡"
OUTER = EDGES.replace("$", "").replace("@", "")
#: Marks at an edge that stand for no letter, and signs there that do.
MARKS = "".join(c for c in EDGES if c not in SIGNS)
EDGE_SIGNS = frozenset(c for c in EDGES if c in SIGNS)
OPENING, CLOSING = "(¡", "!"
#: Each letter, and each sign as a letter, in one spelling: l and i are one.
FOLDED = str.maketrans({**{sign: letters[0] for sign, letters in SIGNS.items()}, "l": "i"})


def letter_table() -> np.ndarray:
    """A number below ``LETTERS`` for each code point: 0 for what isn't a letter, 1 to 26 for a to z, shared ones for the rest."""
    points = np.arange(0x110000)
    table = np.zeros(0x110000, np.uint8)
    alpha = np.char.isalpha(points.astype("<u4").view("<U1"))
    table[alpha] = 27 + points[alpha] % (LETTERS - 27)
    table[97:123] = np.arange(1, 27)
    return table


_table: np.ndarray | None = None


def numbers(text: str) -> np.ndarray:
    global _table
    if _table is None:
        _table = letter_table()
    return _table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


@cache
def place(letter: str) -> int:
    """One letter's number."""
    return int(numbers(letter)[0])


#: What a character is, in bits.
SPACE, ALPHA, IN_EDGES, IN_MARKS = 1, 2, 4, 8


def character_table() -> np.ndarray:
    """The bits of each code point, as ``str.split`` and ``str.isalpha`` have it."""
    points = np.arange(0x110000, dtype="<u4").view("<U1")
    table = SPACE * np.char.isspace(points).astype(np.uint8) | ALPHA * np.char.isalpha(points).astype(np.uint8)
    for bit, some in ((IN_EDGES, EDGES), (IN_MARKS, MARKS)):
        table[[ord(c) for c in some]] |= bit
    return table


_characters: np.ndarray | None = None


class Portion:
    """Where the tokens of some lower-case texts are, found for all at once."""

    def __init__(self, texts: list[str]) -> None:
        global _characters
        if _characters is None:
            _characters = character_table()
        self.texts, self.joined = texts, "\n".join(texts)
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bits = _characters[self.points]
        solid = np.zeros(len(self.bits) + 2, bool)
        solid[1:-1] = self.bits & SPACE == 0
        bounds = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = bounds[::2], bounds[1::2]
        #: Each text's first token, and after the last text's last.
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()

    def dull(self, heads: np.ndarray) -> np.ndarray:
        """Which tokens are ``Scorer.vain`` at a glance; those with more than ``STRIPPED`` signs at a side never are."""
        bits, points = self.bits, self.points
        out = np.zeros(len(self.starts), bool)
        at = np.flatnonzero(self.ends - self.starts > PIECE)
        start, end = self.starts[at], self.ends[at]
        others = np.zeros(len(bits) + 1, np.int32)
        np.cumsum(bits & ALPHA == 0, out=others[1:])
        odd = np.flatnonzero(others[start] != others[end])
        a, b = start[odd], end[odd]
        for _ in range(STRIPPED):
            b -= bits[b - 1] & IN_EDGES > 0
            b = np.maximum(b, a + 1)
        for _ in range(STRIPPED):
            a += bits[a] & IN_MARKS > 0
            a = np.minimum(a, b - 1)
        start[odd], end[odd] = a, b
        fits = (end - start > PIECE) & (others[start] == others[end])
        at, start = at[fits], start[fits]
        x, y, z = (points[start + k].astype(np.int64) for k in range(3))
        out[at] = (x != y) & (y != z) & ~np.isin(x << 42 | y << 21 | z, heads)
        return out

    def tokens(self, chosen: np.ndarray) -> list[str]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.starts[chosen].tolist(), self.ends[chosen].tolist(), strict=True)]


def unwound(word: tuple | None) -> str:
    """The letters of a word held as (its beginning, last letter)."""
    letters = []
    while word is not None:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters))


class CharacterModel:
    """Trigram log probabilities of letters, with 0 for a word's bounds."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
        two = three.sum(0)
        one = two.sum(0) + 1
        low = one / one.sum()
        middle = (two + 5 * low) / (two.sum(1, keepdims=True) + 5)
        self.logs = np.log((three + 5 * middle[None]) / (three.sum(2, keepdims=True) + 5)).tolist()

    def restore(self, token: str) -> str:
        """The likeliest spelling of a disguised lower-case token; marks at its edges are dropped."""
        return self.likeliest(token)[1]

    def likeliest(self, token: str) -> tuple[float, str]:
        """The cost and letters of a token's likeliest spelling."""
        # by the last two letters: cost, and the spelling as (its beginning, last letter), so that long tokens aren't copied
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before, logs = "", self.logs
        repeated = [n for _, run in groupby(token) for n in [len(list(run))] for _ in range(n)]
        for c, run in zip(token, repeated, strict=True):
            arcs: list[tuple[str, float]]
            if c.isalpha():
                arcs = [(c, 0.0)]
                if c == before:
                    arcs.append(("", TWICE if run == 2 else OFTEN))
            elif c in SIGNS:
                arcs = [(x, AS_LETTER) for x in SIGNS[c]]
                arcs.append(("", 0.1 if c == before else AS_NOTHING))
            else:
                arcs = [("", MARK)]
            before = c
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (i, j), (cost, spelled) in best.items():
                for letter, price in arcs:
                    if letter:
                        k = place(letter)
                        state, total, text = (j, k), cost + price - logs[i][j][k], (spelled, letter)
                    else:
                        state, total, text = (i, j), cost + price, spelled
                    held = following.get(state)
                    if held is None or total < held[0]:
                        following[state] = (total, text)
            best = following
        cost, spelled = min(((cost - logs[i][j][0], spelled) for (i, j), (cost, spelled) in best.items()), key=lambda x: x[0])
        return cost, unwound(spelled)

    def spanned(self, parts: list[str]) -> list[str]:
        """Spellings of pieces of one word that aren't ``FEATURE`` less likely than their words apart."""
        gaps = sum(JOIN_ONE if 1 in (len(a), len(b)) else JOIN for a, b in pairwise(parts))
        apart = sum(self.likeliest(x)[0] if any(c.isalpha() for c in x) else sum(NUMBER if c.isalnum() or c in SIGNS else MARK for c in x) for x in parts)
        glued = "".join(parts)
        found = [self.likeliest(x) for x in dict.fromkeys((glued, glued.lstrip(EDGES), glued.rstrip(EDGES), glued.strip(EDGES))) if x]
        return [spelled for cost, spelled in found if cost + gaps < apart + FEATURE]

    def joined(self, tokens: list[str]) -> list[str]:
        """Words of more than one token in the likeliest reading of a run of short tokens."""
        glued = "".join(tokens)
        if glued.isalpha() and not TWICE_ON_END.search(glued):
            return self.joined_letters(tokens)
        # by the last two letters (none after a word's end): cost, the open word as (its beginning, last letter), its tokens, (earlier words, last)
        best: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None, 0, None)}
        repeated = [n for _, run in groupby(glued) for n in [len(list(run))] for _ in range(n)]
        at, before, last, logs = 0, "", 0, self.logs
        for token in tokens:
            start = best
            best = {}
            letters = token.isalpha() or any(c.isalpha() for c in token)
            gap = JOIN_ONE if len(token) == 1 or last == 1 else JOIN
            last = len(token)
            for state, (cost, word, n, done) in start.items():
                # as a token of the open word
                best[state] = (cost + gap * (n > 0), word, n + 1, done)
            for k, c in enumerate(token):
                following: dict[tuple[int, int], tuple] = {}
                if c.isalpha():
                    if c != before:
                        # one reading for each state, as of most letters
                        x = place(c)
                        for (i, j), (cost, word, n, done) in best.items():
                            cost -= logs[i][j][x]
                            held = following.get((j, x))
                            if held is None or cost < held[0]:
                                following[j, x] = cost, (word, c), n, done
                        best, before, at = following, c, at + 1
                        continue
                    arcs = [(c, 0.0)]
                    again = TWICE if repeated[at] == 2 else OFTEN
                elif c in SIGNS:
                    arcs = [(x, AS_LETTER) for x in SIGNS[c]]
                    again = 0.1
                    if letters:
                        mark = (k == 0 and c in OPENING) or (k == len(token) - 1 and c in CLOSING)
                        arcs.append(("", EDGE if mark else AS_NOTHING))
                else:
                    arcs, again = [("", MARK)], None
                for (i, j), (cost, word, n, done) in best.items():
                    for letter, price in (*arcs, ("", again)) if again is not None and c == before and word else arcs:
                        if letter:
                            x = place(letter)
                            state, found = (j, x), (cost + price - logs[i][j][x], (word, letter), n, done)
                        else:
                            state, found = (i, j), (cost + price, word, n, done)
                        held = following.get(state)
                        if held is None or found[0] < held[0]:
                            following[state] = found
                best, before, at = following, c, at + 1
            # the word ends here, or the token is left as a number or a mark of its own
            ends = [(cost - (logs[i][j][0] if word else 0.0), word, n, done) for (i, j), (cost, word, n, done) in best.items()]
            best.pop((0, 0), None)
            cost, word, n, done = min(ends, key=lambda x: x[0])
            ended = (cost, None, 0, (done, word) if n > 1 and word else done)
            if not letters and (0, 0) in start:
                aside = start[0, 0]
                price = aside[0] + sum(NUMBER if c.isalnum() or c in SIGNS else MARK for c in token)
                if price < ended[0]:
                    ended = (price, None, 0, aside[3])
            best[0, 0] = ended
        out, done = [], best[0, 0][3]
        while done is not None:
            done, word = done
            spelled = unwound(word)
            if len(spelled) <= WORD_LETTERS:
                out.append(spelled)
        return out[::-1]


    def joined_letters(self, tokens: list[str]) -> list[str]:
        """``joined`` of tokens of letters alone, none repeated, each of which has one reading: their words differ in their bounds alone."""
        logs, ends = self.logs, self.logs[0][0]
        # open words by their last two letters, two at most: cost, tokens, (earlier words, last); then those that ended
        opened: list[tuple[int, int, float, int, tuple | None]] = []
        ended, earlier, last = 0.0, None, 0
        for at, token in enumerate(tokens):
            x, *more = map(place, token)
            gap = JOIN_ONE if len(token) == 1 or last == 1 else JOIN
            last = len(token)
            found = [(0, x, ended - ends[x], 1, earlier)]
            if opened:
                # by now the letters before the last two are the same, or none
                _, j, cost, n, done = min([(i, j, cost + gap - logs[i][j][x], n, done) for i, j, cost, n, done in opened], key=COST)
                found.insert(0, (j, x, cost, n + 1, done))
            for y in more:
                if len(found) > 1:
                    found = [min([(j, k, cost - logs[j][k][y], n, done) for j, k, cost, n, done in found], key=COST)]
                    j, k, cost, n, done = found[0]
                else:
                    j, k, cost, n, done = found[0]
                    cost -= logs[j][k][y]
                found = [(k, y, cost, n, done)]
            opened = found
            ended, n, earlier = min([(cost - logs[i][j][0], n, done) for i, j, cost, n, done in opened], key=FIRST)
            if n > 1:
                earlier = earlier, "".join(tokens[at + 1 - n : at + 1])
        out = []
        while earlier is not None:
            earlier, spelled = earlier
            if len(spelled) <= WORD_LETTERS:
                out.append(spelled)
        return out[::-1]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; Spark adds up the partitions' counts, of which the driver gets a bounded number."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches(rows):
            # texts on end, with non-letters between them: as if each began and ended a word
            n = np.concatenate([[0, 0], numbers("\n".join(batch.column(0).to_pylist())), [0]]).astype(np.int32)
            first, second, third = n[:-2].copy(), n[1:-1], n[2:]
            first[second == 0] = 0
            total += np.bincount((first * LETTERS + second) * LETTERS + third, minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(LETTERS**3, np.int64)
    for row in docs.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


class Reader:
    """Tokens to words, disguised ones in their restored spelling too."""

    def __init__(self, model: CharacterModel) -> None:
        self.model = model
        self.kept: dict[str, tuple[str, ...]] = {}
        self.read: dict[tuple[str, ...], list[str]] = {}

    def spanned(self, parts: tuple[str, ...]) -> list[str]:
        """``CharacterModel.spanned``, kept."""
        found = self.read.get(parts)
        if found is None:
            if len(self.read) >= KEPT_READINGS:
                self.read.clear()
            found = self.read[parts] = self.model.spanned(list(parts))
        return found

    def words(self, token: str) -> tuple[str, ...]:
        found = self.kept.get(token)
        if found is None:
            inner = token.strip(MARKS)
            if inner.isalpha():
                # marks around letters say nothing: such words are kept without them, and only if they have other readings
                if not TWICE_ON_END.search(inner):
                    return (inner,)
                if inner != token:
                    return self.words(inner)
            plain = token.strip(EDGES)
            core = RUNS.sub("", token).strip(OUTER) if token[0] in MONEY or token[-1] in MONEY else plain
            found = (core,) if core.isalpha() else tuple(WORD.findall(token))
            if any(c.isalpha() for c in token):
                if not core.isalpha() or TWICE_ON_END.search(core):
                    found = (*found, self.model.restore(core))
                found = tuple(dict.fromkeys((*found, *(self.model.restore(x) for x in with_edges(token, plain)))))
            if len(self.kept) >= KEPT_READINGS:
                self.kept.clear()
            self.kept[token] = found
        return found

    def counts(self, text: str) -> tuple[Counter[str], int]:
        """Words of a text with their counts, and the number of its tokens."""
        tokens = text.lower().split()
        out: Counter[str] = Counter()
        get = out.get
        for token, n in Counter(tokens).items():
            # most tokens are words as they are
            for word in (token,) if token.isalpha() and not TWICE_ON_END.search(token) else self.words(token):
                out[word] = get(word, 0) + n
        out.update(self.spelled_apart(tokens))
        return out, len(tokens)

    def spelled_apart(self, tokens: list[str]) -> list[str]:
        """Restored words from runs of short tokens."""
        out, run = [], []
        for token in (*tokens, None):
            if token is None or (len(token) > PIECE and token.isalpha()):
                part = None
            else:
                part = token if token.isalpha() else piece(token)
            if part is not None:
                run.append(part)
                continue
            if len(run) > 1:
                out += self.model.joined(run)
            run = []
        return out


def with_edges(token: str, plain: str) -> list[str]:
    """A token with signs that it has at its edges: with all on a side, with those next to the word, with none."""
    whole = RUNS.sub("", token).strip(MARKS)
    if not plain or len(whole) <= len(plain) or not (whole[0] in EDGE_SIGNS or whole[-1] in EDGE_SIGNS):
        return []
    a = whole.find(plain)
    left, right = whole[:a], whole[a + len(plain) :]
    near_left = next((left[-len(list(run)) :] for _, run in groupby(left[::-1])), "")
    near_right = next((right[: len(list(run))] for _, run in groupby(right)), "")
    sides = [(x, y) for x in dict.fromkeys(("", near_left, left)) for y in dict.fromkeys(("", near_right, right))]
    return [x + plain + y for x, y in sides if x or y]


@lru_cache(KEPT_READINGS)
def piece(token: str) -> str | None:
    """What a token may add to a word spelled apart: without marks at its edges; null if it is too long."""
    inner = RUNS.sub("", token).strip(MARKS) or token[:1]
    return inner if len(inner.strip(EDGES)) <= PIECE and len(AGAIN.sub(r"\1", inner)) <= PIECE + 4 else None


@lru_cache(KEPT_READINGS)
def names(word: str) -> tuple[str, ...]:
    """A whole word, and its beginnings marked by a tilde."""
    return word, *(word[:k] + "~" for k in BEGINNINGS if len(word) > k)


def features(words: dict[str, int]) -> dict[str, int]:
    """``names`` of all words with their counts."""
    begun: dict[str, int] = {}
    get = begun.get
    for word, n in words.items():
        size = len(word)
        for k in BEGINNINGS:
            if k >= size:
                break
            begun[word[:k]] = get(word[:k], 0) + n
    return {**words, **{f + "~": n for f, n in begun.items()}}


def folded(letters: str) -> str:
    """Letters and signs in one spelling, without repetitions and marks."""
    return AGAIN.sub(r"\1", "".join(WORD.findall(letters.translate(FOLDED))))


#: The step to a token that is no piece.
NOWHERE = (False, NONE, NONE, False)


class Codes(dict):
    """A token's number: 8 times the place of its kind, 4 if it has features, 2 if it may be a piece of a word, 1 if a word with a feature may begin with it; 0 if it says nothing."""

    def __init__(self, scorer: Scorer, reader: Reader) -> None:
        self.scorer, self.reader = scorer, reader
        #: Places of features, and foldings, by kind.
        self.kinds: list[tuple[tuple[int, ...], frozenset[str]]] = [((), NONE)]
        self.numbers = {self.kinds[0]: 0}
        #: By two numbers of tokens, whether a word with a feature may begin with the first and not end there.
        self.pairs: dict[int, bool] = {}

    def __missing__(self, token: str) -> int:
        at, opening = self.scorer.learn(self.reader, token)
        letters = self.scorer.foldings(token)
        kind = self.numbers.setdefault((at, letters), len(self.kinds))
        if kind == len(self.kinds):
            self.kinds.append((at, letters))
        self[token] = code = 8 * kind + 4 * bool(at) + 2 * bool(letters) + opening
        return code

    def of(self, portion: Portion) -> np.ndarray:
        """The numbers of the tokens; those of portions before may no longer hold."""
        if len(self) >= KEPT_TOKENS or len(self.pairs) >= KEPT_TOKENS:
            self.clear()
            self.__init__(self.scorer, self.reader)
        own = np.flatnonzero(~portion.dull(self.scorer.points))
        out = np.zeros(len(portion.starts), np.int64)
        out[own] = np.fromiter(map(self.__getitem__, portion.tokens(own)), np.int64, len(own))
        return out

    def places(self, codes: np.ndarray) -> list[int]:
        """Where a word with a feature may begin, and not end at once."""
        at = np.flatnonzero(codes[:-1] & codes[1:] >> 1 & 1)
        pairs, out = self.pairs, []
        for k, pair in zip(at.tolist(), (codes[at] << 32 | codes[at + 1]).tolist(), strict=True):
            good = pairs.get(pair)
            if good is None:
                begun, some, more, _ = self.scorer.met(self.kinds[pair >> 35][1], self.kinds[(pair & 0xFFFFFFFF) >> 3][1])
                good = pairs[pair] = begun or not (some <= NOTHING and more <= NOTHING)
            if good:
                out.append(k)
        return out


class Scorer:
    """A logistic model over damped counts and rates of chosen features."""

    def __init__(self, chosen: list[str], rows: list[tuple], prior: float) -> None:
        self.chosen = {f: i for i, f in enumerate(chosen)}
        self.heads = {f.rstrip("~")[:3] for f in chosen}
        self.points = np.array(sorted(ord(h[0]) << 42 | ord(h[1]) << 21 | ord(h[2]) for h in self.heads if len(h) == 3), np.int64)
        self.letters = {f.rstrip("~") for f in chosen}
        self.begun = {x[:k] for x in self.letters for k in range(len(x) + 1)}
        #: For words in pieces: folded, without repetitions, whole and up to each letter.
        short = [f for f in chosen if len(f.rstrip("~")) <= WORD_LETTERS]
        self.words = {folded(f) for f in short if not f.endswith("~")}
        self.wholes = {folded(f.rstrip("~")) for f in short}
        self.upto = {w[:k] for w in self.wholes for k in range(1, len(w))}
        self.pieces: dict[str, frozenset[str]] = {}
        self.codes: Codes | None = None
        #: Steps of the searches for words in pieces: by what tokens may be so far (none: nothing), and what the next token may be.
        self.steps: dict[tuple[frozenset[str], frozenset[str]], tuple[bool, frozenset[str], frozenset[str], bool]] = {}
        self.weights: np.ndarray | None = None
        self.prior = prior
        if len(chosen) and 0 < prior < 1:
            self.fit(rows)

    def vector(self, found: list[tuple[int, int]], n: int) -> np.ndarray:
        k = len(self.chosen)
        v = np.zeros(2 * k + 1, np.float32)
        for i, c in found:
            v[i] = np.log1p(c)
            v[k + i] = 100 * c / (n + 20)
        v[-1] = np.log1p(n) / 5
        return v

    def fit(self, rows: list[tuple]) -> None:
        """rows: (label, found, n). Adam on the penalised log loss, over a fixed number of steps."""
        y = np.array([r[0] for r in rows], np.float32)
        x = np.stack([self.vector(r[1], r[2]) for r in rows])
        self.scale = np.maximum(x.std(0), 0.05)
        x /= self.scale
        w, b = np.zeros(x.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 301):
            off = 1 / (1 + np.exp(-(x @ w + b))) - y
            g = (x.T @ off + 2.0 * w) / len(y)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            b -= 0.5 * float(off.mean())
        self.weights, self.bias = w / self.scale, b

    def places(self, word: str) -> list[int]:
        """Chosen features that a word has."""
        return [self.chosen[f] for f in names(word) if f in self.chosen]

    def found(self, words: Counter[str]) -> list[tuple[int, int]]:
        held: Counter[int] = Counter()
        heads = self.heads
        for word, n in words.items():
            if word[:3] in heads:
                for i in self.places(word):
                    held[i] += n
        return list(held.items())

    def find(self, reader: Reader, text: str) -> tuple[list[tuple[int, int]], int]:
        """``found`` of ``reader.counts``."""
        return next(self.find_all(reader, [text]))

    def find_all(self, reader: Reader, texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], int]]:
        """``find`` for each text, by the numbers of the tokens instead of their words."""
        some: list[str] = []
        held = 0
        for text in texts:
            if some and held + len(text) > PORTION:
                yield from self.portion(reader, some)
                some, held = [], 0
            some.append(text.lower())
            held += len(text)
        if some:
            yield from self.portion(reader, some)

    def portion(self, reader: Reader, lower: list[str]) -> Iterator[tuple[list[tuple[int, int]], int]]:
        """``find`` for each of some lower-case texts, whose tokens are found at once."""
        portion, codes = self.coded(reader, lower)
        kinds = self.codes.kinds
        # most tokens say nothing, or may be a piece and no more
        speaking = np.flatnonzero(codes & 4)
        own = np.searchsorted(speaking, portion.first).tolist()
        spoken = (codes[speaking] >> 3).tolist()
        places = self.codes.places(codes)
        begun = np.searchsorted(places, portion.first).tolist()
        for k, text in enumerate(lower):
            held: dict[int, int] = {}
            for kind, n in Counter(spoken[own[k] : own[k + 1]]).items():
                for i in kinds[kind][0]:
                    held[i] = held.get(i, 0) + n
            first, last = portion.first[k], portion.first[k + 1]
            # a last token begins nothing: what follows is another text's
            at = [x - first for x in places[begun[k] : begun[k + 1]] if x + 1 < last]
            if at:
                for word, n in self.read_pieces(reader, text.split(), at).items():
                    for i in self.places(word):
                        held[i] = held.get(i, 0) + n
            yield list(held.items()), last - first

    def coded(self, reader: Reader, lower: list[str]) -> tuple[Portion, np.ndarray]:
        """Texts' tokens with their numbers, which are kept from portion to portion."""
        if self.codes is None or self.codes.reader is not reader:
            self.codes = Codes(self, reader)
        portion = Portion(lower)
        return portion, self.codes.of(portion)

    def vain(self, token: str) -> bool:
        """Whether a token is no piece, and all its readings have three first letters that no feature has."""
        # signs after six letters or more, and repetitions after the first three, leave these as they are
        plain = token if token.isalpha() else token.rstrip(EDGES).lstrip(MARKS)
        head = plain[:3]
        return len(plain) > PIECE and head not in self.heads and head[0] != head[1] != head[2] and plain.isalpha()

    def learn(self, reader: Reader, token: str) -> tuple[tuple[int, ...], bool]:
        """The places of a token's words, and whether a word with a feature may begin with it."""
        plain = token if token.isalpha() else token.strip(EDGES)
        plainly = plain.isalpha() and (len(plain) == len(token) or EDGE_SIGNS.isdisjoint(token))
        if plainly and not TWICE_ON_END.search(plain):
            at = tuple(self.places(plain)) if plain[:3] in self.heads else ()
        elif not self.reachable(plain if plainly else token):
            at = ()
        else:
            at = tuple(i for word in reader.words(token) for i in self.places(word))
        # more letters than a piece has are no piece
        opening = len(plain) <= PIECE and any(f in self.upto or any(f[:n] in self.wholes for n in range(1, len(f) + 1)) for f in self.foldings(token))
        return at, opening

    def reachable(self, token: str) -> bool:
        """Whether any reading of a token, from any of its words on, may begin with the letters of a feature."""
        held, before = {""}, ""
        for c in token:
            letters = c if c.isalpha() else SIGNS.get(c, "")
            if not letters and c.isalnum() and not c.isdecimal():
                return True  # letters to some, not to others
            grown = {p + x for p in held for x in letters if p + x in self.begun}
            if not grown.isdisjoint(self.letters):
                return True
            # letters twice on end may be one, signs and marks nothing, or an end
            held = grown | held if c == before else grown if c.isalpha() else grown | held | {""}
            before = c
        return False

    def foldings(self, token: str) -> frozenset[str]:
        """What a token may be in a feature, folded; empty if it is too long for a piece."""
        if len(token) > PIECE and len(token.strip(EDGES)) > PIECE:
            return NONE
        found = self.pieces.get(token)
        if found is None:
            part = token if token.isalpha() and len(token) <= PIECE else piece(token)
            if part is None:
                found = NONE
            elif part.isalpha():
                found = frozenset((folded(part),))
            else:
                readings = {part, part.lstrip(EDGES), part.rstrip(EDGES), part.strip(EDGES)}
                if WORD.search(part) and WORD.sub("", part):
                    readings.add("".join(WORD.findall(part)))
                found = frozenset(map(folded, readings))
            if len(self.pieces) >= KEPT_READINGS:
                self.pieces.clear()
            self.pieces[token] = found
        return found

    def step(self, now: frozenset[str], token: str) -> tuple[bool, frozenset[str], frozenset[str], bool]:
        """What tokens on end may be with one more: whether a feature is begun, the beginnings of features, those and whole words, whether any is a whole word."""
        more_letters = self.foldings(token)
        return self.met(now, more_letters) if more_letters else NOWHERE

    def met(self, now: frozenset[str], more_letters: frozenset[str]) -> tuple[bool, frozenset[str], frozenset[str], bool]:
        """``step`` by what the next token may be."""
        found = self.steps.get((now, more_letters))
        if found is None:
            both = {AGAIN.sub(r"\1", a + b) for a in now for b in more_letters}
            begun = any(x[:n] in self.wholes for x in both for n in range(1, len(x) + 1))
            some = frozenset(x for x in both if not x or x in self.upto)
            more = frozenset(x for x in both if not x or x in self.upto or x in self.words)
            if len(self.steps) >= KEPT_READINGS:
                self.steps.clear()
            found = self.steps[now, more_letters] = begun, some, more, not more.isdisjoint(self.words)
        return found

    def reaches(self, tokens: list[str], at: int, vain: set[tuple]) -> bool:
        """Whether tokens from a place on may be pieces of a word with a feature; vain: gets what led to none, so that no run is walked again and again."""
        walked = []
        now = self.foldings(tokens[at])
        for k in range(at + 1, min(len(tokens), at + 2 * WORD_LETTERS)):
            begun, now, _, _ = self.step(now, tokens[k])
            if begun:
                return True
            if now <= NOTHING or (k, now) in vain:
                break
            walked.append((k, now))
        vain.update(walked)
        return False

    def spans(self, reader: Reader, tokens: list[str], places: list[int]) -> Iterator[str]:
        """Feature words that tokens on end spell, the longest from each place, where words apart aren't far likelier."""
        end, vain = 0, set()
        for at in places:
            if at < end:
                continue
            now, best, walked, near = self.foldings(tokens[at]), None, [], False
            for k in range(at + 1, min(len(tokens), at + 2 * WORD_LETTERS)):  # a mark after each letter at most
                before = now
                _, _, now, whole = self.step(now, tokens[k])
                if now <= NOTHING or (k, now) in vain:
                    break
                walked.append((k, now))
                if whole and now != before:  # marks and repetitions add nothing
                    near = True
                    parts = tuple(piece(t) for t in tokens[at : k + 1])
                    best = next(((x, k) for x in reader.spanned(parts) if x in self.chosen), best)
            if not near:
                vain.update(walked)
            if best:
                end = best[1] + 1
                yield best[0]

    def in_pieces(self, reader: Reader, tokens: list[str]) -> Counter[str]:
        """``read_pieces`` from wherever a word may begin."""
        _, codes = self.coded(reader, [" ".join(tokens)])
        return self.read_pieces(reader, tokens, self.codes.places(codes))

    def read_pieces(self, reader: Reader, tokens: list[str], places: list[int]) -> Counter[str]:
        """``spans``, and ``reader.spelled_apart`` of the runs that may hold a word with a feature; places: where one may begin, and not end at once."""
        out: Counter[str] = Counter()
        end, vain = 0, set()
        for at in places:
            if at >= end and self.reaches(tokens, at, vain):
                start = at
                while start > end and self.foldings(tokens[start - 1]):
                    start -= 1
                end = at + 1
                while end < len(tokens) and self.foldings(tokens[end]):
                    end += 1
                out.update(reader.spelled_apart(tokens[start:end]))
        return out | Counter(self.spans(reader, tokens, places))

    def score(self, found: list[tuple[int, int]], n: int) -> float:
        if self.weights is None:
            return self.prior
        k, w = len(self.chosen), self.weights
        total = self.bias + float(w[-1]) * np.log1p(n) / 5
        for i, c in found:
            total += float(w[i]) * np.log1p(c) + float(w[k + i]) * 100 * c / (n + 20)
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, most: int = FEATURES) -> tuple[CharacterModel, Scorer]:
    """The character model over all ``docs`` (id, text), the scorer on labelled rows (doc_id, label) that aren't held out."""
    spark = docs.sparkSession
    model = CharacterModel(count_trigrams(docs.select("text")))
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    truth = spark.sparkContext.broadcast({r["doc_id"]: r["y"] for r in rows})
    # what a worker remembers of tokens stays from task to task
    shared = spark.sparkContext.broadcast(Reader(model))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value
        for batch in batches(rows):
            ids = batch.column("id").to_pylist()
            own = [i for i, x in enumerate(ids) if x in truth.value]
            if not own:
                continue
            texts = batch.column("text").take(pa.array(own)).to_pylist()
            read = [reader.counts(t) for t in texts]
            columns = [pa.array([truth.value[ids[i]] for i in own], pa.int32()), pa.array([n for _, n in read], pa.int64()), pa.array([list(c) for c, _ in read], pa.list_(pa.string())), pa.array([list(c.values()) for c, _ in read], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["y", "n", "words", "counts"])

    seen = stash(docs.mapInArrow(read, "y int, n long, words array<string>, counts array<long>"))

    def tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[dict[str, int], dict[str, int]] = {}, {}
        docs_with: Counter[str] = Counter()
        for batch in batches(rows):
            for y, words, counts in zip(*(batch.column(c).to_pylist() for c in ("y", "words", "counts")), strict=True):
                own, total = features(dict(zip(words, counts, strict=True))), by[y]
                for f, c in own.items():
                    total[f] = total.get(f, 0) + (c if c < 5 else 5)
                if y:
                    docs_with.update(own.keys())
        found = list({*by[0], *by[1]})
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c.get(f, 0) for f in found], pa.int64()) for c in (by[1], by[0], docs_with))], ["f", "c1", "c0", "d1"])

    sizes = {r["y"]: (r["n"], r["rows"]) for r in seen.groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    (n0, rows0), (n1, rows1) = sizes.get(0, (0, 0)), sizes.get(1, (0, 0))
    prior = rows1 / (rows0 + rows1) if rows0 + rows1 else 0.0
    if not (n0 and n1):
        return model, Scorer([], [], prior)
    # the likelihood ratio of a rate of its own in each class against one for both
    c1, c0 = F.col("c1"), F.col("c0")
    rate = (c1 + c0) / float(n0 + n1)
    part = lambda c, n: F.when(c > 0, c * F.log(c / (rate * float(n)))).otherwise(0.0)
    counts = seen.mapInArrow(tally, "f string, c1 long, c0 long, d1 long").groupBy("f").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), F.sum("d1").alias("d1"))
    ratio = counts.where((F.col("d1") >= 3) & (c1 / float(n1) > c0 / float(n0))).withColumn("ratio", part(c1, n1) + part(c0, n0))
    # of features with the very same counts (a word and its beginnings), the longest, and of equally long ones the whole word
    longest = F.max_by("f", F.struct(F.length(F.rtrim("f", F.lit("~"))), ~F.col("f").endswith("~"), "f"))
    one = ratio.groupBy("c1", "c0", "d1", F.substring("f", 1, 3)).agg(longest.alias("f"), F.max("ratio").alias("ratio"))
    chosen = [r["f"] for r in one.orderBy(F.desc("ratio"), "f").limit(most).collect()]
    listed = spark.sparkContext.broadcast(chosen)

    def vectors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Scorer(listed.value, [], 0.0)
        for batch in batches(rows):
            found = [finder.found(Counter(dict(zip(w, c, strict=True)))) for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            columns = [batch.column("y"), batch.column("n"), pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[c for _, c in x] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["y", "n", "at", "counts"])

    drawn = seen.mapInArrow(vectors, "y int, n long, at array<int>, counts array<long>").collect()  # ``sample`` rows at most
    fitted = sorted((r["y"], r["n"], tuple(r["at"]), tuple(r["counts"])) for r in drawn)
    return model, Scorer(chosen, [(y, list(zip(at, c, strict=True)), n) for y, n, at, c in fitted], prior)


def toxicity(documents: DataFrame, labels: DataFrame, path: str = "doc_id", text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The documents' columns with score and predicted, which replace columns of the same names."""
    docs = documents.select(F.col(path).alias("id"), body(text).alias("text"))
    model, scorer = train(docs, labels)
    # what a worker remembers of tokens stays from task to task
    shared = documents.sparkSession.sparkContext.broadcast((Reader(model), scorer))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, scorer = shared.value
        for batch in batches(rows):
            scores = [scorer.score(*x) for x in scorer.find_all(reader, batch.column("body").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    # the row goes as one value, so that its columns can have any names
    whole = documents.select(F.struct(*documents.columns).alias("row"), body(text).alias("body"))
    scored = whole.mapInArrow(run, StructType().add("row", whole.schema["row"].dataType).add("score", "double"))
    own = [F.col("row")[c].alias(c) for c in documents.columns if c not in (score, predicted)]
    return scored.select(*own, F.col("score").alias(score), (F.col("score") >= THRESHOLD).cast("int").alias(predicted))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out, its score, the prediction."""
    found = toxicity(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
