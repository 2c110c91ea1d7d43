"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces. Each
path has a probability in proportion to the product of its pieces' weights. Perturbing
every path's log-probability with Gumbel noise and taking the k largest gives k distinct
segmentations, drawn without replacement. They are found best first, as in A* sampling:

- backward sums give every lattice node the exact weight of what follows it, so a path
  can be drawn edge by edge and its bound is exact;
- the best path takes the root's Gumbel; at each of its steps, the paths that leave it
  there form a region whose best value is a Gumbel truncated at the path's own;
- the region with the largest value is opened next: its path is drawn, and its own
  regions join the frontier. The value of the first region left unopened is the
  threshold from which inclusion probabilities follow.

No piece crosses the start of a word, so lattices are built once for each distinct word.
Random numbers are functions of the row key, the sample, the word and the step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.ppm import KeyTable

SPACE = "▁"
#: Stands for a literal U+2581 in the lattice; a lone surrogate is in no valid text.
LITERAL = "\ud800"
#: Distinct segmentations drawn a text (fewer where a text has fewer).
SAMPLES = 2
#: Exponent on the pieces' weights: above 1 favours likely segmentations.
SHARPNESS = 1.0
#: Log-weight of a byte piece, below every other piece's.
BYTE_WEIGHT = -11.0
#: Lattice nodes that a worker keeps for reuse before it starts afresh.
CACHE_NODES = 1_600_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Before a word that follows a line end, in the list of a plain text's words: it has no mark.
BARE = "\udc00"


@dataclass
class Vocabulary:
    """Pieces by id, their log-weights, and the ids of the 256 bytes."""

    pieces: list[str]
    weights: np.ndarray
    usable: np.ndarray  # bool: ordinary pieces
    byte_ids: np.ndarray


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """Reads a BPE model file with byte pieces.

    Its scores are merge ranks, not log-probabilities, so a piece of rank r gets the weight
    r ** -SHARPNESS (Zipf's law). Pieces must not hold a space mark after another character
    nor a line end: the lattice is cut there.
    """
    if "://" in path:
        proto = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        proto = Path(path).read_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int32)
    usable = np.zeros(n, bool)
    weights = np.zeros(n)
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {i} crosses a boundary of the lattice")
            usable[i] = True
            weights[i] = -SHARPNESS * np.log(1.0 - sp.get_score(i))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    return Vocabulary(pieces, weights, usable, byte_ids)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit state for each combination of integer parts."""
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = _mix(x * _BASE + np.atleast_1d(p).astype(np.uint64) + np.uint64(1))
    return x


def _uniform(*parts: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1), each a function of its integer parts."""
    return ((_seeded(*parts) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


#: Largest standard Gumbel that such a number gives: -log(-log(1 - 2^-54)).
GUMBEL_MAX = 37.5


def split_words(text: str) -> list[str]:
    """The words of a text, none of which a piece can cross the start of.

    Spaces are marks, one mark goes in front, as the model's own normaliser does. Most texts
    have single spaces only; their words stand without their mark, those that have none
    after BARE, and are found by plain splitting.
    """
    if SPACE not in text:
        plain = text.replace("\n", f" \n {BARE}").replace(f"{BARE} ", "")
        plain = plain.removeprefix(" ") if text.startswith("\n") else plain
        plain = plain.removesuffix(f" {BARE}")
        if "  " not in plain and not text.startswith((" ", "\n")) and not text.endswith(" "):
            return plain.split(" ")
    marked = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
    return [w[1:] if w[0] == SPACE and w[1:2] not in ("", SPACE, "\n") else w if w[0] in (SPACE, "\n") else BARE + w for w in _CHUNK.findall(marked)]


def lattice_form(word: str) -> str:
    """A word of split_words() with its mark."""
    return word[1:] if word[0] == BARE else word if word[0] in (SPACE, "\n") else SPACE + word


class Lattices:
    """Lattices of distinct words, with the conditional edge probabilities of every node.

    Node i of a word stands before its i-th character. prob[node, l - 1] is the probability
    of the edge over l characters, piece[node, l - 1] its piece (-2: the bytes of one
    character the vocabulary lacks).
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        ids = np.flatnonzero(vocab.usable)
        self.longest = max(len(vocab.pieces[i]) for i in ids)
        # hashes of all pieces and of their beginnings, of which most have no id of their own
        size = np.array([len(vocab.pieces[i]) for i in ids])
        keys, of = [], []
        for n in np.unique(size):
            mine = ids[size == n]
            chars = np.frombuffer("".join(vocab.pieces[i] for i in mine).encode("utf-32-le"), np.uint32).reshape(-1, n)
            run = np.zeros(len(mine), np.uint64)
            for k in range(n):
                run = run * _BASE + chars[:, k].astype(np.uint64) + np.uint64(1)
                keys.append(_mix(run + np.uint64(k + 1)))
                of.append(mine if k + 1 == n else np.full(len(mine), -1))
        keys, of = np.concatenate(keys), np.concatenate(of)
        order = np.lexsort((-of, keys))  # of equal strings the piece first
        first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - np.uint64(1)) != 0)
        self.table, self.ids = KeyTable(keys[order[first]]), of[order[first]]
        narrow = len(vocab.pieces) < 1 << 15
        self.cum = np.empty((CACHE_NODES, self.longest), np.float32)
        self.prob = np.empty((CACHE_NODES, self.longest), np.float32)
        self.piece = np.empty((CACHE_NODES, self.longest), np.int16 if narrow else np.int32)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of each word
        self.first = np.zeros(1 << 12, np.int64)  # by word: its first node
        self.size = np.zeros(1 << 12, np.int64)  # its length
        self.uses = np.zeros(1 << 12, np.int64)  # and how often it was met
        self.used = 0
        self.bytes: dict[int, str] = {}

    def add(self, words: list[str]) -> None:
        """Builds the lattices of words not seen before, some of one length at a time."""
        forms = list(map(lattice_form, words))
        sizes = np.fromiter(map(len, forms), np.int64, len(forms))
        need = self.used + int(sizes.sum())
        if need > len(self.cum):  # one batch of very long words
            for name in ("cum", "prob", "piece"):
                old = getattr(self, name)
                new = np.empty((need, self.longest), old.dtype)
                new[: self.used] = old[: self.used]
                setattr(self, name, new)
        while len(self.number) + len(words) > len(self.first):
            self.first, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.uses))
        order = np.argsort(sizes, kind="stable")
        words, forms, sizes = [words[i] for i in order.tolist()], [forms[i] for i in order.tolist()], sizes[order]
        lo, base = 0, len(self.number)
        self.number.update(zip(words, range(base, base + len(words)), strict=True))
        self.size[base : base + len(words)] = sizes
        self.first[base : base + len(words)] = self.used + np.cumsum(sizes) - sizes
        while lo < len(words):
            n = int(sizes[lo])
            hi = min(int(np.searchsorted(sizes, n, "right")), lo + max(1, (1 << 14) // n))
            self._build(forms[lo:hi], n)
            lo = hi

    def _build(self, words: list[str], n: int) -> None:
        """Lattices of words of n characters each; arrays are by character, piece length, word."""
        only = len(words) == 1
        if only:  # sums over a single column round otherwise than over several
            words = words * 2
        m = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        chars = (codes.T.astype(np.uint64) + np.uint64(1)).ravel()
        alive, run, found = np.arange(n * m), chars, []
        for k in range(1, min(self.longest, n) + 1):
            if k > 1:  # only what began a piece so far goes on
                alive = alive[: np.searchsorted(alive, (n - k + 1) * m)]
                run = run[: len(alive)] * _BASE + chars[alive + (k - 1) * m]
            row = self.table.find(_mix(run + np.uint64(k)))
            hit = np.flatnonzero(row >= 0)
            alive, run, got = alive[hit], run[hit], self.ids[row[hit]]
            whole = np.flatnonzero(got >= 0)
            found.append((alive[whole], got[whole]))
        wide = max(1, *(k + 1 for k, (x, _) in enumerate(found) if len(x)), 1)
        piece = np.full((n, wide, m), -1, self.piece.dtype)
        p = np.full((n, wide, m), -np.inf, np.float32)  # weights, then conditional probabilities
        for k, (x, got) in enumerate(found[:wide]):
            at, word = np.divmod(x, m)
            piece[at, k, word] = got
            p[at, k, word] = self.vocab.weights[got]
        keep = 1 if only else m
        for i, word in np.argwhere(piece[:, 0] < 0).tolist():  # every character can be passed: by its bytes if need be
            char = chr(codes[word, i])
            char = SPACE if char == LITERAL else char
            if word < keep:
                self.bytes[self.used + word * n + i] = char
            piece[i, 0, word] = -2
            p[i, 0, word] = BYTE_WEIGHT * len(char.encode("utf-8", "surrogatepass"))
        # backward sums from the words' ends, whose weight is 1
        beta = np.zeros((n + 1, m), np.float32)
        for i in range(n - 1, -1, -1):
            k = min(wide, n - i)
            x = p[i, :k]
            x += beta[i + 1 : i + k + 1]
            top = x.max(axis=0)
            x -= top
            np.exp(x, out=x)
            total = x.sum(axis=0)
            x /= total
            p[i, k:] = 0
            beta[i] = top + np.log(total)
        c = np.cumsum(p, axis=1)
        c[c >= c[:, -1:]] = 2.0  # rounding never passes the last edge
        there = slice(self.used, self.used + n * keep)
        for name, x in (("prob", p), ("cum", c), ("piece", piece)):
            getattr(self, name)[there, :wide] = x[:, :, :keep].transpose(2, 0, 1).reshape(n * keep, wide)
        self.prob[there, wide:], self.cum[there, wide:] = 0, 2.0
        self.used += n * keep

    def make_room(self, keep: int = 2) -> None:
        """Forgets the words met once, and, while the rest fills more than a third of the tables, those
        met less often than others."""
        n = len(self.number)
        order = np.argsort(-self.uses[:n], kind="stable")
        order = order[: int(np.searchsorted(-self.uses[order], -keep, "right"))]
        order = np.sort(order[: int(np.searchsorted(np.cumsum(self.size[order]), CACHE_NODES // 3, "right"))])
        size = self.size[order]
        new = np.cumsum(size) - size
        total = int(size.sum())
        rows = np.repeat(self.first[order] - new, size) + np.arange(total)
        for name in ("cum", "prob", "piece"):
            whole = getattr(self, name)
            whole[:total] = whole[rows]
        at = {int(self.first[k]): (int(a), int(z)) for k, a, z in zip(order, new, size, strict=True)} if self.bytes else {}
        starts = np.array(sorted(at), np.int64)
        old, self.bytes = self.bytes, {}
        for node, char in old.items():
            i = int(np.searchsorted(starts, node, "right")) - 1
            if i >= 0 and node - (start := int(starts[i])) < at[start][1]:
                self.bytes[at[start][0] + node - start] = char
        words = list(self.number)
        self.number = {words[k]: i for i, k in enumerate(order.tolist())}
        self.first[: len(order)], self.size[: len(order)], self.uses[: len(order)] = new, size, self.uses[order] // 2
        self.uses[len(order) :] = 0
        self.used = total

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First node and last node + 1 of every word, text by text, and each text's words."""
        split = [split_words(t) for t in texts]
        words = list(chain.from_iterable(split))
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(number < 0)
        if len(lacking):
            new = {words[i] for i in lacking.tolist()}
            if self.used + sum(map(len, new)) + len(new) > CACHE_NODES and self.used:  # with their marks
                self.make_room()
                new = {w for w in words if w not in self.number}
                self.add(list(new))
                number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            else:
                self.add(list(new))
                number[lacking] = [self.number[words[i]] for i in lacking.tolist()]
        self.uses[: len(self.number)] += np.bincount(number, minlength=len(self.number))
        first = self.first[number]
        return first, first + self.size[number], np.array([len(x) for x in split])

    def draw(self, node: np.ndarray, end: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each node to its end: (number of steps, edges), the paths one
        after the other. An edge is its place in the tables. `key` seeds each path."""
        at, alive, k = node.copy(), np.flatnonzero(node < end), 0
        state = np.broadcast_to(_seeded(*key), len(node))
        steps = np.zeros(len(node), np.int64)
        took = []
        while len(alive):
            u = (_mix(state[alive] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            here = at[alive]
            skip = np.count_nonzero(self.cum.take(here, axis=0) <= u[:, None], axis=1)
            took.append((alive, here * self.longest + skip))
            here += skip + 1
            at[alive] = here
            steps[alive] = k + 1
            alive = alive[here < end[alive]]
            k += 1
        start = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), np.int64)
        for k, (who, edge) in enumerate(took):
            edges[start[who] + k] = edge
        return steps, edges

    def log_q(self, edges: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each edge."""
        return np.log(self.prob.reshape(-1).take(edges)).astype(np.float64)


@dataclass
class Segmentation:
    """A path: its edges, the word of each, their log-probabilities, the perturbed score."""

    edge: np.ndarray
    word: np.ndarray
    log_q: np.ndarray
    score: float


def _truncated(log_mass: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Largest perturbed value of regions of the given log mass, given that it is below `top`."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, -np.logaddexp(-top, np.log(-np.log(u)) - log_mass))


def _regions(lattices: Lattices, paths: list[Segmentation], since: np.ndarray, keys: np.ndarray, turn: int, k: int, first: int = 400) -> list[np.ndarray]:
    """For each path the values of the regions that leave it at each step from `since` on.

    A region's value is its log mass plus a bounded Gumbel, and the mass shrinks along the
    path. Steps whose bound lies below k values already at hand can't be opened and are
    left out; if `first` steps don't settle that, more are taken.
    """
    ends = np.array([len(p.edge) for p in paths])
    stop = np.minimum(ends, since + first)
    n = stop - since
    cut = np.cumsum(n) - n
    of = np.repeat(np.arange(len(paths)), n)
    q = lattices.prob.reshape(-1).take(np.concatenate([p.edge[a:b] for p, a, b in zip(paths, since, stop, strict=True)])).astype(np.float64)
    log_q = np.concatenate([p.log_q[a:b] for p, a, b in zip(paths, since, stop, strict=True)])
    ahead = np.array([p.log_q[:a].sum() for p, a in zip(paths, since, strict=True)])
    place = np.arange(len(of)) - cut[of]
    grid = np.zeros((len(paths), int(n.max(initial=0))))  # a row a path, so that a path's sums don't depend on its neighbours
    grid[of, place] = log_q
    before = (np.cumsum(grid, axis=1) - grid)[of, place] + ahead[of]
    with np.errstate(divide="ignore"):
        mass = before + np.log(np.where(q >= 1.0, 0.0, 1.0 - q))
    step = place + since[of]
    value = _truncated(mass, np.array([p.score for p in paths])[of], _uniform(keys[of], np.uint64(1000 + turn), step.astype(np.uint64)))
    out, more = [], []
    for i, p in enumerate(paths):
        mine = value[cut[i] : cut[i] + n[i]]
        if stop[i] < ends[i]:
            bound = before[cut[i] + n[i] - 1] + log_q[cut[i] + n[i] - 1] + GUMBEL_MAX
            if np.count_nonzero(mine > bound) <= k:
                more.append(i)
        # steps before `since` belong to the paths this one shares its beginning with
        out.append(np.concatenate([np.full(since[i], -np.inf), mine]))
    if more:
        again = _regions(lattices, [paths[i] for i in more], since[more], keys[more], turn, k, 4 * first)
        for i, x in zip(more, again, strict=True):
            out[i] = x
    return out


def sample_segmentations(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int = SAMPLES) -> list[tuple[list[Segmentation], float]]:
    """For each text (none empty) up to k distinct segmentations, best first, and the
    value of the first one not drawn (-inf if there is none)."""
    node, end, count = lattices.chunks(texts)
    width = lattices.longest
    doc = np.repeat(np.arange(len(texts)), count)
    base = np.cumsum(count) - count
    word = np.arange(len(doc)) - base[doc]
    keys = keys.astype(np.uint64)

    # the best path of every text
    steps, edge = lattices.draw(node, end, keys[doc], np.zeros(1, np.uint64), word.astype(np.uint64))
    q, of_word = lattices.log_q(edge), np.repeat(word, steps)
    size = np.add.reduceat(steps, base)
    cut = np.cumsum(size) - size
    best = -np.log(-np.log(_uniform(keys, np.uint64(999))))
    found = [[Segmentation(edge[a : a + n], of_word[a : a + n], q[a : a + n], float(g))] for a, n, g in zip(cut, size, best, strict=True)]
    #: a text's frontier: for each of its paths, the values of the regions along it
    frontier = [[x] for x in _regions(lattices, [f[0] for f in found], np.zeros(len(texts), np.int64), keys, 0, k)]
    closed: list[dict[tuple[int, int], list[int]]] = [{} for _ in texts]  # (path, step) -> edges used there

    for turn in range(1, k):
        u_pick, u_left = _uniform(keys, np.uint64(2000 + turn)), _uniform(keys, np.uint64(3000 + turn))
        opened = []
        for d, values in enumerate(frontier):
            steps_at = [int(x.argmax()) if len(x) else -1 for x in values]
            tops = [x[j] if j >= 0 else -np.inf for x, j in zip(values, steps_at, strict=True)]
            i = int(np.argmax(tops))
            if np.isneginf(tops[i]):
                continue
            j, path, value = steps_at[i], found[d][i], float(tops[i])
            at = int(path.edge[j]) // width
            used = closed[d].setdefault((i, j), [int(path.edge[j])])
            p = lattices.prob[at].astype(np.float64)
            p[[x % width for x in used]] = 0.0
            total = np.cumsum(p)
            pick = min(int(np.searchsorted(total, u_pick[d] * total[-1], "right")), int(np.flatnonzero(p)[-1]))
            used.append(at * width + pick)
            p[pick] = 0.0
            with np.errstate(divide="ignore"):
                left = np.log(p.sum()) + path.log_q[:j].sum()
            values[i][j] = _truncated(np.array([left]), value, u_left[d : d + 1])[0]
            opened.append((d, path, j, at * width + pick, value))
        if not opened:
            break
        # the rest of each new path: its word from the forced edge on, then the words that follow
        d_of = np.array([o[0] for o in opened])
        begin = base[d_of] + [o[1].word[o[2]] for o in opened]
        n = base[d_of] + count[d_of] - begin
        heads = np.cumsum(n) - n
        which = np.repeat(np.arange(len(opened)), n)
        occ = np.arange(len(which)) - heads[which] + begin[which]
        start = node[occ]
        start[heads] = [o[3] // width + o[3] % width + 1 for o in opened]
        steps, edge = lattices.draw(start, end[occ], keys[doc[occ]], np.full(1, turn, np.uint64), word[occ].astype(np.uint64))
        q, of_word = lattices.log_q(edge), np.repeat(word[occ], steps)
        size = np.add.reduceat(steps, heads)
        cut = np.cumsum(size) - size
        forced = lattices.log_q(np.array([o[3] for o in opened]))
        paths = []
        for (_, path, j, e, value), f, a, m in zip(opened, forced, cut, size, strict=True):
            s = slice(a, a + m)
            paths.append(Segmentation(np.concatenate([path.edge[:j], [e], edge[s]]), np.concatenate([path.word[: j + 1], of_word[s]]), np.concatenate([path.log_q[:j], [f], q[s]]), value))
        more = _regions(lattices, paths, np.array([o[2] + 1 for o in opened]), keys[d_of], turn, k)
        for d, p, x in zip(d_of, paths, more, strict=True):
            found[d].append(p)
            frontier[d].append(x)
    rest = [max((float(x.max()) for x in xs if len(x)), default=-np.inf) for xs in frontier]
    return list(zip(found, rest, strict=True))


def path_ids(lattices: Lattices, paths: list[Segmentation]) -> list[np.ndarray]:
    """Piece ids of each path; a character the vocabulary lacks gives the ids of its bytes."""
    ids = lattices.piece.reshape(-1).take(np.concatenate([p.edge for p in paths])).astype(np.int32)
    stop = np.cumsum([len(p.edge) for p in paths])
    out = [ids[z - len(p.edge) : z] for p, z in zip(paths, stop.tolist(), strict=True)]
    byte = lattices.vocab.byte_ids
    for j in np.unique(np.searchsorted(stop, np.flatnonzero(ids < 0), "right")).tolist():
        mine, edge, parts, last = out[j], paths[j].edge, [], 0
        for i in np.flatnonzero(mine < 0).tolist():
            char = lattices.bytes[int(edge[i]) // lattices.longest]
            parts += [mine[last:i], byte[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]]
            last = i + 1
        out[j] = np.concatenate([*parts, mine[last:]]).astype(np.int32)
    return out


def decode(vocab: Vocabulary, ids) -> str:
    """The text of piece ids: byte pieces are joined to characters, marks are spaces, the
    first mark goes."""
    if not len(ids):
        return ""
    flat, start, size = _decoded(vocab)
    ids = np.asarray(ids)
    n = size[ids]
    stop = np.cumsum(n, dtype=np.int64)
    at = np.repeat((start[ids] - stop + n).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    text = flat.take(at).tobytes().decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _decoded(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that pieces decode to, one piece after the other, and each piece's first and number."""
    if not hasattr(vocab, "_bytes"):
        each = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in vocab.pieces]
        for value, i in enumerate(vocab.byte_ids.tolist()):
            each[i] = bytes([value])
        size = np.array([len(x) for x in each], np.int32)
        vocab._bytes = np.frombuffer(b"".join(each), np.uint8), np.cumsum(size, dtype=np.int32) - size, size
    return vocab._bytes


def inclusion(log_p: float, threshold: float) -> float:
    """Probability that a segmentation is among the drawn, given the threshold."""
    return 1.0 if np.isneginf(threshold) else float(-np.expm1(-np.exp(min(log_p - threshold, 700.0))))


def encode_batch(lattices: Lattices, texts: list[str | None], keys: np.ndarray, k: int = SAMPLES) -> list[list[dict] | None]:
    """For each text its samples (ids, log_prob, score, inclusion); null for null; one
    sample without ids for the empty text."""
    out: list[list[dict] | None] = [None if t is None else [{"ids": np.zeros(0, np.int32), "log_prob": 0.0, "score": 0.0, "inclusion": 1.0}] for t in texts]
    full = [i for i, t in enumerate(texts) if t]
    lo = 0
    while lo < len(full):  # bounded by characters; one text is never cut
        hi, chars = lo, 0
        while hi < len(full) and (hi == lo or chars + len(texts[full[hi]]) < 400_000):
            chars += len(texts[full[hi]])
            hi += 1
        part = full[lo:hi]
        drawn = sample_segmentations(lattices, [texts[i] for i in part], keys[part], k)
        ids = iter(path_ids(lattices, [p for paths, _ in drawn for p in paths]))
        for i, (paths, threshold) in zip(part, drawn, strict=True):
            out[i] = []
            for p in paths:
                log_p = float(p.log_q.sum())
                out[i].append({"ids": next(ids), "log_prob": log_p, "score": p.score, "inclusion": inclusion(log_p, threshold)})
        lo = hi
    return out


SAMPLE_TYPE = "array<struct<ids:array<int>,log_prob:double,score:double,inclusion:double>>"


def encode_documents(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = 1) -> DataFrame:
    """One row per input row: id, samples (up to k distinct segmentations, best perturbed
    score first: ids, log_prob, score, inclusion), round_trip (every sample decodes to the
    text).

    Null texts have null samples and a true round trip; the empty text has one sample
    without pieces. Rows of equal id and text get equal samples; null ids are seeded alike.
    Whole texts are encoded; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not hasattr(shared.value, "_lattices"):  # a worker keeps its lattices from task to task
            shared.value._lattices = Lattices(shared.value)
        lattices = shared.value._lattices
        struct = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("score", pa.float64()), ("inclusion", pa.float64())])
        for whole in batches:
            for b in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                texts = b.column(1).to_pylist()
                keys = np.array([0 if i is None else i & 0xFFFFFFFFFFFFFFFF for i in b.column(0).to_pylist()], np.uint64) * _BASE + np.uint64(seed)
                found = encode_batch(lattices, texts, keys, k)
                same = [t is None or all(decode(shared.value, s["ids"]) == t for s in x) for t, x in zip(texts, found, strict=True)]
                flat = [s for x in found if x is not None for s in x]
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s["ids"]) for s in flat])]).astype(np.int32), pa.array(np.concatenate([s["ids"] for s in flat] or [np.zeros(0, np.int32)])))
                each = pa.StructArray.from_arrays([ids, *(pa.array([s[n] for s in flat], pa.float64()) for n in ("log_prob", "score", "inclusion"))], fields=list(struct))
                offsets = pa.array(np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in found])]).astype(np.int32))
                samples = pa.ListArray.from_arrays(offsets, each, mask=pa.array([x is None for x in found]))
                yield pa.RecordBatch.from_arrays([b.column(0), samples, pa.array(same, pa.bool_())], names=["id", "samples", "round_trip"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id long, samples {SAMPLE_TYPE}, round_trip boolean").withColumnRenamed("id", id_col)
