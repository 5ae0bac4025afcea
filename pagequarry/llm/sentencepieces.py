"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

The segmentations of a text are the paths of its lattice: every vocabulary piece at every place, and the bytes of
characters the vocabulary lacks.  A path has the weight ``prod (1 + merge rank of the piece) ** -theta``.  Backward
filtering gives the exact probability of each piece at each place; no piece crosses a space, a line end or a tab, so
the lattice of a text is the chain of its words' lattices, which are built once per distinct word and kept in a bounded
cache, if more than one batch has them.

Sampling is an A* search over prefixes.  A prefix's perturbed score is the largest Gumbel-perturbed log-probability of the
paths through it.  The best path is followed to its end; at every word it leaves aside all other segmentations of that
word, whose best perturbed score is one Gumbel value below the path's (located at the log of their joint probability, so
it need not be split until it is wanted).  The best of what was left aside opens the next path: one of the word's other
segmentations is drawn, and the words after it are drawn anew.  Paths come out in falling perturbed score, distinct: a
sample without replacement.  With the next score left as threshold, a path's inclusion score is
``1 - exp(-exp(log_prob - threshold))``.  That of a long text is too small for a number, so its logarithm is returned as well.
A word's other segmentations are taken for none if their joint probability is below 1e-12.

All words of a batch of texts take their steps together in numpy.  Random numbers depend on the row's key and the place
in its text only, so a row's samples are the same in any batch, task or attempt.

Edge cases: null texts count as empty; an empty text is its prefix space alone; a text with fewer segmentations than
asked for gives all of them, with inclusion score 1; the piece mark (U+2581) in a text is kept apart from spaces as bytes,
so decoding is exact; null keys count as the empty key, and rows of equal key and text get equal samples; columns called
like the output are replaced, others are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Places that a task's cache of word lattices may hold, and characters that are stepped together.
CACHE_NODES = 700_000
BATCH_CHARS = 200_000
#: Hash classes of words, by which a cache knows what it has built before.
SEEN_CLASSES = 1 << 22
#: Edges up to which a cleared cache keeps its arrays.
KEPT_EDGES = 1 << 22
#: A word with the spaces before it, spaces before a line end or tab, or one of these.
_CHUNKS = re.compile(r" *[^ \n\t]+| +|[\n\t]")

SAMPLES = "array<struct<ids: array<int>, log_prob: double, inclusion: double, log_inclusion: double, exact: boolean>>"


class Vocabulary:
    """Pieces with their ids and log-weights, and the ids of the 256 bytes."""

    def __init__(self, model_path: str, theta: float = 1.0):
        import sentencepiece

        self.key = model_path, theta
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {}
        self.weight: dict[str, tuple[int, float]] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.weight[piece] = i, -theta * math.log1p(min(size, max(0.0, -model.get_score(i))))
        if any(MARK in p.lstrip(MARK) or set(p) & set("\n\t ") for p in self.weight):
            raise ValueError("pieces across spaces, line ends or tabs are not supported")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary needs byte pieces")
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.byte_weight = -theta * math.log1p(size)
        self.longest = max(map(len, self.weight))

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for; the piece mark is a space."""
        return [self.bytes_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]


def _marked(text: str) -> str:
    """A text without ``\\1``, and with its prefix space, as its words with ``\\1`` between them (or several of it)."""
    text = " " + text
    if "  " in text:
        return "\1".join(_CHUNKS.findall(text))
    return text.replace(" ", "\1 ").replace("\n", "\1\n\1").replace("\t", "\1\t\1")


def words_of(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts one after another, and how many each text has; joined, a text's words are its prefix space
    and the text."""
    if any("\1" in t for t in texts):
        chunks = [_CHUNKS.findall(" " + t) for t in texts]
        flat = pa.array([w for c in chunks for w in c], pa.large_string())
        return flat.dictionary_encode(), np.array([len(c) for c in chunks], np.int64)
    lists = pc.split_pattern(pa.array([_marked(t) for t in texts], pa.large_string()), "\1")
    flat = lists.flatten()
    filled = np.asarray(pc.binary_length(flat)) > 0
    words = np.append(0, np.cumsum(filled))[np.asarray(lists.offsets).astype(np.int64)]
    return flat.filter(pa.array(filled)).dictionary_encode(), np.diff(words)


class Lattices:
    """Lattices of words in flat arrays: a node is a place in a word, its edges are the pieces that start there."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        states, found = {"": 0}, {}  # the vocabulary's prefixes, numbered
        for piece in vocabulary.weight:
            for i in range(1, len(piece) + 1):
                if piece[:i] not in states:
                    states[piece[:i]] = len(states)
        keys = np.array([states[p[:-1]] << 21 | ord(p[-1]) for p in states if p], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array([states[p] for p in states if p])[order], 0)
        # the same steps by table for ASCII and the mark (in the place of the space); row 0 has none
        source, char, to = self.keys[:-1] >> 21, self.keys[:-1] & (1 << 21) - 1, self.to[:-1]
        parents = np.unique(source)
        self.row = np.zeros(len(states), np.int32)
        self.row[parents] = np.arange(1, len(parents) + 1)
        self.ascii = np.zeros((len(parents) + 1, 128), np.int32)
        slot = np.where(char == ord(MARK), 32, char)
        self.ascii[self.row[source[slot < 128]], slot[slot < 128]] = to[slot < 128]
        self.token_of, self.weight_of = np.full(len(states), -1, np.int64), np.zeros(len(states))
        for piece, (token, weight) in vocabulary.weight.items():
            self.token_of[states[piece]], self.weight_of[states[piece]] = token, weight
        self.width = vocabulary.longest
        self._empty()
        self.clear()

    def _empty(self):
        self.first = np.zeros(1 << 16, np.int64)
        self.logp, self.cumulated = np.zeros(1 << 18), np.zeros(1 << 18)
        self.next, self.token = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)

    def clear(self):
        """Forget all words.  The arrays stay for the next ones, unless they are very large."""
        self.roots: dict[str, int] = {}
        self.spelled: list[list[int]] = []  # ids of the edges that are several byte pieces
        self.nodes = self.edges = 0
        self.seen, self.lasting = np.zeros(SEEN_CLASSES, bool), (0, 0, 0)
        if len(self.logp) > KEPT_EDGES:
            self._empty()

    def _room(self, nodes: int, edges: int):
        for names, need in ((("first",), self.nodes + nodes), (("logp", "cumulated", "next", "token"), self.edges + edges)):
            for name in names:
                old = getattr(self, name)
                if need > len(old):
                    grown = np.zeros(max(need, 2 * len(old)), old.dtype)
                    grown[:len(old)] = old
                    setattr(self, name, grown)

    def build(self, words: list[str]) -> dict[str, int]:
        """Roots of new words.  What a batch has for the first time goes with it, what comes again stays in ``roots``."""
        classes = np.fromiter(map(hash, words), np.int64, len(words)) & (SEEN_CLASSES - 1)
        again = self.seen[classes]
        self.seen[classes] = True
        built = self.add(list(compress(words, again)))
        self.roots |= built
        self.lasting = self.nodes, self.edges, len(self.spelled)
        return built | self.add(list(compress(words, ~again)))

    def forget(self) -> None:
        """Leave out the words of the last batch that do not stay; all, if a very long text has made the arrays large."""
        self.nodes, self.edges, spelled = self.lasting
        del self.spelled[spelled:]
        if len(self.logp) > KEPT_EDGES:
            self.clear()

    def add(self, words: list[str]) -> dict[str, int]:
        """Build the lattices of new words, all at once; their roots."""
        if not words:
            return {}
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        coded = np.where(chars == 32, ord(MARK), np.where(chars == ord(MARK), (1 << 21) - 1, chars))  # a mark in the text matches no piece
        n = len(chars)
        end_of = np.repeat(np.cumsum(sizes), sizes)
        # all places walk down the vocabulary's prefixes together
        at, state, place = np.arange(n), np.zeros(n, np.int64), np.arange(n)
        found = []
        single = np.zeros(n, bool)
        for length in range(1, self.width + 1):
            char = chars[place]
            to = self.ascii[self.row[state], np.minimum(char, 127)].astype(np.int64)
            wide = np.nonzero(char > 126)[0]
            if len(wide):
                key = state[wide] << 21 | coded[place[wide]]
                hit = np.searchsorted(self.keys, key)
                to[wide] = np.where(self.keys[hit] == key, self.to[hit], 0)
            ok = to > 0
            at, state, place = at[ok], to[ok], place[ok] + 1
            piece = self.token_of[state] >= 0
            found.append((at[piece], place[piece], self.token_of[state[piece]], self.weight_of[state[piece]]))
            if length == 1:
                single[at[piece]] = True
            inside = place < end_of[at]
            at, state, place = at[inside], state[inside], place[inside]
            if not len(at):
                break
        lone = np.nonzero(~single)[0]  # characters without a piece are spelled in bytes
        tokens, weights = [], []
        for i in lone:
            raw = chr(chars[i]).encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                tokens.append(self.v.byte_ids[raw[0]])
            else:
                self.spelled.append([self.v.byte_ids[b] for b in raw])
                tokens.append(-len(self.spelled))
            weights.append(self.v.byte_weight * len(raw))
        found.append((lone, lone + 1, np.array(tokens, np.int64), np.array(weights, float)))
        source, target, token, weight = (np.concatenate(x[::-1]) for x in zip(*found))
        order = np.argsort(source, kind="stable")  # at each place the longest piece first
        source, target, token, weight = source[order], target[order], token[order], weight[order]
        first = np.searchsorted(source, np.arange(n))
        last_edge = np.append(first, len(source))[1:]
        # backward filtering, by the distance to the word's end
        beta = np.zeros(n + 1)
        ends = target == end_of[source]
        left = end_of - np.arange(n)
        by_left = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")  # short numbers sort faster
        cuts = np.searchsorted(left[by_left], np.arange(1, left.max() + 2))
        for lo, hi in zip(cuts, cuts[1:]):
            nodes = by_left[lo:hi]
            if not len(nodes):
                continue
            counts = last_edge[nodes] - first[nodes]
            starts = np.cumsum(counts) - counts
            edge = np.arange(counts.sum()) + np.repeat(first[nodes] - starts, counts)
            value = weight[edge] + np.where(ends[edge], 0.0, beta[target[edge]])
            top = np.maximum.reduceat(value, starts)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), starts))
        logp = weight + np.where(ends, 0.0, beta[target]) - beta[source]
        self._room(n, len(source))
        e = slice(self.edges, self.edges + len(source))
        self.first[self.nodes:self.nodes + n] = first + self.edges
        total = np.cumsum(np.exp(logp))
        before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0.0)
        cumulated = total - before[source]
        cumulated[last_edge - 1] = 2.0  # a uniform number is never above the last edge
        self.logp[e], self.cumulated[e], self.token[e], self.next[e] = logp, cumulated, token, np.where(ends, -1, target + self.nodes)
        begin = np.cumsum(sizes) - sizes + self.nodes
        self.nodes += n
        self.edges += len(source)
        return dict(zip(words, begin.tolist()))

    def edges_of(self, node: int) -> range:
        return range(self.first[node], self.first[node + 1] if node + 1 < self.nodes else self.edges)

    def other(self, root: int, taken: list[tuple[int, ...]], uniforms) -> tuple[int, ...]:
        """A path from ``root`` to the word's end that is none of ``taken``, drawn in proportion to its probability.

        All probabilities are those of going on from the prefix drawn so far: that of the prefix itself may be too small for
        a number.
        """
        node, path, counts = root, [], None
        ahead = [np.cumsum(self.logp[list(t)][::-1])[::-1] for t in taken]  # of the rest of a taken path, from each step
        along = list(range(len(taken)))  # taken paths that share the prefix
        while node >= 0:
            edges, step = self.edges_of(node), len(path)
            if len(edges) == 1:
                path.append(edges[0])
                node = int(self.next[edges[0]])
                continue
            options = []
            for edge in edges:
                rest = p = math.exp(self.logp[edge])
                through = [t for t in along if taken[t][step] == edge]
                if through:
                    rest -= sum(math.exp(ahead[t][step]) for t in through)
                    if rest < 1e-9 * p:  # all gone, or rounding: count
                        if counts is None:
                            counts = self._paths(node, len(taken) + 1)
                        after = counts[int(self.next[edge])] if self.next[edge] >= 0 else 1
                        rest = max(rest, 1e-12 * p) if len(through) < after else 0.0
                options.append((edge, rest))
            point = uniforms() * sum(o[1] for o in options)
            for edge, rest in options:
                point -= rest
                if rest and point <= 0:
                    break
            else:
                edge = next(e for e, rest in reversed(options) if rest)
            along = [t for t in along if taken[t][step] == edge]
            path.append(edge)
            node = int(self.next[edge])
        return tuple(path)

    def _paths(self, node: int, most: int) -> dict[int, int]:
        """The numbers of paths, counted up to ``most``, from a node and all places after it to the word's end."""
        last = node
        while (self.next[list(self.edges_of(last))] >= 0).any():  # every place has an edge to the next one
            last += 1
        counts: dict[int, int] = {}
        for at in range(last, node - 1, -1):
            counts[at] = min(most, sum(counts[n] if n >= 0 else 1 for n in self.next[list(self.edges_of(at))].tolist()))
        return counts


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _walk(lat: Lattices, nodes: np.ndarray, salt: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Sample a path from every node to its word's end.

    Returns ``(index, edge)`` of every step, the paths' log-probabilities and their lengths.
    """
    log_prob, length = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64)
    index, chosen = np.arange(len(nodes)), []
    while len(index):
        with np.errstate(over="ignore"):
            u = _uniform(_mix(salt[index] + np.uint64(len(chosen) + 1) * np.uint64(0x9E3779B97F4A7C15)))
        edge = lat.first[nodes]
        beyond = np.nonzero(lat.cumulated[edge] < u)[0]
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[lat.cumulated[edge[beyond]] < u[beyond]]
        log_prob[index] += lat.logp[edge]
        length[index] += 1
        chosen.append((index, edge))
        nodes = lat.next[edge]
        go = nodes >= 0
        index, nodes = index[go], nodes[go]
    return chosen, log_prob, length


def _left_aside(limit: np.ndarray, log_prob: np.ndarray, prefix: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The best perturbed score of a word's other segmentations: a Gumbel value at their joint log-probability, below ``limit``."""
    rest = -np.expm1(np.minimum(log_prob, 0.0))
    with np.errstate(divide="ignore"):
        location = prefix + np.log(np.where(rest > 1e-12, rest, 0.0))
        return np.where(np.isfinite(location), limit - np.logaddexp(0.0, np.log(-np.log(_uniform(bits))) + limit - location), -np.inf)


class _Paths:
    """One path of every text: the tokens of its words, their log-probabilities, and what each word has left aside."""

    def __init__(self, words: int):
        self.log_prob, self.left = np.zeros(words), np.full(words, -np.inf)
        self.edge, self.start, self.length = np.zeros(0, np.int64), np.zeros(words, np.int64), np.zeros(words, np.int64)


def sample_batch(lat: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """``k`` samples ``(ids, log_prob, inclusion, log_inclusion)`` of each text."""
    if lat.nodes > CACHE_NODES:
        lat.clear()
    coded, sizes = words_of(texts)
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    places = list(map(lat.roots.get, words))
    if unknown := [w for w, at in zip(words, places) if at is None]:
        built = lat.build(unknown)
        places = [built[w] if at is None else at for w, at in zip(words, places)]
    root = np.array(places, np.int64)[np.asarray(coded.indices)]
    docs, begin = len(texts), np.cumsum(sizes) - sizes
    doc_of = np.repeat(np.arange(docs), sizes)
    word_number = (np.arange(len(root)) - np.repeat(begin, sizes)).astype(np.uint64)

    def salted(number: int, words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            path = _mix(seeds + np.uint64(number + 1) * np.uint64(0xD1342543DE82EF95))
            return _mix(path[doc_of[words]] + word_number[words] * np.uint64(0x2545F4914F6CDD1D))

    def walked(path: _Paths, words: np.ndarray, salt: np.ndarray) -> None:
        """Draw the segmentations of ``words`` into ``path``."""
        steps, log_prob, length = _walk(lat, root[words], salt)
        at = len(path.edge) + np.cumsum(length) - length
        edges = np.empty(int(length.sum()), np.int64)
        for step, (index, edge) in enumerate(steps):
            edges[at[index] - len(path.edge) + step] = edge
        path.log_prob[words], path.start[words], path.length[words] = log_prob, at, length
        path.edge = np.concatenate([path.edge, edges])

    def prefixes(path: _Paths) -> np.ndarray:
        total = np.cumsum(path.log_prob) - path.log_prob
        return total - np.repeat(total[begin], sizes)

    def segmentation(path: _Paths, word: int) -> tuple[int, ...]:
        return tuple(path.edge[path.start[word]:path.start[word] + path.length[word]].tolist())

    everything = np.arange(len(root))
    score = -np.log(-np.log(_uniform(_mix(seeds))))  # the root's perturbed score; all probabilities together are 1
    path = _Paths(len(root))
    salt = salted(0, everything)
    walked(path, everything, salt)
    path.left = _left_aside(np.repeat(score, sizes), path.log_prob, prefixes(path), _mix(salt ^ np.uint64(0x5851F42D4C957F2D)))
    paths, exists, taken = [path], [np.ones(docs, bool)], {}
    threshold = np.full(docs, -np.inf)
    for number in range(1, k + 1):
        # the best of what all paths have left aside
        best = np.stack([np.maximum.reduceat(p.left, begin) for p in paths])
        parent, threshold = best.argmax(axis=0), best.max(axis=0)
        alive = np.isfinite(threshold)
        if number == k or not alive.any():
            break
        path = _Paths(len(root))
        branch = np.zeros(docs, np.int64)
        for j, old in enumerate(paths):
            mine = alive & (parent == j)
            if not mine.any():
                continue
            is_best = (old.left == np.repeat(threshold, sizes)) & np.repeat(mine, sizes)
            words = np.nonzero(is_best)[0]
            branch[doc_of[words[::-1]]] = words[::-1]
        own = np.nonzero(alive)[0]
        source = np.repeat(parent, sizes)
        shared = np.nonzero(np.repeat(alive, sizes) & (everything < np.repeat(branch, sizes)))[0]
        for j, old in enumerate(paths):
            w = shared[source[shared] == j]
            path.log_prob[w], path.length[w] = old.log_prob[w], old.length[w]
            path.start[w] = old.start[w] + len(path.edge)
            path.edge = np.concatenate([path.edge, old.edge])
        before = {int(d): float(prefixes(paths[parent[d]])[branch[d]]) for d in own} if len(paths) > 1 else dict(zip(own.tolist(), prefixes(paths[0])[branch[own]].tolist()))
        edges = []
        for d in own.tolist():  # one word of each text: draw one of its other segmentations
            j, b = int(parent[d]), int(branch[d])
            gone = taken.setdefault((j, b), [segmentation(paths[j], b)])
            uniforms = random.Random(int(seeds[d]) * 1_000_003 + number).random
            drawn = lat.other(int(root[b]), gone, uniforms)
            gone.append(drawn)
            log_prob = float(lat.logp[list(drawn)].sum())
            path.log_prob[b], path.start[b], path.length[b] = log_prob, len(path.edge) + len(edges), len(drawn)
            edges.extend(drawn)
            # what the word still leaves aside lies below what was just taken from it
            rest = 1 - sum(math.exp(float(lat.logp[list(t)].sum())) for t in gone)
            left = -np.inf
            if rest > 1e-12:
                e = -math.log(1.0 - uniforms())
                left = threshold[d] - float(np.logaddexp(0.0, math.log(e) + threshold[d] - before[d] - math.log(rest)))
            paths[j].left[b] = left
        path.edge = np.concatenate([path.edge, np.array(edges, np.int64)])
        after = np.nonzero(np.repeat(alive, sizes) & (everything > np.repeat(branch, sizes)))[0]
        salt = salted(number, after)
        walked(path, after, salt)
        path.left[after] = _left_aside(np.repeat(threshold, sizes)[after], path.log_prob[after], prefixes(path)[after], _mix(salt ^ np.uint64(0x5851F42D4C957F2D)))
        paths.append(path)
        exists.append(alive)
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in texts]
    for path, alive in zip(paths, exists):
        length = path.length * np.repeat(alive, sizes)
        edges = path.edge[np.arange(length.sum()) + np.repeat(path.start - (np.cumsum(length) - length), length)]
        token = lat.token[edges]
        cuts = np.cumsum(np.add.reduceat(length, begin))
        total = np.add.reduceat(path.log_prob, begin)
        for d, ids in enumerate(np.split(token, cuts[:-1])):
            if alive[d]:
                log_inclusion = _log_inclusion(float(total[d] - threshold[d]))
                out[d].append((_ids(ids, lat.spelled), float(total[d]), math.exp(log_inclusion), log_inclusion))
    lat.forget()
    return out


def _log_inclusion(above: float) -> float:
    """``log(1 - exp(-exp(above)))``: the log-probability that a path so far above the threshold is among the samples."""
    if above < -30:
        return above
    return math.log(-math.expm1(-math.exp(above))) if above < 700 else 0.0


def _ids(tokens: np.ndarray, spelled: list[list[int]]) -> np.ndarray:
    if not len(tokens) or tokens.min() >= 0:
        return tokens
    return np.array([i for t in tokens.tolist() for i in ((t,) if t >= 0 else spelled[-t - 1])], np.int32)


def sample_encodings(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", k: int = 2, output: str = "samples") -> DataFrame:
    """``df`` with ``output array<struct<ids, log_prob, inclusion, exact>>``: ``k`` distinct segmentations of the whole text;
    ``exact`` says whether the ids decode to the text."""
    kept = [c for c in df.columns if c not in (output, "__seed")]
    if text not in kept:
        raise ValueError(f"no column {text}")
    fed = df.select(*(F.col(f"`{c}`") for c in kept), F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("__seed"))
    schema = T.StructType([*(f for f in fed.schema if f.name != "__seed")]).add(output, T.StructType.fromDDL(f"x {SAMPLES}")["x"].dataType)
    number = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, pieces = _worker_lattices(vocabulary)
        for rows in batches:
            seeds = np.asarray(rows.column(len(kept))).view(np.uint64)
            sizes = np.asarray(pc.fill_null(pc.utf8_length(rows.column(number)), 0)).astype(np.int64)
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_CHARS)) + at)
                part = rows.slice(at, stop - at)
                texts = [t or "" for t in part.column(number).to_pylist()]
                got = sample_batch(lattices, texts, seeds[at:stop], k)
                flat = [s for samples in got for s in samples]
                ids, ends = np.concatenate([s[0] for s in flat]), np.cumsum([len(s[0]) for s in flat])
                wanted = [w for t, samples in zip(texts, got) for w in [b" " + t.encode("utf-8", "surrogatepass")] * len(samples)]
                exact = [a == b for a, b in zip(pieces.spelled(ids, ends), wanted)]
                lists_of_ids = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids)
                struct = pa.StructArray.from_arrays(
                    [lists_of_ids, *(pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3)), pa.array(exact)],
                    ["ids", "log_prob", "inclusion", "log_inclusion", "exact"],
                )
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)]).astype(np.int32), struct)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), lists], [*kept, output])
                at = stop

    return fed.mapInArrow(run, schema)


class PieceBytes:
    """What ids stand for, as one array of bytes."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def spelled(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of encodings that lie one after another and end before ``ends``, prefix space included."""
        sizes = self.size[ids]
        stops = np.cumsum(sizes)
        joined = self.bytes[np.arange(int(sizes.sum())) + np.repeat(self.start[ids] - (stops - sizes), sizes)].tobytes()
        cuts = np.append(0, stops)[ends].tolist()
        return [joined[a:b] for a, b in zip([0, *cuts], cuts)]


_LATTICES: dict[tuple[str, float], tuple[Lattices, PieceBytes]] = {}


def _worker_lattices(vocabulary: Vocabulary) -> tuple[Lattices, PieceBytes]:
    """The lattices of a Python worker, kept for its next task."""
    if vocabulary.key not in _LATTICES:
        _LATTICES[vocabulary.key] = Lattices(vocabulary), PieceBytes(vocabulary.piece_bytes())
    return _LATTICES[vocabulary.key]


def decode_ids(ids: np.ndarray, raw: list[bytes]) -> str:
    """The text of an encoding; ``raw`` are the bytes of the pieces.  The prefix space goes."""
    text = b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
    return text[1:] if text.startswith(" ") else text


def decode_column(vocabulary: Vocabulary):
    """A vectorised column function from ``array<int>`` ids to text."""
    raw = vocabulary.piece_bytes()

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode_ids(x, raw))

    return decode
