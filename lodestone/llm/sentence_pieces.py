"""SentencePiece encoding and decoding: segmentations sampled without replacement by a perturbed best-first search.

The vocabulary file is read as it is. Its pieces get unigram log-probabilities by rank, ln p = -ln(1 + rank) + const,
characters without a piece fall back to their bytes. No piece holds a space but at its start, so the lattice of a text is
a chain of small lattices, one for each chunk (spaces and what follows up to the next space, line feed, or change between Latin letters
and others, where the vocabulary has no piece across it); equal chunks share one. Backward sums over a chunk's lattice make each step of a segmentation a draw from its edges.

The search is Gumbel top-k in the tree of partial segmentations: the root's perturbed score is a standard Gumbel number, the
drawn child inherits its parent's score, and its siblings together get one Gumbel number of their joint mass, truncated below
that score. A heap of such sibling sets gives the next best segmentation: the set with the highest score is opened, one of it is drawn,
the rest goes back, and the draw is completed to the end of the text. So segmentations come out distinct, in falling order of perturbed
score, as samples without replacement from the whole text's distribution. The score of the best one left out, kappa, gives each
sample's inclusion score 1 - exp(-exp(ln p - kappa)). All random numbers are hashes of seed, row key, sample and place.

Steps run over all chunks of a batch of texts at once. Defined results: a null text gives no row; an empty text has one segmentation, of no
piece (rank 1, ln p 0, inclusion 1); texts with fewer than k segmentations give all of them; texts of any length are one
lattice; rows with equal key and text give equal samples, a null key counts as 0; U+2581 in a text is spelt in bytes, so decoding
gives every text back; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
SEED = 7
MARK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
# Chunks, where no piece goes on from a Latin letter to another character or back, and where one does.
CUT_CHUNK = re.compile(f" *[{LATIN}]+| *[^ \n{MARK}{LATIN}]+| +|[\n{MARK}]")
WHOLE_CHUNK = re.compile(f" *[^ \n{MARK}]+| +|[\n{MARK}]")
MAX_CHUNKS = 60_000  # kept lattices of a task, before it starts anew


class Vocabulary:
    """Pieces as a trie over character codes, in arrays."""

    def __init__(self, path: str) -> None:
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte = [-1] * 256
        pieces: list[tuple[str, int]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((piece, i))
        total = sum(1 / (1 + r) for r in range(1, n + 1))
        latin = re.compile(f"[{LATIN}]")
        mixed = any(bool(latin.match(a)) != bool(latin.match(b)) for p, _ in pieces for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:], strict=False))
        self.chunk = WHOLE_CHUNK if mixed else CUT_CHUNK
        self.text = {i: p.replace(MARK, " ") for p, i in pieces}
        self.unspelt = -math.log(2.0 * n) - math.log(total)  # ln p of a byte
        code = {c: k + 1 for k, c in enumerate(sorted({c for p, _ in pieces for c in p}))}
        self.code = np.zeros(0x110000, np.int64)
        for c, k in code.items():
            self.code[ord(c)] = k
        self.code[ord(" ")] = code[MARK]
        self.wide = len(code) + 1
        nodes: dict[tuple[int, int], int] = {}
        token, score = [-1], [0.0]
        for rank, (piece, i) in enumerate(pieces):
            at = 0
            for c in piece:
                key = (at, code[c])
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                    score.append(0.0)
                at = nodes[key]
            token[at], score[at] = i, -math.log(2 + rank) - math.log(total)
        self.token, self.score = np.array(token, np.int32), np.array(score)
        # An open-addressing table of the trie's steps.
        self.bits = max(20, (8 * len(nodes)).bit_length())
        keys = np.array([a * self.wide + c for a, c in nodes], np.int64)
        values = np.array(list(nodes.values()), np.int32)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node, code):
        """The trie's node after node and code, 0 for none."""
        import numpy as np

        keys = node.astype(np.int64) * self.wide + code
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], 0)
        for _ in range(1, self.probes):
            missed = np.flatnonzero((out == 0) & (self.keys[slot] != -1) & (self.keys[slot] != keys))
            if not len(missed):
                break
            slot[missed] = (slot[missed] + 1) & ((1 << self.bits) - 1)
            hit = missed[self.keys[slot[missed]] == keys[missed]]
            out[hit] = self.values[slot[hit]]
        return out


class Numbers(dict):
    """Numbers for keys in the order in which they are first asked for; new ones are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Lattices:
    """Lattices of chunks. State s has the edges first[s] to first[s + 1]: cum (distribution function), log_q and log_rest (ln of the
    edge's probability and of its siblings'), token, to (-1 at the chunk's end). Arrays grow by doubling; states and edges are counted."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.known = Numbers()
        self.chunks, self.states, self.edges = 0, 0, 0
        self.base, self.first = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.cum, self.log_q, self.log_rest = np.zeros(1024, np.float32), np.zeros(1024), np.zeros(1024, np.float32)
        self.token, self.to = np.zeros(1024, np.int32), np.zeros(1024, np.int32)

    def _grow(self, name: str, used: int, new) -> None:
        import numpy as np

        old = getattr(self, name)
        if used + len(new) > len(old):
            wide = np.zeros(max(2 * len(old), used + len(new)), old.dtype)
            wide[:used] = old[:used]
            setattr(self, name, wide)
            old = wide
        old[used : used + len(new)] = new

    def of(self, texts: list[str]) -> tuple:
        """(place of each text's chunks, chunk numbers); new chunks get their lattices."""
        import numpy as np

        if len(self.known) > MAX_CHUNKS:
            self.clear()
        found = [self.vocabulary.chunk.findall(" " + text) if text else [] for text in texts]
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        if self.known.new:
            self._add(self.known.new)
            self.known.new = []
        return np.concatenate(([0], np.cumsum([len(x) for x in found]))), numbers

    def _add(self, chunks: list[str]) -> None:
        import numpy as np

        v = self.vocabulary
        size = np.array([len(c) for c in chunks], np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = v.code[points]
        code[points == ord(MARK)] = 0
        start = np.concatenate(([0], np.cumsum(size)))
        rest = np.repeat(start[1:], size) - np.arange(len(points))  # characters up to the chunk's end
        at, node = np.arange(len(points)), np.zeros(len(points), np.int32)
        froms, lengths, tokens, scores = [], [], [], []
        single = np.zeros(len(points), bool)
        length = 0
        while len(at):
            length += 1
            node = v.step(node, code[at + length - 1])
            ok = (node > 0) & (code[at + length - 1] > 0)
            at, node = at[ok], node[ok]
            piece = v.token[node] >= 0
            froms.append(at[piece])
            lengths.append(np.full(int(piece.sum()), length, np.int64))
            tokens.append(v.token[node[piece]])
            scores.append(v.score[node[piece]])
            if length == 1:
                single[at[piece]] = True
            more = rest[at] > length
            at, node = at[more], node[more]
        spelt = np.flatnonzero(~single)
        if len(spelt):
            p = points[spelt]
            bytes_ = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
            froms.append(spelt)
            lengths.append(np.ones(len(spelt), np.int64))
            tokens.append(np.where(p < 0x80, np.array(v.byte, np.int64)[np.minimum(p, 255)], -p).astype(np.int32))
            scores.append(bytes_ * v.unspelt)
        origin, length, token, score = map(np.concatenate, (froms, lengths, tokens, scores))
        # State of character i of chunk j: i + j, its end i + j + 1 after the last character.
        chunk = np.repeat(np.arange(len(chunks)), size)
        state = origin + chunk[origin]
        order = np.argsort(state, kind="stable")
        state, length, token, score, origin = state[order], length[order], token[order], score[order], origin[order]
        states = len(points) + len(chunks)
        beta = np.zeros(states)
        first = np.searchsorted(state, np.arange(states + 1))
        to = state + length
        # Backward sums, all characters at one distance from their chunk's end together, each relative to the next character's:
        # every character has an edge of its own, so the exponents stay small.
        away = rest[origin]
        by_distance = np.argsort(away, kind="stable")
        far_state, far_to, far_score = state[by_distance], to[by_distance], score[by_distance]
        lead = np.flatnonzero(np.concatenate(([True], far_state[1:] != far_state[:-1])))
        cuts = np.searchsorted(away[by_distance[lead]], np.arange(1, int(rest.max(initial=0)) + 2)).tolist()
        lead = np.append(lead, len(far_state))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = int(lead[i]), int(lead[j])
            x = far_score[a:b] + beta[far_to[a:b]]
            x -= beta[far_state[a:b] + 1]
            s = far_state[lead[i:j]]
            beta[s] = beta[s + 1] + np.log(np.add.reduceat(np.exp(x), lead[i:j] - a))
        log_q = np.minimum(score + beta[to] - beta[state], 0.0)
        cum = np.exp(log_q)
        own, rank = np.flatnonzero(np.diff(first)), 1  # summed state by state, so that equal chunks get equal numbers anywhere
        while len(own := own[first[own] + rank < first[own + 1]]):
            cum[first[own] + rank] += cum[first[own] + rank - 1]
            rank += 1
        last = first[1:][first[1:] > first[:-1]] - 1
        cum[last] = 1.0
        with np.errstate(divide="ignore"):
            log_rest = np.log(-np.expm1(log_q))
        log_rest[first[state]] = np.where(np.diff(first)[state] == 1, -np.inf, log_rest[first[state]])
        shift, edge = self.states, self.edges
        self._grow("base", self.chunks, start[:-1] + np.arange(len(chunks)) + shift)
        self._grow("first", shift, first + edge)
        for name, new in (("cum", cum), ("log_q", log_q), ("log_rest", log_rest), ("token", token), ("to", np.where(length == rest[origin], -1, to + shift))):
            self._grow(name, edge, new)
        self.chunks, self.states, self.edges = self.chunks + len(chunks), shift + states, edge + len(token)


def scalar_mix(x: int) -> int:
    """tokens.mix of one number."""
    x &= (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return x ^ (x >> 31)


def scalar_uniform(x: int) -> float:
    return ((scalar_mix(x) >> 11) + 0.5) * 2.0**-53


def uniform(keys):
    """Numbers in (0, 1) from 64-bit keys: tokens.mix, in place on a copy."""
    import numpy as np

    x = keys >> np.uint64(30)
    x ^= keys
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def walk(lattices: Lattices, state, keys):
    """Draws paths from the states (-1: none) on: (edges of all paths in order, how many each has). keys seed each path's numbers."""
    import numpy as np

    first, cum, to = lattices.first, lattices.cum, lattices.to
    live = np.flatnonzero(state >= 0)
    now, key = state[live], keys[live]
    steps, size = [], np.zeros(len(state), np.int64)
    while len(live):
        u = uniform(key)
        e = first[now]
        late = np.flatnonzero(cum[e] < u)
        while len(late):
            e[late] += 1
            late = late[cum[e[late]] < u[late]]
        steps.append((live, e))
        size[live] += 1
        now = to[e]
        on = np.flatnonzero(now >= 0)
        live, now, key = live[on], now[on], key[on]
        key += np.uint64(0x9E3779B97F4A7C15)
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(begin[-1]), np.int64)
    for step, (path, e) in enumerate(steps):
        out[begin[path] + step] = e
    return out, size


def below(loc, top, u):
    """Gumbel numbers at loc (-inf: none), truncated to lie below top."""
    import numpy as np

    return loc - np.log(np.exp(loc - top) - np.log(u))


class Search:
    """One text's best-first search: found segmentations and the sibling sets that are left."""

    __slots__ = ("chunks", "found", "key", "left", "lo", "taken")

    def __init__(self, key: int, lo: int, chunks: int) -> None:
        self.key, self.lo, self.chunks = key, lo, chunks
        self.found: list[tuple] = []  # (edges, ln p before each edge and in total, states, chunks of the text, score)
        self.left: list = []  # sibling sets of each path: [scores, the step of the first]
        self.taken: dict[tuple[int, int], list[int]] = {}  # opened siblings by path and step


def opened(s: Search, lattices: Lattices, salt: int):
    """Open the best sibling set: (prefix of edges, their states and the opened one's, edge, chunks of the prefix, the edge's chunk, ln p, score), or None."""
    import numpy as np

    log_q, first = lattices.log_q, lattices.first
    best, p = max(((float(scores.max()), p) for p, (scores, _) in enumerate(s.left) if len(scores)), default=(-math.inf, -1))
    if best == -math.inf:
        return None
    scores, begin = s.left[p]
    i = int(scores.argmax())
    step = begin + i
    path, logs, states, chunks, _ = s.found[p]
    state = int(states[step])
    gone = s.taken.setdefault((p, step), [int(path[step])])
    rest = [e for e in range(int(first[state]), int(first[state + 1])) if e not in gone]
    q = np.exp(log_q[rest])
    u = scalar_uniform(salt + 1) * q.sum()
    e = rest[min(int(np.searchsorted(np.cumsum(q), u)), len(rest) - 1)]
    gone.append(e)
    rest.remove(e)
    before = float(logs[step])
    scores[i] = float(below(before + math.log(float(np.exp(log_q[rest]).sum())), best, scalar_uniform(salt + 2))) if rest else -math.inf
    return path[:step], states[: step + 1], e, chunks[:step], int(chunks[step]), before + float(log_q[e]), best


def sample(lattices: Lattices, edges, chunks, keys, k: int) -> list[Search]:
    """k segmentations (fewer, if there are no more) of each text, and the sets left over."""
    import numpy as np

    from .tokens import mix

    base = lattices.base[chunks] if len(chunks) else np.zeros(0, np.int64)
    searches = [Search(int(key), int(a), int(b - a)) for key, a, b in zip(keys, edges[:-1], edges[1:], strict=True)]
    to = lattices.to
    for r in range(k):
        starts, places, plans = [], [], []
        for s in searches:
            salt = scalar_mix(s.key ^ (r * 0x8CB92BA72F3D8DD7))
            if r == 0:
                head, chunk, lead = None, 0, ()
            else:
                head = opened(s, lattices, salt)
                if head is None:
                    continue
                chunk, lead = head[4], (to[head[2]],)
            own = base[s.lo + chunk + len(lead) : s.lo + s.chunks]
            starts.append(np.concatenate((lead, own)).astype(np.int64) if lead else own)
            places.append(np.arange(chunk, s.chunks, dtype=np.uint64))
            plans.append((s, head, chunk, salt))
        if not plans:
            break
        count = np.array([len(x) for x in starts])
        salts = np.array([salt for *_, salt in plans], np.uint64)
        start = np.concatenate(starts)
        seeds = mix(np.concatenate(places) * np.uint64(0xD6E8FEB86659FD93) + np.repeat(salts, count))
        path, size = walk(lattices, start, seeds)
        origin = path_states(lattices, path, size, start)
        chunk_of = np.repeat(np.concatenate(places).astype(np.int32), size)
        cut = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
        tops = np.array([-math.log(-math.log(scalar_uniform(s.key ^ 0x5DEECE66D))) if head is None else head[6] for s, head, *_ in plans])
        new = np.diff(cut)
        log_q = lattices.log_q[path]
        ahead = np.empty(len(path))
        logs = []
        for (_, head, *_), a, b in zip(plans, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            sums = np.empty(b - a + 1)
            sums[0] = head[5] if head else 0.0
            sums[1:] = log_q[a:b]
            np.cumsum(sums, out=sums)
            ahead[a:b] = sums[:-1]
            logs.append(sums)
        step = np.arange(len(path)) - np.repeat(cut[:-1], new)
        u = uniform(step.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.repeat(mix(salts ^ np.uint64(0xE7037ED1A0B428DB)), new))
        scores = below(ahead + lattices.log_rest[path], np.repeat(tops, new), u)
        for (s, head, chunk, _), sums, top, a, b in zip(plans, logs, tops.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if head is None:
                s.found.append((path[a:b], sums, origin[a:b], chunk_of[a:b], top))
                s.left.append([scores[a:b], 0])
                continue
            s.found.append((np.concatenate((head[0], [head[2]], path[a:b])), np.concatenate((np.full(len(head[0]) + 1, np.nan), sums)), np.concatenate((head[1], origin[a:b])), np.concatenate((head[3], [chunk], chunk_of[a:b])), top))
            s.left.append([scores[a:b], len(head[0]) + 1])
    return searches


def path_states(lattices: Lattices, path, size, start):
    """The state that each edge of the paths leaves."""
    import numpy as np

    out = np.empty(len(path), np.int64)
    out[1:] = lattices.to[path[:-1]]
    begin = np.cumsum(size) - size
    some = size > 0
    out[begin[some]] = start[some]
    return out


def spell(tokens, vocabulary: Vocabulary) -> list[int]:
    """Piece ids, characters without a piece in bytes."""
    if not (tokens < 0).any():
        return tokens
    out: list[int] = []
    for t in tokens.tolist():
        out += [t] if t >= 0 else [vocabulary.byte[b] for b in chr(-t).encode("utf-8", "surrogatepass")]
    return out


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    """The text of piece ids."""
    value = {i: b for b, i in enumerate(vocabulary.byte) if i >= 0}
    raw = b"".join(bytes([value[i]]) if i in value else vocabulary.text[i].encode() for i in ids)
    return raw.decode("utf-8", "replace")[1:] if len(ids) else ""


SCHEMA = "doc_id long, rank int, ids array<int>, n_pieces int, log_p double, perturbed double, inclusion double"
_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary in a file of this machine, or of those that Spark has shipped, read once a process."""
    import os

    if path not in _loaded:
        _loaded[path] = Vocabulary(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _loaded[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, k: int = K, seed: int = SEED) -> DataFrame:
    """k rows a document: doc_id, rank, ids, n_pieces, log_p, perturbed (score), inclusion (score).

    model is a path that every machine has, or the name of a file given to SparkContext.addFile.
    """

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from .tokens import mix

        v = vocabulary(model)
        lattices = Lattices(v)
        names = ["doc_id", "rank", "ids", "n_pieces", "log_p", "perturbed", "inclusion"]
        for whole in batches:
            for batch in text_batches(whole.filter(pc.is_valid(whole.column(1))), 1, 1 << 19):
                ids = np.asarray(pc.fill_null(batch.column(0), 0)).astype(np.int64)
                edges, chunks = lattices.of(batch.column(1).to_pylist())
                keys = mix(ids.view(np.uint64) + mix(np.array([seed], np.uint64)))
                rows, spans, flat = [], [0], []
                for doc, s in zip(batch.column(0).to_pylist(), sample(lattices, edges, chunks, keys, k), strict=True):
                    kappa = max((float(x.max()) for x, _ in s.left if len(x)), default=-math.inf)
                    for rank, (path, logs, _, _, score) in enumerate(s.found):
                        log_p = float(logs[-1])
                        pieces = spell(lattices.token[path], v)
                        inclusion = 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(700.0, log_p - kappa)))
                        rows.append((doc, rank + 1, len(pieces), log_p, score, inclusion))
                        flat.append(pieces)
                        spans.append(spans[-1] + len(pieces))
                if not rows:
                    continue
                values = pa.array(np.concatenate([np.asarray(x, np.int32) for x in flat]), pa.int32())
                cols = list(zip(*rows, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(spans, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), lists, pa.array(cols[2], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[3:])], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(work, SCHEMA)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL, to: str = "text") -> DataFrame:
    """encoded with the text of its piece ids in column `to`; null ids give a null text."""
    kept = [c for c in encoded.columns if c != to]
    rows = encoded.select(*kept)
    place = kept.index(ids_col)
    text = F.lit("").cast("string").alias(to)
    schema = rows.select("*", text).schema

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else decode_ids(x, v) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return rows.mapInArrow(work, schema)
