"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

Sampling is Gumbel top-k by perturbed A* over the segmentation lattice. Hypotheses are suffixes of a segmentation; the
heuristic is the exact log-mass of what lies before (the forward sum), so a hypothesis' perturbed score is the maximum
over all its completions. The best hypothesis is completed by ancestral sampling, which keeps its maximum; at each
node passed, the edges not taken become one hypothesis, whose score is a Gumbel truncated at that maximum. The k best
complete segmentations come out in order, all distinct, and the next score gives each its inclusion probability.

No piece crosses the start of a pre-token, so the lattice of a text is the chain of its pre-tokens' lattices. These
are built once for each distinct pre-token, and all texts of a batch are walked in step by array operations. Random
numbers are hashes of seed, row key, word and step: a row's samples don't depend on its neighbours or partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame

from tessera.llm.common import remembered, ship
from tessera.llm.tokens import MARK, load

#: Log-weight of a piece for each point of its score: ranks of some thousands part likely from unlikely pieces.
ALPHA = 1 / 2000
#: Characters walked together, and nodes of remembered lattices. Both bound a worker's memory; larger ones were no faster.
GROUP, NODES = 120_000, 800_000
#: Hypotheses this far, in log-mass, below a sibling are not drawn: their chance to matter is below 1e-25.
FAR = 60.0
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HASH = np.uint64(0x100000001B3)
#: Words' log-probabilities are multiples of 1 / GRID, so that their sums are exact and the same in any grouping.
GRID = 2.0**30
#: Codes from here on stand for a character without a piece, by its code point.
BARE = 1 << 24
#: Pre-tokens by marks alone, and by marks and changes between letters and other characters.
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
LETTERS = "A-Za-zÀ-ɏ"
LETTERED = re.compile(f"{MARK}*[{LETTERS}]+|{MARK}*[^{LETTERS}{MARK}]+|{MARK}+")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, draw: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), one for each key and draw."""
    step = np.uint64((draw + 1) * int(_A) & (1 << 64) - 1) if isinstance(draw, int) else (draw.astype(np.uint64) + np.uint64(1)) * _A
    return ((mix(key + step) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def row_key(row: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(repr(row).encode(), seed)


class Vocabulary:
    """Pieces by hash of their prefixes, their log-weights, and the bytes that they decode to."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        sp = load(model)
        self.size = sp.get_piece_size()
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in plain}
        lowest = min((s for s in scores.values() if s > -1e6), default=0.0)
        self.weight = np.zeros(self.size)
        self.bare = alpha * (lowest - 1)
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.ascii = np.array([self.byte.get(b, BARE + b) for b in range(128)], np.int64)
        found: dict[int, int] = {}
        self.bytes: list[bytes] = [b""] * self.size
        with np.errstate(over="ignore"):
            for i in range(self.size):
                if sp.is_byte(i):
                    self.bytes[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
                elif sp.is_unknown(i):
                    self.bytes[i] = " ⁇ ".encode()
            for i in plain:
                piece = sp.id_to_piece(i)
                self.bytes[i] = piece.replace(MARK, " ").encode()
                self.weight[i] = alpha * max(scores[i], lowest)
                h = np.uint64(0)
                for c in piece:
                    h = h * _HASH + np.uint64(ord(c) + 1)
                    found.setdefault(int(h), -1)
                found[int(h)] = i
        # prefixes by hash, in a table with linear probing
        self.bits = 21
        self.hashes, self.piece = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        for h, i in found.items():
            at = h * int(_A) % (1 << 64) >> 64 - self.bits
            while self.hashes[at]:
                at = (at + 1) % (1 << self.bits)
            self.hashes[at], self.piece[at] = h, i
        # texts may be cut where letters meet others only if no piece has both side by side, marks at its start aside
        apart = all(len(LETTERED.findall(sp.id_to_piece(i))) == 1 for i in plain)
        self.pattern = LETTERED if apart else MARKED
        self.longest = max((len(sp.id_to_piece(i)) for i in plain), default=1)

    def prefix(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a piece's prefix, and its piece (-1 for none)."""
        at = (h * _A >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.hashes[at]
        off = np.flatnonzero((there != h) & (there != 0))
        while len(off):
            at[off] = (at[off] + 1) & (1 << self.bits) - 1
            there[off] = self.hashes[at[off]]
            off = off[(there[off] != h[off]) & (there[off] != 0)]
        ok = there == h
        return ok, np.where(ok, self.piece[at], -1)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: without the blank that encoding puts first."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def spell(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for codes, and where each code's ids begin, and the end: characters without a piece become their
        bytes' ids, or unknown where the model has none."""
        bare = np.flatnonzero(codes >= BARE)
        spelled = [[self.byte.get(b, self.unknown) for b in chr(c - BARE).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown] for c in codes[bare].tolist()]
        width = np.ones(len(codes), np.int64)
        width[bare] = [len(x) for x in spelled]
        past = np.concatenate(([0], np.cumsum(width)))
        out = np.empty(past[-1], np.int32)
        plain = codes < BARE
        out[past[:-1][plain]] = codes[plain]
        for i, x in zip(bare.tolist(), spelled):
            out[past[i] : past[i + 1]] = x
        return out, past


class Lattices(dict):
    """Pre-token to number. For each number a chain of nodes, one before each character and one at the end; for each
    node its incoming edges: source, code, cumulative probability, log-probability, log of the others' probability."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.fresh: list[str] = []
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.fresh = []
        self.start, self.end, self.first = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int64)
        self.source, self.code = np.zeros(1 << 19, np.int32), np.zeros(1 << 19, np.int32)
        self.cum, self.rest, self.logp = np.zeros(1 << 19, np.float32), np.zeros(1 << 19, np.float32), np.zeros(1 << 19)
        self.nodes = self.edges = 0

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        """Store values from a place on; room is doubled when it runs out."""
        room = getattr(self, name)
        if at + len(values) > len(room):
            wide = np.zeros(max(2 * len(room), at + len(values)), room.dtype)
            wide[:at] = room[:at]
            setattr(self, name, wide)
            room = wide
        room[at : at + len(values)] = values

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        self.fresh.append(token)
        return n

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Numbers of pre-tokens, those not seen yet being built."""
        if self.nodes > NODES:
            self.empty()
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.fresh:
            self.build(self.fresh)
            self.fresh = []
        return out

    def build(self, tokens: list[str]) -> None:
        v = self.vocabulary
        chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) for t in tokens])
        stops = np.cumsum(sizes)
        token = np.repeat(np.arange(len(tokens)), sizes)
        stop = stops[token]
        node = np.arange(len(chars)) + token  # the node before each character
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        parts: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        for n in range(1, v.longest + 1):
            inside = at + n <= stop[at]
            at, h = at[inside], h[inside]
            h = h * _HASH + (chars[at + n - 1] + 1).astype(np.uint64)
            ok, piece = v.prefix(h)
            has = piece >= 0
            parts.append((at[has], n, piece[has], v.weight[piece[has]]))
            if n == 1:
                none = at[~has]
                wide = 1 + (chars[none] > 0x7F) + (chars[none] > 0x7FF) + (chars[none] > 0xFFFF)
                parts.append((none, 1, np.where(wide == 1, v.ascii[np.minimum(chars[none], 127)], BARE + chars[none]), v.bare * wide))
            at, h = at[ok], h[ok]
            if not len(at):
                break
        begin = np.concatenate([p[0] for p in parts])
        size = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
        code = np.concatenate([p[2] for p in parts])
        weight = np.concatenate([p[3] for p in parts])
        source = node[begin]
        target = source + size
        depth = begin + size - (stops - sizes)[token[begin]]
        order = np.lexsort((target, depth))
        source, target, code, weight, depth = source[order], target[order], code[order], weight[order], depth[order]
        n_nodes = len(chars) + len(tokens)
        mass = np.zeros(n_nodes)
        logp = np.empty(len(source))
        edges = np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1], [True]))) if len(depth) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            t = target[a:b]
            group = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            count = np.diff(np.append(group, b - a))
            value = mass[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, group)
            total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), group))
            mass[t[group]] = total
            logp[a:b] = value - np.repeat(total, count)
        order = np.argsort(target, kind="stable")
        source, target, code, logp = source[order], target[order], code[order], logp[order]
        count = np.bincount(target, minlength=n_nodes)
        first = np.concatenate(([0], np.cumsum(count)))
        p = np.exp(logp)
        cum, place = p.copy(), np.arange(len(p)) - first[target]
        for n in range(1, int(count.max(initial=0))):  # node by node, so that no other token's rounding enters
            at = np.flatnonzero(place == n)
            cum[at] += cum[at - 1]
        cum[first[1:][count > 0] - 1] = 2.0
        with np.errstate(divide="ignore"):
            rest = np.where(count[target] == 1, -np.inf, np.log(np.maximum(1 - p, 1e-300)))
        starts = stops - sizes + np.arange(len(tokens)) + self.nodes
        done = len(self) - len(tokens)
        self.put("start", done, starts)
        self.put("end", done, starts + sizes)
        self.put("first", self.nodes + 1, first[1:] + self.edges)
        for name, values in (("source", source + self.nodes), ("code", code), ("cum", cum), ("logp", logp), ("rest", rest)):
            self.put(name, self.edges, values)
        self.nodes, self.edges = self.nodes + n_nodes, self.edges + len(source)


def lattices_of(model: bytes) -> Lattices:
    """A worker's lattices for a model: tasks that follow one another in a worker go on with them."""
    return remembered(f"lattices {xxhash.xxh3_64_intdigest(model)}", lambda: Lattices(Vocabulary(model)))


def copied(into: np.ndarray, to: np.ndarray, out_of: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
    """Copy runs: ``count`` values from ``start`` of ``out_of`` to ``to`` of ``into``."""
    if len(count):
        shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        into[np.repeat(to, count) + shift] = out_of[np.repeat(start, count) + shift]


def truncated(phi: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates of location ``phi`` given that they are below ``most``."""
    with np.errstate(over="ignore", under="ignore"):
        return phi - np.log(np.exp(np.minimum(phi - most, 700)) - np.log(u))


class Round:
    """One segmentation of each text: codes of all words in a row, words' counts and log-probabilities."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.logp = np.zeros(n)
        self.past = np.zeros(n, np.int64)  # where each word's codes end
        self.codes = np.zeros(0, np.int32)


def sample(lat: Lattices, kind: np.ndarray, text: np.ndarray, first: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Round], np.ndarray, np.ndarray, np.ndarray]:
    """The k best perturbed segmentations of each text.

    ``kind``: lattice of each word; ``text``: its text; ``first``: each text's first word, and the end; ``keys``: each
    text's. Returns the rounds, and by round and text: whether there is such a segmentation, its perturbed score; and
    by text the next score (-inf if there is no further segmentation).
    """
    n, d = len(kind), len(keys)
    word_key = mix(keys[text] + (np.arange(n) - first[text]).astype(np.uint64) * _C) if n else np.zeros(0, np.uint64)
    rounds: list[Round] = []
    there, score = np.zeros((k, d), bool), np.full((k, d), -np.inf)
    there[0], score[0] = True, -np.log(-np.log(uniform(keys, 1 << 40)))
    names = ("text", "round", "word", "right", "node", "part", "phi", "score")
    agenda = {x: np.zeros(0, np.int64 if x in names[:5] else np.float64) for x in names} | {"not": np.zeros((0, k), np.int64)}
    todo = np.arange(n)
    now = lat.end[kind]
    right, part = np.zeros(n, np.int64), np.zeros(n)
    popped: dict[str, np.ndarray] | None = None
    for r in range(k):
        new = Round(n)
        stop = lat.start[kind]
        at = now.copy()
        steps = []
        live, s = todo[at[todo] != stop[todo]], 0
        run = part.copy()
        deep = right.copy()
        while len(live):
            u = uniform(word_key[live], r << 32 | s)
            node = at[live]
            e = lat.first[node]
            go = np.flatnonzero(u >= lat.cum[e])
            while len(go):
                e[go] += 1
                go = go[u[go] >= lat.cum[e[go]]]
            steps.append((live, e, node, deep[live], run[live]))
            run[live] += lat.logp[e]
            deep[live] += 1
            at[live] = lat.source[e]
            live, s = live[at[live] != stop[live]], s + 1
        new.count[todo], new.logp[todo] = deep[todo], np.round(run[todo] * GRID) / GRID + 0.0
        kept = []
        if popped is not None:
            # what the parents have fixed: words after the one that was reopened, and that word's right part
            own = np.full(d, n)
            own[popped["text"]] = popped["word"]
            parent = np.full(d, -1)
            parent[popped["text"]] = popped["round"]
            for q in range(r):
                w = np.flatnonzero((parent[text] == q) & (np.arange(n) > own[text]))
                new.count[w], new.logp[w] = rounds[q].count[w], rounds[q].logp[w]
                kept.append((q, w))
        new.past = np.cumsum(new.count)
        new.codes = np.empty(int(new.past[-1]) if n else 0, np.int32)
        for w, e, _, before, _ in steps:
            new.codes[new.past[w] - 1 - before] = lat.code[e]
        for q, w in kept:
            copied(new.codes, new.past[w] - new.count[w], rounds[q].codes, rounds[q].past[w] - rounds[q].count[w], rounds[q].count[w])
            mine = popped["round"] == q
            w, c = popped["word"][mine], popped["right"][mine]
            copied(new.codes, new.past[w] - c, rounds[q].codes, rounds[q].past[w] - c, c)
            new.codes[new.past[w] - 1 - c] = lat.code[popped["edge"][mine]]
        rounds.append(new)
        # what was not taken on the way
        total = np.concatenate(([0.0], np.cumsum(new.logp)))
        after = total[first[1:]][text] - total[1:] if n else np.zeros(0)
        found = []
        for w, e, node, before, log in steps:
            phi = after[w] + log + lat.rest[e]
            near = np.flatnonzero(phi > -200)
            found.append((w[near], e[near], node[near], before[near], log[near], phi[near]))
        seen = np.zeros(d, bool)
        for f in found:
            seen[text[f[0]]] = True
        for w, e, node, before, log in steps if not seen[there[r]].all() else ():
            phi = after[w] + log + lat.rest[e]
            near = np.flatnonzero(~seen[text[w]] & (phi > -np.inf))
            found.append((w[near], e[near], node[near], before[near], log[near], phi[near]))
        w, e, node, before, log, phi = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64 if i < 4 else np.float64) for i in range(6))
        top = np.full(d, -np.inf)
        np.maximum.at(top, text[w], phi)
        near = phi > top[text[w]] - FAR
        w, e, node, before, log, phi = w[near], e[near], node[near], before[near], log[near], phi[near]
        made = {"text": text[w], "round": np.full(len(w), r), "word": w, "right": before, "node": node, "part": log, "phi": after[w] + log}
        made["score"] = truncated(phi, score[r][text[w]], uniform(word_key[w], (before + (r + 1 << 20)).astype(np.uint64) | np.uint64(1 << 52)))
        made["not"] = np.full((len(w), k), -1)
        made["not"][:, 0] = e
        parts = [agenda, made]
        if popped is not None and len(popped["text"]):
            # what is still left at the reopened nodes
            again = {x: popped[x] for x in (*names, "not")}
            again["not"] = np.where(np.cumsum(again["not"] < 0, 1) == 1, popped["edge"][:, None], again["not"])
            again["score"] = truncated(popped["phi"] + popped["left"], popped["score"], uniform(word_key[popped["word"]], (popped["right"] + (r + 1 << 20)).astype(np.uint64) | np.uint64(1 << 53)))
            keep = popped["left"] > -np.inf
            parts.append({x: a[keep] for x, a in again.items()})
        agenda = {x: np.concatenate([p[x] for p in parts]) for x in agenda}
        order = np.lexsort((-agenda["score"], agenda["text"]))
        t = agenda["text"][order]
        best = order[np.concatenate(([True], t[1:] != t[:-1]))] if len(order) else order
        if r == k - 1:
            break
        popped = {x: a[best] for x, a in agenda.items()}
        rest = np.ones(len(agenda["text"]), bool)
        rest[best] = False
        agenda = {x: a[rest] for x, a in agenda.items()}
        there[r + 1, popped["text"]], score[r + 1, popped["text"]] = True, popped["score"]
        # an edge among those not excluded
        lo, hi = lat.first[popped["node"]], lat.first[popped["node"] + 1]
        wide = int((hi - lo).max()) if len(lo) else 0
        edge = lo[:, None] + np.arange(wide)
        valid = edge < hi[:, None]
        edge = np.where(valid, edge, 0)
        for j in range(k):
            valid &= edge != popped["not"][:, j : j + 1]
        p = np.where(valid, np.exp(lat.logp[edge]), 0.0) if len(lo) else np.zeros((0, 1))
        u = uniform(word_key[popped["word"]], (popped["right"] + (r + 1 << 20)).astype(np.uint64) | np.uint64(1 << 54))
        run_p = np.cumsum(p, 1)
        j = np.minimum((run_p <= (u * run_p[:, -1])[:, None]).sum(1), wide - 1) if len(lo) else np.zeros(0, np.int64)
        popped["edge"] = edge[np.arange(len(lo)), j] if len(lo) else np.zeros(0, np.int64)
        taken = p[np.arange(len(lo)), j] if len(lo) else np.zeros(0)
        with np.errstate(divide="ignore"):
            popped["left"] = np.where(valid.sum(1) > 1, np.log(np.maximum(run_p[:, -1] - taken, 1e-300)), -np.inf) if len(lo) else np.zeros(0)
        own = np.full(d, -1)
        own[popped["text"]] = popped["word"]
        todo = np.flatnonzero(np.arange(n) <= own[text])
        now, right, part = lat.end[kind], np.zeros(n, np.int64), np.zeros(n)
        now[popped["word"]] = lat.source[popped["edge"]]
        right[popped["word"]] = popped["right"] + 1
        part[popped["word"]] = popped["part"] + lat.logp[popped["edge"]]
    last = np.full(d, -np.inf)
    last[agenda["text"][best]] = agenda["score"][best]
    return rounds, there, score, last


def pretokens(text: str, pattern: re.Pattern) -> list[str]:
    """The parts of a marked text that no piece joins."""
    return pattern.findall(MARK + text.replace(" ", MARK)) if text else []


SAMPLED = pa.schema([("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])


def sample_texts(vocabulary: Vocabulary, lat: Lattices, texts: list[str], keys: np.ndarray, k: int) -> tuple[np.ndarray, pa.Table]:
    """For each text and sample: the text's index, and the columns of ``SAMPLED``."""
    tokens = [pretokens(t, vocabulary.pattern) for t in texts]
    counts = np.array([len(t) for t in tokens])
    first = np.concatenate(([0], np.cumsum(counts)))
    kind = lat.numbers([w for t in tokens for w in t])
    rounds, there, score, last = sample(lat, kind, np.repeat(np.arange(len(texts)), counts), first, keys, k)
    index, number, lists, log, perturbed, included = [], [], [], [], [], []
    for r, done in enumerate(rounds):
        who = np.flatnonzero(there[r])
        past = np.concatenate(([0], done.past))[first]
        total = np.concatenate(([0.0], np.cumsum(done.logp)))[first]
        codes, ends = done.codes, past
        if (codes >= BARE).any():
            codes, begin = vocabulary.spell(codes)
            ends = begin[past]
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32()))
        lists.append(values if len(who) == len(texts) else values.take(pa.array(who)))
        index.append(who)
        number.append(np.full(len(who), r + 1))
        lp = (total[1:] - total[:-1])[who]
        log.append(lp)
        perturbed.append(score[r][who])
        with np.errstate(divide="ignore", over="ignore"):
            x = np.where(np.isneginf(last[who]), 0.0, lp - last[who])
            included.append(np.where(np.isneginf(last[who]), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 30)))))))
    return np.concatenate(index), pa.table([pa.array(np.concatenate(number), pa.int32()), pa.chunked_array(lists, pa.list_(pa.int32())), *[pa.array(np.concatenate(x)) for x in (log, perturbed, included)]], schema=SAMPLED)


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``GROUP`` bytes, each with its first place; a longer text is a run of its own. Only a
    run's texts are Python's at a time; null is as empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo = size = 0
    for i, n in enumerate([*sizes, GROUP]):
        if i > lo and (size + n > GROUP or i == len(sizes)):
            yield lo, [t or "" for t in texts.slice(lo, i - lo).to_pylist()]
            lo, size = i, 0
        size += n


def sample_pieces(docs: DataFrame, row_id: Column, text: Column, model: bytes, k: int = 2, seed: int = 0) -> DataFrame:
    """Up to ``k`` rows for each row of ``docs``: ``row_id``, ``sample`` (from 1, by falling perturbed score), ``ids``,
    ``log_prob``, ``perturbed`` and ``log_inclusion`` (log of the segmentation's probability to be among the k, given
    the next score; 0 if there is no further segmentation).

    Segmentations of a text are distinct and decode to it. A text with fewer than ``k`` has as many rows as it has.
    Null and empty texts have one segmentation, the empty one. Rows with the same id and text get the same samples;
    null is an id like others; empty tables give no rows; other columns aren't read. Texts are read whole: a batch's
    memory follows its longest text.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    given = docs.select(row_id.alias("row_id"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices_of(sent.value)
        vocabulary = lat.vocabulary
        for batch in batches:
            keys = np.array([row_key(i, seed) for i in batch.column(0).to_pylist()], np.uint64)
            for lo, texts in groups(batch.column(1)):
                index, found = sample_texts(vocabulary, lat, texts, keys[lo : lo + len(texts)], k)
                rows = pa.table([batch.column(0).take(pa.array(index + lo)), *found.columns], names=["row_id", *SAMPLED.names])
                yield from rows.combine_chunks().to_batches()

    return given.mapInArrow(scan, f"row_id {given.schema['row_id'].dataType.simpleString()}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double")


def encode(docs: DataFrame, row_id: Column, text: Column, model: bytes) -> DataFrame:
    """``row_id``, ``ids``: the library's own encoding of each whole text; none for null and empty texts."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(row_id.alias("row_id"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(sent.value)
        for batch in batches:
            for lo, texts in groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(sp.encode(texts, num_threads=1), pa.list_(pa.int32()))], ["row_id", "ids"])

    return given.mapInArrow(scan, f"row_id {given.schema['row_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, row_id: Column, ids: Column, model: bytes) -> DataFrame:
    """``row_id``, ``text`` of each row's ids; null for null ids. Raises ``IndexError`` for an id past the vocabulary."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.select(row_id.alias("row_id"), ids.cast("array<int>").alias("ids"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattices_of(sent.value).vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["row_id", "text"])

    return given.mapInArrow(scan, f"row_id {given.schema['row_id'].dataType.simpleString()}, text string")
