"""Language-model scores by online logistic context mixing.

A text is a run of words and an end. The model codes it by yes-no decisions, in two steps.

Recall: where the last two words (or the last one) stood together earlier in the document, is the word that followed then said
again? Predictors are how often that came true so far in this document; the gate is how much context agreed and how often in
a row it came true. Weights are fitted on all training documents and refined further while a document is read.

Spelling: a word that isn't recalled is its bytes and an end mark, and each byte a run of decisions: its Huffman code among the bytes that
follow the two before it. For each decision several predictors (the code's own node; hashed contexts: the last three bytes, and the word
so far, each with the document's class) give a probability from exact counts over all training documents; their logits are mixed with weights that a
gate selects by what each context has seen. The class is the group of short words that the document has had most of so far (Classes); short
words that share documents are a group, so classes are languages, mostly. A word's spelling costs the same wherever it stands in a
class, so it is worked out once for each word and class.

The sum over all decisions is the logarithm of the text's probability.
"""

from __future__ import annotations

import heapq

import numpy as np
import xxhash

from .common import M1, M2, mix

#: Bytes that the first kind of context looks back (within a word); the second is the word so far, up to DEPTH bytes.
ORDER, DEPTH = 3, 64
CONTEXTS = 2
#: Stretches of a document, in recall decisions, after each of which its own weights are refined; each is four times as long.
FIRST_STRETCH = 64
#: Of a step's full length, and what is added to the curvature (as if so much had been seen).
RATE, PRIOR = 0.3, 60.0
#: How much a predictor has seen (0: nothing), and whether all of it was alike.
SEEN, N_LEVELS = (1, 2, 4, 16), 10
GATES = N_LEVELS**CONTEXTS
#: Weights before anything is seen.
SPELL_START = np.full(CONTEXTS + 1, 0.4)
RECALL_START = np.array([0.0, 1.0])
#: Classes of documents by their short words (up to so many bytes, in so many hash buckets); one more is for documents without any.
CLASSES, SHORT, BUCKETS = 8, 3, 256
STREAKS = (1, 2, 4, 16)
RECALL_GATES = 2 * (len(STREAKS) + 1)


def _huffman(weights: list[int]) -> tuple[list[list[tuple[int, int]]], int, list[float]]:
    """Paths ((inner node, bit), from the root) of each leaf, the number of inner nodes, and each one's share of yeses."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n, children = len(weights), []
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((i, j, b / (a + b)))
        heapq.heappush(heap, (a + b, n + len(children) - 1))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(n + len(children))]
    for k in range(len(children) - 1, -1, -1):
        for bit, child in enumerate(children[k][:2]):
            paths[child] = [*paths[n + k], (k, bit)]
    return paths[:n], len(children), [c[2] for c in children]


class Code:
    """Codes of bytes in context: a byte's path of decisions, node by node."""

    def __init__(self, counts: dict[int, dict[int, int]], singles: np.ndarray):
        """counts: previous two bytes -> byte -> count, of all such contexts; singles: (256, 256), last byte and byte.

        A context's own code has the bytes seen after it and a way out, which the code of its last byte follows.
        """
        n = 256 + len(counts)
        self.row = np.repeat(np.arange(256, dtype=np.intp)[None, :], 256, 0).ravel()  # by (last but one, last)
        self.at, self.depth = np.zeros((n, 257), np.int32), np.zeros((n, 257), np.int16)  # place 256: the way out
        nodes, bits, logits = [], [], []

        def put(row: int, places: list[int], weights: list[int]) -> None:
            paths, _, yes = _huffman(weights)
            for place, path in zip(places, paths, strict=True):
                self.at[row, place], self.depth[row, place] = len(nodes), len(path)
                nodes.extend(len(logits) + k for k, _ in path)
                bits.extend(bit for _, bit in path)
            logits.extend(yes)

        for last in range(256):
            put(last, list(range(256)), [int(c) * 16 + 1 for c in singles[last]])
        for row, (pair, follow) in enumerate(sorted(counts.items()), 256):
            self.row[pair] = row
            put(row, [*sorted(follow), 256], [*(16 * follow[b] for b in sorted(follow)), 8 * len(follow)])
        self.nodes, self.bits = np.array(nodes, np.int32), np.array(bits, np.uint8)
        p = np.clip(np.array(logits, np.float64), 1e-7, 1 - 1e-7)
        self.logits = np.log(p / (1 - p)).astype(np.float32)

    def spell(self, pairs: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many decisions each byte takes after its pair, then their nodes and bits, one after another."""
        own, byte = self.row.take(pairs), byte.astype(np.intp)
        way = np.where(self.depth[own, byte] > 0, byte, 256)
        rest = np.where(way == 256, self.depth[pairs & 255, byte], 0)
        n = np.stack([self.depth[own, way], rest], 1).astype(np.intp).ravel()
        at = np.stack([self.at[own, way], self.at[pairs & 255, byte]], 1).astype(np.intp).ravel()
        places = np.repeat(at - np.cumsum(n) + n, n)
        places += np.arange(len(places), dtype=np.intp)
        return n.reshape(-1, 2).sum(1), self.nodes.take(places), self.bits.take(places)


def bucket(word: bytes) -> int:
    """The bucket of a short word; one beyond the last for other words."""
    return xxhash.xxh32_intdigest(word) % BUCKETS if 0 < len(word) <= SHORT else BUCKETS


def together(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """In how many documents each two buckets of short words occur; the last is for no bucket, which all documents have.

    own: the bucket of each token, sizes: tokens in each document.
    """
    x = np.zeros((len(sizes), BUCKETS + 1), np.float32)
    x[np.repeat(np.arange(len(sizes)), sizes), own] = 1
    x[:, BUCKETS] = 1
    return (x.T @ x).astype(np.float64)


def groups(both: np.ndarray) -> np.ndarray:
    """The group of each bucket from together(), by spectral clustering of how much likelier two are in one document; and of no bucket."""
    alone, all_texts = np.diag(both)[:BUCKETS], both[BUCKETS, BUCKETS]
    have = np.flatnonzero(alone)
    out = np.full(BUCKETS + 1, CLASSES, np.int64)
    if not len(have):
        return out
    with np.errstate(divide="ignore"):
        near = np.maximum(0, np.log(both[np.ix_(have, have)] * all_texts / np.outer(alone[have], alone[have])))
    near = np.nan_to_num(near, neginf=0.0, posinf=0.0) * np.sqrt(np.outer(alone[have], alone[have]))
    size = np.sqrt(np.maximum(near.sum(1), 1e-9))
    _, axes = np.linalg.eigh(near / np.outer(size, size))
    at = axes[:, -CLASSES:]
    at = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
    centres = at[[int(np.argmax(alone[have]))]]
    while len(centres) < min(CLASSES, len(have)):  # the next is the heaviest far from all so far
        far = (1 - (at @ centres.T).max(1)) * alone[have]
        centres = np.concatenate([centres, at[[int(np.argmax(far))]]])
    for _ in range(20):
        own = np.argmax(at @ centres.T, 1)
        for k in range(len(centres)):
            if (own == k).any():
                middle = (at[own == k] * alone[have][own == k, None]).sum(0)
                centres[k] = middle / max(1e-9, float(np.linalg.norm(middle)))
    out[have] = np.argmax(at @ centres.T, 1)
    return out


def classes(group: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The class of a document just before each token, from the group of each token (CLASSES for none) and tokens in each document."""
    most, out = np.zeros(len(group), np.int32), np.full(len(group), CLASSES, np.int64)
    begun = np.repeat(np.cumsum(sizes) - sizes, sizes)
    for k in range(CLASSES):
        had = np.concatenate([[0], np.cumsum(group == k, dtype=np.int32)])
        n = had[:-1] - had[begun]
        out[n > most] = k
        most = np.maximum(most, n)
    return out


class Batch:
    """Words side by side: bytes with end marks, and what precedes each byte in its word. of: the class each word stands in."""

    def __init__(self, words: list[bytes], of: np.ndarray):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.bytes = joined = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8) if words else np.empty(0, np.uint8)
        first = np.cumsum(self.sizes) - self.sizes
        begun = np.repeat(first, self.sizes)
        since = np.arange(len(joined)) - begun
        w = np.zeros(len(joined), np.uint64)  # the bytes before, the last one lowest
        for k in range(1, ORDER + 1):
            w[k:] |= np.where(since[k:] >= k, joined[:-k], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
        self.pair = (w & np.uint64(0xFFFF)).astype(np.intp)
        own = np.repeat(mix(of.astype(np.uint64) + M2), self.sizes)
        near = own ^ mix(w + np.minimum(since, ORDER).astype(np.uint64) * M2)
        said = np.cumsum(mix(joined * M1 + since.astype(np.uint64) * M2), dtype=np.uint64)  # each byte at its place adds a number of its own
        said = np.concatenate([np.zeros(1, np.uint64), said])[:-1] if len(said) else said
        far = own ^ mix(said - said[begun] + since.astype(np.uint64) * M1) if len(said) else said
        #: For each kind of context 48 bits for what precedes a byte, then the byte. Context 0: beyond DEPTH, nothing is known.
        self.keys = [(mix(x) >> np.uint64(16) << np.uint64(8) | joined).astype(np.int64) for x in (near, far)]
        self.keys[1][since > DEPTH] &= 255


def tally(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, how often they occur if each place counts so many times, and which key each place has."""
    distinct, of = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(of, weights=times, minlength=len(distinct)).astype(np.int64), of.astype(np.int32)


class Counts:
    """What all training documents did after some contexts, for one kind of context; exact, whatever their number.

    keys (distinct, sorted), pairs (the two bytes that end each key's context) and counts: every byte after these contexts, and
    how often. A key's decisions begin at first; n0 and n1 are the noes and yeses that training documents have there, bits the key's own way.
    """

    def __init__(self, code: Code, keys: np.ndarray, pairs: np.ndarray, counts: np.ndarray):
        n, nodes, self.bits = code.spell(pairs, keys & 255)
        self.first = np.cumsum(n) - n
        counts = np.repeat(np.where(keys < 256, 0, counts), n)  # context 0 knows nothing
        yes, both = counts * self.bits, counts.copy()
        context = keys >> 8
        alone = np.ones(len(keys), bool)  # what is the only byte after its context has its decisions for itself
        alone[1:] &= context[1:] != context[:-1]
        alone[:-1] &= context[1:] != context[:-1]
        at = np.flatnonzero(~np.repeat(alone, n))
        if len(at):
            number = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]]))
            node = (np.repeat(number, n)[at] << 24) + nodes[at]
            order = np.argsort(node)
            at, node = at[order], node[order]
            new = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.append(new, len(node)))
            yes[at], both[at] = (np.repeat(np.add.reduceat(x[at], new), size) for x in (yes, both))
        self.n0, self.n1 = both - yes, yes

    def inputs(self, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Logit and level of each decision; with leave_out, one occurrence of the key itself is taken off."""
        n0, n1 = self.n0, self.n1
        if leave_out:
            n0, n1 = n0 - ((self.bits == 0) & (n0 > 0)), n1 - ((self.bits == 1) & (n1 > 0))
        levels = np.digitize(n0 + n1, SEEN) + 5 * ((n0 > 0) & (n1 > 0))
        return np.log((n1 + 0.3) / (n0 + 0.3)).astype(np.float32), levels.astype(np.int16)


def inputs(code: Code, pairs: np.ndarray, joined: np.ndarray, known: list[tuple[Counts, np.ndarray, np.ndarray, np.ndarray]]):
    """Decisions of each byte, their bits, logits of each predictor, gates. known: of each kind Counts, its inputs, the key of each byte."""
    n, nodes, bits = code.spell(pairs, joined)
    ends, step = np.cumsum(n), np.arange(len(nodes))
    logits, gate = [code.logits.take(nodes)], np.zeros(len(nodes), np.int16)
    for counts, logit, level, of in known:
        at = np.repeat(counts.first[of] - ends + n, n) + step
        logits.append(logit.take(at))
        gate = gate * np.int16(N_LEVELS) + level.take(at)
    return n, bits, logits, gate


def spelling(sizes: np.ndarray, n: np.ndarray, bits: np.ndarray, logits: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural-log probability of each word; sizes: bytes of each, with its end."""
    z = sum(x * weights[:, k].take(gate) for k, x in enumerate(logits))
    z = np.clip(np.where(bits == 1, z, -z), -30, 30)
    logs = -np.log1p(np.exp(-z))
    ends = np.cumsum(n)[np.cumsum(sizes) - 1]
    return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]])) if len(ends) else np.empty(0)


class Recall:
    """Of documents side by side: the tokens whose context stood earlier in their document, and whether the same word follows.

    tokens: numbers of words, document after document; sizes: tokens in each. Decision i is about token at[i] of document doc[i].
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        n = len(tokens)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one, two = (np.concatenate([np.zeros(min(k, n), np.uint64), tokens[: n - k].astype(np.uint64)]) if n > k else np.zeros(n, np.uint64) for k in (1, 2))
        one = mix(one + doc.astype(np.uint64) * M1)
        earlier = self._earlier(mix(one + two * M2 + M1), place >= 2)
        much = earlier >= 0
        earlier = np.where(much, earlier, self._earlier(one, place >= 1))
        self.at = np.flatnonzero(earlier >= 0)
        self.doc, much = doc[self.at], much[self.at]
        self.hit = hit = tokens[earlier[self.at]] == tokens[self.at]
        step = np.arange(len(hit))
        begun = np.searchsorted(self.doc, np.arange(len(sizes)))[self.doc]
        missed = np.maximum.accumulate(np.concatenate([[-1], np.where(hit, -1, step)[:-1]])) if len(hit) else step
        streak = step - np.maximum(missed + 1, begun)
        self.gate = much * (len(STREAKS) + 1) + np.digitize(streak, STREAKS)
        came = np.zeros(len(hit))
        tried = np.zeros(len(hit))
        for level in (False, True):
            own = np.flatnonzero(much == level)
            first = np.searchsorted(self.doc[own], np.arange(len(sizes)))[self.doc[own]]
            before = np.concatenate([[0], np.cumsum(hit[own])])
            came[own] = before[:-1] - before[first]
            tried[own] = np.arange(len(own)) - first
        self.inputs = [np.ones(len(hit), np.float32), np.log((came + 0.4) / (tried - came + 1.6)).astype(np.float32)]

    @staticmethod
    def _earlier(keys: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """The last token before each with the same key; -1 for none."""
        at = np.flatnonzero(usable)
        at = at[np.argsort(keys[at], kind="stable")]
        out, same = np.full(len(keys), -1), keys[at[1:]] == keys[at[:-1]]
        out[at[1:][same]] = at[:-1][same]
        return out

    def logs(self, weights: np.ndarray) -> np.ndarray:
        """Natural-log probability of each decision, with the document's own weights refined stretch by stretch."""
        out, docs = np.zeros(len(self.at)), int(self.doc[-1]) + 1 if len(self.doc) else 0
        z = sum(x * weights[:, k].take(self.gate) for k, x in enumerate(self.inputs))
        side = np.where(self.hit, 1.0, -1.0)
        step = np.arange(len(self.at)) - np.searchsorted(self.doc, np.arange(docs))[self.doc] if docs else self.at
        own, low, high = np.zeros((len(self.inputs), docs)), 0, FIRST_STRETCH
        while len(at := np.flatnonzero((step >= low) & (step < high))):
            d = self.doc[at]
            zz = z[at] + sum(own[k][d] * x[at] for k, x in enumerate(self.inputs))
            q = 1 / (1 + np.exp(np.clip(zz * side[at], -30, 30)))  # probability of what did not happen
            out[at] = np.log1p(-q)
            for k, x in enumerate(self.inputs):
                pull, bend = np.bincount(d, weights=q * side[at] * x[at], minlength=docs), np.bincount(d, weights=q * (1 - q) * x[at] ** 2, minlength=docs)
                own[k] += RATE * pull / (bend + PRIOR)
            low, high = high, high * 4
        return out


class Fit:
    """Sums for mixing weights: each gate's curvature, and curvature times weights plus gradient; sums of parts of a corpus add up."""

    def __init__(self, gates: int, start: np.ndarray):
        k = len(start)
        self.start, self.curve, self.pull, self.seen = start, np.zeros((gates, k, k)), np.zeros((gates, k)), 0

    def weights(self) -> np.ndarray:
        """The minimum of the quadratic that has been summed, with PRIOR towards the weights at the start."""
        return np.linalg.solve(self.curve + PRIOR * np.eye(len(self.start)), (self.pull + PRIOR * self.start)[:, :, None])[:, :, 0]

    def add(self, bits: np.ndarray, logits: list[np.ndarray], gate: np.ndarray, times: np.ndarray | int = 1) -> None:
        """Decisions, each so many times; their log-loss taken as a quadratic around the weights of what was added so far."""
        now, gates = self.weights(), len(self.pull)
        z = sum(x * now[:, k].take(gate) for k, x in enumerate(logits))
        p = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
        err, bend, curve = (bits - p) * times, p * (1 - p) * times, np.zeros_like(self.curve)
        for i, x in enumerate(logits):
            self.pull[:, i] += np.bincount(gate, weights=err * x, minlength=gates)
            for j in range(i + 1):
                curve[:, i, j] = curve[:, j, i] = np.bincount(gate, weights=bend * x * logits[j], minlength=gates)
        self.curve += curve
        self.pull += (curve @ now[:, :, None])[:, :, 0]
        self.seen += int(np.sum(times) if np.ndim(times) else len(bits) * times)

    def sums(self) -> bytes:
        return np.concatenate([self.curve.ravel(), self.pull.ravel(), [self.seen]]).tobytes()

    def take(self, sums: bytes) -> Fit:
        """Adds what sums() of another gave."""
        x, k = np.frombuffer(sums), self.curve.size
        self.curve += x[:k].reshape(self.curve.shape)
        self.pull += x[k:-1].reshape(self.pull.shape)
        self.seen += int(x[-1])
        return self
