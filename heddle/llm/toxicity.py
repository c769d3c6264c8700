"""Toxicity by a linear-chain conditional random field over tokens.

Training (from a bounded sample of labelled rows): a token of a toxic document is first labelled toxic
where its word or one of its beginnings is far more frequent among toxic documents than among clean ones (smoothed
log-odds, and the root of the likelihood ratio, which also knows the marks of a small language). These labels train a
two-state chain: emissions are sums of weights of word features, the transitions are free, and gradients come from
forward-backward. Then the labels are estimated anew, as a bag's: the chain's marginals given that a toxic document
holds at least one toxic token, and none in a clean one; the chain is fitted to those and so on for EM_ROUNDS.

Document scores come from the chain's marginals by a logistic layer on their rate and on their expected number in the
best window, so that a short passage counts in a long text too. The layer and its threshold are fitted on
marginals of chains that have not seen the document (cross-fitting over PARTS).

Scoring runs over every token of every text. With two states the forward and backward vectors reduce to ratios that
move by Moebius maps, so a slice's tokens are cut into lanes, each lane's map is composed in parallel, the lanes are
chained, and a second parallel pass fills in all marginals exactly. Slices hold a bounded number of bytes: many short
texts, or a piece of a long one, whose ratio is carried from piece to piece in either direction.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_lengths, byte_slices, materialise, ship, type_of, worker_memory

#: The training sample: at most so many labelled rows of each class, in hash order, whatever their length.
SAMPLE_ROWS = 800
FOLDS = 5
#: Features of fewer sampled documents than this are left out.
MIN_DOCS = 3
#: Tokens of a lane, and steps after which a lane's map is scaled: emission ratios of e^30 stay far from overflow between.
LANE, RESCALE = 256, 8
CACHE_WORDS = 400_000
#: What marks toxic tokens at first: least log-odds, and least root of twice the log likelihood ratio.
MIN_ODDS, MIN_ROOT = 2.0, 4.5
#: Rounds of labels estimated from marginals, and parts of the sample for cross-fitting.
EM_ROUNDS, PARTS = 2, 3
#: Words of the window whose expected number of toxic words is a feature of the document.
WINDOW = 64
#: Tokens whose marginal reaches this are reported as offending.
OFFENDING = 0.5
#: Bytes of text, and tokens, that are worked on at a time.
SLICE_BYTES, SLICE_TOKENS = 1 << 20, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class Model:
    """Emission weights by feature, a bias, log transitions, log start ratio, and the document layer."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    start: float
    layer: np.ndarray
    digest: str = ""

    def emissions(self, words: list[bytes]) -> list[float]:
        """Log ratio of the emission of the toxic state over the clean one for each word."""
        get, bias = self.weights.get, self.bias
        return [bias + sum(get(x, 0.0) for x in features(w)) for w in words]


def core(word: bytes) -> str:
    """A word in lower case without what is not alphanumeric at its ends."""
    text = word.decode("utf-8", "replace").lower()
    a, b = 0, len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return text[a:b]


def stems(text: str) -> list[str]:
    """A word core and its beginnings of 4 to 8 characters."""
    return [f"w={text}", *(f"p={text[:n]}" for n in range(4, min(len(text), 8) + 1))]


def features(word: bytes) -> list[str]:
    text = core(word)
    return [*stems(text), f"s={text[-3:]}", f"n={min(len(text), 12)}", "u=1" if word[:1].isupper() else "u=0"]


def _scan(e: np.ndarray, reset: np.ndarray, first: float, m: np.ndarray, emit_after: bool, before: float) -> np.ndarray:
    """Ratios of a two-state chain. Forward (emit_after): x_t = E_t (m01 + m11 x) / (m00 + m10 x), x_t = E_t first
    where reset. Backward: x_t = (m01 + m11 E x) / (m00 + m10 E x) from its predecessor's E and x, and first where reset.
    ``e`` holds E for the former, and the predecessor's E for the latter; ``before`` is the ratio ahead of the first.
    """
    n = len(e)
    lanes = -(-n // LANE)
    pad = lanes * LANE - n
    e = np.concatenate([e, np.ones(pad)]).reshape(lanes, LANE).T.copy()
    # Resets are few: the lanes of each step's.
    step, lane = np.nonzero(np.concatenate([reset, np.ones(pad, bool)]).reshape(lanes, LANE).T)
    fresh = np.split(lane, np.searchsorted(step, np.arange(1, LANE)))
    # Ratios don't change with the scale of the transitions.
    m01, m10, m11 = m[0, 1] / m[0, 0], m[1, 0] / m[0, 0], m[1, 1] / m[0, 0]
    # The map x -> (p + q x) / (r + s x) of each lane, composed over its tokens.
    p, q, r, s = np.zeros(lanes), np.ones(lanes), np.ones(lanes), np.zeros(lanes)
    for t in range(LANE):
        if not emit_after:
            p, q = p * e[t], q * e[t]
        p, q, r, s = m01 * r + m11 * p, m01 * s + m11 * q, r + m10 * p, s + m10 * q
        if emit_after:
            p, q = p * e[t], q * e[t]
        new = fresh[t]
        p[new], q[new], r[new], s[new] = first * e[t, new] if emit_after else first, 0.0, 1.0, 0.0
        if t % RESCALE == RESCALE - 1:
            scale = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / scale, q / scale, r / scale, s / scale
    starts, x = np.empty(lanes), before
    for k, (a, b, c, d) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        starts[k] = x
        x = (a + b * x) / (c + d * x)
    out, x = np.empty((LANE, lanes)), starts
    for t in range(LANE):
        y = x if emit_after else x * e[t]
        x = (m01 + m11 * y) / (1 + m10 * y)
        if emit_after:
            x *= e[t]
        new = fresh[t]
        x[new] = first * e[t, new] if emit_after else first
        out[t] = x
    return out.T.reshape(-1)[:n]


def marginals(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of every token of documents laid end to end; forward and backward ratios and emission ratios too."""
    e = np.exp(np.clip(emissions, -30, 30))
    n, m = len(e), np.exp(trans)
    ends = np.cumsum(lengths)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    full = lengths > 0
    head[(ends - lengths)[full]] = True
    tail[ends[full] - 1] = True
    forward, backward, x = np.empty(n), np.empty(n), float(np.exp(start))
    for a in range(0, n, SLICE_TOKENS):
        b = min(n, a + SLICE_TOKENS)
        forward[a:b] = _scan(e[a:b], head[a:b], float(np.exp(start)), m, True, x)
        x = float(forward[b - 1])
    # Backward over reversed tokens; the transition is read the other way round.
    x, back = 1.0, m.T
    for b in range(n, 0, -SLICE_TOKENS):
        a = max(0, b - SLICE_TOKENS)
        after = np.append(e[a + 1 : b], e[b] if b < n else 1.0)
        backward[a:b] = _scan(after[::-1], tail[a:b][::-1], 1.0, back, False, x)[::-1]
        x = float(backward[a])
    both = forward * backward
    return both / (1 + both), forward, backward, e


def _transition_counts(forward: np.ndarray, backward: np.ndarray, e: np.ndarray, trans: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected transitions between the tokens t and t + 1 where inner holds for t."""
    m = np.exp(trans)
    x, y = forward[:-1], e[1:] * backward[1:]
    weight = inner[:-1] / (m[0, 0] + m[0, 1] * y + x * (m[1, 0] + m[1, 1] * y))
    return m * np.array([[weight.sum(), weight @ y], [weight @ x, (weight * x) @ y]])


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each document's values."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(lengths)])])


def _document_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A constant, and the logarithms of the marginals' smoothed rate and of their sum in the best window.

    The rate is the sum over a hundred words more than the document has, so that a chance hit weighs little in a short
    text and many words do not make up for it in a long one.
    """
    ends, full = np.cumsum(lengths), lengths > 0
    upto, best = np.concatenate([[0.0], np.cumsum(p)]), np.zeros(len(lengths))
    if full.any():
        inside = upto[np.minimum(np.arange(len(p)) + WINDOW, np.repeat(ends, lengths))] - upto[:-1]
        best[full] = np.maximum.reduceat(inside, (ends - lengths)[full])
    sums = np.maximum(upto[ends] - upto[ends - lengths], 0)
    return np.stack([np.ones(len(lengths)), 5 + np.log((sums + 0.1) / (lengths + 100)), np.log(best + 0.1)], 1)


def marks_toxic(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Whether a feature of c1 among n1 toxic and c0 among n0 clean documents is far more frequent among the former."""
    odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
    part = lambda x, mean: x * np.log(np.maximum(x, 1e-9) / mean)
    share = (c1 + c0) / (n1 + n0)
    ratio = part(c1, n1 * share + 1e-9) + part(c0, n0 * share + 1e-9) + part(n1 - c1, n1 * (1 - share) + 1e-9) + part(n0 - c0, n0 * (1 - share) + 1e-9)
    return (c1 >= 3) & (odds >= MIN_ODDS) & (np.sqrt(2 * np.maximum(ratio, 0)) >= MIN_ROOT)


@dataclass
class _Sample:
    """Documents as numbers: words of documents end to end, and the features of each distinct word."""

    y: np.ndarray
    lengths: np.ndarray
    flat: np.ndarray
    first: np.ndarray
    feats: np.ndarray
    names: list[str]

    def of(self, chosen: np.ndarray) -> _Sample:
        return _Sample(self.y[chosen], self.lengths[chosen], self.flat[np.repeat(chosen, self.lengths)], self.first, self.feats, self.names)


def _numbered(texts: list[bytes], labels: list[int]) -> _Sample:
    vocabulary: dict[bytes, int] = {}
    flat, lengths = array("q"), []
    for text in texts:
        n = len(flat)
        for piece in _pieces(text):
            flat.extend(vocabulary.setdefault(w, len(vocabulary)) for w in piece.split())
        lengths.append(len(flat) - n)
    number: dict[str, int] = {}
    feats, first = array("q"), array("q", [0])
    for w in vocabulary:
        feats.extend(number.setdefault(x, len(number)) for x in features(w))
        first.append(len(feats))
    as_array = lambda a: np.frombuffer(a, np.int64) if a else np.empty(0, np.int64)
    return _Sample(np.array(labels, np.int64), np.array(lengths, np.int64), as_array(flat), as_array(first), as_array(feats), list(number))


def _bag_labels(p: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marginals given that each toxic document holds a toxic token, and zero in clean ones."""
    any_toxic = -np.expm1(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), lengths))
    return np.where(np.repeat(y == 1, lengths), np.minimum(p / np.repeat(np.maximum(any_toxic, 1e-9), lengths), 1.0), 0.0)


def _fit_chain(sample: _Sample, rounds: int, em_rounds: int, decay: float) -> Model:
    """Trains the chain: to seeds first, then to labels estimated from its own marginals."""
    y, lengths, flat, words = sample.y, sample.lengths, sample.flat, len(sample.first) - 1
    word_of, feat_of = np.repeat(np.arange(words), np.diff(sample.first)), sample.feats
    in_docs = np.zeros((2, len(sample.names)), np.int64)
    ends = np.cumsum(lengths)
    for label, a, b in zip(y.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
        used = np.unique(flat[a:b])
        in_docs[label, np.unique(np.concatenate([feat_of[sample.first[i] : sample.first[i + 1]] for i in used]) if len(used) else used)] += 1
    is_stem = np.array([x[:2] in ("w=", "p=") and x != "w=" for x in sample.names], bool)
    n1 = max(int((y == 1).sum()), 1)
    bad = is_stem & marks_toxic(in_docs[1], in_docs[0], n1, max(len(y) - n1, 1)) if len(is_stem) else is_stem
    is_bad = np.bincount(word_of, bad[feat_of], minlength=words) > 0
    gold = (is_bad[flat] & np.repeat(y == 1, lengths)).astype(float) if len(flat) else np.empty(0)
    frequent = in_docs.sum(axis=0) >= MIN_DOCS
    place, kept = np.cumsum(frequent) - 1, frequent[feat_of]
    word_of, feat_of = word_of[kept], place[feat_of[kept]]
    names = [x for x, f in zip(sample.names, frequent.tolist(), strict=True) if f]
    weights, bias, trans, start = np.zeros(len(names)), -2.0, np.zeros((2, 2)), 0.0
    n = len(flat)
    if n and gold.any():
        full = lengths > 0
        tail = np.zeros(n, bool)
        tail[ends[full] - 1] = True
        inner, head = ~tail, (ends - lengths)[full]
        scale_w, scale_s, scale_b, scale_t = np.full(len(names), 1e-8), 1e-8, 1e-8, np.full((2, 2), 1e-8)
        for em in range(em_rounds + 1):
            g, h = gold[:-1][inner[:-1]], gold[1:][inner[:-1]]
            seen = np.array([[((1 - g) * (1 - h)).sum(), ((1 - g) * h).sum()], [(g * (1 - h)).sum(), (g * h).sum()]])
            gold_by_word = np.bincount(flat, gold, minlength=words)
            for _ in range(rounds if em == 0 else rounds // 3):
                emitted = (np.bincount(word_of, weights[feat_of], minlength=words) + bias)[flat]
                p, forward, backward, e = marginals(emitted, lengths, trans, start)
                by_word = np.bincount(flat, p, minlength=words) - gold_by_word
                grad = np.bincount(feat_of, by_word[word_of], minlength=len(names)) + decay * n / 100 * weights
                moves = _transition_counts(forward, backward, e, trans, inner) - seen
                at_start = float((p[head] - gold[head]).sum())
                # AdaGrad: each parameter has its own falling step.
                scale_w += grad**2
                weights -= 0.5 * grad / np.sqrt(scale_w)
                total = float(by_word.sum())
                scale_b += total**2
                bias -= 0.3 * total / np.sqrt(scale_b)
                scale_t += moves**2
                trans -= 0.3 * moves / np.sqrt(scale_t)
                scale_s += at_start**2
                start -= 0.3 * at_start / np.sqrt(scale_s)
            if em < em_rounds:
                emitted = (np.bincount(word_of, weights[feat_of], minlength=words) + bias)[flat]
                gold = _bag_labels(marginals(emitted, lengths, trans, start)[0], lengths, y)
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias, trans, start, np.zeros(3))


def _seen_by(model: Model, sample: _Sample) -> np.ndarray:
    """Document features of a sample under a model."""
    weight = np.array([model.weights.get(x, 0.0) for x in sample.names])
    word_of = np.repeat(np.arange(len(sample.first) - 1), np.diff(sample.first))
    by_word = np.bincount(word_of, weight[sample.feats], minlength=len(sample.first) - 1) + model.bias
    return _document_features(marginals(by_word[sample.flat], sample.lengths, model.trans, model.start)[0], sample.lengths)


def _fit_layer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic layer with a small ridge, its constant moved to where it tells both classes apart best."""
    layer = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[0.3] * (x.shape[1] - 1)])
    for _ in range(50):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(layer))
        layer -= np.linalg.solve(h, x.T @ (q - y) + ridge @ layer)
    z = x @ layer
    order = np.argsort(z, kind="stable")
    below = np.concatenate([[0], np.cumsum(y[order] == 1)]) / max((y == 1).sum(), 1)
    clean = np.concatenate([[0], np.cumsum(y[order] == 0)]) / max((y == 0).sum(), 1)
    gain = clean - below
    cuts = np.concatenate([[z[order[0]] - 1], (z[order][1:] + z[order][:-1]) / 2, [z[order[-1]] + 1]])
    # Of the cuts that are nearly best, the one nearest to the layer's own.
    good = cuts[gain >= gain.max() - 0.002]
    layer[0] -= good[np.abs(good).argmin()]
    return layer


def _part(sample: _Sample, parts: np.ndarray, k: int, *how) -> Model | np.ndarray | None:
    """The chain of the whole sample for k = -1, else the features of part k's documents under a chain of the rest."""
    if k < 0:
        return _fit_chain(sample, *how)
    own, rest = parts == k, parts != k
    if own.any() and len(np.unique(sample.y[rest])) == 2:
        return _seen_by(_fit_chain(sample.of(rest), *how), sample.of(own))
    return None


def _part_batches(batches: Iterator[pa.RecordBatch], shared, *how) -> Iterator[pa.RecordBatch]:
    worker_memory("toxicity fit")  # what an earlier operator remembers goes before the fit takes its share
    for batch in batches:
        ks = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([pickle.dumps(_part(*shared.value, k, *how)) for k in ks], pa.binary())], names=["k", "fitted"])


def fit(texts: list[bytes], labels: list[int], rounds: int = 30, em_rounds: int = EM_ROUNDS, decay: float = 1e-4, spark: SparkSession | None = None) -> Model:
    """Trains the chain and the document layer. Without both classes every score is that of the only class.

    Equal texts with equal labels count once, so that a much copied text teaches no more than another. With a session
    the chains of the whole sample and of its parts are fitted at the same time, each by a task of its own.
    """
    pairs = list(dict.fromkeys(zip(texts, labels, strict=True)))
    sample, how = _numbered([t for t, _ in pairs], [y for _, y in pairs]), (rounds, em_rounds, decay)
    y, parts = sample.y, np.array([hash_order(t)[0] % PARTS for t, _ in pairs], np.int64)
    both = len(np.unique(y)) == 2
    ks = range(-1, PARTS if both else 0)
    if spark is None:
        fitted = {k: _part(sample, parts, k, *how) for k in ks}
    else:
        shared = spark.sparkContext.broadcast((sample, parts))
        rows = spark.range(ks.start, ks.stop, 1, len(ks)).mapInArrow(lambda b: _part_batches(b, shared, *how), "k long, fitted binary").collect()
        fitted = {r["k"]: pickle.loads(r["fitted"]) for r in rows}
    model = fitted.pop(-1)
    if not both:
        model.layer = np.array([4.0 if len(y) and y[0] else -4.0, 0, 0])
    else:
        x, known = np.zeros((len(y), 3)), np.zeros(len(y), bool)
        for k, seen in fitted.items():
            if seen is not None:
                x[parts == k], known[parts == k] = seen, True
        if len(np.unique(y[known])) < 2:
            x, known = _seen_by(model, sample), np.ones(len(y), bool)
        model.layer = _fit_layer(x[known], y[known])
    model.digest = hashlib.sha256(pickle.dumps((sorted(model.weights.items()), model.bias, model.trans.tolist(), model.start))).hexdigest()
    return model


def _word_emissions(model: Model, words: list[bytes]) -> np.ndarray:
    known = worker_memory(f"toxicity {model.digest}")
    try:
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
    except KeyError:
        if len(known) > CACHE_WORDS:
            known.clear()
        missing = list(set(words).difference(known))
        known.update(zip(missing, model.emissions(missing), strict=True))
        out = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        for w in missing:
            if len(w) > 64:  # long words come once and would hold much
                del known[w]
        return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about SLICE_BYTES, cut at white space."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = _SPACE.search(text, at + SLICE_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def score_texts(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[int]]]:
    """Scores of whole texts, and for each the numbers of its offending words."""
    scores, offending = np.empty(len(texts)), [[] for _ in texts]
    for first, end in byte_slices(np.array([len(t or b"") for t in texts], np.int64), SLICE_BYTES):
        lengths, emitted = np.zeros(end - first, np.int64), []
        if end - first == 1:
            for piece in _pieces(texts[first] or b""):
                words = piece.split()
                lengths[0] += len(words)
                emitted.append(_word_emissions(model, words))
        else:
            split = [(t or b"").split() for t in texts[first:end]]
            lengths[:] = list(map(len, split))
            emitted.append(_word_emissions(model, [w for words in split for w in words]))
        p = marginals(np.concatenate(emitted), lengths, model.trans, model.start)[0]
        # Rounded, so that how rows fall into slices does not show in the last digits.
        scores[first:end] = np.round(1 / (1 + np.exp(-np.clip(_document_features(p, lengths) @ model.layer, -30, 30))), 9)
        ends, at = np.cumsum(lengths), np.flatnonzero(p >= OFFENDING)
        owner = np.searchsorted(ends, at, "right")
        for i, k in zip(owner.tolist(), (at - (ends - lengths)[owner]).tolist(), strict=True):
            offending[first + i].append(k)
    return scores, offending


def _scored(batches: Iterator[pa.RecordBatch], model: Model, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[int]]]]:
    for batch in batches:
        texts = batch.column(column)
        texts = texts if pa.types.is_binary(texts.type) else texts.cast(pa.binary())
        for a, b in byte_slices(byte_lengths(texts), SLICE_BYTES):
            yield batch.slice(a, b - a), *score_texts(model, texts.slice(a, b - a).to_pylist())


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for part, scores, offending in _scored(batches, shared.value, 1):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(offending, pa.list_(pa.int64()))], names=["id", "score", "offending"])


def held_out(id_col: Column) -> Column:
    """Rows whose labels training must not see: crc32 of the id as text divides by FOLDS; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the whole texts of at most sample_rows labelled rows of each class, none of them held out.

    The rows are the first in the order of a hash of the id; null labels, ids and texts are left out. An id with both
    labels counts as toxic; of several texts of an id the least is taken, so that reruns agree.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    # Labels without a text go before the sample is cut, so that its size does not depend on how many there are.
    there = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    known = known.join(there, "id", "left_semi")
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * sample_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.col("text").cast("binary")).alias("text"))
    found = materialise(found, "labelled")
    ids = sorted(((r["y"], hash_order(r["id"]), r["id"]) for r in found.select("id", "y").collect()), key=lambda x: x[:2])
    kept = {i for y in (0, 1) for *_, i in [x for x in ids if x[0] == y][:sample_rows]}
    rows = [r for r in found.where(F.col("id").isin(*kept)).toLocalIterator()] if kept else []
    rows.sort(key=lambda r: (r["y"], hash_order(r["id"])))
    ship(docs.sparkSession)
    return fit([bytes(r["text"]) for r in rows], [r["y"] for r in rows], spark=docs.sparkSession)


def hash_order(key: object) -> tuple[int, str]:
    """A repeatable shuffle of ids."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(key if isinstance(key, bytes) else str(key)), str(key)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, offending)`` for every row: the score of its whole text, and the numbers of its offending words.

    Null and empty texts get the score of a text without toxic tokens; a very long one is worked on in pieces, with the
    same result. Repeated rows come back as often as they came
    in. Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: _score_batches(b, shared), f"id {type_of(docs, id_col)}, score double, offending array<long>")


def _clean_batches(batches: Iterator[pa.RecordBatch], shared, text_at: int, limit: float) -> Iterator[pa.RecordBatch]:
    for part, scores, _ in _scored(batches, shared.value, text_at):
        yield part.filter(pa.array(scores < limit))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score is below ``limit``, with all their columns, without a shuffle.

    Each row is judged by its own whole text, however long; null and empty texts have the score of a text without toxic
    tokens; repeated rows stay or go together; ids are not looked at; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, text_at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _clean_batches(b, shared, text_at, limit), docs.schema)
