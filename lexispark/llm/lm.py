"""Language-model scores by masked pseudo-likelihood.

A network sees SIDE words on both sides of a masked one and predicts it; the sum of the log-probabilities of
all words, each masked in turn, scores a document. The words are the most frequent ones of the corpus, CLASS to a
class by rank of frequency: the network predicts the class, then the word in its class. Words beyond these are
a class of their own, within which they are spelled: a model of three bytes in a row, counted over all of
them, tells a likely word from garbage. So every word has a probability of its own, and all of them sum to 1.

Training is distributed: in each round every task starts from the same network, runs mini-batches over masked
words of all its documents, and Spark averages what the tasks have learned, parameter by parameter. The rounds
together mask every word of every document once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexispark.llm._spark import cut, drop_cut, exact, load, released, without
from lexispark.llm._text import ALNUM, U64, Words, blocks, by_doc, folded, table, utf8, words

#: Words of a class, classes of frequent words, words seen on each side, length of a word's vector.
CLASS, CLASSES, SIDE, DIM = 64, 64, 3, 16
FREQUENT = CLASS * CLASSES
#: Rare words that stand in a window are told apart by this many kinds of their hash; what is predicted isn't.
KINDS = 64
#: Inputs: 0 is beyond the edge of a document, then frequent words, then kinds of rare ones.
INPUTS = 1 + FREQUENT + KINDS
#: Bytes as the spelling model knows them; 0 is an edge of the word.
LETTERS = 128
#: Each of ROUNDS masks its share of all words, in mini-batches of about BATCH to MOST words.
ROUNDS, BATCH, MOST = 3, 2048, 1 << 14
#: Rows of a softmax at a time, so that temporaries stay in cache.
ROWS = 2048
_VALUES = folded(table(5))
_LETTER = np.zeros(256, np.int64)
_LETTER[0x30:0x3A] = 1 + np.arange(10)
_LETTER[0x61:0x7B] = _LETTER[0x41:0x5B] = 11 + np.arange(26)
_LETTER[0x80:0xC0] = 37 + np.arange(64)
_LETTER[0xC0:] = 101 + np.arange(64) % (LETTERS - 101)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition's documents with their counts."""
    for batch in batches:
        data, offs = utf8(batch.column(0))
        found = [words(data, offs[i : j + 1], ALNUM, _VALUES).hash for i, j in blocks(offs)]
        word, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], ["word", "n"])


class Vocabulary:
    """Hashes of the FREQUENT most frequent words by rank, of equally frequent ones those of lower hash first; and all counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        self.hash = hashes.astype(np.uint64)
        self.counts = counts.astype(np.float64)
        self.rare = max(0.0, total - self.counts.sum())
        self.order = np.argsort(self.hash)
        self.sorted = self.hash[self.order]
        # words by the first 16 bits of their hashes: where they begin, and how many share them at most
        head = (self.sorted >> U64(48)).astype(np.int64)
        self.first = np.searchsorted(head, np.arange(1 << 16)).astype(np.int32)
        self.most = int(np.bincount(head).max()) if len(head) else 0

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, FREQUENT for rare ones."""
        out = np.full(len(hashes), FREQUENT, np.int64)
        first = self.first[(hashes >> U64(48)).astype(np.int64)]
        for k in range(self.most):
            at = np.minimum(first + k, len(self.sorted) - 1)
            known = np.flatnonzero(self.sorted[at] == hashes)
            out[known] = self.order[at[known]]
        return out


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Words of all documents are counted; FREQUENT of them and the total reach the driver."""
    counts = exact(docs, text).mapInArrow(released(_tally), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts, "words")
    size = F.floor(F.log2("n") * 4)
    sizes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("size")).collect()  # at most 4 x 64 rows
    least, have = 0, 0
    for r in sizes:
        if have < FREQUENT:
            least, have = r.size, have + r.words
    top = counts.where(size >= least).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    drop_cut(counts)
    return Vocabulary(np.array([r.word for r in top], np.int64), np.array([r.n for r in top], np.int64), sum(r.n for r in sizes))


class Windows:
    """Of some documents: the words, their ranks, and what the network reads around each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, vocab: Vocabulary):
        self.data, self.base = data[int(offs[0]) : int(offs[-1])], int(offs[0])
        self.found = words(data, offs, ALNUM, _VALUES)
        self.rank = vocab.ranks(self.found.hash)
        symbol = 1 + self.rank
        rare = np.flatnonzero(self.rank == FREQUENT)
        symbol[rare] += (self.found.hash[rare] >> U64(40)).astype(np.int64) % KINDS
        # documents with SIDE edges between them, so that a window is a slice
        n, docs = self.found.counts, len(self.found.counts)
        self.place = np.arange(len(symbol)) + SIDE * (1 + np.repeat(np.arange(docs), n))
        self.line = np.zeros(len(symbol) + SIDE * (docs + 1), np.uint16)
        self.line[self.place] = symbol

    def around(self, at: np.ndarray) -> np.ndarray:
        """Inputs around the words ``at``, a column for each place."""
        return _around(self.line, self.place[at])

    def spelled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the spelling model that the words ``at`` use, one for each byte and one for the end; and where each word's begin."""
        start, size = self.found.start[at], self.found.end[at] - self.found.start[at]
        upto = np.concatenate([[0], np.cumsum(size + 1)])
        inside = np.arange(upto[-1]) - np.repeat(upto[:-1], size + 1)
        byte = np.repeat(start, size + 1) + inside
        letter = _LETTER[self.data[np.minimum(byte, len(self.data) - 1)]]
        letter[upto[1:] - 1] = 0
        one, two = np.zeros_like(letter), np.zeros_like(letter)
        one[1:], two[2:] = letter[:-1], letter[:-2]
        one[inside == 0] = 0
        two[inside < 2] = 0
        return (two * LETTERS + one) * LETTERS + letter, upto


def _around(line: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.stack([line[place + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]).T


SHAPES = {"input": (INPUTS, DIM), "place": (2 * SIDE, DIM), "hidden": (DIM,), "class": (CLASSES + 1, DIM), "class_bias": (CLASSES + 1,), "word": (FREQUENT, DIM), "word_bias": (FREQUENT,)}


class Network:
    """tanh of the weighted sum of the window's vectors, a softmax over classes, and one over the words of a class."""

    def __init__(self, vocab: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
        self.p["place"][:] = 1
        counts = np.zeros(FREQUENT)
        counts[: len(vocab.counts)] = vocab.counts
        by_class = np.append(counts.reshape(CLASSES, CLASS).sum(1), vocab.rare)
        self.p["class_bias"] = np.log((by_class + 0.5) / (by_class.sum() + 1)).astype(np.float32)
        self.p["word_bias"] = np.log(counts + 0.5).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])

    def take(self, flat: np.ndarray) -> Network:
        at = 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        a = np.tile(self.p["hidden"], (len(around), 1))
        for k in range(2 * SIDE):
            a += np.take(self.p["input"] * self.p["place"][k], around[:, k], axis=0)
        return np.tanh(a, out=a)

    def log_probabilities(self, around: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log P(word | window); for rare words that of being rare."""
        order, edges = _by_class(rank // CLASS)
        h, rank = np.take(self.hidden(around), order, axis=0), rank[order]
        found = np.zeros(len(rank), h.dtype)
        for kind, own, target, some in _softmaxes(rank, edges):
            found[some] += _chances(h[some], self.p[kind][own], self.p[f"{kind}_bias"][own], target)[0]
        out = np.empty_like(found)
        out[order] = found
        return out

    def step(self, around: np.ndarray, rank: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-probability of a batch, and its gradient."""
        n = len(rank)
        order, edges = _by_class(rank // CLASS)
        h, rank, loss = np.take(self.hidden(around), order, axis=0), rank[order], 0.0
        g = {k: np.zeros_like(x) for k, x in self.p.items()}
        dh = np.zeros_like(h)
        for kind, own, target, some in _softmaxes(rank, edges):
            weight, x = self.p[kind][own], h[some]
            logp, dz, total = _chances(x, weight, self.p[f"{kind}_bias"][own], target)
            loss -= float(logp.sum())
            dz *= (1 / total)[:, None]
            dz[np.arange(len(dz)), target] -= 1
            g[kind][own] += dz.T @ x
            g[f"{kind}_bias"][own] += np.ones(len(dz), dz.dtype) @ dz
            dh[some] += dz @ weight
        da = np.empty_like(h)
        da[order] = dh * (1 - h * h)
        g["hidden"] = da.sum(0)
        for k in range(2 * SIDE):
            order = np.argsort(around[:, k].astype(np.uint16), kind="stable")  # of 16 bits, which numpy sorts by radix
            key = around[order, k]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, sums = key[edge], np.add.reduceat(np.take(da, order, axis=0), edge)
            g["place"][k] = (sums * self.p["input"][key]).sum(0)
            g["input"][key] += sums * self.p["place"][k]
        return loss / n, {k: x / n for k, x in g.items()}

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.01) -> tuple[float, int]:
        """Adam over mini-batches of (inputs around, rank); the words seen, and the sum of their losses, each before its step."""
        m, v, total, words = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0.0, 0
        for t, (around, rank) in enumerate(batches, 1):
            loss, g = self.step(around, rank)
            total, words = total + loss * len(rank), words + len(rank)
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                self.p[k] -= np.float32(rate / (1 - 0.9**t)) * m[k] / (np.sqrt(v[k] / (1 - 0.99**t)) + np.float32(1e-8))
        return total, words


def _chances(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P of the targets under a softmax of each row; its terms, and their sum."""
    z = h @ weight.T
    z += bias
    if np.abs(weight).sum(1).max() + np.abs(bias).max() > 80:  # else no term is too large or too small, as h is a tanh
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return own - np.log(total), z, total


def _softmaxes(rank: np.ndarray, edges: list[tuple[int, int, int]]) -> Iterator[tuple[str, slice, np.ndarray, slice]]:
    """What words in order of class need, ROWS at a time: the parameters, which of them, the targets among these, and the words."""
    for lo in range(0, len(rank), ROWS):
        yield "class", slice(None), rank[lo : lo + ROWS] // CLASS, slice(lo, lo + ROWS)
    for c, lo, hi in edges:
        for i in range(lo, hi, ROWS):
            some = slice(i, min(i + ROWS, hi))
            yield "word", slice(c * CLASS, (c + 1) * CLASS), rank[some] - c * CLASS, some


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and (class, lo, hi) of the classes of frequent words in it."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    return order, [(c, int(edges[c]), int(edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]


def _lines(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Documents as the network reads them: the inputs of a block of documents, 16 bits each, zeros between documents."""
    for batch in batches:
        data, offs = utf8(batch.column(0))
        for i, j in blocks(offs):
            yield pa.RecordBatch.from_arrays([pa.array([Windows(data, offs[i : j + 1], vocab).line.tobytes()], pa.binary())], ["line"])


def masked(batches: Iterator[pa.RecordBatch], turn: int, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Mini-batches of the words that a turn masks; ``rounds`` turns mask each word once, in an order that no pattern of a text follows."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    full: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for x in batch.column(0):
            line = np.frombuffer(x.as_buffer(), np.uint16)
            at = np.flatnonzero(line)
            at = at[np.random.default_rng(len(at)).permutation(len(at))[turn::rounds]]
            for lo in range(0, len(at), MOST):
                some = at[lo : lo + MOST]
                kept.append((_around(line, some), np.minimum(line[some].astype(np.int64) - 1, FREQUENT)))
                if sum(len(r) for _, r in kept) >= BATCH:
                    if full:
                        yield _joined(full)
                    full, kept = kept, []
    if full or kept:  # words too few for a step of their own go with the batch before
        yield _joined(full + kept)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    around, rank = zip(*parts, strict=True)
    return np.concatenate(around), np.concatenate(rank)


def learn(docs: DataFrame, vocab: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> tuple[Network, list[float]]:
    """A network trained on every word of all documents, and the mean loss of each round's words before their steps.

    What the network reads of the documents is written once, two bytes a word, so that all rounds see the same
    words in the same order. A task returns its parameters times the words it has masked; the sums go to the
    driver, a row for each parameter, whatever the number of documents.
    """
    net, losses = Network(vocab), []
    size = len(net.flat())
    known = docs.sparkSession.sparkContext.broadcast(vocab)
    lines = cut(exact(docs, text).mapInArrow(released(lambda batches: _lines(batches, known.value)), "line binary"), "lines")
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            own = Network(known.value).take(sent.value)
            loss, seen = own.train(masked(batches, turn, rounds), 0.01 / (1 + turn))
            if seen:
                w = np.append(own.flat().astype(np.float64) * seen, [loss, seen])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(w)], ["i", "w"])

        got = lines.mapInArrow(released(run), "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).toPandas()
        sent.unpersist()
        if not len(got):  # fewer words than rounds: this one's share is empty
            continue
        w = np.zeros(size + 2)
        w[got["i"].to_numpy(np.int64)] = got["w"].to_numpy()
        net.take(w[:-2] / w[-1])
        losses.append(float(w[-2] / w[-1]))
    drop_cut(lines)
    return net, losses


def spelling(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> np.ndarray:
    """log P(byte | two before) of rare words, from counts over all documents; LETTERS ** 3 cells at most reach the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in blocks(offs):
                seen = Windows(data, offs[i : j + 1], sent.value)
                np.add.at(total, seen.spelled(np.flatnonzero(seen.rank == FREQUENT))[0], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["c", "n"])

    got = exact(docs, text).mapInArrow(released(run), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    n3 = np.zeros(LETTERS**3)
    n3[got["c"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return spelling_table(n3.reshape(LETTERS, LETTERS, LETTERS))


def spelling_table(n3: np.ndarray) -> np.ndarray:
    """Each length of context is smoothed by the next shorter one."""
    n2 = n3.sum(0)
    p1 = (n2.sum(0) + 1) / (n2.sum() + LETTERS)
    p2 = (n2 + 4 * p1) / (n2.sum(1, keepdims=True) + 4)
    p3 = (n3 + 4 * p2) / (n3.sum(2, keepdims=True) + 4)
    return np.log(p3).astype(np.float32).ravel()


ADDED = [StructField("n_tokens", LongType()), StructField("pll", DoubleType()), StructField("mean_pll", DoubleType())]


def word_scores(seen: Windows, net: Network, spelled: np.ndarray) -> np.ndarray:
    """log P of each word given the words around it."""
    out = np.zeros(len(seen.rank))
    for lo in range(0, len(out), 1 << 15):
        at = np.arange(lo, min(lo + (1 << 15), len(out)))
        out[at] = net.log_probabilities(seen.around(at), seen.rank[at])
    rare = np.flatnonzero(seen.rank == FREQUENT)
    if len(rare):
        cells, upto = seen.spelled(rare)
        out[rare] += np.add.reduceat(spelled[cells].astype(np.float64), upto[:-1])
    return out


def apply(docs: DataFrame, vocab: Vocabulary, net: Network, spelled: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with scores under given models."""
    rest = without(docs, [f.name for f in ADDED], keep=(text,))
    schema = StructType([*rest.schema.fields, *ADDED])
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, net, spelled))  # of fixed size, whatever the input: under 10 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net, spelled = sent.value
        for batch in batches:
            data, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            n, pll = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j in blocks(offs):
                seen = Windows(data, offs[i : j + 1], vocab)
                n[i:j] = seen.found.counts
                pll[i:j] = by_doc(word_scores(seen, net, spelled), seen.found.first, np.add, 0.0)
            mean = pa.array(pll / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, pa.array(n), pa.array(pll), mean], arrow, strict=True)], schema=arrow)

    return rest.mapInArrow(released(run), schema)


def score(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with n_tokens, pll (sum of the log-probabilities of all words, each masked) and mean_pll.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Vocabulary, spelling and
    training cover all rows, repeated ones as often as they occur: each round masks its share of the words, and
    the rounds together every word once. Null, empty and wordless texts have a pll of 0
    and a null mean; columns that clash with the added ones, in any case, are replaced; an empty table stays
    empty.

    Word counts are aggregated before they are shuffled; the driver gets FREQUENT words, LETTERS ** 3 counts
    at most and one number for each parameter of the network. Texts stay where they are. A task that is run again
    learns the same from the same documents.
    """
    vocab = vocabulary(docs, text)
    net, _ = learn(docs, vocab, text, rounds)
    return apply(docs, vocab, net, spelling(docs, vocab, text), text)


# ---------------------------------------------------------------------------------------------- query


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a network trained on all of them."""
    done = score(exact(load(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_tokens", "pll", "mean_pll")
