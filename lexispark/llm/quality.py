"""Quality rules as weak supervision: rules vote or abstain, EM learns how far to trust each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from lexispark.llm._spark import exact, load, released, without
from lexispark.llm._text import SPACE, U64, Words, blocks, by_doc, code_points, grams, mix, table, utf8, words

_VALUES = table(1)
_LINE = np.ones(256, np.bool_)
_LINE[0x0A] = False
_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, np.bool_)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_distinct_words"]
#: A base failure rejects whatever the rules say.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def _keys(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Identities that differ between documents."""
    return mix(hashes + mix(doc.astype(np.uint64) + U64(1)))


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, lead = np.unique(keys, return_index=True)
    return np.bincount(doc[lead], minlength=n)


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The counts named in ``COUNTS``, a row for each document."""
    out = np.zeros((len(offs) - 1, len(COUNTS)), np.int64)
    for i, j in blocks(offs):
        part, n = offs[i : j + 1], j - i
        found = words(data, part, SPACE, _VALUES)
        doc, points = found.docs(), code_points(data, part)
        raw = data[part[0] : part[-1]]
        out[i:j, 0] = found.counts
        out[i:j, 1] = by_doc(points[found.end] - points[found.start], found.first, np.add, 0)
        upto = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
        out[i:j, 2] = np.diff(upto[part - part[0]])
        lines = words(data, part, _LINE, _VALUES)
        real = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
        line_doc = lines.docs()[real]
        total = np.bincount(line_doc, minlength=n)
        out[i:j, 3] = total - _distinct(_keys(lines.hash[real], line_doc), line_doc, n)
        out[i:j, 4] = _repeated(found, doc, n)
        out[i:j, 5] = total
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        out[i:j, 6] = np.bincount(doc[letters[found.end] > letters[found.start]], minlength=n)
        out[i:j, 7] = _distinct(_keys(found.hash, doc), doc, n)
    return out


def _repeated(found: Words, doc: np.ndarray, n: int, size: int = 5) -> np.ndarray:
    """Words in windows of ``size`` words that occur twice or more in their document."""
    at, hashes = grams(found, size)
    if not len(at):
        return np.zeros(n, np.int64)
    keys = _keys(hashes, doc[at])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(doc) + 1, np.int64)
    cover[at[twice]] += 1
    np.subtract.at(cover, at[twice] + size, 1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])


#: Name, what it measures of a text, and the ranges in which it votes against (-1) or for (+1); it abstains elsewhere.
RULES = [
    ("symbols_per_word", lambda c: c[:, 2] / np.maximum(c[:, 0], 1), [(0.1, np.inf, -1), (0.0, 0.02, 1)]),
    ("repeated_line_share", lambda c: np.where(c[:, 5] >= 3, c[:, 3] / np.maximum(c[:, 5], 1), np.nan), [(0.34, np.inf, -1), (0.0, 0.1, 1)]),
    ("repeated_word_share", lambda c: np.where(c[:, 0] >= 10, c[:, 4] / np.maximum(c[:, 0], 1), np.nan), [(0.2, np.inf, -1), (0.0, 0.05, 1)]),
    ("mean_word_length", lambda c: np.where(c[:, 0] >= 20, c[:, 1] / np.maximum(c[:, 0], 1), np.nan), [(0.0, 3.5, -1), (7.5, np.inf, -1), (4.3, 6.3, 1)]),
    ("words_with_letters_share", lambda c: np.where(c[:, 0] >= 30, c[:, 6] / np.maximum(c[:, 0], 1), np.nan), [(0.0, 0.75, -1), (0.95, np.inf, 1)]),
    ("distinct_word_share", lambda c: np.where(c[:, 0] >= 30, c[:, 7] / np.maximum(c[:, 0], 1), np.nan), [(0.0, 0.2, -1), (0.4, np.inf, 1)]),
    ("length", lambda c: c[:, 0], [(0, MIN_WORDS, -1), (50, np.inf, 1)]),
]
PATTERNS = 3 ** len(RULES)


def votes(c: np.ndarray) -> np.ndarray:
    """Votes of all rules, a row for each document: -1, 0 (abstains) or 1. A range includes its lower end only, one that begins at 0 both."""
    out = np.zeros((len(c), len(RULES)), np.int64)
    for k, (_, measure, ranges) in enumerate(RULES):
        x = measure(c).astype(np.float64)
        for lo, hi, vote in reversed(ranges):
            out[(x >= lo) & ((x <= hi) if lo == 0 and vote > 0 else (x < hi)), k] = vote
    return out


def encode_votes(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def decode_votes(pattern: np.ndarray, rules: int) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(rules) % 3 - 1


def fit(v: np.ndarray, n: np.ndarray, rounds: int = 200, strength: float = 20.0) -> dict:
    """EM over distinct vote patterns ``v`` that ``n`` documents have.

    Two accuracies for each rule: how often a vote of it is right on good and on bad documents, given that
    it votes. A rule finds one kind of fault, so most votes on bad documents may be wrong (others found
    them), while votes on good documents seldom are; Beta priors with the weight of ``strength`` documents
    say so (0.95 and 0.5), and EM starts from that: no vote against a document means that it is probably
    good. That also fixes which of the two classes is the good one. Returns prior, right_good, right_bad and
    a function from votes to posterior probabilities of being good.
    """
    n = n.astype(np.float64)
    p = np.where((v < 0).any(1), 0.2, 0.95)
    prior, good, bad = 0.9, np.full(v.shape[1], 0.95), np.full(v.shape[1], 0.5)

    def posterior(x: np.ndarray) -> np.ndarray:
        up, down = x > 0, x < 0
        score = np.log(prior) - np.log1p(-prior) + up @ (np.log(good) - np.log1p(-bad)) + down @ (np.log1p(-good) - np.log(bad))
        return 1 / (1 + np.exp(-score))

    for _ in range(rounds):
        up, down, was = v > 0, v < 0, (prior, good, bad)
        prior = float(np.clip(((n * p).sum() + strength * 0.9) / (n.sum() + strength), 1e-4, 1 - 1e-4))
        good = np.clip(((n * p) @ up + strength * 0.95) / ((n * p) @ (up | down) + strength), 0.5, 1 - 1e-4)
        bad = np.clip(((n * (1 - p)) @ down + strength * 0.5) / ((n * (1 - p)) @ (up | down) + strength), 0.02, 1 - 1e-4)
        p = posterior(v)
        if abs(was[0] - prior) + np.abs(was[1] - good).sum() + np.abs(was[2] - bad).sum() < 1e-9:
            break
    return {"prior": prior, "right_good": good, "right_bad": bad, "posterior": posterior}


ADDED = [
    *[StructField(c, LongType()) for c in COUNTS], StructField("votes_for", IntegerType()), StructField("votes_against", IntegerType()),
    StructField("base_failed", BooleanType()), StructField("quality", DoubleType()), StructField("kept", BooleanType()),
]


def vote_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all documents and how many have each; at most ``PATTERNS`` rows reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PATTERNS, np.int64)
        for batch in batches:
            total += np.bincount(encode_votes(votes(counts(*utf8(batch.column(0))))), minlength=PATTERNS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pattern", "n"])

    found = exact(docs, text).mapInArrow(released(tally), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    return decode_votes(found["pattern"].to_numpy(np.int64), len(RULES)), found["n"].to_numpy(np.int64)


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with its counts, votes, ``base_failed``, ``quality`` (posterior probability) and ``kept``.

    Kept is what didn't fail the base and has a quality of ``threshold`` or more. Statistics cover all rows,
    repeated ones as often as they occur. Null and empty texts have no words and so fail the base. Columns
    of ``docs`` that clash with the added ones, in any case, are replaced; an empty table stays empty.

    Two passes over the texts and no shuffle of them: the first leaves one number for each vote pattern, of
    which there are at most 3 to the number of rules whatever the input, the second judges row by row.
    """
    model = fit(*vote_counts(docs, text))
    posterior = model["posterior"](decode_votes(np.arange(PATTERNS), len(RULES)))
    rest = without(docs, [f.name for f in ADDED], keep=(text,))
    schema = StructType([*rest.schema.fields, *ADDED])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = counts(*utf8(batch.column(batch.schema.get_field_index(text))))
            v = votes(c)
            quality, failed = posterior[encode_votes(v)], base_failed(c)
            added = [*c.T, (v > 0).sum(1), (v < 0).sum(1), failed, quality, ~failed & (quality >= threshold)]
            columns = [*batch.columns, *[pa.array(np.ascontiguousarray(x)) for x in added]]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rest.mapInArrow(released(run), schema)


# ---------------------------------------------------------------------------------------------- query


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents."""
    done = judge(exact(load(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
