"""Domain concepts in texts: a substring join with a vocabulary, without a join.

The vocabulary travels with the search; each text is searched for all terms in its own row, so nothing is
shuffled, and no pair of a text and a term that isn't in it exists as a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.sources.vocabulary import Vocabulary

#: Terms up to which each text is searched term by term; beyond, one automaton finds all in a pass.
NATIVE_TERMS = 2000
#: Texts that are searched together.
SLICE = 500
MATCH = "struct<matched_term:string,canonical_term:string,capabilities:array<string>,category:string,start:int,end:int,confidence:double,context:string>"


def _info(vocabulary: Vocabulary) -> Column:
    """What a match says of its term, by the term's number."""
    one = lambda w, size, e: F.struct(
        F.lit(w).alias("written"), F.lit(size).alias("size"), F.lit(e.canonical_term).alias("name"), F.lit(e.category).alias("category"), F.array(*map(F.lit, e.capabilities)).cast("array<string>").alias("caps")
    )
    return F.array(*[one(w, len(t), vocabulary.entries[e]) for t, w, e, _ in vocabulary.terms])


def _finder(vocabulary: Vocabulary, every: bool):
    """(term number, start) of the first occurrence of each canonical term, or of every one of each term, in the order that matches are taken.

    A text is searched for each term by ``str.find``, or beyond ``NATIVE_TERMS`` by an automaton; what is found is held as
    numbers, a slice of texts at a time.
    """
    terms = [t for t, *_ in vocabulary.terms]
    size = np.array([len(t) for t in terms])
    place = np.empty(len(terms), np.int64)  # of the term among those that end together
    place[sorted(range(len(terms)), key=lambda i: (-size[i], *vocabulary.terms[i][2:]))] = np.arange(len(terms))
    names: dict[str, int] = {}
    owner = np.array([names.setdefault(vocabulary.entries[e].canonical_term.lower(), len(names)) for _, _, e, _ in vocabulary.terms])
    wide = len(terms) > NATIVE_TERMS
    numbers: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        numbers.setdefault(t, []).append(i)

    def by_term(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs, which, starts = [], [], []
        for t, own in numbers.items():
            first = np.array([x.find(t) for x in texts], np.int64)
            doc = np.flatnonzero(first >= 0)
            start = first[doc]
            if every:
                more_docs, more = [], []
                for d, at in zip(doc.tolist(), start.tolist(), strict=True):
                    find = texts[d].find
                    while (at := find(t, at + 1)) >= 0:
                        more_docs.append(d)
                        more.append(at)
                doc, start = np.append(doc, np.array(more_docs, np.int64)), np.append(start, np.array(more, np.int64))
            for i in own:
                docs.append(doc)
                which.append(np.full(len(doc), i))
                starts.append(start)
        return np.concatenate(docs), np.concatenate(which), np.concatenate(starts)

    def by_automaton(texts: list[str], machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = []
        for d, text in enumerate(texts):
            seen: set[int] = set()
            for end, own in machine.iter(text):
                for i in own:
                    if every or i not in seen:
                        seen.add(i)
                        rows.append((d, i, end - len(terms[i]) + 1))
        return tuple(np.array(rows, np.int64).reshape(-1, 3).T)

    def built():
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t, own in numbers.items():
            machine.add_word(t, own)
        machine.make_automaton()
        return machine

    def found(texts: list[str], machine) -> pa.Array:
        doc, i, start = by_term(texts) if machine is None else by_automaton(texts, machine)
        end = start + size[i]
        if not every:  # the first of each canonical term
            order = np.lexsort((place[i], end, owner[i], doc))
            head = np.ones(len(order), np.bool_)
            head[1:] = (doc[order][1:] != doc[order][:-1]) | (owner[i][order][1:] != owner[i][order][:-1])
            doc, i, start, end = (x[order[head]] for x in (doc, i, start, end))
        order = np.lexsort((place[i], end, doc))
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
        flat = pa.StructArray.from_arrays([pa.array(i[order], pa.int32()), pa.array(start[order], pa.int32())], ["i", "start"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = built() if wide else None
        for batch in batches:
            parts = [found(batch.slice(lo, SLICE).to_pylist(), machine) for lo in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(parts) if parts else found([], machine)

    # not to be pushed into filters, where it would run once more
    return F.arrow_udf(search, "array<struct<i:int,start:int>>").asNondeterministic()


def match_text(df: DataFrame, vocabulary: Vocabulary, text: str = "text", context: int | None = 50, deduplicate: bool = True, out: str = "domain_matches") -> DataFrame:
    """``df`` with the concepts in a text: array of matches, by end, then longest, then vocabulary order.

    Terms match anywhere, inside words too, without regard to case. ``deduplicate`` keeps the first match
    of each canonical term. Spans are in characters, end exclusive; ``context`` characters stand on both sides (None: no context).
    """
    if not vocabulary.terms:
        return df.withColumn(out, F.array().cast(f"array<{MATCH}>"))
    df = df.withColumn("_found", _finder(vocabulary, not deduplicate)(F.lower(F.coalesce(F.col(text), F.lit("")))))
    info, whole = _info(vocabulary), F.col(text)

    def match(x: Column) -> Column:
        term = F.element_at(info, x["i"] + 1)
        start = x["start"]
        end = start + term["size"]
        begin = F.greatest(F.lit(0), start - (context or 0))
        said = F.lit(None).cast("string") if context is None else F.substring(whole, begin + 1, end + context - begin)
        return F.struct(
            term["written"].alias("matched_term"), term["name"].alias("canonical_term"), term["caps"].alias("capabilities"), term["category"].alias("category"),
            start.alias("start"), end.alias("end"), F.lit(1.0).alias("confidence"), said.alias("context"),
        )

    return df.withColumn(out, F.transform("_found", match)).drop("_found")


def match_keywords(df: DataFrame, vocabulary: Vocabulary, keywords: str = "keywords", out: str = "keyword_matches") -> DataFrame:
    """``df`` with a match for each keyword that is a term; a term of several entries counts for the last."""
    owner = vocabulary.owner
    if not owner:
        return df.withColumn(out, F.array().cast("array<struct<matched_term:string,canonical_term:string>>"))
    lookup = F.map_from_arrays(F.array(*map(F.lit, owner)), F.array(*[F.lit(vocabulary.entries[e].canonical_term) for e in owner.values()]))
    found = F.transform(keywords, lambda k: F.struct(k.alias("matched_term"), lookup[F.lower(F.trim(k))].alias("canonical_term")))
    return df.withColumn(out, F.filter(found, lambda m: m["canonical_term"].isNotNull()))
