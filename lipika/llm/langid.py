"""Language identification: word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word is scored by its character n-grams, marked at
the word's ends, of the longest length of which any is known: five characters, then four, down to one.  A document's
languages are weighed by the sums over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lipika.llm.common import broadcast_if_small, materialize

#: Documents that the model is fitted on, for each language, at most about (a hash of key and text picks them).
SAMPLE_DOCUMENTS = 4_000
#: Occurrences in a language's sample that make a word known in it; rarer ones are scored by their n-grams, like unseen ones.
KNOWN = 2
LONGEST = 5
#: Added to each count.
ALPHA = 0.1
#: Words remembered in each worker, and their scores; beyond either the memory starts anew.
MEMO_WORDS, MEMO_SCORES = 150_000, 4_000_000
UNDETERMINED = "und"


def letters(token: str) -> str:
    token = token.lower()
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Table:
    """Log frequencies by spelling and language.  Most spellings are known in few languages: a row has these only, as what they exceed the value of
    its part (words, or n-grams of one length) for languages without the spelling."""

    rows: dict[str, int]
    starts: np.ndarray
    columns: np.ndarray
    above: np.ndarray
    part: np.ndarray
    bases: np.ndarray

    @classmethod
    def of(cls, spellings: pa.Array, columns: np.ndarray, counts: np.ndarray, parts: np.ndarray, totals: list[np.ndarray]) -> Table:
        """From counts of (spelling, language), sorted by spelling, which is of one of the ``parts``; ``totals``: occurrences by language in each part."""
        codes = pc.dictionary_encode(spellings)
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        at, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        starts = np.concatenate((np.flatnonzero(np.diff(at, prepend=-1)), [len(at)])).astype(np.int64)
        part = parts[starts[:-1]]
        sizes = np.bincount(part, minlength=len(totals))
        bases = np.array([np.log(ALPHA / (total + ALPHA * size)) for total, size in zip(totals, sizes)])
        return cls(dict(zip(names, range(len(names)))), starts, columns.astype(np.int32), np.log((counts + ALPHA) / ALPHA), part, bases)

    def add(self, out: np.ndarray, owners: list[int], rows: list[int]) -> None:
        """Adds the rows to those of ``out`` that own them, by ``owners`` in order; an owner's rows are of one part."""
        if not rows:
            return
        owner, row = np.array(owners), np.array(rows)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] += self.bases[self.part[row[first]]] * np.diff(np.append(first, len(owner)))[:, None]
        length = self.starts[row + 1] - self.starts[row]
        at = np.arange(length.sum()) + np.repeat(self.starts[row] - (np.cumsum(length) - length), length)
        cell = np.repeat(owner * out.shape[1], length) + self.columns[at]
        out += np.bincount(cell, self.above[at], out.size).reshape(out.shape)


@dataclass
class Model:
    """Tables of words and of n-grams (which differ by their length, and are one table), and the languages that are their columns."""

    languages: list[str]
    words: Table | None
    grams: Table | None
    memo: dict[str, int] = field(default_factory=dict)
    seen: np.ndarray | None = None
    used: int = 0

    def remember(self, tokens: list[str]) -> None:
        """Gives each token its place in the memory; 0 without letters."""
        words = self.words.rows.get if self.words is not None else {}.get
        get = self.grams.rows.get if self.grams is not None else {}.get
        known: tuple[list[int], list[int]] = ([], [])
        unseen: tuple[list[int], list[int]] = ([], [])
        n = 0
        for token in tokens:
            word = letters(token)
            if not word:
                self.memo[token] = 0
                continue
            if (at := words(word)) is not None:
                known[0].append(n)
                known[1].append(at)
            else:
                for size in range(min(LONGEST, len(word) + 2), 0, -1):
                    found = [at for g in grams(word, size) if (at := get(g)) is not None]
                    if found:
                        unseen[0].extend([n] * len(found))
                        unseen[1].extend(found)
                        break
            self.memo[token] = self.used + n
            n += 1
        while self.used + n > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        out = self.seen[self.used : self.used + n]
        out[:] = 0.0
        if self.words is not None:
            self.words.add(out, *known)
        if self.grams is not None:
            self.grams.add(out, *unseen)
        self.used += n

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages:
            return UNDETERMINED, 0.0
        tokens = text.split()
        memo = self.memo
        if self.seen is None or len(memo) > MEMO_WORDS or self.used * len(self.languages) > MEMO_SCORES:
            memo.clear()
            # row 0: tokens without letters, which count for nothing
            self.seen, self.used = np.zeros((1024, len(self.languages))), 1
        new = list(set(tokens).difference(memo))
        for i in range(0, len(new), MEMO_WORDS):
            self.remember(new[i : i + MEMO_WORDS])
        at = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
        if not at.any():
            return UNDETERMINED, 0.0
        total = self.seen[at].sum(axis=0)
        weights = np.exp(total - total.max())
        best = int(np.argmax(weights))
        return self.languages[best], float(weights[best] / weights.sum())


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether the CRC-32 of the key as text leaves ``fold`` modulo ``folds``; false for a null key."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, fold: int = 1) -> Model:
    """A model from at most about ``SAMPLE_DOCUMENTS`` documents of each language outside the held-out fold.

    All of these documents' words and n-grams and all languages are learned.  Rows with a null key, text or language teach nothing.  Without any, every
    document is undetermined.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(
        F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("k"), folds, fold)
    )
    sizes = materialize(rows.groupBy("l").count(), "languages")
    languages = sorted(r["l"] for r in sizes.select("l").collect())
    if not languages:
        return Model([], None, None)
    share = sizes.select(F.col("l").alias("of"), F.expr(f"greatest(1, least({1 << 20}, {SAMPLE_DOCUMENTS << 20} div count))").alias("share"))
    chosen = rows.join(broadcast_if_small(share), F.col("l") == F.col("of"))
    chosen = chosen.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.col("share"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(l, Counter()).update(map(letters, t.split()))
            flat = [(l, w, n) for l, c in found.items() for w, n in c.items() if w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], ["l", "w", "n"]
            )

    counts = materialize(
        chosen.select("t", "l").mapInArrow(counted, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n")), "words"
    )

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for l, w, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size in range(1, LONGEST + 1):
                    for g in grams(w, size):
                        found[l, g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([l for l, _ in found], pa.string()), pa.array([g for _, g in found], pa.string()), pa.array(found.values(), pa.int64())], ["l", "w", "n"]
            )

    known = counts.where(F.col("n") >= KNOWN)
    by_gram = known.mapInArrow(spelled, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    column = pa.array(languages, pa.string())

    def table_of(found: DataFrame) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        got = found.toArrow().sort_by([("w", "ascending"), ("l", "ascending")])
        return got, pc.index_in(got["l"], column).to_numpy().astype(np.int64), got["n"].to_numpy().astype(float)

    def sums(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.maximum(np.bincount(columns, counts, len(languages)), 1.0)

    got, columns, n = table_of(known)
    every = counts.groupBy("l").agg(F.sum("n").alias("n")).toArrow()
    totals = sums(pc.index_in(every["l"], column).to_numpy().astype(np.int64), every["n"].to_numpy().astype(float))
    words = Table.of(got["w"], columns, n, np.zeros(len(n), dtype=np.int64), [totals]) if len(n) else None
    got, columns, n = table_of(by_gram)
    if not len(n):
        return Model(languages, words, None)
    parts = pc.utf8_length(got["w"]).to_numpy().astype(np.int64) - 1
    by_part = [sums(columns[parts == i], n[parts == i]) for i in range(LONGEST)]
    return Model(languages, words, Table.of(got["w"], columns, n, parts, by_part))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the score is the share of the predicted language.

    ``und`` with score 0 for a text that is null or has no letter; ties go to the first language by name; a null key is
    not held out; repeated rows are predicted each; whole texts are read, of any length; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    return _predicted(docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key), folds, fold).alias("held_out"), F.col(text).cast("string").alias("t")), model, "doc_id long, held_out boolean")


def _predicted(rows: DataFrame, model: Model, ddl: str) -> DataFrame:
    """The rows, their last column (the text) replaced by lang_pred and score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [*rows.columns[:-1], "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            found = [shared.value.predict(t.as_py() or "") for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names
            )

    return rows.mapInArrow(run, f"{ddl}, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without documents of undetermined language or with a score under ``least``; all columns come back as they were.

    The model learns from the documents' own labels.  A null, empty or letterless text goes; a tie between two languages has a score of a half and stays; a
    null key teaches nothing but its row is judged like any other; repeated rows are judged each; without any label everything goes; an empty table stays empty.
    """
    model = fit(docs, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shared.value.predict(t.as_py() or "") for t in batch.column(text))
            yield batch.filter(pa.array([l != UNDETERMINED and s >= least for l, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
