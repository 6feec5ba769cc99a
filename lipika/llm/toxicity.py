"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is its log-odds of the toxic class, with Dirichlet priors in a hierarchy: a word's prior is what its first five
letters show, theirs what the first four show, then three, then all words.  A word that the labelled rows don't know is also read as
others may write it on purpose: with look-alike characters, signs in place of letters, letters left out, added or doubled, joined
to other words or spaced out; such a reading counts ``RELIABLE`` of the known word's score.  A drift makes ordinary text score below zero, and
a linear scan (Ruzzo and Tompa, 1999) finds all maximal scoring segments of a document; a token's n-th repetition counts one n-th.

Under the clean class the best segment's score follows an extreme-value law (Karlin and Altschul, 1990): with ``lam`` from the clean
tokens' scores and ``place`` and ``scale`` from the clean documents' best segments, ``(lam * score - ln(tokens) - place) / scale`` is a
segment's significance, in nats.  A document's is that of its r best segments together (Karlin and Altschul, 1993), for the best r,
and its score the odds of the toxic class against that law's tail.  The law is fitted by cross-fitting: each labelled text is
scored by the log-odds of the other folds.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lipika.llm.common import broadcast_if_small, materialize

#: Labelled rows that the model is fitted on, at most about (a hash of the key picks them).
SAMPLE_ROWS = 20_000
BEGINNINGS = (5, 4, 3)
#: Weight of a prior, in documents.
PRIOR = 5.0
#: Standard errors that a score is moved towards zero by, so that a few chance occurrences don't make a toxic word.
CAUTION = 1.5
#: Parts that the labelled texts are dealt to for cross-fitting.
FOLDS = 4
PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("significance", pa.float64())]))
#: What each token's score is lowered by.
DRIFT = 0.7
#: Score from which a known word is looked for in unknown ones, and the share of its score that they get.
STRONG, RELIABLE = 2.0, 0.8
#: A known word's least letters to be found in a run of spaced letters, inside a word, or with a letter changed.
RUN_LETTERS, INNER_LETTERS = 4, 5
#: Significance, in nats, of a text without segments, and from which segments add to the best one's.
NOTHING, SIGNIFICANT = -10.0, math.log(100)
#: Words remembered in each worker; beyond it the memory starts anew.
MEMO_WORDS = 400_000

# Characters that look like letters (a character of two readings is in both tables).
LOOK_ALIKE = str.maketrans("0134579@$!|€+£аеорсухіѕјοιαν", "oieastgasilettaeopcyxisjoiav")
LOOK_ALIKE_L = str.maketrans("16!", "lbl")
SPACED = re.compile(r"(?<!\S)(?:\S\s+){3}")


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def levels(word: str) -> list[str]:
    """The word and its beginnings, the longest first, each marked by its length (0: the word)."""
    return [f"0{word}"] + [f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n]


def readings(token: str) -> list[str]:
    """Words that a lower-case token may stand for: without marks over its letters, and with look-alikes as the letters they look like."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    if plain.isascii() and plain.isalpha():
        return [plain]
    return [letters(plain), letters(plain.translate(LOOK_ALIKE)), letters(plain.translate(LOOK_ALIKE_L).translate(LOOK_ALIKE))]


DOUBLED = re.compile(r"(.)\1+")


def squeezed(word: str) -> str:
    return DOUBLED.sub(r"\1", word)


def shortened(word: str) -> list[str]:
    """The word, and it without each one of its letters: words one letter apart have one of these in common."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Similar:
    """Finds strong words in altered ones."""

    def __init__(self, strong: dict[str, float]):
        self.squeezed: dict[str, float] = {}
        # what a word with a strong one inside, or one letter away from one, must have: its first letters somewhere, or one of its ends
        self.first = {w[:RUN_LETTERS] for w in strong if len(w) >= RUN_LETTERS}
        self.heads = {w[:n] for w in strong if len(w) >= INNER_LETTERS for n in range(2, len(w))}
        self.tails = {w[-n:] for w in strong if len(w) >= INNER_LETTERS for n in range(2, len(w))}
        self.near: dict[str, float] = {}
        self.words = {w: s for w, s in strong.items() if len(w) >= RUN_LETTERS}
        self.by_length: dict[int, str] = {}
        for w, s in self.words.items():
            key = squeezed(w)
            self.squeezed[key] = max(s, self.squeezed.get(key, 0.0))
            self.by_length[len(w)] = self.by_length.get(len(w), "\n") + w + "\n"
            if len(w) >= INNER_LETTERS:
                for key in shortened(w):
                    self.near[key] = max(s, self.near.get(key, 0.0))
        self.lengths = sorted(self.by_length)
        self.longest = self.lengths[-1] if self.lengths else 0

    def inside(self, word: str, least: int) -> float:
        """The best score of strong words of at least so many letters in a row of letters."""
        best, get, n = 0.0, self.words.get, RUN_LETTERS
        for i in range(len(word) - least + 1):
            if word[i : i + n] in self.first:
                best = max(best, *(get(word[i : i + size], 0.0) for size in self.lengths if size >= least))
        return best

    def masked(self, token: str) -> float:
        """The best score of strong words that the token's letters fit, any other sign in it standing for one letter."""
        if token.isalnum():
            return 0.0
        core = token.strip("".join({c for c in token if not c.isalnum()}))
        if core not in token or len(core) not in self.by_length or core.isalpha() or sum(map(str.isalpha, core)) < max(2, len(core) / 2):
            return 0.0
        fit = re.findall("(?<=\n)" + "".join(re.escape(c) if c.isalpha() else "[^\n]" for c in core) + "(?=\n)", self.by_length[len(core)])
        return max((self.words[w] for w in fit), default=0.0)

    def score(self, word: str) -> float:
        best = self.squeezed.get(squeezed(word), 0.0)
        if len(word) >= INNER_LETTERS and self.lengths:
            best = max(best, self.inside(word, INNER_LETTERS))
            half = (len(word) - 1) // 2
            if len(word) <= self.longest + 1 and (word[:half] in self.heads or word[-half:] in self.tails):
                best = max(best, *(self.near.get(x, 0.0) for x in shortened(word)))
        return best


def hash_of(word: str) -> int:
    """Spark's ``xxhash64``."""
    return xxhash.xxh64_intdigest(word.encode(), 42)


@dataclass
class Model:
    """Scores of words and beginnings, the words known at all (sorted hashes), and the law's parameters."""

    scores: dict[str, float]
    known: array
    lam: float = 1.0
    place: float = 0.0
    scale: float = 1.0
    #: Logarithm of the odds of the toxic class, and the mean significance of its texts.
    log_odds: float = -30.0
    mean: float = 2.0
    memo: dict[str, float] = field(default_factory=dict)
    similar: Similar | None = None

    def lookup(self, word: str) -> float:
        """The score of the longest level that there is; 0 without any."""
        get = self.scores.get
        if (found := get("0" + word)) is not None:
            return found
        n = len(word)
        if n >= 3:
            if n >= 5 and (found := get("5" + word[:5])) is not None or n >= 4 and (found := get("4" + word[:4])) is not None:
                return found
            return get("3" + word[:3], 0.0)
        return 0.0

    def is_known(self, word: str) -> bool:
        h = hash_of(word)
        at = bisect_left(self.known, h)
        return at < len(self.known) and self.known[at] == h

    def index(self) -> Similar:
        if self.similar is None:
            self.similar = Similar({k[1:]: s for k, s in self.scores.items() if k[0] == "0" and s >= STRONG})
        return self.similar

    def learn(self, token: str) -> float:
        token = token.lower()
        word = letters(token)
        best = self.lookup(word) if word else 0.0
        if best >= STRONG or (word == token or word in token) and (not word or self.is_known(word)):
            return best - DRIFT
        tried = {word, ""}
        if not (token.isascii() and token.isalpha()):
            for reading in readings(token):
                if reading not in tried:
                    tried.add(reading)
                    best = max(best, RELIABLE * self.lookup(reading))
        if best < STRONG:
            similar = self.index()
            found = [similar.score(x) for x in tried if len(x) >= RUN_LETTERS]
            best = max(best, RELIABLE * max(found, default=0.0), RELIABLE * similar.masked(token))
        return best - DRIFT

    def token_scores(self, text: str) -> np.ndarray:
        tokens, memo = text.split(), self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for token in set(tokens).difference(memo):
            memo[token] = self.learn(token)
        out = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
        seen: Counter = Counter()
        for i in np.flatnonzero(out > 0).tolist():
            seen[tokens[i]] += 1
            out[i] /= seen[tokens[i]]
        if SPACED.search(text):
            self.spaced(tokens, out)
        return out

    def spaced(self, tokens: list[str], out: np.ndarray) -> None:
        """Strong words in runs of single characters: the score goes to the run's first token."""
        single = np.fromiter((len(t) == 1 for t in tokens), bool, len(tokens))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], single, [False])).astype(np.int8))).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= RUN_LETTERS].tolist():
            run = "".join(tokens[a:b]).lower()
            if found := max(self.index().inside(x, RUN_LETTERS) for x in (letters(run), *readings(run))):
                out[a:b] = 0.0
                out[a] = RELIABLE * found - DRIFT

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """(first token, end, significance) of every maximal segment, significant if above zero."""
        scores = self.token_scores(text)
        return [(a, b, self.significance(s, len(scores))) for a, b, s in segments(scores)]

    def significance(self, score: float, tokens: int) -> float:
        return (self.lam * score - math.log(max(tokens, 1)) - self.place) / self.scale

    def score(self, text: str) -> float:
        return self.score_of(self.passages(text))

    def score_of(self, passages: list[tuple[int, int, float]]) -> float:
        """Odds of the toxic class, whose significance is taken for exponential, against the clean one's tail."""
        x = self.log_odds - math.log(self.mean) + (1 - 1 / self.mean) * together([s for *_, s in passages])
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def together(significances: list[float]) -> float:
    """Significance of the r best segments, of those that one clean text in a hundred reaches by chance, for the r that makes it largest: their sum's
    tail is exp(-t) t^(r-1) / (r! (r-1)!), and each further segment costs a factor of two for the choice."""
    best = max(significances, default=NOTHING)
    x = np.sort([s for s in significances if s > SIGNIFICANT])[::-1]
    if len(x) < 2:
        return max(best, NOTHING)
    t, r = np.cumsum(x), np.arange(1, len(x) + 1)
    factorials = np.concatenate(([0.0], np.cumsum(np.log(r))))
    return float((t - (r - 1) * np.log(np.maximum(t, 1.0)) + factorials[1:] + factorials[:-1] - (r - 1) * math.log(2)).max())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa), in order: (start, end, sum), in linear time.

    Runs of tokens of one sign are taken together first.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate(([0], edges))
    sums = np.add.reduceat(scores, starts).tolist()
    ends = np.concatenate((edges, [len(scores)])).tolist()
    starts = starts.tolist()
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    total = 0.0
    before: list[int] = []  # for each segment the last earlier one with a smaller sum before it, or -1
    for start, end, value in zip(starts, ends, sums):
        low, total = total, total + value
        if value <= 0:
            continue
        left, high = start, total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = before[j]
            if j < 0 or out[j][3] >= high:
                out.append((left, end, low, high))
                before.append(j)
                break
            left, low = out[j][0], out[j][2]
            del out[j:], before[j:]
    return [(a, b, high - low) for a, b, low, high in out]


def fit_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive solution of the weighted mean of exp(lam * s) = 1; 1 where there is none.

    One more token with score ``STRONG`` is counted, so that it is bounded where no token scores above zero.
    """
    values, weights = np.append(values, STRONG), np.append(weights, 1.0)
    weights = weights / weights.sum()
    mean = lambda lam: float((weights * np.exp(np.minimum(lam * values, 700))).sum())
    if (weights * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(low, 1e-3)


def count_levels(texts: Iterable[tuple[str, int]]) -> tuple[Counter, Counter]:
    """(toxic, clean) numbers of documents with each level key; key "" counts the documents."""
    out = (Counter(), Counter())
    for text, toxic in texts:
        words = set(map(letters, set(text.lower().split())))
        out[toxic].update({level for word in words if word for level in levels(word)} | {""})
    return out[1], out[0]


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the key as text leaves ``fold`` modulo ``folds``; false for a null key."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def scored(y1: Column, y0: Column, prior: Column, share: list[float]) -> Column:
    """Scores (one for each model) by numbers of toxic and clean documents: of ``PRIOR`` documents so many would be toxic, if the prior's odds held."""

    def one(x: Column) -> Column:
        base = F.log(x["share"] / (1 - x["share"]))
        toxic = PRIOR / (1 + F.exp(-(x["prior"] + base)))
        found = F.log((x["y1"] + toxic) / (x["y0"] + PRIOR - toxic)) - base
        error = CAUTION * F.sqrt(1 / (x["y1"] + toxic) + 1 / (x["y0"] + PRIOR - toxic))
        return F.signum(found) * F.greatest(F.abs(found) - error, F.lit(0.0))

    return F.transform(F.arrays_zip(y1.alias("y1"), y0.alias("y0"), prior.alias("prior"), F.lit(share).alias("share")), one)


def log_odds(counts: DataFrame, share: list[float]) -> DataFrame:
    """(key, scores) of the levels in ``counts`` (key, y1, y0: arrays, an entry for each model), each with the next shorter one as its prior.

    A word that a single document has is scored by its beginnings.  Only scores that differ from the prior's come back: the others say nothing new.
    """
    parts = counts.select(F.substring("key", 1, 1).cast("int").alias("level"), F.expr("substring(key, 2)").alias("stem"), "y1", "y0").where("stem <> ''")
    zeros = F.array_repeat(F.lit(0.0), len(share))
    above = parts.sparkSession.createDataFrame([], "above string, prior array<double>")
    out = []
    for level in (*reversed(BEGINNINGS), 0):
        own = parts.where(F.col("level") == level)
        if not level:
            own = own.where(F.col("y1")[0] + F.col("y0")[0] >= 2)
        # a word's prior is the beginning of up to as many letters as there are levels for
        longer = F.when(F.lit(level > 0), level - 1).otherwise(BEGINNINGS[0])
        own = own.withColumn("above", F.substring("stem", F.lit(1), F.least(longer, F.length("stem"))))
        own = own.join(above, "above", "left").withColumn("prior", F.coalesce("prior", zeros))
        own = materialize(own.withColumn("scores", scored(F.col("y1"), F.col("y0"), F.col("prior"), share)).select("level", "stem", "prior", "scores"), "scores")
        out.append(own)
        if level:
            above = above.union(own.select(F.col("stem").alias("above"), F.col("scores").alias("prior")))
    found = out[0]
    for own in out[1:]:
        found = found.union(own)
    news = F.exists(F.arrays_zip("scores", "prior"), lambda x: F.abs(x["scores"] - x["prior"]) > 1e-9)
    return found.where(news).select(F.concat(F.col("level").cast("string"), "stem").alias("key"), "scores")


def fit_tail(values: np.ndarray) -> tuple[float, float]:
    """Place and scale of an extreme-value law by its tail: the quantiles 0.9 and 0.99 of the values (minus infinity: no segment).

    Where fewer values than that are finite, the largest, or zero, counts as reached by one text more than there are.
    """
    near, far = np.quantile(values, [0.9, 0.99], method="higher") if len(values) else (-np.inf, -np.inf)
    of = [-math.log(-math.log(p)) for p in (0.9, 0.99)]
    if not np.isfinite(far):
        return float(max(values[np.isfinite(values)], default=0.0)) - math.log(len(values) + 1), 1.0
    scale = max((far - near) / (of[1] - of[0]), 1.0) if np.isfinite(near) else 1.0
    return float(far - scale * of[1]), float(scale)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fold: int = 0) -> Model:
    """A model from at most about ``SAMPLE_ROWS`` labelled rows outside the held-out fold.

    Rows without key, label or document teach nothing; a key with both labels teaches both; equal texts of one label teach once.  Without labelled rows of both
    classes every document's score is the share of toxic ones (0 without any).
    """
    chosen = labels.select(F.col(key).cast("long").alias("k"), (F.col(label) == 1).cast("int").alias("y")).where(
        F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k"), folds, fold)
    )
    n = chosen.count()
    chosen = materialize(chosen.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE_ROWS << 20) // max(n, 1)))).distinct(), "labels")
    rows = materialize(
        docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
        .join(broadcast_if_small(chosen), "k")
        .select("t", "y", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).cast("int").alias("fold"))
        .distinct(),
        "labelled",
    )
    sizes = Counter({(r["y"], r["fold"]): r["count"] for r in rows.groupBy("y", "fold").count().collect()})
    n1, n0 = (sum(sizes[y, f] for f in range(FOLDS)) for y in (1, 0))
    if not n1 or not n0:
        return Model({}, array("Q"), log_odds=30.0 + math.log(2) if n1 else -30.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fold_of, y1, y0 = [], [], [], []
            texts: dict[int, list[tuple[str, int]]] = {}
            for t, y, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
                texts.setdefault(f, []).append((t, y))
            for f, found in texts.items():
                toxic, clean = count_levels(found)
                both = list(toxic.keys() | clean.keys())
                keys += both
                fold_of += [f] * len(both)
                y1 += [toxic[x] for x in both]
                y0 += [clean[x] for x in both]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(fold_of, pa.int32()), pa.array(y1, pa.int64()), pa.array(y0, pa.int64())], ["key", "fold", "y1", "y0"])

    def but(name: str) -> Column:
        """Sums over all folds, and over all but each one."""
        return F.array(F.sum(name), *[F.sum(F.when(F.col("fold") != f, F.col(name)).otherwise(0)) for f in range(FOLDS)])

    counts = materialize(rows.mapInArrow(counted, "key string, fold int, y1 long, y0 long").groupBy("key").agg(but("y1").alias("y1"), but("y0").alias("y0")), "levels")
    share = [(max(n1 - (sizes[1, f] if f is not None else 0), 1)) / max(n1 + n0 - (sizes[1, f] + sizes[0, f] if f is not None else 0), 2) for f in (None, *range(FOLDS))]
    share = [min(x, 0.999) for x in share]
    found = log_odds(counts, share).toArrow()
    known = np.sort(counts.where(F.col("key").startswith("0")).select(F.xxhash64(F.expr("substring(key, 2)")).alias("h")).toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))
    known = array("Q", known.tobytes())
    keys = found["key"].to_pylist()
    table = np.array(found["scores"].to_pylist(), dtype=float).reshape(-1, FOLDS + 1)
    models = [Model(dict(zip(keys, table[:, i].tolist())), known) for i in range(FOLDS + 1)]
    model, draft = models[0], docs.sparkSession.sparkContext.broadcast(models[1:])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's tokens and segments; of clean texts also how many tokens have each score, in fiftieths."""
        for batch in batches:
            bins: Counter = Counter()
            ns, ys, sums = [], [], []
            for t, y, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
                scores = draft.value[f].token_scores(t)
                if not y:
                    bins.update(np.round(scores * 50).astype(int).tolist())
                ns.append(len(scores))
                ys.append(y)
                sums.append([s for *_, s in segments(scores)])
            m = len(bins)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ns, *bins.values()], pa.int64()),
                    pa.array([*ys, *[None] * m], pa.int32()),
                    pa.array([*sums, *[None] * m], pa.list_(pa.float64())),
                    pa.array([*[None] * len(ns), *bins.keys()], pa.int64()),
                ],
                ["n", "y", "sums", "bin"],
            )

    data = materialize(rows.mapInArrow(measured, "n long, y int, sums array<double>, bin long"), "measured")
    # scores are bounded by the logarithm of the sample's counts, so the bins are few
    bins = data.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    if bins.num_rows:
        model.lam = fit_lambda(bins["bin"].to_numpy() / 50, bins["n"].to_numpy().astype(float))
    best = data.where("y = 0").select("n", F.array_max("sums").alias("s")).toArrow()
    n, s = best["n"].to_numpy(), best["s"].to_numpy(zero_copy_only=False).astype(float)
    model.place, model.scale = fit_tail(np.where(np.isnan(s), -np.inf, model.lam * s - np.log(np.maximum(n, 1))))
    toxic = data.where("y = 1").select("n", "sums").toArrow()
    reached = [together([model.significance(x, n) for x in sums]) for n, sums in zip(toxic["n"].to_pylist(), toxic["sums"].to_pylist())]
    model.mean = max(2.0, float(np.mean([max(x, 0.0) for x in reached])))
    model.log_odds = math.log(n1 / n0)
    draft.unpersist()
    return model


def score_passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row.

    ``passages`` are the significant ones in order: first token (white-space separated, from 0), the token after the last, significance in nats.
    A null, empty or wordless text has the score of one without any segment; a null key is not held out; repeated rows are
    scored each; whole texts are scored, of any length; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.passages(t.as_py() or "") for t in batch.column(2)]
            scores = [shared.value.score_of(x) for x in found]
            spans = [[{"start": a, "end": b, "significance": x} for a, b, x in passages if x > 0] for passages in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, PASSAGES)],
                ["doc_id", "held_out", "score", "predicted", "passages"],
            )

    return docs.select(F.col(key).cast("long"), held_out(F.col(key), folds, fold), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start: long, end: long, significance: double>>"
    )


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """``score_passages`` without the passages."""
    return score_passages(docs, model, key, text, folds, fold).drop("passages")
