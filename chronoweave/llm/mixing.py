"""Mixing sources to target shares of the total size.

A classifier learned from the labelled table gives each text a posterior over the target domains: naive Bayes over hashed
words with counts over all texts, each text scored without its own counts. How much the words say is calibrated: the power of
the likelihood is the one of least log loss over all texts, down to none at all where words do not tell the
domains apart, so a posterior is never surer than it is right. It is multiplied by the chance that a text of a domain
carries the label it has.

Document rates then solve a nonnegative least-squares problem: expected tokens of every domain should equal its part
of the total, rates stay between 0 and the source's cap of repetitions. The gradient is projected lazily: the steps are summed
up as one number a domain, and a document's rate is the equal rate less its posterior's product with these, put back between
the bounds. So no document's rate is kept from round to round, and a round is one pass that sums over all documents, of
whatever number, each with its own posterior. A step is scaled by the curvature of the documents that are not at a bound.
:func:`soft_report` shows what this fit reaches alone, in expectation and in real tokens per label.

Labels tell more than expectations where both exist, so the rates of a source are then scaled until its real tokens fit;
copies are whole numbers by rounding with a hash of the id, shifted per source so that the whole copies reach the target too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.tokens import VOCABULARY, encoder
from chronoweave.plans.scratch import Scratch

_WORD = re.compile(r"\w+")
_GRID = 257


@dataclass(frozen=True)
class Mix:
    """``buckets`` of hashed words; ``mislabelled``: share of labels taken to be wrong; ``rounds`` of the projected gradient and
    of the scaling to real tokens, at most; ``tolerance``: relative residual at which they end."""

    buckets: int = 4096
    mislabelled: float = 0.02
    rounds: int = 500
    tolerance: float = 1e-4
    vocabulary: str = VOCABULARY


def _bag(text: str, buckets: int, known: dict[str, int]) -> np.ndarray:
    out = np.empty(0, np.int64)
    words = _WORD.findall(text.lower())
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh32_intdigest(w) % buckets
    return np.fromiter((known[w] for w in words), np.int64, len(words)) if words else out


#: Powers of the likelihood that calibration chooses from.
_POWERS = (0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)


class Bayes:
    """Naive Bayes over bags of hashed words, scored without a labelled text's own counts."""

    def __init__(self, counts: np.ndarray, texts: np.ndarray, power: float = 1.0):
        self.counts, self.sums, self.power = counts, counts.sum(axis=1), power
        self.log_word = np.log((counts + 1) / (self.sums + counts.shape[1])[:, None])
        self.log_prior = np.log((texts + 1) / (texts.sum() + len(texts)))

    def words(self, bag: np.ndarray, label: int) -> np.ndarray:
        """Log likelihood of the words in each domain."""
        out = self.log_word[:, bag].sum(axis=1)
        _, at, times = np.unique(bag, return_inverse=True, return_counts=True)
        own = (self.counts[label, bag] + 1 - times[at]) / (self.sums[label] - len(bag) + self.counts.shape[1])
        out[label] = np.log(np.maximum(own, 1e-12)).sum()
        return out

    def log_posterior(self, bag: np.ndarray, label: int, power: float | None = None) -> np.ndarray:
        return self.log_posteriors(self.words(bag, label)[None], power)[0]

    def log_posteriors(self, words: np.ndarray, power: float | None = None) -> np.ndarray:
        """Of texts (rows) with the log likelihoods that :meth:`words` gives."""
        score = self.log_prior + (self.power if power is None else power) * words
        score = score - score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))

    def losses(self, words: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Log loss of texts at each power."""
        return np.array([-self.log_posteriors(words, p)[np.arange(len(labels)), labels].sum() for p in _POWERS])

    def settled(self, losses: np.ndarray) -> Bayes:
        """With the power of least loss, of equal ones the smallest."""
        self.power = _POWERS[int(np.argmin(losses))]
        return self

    def calibrated(self, bags: list[tuple[np.ndarray, int]]) -> Bayes:
        return self.settled(self.losses(np.array([self.words(b, s) for b, s in bags]).reshape(-1, len(self.sums)), np.array([s for _, s in bags], int)))


#: Lengths of a step that one pass tries.
_STEPS = 0.25 ** np.arange(12)


def rates(p: np.ndarray, start: np.ndarray, cap: np.ndarray, unit: float, pull: np.ndarray) -> np.ndarray:
    """Rates in [0, cap] of documents with posteriors ``p`` after a ``pull`` of every domain."""
    return np.clip(start - unit * (p @ pull), 0, cap)


def sums(p: np.ndarray, n: np.ndarray, start: np.ndarray, cap: np.ndarray, unit: float, whole: float, pulls: np.ndarray) -> np.ndarray:
    """What documents add to a round, a row for each of ``pulls``: the objective, the parts of ``whole`` that domains reach, and
    how these change with the pull."""
    out = []
    low, high = (start - cap) / unit, start / unit
    for pull in pulls:
        u = p @ pull
        r, within = rates(p, start, cap, unit, pull), np.clip(u, low, high)
        moved = start * within - unit * within**2 / 2 + np.minimum(u - low, 0) * cap
        free = p * (n * ((r > 0) & (r < cap)))[:, None]
        out.append(np.concatenate([[-(n @ moved)], (n * r) @ p, (unit * free.T @ p).ravel()]) / whole)
    return np.array(out)


def lazy_projection(evaluate: Callable[[np.ndarray], np.ndarray], want: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pull of every domain at which the parts reached are nearest to ``want``, and these parts; ``evaluate`` gives :func:`sums`
    over all documents. Of rates that fit about equally those near the equal rate are taken."""
    k, weight = len(want), tolerance / 1000

    def at(pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = evaluate(pulls)
        return got[:, 0] + pulls @ want + weight / 2 * (pulls**2).sum(axis=1), got[:, 1 : k + 1], got[:, k + 1 :].reshape(-1, k, k)

    pull = np.zeros(k)
    value, reached, curve = (x[0] for x in at(pull[None]))
    for _ in range(rounds):
        slope = weight * pull + want - reached
        if min(np.abs(want - reached).max() * 10, np.abs(slope).max() * 1000) <= tolerance:
            break
        tried = pull - _STEPS[:, None] * np.linalg.solve(weight * np.eye(k) + curve, slope)
        values, parts, curves = at(tried)
        best = int(np.argmin(values))
        if not values[best] < value:
            break
        pull, value, reached, curve = tried[best], values[best], parts[best], curves[best]
    return pull, reached


def project(p: np.ndarray, n: np.ndarray, cap: np.ndarray, goal: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Rates in [0, cap] of documents with ``n`` tokens and posteriors ``p`` whose expected tokens per domain are nearest to
    ``goal``, by lazily projected gradient on residuals relative to the whole."""
    whole = max(float(goal.sum()), 1e-9)
    unit = whole / max(float(n.sum()), 1e-9)
    start = np.clip(unit, 0, cap)
    pull, _ = lazy_projection(lambda pulls: sums(p, n, start, cap, unit, whole, pulls), goal / whole, rounds, tolerance)
    return rates(p, start, cap, unit, pull)


def largest_total(tokens: np.ndarray, share: np.ndarray, caps: np.ndarray) -> float:
    """The largest total at which no source with texts needs more repetitions than its cap."""
    can = (tokens > 0) & (share > 0)
    return float(np.min(tokens[can] * caps[can] / share[can])) if can.any() else 0.0


@dataclass
class _Fit:
    """What the documents and targets say: the table of sized documents, their rate as a function of label and posterior,
    and the tokens that the soft fit expects and really has per domain."""

    docs: DataFrame
    names: list[str]
    share: np.ndarray
    caps: np.ndarray
    goal: np.ndarray
    rate: Callable[[np.ndarray, np.ndarray], np.ndarray]
    expected: np.ndarray
    real: np.ndarray


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _added(df: DataFrame, columns: list[str], one: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sums over all rows of an array that ``one`` gives for some."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += one(batch)
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size, dtype="i4"), "x": total.ravel()})

    out = np.zeros(shape)
    for r in df.select(*columns).mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out.flat[r.i] = r.x
    return out


def _fit(documents: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total: float | None, conf: Mix) -> _Fit | None:
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = sorted((r.source, max(0.0, r.target_share or 0.0), max(0, 1 if r.max_repeats is None else r.max_repeats)) for r in targets.dropDuplicates(["source"]).collect() if r.source is not None)
    names = [w[0] for w in wanted]
    if not names:
        return None
    number = {s: i for i, s in enumerate(names)}
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and source is not null and text != ''")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.where(F.col("source").isin(*names))
    k = len(names)

    def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        total = np.zeros((k, conf.buckets + 1), np.int64)  # the last column counts texts
        for pdf in batches:
            for source, text in zip(pdf["source"], pdf["text"]):
                np.add.at(total[number[source]], _bag(text, conf.buckets, known), 1)
                total[number[source], -1] += 1
        s, b = np.nonzero(total)
        yield pd.DataFrame({"s": s.astype("i4"), "b": b.astype("i4"), "n": total[s, b]})

    counts = np.zeros((k, conf.buckets + 1))
    for r in rows.mapInPandas(word_counts, "s int, b int, n long").groupBy("s", "b").agg(F.sum("n").alias("n")).collect():
        counts[r.s, r.b] = r.n  # at most domains x buckets rows
    bayes = Bayes(counts[:, :-1], counts[:, -1])
    label = np.log(np.full((k, k), conf.mislabelled / max(1, k - 1)) + np.eye(k) * (1 - conf.mislabelled - conf.mislabelled / max(1, k - 1)))

    def likelihoods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        encode = encoder(conf.vocabulary).encode_ordinary
        for pdf in batches:
            words = [bayes.words(_bag(text, conf.buckets, known), number[source]).tolist() for source, text in zip(pdf["source"], pdf["text"])]
            yield pdf[["doc_id", "source"]].assign(n_tokens=[len(encode(t)) for t in pdf["text"]], words=words)

    sized = rows.mapInPandas(likelihoods, f"doc_id {id_type}, source string, n_tokens long, words array<double>")
    told = scratch.save(sized.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens", "words")).alias("d")).select("doc_id", "d.*").where("n_tokens > 0"))
    labels = lambda batch: pc.index_in(batch["source"], pa.array(names, batch["source"].type)).to_numpy().astype(int)
    bayes.settled(_added(told, ["source", "words"], lambda batch: bayes.losses(_matrix(batch["words"]), labels(batch)), (len(_POWERS),)))

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = bayes.log_posteriors(_matrix(batch["words"])) + label[labels(batch)]
                p = np.exp(score - score.max(axis=1, keepdims=True))
                p = pa.ListArray.from_arrays(np.arange(0, p.size + 1, k, dtype="i4"), (p / p.sum(axis=1, keepdims=True)).ravel())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["n_tokens"], p], ["doc_id", "source", "n_tokens", "p"])

    docs = scratch.save(told.mapInArrow(posteriors, f"doc_id {id_type}, source string, n_tokens long, p array<double>"))
    scratch.drop(told)
    tokens = np.zeros(k)
    for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():
        tokens[number[r.source]] = r.n
    share = np.array([w[1] for w in wanted]) * (tokens > 0)
    caps = np.array([float(w[2]) for w in wanted])
    if not share.sum():
        return None
    share = share / share.sum()
    goal = share * (largest_total(tokens, share, caps) if total is None else float(total))
    cap = np.where(share > 0, caps, 0.0)
    whole = max(float(goal.sum()), 1e-9)
    unit = whole / tokens.sum()
    start = np.clip(unit, 0, cap)

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return labels(batch), _matrix(batch["p"]), batch["n_tokens"].to_numpy().astype(float)

    def evaluate(pulls: np.ndarray) -> np.ndarray:
        def one(batch: pa.RecordBatch) -> np.ndarray:
            s, p, n = of(batch)
            return sums(p, n, start[s], cap[s], unit, whole, pulls)

        return _added(docs, ["source", "n_tokens", "p"], one, (len(pulls), 1 + k + k * k))

    pull, reached = lazy_projection(evaluate, goal / whole, conf.rounds, conf.tolerance)
    equal, times, real = np.zeros(k, bool), np.ones(k), None

    def rate(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        soft = np.where(equal[s], (goal / np.maximum(tokens, 1e-9))[s], rates(p, start[s], cap[s], unit, pull))
        return np.clip(times[s] * soft, 0, cap[s])

    def scaled(batch: pa.RecordBatch) -> np.ndarray:
        s, p, n = of(batch)
        r = rate(s, p)
        return np.array([np.bincount(s, n * r, minlength=k), np.bincount(s, n * r * (r < cap[s]), minlength=k)])

    for _ in range(conf.rounds):
        now, free = _added(docs, ["source", "n_tokens", "p"], scaled, (2, k))
        real = now if real is None else real
        far = np.abs(goal - now) > conf.tolerance / 100 * goal.sum()
        # A source without any rate left, or with too few to reach its part, starts again from equal rates.
        again = far & ~equal & (now < goal) & (free <= 0)
        moves = far & (now > 0) & ((now > goal) | (free > 0))
        if not (again | moves).any():
            break
        # A source's tokens are a concave function of the factor, so these steps never pass its part from below.
        step = np.where(now > goal, goal / np.maximum(now, 1e-9), 1 + (goal - now) / np.maximum(free, 1e-9))
        times, equal = np.where(again, 1.0, np.where(moves, times * step, times)), equal | again
    return _Fit(docs, names, share, caps, goal, rate, reached * whole, real)


def mix_documents(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: float | None = None, conf: Mix = Mix()) -> DataFrame:
    """``doc_id, source, n_tokens, rate, copies`` of the documents used, ``copies`` times each.

    ``targets`` (``source``, ``target_share``, ``max_repeats``) is a small table of settings. Shares of sources without
    any token are unreachable; the others keep their proportions and sum to 1. Sources that are no target
    contribute nothing. ``total`` is in tokens; by default it is the largest that the caps allow.

    Null and empty texts have no tokens and are not used, nor are rows without an id or source; rows repeating
    an id are one text. A null or negative share is 0, a null cap is 1. Empty tables give no rows.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    used = f"doc_id {id_type}, source string, n_tokens long, rate double, copies int"
    fit = _fit(documents, targets, id_col, text_col, source_col, total, conf)
    if fit is None:
        return documents.sparkSession.createDataFrame([], used)
    rate = fit.rate
    k, number = len(fit.names), {s: i for i, s in enumerate(fit.names)}
    cap_of = {s: (fit.caps[i] if fit.share[i] > 0 else 0.0) for s, i in number.items()}

    def copies(pdf: pd.DataFrame, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and whole copies for each shift (a column each); more shift, never fewer copies."""
        r = rate(pdf["source"].map(number).to_numpy(int), np.stack(pdf["p"]))
        u = np.array([xxhash.xxh3_64_intdigest(str(d)) / 2**64 for d in pdf["doc_id"]])
        cap = pdf["source"].map(cap_of).to_numpy(float)
        return r, np.clip(np.floor((r + u)[:, None] + shift[pdf["source"].map(number).to_numpy(int)]), 0, np.where(r > 0, cap, 0)[:, None])

    # Rounding moves the totals of small sources; the shift per source that brings them back is read off a grid.
    grid = np.tile(np.linspace(-0.5, 0.5, _GRID), (k, 1))

    def rounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros((k, _GRID))
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                np.add.at(got, part["source"].map(number).to_numpy(int), copies(part, grid)[1] * part["n_tokens"].to_numpy(float)[:, None])
        s, g = np.indices(got.shape)
        yield pd.DataFrame({"s": s.ravel(), "g": g.ravel(), "n": got.ravel()})

    got = np.zeros((k, _GRID))
    for row in fit.docs.mapInPandas(rounded, "s int, g int, n double").groupBy("s", "g").agg(F.sum("n").alias("n")).collect():
        got[row.s, row.g] = row.n
    shift = grid[np.arange(k), np.abs(got - fit.goal[:, None]).argmin(1)][:, None]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r, whole = copies(pdf, shift)
                out = pdf[["doc_id", "source", "n_tokens"]].assign(rate=r, copies=whole[:, 0].astype("i4"))
                yield out[out["copies"] > 0]

    return fit.docs.mapInPandas(finish, used)


def soft_report(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: float | None = None, conf: Mix = Mix()) -> DataFrame:
    """What the soft fit alone reaches: ``source, wanted_share, expected_share`` (by posteriors) and ``real_share`` (by labels).

    Nulls, repeats and empty tables as in :func:`mix_documents`; shares are of the reachable total.
    """
    kinds = "source string, wanted_share double, expected_share double, real_share double"
    fit = _fit(documents, targets, id_col, text_col, source_col, total, conf)
    if fit is None:
        return documents.sparkSession.createDataFrame([], kinds)
    return documents.sparkSession.createDataFrame([(s, float(fit.share[i]), float(fit.expected[i] / fit.expected.sum()), float(fit.real[i] / fit.real.sum())) for i, s in enumerate(fit.names)], kinds)


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share, texts, tokens and most repetitions of every target source."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    whole = F.sum("n_tokens").over(Window.partitionBy())  # one row a source
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").withColumn("whole", whole)
    return out.select("source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.col("whole")).alias("reached_share"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
