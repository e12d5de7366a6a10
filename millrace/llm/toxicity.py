"""Toxicity by weak supervision: voters, a generative label model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import only, small_batches, stored
from millrace.llm.wordhash import each_text, mix, shingles

#: Labelled rows that the models are fitted on at most: those of the least hashes.
MAX_TRAIN = 20_000
#: Terms that become voters at most: words and stems that most tell toxic from clean rows.
TERMS = 96
CUTOFF = 0.7
#: Insults that any reader knows, one voter for each language; a start that the labelled rows need not hold.
SEEDS = {
    "en": "idiot moron stupid scum trash loser pathetic disgusting worthless clown fool dumb imbecile garbage filth freak jerk bastard",
    "de": "idiot trottel dummkopf abschaum versager widerlich wertlos arschloch depp blödmann schwachkopf mistkerl",
    "fr": "idiot imbécile crétin débile ordure minable raté abruti connard salaud stupide dégoûtant",
    "es": "idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil cretino payaso tonto",
}
WORD = re.compile(r"[^\W\d_]+")
SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][.*_\- ]){2,}[^\W\d_](?!\w)")
MASKED = re.compile(r"\w*[01345@$!*]\w*", re.ASCII)
UNMASK = str.maketrans("01345@$!", "oieasasi")
SECOND_PERSON = frozenset("you your u du dein ihr euch tu te toi ton vous tú usted vosotros".split())
ABSTAIN, CLEAN, TOXIC = 0, 1, 2


#: Lengths of the word beginnings that count as stems: an insult may be inflected.
STEMS = range(4, 9)


class Voters(NamedTuple):
    """Mined lexicon: a term is a word, or a stem with * behind; ``least`` tells from how many of its words on it votes."""

    terms: tuple[str, ...]
    least: tuple[int, ...]

    @property
    def names(self) -> list[str]:
        return [*(f"term {t} {n}" for t, n in zip(self.terms, self.least, strict=True)), *(f"seed {k}" for k in SEEDS), "masked", "spelled", "aimed", "shouting", "none"]


def term_counts(words: list[str]) -> Counter:
    """How often each word, and each stem of a longer word, stands in a text."""
    out = Counter(words)
    for w, n in list(out.items()):
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


class Voting:
    """Votes and counts of a text, by voters compiled once."""

    def __init__(self, voters: Voters):
        self.voters, self.n = voters, len(voters.names)
        self.column = {t: k for k, t in enumerate(voters.terms)}
        self.heads = {t[: STEMS[0]] for t in voters.terms if t.endswith("*")}
        self.seeds = [frozenset(v.split()) for v in SEEDS.values()]
        self.insults = frozenset(t for t in voters.terms if not t.endswith("*")).union(*self.seeds)

    def _columns(self, word: str) -> list[int]:
        found = [self.column[word]] if word in self.column else []
        if word[: STEMS[0]] in self.heads:
            found += [self.column[s] for k in STEMS if len(word) > k and (s := word[:k] + "*") in self.column]
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, list[float]]:
        votes = np.zeros(self.n, np.int8)
        words = WORD.findall(text.lower())
        head, heads, insults = STEMS[0], self.heads, self.insults
        hits = [k for k, w in enumerate(words) if w in insults or w[:head] in heads and self._columns(w)]
        counts = Counter(c for k in hits for c in self._columns(words[k]))
        for c, n in counts.items():
            if n >= self.voters.least[c]:
                votes[c] = TOXIC
        at = len(self.column)
        kinds = {words[k] for k in hits}
        for k, seeds in enumerate(self.seeds):
            if not kinds.isdisjoint(seeds):
                votes[at + k] = TOXIC
        at += len(self.seeds)
        masked = any(m[0].lower().translate(UNMASK) in insults for m in MASKED.finditer(text) if len(m[0]) > 3)
        spelled = any(re.sub(r"[^\w]|_", "", m[0]).lower() in insults for m in SPELLED.finditer(text))
        aimed = any(w in SECOND_PERSON for k in hits for w in words[max(0, k - 4) : k + 4])
        long = [w for w in WORD.findall(text) if len(w) > 3]
        shouting = len(long) > 20 and sum(map(str.isupper, long)) > 0.5 * len(long)
        votes[at + 4] = CLEAN * (not ((votes == TOXIC).any() or masked or spelled))
        votes[at : at + 4] = [TOXIC * masked, TOXIC * spelled, TOXIC * aimed, TOXIC * shouting]
        return votes, [math.log1p(len(hits)), float(len(kinds) > 1), math.log1p(100 * len(hits) / (len(words) + 20))]


class LabelModel(NamedTuple):
    prior: float
    parent: np.ndarray  # of each voter, or -1
    tables: np.ndarray  # voter, class, parent's vote, vote


def _posterior(votes: np.ndarray, model: LabelModel) -> np.ndarray:
    score = np.stack([np.full(len(votes), math.log1p(-model.prior)), np.full(len(votes), math.log(model.prior))])
    for j, p in enumerate(model.parent):
        above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int8)
        score += np.log(model.tables[j][:, above, votes[:, j]])
    return 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60)))


def _tables(votes: np.ndarray, q: np.ndarray, parent: np.ndarray) -> np.ndarray:
    out = np.empty((len(parent), 2, 3, 3))
    for j, p in enumerate(parent):
        cell = (votes[:, p].astype(np.int64) if p >= 0 else 0) * 3 + votes[:, j]
        for y, weight in enumerate((1 - q, q)):
            counts = np.bincount(cell, weight, minlength=9).reshape(3, 3) + 0.1
            out[j, y] = counts / counts.sum(axis=1, keepdims=True)
    return out


def _tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The tree of voters with the most mutual information given the class, over its edges of note."""
    n = votes.shape[1]
    one = (votes[:, :, None] == np.arange(3)).reshape(len(votes), 3 * n).astype(float)
    info = np.zeros((n, n))
    for weight in (1 - q, q):
        total = weight.sum() + 1e-9
        joint = (one * weight[:, None]).T @ one / total
        alone = np.diag(joint)
        ratio = joint / np.maximum(np.outer(alone, alone), 1e-12)
        info += total / len(votes) * (joint * np.log(np.maximum(ratio, 1e-12))).reshape(n, 3, n, 3).sum(axis=(1, 3))
    parent, best, near, left = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), set(range(1, n))
    at = 0
    while left:
        for j in left:
            if info[at, j] > best[j]:
                best[j], near[j] = info[at, j], at
        at = max(left, key=lambda j: (best[j], -j))
        left.discard(at)
        parent[at] = near[at] if best[at] > 0.005 else -1
    return parent


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation; voters' correlations are a tree found on the way. The rows' labels, which hold errors, are one
    more voter, the last, whose accuracy is estimated like that of the others.

    Returns the model and each row's posterior of being toxic.
    """
    q = np.where(labels == 1, 0.9, np.where((votes == TOXIC).any(axis=1), 0.2, 0.02))
    votes = np.hstack([votes, np.where(labels == 1, TOXIC, CLEAN).astype(np.int8)[:, None]])
    parent = np.full(votes.shape[1], -1)
    for k in range(rounds):
        if k == 5:
            parent = _tree(votes, q)
        model = LabelModel(float(np.clip(q.mean(), 0.005, 0.5)), parent, _tables(votes, q, parent))
        q = _posterior(votes, model)
    return model, q


def _design(votes: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(votes), 1)), votes == TOXIC, votes == CLEAN, extra]).astype(float)


def seed_weights(voters: Voters) -> np.ndarray:
    """What is held before any row is seen: few texts are toxic, and a seed lexicon's vote tells one."""
    weights = np.zeros(1 + 2 * len(voters.names) + 3)
    weights[0], weights[[1 + k for k, name in enumerate(voters.names) if name.startswith("seed")]] = -3.0, 4.0
    return weights


def fit_linear(x: np.ndarray, target: np.ndarray, prior: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method, drawn to the weights ``prior``: without rows they stay, a few move
    them a little, many leave little of them."""
    if not len(x):
        return prior
    w = np.zeros(len(prior))  # Newton's steps are safe from here, not from weights that leave p at its ends
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (target - p) - penalty * (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, ``max_rows`` at most."""
    known = only(labels, doc_id="long", toxic="int").filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 1))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return only(docs, doc_id="long", text="string").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros((batch.num_rows, 2), np.int64)
        for i, hashes, _, _ in each_text(batch.column("text")):
            if len(hashes):
                runs = shingles(hashes, 5)
                keys[i] = [runs.min().view(np.int64), mix(runs).min().view(np.int64)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "toxic", "text", "ka", "kb"])


def apart(rows: DataFrame) -> DataFrame:
    """One of each group of like rows, told by either of two least shingle hashes: copies of a text are not more witnesses."""
    keyed = rows.select("doc_id", "toxic", "text").mapInArrow(_sketch, "doc_id long, toxic int, text string, ka long, kb long")
    for key in ("ka", "kb"):
        keyed = keyed.groupBy(key).agg(F.min_by(F.struct("toxic", "text", "ka", "kb"), "doc_id").alias("r"), F.min("doc_id").alias("doc_id")).select("doc_id", "r.*")
    return keyed.select("text", "toxic")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and term: toxic and clean texts that hold it, and that hold it twice."""
    for batch in batches:
        totals: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for term, n in term_counts(WORD.findall((text or "").lower())).items():
                row = totals.setdefault(term, [0, 0, 0, 0])
                row[1 - toxic] += 1
                row[3 - toxic] += n > 1
        columns = list(zip(*totals.values(), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["term", "a1", "b1", "a2", "b2"])


def mine_voters(rows: DataFrame, most: int = TERMS) -> Voters:
    """Terms that tell toxic from clean rows by the z value of their log odds, and of whose texts most are toxic.

    The driver gets at most 20 * ``most`` of them, and of terms that begin alike takes the best alone.
    """
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n1, n0 = totals["t"], totals["n"] - totals["t"]
    if not n0 or not n1:
        return Voters((), ())
    counts = rows.mapInArrow(_count_terms, "term string, a1 long, b1 long, a2 long, b2 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("a1", "b1", "a2", "b2")])
    each = counts.select("term", F.explode(F.array(*[F.struct(F.lit(k).alias("least"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in (1, 2)])).alias("r")).select("term", "r.*")
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    told = each.filter(f"a >= greatest(4, 0.02 * {n1}) AND a + 0.5 >= 0.7 * (a + b + 1)").withColumn("z", odds / spread).filter(odds > 2).filter("z > 4")
    told = told.withColumn("z", F.when(F.col("term").endswith("*"), F.col("z")).otherwise(1.1 * F.col("z")))  # a stem should add something to its word
    best: list[tuple[str, int]] = []
    for r in told.orderBy(F.desc("z"), F.desc(F.length("term")), "term", "least").limit(20 * most).collect():
        stem = r["term"].rstrip("*")
        if len(best) < most and not any(stem.startswith(t.rstrip("*")[:5]) or t.startswith(stem) for t, _ in best):
            best.append((r["term"], r["least"]))
    best.sort()
    return Voters(tuple(t for t, _ in best), tuple(n for _, n in best))


def _vote(batches: Iterator[pa.RecordBatch], voters: Voters) -> Iterator[pa.RecordBatch]:
    voting = Voting(voters)
    for batch in batches:
        got = [voting(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v, _ in got], pa.binary()), pa.array([x for _, x in got], pa.list_(pa.float64())), batch.column("toxic")], ["votes", "extra", "toxic"])


class Model(NamedTuple):
    voters: Voters
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Voters, label model and classifier. Labels choose the terms that vote, and are a voter of their own; the classifier
    learns from the label model's posteriors, not from labels, and from the seeds where rows are few: there is no least number of them."""
    small_batches(docs.sparkSession)
    rows = stored(apart(training_rows(docs, labels, max_rows)), "toxicity-sample")
    voters = mine_voters(rows)
    # Votes of max_rows rows at most.
    got = rows.mapInArrow(lambda b: _vote(b, voters), "votes binary, extra array<double>, toxic int").collect()
    width = len(voters.names)
    votes = np.frombuffer(b"".join(r["votes"] for r in got), np.int8).reshape(-1, width)
    posterior = fit_label_model(votes, np.array([r["toxic"] for r in got]))[1] if len(got) else np.zeros(0)
    return Model(voters, fit_linear(_design(votes, np.array([r["extra"] for r in got]).reshape(-1, 3)), posterior, seed_weights(voters)))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    voting = Voting(model.voters)
    for batch in batches:
        if not batch.num_rows:
            continue
        votes, extra = zip(*[voting(t or "") for t in batch.column("text").to_pylist()], strict=True)
        p = 1 / (1 + np.exp(-np.clip(_design(np.array(votes), np.array(extra)) @ model.weights, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= CUTOFF).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from CUTOFF up).

    The score depends on the text alone. Null and empty texts have no hits and get the lowest scores. A null doc_id counts as the empty text
    in the fold. Repeated rows are scored one by one; extra columns are ignored; no documents: no rows.
    """
    small_batches(docs.sparkSession)
    base = only(docs, doc_id="long", text="string").withColumn("held_out", fold(F.col("doc_id")) == 1)
    return base.mapInArrow(lambda b: _score(b, model), "doc_id long, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
