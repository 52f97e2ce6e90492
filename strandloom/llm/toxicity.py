"""Toxicity: weak supervision with a generative label model and a linear classifier.

Voters are lexicons and patterns: a public list of insults, shouting and address
patterns, and groups of words and word stems that stand out among the labelled rows
of the training folds, and a voter for harmless text. A generative model (latent class,
fitted by EM) estimates each voter's accuracy from the other voters and from the known
labels, half each, and the residual correlation of voters given the class; voters that
move together share their weight. The posterior of a row comes from its votes alone, its
own label is no voter, and the posteriors, not the labels, train a logistic regression
over words and word stems, which scores all texts.

Defined results: a null text counts as empty; the empty text gets the score of the
intercept; a null doc_id belongs to the held-out fold; repeated rows are scored alike;
without labelled rows of both kinds every score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, raw_texts, release, slices
from .quality import FIT_ROWS, FOLDS, sample_labelled  # noqa: F401

#: A public word list of plain insults.
INSULTS = tuple("idiot stupid moron dumb fool loser trash scum worthless pathetic disgusting clown ugly hate garbage imbecile jerk creep pig liar".split())
STEMS = (4, 5, 6)
#: Terms of the classifier, and how often one must occur in the sample.
TERMS, SUPPORT = 6_000, 4
#: Documents that a term must explain anew to be picked.
COVER = 2
#: Terms beyond so many share voters.
GROUPS = 48
#: The accuracy that a voter is first taken to have, and for how many votes that counts.
GUESS, WORTH = 0.9, 8
THRESHOLD = 0.5

_STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def terms_of(word: str) -> list[str]:
    """The word without its outer punctuation, and its stems; stems carry a mark."""
    w = word.strip(_STRIP)
    return [w, *(f"{w[:k]}\0" for k in STEMS if len(w) > k)] if w else []


def words_of(text: bytes) -> set[str]:
    return set(text.decode("utf-8", "replace").lower().split())


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(t, 0.0) for t in terms_of(word))

    def scores(self, texts: list[bytes], memo: Memo) -> np.ndarray:
        z = np.array([sum(map(memo.__getitem__, words_of(t))) for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def label_model(votes: np.ndarray, prior: float, known: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, voters' accuracy, voters' correlations) from votes of 1, 0 (abstains) and -1.

    votes: rows by voters; prior: the share of class 1; known: the rows' labels, 0 or 1, if there
    are any. A vote is evidence by how often the voter casts it in each class, which is counted
    over the posteriors, or half over them and half over the labels; abstaining is none. A row's posterior comes from
    its votes and the share of class 1 only, so it can differ from its label. Voters that cast
    the same vote in a row divide their weight there by the sum of their residual correlations,
    so copies of a voter count once. The first posterior is that of a majority vote."""
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    odds = np.log(prior / (1 - prior))
    post = 1 / (1 + np.exp(-np.clip(odds + 2 * votes.astype(float).sum(axis=1), -4, 4)))
    good, bad = WORTH * GUESS, WORTH * (1 - GUESS)
    for _ in range(rounds):
        q = post if known is None else (post + known) / 2
        right_up, wrong_up, wrong_down, right_down = q @ up, (1 - q) @ up, q @ down, (1 - q) @ down
        n_one, n_zero = max(1e-9, q.sum()), max(1e-9, (1 - q).sum())
        rest = votes - q[:, None] * (right_up - wrong_down) / n_one - (1 - q)[:, None] * (wrong_up - right_down) / n_zero
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        corr = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        alike = np.where(corr > 0.1, corr, 0)
        of_up = np.log(right_up + good) - np.log(wrong_up + bad) - np.log(n_one / n_zero)
        of_down = np.log(wrong_down + bad) - np.log(right_down + good) - np.log(n_one / n_zero)
        said = up / np.maximum(1, up @ alike) @ of_up + down / np.maximum(1, down @ alike) @ of_down
        post = 1 / (1 + np.exp(-np.clip(odds + said, -40, 40)))
    accuracy = (right_up + right_down + good) / (up.sum(axis=0) + down.sum(axis=0) + WORTH)
    return post, accuracy, corr


def covering(terms: list[int], owner: np.ndarray, flat: np.ndarray, y: np.ndarray, p: np.ndarray, n: np.ndarray) -> list[int]:
    """Terms picked one by one, each for the documents of label 1 that none before it explains.

    The words around an insult stand out too when a document has copies; once the insult
    is picked they explain nothing more."""
    at = np.full(len(p), -1, dtype=np.int64)
    at[terms] = np.arange(len(terms))
    live = (at[flat] >= 0) & (y[owner] > 0)
    docs, term = owner[live], at[flat[live]]
    sure = ((p[terms] + 0.5) / (p[terms] + n[terms] + 1.5)) ** 6
    picked = []
    while len(docs):
        open_ = np.bincount(term, minlength=len(terms))
        worth = np.where(open_ >= COVER, open_ * sure, 0)
        best = int(np.argmax(worth))
        if worth[best] <= 0:
            break
        picked.append(terms[best])
        left = ~np.isin(docs, docs[term == best])
        docs, term = docs[left], term[left]
    return picked


def train(texts: list[bytes], y: np.ndarray) -> Classifier:
    """Terms, voters, label model, then logistic regression on the posterior labels."""
    if not len(y) or y.min() == y.max():
        return Classifier({}, 500.0 if len(y) and y.min() == 1 else -500.0)
    ids: dict[str, int] = {}
    memo = Memo(lambda w: [ids.setdefault(t, len(ids)) for t in terms_of(w)])
    bags = []
    for t in texts:
        got = np.fromiter((i for w in words_of(t) for i in memo[w]), dtype=np.int32)
        bags.append(np.unique(got))
    names = list(ids)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])])
    flat, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), np.diff(starts))
    np_, nn = int(y.sum()), int(len(y) - y.sum())
    n = np.bincount(flat, minlength=len(ids))
    p = np.bincount(flat[y[owner] > 0], minlength=len(ids))
    n = n - p
    rate = np.log((p + 0.5) / (np_ + 1)) - np.log((n + 0.5) / (nn + 1))
    z = np.where(p + n >= SUPPORT, rate / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)), 0)
    chosen = sorted(np.flatnonzero(z > 2), key=lambda i: (-z[i], names[i]))[:TERMS]
    public = [ids[w] for w in INSULTS if w in ids and p[ids[w]] > n[ids[w]]]
    chosen = list(dict.fromkeys([*covering(chosen, owner, flat, y, p, n), *public]))
    at = np.full(len(ids), -1, dtype=np.int32)
    at[chosen] = np.arange(len(chosen))
    kept = at[flat] >= 0
    owner, flat = owner[kept], at[flat[kept]]
    rate, p, names = rate[chosen], p[chosen], [names[i] for i in chosen]

    # Voters: the public list, a pattern of address, harmless text, terms that stand out.
    strong = np.flatnonzero((rate > 3) & (p >= SUPPORT))
    group = np.full(len(names), -1)
    group[strong] = np.arange(len(strong)) % GROUPS
    listed = np.isin(np.array(names, dtype=object), INSULTS)
    votes = np.zeros((len(y), 3 + GROUPS), dtype=np.int8)
    votes[:, 0] = np.bincount(owner, listed[flat], len(y)) > 0
    votes[:, 1] = votes[:, 0] * np.array([b"you " in t.lower() for t in texts])
    for g in range(GROUPS):
        votes[:, 3 + g] = np.bincount(owner, group[flat] == g, len(y)) > 0
    votes[:, 2] = np.where(votes.any(axis=1), 0, -1)
    votes = votes[:, (votes != 0).any(axis=0)]
    post, _, _ = label_model(votes, np_ / len(y), y)

    # Logistic regression by Adam over the sparse rows, L2 on the weights.
    w, b = np.zeros(len(names)), float(np.log(np_ / nn))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 401):
        s = np.bincount(owner, w[flat], len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(s, -50, 50))) - post) / len(y)
        g = np.append(np.bincount(flat, d[owner], len(w)) + 2e-6 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        # Harmless words are no evidence against harm: in a long text they would outweigh an insult.
        w, b = np.maximum(0, w - move[:-1]), b - float(move[-1])
    return Classifier({t: float(x) for t, x in zip(names, w, strict=True) if x > 1e-3}, b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Trains on one executor from a bounded sample, so the driver holds only the weights."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += raw_texts(batch)
            y += batch.column("y").to_pylist()
        order = sorted(range(len(y)), key=lambda i: (texts[i], y[i]))
        got = train([texts[i] for i in order], np.array([y[i] for i in order], dtype=int))
        del texts
        release()
        yield pa.RecordBatch.from_pydict({"term": ["", *got.weights], "w": [got.bias, *got.weights.values()]})

    # At most `rows` rows meet in the one task, even where ids repeat; the scan before stays spread.
    sample = sample_labelled(docs, labels, "toxic", rows).limit(rows)
    got = sample.mapInArrow(whole, "term string, w double").collect()
    return Classifier({r.term: r.w for r in got if r.term}, next((r.w for r in got if not r.term), -500.0))


def score(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """Adds score to the columns in keep (all by default); docs needs text."""
    keep = docs.columns if keep is None else keep
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("text"))
    schema = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.word)
        for batch in slices(batches):
            s = model.scores(raw_texts(batch), memo)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], [*batch.schema.names[:-1], "score"])

    out = inner.mapInArrow(rate, f"{schema}, score double" if schema else "score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score")
