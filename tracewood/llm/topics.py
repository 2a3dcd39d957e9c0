"""Subjects of each text: a classifier chain over term, source and structure features, decoded by beam search.

Texts are read once: their sentences are written as lists of word ids, and everything after works on these arrays.

1. A bounded sample of labelled documents (``SAMPLE``, by hash of the id) gives the words that are typical of one subject.
2. ``ROUNDS`` passes over the words of all documents let sentences that hold typical words of one subject only (or none, in a
   document of one subject) vouch for their other words, so that words few labels or none have met are learned as well.
3. Sentences with a single typical word are weighed by their other words: in the sample these tell a passing mention or
   a comparison ("not to be mixed up with the ... of the same name") from a sentence that deals with its word.
4. Per document and subject the evidence becomes a few features: terms, structure, and how often the document's source has the
   subject in the sample (leaving the document itself out). A chain of logistic links decides subject after subject, each seeing
   the subjects chosen so far and how they go together in the sample. Every subject has weights of its own, drawn towards those
   fitted over all subjects, and a calibration fitted on scores of folds left out of its fit; beam search finds the best set.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewood.session import Workspace

SAMPLE = 20_000  # the most labelled documents the classifier is fitted on
VOCABULARY = 2_000_000  # the most words of the model (some 36 MB): the commonest typical ones
SUBJECTS = 200  # the most subjects; subject_area is a small fixed table
PURITY = 0.8  # share of a word's labelled documents that must be of one subject
LEARNED_PURITY = 0.9  # share of a word's sentences in all documents that must speak of one subject
ROUNDS = 3
BEAM = 8
FOLDS = 4
SHRINK = 20.0  # how strongly a subject's weights are drawn towards the pooled ones
KINDS = ("markdown", "source", "commit", "doc_comment", "question", "rules")
MARK = 0x5BD1E995A7C15F39  # a title's words come a second time, their ids changed by this

_WORD = re.compile(r"[^\W\d_]{3,30}(?![^\W\d_])")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])|_")
_SENTENCE = re.compile(r"[.!?;]+[)\]\"'»”]*\s+|\n+")
_met: dict[str, list[int]] = {}  # word ids of parts met lately; texts of one origin repeat their phrases
_MOST_MET = 100_000
_known: dict[str, int] = {}  # ids of words met lately
_MOST_KNOWN = 500_000


def word_id(word: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(word), "big", signed=True)


def _ids(part: str) -> list[int]:
    """Ids of the distinct words (three letters at least, in lower case, identifiers taken apart) of a sentence or line."""
    ids = _met.get(part)
    if ids is None:
        ids = []
        for w in {*_WORD.findall(_CAMEL.sub(" ", part).lower())}:
            i = _known.get(w)
            if i is None:
                if len(_known) >= _MOST_KNOWN:
                    _known.clear()
                i = _known[w] = word_id(w)
            ids.append(i)
        if len(part) < 400:
            if len(_met) >= _MOST_MET:
                _met.clear()
            _met[part] = ids
    return ids


def word_lists(docs: DataFrame) -> DataFrame:
    """doc_id, kind, source, n (characters), sizes (words of each sentence that has any), words (ids, end to end) of every
    document with an id and a text."""
    schema = "doc_id bigint, kind string, source string, n int, sizes array<int>, words array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, lengths, at_s, at_w = [], [], [], [0], [0]
            for text in batch.column(3).to_pylist():
                lengths.append(len(text))
                for part in _SENTENCE.split(text):
                    ids = _ids(part)
                    if ids:
                        sizes.append(len(ids))
                        words.extend(ids)
                at_s.append(len(sizes))
                at_w.append(len(words))
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, t)) for o, v, t in ((at_s, sizes, pa.int32()), (at_w, words, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(lengths, pa.int32()), *lists], names=["doc_id", "kind", "source", "n", "sizes", "words"])

    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "kind", "source", "text").mapInArrow(run, schema)


class Sentences:
    """A batch of word lists as flat arrays: one entry per word and sentence, a title's words a second time with their mark."""

    def __init__(self, sizes: pa.ListArray, words: pa.ListArray) -> None:
        size, word = sizes.flatten().to_numpy(), words.flatten().to_numpy()
        per_doc = np.diff(sizes.offsets.to_numpy())
        self.docs, self.count = len(sizes), len(size)
        self.doc = np.repeat(np.arange(self.docs), per_doc)  # of each sentence
        first = np.zeros(self.count, dtype=bool)
        starts = np.cumsum(per_doc) - per_doc
        first[starts[per_doc > 0]] = True
        self.first = first
        sentence = np.repeat(np.arange(self.count), size)
        title = first[sentence]
        self.word = np.concatenate([word, word[title] ^ MARK])
        self.sentence = np.concatenate([sentence, sentence[title]])
        self.marked = np.arange(len(self.word)) >= len(word)
        self.size = size * (1 + first)


def _find(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Place of each word among sorted keys, or -1."""
    if not len(keys):
        return np.full(len(word), -1)
    at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
    return np.where(keys[at] == word, at, -1)


def _sorted(table: dict[int, float], kind: type) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(table), dtype=np.int64)
    return keys, np.array([table[k] for k in keys.tolist()], dtype=kind)


@dataclass
class Model:
    subjects: list[str]
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # ids of typical words, sorted
    subject: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int16))  # subject of each
    cues: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    cue: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log odds that a sentence only mentions its typical word
    cue_prior: float = -3.0
    sources: dict[str, tuple[int, np.ndarray]] = field(default_factory=dict)  # sampled documents and their subjects
    prior: np.ndarray | None = None  # share of each subject in the sample
    weights: np.ndarray | None = None  # (subjects, features and chain)
    scale: np.ndarray | None = None  # (subjects, 2): calibration of a link's score
    together: np.ndarray | None = None  # log lift of pairs of subjects
    order: list[int] = field(default_factory=list)

    def typical(self, words: dict[int, int]) -> None:
        self.words, self.subject = _sorted(words, np.int16)

    def hits(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Entries that are typical words, and their subjects."""
        at = _find(self.words, s.word)
        return np.flatnonzero(at >= 0), self.subject[at[at >= 0]].astype(np.int64)

    def rates(self, source: list[str | None], own: np.ndarray | None = None) -> np.ndarray:
        """(documents, subjects): log odds of each subject in the document's source against all; ``own``: what to leave out."""
        k = len(self.subjects)
        n, got = np.zeros((len(source), 1)), np.zeros((len(source), k))
        for i, x in enumerate(source):
            if x in self.sources:
                n[i], got[i] = self.sources[x]
        if own is not None:
            known = n[:, 0] > 0
            n[known] -= 1
            got[known] -= own[known]
        rate = (got + 10 * self.prior) / (n + 10)
        return np.log(rate / (1 - rate)) - np.log(self.prior / (1 - self.prior))

    def features(self, s: Sentences, n: np.ndarray, kind: list[str | None], source: list[str | None], own: np.ndarray | None = None) -> np.ndarray:
        """(documents, subjects, features)."""
        k, d = len(self.subjects), s.docs
        entry, subject = self.hits(s)
        base = s.marked[entry]  # a title's word counts once
        if base.any():
            twice = base.copy()
            twice[base] = _find(self.words, s.word[entry[base]] ^ MARK) >= 0
            entry, subject = entry[~twice], subject[~twice]
        sentence = s.sentence[entry]
        hits = np.bincount(sentence, minlength=s.count)
        at = _find(self.cues, s.word)
        cue = np.where(at >= 0, self.cue[at] if len(self.cue) else 0.0, 0.0)
        score = self.cue_prior + np.bincount(s.sentence, weights=cue, minlength=s.count)
        lone = hits[sentence] == 1
        q = np.zeros(len(entry))
        q[lone] = 1 / (1 + np.exp(-np.clip(score[sentence[lone]] - cue[entry[lone]], -30, 30)))
        cell, where, c = np.unique(sentence * k + subject, return_index=True, return_counts=True)  # sentence and subject
        q, line, subj = q[where], cell // k, cell % k
        doc, single = s.doc[line], hits[line] == 1

        def add(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc * k + subj, weights=values, minlength=d * k).reshape(d, k)

        strong, weak, mention, lines = add(np.where(c > 1, c, 0)), add(np.where(c > 1, 0, 1 - q)), add(np.where(c > 1, 0, q)), add(1 - q)
        best, title, heading = np.zeros(d * k), np.zeros(d * k), np.zeros(d * k)
        np.maximum.at(best, doc * k + subj, np.where(single, 1 - q, c))
        top = s.first[line]
        title[(doc * k + subj)[top]] = 1
        heading[(doc * k + subj)[top]] = ((s.size[line] <= 12) * (1 - q))[top]  # six words, each of them marked too
        pair, word = s.doc[sentence] * k + subject, s.word[entry]
        by = np.lexsort((word, pair))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (pair[by][1:] != pair[by][:-1]) | (word[by][1:] != word[by][:-1])
        distinct = np.bincount(pair[by][new], minlength=d * k).reshape(d, k)
        best, title, heading = (a.reshape(d, k) for a in (best, title, heading))
        total = strong + weak
        whole = total.sum(axis=1, keepdims=True)
        place = np.array([[kd == x for x in KINDS] for kd in kind], dtype=float).reshape(d, 1, len(KINDS))
        short = np.array([kd in ("markdown", "commit") for kd in kind], dtype=float)[:, None]
        wide = lambda a: np.broadcast_to(a, (d, k))
        cols = [
            np.ones((d, k)), np.log1p(total), total / (1 + whole), np.log1p(strong), np.log1p(weak), np.log1p(mention), np.minimum(best, 4), title, np.log1p(distinct), np.log1p(lines), np.log1p(np.maximum(whole - total, 0)), total > 0.5, (total >= total.max(axis=1, keepdims=True)) & (total > 0.3), best >= 2, best >= 3, lines > 1.5, (title > 0) & (best >= 0.5), heading, heading * short,
            wide(np.log1p(n)[:, None]), wide(np.array([x is None for x in source], dtype=float)[:, None]), self.rates(source, own),
        ]
        return np.concatenate([np.stack(cols, axis=2).astype(float), (total > 0.3)[:, :, None] * place], axis=2)

    def decode(self, logits: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """Best label sets (documents, subjects) of base logits by beam search; ``chain``: (subjects, 3) weights of one subject
        before, more than one, and pairs."""
        n, k = logits.shape
        scale = np.tile([1.0, 0.0], (k, 1)) if self.scale is None else self.scale
        chosen = np.zeros((n, 1, k), dtype=bool)
        score = np.zeros((n, 1))
        for s in self.order:
            number = chosen.sum(axis=2)
            z = logits[:, [s]] + chain[s, 0] * (number == 1) + chain[s, 1] * (number > 1) + chain[s, 2] * (chosen @ self.together[s])
            z = scale[s, 0] * z + scale[s, 1]
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            both = np.concatenate([chosen, chosen], axis=1)
            both[:, chosen.shape[1] :, s] = True
            total = np.concatenate([score + no, score + yes], axis=1)
            top = np.argsort(-total, axis=1, kind="stable")[:, :BEAM]
            score = np.take_along_axis(total, top, axis=1)
            chosen = np.take_along_axis(both, top[:, :, None], axis=1)
        return chosen[:, 0, :]


def majority_labels(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subjects): subjects that at least half of a document's annotators gave; an empty list where that is 'none'.

    Spelling is folded; labels that name no subject, nulls and repeated labels don't count.
    """
    told = labels.select("doc_id", F.coalesce("annotator", F.lit("")).alias("annotator"), F.lower(F.trim("subject")).alias("subject")).filter("doc_id is not null").filter(F.col("subject").isin([*subjects, "none"])).distinct()
    by = told.groupBy("doc_id").agg(F.count_distinct("annotator").alias("annotators"))
    votes = told.groupBy("doc_id", "subject").agg(F.count("*").alias("votes")).join(by, "doc_id").filter(F.col("votes") * 2 >= F.col("annotators"))
    return votes.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("subject") != "none", F.col("subject")))).alias("subjects"))


COUNTS = "word bigint, marked boolean, subject int, n bigint"


def _tally(word: np.ndarray, marked: np.ndarray, subject: np.ndarray) -> pa.RecordBatch:
    """Number of equal (word, subject)."""
    order = np.lexsort((subject, word))
    word, marked, subject = word[order], marked[order], subject[order]
    new = np.ones(len(word), dtype=bool)
    new[1:] = (word[1:] != word[:-1]) | (subject[1:] != subject[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(word)))
    return pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(marked[at]), pa.array(subject[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "marked", "subject", "n"])


def _label_counts(taught: DataFrame, k: int) -> DataFrame:
    """COUNTS of documents with at most one subject (``label``; none is k) by each word in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sentences(batch.column(0), batch.column(1))
            label = np.array([x[0] if x else k for x in batch.column(2).to_pylist()], dtype=np.int64)
            doc = s.doc[s.sentence]
            order = np.lexsort((doc, s.word))
            once = np.ones(len(order), dtype=bool)
            once[1:] = (s.word[order][1:] != s.word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            kept = order[once]
            yield _tally(s.word[kept], s.marked[kept], label[doc[kept]])

    return taught.filter("size(label) <= 1").select("sizes", "words", "label").mapInArrow(run, COUNTS)


def _sentence_counts(lists: DataFrame, model) -> DataFrame:
    """COUNTS of sentences by each word in them that speak of a subject by their typical words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.value.subjects)
        for batch in batches:
            s = Sentences(batch.column(0), batch.column(1))
            entry, subject = model.value.hits(s)
            bounds = []
            for group, size in ((s.sentence[entry], s.count), (s.doc[s.sentence[entry]], s.docs)):
                low, high = np.full(size, k), np.full(size, -1)
                np.minimum.at(low, group, subject)
                np.maximum.at(high, group, subject)
                bounds.append((low, high))
            (low, high), (dlow, dhigh) = bounds
            rest = np.where(dlow == dhigh, dlow, k)
            speaks = np.where(high < 0, rest[s.doc], low)
            kept = (low >= high)[s.sentence]  # no or one subject
            yield _tally(s.word[kept], s.marked[kept], speaks[s.sentence[kept]])

    return lists.select("sizes", "words").mapInArrow(run, COUNTS)


def _typical(counts: DataFrame, k: int, least: int, share_of: str, purity: float) -> dict[int, int]:
    """Words of which one subject has the ``purity`` share of sentences: word to subject, the commonest VOCABULARY ones."""
    firm = F.when(F.col("marked"), 4 * least).otherwise(least)  # a title's words are met less and prove less
    sums = counts.groupBy("word", "marked", "subject").agg(F.sum("n").alias("n"))
    by = sums.groupBy("word", "marked").agg(F.max_by("subject", F.struct("n", "subject")).alias("subject"), F.max("n").alias("n"), F.sum(F.expr(share_of)).alias("all"), F.sum("n").alias("total"))
    good = by.filter((F.col("subject") < k) & (F.col("n") >= firm) & (F.col("n") >= F.lit(purity) * F.col("all")) & (F.col("n") * 4 >= F.col("total")))
    got = good.orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word", "subject").toPandas()
    return dict(zip(got["word"].tolist(), got["subject"].tolist(), strict=True))


def _cue_counts(taught: DataFrame, model) -> dict[int, tuple[int, int]]:
    """Words of sentences with one typical word, by whether the document has that word's subject; 0 stands for the sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.value.subjects)
        for batch in batches:
            s = Sentences(batch.column(0), batch.column(1))
            given = _sets(batch.column(2).to_pylist(), k)
            entry, subject = model.value.hits(s)
            lone = np.bincount(s.sentence[entry], minlength=s.count)[s.sentence[entry]] == 1
            entry, subject = entry[lone], subject[lone]
            own = np.full(s.count, -1)
            own[s.sentence[entry]] = given[s.doc[s.sentence[entry]], subject]
            kept = own[s.sentence] >= 0
            kept[entry] = False
            word = np.concatenate([s.word[kept], np.zeros(len(entry), dtype=np.int64)])
            yield _tally(word, np.zeros(len(word), dtype=bool), np.concatenate([own[s.sentence[kept]], own[s.sentence[entry]]]))

    sums = taught.select("sizes", "words", "label").mapInArrow(run, COUNTS).groupBy("word").agg(F.sum(F.when(F.col("subject") == 1, F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.col("subject") == 0, F.col("n")).otherwise(0)).alias("other"))
    got = sums.filter("own + other >= 3").orderBy(F.desc(F.col("own") + F.col("other")), "word").limit(VOCABULARY).toPandas()
    return {w: (a, b) for w, a, b in zip(got["word"].tolist(), got["own"].tolist(), got["other"].tolist(), strict=True)}


def _sets(labels: list[list[int]], k: int) -> np.ndarray:
    out = np.zeros((len(labels), k), dtype=bool)
    for i, x in enumerate(labels):
        out[i, x] = True
    return out


def _fit_links(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, towards: np.ndarray | float = 0.0) -> np.ndarray:
    """Logistic regression by Newton steps, its weights drawn ``towards`` others."""
    w = np.zeros(x.shape[1]) + towards
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - towards)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _fit_chain(model: Model, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
    """Weights and calibration of every subject's link from features (documents, subjects, features) and labels."""
    n, k, _ = x.shape
    share = (y.sum(axis=0) + 1) / (n + 2)
    pairs = (y.T.astype(float) @ y + 1) / (n + 2)
    model.together = np.clip(np.log(pairs / np.outer(share, share)), -3, 3)
    np.fill_diagonal(model.together, 0)
    model.order = [int(i) for i in np.argsort(-share, kind="stable")]
    blocks, before = [None] * k, np.zeros((n, k), dtype=bool)
    for s in model.order:
        number = before.sum(axis=1)
        blocks[s] = np.concatenate([x[:, s, :], np.stack([number == 1, number > 1, before @ model.together[s]], axis=1)], axis=1)
        before[:, s] = y[:, s]

    def links(rows: np.ndarray) -> np.ndarray:
        pooled = _fit_links(np.concatenate([b[rows] for b in blocks]), y[rows].T.ravel().astype(float))
        return np.stack([_fit_links(blocks[s][rows], y[rows, s].astype(float), SHRINK, pooled) for s in range(k)])

    model.weights = links(np.arange(n))
    z = np.zeros((n, k))
    for f in range(FOLDS):
        out = fold == f
        if out.any() and not out.all():
            w = links(np.flatnonzero(~out))
            z[out] = np.stack([blocks[s][out] @ w[s] for s in range(k)], axis=1)
    model.scale = np.stack([_fit_links(np.stack([z[:, s], np.ones(n)], axis=1), y[:, s].astype(float), 5.0, np.array([1.0, 0.0])) for s in range(k)])


def fit(lists: DataFrame, labels: DataFrame, areas: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the subjects of ``areas`` from word lists; without labelled documents it rests on the words of ``about``."""
    rows = areas.select("subject", "about").filter("subject is not null").orderBy("subject").limit(SUBJECTS + 1).collect()
    if len(rows) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    about: dict[str, set[str]] = defaultdict(set)
    for r in rows:
        own = r["subject"].strip().lower()
        about[own] |= {*_WORD.findall(_CAMEL.sub(" ", r["about"] or "").lower()), own}
    model = Model(sorted(about))
    k = len(model.subjects)
    if not k:
        return model
    context = lists.sparkSession.sparkContext
    owners = Counter(w for words in about.values() for w in words)
    first = {word_id(form): i for i, s in enumerate(model.subjects) for w in about[s] if owners[w] == 1 and len(w) > 4 for form in (w, w.removesuffix("s"))}
    chosen = majority_labels(labels, model.subjects).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    numbers = F.create_map(*[x for i, s in enumerate(model.subjects) for x in (F.lit(s), F.lit(i))])
    chosen = chosen.select("doc_id", F.transform("subjects", lambda s: F.element_at(numbers, s)).alias("label"))
    taught = lists.join(F.broadcast(chosen), "doc_id").persist()
    by_label = _typical(_label_counts(taught, k), k, 2, "n", PURITY)
    model.typical({**first, **by_label})
    # words that sentences of typical words vouch for; sentences without any count half against a word by the last filter
    for _ in range(ROUNDS):
        learned = _typical(_sentence_counts(lists, context.broadcast(model)), k, 5, f"if(subject < {k}, n, 0)", LEARNED_PURITY)
        model.typical({**learned, **by_label})
    cues = _cue_counts(taught, context.broadcast(model))
    own, other = cues.pop(0, (0, 0))
    model.cue_prior = math.log((other + 1) / (own + 10))
    odds = {w: math.log((b + 0.5) / (other + 1)) - math.log((a + 0.5) / (own + 1)) for w, (a, b) in cues.items()}
    model.cues, model.cue = _sorted({w: max(-4.0, min(4.0, v)) for w, v in odds.items() if abs(v) > 0.7}, float)
    # the sample's word lists, at most SAMPLE of them, in passes of a few thousand
    got = taught.select("sizes", "words", "n", "kind", "source", "label", "doc_id").orderBy("doc_id").toArrow()
    taught.unpersist()
    y = _sets(got["label"].to_pylist(), k)
    source = got["source"].to_pylist()
    model.prior = (y.sum(axis=0) + 1) / (len(y) + 2)
    for name in sorted({x for x in source if x is not None}):
        mine = np.array([x == name for x in source])
        model.sources[name] = (int(mine.sum()), y[mine].sum(axis=0).astype(float))
    width = model.features(Sentences(*_no_lists()), np.zeros(0), [], []).shape[2]
    blocks = []
    for at in range(0, len(y), 2000):
        part = got.slice(at, 2000).combine_chunks()
        s = Sentences(*(part[c].combine_chunks() if part[c].num_chunks else part[c].chunk(0) for c in ("sizes", "words")))
        blocks.append(model.features(s, part["n"].to_numpy(), part["kind"].to_pylist(), part["source"].to_pylist(), y[at : at + 2000]))
    if len(y):
        fold = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in got["doc_id"].to_pylist()])
        _fit_chain(model, np.concatenate(blocks), y, fold)
    else:
        model.together, model.order = np.zeros((k, k)), list(range(k))
        model.weights = np.zeros((k, width + 3))
        model.weights[:, [0, 1, 2]] = -2.5, 1.0, 3.0
    return model


def _no_lists() -> tuple[pa.ListArray, pa.ListArray]:
    return pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int64()))


def subjects_of(docs: DataFrame, labels: DataFrame, areas: DataFrame, sample: int = SAMPLE, work: Workspace | None = None) -> DataFrame:
    """(doc_id, subject): one row for each subject a text deals with.

    Null, empty and blank texts deal with none, rows without doc_id are left out, and equal texts get equal subjects
    where kind and source are equal. No subjects or no documents give no rows.
    """
    work = work or Workspace(docs.sparkSession, "subjects")
    lists = work.cut(word_lists(docs.select("doc_id", "text", "kind", "source")))
    model = fit(lists, labels, areas, sample)
    if not model.subjects:
        return lists.limit(0).select("doc_id", F.lit("").alias("subject"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        width = m.weights.shape[1] - 3
        for batch in batches:
            who, what = [], []
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                x = m.features(Sentences(part.column(4), part.column(5)), part.column(3).to_numpy(), part.column(1).to_pylist(), part.column(2).to_pylist())
                logits = np.einsum("dkf,kf->dk", x, m.weights[:, :width])
                doc, subject = np.nonzero(m.decode(logits, m.weights[:, width:]))
                who.append(part.column(0).to_numpy()[doc])
                what.append(subject)
            names = np.array(m.subjects, dtype=object)[np.concatenate(what)] if what else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who) if who else [], pa.int64()), pa.array(names, pa.string())], names=["doc_id", "subject"])

    return lists.mapInArrow(run, "doc_id bigint, subject string").distinct()


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of each subject and their share of all documents."""
    total = docs.agg(F.count("*").alias("all"))
    return found.groupBy("subject").agg(F.count("*").alias("documents")).join(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("all"), 6).alias("share"))
