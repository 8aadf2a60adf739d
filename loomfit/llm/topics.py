"""Subject areas of messages, from an anchored non-negative factorization of the document-term matrix.

Every component is anchored: to a subject in a language, or to a language, which takes up what its subjects share. Labelled
documents start the subjects' components and stay bound to their own subjects; all documents take part in the alternating
updates of terms and mixtures. A document has the subjects that the mixtures of its sentences hold, each sentence's mixture
being one update from that of the whole collection.

Signatures and disclaimers are what the collection repeats: short lines that open paragraphs in many messages, nearly always
next to the end, and sentences that stand in many messages, nearly always among other repeated ones only.

Frequent terms are few and go to all tasks. Rare ones stay in a distributed table: their part in the components follows from
the mixtures of the documents they are in, and joins these by term.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfit.llm.mail import own_text, paragraphs
from loomfit.llm.tokens import texts
from loomfit.session import small, store

#: Alternating updates of the terms, and updates of the mixtures in each.
ROUNDS, INNER = 3, 16
#: Share of the documents from which a claimed language has components of its own: at most 50 have. Documents of others are
#: judged by the language whose terms fit them best.
LANGUAGE_SHARE = 0.02
#: A term needs this many documents. From ``FREQUENT`` of all documents on it is held by all tasks; there are at most the
#: mean number of terms of a document divided by that.
MIN_DOCS, FREQUENT = 4, 0.0002
#: Share of the documents from which a line or sentence is a repeated one.
REPEATED = 0.0002
#: Lines that may follow a signature's first one, and the share of such places among all; share of the paragraphs of a
#: disclaimer's sentence in which all sentences are repeated, of messages in which not all are.
FOLLOW, AT_END, AMONG_SUCH = 8, 0.95, 0.9
#: Share of the sentences from which a document has a subject, and terms from which a sentence has one.
SENTENCE_SHARE, EVIDENCE = 0.25, 0.5
#: Weight of a wrong component in a labelled document: labels may be wrong.
SLACK = 0.05
#: Tokens of the language that a subject's labelled documents are mixed with at the start.
SHRINK = 5.0
#: Most subject areas.
MOST_SUBJECTS = 1_000
WORD = re.compile(r"[^\W\d_]{2,}")
TOKEN = re.compile(r"\w+")
LINK = re.compile(r"\S*(?:@|://)\S*")


def term(word: str) -> int:
    """The number of a word."""
    return xxhash.xxh64_intdigest(word) >> 1


def terms_of(sentence: str) -> list[int]:
    """Terms of a sentence. Addresses and links are no words."""
    return [term(w) for w in WORD.findall(LINK.sub(" ", sentence).lower())]


def mark(sentence: str) -> int:
    """The number of a sentence, whatever its case, spaces and signs."""
    return term(" ".join(TOKEN.findall(sentence.lower())))


PARSED = {"words": "bigint", "ends": "int", "marks": "bigint", "paras": "int", "heads": "bigint", "after": "int"}


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id, more`` and lists: ``words``, the terms of the sentences one after another, and ``ends``, where each ends;
    ``marks`` and ``paras``, every sentence's number and paragraph; ``heads`` and ``after``, every paragraph's first line if
    that is short (else 0) and the lines that follow it."""
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *more, F.col(text_col).alias("text_"))
    names = [*kept.columns[:-1], *PARSED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {c: [] for c in PARSED}
            for t in texts(b.column(b.num_columns - 1)):
                found = paragraphs(own_text(t))
                each = [(k, x) for k, p in enumerate(found) for x in p.sentences]
                words = [terms_of(x) for _, x in each]
                rows["words"].append([w for x in words for w in x])
                rows["ends"].append(np.cumsum([len(x) for x in words]).tolist())
                rows["marks"].append([mark(x) for _, x in each])
                rows["paras"].append([k for k, _ in each])
                rows["heads"].append([term(p.head) if p.head else 0 for p in found])
                rows["after"].append([p.after for p in found])
            lists = [pa.array(rows[c], pa.list_(pa.int64() if kind == "bigint" else pa.int32())) for c, kind in PARSED.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(run, ", ".join([*kinds, *[f"{c} array<{kind}>" for c, kind in PARSED.items()]]))


def numbers(df: DataFrame) -> np.ndarray:
    """The only column of a table of bounded size, sorted."""
    return np.sort(df.toArrow().column(0).to_numpy())


def repeated(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines of signatures, and sentences of disclaimers. Both are at most the mean number of lines or sentences of a
    document divided by ``REPEATED``."""
    least = max(MIN_DOCS, REPEATED * total)
    lines = rows.select(F.explode(F.arrays_zip("heads", "after")).alias("x")).where("x.heads <> 0").groupBy("x.heads")
    lines = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.after") <= FOLLOW).alias("near"))
    openers = numbers(lines.where((F.col("n") >= least) & (F.col("near") >= AT_END * F.col("n"))).select("heads"))
    many = rows.select(F.explode(F.array_distinct("marks")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    shared = rows.sparkSession.sparkContext.broadcast(numbers(many.select("m")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(shared.value):
                continue
            m, size = flat(b.column(0))
            known = positions(m, shared.value) >= 0
            doc = np.repeat(np.arange(len(size)), size)
            _, at = np.unique(doc << 32 | flat(b.column(1))[0], return_inverse=True)
            alone = np.bincount(at, ~known)[at] == 0
            known &= np.bincount(doc, ~known)[doc] > 0  # where all is repeated, all stands among such
            k, first = np.unique(m[known], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(first, alone[known], len(k))), pa.array(np.bincount(first, minlength=len(k)))], ["m", "alone", "n"])

    found = rows.select("marks", "paras").mapInArrow(run, "m bigint, alone double, n bigint").groupBy("m").agg(F.sum("alone").alias("alone"), F.sum("n").alias("n"))
    return openers, numbers(found.where(F.col("alone") >= AMONG_SUCH * F.col("n")).select("m"))


def cleaned(rows: DataFrame, openers: np.ndarray, disclaimers: np.ndarray) -> DataFrame:
    """``doc_id, claim, words, ends`` without the paragraphs from a signature's first line on, and without disclaimers."""
    shared = rows.sparkSession.sparkContext.broadcast((openers, disclaimers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openers, disclaimers = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: flat(b.column(c)) for c in PARSED}
            heads, n = col["heads"]
            doc = np.repeat(np.arange(b.num_rows), n)
            para = np.arange(len(heads)) - np.repeat(np.cumsum(n) - n, n)
            end = np.full(b.num_rows, np.iinfo(np.int64).max)
            if len(openers):
                opens = positions(heads, openers) >= 0
                np.minimum.at(end, doc[opens], para[opens])
            marks, size = col["marks"]
            of = np.repeat(np.arange(b.num_rows), size)
            keep = col["paras"][0] < end[of]
            if len(disclaimers):
                keep &= positions(marks, disclaimers) < 0
            sentence, _ = sentence_of(b.column("ends"), col["words"][1])
            at = (np.cumsum(size) - size)[np.repeat(np.arange(b.num_rows), col["words"][1])] + sentence
            length = np.bincount(at, minlength=len(marks))
            words = col["words"][0][keep[at]]
            kept = np.bincount(of[keep], minlength=b.num_rows)
            total = np.cumsum(length[keep])
            before = np.r_[0, total][np.cumsum(kept) - kept]
            ends = total - np.repeat(before, kept)
            held = np.bincount(of[keep], length[keep], b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("claim"), listed(words, held), listed(ends.astype(np.int32), kept)], ["doc_id", "claim", "words", "ends"])

    return rows.mapInArrow(run, "doc_id bigint, claim int, words array<bigint>, ends array<int>")


def listed(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values))


@dataclass
class Model:
    """Frequent terms (sorted) and their part in the components: per language the subjects' and then its own (columns add
    up to 1), the mass of each, and the terms' logarithmic shares in the languages."""

    terms: np.ndarray
    tongues: np.ndarray
    h: np.ndarray | None = None
    mass: np.ndarray | None = None

    def speaks(self) -> np.ndarray:
        """How a term is shared by the components: a mixture's update from that of the whole collection."""
        joint = self.h * self.mass[:, None]
        return joint / np.maximum(joint.sum(2, keepdims=True), 1e-30)


@dataclass
class Batch:
    """The document-term matrix of a batch by row (frequent terms only), and the language of every document."""

    row: np.ndarray
    col: np.ndarray
    x: np.ndarray
    tongue: np.ndarray
    n: int

    def of(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and counts of the documents of a language, whose numbers are the last item; rows count these."""
        docs = self.tongue == t
        ok = docs[self.row]
        return (np.cumsum(docs) - 1)[self.row[ok]], self.col[ok], self.x[ok], np.flatnonzero(docs)


def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a list column and how many each row has."""
    offsets = np.asarray(words.offsets)
    return words.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def positions(w: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Where each term is among ``terms`` (sorted), -1 for others."""
    k = np.minimum(np.searchsorted(terms, w), len(terms) - 1)
    return np.where(terms[k] == w, k, -1)


def matrix(words: pa.Array, model: Model) -> Batch:
    """The language of a document is that whose terms fit its own best, whatever it claims."""
    w, size = flat(words)
    k = positions(w, model.terms)
    key = np.repeat(np.arange(len(size)), size)[k >= 0] * len(model.terms) + k[k >= 0]
    key, n = np.unique(key, return_counts=True)
    row, col, x = key // len(model.terms), key % len(model.terms), n.astype(np.float32)
    fit = [np.bincount(row, x * model.tongues[col, t], len(size)) for t in range(model.tongues.shape[1])]
    return Batch(row, col, x, np.argmax(fit, axis=0), len(size))


def sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by ``at``."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)


def mixtures(row: np.ndarray, col: np.ndarray, x: np.ndarray, h: np.ndarray, allowed: np.ndarray, rounds: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """Documents' mixtures by multiplicative updates for fixed terms ``h``, and the last ratio of count to estimate of every
    entry. Entries are in order of ``row``."""
    h = h.astype(np.float32)
    w = (allowed / h.shape[1]).astype(np.float32)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    seen = row[start]
    if len(seen):
        w[seen] *= np.add.reduceat(x, start)[:, None]
    hc = h[col]
    for last in range(rounds + 1):
        ratio = x / np.maximum(np.einsum("ij,ij->i", w[row], hc), np.float32(1e-12))
        if last < rounds and len(seen):
            w[seen] *= np.add.reduceat(ratio[:, None] * hc, start, axis=0) * allowed[seen]
    return w, ratio


def begin(own: np.ndarray, spoken: np.ndarray) -> np.ndarray:
    """First components of a language: what a subject's labelled documents have more of than the language, and the latter."""
    common = (spoken + 1e-3) / (spoken + 1e-3).sum()
    share = (own + SHRINK * common[:, None]) / (own.sum(0) + SHRINK)
    seeds = share * np.maximum(np.log(share / common[:, None]), 0)
    return np.concatenate([seeds / np.maximum(seeds.sum(0), 1e-12), common[:, None]], 1)


def updated(h: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next components of a language and their masses, from the numerators summed over its documents.

    Of a subject's component only what exceeds the other subjects' mean stays; the rest, which the subjects share, goes to
    the language.
    """
    new = h * top
    mass, n = new.sum(0), h.shape[1] - 1
    share = new[:, :n] / np.maximum(mass[:n], 1e-9)
    own = np.maximum(share - (share.sum(1, keepdims=True) - share) / max(1, n - 1), 0) if n > 1 else share
    rest = new[:, n] + (new[:, :n] * (1 - own / np.maximum(share, 1e-30))).sum(1)
    return np.concatenate([own / np.maximum(own.sum(0), 1e-12), rest[:, None] / max(rest.sum(), 1e-9)], 1), mass


def _per_term(rows: DataFrame, model: Model, width: int, kernel: Callable[[pa.RecordBatch, Model], np.ndarray]) -> np.ndarray:
    """Sums over all documents per frequent term (terms x ``width``): tasks add up their batches, Spark the tasks.

    ``kernel`` maps a batch to a matrix (terms x width). What comes to the driver is bounded by the number of terms.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    terms = len(model.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, width))
        for b in batches:
            if b.num_rows:
                total += kernel(b, shared.value)
        k = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(k), *[pa.array(total[k, j]) for j in range(width)]], ["k", *[f"v{j}" for j in range(width)]])

    part = rows.mapInArrow(run, ", ".join(["k bigint", *[f"v{j} double" for j in range(width)]]))
    got = part.groupBy("k").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)]).toArrow()
    out = np.zeros((terms, width))
    if got.num_rows:
        out[got.column("k").to_numpy()] = np.stack([got.column(f"v{j}").to_numpy() for j in range(width)], 1)
    return out


def trained(full: DataFrame, terms: np.ndarray, n: int, tongues: int) -> Model:
    """The components after ``ROUNDS`` alternating updates over all documents.

    ``full`` has ``words``, ``told`` (numbers of the labelled subjects, or null) and ``claim`` (number of the claimed
    language, -1 for others).
    """
    model = Model(terms, np.zeros((len(terms), 1), np.float32))

    def claimed(b: pa.RecordBatch, model: Model) -> np.ndarray:
        m, claim = matrix(b.column("words"), model), b.column("claim").to_numpy()
        return np.stack([np.bincount(m.col, m.x * (claim == t)[m.row], len(model.terms)) for t in range(tongues)], 1)

    if tongues > 1:
        spoken = _per_term(full, model, tongues, claimed) + 0.1
        model.tongues = np.log(spoken / spoken.sum(0)).astype(np.float32)

    def labels(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        told = b.column("told")
        has = np.asarray(told.is_valid())
        size = np.where(has, np.diff(np.asarray(told.offsets)), 0)
        mine = np.zeros((b.num_rows, n), bool)
        mine[np.repeat(np.arange(len(size)), size), told.flatten().to_numpy()] = True
        return has, mine

    def counts(b: pa.RecordBatch, model: Model) -> np.ndarray:
        m, (has, mine) = matrix(b.column("words"), model), labels(b)
        share, out = mine / np.maximum(mine.sum(1, keepdims=True), 1), []
        for t in range(tongues):
            row, col, x, docs = m.of(t)
            told = has[docs][row]  # few entries have a label
            out += [sums(x[told, None] * share[docs[row[told]]], col[told], len(model.terms)), np.bincount(col, x, len(model.terms))[:, None]]
        return np.concatenate(out, 1)

    def numerators(b: pa.RecordBatch, model: Model) -> np.ndarray:
        m, (has, mine) = matrix(b.column("words"), model), labels(b)
        allowed = np.ones((b.num_rows, n + 1), np.float32)
        allowed[has, :n] = np.where(mine[has], 1.0, SLACK)
        out = []
        for t in range(tongues):
            row, col, x, docs = m.of(t)
            w, ratio = mixtures(row, col, x, model.h[t], allowed[docs])
            out.append(sums(w[row] * ratio[:, None], col, len(model.terms)))
        return np.concatenate(out, 1)

    width = tongues * (n + 1)
    parts = np.split(_per_term(full, model, width, counts), tongues, axis=1)
    model.h, model.mass = np.stack([begin(p[:, :n], p[:, n]) for p in parts]), np.ones((tongues, n + 1))
    for _ in range(ROUNDS):
        tops = np.split(_per_term(full, model, width, numerators), tongues, axis=1)
        model.h, model.mass = (np.stack(v) for v in zip(*[updated(h, top) for h, top in zip(model.h, tops)]))
    return model


def rare_terms(full: DataFrame, model: Model) -> DataFrame:
    """``term, tongue, speaks``: how the terms that are not frequent are shared by the components, from the mixtures of their
    documents: one update from an even share. Terms in fewer than ``MIN_DOCS`` documents of a language are left out."""
    shared, width = full.sparkSession.sparkContext.broadcast(model), model.h.shape[2]
    values = [f"v{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column("words"), model)
            part = np.zeros((m.n, width))
            for t in range(len(model.h)):
                row, col, x, docs = m.of(t)
                w, _ = mixtures(row, col, x, model.h[t], np.ones((len(docs), width), np.float32))
                part[docs] = w / np.maximum(model.mass[t], 1e-9)
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            w, size = flat(b.column("words"))
            new = positions(w, model.terms) < 0
            doc, w = np.repeat(np.arange(m.n), size)[new], w[new]
            order = np.lexsort((doc, w))
            doc, w = doc[order], w[order]
            if not len(w):
                continue
            once = np.r_[True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]
            tongue = m.tongue[doc]
            key, at = np.unique(np.stack([w, tongue], 1), axis=0, return_inverse=True)
            total = sums(part[doc], at, len(key))
            docs = np.bincount(at, once, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(docs), *[pa.array(total[:, j]) for j in range(width)]], ["term", "tongue", "docs", *values])

    part = full.mapInArrow(run, ", ".join(["term bigint", "tongue bigint", "docs bigint", *[f"{v} double" for v in values]]))
    every = part.groupBy("term", "tongue").agg(F.sum("docs").alias("docs"), *[F.sum(v).alias(v) for v in values]).where(F.col("docs") >= MIN_DOCS)
    all_ = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return every.select("term", "tongue", F.array(*[F.col(v) / all_ for v in values[:-1]]).alias("speaks"))


def rare_evidence(full: DataFrame, model: Model) -> DataFrame:
    """``doc_id, at, more``: sentences of a document with rare terms (from 0), and what these add to each subject, one list
    after another."""
    shared, n = full.sparkSession.sparkContext.broadcast(model), model.h.shape[2] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            tongue = matrix(b.column("words"), model).tongue
            w, size = flat(b.column("words"))
            new = np.flatnonzero(positions(w, model.terms) < 0)
            doc = np.repeat(np.arange(len(size)), size)[new]
            sentence = sentence_of(b.column("ends"), size)[0][new]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(sentence), pa.array(w[new]), pa.array(tongue[doc])], ["doc_id", "at", "term", "tongue"])

    seen = full.select("doc_id", "words", "ends").mapInArrow(run, "doc_id bigint, at bigint, term bigint, tongue bigint")
    terms = store(rare_terms(full, model), "rare_terms").df
    hit = seen.join(small(terms, terms.count()), ["term", "tongue"])
    each = hit.groupBy("doc_id", "at").agg(*[F.sum(F.col("speaks")[j]).cast("float").alias(f"s{j}") for j in range(n)])
    both = F.sort_array(F.collect_list(F.struct("at", F.array(*[f"s{j}" for j in range(n)]).alias("s"))))
    return each.groupBy("doc_id").agg(both.alias("x")).select("doc_id", F.transform("x", lambda v: v["at"]).alias("at"), F.flatten(F.transform("x", lambda v: v["s"])).alias("more"))


def sentence_of(ends: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of every term, counted within its document, and the number of sentences of every document."""
    end, n = flat(ends)
    lengths = np.diff(np.r_[0, end])
    first = (np.cumsum(n) - n)[n > 0]
    lengths[first] = end[first]
    return np.repeat(np.arange(len(end)) - np.repeat(np.cumsum(n) - n, n), lengths), n


def decided(b: pa.RecordBatch, model: Model, speaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and subjects of a batch of ``words, ends, at, more``."""
    tongue = matrix(b.column("words"), model).tongue
    w, size = flat(b.column("words"))
    sentence, n = sentence_of(b.column("ends"), size)
    first = np.cumsum(n) - n
    k, doc = positions(w, model.terms), np.repeat(np.arange(len(size)), size)
    ok = k >= 0
    score = sums(speaks[tongue[doc[ok]], k[ok], :-1], first[doc[ok]] + sentence[ok], int(n.sum()))
    at, many = flat(b.column("at"))
    np.add.at(score, np.repeat(first, many) + at, b.column("more").flatten().to_numpy().reshape(len(at), -1) if len(at) else 0)
    if not len(score):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    best = score.argmax(1)
    told = score[np.arange(len(best)), best] >= EVIDENCE
    row = np.repeat(np.arange(len(n)), n)
    about = np.zeros((len(n), score.shape[1]), np.int64)
    np.add.at(about, (row[told], best[told]), 1)
    return np.nonzero((about > 0) & (about >= SENTENCE_SHARE * n[:, None]))


def subjects_of(docs: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, subject``: a row for every subject of every message.

    ``docs`` has ``doc_id, text, lang``; ``labels`` has ``doc_id, subject`` by readers, in any case, doubled or wrong. Null,
    empty and unreadable texts have no subject; without usable labels nothing has, and a subject without labels in a
    language is not found in it. Repeated ``doc_id`` are judged row by row and listed once.
    """
    spark = docs.sparkSession
    named = subjects.select("subject").where("subject IS NOT NULL AND subject <> ''").distinct().limit(MOST_SUBJECTS + 1).collect()
    if len(named) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    names = sorted(r["subject"] for r in named)
    empty = spark.createDataFrame([], "doc_id bigint, subject string")
    if not names:
        return empty
    told = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin([x.lower() for x in names]) & F.col("doc_id").isNotNull()).distinct()
    at = F.array_position(F.array(*[F.lit(x.lower()) for x in names]), F.col("subject")).cast("int") - 1
    told = store(told.groupBy("doc_id").agg(F.sort_array(F.collect_set(at)).alias("told")), "labels")
    few = told.count()
    total = docs.count()
    if not few or not total:
        return empty
    lang = F.lower(F.trim(F.split_part(F.regexp_replace("lang", "_", "-"), F.lit("-"), F.lit(1))))
    common = docs.select(lang.alias("lang")).where("lang <> ''").groupBy("lang").count().where(F.col("count") >= LANGUAGE_SHARE * total)
    tongues = sorted(r["lang"] for r in common.collect())  # at most 1 / LANGUAGE_SHARE
    claim = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in tongues]), lang), F.lit(0)) - 1 if tongues else F.lit(-1)
    read = parsed(docs.withColumn("claim_", claim.cast("int")), "doc_id", "text", "claim_").withColumnRenamed("claim_", "claim")
    read = store(read, "parsed")
    own = cleaned(read.df, *repeated(read.df, total))
    full = store(own.join(small(told.df, few), "doc_id", "left").select("doc_id", "words", "ends", "told", "claim"), "own_words").df
    read.drop()
    # document frequency of every term, counted over all documents
    seen = full.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    seen = store(seen, "term_documents").df
    terms = seen.where(F.col("n") >= FREQUENT * total).orderBy("w").toArrow().column(0).to_numpy()
    if not len(terms):
        return empty
    model = trained(full, terms, len(names), max(1, len(tongues)))
    rows = full.select("doc_id", "words", "ends")
    if seen.where(F.col("n") < FREQUENT * total).limit(1).count():
        more = store(rare_evidence(full, model), "rare").df
        rows = rows.join(small(more, more.count()), "doc_id", "left")
    else:
        rows = rows.withColumns({"at": F.lit(None).cast("array<bigint>"), "more": F.lit(None).cast("array<float>")})
    shared = spark.sparkContext.broadcast((model, model.speaks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, speaks = shared.value
        for b in batches:
            if b.num_rows:
                row, found = decided(b, model, speaks)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array([names[s] for s in found], pa.string())], ["doc_id", "subject"])

    return rows.mapInArrow(run, "doc_id bigint, subject string").distinct()
