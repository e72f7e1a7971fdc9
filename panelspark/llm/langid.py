"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

A word (letters only, lower-cased, with a mark at its start, cut after ``LONGEST`` characters) can be split into vocabulary pieces in
many ways; its probability in a language is the sum over all of them of the product of piece probabilities, by the forward algorithm.
A single character that the vocabulary lacks counts as one unknown piece. Piece probabilities are fitted by expectation maximisation
(forward-backward) on the words of all training documents: each distinct word of a language is one row with its count and its lattice,
every round sums the expected counts in tasks, and only a number for each piece and language comes to the driver. Expected counts are
summed as integers (2^-16 of an occurrence), so the model does not depend on how rows are dealt. A text's score is the softmax over
languages of its log-probability divided by the square root of its number of words.

Texts that are null or have no letter get ``und`` and score 0, and so does every text where nothing could be learnt (no training rows).
Rows with a null id are scored and never learnt from. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import held, ship, slices, stage

VOCABULARY = "piece_bpe_32k.model"
ROUNDS, LONGEST, WIDEST = 4, 24, 10
LOW = 0.05
#: Expected count that each piece has beforehand, at least this share of the language's pieces, so that no word's probability vanishes.
PRIOR, LEAST_SHARE = 0.01, 1e-8
#: A task hands on the words it has counted when it holds so many.
COUNTED = 1 << 18
_UNIT = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters (lower-cased; the word mark may come first) -> number; 0 is the unknown character."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    keep = sorted(p for p in pieces if len(p) <= WIDEST and (p == "▁" or p.removeprefix("▁").isalpha()))
    return {p: i + 1 for i, p in enumerate(keep)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


class Finder:
    """Numbers of the vocabulary's pieces among all substrings of many words at once; substrings are told apart by 64-bit hashes."""

    _BASE, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)

    def __init__(self, vocab: dict[str, int]):
        hashes = np.zeros(len(vocab), np.uint64)
        by_width: dict[int, list] = {}
        for i, p in enumerate(vocab):
            by_width.setdefault(len(p), []).append((i, p))
        for width, group in by_width.items():
            h = np.zeros((len(group), 1), np.uint64)
            codes = self.codes([p for _, p in group], width)
            for k in range(width):
                h = self.longer(h, codes[:, k : k + 1])
            hashes[[i for i, _ in group]] = h[:, 0]
        order = np.argsort(hashes)
        self.keys, self.numbers = hashes[order], np.fromiter(vocab.values(), np.int32, len(vocab))[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.slot(self.keys)] = True

    @staticmethod
    def codes(words: list[str], size: int) -> np.ndarray:
        return np.array(words, f"U{max(size, 1)}").view(np.uint32).reshape(len(words), -1)[:, :size].astype(np.uint64) + np.uint64(1)

    def longer(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (h ^ codes) * self._BASE

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h ^ (h << np.uint64(23))) >> self._BITS

    def numbers_of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.size, -1, np.int32)
        flat = h.ravel()
        may = np.flatnonzero(self.seen[self.slot(flat)])
        at = np.minimum(np.searchsorted(self.keys, flat[may]), len(self.keys) - 1)
        hit = self.keys[at] == flat[may]
        out[may[hit]] = self.numbers[at[hit]]
        return out.reshape(h.shape)


def lattice(words: list[str], vocab: dict[str, int] | Finder) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers [word, start, width - 1] (-1: no such piece), and lengths."""
    finder = vocab if isinstance(vocab, Finder) else Finder(vocab)
    marked = ["▁" + w[:LONGEST] for w in words]
    n = np.array([len(m) for m in marked], np.int64)
    longest = int(n.max(initial=0))
    out = np.full((len(marked), longest, WIDEST), -1, np.int32)
    codes = finder.codes(marked, longest)
    h = np.zeros((len(marked), longest), np.uint64)
    for w in range(1, min(WIDEST, longest) + 1):
        h = finder.longer(h[:, : longest - w + 1], codes[:, w - 1 :])
        found = finder.numbers_of(h)
        found[np.arange(w, longest + 1) > n[:, None]] = -1
        out[:, : longest - w + 1, w - 1] = found
    inside = np.arange(longest) < n[:, None]
    out[:, :, 0][inside & (out[:, :, 0] < 0)] = 0
    return out, n


def forward(pieces: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Sums over segmentations up to each position, [word, position, language]. prob has a row of zeros at its end, for -1."""
    words, size, _ = pieces.shape
    a = np.zeros((words, size + 1, prob.shape[1]))
    a[:, 0] = 1
    for s in range(size):
        for w in range(min(WIDEST, size - s)):
            a[:, s + w + 1] += a[:, s] * prob[pieces[:, s, w]]
    return a


def word_scores(words: list[str], vocab: dict[str, int] | Finder, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; words longer than LONGEST are the sum of their cuts."""
    cuts = [[w[k : k + LONGEST] for k in range(0, len(w), LONGEST)] for w in words]
    flat = [c for cs in cuts for c in cs]
    owner = np.repeat(np.arange(len(words)), [len(c) for c in cuts])
    out = np.zeros((len(words), prob.shape[1]))
    sizes = np.array([len(c) for c in flat])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            pieces, _ = lattice([flat[i] for i in part], vocab)
            np.add.at(out, owner[part], np.log(forward(pieces, prob)[:, -1]))
    return out


def expected(pieces: np.ndarray, lang: np.ndarray, count: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece, [language, piece] flattened, in integer units of 1 / _UNIT, for words of one length.
    prob [language, piece] has a zero at the end of each language, for -1."""
    words, n, _ = pieces.shape
    size = prob.shape[1]
    at = pieces % size + (lang * size)[:, None, None]
    q = prob.ravel().take(at)
    a, b = np.zeros((words, n + 1)), np.zeros((words, n + 1))
    a[:, 0] = b[:, n] = 1
    for s in range(n):
        w = min(WIDEST, n - s)
        a[:, s + 1 : s + 1 + w] += a[:, s, None] * q[:, s, :w]
    for s in range(n - 1, -1, -1):
        w = min(WIDEST, n - s)
        b[:, s] = (q[:, s, :w] * b[:, s + 1 : s + 1 + w]).sum(axis=1)
        q[:, s, :w] *= a[:, s, None] * b[:, s + 1 : s + 1 + w]
    q *= (count / a[:, n])[:, None, None]
    return np.bincount(at.ravel(), np.rint(q * _UNIT).ravel(), prob.size)


class _Scores:
    """Scores of the words met so far by this worker, for one model; emptied when full."""

    LIMIT = 1 << 20

    def __init__(self, vocab, prob):
        self.vocab, self.prob, self.rows, self.at = vocab, prob, np.zeros((4096, prob.shape[1])), {}

    def of(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*docs).difference(self.at)) if docs else []
        if len(self.at) + len(new) > self.LIMIT:
            self.at, new = {}, list(set().union(*docs))
        if new:
            first = len(self.at)
            while len(self.rows) < first + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = word_scores(new, self.vocab, self.prob)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
        get = self.at.__getitem__
        return [self.rows[np.fromiter(map(get, d), np.int64, len(d))].sum(axis=0) if d else np.zeros(self.rows.shape[1]) for d in docs]


def _predict(name: str, model, path: str, keep: list[str], text: int, fit: bool):
    def run(batches):
        scores, langs = held(name, lambda: (_Scores(Finder(vocabulary(path)), model.value[1]), model.value[0]))
        for b in slices(batches, 256):
            docs = [words_of(t) for t in b.column(text).to_pylist()]
            pred, best, fits, sizes = [], [], [], []
            for d, s in zip(docs, scores.of(docs), strict=True):
                sizes.append(len(d))
                fits.append(float(s.max()) / sum(map(len, d)) if langs and d else None)
                if not langs or not has_letter(d):
                    pred.append("und")
                    best.append(0.0)
                    continue
                z = np.exp((s - s.max()) / np.sqrt(len(d)))
                pred.append(langs[int(s.argmax())])
                best.append(float(z.max() / z.sum()))
            more = [pa.array(fits, pa.float64()), pa.array(sizes, pa.int64())] if fit else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(best, pa.float64()), *more], names=[*keep, "lang_pred", "score", *["fit", "n_words"][: len(more)]])

    return run


def _counted(batches):
    counts: dict[str, Counter] = {}

    def rows():
        for lang, c in counts.items():
            for w in [w for w in c if len(w) > LONGEST]:
                n = c.pop(w)
                for k in range(0, len(w), LONGEST):
                    c[w[k : k + LONGEST]] += n
            for b in slices([pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["w", "n"])], 8192):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * b.num_rows, pa.string()), *b.columns], names=["lang", "w", "n"])
        counts.clear()

    for b in slices(batches, 256):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) >= COUNTED:
            yield from rows()
    yield from rows()


def _lattices(path: str):
    def run(batches):
        finder = held(("finder", path), lambda: Finder(vocabulary(path)))
        for b in batches:
            words = b.column(1).to_pylist()
            lengths = np.array([len(w) for w in words], np.int64)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                pieces, sizes = lattice([words[i] for i in at], finder)
                raw = [p.tobytes() for p in pieces.astype("<i4")]
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], names=["lang", "n", "size", "pieces"])

    return run


def _expected(model):
    def run(batches):
        langs, prob = model.value
        number, got = {x: j for j, x in enumerate(langs)}, np.zeros(prob.size)
        for b in batches:
            lang = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            count, sizes = b.column(1).to_numpy(), b.column(2).to_numpy()
            raw = b.column(3).to_pylist()
            for n in np.unique(sizes).tolist():
                all_of = np.flatnonzero(sizes == n)
                for k in range(0, len(all_of), 4096):
                    at = all_of[k : k + 4096]
                    pieces = np.frombuffer(b"".join([raw[i] for i in at]), "<i4").reshape(len(at), n, WIDEST)
                    got += expected(pieces, lang[at], count[at], prob)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(got[at].astype(np.int64))], names=["piece", "uses"])

    return run


def train(docs: DataFrame, learn, vocab_path: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Fit on all rows of (doc_id, text, lang) where ``learn`` holds: languages, and piece probabilities [piece, language] with a row of
    zeros last."""
    spark = docs.sparkSession
    ship(spark)
    path = vocab_path or public_tokenizers.path(VOCABULARY)
    rows = docs.filter(learn).filter("lang is not null and doc_id is not null").select("lang", "text")
    words = rows.mapInArrow(_counted, "lang string, w string, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    words = stage(words.mapInArrow(_lattices(path), "lang string, n bigint, size int, pieces binary").sortWithinPartitions("size"))
    langs, size = sorted(r.lang for r in words.select("lang").distinct().collect()), len(vocabulary(path)) + 1
    prob = np.full((len(langs), size + 1), 1 / size)
    prob[:, size] = 0
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast((langs, prob))
        sums = words.mapInArrow(_expected(sent), "piece bigint, uses bigint").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        got = np.zeros(prob.size)
        got[sums.column("piece").to_numpy()] = sums.column("uses").to_numpy()
        got = got.reshape(prob.shape)[:, :size] / _UNIT
        total = got.sum(axis=1, keepdims=True)
        prior = np.maximum(PRIOR, LEAST_SHARE * total)
        prob[:, :size] = (got + prior) / (total + prior * size)
        sent.destroy()
    return langs, prob.T.copy()


def low_fits(scored: DataFrame) -> dict[str, float]:
    """Language -> the ``LOW`` quantile of ``fit`` (see ``predict``) over all given rows, fits taken to three decimals and counted."""
    fits = scored.filter("lang_pred <> 'und'").groupBy("lang_pred", F.round("fit", 3).alias("fit")).agg(F.count("*").alias("n"))
    return {r.lang_pred: r.low for r in fits.groupBy("lang_pred").agg(F.percentile("fit", F.lit(LOW), F.col("n")).alias("low")).collect()}  # a row for each language


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab_path: str | None = None, keep: tuple[str, ...] = ("doc_id",), fit: bool = False) -> DataFrame:
    """The columns ``keep`` with lang_pred and score; the text alone decides. ``fit`` adds the columns fit, the mean log-probability a
    letter in the best language (null without a letter or a language), and n_words."""
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    text = keep.index("text") if "text" in keep else len(keep)
    given = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)])
    sent = spark.sparkContext.broadcast(model)  # vocabulary size times number of languages
    return given.mapInArrow(_predict(uuid.uuid4().hex, sent, vocab_path or public_tokenizers.path(VOCABULARY), keep, text, fit), f"{fields}, lang_pred string, score double" + (", fit double, n_words bigint" if fit else ""))
