"""Ranked lexical search by pair-bound MaxScore.

Terms are maximal runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. Documents are kept in blocks, in three
passes over the corpus, each staged or reduced to a few numbers:

* ``postings``: lengths and term counts of a block's documents for the terms that the queries use; the corpus's document count, token
  count and document frequencies are aggregates over blocks.
* ``impacts``: with them every posting gets its impact (what it adds to a score, but for the term's weight) and every term its highest
  one in the block. For pairs of terms, neighbours in a query by rarity, the intersection list is stored with its highest joint impact.
* ``best_few``, then ``search``: each block scores the few documents that its strongest lists name; the corpus's k-th best of those is a
  threshold from the start. A query's bound in a block takes, along its chain of terms by rarity, the cheapest choice of single maxima
  and pair bounds (a pair adds at most its joint maximum where both terms meet, else the larger single one). A block below the threshold
  is skipped; else lists are left out, weakest first, while their bounds together stay below it; of further pairs, while the larger single
  ones still fit, only the intersection list names documents, of the rest both lists do. The lists left out are looked up only for
  documents that can still reach the threshold.

Results are exact. Queries are taken in groups of about ``GROUP`` terms, so what is sent to tasks is bounded whatever their number.

Null or empty texts have no terms: such documents count nowhere, such queries give no rows. Rows repeating an id are documents (queries)
of their own; null doc_ids come after others on equal scores. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import ship, slices, stage

K = 20
#: Query terms of a group; documents (at most 2^16) and postings that close a block; strongest lists that name the first few documents.
GROUP, DOCS, POSTINGS, STRONGEST = 1 << 17, 1 << 13, 1 << 20, 8
#: Digits, letters and all bytes of characters beyond ASCII are kept; the rest parts terms.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _postings(vocabulary: dict[bytes, int], max_docs: int, max_postings: int):
    def run(batches):
        block, docs, sizes, keys, n, totals = TaskContext.get().partitionId() << 32, [], [], [], 0, [0, 0]

        def row():
            at, times = np.concatenate([k for k, _ in keys]), np.concatenate([t for _, t in keys])
            order = np.argsort(at, kind="stable")
            at, times = at[order], times[order]
            term, doc = at >> 32, at & 0xFFFFFFFF
            used, df = np.unique(term, return_counts=True)
            cols = [pa.array([block], pa.int64()), *(pa.array([x], pa.int64()) for x in totals), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))]
            cols += [pa.array([x], pa.list_(pa.int32())) for x in (used, df)]
            cols += [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (doc, times)]
            return pa.RecordBatch.from_arrays(cols, names=list(POSTING))

        for b in slices(batches, 256):
            found = [terms(t) for t in b.column(1).to_pylist()]
            count = np.array([len(f) for f in found], np.int64)
            code = np.fromiter(map(vocabulary.get, chain.from_iterable(found), repeat(-1)), np.int64, int(count.sum()))
            doc = np.repeat(np.arange(len(found)), count)[code >= 0]
            pairs, times = np.unique(code[code >= 0] << 32 | doc, return_counts=True)
            own = np.zeros(len(found), bool)
            own[doc] = True
            place = np.cumsum(own) - 1 + len(docs)
            keys.append((pairs >> 32 << 32 | place[pairs & 0xFFFFFFFF], times))
            docs += b.column(0).filter(pa.array(own)).to_pylist()
            sizes += count[own].tolist()
            n, totals = n + len(pairs), [totals[0] + int((count > 0).sum()), totals[1] + int(count.sum())]
            if len(docs) >= max_docs or n >= max_postings:
                yield row()
                block, docs, sizes, keys, n, totals = block + 1, [], [], [], 0, [0, 0]
        if keys:
            yield row()

    return run


POSTING = {"block": "bigint", "n_docs": "bigint", "n_terms": "bigint", "docs": "array<bigint>", "sizes": "array<bigint>", "terms": "array<int>", "df": "array<int>", "doc": "binary", "times": "binary"}


def _impacts(n_docs: int, n_terms: int, weights: np.ndarray, pairs: np.ndarray):
    """Blocks of the impact index; ``pairs`` [p, 2] are ascending numbers of terms."""

    def run(batches):
        for b in slices(batches, 1):
            r = b.to_pydict()
            term, df = np.array(r["terms"][0], np.int64), np.array(r["df"][0], np.int64)
            doc, tf = (np.frombuffer(r[c][0], "<u4").astype(np.int64) for c in ("doc", "times"))
            m = 75 + 25 * np.array(r["sizes"][0], np.int64) * n_docs // max(n_terms, 1)
            plain = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])  # at most a million
            impact = np.repeat(weights[term], df) * plain
            cuts = np.concatenate([[0], np.cumsum(df)])
            at = np.full(len(weights), -1)
            at[term] = np.arange(len(term))
            dense = np.full(len(m), -1)
            both, sizes, joint = [], [], []
            here = np.nonzero((at[pairs] >= 0).all(axis=1))[0]
            for p in here.tolist():
                x, y = at[pairs[p]].tolist()
                if cuts[x + 1] - cuts[x] > cuts[y + 1] - cuts[y]:
                    x, y = y, x
                short, long = doc[cuts[x] : cuts[x + 1]], doc[cuts[y] : cuts[y + 1]]
                dense[short] = np.arange(cuts[x], cuts[x + 1])
                meet = np.nonzero(dense[long] >= 0)[0]
                both.append(long[meet])
                joint.append(int((impact[dense[long[meet]]] + impact[cuts[y] + meet]).max(initial=0)))
                sizes.append(len(meet))
                dense[short] = -1
            lists = (term, cuts, [int(impact[x:y].max()) for x, y in zip(cuts, cuts[1:], strict=False)], here, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), joint)
            blobs = [doc.astype("<u2"), plain.astype("<u4"), np.concatenate([*both, doc[:0]]).astype("<u2")]
            cols = [b.column(0), b.column(b.schema.get_field_index("docs")), *(pa.array([x], pa.list_(pa.int64())) for x in lists), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(cols, names=list(IMPACT))

    return run


IMPACT = {"block": "bigint", "docs": "array<bigint>"} | {c: "array<bigint>" for c in ("terms", "cuts", "highest", "pairs", "pair_cuts", "pair_highest")} | {c: "binary" for c in ("doc", "impact", "both")}


class Queries:
    """Queries as chains of terms, rarest first, with how often each occurs; ``chained`` are the numbers of the neighbours' pairs."""

    def __init__(self, texts: list[str | None]):
        self.counts = [{} for _ in texts]
        self.vocabulary: dict[bytes, int] = {}
        for c, t in zip(self.counts, texts, strict=True):
            for w in terms(t):
                v = self.vocabulary.setdefault(w, len(self.vocabulary))
                c[v] = c.get(v, 0) + 1

    def order(self, df: np.ndarray) -> np.ndarray:
        """Chains by document frequency; returns the pairs that neighbours form."""
        self.chains = [np.array(sorted(c, key=lambda v: (df[v], v)), np.int64) for c in self.counts]
        self.often = [np.array([c[v] for v in ch.tolist()], np.int64) for c, ch in zip(self.counts, self.chains, strict=True)]
        numbers: dict[tuple[int, int], int] = {}
        self.chained = [np.array([numbers.setdefault((min(x, y), max(x, y)), len(numbers)) for x, y in zip(ch.tolist(), ch[1:].tolist(), strict=False)], np.int64) for ch in self.chains]
        return np.array(list(numbers), np.int64).reshape(-1, 2)


class Block:
    """One block of the index, with lists found by number of term or pair."""

    def __init__(self, r: dict, weights: np.ndarray, n_pairs: int):
        self.docs, self.weights = r["docs"][0], weights
        self.cuts, self.pair_cuts = np.array(r["cuts"][0]), np.array(r["pair_cuts"][0])
        self.doc, self.both = (np.frombuffer(r[c][0], "<u2") for c in ("doc", "both"))
        self.plain = np.frombuffer(r["impact"][0], "<u4")
        self.at, self.pair_at = np.full(len(weights), -1), np.full(n_pairs, -1)
        self.at[r["terms"][0]] = np.arange(len(r["terms"][0]))
        self.pair_at[r["pairs"][0]] = np.arange(len(r["pairs"][0]))
        self.highest, self.pair_highest = np.array([*r["highest"][0], 0]), np.array([*r["pair_highest"][0], 0])

    def postings(self, term: int):
        k = self.at[term]
        a, z = (self.cuts[k], self.cuts[k + 1]) if k >= 0 else (0, 0)
        return self.doc[a:z], self.plain[a:z] * self.weights[term]

    def meeting(self, pair: int) -> np.ndarray:
        k = self.pair_at[pair]
        return self.both[self.pair_cuts[k] : self.pair_cuts[k + 1]]

    def units(self, terms_: np.ndarray, often: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int, tuple[int, ...]]]:
        """(bound, bound where a pair's terms don't meet, places in the chain) of singles and disjoint neighbours, chosen so that the
        bounds' sum is least; weakest first."""
        single = (self.highest[self.at[terms_]] * often).tolist()
        met = (self.pair_highest[self.pair_at[pairs]]).tolist()
        often, present = often.tolist(), (self.at[terms_] >= 0).tolist()
        best, take = [0], []
        for k, u in enumerate(single):
            bound, how = best[-1] + u, (u, u, (k,) if present[k] else ())
            if k and present[k] and present[k - 1]:
                both = min(often[k - 1 : k + 1])
                pair = both * met[k - 1] + sum((o - both) * s // o for o, s in zip(often[k - 1 : k + 1], single[k - 1 : k + 1], strict=True)) if met[k - 1] else 0
                apart = max(u, single[k - 1])
                pair = max(pair, apart)
                if best[-2] + pair < bound:
                    bound, how = best[-2] + pair, (pair, apart, (k - 1, k))
            best.append(bound)
            take.append(how)
        out, k = [], len(single) - 1
        while k >= 0:
            if take[k][2]:
                out.append(take[k])
            k -= max(len(take[k][2]), 1)
        return sorted(out)

    def exact(self, docs: np.ndarray, terms_: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Scores of some documents, by looking each up in every list."""
        out = np.zeros(len(docs), np.int64)
        for v, o in zip(terms_.tolist(), often.tolist(), strict=True):
            d, imp = self.postings(v)
            if len(d):
                k = np.minimum(np.searchsorted(d, docs), len(d) - 1)
                out += np.where(d[k] == docs, imp[k], 0) * o
        return out


def _top(docs: np.ndarray, scores: np.ndarray, ids: list, k: int) -> list[tuple[int | None, int]]:
    """The k highest scores above 0, equal ones by id with nulls last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        docs, scores = docs[scores >= least], scores[scores >= least]
    rows = sorted(((-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s > 0))[:k]
    return [(None if null else d, -s) for s, null, d in rows]


def few(block: Block, terms_, often, pairs, k: int):
    """Some of the block's best documents with their scores: those that rank first on the strongest lists alone."""
    units = block.units(terms_, often, pairs)[-STRONGEST:]
    part = np.zeros(len(block.docs), np.int64)
    for *_, places in units:
        for p in places:
            d, imp = block.postings(int(terms_[p]))
            part[d] += imp * often[p]
    some = np.nonzero(part)[0]
    if len(some) > k:
        some = some[np.argpartition(part[some], len(some) - k)[-k:]]
    return some, block.exact(some, terms_, often)


def scan(block: Block, terms_, often, pairs, threshold: int, k: int):
    """(documents, scores) of all that can be among the k best at ``threshold``; the rest of the block is skipped. Third: documents
    that were looked at."""
    units = block.units(terms_, often, pairs)
    below = np.cumsum([0] + [u for u, *_ in units]).tolist()  # below[i]: bound of the i weakest units
    if below[-1] < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    weak = sum(x < threshold for x in below[1:])
    apart, score, named = below[weak], np.zeros(len(block.docs), np.int64), np.zeros(len(block.docs), bool)
    for _, single, places in sorted(units[weak:], key=lambda u: u[1]):
        apart += single
        half = len(places) == 2 and apart < threshold
        for p in places:
            d, imp = block.postings(int(terms_[p]))
            score[d] += imp * often[p]
            if not half:
                named[d] = True
        if half:
            named[block.meeting(pairs[places[0]])] = True
    docs = np.nonzero(named)[0]
    score = score[docs]
    looked = len(docs)
    for i in range(weak - 1, -1, -1):
        if len(score) > k:
            threshold = max(threshold, int(np.partition(score, len(score) - k)[len(score) - k]))
        alive = score + below[i + 1] >= threshold
        docs, score = docs[alive], score[alive]
        if not len(docs):
            break
        places = list(units[i][2])
        score = score + block.exact(docs, terms_[places], often[places])
    return docs, score, looked


def _per_block(queries: Queries, weights: np.ndarray, n_pairs: int, thresholds: np.ndarray | None, k: int):
    """Rows (query, doc_id, score): with thresholds the results of each block, without them its first few."""
    chains = list(zip(queries.chains, queries.often, queries.chained, strict=True))

    def run(batches):
        for b in slices(batches, 1):
            block = Block(b.to_pydict(), weights, n_pairs)
            out = []
            for q, chained in enumerate(chains):
                docs, scores = few(block, *chained, k) if thresholds is None else scan(block, *chained, int(thresholds[q]), k)[:2]
                out += [(q, d, s) for d, s in _top(docs, scores, block.docs, k)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; tasks first cut their own rows to k."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _group(docs: DataFrame, ids: list, texts: list, k: int, max_docs: int, max_postings: int) -> DataFrame:
    """Results of one bounded group of queries."""
    spark, q = docs.sparkSession, Queries(texts)
    schema = {c: t for c, t in (("query", "int"), ("doc_id", "bigint"), ("score", "bigint"))}
    ddl = lambda s: ", ".join(f"{c} {t}" for c, t in s.items())
    postings = stage(docs.mapInArrow(_postings(q.vocabulary, min(max_docs, 1 << 16), max_postings), ddl(POSTING)))
    n_docs, n_terms = (x or 0 for x in postings.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = np.zeros(len(q.vocabulary), np.int64)
    counted = postings.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("n"))
    for r in counted.collect():  # at most a row for each term of the group
        df[r.terms] = r.n
    pairs = q.order(df)
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    index = stage(postings.mapInArrow(_impacts(n_docs, n_terms, weights, pairs), ddl(IMPACT)))
    best = _ranked(index.mapInArrow(_per_block(q, weights, len(pairs), None, k), ddl(schema)), k).filter(F.col("rank") == k)
    thresholds = np.ones(len(texts), np.int64)
    for r in best.select("query", "score").collect():  # a row for each query of the group
        thresholds[r.query] = r.score
    found = _ranked(index.mapInArrow(_per_block(q, weights, len(pairs), thresholds, k), ddl(schema)), k)
    named = spark.createDataFrame(list(enumerate(ids)), "query int, item_id bigint")
    return found.join(named, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, group: int = GROUP, max_docs: int = DOCS, max_postings: int = POSTINGS) -> DataFrame:
    """(doc_id, text), (item_id, text) -> item_id, rank, doc_id, score: each item's k best documents."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-total // (4 * group)) or 1  # a term is rarely shorter than three characters and what parts it from the next
    parts = []
    for g in range(groups):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").collect()
        if rows or not parts:
            parts.append(_group(docs, [r.item_id for r in rows], [r.text for r in rows], k, max_docs, max_postings))
    return reduce(DataFrame.unionByName, parts)
