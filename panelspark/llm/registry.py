"""Queries of this folder: one per operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import align, bpe, fingerprints, langid, licenses, lines, lm, minhash, packing, patterns, ranked, tokenfile, vectors
from panelspark.llm.common import table
from panelspark.session import checkpoint_dir

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op6_bpe_round_trip")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_syncmer_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


@query(
    "op8_minhash_near_duplicates",
    f"""
    WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END s FROM words),
    items AS (SELECT doc_id, unnest(s) item FROM sets),
    pairs AS (
        SELECT a.doc_id x, b.doc_id y, count(*) both_n FROM items a JOIN items b ON a.item = b.item AND a.doc_id > b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * both_n >= 80 * (len(p.s) + len(q.s) - both_n)),
    edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
    roots AS (SELECT a, min(b) c FROM reach GROUP BY a)
    SELECT doc_id, CAST(len(s) AS BIGINT) n_shingles, c component_id, doc_id = c AS kept FROM sets JOIN roots ON a = doc_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return langid.predict(docs, langid.train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _license_sql() -> str:
    phrases = ", ".join(
        f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))}), lambda i: {{'at': i - 1, 'label': '{label}'}})"
        for p, label in licenses.PHRASES.items()
    )
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, ts in licenses.TEMPLATES.items() for t in ts)
    half = licenses.BLOCK // 2
    return f"""
    WITH texts AS (SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w FROM documents),
    base AS (SELECT doc_id, len(w) n, flatten([{phrases}]) p FROM texts),
    blocks AS (SELECT doc_id, unnest(list_transform(range(0, CAST(greatest(len(w) - {half} - 1, 0) // {half} + 1 AS BIGINT)), lambda k: w[k * {half} + 1 : k * {half} + {licenses.BLOCK}])) b FROM texts),
    templates(label, t) AS (VALUES {templates}),
    found AS (
        SELECT doc_id, list(DISTINCT label) found, max(len(list_intersect(b, t)) / len(t)) best FROM blocks, templates
        WHERE len(list_intersect(b, t)) >= ceil({licenses.THRESHOLD} * len(t) - 1e-9) GROUP BY doc_id)
    SELECT doc_id, CAST(n AS BIGINT) n_words, CAST(len(p) AS BIGINT) n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) first_word,
        CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) last_word, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') base_labels,
        array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(found, [])))), ',') labels,
        CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE score
    FROM base LEFT JOIN found USING (doc_id)"""


@query("op3_license_notices", _license_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op2_hilbert_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


LINES_SQL = f"""
    WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) a FROM documents),
    numbered AS (SELECT doc_id, unnest(a) line, unnest(range(len(a))) i FROM texts),
    worded AS (SELECT doc_id, i, line, list_filter(string_split_regex({ASCII_LOWER.replace("coalesce(text, '')", "line")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM numbered),
    placed AS (SELECT doc_id, i, line, w, array_to_string(w, ' ') k, doc_id::HUGEINT * 4294967296 + i o FROM worded),
    firsts AS (SELECT k, any_value(w) w, min(o) o FROM placed WHERE len(w) > 0 GROUP BY k),
    lengthy AS (SELECT * FROM firsts WHERE len(w) >= 10),
    less AS (SELECT k, o, p, array_to_string(w[1 : p] || w[p + 2 :], ' ') v, len(w) n FROM (SELECT k, w, o, unnest(range(len(w))) p FROM lengthy)),
    early AS (SELECT v, p, n, min(o) o FROM less GROUP BY ALL),
    near AS (
        SELECT l.k FROM less l JOIN early e ON l.v = e.v AND l.p = e.p AND l.n = e.n WHERE l.o > e.o
        UNION SELECT s.k FROM lengthy s JOIN less l ON l.v = s.k WHERE s.o > l.o
        UNION SELECT l.k FROM lengthy s JOIN less l ON l.v = s.k WHERE l.o > s.o),
    kept AS (
        SELECT doc_id, i, line, len(p.w) > 0 AND (p.o > f.o OR p.k IN (FROM near)) gone FROM placed p LEFT JOIN firsts f ON p.k = f.k)
    SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '')) kept_sha256
    FROM kept GROUP BY doc_id"""


@query("op1_line_dedupe", LINES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedupe(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


VECTORS_SQL = """
    WITH RECURSIVE ok AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id x, b.vec_id y FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
    roots AS (SELECT a, min(b) c FROM reach GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0) n_links, c component_id, e.vec_id = c AS kept
    FROM embeddings e JOIN roots ON a = e.vec_id LEFT JOIN (SELECT x, count(*) n FROM links GROUP BY x) ON x = e.vec_id"""


@query("op9_embedding_near_duplicates", VECTORS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_pitman_yor_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = lm.score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_pattern_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))[0]


def _terms_sql(text: str) -> str:
    return f"list_filter(string_split_regex({ASCII_LOWER.replace('text', text)}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


RANKED_SQL = f"""
    WITH words AS (SELECT doc_id, unnest({_terms_sql('text')}) t FROM documents),
    sizes AS (SELECT doc_id, count(*) n FROM words GROUP BY doc_id),
    whole AS (SELECT count(*) docs, CAST(sum(n) AS BIGINT) terms FROM sizes),
    tfs AS (SELECT doc_id, t, count(*) tf FROM words GROUP BY doc_id, t),
    dfs AS (SELECT t, count(*) df FROM tfs GROUP BY t),
    asked AS (SELECT item_id, unnest({_terms_sql('text')}) t FROM benchmark),
    scores AS (
        SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
            * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) score
        FROM asked JOIN tfs USING (t) JOIN dfs USING (t) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) rank FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""


@query("op13_pair_bound_search", RANKED_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
