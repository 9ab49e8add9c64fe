"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import ann, bpe, chat, fim, langid, line_dedup, minhash, mixing, phrases, secret_scan, segment, simhash, toxicity
from rankweave.llm.common import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with SQL where SQL can express it."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def remainder(divisor: int):
    """crc32 of the id as text, modulo ``divisor``: the fixed folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
r AS (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 0))) AS pos FROM l),
w AS (SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM w
      WHERE regexp_matches(a || b || c, '[^ \\t\\r]')),
x AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS line FROM f WHERE nth > 1),
m AS (SELECT doc_id, list(line) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
           [lines[i + 1] FOR i IN range(0, len(lines)) IF NOT list_contains(gone, i)], chr(10)), '') END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM documents d JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without lines of repeated three-line windows."""
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query()
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector, among all."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query("""
WITH t AS (SELECT conv_id, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, ''))
                                ORDER BY turn, role, text) AS c FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, c, list_max([i FOR i IN range(1, len(c) + 1) IF c[i].role = 'assistant']) AS last FROM t),
b AS (SELECT conv_id, c, c[last].text AS reply FROM l WHERE last IS NOT NULL),
s AS (SELECT l.conv_id, l.c, CASE WHEN l.last IS NULL OR b.conv_id IS NULL THEN l.c ELSE
        [struct_pack(role := l.c[i].role, text := CASE WHEN i = l.last THEN b.reply ELSE l.c[i].text END)
         FOR i IN range(1, len(l.c) + 1)] END AS r
      FROM l LEFT JOIN b ON b.conv_id = xor(l.conv_id, 1)),
n AS (SELECT *, coalesce(list_min([i - 1 FOR i IN range(1, len(c) + 1) IF c[i] <> r[i]]), len(c)) AS n FROM s),
m AS (SELECT conv_id, n,
        array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN c[1:n]], '') AS prompt,
        c[n + 1:] AS c, r[n + 1:] AS r FROM n),
o AS (SELECT *,
        [CAST(length(prompt) + coalesce(list_sum([length(y.role) + length(y.text) + 13 FOR y IN c[1:i - 1]]), 0) + length(c[i].role) + 5 AS BIGINT)
         FOR i IN range(1, len(c) + 1)] AS cs,
        [CAST(length(prompt) + coalesce(list_sum([length(y.role) + length(y.text) + 13 FOR y IN r[1:i - 1]]), 0) + length(r[i].role) + 5 AS BIGINT)
         FOR i IN range(1, len(r) + 1)] AS rs FROM m),
p AS (SELECT conv_id, n, prompt,
        coalesce(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN c], ''), '') AS chosen,
        coalesce(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN r], ''), '') AS rejected,
        coalesce(array_to_string([cs[i] || ':' || (cs[i] + length(c[i].text)) FOR i IN range(1, len(c) + 1) IF c[i].role = 'assistant'], ','), '') AS chosen_mask,
        coalesce(array_to_string([rs[i] || ':' || (rs[i] + length(r[i].text)) FOR i IN range(1, len(r) + 1) IF r[i].role = 'assistant'], ','), '') AS rejected_mask
      FROM o)
SELECT conv_id AS pair_id, CAST(n AS BIGINT) AS n_common, coalesce(prompt, '') AS prompt, chosen, rejected, chosen_mask, rejected_mask,
       chosen <> rejected AND chosen_mask <> '' AND rejected_mask <> '' AS usable
FROM p
""")
def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with its partner's last reply, as prompt and masked completions."""
    chosen, rejected = chat.swapped_replies(table(spark, folder, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(c)
    return chat.preference(chosen, rejected).select(
        "pair_id", "n_common", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"), "usable")


@query()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the ids, and the threshold of its language."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    known = table(spark, folder, "labels").select("doc_id", "toxic").filter(remainder(5) != 0)
    model = toxicity.train(docs, known)
    scored = materialise(toxicity.apply(docs, model).select(
        "doc_id", "lang", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"))
    # Language decides the extra flag alone, never the score.
    limits = toxicity.thresholds(scored.filter("NOT held_out").join(known, "doc_id"), "lang", "toxic")
    limits = materialise(limits.withColumnRenamed("lang", "_lang"))
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("threshold", F.lit(0.5))
    return joined.select("doc_id", "held_out", "score", "predicted", limit.alias("threshold"), (F.col("score") >= limit).cast("int").alias("flagged"))


@query()
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    found, _ = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of the ids."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    parser = langid.train(docs.filter(remainder(4) != 2))
    return langid.identify(docs.select("doc_id", "text"), parser).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query()
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Slot of every document in the mixture, once per epoch."""
    return mixing.schedule(table(spark, folder, "documents").select("doc_id", "source"))


@query()
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and its edited text, how alike they are, and near-duplicate classes."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return minhash.compare_with_next(docs, minhash.near_duplicates(docs))


@query()
def op10_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    """Best segmentation of every text, with scores and digests of the N best."""
    return segment.segment(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
             CAST('0x' || h[17:24] AS BIGINT) % 100 AS share, CAST('0x' || h[25:32] AS BIGINT) % 100 AS kind FROM t),
p AS (SELECT *, CASE WHEN text = '' OR share >= 90 OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN kind < 20 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(array_to_string(u[1:least(c1, c2)], ''), '') AS pre, coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS mid,
             coalesce(array_to_string(u[greatest(c1, c2) + 1:], ''), '') AS suf FROM g),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
             ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
""")
def op11_fim(spark: SparkSession, folder: str) -> DataFrame:
    """Every text cut in three and rearranged, with digests of the output and of the text rebuilt from it."""
    made = fim.restore(fim.transform(table(spark, folder, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, (SELECT unnest(range(1, 5)) AS k)),
f AS (SELECT lang, g, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, g),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
x AS (SELECT lang, g[i:i + j - 1] AS g, max(a) AS longest FROM (SELECT c.*, unnest(range(2, k)) AS j FROM c), (SELECT unnest(range(1, 4)) AS i)
      WHERE i + j - 1 <= k GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN x USING (lang, g) WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a),
s AS (SELECT d.lang, d.g, d.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * d.a) // (l.a + r.a) AS score
      FROM (SELECT d.*, unnest(range(1, k)) AS j FROM d) d JOIN f l ON l.lang = d.lang AND l.g = d.g[1:j] JOIN f r ON r.lang = d.lang AND r.g = d.g[j + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b JOIN t USING (lang) QUALIFY rank <= 2000
""")
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language."""
    return phrases.collocations(table(spark, folder, "documents").select("lang", "text"))


@query()
def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded to ids and decoded again."""
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"))
    return bpe.decode(encoded).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"),
                                      F.sha2("decoded", 256).alias("decoded_sha256"))
