"""The queries of the llm operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, epsgrid, filter_audit, license, ngram_join, packing, scratch, sentencepiece_viterbi, spelling, substring, topk, toxicity, warc, winnow

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A conversation whose texts are control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and the probe, read back from the formatted ids."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), F.lit(PROBE).alias("text"))
    path = tokenizer_path("byte_bpe_50k.json")
    return chat.digest_turns(chat.format_turns(turns.union(probe), path), path)


ORACLES["op1_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown AS (
  SELECT *, regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS safe,
    replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<|', '<\|') AS safe_role FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe_role) + length(safe) + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license notices in every document."""
    return license.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "blocks")


def _op4_oracle() -> str:
    word = license.WORD
    a_z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    places = " || ".join(
        f"list_transform(list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {j + 1}] = '{p}'" for j, p in enumerate(phrase.split()))}), lambda i: {{'at': i, 'label': '{label}'}})" for phrase, label in license.PHRASES.items()
    )
    shares = ", ".join(f"{{'label': '{label}', 'share': len(list_intersect({listed(ws)}, b)) / {float(len(ws))}}}" for label, ws in license._vocabulary(license.TEMPLATES).items())
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), {a_z}) AS t FROM documents),
ws AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM low),
base AS (SELECT doc_id, t, len(w) AS n, {places} AS p FROM ws),
blocks AS (SELECT doc_id, n, p, list_filter(flatten(list_transform(list_transform(string_split(t, chr(10)), lambda x: list_distinct(regexp_extract_all(x, '{word}'))), lambda b: [{shares}])), lambda x: x.share >= 0.8 - 1e-9) AS f FROM base)
SELECT doc_id, n AS n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label) || list_transform(f, lambda x: x.label))), ',') AS labels,
  CAST(CASE WHEN len(p) > 0 THEN 1 ELSE coalesce(list_max(list_transform(f, lambda x: x.share)), 0) END AS DOUBLE) AS score
FROM blocks
"""


ORACLES["op4_license_scan"] = _op4_oracle()


@query
def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back from them by range."""
    made = warc.write_files(warc.with_revisits(table(spark, sf_dir, "pages")), scratch.folder(spark, "packages"))
    return warc.read_files(scratch.keep(made, "listed"), payloads=False).drop("url", "payload")


ORACLES["op2_warc_packages"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth vector with all others."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


ORACLES["op6_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(len(q.e)), lambda i: q.e[i + 1] * c.e[i + 1])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that start elsewhere, too."""
    return substring.drop_repeats(table(spark, sf_dir, "documents"), digest=True)


ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS s FROM d),
h AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 35], ' ') AS t FROM p),
r AS (SELECT doc_id, s, count(*) OVER (PARTITION BY t) AS n FROM h),
g AS (SELECT DISTINCT doc_id, s + o AS i FROM (SELECT doc_id, s FROM r WHERE n > 1), range(35) q(o)),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END AS kept FROM d LEFT JOIN x ON x.doc_id = d.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under links of 5-word Jaccard similarity 0.75 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and class at cosine 0.95 or more."""
    return epsgrid.near_components(table(spark, sf_dir, "embeddings"))


ORACLES["op3_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.95),
p AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.a = node
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model fitted outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the digest of the text read back from them."""
    return sentencepiece_viterbi.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of up to 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


@query
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in 10-word windows of the benchmark, and the items that they come from."""
    found = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.hi - x.lo)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLES["op11_benchmark_decontamination"] = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, list_filter(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda s: array_to_string(w[s + 1 : s + 10], ' '))) AS t FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, n, w, unnest(range(greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM i)),
h AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t FROM p),
x AS MATERIALIZED (SELECT h.doc_id, h.n, s, i.item_id FROM h JOIN i ON i.t = h.t AND i.n = h.n),
c AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM x, range(10) q(o) WHERE o < n GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM x WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language's documents in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, FALSE) AS INTEGER) AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
k AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, CAST(coalesce(list_sum(bits[1 : i - 1]), 0) AS INTEGER) AS earlier FROM o, range(1, 6) z(i)),
e AS (SELECT part, filter_order, step, own,
  CAST(sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM e
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with the spelling that it is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE steps AS (SELECT 0 AS k, i AS v, i AS i FROM range(256) q(i) UNION ALL SELECT k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS c FROM steps WHERE k = 8),
r AS MATERIALIZED (SELECT doc_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS u FROM documents) WHERE length(u) >= 6 GROUP BY ALL),
y AS (SELECT u, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || u, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END)) AS b FROM r),
h AS (SELECT u, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM y, crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN u[1 : h % length(u)] || u[h % length(u) + 2 :] ELSE u END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.i = b.i AND a.less = b.less AND a.word < b.word UNION SELECT g.word, v.word FROM g JOIN v ON v.word = g.less),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
f AS MATERIALIZED (SELECT v.word, v.n, count(*) AS n_near, list({'f': z.word, 'm': z.n} ORDER BY z.n DESC, z.word)[1] AS t FROM v JOIN e ON e.a = v.word JOIN v z ON z.word = e.b GROUP BY v.word, v.n),
s AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN t.m >= 5 * v.n THEN t.f END AS form, CASE WHEN t.m >= 5 * v.n THEN t.m END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
w AS (SELECT word, word AS node, 0 AS k FROM s UNION ALL SELECT w.word, s.form, k + 1 FROM w JOIN s ON s.word = w.node WHERE s.form IS NOT NULL)
SELECT s.word, form, root, n, n_near, form_n FROM s JOIN (SELECT word, arg_max(node, k) AS root FROM w GROUP BY word) z ON z.word = s.word
"""
