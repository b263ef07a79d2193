"""Queries of corpus building: kernels over logits, prompts, contexts, grouped joins, misses and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, text
from ..functions import scores as S
from ..operators import control, conversations, routing, sampling, selection, units
from ..sources import corpora
from .catalog import query
from .roles import role

# Logits of a student and a teacher: a vector and the next one.
LOGITS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM @vectors),
j AS (SELECT a.vec_id, b.e AS s, a.e AS t FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"""


def _logs_sql(c: str, temperature: int = 1) -> str:
    x = f"list_transform({c}, lambda x: x / {temperature}.0)"
    return f"list_transform({x}, lambda x: x - list_max({x}) - ln(list_sum(list_transform({x}, lambda y: exp(y - list_max({x}))))))"


def _logits(spark, d):
    v = role(spark, d, "vectors").select("vec_id", F.col("embedding").cast("array<double>").alias("t"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("s")), "vec_id")


def _loss(column):
    return F.round(column, 8).alias("loss")


LOGS = f"{LOGITS}, l AS (SELECT *, {_logs_sql('s')} AS q, {_logs_sql('t')} AS p FROM j)"


@query(f"""{LOGS}, d AS (SELECT vec_id, s, q, list_transform(range(len(s)), lambda i: s[i + 1] - t[i + 1]) AS d FROM l),
m AS (SELECT *, list_sum(list_transform(range(len(s)), lambda i: exp(q[i + 1]) * d[i + 1])) AS m FROM d)
SELECT vec_id, round(list_sum(list_transform(range(len(s)), lambda i: (d[i + 1] - m) * exp(q[i + 1]) * s[i + 1])), 8) AS loss FROM m""")
def score_difference(spark, d):
    return _logits(spark, d).select("vec_id", _loss(S.contrastive_sd(F.col("s"), F.col("t"))))


# The assistant for alpha = 0.5, lam = 0.5 in logarithms that do not yet sum to 1.
_MEAN = "list_transform(range(len(p)), lambda i: 4 * ln(0.5 * exp(0.25 * p[i + 1]) + 0.5 * exp(0.25 * q[i + 1])))"


@query(f"""{LOGS}, u AS (SELECT vec_id, p, q, {_MEAN} AS u FROM l), r AS (SELECT vec_id, p, q, {_logs_sql('u')} AS r FROM u)
SELECT vec_id, round(list_sum(list_transform(range(len(p)), lambda i: exp(p[i + 1]) * (p[i + 1] - r[i + 1]))), 8) AS loss FROM r""")
def assistant_forward_kl(spark, d):
    return _logits(spark, d).select("vec_id", S.logs(F.col("t")).alias("p"), S.logs(F.col("s")).alias("q")).select("vec_id", _loss(S.assistant_divergence(F.col("p"), F.col("q"))))


@query(f"""{LOGS}, u AS (SELECT vec_id, p, q, list_transform(range(len(p)), lambda i: 0.3 * p[i + 1] + 0.7 * q[i + 1]) AS u FROM l), r AS (SELECT vec_id, q, {_logs_sql('u')} AS r FROM u)
SELECT vec_id, round(list_sum(list_transform(range(len(q)), lambda i: (0.2 * exp(0.9 * r[i + 1]) + 0.7 * exp(0.9 * q[i + 1])) / 0.9 - exp(0.2 * r[i + 1] + 0.7 * q[i + 1]))) / (0.2 * 0.7), 8) AS loss FROM r""")
def assistant_alpha_beta(spark, d):
    logs = _logits(spark, d).select("vec_id", S.logs(F.col("t")).alias("p"), S.logs(F.col("s")).alias("q"))
    return logs.select("vec_id", _loss(S.assistant_divergence(F.col("p"), F.col("q"), "ab", "rq", alpha=1.0, lam=0.3)))


@query(f"""{LOGS}, x AS (SELECT vec_id, p, q, CAST(vec_id % len(p) AS INTEGER) + 1 AS a, CAST((vec_id * 7) % len(p) AS INTEGER) + 1 AS b FROM l),
k AS (SELECT *, (p[a] - q[a]) * exp(q[a]) AS ka, (p[b] - q[b]) * exp(q[b]) AS kb FROM x)
SELECT vec_id, round(-q[a] * (ka + CASE WHEN ka > 0 THEN exp(p[a]) ELSE 0 END + CASE WHEN ka > 0 AND kb < 0 THEN exp(p[a]) ELSE 0 END) - CASE WHEN kb < 0 AND a <> b THEN kb ELSE 0 END * q[b], 8) AS loss FROM k""")
def hybrid_policy_loss(spark, d):
    """The expert's and the drawn token are columns."""
    logs = _logits(spark, d).select("vec_id", S.logs(F.col("t")).alias("p"), S.logs(F.col("s")).alias("q"))
    at = lambda k: ((F.col("vec_id") * k) % F.size("p")).cast("int")
    return logs.select("vec_id", _loss(S.hybrid_policy(F.col("p"), F.col("q"), at(1), at(7))))


@query(f"""{LOGITS}, l AS (SELECT vec_id, {_logs_sql('s', 2)} AS q, {_logs_sql('t', 2)} AS p FROM j)
SELECT vec_id, round(list_sum(list_transform(range(len(p)), lambda i: exp(p[i + 1]) * (p[i + 1] - q[i + 1]))), 8) AS loss FROM l""")
def soft_label_loss(spark, d):
    return _logits(spark, d).select("vec_id", _loss(S.soft_labels(F.col("s"), F.col("t"))))


@query(f"""{LOGS}, n AS (SELECT a.vec_id, list_transform(range(len(a.p)), lambda i: b.q[i + 1] - a.q[i + 1]) AS ds, list_transform(range(len(a.p)), lambda i: b.p[i + 1] - a.p[i + 1]) AS dt FROM l a JOIN l b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(1 - list_inner_product(ds, dt) / (greatest(sqrt(list_inner_product(ds, ds)), 1e-5) * greatest(sqrt(list_inner_product(dt, dt)), 1e-5)), 8) AS loss FROM n""")
def layer_step_loss(spark, d):
    """How differently two models' log-chances change from one layer to the next; rows stand for layers."""
    x = _logits(spark, d)
    after = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    return x.join(after, "vec_id").select("vec_id", _loss(S.step_loss(F.col("s"), F.col("s2"), F.col("t"), F.col("t2"))))


@query(f"""{LOGS}, x AS (SELECT vec_id, q, CASE WHEN vec_id % 3 = 0 THEN -100 ELSE CAST(vec_id % len(q) AS INTEGER) END AS y FROM l)
SELECT vec_id % 10 AS batch, round(avg(CASE WHEN y >= 0 THEN -q[y + 1] END), 8) AS loss, count(CASE WHEN y >= 0 THEN 1 END) AS tokens FROM x GROUP BY 1""")
def causal_lm_loss(spark, d):
    """Mean over the labelled tokens of each batch."""
    x = _logits(spark, d).withColumn("y", F.when(F.col("vec_id") % 3 == 0, -100).otherwise((F.col("vec_id") % F.size("s")).cast("int")))
    x = x.select((F.col("vec_id") % 10).alias("batch"), S.cross_entropy(F.col("s"), F.col("y")).alias("l"))
    return x.groupBy("batch").agg(F.round(F.avg("l"), 8).alias("loss"), F.count("l").alias("tokens"))


@query("""WITH r AS (SELECT a.label AS s, r.type, b.label AS t, a.schema_id FROM @relations r JOIN @nodes a ON a.node_id = r.source JOIN @nodes b ON b.node_id = r.target AND b.schema_id = a.schema_id),
n AS (SELECT schema_id, string_agg(concat('- (:', label, ')'), chr(10) ORDER BY label) AS t FROM @nodes GROUP BY schema_id),
e AS (SELECT schema_id, string_agg(concat('- (:', s, ')-[:', type, ' { since: DATE }]->(:', t, ')'), chr(10) ORDER BY s, type, t) AS t FROM r GROUP BY schema_id)
SELECT schema_id, concat('Nodes:', chr(10), n.t, chr(10), 'Relationships:', chr(10), e.t) AS rendered FROM n JOIN e USING (schema_id)""")
def rendered_schemas(spark, d):
    """Whole schemas as text: the nations of a region and the relations between them."""
    nodes, rel = _regions(spark, d)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    n = nodes.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("label", F.lit(1).alias("one")))).alias("n"))
    r = rel.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("source", "type", "target"))).alias("r"))
    both = n.join(r, "schema_id").select(
        "schema_id", F.transform("n", lambda x: F.struct(x.label.alias("label"), none.alias("properties"))).alias("n"),
        F.transform("r", lambda x: F.struct(x.source.alias("source"), x.type.alias("type"), x.target.alias("target"), F.create_map(F.lit("since"), F.lit("DATE")).alias("properties"))).alias("r"),
    )
    return both.select("schema_id", prompts.render_schema(F.col("n"), F.col("r")).alias("rendered"))


def _regions(spark, d):
    """Nodes (schema_id, label, node_id) and relations (schema_id, source, type, target) of one schema for each region."""
    nodes = role(spark, d, "nodes").select("schema_id", "label", "node_id")
    side = lambda c: nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"), F.col("schema_id").alias(f"{c}_schema"))
    rel = role(spark, d, "relations").join(side("source"), "source").join(side("target"), "target").where("source_schema = target_schema")
    return nodes, rel.select(F.col("source_schema").alias("schema_id"), F.col("source_label").alias("source"), "type", F.col("target_label").alias("target"))


_PROPERTIES = "['name', concat('p', CAST(node_id % 3 AS STRING)), concat('q', CAST(node_id % 2 AS STRING))]"


@query(f"""WITH n AS (SELECT schema_id, label, {_PROPERTIES} AS p FROM @nodes),
r AS (SELECT a.schema_id, a.label AS s, r.type, b.label AS t, concat('(:', a.label, ')-[:', r.type, ']->(:', b.label, ')') AS line FROM @relations r JOIN @nodes a ON a.node_id = r.source JOIN @nodes b ON b.node_id = r.target AND b.schema_id = a.schema_id),
f AS (SELECT a.schema_id, concat_ws('|', a.s, a.type, a.t) AS id, 0 AS k, b.line AS x FROM r a JOIN r b ON a.schema_id = b.schema_id AND a.line <> b.line AND least(a.s, a.t) = least(b.s, b.t) AND greatest(a.s, a.t) = greatest(b.s, b.t)
  UNION SELECT a.schema_id, concat_ws('|', a.s, a.type, a.t), 1, b.line FROM r a JOIN r b ON a.schema_id = b.schema_id AND a.line <> b.line AND a.type = b.type
  UNION SELECT n.schema_id, n.label, 2, b.line FROM n JOIN r b ON n.schema_id = b.schema_id AND n.label IN (b.s, b.t)
  UNION SELECT n.schema_id, n.label, 3, concat('(:', o.label, ')') FROM n JOIN n o ON n.schema_id = o.schema_id AND n.label <> o.label AND len(list_intersect(n.p, o.p)) >= 2 AND len(list_intersect(n.p, o.p)) / len(list_distinct(n.p || o.p)) >= 0.5),
g AS (SELECT schema_id, id, k, string_agg(concat('- ', x), chr(10) ORDER BY x) AS t FROM f GROUP BY ALL),
u AS (SELECT schema_id, label AS id, 2 AS k FROM n UNION ALL SELECT schema_id, concat_ws('|', s, type, t), 0 FROM r),
h AS (SELECT 0 AS k, '{prompts.SAME_ENDS}' AS h UNION ALL SELECT 1, '{prompts.SAME_TYPE}' UNION ALL SELECT 2, '{prompts.CONNECTED}' UNION ALL SELECT 3, '{prompts.SIMILAR}')
SELECT u.schema_id, u.id, string_agg(concat(h.h, chr(10), coalesce(g.t, '- none')), chr(10) ORDER BY h.k) AS context
FROM u JOIN h ON h.k IN (u.k, u.k + 1) LEFT JOIN g ON g.schema_id = u.schema_id AND g.id = u.id AND g.k = h.k GROUP BY u.schema_id, u.id""")
def unit_contexts(spark, d):
    """What each node and relation of a schema could be mistaken for."""
    nodes, rel = _regions(spark, d)
    name = lambda p, m: F.concat(F.lit(p), (F.col("node_id") % m).cast("string"))
    null = F.lit(None).cast("string")
    made = nodes.select("schema_id", F.col("label").alias("id"), F.lit("node").alias("kind"), "label", null.alias("source"), null.alias("type"), null.alias("target"), F.array(F.lit("name"), name("p", 3), name("q", 2)).alias("properties"))
    edges = rel.select("schema_id", F.concat_ws("|", "source", "type", "target").alias("id"), F.lit("relation").alias("kind"), null.alias("label"), "source", "type", "target", F.lit(None).cast("array<string>").alias("properties"))
    return prompts.contexts(made.unionByName(edges))


@query("""SELECT conv_id, concat('<|begin|>', string_agg(concat('<|start_header_id|>', role, '<|end_header_id|>', chr(10), chr(10), text, '<|eot_id|>'), '' ORDER BY turn), '<|start_header_id|>assistant<|end_header_id|>', chr(10), chr(10)) AS rendered
FROM @turns WHERE role IN ('system', 'user', 'assistant') AND text IS NOT NULL GROUP BY conv_id""")
def llama_markup(spark, d):
    rows = conversations.gather(role(spark, d, "turns").where("role in ('system', 'user', 'assistant') and text is not null"))
    return rows.select("conv_id", prompts.render_chat(F.col("messages"), "llama3", "<|begin|>").alias("rendered"))


@query("""SELECT example_id, coalesce(question, '') AS question, concat('{"name": "', graph, '"}') AS schema, cypher FROM @examples""")
def prompt_records(spark, d):
    """Question, schema and query taken apart from one prompt and its response."""
    e = role(spark, d, "examples")
    prompt = F.concat(F.lit(corpora.QUESTION), F.coalesce("question", F.lit("")), F.lit(corpora.SCHEMA), F.lit('{"name": "'), "graph", F.lit('"}'), F.lit(corpora.TASK), F.lit(" for it."))
    made = e.select("example_id", corpora.prompt_record(prompt, F.to_json(F.struct("cypher"))).alias("p"))
    return made.select("example_id", "p.question", "p.schema", "p.cypher")


@query("""WITH r AS (SELECT example_id, id, row_number() OVER (ORDER BY pos) - 1 AS i FROM @selection),
p AS (SELECT id, predicted, row_number() OVER (ORDER BY pos) - 1 AS i FROM @selection)
SELECT r.example_id, count(*) AS units, min(r.i) AS first, count(*) FILTER (predicted = 'YES') AS chosen, max(r.i) - min(r.i) + 1 = count(*) AS contiguous, bool_and(r.id = p.id) AS agrees
FROM r JOIN p USING (i) GROUP BY r.example_id""")
def grouped_pairs(spark, d):
    """Row k of the units with row k of the predictions, grouped by question, which must be contiguous."""
    rows = role(spark, d, "selection")
    mine = sampling.number(rows.select("example_id", "id", "pos"), ["pos"])
    other = sampling.number(rows.select(F.col("id").alias("other"), "predicted", "pos"), ["pos"])
    per = selection.grouped_pairs(mine, other, "example_id", "id", "other", [F.count_if(F.col("predicted") == "YES").alias("chosen")])
    return per.select("example_id", "units", "first", "chosen", "contiguous", "agrees")


@query("""WITH u AS (SELECT DISTINCT schema_id, unit_id FROM @selection)
SELECT e.example_id, e.schema_id, count(u.unit_id) AS units, count(u.unit_id) = 0 AS missing FROM @examples e LEFT JOIN u ON u.schema_id = e.schema_id GROUP BY e.example_id, e.schema_id""")
def prompt_units(spark, d):
    """Questions with the units of their schema; those whose schema is unknown are marked."""
    known = role(spark, d, "selection").groupBy("schema_id").agg(F.collect_set("unit_id").alias("units"))
    rows = role(spark, d, "examples").select("example_id", "schema_id").join(known, "schema_id", "left")
    return rows.select("example_id", "schema_id", F.coalesce(F.size("units"), F.lit(0)).cast("long").alias("units"), F.col("units").isNull().alias("missing"))


@query("""WITH u AS (SELECT schema_id, unit_id, min(unit_type) AS unit_type FROM @selection GROUP BY ALL)
SELECT s.id, s.unit_id, CASE WHEN u.unit_id IS NULL THEN 'unknown' WHEN s.unit_type IS DISTINCT FROM u.unit_type THEN 'differs' ELSE 'equal' END AS state
FROM @selection s LEFT JOIN u ON u.schema_id = s.schema_id AND u.unit_id = s.unit_id AND u.unit_id % 17 <> 0 WHERE s.label = 1""")
def gold_units(spark, d):
    """Gold ids looked up among the schema's units, and whether they are the same unit there."""
    rows = role(spark, d, "selection")
    known = rows.groupBy("schema_id", "unit_id").agg(F.min("unit_type").alias("unit_type")).where("unit_id % 17 <> 0")
    return selection.looked_up(rows.where("label = 1"), known, ["schema_id", "unit_id"], ["unit_type"]).select("id", "unit_id", "state")


@query("""WITH s AS (SELECT example_id, schema_id, list_sort(list(DISTINCT unit_id) FILTER (unit_type = 'node')) AS n, list_sort(list(DISTINCT unit_id) FILTER (unit_type = 'relation')) AS r FROM @selection GROUP BY ALL)
SELECT example_id, schema_id, coalesce(array_to_string(list_filter(n, lambda x: x % 3 = 0), ','), '') AS nodes, coalesce(array_to_string(list_filter(r, lambda x: x % 2 = 0), ','), '') AS relations FROM s""")
def subset_units(spark, d):
    """Of each schema in hand only the wanted nodes and relations."""
    held = lambda kind: F.array_sort(F.collect_set(F.when(F.col("unit_type") == kind, F.col("unit_id"))))
    rows = role(spark, d, "selection").groupBy("example_id", "schema_id").agg(held("node").alias("n"), held("relation").alias("r"))
    every = lambda m: F.transform(F.sequence(F.lit(0), F.lit(59 // m)), lambda x: (x * m).cast("long"))
    return rows.select("example_id", "schema_id", F.array_join(units.subset(F.col("n"), every(3)), ",").alias("nodes"), F.array_join(units.subset(F.col("r"), every(2)), ",").alias("relations"))


# Units of a question: nodes n0 to n59, and relations between them.
_UNITS = "SELECT example_id, concat('n', unit_id) AS unit, 'node' AS kind, label, NULL AS source, NULL AS target FROM @selection WHERE unit_type = 'node' UNION ALL SELECT example_id, concat('r', unit_id), 'relation', label, concat('n', unit_id), concat('n', unit_id * 3 % 60) FROM @selection WHERE unit_type = 'relation'"


@query(f"""WITH u AS (SELECT example_id, unit, kind, max(label) AS label, min(source) AS source, min(target) AS target FROM ({_UNITS}) GROUP BY example_id, unit, kind),
d AS (SELECT *, md5(concat_ws('|', '11', CAST(example_id AS STRING), unit)) AS d FROM u),
e AS (SELECT example_id, unit, unnest([source, target]) AS node FROM d WHERE kind = 'relation'),
free AS (SELECT * FROM d WHERE kind = 'node' AND label = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.example_id = d.example_id AND e.node = d.unit)),
has AS (SELECT example_id FROM d WHERE kind = 'relation' AND label = 1 GROUP BY example_id),
c AS (SELECT example_id, unit, d FROM d WHERE kind = 'relation' AND label = 1 UNION ALL SELECT example_id, unit, d FROM free WHERE example_id NOT IN (SELECT example_id FROM has)),
p AS (SELECT example_id, arg_min(unit, (d, unit)) AS unit FROM c GROUP BY example_id),
r AS (SELECT example_id, unit FROM p UNION SELECT p.example_id, e.node FROM p JOIN e ON e.example_id = p.example_id AND e.unit = p.unit
  WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.example_id = p.example_id AND o.node = e.node AND o.unit <> p.unit)),
k AS (SELECT u.example_id FROM u LEFT JOIN r ON r.example_id = u.example_id AND r.unit = u.unit GROUP BY u.example_id HAVING count(*) > count(r.unit)),
h AS (SELECT example_id FROM k WHERE ('0x' || substring(md5(concat_ws('|', '11', CAST(example_id AS STRING))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < 0.3)
SELECT r.example_id, r.unit FROM r JOIN h USING (example_id) JOIN u ON u.example_id = r.example_id AND u.unit = r.unit""")
def missed_units(spark, d):
    """Gold units that a selector is made to miss, with the ends that nothing else needs."""
    rows, null = role(spark, d, "selection"), F.lit(None).cast("string")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    u = F.col("unit_id")
    nodes = rows.where("unit_type = 'node'").select("example_id", name("n", u).alias("unit"), F.lit("node").alias("kind"), "label", null.alias("source"), null.alias("target"))
    rel = rows.where("unit_type = 'relation'").select("example_id", name("r", u).alias("unit"), F.lit("relation").alias("kind"), "label", name("n", u).alias("source"), name("n", u * 3 % 60).alias("target"))
    return units.missed(nodes.unionByName(rel), "example_id", 0.3, 11)


@query("""WITH u AS (SELECT example_id, n_units, ('0x' || substring(md5(concat_ws('|', '21', CAST(example_id AS STRING))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM @examples)
SELECT example_id, CASE WHEN u < 0.4 OR n_units < 3 THEN 'gold' WHEN u < 0.45 THEN 'full' ELSE 'noisy' END AS mode FROM u""")
def augmentation_modes(spark, d):
    rows = role(spark, d, "examples").withColumn("spare", F.col("n_units") >= 3)
    return units.augmentation_mode(rows, "example_id", "spare", 0.4, 0.05, 21).select("example_id", "mode")


@query("""WITH c AS (SELECT label, unit_type, count(*) AS n FROM @selection WHERE schema_id <> 4 GROUP BY ALL)
SELECT label, unit_type, n, n / sum(n) OVER (PARTITION BY label) AS share FROM c""")
def pooled_priors(spark, d):
    """Counts of several benchmarks, checked against their manifests and pooled by rows."""
    rows = role(spark, d, "selection").where("schema_id <> 4")
    counts = rows.groupBy(F.col("schema_id").alias("source"), "label", "unit_type").agg(F.count("*").alias("n"))
    manifest = rows.groupBy(F.col("schema_id").alias("source")).agg(F.count("*").alias("rows"))
    return selection.pooled_priors(counts, manifest)


@query("SELECT id, CASE WHEN failed THEN NULL ELSE CAST(metric AS DOUBLE) END AS value, CASE WHEN failed THEN 'query failed' END AS error, CASE WHEN failed THEN 0.0 ELSE 1.0 END::DOUBLE AS executable FROM @scores")
def captured_metrics(spark, d):
    """A metric's value or its error, and whether the query ran."""
    rows = role(spark, d, "scores")
    got = routing.captured(F.col("metric"), F.col("failed"), F.lit("query failed"))
    return rows.select("id", got.alias("m"), routing.executable(F.col("failed")).alias("executable")).select("id", "m.value", "m.error", "executable")


@query("SELECT doc_id, sha256(concat(substring(coalesce(text, ''), 1, 256), CASE WHEN length(coalesce(text, '')) > 256 THEN right(text, 256) ELSE '' END)) AS digest FROM documents")
def sampled_digests(spark, d):
    """A digest of the head and the tail of long texts."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.sampled_digest(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("SELECT example_id, CASE WHEN cypher = '' THEN 0 ELSE 14 END AS tokens FROM @examples")
def prompt_tokens(spark, d):
    """Length in tokens of the lexer."""
    from ..functions.cypher import tokens_udf

    return role(spark, d, "examples").select("example_id", F.size(tokens_udf("cypher")).alias("tokens"))


@query("""WITH v AS (SELECT vec_id, list_transform(range(len(embedding)), lambda i: CASE WHEN (i + vec_id) % 3 = 0 THEN -100 ELSE i END) AS y, list_transform(range(len(embedding)), lambda i: i < len(embedding) - vec_id % 5) AS a FROM @vectors)
SELECT vec_id, len(list_filter(range(len(y) - 1), lambda i: a[i + 1] AND y[i + 2] <> -100)) AS response, len(list_filter(a, lambda x: x)) - 1 AS hidden FROM v""")
def causal_masks(spark, d):
    """Positions whose next token is labelled, and valid positions but the last."""
    n, k = F.size("embedding"), F.col("vec_id")
    i = F.sequence(F.lit(0), n - 1)
    v = role(spark, d, "vectors").select("vec_id", F.transform(i, lambda x: F.when((x + k) % 3 == 0, -100).otherwise(x)).alias("y"), F.transform(i, lambda x: x < n - k % 5).alias("a"))
    held = lambda m: F.size(F.filter(m, lambda x: x)).cast("long")
    return v.select("vec_id", held(S.response_mask(F.col("y"), F.col("a"))).alias("response"), held(S.hidden_mask(F.col("a"))).alias("hidden"))


@query("""SELECT event_id, round(0.6 * CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN least(greatest(value / 50, 0), 1) ELSE 1 - least(greatest(value / 50, 0), 1) END, 9) AS share FROM @events_by_user""")
def fresh_shares(spark, d):
    e, progress = role(spark, d, "events_by_user"), F.col("value") / 50
    schedule = F.when(F.col("event_type") == "view", "constant").when(F.col("event_type") == "click", "increasing").otherwise("decreasing")
    return e.select("event_id", F.round(S.fresh_share(F.lit(0.6), progress, schedule), 9).alias("share"))


@query("""WITH v AS (SELECT user_id, list(CAST(floor(value) AS DOUBLE) ORDER BY event_id) AS l FROM @events_by_user GROUP BY user_id),
s AS (SELECT user_id, list_reduce(list_transform(l, lambda x: {'t': x, 'b': x}), lambda acc, x: CASE WHEN x.t >= acc.b + 1 THEN {'t': least(1.0, acc.t + 0.1), 'b': x.t} ELSE acc END, {'t': 0.2::DOUBLE, 'b': 0.0::DOUBLE}) AS s FROM v)
SELECT user_id, round(s.t, 9) AS threshold, s.b AS baseline FROM s""")
def replay_thresholds(spark, d):
    """The threshold after each user's losses in order: it rises where a loss passes the last one that did."""
    per = role(spark, d, "events_by_user").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.floor("value").cast("double").alias("loss")))).alias("l"))
    state = S.replay_threshold(F.transform("l", lambda x: x.loss), 0.2, 1.0)
    return per.select("user_id", state.alias("s")).select("user_id", F.round("s.threshold", 9).alias("threshold"), "s.baseline")


@query("""SELECT pos, task, CASE WHEN coalesce(text, '') = '' OR trim(coalesce(task, '')) = '' THEN 0 ELSE 3 END AS messages FROM @prompts""")
def chat_rows(spark, d):
    """Prepared rows as three messages; rows that lack a field have none."""
    rows = role(spark, d, "prompts")
    made = conversations.chat_row(F.lit("system"), F.col("text"), F.col("task"))
    whole = conversations.complete(["text", "task"])
    return rows.select("pos", "task", F.when(whole, F.size(made)).otherwise(0).alias("messages"))


@query("""WITH t AS (SELECT 'x' AS k, text FROM @turns), f AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'tool' ELSE role END AS role FROM @turns)
SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM f GROUP BY conv_id""")
def tool_roles(spark, d):
    """Function results and observations as tool messages."""
    given = role(spark, d, "turns").withColumn("role", F.when(F.col("turn") % 6 == 0, "function").when(F.col("turn") % 6 == 3, "observation").otherwise(F.col("role")))
    rows = conversations.gather(given)
    return rows.select("conv_id", F.array_join(F.transform(conversations.tool_roles(F.col("messages")), lambda m: m.role), " ").alias("roles"))


@query()
def contrast_chain(spark, d):
    """Contrast pairs of each schema, exchanged so that negatives compete with their positives."""
    from ..operators.samplers import contrast_sample, paired_rows

    rows = role(spark, d, "selection").withColumn("graph", F.concat(F.lit("g"), "schema_id"))
    pairs = contrast_sample(rows, "graph", "example_id", "unit_id", "label", 40, 42)
    return paired_rows(pairs, rows, "graph", "example_id", "unit_id", "label", "unit_type", 42)


@query()
def threshold_report(spark, d):
    """The sweep as the lines of a table."""
    from .catalog import THRESHOLDS, metrics

    swept = metrics.threshold_sweep(role(spark, d, "selection"), THRESHOLDS).orderBy("threshold").collect()
    lines = control.report([r.asDict() for r in swept]).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")
