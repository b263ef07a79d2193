"""Queries over the driver's tables and their equivalent SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import metrics, profile, routing, sampling, units, windows
from .roles import role, with_roles

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with SQL over roles that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_roles(sql)
        return f

    return add


THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.9]


@query("""
WITH g AS (SELECT s.*, t.threshold FROM @selection s, (SELECT unnest([0.1::DOUBLE, 0.3, 0.5, 0.7, 0.9]) AS threshold) t),
q AS (SELECT threshold, example_id, count(*) FILTER (p_yes >= threshold AND label = 1) AS tp, count(*) FILTER (p_yes >= threshold AND label = 0) AS fp,
  count(*) FILTER (p_yes < threshold AND label = 1) AS fn FROM g GROUP BY ALL),
t AS (SELECT threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS questions, count(*) FILTER (fn > 0) AS missing, count(*) FILTER (fp = 0 AND fn = 0) AS exact FROM q GROUP BY threshold)
SELECT threshold, questions, 100 * (CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS precision, 100 * (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) AS recall,
  100 * (CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS f1, fp / questions AS extra_per_question, 100 * missing / questions AS missing_pct, 100 * exact / questions AS exact_pct
FROM t""")
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(role(spark, d, "selection"), THRESHOLDS)


CONFUSION = """count(*) FILTER (label = 1 AND predicted = 'YES') AS tp, count(*) FILTER (label = 0 AND predicted = 'YES') AS fp, count(*) FILTER (label = 1 AND predicted <> 'YES') AS fn,
  count(*) FILTER (label = 0 AND predicted = 'NO') AS tn, count(*) FILTER (predicted = 'INVALID') AS invalid, count(*) AS n"""
PRF = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n END AS accuracy"""


@query(f"WITH c AS (SELECT unit_type, {CONFUSION} FROM @selection GROUP BY unit_type) SELECT *, {PRF} FROM c")
def confusion_matrix(spark, d):
    return metrics.confusion(role(spark, d, "selection"), ["unit_type"])


@query(f"""
WITH c AS (SELECT {CONFUSION} FROM @selection), m AS (SELECT *, {PRF} FROM c),
s AS (SELECT count(DISTINCT example_id) AS labelled, (SELECT count(DISTINCT example_id) FROM @examples) AS examples FROM @selection)
SELECT labelled, examples, precision * (labelled / examples) AS precision, recall * (labelled / examples) AS recall, f1 * (labelled / examples) AS f1 FROM m, s""")
def confusion_coverage(spark, d):
    rows = role(spark, d, "selection")
    return metrics.coverage_adjusted(metrics.confusion(rows, []), rows, role(spark, d, "examples"), ["precision", "recall", "f1"])


@query("""
SELECT coalesce(graph, 'overall') AS graph, count(*) AS n_rows, count(CASE WHEN failed THEN 0 ELSE metric END) AS n_scored, avg(CASE WHEN failed THEN 0 ELSE metric END) AS mean
FROM @scores GROUP BY GROUPING SETS ((graph), ())""")
def per_graph_rollup(spark, d):
    return metrics.rollup_scores(role(spark, d, "scores"))


@query("""
WITH m AS (SELECT graph, seed, avg(metric) AS m, count(metric) AS k FROM @scores GROUP BY graph, seed)
SELECT graph, round(avg(m), 9) AS mean, CAST(sum(k) AS BIGINT) AS n FROM m GROUP BY graph""")
def mean_of_means(spark, d):
    return metrics.mean_of_means(role(spark, d, "scores"), ["seed"], ["graph"], "metric").withColumn("mean", F.round("mean", 9))


@query("""
WITH w AS (SELECT unit_type, schema_id, count(*) AS weight FROM @selection GROUP BY ALL),
e AS (SELECT *, 1000 * weight / sum(weight) OVER (PARTITION BY unit_type) AS exact FROM w),
b AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_type ORDER BY exact - base DESC, schema_id) AS rn, 1000 - sum(base) OVER (PARTITION BY unit_type) AS rest FROM b)
SELECT unit_type, schema_id, weight, base + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS quota FROM r""")
def largest_remainder_quota(spark, d):
    w = role(spark, d, "selection").groupBy("unit_type", "schema_id").agg(F.count("*").alias("weight"))
    return sampling.largest_remainder(w, "unit_type", "schema_id", "weight", 1000)


@query("""
WITH p AS (SELECT *, sum(label) OVER (PARTITION BY example_id) AS n_pos, row_number() OVER (PARTITION BY example_id, label ORDER BY md5(concat_ws('|', '42', CAST(example_id AS STRING), id)), id) AS rk FROM @selection)
SELECT id, example_id, label FROM p WHERE label = 1 OR rk <= round_even(n_pos * 1.5, 0)""")
def negative_sampling(spark, d):
    return sampling.sample_negatives(role(spark, d, "selection").select("id", "example_id", "label"), "example_id", "id", "label", 1.5, 42)


@query("SELECT example_id, arg_min(id, pos) AS id, min(pos) AS pos FROM @selection GROUP BY example_id")
def first_per_key(spark, d):
    return sampling.first_per_key(role(spark, d, "selection").select("example_id", "pos", "id"), ["example_id"], ["pos"])


@query("""
WITH f AS (SELECT schema_id, unit_id, count(*) AS n FROM @selection GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY schema_id ORDER BY n, unit_id) AS rank FROM f""")
def frequency_rank(spark, d):
    n = role(spark, d, "selection").groupBy("schema_id", "unit_id").agg(F.count("*").alias("n"))
    w = sampling.W.partitionBy("schema_id").orderBy("n", "unit_id")
    return n.withColumn("rank", F.row_number().over(w).cast("long"))


@query("""
WITH n AS (SELECT unit_id, count(*) AS n FROM @selection GROUP BY unit_id),
r AS (SELECT s.example_id, s.unit_id, n.n, row_number() OVER (PARTITION BY example_id ORDER BY n, md5(concat_ws('|', '7', s.id)), s.id) AS rk FROM @selection s JOIN n USING (unit_id))
SELECT example_id, unit_id, n FROM r WHERE rk = 1""")
def rarest_unit_choice(spark, d):
    rows = role(spark, d, "selection")
    n = rows.groupBy("unit_id").agg(F.count("*").alias("n"))
    scored = rows.join(n, "unit_id").withColumn("d", sampling.draw(7, "id")).select("example_id", "n", "d", "id", "unit_id")
    return sampling.first_per_key(scored, ["example_id"], ["n", "d", "id"]).select("example_id", "unit_id", "n")


@query("""
WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM @events_by_user),
r AS (SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM n GROUP BY user_id, event_type, g)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS run, event_type, first, last, n FROM r""")
def run_detection(spark, d):
    return windows.runs(role(spark, d, "events_by_user"), ["user_id"], "event_id", "event_type")


@query("""
WITH p AS (SELECT user_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g, event_id FROM @events_by_user WHERE event_id % 7 <> 0)
SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM p GROUP BY user_id, g""")
def gaps_islands(spark, d):
    return windows.islands(role(spark, d, "events_by_user").where("event_id % 7 <> 0"), "user_id", "event_id")


@query("""
SELECT id, CAST(floor((row_number() OVER (PARTITION BY schema_id ORDER BY pos) - 1) / 64) AS BIGINT) AS batch, (row_number() OVER (PARTITION BY schema_id ORDER BY pos) - 1) % 64 AS slot FROM @selection""")
def fixed_batches(spark, d):
    return sampling.batches(role(spark, d, "selection"), "schema_id", ["pos"], 64).select("id", "batch", "slot")


@query("""
SELECT pos, task, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY task ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM @prompts""")
def cumulative_offsets(spark, d):
    return windows.offsets(role(spark, d, "prompts"), "task", ["pos"], "n_tokens").select("pos", "task", "offset")


@query("SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM @events_by_user")
def causal_shift(spark, d):
    return windows.shifted(role(spark, d, "events_by_user"), "user_id", ["event_id"], "event_type").select("event_id", "user_id", "event_type", "target")


@query("""
WITH o AS (SELECT conv_id, role, row_number() OVER w AS rn, lag(role) OVER w AS last_role FROM @turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN role IN ('user', 'tool') THEN 0 WHEN role = 'assistant' THEN 1 END AS side, CASE WHEN last_role IN ('user', 'tool') THEN 0 WHEN last_role = 'assistant' THEN 1 END AS last_side FROM o),
p AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'system' AND rn > 1) AS late_system,
  count(*) FILTER (role <> 'system' AND CASE WHEN last_role IS NULL OR last_role = 'system' THEN side <> 0 ELSE side = last_side END) AS not_alternating, count(*) FILTER (role <> 'system') AS spoken FROM s GROUP BY conv_id)
SELECT conv_id, turns, late_system, not_alternating, late_system = 0 AND not_alternating = 0 AND spoken % 2 = 0 AND spoken > 0 AS well_formed FROM p""")
def chat_turn_order(spark, d):
    return windows.turn_problems(role(spark, d, "turns"))


@query("SELECT example_id, source, split, rn FROM (SELECT *, row_number() OVER (PARTITION BY source, split ORDER BY pos) AS rn FROM @examples) WHERE rn <= 100")
def max_examples(spark, d):
    rows = sampling.limit_per_group(role(spark, d, "examples"), ["source", "split"], ["pos"], 100)
    return rows.select("example_id", "source", "split", F.col("rn").cast("long").alias("rn"))


@query("SELECT * FROM (SELECT example_id, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM @selection GROUP BY example_id) WHERE n_pos > 0 AND n_neg > 0")
def contrast_eligible(spark, d):
    return sampling.contrast_eligible(role(spark, d, "selection"), "example_id", "label")


@query("""
WITH n AS (SELECT unit_id, label, count(*) AS n FROM @selection GROUP BY ALL),
r AS (SELECT s.example_id, s.id, s.label, row_number() OVER (PARTITION BY example_id, label ORDER BY n, md5(concat_ws('|', '42', s.id)), s.id) AS rk FROM @selection s JOIN n USING (unit_id, label))
SELECT p.example_id, p.id AS positive, q.id AS negative FROM r p JOIN r q USING (example_id) WHERE p.label = 1 AND p.rk = 1 AND q.label = 0 AND q.rk = 1""")
def contrast_pairs(spark, d):
    rows = role(spark, d, "selection")
    n = rows.groupBy("unit_id", "label").agg(F.count("*").alias("n"))
    return sampling.contrast_pairs(rows.join(n, ["unit_id", "label"]), "example_id", "id", "label", [F.col("n"), sampling.draw(42, "id").alias("d")])


@query("""
WITH r AS (SELECT id, example_id, label, md5(concat_ws('|', '5', id)) AS d, row_number() OVER (PARTITION BY example_id, label ORDER BY md5(concat_ws('|', '5', id)), id) AS rk FROM @selection),
n AS (SELECT * FROM r WHERE rk = 1 AND label = 0 ORDER BY d, id LIMIT 250),
p AS (SELECT * FROM r WHERE rk = 1 AND label = 1 AND example_id NOT IN (SELECT example_id FROM n) ORDER BY d, id LIMIT 250)
SELECT id, example_id, label FROM n UNION ALL SELECT id, example_id, label FROM p""")
def balanced_eval_sample(spark, d):
    return sampling.balanced_sample(role(spark, d, "selection"), "example_id", "id", "label", 500, 5)


@query("""
WITH s AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS i FROM @selection WHERE unit_type = 'node'),
g AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS i FROM @selection WHERE unit_type = 'relation'),
n AS (SELECT least((SELECT count(*) FROM s), (SELECT count(*) FROM g)) AS n),
b AS (SELECT id, 1 AS task, CAST(floor(i / 4) AS BIGINT) * 8 + 4 + i % 4 AS k FROM s, n WHERE i < n UNION ALL SELECT id, 0, CAST(floor(i / 4) AS BIGINT) * 8 + i % 4 FROM g, n WHERE i < n)
SELECT id, task, row_number() OVER (ORDER BY k) - 1 AS position FROM b""")
def interleave_task_batches(spark, d):
    rows = role(spark, d, "selection").select("id", "pos", "unit_type")
    s, g = (sampling.number(rows.where(F.col("unit_type") == t).select("id", "pos"), ["pos"]) for t in ("node", "relation"))
    n = min(s.count(), g.count())
    return sampling.interleave(s.where(F.col("i") < n), g.where(F.col("i") < n), "id", 8)


def _interleaved(spark, d, selectors: int):
    """All rows, those of one label as selectors and those of the other as generators."""
    rows = role(spark, d, "selection").select("id", "pos", "label")
    s, g = (sampling.number(rows.where(F.col("label") == x).select("id", "pos"), ["pos"]) for x in (selectors, 1 - selectors))
    return sampling.interleave_all(s, g, "id", 8, s.count(), g.count())


def _numbered_sql(selectors: int) -> str:
    one = "SELECT id, row_number() OVER (ORDER BY pos) - 1 AS i FROM @selection WHERE label = "
    return f"s AS ({one}{selectors}), g AS ({one}{1 - selectors})"


@query(f"""
WITH {_numbered_sql(0)},
m AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM g) AS ng, CAST(floor((SELECT count(*) FROM g) / 4) AS BIGINT) AS k)
SELECT id, 1 AS task, CASE WHEN i < k * 4 THEN CAST(floor(i / 4) AS BIGINT) * 8 + 4 + i % 4 ELSE k * 8 + ng - k * 4 + i - k * 4 END AS position FROM s, m WHERE ns > ng
UNION ALL SELECT id, 0, CASE WHEN i < k * 4 THEN CAST(floor(i / 4) AS BIGINT) * 8 + i % 4 ELSE k * 8 + i - k * 4 END FROM g, m WHERE ns > ng""")
def interleave_batches(spark, d):
    """More selectors than generators."""
    return _interleaved(spark, d, 0)


@query(f"""
WITH {_numbered_sql(1)},
n AS (SELECT (SELECT count(*) FROM s) AS ns, CAST(ceil((SELECT count(*) FROM s) / 4) AS BIGINT) AS chunks),
m AS (SELECT ns, (chunks - 1) * 4 AS whole, 8 - (ns - (chunks - 1) * 4) AS fill FROM n)
SELECT id, 1 AS task, CASE WHEN i < whole THEN CAST(floor(i / 4) AS BIGINT) * 8 + 4 + i % 4 ELSE whole * 2 + fill + i - whole END AS position FROM s, m
UNION ALL SELECT id, 0, CASE WHEN i < whole THEN CAST(floor(i / 4) AS BIGINT) * 8 + i % 4 WHEN i < whole + fill THEN i + whole ELSE i + ns END FROM g, m""")
def interleave_few_selectors(spark, d):
    """Fewer selectors than generators: what is left of these comes last."""
    return _interleaved(spark, d, 1)


@query("""
WITH u AS (SELECT example_id, ('0x' || substring(md5(concat_ws('|', '3', CAST(example_id AS STRING))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 * 10.0 AS u FROM @examples)
SELECT example_id, CASE WHEN u < 5 THEN 0 WHEN u < 8 THEN 1 WHEN u < 9.5 THEN 2 ELSE 3 END AS drawn FROM u""")
def distractor_counts(spark, d):
    return sampling.drawn_count(role(spark, d, "examples"), "example_id", [(0, 5.0), (1, 3.0), (2, 1.5), (3, 0.5)], 3)


@query("""
WITH n AS (SELECT example_id, count(*) AS n, min(md5(concat_ws('|', '11', CAST(example_id AS STRING), id))) AS d FROM @selection GROUP BY example_id),
h AS (SELECT example_id, d FROM n WHERE n > 1 AND ('0x' || substring(md5(concat_ws('|', '11', CAST(example_id AS STRING))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < 0.1)
SELECT s.example_id, s.id FROM @selection s LEFT JOIN h ON h.example_id = s.example_id AND h.d = md5(concat_ws('|', '11', CAST(s.example_id AS STRING), s.id)) WHERE h.d IS NULL""")
def selector_miss(spark, d):
    return units.drop_selected(role(spark, d, "selection").select("example_id", "id"), "example_id", "id", 0.1, 11)


@query("""
WITH n AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS total FROM @selection),
b AS (SELECT pos, i % 32 AS slot, CAST(floor(i / 32) AS BIGINT) AS batch, CAST(floor(total / 32) AS BIGINT) AS batches FROM n),
x AS (SELECT *, batches % 3 AS gone FROM b WHERE batch < batches),
k AS (SELECT pos, slot, batch, dense_rank() OVER (ORDER BY batch) - 1 AS spot FROM x WHERE NOT list_contains(list_transform(range(gone), lambda j: 2 + (gone + j) % 6), batch)),
d AS (SELECT *, md5(concat_ws('|', '10', CAST(spot AS STRING))) AS d FROM k),
r AS (SELECT pos, batch, slot, dense_rank() OVER (ORDER BY d, spot) - 1 AS position FROM d)
SELECT pos, batch, slot, position, position % 3 AS rank FROM r""")
def block_shuffle(spark, d):
    """Batches of 32 dealt to three ranks in the second epoch; two batches at most are left out to even them."""
    return sampling.shuffled_blocks(role(spark, d, "selection").select("pos"), "pos", 32, 9, replicas=3, epoch=1, first=2, count=6)


@query("""
WITH r AS (SELECT concat_ws('|', source, type, target) AS unit, source, target FROM @relations),
c AS (SELECT DISTINCT source % 5 AS k, unit FROM r WHERE source % 3 = 0),
n AS (SELECT DISTINCT node_id % 5 AS k, node_id FROM @nodes WHERE node_id % 4 = 0),
e AS (SELECT k, unnest([source, target]) AS node_id FROM c JOIN r USING (unit)),
b AS (SELECT k, 'relation' AS kind, unit, false AS closure FROM c UNION ALL SELECT k, 'node', CAST(node_id AS STRING), false FROM n UNION ALL SELECT k, 'node', CAST(node_id AS STRING), true FROM e)
SELECT k, kind, unit, bool_and(closure) AS closure FROM b GROUP BY k, kind, unit""")
def relation_closure(spark, d):
    r = role(spark, d, "relations").select(F.concat_ws("|", "source", "type", "target").alias("unit"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    chosen = r.where("cast(source as int) % 3 = 0").select((F.col("source").cast("int") % 5).alias("k"), F.lit("relation").alias("kind"), "unit")
    nodes = role(spark, d, "nodes").where("node_id % 4 = 0").select((F.col("node_id") % 5).alias("k"), F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("unit"))
    return units.close_selection(chosen.unionByName(nodes), r, "k")


@query("SELECT DISTINCT a.schema_id, a.unit_id FROM @selection a WHERE NOT EXISTS (SELECT 1 FROM @selection b WHERE b.schema_id = a.schema_id AND b.unit_id = a.unit_id AND b.p_yes >= 0.9 AND b.pos % 31 = 0)")
def complement_units(spark, d):
    rows = role(spark, d, "selection")
    return units.complement(rows.select("schema_id", "unit_id").distinct(), rows.where("p_yes >= 0.9 and pos % 31 = 0").select("schema_id", "unit_id"), ["schema_id", "unit_id"])


PATTERN_SQL = """SELECT pattern, CASE WHEN pattern % 4 = 0 THEN NULL ELSE mkt END AS type, CASE WHEN pattern % 3 = 0 THEN list_value() ELSE list_value(CAST(pattern % 25 AS INTEGER), CAST((pattern + 7) % 25 AS INTEGER)) END AS lefts,
  CASE WHEN pattern % 5 = 0 THEN list_value() ELSE list_value(CAST((pattern * 3) % 25 AS INTEGER)) END AS rights, CASE pattern % 3 WHEN 0 THEN 'out' WHEN 1 THEN 'in' ELSE 'undirected' END AS direction
  FROM (SELECT c_custkey AS pattern, c_mktsegment AS mkt FROM customer)"""


@query(f"""
WITH p AS ({PATTERN_SQL}), x AS (SELECT p.*, r.source, r.type AS rel_type, r.target FROM p JOIN @relations r ON p.type IS NULL OR p.type = r.type)
SELECT pattern, source, rel_type, target FROM x
WHERE (direction IN ('out', 'undirected') AND (len(lefts) = 0 OR list_contains(lefts, source)) AND (len(rights) = 0 OR list_contains(rights, target)))
   OR (direction IN ('in', 'undirected') AND (len(lefts) = 0 OR list_contains(lefts, target)) AND (len(rights) = 0 OR list_contains(rights, source)))""")
def theta_relation_match(spark, d):
    p = F.col("c_custkey")
    ints = lambda *xs: F.array(*[x.cast("int") for x in xs])
    patterns = spark.read.parquet(f"{d}/customer.parquet").select(
        p.alias("pattern"), F.when(p % 4 != 0, F.col("c_mktsegment")).alias("type"), F.when(p % 3 == 0, F.array().cast("array<int>")).otherwise(ints(p % 25, (p + 7) % 25)).alias("lefts"),
        F.when(p % 5 == 0, F.array().cast("array<int>")).otherwise(ints((p * 3) % 25)).alias("rights"), F.when(p % 3 == 0, "out").when(p % 3 == 1, "in").otherwise("undirected").alias("direction"),
    )
    return units.match_relations(patterns, role(spark, d, "relations"))


@query("""
WITH h AS (SELECT DISTINCT schema_id, example_id % 200 AS node_id, unit_id AS property FROM @selection),
n AS (SELECT schema_id, node_id, count(*) AS n FROM h GROUP BY ALL),
s AS (SELECT a.schema_id, a.node_id AS a, b.node_id AS b, count(*) AS shared FROM h a JOIN h b ON a.schema_id = b.schema_id AND a.property = b.property AND a.node_id < b.node_id GROUP BY ALL)
SELECT s.*, shared / (x.n + y.n - shared) AS jaccard FROM s JOIN n x ON x.schema_id = s.schema_id AND x.node_id = a JOIN n y ON y.schema_id = s.schema_id AND y.node_id = b WHERE shared >= 2 AND shared / (x.n + y.n - shared) >= 0.5""")
def similar_nodes_jaccard(spark, d):
    h = role(spark, d, "selection").select("schema_id", (F.col("example_id") % 200).alias("node_id"), F.col("unit_id").alias("property"))
    keyed = h.distinct().withColumn("key", F.concat_ws("/", "schema_id", "node_id"))
    found = units.similar_nodes(keyed.select("schema_id", F.col("key").alias("node_id")).distinct(), keyed.select(F.col("key").alias("node_id"), "property"), 2, 0.5)
    number = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(2)).cast("long")
    return found.select("schema_id", F.least(number("a"), number("b")).alias("a"), F.greatest(number("a"), number("b")).alias("b"), "shared", "jaccard")


@query("""
WITH r AS (SELECT concat_ws('|', source, type, target) AS u, type, least(source, target) AS lo, greatest(source, target) AS hi FROM @relations)
SELECT DISTINCT a.u AS a, b.u AS b FROM r a JOIN r b ON a.u < b.u AND (a.type = b.type OR (a.lo = b.lo AND a.hi = b.hi))""")
def competing_relations(spark, d):
    return units.competing_relations(role(spark, d, "relations"))


@query("""
WITH x AS (SELECT event_id AS pos, event_type AS k FROM @events_by_user WHERE event_id % 97 <> 0), y AS (SELECT event_id AS pos, CASE WHEN event_id % 101 = 0 THEN 'other' ELSE event_type END AS k FROM @events_by_user WHERE event_id % 89 <> 0)
SELECT pos, x.k AS left_key, y.k AS right_key, x.k IS NOT DISTINCT FROM y.k AS agrees FROM x FULL JOIN y USING (pos)""")
def positional_join(spark, d):
    e = role(spark, d, "events_by_user").withColumn("pos", F.col("event_id"))
    a = e.where("event_id % 97 <> 0").select("pos", F.col("event_type").alias("k"))
    b = e.where("event_id % 89 <> 0").select("pos", F.when(F.col("event_id") % 101 == 0, "other").otherwise(F.col("event_type")).alias("k"))
    return routing.positional(a, b, "pos", "k")


@query("""
WITH a AS (SELECT example_id FROM @examples WHERE example_id % 13 <> 0), b AS (SELECT example_id FROM @examples WHERE example_id % 11 <> 0 UNION ALL SELECT example_id FROM @examples WHERE example_id % 500 = 1),
x AS (SELECT example_id, 1 AS l, 0 AS r FROM a UNION ALL SELECT example_id, 0, 1 FROM b),
g AS (SELECT example_id, CAST(sum(l) AS BIGINT) AS in_left, CAST(sum(r) AS BIGINT) AS in_right FROM x GROUP BY example_id)
SELECT * FROM g WHERE in_left <> 1 OR in_right <> 1""")
def coverage_join(spark, d):
    e = role(spark, d, "examples").select("example_id")
    return routing.coverage(e.where("example_id % 13 <> 0"), e.where("example_id % 11 <> 0").union(e.where("example_id % 500 = 1")), "example_id")


@query("""
WITH a AS (SELECT schema_id, unit_id FROM @selection), b AS (SELECT schema_id, unit_id FROM @selection WHERE pos % 53 <> 0),
x AS (SELECT schema_id, unit_id, 1 AS l, 0 AS r FROM a UNION ALL SELECT schema_id, unit_id, 0, 1 FROM b), g AS (SELECT schema_id, unit_id, CAST(sum(l) AS BIGINT) AS in_a, CAST(sum(r) AS BIGINT) AS in_b FROM x GROUP BY ALL)
SELECT * FROM g WHERE in_a <> in_b""")
def multiset_equality(spark, d):
    rows = role(spark, d, "selection")
    return metrics.multiset_difference(rows, rows.where("pos % 53 <> 0"), ["schema_id", "unit_id"])


REASON = """CASE WHEN coalesce(question, '') = '' OR coalesce(cypher, '') = '' THEN 'missing_question_or_cypher' WHEN n_units = 0 THEN 'empty_normalized_schema' WHEN n_units = 1 THEN 'no_schema_units_resolved' WHEN NOT complete THEN 'incomplete_gold_subschema' END"""


@query(f"""
WITH r AS (SELECT *, {REASON} AS reason FROM @examples)
SELECT source, split, count(*) AS examples, count(*) FILTER (reason IS NULL) AS usable, count(*) FILTER (reason = 'missing_question_or_cypher') AS missing_text, count(*) FILTER (reason = 'empty_normalized_schema') AS empty_schema,
  count(*) FILTER (reason = 'no_schema_units_resolved') AS unresolved, count(*) FILTER (reason = 'incomplete_gold_subschema') AS incomplete, count(*) FILTER (has_issue) AS issues, CAST(sum(n_units) FILTER (reason IS NULL) AS BIGINT) AS units
FROM r GROUP BY source, split""")
def routing_counts(spark, d):
    return routing.route_counts(routing.route(role(spark, d, "examples")), ["source", "split"])


@query(f"""
WITH r AS (SELECT *, {REASON} AS reason FROM @examples)
SELECT example_id, n_units > 1 AND complete AS gold_available, CASE WHEN n_units > 1 AND complete THEN n_units END AS gold_units FROM r
WHERE split = 'test' AND (reason IS NULL OR reason NOT IN ('missing_question_or_cypher', 'empty_normalized_schema'))""")
def dual_emission(spark, d):
    return routing.inference_rows(routing.route(role(spark, d, "examples")))


@query(f"SELECT example_id, source, split, graph, schema_id, question, cypher, {REASON} AS reason FROM @examples WHERE {REASON} IS NOT NULL")
def rejected_rows(spark, d):
    return routing.route(role(spark, d, "examples")).where("reason is not null").select("example_id", "source", "split", "graph", "schema_id", "question", "cypher", "reason")


@query("SELECT example_id, source, split, graph FROM @examples WHERE has_issue")
def normalization_issues(spark, d):
    return role(spark, d, "examples").where("has_issue").select("example_id", "source", "split", "graph")


@query("SELECT id, CASE WHEN label = 1 THEN 'YES' ELSE 'NO' END AS label, concat('{\"label\": \"', CASE WHEN label = 1 THEN 'YES' ELSE 'NO' END, '\"}') AS response FROM @selection")
def label_responses(spark, d):
    text = routing.label_text(F.col("label"))
    return role(spark, d, "selection").select("id", text.alias("label"), F.concat(F.lit('{"label": "'), text, F.lit('"}')).alias("response"))


@query("SELECT id, CASE WHEN predicted = 'INVALID' THEN 'INVALID' WHEN pos % 9 = 0 THEN predicted WHEN p_yes >= 0.4 THEN 'YES' ELSE 'NO' END AS decision FROM @selection")
def label_threshold(spark, d):
    p = F.when(F.col("pos") % 9 != 0, F.col("p_yes"))
    return role(spark, d, "selection").select("id", routing.decide(F.col("predicted") != "INVALID", F.col("predicted"), p, 0.4).alias("decision"))


@query("SELECT id, coalesce(CASE WHEN pos % 3 = 0 THEN unit_type END, CASE WHEN pos % 3 = 1 THEN 'relation' END, split_part(concat(unit_type, ':', unit_id), ':', 1)) AS unit_type FROM @selection")
def unit_type_fallback(spark, d):
    rows, pos = role(spark, d, "selection"), F.col("pos")
    made = routing.unit_type(F.when(pos % 3 == 0, F.col("unit_type")), F.when(pos % 3 == 1, F.lit("relation")), F.concat("unit_type", F.lit(":"), "unit_id"))
    return rows.select("id", made.alias("unit_type"))


@query("SELECT id, pos, predicted FROM @selection WHERE pos > (SELECT quantile_disc(pos, 0.25) FROM @selection)")
def resume_filter(spark, d):
    """Rows beyond the first quarter, which has its results."""
    rows = role(spark, d, "selection").select("id", "pos", "predicted")
    done = rows.where(F.col("pos") <= F.lit(sampling.at_share(rows, "pos", 0.25))).select("id")
    return sampling.after_progress(rows, ["pos"], "id", done)


@query("SELECT k.source, coalesce(n, 0) AS n FROM (SELECT unnest(['F', 'O', 'P', 'absent']) AS source) k LEFT JOIN (SELECT source, count(*) AS n FROM @examples WHERE split = 'train' GROUP BY source) c USING (source)")
def zero_filled_counts(spark, d):
    keys = spark.createDataFrame([(x,) for x in ("F", "O", "P", "absent")], "source string")
    return routing.zero_filled(role(spark, d, "examples").where("split = 'train'"), keys, "source")


@query("SELECT label, unit_type, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share FROM @selection GROUP BY label, unit_type")
def label_type_priors(spark, d):
    return profile.shares(role(spark, d, "selection"), "label", "unit_type")


@query("""
SELECT split, count(n_tokens) AS n, min(n_tokens) AS least, avg(n_tokens) AS mean, quantile_cont(n_tokens, 0.5) AS median, quantile_cont(n_tokens, 0.9) AS p90, quantile_cont(n_tokens, 0.95) AS p95, quantile_cont(n_tokens, 0.99) AS p99,
  max(n_tokens) AS most, count(*) FILTER (n_tokens > 1024) AS "over", 100 * count(*) FILTER (n_tokens > 1024) / count(n_tokens) AS over_pct FROM @prompts GROUP BY split""")
def length_profile(spark, d):
    return profile.length_profile(role(spark, d, "prompts"), ["split"], "n_tokens", 1024)


@query("""
WITH o AS (SELECT split, list_sort(list(n_tokens)) AS v FROM @prompts WHERE n_tokens IS NOT NULL GROUP BY split)
SELECT split, len(v) AS n, v[1] AS least, v[CAST(floor(len(v) / 2) AS BIGINT) + 1] AS p50, v[-1] AS most, CAST(list_sum(v) AS BIGINT) / len(v) AS mean FROM o""")
def upper_median(spark, d):
    return profile.upper_median(role(spark, d, "prompts"), ["split"], "n_tokens")


@query("SELECT split, task, count(*) AS n FROM @prompts GROUP BY ALL")
def histogram_modes(spark, d):
    return profile.histogram(role(spark, d, "prompts"), ["split", "task"])


@query("SELECT task, max(n_tokens) AS n_tokens, arg_min(pos, struct_pack(a := -n_tokens, b := pos)) AS pos FROM @prompts GROUP BY task")
def longest_prompt(spark, d):
    return profile.longest(role(spark, d, "prompts"), "task", "n_tokens", "pos")


@query("SELECT max(m) AS longest, CAST(ceil((max(m) + 256) / 8) * 8 AS BIGINT) AS budget FROM (SELECT task, max(n_tokens) AS m FROM @prompts GROUP BY task)")
def token_budget(spark, d):
    return profile.budget(role(spark, d, "prompts"), "task", "n_tokens", 256, 8)


@query("""
WITH e AS (SELECT example_id FROM @selection GROUP BY example_id HAVING count(DISTINCT label) = 2)
SELECT schema_id, unit_id, label, count(DISTINCT example_id) AS questions FROM @selection WHERE example_id IN (SELECT example_id FROM e) GROUP BY ALL""")
def pair_frequencies(spark, d):
    rows = role(spark, d, "selection")
    eligible = sampling.contrast_eligible(rows, "example_id", "label").select("example_id")
    return rows.join(eligible, "example_id", "left_semi").groupBy("schema_id", "unit_id", "label").agg(F.countDistinct("example_id").alias("questions"))


def _words(c):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def _worded(spark, d):
    return role(spark, d, "pairs").select("item_id", _words(F.col("predicted")).alias("p"), _words(F.col("reference")).alias("r"))


WORDS_SQL = "WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(predicted), '[^a-z0-9]+'), lambda x: x <> '') AS p, list_filter(string_split_regex(lower(reference), '[^a-z0-9]+'), lambda x: x <> '') AS r FROM @pairs)"


def _overlap_sql(n: int) -> str:
    grams = lambda c: f"CASE WHEN len({c}) >= {n} THEN list_transform(range(len({c}) - {n - 1}), lambda i: array_to_string({c}[i + 1 : i + {n}], ' ')) ELSE [] END"
    return f"""{WORDS_SQL}, g AS (SELECT item_id, {grams('p')} AS a, {grams('r')} AS b FROM w),
o AS (SELECT item_id, len(a) AS na, len(b) AS nb, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS o FROM g)
SELECT item_id, CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN o = 0 THEN 0 ELSE 2 * (o / na) * (o / nb) / (o / na + o / nb) END AS score FROM o"""


@query(_overlap_sql(1))
def rouge_1(spark, d):
    return S.ngram_scores(_worded(spark, d), "item_id", "p", "r", 1)


@query(_overlap_sql(2))
def rouge_2(spark, d):
    return S.ngram_scores(_worded(spark, d), "item_id", "p", "r", 2)


@query(f"""{WORDS_SQL}, l AS (SELECT item_id, len(p) AS np, len(r) AS nr, list_reduce(list_transform(p, lambda x: {{'w': x, 'r': list_transform(range(len(r) + 1), lambda z: 0)}}),
  lambda prev, cur: {{'w': cur.w, 'r': list_reduce(list_transform(range(1, len(r) + 1), lambda j: [CAST(j AS INTEGER)]), lambda acc, j: acc || [CASE WHEN r[j[1]] = cur.w THEN prev.r[j[1]] + 1 ELSE greatest(prev.r[j[1] + 1], acc[-1]) END], [0])}},
  {{'w': '', 'r': list_transform(range(len(r) + 1), lambda z: 0)}}).r[-1] AS o FROM w)
SELECT item_id, CASE WHEN np = 0 AND nr = 0 THEN 1 WHEN o = 0 THEN 0 ELSE 2 * (o / np) * (o / nr) / (o / np + o / nr) END AS score FROM l""")
def rouge_l(spark, d):
    return _worded(spark, d).select("item_id", S.rouge_l(F.col("p"), F.col("r")).alias("score"))


@query(f"{WORDS_SQL} SELECT item_id, CASE WHEN len(list_distinct(p || r)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(p), list_distinct(r))) / len(list_distinct(p || r)) END AS score FROM w")
def jaccard_psjs(spark, d):
    return role(spark, d, "pairs").select("item_id", S.jaccard(_words(F.col("predicted")), _words(F.col("reference"))).alias("score"))


SOFT_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM @vectors),
j AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, list_transform(x, lambda t: exp(t - list_max(x))) AS x, list_transform(y, lambda t: exp(t - list_max(y))) AS y FROM j),
s AS (SELECT vec_id, list_transform(x, lambda t: t / list_sum(x)) AS p, list_transform(y, lambda t: t / list_sum(y)) AS q FROM m)"""


def _soft(spark, d):
    v = role(spark, d, "vectors").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(b, "vec_id").select("vec_id", S.softmax(F.col("e")).alias("p"), S.softmax(F.col("f")).alias("q"))


def _kernel(name: str, column, sql: str):
    def f(spark, d):
        return _soft(spark, d).select("vec_id", F.round(column(F.col("p"), F.col("q")), 9).alias("loss"))

    f.__name__ = name
    query(f"{SOFT_SQL} SELECT vec_id, round(list_sum(list_transform(range(len(p)), lambda i: {sql})), 9) AS loss FROM s")(f)


P, Q = "p[i + 1]", "q[i + 1]"
_kernel("forward_kl", S.forward_kl, f"-{P} * ln({Q})")
_kernel("reverse_kl", S.reverse_kl, f"{Q} * (ln({Q}) - ln({P}))")
_kernel("skewed_forward_kl", S.skewed_forward_kl, f"-{P} * ln(0.1 * {P} + 0.9 * {Q})")
_kernel("skewed_reverse_kl", S.skewed_reverse_kl, f"{Q} * (ln({Q}) - ln(0.9 * {P} + 0.1 * {Q}))")
_kernel("blended_kl", S.blended_kl, f"(0.1 * {P} + 0.9 * {Q}) * (ln(0.1 * {P} + 0.9 * {Q}) - ln(0.9 * {P} + 0.1 * {Q}))")


@query("""
WITH m AS (SELECT user_id, event_type, avg(CAST(floor(value) AS BIGINT)) AS m FROM @events_by_user WHERE event_type IN ('view', 'click') GROUP BY ALL),
w AS (SELECT *, CASE event_type WHEN 'view' THEN 0.75 ELSE 0.25 END AS w FROM m)
SELECT user_id, round(sum(m * w) / sum(w), 9) AS loss, count(*) AS tasks FROM w GROUP BY user_id""")
def task_balanced_mean(spark, d):
    rows = role(spark, d, "events_by_user").where("event_type in ('view', 'click')").withColumn("v", F.floor("value"))
    return metrics.weighted_task_mean(rows, "user_id", "event_type", "v", {"view": 0.75, "click": 0.25}).withColumn("loss", F.round("loss", 9))


@query("SELECT md5(concat_ws('|', '1', CAST(example_id AS STRING))) AS d, sha256(concat(source, ':', split, ':', graph)) AS digest, substring(sha256(CAST(example_id AS STRING)), 1, 16) AS short_id FROM @examples")
def digests(spark, d):
    return role(spark, d, "examples").select(sampling.draw(1, "example_id").alias("d"), F.sha2(F.concat_ws(":", "source", "split", "graph"), 256).alias("digest"), F.substring(F.sha2(F.col("example_id").cast("string"), 256), 1, 16).alias("short_id"))


@query("SELECT conv_id, string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '' ORDER BY turn) AS rendered FROM @turns WHERE role <> 'system' GROUP BY conv_id")
def chat_markup(spark, d):
    rows = role(spark, d, "turns").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", T.chat_markup(F.col("m"), "<|im_start|>", "\n", "<|im_end|>\n").alias("rendered"))


@query("""
WITH u AS (SELECT *, upper(translate(trim(t), '- ', '__')) AS u FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'str' WHEN 1 THEN ' Long ' WHEN 2 THEN 'date-time' WHEN 3 THEN '' WHEN 4 THEN 'list<string>' WHEN 5 THEN 'number' WHEN 6 THEN p_type ELSE 'bool' END AS t FROM part))
SELECT p_partkey, CASE WHEN u = '' THEN 'UNKNOWN' WHEN u = 'STR' THEN 'STRING' WHEN u = 'LONG' THEN 'INTEGER' WHEN u = 'NUMBER' THEN 'FLOAT' WHEN u = 'BOOL' THEN 'BOOLEAN' WHEN u LIKE 'LIST%' THEN 'LIST' ELSE u END AS kind FROM u""")
def property_types(spark, d):
    k = F.col("p_partkey") % 8
    given = F.when(k == 0, "str").when(k == 1, " Long ").when(k == 2, "date-time").when(k == 3, "").when(k == 4, "list<string>").when(k == 5, "number").when(k == 6, F.col("p_type")).otherwise("bool")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.property_type(given).alias("kind"))


@query("SELECT DISTINCT concat('(:', a.label, ')-[:', r.type, ' { since: DATE }]->(:', b.label, ')') AS text FROM @relations r JOIN @nodes a ON a.node_id = r.source JOIN @nodes b ON b.node_id = r.target")
def relation_texts(spark, d):
    nodes = role(spark, d, "nodes")
    side = lambda c: nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"))
    rows = role(spark, d, "relations").join(side("source"), "source").join(side("target"), "target")
    return rows.select(T.relation_text(F.col("source_label"), F.col("type"), F.col("target_label"), F.create_map(F.lit("since"), F.lit("DATE"))).alias("text")).distinct()


@query("SELECT schema_id, concat('Nodes:', chr(10), string_agg(DISTINCT concat('- ', label), chr(10) ORDER BY concat('- ', label))) AS section FROM @nodes GROUP BY schema_id")
def context_sections(spark, d):
    return role(spark, d, "nodes").groupBy("schema_id").agg(F.collect_set("label").alias("l")).select("schema_id", T.section("Nodes:", F.col("l")).alias("section"))


@query("SELECT pos, translate(substring(text, 1, 80), chr(10) || chr(13), '  ') AS preview FROM @prompts")
def example_preview(spark, d):
    return role(spark, d, "prompts").select("pos", T.preview(F.col("text"), 80).alias("preview"))


@query("SELECT graph, max(example_id) AS newest, CAST(max(CAST(regexp_extract(concat('checkpoint-', example_id), 'checkpoint-([0-9]+)$', 1) AS BIGINT)) AS BIGINT) AS step FROM @examples GROUP BY graph")
def last_checkpoint(spark, d):
    step = F.regexp_extract(F.concat(F.lit("checkpoint-"), "example_id"), r"checkpoint-([0-9]+)$", 1).cast("long")
    return role(spark, d, "examples").groupBy("graph").agg(F.max("example_id").alias("newest"), F.max(step).alias("step"))


@query("SELECT event_id, printf('%02d:%02d:%02d', CAST(floor(value * 60 / 3600) AS INT), CAST(floor(floor(value * 60) / 60) AS BIGINT) % 60, CAST(floor(value * 60) AS BIGINT) % 60) AS took FROM @events_by_user")
def durations(spark, d):
    return role(spark, d, "events_by_user").select("event_id", T.duration(F.col("value") * 60).alias("took"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", k.alias("k")).where("k >= 50")


@query("SELECT n_name AS graph, count(DISTINCT c_custkey) AS n_entities, (SELECT count(*) FROM @relations r WHERE r.source = n_nationkey) AS n_relations FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def entity_counts(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    entities = read("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.countDistinct("c_custkey").alias("n_entities"))
    relations = role(spark, d, "relations").groupBy(F.col("source").alias("k")).agg(F.count("*").alias("n_relations"))
    rows = read("nation").select(F.col("n_name").alias("graph"), F.col("n_nationkey").alias("k")).join(entities, "k", "left").join(relations, "k", "left")
    return rows.select("graph", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"))


@query("""
SELECT d.lang, count(*) AS documents, count(g.doc_id) AS labelled, CAST(coalesce(sum(g.quality), 0) AS BIGINT) AS good, count(g.doc_id) / count(*) AS coverage FROM documents d LEFT JOIN @gold g USING (doc_id) GROUP BY d.lang""")
def label_coverage(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    gold = role(spark, d, "gold").select("doc_id", "quality", F.lit(1).alias("has"))
    per = docs.join(gold, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.count("has").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))
    return per.withColumn("coverage", F.col("labelled") / F.col("documents"))


@query()
def extract_subschema(spark, d):
    """Sub-schemas of queries over one schema graph, each schema parsed against once."""
    from ..operators.extraction import extract_all

    nodes = role(spark, d, "nodes").select(F.col("label"), F.col("node_id"))
    side = lambda c: nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"))
    rel = role(spark, d, "relations").join(side("source"), "source").join(side("target"), "target")
    schema = rel.agg(F.array_sort(F.collect_set(F.struct(F.col("source_label").alias("source"), "type", F.col("target_label").alias("target")))).alias("relations"))
    schema = schema.crossJoin(nodes.agg(F.array_sort(F.collect_set("label")).alias("labels"))).withColumn("schema_id", F.lit(0))
    k = F.col("example_id")
    label = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    text = F.concat(F.lit("MATCH (a:"), label(k % 27), F.lit(")-[:"), F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "HOUSEHOLD", "UNKNOWN"))), (k % 4 + 1).cast("int")), F.when(k % 2 == 0, "]->(b) RETURN b").otherwise("]-(b) RETURN b"))
    return extract_all(role(spark, d, "examples").select("example_id", F.lit(0).alias("schema_id"), text.alias("query")), schema, "example_id")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM @events_by_user")
def execution_accuracy(spark, d):
    """Results that are equal up to the order of columns and rows, but every fifth, which lacks a row."""
    from ..functions.results import execution_accuracy as accuracy

    e = role(spark, d, "events_by_user")
    gold = F.format_string("[[%d, \"a\", 1.5], [%d, \"b\", 2.5]]", "event_id", "user_id")
    other = F.format_string("[[2.5, %d, \"b\"], [1.5, %d, \"a\"]]", "user_id", "event_id")
    short = F.format_string("[[1.5, %d, \"a\"]]", "event_id")
    return e.select("event_id", accuracy(F.when(F.col("event_id") % 5 == 0, short).otherwise(other), gold, F.lit("MATCH (n) RETURN n")).alias("score"))


@query("SELECT example_id, CASE WHEN question = '' THEN NULL ELSE question END AS answer FROM @examples WHERE question IS NOT NULL AND question <> ''")
def answer_extraction(spark, d):
    """Queries read back from JSON, fenced and cut-off answers."""
    from ..functions.cypher import answer_udf

    q = F.col("question")
    wrapped = F.when(F.col("example_id") % 3 == 0, F.concat(F.lit('noise {"cypher": "'), q, F.lit('"} more'))).when(F.col("example_id") % 3 == 1, F.concat(F.lit("```cypher\n"), q, F.lit("\n```"))).otherwise(F.concat(F.lit('{"cypher": "'), q))
    return role(spark, d, "examples").where("question <> ''").select("example_id", answer_udf(wrapped).alias("answer"))


@query("SELECT concat('s:g:', substring(sha256(concat('{\"graph\": \"', graph, '\", \"n\": ', count(*), '}')), 1, 16)) AS schema_id, graph FROM @examples GROUP BY graph")
def schema_digests(spark, d):
    from ..functions.canonical import schema_id_udf

    payload = F.to_json(F.struct(F.col("count").alias("n"), "graph"))
    return role(spark, d, "examples").groupBy("graph").count().select(schema_id_udf(F.lit("s"), F.lit("g"), payload).alias("schema_id"), "graph")
