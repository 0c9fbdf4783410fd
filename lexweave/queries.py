"""The queries of the library's own operators, each over whole tables, with the SQL that gives the same rows.

Records are the distinct texts of `part` (a text's id is its smallest key): `items` (name, type, brand), `kinds` (name, type) and
`shelf` (name, brand); so joins return pairs of representatives, and `part_members` tells which parts each stands for. Queries over
`kinds` are registered over `items` too, as NAME_items. Rules are given here, for Spark and for SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays
from .operators import distances, joins, orders, qgrams, rewrite
from .operators.verify import verify
from .plans import generate, planner, quality, registry, statistics, sweep
from .plans.spec import JoinSpec, Params
from .sources import sinks, text

RULES = [
    ("red", "hot"), ("hot ring", "old rod"), ("blue bolt", "red plate"), ("economy", "promo"), ("brand#2", "brand#3"), ("small", "large"),
    ("economy brand#4", "brand#4"), ("ring economy", "ring"), ("widget small", "gear medium"), ("standard", "medium"), ("cold", "old"),
    ("promo brand#5", "brand#5 promo"), ("large rod", "rod large small"), ("medium brand#7", "brand#8"), ("bolt", "rod"), ("absent words", "red"),
]
COLUMNS = {"items": ("p_name", "p_type", "p_brand"), "kinds": ("p_name", "p_type"), "shelf": ("p_name", "p_brand")}


def records(spark: SparkSession, sf_dir: str, name: str = "items") -> DataFrame:
    """(id, raw, toks)"""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower(F.concat_ws(" ", *COLUMNS[name])).alias("raw"), "p_partkey")
    return text.with_tokens(p.groupBy("raw").agg(F.min("p_partkey").alias("id")))


def members(spark: SparkSession, sf_dir: str, name: str = "items") -> DataFrame:
    """(p_partkey, id): the representative of every part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower(F.concat_ws(" ", *COLUMNS[name])).alias("raw"))
    return p.join(records(spark, sf_dir, name).select("raw", "id"), "raw").select("p_partkey", "id")


def rules(spark: SparkSession) -> DataFrame:
    return text.rules_of(spark, RULES)


def matched(spark: SparkSession, sf_dir: str, name: str = "items") -> DataFrame:
    return rewrite.matched(records(spark, sf_dir, name), rules(spark))


def profiled(spark: SparkSession, sf_dir: str, name: str = "items") -> DataFrame:
    return rewrite.profiled(matched(spark, sf_dir, name))


def joined(c: str):
    return F.array_join(c, " ")


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(body: str, name: str = "items", other: str | None = None) -> str:
    """Common tables: recs, allrules, m (applicable rules), ex (prefixes of rewritings), e (rewritings), rank; and recs2 of another record set."""
    recs = lambda n: f"SELECT min(p_partkey) AS id, raw, string_split_regex(raw, '[ \\t]+') AS toks FROM (SELECT p_partkey, lower(concat_ws(' ', {', '.join(COLUMNS[n])})) AS raw FROM part) GROUP BY raw"
    given = ", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in RULES)
    more = f"\nrecs2 AS ({recs(other)})," if other else ""
    return f"""
WITH RECURSIVE recs AS ({recs(name)}),{more}
rules AS (SELECT string_split(l, ' ') AS lhs, string_split(r, ' ') AS rhs FROM (VALUES {given}) AS v(l, r)),
allrules AS (SELECT lhs, rhs FROM rules UNION SELECT [t], [t] FROM (SELECT DISTINCT unnest(toks) AS t FROM recs)),
grams AS (SELECT id, i - 1 AS start, w AS n, toks[i:i + w - 1] AS lhs FROM (SELECT id, toks, unnest(range(1, len(toks) + 1)) AS i FROM recs), (VALUES (1), (2), (3)) AS s(w) WHERE i + w - 1 <= len(toks)),
m AS (SELECT DISTINCT id, start, n, lhs, rhs FROM grams JOIN allrules USING (lhs)),
ex AS (
  SELECT id, CAST(0 AS BIGINT) AS done, CAST([] AS VARCHAR[]) AS made FROM recs
  UNION ALL SELECT ex.id, ex.done + m.n, list_concat(ex.made, m.rhs) FROM ex JOIN m ON m.id = ex.id AND m.start = ex.done),
e AS (SELECT DISTINCT id, made FROM ex JOIN recs USING (id) WHERE done = len(toks)),
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(rhs) AS token FROM m) GROUP BY token),
rank AS (SELECT token, n, row_number() OVER (ORDER BY n, token) AS rank FROM counts)
{body}
"""


SELF = "SELECT DISTINCT least(a, b) AS id1, greatest(a, b) AS id2 FROM ({})"
SEQUENCE = SELF.format("SELECT e.id AS a, r.id AS b FROM e JOIN recs r ON e.made = r.toks")
SET = SELF.format("SELECT e.id AS a, r.id AS b FROM e JOIN recs r ON list_sort(list_distinct(e.made)) = list_sort(list_distinct(r.toks))")
DROPS = "(SELECT id, {0} AS t, {0}[1:i - 1] || {0}[i + 1:] AS less, i, len({0}) AS n FROM (SELECT id, {0}, unnest(range(1, len({0}) + 1)) AS i FROM {1}))"
LCS1 = f"""SELECT e.id AS a, r.id AS b FROM e JOIN recs r ON e.made = r.toks
  UNION ALL SELECT d.id, r.id FROM {DROPS.format("made", "e")} d JOIN recs r ON d.less = r.toks
  UNION ALL SELECT e.id, d.id FROM e JOIN {DROPS.format("toks", "recs")} d ON e.made = d.less"""
EDIT1 = LCS1 + f"""
  UNION ALL SELECT x.id, y.id FROM {DROPS.format("made", "e")} x JOIN {DROPS.format("toks", "recs")} y ON x.less = y.less AND x.i = y.i AND x.n = y.n"""
DELTA = {"lcs": SELF.format(LCS1), "edit": SELF.format(EDIT1)}

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    _queries[name] = query
    if oracle:
        _sql[name] = oracle


def _self_join(name: str, kind: str = "items", **params) -> Query:
    return lambda spark, d: registry.run(name, JoinSpec.of_self(records(spark, d, kind), rules(spark), **params))


def add_items(name: str, query: Callable[[SparkSession, str, str], DataFrame], with_sql: bool = True) -> None:
    """The query of `kinds` over `items`; without SQL where that would hold all pairs of records against each other."""
    records_sql = lambda kind: sql("", kind).split("\n")[1]
    oracle = _sql[name].replace(records_sql("kinds"), records_sql("items")) if with_sql else None
    add(f"{name}_items", lambda spark, d: query(spark, d, "items"), oracle)


# sources and tokens
add(
    "tokenize",
    lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.element_at("t", 1).alias("first_token"), F.element_at("t", -1).alias("last_token")),
    r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first_token, t[-1] AS last_token FROM (SELECT doc_id, string_split_regex(regexp_replace(lower(coalesce(text, '')), '[ \t]+$', ''), '[ \t]+') AS t FROM documents)",
)
add("dictionary_encode", lambda spark, d: orders.dictionary(records(spark, d)), sql("SELECT token, row_number() OVER (ORDER BY token) AS token_id FROM (SELECT DISTINCT unnest(toks) AS token FROM recs) WHERE token <> '' UNION ALL SELECT '', 0"))


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    words = orders.dictionary(r)
    return orders.decode(orders.encode(r, words), words).select("id", joined("toks").alias("toks"))


add("dictionary_round_trip", _round_trip, sql("SELECT id, array_to_string(toks, ' ') AS toks FROM recs"))


def _result_text(spark: SparkSession, d: str, kind: str = "kinds") -> DataFrame:
    r = records(spark, d, kind)
    return sinks.result_lines(_self_join("JoinNaive", kind)(spark, d), r, r, True)


add(
    "result_text",
    _result_text,
    sql(f"SELECT CAST(count(*) AS VARCHAR) AS value FROM ({SEQUENCE}) UNION ALL SELECT a.raw || ' (' || id1 || ')' || chr(9) || '==' || chr(9) || b.raw || ' (' || id2 || ')' FROM ({SEQUENCE}) p JOIN recs a ON a.id = id1 JOIN recs b ON b.id = id2 WHERE id1 <> id2", "kinds"),
)
add_items("result_text", _result_text)
for _kind in COLUMNS:
    _raw = f"lower(concat_ws(' ', {', '.join(COLUMNS[_kind])}))"
    add(f"part_members_{_kind}", lambda spark, d, k=_kind: members(spark, d, k), f"SELECT p_partkey, min(p_partkey) OVER (PARTITION BY {_raw}) AS id FROM part")

# arrays
_three = lambda spark, d: records(spark, d).select("id", "toks")
add(
    "array_ops",
    lambda spark, d: _three(spark, d).select(
        "id", arrays.subarray_equal(F.col("toks"), 0, 2, F.array(F.lit("red"), F.lit("ring"))).alias("starts"), joined(arrays.pad(F.col("toks"), 6, "*")).alias("padded"),
        joined(arrays.subsequence(F.col("toks"), F.array(F.lit(0), F.lit(2)))).alias("chosen"), joined(arrays.subsequence_without(F.col("toks"), F.array(F.lit(1)))).alias("rest"),
        joined(arrays.union_sorted(F.col("toks"), F.array(F.lit("red"), F.lit("zinc")))).alias("merged"), F.size(arrays.gram_prefixes(F.col("toks"))).cast("long").alias("prefixes"),
    ),
    sql("SELECT id, toks[1:2] = ['red', 'ring'] AS starts, array_to_string(toks || list_transform(range(0, greatest(6 - len(toks), 0)), lambda x: '*'), ' ') AS padded, toks[1] || ' ' || toks[3] AS chosen, array_to_string(toks[1:1] || toks[3:], ' ') AS rest, array_to_string(list_sort(list_distinct(toks || ['red', 'zinc'])), ' ') AS merged, CAST(len(toks) AS BIGINT) AS prefixes FROM recs"),
)


def _distances(spark: SparkSession, d: str) -> DataFrame:
    k = records(spark, d, "kinds")
    x, y = k.select(F.col("id").alias("id1"), F.col("toks").alias("x"), F.get("toks", F.lit(0)).alias("f")), k.select(F.col("id").alias("id2"), F.col("toks").alias("y"), F.get("toks", F.lit(0)).alias("f"))
    return _measured(x.join(y, "f"))


def _measured(d1: DataFrame) -> DataFrame:
    cx, cy = F.col("x"), F.col("y")
    return d1.select("id1", "id2", arrays.lcs_length(cx, cy).cast("long").alias("lcs"), arrays.indel_distance(cx, cy).cast("long").alias("indel"), arrays.edit_distance(cx, cy).cast("long").alias("edit"), F.round(arrays.jaccard(cx, cy), 9).alias("jaccard"))


add(
    "array_distances",
    _distances,
    sql(
        """, subs AS (SELECT id, b, list_filter(toks, lambda x, i: (b >> (i - 1)) & 1 = 1) AS s FROM recs, (SELECT unnest(range(0, 16)) AS b) WHERE b < (1 << len(toks))),
letters AS (SELECT token, chr(CAST(64 + row_number() OVER (ORDER BY token) AS INTEGER)) AS c FROM (SELECT DISTINCT unnest(toks) AS token FROM recs)),
coded AS (SELECT id, string_agg(c, '' ORDER BY i) AS w FROM (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM recs) JOIN letters USING (token) GROUP BY id),
lcs AS (SELECT a.id AS id1, b.id AS id2, max(len(a.s)) AS lcs FROM subs a JOIN subs b ON a.s = b.s GROUP BY ALL)
SELECT id1, id2, CAST(lcs AS BIGINT) AS lcs, CAST(len(a.toks) + len(b.toks) - 2 * lcs AS BIGINT) AS indel, CAST(levenshtein(p.w, q.w) AS BIGINT) AS edit,
  round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(a.toks || b.toks)), 9) AS jaccard
FROM lcs JOIN recs a ON a.id = id1 JOIN recs b ON b.id = id2 JOIN coded p ON p.id = id1 JOIN coded q ON q.id = id2 WHERE a.toks[1] = b.toks[1]""",
        "kinds",
    ),
)
add_items("array_distances", lambda spark, d, kind: distances.all_pairs(records(spark, d, kind)), False)

# rules
add("rule_match", lambda spark, d: rewrite.applicable(records(spark, d), rules(spark)).select("id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), joined("lhs").alias("lhs"), joined("rhs").alias("rhs")), sql("SELECT DISTINCT id, start, CAST(n AS BIGINT) AS n, array_to_string(lhs, ' ') AS lhs, array_to_string(rhs, ' ') AS rhs FROM grams JOIN rules USING (lhs)"))
add("rule_self", lambda spark, d: rewrite.self_rules(records(spark, d)).select(joined("lhs").alias("lhs"), joined("rhs").alias("rhs")), sql("SELECT DISTINCT t AS lhs, t AS rhs FROM (SELECT unnest(toks) AS t FROM recs)"))
add("rule_end_index", lambda spark, d: rewrite.by_end(matched(spark, d)).select("id", F.col("end").cast("long").alias("end"), F.col("n").cast("long").alias("n"), joined("rhs").alias("rhs")), sql('SELECT id, start + n - 1 AS "end", CAST(n AS BIGINT) AS n, array_to_string(rhs, \' \') AS rhs FROM m'))
add("rule_count", lambda spark, d: rewrite.num_applicable(matched(spark, d)), sql("SELECT id, count(*) FILTER (lhs <> rhs) AS rules FROM m GROUP BY id"))
add("rule_usage", lambda spark, d: statistics.rule_usage(rewrite.applicable(records(spark, d), rules(spark)), rules(spark)).select(joined("lhs").alias("lhs"), joined("rhs").alias("rhs"), "places", "records"), sql("SELECT array_to_string(r.lhs, ' ') AS lhs, array_to_string(r.rhs, ' ') AS rhs, count(m.id) AS places, count(DISTINCT m.id) AS records FROM rules r LEFT JOIN m ON m.lhs = r.lhs AND m.rhs = r.rhs GROUP BY ALL"))
add("rule_prune", lambda spark, d: statistics.used_rules(rewrite.applicable(records(spark, d), rules(spark)), rules(spark)).select(joined("lhs").alias("lhs"), joined("rhs").alias("rhs")), sql("SELECT array_to_string(lhs, ' ') AS lhs, array_to_string(rhs, ' ') AS rhs FROM rules WHERE lhs IN (SELECT lhs FROM grams)"))
add("expand_all", lambda spark, d: rewrite.expand(matched(spark, d)).select("id", joined("toks").alias("toks")), sql("SELECT id, array_to_string(made, ' ') AS toks FROM e"))
add("trans_len_range", lambda spark, d: profiled(spark, d).select("id", F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len")), sql("SELECT id, CAST(min(len(made)) AS BIGINT) AS min_len, CAST(max(len(made)) AS BIGINT) AS max_len FROM e GROUP BY id"))
add("est_num_trans", lambda spark, d: profiled(spark, d).select("id", "transforms"), sql("SELECT id, count(*) AS transforms FROM ex JOIN recs USING (id) WHERE done = len(toks) GROUP BY id"))
add("skipped_records", lambda spark, d: rewrite.skipped(matched(spark, d), 5), sql("SELECT id FROM ex JOIN recs USING (id) WHERE done = len(toks) GROUP BY id HAVING count(*) > 5"))
add("available_tokens", lambda spark, d: rewrite.available_tokens(matched(spark, d)).select("id", F.col("pos").cast("long").alias("pos"), "token"), sql("SELECT DISTINCT id, unnest(range(lo + i - 1, hi + i)) AS pos, token FROM (SELECT m.id, lo, hi, unnest(rhs) AS token, generate_subscripts(rhs, 1) AS i FROM m JOIN (SELECT id, done, min(len(made)) AS lo, max(len(made)) AS hi FROM ex GROUP BY ALL) x ON x.id = m.id AND x.done = m.start)"))
add("set_expansion", lambda spark, d: rewrite.set_expansions(matched(spark, d, "kinds")).select("id", joined("toks").alias("toks")), sql(""", own AS (SELECT DISTINCT m.id, m.rhs FROM m JOIN recs USING (id) WHERE NOT list_has_all(toks, m.rhs)), numbered AS (SELECT id, rhs, row_number() OVER (PARTITION BY id ORDER BY rhs) AS k, count(*) OVER (PARTITION BY id) AS c FROM own),
sx AS (SELECT id, CAST(0 AS BIGINT) AS k, list_sort(list_distinct(toks)) AS s FROM recs UNION ALL SELECT sx.id, sx.k + 1, CASE WHEN y THEN list_sort(list_distinct(sx.s || n.rhs)) ELSE sx.s END FROM sx JOIN numbered n ON n.id = sx.id AND n.k = sx.k + 1, (VALUES (true), (false)) AS c(y))
SELECT DISTINCT id, array_to_string(s, ' ') AS toks FROM sx WHERE k = coalesce((SELECT max(c) FROM numbered n WHERE n.id = sx.id), 0)""", "kinds"))
add_items("set_expansion", lambda spark, d, kind: rewrite.set_expansions(matched(spark, d, kind)).select("id", joined("toks").alias("toks")))
add("full_set", lambda spark, d: rewrite.full_set(matched(spark, d)).select("id", F.size("full").cast("long").alias("n"), joined(F.array_sort("full")).alias("full")), sql('SELECT id, CAST(len(f) AS BIGINT) AS n, array_to_string(f, \' \') AS "full" FROM (SELECT id, list_sort(list_distinct(flatten(list(rhs)))) AS f FROM m GROUP BY id)'))
add("random_transform", lambda spark, d: rewrite.random_transform(matched(spark, d)).select("id", joined("toks").alias("toks")))

# q-grams
PADDED = "list_concat({}, ['\u0001', '\u0001', '\u0001'])"
_show = lambda df: df.select("id", F.col("pos").cast("long").alias("pos"), F.regexp_replace(joined("gram"), arrays.PAD.replace("$", r"\$"), "\u0001").alias("gram"))
PQ2 = f"SELECT id, i - 1 AS pos, ({PADDED.format('toks')})[i:i + 1] AS gram FROM (SELECT id, toks, unnest(range(1, len(toks) + 1)) AS i FROM recs)"
CHAIN = """, chain AS (
  SELECT id, start, i - 1 AS i, start + n AS done, rhs[i:i + 1] AS gram FROM (SELECT *, unnest(range(1, len(rhs) + 1)) AS i FROM m)
  UNION ALL SELECT c.id, c.start, c.i, c.done + m.n, (list_concat(c.gram, m.rhs))[1:2] FROM chain c JOIN m ON m.id = c.id AND m.start = c.done WHERE len(c.gram) < 2),
pre AS (SELECT id, done, min(len(made)) AS lo, max(len(made)) AS hi FROM ex GROUP BY ALL),
ranges AS (SELECT DISTINCT c.id, lo + i AS low, hi + i AS high, CASE WHEN len(gram) = 1 THEN list_concat(gram, ['\u0001']) ELSE gram END AS gram FROM chain c JOIN pre ON pre.id = c.id AND pre.done = c.start JOIN recs r ON r.id = c.id WHERE len(gram) = 2 OR c.done = len(r.toks)),
stpq AS (SELECT DISTINCT id, unnest(range(low, high + 1)) AS pos, gram FROM ranges)"""
TPQ = f"SELECT DISTINCT id, i - 1 AS pos, ({PADDED.format('made')})[i:i + 1] AS gram FROM (SELECT id, made, unnest(range(1, len(made) + 1)) AS i FROM e)"
add("pq_grams", lambda spark, d: _show(qgrams.pq(records(spark, d), 2)), sql(f"SELECT id, pos, array_to_string(gram, ' ') AS gram FROM ({PQ2})"))
add("tpq_grams", lambda spark, d: _show(qgrams.tpq(matched(spark, d), 2)), sql(f"SELECT id, pos, array_to_string(gram, ' ') AS gram FROM ({TPQ})"))
add("stpq_grams", lambda spark, d: _show(qgrams.stpq(matched(spark, d), 2)), sql(CHAIN + "SELECT id, pos, array_to_string(gram, ' ') AS gram FROM stpq"))
add("stpq_grams_first", lambda spark, d: _show(qgrams.stpq(matched(spark, d), 2, 2)), sql(CHAIN + "SELECT id, pos, array_to_string(gram, ' ') AS gram FROM stpq WHERE pos < 2"))
add("stpq_gram_counts", lambda spark, d: qgrams.gram_counts(qgrams.stpq(matched(spark, d), 2)).select(F.col("pos").cast("long").alias("pos"), F.regexp_replace(joined("gram"), arrays.PAD.replace("$", r"\$"), "\u0001").alias("gram"), "n"), sql(CHAIN + "SELECT pos, array_to_string(gram, ' ') AS gram, count(*) AS n FROM stpq GROUP BY ALL"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    m = qgrams.merged_ranges(qgrams.stpq_ranges(matched(spark, d), 2))
    return m.select("id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.regexp_replace(joined("gram"), arrays.PAD.replace("$", r"\$"), "\u0001").alias("gram"))


add("stpq_ranges", _merged, sql(CHAIN + ", runs AS (SELECT id, gram, pos, pos - row_number() OVER (PARTITION BY id, gram ORDER BY pos) AS k FROM stpq) SELECT id, array_to_string(gram, ' ') AS gram, min(pos) AS low, max(pos) AS high FROM runs GROUP BY id, gram, k"))
add("gram_superset", lambda spark, d: quality.gram_superset(matched(spark, d), 2), sql(CHAIN + f", tpq AS ({TPQ}) SELECT (SELECT count(*) FROM tpq) AS tpq, (SELECT count(*) FROM stpq) AS stpq, (SELECT count(*) FROM (SELECT id, pos, gram FROM stpq EXCEPT SELECT id, pos, gram FROM tpq)) AS false_grams"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    v = qgrams.variants(qgrams.pq(records(spark, d), 3), 2, 1)
    return v.select("id", F.col("pos").cast("long").alias("pos"), F.regexp_replace(joined("gram"), arrays.PAD.replace("$", r"\$"), "\u0001").alias("gram"), F.col("delta").cast("long").alias("delta"))


add("delta_variants", _variants, sql(f""", w AS (SELECT id, i - 1 AS pos, ({PADDED.format('toks')})[i:i + 2] AS g FROM (SELECT id, toks, unnest(range(1, len(toks) + 1)) AS i FROM recs))
SELECT DISTINCT id, pos, a || ' ' || b AS gram, delta FROM (SELECT id, pos, g[1] AS a, g[2] AS b, CAST(0 AS BIGINT) AS delta, '' AS gap FROM w UNION ALL SELECT id, pos, g[1], g[3], 1, g[2] FROM w UNION ALL SELECT id, pos, g[2], g[3], 1, g[1] FROM w) WHERE a <> '\u0001' AND gap <> '\u0001'"""))

# orders and choices
add("token_rank", lambda spark, d: orders.frequency_first(matched(spark, d)), sql("SELECT token, n, rank FROM rank"))
add("position_first", lambda spark, d: orders.position_first(records(spark, d), matched(spark, d)).select("id", F.col("pos").cast("long").alias("pos"), "token", "place"), sql("SELECT id, i - 1 AS pos, token, row_number() OVER (PARTITION BY id ORDER BY i) AS place FROM (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM recs)"))
add("best_k_positions", lambda spark, d: orders.best_positions(qgrams.pq(records(spark, d), 2), qgrams.gram_counts(qgrams.stpq(matched(spark, d), 2)), 2).select("id", F.col("pos").cast("long").alias("pos"), F.regexp_replace(joined("gram"), arrays.PAD.replace("$", r"\$"), "\u0001").alias("gram"), "n"), sql(CHAIN + f", c AS (SELECT pos, gram, count(*) AS n FROM stpq GROUP BY ALL) SELECT id, pos, array_to_string(gram, ' ') AS gram, n FROM (SELECT p.id, p.pos, p.gram, coalesce(c.n, 0) AS n, row_number() OVER (PARTITION BY p.id ORDER BY coalesce(c.n, 0), p.pos) AS k FROM ({PQ2}) p LEFT JOIN c ON c.pos = p.pos AND c.gram = p.gram) WHERE k <= 2"))
PLACED = "placed AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY rank) AS place, count(*) OVER (PARTITION BY id) AS n_set FROM (SELECT DISTINCT id, unnest(toks) AS token FROM recs) JOIN rank USING (token))"
add("rarest_tokens", lambda spark, d: orders.rarest(records(spark, d), orders.rhs_counts(matched(spark, d)), 2).select("id", "token", "place"), sql(f", {PLACED} SELECT id, token, place FROM placed WHERE place <= 2"))
add("prefix_signature", lambda spark, d: orders.rarest(records(spark, d), orders.rhs_counts(matched(spark, d)), orders.prefix_size(0.5)).select("id", "token", "place"), sql(f", {PLACED} SELECT id, token, place FROM placed WHERE place <= floor(0.5 * n_set) + 1"))
add("sig_membership", lambda spark, d: joins.least_token_signatures(matched(spark, d), orders.rhs_counts(matched(spark, d))).select(F.col("id1").alias("id"), "token"), sql("SELECT DISTINCT id, token FROM (SELECT id, made, token, row_number() OVER (PARTITION BY id, made ORDER BY rank) AS k FROM (SELECT id, made, unnest(made) AS token FROM e) JOIN rank USING (token)) WHERE k = 1"))
add("sig_prefix", lambda spark, d: joins.prefix_signatures(matched(spark, d), orders.rhs_counts(matched(spark, d)), 2).select(F.col("id1").alias("id"), "token"), sql("SELECT DISTINCT id, token FROM (SELECT id, made, token, rank() OVER (PARTITION BY id, made ORDER BY rank) AS k FROM (SELECT id, made, unnest(made) AS token FROM e) JOIN rank USING (token)) WHERE k <= 2"))
add("si_candidates", lambda spark, d: joins.si_candidates(profiled(spark, d, "kinds"), records(spark, d, "kinds")), sql(""", sig AS (SELECT DISTINCT id, token FROM (SELECT id, token, row_number() OVER (PARTITION BY id, made ORDER BY rank) AS k FROM (SELECT id, made, unnest(made) AS token FROM e) JOIN rank USING (token)) WHERE k = 1),
own AS (SELECT id, token FROM (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM (SELECT DISTINCT id, unnest(toks) AS token FROM recs) JOIN rank USING (token)) WHERE k = 1), lens AS (SELECT id, min(len(made)) AS lo, max(len(made)) AS hi FROM e GROUP BY id)
SELECT DISTINCT s.id AS id1, o.id AS id2 FROM sig s JOIN own o USING (token) JOIN lens l ON l.id = s.id JOIN recs r ON r.id = o.id WHERE len(r.toks) BETWEEN lo AND hi""", "kinds"))
add("length_filter", lambda spark, d: joins.pairs_by_length(profiled(spark, d, "kinds"), records(spark, d, "kinds")), sql(", lens AS (SELECT id, min(len(made)) AS lo, max(len(made)) AS hi FROM e GROUP BY id) SELECT l.id AS id1, r.id AS id2 FROM lens l JOIN recs r ON len(r.toks) BETWEEN lo AND hi", "kinds"))
add_items("si_candidates", lambda spark, d, kind: joins.si_candidates(profiled(spark, d, kind), records(spark, d, kind)), False)
add_items("length_filter", lambda spark, d, kind: joins.pairs_by_length(profiled(spark, d, kind), records(spark, d, kind)), False)

# joins
for _name, _key, _params in (
    ("join_naive", "JoinNaive", {}), ("join_mh", "JoinMH", {"k": 2}), ("join_mh_tpq", "JoinMH", {"use_stpq": False}), ("join_mh_all_pairs", "JoinMH", {"use_pqf": False}), ("join_min", "JoinMin", {"k": 2}), ("join_min_fast", "JoinMinFast", {"sample": 0.2}),
    ("join_hybrid_all", "JoinHybridAll", {"sample_plan": 0.2}), ("join_si", "SIJoin", {}), ("join_pkduck", "JoinPkduck", {}), ("join_pkduck_pf", "JoinPkduck", {"order": "PF"}), ("join_pkduck_naive", "JoinPkduck", {"check": "naive", "rc": True}), ("pass_join", "PassJoin", {}),
):
    add(_name, _self_join(_key, **_params), sql(SEQUENCE))
for _name, _key, _params in (("join_set_naive", "JoinSetNaive", {}), ("join_pkduck_set", "JoinPkduckSet", {}), ("join_pkduck_set_naive", "JoinPkduckSet", {"check": "naive"}), ("join_bkp_set", "JoinBKPSet", {"k": 2})):
    add(_name, _self_join(_key, **_params), sql(SET))
for _dist in ("edit", "lcs"):
    for _name, _key, _params in (
        ("delta_naive", "JoinDeltaNaive", {}), ("delta_simple", "JoinDeltaSimple", {}), ("delta_var", "JoinDeltaVar", {"k": 2}), ("delta_var_bk", "JoinDeltaVarBK", {"k": 2}), ("delta_pqvpq", "JoinDeltaPQVPQ", {}), ("delta_hybrid", "JoinDeltaHybrid", {"sample_plan": 0.2}),
        ("delta_all_pairs", "JoinDeltaVar", {"use_pqf": False}), ("pass_join", "PassJoin", {}),
    ):
        kind = "kinds" if _name == "delta_all_pairs" else "items"
        add(f"{_name}_{_dist}", _self_join(_key, kind, delta=1, dist=_dist, **_params), sql(DELTA[_dist], kind))
    add_items(f"delta_all_pairs_{_dist}", lambda spark, d, kind, x=_dist: _self_join("JoinDeltaVar", kind, delta=1, dist=x, use_pqf=False)(spark, d))
for _name, _key, _params in (("join_pkduck_greedy", "JoinPkduck", {"check": "greedy"}), ("join_pkduck_set_greedy", "JoinPkduckSet", {"check": "greedy"}), ("join_bkp_set_beam", "JoinBKPSet", {"check": "beam", "beam": 3}), ("join_bkp_set_greedy", "JoinBKPSet", {"check": "MIT_GR"}), ("join_jaccard_replace", "JoinPkduckOriginal", {"theta": 0.6}), ("join_jaccard_expand", "SIJoinOriginal", {"theta": 0.6})):
    add(_name, _self_join(_key, **_params))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return joins.pass_join_plain(records(spark, d), 1, "lcs")


add("pass_join_plain", _plain, sql("SELECT id AS id1, id AS id2 FROM recs UNION " + SELF.format(f"SELECT d.id AS a, r.id AS b FROM {DROPS.format('toks', 'recs')} d JOIN recs r ON d.less = r.toks")))


def _every_pair(m: DataFrame, r: DataFrame) -> DataFrame:
    """All pairs of records, for the verifiers alone; no length is left out."""
    longest = max(r.agg(F.max(F.size("toks"))).first()[0] or 0, m.agg(F.max("max_len")).first()[0] or 0)
    return joins.pairs_by_length(m, r, int(longest))


def _jaccard_exact(spark: SparkSession, d: str, kind: str = "kinds") -> DataFrame:
    m = profiled(spark, d, kind)
    return joins.jaccard_expand(m, m, 0.6, "jaccard_exact").filter("id1 <= id2")


def _jaccard_full(spark: SparkSession, d: str, kind: str = "kinds") -> DataFrame:
    m = profiled(spark, d, kind)
    return verify(_every_pair(m, records(spark, d, kind)), m, m, "jaccard_full", theta=0.6).filter("id1 <= id2")


SETS = _sql["set_expansion"].rsplit("SELECT DISTINCT id,", 1)
add("jaccard_expand_exact", _jaccard_exact, SETS[0] + ", sets AS (SELECT DISTINCT id, s" + SETS[1].replace("array_to_string(s, ' ') AS toks ", "") + ") SELECT DISTINCT a.id AS id1, b.id AS id2 FROM sets a JOIN sets b ON a.id <= b.id WHERE len(list_intersect(a.s, b.s)) >= 0.6 * len(list_distinct(a.s || b.s)) - 1e-9")
add("jaccard_expand_full", _jaccard_full, sql(", f AS (SELECT id, list_distinct(flatten(list(rhs))) AS s FROM m GROUP BY id) SELECT a.id AS id1, b.id AS id2 FROM f a JOIN f b ON a.id <= b.id WHERE len(list_intersect(a.s, b.s)) >= 0.6 * len(list_distinct(a.s || b.s)) - 1e-9", "kinds"))
add_items("jaccard_expand_exact", _jaccard_exact, False)
add_items("jaccard_expand_full", _jaccard_full, False)
add("join_two_tables_one_side", lambda spark, d: registry.run("JoinNaive", JoinSpec(records(spark, d), records(spark, d, "shelf"), rules(spark), one_side=True, params=Params())), sql("SELECT DISTINCT e.id AS id1, r.id AS id2 FROM e JOIN recs2 r ON e.made = r.toks", other="shelf"))


def _two_tables(name: str, **params) -> Query:
    return lambda spark, d: registry.run(name, JoinSpec(records(spark, d), records(spark, d, "shelf"), rules(spark), params=Params(**params)))


_OTHER = ", grams2 AS (SELECT id, i - 1 AS start, w AS n, toks[i:i + w - 1] AS lhs FROM (SELECT id, toks, unnest(range(1, len(toks) + 1)) AS i FROM recs2), (VALUES (1), (2), (3)) AS s(w) WHERE i + w - 1 <= len(toks)), own2 AS (SELECT lhs, rhs FROM rules UNION SELECT [t], [t] FROM (SELECT DISTINCT unnest(toks) AS t FROM recs2)), m2 AS (SELECT DISTINCT id, start, n, rhs FROM grams2 JOIN own2 USING (lhs)), ex2 AS (SELECT id, CAST(0 AS BIGINT) AS done, CAST([] AS VARCHAR[]) AS made FROM recs2 UNION ALL SELECT ex2.id, ex2.done + m2.n, list_concat(ex2.made, m2.rhs) FROM ex2 JOIN m2 ON m2.id = ex2.id AND m2.start = ex2.done), e2 AS (SELECT DISTINCT id, made FROM ex2 JOIN recs2 USING (id) WHERE done = len(toks))"
BOTH = sql(_OTHER + " SELECT e.id AS id1, r.id AS id2 FROM e JOIN recs2 r ON e.made = r.toks UNION SELECT r.id, e2.id FROM e2 JOIN recs r ON e2.made = r.toks", other="shelf")
add("join_two_tables", _two_tables("JoinMin"), BOTH)
add("join_two_tables_signature", _two_tables("SIJoin"), BOTH)


def _both_sides(spark: SparkSession, d: str, kind: str = "kinds") -> DataFrame:
    m = profiled(spark, d, kind)
    return verify(_every_pair(m, records(spark, d, kind)), m, m, "both")


def _both_expanded(spark: SparkSession, d: str) -> DataFrame:
    x = rewrite.expand(matched(spark, d))
    return x.select(F.col("id").alias("id1"), "toks").join(x.select(F.col("id").alias("id2"), "toks"), "toks").select("id1", "id2").distinct()


add("verify_both_sides", _both_sides, sql("SELECT DISTINCT a.id AS id1, b.id AS id2 FROM e a JOIN e b ON a.made = b.made", "kinds"))
add("join_both_sides", _both_expanded, sql("SELECT DISTINCT a.id AS id1, b.id AS id2 FROM e a JOIN e b ON a.made = b.made"))
for _name in ("sequence", "sequence_naive", "same", "set", "set_naive"):
    add(
        f"verify_{_name}",
        lambda spark, d, n=_name: verify(_every_pair(profiled(spark, d, "kinds"), records(spark, d, "kinds")), matched(spark, d, "kinds"), records(spark, d, "kinds"), n),
        sql({"same": "SELECT id AS id1, id AS id2 FROM recs"}.get(_name) or "SELECT DISTINCT e.id AS id1, r.id AS id2 FROM e JOIN recs r ON " + ("list_sort(list_distinct(e.made)) = list_sort(list_distinct(r.toks))" if "set" in _name else "e.made = r.toks"), "kinds"),
    )
for _name in ("delta", "delta_naive"):
    add(f"verify_{_name}", lambda spark, d, n=_name: verify(_every_pair(profiled(spark, d, "kinds"), records(spark, d, "kinds")), matched(spark, d, "kinds"), records(spark, d, "kinds"), n, delta=1, dist="edit"), sql(f"SELECT DISTINCT a AS id1, b AS id2 FROM ({EDIT1})", "kinds"))

_verified = lambda spark, d, kind, n, **options: verify(_every_pair(profiled(spark, d, kind), records(spark, d, kind)), matched(spark, d, kind), records(spark, d, kind), n, **options)
add_items("verify_both_sides", _both_sides)
for _name in ("sequence", "sequence_naive", "same", "set", "set_naive"):
    add_items(f"verify_{_name}", lambda spark, d, kind, n=_name: _verified(spark, d, kind, n))
for _name in ("delta", "delta_naive"):
    add_items(f"verify_{_name}", lambda spark, d, kind, n=_name: _verified(spark, d, kind, n, delta=1, dist="edit"))


# evaluation, statistics, planning, generation
def _quality(spark: SparkSession, d: str, kind: str = "kinds") -> DataFrame:
    found = _self_join("JoinNaive", kind)(spark, d)
    truth = _self_join("JoinDeltaNaive", kind, delta=1, dist="lcs")(spark, d).filter("id1 <> id2")
    return quality.scores(*quality.confusion(found, truth, self_join=True))


add("quality_prf1", _quality, sql(f""", found AS ({SEQUENCE}), truth AS (SELECT * FROM ({DELTA['lcs']}) WHERE id1 <> id2),
n AS (SELECT (SELECT count(*) FROM found JOIN truth USING (id1, id2)) AS tp, (SELECT count(*) FROM truth ANTI JOIN found USING (id1, id2)) AS fn, (SELECT count(*) FROM found ANTI JOIN truth USING (id1, id2) WHERE id1 <> id2) AS fp)
SELECT tp, fn, fp, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM n)""", "kinds"))
add_items("quality_prf1", _quality)
add("filter_power", lambda spark, d: quality.filter_power(profiled(spark, d), records(spark, d)))
add("dataset_stats", lambda spark, d: statistics.dataset(records(spark, d)), sql("SELECT count(*) AS records, CAST(sum(len(toks)) AS BIGINT) AS tokens, avg(len(toks)) AS avg_len, max(len(toks)) AS max_len, (SELECT count(DISTINCT t) FROM (SELECT unnest(toks) AS t FROM recs)) AS distinct_tokens FROM recs"))
add("characteristics", lambda spark, d: statistics.characteristics(profiled(spark, d)), sql(""", x AS (SELECT id, CAST(len(toks) AS DOUBLE) AS length, (SELECT CAST(count(*) AS DOUBLE) FROM m WHERE m.id = recs.id AND lhs <> rhs) AS rules, (SELECT CAST(count(*) AS DOUBLE) FROM ex WHERE ex.id = recs.id AND done = len(toks)) AS transforms FROM recs)
SELECT what, min(v) AS least, avg(v) AS mean, max(v) AS most, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90 FROM (SELECT 'length' AS what, length AS v FROM x UNION ALL SELECT 'rules', rules FROM x UNION ALL SELECT 'transforms', transforms FROM x) GROUP BY what"""))
add("token_frequency", lambda spark, d: statistics.token_frequency(records(spark, d)), sql("SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM recs) GROUP BY token"))
add("transforms_histogram", lambda spark, d: statistics.transforms_distribution(profiled(spark, d)), sql("SELECT CAST(floor(log10(c)) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT id, count(*) AS c FROM ex JOIN recs USING (id) WHERE done = len(toks) GROUP BY id) GROUP BY 1"))
add("sweep", lambda spark, d: sweep.run(spark, JoinSpec.of_self(records(spark, d, "kinds"), rules(spark)), {"JoinNaive": [{}], "JoinMH": [{"k": k, "q": q} for k in (1, 2) for q in (1, 2)]}), sql(f", n AS (SELECT count(*) AS pairs FROM ({SEQUENCE})) SELECT strategy, parameters, pairs FROM n, (VALUES ('JoinNaive', '{{}}'), ('JoinMH', '{{\"k\": 1, \"q\": 1}}'), ('JoinMH', '{{\"k\": 1, \"q\": 2}}'), ('JoinMH', '{{\"k\": 2, \"q\": 1}}'), ('JoinMH', '{{\"k\": 2, \"q\": 2}}')) AS v(strategy, parameters)", "kinds"))
add_items("sweep", lambda spark, d, kind: sweep.run(spark, JoinSpec.of_self(records(spark, d, kind), rules(spark)), {"JoinNaive": [{}], "JoinMH": [{"k": k, "q": q} for k in (1, 2) for q in (1, 2)]}))
add("sample_bernoulli", lambda spark, d: planner.bernoulli(profiled(spark, d), 0.2, 7).select("id", "transforms"))
add("sample_stratified", lambda spark, d: planner.stratified(profiled(spark, d), 0.2, 7).select("id", "transforms"))
add("sample_stratified_log", lambda spark, d: planner.stratified_log(profiled(spark, d), 0.2, 7).select("id", "transforms"))
add("plan_costs", lambda spark, d: planner.thresholds(planner.costs(profiled(spark, d), records(spark, d), 2, 1, 1.0, 7)))
add("perturbed", lambda spark, d: generate.perturbed(matched(spark, d)).select("id", "kind", joined("toks").alias("toks")))
add("synthetic", lambda spark, d: generate.records(spark, 2000, 500, rule_sides=[a.split() for a, _ in RULES], rules_per_record=1.0, equivalent=0.1).select("id", "raw"))
add("synthetic_rules", lambda spark, d: generate.rules(spark, 500, 300).select("rule_id", joined("lhs").alias("lhs"), joined("rhs").alias("rhs")))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
