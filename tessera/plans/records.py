"""Records, errors and actions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import actions as A
from ..operators import nested as J
from ..operators import patterns as P
from ..operators import records as G
from ..operators import tokens as K
from .registry import query, table

_SCHEMA = {"type": "object", "properties": {"event_type": {"enum": ["click", "view", "error", "purchase", "login"]}, "value": {"type": "number", "minimum": 1, "maximum": 40}, "user_id": {"type": "integer", "maximum": 100}}, "required": ["event_type", "value"]}
_ERRORS = """CASE WHEN event_id % 50 = 0 THEN 'Invalid JSON' WHEN event_type NOT IN ('click', 'view', 'error', 'purchase', 'login') THEN 'enum'
 WHEN value < 1 THEN 'minimum' WHEN value > 40 THEN 'maximum' WHEN user_id > 100 THEN 'maximum' END"""


def _validated(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    raw = e.withColumn("line", F.concat(G.serialized(e, exclude=("event_id",)), F.when(F.col("event_id") % 50 == 0, "").otherwise("")))
    raw = raw.withColumn("line", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{oops "), F.col("line"))).otherwise(F.col("line")))
    return G.responses(raw, "event_id", "line", _SCHEMA)


@query(f"SELECT coalesce({_ERRORS}, 'valid') AS outcome, count(*) AS n FROM events GROUP BY 1")
def jsonl_roundtrip_validate(spark, sf):
    return _validated(spark, sf).groupBy(F.coalesce("error_kind", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH e AS (SELECT {_ERRORS} AS kind, CASE WHEN event_id % 50 = 0 THEN 'the record is not JSON' WHEN event_type NOT IN ('click', 'view', 'error', 'purchase', 'login') THEN 'event_type: is not one of the values'
 WHEN value < 1 THEN 'value: minimum is 1' WHEN value > 40 THEN 'value: maximum is 40' WHEN user_id > 100 THEN 'user_id: maximum is 100' END AS message FROM events)
SELECT message AS error_message, kind AS error_kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e WHERE kind IS NOT NULL GROUP BY 1, 2
""")
def error_statistics(spark, sf):
    bad = _validated(spark, sf).filter(~F.col("is_valid"))
    return G.error_statistics(bad, "error_message", "error_kind").withColumn("share", F.round("share", 6))


@query("""
WITH c AS (SELECT conv_id, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p, role FROM conversations)
SELECT conv_id, count(*) AS n, CASE WHEN count(DISTINCT role) > 1 THEN 'groupby' WHEN bool_or(coalesce(p > n, false)) THEN 'order' END AS error FROM c GROUP BY 1
""")
def grouped_record_validation(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    line = G.serialized(c, ["role", "n"])
    rows = c.withColumn("line", line).groupBy("conv_id").agg(F.concat(F.lit("<s>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n"), F.lit("</s>")).alias("text"))
    schema = {"properties": {"role": {"type": "string"}, "n": {"type": "integer"}}, "required": ["role", "n"]}
    return G.grouped_responses(rows, "conv_id", "text", schema, "role", "n").select("conv_id", "n", "error")


@query("""SELECT event_id, '$.k' AS path, 'k' AS field, json_extract_string(props, '$.k') AS "value" FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def flatten_json_paths(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.inline(G.flattened(F.col("props"))))
    return e.select("event_id", "path", "field", "value")


@query("""
WITH t AS (SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS s FROM customer)
SELECT c_custkey, CAST(ceil(length(regexp_replace(s, '[0-9]', '', 'g')) / 4 + length(s) - length(regexp_replace(s, '[0-9]', '', 'g'))) AS BIGINT) AS tokens FROM t
""")
def token_estimate(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", G.estimated_tokens([F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")]).alias("tokens"))


@query("""
SELECT CASE WHEN o_totalprice > 400000 THEN 'expression_drop' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'categorical'
  WHEN NOT o_orderdate >= TIMESTAMP '1996-01-01' THEN 'date_constraint' END AS reject_reason, count(*) AS n FROM orders GROUP BY 1
""")
def data_action_validation(spark, sf):
    o = table(spark, sf, "orders").withColumn("floor", F.lit("1996-01-01"))
    rules = [A.DropWhere(("o_totalprice > 400000",)), A.Categorical("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")), A.DateConstraint("o_orderdate", "ge", "floor")]
    return A.validated(o, rules).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round(p_retailprice * 2, 4) AS twice, p_size FROM part")
def data_action_generation(spark, sf):
    rules = [A.Expression("twice", "round(p_retailprice * 2, 4)"), A.Regenerated("p_size", "p_size_kept", 2)]
    p = table(spark, sf, "part").withColumn("p_size_kept", F.col("p_size"))
    return A.finished(A.generated(A.prepared(p, rules), rules), rules).select("p_partkey", "twice", "p_size")


@query("""
SELECT o_orderkey, o_totalprice - o_orderkey AS less, o_orderkey + 1 AS o_next, true AS fits, true AS named FROM orders
""")
def derived_columns(spark, sf):
    """Both new columns see the old ones; times lie between the bounds and on whole hours; equal keys have equal stand-ins."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 5).alias("who"))
    rules = [A.Derived((("less", "o_totalprice - o_orderkey"), ("o_next", "o_orderkey + 1"))), A.SampledTimes("t", 1_700_000_000, 1_700_086_400, "gaussian", "hour"), A.StandIn("name", "name", "who"), A.StandIn("again", "name", "who")]
    made = A.generated(o, rules)
    at = F.unix_timestamp("t")
    fits = (at >= 1_700_000_000 - 3600) & (at <= 1_700_086_400) & (at % 3600 == 0)
    return made.select("o_orderkey", "less", "o_next", fits.alias("fits"), (F.col("name") == F.col("again")).alias("named"))


@query("""
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, turn FROM conversations), s AS (SELECT conv_id, k, CASE WHEN conv_id % 3 = 0 AND k >= 2 THEN 60 * k + 1 ELSE 60 * k END AS t FROM r),
b AS (SELECT conv_id, k, coalesce(t - lag(t) OVER w <> 60, false) AS bad FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
e AS (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM b)
SELECT conv_id, count(*) AS n, count(*) FILTER (NOT bad AND NOT earlier) AS n_valid, count(*) FILTER (bad OR earlier) AS late FROM e GROUP BY 1
""")
def timed_record_validation(spark, sf):
    by = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(by) - 1).alias("k"))
    at = 60 * F.col("k") + F.when((F.col("conv_id") % 3 == 0) & (F.col("k") >= 2), 1).otherwise(0)
    lines = c.withColumn("line", F.concat(F.lit('{"t": '), at, F.lit("}"))).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))
    found = G.timed_responses(lines, "conv_id", "text", {"properties": {"t": {"type": "integer"}}, "required": ["t"]}, "t", "elapsed_seconds", 60)
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"), F.count_if(F.col("error_kind") == "interval").alias("late"))


_ORDER = {"properties": {"k": {"type": "integer", "minimum": 37, "maximum": 41873}, "c": {"type": "integer", "minimum": -12, "maximum": 768}, "s": {"enum": ["O", "F"]}, "p": {"type": "string", "minLength": 5, "maxLength": 9}}, "required": ["k", "s"]}


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey - 50 AS k, o_custkey - 20 AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey, k BETWEEN 37 AND 41873 AND (o_orderkey % 3 = 0 OR c BETWEEN -12 AND 768) AND s IN ('O', 'F') AND (o_orderkey % 5 = 0 OR length(p) BETWEEN 5 AND 9) AS fits, true AS agrees FROM o
""")
def schema_pattern_rows(spark, sf):
    """Records checked by one pattern; some lack members that need not be there.  agrees: the rules, one by one, say the same."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") - 50).alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") - 20).alias("c"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"))
    lines = o.select("o_orderkey", F.to_json(F.struct("k", "c", "s", "p")).alias("line"))
    fits = F.col("line").rlike(f"^(?:{P.records_pattern(_ORDER, single=True)})$")
    return G.validated(lines.withColumn("fits", fits), "line", _ORDER).select("o_orderkey", "fits", (F.col("fits") == F.col("is_valid")).alias("agrees"))


@query("""
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN 'late' ELSE event_type END AS kind, user_id AS id, CASE WHEN event_id % 3 = 0 THEN round(value) END AS amount, event_id % 4 <> 0 AS has_whole
FROM events
""")
def merged_properties(spark, sf):
    """Properties with what a second record says of the same event: inner members are merged, and on a clash of types the second wins."""
    e = table(spark, sf, "events")
    who = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("id"))
    base = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "a": '), F.to_json(F.struct(who.alias("who"))), F.lit(', "whole": {"x": [1]}}'))
    late = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(F.struct(F.lit("late").alias("kind"), F.round("value").alias("amount")).alias("who")).alias("a"))))
    new = F.when(F.col("event_id") % 4 == 0, F.lit('{"whole": 5}'))
    merged = J.merged_json(F.to_json(J.merged_json(base, late)), new)
    at = lambda path, kind: F.try_variant_get(merged, path, kind)
    return e.select("event_id", at("$.k", "long").alias("k"), at("$.a.who.kind", "string").alias("kind"), at("$.a.who.id", "long").alias("id"), at("$.a.who.amount", "double").alias("amount"), at("$.whole.x[0]", "long").isNotNull().alias("has_whole"))


@query("""
WITH w AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, turn, CAST(least(n, 20) AS INT) AS n_tokens, n <= 20 AS fits FROM w
""")
def budgeted_tokens(spark, sf):
    c = K.tokenized(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")
    return K.within_budget(c, "input_ids", 32, 8, "cut").select("conv_id", "turn", "n_tokens", "fits")
