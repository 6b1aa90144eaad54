"""The SQL surface: tables as views, and scalar and table functions defined in SQL, so that a query can price and bucket without Python.

All names carry a prefix. Functions are temporary: they live as long as the session. The optimizer inlines them, so they cost
what their text costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionledger.functions.pricing import DEFAULT_FAMILY, FAMILIES, RATES


def _rates(slot: int) -> str:
    return "CASE " + " ".join(f"WHEN family = '{r[0]}' AND context > {r[3]} AND context <= {r[4]} THEN {float(r[slot])!r}D" for r in RATES) + " END"


def _family() -> str:
    rules = " ".join("WHEN " + " OR ".join(f"m LIKE '%{p}%'" for p in patterns) + f" THEN '{family}'" for family, patterns in FAMILIES)
    return rules.replace("m LIKE", "translate(lower(trim(model)), '_ ', '--') LIKE")


def definitions(prefix: str) -> list[str]:
    """Statements that create the functions; later ones use earlier ones."""
    p = prefix
    return [
        f"{p}price_family(model STRING) RETURNS STRING RETURN CASE {_family()} ELSE '{DEFAULT_FAMILY}' END",
        f"{p}unit_rate(kind STRING, family STRING, context BIGINT) RETURNS DOUBLE RETURN CASE kind WHEN 'input' THEN {_rates(5)} WHEN 'cached' THEN {_rates(6)} WHEN 'output' THEN {_rates(7)} END",
        f"{p}token_cost(kind STRING, tokens BIGINT, family STRING, context BIGINT) RETURNS DOUBLE RETURN CASE WHEN tokens > 0 THEN tokens * {p}unit_rate(kind, family, context) / 1000000D ELSE 0D END",
        f"{p}tier_context(input BIGINT, calls BIGINT) RETURNS BIGINT RETURN CASE WHEN calls > 1 THEN input div calls ELSE input END",
        f"{p}bucket_start(ms BIGINT, step BIGINT, start BIGINT) RETURNS BIGINT RETURN start + cast(floor((ms - start) / step) AS BIGINT) * step",
        # units left over go to the largest fractions, ties to earlier places; for the short lists of one round
        f"""{p}largest_remainder(weights ARRAY<DOUBLE>, target BIGINT) RETURNS ARRAY<BIGINT> RETURN
          transform(array(transform(weights, x -> x / aggregate(weights, 0D, (a, y) -> a + y) * target)), shares ->
            transform(array(struct(shares AS s, target - aggregate(shares, 0L, (a, y) -> a + floor(y)) AS left)), t ->
              transform(t.s, (x, i) -> floor(x) + CASE WHEN size(filter(t.s, (y, j) -> y - floor(y) > x - floor(x) OR (y - floor(y) = x - floor(x) AND j < i))) < t.left THEN 1L ELSE 0L END))[0])[0]""",
        f"""{p}priced_turns(since BIGINT, until BIGINT) RETURNS TABLE (session_id BIGINT, event_ms BIGINT, family STRING, tokens_in BIGINT, tokens_cached BIGINT, tokens_out BIGINT, cost_usd DOUBLE) RETURN
          SELECT session_id, agent_ms, family, input - ca, ca, output,
            {p}token_cost('input', input - ca, family, context) + {p}token_cost('cached', ca, family, context) + {p}token_cost('output', output, family, context)
          FROM (SELECT session_id, agent_ms, input, output, least(cached, input) AS ca, {p}price_family(coalesce(model, '')) AS family, {p}tier_context(input, calls) AS context
            FROM {p}turns WHERE agent_ms >= since AND agent_ms < until)""",
        f"""{p}usage_buckets(since BIGINT, until BIGINT, step BIGINT) RETURNS TABLE (bucket_ms BIGINT, turns BIGINT, tokens_in BIGINT, tokens_cached BIGINT, tokens_out BIGINT, cost_usd DOUBLE) RETURN
          SELECT {p}bucket_start(event_ms, step, since), count(*), sum(tokens_in), sum(tokens_cached), sum(tokens_out), sum(cost_usd) FROM {p}priced_turns(since, until) GROUP BY 1""",
    ]


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "ledger_") -> None:
    """Views over ``tables`` (``turns`` is needed) and the functions over them."""
    from sessionledger.sources.store import register_views

    register_views(spark, tables, prefix)
    for text in definitions(prefix):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
