"""Numbers pinned for the reconstruction, the miss classifier and the peel."""

import pytest
from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.operators import allocate as a
from sessionledger.operators import anomaly as an
from sessionledger.operators import peel as pl
from sessionledger.operators import reconstruct as r
from sessionledger.operators.grouping import PlainGroups

c = F.col
G = PlainGroups(["rid"], "call_no")


def calls(spark, starts, off_in, off_cache, off_out, prior=None, reread=None, user=0, system=0, ends=None, **w):
    n = len(starts)
    cols = {k: w.get(k, [0] * n) for k in ("w_thought", "w_enc", "w_emit", "w_message", "w_harness")}
    rows = [(1, i + 1, starts[i], (ends or starts)[i], *[cols[k][i] for k in cols], off_in, off_cache, off_out, prior, reread, user, system, "4.5") for i in range(n)]
    return spark.createDataFrame(rows, "rid long, call_no long, start long, end long, w_thought long, w_enc long, w_emit long, w_message long, w_harness long, "
                                       "off_in long, off_cache long, off_out long, prior long, reread long, user_unc long, system_unc long, family string")


def run(df):
    return sorted(r.reconstruct(df, G).collect(), key=lambda x: x.call_no)


def identities(rows, off_in, off_cache):
    assert sum(x.cache for x in rows) + rows[0].cache_omitted == off_cache
    assert sum(x.paid for x in rows) == off_in - off_cache


def test_warm_round_last_call_shows_no_cache(spark):
    rows = run(calls(spark, [178033, 178637, 178812], 535446, 533760, 511, prior=177511))
    assert rows[-1].cache == 0 and rows[0].cache_omitted > 0
    assert 0 < rows[0].cache < rows[0].cache_omitted + 50_000
    assert sum(x.paid for x in rows) == 1686
    identities(rows, 535446, 533760)


def test_single_warm_call_keeps_its_prefix(spark):
    rows = run(calls(spark, [138014], 138008, 137600, 168, prior=137887))
    assert rows[0].cache > 0 and rows[0].cache_omitted == 0
    identities(rows, 138008, 137600)


def test_cold_round_shares_the_cache(spark):
    rows = run(calls(spark, [5416, 17924, 18969], 52518, 29440, 521, user=1800, system=11300))
    assert [x.cache for x in rows] == [13100, 16340, 0]
    assert rows[0].user_cache_share == 0


def test_output_identity(spark):
    rows = run(calls(spark, [10000, 11000, 12000], 33000, 20000, 900, prior=9000, w_thought=[40] * 3, w_enc=[800, 400, 200]))
    assert sum(x.o_reason + x.o_emit + x.o_message for x in rows) == 900
    assert rows[0].o_reason > rows[1].o_reason > rows[2].o_reason > 0
    assert all(x.thought_usd > 0 for x in rows)
    assert sum(x.thought_usd + x.reason_usd + x.emit_usd + x.message_usd for x in rows) == pytest.approx(sum(x.out_usd for x in rows))


def test_calls_without_sizes_share_the_input_evenly(spark):
    """As in the SQL: a compaction may leave a round whose calls all start at 0."""
    rows = run(calls(spark, [0, 0], 203_971, 155_017, 100, w_harness=[0, 600]))
    assert [x.input for x in rows] == [101_986, 101_985] and [x.tier for x in rows] == ["low", "low"]
    assert sum(x.paid for x in rows) == 48_954 and all(x.paid <= x.input for x in rows)


def test_stream_start_is_the_input(spark):
    df = calls(spark, [10000], 10000, 0, 0).withColumn("context_start", F.lit(999999))
    assert run(df)[0].input == 10000


def test_system_window(spark):
    tree = 4522 + 1563 + 355 + 355 + 0
    df = spark.createDataFrame([(22516, 3741, tree, 3409), (5000, 3741, tree, 4000), (None, 1, 1, 1)], "context_end long, user_in long, calls_in long, history_tokens long")
    rows = r.system_bucket(df).collect()
    assert [x.bucket for x in rows] == [22516 - 3741 - tree - 3409, 0, 0]
    assert rows[0].system_in + rows[0].tree_in == 22516


def test_display_shift(spark):
    df = calls(spark, [20000, 50000, 80000], 150000, 0, 0, prior=19000)
    d = r.round_facts(df, G).withColumns({"raw_start": c("start"), "growth_raw": F.lit(0)})
    rows = sorted(r.display_windows(d, G).collect(), key=lambda x: x.call_no)
    assert [x.shown_start for x in rows] == [50000, 80000, None]
    assert [x.shown_growth for x in rows] == [30000, 30000, 0]
    cold = r.round_facts(calls(spark, [5416, 17924, 18969], 1, 0, 0), G).withColumns({"raw_start": c("start"), "growth_raw": F.lit(0)})
    first = min(r.display_windows(cold, G).collect(), key=lambda x: x.call_no)
    assert (first.shown_start, first.shown_end) == (0, 17924)


def test_misses(spark):
    rows = [("collapsed", 192000, 244535, 203264, 6607, 39805), ("warm", 126000, 438000, 400000, 126800, 163000),
            ("first", 126446, 3802792, 3637888, 126824, 163599), ("classic", 100000, 91000, 1000, 100500, 101000)]
    df = spark.createDataFrame([(n, True, False, off_in, cache, prior, end, start, None) for n, prior, off_in, cache, start, end in rows],
                               "name string, completed boolean, is_first boolean, off_in long, off_cache long, prior long, context_end long, start0 long, idle_gap_ms long")
    got = {x.name: x for x in an.detect_miss(df).collect()}
    assert got["collapsed"].miss_kind is None and got["warm"].miss_kind is None
    assert (got["first"].miss_kind, got["first"].off_unc) == ("first_call_reread", 164904) and got["first"].reread == 126446
    assert (got["classic"].miss_kind, got["classic"].off_unc) == ("classic_cache_miss", 90000)


def test_compaction_is_cached_or_input_never_both(spark):
    df = spark.createDataFrame([(314734, 5942, False, None, "4.5"), (100000, 4000, True, None, "4.5")], "tokens_before long, tokens_after long, prev_missed boolean, reload_tokens long, family string")
    warm, missed = an.compaction_cards(df).collect()
    assert (warm.pre_in_tokens, warm.pre_cached_tokens) == (0, 314734) and (missed.pre_in_tokens, missed.pre_cached_tokens) == (100000, 0)
    assert warm.out_tokens > 0 and missed.out_usd > 0


def test_incremental_peel(spark):
    full = dict(reasoning=0, total=0, ticks=0, api_ms=0)
    def row(line, i, o, ca, n):
        return (1, 2, line, i, o, full["reasoning"], ca, 0, 0, 0, n)
    schema = "session_id long, child_id long, line_no long, input long, output long, reasoning long, cached long, total long, ticks long, api_ms long, calls long"
    waits = spark.createDataFrame([row(1, 1000, 20, 800, 4), row(2, 1000, 20, 800, 4), row(3, 1500, 30, 1000, 6)], schema)
    inc = pl.increments(waits, PlainGroups(["session_id", "child_id"], "line_no")).withColumn("round_no", c("line_no"))
    rounds = spark.createDataFrame([(1, n, 2500, 50, 0, 1800, 0, 0, 0, 10) for n in (1, 2, 3)],
                                   "session_id long, round_no long, input long, output long, reasoning long, cached long, total long, ticks long, api_ms long, calls long")
    got = {x.round_no: (x.input, x.calls) for x in pl.peel_rounds(rounds, inc).collect()}
    assert got == {1: (1500, 6), 2: (2500, 10), 3: (2000, 8)}


def test_prices(spark):
    ids = spark.createDataFrame([("gen-4.6-build",), ("gen-4.5-build",), ("Gen 4.5",), ("gen-4.3",)], "m string")
    assert [x[0] for x in ids.select(p.price_family(c("m"))).collect()] == ["4.6", "4.5", "4.5", None]
    one = spark.range(1).select(p.price_tokens("cached", F.lit(10000), F.lit("4.5"), F.lit(10000)), p.price_tokens("cached", F.lit(10000), F.lit("4.6"), F.lit(10000))).first()
    assert one[0] == pytest.approx(0.003) and one[1] == pytest.approx(0.005)
    t = spark.createDataFrame([(1_000_000, 0, 10, 0, 10, 0, None)], "input long, cached long, output long, reasoning long, calls long, ticks long, model string")
    assert p.price_turns(t).first().tier_ctx == 100_000


def test_even_split_without_weights(spark):
    df = spark.createDataFrame([(1, i, 0) for i in range(3)], "rid long, call_no long, w long")
    assert [x.x for x in sorted(a.split_exact(df, G, "x", c("w"), F.lit(11)).collect(), key=lambda x: x.call_no)] == [4, 4, 3]
