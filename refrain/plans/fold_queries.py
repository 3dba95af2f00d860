"""Registered queries of ordered folds and of detectors made of them, with DuckDB twins that fold lists in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions import kernels
from ..functions.hashing import text_hash
from ..operators import folds, joins, windows
from ..sinks import reports
from ..sources.sequences import doc_frames, emb_frames, evt_frames, table
from ..streaming import rolling
from . import detectors, evaluate
from .queries import CONFIDENCE, DOC, EMB, EVT, UNION_LIST, _rolled, _status, query, r6

TIMINGS = "array<struct<episode_name:string,start_time:double,end_time:double>>"


def _first_fit(source: str, item: str, close: str) -> str:
    """CTEs ``ff`` (series, g, x): each item of ``source`` (series, x) joins the first group whose leader ``l`` is ``close`` to it, ``b.x``."""
    return f"""
fo AS (SELECT series, list(x ORDER BY x) AS xs FROM {source} GROUP BY series),
fr AS (SELECT series, xs, list_reduce(
  list_prepend({{'ls': []::{item}[], 'g': []::BIGINT[], 'x': NULL::{item}}}, list_transform(xs, lambda x: {{'ls': []::{item}[], 'g': []::BIGINT[], 'x': x}})),
  lambda a, b: list_transform([coalesce(list_position(list_transform(a.ls, lambda l: {close}), true), 0)],
    lambda k: {{'ls': CASE WHEN k = 0 THEN list_append(a.ls, b.x) ELSE a.ls END, 'g': list_append(a.g, CASE WHEN k = 0 THEN len(a.ls) + 1 ELSE k END), 'x': b.x}})[1]) AS z FROM fo),
ff AS (SELECT series, unnest(z.g) AS g, unnest(xs) AS x FROM fr)"""


SEG = "STRUCT(s DOUBLE, e DOUBLE, eps VARCHAR[], c DOUBLE)"


def _deduplicated(source: str) -> str:
    """CTE ``dd`` (series, x): INT-4 over ``source`` (series, x)."""
    common, union = "(least(o.e, b.x.e) - greatest(o.s, b.x.s))", "(greatest(o.e, b.x.e) - least(o.s, b.x.s))"
    shared = "len(list_filter(o.eps, lambda y: list_contains(b.x.eps, y))) / least(len(o.eps), len(b.x.eps))"
    old = "a.found[k]"
    merged = f"{{'s': least({old}.s, b.x.s), 'e': greatest({old}.e, b.x.e), 'eps': list_concat({old}.eps, list_filter(b.x.eps, lambda y: NOT list_contains({old}.eps, y))), 'c': greatest({old}.c, b.x.c)}}"
    return f"""
do_ AS (SELECT series, list(x ORDER BY x) AS xs FROM {source} GROUP BY series),
dr AS (SELECT series, list_reduce(
  list_prepend({{'found': []::{SEG}[], 'x': NULL::{SEG}}}, list_transform(xs, lambda x: {{'found': []::{SEG}[], 'x': x}})),
  lambda a, b: list_transform([coalesce(list_position(list_transform(a.found, lambda o: {common} > 0 AND {union} > 0 AND {common} / {union} > 0.5 AND {shared} > 0.7), true), 0)],
    lambda k: {{'found': CASE WHEN k = 0 THEN list_append(a.found, b.x) ELSE list_concat(a.found[1:k - 1], [{merged}], a.found[k + 1:]) END, 'x': b.x}})[1]) AS z FROM do_),
dd AS (SELECT series, unnest(z.found) AS x FROM dr)"""


def _merged(source: str, fields: str = "", more: str = "") -> str:
    """CTE ``mg`` (series, x): INT-2 over ``source`` (series, x) without timings; ``more`` merges ``fields``."""
    kind = f"STRUCT(s DOUBLE, e DOUBLE, eps VARCHAR[], c DOUBLE{fields})"
    now = "a.found[len(a.found)]"
    joined = f"{{'s': {now}.s, 'e': greatest({now}.e, b.x.e), 'eps': list_concat({now}.eps, list_filter(b.x.eps, lambda y: NOT list_contains({now}.eps, y))), 'c': greatest({now}.c, b.x.c){more.format(now=now)}}}"
    return f"""
mo AS (SELECT series, list(x ORDER BY x) AS xs FROM {source} GROUP BY series),
mr AS (SELECT series, list_reduce(
  list_prepend({{'found': []::{kind}[], 'x': NULL::{kind}}}, list_transform(xs, lambda x: {{'found': []::{kind}[], 'x': x}})),
  lambda a, b: {{'found': CASE WHEN len(a.found) > 0 AND ({now}.e > b.x.s OR b.x.s - {now}.e <= 2) THEN list_append(a.found[1:len(a.found) - 1], {joined}) ELSE list_append(a.found, b.x) END, 'x': b.x}}) AS z FROM mo),
mg AS (SELECT series, unnest(z.found) AS x FROM mr)"""


# Matches between ten sequences of each supplier, which is a series.
PAIRS = """p AS (SELECT l_suppkey::BIGINT AS series, l_suppkey::BIGINT * 10 + l_linenumber % 4 AS ep1, l_suppkey::BIGINT * 10 + l_linenumber % 4 + 1 + l_partkey % 3 AS ep2,
  (l_orderkey % 900)::DOUBLE AS s1, l_quantity::DOUBLE + 3 AS d, (l_partkey % 5) * 1.5::DOUBLE AS off, l_linenumber * 12 AS n, l_discount::DOUBLE * 8 AS score FROM lineitem),
i AS (SELECT series, {'ep1': ep1, 'ep2': ep2, 's1': s1, 'e1': s1 + d, 's2': s1 + off, 'e2': s1 + off + d, 'n': n::INTEGER, 'c': score} AS x FROM p)"""
PAIR = "STRUCT(ep1 BIGINT, ep2 BIGINT, s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE, n INTEGER, c DOUBLE)"


def _pair_matches(spark: SparkSession, sf: str) -> DataFrame:
    ep1 = F.col("l_suppkey").cast("long") * 10 + F.col("l_linenumber") % 4
    start1, d = (F.col("l_orderkey") % 900).cast("double"), F.col("l_quantity").cast("double") + 3
    start2 = start1 + (F.col("l_partkey") % 5) * 1.5
    return table(spark, sf, "lineitem").select(
        ep1.alias("ep1"),
        (ep1 + 1 + F.col("l_partkey") % 3).alias("ep2"),
        start1.alias("start1"),
        (start1 + d).alias("end1"),
        start2.alias("start2"),
        (start2 + d).alias("end2"),
        (F.col("l_linenumber") * 12).cast("int").alias("match_count"),
        (F.col("l_discount").cast("double") * 8).alias("score"),
    )


def _supplier_sequences(spark: SparkSession, sf: str) -> DataFrame:
    ten = F.explode(F.sequence(F.lit(0), F.lit(9)))
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("series"), ten.alias("k"))
    return ids.select("series", (F.col("series") * 10 + F.col("k")).alias("episode_id"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("name"))


@query(
    "agg4_agg6_agg8_groups",
    f"""WITH {PAIRS}, {_first_fit("i", PAIR, "abs(l.s1 - b.x.s1) < 30 AND abs(l.e1 - b.x.e1) < 30")},
side AS (SELECT series, g, x.ep1 AS ep, x.s1 AS s, x.e1 AS e FROM ff UNION ALL SELECT series, g, x.ep2, x.s2, x.e2 FROM ff),
m AS (SELECT *, max(e) OVER (PARTITION BY series, g, ep ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM side),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY series, g, ep ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
r AS (SELECT series, g, ep, min(s) AS s, max(e) AS e FROM k GROUP BY series, g, ep, island),
best AS (SELECT *, row_number() OVER (PARTITION BY series, g, ep ORDER BY trunc((e - s) * 1000) DESC, s DESC) AS place FROM r),
big AS (SELECT series, g, list(s ORDER BY ep) AS ss, min(s) AS s, max(e) AS e, list('e' || (ep % 10)::VARCHAR ORDER BY ep) AS eps FROM best WHERE place = 1 AND e - s >= 10 GROUP BY series, g HAVING count(*) >= 3),
v AS (SELECT series, g, least(avg(x.n) / 50, 1.0) * 0.8 + 0.2 AS c FROM ff GROUP BY series, g)
SELECT series, s AS start_time, e AS end_time, array_to_string(eps, ',') AS episodes, round(c, 6) AS confidence, len(list_filter(ss, lambda y: abs(y - ss[1]) > 2)) > 0 AS shifted
FROM big JOIN v USING (series, g) WHERE e - s <= 240""",
)
def agg4(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-4, AGG-6, AGG-8, FLT-2, FLT-4, FLT-5."""
    found = detectors.segments_from_matches(detectors.match_filter(_pair_matches(spark, sf)), _supplier_sequences(spark, sf), DetectConfig(threshold=3, min_duration=10.0), "chromaprint", merge=False)
    return found.select("series", "start_time", "end_time", F.array_join("episode_list", ",").alias("episodes"), r6("confidence", "confidence"), F.col("episode_timings").isNotNull().alias("shifted"))


@query(
    "agg5_agg7_correlation_groups",
    f"""WITH {PAIRS}, {_first_fit("i", PAIR, "abs(l.s1 - b.x.s1) < 5")},
e AS (SELECT DISTINCT series, g, unnest([x.ep1, x.ep2]) AS ep FROM ff), n AS (SELECT series, g, list('e' || (ep % 10)::VARCHAR ORDER BY ep) AS eps FROM e GROUP BY series, g HAVING count(*) >= 3),
v AS (SELECT series, g, avg(least(x.s1, x.s2)) AS s, avg(greatest(x.e1, x.e2)) AS e, avg(x.c) AS c FROM ff GROUP BY series, g)
SELECT series, round(s, 6) AS start_time, round(e, 6) AS end_time, array_to_string(eps, ',') AS episodes, round(c, 6) AS confidence FROM v JOIN n USING (series, g) WHERE e - s >= 10""",
)
def agg5(spark: SparkSession, sf: str) -> DataFrame:
    found = detectors.segments_from_matches(_pair_matches(spark, sf), _supplier_sequences(spark, sf), DetectConfig(threshold=3, min_duration=10.0), "correlation")
    return found.select("series", r6("start_time", "start_time"), r6("end_time", "end_time"), F.array_join("episode_list", ",").alias("episodes"), r6("confidence", "confidence"))


REGION = "STRUCT(ep BIGINT, s DOUBLE, e DOUBLE, c DOUBLE)"


@query(
    "jn14_region_groups",
    f"""WITH {PAIRS}, q AS (SELECT series, {{'ep': x.ep1, 's': x.s1 * 7, 'e': x.s1 * 7 + x.e1 - x.s1, 'c': x.c}} AS x FROM i),
{_first_fit("q", REGION, "l.ep <> b.x.ep AND (greatest(l.s, b.x.s) < least(l.e, b.x.e) OR abs(b.x.s - l.e) < 5 OR abs(l.s - b.x.e) < 5)")}
SELECT series, min(x.s) AS start_time, max(x.e) AS end_time, count(*)::INTEGER AS n, round(avg(x.c), 6) AS confidence FROM ff GROUP BY series, g HAVING count(DISTINCT x.ep) >= 3""",
)
def jn14(spark: SparkSession, sf: str) -> DataFrame:
    p = _pair_matches(spark, sf)
    start = F.col("start1") * 7
    regions = p.select(F.floor(F.col("ep1") / 10).alias("series"), F.col("ep1").alias("episode_id"), F.lit("e").alias("name"), start.alias("start_time"), (start + F.col("end1") - F.col("start1")).alias("end_time"), F.col("score").alias("confidence"))
    found = detectors.region_groups(regions, 3)
    return found.select("series", "start_time", "end_time", F.size("episode_list").alias("n"), r6("confidence", "confidence"))


# A supplier's lines as segments of one sequence each: returned ones are one side, the others the other.
SIDES = """l AS (SELECT l_suppkey::BIGINT AS series, (l_orderkey % {span})::DOUBLE AS s, (l_orderkey % {span})::DOUBLE + l_quantity::DOUBLE / 2 AS e, ['p' || (l_partkey % 20)::VARCHAR] AS eps, l_discount::DOUBLE AS c, l_returnflag AS flag FROM lineitem)"""


def _sides(spark: SparkSession, sf: str, span: int) -> DataFrame:
    start, none = (F.col("l_orderkey") % span).cast("double"), F.lit(None).cast("double")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("series"),
        start.alias("start_time"),
        (start + F.col("l_quantity").cast("double") / 2).alias("end_time"),
        F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string"))).alias("episode_list"),
        F.lit(None).cast(TIMINGS).alias("episode_timings"),
        F.col("l_discount").cast("double").alias("confidence"),
        none.alias("video_confidence"),
        none.alias("audio_confidence"),
        F.when(F.col("l_returnflag") == "N", "audio").otherwise("video").alias("match_type"),
    )


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("series", r6("start_time", "start_time"), r6("end_time", "end_time"), F.array_join("episode_list", ",").alias("episodes"), r6("confidence", "confidence"), *more)


SHOWN = "series, round(x.s, 6) AS start_time, round(x.e, 6) AS end_time, array_to_string(x.eps, ',') AS episodes, round(x.c, 6) AS confidence"


@query("int4_deduplicate", f"WITH {SIDES.format(span=300)}, i AS (SELECT series, {{'s': s, 'e': e, 'eps': eps, 'c': c}} AS x FROM l), {_deduplicated('i')} SELECT {SHOWN} FROM dd")
def int4(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(folds.fold_segments(_sides(spark, sf, 300), folds.deduplicate))


FUSED = f"""v AS (SELECT series, list({{'s': s, 'e': e, 'eps': eps, 'c': c}} ORDER BY s, e, eps, c) AS vs FROM l WHERE flag <> 'N' GROUP BY series),
au AS (SELECT series, list({{'s': s, 'e': e, 'eps': eps, 'c': c}} ORDER BY s, e, eps, c) AS xs FROM l WHERE flag = 'N' GROUP BY series),
va AS (SELECT coalesce(v.series, au.series) AS series, coalesce(vs, []) AS vs, coalesce(xs, []) AS xs FROM v FULL JOIN au ON v.series = au.series),
took AS (SELECT series, vs, xs, list_reduce(
  list_prepend({{'g': []::BIGINT[], 'x': NULL::{SEG}}}, list_transform(vs, lambda x: {{'g': []::BIGINT[], 'x': x}})),
  lambda a, b: list_transform([coalesce(list_position(list_transform(xs, lambda o, j: NOT list_contains(a.g, j) AND (least(b.x.e, o.e) - greatest(b.x.s, o.s) > 0.5 * least(b.x.e - b.x.s, o.e - o.s) OR abs(least(b.x.e, o.e) - greatest(b.x.s, o.s)) < 1)), true), 0)],
    lambda k: {{'g': list_append(a.g, k), 'x': b.x}})[1]).g AS g FROM va),
pairs AS (SELECT series, xs, unnest(vs) AS x, unnest(g) AS k FROM took),
left_ AS (SELECT series, unnest(list_filter(xs, lambda o, j: NOT list_contains(g, j))) AS x FROM took),
i AS (SELECT series, {{'s': x.s, 'e': x.e, 'eps': CASE WHEN k > 0 THEN list_concat(x.eps, list_filter(xs[k].eps, lambda y: NOT list_contains(x.eps, y))) ELSE x.eps END, 'c': CASE WHEN k > 0 THEN (x.c + xs[k].c) / 2 ELSE x.c END, 'kind': CASE WHEN k > 0 THEN 2 ELSE 1 END}} AS x FROM pairs
  UNION ALL SELECT series, {{'s': x.s, 'e': x.e, 'eps': x.eps, 'c': x.c, 'kind': 0}} FROM left_)"""


@query(
    "detx1_jn15_fusion",
    f"WITH {SIDES.format(span=5000)}, {FUSED}, {_merged('i', ', kind INTEGER', ', {{q}}kind{{q}}: greatest({now}.kind, b.x.kind)').replace('{q}', chr(39))} SELECT {SHOWN}, CASE x.kind WHEN 2 THEN 'audio+video' WHEN 1 THEN 'video' ELSE 'audio' END AS match_type FROM mg",
)
def detx1(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sides(spark, sf, 5000)
    return _shown(detectors.fuse(rows.filter("match_type = 'video'"), rows.filter("match_type = 'audio'")), "match_type")


@query(
    "detx2_jn16_evaluation",
    f"""WITH {SIDES.format(span=2000)},
d AS (SELECT series, list({{'s': s, 'e': e, 'eps': eps, 'c': c}} ORDER BY c DESC, s, e) AS vs FROM l WHERE flag <> 'N' GROUP BY series),
w AS (SELECT series, list({{'s': s, 'e': e, 'least': len(eps)}} ORDER BY s, e) AS xs FROM l WHERE flag = 'N' GROUP BY series),
dw AS (SELECT coalesce(d.series, w.series) AS series, coalesce(vs, []) AS vs, coalesce(xs, []) AS xs FROM d FULL JOIN w ON d.series = w.series),
took AS (SELECT series, len(vs) AS n, len(xs) AS m, list_reduce(
  list_prepend({{'g': []::BIGINT[], 'x': NULL::{SEG}}}, list_transform(vs, lambda x: {{'g': []::BIGINT[], 'x': x}})),
  lambda a, b: list_transform([coalesce(list_position(list_transform(xs, lambda o, j: NOT list_contains(a.g, j) AND least(b.x.e, o.e) - greatest(b.x.s, o.s) > 0.5 * least(b.x.e - b.x.s, o.e - o.s) AND len(b.x.eps) >= o.least), true), 0)],
    lambda k: {{'g': list_append(a.g, k), 'x': b.x}})[1]).g AS g FROM dw),
t AS (SELECT series, avg(t) * 1000 AS t FROM (SELECT a.series, a.rowid_ AS r, min((abs(a.s - b.s) + abs(a.e - b.e)) / 2) AS t FROM (SELECT *, row_number() OVER () AS rowid_ FROM l WHERE flag <> 'N') a JOIN (SELECT * FROM l WHERE flag = 'N') b ON a.series = b.series GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT series, n, m, len(list_filter(g, lambda k: k > 0)) AS hits FROM took)
SELECT c.series AS fixture, hits AS true_positives, n - hits AS false_positives, m - hits AS false_negatives, n AS segments_detected, round(hits / n, 6) AS precision, round(hits / m, 6) AS recall, round(2.0 * hits / (n + m), 6) AS f1_score, round(t, 6) AS timing_mean_abs_error_ms FROM c JOIN t USING (series)""",
)
def detx2(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sides(spark, sf, 2000).withColumnRenamed("series", "fixture")
    expected = rows.filter("match_type = 'audio'").select("fixture", "start_time", "end_time", F.size("episode_list").alias("min_episodes"))
    found = evaluate.evaluate(rows.filter("match_type = 'video'"), expected)
    return found.select("fixture", "true_positives", "false_positives", "false_negatives", "segments_detected", *[r6(c, c) for c in ("precision", "recall", "f1_score", "timing_mean_abs_error_ms")])


def _groups_sql(frames: str, threshold: int, least: float, name: str, series: str = "0") -> str:
    """CTE ``i`` (series, x): AGG-1's groups of ``frames`` as segments."""
    return f"""i AS (SELECT series, {{'s': s, 'e': s + d, 'eps': eps, 'c': c}} AS x FROM (SELECT {series}::BIGINT AS series, hash, avg(start_time) AS s, avg(end_time - start_time) AS d, list_sort(list(DISTINCT {name})) AS eps, {CONFIDENCE} AS c FROM {frames}
  GROUP BY 1, hash HAVING count(*) >= {threshold} AND count(DISTINCT episode_id) >= {threshold} AND avg(end_time - start_time) >= {least}))"""


@query("deta5_spectral_hash", f"WITH {DOC}, {_rolled(3)}, {_groups_sql('r', 3, 2, chr(39) + 'doc-' + chr(39) + ' || episode_id::VARCHAR')}, {_deduplicated('i')}, {_merged('dd')} SELECT {SHOWN} FROM mg")
def deta5(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"))
    return _shown(detectors.spectral_hash(doc_frames(spark, sf), names, DetectConfig(threshold=3, min_duration=2.0, window_frames=3)))


# A supplier's lines are a sequence, suppliers with even and odd keys are two series.
LINES = "f AS (SELECT l_suppkey::BIGINT AS episode_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS frame_idx, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1)::DOUBLE AS ts, ('0x' || substr(md5((l_partkey % 30)::VARCHAR), 1, 15))::BIGINT AS hash FROM lineitem)"
LINE_WINDOWS = f"{_rolled(6)}, {_rolled(3).replace('w0', 'v0').replace('r AS', 'q AS')}, rq AS (SELECT * FROM r UNION ALL SELECT * FROM q)"


@query("detv2_current", f"WITH {LINES}, {LINE_WINDOWS}, {_groups_sql('rq', 4, 2, chr(39) + 's' + chr(39) + ' || episode_id::VARCHAR', 'episode_id % 2')}, {_deduplicated('i')}, {_merged('dd')} SELECT {SHOWN} FROM mg")
def detv2(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("episode_id"), "l_orderkey", "l_linenumber", "l_partkey")
    # By the renamed column, as all that follows, so that lines are dealt out once.
    order = Window.partitionBy("episode_id").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    placed = lines.withColumn("frame_idx", F.row_number().over(order) - 1)
    frames = placed.select("episode_id", "frame_idx", F.col("frame_idx").cast("double").alias("ts"), text_hash((F.col("l_partkey") % 30).cast("string")).alias("hash"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("episode_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 2).alias("series"))
    return _shown(detectors.current(frames, names, DetectConfig(threshold=4, min_duration=2.0, similarity_threshold=1.0, window_frames=6)))


def _nation_segments(spark: SparkSession, sf: str) -> DataFrame:
    start, value = F.col("n_nationkey") * F.lit(10.0), F.col("n_regionkey") / F.lit(4.0)
    end = start + F.col("n_regionkey") + 5.5
    late = start + F.col("n_regionkey") * 0.25
    timings = F.array(F.struct(F.col("n_name").alias("episode_name"), start.alias("start_time"), end.alias("end_time")), F.struct(F.lit("other").alias("episode_name"), (late * 2).alias("start_time"), (end + 1).alias("end_time")))
    return table(spark, sf, "nation").select(
        start.alias("start_time"), end.alias("end_time"), F.array("n_name").alias("episode_list"), F.when(F.col("n_regionkey") > 1, timings).cast(TIMINGS).alias("episode_timings"),
        value.alias("confidence"), F.lit(None).cast("double").alias("video_confidence"), value.alias("audio_confidence"), F.lit("audio").alias("match_type"),
    )


SHOW_TIME = "CASE WHEN {0} < 60 THEN printf('%.1fs', {0}) ELSE printf('%d:%04.1f', floor({0} / 60)::BIGINT, {0} - floor({0} / 60) * 60) END"


@query(
    "snk6_text_summary",
    f"""WITH n AS (SELECT n_nationkey * 10.0::DOUBLE AS s, n_nationkey * 10.0::DOUBLE + n_regionkey + 5.5 AS e, n_name, n_regionkey AS k, (n_nationkey * 10.0::DOUBLE + n_regionkey * 0.25) * 2 AS s2 FROM nation)
SELECT s AS start_time, {SHOW_TIME.format("s")} || ' - ' || {SHOW_TIME.format("e")} || ' [audio] ' || n_name || CASE WHEN k > 1 AND abs(s2 - s) >= 0.5 THEN ' (shifted: other ' || {SHOW_TIME.format("s2")} || ' - ' || {SHOW_TIME.format("(e + 1)")} || ')' ELSE '' END AS line FROM n""",
)
def snk6(spark: SparkSession, sf: str) -> DataFrame:
    return reports.text_summary(_nation_segments(spark, sf))


def _vectors(spark: SparkSession, sf: str, value) -> DataFrame:
    """Windows of five vectors, a start every third one."""
    rows = emb_frames(spark, sf).withColumn("value", value)
    return windows.vector_windows(rows, "value", 5, 3)


WINDOWS5 = f"{EMB}, w AS (SELECT episode_id, frame_idx AS pos, list(embedding::DOUBLE[]) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS v, count(*) OVER (PARTITION BY episode_id) AS n FROM f), k AS (SELECT episode_id, pos, v FROM w WHERE pos % 3 = 0 AND pos < n - 5)"
NEAREST5 = "SELECT ep1, ep2, pos1, pos2, round(d, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ep1, ep2, pos1 ORDER BY {order}, pos2) AS place FROM p) WHERE place = 1"


@query(
    "jn6_dsp13_nearest_mfcc",
    f"WITH {WINDOWS5}, p AS (SELECT x.episode_id AS ep1, y.episode_id AS ep2, x.pos AS pos1, y.pos AS pos2, list_avg(list_transform(range(1, 6), lambda i: sqrt(1.125 * list_distance(x.v[i], y.v[i]) ** 2 + 0.25 * list_distance(list_transform(x.v[i], lambda t: abs(t)), list_transform(y.v[i], lambda t: abs(t))) ** 2))) AS d FROM k x JOIN k y ON x.episode_id < y.episode_id) " + NEAREST5.format(order="d"),
)
def jn6(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients, half of them as deltas, their sizes as second deltas: weights 1, 0.5 and 0.25."""
    c = F.transform("embedding", lambda x: x.cast("double"))
    value = F.struct(c.alias("coefficients"), F.transform(c, lambda x: x / 2).alias("deltas"), F.transform(c, F.abs).alias("delta_deltas"))
    found = joins.nearest_windows(_vectors(spark, sf, value), kernels.MfccDistance(), False, lambda s: s >= 0)
    return found.select("ep1", "ep2", "pos1", "pos2", r6("score", "score"))


@query(
    "jn7_dsp14_nearest_energy",
    f"WITH {WINDOWS5}, p AS (SELECT x.episode_id AS ep1, y.episode_id AS ep2, x.pos AS pos1, y.pos AS pos2, list_avg(list_transform(range(1, 6), lambda i: 0.8 * list_cosine_similarity(x.v[i], y.v[i]) + 0.2 * least(list_sum(list_transform(x.v[i], lambda t: t * t)), list_sum(list_transform(y.v[i], lambda t: t * t))) / greatest(list_sum(list_transform(x.v[i], lambda t: t * t)), list_sum(list_transform(y.v[i], lambda t: t * t))))) AS d FROM k x JOIN k y ON x.episode_id < y.episode_id) " + NEAREST5.format(order="d DESC"),
)
def jn7(spark: SparkSession, sf: str) -> DataFrame:
    c = F.transform("embedding", lambda x: x.cast("double"))
    value = F.struct(c.alias("bands"), F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x).alias("rms_energy"))
    found = joins.nearest_windows(_vectors(spark, sf, value), kernels.EnergyCorrelation(), True, lambda s: s >= -9)
    return found.select("ep1", "ep2", "pos1", "pos2", r6("score", "score"))


@query(
    "str6_sessions",
    f"WITH {EVT}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY episode_id ORDER BY frame_idx) < 14400 THEN 0 ELSE 1 END AS cut FROM f), c AS (SELECT *, sum(cut) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS scene FROM g) SELECT episode_id, count(*) AS n, min(frame_idx)::BIGINT AS start_frame, max(frame_idx)::BIGINT AS end_frame FROM c GROUP BY episode_id, scene",
)
def str6(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming plan over a table at rest."""
    frames = evt_frames(spark, sf).withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
    found = rolling.stream_sessions(frames, "4 hours")
    return found.select("episode_id", "n", F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"))


@query(
    "snk5_segments_json",
    """WITH n AS (SELECT n_nationkey * 10.0::DOUBLE AS s, n_nationkey * 10.0::DOUBLE + n_regionkey + 5.5 AS e, n_name, n_regionkey AS k, (n_nationkey * 10.0::DOUBLE + n_regionkey * 0.25) * 2 AS s2 FROM nation)
SELECT string_agg('{"start_time":' || s || ',"end_time":' || e || ',"episodes":["' || n_name || '"],"match_type":"audio","confidence":' || (k / 4.0)::DOUBLE || ',"video_confidence":null,"audio_confidence":' || (k / 4.0)::DOUBLE || ',"episode_timings":'
 || CASE WHEN k > 1 THEN '[{"episode_name":"' || n_name || '","start_time":' || s || ',"end_time":' || e || '},{"episode_name":"other","start_time":' || s2 || ',"end_time":' || (e + 1) || '}]' ELSE 'null' END || '}', ',' ORDER BY s) AS segments FROM n""",
)
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    """The list of segments in the summary."""
    summary = reports.json_summary(_nation_segments(spark, sf), _status(spark, sf))
    inside = F.substring_index(F.substring_index("summary", '"segments":[', -1), '],"failures"', 1)
    return summary.select(inside.alias("segments"))
