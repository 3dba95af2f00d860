"""Registered queries: each applies operators to whole driver tables, with a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions import hashing, kernels, similarity, text
from ..operators import folds, intervals, joins, windows
from ..operators.components import components
from ..sinks import reports
from ..sources import run_store
from ..sources.sequences import conv_frames, doc_frames, emb_frames, evt_frames, line_segments, table
from ..storage import fresh_dir
from ..streaming import rolling
from . import detectors, evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Sequence views for DuckDB.
DOC = "d0 AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), d1 AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d0), f AS (SELECT doc_id AS episode_id, i AS frame_idx, i::DOUBLE AS ts, ('0x' || substr(md5(l), 1, 15))::BIGINT AS hash FROM d1)"
EMB = "e0 AS (SELECT label AS episode_id, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN (1::HUGEINT << (i - 1)::INTEGER) ELSE 0::HUGEINT END))::HUGEINT AS u FROM embeddings), f AS (SELECT episode_id, frame_idx, frame_idx::DOUBLE AS ts, u, vec_id, embedding, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash FROM e0)"
EVT = "f AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, epoch_us(ts) / 1e6 AS ts, ('0x' || substr(md5(event_type), 1, 15))::BIGINT AS hash, value FROM events)"
CONV = "f AS (SELECT conv_id AS episode_id, turn AS frame_idx, turn::DOUBLE AS ts, ('0x' || substr(md5(text), 1, 15))::BIGINT AS hash FROM conversations)"
SEG = "s AS (SELECT l_orderkey AS episode_id, l_linenumber::DOUBLE AS start_time, l_linenumber + l_quantity AS end_time, l_discount AS confidence FROM lineitem)"
FOLD = "list_reduce(list_prepend(0::BIGINT, w), lambda h, v: (h * 1000000007 + v) % 1000000009)"
OVER = "OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _rolled(width: int, view: str = "f") -> str:
    o = OVER.format(width - 1)
    return f"w0 AS (SELECT episode_id, frame_idx, first_value(ts) {o} AS start_time, ts AS end_time, list(hash) {o} AS w FROM {view}), r AS (SELECT {FOLD} AS hash, episode_id, frame_idx, start_time, end_time FROM w0 WHERE len(w) = {width})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name)


CONFIDENCE = "least(1.0, 0.7 / (1 + var_pop(end_time - start_time)) + 0.3 * least(1.0, count(*) / 10.0))"


@query(
    "agg1_recurring_windows",
    f"WITH {DOC}, {_rolled(3)} SELECT hash, count(*) AS n, count(DISTINCT episode_id) AS n_episodes, round(avg(start_time), 6) AS start_time, round(avg(end_time - start_time), 6) AS duration, round({CONFIDENCE}, 6) AS confidence FROM r GROUP BY hash HAVING count(*) >= 3 AND count(DISTINCT episode_id) >= 3",
)
def agg1(spark: SparkSession, sf: str) -> DataFrame:
    groups = detectors.hash_groups(windows.rolling_hash(doc_frames(spark, sf), 3), 3)
    return groups.select("hash", "n", "n_episodes", r6("start_time", "start_time"), r6("duration", "duration"), r6("confidence", "confidence"))


@query("srt10_largest_groups", f"WITH {DOC}, {_rolled(3)} SELECT hash, count(*) AS n FROM r GROUP BY hash ORDER BY n DESC, hash LIMIT 10")
def srt10(spark: SparkSession, sf: str) -> DataFrame:
    return windows.rolling_hash(doc_frames(spark, sf), 3).groupBy("hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hash").limit(10)


@query("win1_rolling_hash", f"WITH {DOC}, {_rolled(3)} SELECT * FROM r")
def win1(spark: SparkSession, sf: str) -> DataFrame:
    return windows.rolling_hash(doc_frames(spark, sf), 3).withColumn("frame_idx", F.col("frame_idx").cast("long"))


@query(
    "win1_rolling_hash_u64",
    f"WITH {EMB}, w0 AS (SELECT episode_id, frame_idx, list(u) {OVER.format(4)} AS w FROM f) SELECT episode_id, frame_idx, list_reduce(list_prepend(0::HUGEINT, w), lambda h, v: ((h * 1000000007 + v) % 18446744073709551616) % 1000000009)::BIGINT AS hash FROM w0 WHERE len(w) = 5",
)
def win1_u64(spark: SparkSession, sf: str) -> DataFrame:
    return windows.rolling_hash(emb_frames(spark, sf), 5).select("episode_id", F.col("frame_idx").cast("long").alias("frame_idx"), "hash")


@query("win2_opening_window", f"WITH {CONV}, {_rolled(4)}, {_rolled(3).replace('w0', 'v0').replace('r AS', 'q AS')} SELECT * FROM r UNION ALL SELECT * FROM q")
def win2(spark: SparkSession, sf: str) -> DataFrame:
    return windows.with_opening_window(conv_frames(spark, sf), 4)


@query("win3_analysis_vector", f"WITH {DOC}, w0 AS (SELECT episode_id, frame_idx, hash, list(hash) {OVER.format(4)} AS w FROM f) SELECT episode_id, frame_idx, CASE WHEN len(w) = 5 THEN {FOLD} ELSE hash END AS value FROM w0")
def win3(spark: SparkSession, sf: str) -> DataFrame:
    return windows.analysis_vector(doc_frames(spark, sf)).withColumn("frame_idx", F.col("frame_idx").cast("long"))


@query(
    "win6_strided_windows",
    f"WITH {DOC}, w0 AS (SELECT episode_id, frame_idx AS pos, ts AS start_time, last_value(ts) OVER a AS end_time, list(hash) OVER a AS w, count(*) OVER (PARTITION BY episode_id) AS n FROM f WINDOW a AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) SELECT episode_id, pos, start_time, end_time, {FOLD} AS hash FROM w0 WHERE pos % 3 = 0 AND pos < n - 6",
)
def win6(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.vector_windows(doc_frames(spark, sf), "hash", 6, 3)
    return rows.select("episode_id", F.col("pos").cast("long").alias("pos"), "start_time", "end_time", hashing.window_hash(F.col("values")).alias("hash"))


@query(
    "win7_sessions",
    f"WITH {EVT}, a AS (SELECT *, sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS scene FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS gap FROM f)), b AS (SELECT *, bit_count(xor(hash, lag(hash) OVER (PARTITION BY episode_id, scene ORDER BY frame_idx))) AS d FROM a) SELECT episode_id, scene::BIGINT AS scene, min(frame_idx)::BIGINT AS start_frame, max(frame_idx)::BIGINT AS end_frame, min(ts) AS start_time, max(ts) AS end_time, round(coalesce(avg(d), 0) / 64, 6) AS complexity FROM b GROUP BY ALL",
)
def win7(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.sessions(evt_frames(spark, sf), 86400.0)
    return s.select("episode_id", "scene", F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"), "start_time", "end_time", r6("complexity", "complexity"))


@query("win8_identity_sample", f"WITH {DOC}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS n FROM f) SELECT episode_id, n, frame_idx FROM n WHERE n <= 30 OR frame_idx < 10 OR frame_idx >= n - 10 OR frame_idx BETWEEN n // 2 - 5 AND n // 2 + 4")
def win8(spark: SparkSession, sf: str) -> DataFrame:
    return windows.identity_sample(doc_frames(spark, sf)).select("episode_id", "n", F.col("frame_idx").cast("long").alias("frame_idx"))


LAGS = "g AS (SELECT *, bit_count(xor(hash, lag(hash) OVER p)) AS d, bit_count(xor((CASE WHEN ((u << 3) % 18446744073709551616 + (u >> 61)) >= 9223372036854775808 THEN (u << 3) % 18446744073709551616 + (u >> 61) - 18446744073709551616 ELSE (u << 3) % 18446744073709551616 + (u >> 61) END)::BIGINT, 3689348814741910323)) / 64.0 AS color FROM f WINDOW p AS (PARTITION BY episode_id ORDER BY frame_idx)), g2 AS (SELECT *, abs(d - lag(d) OVER (PARTITION BY episode_id ORDER BY frame_idx)) AS dd FROM g), st AS (SELECT episode_id, coalesce(avg(d), 0) / 64 AS complexity, coalesce(avg(dd), 0) / 64 AS motion, coalesce(var_pop(color), 0) AS color_variance FROM g2 GROUP BY episode_id)"


@query("win9_s19_s20_statistics", f"WITH {EMB}, {LAGS} SELECT episode_id, round(complexity, 6) AS complexity, round(motion, 6) AS motion, round(color_variance, 6) AS color_variance, round(greatest(0.5, least(0.95, 0.75 - 0.1 * (0.3 * complexity + 0.4 * motion + 0.3 * color_variance))), 6) AS threshold FROM st")
def win9(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.lag_statistics(emb_frames(spark, sf))
    t = similarity.adaptive_threshold(0.75, F.col("complexity"), F.col("motion"), F.col("color_variance"))
    return s.select("episode_id", r6("complexity", "complexity"), r6("motion", "motion"), r6("color_variance", "color_variance"), r6(t, "threshold"))


@query(
    "win10_dsp8_deltas",
    f"WITH {EVT}, a AS (SELECT *, first_value(value) OVER e AS lo, last_value(value) OVER e AS hi FROM f WINDOW e AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), b AS (SELECT *, (-2 * coalesce(lag(value, 2) OVER p, lo) - coalesce(lag(value) OVER p, lo) + coalesce(lead(value) OVER p, hi) + 2 * coalesce(lead(value, 2) OVER p, hi)) / 6.0 AS delta FROM a WINDOW p AS (PARTITION BY episode_id ORDER BY frame_idx)), c AS (SELECT *, (coalesce(lag(delta) OVER p, delta) + delta + coalesce(lead(delta) OVER p, delta)) / 3.0 AS dd FROM b WINDOW p AS (PARTITION BY episode_id ORDER BY frame_idx)) SELECT episode_id, frame_idx, round(delta, 4) AS delta, round(dd, 4) AS delta_delta FROM c",
)
def win10(spark: SparkSession, sf: str) -> DataFrame:
    d = windows.deltas(evt_frames(spark, sf), "value")
    return d.select("episode_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.round("delta", 4).alias("delta"), F.round("delta_delta", 4).alias("delta_delta"))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("episode_id").orderBy("frame_idx")
    rows = emb_frames(spark, sf).withColumns({"other": F.lag("hash").over(order), "before": F.lag("embedding").over(order)})
    return rows.filter(F.col("other").isNotNull())


NEAR = f"WITH {EMB}, p AS (SELECT *, lag(hash) OVER w AS other, lag(embedding) OVER w AS before FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)), q AS (SELECT * FROM p WHERE other IS NOT NULL)"


@query("s1_s3_hamming", f"{NEAR} SELECT vec_id, bit_count(xor(hash, other))::INTEGER AS distance, bit_count(xor(hash, other)) <= 30 AS near, round(1 - bit_count(xor(hash, other)) / 64.0, 6) AS similarity FROM q")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("hash"), F.col("other")
    return _neighbours(spark, sf).select("vec_id", hashing.hamming(a, b).alias("distance"), hashing.is_similar(a, b, 30).alias("near"), r6(hashing.hamming_similarity(a, b), "similarity"))


@query("s10_s24_multi_hash", f"{NEAR} SELECT vec_id, round(1 - bit_count(xor(hash, other)) / 64.0, 6) AS similarity FROM q")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    rows = _neighbours(spark, sf).withColumns({"a": hashing.synthetic_hashes(F.col("hash")), "b": hashing.synthetic_hashes(F.col("other"))})
    return rows.select("vec_id", r6(hashing.weighted_similarity(F.col("a"), F.col("b")), "similarity"))


@query("s15_cosine", f"{NEAR} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], before::DOUBLE[]), 6) AS cosine FROM q")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select("vec_id", r6(similarity.cosine(F.col("embedding"), F.col("before")), "cosine"))


PIXELS = "list_transform({}, lambda x: least(255, greatest(0, floor(x::DOUBLE * 128) + 128))::DOUBLE)"
_A, _B = PIXELS.format("embedding"), PIXELS.format("before")


def _pixels(c: str):
    return F.transform(F.col(c), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 128) + 128)).cast("int"))


@query(
    "s14_global_ssim",
    f"{NEAR}, x AS (SELECT vec_id, {_A} AS a, {_B} AS b FROM q), m AS (SELECT vec_id, list_avg(a) AS ma, list_avg(b) AS mb, list_inner_product(a, a) / 64 AS aa, list_inner_product(b, b) / 64 AS bb, list_inner_product(a, b) / 64 AS ab FROM x) SELECT vec_id, round((2 * ma * mb + 650.25) * (2 * (ab - ma * mb) + 1950.75) / ((ma * ma + mb * mb + 650.25) * (aa - ma * ma + bb - mb * mb + 1950.75)), 6) AS ssim FROM m",
)
def s14(spark: SparkSession, sf: str) -> DataFrame:
    rows = _neighbours(spark, sf).select("vec_id", _pixels("embedding").alias("a"), _pixels("before").alias("b"))
    return rows.select("vec_id", r6(similarity.global_ssim(F.col("a"), F.col("b")), "ssim"))


@query(
    "s6_s7_image_hashes",
    f"WITH x AS (SELECT vec_id, {PIXELS.format('embedding')} AS p FROM embeddings), y AS (SELECT vec_id, p, list_concat(p, p[1:8]) AS q FROM x), z AS (SELECT vec_id, list_sum(list_transform(p, lambda v, i: CASE WHEN v > floor(list_avg(p)) THEN (1::HUGEINT << (i - 1)::INTEGER) ELSE 0::HUGEINT END))::HUGEINT AS a, list_sum(list_transform(range(64), lambda i: CASE WHEN q[(i // 8) * 9 + i % 8 + 1] > q[(i // 8) * 9 + i % 8 + 2] THEN (1::HUGEINT << i::INTEGER) ELSE 0::HUGEINT END))::HUGEINT AS d FROM y) SELECT vec_id, (CASE WHEN a >= 9223372036854775808 THEN a - 18446744073709551616 ELSE a END)::BIGINT AS ahash, (CASE WHEN d >= 9223372036854775808 THEN d - 18446744073709551616 ELSE d END)::BIGINT AS dhash FROM z",
)
def s6(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", _pixels("embedding").alias("p"))
    return rows.select("vec_id", hashing.average_hash(F.col("p")).alias("ahash"), hashing.difference_hash(F.concat("p", F.slice("p", 1, 8))).alias("dhash"))


@query("s5_placeholder_hash", "SELECT p_partkey, (p_size::BIGINT * 31 + 1080) * 31 + list_sum(list_transform(range(1, least(len(p_name), 16) + 1), lambda i: ascii(p_name[i])::BIGINT << ((i - 1) % 8)::INTEGER))::BIGINT AS hash FROM part")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("bytes", F.transform(F.sequence(F.lit(1), F.least(F.length("p_name"), F.lit(16))), lambda i: F.ascii(F.substring("p_name", i, F.lit(1)))))
    return parts.select("p_partkey", hashing.placeholder_hash(F.col("p_size"), F.lit(1080), F.col("bytes")).alias("hash"))


@query("s17_s25_signature_score", f"{NEAR}, k AS (SELECT vec_id, bit_count(hash & 255) AS a, bit_count(other & 255) AS b FROM q) SELECT vec_id, round(CASE WHEN a > 0 AND b > 0 AND a / greatest(a, b) >= 0.2 THEN 0.9 * a / greatest(a, b) ELSE 0 END, 6) AS keypoints FROM k")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (F.bit_count(F.col(c).bitwiseAND(F.lit(255))) for c in ("hash", "other"))
    return _neighbours(spark, sf).select("vec_id", r6(similarity.keypoint_match(a, b), "keypoints"))


@query("s26_mel_scale", "SELECT c_custkey, round(2595 * log10(1 + (c_acctbal + 2000) / 700), 4) AS mel, round(700 * (pow(10, (c_acctbal + 2000) / 25950) - 1), 4) AS hz FROM customer")
def s26(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("c_acctbal") + 2000
    return table(spark, sf, "customer").select("c_custkey", F.round(similarity.hz_to_mel(x), 4).alias("mel"), F.round(similarity.mel_to_hz(x / 10), 4).alias("hz"))


LEVEL = "list_transform({}, lambda x: (CASE WHEN x < -0.1 THEN 0 WHEN x < 0 THEN 1 WHEN x < 0.1 THEN 2 ELSE 3 END))"


@query("s27_level_similarity", f"{NEAR}, k AS (SELECT vec_id, {LEVEL.format('embedding')} AS a, {LEVEL.format('before')} AS b FROM q) SELECT vec_id, round(len(list_filter(list_zip(a, b), lambda p: abs(p[1] - p[2]) <= 1)) / 64.0, 6) AS similarity FROM k")
def s27(spark: SparkSession, sf: str) -> DataFrame:
    level = lambda c: F.transform(F.col(c), lambda x: F.when(x < -0.1, 0).when(x < 0, 1).when(x < 0.1, 2).otherwise(3))
    return _neighbours(spark, sf).select("vec_id", r6(similarity.level_similarity(level("embedding"), level("before")), "similarity"))


@query("s22_time_overlap", f"WITH {SEG}, p AS (SELECT episode_id, start_time, end_time, lead(start_time) OVER w AS s2, lead(end_time) OVER w AS e2 FROM s WINDOW w AS (PARTITION BY episode_id ORDER BY start_time, end_time)) SELECT episode_id, start_time, round(CASE WHEN least(end_time, e2) > greatest(start_time, s2) THEN (least(end_time, e2) - greatest(start_time, s2)) / (greatest(end_time, e2) - least(start_time, s2)) ELSE 0 END, 6) AS iou FROM p WHERE s2 IS NOT NULL")
def s22(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("episode_id").orderBy("start_time", "end_time")
    rows = line_segments(spark, sf).withColumns({"s2": F.lead("start_time").over(w), "e2": F.lead("end_time").over(w)}).filter("s2 is not null")
    return rows.select("episode_id", "start_time", r6(similarity.time_overlap(F.col("start_time"), F.col("end_time"), F.col("s2"), F.col("e2")), "iou"))


@query("s23_set1_set2_lists", "WITH g AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N'), []) AS a, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O'), []) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_intersect(a, b))::INTEGER AS common, len(list_distinct(list_concat(a, b)))::INTEGER AS either, round(CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS overlap FROM g")
def s23(spark: SparkSession, sf: str) -> DataFrame:
    supplier = F.col("l_suppkey")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "N", supplier)).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "O", supplier)).alias("b"))
    return g.select("l_orderkey", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("either"), r6(similarity.sequence_overlap(F.col("a"), F.col("b")), "overlap"))


@query("s28_time_shift", f"WITH {SEG} SELECT episode_id, bool_or(abs(start_time - (first))) AS shifted FROM (SELECT episode_id, start_time, min(start_time) OVER (PARTITION BY episode_id) AS first FROM s) GROUP BY 1".replace("bool_or(abs(start_time - (first)))", "bool_or(abs(start_time - first) > 2.0)"))
def s28(spark: SparkSession, sf: str) -> DataFrame:
    starts = line_segments(spark, sf).groupBy("episode_id").agg(F.array_sort(F.collect_list("start_time")).alias("starts"))
    return starts.select("episode_id", similarity.time_shifted(F.col("starts")).alias("shifted"))


@query("s29_s31_time_text", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 7 AS s FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%d:%04.1f', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) END AS shown, printf('[%02d:%02d]', floor(s / 60)::BIGINT, (floor(s)::BIGINT % 60)) AS elapsed FROM x")
def s29(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("l_quantity") * 7
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.format_time(s).alias("shown"), text.format_elapsed(s).alias("elapsed"))


@query("s30_parse_time", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity + 0.5 WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity * 60 + 7.5 ELSE 3600 + l_quantity * 60 + 9 END::DOUBLE AS seconds FROM lineitem")
def s30(spark: SparkSession, sf: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    token = F.when(k == 0, F.concat(q, F.lit(".5s"))).when(k == 1, q).when(k == 2, F.concat(q, F.lit(":07.5"))).otherwise(F.concat(F.lit("1:"), q, F.lit(":09")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.parse_time_token(token).alias("seconds"))


@query("s32_refine_boundaries", f"WITH {SEG}, t AS (SELECT *, CASE WHEN end_time - start_time >= 15 THEN least(least(0.2 * (end_time - start_time), 10), 2) ELSE 0 END AS t FROM s) SELECT episode_id, round(start_time + t, 6) AS start_time, round(end_time - t, 6) AS end_time FROM t")
def s32(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.refine_boundaries(line_segments(spark, sf), 10.0).select("episode_id", r6("start_time", "start_time"), r6("end_time", "end_time"))


@query("s33_s34_frame_counts", "SELECT o_orderkey, floor(o_totalprice * 5)::BIGINT AS frames, (CASE WHEN floor(o_totalprice) < 8192 THEN 0 ELSE floor((floor(o_totalprice) - 8192) / 2048) + 1 END)::BIGINT AS spectral FROM orders")
def s33(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", text.estimated_frames(price, 5.0).alias("frames"), text.spectral_frames(F.floor(price), 8192, 2048).cast("long").alias("spectral"))


@query("s35_match_types", "SELECT l_orderkey, CASE max(CASE WHEN l_shipdate IS NULL THEN 0 WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) WHEN 2 THEN 'audio+video' WHEN 1 THEN 'video' ELSE 'audio' END AS match_type FROM lineitem GROUP BY 1")
def s35(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "audio+video").when(F.col("l_returnflag") == "R", "video").otherwise("audio")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(text.match_name(F.max(text.match_rank(kind))).alias("match_type"))


@query("int1_islands", f"WITH {SEG}, a AS (SELECT *, max(end_time) OVER (PARTITION BY episode_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s), c AS (SELECT *, sum(CASE WHEN b IS NULL OR start_time - b > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island FROM a) SELECT episode_id, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n, round(avg(confidence), 6) AS confidence FROM c GROUP BY episode_id, island")
def int1(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_islands(line_segments(spark, sf)).select("episode_id", "start_time", "end_time", "n", r6("confidence", "confidence"))


def _durations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode_id"), F.lit(40.0).alias("duration"))


# Islands at gap 0, then what is between them in [0, 40].
KEEPS = "dur AS (SELECT o_orderkey AS episode_id, 40.0::DOUBLE AS duration FROM orders), a AS (SELECT *, max(end_time) OVER (PARTITION BY episode_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {0}), c AS (SELECT *, sum(CASE WHEN b IS NULL OR start_time > b THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island FROM a), m AS (SELECT episode_id, min(start_time) AS s, max(end_time) AS e FROM c GROUP BY episode_id, island), k AS (SELECT m.episode_id, lag(e, 1, 0.0) OVER (PARTITION BY m.episode_id ORDER BY s) AS start_time, least(s, duration) AS end_time FROM m JOIN dur USING (episode_id) UNION ALL SELECT dur.episode_id, coalesce(max(e), 0.0), any_value(duration) FROM dur LEFT JOIN m USING (episode_id) GROUP BY dur.episode_id)"


@query("int7_keeps", f"WITH {SEG}, {KEEPS.format('s')} SELECT episode_id, start_time, end_time FROM k WHERE start_time < end_time")
def int7(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.keeps_from_removals(line_segments(spark, sf), _durations(spark, sf))


@query("int7_keeps_historical", f"WITH {SEG}, dur AS (SELECT o_orderkey AS episode_id, 40.0::DOUBLE AS duration FROM orders), x AS (SELECT s.episode_id, start_time, end_time, duration FROM s JOIN dur USING (episode_id) UNION ALL SELECT episode_id, duration, NULL, duration FROM dur), k AS (SELECT episode_id, lag(end_time, 1, 0.0) OVER (PARTITION BY episode_id ORDER BY end_time IS NULL, start_time, end_time) AS start_time, least(start_time, duration) AS end_time FROM x) SELECT * FROM k WHERE start_time < end_time")
def int7_historical(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.keeps_from_removals(line_segments(spark, sf), _durations(spark, sf), coalesce=False)


@query("int8_removals", f"WITH {SEG}, s1 AS (SELECT episode_id, greatest(start_time, 0.0) AS start_time, least(end_time, 40.0) AS end_time FROM s WHERE greatest(start_time, 0.0) < least(end_time, 40.0)), {KEEPS.format('s1')} SELECT episode_id, start_time, end_time FROM k WHERE start_time < end_time")
def int8(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.removals_from_keeps(line_segments(spark, sf), _durations(spark, sf))


@query("int9_first_and_last", f"WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_time, end_time) AS a, row_number() OVER (PARTITION BY episode_id ORDER BY start_time DESC, end_time DESC) AS b FROM s) SELECT DISTINCT episode_id, start_time, end_time FROM n WHERE a = 1 OR b = 1")
def int9(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.first_and_last(line_segments(spark, sf)).select("episode_id", "start_time", "end_time").distinct()


@query("flt6_int11_trims", f"WITH {SEG}, t AS (SELECT episode_id, start_time * 200 AS s, start_time * 200 + (end_time - start_time) * 4 AS e FROM s), u AS (SELECT *, e - s AS d, CASE WHEN s < 30 AND e < 500 AND e - s > 90 THEN s + 90 ELSE e END AS e2 FROM t WHERE e - s >= 20), v AS (SELECT episode_id, CASE WHEN s > 1300 AND e2 > 1400 AND d > 70 THEN e2 - 70 ELSE s END AS start_time, e2 AS end_time FROM u WHERE NOT (s > 1300 AND e2 > 1400 AND d < 40)) SELECT * FROM v WHERE end_time > start_time")
def flt6(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("start_time") * 200
    wide = line_segments(spark, sf).select("episode_id", s.alias("start_time"), (s + (F.col("end_time") - F.col("start_time")) * 4).alias("end_time"))
    return intervals.trim_openings_and_endings(wide)


@query("flt1_flt5_durations", f"WITH {SEG} SELECT episode_id, start_time, end_time FROM s WHERE end_time - start_time BETWEEN 10 AND 24")
def flt1(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_segments(spark, sf).filter(F.col("end_time") - F.col("start_time") >= 10)
    return intervals.drop_overlong(kept, 24.0).select("episode_id", "start_time", "end_time")


def _line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("episode_id").orderBy("start_time", "end_time")
    rows = line_segments(spark, sf).withColumns({"start2": F.lead("start_time").over(w), "end2": F.lead("end_time").over(w)}).filter("start2 is not null")
    return rows.select(F.col("episode_id").alias("ep1"), F.col("start_time").alias("start1"), F.col("end_time").alias("end1"), "start2", "end2")


@query("flt3_match_filter", f"WITH {SEG}, p AS (SELECT episode_id AS ep1, start_time AS start1, end_time AS end1, lead(start_time) OVER w AS start2, lead(end_time) OVER w AS end2 FROM s WINDOW w AS (PARTITION BY episode_id ORDER BY start_time, end_time)) SELECT * FROM p WHERE start2 IS NOT NULL AND end1 - start1 BETWEEN 5 AND 240 AND end2 - start2 BETWEEN 5 AND 240 AND abs((end1 - start1) - (end2 - start2)) < 30")
def flt3(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.match_filter(_line_pairs(spark, sf), 5.0, 240.0, 30.0)


@query("flt10_head_and_tail", f"WITH {EVT}, l AS (SELECT episode_id, frame_idx, ts - min(ts) OVER (PARTITION BY episode_id) AS ts FROM f), m AS (SELECT *, max(ts) OVER (PARTITION BY episode_id) AS last FROM l) SELECT episode_id, frame_idx FROM m WHERE last <= 600 OR ts < 86400 OR ts > last - 86400")
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    rows = evt_frames(spark, sf).withColumn("ts", F.col("ts") - F.min("ts").over(Window.partitionBy("episode_id")))
    return detectors.head_and_tail(rows, 86400.0, 600.0).select("episode_id", F.col("frame_idx").cast("long").alias("frame_idx"))


MATCHES = "a AS (SELECT hash, episode_id AS ep1, start_time AS t1 FROM r), b AS (SELECT hash, episode_id AS ep2, start_time AS t2 FROM r), mm AS (SELECT ep1, ep2, t1, t2 FROM a JOIN b USING (hash) WHERE ep1 < ep2)"


@query("jn2_landmark_matches", f"WITH {DOC}, {_rolled(3)}, {MATCHES} SELECT * FROM mm")
def jn2(spark: SparkSession, sf: str) -> DataFrame:
    rolled = windows.rolling_hash(doc_frames(spark, sf), 3)
    return joins.landmark_matches(rolled.select("hash", "episode_id", F.col("start_time").alias("ts")))


@query("jn3_offset_bins", f"WITH {DOC}, {_rolled(3)}, {MATCHES} SELECT ep1, ep2, round((t2 - t1) / 5.0)::INTEGER AS bin, count(*) AS n, min(t1) AS t1_min, max(t1) AS t1_max FROM mm GROUP BY 1, 2, 3")
def jn3(spark: SparkSession, sf: str) -> DataFrame:
    return joins.offset_bins(jn2(spark, sf))


REGION = "CASE WHEN {a}.n >= 3 AND {a}.n / greatest({a}.l1 - {a}.s1, 1.0) >= 0.05 AND {a}.l1 - {a}.s1 BETWEEN 5 AND 240 AND {a}.l2 - {a}.s2 BETWEEN 5 AND 240 THEN list_append({a}.found, {{'start1': {a}.s1, 'end1': {a}.l1, 'start2': {a}.s2, 'end2': {a}.l2, 'n': {a}.n}}) ELSE {a}.found END"
REGIONS = f"""
WITH {DOC}, {_rolled(3)}, {MATCHES},
b3 AS (SELECT ep1, ep2, round((t2 - t1) / 5.0)::INTEGER AS bin,
  list({{'found': []::STRUCT(start1 DOUBLE, end1 DOUBLE, start2 DOUBLE, end2 DOUBLE, n INTEGER)[], 's1': t1, 's2': t2, 'l1': t1, 'l2': t2, 'n': 1}} ORDER BY t1, t2) AS xs FROM mm GROUP BY 1, 2, 3),
red AS (SELECT ep1, ep2, list_reduce(xs, lambda a, x: CASE
  WHEN x.l1 - a.l1 < 3 AND x.l1 - a.s1 < 240 AND (a.n + 1) / greatest(x.l1 - a.s1, 1.0) >= 0.05
  THEN {{'found': a.found, 's1': a.s1, 's2': a.s2, 'l1': x.l1, 'l2': x.l2, 'n': a.n + 1}}
  ELSE {{'found': {REGION.format(a="a")}, 's1': x.s1, 's2': x.s2, 'l1': x.l1, 'l2': x.l2, 'n': 1}} END) AS z FROM b3),
reg AS (SELECT ep1, ep2, unnest({REGION.format(a="z")}) AS r FROM red)
SELECT ep1::BIGINT AS ep1, ep2::BIGINT AS ep2, r.start1 AS start1, r.end1 AS end1, r.start2 AS start2, r.end2 AS end2, r.n AS match_count, r.n::DOUBLE AS score FROM reg
"""


@query("jn3_regions", REGIONS)
def jn3_regions(spark: SparkSession, sf: str) -> DataFrame:
    return joins.landmark_regions(jn2(spark, sf))


def _hamming_sql(radius: int) -> str:
    return f"WITH {EMB} SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.hash, y.hash))::INTEGER AS distance FROM f x JOIN f y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.hash, y.hash)) <= {radius}"


@query("jn4_hamming_bands", _hamming_sql(8))
def jn4(spark: SparkSession, sf: str) -> DataFrame:
    return joins.hamming_join(emb_frames(spark, sf), 8, "vec_id")


@query("jn5_hamming_blocks", _hamming_sql(19))
def jn5(spark: SparkSession, sf: str) -> DataFrame:
    return joins.hamming_join(emb_frames(spark, sf), 19, "vec_id")


@query("jn4_leader_clusters")
def jn4_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return joins.leader_clusters(emb_frames(spark, sf).select(F.col("vec_id").alias("id"), "hash"), 20)


@query(
    "jn8_nearest_windows",
    f"WITH {EMB}, p AS (SELECT x.episode_id AS ep1, y.episode_id AS ep2, x.frame_idx AS pos1, y.frame_idx AS pos2, bit_count(xor(x.hash, y.hash)) AS d FROM f x JOIN f y ON x.episode_id < y.episode_id), r AS (SELECT *, row_number() OVER (PARTITION BY ep1, ep2, pos1 ORDER BY d, pos2) AS k FROM p) SELECT ep1, ep2, pos1, pos2, round(1 - d / 64.0, 6) AS score FROM r WHERE k = 1 AND 1 - d / 64.0 >= 0.7",
)
def jn8(spark: SparkSession, sf: str) -> DataFrame:
    rows = emb_frames(spark, sf).select("episode_id", F.col("frame_idx").cast("long").alias("pos"), F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), F.col("hash").alias("values"))
    found = joins.nearest_windows(rows, kernels.Words(), True, lambda s: s >= 0.7)
    return found.select("ep1", "ep2", "pos1", "pos2", r6("score", "score"))


@query(
    "jn11_window_grid",
    f"WITH {EMB}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS n FROM f), t AS (SELECT episode_id, frame_idx // 5 AS w, frame_idx % 5 AS k, hash FROM n WHERE (frame_idx // 5) * 5 < n - 5) SELECT x.episode_id AS ep1, y.episode_id AS ep2, x.w::INTEGER AS w1, y.w::INTEGER AS w2, round(avg(1 - bit_count(xor(x.hash, y.hash)) / 64.0), 6) AS score FROM t x JOIN t y ON x.k = y.k AND x.episode_id < y.episode_id GROUP BY ALL",
)
def jn11(spark: SparkSession, sf: str) -> DataFrame:
    return joins.window_grid_join(emb_frames(spark, sf), 5, hashing.hamming_similarity).select("ep1", "ep2", "w1", "w2", r6("score", "score"))


DUPES = f"WITH {{}} {DOC}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS n FROM f), i AS (SELECT * FROM n WHERE n <= 30 OR frame_idx < 10 OR frame_idx >= n - 10 OR frame_idx BETWEEN n // 2 - 5 AND n // 2 + 4), dp AS (SELECT x.episode_id AS ep1, y.episode_id AS ep2, x.n, count(*) / least(x.n, 30) AS share FROM i x JOIN i y ON x.n = y.n AND x.frame_idx = y.frame_idx AND x.hash = y.hash AND x.episode_id < y.episode_id GROUP BY 1, 2, 3 HAVING count(*) / least(x.n, 30) >= 0.95)"


@query("jn12_full_duplicates", DUPES.format("") + " SELECT ep1, ep2, n, round(share, 6) AS share FROM dp")
def jn12(spark: SparkSession, sf: str) -> DataFrame:
    frames = doc_frames(spark, sf)
    return joins.full_duplicates(frames, windows.identity_sample(frames)).select("ep1", "ep2", "n", r6("share", "share"))


@query("agg10_components", DUPES.format("RECURSIVE") + ", e AS (SELECT ep1 AS a, ep2 AS b FROM dp UNION ALL SELECT ep2, ep1 FROM dp), c AS (SELECT a AS node, a AS reach FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a) SELECT node, min(reach) AS component FROM c GROUP BY node")
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    return components(jn12(spark, sf), "ep1", "ep2")


@query("agg9_lengths", f"WITH {DOC}, c AS (SELECT episode_id, count(*) AS n FROM f GROUP BY 1) SELECT n, count(*) AS sequences FROM c GROUP BY 1")
def agg9(spark: SparkSession, sf: str) -> DataFrame:
    return doc_frames(spark, sf).groupBy("episode_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sequences"))


@query("jn13_opening", f"WITH {EMB}, m AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM f GROUP BY episode_id)), h AS (SELECT f.* FROM f, m WHERE frame_idx < CASE WHEN c < 5 THEN 0 ELSE least(160, c) END), o AS (SELECT frame_idx, hash AS ref FROM h WHERE episode_id = (SELECT min(episode_id) FROM f)) SELECT episode_id, max(bit_count(xor(hash, ref)))::INTEGER AS worst, count(*) AS n_frames FROM h JOIN o USING (frame_idx) GROUP BY 1 HAVING max(bit_count(xor(hash, ref))) <= 46")
def jn13(spark: SparkSession, sf: str) -> DataFrame:
    return joins.opening_matches(emb_frames(spark, sf), 46).select("episode_id", "worst", "n_frames")


@query("jn17_timing_error", f"WITH {SEG}, o AS (SELECT *, row_number() OVER () AS i FROM s WHERE start_time % 2 = 1), e AS (SELECT * FROM s WHERE start_time % 2 = 0), b AS (SELECT o.episode_id, o.i, min((abs(o.start_time - e.start_time) + abs(o.end_time - e.end_time)) / 2) AS err FROM o JOIN e USING (episode_id) GROUP BY 1, 2) SELECT episode_id, round(avg(err) * 1000, 4) AS timing_ms, count(*) AS n FROM b GROUP BY 1")
def jn17(spark: SparkSession, sf: str) -> DataFrame:
    s = line_segments(spark, sf)
    found = evaluate.timing_error(s.filter("start_time % 2 = 1").select("episode_id", "start_time", "end_time"), s.filter("start_time % 2 = 0"), "episode_id")
    return found.select("episode_id", F.round("timing_ms", 4).alias("timing_ms"), "n")


def _flagged(spark: SparkSession, sf: str, flag: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).select((F.col("l_partkey") * 1.0).alias("start_time"), (F.col("l_partkey") + F.col("l_quantity")).alias("end_time"), F.col("l_discount").alias("confidence"))


@query("jn18_agg13_agreement", "WITH k AS (SELECT l_returnflag AS f, printf('%.1f-%.1f', l_partkey::DOUBLE, l_partkey + l_quantity) AS key, l_discount AS c FROM lineitem), a AS (SELECT * FROM k WHERE f = 'A'), b AS (SELECT * FROM k WHERE f = 'R') SELECT 'common' AS part, count(*) AS n, round(coalesce(avg(c), 0), 6) AS avg_confidence FROM a WHERE key IN (SELECT key FROM b) UNION ALL SELECT 'only_a', count(*), round(coalesce(avg(c), 0), 6) FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'only_b', count(*), round(coalesce(avg(c), 0), 6) FROM b WHERE key NOT IN (SELECT key FROM a)")
def jn18(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.compare_results(_flagged(spark, sf, "A"), _flagged(spark, sf, "R")).select("part", "n", r6("avg_confidence", "avg_confidence"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("fixture_path"), F.col("o_totalprice").alias("f1_score"), "o_custkey")


@query("srt8_last_two", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS k FROM orders) SELECT o_orderpriority AS fixture_path, max(CASE WHEN k = 2 THEN o_totalprice END) AS older, max(CASE WHEN k = 1 THEN o_totalprice END) AS newer FROM r WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2")
def srt8(spark: SparkSession, sf: str) -> DataFrame:
    return run_store.last_two(_history(spark, sf))


@query("srt9_latest", "SELECT o_orderpriority AS fixture_path, arg_max(o_totalprice, o_orderkey) AS latest, max(o_orderkey) AS latest_run FROM orders GROUP BY 1")
def srt9(spark: SparkSession, sf: str) -> DataFrame:
    return run_store.latest(_history(spark, sf))


@query("srt7_list_runs", "SELECT o_orderkey AS id, o_totalprice AS f1_score FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def srt7(spark: SparkSession, sf: str) -> DataFrame:
    return run_store.list_runs(_history(spark, sf).select(F.col("run_id").alias("id"), "f1_score"))


@query("jn19_run_join", "SELECT o_orderkey AS run_id, o_orderpriority AS fixture_path, o_totalprice AS f1_score, o_custkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn19(spark: SparkSession, sf: str) -> DataFrame:
    return run_store.joined(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber"), _history(spark, sf).withColumnRenamed("run_id", "id"))


@query("jn20_name_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn20(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("name"))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Completed").otherwise("Probed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), state.alias("state"), F.col("o_totalprice").alias("elapsed"))


@query("agg11_flt12_sync", "SELECT count_if(o_orderstatus <> 'F')::BIGINT AS probed, count_if(o_orderstatus = 'O')::BIGINT AS analyzed, count_if(o_orderstatus = 'F')::BIGINT AS is_failed, count_if(o_orderstatus IN ('F', 'O'))::BIGINT AS is_terminal, count(*) AS total FROM orders")
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sync_counts(_status(spark, sf))


@query("agg16_snk7_summary", "SELECT count_if(o_orderstatus = 'O')::BIGINT AS completed, count_if(o_orderstatus = 'F')::BIGINT AS failed, max(o_totalprice) AS max_elapsed FROM orders")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    return reports.processing_summary(_status(spark, sf))


@query("agg12_ratios", "WITH c AS (SELECT count_if(quality = 1 AND toxic = 0) AS tp, count_if(quality = 1 AND toxic = 1) AS fp, count_if(quality = 0 AND toxic = 0) AS fn FROM labels) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_score FROM c")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    c = table(spark, sf, "labels").agg(F.count_if((q == 1) & (t == 0)).alias("tp"), F.count_if((q == 1) & (t == 1)).alias("fp"), F.count_if((q == 0) & (t == 0)).alias("fn"))
    return c.select(*evaluate.ratios(F.col("tp"), F.col("fp"), F.col("fn"))).select(*[r6(x, x) for x in ("precision", "recall", "f1_score")])


@query("agg14_removable", f"WITH {SEG} SELECT sum(end_time - start_time) AS seconds FROM s")
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    return reports.removable_seconds(line_segments(spark, sf))


@query("agg15_leaders", "WITH r AS (SELECT c_mktsegment AS a, round(avg(c_acctbal), 2) AS f, min(c_acctbal) AS t, count(*)::DOUBLE AS s FROM customer GROUP BY 1) SELECT arg_max(a, (f, a)) AS best_f1, arg_min(a, (t, a)) AS best_timing, arg_min(a, (s, a)) AS fastest FROM r")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("algorithm")).agg(F.round(F.avg("c_acctbal"), 2).alias("f1_score"), F.min("c_acctbal").alias("timing_mean_abs_error_ms"), F.count("*").cast("double").alias("seconds"))
    return evaluate.leaders(r.withColumn("error", F.lit(None).cast("string")), "seconds")


@query("detx5_cut_plan", f"WITH {SEG}, {KEEPS.format('s')}, kk AS (SELECT * FROM k WHERE start_time < end_time), t AS (SELECT DISTINCT episode_id FROM s) SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY start_time)::INTEGER AS seg_no, 'cut' AS action, start_time, end_time, printf('-ss %.3f -to %.3f -c copy', start_time, end_time) AS arguments FROM kk WHERE episode_id IN (SELECT * FROM t) UNION ALL SELECT episode_id, 1, 'copy', 0.0, duration, '-c copy' FROM dur WHERE episode_id NOT IN (SELECT * FROM t) UNION ALL SELECT episode_id, 0, 'empty', 0.0, 0.0, '' FROM dur WHERE episode_id IN (SELECT * FROM t) AND episode_id NOT IN (SELECT episode_id FROM kk)")
def detx5(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cut_plan(line_segments(spark, sf).select("episode_id", "start_time", "end_time"), _durations(spark, sf))


# Detectors: ordered folds, which SQL can't express; tests hold them against planted segments and plain models.


def _doc_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"))


def _label_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").alias("episode_id")).distinct().withColumn("name", F.concat(F.lit("label-"), F.col("episode_id").cast("string")))


@query(
    "detv0_full_duplicates",
    DUPES.format("RECURSIVE")
    + ", e AS (SELECT ep1 AS a, ep2 AS b FROM dp UNION ALL SELECT ep2, ep1 FROM dp), c AS (SELECT a AS node, a AS reach FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a), k AS (SELECT node, min(reach) AS component FROM c GROUP BY node), "
    "sp AS (SELECT episode_id, min(ts) AS s, max(ts) AS e FROM f GROUP BY 1) "
    "SELECT arg_min(s, node) AS start_time, arg_min(e, node) AS end_time, count(*)::INTEGER AS n_episodes, min(node)::BIGINT AS first, 1.0::DOUBLE AS confidence FROM k JOIN sp ON node = episode_id GROUP BY component HAVING count(*) >= 2 AND arg_min(e, node) - arg_min(s, node) >= 2",
)
def detv0(spark: SparkSession, sf: str) -> DataFrame:
    found = detectors.full_duplicates(doc_frames(spark, sf), _doc_names(spark, sf), DetectConfig(threshold=2, min_duration=2.0))
    first = F.array_min(F.transform("episode_list", lambda x: F.regexp_extract(x, "([0-9]+)", 1).cast("long")))
    return found.select("start_time", "end_time", F.size("episode_list").alias("n_episodes"), first.alias("first"), "confidence")


def _hash_segments(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.spectral_hash(doc_frames(spark, sf), _doc_names(spark, sf), DetectConfig(threshold=3, min_duration=2.0, window_frames=3))


@query("deta1_chromaprint")
def deta1(spark: SparkSession, sf: str) -> DataFrame:
    rolled = windows.rolling_hash(doc_frames(spark, sf), 3).select("episode_id", F.col("start_time").alias("ts"), "hash")
    return detectors.chromaprint(rolled, _doc_names(spark, sf), DetectConfig(threshold=2, min_duration=5.0))


@query("deta3_spectral_v2")
def deta3(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.spectral_v2(emb_frames(spark, sf), _label_names(spark, sf), DetectConfig(threshold=2, min_duration=2.0), width=5)


@query("deta4_energy_bands")
def deta4(spark: SparkSession, sf: str) -> DataFrame:
    rows = emb_frames(spark, sf).select("episode_id", "frame_idx", "ts", F.transform("embedding", lambda x: F.abs(x)).alias("bands"), F.lit(1.0).alias("rms_energy"))
    return detectors.energy_bands(rows, _label_names(spark, sf), DetectConfig(threshold=2, min_duration=2.0), width=5, stride=3)


@query("deta6_cross_correlation")
def deta6(spark: SparkSession, sf: str) -> DataFrame:
    # One bit of a word: by chance alone chunks agree now and then.
    frames = emb_frames(spark, sf).withColumn("hash", F.col("hash").bitwiseAND(F.lit(1)))
    return detectors.cross_correlation(frames, _label_names(spark, sf), DetectConfig(threshold=2, min_duration=2.0, window_frames=10))


@query("detv4_ssim")
def detv4(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.ssim(emb_frames(spark, sf), _label_names(spark, sf), DetectConfig(threshold=2, min_duration=2.0, window_frames=5))


@query("detv5_time_shifted")
def detv5(spark: SparkSession, sf: str) -> DataFrame:
    # Two sequences, long enough for chunks of 50, of words with four bits: by chance less than three bits a word differ.
    order = Window.partitionBy("episode_id").orderBy("vec_id")
    rows = emb_frames(spark, sf).select((F.col("vec_id") % 2).alias("episode_id"), "vec_id", F.col("hash").bitwiseAND(F.lit(15)).alias("hash"))
    frames = rows.withColumn("frame_idx", F.row_number().over(order) - 1).withColumn("ts", F.col("frame_idx").cast("double"))
    return detectors.time_shifted(frames, _label_names(spark, sf), DetectConfig(threshold=2, min_duration=2.0))


@query("deta2_mfcc")
def deta2(spark: SparkSession, sf: str) -> DataFrame:
    value = F.transform("embedding", lambda x: x.cast("double") / 8)
    # Labels hold more than ten minutes of rows, at 0.1 s a row, from sf0.1 on.
    rows = emb_frames(spark, sf).select("episode_id", "frame_idx", (F.col("ts") * 0.1).alias("ts"), value.alias("coefficients"), value.alias("deltas"), value.alias("delta_deltas"))
    return detectors.mfcc(rows, _label_names(spark, sf), DetectConfig(threshold=2, min_duration=0.1), width=5, stride=15)


SUPPLIES = "s AS (SELECT l_suppkey::BIGINT AS series, (l_orderkey % 5000)::DOUBLE AS start_time, (l_orderkey % 5000)::DOUBLE + l_quantity::DOUBLE / 4 AS end_time, 'p' || (l_partkey % 20)::VARCHAR AS name, l_discount::DOUBLE AS confidence FROM lineitem)"


def _fold_sql(joins_: str, end: str, names: str, value: str) -> str:
    """A fold over each series' segments in order: ``a`` is the segment so far, ``b`` the next one, which ``joins_`` it or stands alone."""
    own = "{{'s': {0}.s, 'e': {0}.e, 'eps': {0}.eps, 'c': {0}.c}}"
    return f"""
WITH {SUPPLIES},
o AS (SELECT series, list({{'found': []::STRUCT(s DOUBLE, e DOUBLE, eps VARCHAR[], c DOUBLE)[], 's': start_time, 'e': end_time, 'eps': [name], 'c': confidence}} ORDER BY start_time, end_time, name, confidence) AS xs FROM s GROUP BY series),
r AS (SELECT series, list_reduce(xs, lambda a, b: CASE WHEN {joins_}
  THEN {{'found': a.found, 's': a.s, 'e': {end}, 'eps': {names}, 'c': {value}}}
  ELSE {{'found': list_append(a.found, {own.format("a")}), 's': b.s, 'e': b.e, 'eps': b.eps, 'c': b.c}} END) AS z FROM o),
u AS (SELECT series, unnest(list_append(z.found, {own.format("z")})) AS x FROM r)
SELECT series, x.s AS start_time, x.e AS end_time, array_to_string(x.eps, ',') AS episodes, x.c AS confidence FROM u
"""


def _supplies(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("l_orderkey") % 5000).cast("double")
    none = F.lit(None).cast("double")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("series"),
        start.alias("start_time"),
        (start + F.col("l_quantity").cast("double") / 4).alias("end_time"),
        F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string"))).alias("episode_list"),
        F.lit(None).cast("array<struct<episode_name:string,start_time:double,end_time:double>>").alias("episode_timings"),
        F.col("l_discount").cast("double").alias("confidence"),
        none.alias("video_confidence"),
        none.alias("audio_confidence"),
        F.lit("audio").alias("match_type"),
    )


def _folded(spark: SparkSession, sf: str, fold) -> DataFrame:
    out = folds.fold_segments(_supplies(spark, sf), fold)
    return out.select("series", "start_time", "end_time", F.array_join("episode_list", ",").alias("episodes"), "confidence")


UNION_LIST = "list_concat(a.eps, list_filter(b.eps, lambda x: NOT list_contains(a.eps, x)))"


@query("int2_set1_merge", _fold_sql("a.e > b.s OR b.s - a.e <= 2", "greatest(a.e, b.e)", UNION_LIST, "greatest(a.c, b.c)"))
def int2(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf, folds.merge_segments)


@query("int3_running_merge", _fold_sql("b.s - a.e <= 5", "greatest(a.e, b.e)", "list_sort(list_distinct(list_concat(a.eps, b.eps)))", "(a.c + b.c) / 2"))
def int3(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf, folds.merge_segments_running)


HALF = "least(a.e, b.e) - greatest(a.s, b.s) > 0 AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 * least(a.e - a.s, b.e - b.s)"


@query("int5_audio_merge", _fold_sql(f"({HALF}) OR (b.s - a.e >= 0 AND b.s - a.e < 2 AND a.e - a.s < 60 AND b.e - b.s < 60)", "greatest(a.e, b.e)", UNION_LIST, "greatest(a.c, b.c)"))
def int5(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf, folds.merge_audio)


@query("int10_srt2_near_repeats", _fold_sql("abs(a.s - b.s) < 3.0 AND abs(a.e - b.e) < 3.0", "a.e", "a.eps", "a.c"))
def int10(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf, lambda found: folds.drop_near_repeats(found, 3.0))


@query(
    "flt1_min_duration",
    f"WITH {DOC}, {_rolled(3)} SELECT hash, count(*) AS n, count(DISTINCT episode_id) AS n_episodes, round(avg(end_time - start_time), 6) AS duration FROM (SELECT hash, episode_id, start_time, end_time + (episode_id % 3)::DOUBLE AS end_time FROM r) GROUP BY hash HAVING count(*) >= 2 AND count(DISTINCT episode_id) >= 2 AND avg(end_time - start_time) >= 3",
)
def flt1_groups(spark: SparkSession, sf: str) -> DataFrame:
    rolled = windows.rolling_hash(doc_frames(spark, sf), 3).withColumn("end_time", F.col("end_time") + (F.col("episode_id") % 3).cast("double"))
    return detectors.hash_groups(rolled, 2, "hash", 3.0).select("hash", "n", "n_episodes", r6("duration", "duration"))


@query(
    "detv1_jn13_opening",
    f"WITH {EMB}, z AS (SELECT episode_id, count(*) AS n FROM f GROUP BY 1), low AS (SELECT CASE WHEN min(n) < 5 THEN 0 ELSE min(n) END AS low FROM z), "
    "h AS (SELECT f.* FROM f, low WHERE frame_idx < least(160, low)), q AS (SELECT frame_idx, hash AS ref FROM h WHERE episode_id = (SELECT min(episode_id) FROM f)), "
    "w AS (SELECT episode_id, max(bit_count(xor(hash, ref))) AS worst, min(ts) AS s, max(ts) AS e FROM h JOIN q USING (frame_idx) GROUP BY 1) "
    "SELECT min(s) AS start_time, max(e) AS end_time, count(*)::INTEGER AS n_episodes, 1.0::DOUBLE AS confidence, 'video' AS match_type FROM w WHERE worst <= 51 HAVING count(*) >= 2 AND max(e) - min(s) >= 2",
)
def detv1(spark: SparkSession, sf: str) -> DataFrame:
    out = detectors.opening(emb_frames(spark, sf), _label_names(spark, sf), DetectConfig(threshold=2, min_duration=2.0, similarity_threshold=0.2))
    return out.select("start_time", "end_time", F.size("episode_list").alias("n_episodes"), "confidence", "match_type")


@query("s25_synthetic_signature", f"WITH {EMB} SELECT vec_id, round(u / 18446744073709551616.0, 6) AS a, round((u >> 32) / 4294967295.0, 6) AS b, round((u & 4294967295) / 4294967295.0, 6) AS c, round(((u >> 16) & 65535) / 65535.0, 6) AS d FROM f")
def s25(spark: SparkSession, sf: str) -> DataFrame:
    parts = hashing.synthetic_signature(F.col("hash"))
    return emb_frames(spark, sf).withColumn("sig", parts).select("vec_id", *[r6(F.col("sig")[i], c) for i, c in enumerate("abcd")])


SPREAD = 0x3333333333333333


@query("jn4_spread_words", f"WITH {EMB}, g AS (SELECT vec_id, hash & {SPREAD} AS h FROM f) SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.h, y.h))::INTEGER AS distance FROM g x JOIN g y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.h, y.h)) <= 5")
def jn4_spread(spark: SparkSession, sf: str) -> DataFrame:
    return joins.hamming_join(emb_frames(spark, sf).select("vec_id", F.col("hash").bitwiseAND(F.lit(SPREAD)).alias("hash")), 5, "vec_id")


@query("str1_stream_rolling_hash", f"WITH {CONV}, {_rolled(3)} SELECT episode_id, frame_idx::BIGINT AS frame_idx, hash, start_time, end_time FROM r")
def str1(spark: SparkSession, sf: str) -> DataFrame:
    """The frames of conversations as a stream that arrives in two parts, by two runs over one checkpoint."""
    frames = conv_frames(spark, sf).select("episode_id", F.col("frame_idx").cast("long").alias("frame_idx"), "ts", "hash")
    arriving, out, checkpoint = (fresh_dir(spark, f"stream-{x}") for x in ("in", "out", "state"))
    for late in (False, True):
        frames.filter((F.col("frame_idx") >= 2) == F.lit(late)).write.mode("append").parquet(arriving)
        stream = rolling.stream_rolling_hash(spark.readStream.schema(frames.schema).parquet(arriving), 3)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rolling.OUT).parquet(out)


@query("snk5_json_summary")
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    return reports.json_summary(_hash_segments(spark, sf), _status(spark, sf))


from . import fold_queries  # noqa: E402, F401  registers its queries
