"""Sequence joins: exact, by Hamming radius, by nearest window, by offset-aligned landmarks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import kernels
from ..functions.hashing import hamming
from ..storage import discard, materialize
from .windows import series_of

BAND_LIMIT = 8
#: Scores that a task holds at a time.
SCORES = 1 << 20
PAIR_SCHEMA = "ep1 long, ep2 long, start1 double, end1 double, start2 double, end2 double, match_count int, score double"


def landmark_matches(landmarks: DataFrame) -> DataFrame:
    """JN-2: (ep1, ep2, t1, t2) of equal hashes in two sequences (of a series), ep1 < ep2. A sort-merge join; adaptive execution splits hot hashes."""
    keys = ["hash", *series_of(landmarks)]
    a = landmarks.select(*keys, F.col("episode_id").alias("ep1"), F.col("ts").alias("t1"))
    b = landmarks.select(*keys, F.col("episode_id").alias("ep2"), F.col("ts").alias("t2"))
    return a.join(b.hint("merge"), keys).filter("ep1 < ep2").select("ep1", "ep2", "t1", "t2")


def offset_bins(matches: DataFrame, width: float = 5.0) -> DataFrame:
    """Matches counted by rounded time offset: the histogram that regions are built from."""
    return matches.groupBy("ep1", "ep2", F.round((F.col("t2") - F.col("t1")) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("t1").alias("t1_min"), F.max("t1").alias("t1_max"))


def dense_regions(times: list[tuple[float, float]], gap: float = 3.0, least: float = 5.0, most: float = 240.0, density: float = 0.05, matches: int = 3) -> list[tuple[float, float, float, float, int]]:
    """JN-3 for one offset bin: runs of matches that stay dense, as (start1, end1, start2, end2, count)."""
    times = sorted(times)
    out, at = [], 0
    while at < len(times):
        t1, t2 = times[at]
        last = at
        while last + 1 < len(times):
            after = times[last + 1][0]
            if after - times[last][0] >= gap or after - t1 >= most or (last + 2 - at) / max(after - t1, 1.0) < density:
                break
            last += 1
        n, d1, d2 = last + 1 - at, times[last][0] - t1, times[last][1] - t2
        if n >= matches and n / max(d1, 1.0) >= density and least <= d1 <= most and least <= d2 <= most:
            out.append((t1, times[last][0], t2, times[last][1], n))
        at = last + 1
    return out


def landmark_regions(matches: DataFrame, width: float = 5.0, gap: float = 3.0, least: float = 5.0, most: float = 240.0, density: float = 0.05, count: int = 3) -> DataFrame:
    """JN-3: pair_matches rows, :func:`dense_regions` of each (ep1, ep2, offset bin), folded over its sorted times in the JVM."""
    bin_ = F.round((F.col("t2") - F.col("t1")) / width).cast("int")
    binned = matches.groupBy("ep1", "ep2", bin_.alias("bin")).agg(F.sort_array(F.collect_list(F.struct("t1", "t2"))).alias("m"))
    # Bins that can hold no region: too few matches, or too short a span.
    binned = binned.filter((F.size("m") >= count) & (F.element_at("m", -1)["t1"] - F.element_at("m", 1)["t1"] >= least))

    def state(found: Column, s1: Column, s2: Column, l1: Column, l2: Column, n: Column) -> Column:
        return F.struct(found.alias("found"), s1.alias("s1"), s2.alias("s2"), l1.alias("l1"), l2.alias("l2"), n.alias("n"))

    def closed(a: Column) -> Column:
        d1, d2 = a["l1"] - a["s1"], a["l2"] - a["s2"]
        good = (a["n"] >= count) & (a["n"] / F.greatest(d1, F.lit(1.0)) >= density) & d1.between(least, most) & d2.between(least, most)
        run = F.struct(a["s1"].alias("start1"), a["l1"].alias("end1"), a["s2"].alias("start2"), a["l2"].alias("end2"), a["n"].alias("n"))
        return F.when(good, F.concat(a["found"], F.array(run))).otherwise(a["found"])

    def step(a: Column, x: Column) -> Column:
        after = x["t1"] - a["s1"]
        goes_on = (x["t1"] - a["l1"] < gap) & (after < most) & ((a["n"] + 1) / F.greatest(after, F.lit(1.0)) >= density)
        more, new = state(a["found"], a["s1"], a["s2"], x["t1"], x["t2"], a["n"] + 1), state(closed(a), x["t1"], x["t2"], x["t1"], x["t2"], F.lit(1))
        return F.when((a["n"] > 0) & goes_on, more).otherwise(new)

    runs = "array<struct<start1:double,end1:double,start2:double,end2:double,n:int>>"
    zero = F.lit(0.0)
    start = state(F.array().cast(runs), zero, zero, zero, zero, F.lit(0))
    found = binned.select("ep1", "ep2", F.explode(F.aggregate("m", start, step, closed)).alias("r"))
    return found.select(F.col("ep1").cast("long").alias("ep1"), F.col("ep2").cast("long").alias("ep2"), "r.start1", "r.end1", "r.start2", "r.end2", F.col("r.n").alias("match_count"), F.col("r.n").cast("double").alias("score"))


def block_counts(df: DataFrame, size: int, within: list[str], name: str = "nb") -> DataFrame:
    """``df`` with the number of blocks of about ``size`` rows that its rows, or those with the same ``within``, make up."""
    if not within:
        return df.withColumn(name, F.lit(max(1, -(-df.count() // size))))
    counts = materialize(df.groupBy(*within).agg(F.ceil(F.count("*") / size).cast("int").alias(name)), "blocks")
    # A table of its own, so that a hot series can be split.
    return df.join(counts.hint("merge"), within)


def dealt_pairs(one: DataFrame, two: DataFrame, keep: Column, size: int) -> DataFrame:
    """All pairs of rows of two tables (of a series, where both have the column) for which ``keep`` holds, by an equi-join on pairs of blocks of about ``size`` rows.

    Each row goes into a block at random and to every block of the other table, so the work is
    split evenly whatever the keys.
    """
    within = series_of(one) if series_of(two) else []
    place = lambda df: F.pmod(F.xxhash64(*[c for c in df.columns if c not in within][:2]), F.lit(1 << 30)).cast("int")
    if within:
        sizes = [materialize(df.groupBy(*within).agg(F.ceil(F.count("*") / size).cast("int").alias(n)), "blocks") for df, n in ((one, "nx"), (two, "ny"))]
        blocks = materialize(sizes[0].join(sizes[1].hint("merge"), within), "blocks")
        a, b = (df.withColumn("place", place(df)).join(blocks.hint("merge"), within) for df in (one, two))
    else:
        counts = {n: F.lit(max(1, -(-df.count() // size))) for df, n in ((one, "nx"), (two, "ny"))}
        a, b = (df.withColumns({"place": place(df), **counts}) for df in (one, two))
    a = a.withColumns({"bx": F.pmod("place", "nx"), "by": F.explode(F.sequence(F.lit(0), F.col("ny") - 1))}).drop("place", "nx", "ny")
    b = b.withColumns({"by": F.pmod("place", "ny"), "bx": F.explode(F.sequence(F.lit(0), F.col("nx") - 1))}).drop("place", "nx", "ny")
    return a.join(b.hint("merge"), [*within, "bx", "by"]).filter(keep).drop("bx", "by")


def _met_blocks(rows: DataFrame, size: int, keys: list[str], within: list[str]) -> DataFrame:
    """``rows``, once for every block that their own (``block``) meets; ``lo`` and ``hi`` are a pair's blocks, of about ``size`` rows each."""
    counted = block_counts(rows, size, within).withColumn("block", F.pmod(F.xxhash64(*keys), F.col("nb")).cast("int"))
    dealt = counted.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))))
    return dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("nb", "other")


def _sides(table: pa.Table) -> list[tuple[pa.Table, pa.Table]]:
    """The two orders in which a pair of blocks is compared; the pair of a block with itself is one."""
    block = table.column("block").to_numpy()
    if block.min() == block.max():
        own = [(table, table)] if table.column("lo")[0] == table.column("hi")[0] else []
        return own
    low = table.filter(pa.array(block == block.min()))
    high = table.filter(pa.array(block == block.max()))
    return [(low, high), (high, low)]


def hamming_join(words: DataFrame, radius: int, key: str = "id", value: str = "hash", block_rows: int = 8192) -> DataFrame:
    """JN-4, JN-5: (a, b, distance) of rows with a < b whose words are within ``radius`` bits; exact for any radius.

    Up to ``BAND_LIMIT`` bits the words are cut into radius + 1 bands, one of which has to be
    equal (pigeonhole), so the join is by (band, value). Above, bands get too short to tell
    words apart: rows are dealt into blocks of about ``block_rows``, and each pair of blocks is
    compared in one task. Words with a ``series`` are compared inside it.
    """
    within = series_of(words)
    rows = words.select(F.col(key).alias("id"), F.col(value).alias("h"), *within)
    if radius <= BAND_LIMIT:
        edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
        bands = F.array(*[F.shiftrightunsigned(F.shiftleft("h", 64 - b), 64 - b + a) if b < 64 else F.shiftrightunsigned("h", a) for a, b in zip(edges, edges[1:], strict=False)])
        cut = rows.select("id", "h", *within, F.posexplode(bands).alias("band", "part"))
        other = cut.select(F.col("id").alias("b"), F.col("h").alias("hb"), *within, "band", "part")
        near = cut.join(other.hint("merge"), [*within, "band", "part"]).filter((F.col("id") < F.col("b")) & (hamming(F.col("h"), F.col("hb")) <= radius))
        return near.select(F.col("id").alias("a"), "b", hamming(F.col("h"), F.col("hb")).alias("distance")).distinct()
    counted = block_counts(rows, block_rows, within)
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = dealt.select("id", "h", *within, "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    left = dealt.filter("block <= other").withColumnsRenamed({"id": "x", "h": "hx"})
    right = dealt.filter("block >= other").select(F.col("id").alias("y"), F.col("h").alias("hy"), *within, F.col("other").alias("block"), F.col("block").alias("other"))

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(two):
            same = one["block"].iloc[0] == one["other"].iloc[0]
            hy, y = two["hy"].to_numpy(np.int64).view(np.uint64), two["y"].to_numpy()
            for x, h in zip(one["x"], one["hx"].to_numpy(np.int64).view(np.uint64), strict=True):
                d = np.bitwise_count(hy ^ h)
                for i in np.flatnonzero(d <= radius):
                    if (x < y[i]) if same else (x != y[i]):
                        out.append((min(x, y[i]), max(x, y[i]), int(d[i])))
        return pd.DataFrame(out, columns=["a", "b", "distance"])

    keys = [*within, "block", "other"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long, distance int")


def leader_clusters(rows: DataFrame, radius: int, first_fit: bool = False) -> DataFrame:
    """Leader clustering of (id, hash) rows (of each series) in id order, exact and distributed: adds ``leader`` and ``distance``.

    In order, a row joins the nearest leader within ``radius`` (ties to the earlier leader; with
    ``first_fit`` the earliest one), or becomes one. The leaders are the greedy independent set of the similarity graph, which
    rounds over all rows find: a row with no undecided or leading neighbour before it leads;
    a row with a leader before it follows. Equal words are one vertex, at their first row.
    """
    within = series_of(rows)
    words = materialize(rows.groupBy("hash", *within).agg(F.min("id").alias("id")), "words")
    edges = materialize(hamming_join(words, radius), "edges")
    # state: 0 undecided, 1 leads, 2 follows
    state = materialize(words.select("id", F.lit(0).alias("state")), "state")
    while True:
        before = edges.join(state.select(F.col("id").alias("a"), F.col("state").alias("sa")).hint("merge"), "a").groupBy("b").agg(F.max((F.col("sa") == 1).cast("int")).alias("led"), F.max((F.col("sa") == 0).cast("int")).alias("waits"))
        judged = state.join(before.hint("merge"), state.id == before.b, "left")
        new = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("led", F.lit(0)) == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        after = materialize(judged.select("id", new.alias("state")), "state")
        discard(state)
        state = after
        if state.filter("state = 0").isEmpty():
            break
    leaders = state.filter("state = 1").select(F.col("id").alias("leader"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    near = both.join(leaders.hint("merge"), F.col("a") == F.col("leader")).select("leader", F.col("b").alias("word"), "distance")
    near = near.unionByName(leaders.select("leader", F.col("leader").alias("word"), F.lit(0).alias("distance")))
    placed = rows.join(words.withColumnRenamed("id", "word").hint("merge"), ["hash", *within]).join(near.hint("merge"), "word").filter("leader <= id")
    order = F.struct("leader", "distance") if first_fit else F.struct("distance", "leader")
    best = placed.groupBy("id").agg(F.min(order).alias("x")).select("id", "x.leader", "x.distance")
    return rows.join(best.hint("merge"), "id")


def _nearest_in_blocks(kernel, one: pa.Table, two: pa.Table) -> list[dict[str, np.ndarray]]:
    """For each window of ``one`` the best one of ``two`` of each later sequence, region by region."""
    columns = ("ep", "pos", "start", "end", "region", "whole")
    a0, b0 = ({c: t.column(c).to_numpy() for c in columns} for t in (one, two))
    va, vb = (kernel.load(t.column("v").combine_chunks()) for t in (one, two))
    keys, out = kernel.keys(vb), []
    for region in np.intersect1d(a0["region"], b0["region"]):
        ia = np.flatnonzero(a0["region"] == region)
        ia = ia[np.argsort(a0["ep"][ia], kind="stable")]
        ib = np.flatnonzero(b0["region"] == region)
        # Of equal windows of a sequence only the first one can be the best.
        ib = ib[np.lexsort((b0["pos"][ib], keys[ib], b0["ep"][ib]))]
        fresh = np.ones(len(ib), bool)
        fresh[1:] = (keys[ib][1:] != keys[ib][:-1]) | (b0["ep"][ib][1:] != b0["ep"][ib][:-1])
        ib = ib[fresh]
        ib = ib[np.lexsort((b0["pos"][ib], b0["ep"][ib]))]
        a, b = kernels.take(a0, ia), kernels.take(b0, ib)
        xa, xb = kernels.take(va, ia), kernels.take(vb, ib)
        step, at = max(1, SCORES // max(1, len(ib))), 0
        while at < len(ia):
            rows = slice(at, at + step)
            at += step
            first = int(np.searchsorted(b["ep"], a["ep"][rows][0], side="right"))
            if first == len(ib):
                break
            own, others = kernels.take(xa, rows), kernels.take(xb, slice(first, None))
            eps = b["ep"][first:]
            starts = np.flatnonzero(np.concatenate([[True], eps[1:] != eps[:-1]]))
            lengths = np.diff(np.append(starts, len(eps)))
            order = kernel.order(own, others)
            if order.dtype.kind == "f":
                order[np.isnan(order)] = np.inf
            least = np.minimum.reduceat(order, starts, axis=1)
            meets = a["ep"][rows][:, None] < eps[starts][None, :]
            if region != 0:
                meets &= ~(a["whole"][rows][:, None] & b["whole"][first:][starts][None, :])
            near = order <= np.repeat(least + kernel.slack(own, others) if order.dtype.kind == "f" else least, lengths, axis=1)
            near &= np.repeat(meets, lengths, axis=1)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            score = np.concatenate([kernel.exact(kernels.take(own, i[k : k + 2048]), kernels.take(others, j[k : k + 2048])) for k in range(0, len(i), 2048)])
            rank = -score if kernel.largest else score
            group = np.repeat(np.arange(len(starts)), lengths)[j]
            # Columns of ``b`` are in order of position inside a sequence.
            best = np.lexsort((j, rank, group, i))
            best = best[np.concatenate([[True], (i[best][1:] != i[best][:-1]) | (group[best][1:] != group[best][:-1])])]
            i, j, score = i[best] + rows.start, j[best] + first, score[best]
            left, right = kernels.take(a, i), kernels.take(b, j)
            out.append({"ep1": left["ep"], "ep2": right["ep"], "region1": left["region"], "pos1": left["pos"], "start1": left["start"], "end1": left["end"], "start2": right["start"], "end2": right["end"], "pos2": right["pos"], "score": score})
    return out


def _kernel_windows(windows: DataFrame, kernel, block_rows: int) -> DataFrame:
    """The best window of each pair of blocks, sequence and window; one row for each pair of blocks that has one."""
    within = series_of(windows)
    names = {"ep": "episode_id", "pos": "pos", "start": "start_time", "end": "end_time", "region": "region", "whole": "whole", "v": "values"}
    rows = windows.filter(F.col("episode_id").isNotNull() & kernel.valid(F.col("values")))
    rows = rows.select(*[F.col(c).alias(n) for n, c in names.items()], kernel.shape(F.col("values")).alias("shape"), *within)
    kind = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField(c, kind[c.rstrip("12")]) for c in ("ep1", "ep2", "region1", "pos1", "start1", "end1", "start2", "end2", "pos2")] + [StructField("score", DoubleType())])

    def compare(table: pa.Table) -> pa.Table:
        found = [x for one, two in _sides(table) for x in _nearest_in_blocks(kernel, one, two)]
        types = {c: table.schema.field(c.rstrip("12")).type for c in schema.names[:-1]} | {"score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate([x[c] for x in found]) if found else [], types[c]) for c in schema.names})

    dealt = _met_blocks(rows, block_rows, ["ep", "region", "pos"], within)
    return dealt.groupBy(*within, "shape", "lo", "hi").applyInArrow(compare, schema)


def nearest_windows(windows: DataFrame, score: Callable[[Column, Column], Column] | kernels.Words | kernels.MfccDistance | kernels.EnergyCorrelation, largest: bool, accept: Callable[[Column], Column], block_rows: int | None = None) -> DataFrame:
    """JN-6, JN-7, JN-8: for each window (episode_id, pos, start_time, end_time, values) the best one of each later sequence; ties to the earlier position.

    Sequences are joined pairwise by design (ep1 < ep2), those of one series where windows have
    the column. Where windows have a ``region`` (and ``whole``: the sequence is in all regions),
    they meet inside it, and two whole sequences only once.

    A kernel for ``score`` compares two blocks of windows at once and leaves the best ones only;
    with a column expression every pair is a row. Windows without a score have no best one.
    """
    if "region" not in windows.columns:
        windows = windows.withColumns({"region": F.lit(0), "whole": F.lit(True)})
    if hasattr(score, "order"):
        # Words are short and quickly compared; longer values are held by the hundred megabytes.
        pairs = _kernel_windows(windows, score, block_rows or (32768 if isinstance(score, kernels.Words) else 4096))
        order = -F.col("score") if largest else F.col("score")
        best = pairs.groupBy("ep1", "ep2", "region1", "pos1").agg(F.min_by(F.struct("start1", "end1", "start2", "end2", "pos2", "score"), F.struct(order, "pos2")).alias("m"))
        return best.select("ep1", "ep2", "pos1", "m.*").filter(accept(F.col("score")))
    names = {"ep": "episode_id", "pos": "pos", "start": "start_time", "end": "end_time", "v": "values", "region": "region", "whole": "whole"}
    side = lambda i: windows.select(*[F.col(c).alias(f"{n}{i}") for n, c in names.items()], *series_of(windows))
    meet = (F.col("ep1") < F.col("ep2")) & (F.col("region1") == F.col("region2")) & ((F.col("region1") == 0) | ~F.col("whole1") | ~F.col("whole2"))
    pairs = dealt_pairs(side(1), side(2), meet, block_rows or 2048).withColumn("score", score(F.col("v1"), F.col("v2"))).drop("v1", "v2")
    order = -F.col("score") if largest else F.col("score")
    best = pairs.groupBy("ep1", "ep2", "region1", "pos1").agg(F.min_by(F.struct("start1", "end1", "start2", "end2", "pos2", "score"), F.struct(order, "pos2")).alias("m"))
    return best.select("ep1", "ep2", "pos1", "m.*").filter(accept(F.col("score")))


def full_duplicates(frames: DataFrame, sampled: DataFrame, ratio: float = 0.95) -> DataFrame:
    """JN-12: pairs of sequences of equal length (of a series) whose sampled positions agree in at least ``ratio`` of cases.

    Candidates share a length and some sampled frame, so the join is by (n, position, hash);
    a pair with no equal frame can't reach any positive ratio.
    """
    keys = ["n", "frame_idx", "hash", *series_of(sampled)]
    own = sampled.select("episode_id", *keys)
    a = own.select(*keys, F.col("episode_id").alias("ep1"))
    b = own.select(*keys, F.col("episode_id").alias("ep2"))
    same = a.join(b.hint("merge"), keys).filter("ep1 < ep2").groupBy("ep1", "ep2", "n").agg(F.count("*").alias("equal"))
    asked = F.when(F.col("n") <= 30, F.col("n")).otherwise(F.lit(30))
    return same.withColumn("share", F.col("equal") / asked).filter(F.col("share") >= ratio).select("ep1", "ep2", "n", "share")


def duplicate_links(sampled: DataFrame, ratio: float = 0.95) -> DataFrame:
    """(a, b) links whose components are those of JN-12's pairs.

    Sequences with the same samples are a class: its members are linked with the smallest one,
    and only these meet in the join, so m copies give m links and not m * m pairs.
    """
    whole = F.array_sort(F.collect_list(F.struct("frame_idx", "hash")))
    per = sampled.groupBy("episode_id", "n", *series_of(sampled)).agg(F.md5(whole.cast("string").cast("binary")).alias("digest"))
    classes = materialize(per.groupBy("n", "digest", *series_of(sampled)).agg(F.min("episode_id").alias("low")), "classes")
    members = per.join(classes.hint("merge"), ["n", "digest", *series_of(sampled)]).filter("low < episode_id").select(F.col("low").alias("a"), F.col("episode_id").alias("b"))
    firsts = sampled.join(classes.select(F.col("low").alias("episode_id")).hint("merge"), "episode_id", "left_semi")
    return members.unionByName(full_duplicates(firsts, firsts, ratio).select(F.col("ep1").alias("a"), F.col("ep2").alias("b")))


def opening_matches(frames: DataFrame, radius: int, most: int = 160, least: int = 5) -> DataFrame:
    """JN-13: sequences whose first frames all lie within ``radius`` bits of the first sequence's (of the series)."""
    if not series_of(frames):
        return opening_matches(frames.withColumn("series", F.lit(0)), radius, most, least).drop("series")
    sizes = frames.groupBy("series", "episode_id").agg(F.count("*").alias("n"))
    low = F.when(F.min("n") < least, 0).otherwise(F.least(F.min("n"), F.lit(most)))
    # Tables of their own, so that a hot series can be split.
    firsts = materialize(sizes.groupBy("series").agg(low.alias("low"), F.min("episode_id").alias("first")), "firsts")
    head = frames.filter(F.col("frame_idx") < most).select("series", "episode_id", "frame_idx", "ts", "hash").join(firsts.hint("merge"), "series").filter("frame_idx < low")
    ref = materialize(head.filter("episode_id = first").select("series", "frame_idx", F.col("hash").alias("ref")), "ref")
    joined = head.join(ref.hint("merge"), ["series", "frame_idx"]).groupBy("series", "episode_id").agg(F.max(hamming(F.col("hash"), F.col("ref"))).alias("worst"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n_frames"))
    return joined.filter(F.col("worst") <= radius)


def _tumbling(frames: DataFrame, width: int) -> DataFrame:
    """Tumbling windows (episode_id, w, h, start, end), one row each."""
    n = F.count("*").over(Window.partitionBy("episode_id"))
    rows = frames.withColumn("n", n).withColumn("w", F.floor(F.col("frame_idx") / width).cast("int")).filter(F.col("w") * width < F.col("n") - width)
    packed = rows.groupBy("episode_id", "w", *series_of(frames)).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "hash"))).alias("f"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return packed.select("episode_id", "w", F.col("f.hash").alias("h"), "start", "end", *series_of(frames))


def window_grid_matches(frames: DataFrame, width: int, kernel: kernels.Signatures, least: float, block_rows: int = 4096) -> DataFrame:
    """JN-11 counted: for each tumbling window (series, ep1, w1, start1, end1) and later sequence ep2 the number ``n`` of windows with a score of ``least`` and more, and their ``total``.

    Blocks of windows are compared at once, so that pairs are no rows; a row stands for a pair of blocks, and those of a window and sequence add up.
    """
    within = series_of(frames)
    words = F.col("h")
    rows = _tumbling(frames, width).filter(F.col("episode_id").isNotNull() & F.forall(words, lambda x: x.isNotNull()))
    rows = rows.select(F.col("episode_id").alias("ep"), "w", "start", "end", kernel.value(words).alias("v"), F.size(words).alias("size"), *within)
    kind = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField(c, kind[c.rstrip("12")]) for c in (*within, "ep1", "w1", "start1", "end1", "ep2")] + [StructField("n", LongType()), StructField("total", DoubleType())])

    def count(one: pa.Table, two: pa.Table) -> list[dict[str, np.ndarray]]:
        one, two = (t.take(pa.array(np.argsort(t.column("ep").to_numpy(), kind="stable"))) for t in (one, two))
        a, b = ({c: t.column(c).to_numpy() for c in ("ep", "w", "start", "end", *within)} for t in (one, two))
        va, vb = (kernel.load(t.column("v").combine_chunks()) for t in (one, two))
        step, out = max(1, (SCORES >> 3) // len(b["ep"])), []
        for at in range(0, len(a["ep"]), step):
            mine = slice(at, at + step)
            first = int(np.searchsorted(b["ep"], a["ep"][at], side="right"))
            if first == len(b["ep"]):
                break
            eps = b["ep"][first:]
            starts = np.flatnonzero(np.concatenate([[True], eps[1:] != eps[:-1]]))
            scores = kernel.scores(kernels.take(va, mine), kernels.take(vb, slice(first, None)))
            good = scores >= least
            n = np.add.reduceat(good, starts, axis=1, dtype=np.int64)
            total = np.add.reduceat(np.where(good, scores, 0.0), starts, axis=1)
            i, g = np.nonzero((n > 0) & (a["ep"][mine][:, None] < eps[starts][None, :]))
            left = kernels.take(a, i + at)
            out.append({**{c: left[c] for c in within}, "ep1": left["ep"], "w1": left["w"], "start1": left["start"], "end1": left["end"], "ep2": eps[starts][g], "n": n[i, g], "total": total[i, g]})
        return out

    def compare(table: pa.Table) -> pa.Table:
        found = [x for one, two in _sides(table) for x in count(one, two)]
        types = {c: table.schema.field(c.rstrip("12")).type for c in schema.names[:-2]} | {"n": pa.int64(), "total": pa.float64()}
        return pa.table({c: pa.array(np.concatenate([x[c] for x in found]) if found else [], types[c]) for c in schema.names})

    return _met_blocks(rows, block_rows, ["ep", "w"], within).groupBy(*within, "size", "lo", "hi").applyInArrow(compare, schema)


def window_grid_join(frames: DataFrame, width: int, score: Callable[[Column, Column], Column], block_rows: int = 2048) -> DataFrame:
    """JN-11: tumbling windows of all pairs of sequences (of a series), scored frame by frame and averaged; the last window is left out unless frames remain behind it.

    A window is one row, and windows are dealt into blocks, so the join's keys are as many as the table is large.
    """
    packed = _tumbling(frames, width)
    side = lambda i: packed.withColumnsRenamed({"episode_id": f"ep{i}", "w": f"w{i}", "h": f"h{i}", "start": f"start{i}", "end": f"end{i}"})
    pairs = dealt_pairs(side(1), side(2), F.col("ep1") < F.col("ep2"), block_rows)
    mean = F.aggregate(F.zip_with("h1", "h2", score), F.lit(0.0), lambda s, x: s + x) / F.size("h1")
    return pairs.select("ep1", "ep2", "w1", "w2", mean.alias("score"), "start1", "end1", "start2", "end2", F.size("h1").alias("k"), *series_of(frames))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """JN-18, SET-3: rows of ``a`` that ``b`` has too, only ``a``'s, only ``b``'s; bags are preserved."""
    return {"common": a.join(b.select(*keys), keys, "left_semi"), "only_a": a.join(b.select(*keys), keys, "left_anti"), "only_b": b.join(a.select(*keys), keys, "left_anti")}
