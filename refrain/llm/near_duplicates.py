"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Texts with equal shingle sets form a class, which gets a number of its own and goes on;
doc_ids come back at the end. Band hashes put classes into buckets. A bucket is never
expanded into its pairs:

1. every class is verified against the smallest bucket-mate of all its buckets;
2. then against the smallest member of each of its buckets, where still apart;
3. buckets that still hold several components are settled in blocks: members outside the
   bucket's largest component are the queries, compared with all members, at most about
   ``PROBES`` by ``BASES`` sets, or as many hashes, a task; a task returns links of a
   spanning forest only.

So no link inside a bucket is lost, two-member buckets and groups that one member ties
together end at step 1 or 2, and a hot bucket is dealt over many tasks. Two sets at the
threshold meet in no bucket with a probability under ``MISS``. Links are confirmed on full
sets of 64-bit shingle hashes. After steps 2 and 3 only the new links between components
are searched for components, not all of them again.

Defined results: a null or wordless text has no shingles and is linked with nothing; a
text shorter than a shingle is one shingle; rows with a null doc_id get a null component,
link nothing and are kept; rows that repeat a doc_id get a row each, by their own text, and
link what any of their texts links; an empty table gives an empty result.
:func:`drop_near_duplicates` links rows without a doc_id like any others and leaves one row
of each group: the smallest doc_id, null last, then the smallest MD5 of the text; of rows
equal in both one stays. Other columns are passed on there, and ignored by
:func:`near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import columns, discard, materialize, packed, trim, unpacked
from .shingles import band_hashes, set_digest, shingle_sets, signature
from .tokenization import slices

MISS = 1e-5
#: Stands for a null doc_id in joins; a row that has it as its id is told apart by its text's digest.
NO_ID = -(1 << 63)
PROBES, BASES = 256, 512
#: Hashes that a block's queries, and its members, have together on average at most.
PROBE_HASHES, BASE_HASHES = 1 << 20, 1 << 21
#: Blocks of so many bytes of hashes give their memory back at their end.
TRIM_BYTES = 4 << 20


def bands_for(percent: int, rows: int = 5) -> int:
    """Bands of ``rows`` coordinates after which a pair at the threshold is missed with a probability under MISS."""
    return int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** rows))))


def linked(common: int | np.ndarray, a: int, b: int | np.ndarray, percent: int):
    return 100 * common >= percent * (a + b - common)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, digest and band hashes of each text, and the text's MD5 as ``key``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) for s in sets], pa.binary()),
                    pa.array([band_hashes(signature(s, bands * rows), bands) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "digest", "bands"],
            )

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInArrow(make, "doc_id long, key binary, n long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, hashes) for the classes in ``wanted`` (rep, doc, digest)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc", "digest", "hashes"],
            )

    known = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    picked = known.join(wanted.select("doc").hint("merge"), "doc", "left_semi")
    sets = picked.mapInArrow(make, "doc long, digest binary, hashes binary")
    # A repeated doc_id may carry several texts; the digest names the right one.
    return sets.join(wanted.hint("merge"), ["doc", "digest"]).dropDuplicates(["rep"]).select("rep", "hashes")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and other columns) whose full sets are similar enough."""
    others = [c for c in pairs.columns if c not in ("a", "b")]

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            good.append(bool(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent)))
        return pa.RecordBatch.from_arrays(batch.columns[2:], names=["a", "b", *others]).filter(pa.array(good, pa.bool_()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(similar, batches)
        trim()

    one = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("s"))
    two = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("t"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("s", "t", "a", "b", *others).mapInArrow(keep, ", ".join(f"{c} long" for c in ["a", "b", *others]))


def _settle(members: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame | None:
    """Links (ca, cb) between components that share a bucket, found in blocks of queries against blocks of members; None where no bucket holds two."""
    placed = members.join(comps.hint("merge"), F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    state = placed.groupBy("bucket").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.count("*").alias("m"), F.sum(F.pmod(F.xxhash64("rep"), F.lit(1 << 40))).alias("sum"), F.min("rep").alias("low"))
    # Several bands bring the same members together; one such bucket is enough.
    open_ = materialize(state.filter("one < other").groupBy("m", "sum", "low").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")
    if open_.isEmpty():
        return None
    rest = materialize(placed.join(open_.hint("merge"), "bucket").select("bucket", "rep", "n", "comp"), "rest")
    sizes = rest.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("hashes"))
    one = sizes.groupBy("bucket").agg(F.sum("k").alias("m"), F.sum("hashes").alias("mh"), F.max(F.struct("k", "hashes", "comp")).alias("main"))
    probes, probe_hashes = F.col("m") - F.col("main.k"), F.col("mh") - F.col("main.hashes")
    nu, nv = F.greatest(F.ceil(probes / PROBES), F.ceil(probe_hashes / PROBE_HASHES)), F.greatest(F.ceil(F.col("m") / BASES), F.ceil(F.col("mh") / BASE_HASHES))
    one = materialize(one.select("bucket", F.col("main.comp").alias("main"), nu.cast("int").alias("nu"), nv.cast("int").alias("nv")), "blocks")
    rows = rest.join(one.hint("merge"), "bucket").withColumn("h", F.xxhash64("rep"))
    base = rows.select("bucket", "rep", "comp", F.pmod("h", "nv").cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("ub"), F.lit(False).alias("probe"))
    probe = rows.filter("comp <> main").select("bucket", "rep", "comp", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("vb"), F.pmod(F.shiftright("h", 20), "nu").cast("int").alias("ub"), F.lit(True).alias("probe"))
    blocks = base.unionByName(probe.select(*base.columns)).join(sets.hint("merge"), "rep")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = forest(group)
        if group["hashes"].str.len().sum() >= TRIM_BYTES:
            trim()
        return out

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        bases = group[~group["probe"]]
        hashes = [np.frombuffer(h, np.uint64) for h in bases["hashes"]]
        reps, comp_of = bases["rep"].tolist(), bases["comp"].to_numpy()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        if hashes:
            sizes = np.array([len(h) for h in hashes], np.int64)
            flat, starts = np.concatenate(hashes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for rep, comp, raw in zip(*(group.loc[group["probe"], c] for c in ("rep", "comp", "hashes")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                near = np.searchsorted(own, flat)
                near[near == len(own)] = 0
                common = np.add.reduceat(own[near] == flat, starts, dtype=np.int64)
                for i in np.flatnonzero(linked(common, len(own), sizes, percent) & (comp_of != comp)).tolist():
                    x, y = root(int(comp)), root(int(comp_of[i]))
                    if x != y:
                        parent[x] = y
                        out.append((x, y))
        return pd.DataFrame(out, columns=["ca", "cb"], dtype="int64")

    return blocks.groupBy("bucket", "ub", "vb").applyInPandas(compare, "ca long, cb long")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, component) after links (ca, cb) between components. A component of one node may be missing from ``comps``."""
    over = components(links, "ca", "cb").select(F.col("node").alias("was"), F.col("component").alias("now"))
    # A component's own node is in ``comps``, so nodes tell what is missing there; only the join by component has hot keys, and can be split.
    moved = comps.join(over.hint("merge"), F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    single = over.join(comps.select("node").hint("merge"), F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return materialize(moved.unionByName(single), "labels")


def _classes(docs: DataFrame, words: int, percent: int, rows: int, link: str) -> tuple[DataFrame, DataFrame]:
    """Sketches (doc_id, key, n, digest), and for each digest with shingles ``low`` and ``least``: the first row of its class, and of its component.

    Rows come in the order (doc_id unknown, doc_id, key). Only those for which ``link`` holds take part.
    """
    sketches = materialize(sketch(docs, words, bands_for(percent, rows), rows), "sketch")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc"), "key")).alias("low")
    classes = sketches.filter("n > 0").filter(link).groupBy("digest").agg(first_row, F.first("n").alias("n"), F.first("bands").alias("bands"))
    # The number stays with the row, since it is written.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    exploded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    buckets = exploded.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rep", F.col("n").alias("hub_n"))).alias("low")).filter("size > 1")
    # A table of its own: both sides of the join are then dealt by it, and a hot bucket can be split.
    buckets = materialize(buckets.select("bucket", "size", F.col("low.rep").alias("hub"), F.col("low.hub_n").alias("hub_n")), "buckets")
    members = materialize(exploded.join(buckets.hint("merge"), "bucket"), "members")
    tried = members.groupBy("rep").agg(F.first("n").alias("n"), F.min(F.struct("hub", "hub_n")).alias("x"))
    named = classes.select("rep", "digest", F.coalesce("low.doc", F.lit(NO_ID)).alias("doc"))
    wanted = materialize(tried.join(named.hint("merge"), "rep").select("rep", "n", "doc", "digest", F.col("x.hub").alias("hub"), F.col("x.hub_n").alias("hub_n")), "wanted")
    sets = materialize(full_sets(docs, wanted.select("rep", "doc", "digest"), words), "sets")
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")

    links = materialize(verified(wanted.filter("hub < rep").filter(fits).select(F.col("hub").alias("a"), F.col("rep").alias("b")), sets, percent), "links")
    comps = components(links)
    discard(links)
    left = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    right = comps.select(F.col("node").alias("hub"), F.col("component").alias("hub_comp"))
    again = members.filter("hub < rep").select("hub", "hub_n", "rep", "n").filter(fits).distinct()
    again = again.join(wanted.select("rep", F.col("hub").alias("tried")).hint("merge"), "rep").filter("hub <> tried")
    again = again.join(left.hint("merge"), "rep", "left").join(right.hint("merge"), "hub", "left")
    ca, cb = F.coalesce("comp", "rep"), F.coalesce("hub_comp", "hub")
    again = again.filter(ca != cb).select(F.col("hub").alias("a"), F.col("rep").alias("b"), ca.alias("ca"), cb.alias("cb"))
    # Written first, so that the join with the sets deals its rows anew and can split hot hubs.
    again = materialize(again, "pairs")
    if not again.isEmpty():
        more = materialize(verified(again, sets, percent), "links")
        if not more.isEmpty():
            comps = _joined(comps, more)
        discard(more)
    discard(again)
    rest = _settle(members.filter("size > 2").select("bucket", "rep", "n"), sets, comps, percent)
    if rest is not None:
        rest = materialize(rest, "links")
        if not rest.isEmpty():
            comps = _joined(comps, rest)
        discard(rest)
    for done in (sets, members, buckets, wanted):
        discard(done)
    placed = materialize(classes.select("rep", "low").join(comps.hint("merge"), F.col("rep") == F.col("node")).select("rep", "low", "component"), "placed")
    # A table of its own, so that a hot component can be split.
    least = materialize(placed.groupBy("component").agg(F.min("low").alias("least")), "least")
    placed = placed.join(least.hint("merge"), "component").select("rep", "least")
    final = classes.select("digest", "low", "rep").join(placed.hint("merge"), "rep", "left").select("digest", "low", F.coalesce("least", "low").alias("least"))
    return sketches.drop("bands"), final


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row: linked are texts with 100 |A & B| >= percent |A | B|."""
    sketches, final = _classes(columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")), words, percent, rows, "doc_id is not null")
    linkable = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    found = sketches.select("doc_id", "n", linkable.alias("digest")).join(final.hint("merge"), "digest", "left")
    component = F.coalesce("least.doc", "doc_id")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("low.doc", "doc_id").alias("class_id"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    narrow = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    sketches, final = _classes(narrow, words, percent, rows, "true")
    found = sketches.filter("n > 0").join(final.hint("merge"), "digest")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc")) & (F.col("key") == F.col("least.key"))
    state = found.groupBy("doc_id", "key").agg(F.max(first).alias("first"), F.count("*").alias("times"))
    # A table of its own: both sides of the join are then dealt by it, and a hot key can be split.
    state = materialize(state.filter("not first or times > 1").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "key", "first"), "copies")
    own = packed(docs, doc=F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), key=text_key(F.col(f"`{text_col}`").cast("string")))
    kept = unpacked(own.join(state.hint("merge"), ["doc", "key"], "left_anti"), docs.columns)
    repeated = state.filter("first")
    if repeated.isEmpty():
        return kept
    # Equal rows: map-side combined, so a hot one costs a row a task.
    whole = own.join(repeated.hint("merge"), ["doc", "key"], "left_semi").groupBy("doc", "key").agg(F.first("row").alias("row"))
    return kept.unionByName(unpacked(whole, docs.columns))
