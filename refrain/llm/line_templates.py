"""Line dedup by a log-template tree, in DataFrame functions only.

A line is cut into tokens at white space. Tokens that vary by their looks (with a digit, an
address or a link) become a wildcard. The line goes down a tree of fixed depth: first by
its token count, then by its ``depth`` leading tokens. In the leaf that it reaches, every
further position is looked at over the leaf's distinct lines: one with more than
``distinct`` different tokens is a variable field, and becomes a wildcard as well. A line
whose template keeps at least ``constant`` of its tokens takes that template; running text,
whose leaves vary nearly everywhere, keeps its masked line as a template of its own.

A template that occurs in at least ``min_docs`` documents is recurring, one of at least
``long_tokens`` tokens in ``long_docs``: its lines are dropped from every document but the
first (by doc_id) that shows it, so no text is lost to the corpus. Lines shorter than
``min_tokens`` are templates by their own unmasked text, since little but a wildcard would
be left of them.

Lines are masked once and written; (line, document) rows then hold digests. Only leaves with
more than ``distinct`` lines can vary: of their lines one copy a task is shuffled, and its
(leaf, position, token) rows are made distinct before and after they are. A line that half
the corpus shares costs a row a task, a leaf is never collected. At the end the documents
are joined to the places of their dropped lines.

Defined results: a null text stays null; an empty one stays empty; an empty line is no
template; equal lines inside one document count once; rows that share a doc_id (null is one
such id) count as one document, but each row's lines are dropped from that row alone; with
several rows of the first document the lines of all of them stay; an empty table gives an
empty result. Other columns are passed on unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, packed, unpacked

WILDCARD = "<*>"
#: A token that varies between lines of one template holds a digit, "@" or "://". Written without backtracking.
VARIABLE = r"(^| )[^ 0-9@:]*+(?::(?!//)[^ 0-9@:]*+)*+(?:[0-9@]|://)[^ ]*+"
#: White space that isn't one space already.
SPACE = r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]"
HAS_VARIABLE = r"[0-9@]|://"
#: Leaves (of 8 bytes) up to which their table goes to every executor, so that only their lines' text is shuffled.
BROADCAST_LEAVES = 1 << 18


def spaced(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE, " "))


def token_count(made: Column) -> Column:
    return F.length(made) - F.length(F.replace(made, F.lit(" "), F.lit(""))) + 1


def masked(line: Column, min_tokens: int) -> Column:
    """A spaced line with its varying tokens replaced; a short one as it is, behind a line feed, which no line holds."""
    short = token_count(line) < min_tokens
    return F.when(line == "", line).when(short, F.concat(F.lit("\n"), line)).when(line.rlike(HAS_VARIABLE), F.regexp_replace(line, VARIABLE, "$1" + WILDCARD)).otherwise(line)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def templates(seen: DataFrame, depth: int, distinct: int, constant: float) -> DataFrame:
    """(line, template) for the lines of ``seen`` (leaf, line, made) whose template isn't the line itself."""
    counted = seen.filter("leaf is not null").select("leaf", "line").distinct().groupBy("leaf").agg(F.count("*").alias("m"))
    # A leaf of up to ``distinct`` lines can't vary that much; its lines go no further.
    wide = materialize(counted.filter(F.col("m") > distinct).select("leaf"), "leaves")
    small = wide.count() <= BROADCAST_LEAVES
    met = seen.join(wide.hint("broadcast" if small else "merge"), "leaf", "left_semi")
    placed = materialize(met.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("made").alias("made")), "placed")
    words = placed.select("leaf", "line", F.split("made", " ").alias("w")).filter(F.size("w") > depth)
    tokens = words.select("leaf", F.posexplode(F.slice("w", depth + 1, 1 << 30)).alias("at", "token")).select("leaf", "at", F.xxhash64("token").alias("token"))
    vary = tokens.distinct().groupBy("leaf", "at").agg(F.count("*").alias("k")).filter(F.col("k") > distinct)
    fields = materialize(vary.groupBy("leaf").agg(F.collect_set("at").alias("fields")), "fields")
    # Positions are counted behind the leading tokens.
    general = F.transform("w", lambda t, i: F.when(F.array_contains("fields", i - depth), F.lit(WILDCARD)).otherwise(t))
    found = words.join(fields.hint("merge"), "leaf").select("line", general.alias("g"))
    kept = F.size(F.filter("g", lambda t: t != WILDCARD))
    return found.filter(kept >= constant * F.size("g")).select("line", digest(F.array_join("g", " ")).alias("template"))


def drop_recurring_lines(
    docs: DataFrame,
    min_docs: int = 3,
    long_docs: int = 2,
    long_tokens: int = 50,
    min_tokens: int = 4,
    depth: int = 2,
    distinct: int = 2,
    constant: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with recurring lines removed from ``text_col``, and ``n_dropped``, the lines removed (replaces a column of that name)."""
    names = [c for c in docs.columns if c != "n_dropped"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), digest(text).alias("key"), text.alias("text")).filter("text is not null")
    # Nested transforms: each lambda refers to its value more than once, and computes it once.
    made = F.transform(F.transform(F.split("text", "\n", -1), spaced), lambda line: masked(line, min_tokens))
    rows = rows.select("doc", "key", F.posexplode(made).alias("pos", "made")).filter("made <> ''").withColumn("tokens", token_count(F.col("made")))
    leaf = F.when(~F.col("made").startswith("\n"), F.xxhash64("tokens", F.substring_index("made", " ", depth)))
    seen = materialize(rows.select("doc", "key", "pos", "made", leaf.alias("leaf"), digest(F.col("made")).alias("line"), (F.col("tokens") >= long_tokens).alias("long")), "lines")
    found = materialize(templates(seen.select("leaf", "line", "made"), depth, distinct, constant), "templates")
    # A row's text is told by its digest: rows that share a doc_id keep their own places.
    places = seen.groupBy("line", "doc", "key").agg(F.collect_set("pos").alias("places"), F.first("long").alias("long"))
    places = places.join(found.hint("merge"), "line", "left").select("doc", "key", "places", "long", F.coalesce("template", "line").alias("template"))
    places = materialize(places, "places")
    discard(seen)
    pairs = places.groupBy("template", "doc").agg(F.first("long").alias("long"))
    counted = pairs.groupBy("template").agg(F.count("*").alias("n"), F.first("long").alias("long"), F.min(F.struct(F.col("doc").isNull().alias("unknown"), F.col("doc").alias("doc")))["doc"].alias("first"))
    # Tables of their own: both sides of a join are then dealt by it, and a hot template can be split.
    recurring = materialize(counted.filter(F.col("n") >= F.when(F.col("long"), long_docs).otherwise(min_docs)).select("template", "first"), "recurring")
    hits = places.join(recurring.hint("merge"), "template").filter(~F.col("doc").eqNullSafe(F.col("first")))
    gone = materialize(hits.groupBy("doc", "key").agg(F.flatten(F.collect_list("places")).alias("gone")), "gone")
    discard(places)
    own = packed(docs, d=F.col(f"`{id_col}`").cast("long"), k=digest(text))
    joined = own.join(gone.hint("merge"), F.col("d").eqNullSafe(F.col("doc")) & (F.col("k") == F.col("key")), "left")
    # Columns of their own, since a lambda would compute a shared expression anew for every element.
    was = F.col(f"row.c{names.index(text_col)}").cast("string")
    whole = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), F.split(was, "\n", -1)).alias("ls"))
    placed = whole.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone")))
    new = F.when(F.col("gone").isNull(), was).otherwise(F.array_join(F.transform("stay", lambda i: F.get(F.col("ls"), i)), "\n"))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("ls") - F.size("stay")).cast("long")
    return unpacked(placed.withColumns({"new": new, "dropped": dropped}), [*names, "n_dropped"], **{text_col: F.col("new"), "n_dropped": F.col("dropped")})


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
s AS (SELECT *, trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g')) AS spaced FROM l),
m AS (SELECT *, CASE WHEN len(string_split(spaced, ' ')) < 4 THEN chr(10) || spaced
  ELSE regexp_replace(spaced, '(^| )[^ ]*([0-9@]|://)[^ ]*', '\1<*>', 'g') END AS made FROM s WHERE spaced <> ''),
w AS (SELECT DISTINCT made, string_split(made, ' ') AS w FROM m WHERE made[1] <> chr(10)),
leaf AS (SELECT made, w, len(w) AS n, array_to_string(w[:2], ' ') AS lead FROM w),
tok AS (SELECT n, lead, unnest(w[3:]) AS token, unnest(range(3, len(w) + 1)) AS p FROM leaf),
vary AS (SELECT n, lead, list(p) AS fields FROM (SELECT n, lead, p FROM tok GROUP BY n, lead, p HAVING count(DISTINCT token) > 2) GROUP BY n, lead),
gen AS (SELECT made, list_transform(w, lambda t, i: CASE WHEN list_contains(fields, i) THEN '<*>' ELSE t END) AS g FROM leaf JOIN vary USING (n, lead)),
tpl AS (SELECT made, array_to_string(g, ' ') AS template FROM gen WHERE len(list_filter(g, lambda t: t <> '<*>')) >= 0.6 * len(g)),
k AS (SELECT doc_id, pos, coalesce(template, m.made) AS template, len(string_split(m.made, ' ')) >= 50 AS long FROM m LEFT JOIN tpl USING (made)),
r AS (SELECT template, min(doc_id) AS first FROM k GROUP BY template HAVING count(DISTINCT doc_id) >= CASE WHEN bool_or(long) THEN 2 ELSE 3 END),
f AS (SELECT l.doc_id, l.pos, l.line, r.first IS NOT NULL AND r.first <> l.doc_id AS gone FROM l LEFT JOIN k USING (doc_id, pos) LEFT JOIN r USING (template)),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_dropped FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE g.text END AS text, coalesce(g.n_dropped, 0)::BIGINT AS n_dropped FROM d LEFT JOIN g USING (doc_id)
"""
