"""Merkle fixity audit of WARC records.

Every record is rendered as WARC and hashed (SHA-256). Records are laid out in the order of their ids, then digests. A leaf
is a range of 16 ids, and its hash covers the ids, sizes and digests of its records in that order; a node is up to 16 ranges
in order, and its hash covers its children's hashes and byte lengths, so each node stands for an ordered range of offsets.
An audit compares the roots of two replicas, goes down only into nodes that differ, and compares record by record only in
the leaves that differ: it reports which records were changed, lost or added. Offsets are handed down from the roots along
the same paths.

An id may have any number of records, a third of all perhaps. Those with more than 16 get a tree of their own over ranges of
digests, a digit of the digest a level, and enter their leaf as one hash; ranks within an id are made from counts by range.

Edge cases: a null url or html is empty; a null id has a leaf of its own before all others; repeated records count as
often as they occur, in order of digest; an empty replica has no root, and then all records of the other are lost or
added; extra columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

LEAF_IDS, FAN_OUT = 16, 16
#: An id with more records has a tree of its own, over ranges of digests told by so many digits and fewer.
FEW, DIGITS = 16, 5


def rendered(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A page as a WARC resource record."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = (
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
    )
    return F.concat(*head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame) -> DataFrame:
    """leaf (null without id), id, size in bytes and digest of each record."""
    text = pages.select(F.col("page_id").alias("id"), rendered().alias("r"))
    return text.select(F.expr(f"id div {LEAF_IDS} - CASE WHEN id % {LEAF_IDS} < 0 THEN 1 ELSE 0 END").alias("leaf"), "id", F.octet_length("r").cast("long").alias("size"), F.sha2("r", 256).alias("digest"))


def _ordered(column: str) -> Column:
    """The hash of a collected list of structs in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(column), lambda c: F.concat_ws(":", c["at"], c["size"].cast("string"), c["n"].cast("string"), c["hash"])), "|"), 256)


def _hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, size and hash: one row for each group of rows (at, size, n, hash), hashed in the order of `at`."""
    return rows.groupBy(*keys).agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.collect_list(F.struct("at", "size", "n", "hash")).alias("_rows")).select(*keys, "size", _ordered("_rows").alias("hash"))


def _of_many(records: DataFrame) -> DataFrame:
    """leaf, id, size and hash of ids with many records: a tree over ranges of digests, in order."""
    prefix = F.substring("at", 1, DIGITS)
    rows = _hashed(records.withColumn("_up", prefix), "leaf", "id", "_up")
    for digits in range(DIGITS - 1, -1, -1):
        rows = rows.select("leaf", "id", F.col("_up").alias("at"), "size", F.lit(1).alias("n"), "hash").withColumn("_up", F.substring("at", 1, digits))
        rows = _hashed(rows, "leaf", "id", "_up")
    return rows.select("leaf", "id", "size", "hash")


def leaves(records: DataFrame) -> DataFrame:
    """node, size and hash of each leaf: of its records in order of id and digest, equal ones counted."""
    each = records.groupBy("leaf", "id", "digest").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    each = settle(each.select("leaf", "id", F.col("digest").alias("at"), "size", "n", F.col("digest").alias("hash")), "records")
    many = settle(each.groupBy("leaf", "id").count().where(F.col("count") > FEW).select(F.col("leaf").alias("_leaf"), F.col("id").alias("_id")), "many")
    # Sixteen hex digits that sort as the ids do.
    place = F.lpad(F.hex(F.coalesce("id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    entry = lambda rows: rows.withColumn("at", F.concat_ws(":", place, "at"))
    if many.isEmpty():
        return _hashed(entry(each), "leaf").withColumnRenamed("leaf", "node")
    on = F.col("leaf").eqNullSafe(F.col("_leaf")) & F.col("id").eqNullSafe(F.col("_id"))
    own = _of_many(each.join(many, on, "left_semi")).select("leaf", "id", F.lit("").alias("at"), "size", F.lit(1).cast("long").alias("n"), "hash")
    return _hashed(entry(each.join(many, on, "left_anti").unionByName(own)), "leaf").withColumnRenamed("leaf", "node")


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes one level up; each has at most FAN_OUT children, in order."""
    up = F.expr(f"node div {FAN_OUT} - CASE WHEN node % {FAN_OUT} < 0 THEN 1 ELSE 0 END")
    children = F.array_sort(F.collect_list(F.struct("node", "size", "hash")))
    joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["size"].cast("string"), c["hash"])), "|")
    return nodes.groupBy(up.alias("parent")).agg(F.sum("size").alias("size"), F.sha2(joined, 256).alias("hash")).withColumnRenamed("parent", "node")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots: one for ids below 0, one for the others. A level is a 16th of the one below."""
    levels = [settle(leaves(records), "leaves")]
    while levels[-1].where("node not in (0, -1)").take(1):
        levels.append(settle(parents(levels[-1]), "level"))
    return levels


def raised(levels: list[DataFrame], height: int) -> list[DataFrame]:
    """The tree with roots at this height."""
    while len(levels) < height:
        levels.append(settle(parents(levels[-1]), "level"))
    return levels


def mismatches(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """Leaves that differ, from the roots down: of each level only the children of nodes that differ are compared."""
    height = max(len(one), len(other))
    one, other = raised(one, height), raised(other, height)
    up = F.expr(f"node div {FAN_OUT} - CASE WHEN node % {FAN_OUT} < 0 THEN 1 ELSE 0 END")
    bad: DataFrame | None = None
    for a, b in zip(reversed(one), reversed(other), strict=True):
        if bad is not None:
            above = bad.withColumnRenamed("node", "_parent")
            a, b = (x.join(above, up == F.col("_parent"), "left_semi") for x in (a, b))
        b = b.select(F.col("node").alias("_node"), F.col("hash").alias("_hash"))
        joined = a.join(b, F.col("node") == F.col("_node"), "full")
        bad = settle(joined.where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(F.coalesce("node", "_node").alias("node")), "mismatches")
    return bad


def offsets(levels: list[DataFrame], leaves_: DataFrame) -> DataFrame:
    """node and first byte of these leaves, handed down from the roots: of each level only nodes with a parent above one of
    the leaves are read."""
    up = F.expr(f"node div {FAN_OUT} - CASE WHEN node % {FAN_OUT} < 0 THEN 1 ELSE 0 END")
    paths = [leaves_.select("node")]
    for _ in levels[1:]:
        paths.append(settle(paths[-1].select(up.alias("node")).distinct(), "paths"))
    start = levels[-1].select("node", (F.coalesce(F.sum("size").over(W.orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("start"))  # two roots at most
    for level, path in zip(reversed(levels[:-1]), reversed(paths[1:]), strict=True):
        own = level.withColumn("_up", up).join(path.withColumnRenamed("node", "_path"), F.col("_up") == F.col("_path"), "left_semi")
        before = F.coalesce(F.sum("size").over(W.partitionBy("_up").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        start = start.select(F.col("node").alias("_parent"), F.col("start").alias("_start"))
        start = own.withColumn("_before", before).join(start, F.col("_up") == F.col("_parent")).select("node", (F.col("_start") + F.col("_before")).alias("start"))
    return start.join(leaves_.select(F.col("node").alias("_leaf")), F.col("node") == F.col("_leaf"), "left_semi")


def ranked(left: DataFrame) -> DataFrame:
    """A row for each record of (leaf, id, digest, n, mine) with its rank k in its id and side, by digest. Ranks are made from the
    counts of 4096 ranges of digests, so no task sorts the records of an id."""
    rows = left.withColumn("_range", F.substring("digest", 1, 3))
    keys = ["leaf", "id", "mine", "_range"]
    earlier = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.sum("n").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier(*keys)), F.lit(0))).select(*[F.col(k).alias(f"{k}_") for k in keys], "_before")
    rows = rows.withColumn("_within", F.coalesce(F.sum("n").over(earlier(*keys, "digest")), F.lit(0)))
    on = (F.col("leaf") == F.col("leaf_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("mine") == F.col("mine_")) & (F.col("_range") == F.col("_range_"))
    # Copies of one record are counted out in steps, so that no row holds a long list.
    step = 10_000
    rows = rows.join(counts, on).withColumn("_step", F.explode(F.expr(f"sequence(0, (n - 1) div {step})")))
    rows = rows.withColumn("_copy", F.explode(F.expr(f"sequence(_step * {step} + 1, least(n, (_step + 1) * {step}))")))
    return rows.select("leaf", "id", "digest", "mine", (F.col("_before") + F.col("_within") + F.col("_copy")).alias("k"))


def audit(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, kind (changed, lost or added), leaf, range_start and range_end (bytes of the archive's leaf; null if it has none),
    and the two digests, of each record that differs. Records of one id are matched in order of digest, after equal ones."""
    mine, its = (settle(manifest(x), "manifest") for x in (archive, replica))
    # Records without id have the leaf before all others of both replicas.
    low = min(0, *(x.agg(F.min("leaf")).first()[0] or 0 for x in (mine, its))) - 1
    mine, its = (x.withColumn("leaf", F.coalesce("leaf", F.lit(low).cast("long"))) for x in (mine, its))
    levels = tree(mine)
    bad = mismatches(levels, tree(its))
    rows = []
    for records, side in ((mine, 1), (its, -1)):
        rows.append(records.join(bad, F.col("leaf") == F.col("node"), "left_semi").select("leaf", "id", "digest", F.lit(side).alias("side")))
    # What both hold is struck out by counting, so only real differences are put in order.
    left = reduce(DataFrame.unionByName, rows).groupBy("leaf", "id", "digest").agg(F.sum("side").alias("more")).where("more <> 0")
    left = settle(left.select("leaf", "id", "digest", F.abs("more").alias("n"), (F.col("more") > 0).alias("mine")), "differences")
    left = ranked(left)
    a = left.where("mine").select("leaf", "id", "k", F.col("digest").alias("digest"))
    b = left.where("not mine").select(F.col("leaf").alias("_leaf"), F.col("id").alias("_id"), F.col("k").alias("_k"), F.col("digest").alias("found_digest"))
    both = a.join(b, (F.col("leaf") == F.col("_leaf")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")), "full")
    kind = F.when(F.col("found_digest").isNull(), "lost").when(F.col("digest").isNull(), "added").otherwise("changed")
    both = both.select(F.coalesce("id", "_id").alias("page_id"), kind.alias("kind"), F.coalesce("leaf", "_leaf").alias("leaf"), "digest", "found_digest")
    sizes = levels[0].select(F.col("node").alias("_n"), F.col("size").alias("_size"))
    where = offsets(levels, bad).join(sizes, F.col("node") == F.col("_n")).select(F.col("node").alias("_node"), F.col("start").alias("range_start"), (F.col("start") + F.col("_size")).alias("range_end"))
    return both.join(where, F.col("leaf") == F.col("_node"), "left").select("page_id", "kind", "leaf", "range_start", "range_end", "digest", "found_digest")


def decayed(pages: DataFrame) -> DataFrame:
    """A replica as a failing disk might leave it, from the pages themselves: one in 64 has a character more, one in 128 is
    lost and one in 256 is there twice, chosen by a digest of the id."""
    columns = ("page_id", "url", "html")
    fate = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int")
    own = pages.select(*columns).withColumn("_fate", fate)
    html = F.when(F.col("_fate") < 4, F.concat(F.lit("~"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    whole = own.where(~F.col("_fate").isin(4, 5)).withColumn("html", html)
    return whole.withColumn("_times", F.explode(F.when(F.col("_fate") == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(*columns)
