"""How filters interact: what each removes after the others, in every order, by sorted posting lists (operator 11).

Each filter has, for each part of a table, lists of the rows that fail it, sorted by id and cut by ranges of ids.  What a filter removes after some
others is its list less theirs; what passes them all is what their union leaves.  Both are made range by range by k-way merges whose cursors
gallop to the next border, and only sizes leave a task: a row for each (part, filter, earlier filters), added up by Spark.
A filter's share of all orders (``shapley``) weighs each set of earlier filters by the orders that begin with it, so no order is ever run.

A list is cut wherever an Arrow batch ends, so a part with a third of all rows is many short lists; rows are dealt by (part, range of ids) and Spark
may split any such bundle, as a size is a sum over any cut of the rows.  In a list a row stands as its place among the list's
ids, which tells apart rows of the same id and rows without one.

Cases: a null text is empty and a null part the empty string; rows without an id come last in their list, are no copies of
smaller ids and have no labels; repeated rows count each, and equal ids aren't smaller than one another; a document is good (toxic) if any
of its labels says so; a part without failures has rows of zeros; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut
from .jobs import released

#: Ids in a range, and places that a cursor takes at once.
RANGE, STEP = 1024, 4096

#: Words of the filters.
WORDS = r"[^\x20\x09-\x0D]+"


def gallop(x: np.ndarray, at: int, border: int) -> int:
    """The first place from ``at`` on that holds border or more: doubling steps, then halves of the last one."""
    step = 1
    while at + step <= len(x) and x[at + step - 1] < border:
        at += step
        step *= 2
    return at + int(np.searchsorted(x[at : at + step], border))


def _ranges(lists: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Slices of sorted lists, one of each, that share a range of values; at least one list is STEP further after each, and ranges without values are leapt over."""
    at = [0] * len(lists)
    while left := [i for i, x in enumerate(lists) if at[i] < len(x)]:
        border = min(int(lists[i][min(at[i] + STEP, len(lists[i])) - 1]) for i in left) + 1
        to = [gallop(x, a, border) for x, a in zip(lists, at)]
        yield [x[a:b] for x, a, b in zip(lists, at, to)]
        at = to


def _merge(slices: list[np.ndarray]) -> np.ndarray:
    some = [x for x in slices if len(x)]
    if len(some) < 2:
        return some[0] if some else np.zeros(0, np.int32)
    both = np.sort(np.concatenate(some), kind="stable")  # sorted runs are merged as such
    return both[np.r_[True, both[1:] != both[:-1]]]


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of a are in b; both sorted."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def union(lists: list[np.ndarray]) -> np.ndarray:
    parts = [_merge(s) for s in _ranges(lists)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def difference(first: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """first less the union of the others."""
    parts = [a[~_within(a, _merge(rest))] for a, *rest in _ranges([first, *others]) if len(a)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two lists share."""
    return sum(int(_within(x, y).sum()) for x, y in _ranges([a, b]) if len(x) and len(y))


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, id, the five filters of this audit as booleans A to E (true: fails) and the marks good and toxic, for each row of docs.

    E, a copy of a smaller id's text: whether a row is the smallest of its text comes from a join on (id, text's digest), so a text that very many rows
    hold is no hot key.
    """
    text, words = F.col("text"), F.col("words")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", "part", "text", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    rows = rows.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (F.size(words) < 200).alias("A"), (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).alias("B"),
        (100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 2 * F.length(text)).alias("C"), text.rlike("[#$%&*|]").alias("D"),
    )
    rows = cut(rows)
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).where("good or toxic")
    found = rows.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    no = F.lit(False)
    return found.select("part", "id", "A", "B", "C", "D", (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def postings(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """part, ids (sorted, nulls last) and, for each filter and mark, the sorted places among ids of the rows that have it: a row for each part and piece of a range of ids."""
    names = ["part", "ids", *filters, *marks]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part").to_pylist()
            cuts = [0, *(i for i in range(1, len(part)) if part[i] != part[i - 1]), len(part)]
            offsets = pa.array(np.array(cuts, np.int32))
            out = [pa.array([part[a] for a in cuts[:-1]], pa.string()), pa.ListArray.from_arrays(offsets, b.column("id"))]
            of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            for name in names[2:]:
                at = np.flatnonzero(b.column(name).to_numpy(zero_copy_only=False))
                ends = np.searchsorted(at, cuts).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((at - np.array(cuts)[of[at]]).astype(np.int32))))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(out, names)

    dealt = rows.withColumn("range", F.floor(F.col("id") / RANGE)).hint("rebalance", "part", "range").sortWithinPartitions("part", F.asc_nulls_last("id"))
    lists = ", ".join(f"{n} array<int>" for n in names[2:])
    return dealt.select(*names[:1], "id", *names[2:]).mapInArrow(run, f"part string, ids array<bigint>, {lists}")


def _sizes(filters: list[str], marks: list[str]):
    every = [(f, e) for f in range(len(filters)) for e in range(1 << len(filters)) if not e >> f & 1]
    names = ["part", "filter", "earlier", "kept", "removed", *marks]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lists, marked = ([b.column(n)[i].values.to_numpy() for n in names] for names in (filters, marks))
                n = len(b.column("ids")[i])
                passed = [n] + [n - len(union([x for f, x in enumerate(lists) if s >> f & 1])) for s in range(1, 1 << len(filters))]
                out = []
                for f, earlier in every:
                    lost = difference(lists[f], [x for g, x in enumerate(lists) if earlier >> g & 1])
                    out.append((f, earlier, passed[earlier | 1 << f], len(lost), *(common(lost, m) for m in marked)))
                columns = [pa.array(c, pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("part")[i].as_py()] * len(out), pa.string()), *columns], names)

    return run


def interactions(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """Of each part, filter (by number) and set of earlier filters (bits): kept, the rows that pass them all; removed, those that fail it and none of the earlier; and how many of the removed have each mark."""
    sizes = lists.mapInArrow(_sizes(filters, marks), "part string, filter int, earlier int, kept long, removed long" + "".join(f", {m} long" for m in marks))
    return sizes.groupBy("part", "filter", "earlier").agg(*(F.sum(c).alias(c) for c in ("kept", "removed", *marks)))


def orders(spark, filters: list[str]) -> DataFrame:
    """filter_order, step, filter and earlier of every step of every order of the filters."""
    rows = []
    for p in permutations(range(len(filters))):
        rows += [("".join(filters[f] for f in p), k + 1, f, sum(1 << g for g in p[:k])) for k, f in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, earlier int")


def audit(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, <mark>_lost and shapley."""
    n = len(filters)
    sizes = interactions(postings(rows, filters, marks), filters, marks)
    mine = Window.partitionBy("part", "filter")
    only = lambda earlier: F.max(F.when(F.col("earlier") == earlier, F.col("removed"))).over(mine)
    weight: Column = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("earlier") + 1)
    others = F.lit((1 << n) - 1).bitwiseXOR(F.expr("shiftleft(1, filter)"))
    told = sizes.select("part", "filter", "earlier", "kept", "removed", (only(F.lit(0)) - F.col("removed")).alias("redundant"), only(others).alias("unique_fails"), *(F.col(m).alias(f"{m}_lost") for m in marks), F.sum(F.col("removed") * weight).over(mine).alias("shapley"))
    steps = F.broadcast(orders(rows.sparkSession, filters))  # n * n! rows
    return told.join(steps, ["filter", "earlier"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley")


#: The filters of the query, in bit order, and its marks.
FILTERS, MARKS = ["A", "B", "C", "D", "E"], ["good", "toxic"]


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failures(docs, labels), FILTERS, MARKS)


#: DuckDB SQL for the query's rows.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, doc_id, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT fails FROM d),
m AS MATERIALIZED (SELECT part, fails, count(*) n, count(*) FILTER (good) g, count(*) FILTER (toxic) x FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
v(f) AS (SELECT unnest(range(5))),
p AS (SELECT [a.f, b.f, c.f, d.f, e.f] o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string([chr(CAST(65 + f AS INTEGER)) FOR f IN o], '') filter_order, step, o[step] f, CAST(1 << o[step] AS INT) bit, CAST(coalesce(list_sum([1 << g FOR g IN o[1:step - 1]]), 0) AS INT) earlier FROM (SELECT o, unnest(range(1, 6)) step FROM p)),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN fails & (earlier | bit) = 0 THEN n ELSE 0 END) kept, sum(CASE WHEN fails & bit > 0 AND fails & earlier = 0 THEN n ELSE 0 END) removed, sum(CASE WHEN fails & bit > 0 AND fails & earlier > 0 THEN n ELSE 0 END) redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) unique_fails,
 sum(CASE WHEN fails & bit > 0 AND fails & earlier = 0 THEN g ELSE 0 END) good_lost, sum(CASE WHEN fails & bit > 0 AND fails & earlier = 0 THEN x ELSE 0 END) toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) step, CAST(kept AS BIGINT) kept, CAST(removed AS BIGINT) removed, CAST(redundant AS BIGINT) redundant, CAST(unique_fails AS BIGINT) unique_fails, CAST(good_lost AS BIGINT) good_lost, CAST(toxic_lost AS BIGINT) toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) shapley FROM r
"""
