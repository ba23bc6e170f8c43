"""Set-similarity join on word n-grams with adaptive multi-match prefixes (operator 6).

Documents whose distinct ``n``-word shingles have a Jaccard similarity of ``num/den`` or more are linked;
the result is each document's component.  The steps, all over whole texts:

1. One pass makes each document's shingle set (64-bit hashes), its identity (``node``: a hash of the set;
   equal sets are one node from here on), short min-hash keys, and a fixed-size table of how many documents
   hold the shingles of each of 2**20 hash classes.  That table, 4 MB whatever the input, is broadcast.
2. Nodes that share a min-hash key are verified against members of their group's components, in groups split
   to a bounded size with the group's first node in each part.  This finds no link that isn't verified and
   contracts large groups of near copies before the exact step, which would otherwise pair all of them.
3. The exact step.  Shingles are ordered by (class count, hash).  Two sets with overlap o or more share at
   least l shingles within their first ``size - o + l``.  The larger set of a pair chooses l from 1 to
   ``LEVELS`` by estimated cost (postings read plus candidates verified); the smaller one offers its prefix of
   every level.  Blocks of postings are dealt out by shingle; only shingles that different components
   share go on to the join, which applies size, position and parity bounds and demands l matches.  The parity bound: a set is also
   a bit string of the parities of its shingles per class of hash values; two strings differ in no more bits than the sets
   do in shingles, so pairs of near copies that fall short of the similarity end here and not as candidates.
4. Candidate pairs are verified on whole sets; components are taken over all links.

No pair is lost: step 3 skips only pairs whose two sides step 2 already connected.

Cases: texts with fewer than n words are one shingle, the whole sequence; texts without words, and null,
have no set and are components of their own.  Equal rows and equal ids are fine; a null doc_id never names
a component, but its rows are linked like others (their texts are found by a hash of the text in place of the id).  Sets are equal if the 64-bit hashes of their sorted shingle hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.storage import cut
from .jobs import released, shuffle_width, tidy
from .text import BASES, Rolling, WordHashes, utf8

#: Words in a shingle, and the similarity of a link as a fraction, of the contract.
SHINGLE, SIMILARITY = 3, (90, 100)
#: Hash classes of the count table.
CLASSES = 1 << 20
#: Slices in which the count table is added up.
SLICES = 64
#: Most shared prefix shingles that a document may demand.
LEVELS = 4
#: Cost of verifying a candidate against that of reading a posting.
VERIFY_COST = 200.0
#: 64-bit words of a parity string.
PARITY = 8
#: Min-hash keys of a set, each of two minima.
KEYS = 8
#: Sets that a task remembers, so as not to send a copy again; those it forgets are merged later.
SEEN = 300_000
#: Documents handled together in a task.
ROWS = 500
#: Nodes of a key group that one task verifies together.
PART = 400


def shingle_sets(texts: list[bytes], n: int, words: WordHashes, roll: Rolling) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    x, count = words(texts)
    h, end = roll(x), np.cumsum(count)
    out = []
    for b, c in zip(end.tolist(), count.tolist()):
        if c >= n:
            out.append(np.unique(h[b - c : b - n + 1]))
        elif c:
            out.append(np.array([xxhash.xxh3_64_intdigest(x[b - c : b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _classes(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) & (CLASSES - 1)


def _minhash_keys(s: np.ndarray) -> np.ndarray:
    """One-permutation min-hash: the first shingle of each of 2 * KEYS equal ranges of hash values (an empty range takes the next one's), two to a key."""
    starts = (np.arange(2 * KEYS, dtype=np.uint64)) * np.uint64((1 << 64) // (2 * KEYS))
    first = s[np.searchsorted(s, starts) % len(s)]
    with np.errstate(over="ignore"):
        pairs = first[0::2] * np.uint64(BASES[0]) + first[1::2] * np.uint64(BASES[1] | 1) + np.arange(KEYS, dtype=np.uint64)
    return (pairs ^ (pairs >> np.uint64(29))).astype(np.int64)


def _each_set(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    words, roll = WordHashes(lower=True), Rolling(n, BASES[1])
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            yield b, shingle_sets(utf8(b.column("text")), n, words, roll)


_PROFILE = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("blob", pa.binary()), ("key", pa.int64())])


def _profiles(n: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros(CLASSES, np.int64), 0
        for b, sets in _each_set(batches, n):
            part = b.column("part")[0].as_py()
            counts += np.bincount(_classes(np.concatenate(sets)), minlength=CLASSES)
            size = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(["document"] * len(sets)), b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([_minhash_keys(s).tobytes() if len(s) else None for s in sets], pa.binary()), b.column("key")], schema=_PROFILE)
        if counts.any():
            slices = np.split(counts.astype("<u4"), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(["counts"] * SLICES), pa.array(range(SLICES), pa.int64()), pa.array([part] * SLICES, pa.int64()), pa.array([None] * SLICES, pa.int64()), pa.array([x.tobytes() for x in slices], pa.binary()), pa.array([None] * SLICES, pa.int64())], schema=_PROFILE)

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<u8" if w else "<u4").astype("<u8") for x, w in zip(group["blob"], group["wide"]))
    return pd.DataFrame({"slice": [group["slice"].iloc[0]], "blob": [total.tobytes()], "wide": [True]})


def class_counts(profiles: DataFrame, parts: int) -> np.ndarray:
    """The count table, added up over all documents in two steps so that no task gets the slices of all partitions; CLASSES numbers reach the driver."""
    rows = profiles.where("kind = 'counts'").select(F.col("doc_id").alias("slice"), (F.col("n") % max(1, round(parts**0.5))).alias("lane"), "blob", F.lit(False).alias("wide"))
    kind = "slice long, blob binary, wide boolean"
    some = rows.groupBy("slice", "lane").applyInPandas(lambda g: _add(g), kind)
    total = {r.slice: r.blob for r in some.groupBy("slice").applyInPandas(lambda g: _add(g), kind).collect()}
    return np.concatenate([np.frombuffer(total[i], "<u8") for i in range(SLICES)]) if total else np.zeros(CLASSES, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if den * small < num * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (small + large - both)


def _links_of_part(num: int, den: int):
    """Links that connect the nodes of one part of a key group: each node is tried against members of the components found so far."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values(["size", "node"])
        nodes, sets = group["node"].tolist(), [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        components: list[list[int]] = []
        out = []
        for i in range(len(nodes)):
            joined = None
            for k, c in enumerate(components):
                tries = dict.fromkeys([c[-1], c[0], c[len(c) // 2]])
                if any(linked(sets[i], sets[j], num, den) for j in tries):
                    if joined is None:
                        out.append((nodes[c[0]], nodes[i]))
                        c.append(i)
                        joined = k
                    else:
                        out.append((nodes[components[joined][0]], nodes[c[0]]))
                        components[joined] += c
                        c.clear()
            components = [c for c in components if c]
            if joined is None:
                components.append([i])
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def prefix_plan(ordered: np.ndarray, counts: np.ndarray, documents: int, num: int, den: int) -> tuple[int, int, int]:
    """For a set in rarity order: (length of the prefix it offers as the smaller side at level 1, its level as the larger side, length of its prefix at that level).

    Level l costs the postings of its prefix, and a candidate for each other document that is expected to share l of them.
    """
    size = len(ordered)
    offers = size - _ceil(2 * num * size, num + den) + 1
    least = _ceil(num * (size + _ceil(num * size, den)), num + den)  # overlap with any partner not larger
    base = size - least
    top = max(1, min(LEVELS, least))
    reads = np.cumsum(counts[: base + top])
    best = None
    for level in range(1, top + 1):
        read = float(reads[min(base + level, size) - 1])
        share = read / max(documents, 1)
        cost = read + VERIFY_COST * documents * share**level / (1, 1, 2, 6, 24)[level]
        if best is None or cost < best[0]:
            best = (cost, level)
    return offers, best[1], base + best[1]


def parity(s: np.ndarray) -> list[int]:
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


_PREFIX = "node long, size int, offers int, level int, reads int, prefix binary, " + ", ".join(f"parity{i} long" for i in range(PARITY))


def _prefixes(n: int, num: int, den: int, counts, documents: int):
    kinds = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("offers", pa.int32()), ("level", pa.int32()), ("reads", pa.int32()), ("prefix", pa.binary()), *((f"parity{i}", pa.int64()) for i in range(PARITY))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        for _, sets in _each_set(batches, n):
            rows = []
            for s in sets:
                if den * len(s) < num * (len(s) + 1):  # too small to be linked with any other set
                    continue
                if (node := node_of(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                c = table[_classes(s)]
                order = np.lexsort((s, c))
                offers, level, reads = prefix_plan(s[order], c[order], documents, num, den)
                rows.append((node, len(s), offers, level, reads, s[order][: max(reads, offers + LEVELS - 1)].tobytes(), *parity(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return run


_POSTING = np.dtype([("h", "<u8"), ("node", "<i8"), ("component", "<i8"), ("size", "<i4"), ("at", "<i4"), ("offers", "<i4"), ("level", "<i4"), ("reads", "<i4")])


def _posting_blocks(buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x, np.uint64) for x in b.column("prefix").to_pylist()]
            n = np.array([len(x) for x in each], np.int64)
            p = np.zeros(n.sum(), _POSTING)
            p["h"] = np.concatenate([*each, np.zeros(0, np.uint64)])
            for name in ("node", "component", "size", "offers", "level", "reads"):
                p[name] = np.repeat(b.column(name).to_numpy(), n)
            p["at"] = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            bucket = ((p["h"] >> np.uint64(12)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([p[order[edges[i] : edges[i + 1]]].tobytes() for i in some], pa.binary())], ["bucket", "postings"])

    return run


def _shared_postings(group: pd.DataFrame) -> pd.DataFrame:
    """The postings of shingles that more than one component holds."""
    p = np.frombuffer(b"".join(group["postings"]), _POSTING)
    p = p[np.lexsort((p["component"], p["h"]))]
    edge = np.flatnonzero(np.r_[True, p["h"][1:] != p["h"][:-1]])
    last = np.r_[edge[1:], len(p)]
    many = p["component"][edge] != p["component"][last - 1]
    p = p[np.repeat(many, last - edge)]
    return pd.DataFrame({"h": p["h"].astype(np.int64)} | {k: p[k].copy() for k in _POSTING.names[1:]})


def _verify(num: int, den: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(a, c)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, representatives: DataFrame, n: int) -> DataFrame:
    """(node, size, shingles) of the documents named in representatives (key, lone: of a row without an id)."""
    kinds = ["node", "size", "shingles"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each_set(batches, n):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], kinds)

    # texts without ids once each before they are dealt out, as any number of rows may share one
    lone = docs.where("doc_id is null").select("key", "text").dropDuplicates(["key"]).select(F.lit(True).alias("lone"), "key", "text")
    each = docs.where("doc_id is not null").select(F.lit(False).alias("lone"), "key", "text").unionByName(lone)
    wanted = each.join(representatives.hint("shuffle_hash"), ["lone", "key"], "left_semi").select("text")
    return wanted.mapInArrow(run, "node long, size int, shingles binary").dropDuplicates(["node"])


def _key(doc_id: str):
    """What a row is fetched by: its id, or a hash of its text if it has none."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64("text"))


def components(docs: DataFrame, n: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id an integer)."""
    return _components(docs, n, similarity).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """components with the key of each row and of the row that its component keeps."""
    num, den = similarity
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key("doc_id").alias("key"))
    profiles = cut(texts.select("*", F.spark_partition_id().cast("long").alias("part")).mapInArrow(_profiles(n), "kind string, doc_id long, n long, node long, blob binary, key long"))
    of_doc = profiles.where("kind = 'document'").select("doc_id", "n", "node", "key")
    counts = class_counts(profiles, texts.rdd.getNumPartitions())
    nodes = cut(of_doc.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key")).withColumn("lone", F.col("doc_id").isNull()))

    # 2: links within groups of a min-hash key
    keyed = profiles.where("kind = 'document' and node is not null").select("node", "blob").dropDuplicates(["node"])

    @released
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("blob").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(b.column("node").to_numpy(), KEYS))], ["key", "node"])

    in_key = cut(keyed.mapInArrow(keys, "key long, node long"))
    groups = in_key.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("members > 1")
    groups = groups.groupBy("members", "first", "mark").agg(F.min("key").alias("key"))  # groups of the same nodes once
    member = in_key.join(groups, "key").select("key", "node", "first", F.ceil(F.col("members") / PART).alias("parts"))
    split = member.select("key", "node", F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "key"), F.col("parts")))).alias("part"))
    split = cut(split.select("key", "node", F.explode("part").alias("part")))
    near = split.select("node").distinct()
    sets = cut(_sets_of(texts, nodes.join(near, "node", "left_semi").select("lone", "key"), n))
    links = cut(split.join(sets, "node").groupBy("key", "part").applyInPandas(tidy(_links_of_part(num, den), "shingles"), "a long, b long"))
    first = connected_components(links)

    # 3: candidates among different components
    documents = max(1, nodes.count())
    shared = spark.sparkContext.broadcast(counts)
    prefixes = texts.select("text").mapInArrow(_prefixes(n, num, den, shared, documents), _PREFIX).dropDuplicates(["node"])
    prefixes = cut(prefixes.join(first, "node", "left").withColumn("component", F.coalesce("component", "node")))
    buckets = max(3 * shuffle_width(docs), 2 * texts.rdd.getNumPartitions())
    blocks = prefixes.drop(*(f"parity{i}" for i in range(PARITY))).mapInArrow(_posting_blocks(buckets), "bucket int, postings binary")
    postings = cut(blocks.groupBy("bucket").applyInPandas(tidy(lambda g: _shared_postings(g), "postings"), "h long, node long, component long, size int, at int, offers int, level int, reads int"))
    # the larger side (ties: by node) reads its prefix at its own level; the smaller side's shingle at position p belongs to level p - offers + 2 and up
    strings = lambda side: prefixes.select(F.col("node").alias(side), *(F.col(f"parity{i}").alias(f"{side}{i}") for i in range(PARITY)))
    large = postings.where("at < reads").select("h", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("sx"), F.col("at").alias("px"), "level").join(strings("x"), "x")
    small = postings.select("h", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("size").alias("sy"), F.col("at").alias("py"), F.greatest(F.lit(1), F.col("at") - F.col("offers") + 2).alias("from_level")).join(strings("y"), "y")
    bounds = (F.col("cx") != F.col("cy")) & ((F.col("sy") < F.col("sx")) | ((F.col("sy") == F.col("sx")) & (F.col("y") < F.col("x")))) & (F.col("sy") * den >= F.col("sx") * num) & (F.col("from_level") <= F.col("level"))
    # what can still match from here on, with those before, must reach the overlap that the link needs
    reach = F.least(F.col("px"), F.col("py")) + F.least(F.col("sx") - F.col("px"), F.col("sy") - F.col("py"))
    bounds &= reach * (num + den) >= (F.col("sx") + F.col("sy")) * num
    differ = sum(F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(PARITY))
    bounds &= differ * (num + den) <= (F.col("sx") + F.col("sy")) * (den - num)
    hits = large.join(small, "h").where(bounds)
    pairs = cut(hits.groupBy("x", "y").agg(F.count(F.lit(1)).alias("matches"), F.max("level").alias("level")).where("matches >= level").select(F.col("x").alias("a"), F.col("y").alias("b")))

    # 4: verification on whole sets, and components over all links
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    missing = nodes.join(need, "node", "left_semi").join(sets.select("node"), "node", "left_anti").select("lone", "key")
    more = cut(sets.join(need, "node", "left_semi").unionByName(_sets_of(texts, missing, n)))
    both = pairs.join(more.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(more.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    late = cut(both.mapInArrow(_verify(num, den), "a long, b long"))
    found = connected_components(links.union(late))
    named = nodes.join(found, "node", "left").select("node", "doc_id", "key", F.coalesce("component", "node").alias("component"))
    name = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("kept_key"))
    named = named.join(name, "component").select("node", "component_id", "kept_key")
    out = of_doc.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "kept_key")
    return out


def keep_one(docs: DataFrame, n: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with one document of each component, the one with its smallest doc_id (if it has none, one of its rows); texts without words all stay.

    Of rows equal in doc_id and lower-cased text one stays; rows that share an id but not a text go or stay together.
    """
    of = _components(docs, n, similarity).withColumn("kept_lone", F.col("doc_id").isNull())
    stay = of.where("n_shingles > 0 and key = kept_key and kept_lone = (component_id is null)").select("kept_lone", "key", F.lit(False).alias("bare"))
    bare = of.where("n_shingles = 0").select("kept_lone", "key", F.lit(True).alias("bare"))
    kept = stay.union(bare).distinct().select("kept_lone", F.col("key").alias("kept"), F.col("bare").alias("kept_bare"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _key("doc_id").alias("at")).withColumn("bare", F.translate(text, " \t\n\x0b\x0c\r", "") == "")
    kept = rows.join(kept, (F.col("at") == F.col("kept")) & (F.col("id").isNull() == F.col("kept_lone")) & (F.col("bare") == F.col("kept_bare")))
    turn = F.row_number().over(Window.partitionBy("id", F.xxhash64(F.lower(text))).orderBy(F.xxhash64(text)))
    return kept.withColumn("turn", turn).where("bare or turn = 1").select("row.*")
