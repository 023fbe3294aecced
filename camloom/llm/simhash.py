"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit place gets a non-zero vector of radius + 1 bits, and every non-zero vector v of that length a mask: the places
whose vector has odd parity with v. The places in which two fingerprints within the radius differ span at most radius
dimensions, so some v is orthogonal to all of them: under its mask the two are equal. Each such pair meets in some table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.llm.common import dropped, text_of, written
from camloom.llm.components import components

BITS = 64
#: Shingles whose bits are counted at once: bounds the memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of UTF-8 text: lower-cased A-Z, words between ASCII white space, shingles of k words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < k:
        starts, ends = [0], [len(joined)]
    else:
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts, ends = [0, *last[: len(words) - k].tolist()], (last[k - 1 :] - 1).tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), BLOCK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """carry's columns and ``fp`` of every row's whole text (null: empty, fingerprint 0)."""
    wanted = docs.select(*(F.col(f"`{c}`") for c in carry), text_of(f"`{text}`").cast("binary").alias("q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes(), k, seed) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*carry, "fp"])

    schema = wanted.drop("q_text").schema.add("fp", "long")
    return wanted.mapInArrow(run, schema)


def covering_masks(radius: int = 2) -> list[int]:
    """2 ** (radius + 1) - 1 masks of 64 bits, as signed numbers."""
    top = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(BITS) if (v & (i % top + 1)).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints ``fp`` -> (u, v): enough links, each of at most radius bits, to join all that links join.

    A bucket is the fingerprints equal under one mask. In one of two they are compared. In a larger one, each fingerprint
    and those made by flipping up to radius / 2 of its free bits (not under the mask) are looked up: two are within the
    radius just if such neighbourhoods share a value (for an odd radius the next even one is used, and links are checked).
    A value is shared by at most as many fingerprints as it has neighbours, so no group grows with the data, and no bucket
    is ever paired with itself.
    """
    half = (radius + 1) // 2
    if half > 1:
        raise ValueError("radius 0, 1 or 2")
    masks = covering_masks(radius)
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"), F.lit(m).alias("mask")) for k, m in enumerate(masks)))).alias("x")).select("fp", "x.*")
    buckets = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    two = buckets.where((F.col("n") == 2) & near).select("u", "v")
    crowd = rows.join(buckets.where(F.col("n") > 2).select("t", "key"), ["t", "key"])
    flips = F.concat(F.array(F.lit(0).cast("long")), F.filter(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS))), lambda b: b.bitwiseAND(F.col("mask")) == 0))
    around = crowd.select("t", "fp", F.explode(F.transform(flips, lambda b: b.bitwiseXOR(F.col("fp")))).alias("at"))
    met = around.groupBy("t", "at").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    star = met.select(F.array_min("s").alias("u"), F.explode("s").alias("v")) if radius > 1 else met.select(F.explode("s").alias("u"), F.col("s")).select("u", F.explode("s").alias("v")).where(F.col("u") < F.col("v"))
    return two.unionByName(star.where((F.col("u") != F.col("v")) & near)).distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable by links) of every row.

    Null texts are empty; all texts without words share fingerprint 0. Equal fingerprints link, so repeated rows and exact
    copies are one component; they are compared once, as one fingerprint. Null ids are kept and never name a component that
    has another id. Other columns are not read. An empty table gives an empty result.
    """
    table = written(fingerprints(docs, [doc_id], text, k, seed), "fingerprints")
    nodes = table.groupBy("fp").agg(F.min(doc_id).alias("least"))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return table.join(named, "fp").select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- groups by similarity


#: Buckets of hashes whose sizes give the order of shingles, and members of a group that are held against each other at once.
BUCKETS, MEMBERS = 1 << 18, 4096
#: Words of sketches that are compared at once.
WORDS = 1 << 20
#: Prefix shingles are dealt out in so many passes, each with its share of them: what a pass shuffles is gone before the next.
PASSES = 4
#: Bounds are loosened by so much, so that rounding never loses a pair; what they let through is verified.
SLACK = 1 - 1e-12


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles of lower-cased words; of all words, if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate([[0], last[: max(0, len(words) - k)]]), last[min(k, len(words)) - 1 :] - 1
    hashes = [
        np.frombuffer(b"".join([digest(joined[x:y]) for x, y in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)]), ">u8")
        for at in range(0, len(starts), BLOCK)
    ]
    return np.unique(np.concatenate(hashes).astype(np.uint64))


def shingle_set(text: bytes, k: int) -> set[int]:
    return set(shingles(text, k).tolist())


def node_of(hashes: np.ndarray) -> int:
    """The signed 64-bit digest of a set of shingles. Texts with equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def bucket_sizes(texts: DataFrame, k: int) -> np.ndarray:
    """How many shingles of texts (binary, the only column) fall into each bucket of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(counts, (shingles(x.as_buffer().to_pybytes(), k) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    found = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles: a bit is set if it is in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes, set if an odd number of them has it; two to four bits a hash, 128 at least.

    Two sets differ in at least as many hashes as their sketches do in bits. Halves laid over each other (xor) are the sketch
    of half as many bits, so that sketches of any two sizes can be compared.
    """
    bits = max(128, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 128
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1).tobytes()


def prefixes(wanted: DataFrame, k: int, similarity: float) -> DataFrame:
    """(id, q_text) -> id, node, fp (SimHash of its set of shingles), n (their number), sketch, first (those of its prefix).

    Shingles are in one order for all texts, those of small buckets first. Of two sets similar by ``similarity``, each
    lacks at most n - ceil(similarity * n) of its shingles in the other, so their prefixes, one longer, share one. The
    order decides how many others share it, not whether a pair is found.
    """
    sizes = wanted.sparkSession.sparkContext.broadcast(bucket_sizes(wanted.select("q_text"), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, counts, sketches, firsts = [], [], [], [], []
            for x in b.column(1):
                s = shingles(x.as_buffer().to_pybytes(), k)
                n = len(s)
                order = np.lexsort((s, sizes.value[(s % np.uint64(BUCKETS)).astype(np.int64)]))
                firsts.append(s[order[: n - math.ceil(similarity * SLACK * n) + 1]].view(np.int64))
                nodes.append(node_of(s))
                fps.append(majority(s))
                counts.append(n)
                sketches.append(sketch(s))
            numbers = (pa.array(x, pa.int64()) for x in (nodes, fps, counts))
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array(sketches, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], names=["id", "node", "fp", "n", "sketch", "first"])

    return wanted.mapInArrow(run, "id long, node long, fp long, n long, sketch binary, first array<long>")


def covered(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(node, fp) -> distinct (u, v): candidates by covering masks. Of nodes with one fingerprint, each with the least; of fingerprints
    within the radius, the least nodes of those that ``links`` joins."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(least, "fp").select(F.col("least").alias("u"), F.col("node").alias("v"))
    ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"q_{x}")) for x in "uv"]
    near = links(least.select("fp"), radius).join(ends[0], "u").join(ends[1], "v").select(F.least("q_u", "q_v").alias("u"), F.greatest("q_u", "q_v").alias("v"))
    return same.unionByName(near).where("u < v").distinct()


def members(kinds: DataFrame, part: int, parts: int = PASSES) -> DataFrame:
    """(node, first) -> distinct head, node: the members of each prefix shingle under the least of them, itself left out; of the
    shingles of one pass. Members of a shingle are in one head's group. A row has two numbers as it is shuffled."""
    rows = kinds.select("node", F.explode("first").alias("token")).where(F.pmod("token", F.lit(parts)) == part).select("token", "node")
    headed = rows.select(F.first("node").over(Window.partitionBy("token").orderBy("node")).alias("head"), "node")
    return headed.where("head < node").distinct()


def possible(n: np.ndarray, sketches: list[bytes], similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets in ascending order of their sizes n -> (first row, differing bits, whether rows may be similar to columns), a few rows at
    a time; the first column is the first row, and a pair counts where its column is beyond its row.

    Sets that are similar enough differ in at most (1 - similarity) / (1 + similarity) of n + m hashes, so none is missed.
    """
    size = np.array([len(x) for x in sketches])
    last = np.searchsorted(n, n / (similarity * SLACK), "right")
    for width in np.unique(size).tolist():
        start, end = np.searchsorted(size, [width, width + 1]).tolist()
        # Those of wider sketches are folded to this width.
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in sketches[start : last[end - 1]]])
        at = start
        while at < end:
            # As many rows as WORDS allows: with the columns of the last of them.
            rows = 1
            while at + 2 * rows <= end and 2 * rows * (last[at + 2 * rows - 1] - at) * (width // 8) <= WORDS:
                rows *= 2
            to = int(last[at + rows - 1])
            a, b = folded[at - start : at - start + rows], folded[at - start : to - start]
            bits = np.zeros((rows, to - at), np.int64)
            step = max(1, WORDS // (rows * (width // 8)))
            for c in range(0, to - at, step):
                bits[:, c : c + step] = np.bitwise_count(a[:, None, :] ^ b[None, c : c + step, :]).sum(axis=2, dtype=np.int64)
            both = n[at : at + rows, None] + n[None, at:to]
            fits = (1 + similarity) * SLACK * bits <= (1 - similarity) * both
            fits &= (n[at : at + rows, None] >= similarity * SLACK * n[None, at:to]) & (np.arange(rows)[:, None] < np.arange(to - at)[None, :])
            yield at, bits, fits
            at += rows


def nearest(n: np.ndarray, sketches: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Each set, in order of sizes, with the one before it of which its sketch differs least, if they may be similar: places of both."""
    none = np.iinfo(np.int64).max
    least, who = np.full(len(n), none), np.zeros(len(n), np.int64)
    for at, bits, fits in possible(n, sketches, similarity):
        bits = np.where(fits, bits, none)
        row = bits.argmin(axis=0)
        found = bits[row, np.arange(len(row))]
        better = np.flatnonzero(found < least[at : at + len(row)])
        least[at + better], who[at + better] = found[better], at + row[better]
    later = np.flatnonzero(least < none)
    return who[later], later


def apart(n: np.ndarray, sketches: list[bytes], root: np.ndarray, block: np.ndarray, across: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that may be similar and have different roots, of different blocks only if ``across``: places of both."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(np.unique(root)) > 1:
        for at, _, fits in possible(n, sketches, similarity):
            i, j = np.nonzero(fits)
            i, j = i + at, j + at
            wanted = (root[i] != root[j]) & ((block[i] != block[j]) | (not across))
            u.append(i[wanted])
            v.append(j[wanted])
    return np.concatenate(u), np.concatenate(v)


def candidates(rows: DataFrame, crowded: DataFrame, similarity: float, roots: DataFrame | None = None) -> DataFrame:
    """(head, node, n, sketch) -> distinct (u, v) that may be similar: in each group, each with its nearest; with roots, all whose roots
    differ. A crowded group is cut into blocks of about MEMBERS; with roots, each two blocks meet by themselves."""
    first = roots is None
    rows = rows.withColumn("root", F.col("node")) if first else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = rows.join(crowded, "head", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    if first:
        dealt = dealt.withColumn("other", F.col("block"))
    else:
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy("head", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.sort_array(F.collect_list(F.struct("n", "node", "root", "block", "sketch"))).alias("each"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each, across = b.column(3), (b.column(1).to_numpy() != b.column(2).to_numpy()).tolist()
            flat, ends = each.flatten(), np.cumsum(each.value_lengths().to_numpy()).tolist()
            n, node, root, block = (flat.field(c).to_numpy() for c in range(4))
            sketches, us, vs = flat.field(4).to_pylist(), [], []
            for start, end, between in zip([0, *ends], ends, across, strict=False):
                own = slice(start, end)
                u, v = nearest(n[own], sketches[own], similarity) if first else apart(n[own], sketches[own], root[own], block[own], between, similarity)
                us.append(node[own][u])
                vs.append(node[own][v])
            u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["u", "v"])

    return groups.select("head", "i", "j", "each").mapInArrow(run, "u long, v long").distinct()


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """(u, v, x, y) -> (u, v) of those whose sets x and y (sorted distinct hashes) have a Jaccard similarity of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, wanted: DataFrame, table: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose texts are similar; pairs, a written table, goes. A node's text is one of its least id, told by its digest."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # Written first: then Spark knows its size, and where that is small the texts stay where they are.
    who = written(table.join(ends, "node").groupBy("node").agg(F.min("id").alias("id")), "who")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [(node, s.tobytes()) for node, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) if node_of(s := shingles(x.as_buffer().to_pybytes(), k)) == node]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], kind) for k, kind in enumerate((pa.int64(), pa.binary()))], names=["node", "s"])

    sets = written(wanted.join(who, "id").select("node", "q_text").mapInArrow(run, "node long, s binary").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("y")), "v").select("u", "v", "x", "y")
    edges = written(similar(both, similarity), "links")
    dropped(sets, pairs, who)
    return edges


def rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (id, node) with the root in place of each node that has one."""
    return nodes.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("node"))


def between(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (u, v) between the roots of their ends: the components of all edges are those of these over those already found."""
    for end in "uv":
        edges = edges.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"q_{end}")), end, "left")
    return edges.select(F.coalesce("q_u", "u").alias("u"), F.coalesce("q_v", "v").alias("v"))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, group_id (the least doc_id of the group) of every row whose id is not null; a row for each distinct pair.

    Groups are the components of all pairs whose texts have a Jaccard similarity of at least ``similarity`` on k-word
    shingles. Candidates come from SimHash under covering masks first, which joins close copies. A fingerprint misses pairs
    farther apart, so an exact search follows: similar texts share a shingle of their prefixes, and those that share one are
    in the group of the least of them. There sketches are held against each other, which miss no similar pair: first each
    takes its nearest, then all that are still in different groups meet. Every candidate is verified on its texts.
    Null texts count as empty, and all texts without words are one; an empty table gives an empty result.
    """
    wanted = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_of(f"`{text}`").cast("binary").alias("q_text"))
    made = written(prefixes(wanted, k, similarity), "prefixes")
    table = written(made.select("id", "node"), "nodes")
    kinds = written(made.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", "sketch", "first"))), "kinds")
    dropped(made)
    close = written(covered(kinds.select("node", "fp")), "close")
    parts = [written(members(kinds, part), "shared") for part in range(PASSES)]
    shared = written(reduce(DataFrame.unionByName, parts).distinct(), "shared")
    crowded = written(shared.groupBy("head").agg(F.ceil((F.count(F.lit(1)) + 1) / MEMBERS).cast("int").alias("blocks")).where("blocks > 1"), "crowded")
    grouped = shared.unionByName(shared.select("head", F.col("head").alias("node")).distinct())
    rows = written(grouped.join(kinds.select("node", "n", "sketch"), "node").select("head", "node", "n", "sketch"), "rows")
    dropped(*parts, shared, kinds)
    first = written(close.unionByName(candidates(rows, crowded, similarity)).distinct(), "pairs")
    dropped(close)
    edges = verified(first, wanted, table, k, similarity)
    roots = components(edges)
    more = verified(written(candidates(rows, crowded, similarity, roots), "pairs"), wanted, table, k, similarity)
    dropped(rows, crowded)
    named = rooted(rooted(table, roots), components(between(more, roots))).select("id", F.col("node").alias("root"))
    groups = named.groupBy("root").agg(F.min("id").alias("group_id"))
    return named.join(groups, "root").select(F.col("id").alias(doc_id), "group_id").distinct()


def op7_simhash(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
