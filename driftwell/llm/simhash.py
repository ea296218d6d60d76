"""SimHash near-duplicate detection over a byte-position inverted index.

Two 64-bit fingerprints that differ in at most `distance` bits differ in at most `distance` of
their eight bytes, so they share at least 8 - distance positional bytes: the guaranteed minimum.
A posting list for a single (position, byte) would hold 1/256 of all fingerprints and its pairs grow
with the square of the input, so postings are keyed by every choice of four positions with their bytes (for distance
2: 70 lists a fingerprint, and a pair that reaches the minimum meets in 15 of them).  Each pair that meets in a list has its
shared positional bytes tallied over all eight places; what reaches the minimum has its bits verified.
The fingerprints of a long list (a family of near copies) are put into lists of 8 - distance positions, where all pairs that
reach the minimum still meet; these hold 256**distance fingerprints at most and are compared in cells of bounded size.

Rows: null text counts as no words.  No words: fingerprint zero.  Fewer than `words` words: one
shingle of them all.  Repeated rows link to each other through their equal fingerprint.  A null doc_id
keeps its row and never serves as a component id unless all ids of the component are null.
Extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, stash

SEED = 42
PIECE = 1 << 15
SHORT, CELL = 64, 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text: lower-cased A-Z, white-space words, shingles with repeats."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes hold."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every whole text."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def posting_lists(fps: DataFrame, width: int) -> DataFrame:
    """(key, fp, n): the inverted index of the values of fp by every choice of `width` byte positions, lists of n > 1 only.

    A key is a hash of the positions and their bytes; two lists that a collision joins only add candidates.
    Here and below joins are told to merge: Spark sizes a table as before its explode, and by its compressed files, so it would
    send tables of gigabytes through the driver.
    """
    masks = [sum(0xFF << 8 * i for i in kept) for kept in combinations(range(8), width)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = fps.select("fp").distinct().select(F.explode(keys).alias("key"), "fp")
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "key").select("key", "fp", "n")


def pairs_of_short(lists: DataFrame, distance: int) -> DataFrame:
    """(a, b) of lists (key, fp) of at most SHORT values: pairs whose tally of shared positional bytes reaches the minimum and whose bits are near."""
    shared = lambda x, i: F.when(x.bitwiseAND(F.lit((0xFF << 8 * i) - (1 << 64 if i == 7 else 0))) == 0, 1).otherwise(0)

    def near(a):
        def keep(b):
            x = a.bitwiseXOR(b)
            tally = sum((shared(x, i) for i in range(8)), F.lit(0))
            return (b > a) & (tally >= 8 - distance) & (F.bit_count(x) <= distance)

        return keep

    grouped = lists.groupBy("key").agg(F.collect_list("fp").alias("fps"))
    return grouped.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", near(F.col("a")))).alias("b")).distinct()


def pairs_of_long(lists: DataFrame, distance: int) -> DataFrame:
    """The same of longer lists (key, fp, n): values are dealt in chunks of about CELL, and each two chunks of a list are compared in a task."""
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    cells = lists.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")).select(
        "key", "fp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    )

    def compare(table):
        fp, own = table.column("fp").to_numpy(), table.column("own").to_numpy()
        low = own == table.column("lo")[0].as_py()
        left, right = fp[low], fp[~low] if (~low).any() else fp
        found = []
        for at in range(0, len(left), 256):
            x = left[at : at + 256, None] ^ right
            tally = (x[..., None].view(np.uint8) == 0).sum(2)
            i, j = np.nonzero((tally >= 8 - distance) & (np.bitwise_count(x.view(np.uint64)) <= distance) & (x != 0))
            found.append(np.stack([left[at + i], right[j]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def near_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct values of fp, a < b, that differ in at most `distance` bits."""
    wide = max(1, 6 - distance)
    lists = stash(posting_lists(fps, wide))
    short = pairs_of_short(lists.where(F.col("n") <= SHORT), distance)
    # a pair of a long list shares 8 - distance bytes if it passes the tally: such lists are taken apart by as many positions
    finer = stash(posting_lists(lists.where(F.col("n") > SHORT), 8 - distance))
    more = pairs_of_short(finer.where(F.col("n") <= SHORT), distance).unionByName(pairs_of_long(finer.where(F.col("n") > SHORT), distance))
    return short.unionByName(more).distinct()


def near_roots(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(fp2, root, component_id): the component of each value of fp, and the smallest doc_id of its rows."""
    parts = connected_components(near_links(fps, distance))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(parts.hint("merge"), classes.fp == parts.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(tops.hint("merge"), "root").select(F.col("fp").alias("fp2"), "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    fps = stash(fingerprints(docs, words))
    return fps.join(near_roots(fps, distance).hint("merge"), F.col("fp") == F.col("fp2")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


PLACES, BANDS, FEW, CHUNK = 256, 32, 8, 512
ODD = (np.random.default_rng(42).integers(0, 1 << 63, (2, PLACES), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def positional_bytes(text: str | None, words: int = 5) -> bytes:
    """One byte a place: the low byte of the least of the text's shingle hashes under the place's own mixing.

    Two texts share each place with the chance of their shingle sets' similarity (and one in 256 besides).
    """
    return least_bytes(shingle_hashes(text, words))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """One 64-bit hash a shingle of the text, with repeats; none of a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = ends[words - 1 :].tolist() or [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def least_bytes(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return b""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512, None] ^ ODD[0]) * ODD[1]).min(0), out=least)
    return (least >> np.uint64(8)).astype(np.uint8).tobytes()


def least_tally(similarity: float) -> int:
    """Shared places that a pair at the similarity has, but for six standard deviations."""
    p = similarity + (1 - similarity) / 256
    return int(PLACES * p - 6 * (PLACES * p * (1 - p)) ** 0.5)


def forest(x: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Row pairs of a maximum spanning forest of x's rows over the pairs that share at least `least` places."""
    at, out, n = 0, [], len(x)
    rows, best, via = np.arange(1, n), np.full(n - 1, -1), np.zeros(n - 1, np.int64)
    rest = x[1:].copy()
    while len(rows):
        tally = np.count_nonzero(rest == x[at], axis=1)
        better = tally > best
        best[better], via[better] = tally[better], at
        k = int(best.argmax())
        at = int(rows[k])
        if best[k] >= least:
            out.append((int(via[k]), at))
        for v in (rows, best, via, rest):
            v[k] = v[-1]
        rows, best, via, rest = rows[:-1], best[:-1], via[:-1], rest[:-1]
    return out


def similar_lists(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): all pairs in posting lists of at most FEW nodes of sigs (node, sig); and the longer lists' cells (band, key, lo, hi, node, sig).

    Postings are keyed by four places with their bytes (32 choices; a pair at 0.8 misses all of them once in 20 million).  A longer
    list is dealt in chunks of about CHUNK nodes, and each two chunks make a cell, so every pair meets in one.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.substring("sig", 4 * i + 1, 4).alias("key")) for i in range(BANDS)])
    rows = sigs.select("node", F.explode(keys).alias("k")).select("node", "k.band", "k.key")
    lists = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(lists.hint("merge"), ["band", "key"])
    few = shared.where(F.col("n") <= FEW).groupBy("band", "key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    pairs = (
        few.select(F.explode("nodes").alias("a"), "nodes")
        .select("a", F.explode(F.filter("nodes", lambda x: x > F.col("a"))).alias("b"))
        .distinct()
    )
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    cells = (
        shared.where(F.col("n") > FEW)
        .select("band", "key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("band", "key", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .join(sigs.hint("merge"), "node")
        .select("band", "key", "lo", "hi", "node", "sig")
    )
    return pairs, cells


def places(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PLACES)


def similar_pairs(sigs: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of nodes of sigs (node, sig) that may be that similar; and the cells of similar_lists() for crossing_links().

    The same index over positional bytes: all pairs of a short posting list have their shared places tallied over all 256; each cell
    of a long one gives a maximum spanning forest of its tallies, the likeliest links of its nodes.
    """
    least = least_tally(similarity)
    pairs, cells = similar_lists(sigs)
    cells = stash(cells)

    def tally(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array((places(batch.column(2)) == places(batch.column(3))).sum(1) >= least))

    def span(table):
        table = table.sort_by("node")
        nodes = table.column("node").to_numpy()
        edges = np.array(forest(places(table.column("sig")), least), np.int64).reshape(-1, 2)
        return pa.table({"a": np.minimum(*nodes[edges].T), "b": np.maximum(*nodes[edges].T)})

    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("s1"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("s2"))
    close = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "s1", "s2").mapInArrow(tally, "a long, b long")
    return close.unionByName(cells.groupBy("band", "key", "lo", "hi").applyInArrow(span, "a long, b long")).distinct(), cells


def crossing_links(cells: DataFrame, parts: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b): links that join, of all pairs of a cell that parts (node, root) leaves apart, those whose sets (node, hashes) are that similar.

    A pair is compared in the first band that it shares; the sets come to the cell, so no row is made for each pair.
    """
    least, keys = least_tally(similarity), ["band", "key", "lo", "hi"]
    marked = cells.join(parts.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = marked.groupBy(*keys).agg((F.min("root") < F.max("root")).alias("open")).where("open").drop("open")

    def cross(table):
        nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy().copy()
        x, band, out = places(table.column("sig")), table.column("band")[0].as_py(), []
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        for i in range(len(x) - 1):
            other = i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])
            same = x[other] == x[i]
            other, same = (v[np.count_nonzero(same, axis=1) >= least] for v in (other, same))
            for j in other[same[:, : 4 * BANDS].reshape(-1, BANDS, 4).all(2).argmax(1) == band].tolist():
                if roots[i] != roots[j] and alike(hashes[i], hashes[j], similarity):
                    out.append(sorted((nodes[i], nodes[j])))
                    roots[roots == roots[j]] = roots[i]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return marked.join(split.hint("merge"), keys).join(sets.hint("merge"), "node").select(*keys, "node", "root", "sig", "hashes").groupBy(*keys).applyInArrow(cross, "a long, b long")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are that similar."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) * (1 - 1e-9):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) >= similarity


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the sorted distinct shingle hashes of each text of texts (node, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The pairs (a, b) whose shingle sets, of sets (node, hashes), are that similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(alike(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("h1"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("h2"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "h1", "h2").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """(doc_id, digest, root) of every row: rows with one root are linked, directly or in steps, by that similarity of shingle sets.

    A node is a set of shingles, named by a 64-bit hash; digest is the text's MD5.  Candidates come from near fingerprints (which only
    tell nearly equal texts: at 0.8 about ten of 64 bits differ and no byte need be shared) and from positional bytes, and
    every link is held against the sets themselves.  The forests' pairs are compared first, then all pairs that these left apart.
    """

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.column(2).to_pylist()]
            names = [xxh64_intdigest(np.unique(h).tobytes(), SEED) for h in hashes]
            fps = [majority(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.array(v, np.uint64).view(np.int64)) for v in (names, fps)), pa.array([least_bytes(h) for h in hashes], pa.binary())],
                ["doc_id", "digest", "node", "fp", "sig"],
            )

    marked = stash(keyed(docs).mapInArrow(run, "doc_id long, digest binary, node long, fp long, sig binary"))
    nodes = marked.groupBy("node").agg(F.min(F.struct("digest", "fp", "sig")).alias("m")).select("node", "m.*").where(F.length("sig") > 0)
    near, cells = similar_pairs(nodes.select("node", "sig"), similarity)
    of = nodes.groupBy("fp").agg(F.min("node").alias("top"))
    far = near_links(nodes, distance)
    ends = [of.select(F.col("fp").alias(end), F.col("top").alias(top)).hint("merge") for end, top in ("ax", "by")]
    far = far.join(ends[0], "a").join(ends[1], "b")
    same = nodes.join(of.hint("merge"), "fp").where("node <> top").select(F.col("top").alias("a"), F.col("node").alias("b"))
    extra = far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same)
    first = stash(near.unionByName(extra).distinct())
    met = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).unionByName(cells.select("node")).distinct()
    texts = keyed(docs).groupBy("digest").agg(F.first("text").alias("text")).join(nodes.select("node", "digest").join(met.hint("merge"), "node", "left_semi").hint("merge"), "digest")
    sets = stash(shingle_sets(texts.select("node", "text"), words))
    links = stash(verified(first, sets, similarity))
    more = crossing_links(cells, connected_components(links), sets, similarity)
    parts = connected_components(links.unionByName(more))
    return marked.select("doc_id", "digest", "node").join(parts.hint("merge"), "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text), the digest 16 bytes of the text (null as no text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs with one left of each root of groups (doc_id, digest, root): of its smallest doc_id, null only where all are."""
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("m"))
    kept = kept.select(F.col("m.doc_id").alias("_id"), F.col("m.digest").alias("_digest"))
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    found = docs.withColumn("_of", digest).join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_digest")), "left_semi")
    return found.dropDuplicates(["doc_id", "_of"]).select(*docs.columns)


def keep_similar_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs with one left of each group of similar_groups()."""
    return one_of_each(docs, similar_groups(docs, words, similarity))


def keep_one(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """The rows of docs with one document left of each component: its smallest doc_id, one row of it; one row of each null doc_id's component."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "digest", "fp"])

    marked = stash(keyed(docs).mapInArrow(run, "doc_id long, digest binary, fp long"))
    roots = near_roots(marked, distance)
    kept = one_of_each(docs, marked.join(roots.hint("merge"), F.col("fp") == F.col("fp2")).select("doc_id", "digest", "root"))
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
