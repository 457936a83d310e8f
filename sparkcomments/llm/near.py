"""N-gram Jaccard join: chosen-path join.

A document is the set of its five-word shingles. Each of several runs splits the documents recursively: a set follows
every token whose hash, drawn anew for the path so far, is below 1 / (threshold x size), so that two similar sets share
a path with a fixed chance while unlike sets part. A bucket of at most bucket_rows sets is compared by brute force; larger
ones split again, three times at most, and what is still larger is compared in pairs of parts. A pair at the threshold
meets in one run with a chance of 1 - exp(-1.1) if buckets are small after one split, and about 0.33 after three; with
twelve runs it is missed with a chance of 2e-6 and 8e-3. Similar sets come in groups, and a class needs only one
chain of links, so that classes lose less.

Comparing in buckets uses the sets themselves (32 bits of each shingle) where both have at most 64 shingles, else sketches
(one-permutation minima), which must agree to five deviations below the threshold for their size; it keeps a spanning star
of each bucket's similar sets, not its pairs. The classes of these candidates are then joined exactly: within a candidate class, in pairs of parts of
bounded size, sets are intersected by a matrix product. It yields every link, counted by document, and spanning links
for the final classes; no pair is written out. So the number of links is exact within a class, however large.

Equal sets (copies) are one representative from the start, counted before any shuffle. No cap drops anything; parts bound
what one task holds.

Texts of fewer than five words have one shingle, all their words. Texts without a word and null texts are alone in
their class, without links; rows without a doc_id have a null class. Repeated rows are copies; rows of one
doc_id are taken to hold one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ODD, mixed, staged, table, window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
RUNS, DEPTH = 12, 3
SKETCH = 256
#: Sets of at most that many shingles are compared as they are.
SMALL = 64
SLICE = 1 << 14
SEEDS = mixed(np.arange(1, RUNS + 1, dtype=np.uint64) * ODD)


def shingles(text: bytes | None) -> np.ndarray:
    words = word_hashes(text)
    if 0 < len(words) < SHINGLE:
        return mixed(np.array([np.bitwise_xor.reduce(words * np.arange(3, 3 + 2 * len(words), 2, dtype=np.uint64))], np.uint64))
    return np.unique(window_hashes(words, SHINGLE))


def _step(tokens: np.ndarray, paths: np.ndarray, least: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Which path goes on (its number), and the longer paths."""
    of, longer = [], []
    for a in range(0, len(tokens), SLICE):
        x = mixed((tokens[None, a:a + SLICE] ^ paths[:, None]) * ODD)
        at, token = np.nonzero(x < least)
        of.append(at)
        longer.append(x[at, token])
    of, longer = np.concatenate(of), np.concatenate(longer)
    return of, mixed(longer ^ (paths[of] * ODD))


def paths(tokens: np.ndarray) -> np.ndarray:
    """Rows of three paths, one for each split; 0 where a path has ended."""
    least = np.uint64(min(2**64 - 1, int(2**64 / (THRESHOLD * len(tokens)))))
    rows = np.zeros((RUNS, 0), np.uint64)
    ends = SEEDS
    for _ in range(DEPTH):
        alive = np.flatnonzero(ends) if rows.shape[1] else np.arange(RUNS)
        of, longer = _step(tokens, ends[alive], least)
        of = alive[of]
        dead = np.setdiff1d(np.arange(len(ends)), of)
        rows = np.concatenate([np.column_stack([rows[of], longer]), np.column_stack([rows[dead], np.zeros(len(dead), np.uint64)])])
        ends = rows[:, -1]
    return rows[rows[:, 0] != 0]


def sketch(tokens: np.ndarray) -> bytes:
    """One byte for each of 256 parts of the hash range: of the part's least token, or the next part's that has one."""
    part = (tokens >> np.uint64(56)).astype(int)  # tokens are sorted: the first of a part is its least
    first = np.unique(part, return_index=True)
    out = np.full(SKETCH, -1)
    out[first[0]] = (mixed(tokens[first[1]]) & np.uint64(255)).astype(int)
    filled = np.flatnonzero(out >= 0)
    src = filled[np.searchsorted(filled, np.arange(SKETCH)) % len(filled)]
    return out[src].astype(np.uint8).tobytes()


def _alike(both: np.ndarray, n, m) -> np.ndarray:
    """Whether sets of n and m members that share both are at the threshold of 4 / 5, in whole numbers."""
    return 5 * both >= 4 * (n + m - both)


def _sketch_least(n):
    """The share of a sketch that must agree for sets of at least n shingles: five deviations below the threshold. A small
    set fills its places from a few values, some of which stand in many."""
    return THRESHOLD - 5 * np.sqrt(THRESHOLD * (1 - THRESHOLD) * (1 / SKETCH + 2 / n))


def _compared(tokens: np.ndarray) -> bytes:
    """What buckets compare of a set: 32 bits of each shingle if it is small, its sketch if it can be alike a larger one."""
    small = (tokens >> np.uint64(32)).astype(np.uint32).tobytes() if len(tokens) <= SMALL else b""
    return small + (sketch(tokens) if 5 * len(tokens) > 4 * SMALL else b"")


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, a hash of the set in two parts, its size, what buckets compare (sketch) and paths."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            h1, h2, size, sketches, found = [], [], [], [], []
            for t in batch.column("t").to_pylist():
                tokens = shingles(t)
                size.append(len(tokens))
                h1.append(int(tokens.sum(dtype=np.uint64).view(np.int64)) if len(tokens) else None)
                h2.append(int(np.bitwise_xor.reduce(mixed(tokens ^ ODD)).view(np.int64)) if len(tokens) else None)
                sketches.append(_compared(tokens) if len(tokens) else None)
                found.append(paths(tokens).view(np.int64).ravel() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(sketches, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))], ["d", "h1", "h2", "n", "sketch", "paths"])

    slim = docs.select(F.col(key).alias("d"), F.col(text).cast("string").cast("binary").alias("t"))
    return slim.mapInArrow(run, f"d {kind}, h1 long, h2 long, n long, sketch binary, paths array<long>")


def _groups(batches, names):
    """Runs of rows with one value in the first column, over batches sorted by it: (value, rows as arrays)."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch.select(names)])
        rest = t if rest is None else pa.concat_tables([rest, t])
        ids = rest.column(0).to_numpy()
        ends = np.flatnonzero(np.diff(ids)) + 1
        start = 0
        for e in ends:
            yield rest.slice(start, e - start)
            start = e
        rest = rest.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's class."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _small_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of small sets at the threshold, by the number of shared members."""
    sizes = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(token.max() + 1, np.int64)
    left, right = [], []
    for k, (lo, hi) in enumerate(zip(starts[:-1], ends[:-1])):
        mark[token[lo:hi]] = 1
        j = np.flatnonzero(_alike(np.add.reduceat(mark[token[hi:]], starts[k + 1:] - hi), sizes[k], sizes[k + 1:]))
        mark[token[lo:hi]] = 0
        left.append(np.full(len(j), k))
        right.append(j + k + 1)
    return np.concatenate(left), np.concatenate(right)


def _sketch_pairs(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sketches that agree enough."""
    left, right = [], []
    m = len(x)
    step = max(1, (1 << 22) // (m * SKETCH) + 1)
    for k in range(0, m, step):
        same = (x[k:k + step, None, :] == x[None, :, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(same >= SKETCH * _sketch_least(np.minimum(sizes[k:k + step, None], sizes[None, :])))
        left.append(i + k)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(batches):
    """Spanning links of the similar sets of each bucket part."""
    for t in _groups(batches, ["g", "side", "rep", "sketch", "n"]):
        if t.num_rows < 2:
            continue
        reps, first = np.unique(t.column("rep").to_numpy(), return_index=True)
        m = len(reps)
        if m < 2:
            continue
        t = t.take(pa.array(first))
        sizes, held = t.column("n").to_numpy(), t.column("sketch").to_pylist()
        small, sketched = np.flatnonzero(sizes <= SMALL), np.flatnonzero(5 * sizes > 4 * SMALL)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(small) > 1:
            i, j = _small_pairs([np.frombuffer(held[k], np.uint32, sizes[k]) for k in small])
            left.append(small[i])
            right.append(small[j])
        if len(sketched) > 1 and sizes[sketched].max() > SMALL:
            x = np.frombuffer(b"".join(held[k][-SKETCH:] for k in sketched), np.uint8).reshape(-1, SKETCH)
            i, j = _sketch_pairs(x, sizes[sketched])
            left.append(sketched[i])
            right.append(sketched[j])
        root = _roots(m, np.concatenate(left), np.concatenate(right))
        at = np.flatnonzero(root != np.arange(m))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(reps[root[at]]), pa.array(reps[at])], ["a", "b"])


def _in_parts(rows: DataFrame, group: str, parts, part, *columns: str) -> DataFrame:
    """rows for each pair of parts of their group: g, a hash of the pair, and side."""
    def pairs(i, c):
        return F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.struct(F.least(i, j).alias("x"), F.greatest(i, j).alias("y")))

    return (rows.select(group, *columns, part.alias("part"), parts.alias("parts"))
            .select(group, *columns, "part", F.explode(pairs(F.col("part"), F.col("parts"))).alias("p"))
            .select(F.xxhash64(group, "p.x", "p.y").alias("g"), (F.col("part") == F.col("p.x")).cast("int").alias("side"),
                    (F.col("p.x") == F.col("p.y")).alias("alone"), *columns))


def _part(parts):
    return F.pmod(F.xxhash64("rep", F.lit(7)), parts).cast("int")


def classes(edges: DataFrame, name: str) -> DataFrame:
    """rep and root, the least member of its class, from staged edges a < b: neighbours move to the least one, until
    nothing changes. The number of rounds grows with the logarithm of the longest chain."""
    edges = staged(edges.distinct(), f"{name}-0")
    seen = None
    for n in range(1, 60):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = larger.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        edges = staged(down.join(low, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "v"), F.struct(F.col("m").alias("a"), F.col("u").alias("v")))).alias("e"))
                       .select("e.a", F.col("e.v").alias("b")).where("a < b").distinct(), f"{name}-{n}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("classes still change after 59 rounds")
    return edges.select(F.col("b").alias("rep"), F.col("a").alias("root"))


def _exact_links(batches):
    """For each pair of parts of a candidate class: how many links each set has in it, and spanning links."""
    for t in _groups(batches, ["g", "side", "alone", "rep", "t"]):
        if t.num_rows < 2:
            continue
        _, first = np.unique(t.column("rep").to_numpy(), return_index=True)  # repeated rows count once
        t = t.take(pa.array(first))
        reps, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
        alone = t.column("alone")[0].as_py()
        sets = [shingles(x) for x in t.column("t").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        _, token, df = np.unique(flat, return_inverse=True, return_counts=True)
        keep = df[token] > 1
        number = np.cumsum(df > 1) - 1
        row, token = row[keep], number[token[keep]]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        m = len(sets)
        a = np.arange(m) if alone else np.flatnonzero(side == 1)
        b = np.arange(m) if alone else np.flatnonzero(side == 0)
        if not len(a) or not len(b):
            continue
        both = np.zeros((len(a), len(b)), np.int32)
        width = max(64, min(4096, (1 << 24) // m))
        for k in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            lo, hi = np.searchsorted(token, [k, k + width])
            x = np.zeros((m, width), np.float32)
            x[row[lo:hi], token[lo:hi] - k] = 1
            both += (x[a] @ x[b].T).astype(np.int32)
        i, j = np.nonzero(_alike(both, sizes[a][:, None], sizes[b][None, :]))
        i, j = a[i], b[j]
        keep = i != j
        i, j = i[keep], j[keep]
        links = np.bincount(i, minlength=m) if alone else np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
        root = _roots(m, i, j)
        at = np.flatnonzero(links)
        if len(at):
            least = np.full(m, np.iinfo(np.int64).max)
            np.minimum.at(least, root, reps)
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(least[root[at]]), pa.array(links[at].astype(np.int64))], ["rep", "near", "links"])


def _sorted_groups(rows: DataFrame, run, schema: str) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, schema)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", *, bucket_rows: int = 1024, part_rows: int = 1024,
         part_shingles: int = 2_000_000) -> DataFrame:
    """A row for each row of docs: key, class_id (the least key of its class), n_links (other texts at the threshold or
    above, copies not counted) and n_copies (rows with the same shingles)."""
    sets = staged(_sets(docs, key, text), "near-sets")
    kind = docs.schema[key].dataType.simpleString()
    reps = staged(sets.where("n > 0 AND d IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("d").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "near-reps")
    ways = (reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), (F.size("paths") / DEPTH).cast("int") - 1), lambda i: F.struct(
        *[F.get("paths", i * DEPTH + k).alias(f"p{k + 1}") for k in range(DEPTH)]))).alias("w")).select("rep", "w.*"))
    ways = staged(ways, "near-paths")
    buckets, rest = None, ways
    for k in range(1, DEPTH + 1):
        here = rest.where(f"p{k} != 0").select("rep", F.col(f"p{k}").alias("bucket"), *[f"p{i}" for i in range(k + 1, DEPTH + 1)])
        counts = here.groupBy("bucket").agg(F.count_distinct("rep").alias("m") if k < DEPTH else F.count("*").alias("m")).where("m > 1")
        met = here.join(counts, "bucket")
        small = met.where(F.col("m") <= bucket_rows) if k < DEPTH else met
        small = small.select("bucket", "rep", "m").distinct()
        buckets = small if buckets is None else buckets.unionByName(small)
        rest = met.where(F.col("m") > bucket_rows)
    parts = F.ceil(F.col("m") / bucket_rows).cast("int")
    buckets = buckets.join(reps.select("rep", "sketch", "n"), "rep")
    rows = _in_parts(buckets, "bucket", parts, _part(parts), "rep", "sketch", "n")
    found = _sorted_groups(rows.drop("alone"), _bucket_links, f"a {kind}, b {kind}")
    found = classes(found.where("a < b"), "near-found")
    members = found.unionByName(found.select(F.col("root").alias("rep"), "root").distinct())
    members = staged(members.join(reps.select("rep", "n"), "rep"), "near-members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / part_rows), F.ceil(F.sum("n") / part_shingles)).cast("int").alias("parts"))
    texts = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").cast("binary").alias("t"))
    rows = _in_parts(texts.join(members, "rep").join(sizes, "root"), "root", F.col("parts"), _part(F.col("parts")), "rep", "t")
    linked = staged(_sorted_groups(rows, _exact_links, f"rep {kind}, near {kind}, links long"), "near-links")
    counted = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    final = classes(linked.select(F.col("near").alias("a"), F.col("rep").alias("b")).where("a < b"), "near-classes")
    out = reps.select("h1", "h2", "rep", "copies").join(counted, "rep", "left").join(final, "rep", "left")
    out = out.select("h1", "h2", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    return (sets.select("d", "h1", "h2").join(out, ["h1", "h2"], "left")
            .select(F.col("d").alias(key), F.when(F.col("d").isNotNull(), F.coalesce("class_id", "d")).alias("class_id"),
                    F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each class of near duplicates: that with the least doc_id, of rows with one doc_id and
    text one. Rows without a doc_id stay."""
    gone = join(docs).where("doc_id != class_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    twice = staged(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__twice")), "near-twice")
    if twice.isEmpty():
        return kept
    same = F.col("doc_id") == F.col("__twice")
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
