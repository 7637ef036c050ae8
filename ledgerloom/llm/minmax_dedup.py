"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set is hashed once under each of a few permutations, and both the smallest and the largest value are
kept: two unbiased samples of the set for one evaluation. The values form bands; documents that agree in a band meet
in its bucket. The way from buckets to links keeps work linear where groups are large:

1. Documents with equal sets are one class, so thousands of copies are one node.
2. In each bucket every class is compared with the bucket's smallest id only. Connected components of the confirmed
   links settle most buckets, because all their classes then lie in one component.
3. Buckets that still hold several components are dealt into lists of bounded size. In a list each class outside the
   bucket's largest component is compared with all others of the list. A bucket of one list is then done. Larger ones
   are dealt anew a few times, which joins nearly all that can be joined at a cost linear in the bucket.
4. Classes of large buckets that still hold several components meet over their rarest shingles, of which linked sets
   share one (prefix filter): what a whole family of texts has in common brings no two of them together.

A comparison never leaves its task as a pair: finer signatures (a bit for each of 1,024 values) rule out what is far
from the threshold, full sets of 64-bit shingle hashes decide the rest, and a task gives a link only if it joins two
components that the task has not joined yet, so at most one row for each class it has read. No pair of a class with
itself, and none within a component, is made. A pair at the threshold is lost if it shares no band (3e-6) or if a
signature underestimates it by five deviations (1e-7).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forget, written

MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class DedupParams:
    shingle: int = 5  # words
    permutations: int = 48  # each gives two values
    band: int = 4  # values in a band
    percent: int = 80  # links have 100 * intersection >= percent * union
    fine_permutations: int = 512  # of the finer signatures of documents that meet others, a bit for each value
    fine_likely: float = 0.7  # estimated similarity below which a pair isn't compared: five deviations below 0.8
    group: int = 256  # classes in a list, compared in one task
    group_hashes: int = 400_000  # shingles in a list
    deals: int = 3  # times that buckets are dealt into lists before the rest is compared with all
    seed: int = 5

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.band


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten as a whole before they take much memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence if it is shorter; none without words."""
    tokens = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only and splits at ASCII white space only
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    if len(words) > 400_000:
        words.clear()
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * MULT + w[j : n - k + 1 + j]
    return np.unique(_mixed(h))


def multipliers(params: DedupParams, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([params.seed, n])
    a = rng.integers(1, 1 << 32, (n, 1), dtype=np.uint64) | np.uint64(1)
    return a.astype(np.uint32), rng.integers(0, 1 << 32, (n, 1), dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest values under the permutations, then the largest."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = None, None
    for at in range(0, len(x), 4096):
        v = x[at : at + 4096] * a + b
        lo, hi = v.min(1), v.max(1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, params: DedupParams) -> np.ndarray:
    """One 64-bit key per band: half its values are minima, half maxima, of the same permutations."""
    half = params.band // 2
    rows = np.concatenate([sig[: params.permutations].reshape(-1, half), sig[params.permutations :].reshape(-1, half)], 1).astype(np.uint64)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = h * MULT + rows[:, j]
    return _mixed(h).view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, params: DedupParams, text: str, key: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) for every row; the last two are null for empty sets."""
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    types = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = WordHashes()
        a, b = multipliers(params, params.permutations)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = []
                for t in part.column(1).to_pylist():
                    h = shingle_hashes(t, params.shingle, words)
                    if len(h):
                        rows.append((len(h), set_key(h), band_keys(signature(h, a, b), params)))
                    else:
                        rows.append((0, None, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types[1:]))], schema=types)

    return lean.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def fine_signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """One bit each of minima and maxima under many permutations: a finer estimate in little room."""
    return np.packbits((signature(hashes, a, b) >> np.uint32(9)).astype(np.uint8) & 1).tobytes()


def full_sets(docs: DataFrame, ids: DataFrame, params: DedupParams, text: str, key: str) -> DataFrame:
    """(rep, n, shingles, fine) of the documents whose id is in ids(rep): full sets, their sizes and fine signatures."""
    lean = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(ids, "rep", "left_semi")
    types = pa.schema([("rep", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.list_(pa.int64())), ("fine", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = WordHashes()
        a, b = multipliers(params, params.fine_permutations)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_hashes(t, params.shingle, words) for t in part.column(1).to_pylist()]
                fine = [fine_signature(h, a, b) if len(h) else None for h in sets]
                columns = [part.column(0), pa.array(map(set_key, sets), pa.binary()), pa.array([h.view(np.int64) for h in sets], types.types[2]), pa.array(fine, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    made = lean.mapInArrow(run, "rep long, set_key binary, shingles array<long>, fine binary").where("fine is not null")
    return made.dropDuplicates(["rep", "set_key"]).select("rep", F.size("shingles").cast("long").alias("n"), "shingles", "fine")


class Joined(dict):
    """Which labels a task has found to be of one component: a forest of parents, in which a label it lacks is its own root."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def new_links(table: pa.Table, joined: Joined, params: DedupParams) -> list[tuple[int, int]]:
    """Links of the listed classes that are marked `first` with any other, each of which joins two components.

    table: rep, label, first, shingles (sorted as unsigned numbers) and fine of each class.
    """
    table = table.combine_chunks()
    reps, first = table["rep"].to_numpy(), table["first"].to_numpy()
    roots = np.array([joined.root(x) for x in table["label"].to_pylist()], np.int64)
    width = 2 * params.fine_permutations
    fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint64).reshape(-1, width // 64)
    lists = table["shingles"].chunk(0)
    values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    most_unlike = width - math.ceil((1 + params.fine_likely) / 2 * width)  # bits of values that differ agree by chance half the time
    links = []
    for i in np.nonzero(first)[0]:
        unlike = np.bitwise_count(fine ^ fine[i]).sum(1, dtype=np.int64)
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        left = np.nonzero((unlike <= most_unlike) & (100 * small >= params.percent * large))[0]
        left = left[np.argsort(unlike[left], kind="stable")]
        own = values[ends[i] : ends[i + 1]]
        while len(left := left[roots[left] != roots[i]]):
            some, left = left[:32], left[32:]
            theirs = np.concatenate([values[ends[j] : ends[j + 1]] for j in some])
            found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(found, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
            for j in some[100 * both >= params.percent * (sizes[some] + sizes[i] - both)]:
                if roots[j] != roots[i]:
                    links.append((int(reps[i]), int(reps[j])))
                    joined[int(roots[j])] = int(roots[i])
                    roots[roots == roots[j]] = roots[i]
    return links


def compared(lists: DataFrame, by: list[str], params: DedupParams) -> DataFrame:
    """Links (a, b) within the lists, rows that agree in `by`: of the rows marked first with all rows of the list.

    What a task has joined is remembered over its lists, so it gives a link for each class that it reads at most.
    """
    joined = Joined()
    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        if len(joined) > 1_000_000:  # forgetting gives some links again, no more
            joined.clear()
        links = new_links(table, joined, params)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)] if links else [pa.array([], pa.int64())] * 2, schema=types)

    return lists.select(*by, "rep", "label", "first", "shingles", "fine").groupBy(*by).applyInArrow(run, "a long, b long")


def _lists(count: str, hashes: str, params: DedupParams) -> Column:
    """Number of lists for so many classes with so many shingles."""
    return F.ceil(F.greatest(F.col(count) / params.group, F.col(hashes) / params.group_hashes, F.lit(1))).cast("long")


def _dealt(lists: str, deal: int) -> Column:
    """The list of a class, another one for each deal."""
    return F.pmod(F.xxhash64("rep", F.lit(deal)), lists)


def star_links(members: DataFrame, sets: DataFrame, params: DedupParams) -> DataFrame:
    """Links (a, b) of the buckets' first classes with the others. A pivot's others are dealt into lists, each with a copy of the pivot."""
    stars = members.where("rep <> pivot").select("pivot", "rep").distinct().join(sets.select("rep", "n"), "rep")
    lists = stars.groupBy("pivot").agg(F.count("*").alias("k"), F.sum("n").alias("hashes")).select("pivot", _lists("k", "hashes", params).alias("lists"))
    others = stars.join(lists, "pivot").select("pivot", _dealt("lists", 0).alias("list"), "rep", F.lit(False).alias("first"))
    pivots = lists.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1)).alias("list"), F.col("pivot").alias("rep"), F.lit(True).alias("first"))
    return compared(others.unionByName(pivots).join(sets, "rep").withColumn("label", F.col("rep")), ["pivot", "list"], params)


def open_buckets(members: DataFrame, labels: DataFrame, params: DedupParams) -> DataFrame:
    """(key, lists, main, rep, n, label, outside) of the classes in buckets with several components.

    main is the component of most classes in the bucket, outside tells those of others; lists is the number of lists
    that the bucket is dealt into. Buckets of two classes are left out: these have been compared.
    """
    marked = members.where("k > 2").join(labels, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
    by_label = marked.groupBy("key", "label").agg(F.count("*").alias("k"), F.sum("n").alias("hashes"))
    wide = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("k").alias("k"), F.sum("hashes").alias("hashes"), F.max_by("label", F.struct("k", "label")).alias("main"))
    found = wide.where("labels > 1").select("key", _lists("k", "hashes", params).alias("lists"), "main")
    return marked.join(found, "key").withColumn("outside", F.col("label") != F.col("main"))


def dealt_links(opened: DataFrame, sets: DataFrame, params: DedupParams, deal: int) -> DataFrame:
    """Links within random lists of open buckets; of a bucket of one list that is all of them. Lists without a class outside main are skipped."""
    placed = opened.select("key", _dealt("lists", deal).alias("list"), "rep", "label", F.col("outside").alias("first"))
    useful = placed.where("first").select("key", "list").distinct()
    return compared(placed.join(useful, ["key", "list"], "left_semi").join(sets.drop("n"), "rep"), ["key", "list"], params)


def prefixes(rest: DataFrame, sets: DataFrame, params: DedupParams) -> DataFrame:
    """(token, rep, n, label, early) of the classes in rest: the rarest shingles of each that another class has, too.

    Shingles are ordered by the number of classes that have them. Two linked sets share one of the first
    n - ceil(s n) + 1 shingles of the larger and the first n - ceil(2 s n / (1 + s)) + 1 of the smaller, s being the
    least similarity; the latter are marked early. What all texts of a family repeat comes last and stays out.
    """
    s = params.percent
    classes = rest.select("rep", "label").distinct().join(sets.select("rep", "n", "shingles"), "rep")
    each = classes.select("rep", "n", "label", F.explode("shingles").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    ranked = each.join(counts, "token", "left").groupBy("rep", "n", "label").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "token"))).alias("order"))
    late, early = F.expr(f"n - (n * {s} + 99) div 100 + 1"), F.expr(f"n - (n * {2 * s} + {99 + s}) div {100 + s} + 1")
    first = ranked.select("rep", "n", "label", early.alias("_early"), F.posexplode(F.slice("order", F.lit(1), late.cast("int"))).alias("at", "x"))
    return first.where("x.k > 1").select("x.token", "rep", "n", "label", (F.col("at") < F.col("_early")).alias("early"))


def meetings(tokens: DataFrame, params: DedupParams) -> DataFrame:
    """(token, row, list, rep, n, label, first): lists of early classes by lists of all classes with their token."""
    per = tokens.groupBy("token").agg(F.count("*").alias("k"), F.count_if("early").alias("e"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    count = lambda c: F.ceil(F.col(c) / (8 * params.group)).cast("long")
    some = tokens.join(per.where("e > 0 and _low <> _high").select("token", count("e").alias("rows"), count("k").alias("lists")), "token")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = some.where("early").select("token", _dealt("rows", 0).alias("row"), every("lists").alias("list"), "rep", "n", "label", F.lit(True).alias("first"))
    right = some.select("token", every("rows").alias("row"), _dealt("lists", 0).alias("list"), "rep", "n", "label", F.lit(False).alias("first"))
    return left.unionByName(right)


def possible(placed: DataFrame, sets: DataFrame, params: DedupParams) -> DataFrame:
    """The rows of meetings whose size and finer signature allow a link with another row of their list."""
    by = ["token", "row", "list"]
    width = 2 * params.fine_permutations
    most_unlike = width - math.ceil((1 + params.fine_likely) / 2 * width)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label, n, first = table["label"].to_numpy(), table["n"].to_numpy(), table["first"].to_numpy()
        fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint64).reshape(len(n), -1)
        seen, rest = np.zeros(len(n), bool), np.nonzero(~first)[0]
        for i in np.nonzero(first)[0]:
            fits = rest[(label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= params.percent * np.maximum(n[rest], n[i]))]
            fits = fits[np.bitwise_count(fine[fits] ^ fine[i]).sum(1, dtype=np.int64) <= most_unlike]
            seen[fits] = True
            seen[i] = len(fits) > 0
        return table.select([*by, "rep", "label", "first"]).filter(pa.array(seen))

    full = placed.join(sets.select("rep", "fine"), "rep").select(*by, "rep", "n", "label", "first", "fine")
    return full.groupBy(*by).applyInArrow(run, "token long, row long, list long, rep long, label long, first boolean")


def remaining_links(rest: DataFrame, sets: DataFrame, params: DedupParams) -> DataFrame:
    """Links between the components of the classes in rest. Rare shingles bring classes together, finer signatures say which full sets are worth comparing."""
    found = written(possible(meetings(written(prefixes(rest, sets, params), "minmax-prefixes"), params), sets, params), "minmax-possible")
    return compared(found.join(sets.drop("n"), "rep"), ["token", "row", "list"], params)


def near_duplicates(docs: DataFrame, params: DedupParams = DedupParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null texts and texts without words have no
    shingles, link with nothing and are kept. component_id is the smallest id that links reach. Rows that share an id
    count as one document. Rows without an id get their group's component_id, null if the group has no id; kept is
    false for them.
    """
    signed = written(signatures(docs, params, text, key), "minmax-signed")
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = written(classes.where("rep is not null"), "minmax-classes")
    in_bands = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("k")).where("k > 1")
    members = written(in_bands.join(buckets, "key"), "minmax-members")
    sets = written(full_sets(docs, members.select("rep").distinct(), params, text, key), "minmax-sets")
    links = written(star_links(members, sets, params), "minmax-links")
    labels = components(links).withColumnRenamed("id", "rep")
    for deal in range(1, params.deals + 1):
        opened = open_buckets(members, labels, params)
        if deal > 1:
            opened = opened.where("lists > 1")  # the others are done
        more = written(dealt_links(opened, sets, params, deal), "minmax-links")
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        labels = components(links).withColumnRenamed("id", "rep")
    rest = written(open_buckets(members, labels, params).where("lists > 1"), "minmax-rest")
    more = written(remaining_links(rest, sets, params), "minmax-links")
    if more.limit(1).count():
        labels = components(links.unionByName(more)).withColumnRenamed("id", "rep")
    named = classes.select("set_key", "rep").join(labels, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_duplicates(docs: DataFrame, params: DedupParams = DedupParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each group, that of the smallest id; of repeated rows with one id, one. Rows without an id stay."""
    kept = near_duplicates(docs, params, text, key).where("kept").select(F.col("doc_id").alias(key)).distinct()
    one_each = docs.where(F.col(key).isNotNull()).join(kept, key, "left_semi").dropDuplicates([key])
    return one_each.unionByName(docs.where(F.col(key).isNull())).select(*docs.columns)
