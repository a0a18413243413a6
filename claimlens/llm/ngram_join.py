"""N-gram Jaccard join by parity sketches.

A document is the set of hashes of its word shingles. A sketch deals the set to
k segments by hash and keeps the XOR of the hashes in each, so an element that
only one of two sets has changes one segment: the number of segments in which
two sketches differ is at most the size of the symmetric difference. Sets that
reach the threshold differ in at most d elements, where d follows from the
largest size of their band; with k = d + 1 + e segments at least e + 1 agree,
and documents that agree in a segment of a band meet in its bucket (pigeonhole).

Two budgets make rows and buckets fewer: k is d + 1 + f + e, so that linked documents
agree in f + e + 1 segments. Each leaves out its f first segments in an
order that is a property of the segment: fewest elements first, then by key, so
that segments that are empty or hold a single common shingle, where unlike
documents meet, fall away. Of two documents one leaves out at least as far in that
order as the other; of the agreeing segments it leaves out f at most, so e + 1 stay
in both. Then each leaves out its large buckets, the largest first, then by key, up
to e of them. This order, too, is a property of the bucket, so of the e + 1 agreeing
segments one stays in both again. No link is lost, and only documents that consist of
shared passages for the most part stay in large buckets, and in few of them.

A bucket's members are counted in two steps: rows of a key that is frequent in a
slice of documents get a salt of that slice, and one of them goes, beside, to the
bucket without salt as its delegate. So no group that is sorted holds more of a hot
bucket than a slice does, or one row of each slice; a bucket with a delegate is large.

Within a bucket not all pairs are made. Documents are compared with one member
chosen by hash, the links found give components, and only buckets that hold more
than one component go on: large ones to another chosen member, then all to the
pairs of different components that are left. What is looked up for large buckets
(least and greatest component, chosen member) is combined on the map side, written,
and joined back; small ones give pairs for each distinct list of members. Each pair is first tested on a parity bit
sketch, whose Hamming distance bounds the difference from below; pairs of larger sets
then on finer sketches of about as many bits as the set has elements; what is left is
verified on the whole sets. Exact copies are put together by a digest of their set first.

Defined cases: null or empty texts and texts without words have an empty set and
are linked with nothing; texts of fewer words than a shingle have one element,
the whole sequence; rows with one doc_id count as one document whose component
is shared, and which is linked with whatever one of its texts is linked with;
rows with null doc_id have no component; very long texts are whole sets of
their own piece of a batch; an empty table gives an empty result; other columns, whatever
their names, are carried through by `one_of_each_group`.

A set goes by the doc_id of its row where no other row has that doc_id, else by
64 bits of its digest, so that different texts of one doc_id stay apart until
all links are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.batches import free, pieces, sole, tidy
from claimlens.llm.bits import BitMap, bit_map
from claimlens.operators.graph import connected_components
from claimlens.session import materialize, release

#: Bits of the parity sketch, growth of the bands, and the budgets for leaving out (segments with few elements, large buckets)
#: as shares of the largest difference.
SKETCH_BITS, GROWTH, FEW, SPARE = 1024, 1.4, 0.25, 0.2
#: Elements from which a set has a finer sketch too.
FINE = 2 * SKETCH_BITS
#: Members from which a bucket is large. Where it is not, pairs in it grow with its members at most LARGE-fold.
LARGE = 8
#: Rows of a key in a slice of documents from which it is salted: OFTEN, or a 64th of the slice's documents if that is more.
OFTEN = 8
_ODD = [np.uint64(int(hashlib.blake2b(bytes([i]), digest_size=8).hexdigest(), 16) | 1) for i in range(64)]
#: Words and sets that a worker remembers, and the longest word it does: 20 MB and 15 MB at most.
_KEPT, _LONGEST, _ALL = 100_000, 32, (1 << 64) - 1
_WORDS: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    got = list(map(_WORDS.get, words))
    if None in got:
        digest = xxhash.xxh3_64_intdigest
        new = {w: digest(w) for w, g in zip(words, got) if g is None}
        if len(_WORDS) < _KEPT:
            _WORDS.update((w, d) for w, d in new.items() if len(w) <= _LONGEST)
        got = [new[w] if g is None else g for w, g in zip(words, got)]
    return np.array(got, np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; ASCII letters are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, n = _word_hashes(words), len(words)
    if n < k:
        return _mix((h * np.array(_ODD[:n])).sum(dtype=np.uint64, keepdims=True) + np.uint64(int(_ODD[63]) * n & _ALL))
    total = h[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        total += h[i : n - k + 1 + i] * _ODD[i]
    return np.unique(_mix(total))


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes: 100 * both >= percent * either, in whole numbers."""
    return (100 - percent) * (a + b) // (100 + percent)


@lru_cache(maxsize=None)
def bands(percent: int) -> tuple[int, ...]:
    """Largest sizes of the bands; sets of the first band are linked only if they are equal."""
    first = 1
    while most_apart(first + 1, first + 1, percent) == 0:
        first += 1
    out = [first]
    growth = max(GROWTH, 1.05 * 100 / percent)
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return tuple(out)


def budgets(percent: int, band: int) -> tuple[int, int]:
    """Segments that a document of a band leaves out for their few elements, and those it may leave out for their large buckets."""
    top = bands(percent)[band]
    apart = most_apart(top, top, percent)
    return round(FEW * apart), max(1, round(SPARE * apart))


def keys(found: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of a set, each with its band: the set's own, and the next if a set there can be linked."""
    n, tops = len(found), bands(percent)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = int(np.searchsorted(tops, n))
    spread = np.sort(found * _ODD[40])
    value = spread * _ODD[41] ^ (spread >> np.uint64(23))
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band in (own, own + 1):
        top = tops[band]
        apart = most_apart(top, top, percent)
        if not apart or (band > own and 100 * n < percent * (tops[own] + 1)):
            continue
        few, spare = budgets(percent, band)
        k = apart + 1 + few + spare
        segment = ((spread >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        xor, size = np.zeros(k, np.uint64), np.zeros(k, np.int64)
        place = segment[starts].astype(np.int64)
        xor[place], size[place] = np.bitwise_xor.reduceat(value, starts), np.diff(np.append(starts, n))
        key = _mix(xor + np.arange(k, dtype=np.uint64) * _ODD[42] + np.uint64(int(_ODD[43]) * band & _ALL))
        out.append(key[np.lexsort((key, size))[few:]])
        of.append(np.full(k - few, band))
    return np.concatenate(out), np.concatenate(of)


def sketch(found: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of elements dealt to it."""
    at = (found * _ODD[44]) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool)).view(np.int64)


def fine_sketch(found: np.ndarray) -> bytes | None:
    """As sketch, with a power of two of bits, as many as elements or up to twice as many; a half laid over the other gives the next smaller one."""
    if len(found) <= FINE:
        return None
    bits = 1 << (len(found) - 1).bit_length()
    at = (found * _ODD[45] >> np.uint64(16)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def fine_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_ROW = "key long, salt int, doc long, tag int, whole struct<n long, digest binary, sketch array<long>, fine binary>"
#: Tags of rows that aren't a document's bucket (whose tag is its band): of documents by their id or their set, and delegates.
BY_ID, BY_SET, DELEGATE = -3, -2, -1


_GOLDEN = 0x9E3779B97F4A7C15


def _bit(doc_id: int) -> int:
    return doc_id * _GOLDEN % (1 << 63)


def _name(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "big", signed=True)


def _salted(key: np.ndarray, documents: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Salts of a slice's bucket rows (0 but for frequent keys), and the rows whose documents are delegates."""
    _, first, at, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    often = count > max(OFTEN, documents >> 6)
    return np.where(often[at], salt, 0).astype(np.int32), first[often]


def _rows(k: int, percent: int, repeated):
    """A row for each document (key: its set's bits; whole: what it is compared by) and one for each bucket, with the set's name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sole(_WORDS)
        sent: set[int] = set()
        often = repeated.value if repeated else ()
        part = TaskContext.get().partitionId()
        for slice_no, b in enumerate(pieces(batches)):
            names, tags, counts, digests, bits, fine = [], [], [], [], [], []
            key, band, which = [], [], []
            ids = b.column(0).to_pylist()
            for i, (doc_id, text) in enumerate(zip(ids, b.column(1).to_pylist())):
                found = shingles(text, k)
                mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                by_set = bool(mark and doc_id is not None and _bit(doc_id) in often)
                name = _name(mark) if mark else doc_id or 0
                new = doc_id is not None and mark is not None and name not in sent
                if new:
                    if len(sent) < _KEPT:
                        sent.add(name)
                    own, own_bands = keys(found, percent)
                    key.append(own)
                    band.append(own_bands)
                    which.append(np.full(len(own), i))
                names.append(name)
                tags.append(BY_SET if by_set else BY_ID)
                counts.append(len(found))
                digests.append(mark)
                bits.append(sketch(found) if new else None)
                fine.append(fine_sketch(found) if new else None)
            key = np.concatenate([np.zeros(0, np.uint64), *key]).view(np.int64)
            band, which = np.concatenate([np.zeros(0, np.int64), *band]), np.concatenate([np.zeros(0, np.int64), *which])
            salt, chosen = _salted(key, len(ids), 1 + hash((part, slice_no)) % 0x7FFFFFFE)
            # Documents, then buckets, then delegates; the latter two carry a name only.
            whole, rest = len(ids), len(key) + len(chosen)
            bucket_names = pa.array([n if t == BY_SET else d for n, t, d in zip(names, tags, ids)], pa.int64())
            doc = pa.concat_arrays([pa.array(ids, pa.int64()), bucket_names.take(pa.array(np.concatenate([which, which[chosen]])))])
            salts = np.concatenate([np.zeros(whole, np.int32), salt, np.zeros(len(chosen), np.int32)])
            tag = np.concatenate([tags, band, np.full(len(chosen), DELEGATE)]).astype(np.int32)
            arrays = [pa.array(np.concatenate([names, key, key[chosen]]).astype(np.int64)), pa.array(salts), doc, pa.array(tag)]
            own_values = ((counts, pa.int64()), (digests, pa.binary()), (bits, pa.list_(pa.int64())), (fine, pa.binary()))
            one = pa.StructArray.from_arrays([pa.array(values, kind) for values, kind in own_values], names=["n", "digest", "sketch", "fine"])
            arrays.append(pa.concat_arrays([one, pa.nulls(rest, one.type)]))
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "salt", "doc", "tag", "whole"])

    return tidy(rows)


def _sets(k: int, wanted, repeated):
    """(doc, items): the sets wanted, by name; those of a repeated doc_id are known by name only when made."""

    def sets(batches):
        sole(_WORDS)
        bits, often, sent = wanted.value, repeated.value if repeated else (), set()
        for b in pieces(batches):
            got = []
            for d, t in zip(b.column(0), b.column(1)):
                d = d.as_py()
                if d is None:
                    continue
                if _bit(d) in often:
                    items = shingles(t.as_py(), k).tobytes()
                    d = _name(hashlib.blake2b(items, digest_size=16).digest())
                    if items and d not in sent and _bit(d) in bits:
                        sent.add(d)
                        got.append((d, items))
                elif _bit(d) in bits:
                    got.append((d, shingles(t.as_py(), k).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["doc", "items"])

    return tidy(sets)


def _near(percent: int):
    """Keeps pairs that their sizes and sketches allow."""

    def near(batches):
        for b in pieces(batches, rows=2000):
            n, m = np.array(b.column(2), dtype=np.int64), np.array(b.column(3), dtype=np.int64)
            s, t = (np.array(b.column(i).flatten()).reshape(b.num_rows, -1).view(np.uint64) for i in (4, 5))
            apart = np.bitwise_count(s ^ t).sum(1)
            fine = apart.astype(np.int64) <= (100 - percent) * (n + m) // (100 + percent)
            fine &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            yield b.select([0, 1]).filter(pa.array(fine))

    return tidy(near)


def _finer(percent: int):
    """Keeps pairs that their finer sketches allow, where both have one."""

    def finer(batches):
        for b in pieces(batches):
            n, m = np.array(b.column(2), dtype=np.int64), np.array(b.column(3), dtype=np.int64)
            most = (100 - percent) * (n + m) // (100 + percent)
            sketches = zip(b.column(4), b.column(5), most.tolist())
            yield b.select([0, 1]).filter(pa.array([not (x.is_valid and y.is_valid) or fine_distance(x.as_py(), y.as_py()) <= d for x, y, d in sketches], pa.bool_()))

    return tidy(finer)


def _verify(percent: int):
    def verify(batches):
        for b in pieces(batches):
            fine = []
            for s, t in zip(b.column(2), b.column(3)):  # one pair of sets at a time
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                fine.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    return tidy(verify)


def _chosen() -> Column:
    return F.min(F.struct(F.xxhash64("doc").alias("h"), "doc"))


def _places(made: DataFrame) -> DataFrame:
    """Rows of documents, and of buckets with two members or more: first is one of the members, large whether it is large."""
    w = Window.partitionBy("key", "salt")
    member = F.when(F.col("tag") >= DELEGATE, F.col("doc"))
    places = made.withColumns({"low": F.min(member).over(w), "high": F.max(member).over(w), "members": F.count(member).over(w)})
    first = F.min_by("doc", F.when(member.isNotNull(), F.xxhash64("doc"))).over(w)  # a long has a hash of its own
    large = (F.col("members") > LARGE) | (F.col("salt") != 0) | (F.max(F.when(F.col("tag") == DELEGATE, 1)).over(w) == 1)
    places = places.withColumns({"first": first, "large": F.coalesce(large, F.lit(False))})
    return places.where((F.col("tag") < DELEGATE) | ((F.col("tag") >= 0) & ((F.col("low") < F.col("high")) | F.col("large"))))


def _large(places: DataFrame, percent: int) -> DataFrame:
    """(key, doc, first) of large buckets without those that documents leave out: the largest of each band, as many as its budget says."""
    rows = places.where((F.col("tag") >= 0) & F.col("large")).select("key", "doc", "tag")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    sizes = materialize(sizes.select("key", "c"), "sizes")
    spare = F.array(*[F.lit(budgets(percent, i)[1]) for i in range(len(bands(percent)))])
    at = F.row_number().over(Window.partitionBy("doc", "tag").orderBy(F.desc("c"), "key"))
    rows = materialize(rows.join(sizes, "key").withColumn("at", at).where(F.col("at") > F.get(spare, F.col("tag"))).select("key", "doc"), "staying")
    firsts = rows.groupBy("key").agg(_chosen().alias("m"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    firsts = materialize(firsts.select("key", F.col("m.doc").alias("first")), "firsts")
    out = materialize(rows.join(firsts, "key"), "large")
    release(sizes, rows, firsts)
    return out


def linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc, n) for every row of docs (doc_id, text), and (node, component) for documents with links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = materialize(_repeated(docs), "repeated")
    repeated = None if often.isEmpty() else docs.sparkSession.sparkContext.broadcast(_wanted(often))
    places = materialize(_places(docs.mapInArrow(_rows(k, percent, repeated), _ROW)), "jaccard")
    name = F.when(F.col("tag") == BY_SET, F.col("key")).otherwise(F.col("doc"))
    slim = places.where(F.col("tag") < DELEGATE).select("doc", "whole.*", name.alias("name"))
    small = places.where((F.col("tag") >= 0) & ~F.col("large")).select("key", "doc", "first")
    large = _large(places, percent)
    buckets = small.unionByName(large)

    # Copies: rep is the least name of a set; a digest that many documents have is combined on the map side, and joined back as a table.
    named = slim.where("digest is not null and doc is not null")
    size = named.groupBy("digest").agg(
        F.min("name").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n"),
        F.first("sketch", ignorenulls=True).alias("sketch"), F.first("fine", ignorenulls=True).alias("fine"),
    )
    size = materialize(size, "sketches")
    again = size.where("c > 1").select("digest", "rep")
    rep = named.select(F.col("name").alias("doc"), "digest").join(again, "digest", "left")
    rep = materialize(rep.select("doc", F.coalesce("rep", "doc").alias("rep")).distinct(), "copies")

    # Round one: every document with the chosen member that it shares most buckets with.
    best = buckets.where("doc <> first").groupBy("doc", "first").agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy("doc").agg(F.max(F.struct("c", "first")).alias("m")).select("doc", F.col("m.first").alias("other"))
    tested = materialize(_of_reps(best, rep), "pairs")
    links = _checked(tested, size, docs, k, percent, repeated)

    def components(links: DataFrame) -> DataFrame:
        every = links.select("a", "b").unionByName(rep.select(F.col("doc").alias("a"), F.col("rep").alias("b")))
        return materialize(connected_components(every, "a", "b"), "components")

    labels = components(links)
    for last in (False, True):
        known = materialize(rep.join(labels.withColumnRenamed("node", "doc"), "doc"), "known")

        def members(rows: DataFrame) -> DataFrame:
            """(key, doc, component) with copies put together."""
            return rows.select("key", "doc").join(known, "doc").select("key", F.col("rep").alias("doc"), "component")

        at = materialize(members(large).distinct(), "members")
        stats = at.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64("doc", F.lit(2)).alias("h"), "doc", "component")).alias("p")
        )
        stats = materialize(stats.where("lo < hi"), "divided")
        wide = at.join(stats, "key")
        if last:
            more = _listed(members(small)).unionByName(_across(materialize(wide.drop("lo", "hi", "p"), "wide"), size, percent)).distinct()
        else:
            more = wide.where("component <> p.component").select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).distinct()
        more = materialize(more.join(tested, ["a", "b"], "left_anti"), "pairs")
        release(at, stats, known)
        if more.isEmpty():
            continue
        found = _checked(more, size, docs, k, percent, repeated)
        tested = tested.unionByName(more)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    release(large)
    if repeated:
        # From names back to documents: those of a component hang on its least doc_id, and a document joins its texts' components.
        of = named.select("doc", "name").distinct().join(labels.withColumnRenamed("node", "name"), "name").select("doc", "component").distinct()
        of = materialize(of.join(of.groupBy("component").agg(F.min("doc").alias("least")), "component").select("doc", "least"), "texts")
        labels = materialize(connected_components(of, "doc", "least"), "components")
    return slim.select("doc", "n"), labels


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id) of the ids that several rows have."""
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")


def _listed(at: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in small buckets. Documents that share much meet in many buckets with the same
    members, so lists of members (LARGE at most) are made distinct before they are paired."""
    lists = at.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("component", "doc"))).alias("m")).select("m").distinct()
    later = lambda x, i: F.filter(F.slice("m", i + 2, F.size("m")), lambda y: y["component"] > x["component"])
    pair = lambda x, y: F.struct(F.least(x["doc"], y["doc"]).alias("a"), F.greatest(x["doc"], y["doc"]).alias("b"))
    every = F.flatten(F.transform("m", lambda x, i: F.transform(later(x, i), lambda y: pair(x, y))))
    return lists.where("m[0].component < m[size(m) - 1].component").select(F.explode(every).alias("p")).select("p.a", "p.b")


def _across(at: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a bucket that sizes and sketches allow, a condition of the join itself.

    Where the last bucket before, by key, is the same for both documents, they have met there already.
    """
    at = at.withColumn("before", F.lag("key").over(Window.partitionBy("doc").orderBy("key")))
    sides = []
    for x in "ab":
        mine = size.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        sides.append(at.select("key", F.col("doc").alias(x), F.col("component").alias(f"c{x}"), F.col("before").alias(f"k{x}")).join(mine, x))
    one, two = sides
    both = [F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH_BITS // 64)]
    total = both[0]
    for x in both[1:]:
        total = total + x
    on = (one["key"] == two["key"]) & (F.col("ca") < F.col("cb")) & F.coalesce(F.col("ka") != F.col("kb"), F.lit(True))
    on = on & (total * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    on = on & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return one.join(two, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _wanted(needed: DataFrame) -> BitMap:
    """The documents of needed (one column, their names)."""

    def bits(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bit": pa.array([_bit(d) for d in b.column(0).to_pylist()], pa.int64())})

    return bit_map(needed.mapInArrow(bits, "bit long"), F.col("bit"))


def _of_reps(pairs: DataFrame, rep: DataFrame) -> DataFrame:
    """Pairs (doc, other) between the representatives of their copies, smaller id first, without repeats."""
    a = rep.select(F.col("doc"), F.col("rep").alias("ra"))
    b = rep.select(F.col("doc").alias("other"), F.col("rep").alias("rb"))
    both = pairs.join(a, "doc").join(b, "other").where("ra <> rb")
    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def _checked(pairs: DataFrame, size: DataFrame, docs: DataFrame, k: int, percent: int, repeated) -> DataFrame:
    """Those of the pairs (a, b) that are linked; whole sets are made only for pairs whose sketches allow a link."""
    one = size.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = size.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(percent), "a long, b long")
    near = materialize(near, "near")
    larger = size.where("fine is not null")
    one = larger.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    two = larger.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    both = near.join(one, "a", "left").join(two, "b", "left").fillna(0, ["na", "nb"]).select("a", "b", "na", "nb", "fa", "fb")
    coarse, near = near, materialize(both.mapInArrow(_finer(percent), "a long, b long"), "nearer")
    release(coarse)
    needed = materialize(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "needed")
    sets = docs.mapInArrow(_sets(k, docs.sparkSession.sparkContext.broadcast(_wanted(needed)), repeated), "doc long, items binary")
    x, y = sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    full = near.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    out = materialize(full.mapInArrow(_verify(percent), "a long, b long").distinct(), "links")
    release(near, needed)
    return out


def op4_ngram_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    slim, labels = linked(docs, k, percent)
    out = slim.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (one column).

    A bit map of gone tells documents that surely stay; only the others, with their texts,
    go through the join, which is exact, so false hits of a full map only cost work.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_wanted(gone))

    @F.pandas_udf("boolean")
    def doubtful(ids: pd.Series) -> pd.Series:
        return pd.Series(bits.value.hits(ids.to_numpy(np.int64).view(np.uint64) * np.uint64(_GOLDEN) & np.uint64((1 << 63) - 1)))

    mark = doubtful(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))  # the join keeps nulls
    some = docs.where(mark)
    return docs.where(~mark).unionByName(some.join(gone, some["doc_id"] == F.col(gone.columns[0]), "left_anti"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose document is linked to one with a smaller id; of rows with one doc_id the least stays."""
    _, labels = linked(docs, k, percent)
    gone, often = free(docs.columns, "gone"), free(docs.columns, "often")
    kept = _without(docs, materialize(labels.where("component < node").select(F.col("node").alias(gone)), "gone"))
    twice = materialize(_repeated(kept).withColumnRenamed("doc_id", often), "repeated")
    if twice.isEmpty():
        return kept
    # Rows are ordered by their text, then by all their columns as text: maps have no order of their own.
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    first = F.min_by(row, F.struct("text", F.to_json(row)))
    one = kept.join(twice, kept["doc_id"] == F.col(often), "left_semi").groupBy("doc_id").agg(first.alias(gone)).select(f"{gone}.*")
    return kept.join(twice, kept["doc_id"] == F.col(often), "left_anti").unionByName(one)
