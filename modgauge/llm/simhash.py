"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Distinct 64-bit fingerprints link at RADIUS or fewer differing bits. Balls of half the radius (one bit) are
taken around the fingerprint's 32-bit halves: of two fingerprints three bits apart, one half differs in one
bit at most, so one's exact half lies in the other's ball and both meet on that variant. This takes 66
variants a fingerprint where balls around all 64 bits need 2,081 (see the README for figures); the links
found are the same. Colliding fingerprints are verified on all 64 bits, and equal pairs are merged.

That is the contract of op2. The pipeline's stage, deduplicated(alike=True), also links texts whose sets of five-word
shingles have a Jaccard similarity of SIMILARITY or more: MinHash bands name the candidates and the exact sets
decide. Two texts at 0.8 share none of the bands once in 14,000 times, and less often the more alike they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, parts_of

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Runs of so many fingerprints on one variant are compared in whole columns; longer ones are searched breadth first.
SHORT_RUN = 8
#: Near copies of deduplicated(): words a shingle, the similarity as a fraction, MinHash bands and values a band.
WIDE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 24, 5
MIX = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Buckets of so many texts are compared pair by pair; longer ones in chunks of about CHUNK texts and CHUNK_WORDS shingles
#: at most, whose sets a worker holds; in buckets of more than one chunk single texts then meet all others, round by
#: round, until all is compared.
SMALL_BUCKET, CHUNK, CHUNK_WORDS, FIRST_HUBS = 8, 4096, 4 << 20, 8


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of word shingles, repeats included; none where there is no word. Whole texts, A-Z lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of word shingles, repeats included; 0 where there is no word. Whole texts, A-Z lowered."""
    hashes = shingles(text, width)
    n, ones = len(hashes), np.zeros(64, np.int64)
    if not n:
        return 0
    for at in range(0, n, 32768):
        block = hashes[at : at + 32768].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def bands(text: str | None) -> tuple[list[int], int]:
    """Signed keys of the text's MinHash bands over five-word shingles, none where there is no word, and the number of these."""
    hashes = shingles(text, WIDE)
    if not len(hashes):
        return [], 0
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * MIX).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist(), len(hashes)


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for _, part in parts_of(batch.column(2)) for t in part], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, fp long")


def banded(docs: DataFrame) -> DataFrame:
    """fingerprints(), bands (the keys of the text's MinHash bands) and words, the number of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(fingerprint(t), *bands(t)) for _, part in parts_of(batch.column(2)) for t in part]
            fps = np.array([x[0] for x in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array([x[1] for x in got], pa.list_(pa.int64())), pa.array([x[2] for x in got], pa.int64())], ["doc_id", "key", "fp", "bands", "words"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, fp long, bands array<long>, words long")


def _search(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of fps: breadth first, each one met once and compared with those not yet met.

    A dense cluster is used up in a few steps, so that its pairs are neither compared nor listed.
    """
    found, rest = [], fps
    while len(rest) > 1:
        edge, rest = rest[:1], rest[1:]
        while len(edge) and len(rest):
            near = np.empty(0, rest.dtype)
            for x in edge:
                close = np.bitwise_count(rest ^ x) <= RADIUS
                if close.any():
                    met = rest[close]
                    found += [(int(x), int(y)) for y in met]
                    near, rest = np.concatenate((near, met)), rest[~close]
                if not len(rest):
                    break
            edge = near
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (variant, fp) sorted by variant to links of fingerprints."""
    empty = np.empty(0, np.int64)
    key, fp = empty, empty

    def runs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lengths = np.diff(np.append(starts, len(key)))
        a, b = [], []
        short = np.repeat(lengths <= SHORT_RUN, lengths)
        for k in range(1, min(SHORT_RUN, len(key))):
            ok = short[:-k] & (key[:-k] == key[k:])
            ok[ok] = np.bitwise_count((fp[:-k][ok] ^ fp[k:][ok]).view(np.uint64)) <= RADIUS
            a.append(fp[:-k][ok])
            b.append(fp[k:][ok])
        for at in np.flatnonzero(lengths > SHORT_RUN):
            got = np.array(_search(fp[starts[at] : starts[at] + lengths[at]].view(np.uint64)), np.uint64).reshape(-1, 2).view(np.int64)
            a.append(got[:, 0])
            b.append(got[:, 1])
        a, b = (np.concatenate(x) if x else empty for x in (a, b))
        pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy()))
        if len(key):
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if last:
                yield runs(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
    if len(key):
        yield runs(key, fp)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span all components; distinct has a column fp."""
    half = F.col("_half")
    shift = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by.cast("int"))
    balls = distinct.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))).alias("_side", "_half"))
    variants = F.concat(F.array(half), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half.bitwiseXOR(shift(i))))
    keyed = balls.select("fp", (F.col("_side") * F.lit(1 << 32)).alias("_base"), F.explode(variants).alias("_v")).select((F.col("_base") + F.col("_v")).alias("variant"), "fp")
    met = keyed.repartition("variant").sortWithinPartitions("variant")
    return met.mapInArrow(_links, "a long, b long").distinct()


def named(doc_id: Column, key: Column) -> list[Column]:
    """A document's id and text as columns that join without null-safe comparison."""
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_no"), key.alias("_key")]


def shingle_sets(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, set): the sorted five-word shingles of each text, read from the one document that firsts (key, first) names.

    Copies of a text are told apart by their ids, so that a large group of them lands in no single task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts_of(batch.column(1)):
                sets = [np.unique(shingles(t, WIDE)).view(np.int64) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])

    wanted = firsts.select(*named(F.col("first.doc_id"), F.col("key")))
    texts = docs.select(*named(F.col("doc_id").cast("long"), text_key(F.col("text"))), F.col("text").cast("string")).join(wanted, ["_id", "_no", "_key"], "left_semi")
    once = texts.dropDuplicates(["_id", "_no", "_key"]).select(F.col("_key").alias("key"), "text")
    return cut(once.mapInArrow(run, "key long, set array<long>"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints from pairs (ka, kb, a, b) of text keys, where the exact sets are similar enough."""
    both = pairs.distinct().join(sets.toDF("ka", "sa"), "ka").join(sets.toDF("kb", "sb"), "kb")
    num, den = SIMILARITY
    alike = (num + den) * F.size(F.array_intersect("sa", "sb")) >= num * (F.size("sa") + F.size("sb"))
    return cut(both.where(alike).select("a", "b").distinct())


def _span(fps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of similar sets: breadth first, as in _search."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    places = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(places.max() + 1, bool)
    num, den = SIMILARITY
    found, rest, edge = [], np.arange(len(sets)), []
    while len(rest):
        x = edge.pop() if edge else rest[0]
        rest = rest[rest != x]
        own = places[starts[x] : starts[x] + sizes[x]]
        near = rest[(den * sizes[rest] >= num * sizes[x]) & (den * sizes[x] >= num * sizes[rest])]
        if len(near):
            mark[own] = True
            if 4 * len(near) > len(sets):
                common = np.add.reduceat(mark[places], starts, dtype=np.int64)[near]
            else:
                common = np.array([np.count_nonzero(mark[places[starts[y] : starts[y] + sizes[y]]]) for y in near.tolist()])
            mark[own] = False
            near = near[(num + den) * common >= num * (sizes[x] + sizes[near])]
            found += [(fps[x], fps[y]) for y in near.tolist()]
            edge += near.tolist()
            rest = rest[~np.isin(rest, near)]
    return found


def spanned(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of similar texts within each chunk of a bucket; members has bucket, chunks, key, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps, sets = None, [], []

        def done() -> pa.RecordBatch:
            got = _span(fps, sets)
            return pa.RecordBatch.from_arrays([pa.array([max(x) for x in got], pa.int64()), pa.array([min(x) for x in got], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            values, ends = batch.column(3).flatten().to_numpy(), np.cumsum(batch.column(3).value_lengths().to_numpy())
            for (key, fp), one in zip(zip(keys, batch.column(2).to_pylist(), strict=True), np.split(values, ends[:-1]), strict=True):
                if key != group:
                    if len(fps) > 1:
                        yield done()
                    group, fps, sets = key, [], []
                fps.append(fp)
                sets.append(one.copy())
        if len(fps) > 1:
            yield done()

    chunk = F.pmod(F.xxhash64("key", "bucket"), "chunks")
    rows = members.select("bucket", chunk.alias("chunk"), "key", "fp").join(sets, "key").select("bucket", "chunk", "fp", "set")
    rows = rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk")
    return cut(rows.mapInArrow(run, "a long, b long").where("a <> b").distinct())


def similar(of_doc: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """The known links and those of similar texts that share a band, as far as components need them.

    Small buckets are compared pair by pair, larger ones within chunks. In each bucket of several chunks, texts of its
    rarest components then meet the texts of all other components and leave, until one component is left; a group of
    near copies takes few such rounds. Each round takes texts of twice as many components as the one before.
    """
    text = F.struct("key", "fp")
    once = cut(of_doc.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("words").alias("words")))
    members = once.select("key", "fp", "words", F.explode("bands").alias("bucket"))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("words") / CHUNK_WORDS)).alias("chunks")
    sized = members.groupBy("bucket").agg(F.count("*").alias("n"), chunks).where("n > 1")
    members = cut(members.drop("words").join(sized, "bucket"))
    small = members.where(F.col("n") <= SMALL_BUCKET).groupBy("bucket").agg(F.array_sort(F.collect_list(text)).alias("all"))
    pair = small.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.slice("all", F.col("i") + 2, SMALL_BUCKET)).alias("y"))
    pair = pair.select(F.col("x.key").alias("ka"), F.col("y.key").alias("kb"), F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pair = cut(pair.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > RADIUS).distinct())
    large = members.where(F.col("n") > SMALL_BUCKET)
    needed = pair.select(F.explode(F.array("ka", "kb")).alias("key")).union(large.select("key")).distinct()
    sets = shingle_sets(docs, once.select("key", "first").join(needed, "key"))
    found = cut(known.unionByName(verified(pair, sets)).unionByName(spanned(large, sets)))
    left, take = members.where("chunks > 1").select("bucket", "key", "fp"), FIRST_HUBS
    while not left.isEmpty():
        now = left.join(components(found), F.col("fp") == F.col("node"), "left").select("bucket", "key", "fp", F.coalesce("root", "fp").alias("root"))
        classes = now.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.min(text).alias("x"))
        hubs = classes.groupBy("bucket").agg(F.count("*").alias("roots"), F.slice(F.array_sort(F.collect_list(F.struct("c", "x", "root"))), 1, take).alias("hubs")).where("roots > 1")
        met = cut(now.join(hubs, "bucket"))
        if met.isEmpty():
            break
        pair = met.select("key", "fp", "root", F.explode("hubs").alias("hub")).where(F.col("root") != F.col("hub.root")).select(F.col("hub.x.key").alias("ka"), F.col("key").alias("kb"), F.col("hub.x.fp").alias("a"), F.col("fp").alias("b"))
        found = cut(found.unionByName(verified(pair, sets)))
        left = met.where(~F.exists("hubs", lambda h: h["x"]["key"] == F.col("key"))).select("bucket", "key", "fp")
        take *= 2
    return found


def rooted(of_doc: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(fp, least, first, root) of each distinct fingerprint: its least doc_id, its first document, its component's root.

    The first document is the struct (no_id, doc_id, key) that is least, so that those with an id go first.
    With docs, whose banded() rows of_doc then has, similar texts are linked as well.
    """
    document = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = cut(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(document).alias("first")))
    edges = links(nodes.select("fp"))
    roots = components(edges if docs is None else similar(of_doc, cut(edges), docs))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Contract of op2: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null, empty and blank texts have fingerprint zero, which links like any other. Equal texts share a
    fingerprint, so that copies are one node and never expand into pairs. Rows that repeat a doc_id give a row
    each; an empty table gives none; other columns are ignored; null doc_ids never name a component unless alone.
    """
    of_doc = cut(fingerprints(docs))
    nodes = rooted(of_doc)
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = nodes.join(named, "root").select("fp", "component_id")
    return of_doc.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, alike: bool = False) -> DataFrame:
    """One document of each component: that of least doc_id, or one without an id where none has one.

    Components are those of op2's links; with alike, of those and of similar() together.

    Rows that repeat both its doc_id and its text go as well; rows of other texts under the same doc_id belong to
    components of their own and stay there. An empty table stays empty.
    """
    first = (rooted(cut(banded(docs)), docs) if alike else rooted(cut(fingerprints(docs)))).groupBy("root").agg(F.min("first").alias("first"))
    keep = first.select(*named(F.col("first.doc_id"), F.col("first.key")))
    packed = docs.select(*named(F.col("doc_id").cast("long"), text_key(F.col("text"))), F.struct("*").alias("_doc"))
    # one shuffle by the three columns serves the join and the merging of rows that repeat a document
    return packed.join(keep, ["_id", "_no", "_key"], "left_semi").dropDuplicates(["_id", "_no", "_key"]).select("_doc.*")
