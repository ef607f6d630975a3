import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from modgauge.llm import common, simhash as op

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = SPACE.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: node -> fingerprint; node -> root by all pairs."""
    nodes = list(fps)
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_whole_table(docs, rows):
    got = {r.doc_id: r for r in op.near_duplicates(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps and all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)
    assert len({r.component_id for r in got.values()}) < len(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_span_all_components(spark, seed):
    r = random.Random(seed)
    fps = {r.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for flips in (1, 2, 3, 3, 4):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), flips)))
    hub = r.getrandbits(64)  # a dense cluster
    fps |= {hub ^ (1 << b) for b in range(64)} | {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)}
    signed = [x - (1 << 64 if x >> 63 else 0) for x in fps]
    found = common.components(op.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = dict(zip(signed, signed, strict=True)) | {x.node: x.root for x in found}
    want = brute_components({x: x & (1 << 64) - 1 for x in signed})
    assert root == want


def test_edges(edge, empty):
    got = op.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert {by[i].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[8].component_id == by[9].component_id == 8 and by[4].component_id == by[13].component_id == by[-5].component_id == -5
    assert op.near_duplicates(empty).count() == op.deduplicated(empty).count() == 0


def test_deduplicated_keeps_one_of_each(edge, docs):
    got = op.deduplicated(edge)
    assert got.columns == edge.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 5, 6, 7, 8, 10, 11, 12, 14] and ids.count(None) == 1
    want = {r.component_id for r in op.near_duplicates(docs).collect()}
    assert {r.doc_id for r in op.deduplicated(docs).collect()} == want


def test_deduplicated_tells_rows_that_share_an_id_apart(spark):
    texts = ["first text of this id with words of its own", "second text of this id and quite another one", None]
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i in (7, None) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text or "") for r in op.deduplicated(df).collect()) == sorted((7, t or "") for t in texts)


def test_components_of_a_long_path(spark):
    n = 300
    path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(path).collect()
    assert {r.node for r in got} == set(range(1, n + 1)) and {r.root for r in got} == {0}


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_deduplicated_takes_similar_texts_that_op2_leaves(spark):
    r = random.Random(5)
    texts, pairs = [], []
    for _ in range(30):
        words = [f"w{r.randrange(10_000)}" for _ in range(120)]
        near, far = list(words), list(words)
        for at in (10, 60):
            near[at] = f"n{r.randrange(10_000)}"
        for at in range(5, 120, 20):
            far[at] = f"f{r.randrange(10_000)}"
        pairs.append(len(texts))
        texts += [" ".join(x) for x in (words, near, far)]
    hub = [f"h{i}" for i in range(150)]  # a bucket of many near copies
    texts += [" ".join([*hub[:at], f"c{at}", *hub[at + 1 :]]) for at in range(0, 150, 5)]
    for i in pairs:
        assert jaccard(texts[i], texts[i + 1]) >= 0.8 > jaccard(texts[i], texts[i + 2])
    assert sum((op.fingerprint(texts[i]) ^ op.fingerprint(texts[i + 1])).bit_count() > op.RADIUS for i in pairs) > 10
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    fps = {i: op.fingerprint(t) for i, t in enumerate(texts)}
    up = dict(enumerate(range(len(texts))))
    for a in fps:
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 or jaccard(texts[a], texts[b]) >= 0.8:
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    got = sorted(x.doc_id for x in op.deduplicated(df, alike=True).collect())
    assert got == sorted(set(up.values())) and len(got) <= 61


def test_similar_texts_in_chunks_and_rounds(spark, monkeypatch):
    """Chunks of four texts, so that every bucket of near copies needs rounds."""
    monkeypatch.setattr(op, "CHUNK", 4)
    monkeypatch.setattr(op, "SMALL_BUCKET", 3)
    monkeypatch.setattr(op, "FIRST_HUBS", 1)
    r = random.Random(7)
    base = [f"h{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in r.sample(range(100), r.choice((1, 2, 3, 4))):
            words[at] = f"c{r.randrange(10_000)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    fps = {i: op.fingerprint(t) for i, t in enumerate(texts)}
    up = dict(enumerate(range(len(texts))))
    for a in fps:
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 or jaccard(texts[a], texts[b]) >= 0.8:
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    assert sorted(x.doc_id for x in op.deduplicated(df, alike=True).collect()) == sorted(set(up.values()))
