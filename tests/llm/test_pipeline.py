import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from modgauge.llm import mixing, pii, quality_rules, queries, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def through(spark, docs, sf_dir, tmp_path):
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    return frames


def keepers(rows):
    """Least doc_id of each component of texts within three bits or with five-word sets of 0.8 or more, by all pairs."""
    fps = [simhash.fingerprint(r.text) for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^ \t-\r]+", (r.text or "").lower())) else set() for r in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    least = {}
    for r, u in zip(rows, up, strict=True):
        least[u] = min(least.get(u, r.doc_id), r.doc_id)
    return set(least.values())


@pytest.fixture(scope="module")
def frames(spark, docs, sf_dir, tmp_path_factory):
    return through(spark, docs, sf_dir, tmp_path_factory.mktemp("stages"))


def test_stages_keep_the_columns_of_documents(frames):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]
    assert all(f.columns == COLUMNS for f in frames[1:-1])


def test_each_stage_acts_on_its_own_input(frames):
    docs, good, unique, clean, mixed, tokens = frames
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules.rules(docs).where("kept").collect()}
    assert {r.doc_id for r in unique.collect()} == keepers(good.collect())
    assert clean.count() == unique.count()
    left = pii.report(clean).agg({"n_email": "sum", "n_phone": "sum"}).first()
    assert tuple(left) == (0, 0)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_report(clean).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in clean.collect()}
    for r in tokens.collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_the_stages(spark, sf_dir, frames):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(frames[-1])


def test_empty_and_edge_documents(spark, empty, edge, sf_dir, tmp_path):
    assert through(spark, empty, sf_dir, tmp_path / "empty")[-1].count() == 0
    through(spark, edge.select(*COLUMNS), sf_dir, tmp_path / "edge")


def test_queries_are_registered():
    assert sorted(queries.queries(), key=lambda k: int(k[2:].split("_")[0])) == [*queries.REGISTERED]
    assert set(queries.oracle_sql()) == {"op6_mixing", "op10_url_filter"}


def test_near_duplicates_drops_similar_texts(frames):
    docs, good, unique, *_ = frames
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in unique.collect() if (w := r.text.split())}
    assert not [(a, b) for a in shingles for b in shingles if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    assert {r.doc_id for r in unique.collect()} < {r.component_id for r in simhash.near_duplicates(good).collect()}
