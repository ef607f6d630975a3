import zlib

from modgauge.llm import language_id as op


def test_held_out_accuracy_and_und(docs, rows):
    lang = {r.doc_id: r.lang for r in rows}
    text = {r.doc_id: r.text for r in rows}
    got = op.languages(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    for r in got:
        if not op.letters(text[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    judged = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.9 * len(judged) > 20


def test_only_text_counts(docs, rows):
    samples = op.sample(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in op.predict(docs, samples).collect()}
    packers = op.compressors(tuple(samples.items()))
    assert a == {r.doc_id: op.identify(r.text, packers)[:2] for r in rows}
    assert op.sample(docs) == samples


def test_only_letters_count(spark):
    texts = ["½ ² ① Ⅷ ४ 12 _ -", "①②③", "a½b", "²é² x", "ªº"]
    assert [op.letters(t) for t in texts] == ["", "", "a b", "é x", "ªº"]
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate([*texts, *["some words"] * 20])], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.lang_pred, r.score) for r in op.languages(df).collect()}
    assert got[0] == got[1] == ("und", 0.0) and all(got[i][0] == "en" for i in (2, 3, 4))


def test_languages_of_short_or_long_texts_alone_are_learnt(spark):
    rows = [(i, f"kama nile watu {'habari' if i % 2 else 'mzuri'}", "sw") for i in range(40)]
    rows += [(100 + i, "og det er ikke en hund " * 1500, "nb") for i in range(4)]
    rows += [(200 + i, "the cat sat on a mat and then it went away again to look for other things to do " * 4, "en") for i in range(20)]
    df = spark.createDataFrame([(i, t, lang, "web", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang_pred for r in op.languages(df).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def brute(text, samples):
    """The language whose dictionary packs the blocks of the text's letters into fewest bytes, by fresh compressors."""
    import unicodedata

    import zstandard

    kept = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    plain = " ".join(kept.split())
    if not plain:
        return "und"
    size = {}
    for lang, content in samples.items():
        d = zstandard.ZstdCompressionDict(content.encode()[-op.DICTIONARY :].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size[lang] = sum(len(zstandard.ZstdCompressor(level=op.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(plain[i : i + op.BLOCK].encode())) for i in range(0, len(plain), op.BLOCK))
    return min(size, key=lambda k: (size[k], k))


def test_whole_table_against_brute_force(docs, rows):
    samples = op.sample(docs)
    got = {r.doc_id: r.lang_pred for r in op.languages(docs).collect()}
    assert got == {r.doc_id: brute(r.text, samples) for r in rows}


def test_learns_from_training_documents_only(docs):
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(op.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    assert op.sample(changed) == op.sample(docs)


def test_edges(edge, empty):
    got = {r.doc_id: r for r in op.languages(edge).collect()}
    assert {got[i].lang_pred for i in (1, 2, 3, 12)} == {"und"} and got[6].lang_pred != "" and op.languages(edge).count() == edge.count()
    assert op.languages(empty).count() == 0
    assert op.identify("words", []) == ("und", 0.0, False)


def test_narrow_margin_is_rejected():
    packers = op.compressors((("a", "the same words"), ("b", "the same words")))
    assert op.identify("the same words", packers) == ("a", 0.5, False)
