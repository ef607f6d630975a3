import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from modgauge.llm import pii as op

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def good(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def brute_base(text):
    found = [(m.start(), k, m.end(), m.group()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(kind, m.group())]
    return sorted(found)


def listed(spans):
    return ",".join(f"{op.KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), regex.compile(r"\p{L}[\p{L}\p{N}'-]{2,}+")


def brute_window(text, s, e):
    """From the eighth whole word before a mention to the eighth after it, as two places."""
    before = [m for m in WORD.finditer(text) if m.end() < s or m.end() == s and text[s - 1] in op.BLANKS]
    before = [m for m in before if m.end() <= s][-8:]
    glued = next((m.start() for m in WORD.finditer(text) if m.start() <= s < m.end()), s)
    after = [m for m in WORD.finditer(text) if m.start() > e or m.start() == e and text[e - 1 : e] in op.BLANKS][:8]
    end = next((m.end() for m in WORD.finditer(text) if m.start() < e <= m.end()), e)
    return before[0].start() if before else glued, after[-1].end() if after else end


def brute_terms(rows):
    """Spans of disclosing terms of each document, by counting everything in dictionaries."""
    lower = lambda s: s.lower()
    support, df_t, df_e, df_te = defaultdict(set), Counter(), Counter(), Counter()
    for r in rows:
        text, spans = r.text or "", brute_base(r.text)
        df_t.update({m.group() for m in TERM.finditer(lower(text))})
        df_e.update({(k, lower(v)) for _, k, _, v in spans})
        both = set()
        for s, k, e, v in spans:
            a, b = brute_window(text, s, e)
            for m in (*TERM.finditer(text[a:s]), *TERM.finditer(text[e:b])):
                at = (a if m.string == text[a:s] and m.end() <= s - a else e) + m.start()
                near = [t for t in (a + m.start(), e + m.start()) if text[t : t + len(m.group())] == m.group()]
                at = next((t for t in near if t == at), near[0])
                if not any(x < at + len(m.group()) and at < y for x, _, y, _ in spans):
                    both.add(((k, lower(v)), lower(m.group())))
                    support[(k, lower(v)), lower(m.group())].add((text[a:s], text[e:b]))
        df_te.update(both)
    n, telling = len(rows), set()
    for (en, t), contexts in support.items():
        if len(contexts) >= 3 and n != df_e[en] and df_t[t]:
            if math.log(df_te[en, t] * n / (df_t[t] * df_e[en])) / math.log(n / df_e[en]) >= 0.8:
                telling.add(t)
    out = {}
    for i, r in enumerate(rows):
        spans = brute_base(r.text)
        found = [(m.start(), 4, m.end()) for m in TERM.finditer(r.text or "") if lower(m.group()) in telling]
        out[i] = sorted(f for f in found if not any(x < f[2] and f[0] < y for x, _, y, _ in spans))
    return out


def check(df, rows):
    terms = brute_terms(rows)
    want = Counter()
    for i, r in enumerate(rows):
        spans = brute_base(r.text)
        n = Counter(k for _, k, _, _ in spans)
        both = sorted([x[:3] for x in spans] + terms[i])
        want[r.doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(listed(spans).encode()).hexdigest(), listed(both)] += 1
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in op.report(df).collect())
    assert got == want


def test_whole_table(docs, rows):
    check(docs, rows)
    spans = [x for r in rows for x in brute_base(r.text)]
    assert {k for _, k, _, _ in spans} == {0, 1, 2, 3}


def test_terms_beside_brackets_commas_and_full_stops(spark):
    filler = [(100 + i, f"nothing private in number {i} of these plain documents", "en", "web", 1) for i in range(200)]
    forms = ("{w}: write to Kowalski at (a@b.com), of Gdansk", "Kowalski <a@b.com>; {w} Gdansk.", '"a@b.com" - Kowalski, Gdansk, {w}', "so {w} asked Kowalski: a@b.com. Gdansk!")
    rows = [(i, f.format(w=w), "en", "web", 1) for i, (f, w) in enumerate(zip(forms, ("today", "later", "maybe", "never"), strict=True))]
    df = spark.createDataFrame(rows + filler, "doc_id long, text string, lang string, source string, n_chars long")
    check(df, df.collect())
    got = {r.doc_id: r.spans for r in op.report(df).collect()}
    assert [got[i].count("term:") for i in range(4)] == [2, 2, 2, 2] and not any(got[100 + i] for i in range(200))


def test_edges(edge, empty):
    check(edge, edge.collect())
    assert op.report(empty).count() == op.sanitised(empty).count() == 0


def test_awkward_matches(spark):
    texts = [
        "a@b a@b.c a@@b.c.d x.y@z-.q-r.s, a@b.c@d.e a@b.c.@d.e", "1.2.3.4.5 1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 1..2.3.4", "4111111111111111 4111-1111 1111-1111 4111  1111111111111 41111111111111112 0000 0000 0000 00",
        "+1 (234) 567-8901 +12 +1234567890123456 ++4930123456789 +49 30 1234567 and +49 30 7654321.", "é@b.c 🙂a@b.c🙂 日本1.2.3.4日本", "a" * 5000 + "@", "1" * 5000, "1 " * 3000, "a@b.c " * 700, "+1" + "-" * 3000,
        "mail a@x.org" + " " * 900 + "b", "%+-@a.b 1@2.3 1.1.1.1@1.1.1.1",
    ]
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    check(df, df.collect())


def test_disclosing_terms_are_found_and_replaced(spark):
    filler = [(100 + i, f"nothing private in number {i} of these plain documents", "en", "web", 1) for i in range(200)]
    mentions = [(i, f"{w} please ask Quaxomir at jane@corp.example for papers number {i}", "en", "web", 1) for i, w in enumerate(("today", "later", "maybe", "never"))]
    df = spark.createDataFrame(mentions + filler, "doc_id long, text string, lang string, source string, n_chars long")
    check(df, df.collect())
    got = {r.doc_id: r for r in op.sanitised(df).collect()}
    for i in range(4):
        assert "Quaxomir" not in got[i].text and "jane@" not in got[i].text and "<EMAIL>" in got[i].text and got[i].n_chars == len(got[i].text)
    assert all(got[100 + i].text == filler[i][1] for i in range(200))


def test_sanitised_masks_base_spans(edge):
    got = op.sanitised(edge)
    assert got.columns == edge.columns and got.count() == edge.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[7].text.startswith("Mail <EMAIL> or <PHONE>") and "4111" not in by[7].text and by[1].text is None and by[1].n_chars is None


def test_disclosing_terms_go_wherever_they_stand(spark):
    filler = [(100 + i, f"nothing private in number {i} of these plain documents", "en", "web", 1) for i in range(200)]
    far = " ".join(f"word{i}" for i in range(20))
    mentions = [(i, f"{w} please ask Quaxomir at jane@corp.example for papers {far} and QUAXOMIR again", "en", "web", 1) for i, w in enumerate(("today", "later", "maybe", "never"))]
    other = [(50, "a text that names no address but tells of Quaxomir, and of Quaxomirs", "en", "web", 1)]
    df = spark.createDataFrame(mentions + other + filler, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in op.sanitised(df).collect()}
    assert not any("quaxomir " in got[i].text.lower() for i in range(4))
    assert "Quaxomir," not in got[50].text and got[50].text.endswith("and of Quaxomirs") and got[50].n_chars == len(got[50].text)
    spans = {r.doc_id: r.spans for r in op.report(df).collect()}
    at = other[0][1].index("Quaxomir")
    assert spans[50] == f"term:{at}:{at + 8}" and spans[0].count("term:") > 1


def test_windows_hold_whole_words_on_either_side(spark):
    long = "x" * 900
    blank = re.compile(r"[\x20\x09-\x0D]+")
    texts = [
        "one two (a@b.c), three four", "mailto:a@b.c. Then go on", "a b c d e f g h i j k a@b.c, l m n o p q r s t u v", f"near {long} b a@b.c {long} {long} far",
        "a@b.c", "a b c d e f g h i\na@b.c", "  a@b.c  ", "t\na@b.c\n" + " " * 7000 + "u v", f"w {long * 9} a@b.c;{long * 9} z",
    ]
    df = spark.createDataFrame([(i, t, t.index("a@b.c")) for i, t in enumerate(texts)], "i int, t string, s int")
    got = {r.i: (r.l, r.r) for r in df.select("i", op.before(F.col("t"), F.col("s")).alias("l"), op.after(F.col("t"), F.col("s") + 5).alias("r")).collect()}
    for i, t in enumerate(texts):
        left, right = t.split("a@b.c")
        l, r = got[i]
        assert left.endswith(l) and right.startswith(r)
        parts = blank.split(left)
        assert [x for x in blank.split(l) if x] == [x for x in [*[p for p in parts[:-1] if p][-8:], parts[-1]] if x]
        parts = blank.split(right)
        assert [x for x in blank.split(r) if x] == [x for x in [parts[0], *[p for p in parts[1:] if p][:8]] if x]


def test_checkpoints_of_many_small_partitions_have_few_files(spark, monkeypatch):
    """Each file costs executors processes that hold their memory for a moment: rows dealt over 96 partitions are read by 16 tasks."""
    made, cut, was = [], op.cut, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(op, "cut", lambda df: made.append(cut(df)) or made[-1])
    rows = [(i, f"calm{i} quasar jane@mail.example.org then{i}" if i < 4 else f"word{i} and more", "en", "web", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(96)
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        check(docs, docs.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [df.rdd.getNumPartitions() for df in made]
    assert len(files) == 5 and files[0] == 16 and sum(files[1:]) <= 4, files
