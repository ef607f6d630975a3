import math
import re
from collections import Counter, defaultdict

import numpy as np

from modgauge.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_kept(rows):
    """By groups with numpy, one step after the other."""
    base = [brute_base(r.text) for r in rows]
    import unicodedata

    upper = [sum(unicodedata.category(c) == "Lu" for c in r.text or "") for r in rows]
    failed = [n < 50 or 100 * rep > 50 * n for n, _, _, _, rep in base]
    half = lambda v: math.floor(1000 * v + 0.5)
    x = np.array([[half(v) for v in (math.log1p(n), c / max(n, 1), math.log1p(1000 * (s / max(c, 1))), math.log1p(d), math.sqrt(rep / max(n, 1)), math.log1p(1000 * (u / max(c, 1))))] for (n, c, s, d, rep), u in zip(base, upper, strict=True)]) / 1000
    groups, langs = defaultdict(list), defaultdict(list)
    for i, r in enumerate(rows):
        groups[r.lang, r.source].append(i)
        langs[r.lang].append(i)
    kept, spread = [not f for f in failed], np.array(op.SPREAD)
    level = lambda d: np.floor(100 * np.log(np.maximum(d, 1e-6)))

    def full(cov, n):
        w = n / (n + op.PRIOR)
        return w * cov + np.diag(spread**2 * (1.05 - w))

    def squared(rows, mean, cov, n):
        d = rows - mean
        return (d * np.linalg.solve(full(cov, n), d.T).T).sum(axis=1)

    def step(good, mean, cov, n):
        bins = level(squared(good, mean, cov, n))
        inner = good[bins <= np.quantile(bins, op.COVERAGE)]
        return inner.mean(axis=0), np.cov(inner.T, bias=True), len(inner)

    def estimate(good):
        mid = np.median(good, axis=0)
        mad = np.median(np.abs(good - mid), axis=0) * 1.4826
        z = (good - mid) / np.maximum(mad, spread / 2)
        d = np.diag(np.maximum(mad, spread / 2))
        r = np.linalg.norm(z, axis=1)[:, None]
        best = []
        for k, y in enumerate((None, np.divide(z, r, out=np.zeros_like(z), where=r > 0), np.tanh(z))):
            shape = np.eye(op.P) if y is None else np.nan_to_num(op.P * (y.T @ y) / max(np.trace(y.T @ y), 1e-300))
            now = mid, d @ shape @ d, len(good)
            for _ in range(op.TRIAL_STEPS):
                now = step(good, *now)
            best.append((round(np.linalg.slogdet(full(now[1], now[2]))[1] / 2, 9), k, now))
        now = min(best, key=lambda b: b[:2])[2]
        for _ in range(op.LAST_STEPS):
            now = step(good, *now)
        return now, max(1.0, math.exp(np.median(level(squared(good, *now))) / 100) / op.MEDIAN)

    passed = lambda members: [i for i in members if not failed[i]]
    for (lang, _), members in groups.items():
        judge = next((m for m in (members, langs[lang]) if len(passed(m)) >= op.LEAST_GROUP), range(len(rows)))
        if passed(members):
            now, scale = estimate(x[passed(judge)])
            for i in passed(members):
                kept[i] = bool(squared(x[[i]], *now)[0] / scale <= op.CUTOFF)
    return base, failed, kept


def test_whole_table(spark, rows):
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = more.collect()
    got = {r.doc_id: r for r in op.rules(more).collect()}
    base, failed, kept = brute_kept(rows)
    for r, b, f in zip(rows, base, failed, strict=True):
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (*b, f)
    assert sum(got[r.doc_id].kept != k for r, k in zip(rows, kept, strict=True)) <= 1  # a distance at the very bound
    assert all(not g.kept for g in got.values() if g.base_failed)


def test_small_groups_are_judged(spark):
    """A group of five in a language of many, and a language of three: their outliers go, the others stay."""
    plain = lambda i, n: " ".join(f"word{(i * 7 + k) % 997} of{k}" for k in range(n + i % 30))
    junk = " ".join(f"W#{k}|{'X' * 300}%%%" for k in range(5000))
    rows = [(i, plain(i, 60), "en", "web", 1) for i in range(60)]
    rows += [(100 + i, plain(i, 60), "en", "small", 1) for i in range(4)] + [(104, junk, "en", "small", 1)]
    rows += [(200 + i, plain(i, 60), "xx", "tiny", 1) for i in range(2)] + [(202, junk, "xx", "tiny", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in op.kept(df).collect()}
    assert got == {r[0] for r in rows} - {104, 202}
    assert {r.doc_id for r in op.rules(df).where("kept").collect()} == got


def test_edges(edge, empty):
    got = op.rules(edge).collect()
    assert len(got) == edge.count() and not any(r.kept for r in got if r.doc_id in (1, 2, 3, 4))
    by = {r.doc_id: r for r in got}
    assert by[6].n_words == 80_000 == by[6].n_repeat_words and by[11].n_dup_lines == 2 and by[11].n_symbols == 8
    assert (by[1].n_words, by[1].word_chars, by[1].base_failed) == (0, 0, True)
    assert op.rules(empty).count() == op.kept(empty).count() == 0


def test_outlier_goes_and_likes_stay(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 997} of{k}" for k in range(60 + i % 30)), "en", "web", 1) for i in range(60)]
    rows.append((99, " ".join(f"W#{k}|{'X' * 300}%%%" for k in range(5000)), "en", "web", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in op.kept(df).collect()}
    assert kept == set(range(60)) and op.kept(df).columns == df.columns


def test_kept_returns_documents(edge):
    assert op.kept(edge).columns == edge.columns


def test_plans_stay_small(spark, edge):
    """Wide projections that build on each other took more of the driver's memory than it has: the largest plan here had 61,393 characters."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def plans():
        bus.waitUntilEmpty(30_000)
        found, each = {}, store.executionsList().iterator()
        while each.hasNext():
            e = each.next()
            found[e.executionId()] = len(e.physicalPlanDescription())
        return found

    before = plans()
    assert op.kept(edge).count() <= edge.count()
    sizes = [n for k, n in plans().items() if k not in before]
    assert len(sizes) > 5 and max(sizes) < 40_000, sizes
