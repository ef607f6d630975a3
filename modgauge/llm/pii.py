"""Personal data, natively: pattern spans, and terms that disclose a protected entity by co-occurrence.

Every e-mail address, IP address, card and phone number is a protected entity. Words within WINDOW words of
its mentions are its candidates. Over the corpus, the pointwise mutual information of a candidate and the
entity, as a share of the entity's own information, tells how much of the entity the term gives away; terms
at GENERALISE or more become a placeholder and at REMOVE or more go, wherever they stand in any document. Spans are
in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, cut, in_parts, join_small, let

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive forms of the patterns: they match the same leftmost spans without backtracking, in linear time.
#: A local part can only start where no character of its class stands before it, or where the last match ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
HINT = {"email": "@[A-Za-z0-9-]++\\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9][ ().0-9-]"}
WINDOW, SUPPORT = 8, 3
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"\p{L}[\p{L}\p{N}'-]{2,}+"
#: Characters looked at first on either side of a mention, and matches whose lengths are summed at once.
REACH, BLOCK = 400, 128
#: The input is read by so many tasks a core, or by one for so many rows where that is more.
TASKS, TASK_ROWS = 4, 4_000
SPANS, KINDED = "array<struct<s:int,e:int,v:string>>", "array<struct<s:int,k:int,e:int,v:string>>"
MASK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def one(i: int) -> Column:
        x = F.coalesce(F.substring(F.reverse(d), i + 1, 1).try_cast("int"), F.lit(0))
        return F.when(x > 4, 2 * x - 9).otherwise(2 * x) if i % 2 else x

    return sum((one(i) for i in range(1, 19)), one(0)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    if kind == "card":
        return n.between(14, 19) & luhn(digits(s))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ip":  # leading zeros count as their value, however many
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array of (s, e, v): places in code points, and the string.

    What stands between the matches gives their places. Sums run in blocks, so that a text with very many
    matches costs their number times a constant.
    """

    def placed(both: Column) -> Column:
        gap, hit = both["g"], both["h"]
        n = F.size(hit)
        step_ = lambda i: F.length(F.get(gap, i)) + F.length(F.get(hit, i))
        until = lambda b: F.least(n, (b + 1) * BLOCK) - 1
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.sequence(b * BLOCK, until(b)), F.lit(0), lambda x, i: x + step_(i)))

        def inside(sums: Column) -> Column:
            def one(b: Column) -> Column:
                start = F.aggregate(F.slice(sums, 1, b), F.lit(0), lambda x, y: x + y)

                def add(acc: Column, i: Column) -> Column:
                    s, v = acc["at"] + F.length(F.get(gap, i)), F.get(hit, i)
                    span = F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"))
                    return F.struct((s + F.length(v)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

                return F.aggregate(F.sequence(b * BLOCK, until(b)), F.struct(start.alias("at"), F.array().cast(SPANS).alias("out")), add)["out"]

            return F.flatten(F.transform(blocks, one))

        return F.when(n > 0, let(sums, inside)).otherwise(F.array().cast(SPANS))

    return let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h")), placed)


def base_spans(text: Column) -> Column:
    """All base spans (s, k, e, v), by start and then by kind as listed; a null text has none."""
    text = F.coalesce(text, F.lit(""))

    def of(k: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda x: valid(kind, x["v"]))
        spans = F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(text.rlike(HINT[kind]), spans).otherwise(F.array().cast(KINDED))

    return F.sort_array(F.concat(*[of(k, kind) for k, kind in enumerate(MASK)]))


def whole_window(sizes: list[int], chunk, pattern: str, trim, rest: Column) -> Column:
    """What pattern finds in the first chunk that holds all WINDOW words, or in the whole side of length rest."""
    if not sizes:
        return F.regexp_extract(chunk(rest), pattern, 0)

    def tried(x: Column) -> Column:
        done = (rest <= sizes[0]) | (F.length(trim(x["c"], F.lit(BLANKS))) > F.length(x["w"]))
        return F.when(done, x["w"]).otherwise(whole_window(sizes[1:], chunk, pattern, trim, rest))

    found = lambda c: F.struct(c.alias("c"), F.regexp_extract(c, pattern, 0).alias("w"))
    return let(let(chunk(F.least(rest, F.lit(sizes[0]))), found), tried)


def before(text: Column, s: Column) -> Column:
    """The WINDOW words before place s, and what is joined to the mention there."""
    pattern = rf"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{0,{WINDOW}}}[^\x20\x09-\x0D]*+\z"
    return whole_window([REACH, 16 * REACH], lambda n: F.substring(text, s - n + 1, n), pattern, F.ltrim, s)


def after(text: Column, e: Column) -> Column:
    """What is joined to the mention that ends at e, and the WINDOW words after it."""
    pattern = rf"^[^\x20\x09-\x0D]*+(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++){{0,{WINDOW}}}"
    return whole_window([REACH, 16 * REACH], lambda n: F.substring(text, e + 1, n), pattern, F.rtrim, F.length(text) - e)


def contexts(text: Column, spans: Column) -> Column:
    """The words around each mention, as an array of (entity, context, term, s, e); context tells windows apart."""

    def around(m: Column) -> Column:
        left, right = before(text, m["s"]), after(text, m["e"])

        def rows(sides: Column) -> Column:
            left, right = sides["l"], sides["r"]
            entity = F.concat_ws(":", m["k"].cast("string"), F.lower(m["v"]))

            def row(at: Column):
                return lambda x: F.struct(entity.alias("entity"), F.xxhash64(left, right).alias("context"), F.lower(x["v"]).alias("term"), (at + x["s"]).alias("s"), (at + x["e"]).alias("e"))

            return F.concat(F.transform(matches(left, TERM), row(m["s"] - F.length(left))), F.transform(matches(right, TERM), row(m["e"])))

        return let(F.struct(left.alias("l"), right.alias("r")), rows)

    all_of = F.flatten(F.transform(spans, around))
    free = F.filter(all_of, lambda t: ~F.exists(spans, lambda m: (m["s"] < t["e"]) & (t["s"] < m["e"])))
    return F.when(F.size(spans) > 0, free).otherwise(F.array().cast("array<struct<entity:string,context:bigint,term:string,s:int,e:int>>"))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(entity, term, share): pairs of which the term gives GENERALISE or more of the entity away, or None.

    Pairs need SUPPORT different contexts, so that copies of one document prove nothing. A term's document
    count is over the whole corpus: tasks count all terms of their documents before anything is shuffled, and
    candidates are picked from the counts, so that common candidates cost no row for each document.
    """
    near = found.where("size(_near) > 0").select("doc_id", "_h", F.explode("_near").alias("x")).select("doc_id", "_h", "x.entity", "x.context", "x.term")
    pairs = near.groupBy("entity", "term", "context").agg(F.count("*")).groupBy("entity", "term").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    total = found.count()
    pairs = cut(in_parts(pairs.select("entity", "term"), total))
    n_pairs = pairs.count()
    if not n_pairs:
        return None
    terms = pairs.select("term").distinct()
    tokens = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("_t"))
    counted = tokens.groupBy("_t").agg(F.count("*").alias("df_t"))
    of_term = join_small(counted, terms, F.col("_t") == F.col("term"), n_pairs).select("term", "df_t")
    entities = pairs.select("entity").distinct()
    of_entity = found.where("size(_spans) > 0").select(F.explode(F.array_distinct(F.transform("_spans", lambda m: F.concat_ws(":", m["k"].cast("string"), F.lower(m["v"]))))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_e")).join(entities, "entity", "left_semi")
    once = found.where("size(_near) > 0").select(F.explode(F.array_distinct(F.transform("_near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("x")).select("x.*")
    both = once.groupBy("entity", "term").agg(F.count("*").alias("df_te"))
    n = F.lit(float(total))
    share = F.log(F.col("df_te") * n / (F.col("df_t") * F.col("df_e"))) / F.nullif(F.log(n / F.col("df_e")), F.lit(0.0))
    out = pairs.join(both, ["entity", "term"]).join(of_term, "term").join(of_entity, "entity").withColumn("share", share)
    return cut(in_parts(out.where(F.col("share") >= GENERALISE).select("entity", "term", "share"), n_pairs))


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, _spans, _near) of every row; many small partitions of the input are read by fewer tasks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = docs.coalesce(max(TASKS * docs.sparkSession.sparkContext.defaultParallelism, docs.count() // TASK_ROWS))
    spans = dealt.select("doc_id", F.xxhash64(text).alias("_h"), text.alias("_t"), F.explode(F.array(base_spans(text))).alias("_spans"))
    return cut(spans.select("doc_id", "_h", "_spans", contexts(F.col("_t"), F.col("_spans")).alias("_near")))


def term_spans(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(_id, _g, _terms): for each document with disclosing terms their spans, v being what takes their place."""
    shares = disclosing(found, docs)
    few = 0 if shares is None else shares.count()
    if not few:
        return None
    of_term = shares.groupBy(F.col("term").alias("_w")).agg(F.max("share").alias("share"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    tokens = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.explode(F.array_distinct(own)).alias("_t"))
    word = F.struct(F.col("_w").alias("w"), F.when(F.col("share") >= REMOVE, "").otherwise("<TERM>").alias("v"))
    hit = join_small(tokens, of_term, F.col("_t") == F.col("_w"), few)
    hit = cut(in_parts(hit.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_g")).agg(F.collect_set(word).alias("_words")), found.count()))
    n_hit = hit.count()
    here = docs.select("doc_id", F.xxhash64(text).alias("_h"), text.alias("_t"))
    here = join_small(here, hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), n_hit).dropDuplicates(["_id", "_g"])

    def placed(by: Column) -> Column:
        struct = lambda x: F.struct(x["s"].alias("s"), F.lit(len(MASK)).alias("k"), x["e"].alias("e"), by[F.lower(x["v"])].alias("v"))
        return F.transform(F.filter(matches(F.col("_t"), TERM), lambda x: by[F.lower(x["v"])].isNotNull()), struct)

    here = here.select("_id", "_g", F.explode(F.array(base_spans(F.col("_t")))).alias("_base"), let(F.map_from_entries("_words"), placed).alias("_all"))
    free = F.filter("_all", lambda t: ~F.exists("_base", lambda m: (m["s"] < t["e"]) & (t["s"] < m["e"])))
    return cut(in_parts(here.select("_id", "_g", free.alias("_terms")), n_hit))


def with_terms(df: DataFrame, terms: DataFrame | None) -> DataFrame:
    """Add _all, base and term spans, to rows with doc_id, _h and _spans."""
    if terms is None:
        return df.withColumn("_all", F.col("_spans"))
    few = terms.count() <= BROADCAST_ROWS
    some = df.join(F.broadcast(terms) if few else terms, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    return some.withColumn("_all", F.sort_array(F.concat("_spans", F.coalesce("_terms", F.array().cast(KINDED))))).drop("_id", "_g", "_terms")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Contract of op5: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans, and the digest of an empty string. Rows that repeat a document get its
    spans each. Spans of different kinds may overlap; terms never overlap base spans. An empty table gives no row.
    """
    found = found_in(docs)
    count = lambda k: F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(MASK)]
    return with_terms(found, term_spans(found, docs)).select("doc_id", *counts, F.sha2(listed(F.col("_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with a mask for each base span and the given string for each term; overlapping spans become one."""
    masks = F.array(*[F.lit(m) for m in MASK.values()])

    def step(acc: Column, x: Column) -> Column:
        mask = F.when(x["k"] < len(MASK), F.element_at(masks, F.least(x["k"] + 1, F.lit(len(MASK))))).otherwise(x["v"])
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), mask)
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)).otherwise(text)


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced and n_chars brought up to date; every row stays."""
    terms = term_spans(found_in(docs), docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.explode(F.array(base_spans(text))).alias("_spans"), F.struct("*").alias("_doc"))
    clean = F.when(F.col("_doc.text").isNotNull(), replaced(F.col("_doc.text"), F.col("_all")))
    out = with_terms(packed, terms).select("_doc", clean.alias("_clean"))
    columns = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    return out.select(*[columns.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
