"""Sanitising personal data by what words disclose (operator 1).

Protected entities are the e-mail addresses, ip addresses, card and phone numbers that patterns and checks find.
How strongly a word reveals an entity is estimated from all distinct texts (so copies are no evidence, neither for
nor against): with N texts, c(e) of them with the entity, df(t) with the word, and c(e, t) with both, the word
discloses the share log(c(e,t) N / (c(e) df(t))) / log(N / c(e)) of the entity's information. Words of a share of at
least ``GENERALISE`` become a placeholder, from ``REMOVE`` on they go, in every document that names the entity. A word
needs ``SUPPORT`` texts. As further evidence c(e) and c(e, t) are also counted over the distinct contexts of the
entity, the ``NEAR`` words before and after, of which one text can have several; the larger share counts.

Built from SQL functions only. Tables are reduced before every shuffle: of texts only the hashes of their distinct
words are moved, but for those that hold a word to be treated; pairs are made of words that are rare enough to disclose.

Cases: a null text has no spans and stays null; repeated rows get equal spans; null ids are matched null-safely; an
empty table gives an empty result; columns named like an output are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import let, sifted
from sessionlens.session import stage

KINDS = ["email", "ip", "card", "phone", "general", "removed"]
#: The base patterns, with possessive parts and starts that can't lie inside a run, so that time stays linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}[\p{L}\p{M}'’-]{2,}+"
NEAR, REACH = 8, 200
#: Texts are cut into parts of at least so many characters where pieces of them are looked up.
PART = 4096
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[WORD]", "removed": "[REMOVED]"}
NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """What a match of the pattern must also fulfil."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits(value)), F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def root(n: Column) -> Column:
    return F.ceil(F.sqrt(n)).cast("int")


def in_runs(n: Column, name: str, run: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """What a fold over 0 .. n - 1 collects, made in runs of about the square root of n.

    A fold that appends copies what it has; runs keep each copy short. ``run`` folds over the numbers of a run from
    a position and gives that after it, ``at``, and what the run made, ``name``; ``finish`` joins the list of these.
    """
    size = F.greatest(root(n), F.lit(1))
    first = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), size)

    def step(state: Column, k: Column) -> Column:
        one = run(state["at"], F.sequence(k, F.least(k + size, n) - 1))
        return let(one, lambda r: F.struct(r["at"].alias("at"), F.concat(state["made"], F.array(r[name])).alias("made")))

    kind = "array<struct<start:int,kind:int,end:int,value:string>>" if name == "spans" else "string"
    nothing = F.expr(f"cast(array() as array<{kind}>)")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("made"))
    return F.when(n > 0, F.aggregate(first, start, step, lambda s: finish(s["made"]))).otherwise(finish(nothing))


def cut(text: Column) -> Column:
    """(size, parts): the text in parts of a fixed size, for :func:`piece`."""
    size = F.greatest(4 * root(F.length(text)), F.lit(PART))
    first = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), size)
    return F.struct(size.alias("size"), F.transform(first, lambda i: F.substring(text, i + 1, size)).alias("parts"))


def piece(text: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` up to ``stop`` of a text that is cut; a substring would walk there from the beginning."""
    size, parts = text["size"], text["parts"]
    head = F.floor(start / size).cast("int")
    some = F.array_join(F.slice(parts, head + 1, F.floor(stop / size).cast("int") - head + 1), "")
    return F.when(stop > start, F.substring(some, start - head * size + 1, stop - start)).otherwise(F.lit(""))


def matches(text: Column, pattern: str, kind: Column, wanted=None) -> Column:
    """Spans of all matches: offsets come from the lengths of the matches and of what a split leaves between them.

    ``wanted`` (from a match to true or false) drops spans as they are made.
    """

    def spans(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]

        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(gaps, i))
            value = F.get(found, i)
            span = F.struct(start.alias("start"), kind.cast("int").alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"))
            grown = F.concat(state["spans"], F.array(span))
            if wanted is not None:
                grown = F.when(wanted(value), grown).otherwise(state["spans"])
            return F.struct((start + F.length(value)).alias("at"), grown.alias("spans"))

        def run(at: Column, numbers: Column) -> Column:
            return F.aggregate(numbers, F.struct(at.alias("at"), F.expr(NO_SPANS).alias("spans")), step)

        return in_runs(F.size(found), "spans", run, F.flatten)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(both, spans)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by start and then kind."""
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    found = []
    for number, kind in enumerate(PATTERNS):
        spans = matches(text, PATTERNS[kind], F.lit(number), lambda v, kind=kind: passes(kind, v))
        found.append(F.when(hint[kind], spans).otherwise(F.expr(NO_SPANS)) if kind in hint else spans)
    return F.when(text.isNull(), F.expr(NO_SPANS)).otherwise(F.sort_array(F.concat(*found)))


def entity(span: Column) -> Column:
    """One value for all spellings of an entity."""
    plain = F.when(span["kind"] < 2, F.lower(span["value"])).otherwise(digits(span["value"]))
    return F.xxhash64(span["kind"], plain)


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def context(text: Column, length: Column, span: Column) -> Column:
    """The words around a span of a text that is cut: at most ``NEAR`` on either side, within ``REACH`` characters."""
    before = terms(piece(text, F.greatest(span["start"] - REACH, F.lit(0)), span["start"]))
    before = let(before, lambda w: F.slice(w, F.greatest(F.size(w) - NEAR + 1, F.lit(1)), F.lit(NEAR)))
    after = F.slice(terms(piece(text, span["end"], F.least(span["end"] + REACH, length))), 1, NEAR)
    return F.array_sort(F.array_distinct(F.concat(before, after)))


def found_entities(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, spans, near) of every row: base spans, and the context of each entity. Written, without texts."""
    rows = df.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    spans = rows.withColumn("spans", base_spans(F.col("text")))
    words = lambda cut_text, s: context(cut_text, F.length("text"), s)
    near = F.when(
        F.size("spans") > 0,
        let(cut(F.col("text")), lambda c: F.transform("spans", lambda s: F.struct(entity(s).alias("entity"), words(c, s).alias("words")))),
    ).otherwise(F.expr("cast(array() as array<struct<entity:bigint,words:array<string>>>)"))
    return stage(spans.select("id", "hash", "spans", near.alias("near")), "entities")


def disclosing_terms(df: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, share) of all words that reveal an entity beyond ``GENERALISE``; entity and term as hashes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_distinct(F.transform(terms(whole), lambda w: F.xxhash64(w)))
    texts = stage(df.select(F.xxhash64(whole).alias("hash"), words.alias("words")).dropDuplicates(["hash"]), "text-terms")
    n = texts.count()
    counts = stage(texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "counts")

    names = found.select("hash", F.explode("near.entity").alias("entity")).distinct()
    known = names.groupBy("entity").agg(F.count("*").alias("ce")).where((F.col("ce") >= SUPPORT) & (F.col("ce") < n))
    named = stage(names.join(known, "entity"), "named")
    # the share is at most log(n / df) / log(n / ce), so a more frequent word can't reach GENERALISE
    most = lambda ce: 1.000001 * F.pow(F.lit(float(n)), F.lit(1 - GENERALISE)) * F.pow(F.col(ce), F.lit(GENERALISE))
    per_text = named.groupBy("hash").agg(F.max("ce").alias("most"))
    rare = texts.join(per_text, "hash").select("hash", "most", F.explode("words").alias("term"))
    rare = rare.join(counts.where(F.col("df") >= SUPPORT), "term").where(F.col("df") <= most("most")).select("hash", "term", "df")
    together = rare.join(named, "hash").where(F.col("df") <= most("ce")).groupBy("entity", "term", "ce", "df").agg(F.count("*").alias("cet"))

    contexts = found.select(F.explode("near").alias("n")).select("n.entity", "n.words").distinct()
    around = contexts.groupBy("entity").agg(F.count("*").alias("ce"))
    pairs = contexts.select("entity", F.explode("words").alias("term")).groupBy("entity", F.xxhash64("term").alias("term")).agg(F.count("*").alias("cet"))
    near = stage(pairs.where(F.col("cet") >= SUPPORT).join(around, "entity"), "pairs").where(F.col("ce") < n).join(counts, "term")

    share = F.log(F.col("cet") * n / (F.col("ce") * F.greatest("df", "cet"))) / F.log(F.lit(n) / F.col("ce"))
    every = together.where(F.col("cet") >= SUPPORT).unionByName(near.select(*together.columns)).withColumn("share", share)
    best = every.where(F.col("share") >= GENERALISE).groupBy("entity", "term").agg(F.max("share").alias("share"))
    return stage(best, "disclosing")


def term_spans(df: DataFrame, found: DataFrame, disclosing: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, more): spans of disclosing words, for the documents that name the entity they reveal."""
    named = found.select("id", "hash", F.explode("near.entity").alias("entity")).distinct().join(disclosing, "entity")
    per_term = named.groupBy("id", "hash", "term").agg(F.max("share").alias("share"))
    wanted = stage(per_term.groupBy("id", "hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares")), "wanted")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("_id"), F.xxhash64(whole).alias("_hash"), whole.alias("text"))
    rows = sifted(rows, F.col("_hash"), wanted.select("hash")).where("_maybe").drop("_maybe")
    rows = rows.join(wanted, (F.col("_hash") == F.col("hash")) & F.col("_id").eqNullSafe(F.col("id"))).dropDuplicates(["id", "hash"])
    share = lambda v: F.element_at("shares", F.xxhash64(F.lower(v)))
    spans = matches(F.col("text"), TERM, F.lit(4), lambda v: share(v).isNotNull())
    removed = lambda s: F.when(share(s["value"]) >= REMOVE, s.withField("kind", F.lit(5))).otherwise(s)
    return stage(rows.select("id", "hash", F.transform(spans, removed).alias("more")), "term-spans")


def private_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, base, spans) of every row: base spans, and all spans by start and then kind."""
    found = found_entities(df, doc_id, text)
    disclosing = disclosing_terms(df, found, text)
    more = term_spans(df, found, disclosing, doc_id, text).select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "more")
    joined = found.join(more, (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    every = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "more")))
    return joined.select("id", "hash", F.col("spans").alias("base"), every.alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with a mask for every span; overlapping spans share the mask of the first."""
    masks = F.array(*(F.lit(MASKS[k]) for k in KINDS))

    def made(cut_text: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            s = F.get(spans, i)
            new = F.concat(piece(cut_text, state["at"], s["start"]), F.get(masks, s["kind"]))
            out = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(new))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

        def run(at: Column, numbers: Column) -> Column:
            start = F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
            joined = lambda s: F.struct(s["at"].alias("at"), F.array_join(s["out"], "").alias("out"))
            return F.aggregate(numbers, start, step, joined)

        rest = piece(cut_text, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
        return F.concat(in_runs(F.size(spans), "out", run, lambda m: F.array_join(m, "")), rest)

    return F.when(F.size(spans) == 0, text).otherwise(let(cut(text), made))


def sanitised(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with personal data and disclosing words masked in the texts."""
    spans = private_spans(df, doc_id, text).where(F.size("spans") > 0).dropDuplicates(["id", "hash"])
    spans = stage(spans.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("spans").alias("_spans")), "spans")
    rows = df.withColumn("_own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    sifting = sifted(rows, F.col("_own"), spans.select("_hash"))
    free = sifting.where("not _maybe").select(*df.columns)
    joined = sifting.where("_maybe").join(spans, (F.col("_own") == F.col("_hash")) & F.col(doc_id).eqNullSafe(F.col("_id")), "left")
    done = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("_spans")))
    return free.union(joined.withColumn(text, done).select(*df.columns))
