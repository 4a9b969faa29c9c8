"""Benchmark decontamination with a distributed positional inverted index.

The index stores a posting (term, document, position) for every training token whose term occurs in
the test set.  An item's windows are phrases: a window's terms are ordered by how many postings they
have, the rarest one proposes places (its position less its offset in the window), and the lists of
the next ones, shifted by their offsets, are intersected with them.

Proximity matches come from the same index: a window is near a place if all but ``MISSES`` of its words
stand there, each at most ``SLOP`` words late.  Of any ``MISSES + 2`` words of a window two must then be
there, so only the lists of its rarest ones propose places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import ascii_lower, discard, own_folder, row_key, without, written
from quillmine.session import cut_lineage

#: The ASCII characters between words, one by one: Java looks such a class up in a table, ranges are tried in turn.
GAPS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: Characters between words: ASCII that is neither a digit nor a letter.
SEPARATOR = f"[{GAPS}]+"
WINDOW = 10
#: How many lists are intersected one after the other, rarest first, before all others at once.
RARE = 2
#: A proximity match lacks at most so many words of a window, and has the others at most so many words late.
MISSES = 1
SLOP = 1
#: Words of a document that are looked at together for a proximity match.
STRETCH = 16


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.char_length(whole)
    return F.array_remove(F.split(F.when(plain, F.lower(whole)).otherwise(ascii_lower(whole)), SEPARATOR, -1), "")


def windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows ``item, n, terms``: ``size`` consecutive words, or all words of a shorter item."""
    listed = items.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = listed.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("terms"))
    return cut.distinct().select("item", F.size("terms").alias("n"), "terms")


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index ``term, doc, pos`` of the words that ``terms(word, term)`` numbers.

    ``doc`` is the row key of ``key`` and text: repeated rows have the same postings.  The texts stay where
    they are; if the terms are many, Spark shuffles words instead of broadcasting them.
    """
    # key and words are made below the explode: beside it they would be made anew for every word.  The outer form adds only
    # a null word to a text of none, which joins nothing, and keeps Spark from cutting the texts twice to filter those out
    cut = docs.select(row_key(key, text).alias("doc"), words(F.col(text)).alias("words"))
    rows = cut.select("doc", F.posexplode_outer("words").alias("pos", "word"))
    return rows.join(terms, "word").select("term", "doc", "pos")


def occurrences(index: DataFrame, phrases: DataFrame, rare: int = RARE, scratch: str | None = None) -> DataFrame:
    """Where phrases occur: distinct ``phrase, doc, start``.

    ``phrases(phrase, terms)``: arrays of term numbers.  ``index``: a written table of postings, read once to
    count its terms, once per intersected list and once for the remaining words of documents that still
    have a candidate.  ``scratch``: where intermediate tables go; the result reads them.
    """
    parts = phrases.select("phrase", F.posexplode("terms").alias("offset", "term"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    sized = parts.join(counts, "term", "left").select("phrase", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term").alias("part"))
    ordered = sized.groupBy("phrase").agg(F.sort_array(F.collect_list("part")).alias("parts")).where("parts[0].n > 0")
    # small tables are written rather than checkpointed: Spark then knows their size and may broadcast them
    ordered = written(ordered.select("phrase", F.transform("parts", lambda p: F.struct(
        p["offset"].alias("offset"), p["term"].alias("term"))).alias("parts")), "decontaminate-phrases", scratch)
    found = index.join(_part(ordered, 0, scratch), "term").where("pos >= offset").select(
        "phrase", "doc", (F.col("pos") - F.col("offset")).alias("start"))
    found = written(found, "decontaminate-candidates", scratch)
    for i in range(1, rare):
        part = _part(ordered, i, scratch)
        listed = index.join(part.select("term").distinct(), "term", "left_semi")
        sought = found.join(part, "phrase").select("phrase", "doc", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
        met = sought.join(listed, ["doc", "pos", "term"], "left_semi").select("phrase", "doc", "start")
        whole = found.join(ordered.where(F.size("parts") <= i).select("phrase"), "phrase", "left_semi")
        found = written(met.unionByName(whole), "decontaminate-candidates", scratch)
    rest = F.slice("parts", rare + 1, F.greatest(F.size("parts") - rare, F.lit(0)))
    tails = ordered.select("phrase", F.size(rest).alias("need"), rest.alias("rest"))
    sought = found.distinct().join(tails, "phrase").select("phrase", "doc", "start", "need", F.explode("rest").alias("p")).select(
        "phrase", "doc", "start", "need", (F.col("start") + F.col("p.offset")).alias("pos"), F.col("p.term").alias("term"))
    # written, so that Spark knows how few documents are left and can filter the index by a broadcast
    held = written(found.select("doc").distinct(), "decontaminate-documents", scratch)
    listed = index.join(held, "doc", "left_semi")
    full = sought.join(listed.distinct(), ["doc", "pos", "term"]).groupBy("phrase", "doc", "start").agg(
        F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n = need").select("phrase", "doc", "start")
    short = found.join(tails.where("need = 0").select("phrase"), "phrase", "left_semi").distinct()
    return full.unionByName(short)


def _part(ordered: DataFrame, i: int, scratch: str | None) -> DataFrame:
    """The i-th rarest term of every phrase that has one: ``phrase, term, offset``."""
    part = F.col("parts")[i]
    rows = ordered.where(F.size("parts") > i).select("phrase", part["term"].alias("term"), part["offset"].alias("offset"))
    return written(rows, "decontaminate-part", scratch)


def near_places(index: DataFrame, lines: DataFrame, size: int = WINDOW, misses: int = MISSES, slop: int = SLOP,
                scratch: str | None = None) -> DataFrame:
    """Proximity matches: distinct ``line, doc, pos`` of the document words that take part in one.

    ``lines(line, terms)``: whole items as arrays of term numbers; windows are ``size`` consecutive ones, and an
    item of fewer has none.  A window is near place s of a document if for at least ``size - misses`` of its
    offsets o the term stands at one of the positions s+o to s+o+slop: a word may be changed, left out or put
    in.  Every such position takes part.  An exact occurrence is near too.  ``index`` as in ``occurrences``.
    """
    if not 0 <= misses <= size - 2 or slop < 0:
        raise ValueError("a window needs two words besides those that may be missing, and a slop of 0 or more")
    whole = lines.where(F.size("terms") >= size)
    parts = written(whole.select("line", F.posexplode("terms").alias("at", "term")), "decontaminate-words", scratch)
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    sized = written(parts.join(counts, "term", "left").select("line", "at", "term", F.coalesce("n", F.lit(0)).alias("n")),
                    "decontaminate-sized", scratch)
    # each word is in up to ``size`` windows; neighbours mostly share their rarest words, so these are few per item
    listed = sized.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("at", "term", "n"))).alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    rarest = F.slice(F.sort_array(F.transform("cut", lambda w: F.struct(w["n"].alias("n"), w["at"].alias("at"), w["term"].alias("term")))), 1, misses + 2)
    cut = listed.select("line", "words", F.explode(starts).alias("s")).select("line", F.slice("words", F.col("s"), size).alias("cut"))
    anchors = cut.select("line", F.inline(rarest)).where("n > 0").select("line", "at", "term").distinct()
    anchors = written(anchors, "decontaminate-anchors", scratch)
    # a word on diagonal d can belong to places d - slop to d; two different anchors must agree on one
    late = range(slop + 1)
    proposed = index.join(anchors, "term").select(
        "line", "doc", "at", F.explode(F.array(*(F.col("pos") - F.col("at") - i for i in late))).alias("s"))
    agreed = proposed.groupBy("line", "doc", "s").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"))
    # where there are only two, both are in the window: the words sought lie around both
    two, low, high = F.col("n") == 2, F.col("low"), F.col("high")
    agreed = agreed.where((low < high) & (~two | (high - low < size))).select(
        "line", "doc", "s", F.greatest(F.when(two, high).otherwise(low) - size + 1, F.lit(0)).alias("low"),
        (F.when(two, low).otherwise(high) + size - 1).alias("high"))
    agreed = written(agreed, "decontaminate-agreed", scratch)
    sought = agreed.join(parts, "line").where("at BETWEEN low AND high").select(
        "line", "doc", "s", "at", "term", F.explode(F.array(*(F.col("s") + F.col("at") + i for i in late))).alias("pos"))
    # the stretches of documents to look at: they grow with the documents, so they are never broadcast
    stretches = F.sequence(F.floor((F.col("s") + low) / STRETCH), F.floor((F.col("s") + high + slop) / STRETCH))
    held = written(agreed.select("doc", F.explode(stretches).alias("stretch")).distinct(), "decontaminate-stretches", scratch)
    there = index.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    there = there.join(held.hint("merge"), ["doc", "stretch"], "left_semi").select("doc", "pos", "term").distinct()
    # a met word is one number: its place in the item, and how late it is
    code = F.col("at").cast("bigint") * slop + F.col("pos") - F.col("s")
    met = sought.join(there, ["doc", "pos", "term"]).groupBy("line", "doc", "s").agg(F.sort_array(F.collect_set(code)).alias("met"))
    met = met.withColumn("ats", F.array_distinct(F.transform("met", lambda m: F.floor(m / (slop + 1))))).where(F.size("ats") >= size - misses)
    met = met.join(whole.select("line", F.size("terms").alias("length")), "line")
    # the first words of a window that has enough: it starts from ``low`` to ``high``
    runs = F.transform(F.sequence(F.lit(0), F.size("ats") - size + misses), lambda j: F.struct(
        F.greatest(F.element_at("ats", j + size - misses) - size + 1, F.lit(0)).alias("low"), F.least(F.element_at("ats", j + 1), F.col("length") - size).alias("high")))
    runs = F.filter(runs, lambda r: r["low"] <= r["high"])
    codes = F.transform(runs, lambda r: F.sequence(r["low"] * (slop + 1), (r["high"] + size) * (slop + 1) - 1))
    taken = met.select("line", "doc", "s", F.explode(F.array_intersect("met", F.flatten(codes))).alias("m"))
    return taken.select("line", "doc", (F.col("s") + F.floor(F.col("m") / (slop + 1)) + F.col("m") % (slop + 1)).cast("int").alias("pos")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", size: int = WINDOW, near: bool = False, misses: int = MISSES, slop: int = SLOP) -> DataFrame:
    """``text_hash, n_hit, items``: one row per distinct (key, text) in which a window occurs.

    ``n_hit`` counts the words inside any occurrence, ``items`` lists the item ids, sorted as strings.
    With ``near`` also ``n_near, near_items`` of the proximity matches (``near_places``) and a row per text that
    has either; where one is lacking its count is 0 and its list empty.
    ``text_hash`` is the row key of key and text.  Null and empty texts or items have no words and match
    nothing; equal items are all listed; repeated rows give one result.  Documents without a hit have no
    row: join with ``with_hits``.
    """
    spark = docs.sparkSession
    scratch = own_folder(spark, "decontaminate")
    cut = cut_lineage(windows(items, item, item_text, size))
    listed = cut.select(F.explode("terms").alias("word")).distinct()
    terms = written(listed.select("word", F.xxhash64("word").alias("term")), "decontaminate-terms", scratch)
    phrase = F.transform("terms", lambda w: F.xxhash64(w))
    phrases = cut.select("item", "n", phrase.alias("terms")).select("item", "n", F.xxhash64("terms").alias("phrase"), "terms")
    phrases = written(phrases, "decontaminate-windows", scratch)
    index = written(postings(docs, terms, key, text), "decontaminate-index", scratch)
    distinct = phrases.select("phrase", "terms").dropDuplicates(["phrase"])
    places = written(occurrences(index, distinct, scratch=scratch), "decontaminate-places", scratch)
    lengths = phrases.groupBy("phrase").agg(F.max("n").alias("n"))
    ids = phrases.select("phrase", F.col("item").cast("string").alias("item")).distinct()
    spans = places.join(lengths, "phrase").groupBy("doc", "start").agg(F.max("n").alias("n"))
    hits = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans")).select("doc", _covered("spans").alias("n_hit"))
    named = places.select("doc", "phrase").distinct().join(ids, "phrase").groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = hits.join(named, "doc")
    if near:
        found = found.join(_near(index, items, item, item_text, size, misses, slop, scratch), "doc", "full").select(
            "doc", *(F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("n_hit", "n_near")),
            *(F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in ("items", "near_items")))
    found = written(found.withColumnRenamed("doc", "text_hash"), "decontaminate-hits")
    discard(spark, scratch)
    return found


def _near(index: DataFrame, items: DataFrame, item: str, text: str, size: int, misses: int, slop: int, scratch: str) -> DataFrame:
    """``doc, n_near, near_items``: words in proximity matches, and the items, equal texts all listed."""
    terms = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    lines = items.select(F.col(item).cast("string").alias("item"), terms.alias("terms")).where(F.size("terms") >= size)
    lines = written(lines.select("item", F.xxhash64("terms").alias("line"), "terms"), "decontaminate-lines", scratch)
    distinct = lines.select("line", "terms").dropDuplicates(["line"])
    places = written(near_places(index, distinct, size, misses, slop, scratch), "decontaminate-near", scratch)
    counted = places.select("doc", "pos").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_near"))
    ids = lines.select("line", "item").distinct()
    named = places.select("doc", "line").distinct().join(ids, "line").groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("near_items"))
    return counted.join(named, "doc")


def _covered(spans: str) -> Column:
    """Words that sorted spans (start, n) cover together."""
    zero = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("end"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["words"] + F.greatest(s["start"] + s["n"] - F.greatest(a["end"], s["start"]), F.lit(0))).cast("bigint").alias("words"),
        F.greatest(a["end"], s["start"] + s["n"]).alias("end")), lambda a: a["words"])


def with_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``items`` (sorted strings, empty where there are none).

    With ``near=True`` also with ``n_near`` and ``near_items``, the same of the proximity matches.
    """
    found = decontaminate(docs, items, key, text, **options)
    names = [n for n in ("n_hit", "n_near", "items", "near_items") if n in found.columns]
    clean = without(docs, "n_words", *names)
    found = found.select(F.col("text_hash").alias("__hash"), *(F.col(n).alias(f"__{n}") for n in names))
    # made below the join: texts that nobody selects are not moved
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SEPARATOR, -1)
    count = F.size(F.array_remove(parts, "")).cast("bigint")
    counted = clean.withColumns({"__row": row_key(key, text), "n_words": count})
    joined = counted.join(found, F.col("__row") == F.col("__hash"), "left")
    return joined.select(
        *(F.col(f"`{c}`") for c in clean.columns), "n_words",
        *(F.coalesce(f"__{n}", F.array().cast("array<string>") if "items" in n else F.lit(0).cast("bigint")).alias(n) for n in names))
