"""Secret scan that links the parts of a credential.

Strong patterns are reported wherever they stand.  Weak ones, such as an unmarked random string or a
user name, mean nothing alone; they are reported when a complementary part (identifier, secret,
endpoint) lies at most ``scope`` code points away in the same text, which an interval join finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import row_key, without
from quillmine.session import cut_lineage

ASSIGN = (
    "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: kind, what role its spans play, the pattern (group 1 is measured), and the least length of that group.
#: ``access`` and ``hex`` have their least length in the pattern: their matches are whole runs either way.
PATTERNS = (
    ("assign", "secret", ASSIGN, 6),
    ("access", "identifier", "(AKIA[A-Z0-9]{16,})", 20),
    ("hex", "secret", "((?<![0-9a-f])[0-9a-f]{24,})", 24),
    ("identifier", "identifier",
     "(?i:\\b(?:user(?:_?name)?|login|client_?id|access_?key(?:_?id)?|account_?(?:id|name))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9@._+-]+))", 3),
    ("secret", "secret", "(?<![A-Za-z0-9+/_=-])((?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2})", 20),
    ("endpoint", "endpoint", "((?i:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\\s\"'<>]+)", 8),
)
#: Places inside an endpoint where a secret may stand: user information, and the values of key parameters.
#: A parameter's name is taken whole and at once, so a long run without "=" is read twice and no more.
OPEN = (
    "open", "open",
    "((?i:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\\s\"'<>/?#@]+@"
    "|[?&;#](?i:(?=[a-z0-9_.-]*?(?:key|token|secret|signature|sig|passw(?:or)?d|pwd|auth|credential))[a-z0-9_.-]++)=[^\\s\"'<>&;#]+)", 1)
BASE = ("assign", "access", "hex")
WEAK = tuple(p[0] for p in PATTERNS if p[0] not in BASE)
KINDS = BASE + WEAK
ROLES = ("identifier", "secret", "endpoint")
SCOPE = 200


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per text with spans: ``key, text_hash, spans``.

    ``spans`` is array<struct<start,rank,kind,end>> by start, then kind as in ``KINDS``; positions count code
    points, the end is exclusive.  ``text_hash`` (xxhash64 of key and text) tells texts of one key apart;
    repeated rows give one result.  Null and empty texts have none, and texts without spans no row:
    join with ``with_secrets``.  Texts are read where they lie, only positions move.
    """
    found = cut_lineage(_in_the_open(cut_lineage(_positions(docs, key, text)), key, scope))
    strong = found.where(F.col("kind").isin(*BASE))
    weak = _uncovered(found, key, scope)
    linked = links(weak, found, key, scope).select(
        F.col(key).alias("k"), F.col("text_hash").alias("h"), F.col("kind").alias("l"), F.col("start").alias("s"))
    same = F.col(key).eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))
    weak = weak.join(linked, same & (F.col("kind") == F.col("l")) & (F.col("start") == F.col("s")), "left_semi")
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    spans = strong.unionByName(weak).select(key, "text_hash", F.struct("start", rank.alias("rank"), "kind", "end").alias("span"))
    return spans.groupBy(key, "text_hash").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def with_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``spans`` (as in ``find_secrets``, empty where there are none); rows one for one."""
    found = cut_lineage(find_secrets(docs, key, text, scope)).select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"), "spans")
    clean = without(docs, "spans")
    # the key is made below the join: texts that nobody selects are not moved
    hashed = clean.withColumn("__row", row_key(key, text))
    joined = hashed.join(found, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__row") == F.col("__hash")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>")
    return joined.select(*(F.col(f"`{c}`") for c in clean.columns), F.coalesce("spans", none).alias("spans"))


def _cuts(text: Column, kind: str, role: str, pattern: str, least: int) -> Column:
    """The matches of one pattern: for each the length of the gap before it, its own, and its group's."""
    matches = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length).alias("length"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.char_length).alias("group"))
    return F.when(text.rlike(pattern), F.struct(
        F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(least).alias("least"), matches.alias("matches")))


def _positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every match as ``key, text_hash, kind, role, start, end``.

    Gaps and matches alternate through a text, so a match ends at the running sum of both lengths.
    """
    cuts = F.array_compact(F.array(*(_cuts(F.col(text), *p) for p in (*PATTERNS, OPEN))))
    rows = docs.select(F.col(key), row_key(key, text).alias("text_hash"), F.explode(cuts).alias("c"))
    rows = rows.select(key, "text_hash", "c.kind", "c.role", "c.least", F.posexplode("c.matches").alias("i", "m"))
    rows = rows.where("m.length IS NOT NULL").select(
        key, "text_hash", "kind", "role", "least", "i", F.col("m.gap").cast("bigint").alias("gap"),
        F.col("m.length").cast("bigint").alias("length"), F.col("m.group").alias("group"))
    # repeated rows give every match twice; the exchange serves the removal and the window
    rows = rows.repartition(key, "text_hash", "kind").dropDuplicates([key, "text_hash", "kind", "i"])
    own = Window.partitionBy(key, "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(own))
    return ended.where(F.col("group") >= F.col("least")).select(
        key, "text_hash", "kind", "role", (F.col("end") - F.col("length")).alias("start"), "end")


def _in_the_open(found: DataFrame, key: str, scope: int) -> DataFrame:
    """``found`` without weak secrets that are part of an address: inside an endpoint, but not in an open place of it."""
    secrets = found.where("kind = 'secret'").select(key, "text_hash", "start", "end", F.floor(F.col("start") / scope).alias("bin"))
    same = F.col(key).eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))

    def inside(parts: DataFrame, kind: str, how: str) -> DataFrame:
        bins = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)))
        around = found.where(F.col("kind") == kind).select(
            F.col(key).alias("k"), F.col("text_hash").alias("h"), F.col("start").alias("s"), F.col("end").alias("e"), bins.alias("b"))
        return parts.join(around, same & (F.col("bin") == F.col("b")) & (F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e")), how)

    address = inside(inside(secrets, "endpoint", "left_semi"), "open", "left_anti").select(
        F.col(key).alias("k"), F.col("text_hash").alias("h"), F.lit("secret").alias("l"), F.col("start").alias("s"))
    others = found.where(F.col("kind") != "open")
    return others.join(address, same & (F.col("kind") == F.col("l")) & (F.col("start") == F.col("s")), "left_anti")


def _uncovered(found: DataFrame, key: str, scope: int) -> DataFrame:
    """The weak matches that share no code point with a strong one."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)))
    weak = found.where(F.col("kind").isin(*WEAK))
    strong = found.where(F.col("kind").isin(*BASE)).select(
        F.col(key).alias("k"), F.col("text_hash").alias("h"), F.col("start").alias("s"), F.col("end").alias("e"), bins.alias("b"))
    cut = weak.select(key, "text_hash", "kind", "start", "end", bins.alias("bin"))
    same = F.col(key).eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))
    covered = cut.join(strong, same & (F.col("bin") == F.col("b")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left_semi")
    covered = covered.select(F.col(key).alias("k"), F.col("text_hash").alias("h"), F.col("kind").alias("l"), F.col("start").alias("s")).distinct()
    return weak.join(covered, same & (F.col("kind") == F.col("l")) & (F.col("start") == F.col("s")), "left_anti")


def links(weak: DataFrame, found: DataFrame, key: str, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part in scope: ``key, text_hash, kind, start, partner, partner_start``.

    An identifier or endpoint needs a secret, a secret an identifier or endpoint.  At most ``scope`` code
    points lie between the end of one part and the start of the other, however long either is.  Both are
    listed in every bin of ``scope`` code points that they cover, the weak part also in those it reaches, and
    meet in the first bin they share, so each is compared only with the few that fit around it.
    """
    same = (F.col("text_hash") == F.col("h")) & F.col(key).eqNullSafe(F.col("k")) & (F.col("bin") == F.col("b"))
    first, last = F.floor((F.col("start") - scope - 1) / scope), F.floor((F.col("end") + scope) / scope)
    left = weak.select(key, "text_hash", "kind", "role", "start", "end", first.alias("first"), F.explode(F.sequence(first, last)).alias("bin"))
    first, last = F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)
    right = found.select(
        F.col(key).alias("k"), F.col("text_hash").alias("h"), F.col("kind").alias("partner"), F.col("role").alias("r"),
        F.col("start").alias("partner_start"), F.col("end").alias("partner_end"), first.alias("f"), F.explode(F.sequence(first, last)).alias("b"))
    once = F.col("bin") == F.greatest("first", "f")
    complementary = ((F.col("role") == "secret") & (F.col("r") != "secret")) | ((F.col("role") != "secret") & (F.col("r") == "secret"))
    gap = F.greatest(F.col("partner_start") - F.col("end"), F.col("start") - F.col("partner_end"))
    return left.join(right, same & once & complementary & gap.between(0, scope)).select(
        key, "text_hash", "kind", "start", "partner", "partner_start")
