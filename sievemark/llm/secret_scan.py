"""Secret scans with linked multipart credentials; native DataFrame functions only.

Base spans are found by three patterns and always reported. Weak candidates are reported only if
complementary parts lie in one scope: apart from the candidate (no shared character), with at most SCOPE code points between.
- `weak` (a token of mixed case and digits) with an identifier (`access` or `ident`) in scope,
- `ident` (an account, user or client id) with a secret (`assign`, `hex` or `weak`) in scope,
- `endpoint` (a URL or IPv4 address) with both an identifier and a secret in scope.
A weak candidate that overlaps a base span is part of it and not reported.

Method: interval join. The texts are scanned once and their spans written. Ends of parts are binned by the scope's size and joined with
the candidates that begin in the same or the next bin, starts with those that end in the same or the one before. A
bin's positions are one array of at most SCOPE for either side, so no pairs of parts are made, however many a scope holds.

Cases: null text is empty; no spans give zeros, the hash of no bytes and an empty string; spans of one
place are in the order of KINDS; repeated rows each keep a row; other columns stay out; offsets
count code points; a text's matches are rows, so a long text with many stays within memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.text import has_any
from sievemark.llm.scratch import Scratch, aside

SCOPE = 256


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Names and shapes of credentials.
_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_OWNERS = "|".join(map(either_case, ("username", "user", "login", "account", "client_id", "key_id")))
_JOIN = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": rf"(?:{_NAMES}){_JOIN}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "weak": r"[A-Za-z0-9+/_-]{16,}",
    "ident": rf"(?:{_OWNERS}){_JOIN}[A-Za-z0-9@._-]+",
    "endpoint": r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}""",
}
KINDS = list(PATTERNS)
BASE, IDENTIFIERS, SECRETS = KINDS[:3], ("access", "ident"), ("assign", "hex", "weak")
#: A mixed token has each of these.
_MIXED = ("[A-Z]", "[a-z]", "[0-9]")


def _may(text: Column, kind: str) -> Column:
    """What a text must have for a match: a word that it begins with, or a mark that it holds."""
    if kind == "assign":
        return has_any(F.lower(text), ["password", "passwd", "secret", "token", "api"])
    if kind == "ident":
        return has_any(F.lower(text), ["user", "login", "account", "client_id", "key_id"])
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    return F.contains(text, F.lit("://")) | F.contains(text, F.lit(".")) if kind == "endpoint" else F.lit(True)


def may_hold(text: Column) -> Column:
    """Whether a span can be reported: there may be a base span, or an identifier and a token. Few texts without any pass."""
    found = {k: _may(text, k) & F.rlike(text, F.lit(PATTERNS[k])) for k in KINDS}
    long = F.rlike(text, F.lit(PATTERNS["assign"].removesuffix("+)") + "{6,})"))  # matches may begin inside a shorter one, so some have none
    return (found["assign"] & long) | found["access"] | found["hex"] | (found["ident"] & found["weak"])


def _kept(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 1)) >= 6
    if kind == "weak":
        return F.rlike(match, F.lit(_MIXED[0])) & F.rlike(match, F.lit(_MIXED[1])) & F.rlike(match, F.lit(_MIXED[2]))
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Structs of each match: kind, number, code points since the match before, code points, kept."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(F.transform(gaps, F.length), 1, F.size(found)), lambda m, g: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), g.alias("gap"), F.length(m).alias("size"), _kept(kind, m).alias("kept")))
    return F.when(_may(text, kind) & F.rlike(text, F.lit(pattern)), F.transform(pairs, lambda p, i: F.struct(p["kind"].alias("kind"), p["rank"].alias("rank"), i.alias("i"), p["gap"].alias("gap"), p["size"].alias("size"), p["kept"].alias("kept")))).otherwise(F.array())


def spans(documents: DataFrame) -> DataFrame:
    """(row, doc_id, kind, rank, start, end) of all reported spans of documents(doc_id, text); a row without any has one row with a null kind."""
    text = F.coalesce("text", F.lit(""))
    empty = "array<struct<kind:string,rank:int,i:int,gap:int,size:int,kept:boolean>>"
    each = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(_matches(text, k).cast(empty) for k in KINDS)).alias("all"))
    each = each.select("row", "doc_id", F.explode_outer("all").alias("m")).select("row", "doc_id", "m.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(before))
    placed = placed.withColumn("start", F.col("end") - F.col("size")).withColumn("kind", F.when(F.col("kept"), F.col("kind")))
    is_base = F.col("kind").isin(*BASE)
    up = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(up) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(is_base, F.col("start"))).over(down) < F.col("end"), F.lit(False))
    placed = placed.withColumn("inside", inside)
    placed = placed.withColumn("kind", F.when(is_base | ~F.col("inside"), F.col("kind"))).select("row", "doc_id", "kind", "rank", "start", "end")
    return _linked(Scratch(documents.sparkSession, "secret-scan").table(placed, "spans"))


def _near(placed: DataFrame, side: str, steps: tuple[int, int]) -> DataFrame:
    """(row, bin, identifier, secret): the places of this side of parts that candidates of a bin can have in scope."""
    parts = placed.where(F.col("kind").isin(*IDENTIFIERS, *SECRETS))
    bins = F.array(*(F.expr(f"{side} div {SCOPE}") + d for d in steps))
    each = parts.select("row", F.explode(bins).alias("bin"), F.col(side).alias("at"), F.col("kind").isin(*IDENTIFIERS).alias("names"))
    return each.groupBy("row", "bin").agg(F.collect_set(F.when(F.col("names"), F.col("at"))).alias("identifier"), F.collect_set(F.when(~F.col("names"), F.col("at"))).alias("secret"))


def _linked(placed: DataFrame) -> DataFrame:
    before, after = _near(placed, "end", (0, 1)).alias("before"), _near(placed, "start", (0, -1)).alias("after")
    met = placed.withColumns({"at_start": F.expr(f"start div {SCOPE}"), "at_end": F.expr(f"end div {SCOPE}")}).alias("x")
    for near, own in ((before, "at_start"), (after, "at_end")):
        side = "before" if near is before else "after"
        met = met.join(near.hint("shuffle_merge"), (F.col("x.row") == F.col(f"{side}.row")) & (F.col(f"x.{own}") == F.col(f"{side}.bin")), "left")

    def near(name: str) -> Column:
        back = F.exists(f"before.{name}", lambda e: (e <= F.col("x.start")) & (F.col("x.start") - e <= SCOPE))
        ahead = F.exists(f"after.{name}", lambda s: (s >= F.col("x.end")) & (s - F.col("x.end") <= SCOPE))
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    kind = F.col("x.kind")
    stays = kind.isin(*BASE) | ((kind == "weak") & near("identifier")) | ((kind == "ident") & near("secret")) | ((kind == "endpoint") & near("identifier") & near("secret"))
    return met.select("x.row", "x.doc_id", F.when(stays, kind).alias("kind"), "x.rank", "x.start", "x.end")


def scan(documents: DataFrame) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end joined by commas)."""
    found = spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "rank", "end", "kind"))
    by_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum((F.coalesce(F.col("kind"), F.lit("")) == k).cast("long")).alias(f"n_{k}") for k in BASE), F.array_sort(F.collect_list(span)).alias("found"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return by_row.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def without_secrets(documents: DataFrame) -> DataFrame:
    """documents without the rows in which a span is reported, with all columns. Only the few texts that may hold one are written aside and joined."""
    suspect = may_hold(F.coalesce("text", F.lit("")))
    moved, back = aside(documents, "th")
    held = Scratch(documents.sparkSession, "secret-suspects").table(moved.where(suspect).withColumn("th", F.sha2("text", 256)), "held")
    found = spans(held.select(F.col("th").alias("doc_id"), "text")).where("kind is not null").select(F.col("doc_id").alias("th")).distinct()
    cleared = held.join(found.hint("shuffle_merge"), "th", "left_anti").drop("th").withColumnsRenamed(back).select(documents.columns)
    return documents.where(~suspect).unionByName(cleared)
