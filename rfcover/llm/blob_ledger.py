"""Secrets in saved files: every content is scanned once per rule version, by a ledger of blobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOUND = "array<struct<rule:string,start:int,stop:int>>"
LEDGER = f"blob string, rules array<string>, findings {FOUND}"
SLOTS = 16  # the files of one blob are joined to its findings in so many groups


@dataclass(frozen=True)
class Rule:
    """A pattern, and which of its matches count; a change of either is a new ``version``.

    ``worth`` is a cheap condition on a text that must hold where the pattern can match.
    """

    name: str
    version: int
    pattern: str
    worth: Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base rules, in the order in which their findings are listed.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?"""
)
VALUE = "[A-Za-z0-9+/_.=-]"
BASE_RULES = (
    Rule("assign", 1, ASSIGN + VALUE + "+", lambda t: t.rlike(ASSIGN + VALUE + "{8}"), lambda v: F.char_length(F.regexp_replace(v, "^" + ASSIGN, "")) >= 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", lambda t: t.contains("AKIA")),
    Rule("hex", 1, "[0-9a-f]{32,}", lambda t: t.rlike("[0-9a-f]{32}")),
)
# Rules beyond the base: forms that mark a secret by themselves.
ADDED_RULES = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda t: t.contains("eyJ")),
    Rule("private_key", 1, "-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\\s]{32,}", lambda t: t.contains("PRIVATE KEY-----")),
    Rule("repository", 1, "(?:gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,})", lambda t: t.contains("_") | t.contains("glpat-")),
    Rule("chat", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", lambda t: t.contains("xox")),
    Rule("map_key", 1, "(?:AIza[A-Za-z0-9_-]{35}|[ps]k\\.eyJ[A-Za-z0-9_-]{20,}\\.[A-Za-z0-9_-]{16,}|pk\\.[0-9a-f]{32})", lambda t: t.contains("AIza") | t.contains("k.")),
    Rule("bearer", 1, "[bB]earer [A-Za-z0-9+/_.=-]{20,}", lambda t: t.contains("earer ")),
    Rule("login", 1, "[a-z][a-z0-9+.-]{1,15}://[^\\s/:@\"'<>]{1,64}:[^\\s/:@\"'<>]{3,64}@", lambda t: t.contains("://")),
)
RULES = BASE_RULES + ADDED_RULES


def places(pieces: Column, found: Column) -> Column:
    """(start, stop, value) of matches, from the pieces between them.

    Places are running sums. They are folded in slices of about the square root of their number,
    so that an array never grows one by one over all matches: linear but for that root.
    """
    one = "struct<start:int,stop:int,value:string>"
    size = F.size(found)
    pairs = F.slice(F.zip_with(pieces, found, lambda p, v: F.struct(F.char_length(p).alias("gap"), v.alias("value"))), F.lit(1), size)
    width = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
    cut = F.struct(pairs.alias("pairs"), width.alias("width"))

    def whole(x):
        firsts = F.sequence(F.lit(0), F.size(x["pairs"]) - 1, x["width"])
        slices = F.transform(firsts, lambda i: F.slice(x["pairs"], i + 1, x["width"]))
        taken = F.transform(slices, lambda s: F.struct(s.alias("s"), F.aggregate(s, F.lit(0), lambda acc, p: acc + p["gap"] + F.char_length(p["value"])).alias("n")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,s:array<struct<gap:int,value:string>>>>").alias("out"))
        begun = F.aggregate(
            taken, start,
            lambda acc, t: F.struct((acc["at"] + t["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), t["s"].alias("s")))).alias("out")),
            lambda acc: acc["out"],
        )

        def step(acc, p):
            a = acc["at"] + p["gap"]
            b = a + F.char_length(p["value"])
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("stop"), p["value"].alias("value")))).alias("out"))

        folded = F.transform(begun, lambda t: F.aggregate(t["s"], F.struct(t["at"].alias("at"), F.array().cast(f"array<{one}>").alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(folded)

    # named once, inside a lambda, so that its parts are not computed for each use
    return F.flatten(F.transform(F.array(cut), whole))


def matches(text: Column, rule: Rule) -> Column:
    """Leftmost, non-overlapping matches of a rule as (rule, start, stop); those that fail its condition are dropped."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.filter(places(F.split(text, rule.pattern, -1), found), (lambda s: rule.keep(s["value"])) if rule.keep else (lambda s: F.lit(True)))
    spans = F.transform(kept, lambda s: F.struct(F.lit(rule.key).alias("rule"), s["start"].alias("start"), s["stop"].alias("stop")))
    return F.when(rule.worth(text) & text.rlike(rule.pattern), spans).otherwise(F.array().cast(FOUND))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What a ledger holds: per blob and run the rule versions that were tried, and their findings."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(LEDGER).parquet(folder)


def _tried(ledger: DataFrame) -> DataFrame:
    """A row per blob: all rule versions tried, and all findings."""
    rules = F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules")
    return ledger.groupBy("blob").agg(rules, F.flatten(F.collect_list("findings")).alias("findings"))


def _once(ordered: Column) -> Column:
    """An ordered array without repeats, such as two runs at the same time leave in the ledger."""
    kept = lambda x: F.filter(x["all"], lambda s, i: (i == 0) | (s != F.get(x["all"], i - 1)))
    return F.flatten(F.transform(F.array(F.struct(ordered.alias("all"))), kept))


def _files(files: DataFrame) -> DataFrame:
    saved = F.col("saved_at") if "saved_at" in files.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("value").cast("string"), F.lit(""))
    return files.select("doc_id", saved.alias("saved_at"), F.sha2(text, 256).alias("blob"), text.alias("value"))


def unseen_blobs(files: DataFrame, folder: str, rules=RULES) -> DataFrame:
    """(blob, value, rules): each content once, with the rule versions that the ledger has not tried on it."""
    blobs = _files(files).groupBy("blob").agg(F.first("value").alias("value"))
    seen = _tried(read_ledger(files.sparkSession, folder)).select("blob", F.col("rules").alias("seen"))
    current = F.array(*[F.lit(r.key) for r in rules])
    left = blobs.join(seen, "blob", "left").select("blob", "value", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
    return left.where(F.size("rules") > 0)


def scan_files(files: DataFrame, folder: str, rules=RULES) -> DataFrame:
    """Secrets in all saved versions of files, such as missions and imported tables.

    ``files`` has ``doc_id`` (a file's path), ``value`` (its whole text) and may have ``saved_at`` (its
    version); other columns are not read. A content is addressed by its SHA-256, so the versions
    and copies of a file that say the same are one blob. The ledger, a table in ``folder`` (on a
    cluster a shared one), lists per blob the rule versions tried and what they found. Only pairs
    of blob and rule version that it lacks are scanned, in one pass per blob, and appended by one
    commit: a run that fails leaves the ledger as it was, and the next one scans what is missing.
    Findings are then joined back to all files. Copies are folded before the shuffle and files
    of one blob are joined in several groups. All of it is column expressions.

    Result, a row per input row: ``doc_id``, ``saved_at``, ``blob``, ``findings`` (array of (rule, start, stop) in the
    order of start, then of ``rules``; code points, stop exclusive; ``rule`` is the name). Findings of rules and
    versions that are not in ``rules`` stay in the ledger and are not listed. A null or empty text is the empty blob,
    without findings; a null doc_id is kept; repeated rows are each reported; an empty table gives no rows.
    """
    spark = files.sparkSession
    text = F.col("value")
    none = F.array().cast(FOUND)
    tried = [F.when(F.array_contains("rules", r.key), matches(text, r)).otherwise(none) for r in rules]
    new = unseen_blobs(files, folder, rules).select("blob", "rules", F.concat(*tried).cast(FOUND).alias("findings"))
    new.write.mode("append").parquet(folder)

    order = F.array(*[F.lit(r.key) for r in rules])
    listed = F.array_sort(F.transform(
        F.filter("findings", lambda s: F.array_contains(order, s["rule"])),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("at"), s["stop"].alias("stop"), F.substring_index(s["rule"], "@", 1).alias("rule")),
    ))
    found = _tried(read_ledger(spark, folder).where(F.size("findings") > 0)).select(
        "blob", F.transform(_once(listed), lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("findings")
    )
    found = found.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    # the number of the row's task and row only deals the files of a blob out; it decides no result
    paths = _files(files).select("doc_id", "saved_at", "blob", F.pmod(F.xxhash64("doc_id", "saved_at", F.monotonically_increasing_id()), F.lit(SLOTS)).cast("int").alias("slot"))
    return paths.join(found, ["blob", "slot"], "left").select("doc_id", "saved_at", "blob", F.coalesce("findings", none).alias("findings"))
