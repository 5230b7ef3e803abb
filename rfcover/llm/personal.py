"""Personal data in descriptions: proposed spans, scored by boosted trees, all in column expressions."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# The base forms, in the order in which their spans are listed. Groups at the end
# repeat possessively, which Java matches in a loop; else a very long match overflows its stack.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
# Proposals beyond the base forms: runs that secrets, account numbers and handles look like.
# An equals sign ends a run, unless it pads its end, so that a key and its value are two runs.
PROPOSALS = {
    "secret": r"[A-Za-z0-9_/+-]{16,}+(?:={1,2}(?![A-Za-z0-9_/+=-]))?",
    "assigned": r"""(?<=(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key)["']?[ ]{0,3}[=:][ ]{0,3}["']?)[^\s"'=,;:\[\]()]{6,64}""",
    "number": r"[0-9][0-9 ().-]{5,}[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "handle": r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9.-]+",
}
WORTH = {
    "secret": "[A-Za-z0-9_/+-]{16}", "assigned": """(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key)["']? {0,3}[=:]""", "number": "[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}[ A-Z0-9]", "handle": r"[(\[]at[)\]]",
}
NAMED = {"assigned": "secret"}
CUES = r"(?i)(token|secret|passw|pwd|key|auth|bearer|iban|account|card|phone|tel|mail|ssn)\w*\W*$"
# Formats that mark a proposal as personal by themselves.
HANDLE = r"^[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\.?$"
GROUPED = r"^[0-9]{2,5}\)?(?:[ .-]{1,2}\(?[0-9]{2,5}\)?){2,6}$"
NOT_GROUPED = r"^(?:19|20)[0-9]{2}[-. ][0-9]{2}[-. ][0-9]{2}\b|^[0-9]{2}[-. ][0-9]{2}[-. ](?:19|20)[0-9]{2}\b|^[0-9]{1,3}(?:[ .][0-9]{3})+$"
FEATURES = ("length", "digits", "upper", "lower", "marks", "kinds", "cue", "quoted", "assigned", "hexadecimal", "check_digit", "handle_form", "grouped_form")
# Texts that show each format to the trees, since a sample may hold none of them.
SEEDS = (
    "write to john (at) example.com today", "ask ann.b [at] relay.example.org", "jo(at)site.net is gone", "from m_k [at] mail.example.co.uk.", "see eve.long-name (at) harbour-radio.example.com",
    "call 202-555-0147 now", "ring (020) 7946 0958 after six", "06 12 34 56 78 at noon", "desk 030 901 820 44", "number 415.555.0132 again", "his 078-05-1120 was seen", "her file 219-09-9999 too",
    "pay GB82 WEST 1234 5698 7654 32 at once", "pay to DE89370400440532013000 today", "from NL91ABNA0417164300 to us", "via FR1420041010050500013M02606 then", "sent BE68 5390 0754 7034 it",
    "api_key=9f8e7d6c5b4a39281706f5e4d3c2b1a0 set", "password=hunter2horse8 works", "the secret: aB3dE6gH9jK2mN5pQ8 here", "client_secret='Zx81-kQ77_pL09wM52' ok", "password = tr0ub4dor&3", "auth_token=ab12cd34ef56ab78cd90== end",
    "on 2024-01-02 10:20 we left", "in 10 000 000 pieces", "the 02.03.2021 edition", "order 12345678 came", "sum 1234567.89 of it", "commit 9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c was made",
    "see /usr/share/doc/package-2024/readme", "build linux-x86_64-release-12 ran", "a 3.14159265358979 circle", "item AB12CDEF34567890123 sold", "from 1990-2000 and 2001-2010", "meet (at) noon with 4 men", "rows 100000 to 2000000",
)
FIT_PARTS = 32  # fixed, so that the fit does not depend on how the input is cut
SCORE_STEPS = 10_000


def _spans(text: Column, found: Column, pieces: Column) -> Column:
    """(start, stop, value) of matches: the pieces between them and the matches give the places."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("out"))
    # paired before the fold: an array named inside a fold would be searched for again at each step
    pairs = F.zip_with(pieces, found, lambda piece, value: F.struct(F.char_length(piece).alias("gap"), value.alias("value")))

    def step(acc, x):
        start = acc.at + x.gap
        stop = start + F.char_length(x.value)
        return F.struct(stop.alias("at"), F.concat(acc.out, F.array(F.struct(start.alias("start"), stop.alias("stop"), x.value.alias("value")))).alias("out"))

    # the piece after the last match has no value
    return F.aggregate(F.filter(pairs, lambda x: x.value.isNotNull()), zero, step, lambda acc: acc.out)


def _matches(text: Column, pattern: str, worth: Column) -> Column:
    """The spans of a pattern; texts that cannot hold one (``worth``) are not searched."""
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(worth & (F.size(found) > 0), _spans(text, found, F.split(text, pattern, -1))).otherwise(none)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(digits, i, F.lit(1)).cast("int") * 2) - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _mod_97(value: Column) -> Column:
    """Whether the check digits of an account number in IBAN form are right."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))

    def step(acc, c):
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    fits = value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$") & F.char_length(plain).between(15, 34)
    return F.when(fits, F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1).otherwise(False)


def _grouped(value: Column) -> Column:
    return value.rlike(GROUPED) & ~value.rlike(NOT_GROUPED) & F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def _parts_fit(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind: leftmost, without overlap, failing matches dropped."""
    digit = text.rlike("[0-9]")
    count = lambda s: F.length(F.regexp_replace(s.value, "[^0-9]", ""))
    return {
        "email": _matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(_matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: _parts_fit(s.value)),
        "card": F.filter(_matches(text, CARD, text.rlike("[0-9](?:[ -]?[0-9]){15}") & digit), lambda s: _luhn(s.value)),
        "phone": F.filter(_matches(text, PHONE, text.contains("+")), lambda s: count(s).between(8, 15)),
    }


def _features(text: Column, s: Column) -> list[Column]:
    value = s.value
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    share = lambda p: F.char_length(F.regexp_replace(value, p, "")) / n
    before = F.substring(text, F.greatest(s.start - 23, F.lit(1)), F.least(s.start, F.lit(24)))
    ahead = F.substring(text, s.start, F.lit(1))
    changes = F.char_length(F.regexp_replace(value, "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", "x")) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        n, share("[^0-9]"), share("[^A-Z]"), share("[^a-z]"), share("[A-Za-z0-9]"), changes,
        flag(before.rlike(CUES)), flag(ahead.rlike("[\"']")), flag(before.rlike(r"[=:]\W*$")), flag(value.rlike("^[0-9a-fA-F]+$")), flag(_luhn(value) | _mod_97(value)), flag(value.rlike(HANDLE)), flag(_grouped(value)),
    ]


def propose(features: DataFrame) -> DataFrame:
    """(feature_id, description, base, proposals): base spans by kind, and high-recall candidates with their features."""
    text = F.col("description")
    base = base_spans(text)
    rows = features.select("*", *[c.alias(f"b_{k}") for k, c in base.items()])
    named = []
    for kind, pattern in PROPOSALS.items():
        spans = F.filter(_matches(text, pattern, text.rlike(WORTH[kind])), lambda s: s.value.rlike("[0-9]") if kind in ("secret", "assigned") else F.lit(True))  # noqa: B023
        named.append(F.transform(spans, lambda s: F.struct(F.lit(NAMED.get(kind, kind)).alias("kind"), s.start.alias("start"), s.stop.alias("stop"), *[c.alias(n) for n, c in zip(FEATURES, _features(text, s))])))  # noqa: B023
    return rows.withColumn("proposals", F.concat(*named))


def _covered(s: Column) -> Column:
    """Whether a base span overlaps it."""
    own = [F.exists(F.col(f"b_{k}"), lambda b: (b.start < s.stop) & (s.start < b.stop)) for k in KINDS]
    return own[0] | own[1] | own[2] | own[3]


def _inside(s: Column) -> Column:
    """Whether it lies wholly in a base span."""
    own = [F.exists(F.col(f"b_{k}"), lambda b: (b.start <= s.start) & (s.stop <= b.stop)) for k in KINDS]
    return own[0] | own[1] | own[2] | own[3]


def _unions(spans: Column) -> Column:
    """Overlapping spans as one, named after the first of them, of equal starts the longest."""
    kind = "array<struct<kind:string,start:int,stop:int>>"
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.stop).alias("back"), s.kind.alias("kind"))))
    begin = F.struct(F.lit("").alias("kind"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.array().cast(kind).alias("out"))
    last = lambda acc: F.when(acc.stop < 0, acc.out).otherwise(F.concat(acc.out, F.array(F.struct(acc.kind.alias("kind"), acc.start.alias("start"), acc.stop.alias("stop")))))

    def step(acc, s):
        joined = s.start < acc.stop
        return F.struct(
            F.when(joined, acc.kind).otherwise(s.kind).alias("kind"), F.when(joined, acc.start).otherwise(s.start).alias("start"),
            F.when(joined, F.greatest(acc.stop, -s.back)).otherwise(-s.back).alias("stop"), F.when(joined, acc.out).otherwise(last(acc)).alias("out"),
        )

    return F.aggregate(order, begin, step, last)


def train_trees(features: DataFrame, trees: int = 10, depth: int = 4):
    """Boosted trees over the proposals of all texts, and a threshold.

    No labels exist, so rules stand for them: a proposal is personal if it overlaps a base
    span, if its own format says so (a handle with a domain, a number in groups that is no date
    or amount, right check digits), or if it follows a cue with an assignment and is hexadecimal
    or mixed; others are not. The trees see format and context. Equal proposals are one row with
    their number as weight. ``SEEDS`` are learned from too, with a fifth of the weight of all
    proposals, so that formats rare in the texts are known. The threshold is the least score, in steps of
    1 / ``SCORE_STEPS``, at which nine tenths of all proposals above it are personal, but at least 0.5.
    """
    def marked(texts):
        fits = lambda s: (s.check_digit > 0) | (s.handle_form > 0) | (s.grouped_form > 0) | ((s.cue > 0) & (s.assigned > 0) & ((s.hexadecimal > 0) | (s.kinds > 0.1)))
        each = F.transform("proposals", lambda s: F.struct(s.alias("s"), (_covered(s) | fits(s)).alias("personal")))
        rows = propose(texts).select(F.explode(each).alias("m"))
        return rows.select(*[F.col(f"m.s.{c}").alias(c) for c in FEATURES], F.col("m.personal").cast("double").alias("label"))

    key = [*FEATURES, "label"]
    rows = stage(marked(features).groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("times")), "span-proposals")
    n = rows.agg(F.sum("times").alias("n")).first().n
    if not n:
        return F.lit(0.0), 0.5
    seeds = features.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("feature_id"), F.explode(F.array(*map(F.lit, SEEDS))).alias("description"))
    seeds = stage(marked(seeds).withColumn("times", F.lit(1.0)), "span-seeds")
    weight = max(1.0, 0.2 * n / max(1, seeds.count()))
    rows = rows.withColumn("weight", F.col("times")).unionByName(seeds.withColumn("weight", F.lit(weight)))
    rows = rows.repartition(FIT_PARTS, *FEATURES).sortWithinPartitions(*key, "weight")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=5).fit(vectors)
    text = None
    for tree, weight in zip(model.trees, model.treeWeights):
        one = f"({weight!r}D * {_tree_sql(tree._call_java('rootNode'))})"
        text = one if text is None else f"{text} + {one}"
    # calibration on all proposals: counts per step of the score
    step = F.floor(F.expr(f"1 / (1 + exp(-2 * ({text.replace('@', '')})))") * SCORE_STEPS).alias("step")
    steps = rows.groupBy(step).agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("label")).alias("good")).collect()  # at most SCORE_STEPS + 1 rows
    best, good, n = SCORE_STEPS, 0.0, 0.0
    for r in sorted(steps, key=lambda r: -r.step):
        good, n = good + r.good, n + r.n
        if 2 * r.step >= SCORE_STEPS and good >= 0.9 * n:
            best = r.step
    return text, (best / SCORE_STEPS if best < SCORE_STEPS else 0.5)


def _tree_sql(node) -> str:
    """A regression tree as nested CASE; ``@`` stands before each feature's name."""
    if node.subtreeDepth() == 0:
        return f"({node.prediction()!r}D)"
    name, at = FEATURES[node.split().featureIndex()], node.split().threshold()
    return f"CASE WHEN @{name} <= {at!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END"


def _spans_by_trees(rows: DataFrame, keep: list[str]) -> DataFrame:
    text, threshold = train_trees(rows.select("feature_id", "description"))
    proposed = propose(rows)
    kind = "array<struct<kind:string,start:int,stop:int>>"
    base = F.concat(*[F.transform(f"b_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s.start.alias("start"), s.stop.alias("stop"))) for k in KINDS])  # noqa: B023
    if isinstance(text, str):
        kept = F.expr(f"filter(proposals, s -> 1 / (1 + exp(-2 * ({text.replace('@', 's.')}))) >= {threshold!r}D)")
    else:
        kept = F.expr("filter(proposals, s -> false)")
    # what lies wholly in a base span is listed by it already
    beyond = F.filter(kept, lambda s: ~_inside(s))
    return proposed.select("feature_id", *keep, base.cast(kind).alias("base"), beyond.alias("p")).select("feature_id", *keep, "base", F.concat("base", _unions(F.col("p")).cast(kind)).alias("spans"))


def personal_spans(features: DataFrame) -> DataFrame:
    """Spans of personal data in feature descriptions.

    ``features`` has ``feature_id`` and ``description``; other columns are not read. Base spans
    are e-mail addresses, IPv4 addresses, card numbers with a right check digit and phone
    numbers with a plus. Generators with high recall propose further, overlapping spans: long
    runs of letters and digits, values after words for secrets, groups of digits, account numbers, handles. Boosted trees over format and
    context features, fitted on the proposals of all descriptions, score them; those above a
    calibrated threshold are added, overlapping ones as their union, unless one lies wholly in a base span; an
    added span may overlap base spans. The trees become one column
    expression, so scoring is a single pass without a shuffle and without Python.

    Result, a row per input row: ``feature_id``, ``base`` (array of (kind, start, stop) in the
    order of ``KINDS``, then start), ``spans`` (base and added ones), in code points, stop
    exclusive. A null or empty description has none; a null feature_id is kept; repeated rows are each
    reported; an empty table gives no rows.
    """
    rows = features.select(F.col("feature_id").cast("bigint"), F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description"))
    return _spans_by_trees(rows, [])


def redact_descriptions(features: DataFrame) -> DataFrame:
    """``features`` with all its columns and ``redacted``: the description with each span of
    ``personal_spans`` replaced by its kind, as in ``[email]``.

    Spans that overlap or touch are replaced as one, named after the first. A null description stays null.
    """
    rows = features.select(F.struct(*features.columns).alias("row"), F.col("feature_id").cast("bigint"), F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description"))
    found = _spans_by_trees(rows, ["row", "description"])
    text = F.col("description")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc.at + 1, F.greatest(s.start - acc.at, F.lit(0)))
        mark = F.when((s.start > acc.at) | (acc.at == 0), F.concat(gap, F.lit("["), s.kind, F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc.at, s.stop).alias("at"), F.concat(acc.out, mark).alias("out"))

    whole = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.char_length(text))))
    return found.select("row.*", F.when(F.col("row.description").isNotNull(), F.when(F.size("spans") > 0, whole).otherwise(text)).alias("redacted"))
