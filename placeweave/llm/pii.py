"""Personal data: base formats, and overlapping proposals of other spellings judged by boosted trees."""

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from placeweave.llm.native import fresh, joined, let, read, spans
from placeweave.llm.store import removed, stored

# The formats of the base rules. Starts are bound to the front of a run or to the end of
# the last match, which finds the same matches without trying every start of a long run.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = f"(?:\\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9]++(?:[\\x20-][0-9]++)*+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators of proposals: numbers with separators, dotted addresses (also defanged ones), tokens with an at sign,
#: colon groups, spelled-out mails, account numbers. They overlap each other and the base spans.
AT_WORD, DOT_WORD = "(?: (?:at|AT) | ?[\\[({] ?(?:at|AT) ?[\\])}] ?)", "(?: (?:dot|DOT) | ?[\\[({] ?(?:dot|DOT|\\.) ?[\\])}] ?)"
GENERATORS = [
    ("[(+]?[0-9]++(?:[ ()./-]{1,3}[0-9]++)++|[0-9]{5,}+", "[0-9]"),
    (f"(?<![0-9.])[0-9]{{1,3}}(?:(?:\\.|{DOT_WORD})[0-9]{{1,3}}){{3}}(?![0-9])", "[0-9](?: ?[\\[({]| (?:dot|DOT) |\\.)[^\n]"),
    ("(?<![^\\x20\\x09-\\x0D@])[^\\x20\\x09-\\x0D@]++@[^\\x20\\x09-\\x0D@]+", "@"),
    ("(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])", ":[0-9A-Fa-f]{0,4}:"),
    (f"(?<!{LOCAL}){LOCAL}{{1,64}}+{AT_WORD}[A-Za-z0-9-]++(?:(?:\\.|{DOT_WORD})[A-Za-z0-9-]++)++",
     "[ \\[({](?:at|AT)[ \\])}]"),
    ("(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
]
NEAR = 40
PERSONAL = (
    "(?i)\\b(?:e-?mail|mail|write|phone|tel|telephone|fax|call|mobile|cell|contact|card|account|iban|address|konto"
    "|kontakt|telefon|handy|correo|tel[eé]fono|tarjeta|carte|courriel|t[eé]l[eé]phone|compte|ip)\\b[^\\n]*$"
)
OTHER = (
    "(?i)(?:\\b(?:version|v|year|page|p|no|nr|order|invoice|isbn|issn|art|licen[cs]e|chapter|section|item|ref|price|total"
    "|since|until|date|table|figure|fig|seite|jahr|preis|datum|page|prix|fecha|precio|by(?:-[a-z]{2})*)\\b[^\\n]{0,12}"
    "|[#§$€£])\\W*$"
)
YEAR = "(?:19|20)[0-9]{2}"
LOOKALIKE = (
    f"^(?:{YEAR}[-./][0-9]{{1,2}}[-./][0-9]{{1,2}}|[0-9]{{1,2}}[-./][0-9]{{1,2}}[-./](?:{YEAR}|[0-9]{{2}})"
    f"|{YEAR} ?[-/] ?(?:{YEAR}|[0-9]{{2}})|[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?|[0-9]{{1,3}}[./][0-9]{{1,3}}(?:[./][0-9]{{1,3}})?)$"
)
FEATURES = ["length", "n_digits", "n_groups", "longest", "n_marks", "n_letters", "bracket", "year", "zero", "check_digit",
            "mixed", "lookalike", "letter_before", "letter_after", "personal", "other"]
FIT_ROWS = 20_000


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits, for up to 19 digits; longer ones are not looked at."""

    def total(d):
        n = F.length(d)
        one = lambda i: F.substr(d, n - i, F.lit(1)).cast("int")
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0),
            lambda a, i: a + F.when(i % 2 == 0, one(i)).otherwise((one(i) * 2) % 10 + (one(i) * 2 / 10).cast("int")),
        )

    return let(digits, lambda d: F.when(F.length(d).between(1, 19), total(d) % 10 == 0).otherwise(False))


def base_spans(text: Column) -> Column:
    """Array of (rank, start, stop, kind): matches of the base formats that pass their checks."""

    def kind(name, pattern, guard, keep):
        return F.transform(
            F.filter(spans(text, pattern, guard), keep),
            lambda s: F.struct(
                F.lit(KINDS.index(name)).alias("rank"), s["start"].alias("start"),
                s["stop"].alias("stop"), F.lit(name).alias("kind"),
            ),
        )

    count = lambda s: F.length(digits_of(s["hit"]))
    return F.concat(
        kind("email", EMAIL, F.contains(text, F.lit("@")), lambda s: F.length(s["hit"]) > 0),
        kind("ip", IP, text.rlike("[0-9]\\.[0-9]"), lambda s: s["hit"].rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")),
        kind("card", CARD, text.rlike("(?:[0-9][\\x20-]?){15}[0-9]"),
             lambda s: count(s).between(16, 19) & luhn(digits_of(s["hit"]))),
        kind("phone", PHONE, F.contains(text, F.lit("+")), lambda s: count(s).between(8, 15)),
    )


def account_check(hit: Column) -> Column:
    """Whether an account number leaves the remainder 1 by 97, letters counted from 10."""
    plain = F.regexp_replace(hit, " ", "")
    signs = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.filter(signs, lambda c: c != ""), F.lit(0),
        lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97,
    ) == 1


def features(hit: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a proposal; the marks of the base formats themselves (plus, at sign) are no features."""
    n = lambda chars: F.length(F.regexp_replace(hit, chars, ""))
    flag = lambda c: c.cast("int")
    made = {
        "length": F.least(F.length(hit), F.lit(64)), "n_digits": F.least(n("[^0-9]+"), F.lit(64)),
        "n_groups": F.least(F.regexp_count(hit, F.lit("[0-9]+")), F.lit(32)),
        "longest": F.coalesce(
            F.array_max(F.transform(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0)),
        "n_marks": F.least(F.regexp_count(hit, F.lit("[ ()./:-]+")), F.lit(32)),
        "n_letters": F.least(n("[^A-Za-z]+"), F.lit(64)), "bracket": flag(hit.rlike("[\\[({]")),
        "year": flag(hit.rlike(f"(?<![0-9]){YEAR}(?![0-9])")), "zero": flag(hit.rlike("^[^0-9]*0")),
        "check_digit": flag(let(digits_of(hit), lambda d: F.length(d).between(13, 19) & luhn(d))),
        "mixed": flag(hit.rlike("[A-Za-z][0-9._]|[0-9._][A-Za-z]")), "lookalike": flag(hit.rlike(LOOKALIKE)),
        "letter_before": flag(before.rlike("\\p{L}$")), "letter_after": flag(after.rlike("^\\p{L}")),
        "personal": flag(before.rlike(PERSONAL)), "other": flag(before.rlike(OTHER) | after.rlike("^ ?[$€£%]")),
    }
    return {name: F.coalesce(made[name], F.lit(0)).cast("int") for name in FEATURES}


def proposals(text: Column, base: Column) -> Column:
    """High-recall spans of all generators: start, stop, ``generator``, ``base``, ``masked``, ``label``, features.

    ``base``: overlaps a base span, so it is never added. ``label`` is 1 for a proposal that is a base span (at least
    half of the longer one is common to both) or passes a check of its own (account numbers, whole addresses of
    colon groups, cards of four groups in other separators); 0 for look-alikes (dates, versions, prices, numbers
    after words such as page or order, long numbers whose check digit fails, at signs without a domain); null for
    all others, which the trees decide on. Base spans come once more as ``masked`` proposals in a spelling that no base format
    reads, in the context where they stand: the country code cut, dots defanged, the at sign spelled out. Masked
    ones are there to learn from only.
    """

    def judged(found):
        """``found`` (start, stop, hit, generator, masked) with context, then features, then the label, each computed once."""

        def context(s):
            left = F.greatest(s["start"] - NEAR, F.lit(0))
            near = F.substr(text, left + 1, s["stop"] - left + 2)
            return F.struct(s.alias("s"), (s["start"] - left).alias("lead"), near.alias("near"))

        def measured(c):
            s = c["s"]
            before = F.substr(c["near"], F.lit(1), c["lead"])
            after = F.substr(c["near"], c["lead"] + s["stop"] - s["start"] + 1, F.lit(2))
            f = features(s["hit"], before, after)
            overlap = lambda b: F.least(b["stop"], s["stop"]) - F.greatest(b["start"], s["start"])
            longer = lambda b: F.greatest(b["stop"] - b["start"], s["stop"] - s["start"])
            return F.struct(
                s.alias("s"), F.exists(base, lambda b: overlap(b) > 0).alias("base"),
                F.exists(base, lambda b: 2 * overlap(b) >= longer(b)).alias("same"), *[f[n].alias(n) for n in FEATURES],
            )

        def labelled(f):
            hit, g = f["s"]["hit"], f["s"]["generator"]
            by = lambda *cases: reduce(lambda w, c: w.when(g == c[0], c[1]), cases[1:], F.when(g == cases[0][0], cases[0][1]))
            checked = by(
                (0, (f["check_digit"] == 1) & (f["n_groups"] == 4) & (f["longest"] == 4) & (f["n_digits"] == 16)),
                (3, hit.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (F.contains(hit, F.lit("::")) & hit.rlike("[A-Fa-f]"))),
                (5, account_check(hit)),
            ).otherwise(False)
            against = ((f["other"] == 1) & (f["personal"] == 0)) | (f["lookalike"] == 1) | by(
                (0, f["n_digits"].between(13, 19) & (f["check_digit"] == 0)),
                (1, ~F.regexp_replace(hit, "[^0-9]+", ".").rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")),
                (2, ~hit.rlike("@[A-Za-z0-9-]+\\.[A-Za-z]")),
                (4, ~hit.rlike("[0-9._\\[({]") & (f["personal"] == 0)),
                (5, ~account_check(hit)),
            ).otherwise(False)
            label = F.when(f["s"]["masked"] | f["same"] | checked, 1).when(against, 0)
            return F.struct(
                f["s"]["start"].alias("start"), f["s"]["stop"].alias("stop"), g.alias("generator"), f["base"].alias("base"),
                f["s"]["masked"].alias("masked"), label.cast("int").alias("label"), *[f[n].alias(n) for n in FEATURES],
            )

        return F.transform(F.transform(F.transform(found, context), measured), labelled)

    def row(s, hit, g, masked):
        return F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), hit.alias("hit"), F.lit(g).alias("generator"),
            F.lit(masked).alias("masked"),
        )

    def found(g):
        pattern, guard = GENERATORS[g]
        return F.transform(spans(text, pattern, text.rlike(guard)), lambda s: row(s, s["hit"], g, False))

    def respelled(kind, g, spelling):
        """Base spans of a kind with their text in another spelling."""

        shown = lambda b: F.substr(text, b["start"] + 1, b["stop"] - b["start"])
        return F.transform(F.filter(base, lambda b: b["kind"] == kind), lambda b: row(b, spelling(shown(b)), g, True))

    def spelled_mail(hit):
        at, dot = (F.when(F.length(hit) % 2 == 0, f" [{w}] ").otherwise(f" {w} ") for w in ("at", "dot"))
        return F.concat(F.substring_index(hit, "@", 1), at, F.replace(F.substring_index(hit, "@", -1), F.lit("."), dot))

    return judged(F.concat(
        *[found(g) for g in range(len(GENERATORS))],
        respelled("phone", 0, lambda hit: F.regexp_replace(hit, "^\\+[0-9]{1,3}[ .-]*", "")),
        respelled("card", 0, lambda hit: F.regexp_replace(digits_of(hit), "([0-9]{4})(?=[0-9])", "$1.")),
        respelled("ip", 1, lambda hit: F.regexp_replace(hit, "\\.", "[.]")),
        respelled("email", 4, spelled_mail),
    ))


def proposed(docs: DataFrame, text="text", key="doc_id") -> DataFrame:
    """Row number, key, base spans and proposals of every row, stored: the only pass over the texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = let(base_spans(whole), lambda b: F.struct(b.alias("base"), proposals(whole, b).alias("proposals")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), found.alias("found"))
    return stored(rows.select("row", "key", "found.base", "found.proposals"), "proposals")


def fitted(docs: DataFrame, text="text", key="doc_id", fit_rows: int = FIT_ROWS, precision: float = 0.98):
    """(boosted trees, threshold per generator), learned from the texts of ``docs``; None if only one class is seen."""
    table = proposed(docs, text, key)
    model = learned(table, fit_rows, precision)
    removed(table)
    return model


def learned(table: DataFrame, fit_rows: int = FIT_ROWS, precision: float = 0.98):
    """(boosted trees, threshold per generator) from the table of ``proposed``.

    The trees are fitted on at most ``fit_rows`` labelled proposals, an equal share for each generator and label: those
    of smallest hash among the even hashes. All labelled proposals outside that sample are scored, and each generator
    gets the least score, in hundredths, above which ``precision`` of its proposals have the label 1. A generator
    gets none, so that nothing of it is added, where no score does or where nothing is labelled outside the sample.
    None if only one class is seen.
    """
    draw = F.xxhash64("key", "p.start", "p.stop", "p.generator", "p.masked")
    each = (
        table.select("key", F.explode("proposals").alias("p")).filter(F.col("p.label").isNotNull())
        .select(draw.alias("draw"), F.col("p.label").cast("double").alias("label"), "p.generator", *[f"p.{f}" for f in FEATURES])
    )
    # Spark keeps the first of each group in the map tasks, so no task sorts more than a share of each task before it.
    share = max(fit_rows // (2 * len(GENERATORS)), 1)
    first = Window.partitionBy("generator", "label").orderBy("draw", *FEATURES)
    fit = (
        each.filter(F.col("draw") % 2 == 0).withColumn("at", F.row_number().over(first))
        .filter(F.col("at") <= share).drop("at").persist()
    )
    seen = fit.groupBy("generator", "label").agg(F.max("draw").alias("last")).collect()  # at most 12 rows
    if len({r["label"] for r in seen}) < 2:
        fit.unpersist()
        return None
    pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(maxIter=10, maxDepth=4, maxBins=64, seed=7).fit(pack.transform(fit))
    fit.unpersist()
    outside = F.col("draw") % 2 != 0
    for r in seen:
        outside = outside | ((F.col("generator") == r["generator"]) & (F.col("label") == r["label"]) & (F.col("draw") > r["last"]))
    scored = trees.transform(pack.transform(each.filter(outside)))
    counts = (
        scored.groupBy("generator", F.floor(vector_to_array("probability")[1] * 100).cast("int").alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
        .collect()  # at most 101 rows per generator
    )

    def limit(rows):
        n = good = 0
        least = None
        for r in sorted(rows, key=lambda r: -r["part"]):
            n, good = n + r["n"], good + r["good"]
            if good >= precision * n:
                least = r["part"] / 100
        return least

    limits = {g: limit([r for r in counts if r["generator"] == g]) for g in range(len(GENERATORS))}
    return trees, {g: v for g, v in limits.items() if v is not None}


def personal_spans(docs: DataFrame, text="text", key="doc_id", model=None) -> DataFrame:
    """key and ``found``: array of (rank, start, stop, kind), base spans and those that the trees add.

    A proposal is added, as kind ``other``, if it reaches its generator's threshold and overlaps no base
    span; added proposals that overlap each other are one span, from the first start to the last stop.

    Null and empty texts have no spans. Every input row gives one output row, repeated rows too. Other
    columns are ignored.
    """
    fresh(docs, key, text)
    table = proposed(docs, text, key)
    model = model or learned(table)
    kind = "array<struct<rank:int,start:int,stop:int,kind:string>>"
    as_is = lambda rows: rows.select(F.col("key").alias(key), F.array_sort(F.col("base").cast(kind)).alias("found"))
    if model is None:
        return as_is(table)
    trees, limits = model
    able = list(limits) or [-1]
    rows = table.withColumn(
        "open", F.filter("proposals", lambda p: ~p["base"] & ~p["masked"] & p["generator"].isin(able))
    )
    # What else the document has travels with its first proposal only; rows without any are never shuffled.
    each = rows.filter(F.size("open") > 0).select(
        "row", F.struct("key", "base").alias("all"), F.posexplode("open").alias("at", "p")
    ).select(
        "row", F.when(F.col("at") == 0, F.col("all")).alias("all"), "p.start", "p.stop", "p.generator",
        *[f"p.{f}" for f in FEATURES],
    )
    scored = trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(each))
    least = F.lit(2.0)
    for g, limit in limits.items():
        least = F.when(F.col("generator") == g, limit).otherwise(least)
    chosen = scored.select("row", "all", "start", "stop", (vector_to_array("probability")[1] >= least).alias("added"))
    order = Window.partitionBy("row").orderBy(F.col("added").desc(), "start", "stop")
    ended = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") < ended, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = (
        chosen.withColumn("run", F.when(F.col("added"), run))
        .groupBy("row", "run").agg(
            F.first("all", ignorenulls=True).alias("all"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    span = F.struct(F.lit(len(KINDS)).alias("rank"), "start", "stop", F.lit("other").alias("kind"))
    back = runs.groupBy("row").agg(
        F.first("all", ignorenulls=True).alias("all"), F.collect_list(F.when(F.col("run").isNotNull(), span)).alias("more")
    )
    with_more = back.select(
        F.col("all.key").alias(key),
        F.array_sort(F.concat(F.col("all.base").cast(kind), F.col("more").cast(kind))).alias("found"),
    )
    return as_is(rows.filter(F.size("open") == 0)).union(with_more)


def personal_digests(docs: DataFrame, key="doc_id", **how) -> DataFrame:
    """Counts and span lists per document, as the query returns them."""
    found = personal_spans(docs, key=key, **how)
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("found", lambda s: s["rank"] < len(KINDS))
    return found.select(
        key, *[n(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def run(spark, sf_dir):
    return personal_digests(read(spark, sf_dir, "documents"))
