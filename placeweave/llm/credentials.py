"""Secrets in texts, told from widely copied examples by how many owners hold the same value."""

from pyspark.sql import Column, DataFrame, functions as F

from placeweave.llm.native import fresh, joined, let, read, spans

# The formats of the base rules.
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "token"]
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|redacted|x{6}|0{8}|12345678"


def candidates(text: Column) -> Column:
    """Spans of all kinds: array of (start, rank, stop, kind, value), base kinds first at equal starts.

    access and hex match maximal runs, so their least lengths can stand in the pattern; assign is cut
    by the length of its value afterwards, because a short match still uses up its text.
    The generic kind keeps long tokens with a digit, a lower-case and an upper-case letter that lie
    outside the base spans.
    """

    def kind(name, pattern, keep, group=None):
        return F.transform(
            F.filter(spans(text, pattern, group=group), keep),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(name)).alias("rank"),
                s["stop"].alias("stop"), F.lit(name).alias("kind"), s["part"].alias("value"),
            ),
        )

    every = lambda s: F.length(s["hit"]) > 0
    base = F.concat(
        kind("assign", ASSIGN, lambda s: F.length(s["part"]) >= 12, 2),
        kind("access", ACCESS, every),
        kind("hex", HEX, every),
    )
    mixed = lambda s: (
        s["hit"].rlike("[0-9]") & s["hit"].rlike("[a-z]") & s["hit"].rlike("[A-Z]")
    )

    def with_tokens(found):
        outside = F.filter(
            kind("token", TOKEN, mixed),
            lambda t: ~F.exists(found, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
        )
        return F.array_sort(F.concat(found, outside))

    return let(base, with_tokens)


def digest_of(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def owned_values(docs: DataFrame, text="text", owner="source", repo=("source", "lang")) -> DataFrame:
    """One row per span: hash of its value, owner and repository; a null name is a name of its own."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    repos = [repo] if isinstance(repo, str) else list(repo)
    return docs.select(
        name(owner).alias("owner"), F.concat_ws("\x01", *[name(c) for c in repos]).alias("repo"),
        F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("span"),
    ).select("owner", "repo", digest_of(F.col("span.value")).alias("digest"))


def value_owners(found: DataFrame) -> DataFrame:
    """Per value hash: number of distinct owners and of distinct repositories (digest, owner, repo in)."""
    return (
        found.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("digest")
        .agg(F.count_distinct("owner").alias("owners"), F.count(F.lit(1)).alias("repos"))
    )


def secret_spans(
    docs: DataFrame, text="text", owner="source", repo=("source", "lang"), most_owners: int = 2,
    most_repos: int = 5, keep: tuple[str, ...] = ("doc_id",), carry_text: bool = False,
    counts: DataFrame | None = None, found: str = "found",
) -> DataFrame:
    """Every document with its secret spans: ``keep`` columns, then ``found``.

    found: array of (start, rank, stop, kind, value, owners, repos, live), ordered. A value is live if at
    most ``most_owners`` distinct owners and ``most_repos`` distinct repositories hold it and it has no
    placeholder word; else it is a copied example. A generic token is only reported if it is live.

    Null and empty texts have no spans. Null owners and repositories are values like others. Every input
    row gives one output row, repeated rows too. Other columns are ignored.
    """
    fresh(docs, text, owner, *keep)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*keep, *([text] if carry_text else [])).alias("all"),
        candidates(F.coalesce(F.col(text), F.lit(""))).alias("spans"),
    )
    if counts is None:
        counts = value_owners(owned_values(docs, text, owner, repo))
    # What else the document has travels with its first span only.
    each = rows.select("row", "all", F.posexplode_outer("spans").alias("at", "span")).select(
        "row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("all")).alias("all"), "span"
    )
    each = each.withColumn("digest", digest_of(F.col("span.value")))
    # Documents without a span get a key of their own, else they would meet in one task.
    met = each.withColumn("digest", F.coalesce("digest", F.col("row").cast("string"))).join(
        counts, "digest", "left"
    )
    s = F.col("span")
    live = (
        (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos) & ~s["value"].rlike(PLACEHOLDER)
    )
    told = F.when(
        s.isNotNull() & ((s["kind"] != "token") | live),
        F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"),
            s["kind"].alias("kind"), s["value"].alias("value"), "owners", "repos", live.alias("live"),
        ),
    )
    return (
        met.groupBy("row")
        .agg(F.first("all", ignorenulls=True).alias("all"), F.sort_array(F.collect_list(told)).alias("told"))
        .select("all.*", F.col("told").alias(found))
    )


def redacted(text: Column, found: Column, mark: str = "<secret>") -> Column:
    """The text with its live spans replaced; overlapping spans become one mark."""
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(a, s):
        ahead = s["start"] >= a["at"]
        between = F.substr(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(
            ahead, state(s["stop"], F.concat(a["out"], F.array(between, F.lit(mark))))
        ).otherwise(state(F.greatest(a["at"], s["stop"]), a["out"]))

    live = F.filter(found, lambda s: s["live"])
    done = F.aggregate(live, state(F.lit(0), F.array().cast("array<string>")), step)
    return let(
        done, lambda d: F.concat(F.array_join(d["out"], ""), F.substr(text, d["at"] + 1, F.length(text)))
    )


def redact_secrets(docs: DataFrame, text="text", owner="source", repo=("source", "lang"), **limits) -> DataFrame:
    """All documents, live secrets in ``text`` replaced by a mark; ``n_chars`` follows where there is one.

    Null texts stay null. Columns and rows stay as they are otherwise.
    """
    others = tuple(c for c in docs.columns if c != text)
    # Only texts in which some pattern occurs are shuffled; the others pass as they are.
    maybe = F.coalesce(F.col(text).rlike("|".join([ASSIGN, ACCESS, HEX, TOKEN])), F.lit(False))
    counts = value_owners(owned_values(docs, text, owner, repo))
    found = "found" + "_" * max(map(len, docs.columns))
    whole = secret_spans(
        docs.filter(maybe), text, owner, repo, keep=others, carry_text=True, counts=counts,
        found=found, **limits,
    )
    some = F.exists(found, lambda s: s["live"])
    new = F.when(some, redacted(F.col(text), F.col(found))).otherwise(F.col(text))
    out = whole.withColumn(text, new)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(some, F.length(text)).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns).unionByName(docs.filter(~maybe))


def secret_digests(docs: DataFrame, key="doc_id", **how) -> DataFrame:
    """Counts and span lists per document, as the query returns them."""
    found = secret_spans(docs, keep=(key,), **how)

    def of(kind):
        return F.filter("found", lambda s: s["kind"] == kind)

    base = F.filter("found", lambda s: s["rank"] < 3)
    return found.select(
        key,
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("bigint").alias("n_examples"),
    )


def run(spark, sf_dir):
    return secret_digests(read(spark, sf_dir, "documents"))
