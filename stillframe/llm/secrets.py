"""Secret scans with corpus-wide ownership frequency, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillframe.llm import spans as S
from stillframe.llm.common import checkpoint, row_key

#: Base kinds in their order (fixed values).
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Further candidates: (kind, pattern).  A match is a secret only if it looks alive and
#: the corpus shows it with one owner and in one repository.
WIDER = [
    ("bearer", r"[bB]earer\x20+[A-Za-z0-9._~+/=-]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("issued", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza)[A-Za-z0-9_-]{16,}"),
    ("pem", r"-----BEGIN\x20[A-Z\x20]{0,30}PRIVATE\x20KEY-----[A-Za-z0-9+/=\s]{32,}"),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]+:[^\x20\x09-\x0D\x01@/]{6,}@"),
    ("mixed", r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"),
]

#: A candidate is hot if it is found more than this often, or more than this share of all finds; so
#: at most 1 / HOT_SHARE are, and no other one has more rows than that in a task of the join.
HOT_ROWS, HOT_SHARE = 10_000, 1 / 20_000

SPAN = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def base_spans(text: Column) -> list[Column]:
    """Spans of the three base kinds of a clean text."""
    found = S.marked(S.around(text, ASSIGN))
    assign = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    assign = F.when(F.size(found) > 0, assign).otherwise(found)
    return [
        S.labelled(assign, "assign", 0),
        S.labelled(S.marked(S.around(text, ACCESS)), "access", 1),
        S.labelled(S.marked(S.around(text, HEX)), "hex", 2),
    ]


def wider_spans(text: Column) -> Column:
    """Candidates beyond the base kinds."""
    return F.concat(*(S.labelled(S.marked(S.around(text, p)), kind, 3 + i) for i, (kind, p) in enumerate(WIDER)))


def secret_of(span: Column) -> Column:
    """What is secret about a match: the value behind an assignment or in a URL, else the match."""
    return (
        F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2))
        .when(span["kind"] == "bearer", F.regexp_extract(span["value"], r"([^\x20]+)$", 1))
        .when(span["kind"] == "url", F.regexp_extract(span["value"], r"://[^:]+:(.+)@$", 1))
        .otherwise(span["value"])
    )


def looks_alive(secret: Column) -> Column:
    """Enough different characters, and no placeholder words or runs."""
    distinct = F.size(F.array_distinct(F.split(secret, "")))
    placeholder = secret.rlike(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0123456789|abcdef|(.)\1{5}")
    return (distinct >= F.least(F.lit(10), F.ceil(F.length(secret) * 0.4))) & ~placeholder


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None, most_repositories: int = 3, most_owners: int = 1) -> DataFrame:
    """Secrets of every row.

    Candidates are hashed and counted by distinct (repository, owner) over the corpus.
    A candidate is *shared* (a copied example) if more than ``most_owners`` owners or
    ``most_repositories`` repositories have it, else *owned*.  An owned candidate of a
    wider kind that looks alive is added to the spans; base spans always stay.

    Returns one row per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and
    n_shared, n_live (distinct candidates of the document that are shared; owned and
    alive), owned_by_one (kind:start:end of the live ones).  Null texts are empty;
    null owners or repositories count as one unnamed owner or repository; repeated rows have
    rows of their own and count once for their owner; an empty table gives an empty one.

    One pass over the text: its candidates are checkpointed without it.  Counts are
    pre-aggregated, so an example that a third of all rows hold is a few rows per task;
    its verdict goes back to its rows by a broadcast of the hot candidates, at most
    1 / ``HOT_SHARE`` of them, and only the others are joined by a shuffle.
    """
    owner = F.lit(None).cast("string") if owner is None else owner.cast("string")
    repository = owner if repository is None else repository.cast("string")
    t = S.clean(F.col(f"`{text}`"))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), owner.alias("_owner"), repository.alias("_repo"), *row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), owner, repository), t.alias("_t"))
    assign, access, hexes = base_spans(F.col("_t"))
    rows = rows.select("doc_id", "_owner", "_repo", "_k1", "_k2", assign.alias("_assign"), access.alias("_access"), hexes.alias("_hex"), wider_spans(F.col("_t")).alias("_wide"))
    rows = checkpoint(rows)

    one = F.explode(F.transform(F.concat("_assign", "_access", "_hex", "_wide"), lambda s: F.struct(s.alias("span"), secret_of(s).alias("secret")))).alias("c")
    found = rows.select("_owner", "_repo", "_k1", "_k2", one).select(
        "_owner", "_repo", "_k1", "_k2", "c.span", F.xxhash64("c.secret").alias("_h1"), F.xxhash64(F.lit(11), "c.secret").alias("_h2"), looks_alive(F.col("c.secret")).alias("alive")
    )
    homes = found.select("_h1", "_h2", "_owner", "_repo").distinct()
    owners = homes.select("_h1", "_h2", "_owner").distinct().groupBy("_h1", "_h2").agg(F.count("*").alias("owners"))
    repos = homes.groupBy("_h1", "_h2").agg(F.count("*").alias("repositories"))
    owned = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    finds = found.groupBy("_h1", "_h2").agg(F.count("*").alias("finds"))
    counts = owners.join(repos, ["_h1", "_h2"]).join(finds, ["_h1", "_h2"]).select("_h1", "_h2", "finds", owned.alias("owned"))
    counts = checkpoint(counts)
    total = counts.agg(F.sum("finds")).first()[0] or 0
    hot = F.col("finds") > max(HOT_ROWS, int(total * HOT_SHARE))
    often = counts.where(hot).select("_h1", "_h2", F.col("owned").alias("_often"))
    told = found.join(F.broadcast(often), ["_h1", "_h2"], "left")
    apart = told.where("_often is null").drop("_often").join(counts.where(~hot).select("_h1", "_h2", "owned"), ["_h1", "_h2"])
    judged = apart.unionByName(told.where("_often is not null").withColumnRenamed("_often", "owned"))
    per_row = (
        judged.groupBy("_k1", "_k2")
        .agg(
            F.count_distinct(F.when(~F.col("owned"), F.col("_h1"))).alias("_shared"),
            F.collect_set(F.when(F.col("owned") & F.col("alive"), F.col("span"))).alias("_live"),
            F.count_distinct(F.when(F.col("owned") & F.col("alive"), F.col("_h1"))).alias("_n_live"),
        )
    )
    none = F.array().cast(SPAN)
    out = rows.join(per_row, ["_k1", "_k2"], "left").withColumn("_live", F.coalesce("_live", none))
    base = S.in_order("_assign", "_access", "_hex")
    added = F.filter("_live", lambda s: s["order"] >= 3)
    return out.select(
        "doc_id",
        *(F.size(c).cast("long").alias(n) for c, n in (("_assign", "n_assign"), ("_access", "n_access"), ("_hex", "n_hex"))),
        F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined(S.in_order(F.col("_assign"), F.col("_access"), F.col("_hex"), added)).alias("spans"),
        F.coalesce("_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.coalesce("_n_live", F.lit(0)).cast("long").alias("n_live"),
        S.joined(F.array_sort("_live")).alias("owned_by_one"),
    )
