"""Document fingerprints: canonical exact digests, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillframe.llm.common import checkpoint, key_sketch, maybe_in, row_key, shuffle_parts, text_or_empty

#: White space that the compatibility form leaves, besides the pattern's own class.
_SPACE = "[\\s\\x1c-\\x1f\\u0085\\u1680\\u180e\\u2028\\u2029]+"


def compatible(text: Column) -> Column:
    """Unicode form NFKC.  Spark has no function for it; its jars hold the Unicode
    library, whose static method SQL can call.  Pure ASCII is its own form."""
    form = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(form)


def with_canonical(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds canonical forms {new column: text column}: NFKC, case folded, white space
    folded to single blanks and trimmed."""
    for new, old in columns.items():
        df = df.withColumn(new, compatible(F.col(old)))
        df = df.withColumn(new, F.lower(F.upper(F.col(new))))
        df = df.withColumn(new, compatible(F.col(new)))
        df = df.withColumn(new, F.trim(F.regexp_replace(F.col(new), _SPACE, " ")))
    return df


def wide_digest(canonical: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of different seeds."""
    return F.xxhash64(canonical), F.xxhash64(F.lit("second"), canonical)


def _hex(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def successors(ids: DataFrame) -> DataFrame:
    """Adds ``next_id``: the next smaller ``doc_id`` (null: the smallest), after the last
    one the first.  ``ids`` has each id once.

    Ids are range-partitioned; each partition looks at its own rows, and only one row
    per partition is looked at together.
    """
    parts = checkpoint(ids.repartitionByRange(shuffle_parts(ids.sparkSession), F.col("doc_id").desc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("_part").orderBy(F.col("doc_id").desc_nulls_last())
    place = parts.withColumns({"_in": F.struct(F.lead("doc_id").over(order).alias("id"), (F.row_number().over(order) == F.count("*").over(Window.partitionBy("_part"))).alias("last"))})
    heads = parts.groupBy("_part").agg(F.max("doc_id").alias("_head"))
    total = Window.orderBy("_part")  # one row per partition
    heads = heads.select(
        "_part",
        F.when(F.lead("_part").over(total).isNotNull(), F.lead("_head").over(total))
        .otherwise(F.first("_head").over(total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_then"),
    )
    return place.join(heads, "_part").select(*ids.columns, F.when(F.col("_in.last"), F.col("_then")).otherwise(F.col("_in.id")).alias("next_id"))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], tuple[Column, Column]] = wide_digest) -> DataFrame:
    """Fingerprints of every row's text and of its edited text.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document's, in descending order of id; after the last
    comes the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (1 if the fingerprints agree, else 0).

    Texts are alike if their canonical forms have equal bytes.  Buckets of equal 128-bit
    digests with more than one entry are compared byte by byte: distinct forms in one
    bucket get a number behind the digest, so fingerprints agree exactly for equal forms.

    Null texts are empty.  Rows may share an id (or have none, the last id in order):
    the one of the smallest text hash stands for the id as a next document.  An empty
    table gives an empty one.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("t"))
    docs = docs.select("doc_id", "t", *row_key(F.col("doc_id"), F.col("t")))
    ids = docs.groupBy("doc_id").agg(F.max(F.length("t")).alias("most"), F.min(F.struct("_k2", "_k1")).alias("_rep"), F.count("*").alias("rows"))
    chain = checkpoint(successors(ids))
    repeated = not chain.where("rows > 1").isEmpty()
    # who takes how much of each id's text, and of which of its rows
    send = chain.select(F.col("next_id").alias("_from"), F.col("doc_id").alias("_to"), F.floor(F.col("most") / 3).cast("int").alias("_take"))
    send = send.join(chain.select(F.col("doc_id").alias("_rid"), "_rep"), F.col("_from").eqNullSafe(F.col("_rid"))).select("_from", "_to", "_take", "_rep")
    rep = chain.select(F.col("doc_id").alias("_rid"), "_rep")
    is_rep = F.struct("_k2", "_k1") <= F.col("_rep")  # the least itself; no key of a join

    def edited(own: DataFrame, sender: DataFrame) -> DataFrame:
        """doc_id, keys, own text, edited text and the next text's digest of the rows ``own``;
        ``sender`` has the next documents.  Both may have more rows."""
        # both joins take the same columns of ``docs``, so its texts are shuffled once for them
        sent = sender.join(send, sender["doc_id"].eqNullSafe(send["_from"])).where(is_rep)
        sent = with_canonical(sent, {"_c": "t"})
        h1, h2 = digest(F.col("_c"))
        sent = sent.select("_to", F.substring("t", F.lit(1), F.col("_take")).alias("_head"), h1.alias("next1"), h2.alias("next2"))
        if repeated:
            sent = sent.dropDuplicates(["_to"])
        n = F.length("t")
        k = F.floor(n / 3).cast("int")
        return own.join(sent, own["doc_id"].eqNullSafe(sent["_to"])).select(
            "doc_id", "_k1", "_k2", "t", F.concat(F.substring("t", F.lit(1), n - k), F.substring("_head", F.lit(1), k)).alias("e"), "next1", "next2"
        )

    both = with_canonical(edited(docs, docs), {"ct": "t", "ce": "e"})
    (a1, a2), (b1, b2) = digest(F.col("ct")), digest(F.col("ce"))
    rows = checkpoint(both.select(
        "doc_id", "_k1", "_k2", F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"),
        a1.alias("own1"), a2.alias("own2"), b1.alias("edit1"), b2.alias("edit2"), "next1", "next2",
    ))

    entries = rows.select(F.explode(F.array(F.struct(F.col("own1").alias("h1"), F.col("own2").alias("h2")), F.struct(F.col("edit1").alias("h1"), F.col("edit2").alias("h2")))).alias("h")).select("h.*")
    shared = checkpoint(entries.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    # texts of buckets with several entries are read again and only these are shuffled: rows
    # that share their own form, and rows that share their edited one with who comes next
    own_again = rows.join(shared, (F.col("own1") == F.col("h1")) & (F.col("own2") == F.col("h2")), "left_semi").select("_k1")
    edit_again = checkpoint(rows.join(shared, (F.col("edit1") == F.col("h1")) & (F.col("edit2") == F.col("h2")), "left_semi").select("doc_id", "_k1"))
    next_ids = chain.join(edit_again.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("next_id")
    own_forms = with_canonical(maybe_in(docs, F.col("_k1"), key_sketch(own_again, F.col("_k1"))), {"form": "t"}).select("doc_id", "_k1", "_k2", F.lit("own").alias("kind"), "form")
    takers = maybe_in(docs, F.col("_k1"), key_sketch(edit_again, F.col("_k1")))
    givers = maybe_in(docs, F.xxhash64(F.col("doc_id")), key_sketch(next_ids, F.xxhash64(F.col("next_id"))))
    edit_forms = with_canonical(edited(takers, givers), {"form": "e"}).select("doc_id", "_k1", "_k2", F.lit("edit").alias("kind"), "form")
    f1, f2 = digest(F.col("form"))
    forms = own_forms.unionByName(edit_forms).select("doc_id", "_k1", "_k2", "kind", "form", f1.alias("h1"), f2.alias("h2"))
    # grouping by digest and bytes is the comparison; copies meet in the map tasks already
    distinct = forms.select("h1", "h2", "form").distinct().join(shared, ["h1", "h2"], "left_semi")
    clash = checkpoint(distinct.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    if clash.isEmpty():
        own, edit, following = _hex(F.col("own1"), F.col("own2")), _hex(F.col("edit1"), F.col("edit2")), _hex(F.col("next1"), F.col("next2"))
        out = rows
    else:
        numbered = forms.join(clash, ["h1", "h2"], "left_semi").select("h1", "h2", "form").distinct().withColumn(
            "number", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("form")) - 1
        )
        tags = forms.join(numbered, ["h1", "h2", "form"]).select("doc_id", "_k1", "_k2", "kind", "number").distinct()
        tags = checkpoint(tags.groupBy("_k1", "_k2").agg(F.max(F.when(F.col("kind") == "own", F.col("number"))).alias("own_n"), F.max(F.when(F.col("kind") == "edit", F.col("number"))).alias("edit_n")))
        heads = rows.select("doc_id", "_k1", "_k2").join(rep, F.col("doc_id").eqNullSafe(F.col("_rid"))).where(is_rep)
        heads = heads.join(tags, ["_k1", "_k2"]).select(F.col("doc_id").alias("_h"), F.col("own_n").alias("next_n")).distinct()
        out = rows.join(tags, ["_k1", "_k2"], "left").join(chain.select(F.col("doc_id").alias("_d"), "next_id"), F.col("doc_id").eqNullSafe(F.col("_d"))).join(heads, F.col("next_id").eqNullSafe(F.col("_h")), "left")

        def tagged(a: str, b: str, n: str) -> Column:
            return F.concat(_hex(F.col(a), F.col(b)), F.when(F.col(n).isNotNull(), F.concat(F.lit("-"), F.col(n).cast("string"))).otherwise(F.lit("")))

        own, edit, following = tagged("own1", "own2", "own_n"), tagged("edit1", "edit2", "edit_n"), tagged("next1", "next2", "next_n")
    out = out.withColumns({"_o": own, "_e": edit, "_n": following})
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("_o").alias("fingerprint"), F.col("_e").alias("edited_fingerprint"),
        (F.col("_o") == F.col("_e")).cast("double").alias("near_edited"), (F.col("_o") == F.col("_n")).cast("double").alias("near_next"),
    )
