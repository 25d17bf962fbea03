"""The queries of this subpackage over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillframe.llm.common import documents

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.lm_score import score

    return score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.fingerprints import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=3, most=3)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.quality import fit, judge

    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), room=1024, end_id=0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.token_counts import with_token_counts

    return with_token_counts(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), limit=1024).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.secrets import scan

    docs = documents(spark, sf_dir)
    return scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.materialise import materialise

    return materialise(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), key=20_260_101, length=1024, end_id=0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.viterbi import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.pii import detect

    return detect(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.audit import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.language import with_language

    return with_language(documents(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stillframe.llm.importance import resample

    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Masks by regular expressions and lists, duplicates by a window, orders by joining the letters.
AUDIT_SQL = """
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
f as (select doc_id, part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::int
             + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * coalesce(min(doc_id) over (partition by x) < doc_id, false)::int as mask from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by part, mask),
t as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from t a, t b, t c, t d, t e
      where len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, i as step, bits[i] as bit, coalesce(list_sum(bits[1:i - 1]), 0)::int as before from o, unnest(range(1, 6)) as r(i)),
r as (select part, filter_order, cast(step as int) as step, bit, sum(case when mask & before = 0 and mask & bit = 0 then n else 0 end) as kept,
             sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
             sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
             sum(case when mask = bit then n else 0 end) as unique_fails,
             sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
             sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
      from c, s group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": AUDIT_SQL}
