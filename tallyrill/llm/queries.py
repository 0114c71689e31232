"""The ten operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.llm import decontam, lines, mixing, neardup, secrets, sharding, tokens, toxicity, urls, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), toxicity.held_out)
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_token_files, op2_toxicity, op3_line_dedup, op4_decontamination, op5_minhash_dedup, op6_secret_scan, op7_mixing, op8_vector_dedup, op9_sharding, op10_url_filter)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLES = {
    "op3_line_dedup": r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
k as (select *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, r.key is not null and k.doc_id <> r.keeper as lost from k left join r on k.key = r.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from m group by doc_id""",
    "op7_mixing": r"""
with d as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size,
             row_number() over (order by source asc nulls last) - 1 as place from d group by source),
w as (select *, [5.0, 2.0, 1.0][(place % 3 + 1)::int]::double as w, 3 * source_size as cap from s),
r as (select *, cap / w as r from w),
v as (select *, row_number() over (order by r, place) as rank,
        ((sum(source_size) over ())::bigint - coalesce(sum(cap) over (order by r, place rows between unbounded preceding and 1 preceding), 0)::bigint)::double
        / sum(w) over (order by r, place rows between current row and unbounded following) as level from r),
t as (select source, place, source_size,
        case when r < level then cap::double else w * (arg_min(level, rank) filter (where r >= level) over ()) end as target
      from v),
p as (select d.*, t.source_size, t.target, t.place,
        sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and current row)::bigint - size as first
      from d join t on d.source is not distinct from t.source),
g as (select *, floor(target + 0.5)::bigint as goal from p),
x as (select *, case when goal > 0 then least(first / goal::double, 1.0) end as x from g)
select doc_id, size, source_size, target,
  (greatest(least(goal - first, size), 0) + greatest(least(goal - source_size - first, size), 0)
   + greatest(least(goal - 2 * source_size - first, size), 0))::bigint as taken,
  coalesce(least(case place % 3
    when 0 then case when x * 1.0 >= 0.625 then 0.5 + 2 * (x - 0.625) / (1.0 + sqrt(greatest(1.0 - 2 * (x - 0.625), 0)))
                else 2 * x / (1.5 + sqrt(greatest(2.25 - 2 * x, 0))) end
    when 1 then case when x >= 0.5 then 0.5 + 2 * (x - 0.5) / 2.0 else 2 * x / 2.0 end
    else case when x >= 0.375 then 0.5 + 2 * (x - 0.375) / (1.0 + sqrt(1.0 + 2 * (x - 0.375)))
              else 2 * x / (0.5 + sqrt(0.25 + 2 * x)) end end, 1.0), 0.0) as position
from x""",
    "op10_url_filter": r"""
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(rule, verdict, rhost, rpath) as (values
  ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'block', 'net', '/de/'),
  ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')),
m as (
  select p.page_id, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from p join r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath) group by p.page_id)
select p.page_id, p.host, p.path, m.rule,
  coalesce(m.verdict, case when list_has_any(string_split(replace(p.host, '-', '.'), '.'),
      ['bet', 'bets', 'betting', 'casino', 'jackpot', 'lottery', 'poker', 'roulette', 'slots', 'adult', 'escort', 'nude', 'porn', 'sex', 'xxx',
       'cialis', 'pharmacy', 'pills', 'viagra', 'ads', 'adserver', 'banner', 'clicks', 'popunder', 'tracker', 'phishing', 'scam', 'spam', 'warez'])
    or regexp_matches(p.path, '/(login|signin)/(.*[^A-Za-z0-9_])?verify([^A-Za-z0-9_]|$)')
    then 'block' else 'allow' end) as verdict
from p left join m on p.page_id = m.page_id""",
}
