"""The registered corpus queries, one per operator, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, loss_text, read_inst
from .collocations import collocations
from .common import appended, crc_mod, documents
from .contamination import contamination
from .exact import exact_dedup
from .langid import fit_languages, identify
from .mixing import mix_plan, taken, word_count
from .negatives import hard_negatives
from .quality import fit_quality, score_quality
from .simhash import simhash_groups
from .substrings import dedup_substrings
from .token_output import token_output, verified
from .toxicity import LIMIT, fit_toxicity, score_toxicity
from .urls import judge_urls, mine_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _decision(held_out) -> list:
    return [held_out.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted")]


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels only from ids whose crc32 leaves a remainder by 5."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", *_decision(crc_mod("doc_id", 5) == 0))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the turns and of the loss text, read back from every formatted conversation."""
    chats = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chats.schema)

    def digest(batch: pa.RecordBatch) -> list[pa.Array]:
        turns, chars, loss = [], [], []
        for text, spans in zip(batch.column("formatted"), batch.column("spans")):
            text = text.as_py()
            turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in read_inst(text)).encode()).hexdigest())
            masked = loss_text(text, spans.as_py())
            chars.append(len(masked))
            loss.append(hashlib.sha256(masked.encode()).hexdigest())
        return [pa.array(turns), pa.array(chars, pa.int64()), pa.array(loss)]

    found = appended(format_chats(chats.unionByName(extra)), digest, {"turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string"})
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op2_chat_format"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(9 + length(role) + case when role = 'user' then 15 else 0 end
                + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g'))) as bigint) as formatted_chars
from c group by conv_id
"""


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from those whose id's crc32 by 4 does not leave 2.

    ``lang_pred`` is the nearest centroid's language; ``inside`` says whether the distance-based
    rejection accepts it.
    """
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.where(crc_mod("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    held_out = (crc_mod("doc_id", 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, F.col("nearest_lang").alias("lang_pred"), F.col("lang_score").alias("score"), F.col("lang_inside").alias("inside"))


@query
def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence in training order, and whether its shard holds it intact."""
    index, folder = token_output(documents(spark, sf_dir))
    return verified(spark, index, folder)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels only from ids whose crc32 by 4 does not leave 2."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(crc_mod("doc_id", 4) != 2))
    scored = score_toxicity(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", *_decision(crc_mod("doc_id", 4) == 2), F.col("toxic").alias("flagged"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a document with a smaller id repeats, and a digest of the others."""
    found = dedup_substrings(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document contains."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "coverage", "item_ids")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count("text").alias("size"))
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the documents is the frozen snapshot, the other half the incoming batch."""
    docs = documents(spark, sf_dir)
    old = F.pmod(F.xxhash64(F.lit("snapshot"), F.col("doc_id")), F.lit(2)) == 0
    found = exact_dedup(docs.where(old), docs.where(~old))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op10_exact_dedup"] = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
r as (
  select *, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r
"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return collocations(documents(spark, sf_dir))


ORACLES["op11_collocations"] = r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
m as (select unnest([1, 2, 3, 4]) as m),
g as (
  select lang, m, list_aggregate(w[s:s + m - 1], 'string_agg', ' ') as phrase
  from (select lang, m, w, unnest(range(1, len(w) - m + 2)) as s from w, m where len(w) >= m)),
f as (select lang, m, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 30),
k as (
  select lang, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from (select *, unnest(range(1, m)) as k from c)),
s as (
  select k.lang, k.phrase, k.a, k.k, l.f as l, r.f as r, ((2000000 * k.a::hugeint) // (l.f::hugeint + r.f))::bigint as score
  from k join f l on l.lang = k.lang and l.phrase = k.first join f r on r.lang = k.lang and r.phrase = k.rest),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
x as (
  select lang, array_to_string(w[s:s + i - 1], ' ') as phrase, max(a) as longer
  from (select lang, a, w, i, unnest(range(1, m - i + 2)) as s from (select *, unnest(range(2, m)) as i from c where m > 2))
  group by all),
o as (
  select b.lang, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank, b.phrase, a, l, r, n, score
  from b join n using (lang) left join x on x.lang = b.lang and x.phrase = b.phrase
  where longer is null or 100 * longer::hugeint < 80 * a::hugeint)
select * from o where rank <= 2000
"""


#: Host, path and verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; rules are mined from the pages whose id has a toxicity label."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    labels = documents(spark, sf_dir, "labels").where("toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.max("toxic") > 0).alias("bad"))
    found = judge_urls(pages, URL_RULES, mine_rules(pages.join(labels, "page_id")))
    return found.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh has its label moved on by one."""
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


ORACLES["op13_hard_negatives"] = r"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a, r b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank,
       other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 3
"""


def _pipeline() -> None:
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


_pipeline()
