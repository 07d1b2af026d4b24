"""Registered queries of the subpackage: name -> f(spark, sf_dir), and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.mixing import Raking
from meridia.llm.support import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meridia.llm.token_counts import TokenCounts

    return TokenCounts(public_tokenizers.path("byte_bpe_50k.json"), limit=512)(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.suffix_dedup import SuffixDedup

    return SuffixDedup(length=50).digest(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Raking().sample(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.lm_scoring import StupidBackoff

    out = StupidBackoff(order=3).score(table(spark, sf_dir, "documents"))
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})  # sums in any order


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.minhash import NearDuplicates

    return NearDuplicates()(table(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.nn_descent import NNDescent

    return NNDescent()(table(spark, sf_dir, "embeddings"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meridia.llm.piece_codec import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_html_extract, op4_toxicity, op5_mixing, op6_lm_scoring, op7_minhash_near_dedup, op8_nn_descent, op9_piece_codec, op10_quality_rules)
}

#: `m` counts of pairs and trigrams are a text's own.
LM_SQL = r"""with words as (select doc_id, unnest(l) w, generate_subscripts(l, 1) i from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') l from documents)),
g as (select doc_id, i, w, lag(w, 1) over o v, lag(w, 2) over o u from words window o as (partition by doc_id order by i)),
c1 as (select w, count(*) c from g group by 1),
c2 as (select v, w, count(*) c from g where i > 1 group by all), m2 as (select doc_id, v, w, count(*) m from g where i > 1 group by all),
c3 as (select u, v, w, count(*) c from g where i > 2 group by all), m3 as (select doc_id, u, v, w, count(*) m from g where i > 2 group by all),
k as (select g.doc_id, g.i, (select sum(c) from c1)::double n,
  a.c cw, b.c cv, p.c - pm.m cvw, q.c - qm.m cuv, t.c - tm.m cuvw
  from g join c1 a on a.w = g.w left join c1 b on b.w = g.v
  left join c2 p on p.v = g.v and p.w = g.w left join m2 pm on pm.doc_id = g.doc_id and pm.v = g.v and pm.w = g.w
  left join c2 q on q.v = g.u and q.w = g.v left join m2 qm on qm.doc_id = g.doc_id and qm.v = g.u and qm.w = g.v
  left join c3 t on t.u = g.u and t.v = g.v and t.w = g.w left join m3 tm on tm.doc_id = g.doc_id and tm.u = g.u and tm.v = g.v and tm.w = g.w),
s as (select doc_id, i > 2 and cuvw < 1 or i = 2 and cvw < 1 back, i > 1 and cvw < 1 and (i = 2 or cuvw < 1) single,
  case when i > 2 and cuvw >= 1 then ln(cuvw / cuv::double)
    else case when i > 2 then ln(0.4) else 0 end + case when i > 1 and cvw >= 1 then ln(cvw / cv::double) else case when i > 1 then ln(0.4) else 0 end + ln(cw / n) end end x from k)
select d.doc_id, count(x) n_words, count(*) filter (back) n_backoff, count(*) filter (single) n_unigram, round(coalesce(sum(x), 0), 4) log_score, round(sum(x) / count(x), 6) mean_log_score
from documents d left join s using (doc_id) group by d.doc_id"""

ORACLE: dict[str, str] = {"op5_mixing": Raking().sql(), "op6_lm_scoring": LM_SQL}
