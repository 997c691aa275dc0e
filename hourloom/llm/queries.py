"""The operators of this subpackage as queries over the given tables, with the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.durable import discard, scratch_path
from hourloom.llm import archives, bin_packing, divergence, exact, extraction, hard_negatives, mixing, near, pieces, quality, sentence_spans, templates, training_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op5_exact_dedup",
    f"""
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
      doc_id = max(doc_id) over w as kept, sha256(normal) as text_sha256
    from (select doc_id, {_LOWER} as normal from documents) t window w as (partition by normal)
    """,
)
def _(spark, d):
    return exact.exact_duplicates(_table(spark, d, "documents"))


@query("op7_minhash_near_dedup")
def _(spark, d):
    return near.near_duplicates(_table(spark, d, "documents"), size=3, percent=85)


@query("op4_quality_rules")
def _(spark, d):
    return quality.quality_rules(_table(spark, d, "documents"), _table(spark, d, "labels"))


@query("op8_template_line_dedup")
def _(spark, d):
    return templates.drop_template_lines(_table(spark, d, "documents"))


@query("op1_sentence_span_dedup")
def _(spark, d):
    return sentence_spans.remove_repeated_spans(_table(spark, d, "documents"))


#: Blocks a source gets for each block of a source not named here.
MIX_WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}


@query("op10_pfair_mixing")
def _(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS).select("row.doc_id", "source", "block", "slot", "place")


@query("op2_sampled_pieces")
def _(spark, d):
    return pieces.sample_pieces(_table(spark, d, "documents"))


@query("op3_page_differencing")
def _(spark, d):
    return extraction.extract_text(_table(spark, d, "pages"))


@query(
    "op6_arc_to_warc",
    """
    select page_id, strlen(body) as payload_bytes, sha1(body) as payload_digest,
      case when strlen(body) >= 1000 and page_id <> newest then 'revisit' else 'response' end as record_type,
      case when strlen(body) >= 1000 and page_id <> newest then newest end as refers_to
    from (select page_id, coalesce(html, '') as body, max(page_id) over (partition by coalesce(html, '')) as newest from pages) t
    """,
)
def _(spark, d):
    pages = _table(spark, d, "pages").select("page_id", "url", "html")
    second = F.pmod("page_id", F.lit(2)) == 1
    arcs = [scratch_path(spark, "arc1"), scratch_path(spark, "arc2")]
    archives.write_arc(pages.where(~F.coalesce(second, F.lit(False))), arcs[0], version=1)
    archives.write_arc(pages.where(second), arcs[1], version=2)
    warc = scratch_path(spark, "warc")
    archives.convert(archives.read_arc(spark, *arcs), warc)
    discard(spark, *arcs)
    return archives.read_warc(spark, warc).drop("url")


@query("op9_training_order")
def _(spark, d):
    shards = scratch_path(spark, "shards")
    n = training_order.materialise(_table(spark, d, "documents"), shards)
    if not n:
        return spark.createDataFrame([], "slot bigint, shard bigint, position bigint, first_id bigint, last_id bigint, n_tokens int, tokens_sha256 string")
    return training_order.read_shards(spark, shards).withColumn("tokens_sha256", F.sha2("tokens", 256)).drop("tokens")


#: Query parameter: the vocabulary of the packed tokens.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op12_minimum_bin_slack")
def _(spark, d):
    return bin_packing.pack(_table(spark, d, "documents"), WORD_VOCABULARY)


@query(
    "op11_source_divergence",
    r"""
    with docs as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
      words as (select row, lang, source, unnest(terms) as term from docs),
      kept as (select lang, term from words group by all having count(distinct row) >= 10),
      sizes as (select lang, count(*) as v from kept group by lang),
      groups as (select lang, source, coalesce(v, 0) as v from (select distinct lang, source from docs) d left join sizes using (lang)),
      found as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
      totals as (select lang, source, sum(n) as n from found group by all),
      cells as (select g.lang, g.source, k.term, coalesce(f.n, 0) as n,
        1 + (1000000000::hugeint * (coalesce(f.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * g.v) as p
        from groups g join kept k using (lang) left join found f using (lang, source, term) left join totals t using (lang, source)),
      whole as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v) as q
        from (select lang, term, sum(n) as n from found group by all) w join sizes using (lang)),
      pairs as (select a.lang, a.source, b.source as item, ((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) as f
        from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source),
      sums as (select g.lang, g.source, h.source as item, coalesce(s.f, 0) as value from groups g join groups h on g.lang = h.lang and g.source <> h.source
        left join (select lang, source, item, sum(f) as f from pairs group by all) s on s.lang = g.lang and s.source = g.source and s.item = h.source),
      more as (select c.lang, c.source, c.term as item, ((p - q) * (p - q)) // (p + q) as value from cells c join whole using (lang, term) where c.n > 0 and p > q)
    select lang, source, part, item, value::bigint as value, rank::integer as rank from (
      select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from sums
      union all by name
      select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from more qualify rank <= 10) r
    """,
)
def _(spark, d):
    return divergence.source_divergence(_table(spark, d, "documents"))


@query(
    "op13_hard_negatives",
    """
    with fine as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
          list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
        from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
      scores as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as positive,
          list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
        from fine a join fine b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
      positives as (select anchor_id, id, score from scores where positive qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
      found as (select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank,
          n.id as negative_id, p.score as positive_score, n.score as negative_score
        from positives p join scores n on p.anchor_id = n.anchor_id and not n.positive and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
    select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from found where rank <= 5
    """,
)
def _(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, d, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)
