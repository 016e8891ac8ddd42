"""The registered queries of this folder: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import centroids, chat, fingerprints, jaccard, licenses, mixing, negatives, packing, quality, secrets, toxicity, vectors, warc
from tidegauge.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    return chat.digests(chat.formatted(conversations.unionByName(probe)))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(spark, warc.archive(table(spark, sf_dir, "pages"))).drop("url")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.found(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_vectors": op4_vectors,
    "op5_chat": op5_chat,
    "op6_jaccard": op6_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
    "op11_centroids": op11_centroids,
    "op12_fingerprints": op12_fingerprints,
    "op13_negatives": op13_negatives,
}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, {_sql(chat.ESCAPE)}, {_sql(chat.ESCAPE + '0')})"
    for control, letter in chat.CONTROLS.items():
        out = f"replace({out}, {_sql(control)}, {_sql(chat.ESCAPE + letter)})"
    return out


_CHAT_ROWS = """select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"""
_CHAT_ROLE = rf"replace(replace({_escaped_sql('role')}, chr(10), '\n'), ']', '\r')"
# a block adds the marks around its texts, a turn that goes on a block adds the mark before it
_CHAT_SQL = f"""
with rows as ({_CHAT_ROWS}),
turns as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as opens from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast({len(chat.BEGIN + chat.END)} + sum(length({_escaped_sql("text")})
    + case when opens then {len(chat.OPEN + chat.NAMED + chat.CLOSE)} + length({_CHAT_ROLE}) else {len(chat.TURN)} end) as bigint) as formatted_chars
from turns group by conv_id
"""

# repeated words: starts of windows that occur again in their text, each counted up to the next such start
_QUALITY_SQL = r"""
with docs as (select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, win) as n
  from (select doc_id, unnest(range(len(w) - 7)) as i, unnest([w[k + 1 : k + 8] for k in range(len(w) - 7)]) as win
        from words where len(w) >= 8)),
repeats as (
  select doc_id, sum(least(8, coalesce(next - i, 8))) as n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as next from windows where n > 1) group by doc_id),
lines as (
  select doc_id, host, text, trim(lower(l), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line
  from (select *, unnest(string_split(text, chr(10))) as l from docs)),
hosts as (select host, count(distinct doc_id) as all_docs from lines where line <> '' group by host),
common as (
  select host, line from lines join hosts using (host) where line <> '' group by host, line, all_docs
  having count(distinct doc_id) >= {most} or (count(distinct doc_id) >= {least} and 100 * count(distinct doc_id) >= {share} * all_docs)),
lost as (select doc_id, sum(length(line)) as removed from lines join common using (host, line) group by doc_id),
figures as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
      - len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(removed, 0) as bigint) as removed_chars
  from words left join repeats using (doc_id) left join lost using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, removed_chars,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * removed_chars > {gone} * (word_chars + n_words)) as kept
from figures
"""
_QUALITY_SQL = (
    _QUALITY_SQL.replace("{most}", str(quality.MOST_DOCS))
    .replace("{least}", str(quality.MIN_DOCS))
    .replace("{share}", str(quality.SHARE_PCT))
    .replace("{gone}", str(100 - quality.LEFT_PCT))
)

_VECTORS_SQL = """
with floors as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v, row_number() over () as nth from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scores as (
  select q.vec_id as query_id, q.nth, c.vec_id, cast(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) as bigint) as score
  from floors q join floors c on q.nth <> c.nth and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, cast(place as int) as rank, vec_id, score from (
  select *, row_number() over (partition by nth order by score desc, vec_id) as place from scores) where place <= 10
"""

# a digest's five-byte groups as eight letters each
_WARC_SQL = """
with rows as (select page_id, coalesce(html, '') as html from pages),
named as (
  select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as h, max(page_id) over (partition by html) as answers from rows)
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(h, 10 * (i // 8) + 1, 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as int), 1) for i in range(32)], '') as payload_digest,
  case when page_id = answers then 'response' else 'revisit' end as record_type,
  case when page_id = answers then null else answers end as refers_to
from named
"""

_CENTROIDS_SQL = """
with kept as materialized (
  select vec_id, row_number() over () as nth, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
c0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as int) as cluster, v as c
  from (select v, sha256('3:' || vec_id) as h from kept) order by h, v limit 8),
{rounds}
of_cluster as (select near.c as cluster, cast(sum(near.d) as bigint) as cluster_inertia from a10 group by 1)
select vec_id, near.c as cluster, near.d as distance, cluster_inertia,
  (select cast(sum(cluster_inertia) as bigint) from of_cluster) as inertia,
  sha256(array_to_string(c10.c, ',')) as centroid_sha256
from a10 join of_cluster on near.c = of_cluster.cluster join c10 on near.c = c10.cluster
"""
# the nearest of the centroids c<i>, then the floors of the means as c<i + 1>
_NEAREST_SQL = """a{i} as materialized (
  select nth, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': d, 'c': cluster}}) as near
  from (select k.*, c.cluster, cast(list_sum([(k.v[j] - c.c[j]) ** 2 for j in range(1, 65)]) as bigint) as d from kept k, c{i} c)
  group by nth),
"""
_MEANS_SQL = """c{next} as materialized (
  select cluster, coalesce(moved, c) as c from c{i} left join (
    select cluster, list(cast((s - (s % n + n) % n) // n as bigint) order by j) as moved
    from (select near.c as cluster, j, sum(x) as s, count(*) as n from (select near, unnest(v) as x, unnest(range(64)) as j from a{i}) group by 1, 2)
    group by cluster) using (cluster)),
"""
_CENTROIDS_SQL = _CENTROIDS_SQL.replace(
    "{rounds}",
    "".join(_NEAREST_SQL.format(i=i) + (_MEANS_SQL.format(i=i, next=i + 1) if i < 10 else "") for i in range(11)).rstrip(),
)

_NEGATIVES_SQL = """
with floors as (
  select row_number() over () as nth, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and label is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scores as materialized (
  select a.nth, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    cast(list_sum([a.v[i] * c.v[i] for i in range(1, len(a.v) + 1)]) as bigint) as score
  from floors a join floors c on a.nth <> c.nth and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
positives as (
  select * from (select *, row_number() over (partition by nth order by score desc, vec_id) as place from scores where same) where place <= 5),
negatives as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
    cast(row_number() over (partition by p.nth, p.place order by n.score desc, n.vec_id) as int) as rank
  from positives p join scores n on p.nth = n.nth and not n.same
  where 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 10
"""

ORACLE: dict[str, str] = {
    "op3_quality": _QUALITY_SQL,
    "op4_vectors": _VECTORS_SQL,
    "op5_chat": _CHAT_SQL,
    "op8_warc": _WARC_SQL,
    "op11_centroids": _CENTROIDS_SQL,
    "op13_negatives": _NEGATIVES_SQL,
}
