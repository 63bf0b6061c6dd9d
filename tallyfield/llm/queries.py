"""The registered queries of the training-data operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, jaccard, language, mixing, packing, passages, quality, spelling, tokens, trie, urls, vectors, warc


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"), run=passages.RUN)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents")).drop("n_bytes")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages")).drop("via_alias")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(_table(spark, sf_dir, "documents"), mixing.label_domains(_table(spark, sf_dir, "labels")))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


EXACT_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from d
"""


#: The 256 steps of crc32.
_CRC_STEPS = """steps as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab
  from (select range as i from range(256))
)"""

TRIE_SQL = f"""
with {_CRC_STEPS}, turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) as pos,
         struct_pack(role := coalesce(role, ''), said := coalesce(text, '')) as turn
  from conversations where conv_id is not null
), convs as (
  select conv_id, list(turn order by pos) as own, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
         lambda c, b: xor(c >> 8, any_value(tab)[(xor(c, b) & 255) + 1]))) % 6 as h
  from turns, steps group by conv_id
), rebuilt as (
  select c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) as seq from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100
), paths as (
  select conv_id, d as depth, seq[1:d] as node, d = len(seq) as ends from (select *, unnest(range(len(seq) + 1)) as d from rebuilt)
), nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids,
         (count(*) - 1) * coalesce(length(node[depth].said), 0) as saved
  from paths group by node, depth
), kids as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
below as (
  select t.node[1:d] as node, count(*) filter (t.leaf) as n_leaves, sum(t.saved)::bigint as saved_tokens
  from (select n.node, n.saved, k.node is null as leaf, unnest(range(n.depth + 1)) as d from nodes n left join kids k on n.node = k.node) t group by 1
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, b.n_leaves, b.saved_tokens, sha256(n.ids) as ends_sha256
from nodes n join below b on b.node = n.node left join kids k on k.node = n.node left join nodes p on n.depth > 0 and p.node = n.node[1:n.depth - 1]
"""


#: Words that lose one code point to the same rest at the same place are one replacement apart.
SPELLING_SQL = f"""
with recursive {_CRC_STEPS}, runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as run from documents
), hexed as (select run, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs where length(run) >= 7),
hashed as (
  select run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i::bigint, 2))::bigint)),
         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) as h from hexed, steps
), words as (
  select word, count(*) as n from (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from hashed)
  where length(word) >= 7 group by word having count(*) >= 2
), cuts as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
shorter as (select distinct c.word as a, w.word as b from cuts c join words w on c.rest = w.word),
pairs as (
  select distinct x.word, y.word as near from cuts x join cuts y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union all select a, b from shorter union all select b, a from shorter
), best as (
  select p.word, count(*) as n_near, arg_min(p.near, row(-w.n, p.near)) as near, max(w.n) as near_n from pairs p join words w on w.word = p.near group by p.word
), forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 10 * w.n then b.near end as form, case when b.near_n >= 10 * w.n then b.near_n end as form_n
  from words w left join best b on w.word = b.word
), led as (
  select word, form as root, 1 as steps from forms where form is not null
  union all select l.word, f.form, l.steps + 1 from led l join forms f on f.word = l.root where f.form is not null
)
select f.word, f.form, coalesce(l.root, f.word) as root, f.n, f.n_near, f.form_n
from forms f left join (select word, arg_max(root, steps) as root from led group by word) l on l.word = f.word
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (op1_warc, op2_passages, op3_vectors, op4_exact, op5_packing, op6_quality, op7_urls, op8_jaccard, op9_mixing, op10_tokens, op11_prefix_trie, op12_language, op13_spelling, pipeline)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact": EXACT_SQL, "op7_urls": urls.ORACLE, "op11_prefix_trie": TRIE_SQL, "op13_spelling": SPELLING_SQL}
