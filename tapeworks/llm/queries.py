"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark, sf_dir):
    from tapeworks.llm.line_crf import score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_jaccard_join(spark, sf_dir):
    from tapeworks.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id", "n_links"
    )


def op4_decontaminate(spark, sf_dir):
    from tapeworks.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark, sf_dir):
    from tapeworks.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", F.col("__n_tokens").alias("n_tokens"), F.col("__weight").alias("weight"),
        F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__place").alias("place"),
    )


def op3_html_consensus(spark, sf_dir):
    from tapeworks.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_graph_search(spark, sf_dir):
    from tapeworks.llm.graph_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_line_dedup(spark, sf_dir):
    from tapeworks.llm.line_dedup import apply_bitmaps, line_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, line_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op8_sharding(spark, sf_dir):
    from tapeworks.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op9_personal_data(spark, sf_dir):
    from tapeworks.llm.personal_data import joined, personal_spans, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = personal_spans(docs, train(docs))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op10_suffix_dedup(spark, sf_dir):
    from tapeworks.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_hilbert_centroids(spark, sf_dir):
    from tapeworks.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"),
    )


def op12_prefix_trie(spark, sf_dir):
    from tapeworks.llm.prefix_trie import rebuilt_turns, trie_nodes

    return trie_nodes(rebuilt_turns(table(spark, sf_dir, "conversations"), 20, 4)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op13_byte_bpe(spark, sf_dir, vocabulary: str | None = None):
    import public_tokenizers

    from tapeworks.llm.byte_bpe import decode, encode, model_json, read_ranks

    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = model_json(ranks, public_tokenizers.PATTERN)
    tokens = encode(table(spark, sf_dir, "documents"), model, places=False).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(tokens, model, keep=["n_tokens", "ids_sha256", "n_split"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_split"
    )


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_jaccard_join, op3_html_consensus, op4_decontaminate, op5_mix_sources, op6_graph_search, op7_line_dedup, op8_sharding, op9_personal_data, op10_suffix_dedup, op11_hilbert_centroids, op12_prefix_trie, op13_byte_bpe)}

def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of integer k-means, one pair of tables each."""
    near = """a{i} as materialized (select vec_id, v, min_by(c, d * 1000 + c) as c, min(d) as d from
  (select x.vec_id, x.v, y.c, cast(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v x, c{i} y) group by vec_id, v)"""
    move = """s{i} as materialized (select c, pos, cast(sum(e) as hugeint) as s, count(*) as n from (select c, unnest(v) as e, generate_subscripts(v, 1) as pos from a{i}) group by c, pos),
m{i} as materialized (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as v from s{i} group by c),
c{j} as materialized (select o.c, coalesce(m.v, o.v) as v from c{i} o left join m{i} m on m.c = o.c)"""
    steps = ",\n".join(f"{near.format(i=i)},\n{move.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""
with v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as c, v from v order by sha256('2:' || vec_id) limit {k}),
{steps},
{near.format(i=rounds)}
select vec_id, a.c as cluster, d as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(k.v, ',')) as centroid_sha256 from a{rounds} a join c{rounds} k on k.c = a.c
"""

#: crc32 of the decimal number modulo 4, bit by bit over the bytes.
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({n}::varchar) + 1), lambda i: ascii(substr({n}::varchar, i::int, 1))::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

_TRIE_SQL = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i from conversations where conv_id is not null),
n as (select conv_id, count(*) as n from t group by conv_id),
c as (select conv_id, conv_id - conv_id % 20 as base, xor({_CRC.format(n="conv_id")}, 4294967295) % 4 as h from n),
b as (select c.*, least(h, coalesce(n.n, 0)) as got from c left join n on n.conv_id = c.base),
r as (select b.conv_id, t.i as d, role, text from b join t on t.conv_id = b.base and t.i <= b.h
  union all select b.conv_id, t.i - b.h + b.got, role, text from b join t on t.conv_id = b.conv_id and t.i > b.h
  union all select conv_id, 0, '', '' from b),
w as (select conv_id, d, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words,
  sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') over (partition by conv_id order by d)) || d as g from r),
p as materialized (select *, lag(g) over (partition by conv_id order by d) as pg, max(d) over (partition by conv_id) as len from w),
k as materialized (select g, any_value(pg) as pg, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
  coalesce(string_agg(conv_id, ',' order by conv_id) filter (where d = len), '') as ends from p group by g),
f as (select pg as g, count(*) as n_children from k where pg is not null group by pg),
u as (select distinct x.g, y.g as below from p x join p y on x.conv_id = y.conv_id and y.d >= x.d),
s as (select u.g, count(*) filter (where f.g is null) as n_leaves, cast(sum((k.n_convs - 1) * k.words) as bigint) as saved_tokens
  from u join k on k.g = u.below left join f on f.g = u.below group by u.g)
select k.conv_id, k.depth, q.conv_id as parent_conv_id, k.n_convs, coalesce(f.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, sha256(k.ends) as ends_sha256
from k join s on s.g = k.g left join f on f.g = k.g left join k q on q.g = k.pg
"""

ORACLES = {
    "op12_prefix_trie": _TRIE_SQL,
    "op11_hilbert_centroids": _centroid_sql(),
    "op2_jaccard_join": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as root from w union select e.b, r.root from r join e on r.node = e.a),
c as (select node, min(root) as root from r group by node),
q as (select a, b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where c = x.n and c = y.n),
k as (select w.doc_id, least(w.doc_id, coalesce(min(q.a), w.doc_id)) as class_id from w left join q on q.b = w.doc_id group by w.doc_id),
d as (select e.a, count(distinct y.class_id) as n_links from e join k x on x.doc_id = e.a join k y on y.doc_id = e.b
  where x.class_id <> y.class_id group by e.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.root as component_id, k.class_id, coalesce(d.n_links, 0) as n_links
from w left join n on w.doc_id = n.doc_id join c on c.node = w.doc_id join k on k.doc_id = w.doc_id left join d on d.a = w.doc_id
""",
    "op7_line_dedup": r"""
with l as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
x as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from l),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
d as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.doc_id, k.line, k.pos, d.top is not null and k.doc_id < d.top as gone from k left join d on k.key = d.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id
""",
}
