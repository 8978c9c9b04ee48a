"""The queries of this subpackage over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspan.llm import centroids, lines, mixing, packing, pages, paragraphs, prefixes, quality, sharding, simhash, sketch, suffixes, topk
from bidspan.llm.common import table

SHARDS = 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def vocabulary() -> dict[str, str]:
    """The files of the byte-level vocabulary; an installed package names them on every machine."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), **vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _tree_values() -> str:
    """The two trees as SQL rows: tree, level, parent, name, weight, shard."""
    rows = []
    for tree, count in (("now", SHARDS), ("grown", SHARDS + 1)):
        leaves = sharding.uniform_tree(count)
        for region in dict.fromkeys(x.region for x in leaves):
            mine = [x for x in leaves if x.region == region]
            rows.append(f"('{tree}', 1, '', '{region}', {sum(x.weight for x in mine)}::double, -1)")
            for rack in dict.fromkeys(x.rack for x in mine):
                own = [x for x in mine if x.rack == rack]
                rows.append(f"('{tree}', 2, '{region}', '{region}/{rack}', {sum(x.weight for x in own)}::double, -1)")
                rows += [f"('{tree}', 3, '{region}/{rack}', '{region}/{rack}/{x.shard}', {x.weight}::double, {x.shard})" for x in own]
    return ", ".join(rows)


#: DuckDB has no CRC-32: a table of 256 entries from the polynomial, folded over the bytes.
_CRC = """
  crc_table as (select list(v order by n) as t from (
    select n, list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as n)))"""
_BYTES = "list_transform(range(1, (octet_length({0}) + 1)::bigint), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::bigint)"

_OP2 = f"""
with recursive nodes(tree, level, parent, name, weight, shard) as (values {_tree_values()}),{_CRC},
  d as (select row_number() over () as rid, doc_id, coalesce(doc_id::varchar, 'null') as k, coalesce(text, '') as text from documents),
  texts as (select distinct text, encode(text) as b from d),
  crcs as (
    select text, xor(list_reduce(list_prepend(4294967295::bigint, {_BYTES.format('b')}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as crc
    from texts, crc_table),
  draws as (select rid, tree, level, parent, name, shard, -ln((('0x' || substr(md5(k || '|' || name), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) / weight as score from d, nodes),
  best as (select rid, tree, level, parent, arg_min(name, score) as name, arg_min(shard, score) as shard from draws group by all),
  leaf as (
    select c.rid, c.tree, c.shard from best a join best b on a.rid = b.rid and a.tree = b.tree and b.level = 2 and b.parent = a.name
    join best c on c.rid = b.rid and c.tree = b.tree and c.level = 3 and c.parent = b.name where a.level = 1),
  placed as (
    select d.doc_id, d.k, octet_length(encode(d.text))::bigint + 1 as size, crc as text_crc32, n.shard, g.shard as grown_shard
    from d join crcs using (text) join leaf n on n.rid = d.rid and n.tree = 'now' join leaf g on g.rid = d.rid and g.tree = 'grown')
select doc_id, size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by substr(md5('slot|' || k || '|' || text_crc32), 1, 3), doc_id nulls first, text_crc32, size) - 1 as slot,
  grown_shard::int as grown_shard
from placed"""


@query("op2_sharding", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.uniform_tree(SHARDS), sharding.uniform_tree(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_OP5 = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
  l as (select doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select doc_id, unnest(lines) as x, generate_subscripts(lines, 1) as i from d)),
  shared as (select key, max(doc_id) as holder from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (not gone), '')) as kept_sha256
from (select l.*, coalesce(l.doc_id <> s.holder, false) as gone from l left join shared s using (key))
group by doc_id"""


@query("op5_lines", _OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_OP10 = f"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
      ('0x' || substr(md5(concat_ws('|', 'mix', doc_id::varchar)), 1, 15))::bigint as ord, text from documents),
  s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from d group by source),
  w as (select *, [{', '.join(map(str, mixing.WEIGHTS))}][((rank - 1) % {len(mixing.WEIGHTS)} + 1)::int]::double as weight from s),
  f as (select *, {mixing.MOST} * source_size as cap, {mixing.MOST} * source_size / weight as full_at from w),
  v as (select *, (sum(source_size) over () * {mixing.SHARE}::double - coalesce(sum(cap) over (order by full_at, rank rows between unbounded preceding and 1 preceding), 0)::double)
      / sum(weight) over (order by full_at, rank rows between current row and unbounded following) as level from f),
  t as (select source, rank, source_size, least(cap::double, weight * (select max(level) from v where level <= full_at)) as target from v),
  e as (select rank, sum(target) over (order by rank rows unbounded preceding) / nullif(sum(target) over (), 0) as high from t),
  ns as (select 2 * coalesce(sum(ceil(target / {mixing.BLOCK_WORDS})), 0)::bigint + {mixing.SPARE_SLOTS} as n from t),
  sl as (
    select slot, least(count(*) filter (high <= point) + 1, count(*)) as rank
    from (select unnest(range(n)) as slot, (((slot + 1) % {mixing.POINTS}::bigint) * {mixing.STEP} % {mixing.POINTS}::bigint)::double / {mixing.POINTS} as point from ns), e group by slot),
  sn as (select slot, rank, row_number() over (partition by rank order by slot) - 1 as block from sl),
  p as (
    select d.*, t.rank, t.source_size, t.target, round(t.target)::bigint as want,
      (sum(size) over (partition by d.source order by ord, doc_id nulls first, size rows between unbounded preceding and current row))::bigint - size as start
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (greatest(0, least(start + size, want) - start) + greatest(0, least(source_size + start + size, want) - source_size - start))::bigint as taken,
  case when size > 0 and start < want then coalesce(slot, (select n from ns) + start // {mixing.BLOCK_WORDS})::bigint end as slot
from p left join sn on sn.rank = p.rank and sn.block = p.start // {mixing.BLOCK_WORDS}"""


@query("op10_mixing", _OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(mixing.mix_documents(table(spark, sf_dir, "documents")))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "slot")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


@query("op9_sketch")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.compare_edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.fingerprint_text(F.col("sketch")).alias("fingerprint"), sketch.fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next", "held_by_edited",
    )


_OP4 = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 5"""


@query("op4_topk", _OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_paragraphs")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.shared_paragraphs(table(spark, sf_dir, "documents"))


@query("op6_pages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def _kmeans_sql() -> str:
    """The rounds written out: a table of centroids and one of assignments each."""
    kept = f"""
with v as (
    select vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as v from embeddings
    where len(embedding) = {centroids.DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  n as (select row_number() over (order by sha256('{centroids.SEED}:' || vec_id::varchar) nulls last, v) as rid, * from v),
  c0 as (select rid - 1 as cluster, v as c from n where rid <= {centroids.K})"""
    steps = []
    for i in range(centroids.ROUNDS + 1):
        steps.append(f"""
  a{i} as (
    select rid, arg_min(cluster, (d, cluster)) as cluster, min(d) as d
    from (select rid, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from n, c{i}) group by rid)""")
        if i < centroids.ROUNDS:
            steps.append(f"""
  s{i} as (
    select cluster, list((s - (((s % k) + k) % k)) // k order by axis) as c
    from (select cluster, axis, sum(x)::hugeint as s, count(*) as k from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as axis from n join a{i} using (rid)) group by cluster, axis)
    group by cluster),
  c{i + 1} as (select cluster, coalesce(s{i}.c, c{i}.c)::bigint[] as c from c{i} left join s{i} using (cluster))""")
    r = centroids.ROUNDS
    return f"""{kept},{",".join(steps)}
select vec_id, cluster::int as cluster, d as distance, (sum(d) over (partition by cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from n join a{r} using (rid) join c{r} using (cluster)"""


@query("op12_centroids", _kmeans_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


_OP11 = f"""
with t as (
    select conv_id, md5(octet_length(encode(role)) || ':' || role || text) as sym, octet_length(encode(text)) as n_bytes,
      row_number() over (partition by conv_id order by turn nulls first, role, md5(octet_length(encode(role)) || ':' || role || text)) - 1 as pos
    from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),{_CRC},
  c as (
    select conv_id, conv_id - conv_id % {prefixes.LENDER} as lender,
      xor(list_reduce(list_prepend(4294967295::bigint, {_BYTES.format('b')}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) % {prefixes.LENT} as h
    from (select distinct conv_id, encode(conv_id::varchar) as b from t), crc_table),
  r as (
    select c.conv_id, 0 as part, pos, sym, n_bytes from c join t on t.conv_id = c.lender and pos < h
    union all select c.conv_id, 1, pos, sym, n_bytes from c join t on t.conv_id = c.conv_id and pos >= h),
  k as (select conv_id, n_bytes, row_number() over w as depth, md5(string_agg(sym, '') over w) as key from r window w as (partition by conv_id order by part, pos)),
  m as (
    select conv_id, depth, key, coalesce(lag(key) over (partition by conv_id order by depth), '') as up, n_bytes from k
    union all select conv_id, 0, '', null, 0 from c),
  ends as (select arg_max(key, depth) as key, conv_id from m group by conv_id),
  tips as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from ends group by key),
  n as (select key, up, min(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * min(n_bytes) as saved from m group by key, up),
  below as (select distinct a.key, b.key as under from m a join m b on a.conv_id = b.conv_id and a.depth <= b.depth),
  children as (select up as key, count(*) as n_children from n group by up),
  total as (
    select below.key, count(*) filter (children.key is null) as n_leaves, sum(saved) as saved_tokens
    from below join n on n.key = under left join children on children.key = under group by below.key)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
  saved_tokens::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from n left join n p on p.key = n.up left join children on children.key = n.key join total on total.key = n.key left join tips on tips.key = n.key"""


@query("op11_prefixes", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_suffixes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
