"""One query per operator over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.llm import align, codebooks, decontamination, langid, licenses, line_dedup, mixing, near_dedup, packing, quality, secrets, topk, warc
from stripcohort.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than a tenth of their source's documents contain."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "emptied", "text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and the benchmark item that it holds at least half of."""
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aligned = align.align(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"), spans=False)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return align.with_counts(aligned.withColumn("groups_sha256", digest)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 8 parts with 16 entries each, after 6 rounds."""
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codebooks.with_label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_line_dedup, op2_secret_scan, op3_source_mix, op4_near_duplicates, op5_language_id, op6_license_scan, op7_decontamination, op8_warc_archives, op9_top_k, op10_quality, op11_token_alignment, op12_packing, op13_vector_codes)
    return {f.__name__: f for f in found}


ORACLE_SQL = {
    "op1_line_dedup": """
with d as (select doc_id, source, text, row_number() over () as rid from documents),
l as (select distinct rid, source, unnest(string_split(text, chr(10))) as line from d),
n as (select source, line, count(*) as n from l where line <> '' group by source, line),
t as (select source, count(*) as total from d group by source),
f as (select n.source, list(n.line) as lines from n join t on n.source is not distinct from t.source
      where n.n >= 2 and n.n > 0.1 * t.total group by n.source),
x as (select d.*, string_split(text, chr(10)) as ls,
        list_filter(string_split(text, chr(10)), lambda y: y = '' or f.lines is null or not list_contains(f.lines, y)) as kept
      from d left join f on d.source is not distinct from f.source),
y as (select *, coalesce(len(list_filter(ls, lambda y: y <> '')), 0) as n_lines, coalesce(len(list_filter(kept, lambda y: y <> '')), 0) as rest from x)
select doc_id, source, cast(n_lines as bigint) as n_lines,
  cast(n_lines - rest as bigint) as n_dropped, n_lines > 0 and rest = 0 as emptied,
  case when rest < n_lines then array_to_string(kept, chr(10)) else text end as text
from y""",
    "op4_near_duplicates": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct doc_id, case when len(ws) >= 5 then array_to_string(ws[i : i + 4], ' ') else 'short ' || array_to_string(ws, ' ') end as gram
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, case when len(ws) > 0 then 2 else 1 end))) as i from w)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
r(node, seen) as (select a, b from e union select r.node, e.b from r join e on r.seen = e.a),
c as (select node, least(node, min(seen)) as root from r group by node)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.root, w.doc_id) as component_id, coalesce(c.root, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join c on c.node = w.doc_id""",
    "op8_warc_archives": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha256(html) as digest from p),
f as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to
from f""",
    "op9_top_k": """
with v as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.n, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
      from v q join v c on q.n <> c.n where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
}


def _codes_sql(rounds: int = 6) -> str:
    """The rounds of op13 one after the other: entries c0, c1, ... by part, and who is nearest to which."""
    nearest = """n{k} as materialized (select id, p, list_min(list_transform(e, lambda x: {{'d': list_sum(list_transform(range(1, 9), lambda i: (x.e[i] - v[i]) * (x.e[i] - v[i]))), 'j': x.j}})) as b, v
      from pt join (select p, list({{'j': j, 'e': e}}) as e from c{k} group by p) using (p))"""
    moved = """c{k} as materialized (select o.p, o.j, coalesce(m.e, o.e) as e from c{before} o left join (
      select p, b.j as j, list_transform(range(1, 9), lambda i: floor(list_sum(list_transform(list(v), lambda w: w[i])) / count(*))) as e from n{before} group by p, b.j) m on m.p = o.p and m.j = o.j)"""
    steps = [nearest.format(k=0)]
    for k in range(1, rounds + 1):
        steps += [moved.format(k=k, before=k - 1), nearest.format(k=k)]
    return f"""
with q as (select row_number() over (order by vec_id, embedding) as id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pt as materialized (select id, p, v[8 * p + 1 : 8 * p + 8] as v from q cross join (select unnest(range(0, 8)) as p)),
c0 as materialized (select p, id - 1 as j, v as e from pt where id <= 16),
{", ".join(steps)},
r as (select id, string_agg(lpad(lower(to_hex(b.j::bigint)), 2, '0'), '' order by p) as code, cast(sum(b.d) as bigint) as error from n{rounds} group by id),
h as (select sha256(string_agg(array_to_string(list_transform(e, lambda x: cast(x as bigint)), ','), ',' order by p, j)) as h from c{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from q join r using (id) cross join h"""


ORACLE_SQL["op13_vector_codes"] = _codes_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
