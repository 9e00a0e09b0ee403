"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import QueryMap, table

TOKENIZER = "byte_bpe_50k.json"

#: (host, path, verdict): the rule set of the URL query, as given.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.lm_score import stupid_backoff

    scored = stupid_backoff(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), "n_full", "n_unseen")


OP1_SQL = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents
), p as (
  select doc_id, len(ws) as n, unnest(range(1, len(ws) + 1)) as i, ws from w
), t as (
  select doc_id, n, i, ws[i] as c, case when i > 1 then ws[i - 1] end as b, case when i > 2 then ws[i - 2] end as a from p
), c1 as (select c, count(*) as k from t group by all),
c2 as (select b, c, count(*) as k from t where i > 1 group by all),
c3 as (select a, b, c, count(*) as k from t where i > 2 group by all),
d1 as (select doc_id, c, count(*) as k from t group by all),
d2 as (select doc_id, b, c, count(*) as k from t where i > 1 group by all),
d3 as (select doc_id, a, b, c, count(*) as k from t where i > 2 group by all),
j as (
  select t.doc_id, t.n, t.i, (select count(*) from t) - t.n as base,
         c1.k - d1.k as u, coalesce(c2.k - d2.k, 0) as g2, coalesce(c3.k - d3.k, 0) as g3,
         coalesce(h1.k - e1.k, 0) as x1, coalesce(h2.k - e2.k, 0) as x2
  from t join c1 on t.c = c1.c join d1 on t.doc_id = d1.doc_id and t.c = d1.c
  left join c2 on t.b = c2.b and t.c = c2.c left join d2 on t.doc_id = d2.doc_id and t.b = d2.b and t.c = d2.c
  left join c3 on t.a = c3.a and t.b = c3.b and t.c = c3.c
  left join d3 on t.doc_id = d3.doc_id and t.a = d3.a and t.b = d3.b and t.c = d3.c
  left join c1 h1 on t.b = h1.c left join d1 e1 on t.doc_id = e1.doc_id and t.b = e1.c
  left join c2 h2 on t.a = h2.b and t.b = h2.c left join d2 e2 on t.doc_id = e2.doc_id and t.a = e2.b and t.b = e2.c
), s as (
  select doc_id, n, case when g3 > 0 then 3 when g2 > 0 then 2 when u > 0 then 1 else 0 end as used, least(i, 3) as top,
         case when g3 > 0 then ln(g3) - ln(x2) when g2 > 0 then ln(g2) - ln(x1)
              when u > 0 then ln(u) - ln(base) else ln(0.5) - ln(greatest(base, 1)) end as l
  from j
)
select w.doc_id, len(ws) as n_words, coalesce(round(sum(l + (top - greatest(used, 1)) * ln(0.4)), 5), 0) as log_score,
       coalesce(sum((used = 3)::int), 0)::bigint as n_full, coalesce(sum((used = 0)::int), 0)::bigint as n_unseen
from w left join s on w.doc_id = s.doc_id group by w.doc_id, len(ws)
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP2_SQL = """
with parts as (
  select page_id,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), split as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(h, p, v) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), hits as (
  select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as nth
  from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select s.page_id, s.host, s.path, t.rule, coalesce(t.v, 'allow') as verdict
from split s left join hits t on s.page_id = t.page_id and t.nth = 1
"""


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, tables=14)


#: All pairs that share a shingle, and a recursive closure: for small tables.
OP4_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as g
  from w
), n as (select doc_id, len(g)::bigint as n from s),
u as (select doc_id, unnest(g) as sh from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from u a join u b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
reach(doc_id, r) as (select doc_id, doc_id from n union select reach.doc_id, e.b from reach join e on reach.r = e.a)
select n.doc_id, n.n as n_shingles, min(r) as component_id, n.doc_id = min(r) as kept
from n join reach on n.doc_id = reach.doc_id group by n.doc_id, n.n
"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and a recursive closure: for small tables.
OP5_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
      where list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach(vec_id, r) as (select vec_id, vec_id from v union select reach.vec_id, l.b from reach join l on reach.r = l.a),
n as (select vec_id, count(b) as n_links from v left join l on vec_id = a group by vec_id)
select n.vec_id, n_links, min(r) as component_id, n.vec_id = min(r) as kept
from n join reach on n.vec_id = reach.vec_id group by n.vec_id, n_links
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.secrets import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_random")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.mixing import schedule

    return schedule(table(spark, sf_dir, "documents"))


OP7_SQL = """
with recursive counts as (
  select source, count(*) as n, pow(count(*), 0.5) as w from documents group by source
), ideal as (
  select source, n, count(*) over () as m, (1000 - count(*) over ()) * w / sum(w) over () as ideal from counts
), whole as (
  select *, floor(round(ideal, 9))::bigint as whole from ideal
), ranked as (
  select *, 1000 - m - sum(whole) over () as short,
         row_number() over (order by round(ideal - whole, 9) desc, source) as nth from whole
), units as (
  select source, nth, (1 + whole + (nth <= short)::int)::bigint as units from ranked
), s as (
  select list(units order by nth) as u from units
), turns(slot, done, i) as (
  select -1, list_transform(u, lambda x: 0::bigint), null::bigint from s
  union all
  select slot + 1,
         list_transform(done, lambda d, j: if(j = pick.i, d + 1, d)),
         pick.i
  from (
    select slot, done, list_min(list_filter(list_transform(u, lambda x, j: {
             'due': ((done[j] + 1) * 1000 + x - 1) // x, 'i': j::bigint, 'free': done[j] * 1000 // x, 'left': x - done[j]}),
             lambda y: y.free <= slot + 1 and y.left > 0)) as pick
    from turns, s where slot < 999)
), plan as (
  select slot, nth, units, source, row_number() over (partition by i order by slot) - 1 as unit
  from turns join units on nth = i where slot >= 0
), ranks as (
  select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) - 1 as rank from documents
), blocks as (
  select r.doc_id, r.source, u.units, r.rank // 8 as block, r.rank % 8 as place from ranks r join units u on r.source is not distinct from u.source
)
select b.doc_id, b.source, b.units, b.block, (b.block // b.units) * 1000 + p.slot as slot, b.place
from blocks b join plan p on b.source is not distinct from p.source and b.block % b.units = p.unit
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.exact_dedup import exact_duplicates

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
with t as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept,
       text_sha256
from t window w as (partition by text_sha256 order by points desc, doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> QueryMap:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_url_filter": op2_url_filter,
        "op3_html_text": op3_html_text,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_mixing": op7_mixing,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_score": OP1_SQL, "op2_url_filter": OP2_SQL, "op4_minhash_dedup": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op7_mixing": OP7_SQL, "op8_exact_dedup": OP8_SQL}
