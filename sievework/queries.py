"""The registered queries of the feature-selection engine, with the SQL they are held against.

Three nominal fixtures are derived from the tables: `docs` (documents and their quality), `price` (line items and a price
band) and `region` (orders and the customer's region).
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators import layout, measures
from sievework.operators.contingency import count_against, count_against_vertical, count_pairs
from sievework.operators.encode import Encoded, assemble, categories, encode, informative, with_codes
from sievework.plans.search import top_states
from sievework.plans.selector import CorrelationFeatureSelector, CorrelationFeatureSelectorModel
from sievework.sources import read_any, sample_rows

#: name -> (features, Spark SQL of the raw columns and the label y, DuckDB SQL of the same)
DOCS = ["lang", "source", "lc", "toxic", "dot", "pipe", "dig", "nl"]
PRICE = ["q10", "ub", "ls", "rf", "ln", "disc", "yr"]
REGION = ["op", "yr", "qq", "mm", "seg", "nk", "nk7"]
FIXTURES = {
    "docs": (
        DOCS,
        r"""select doc_id, lang, source, length(bin(n_chars + 1)) - 1 lc, toxic, cast(contains(text, '.') as int) dot, cast(contains(text, '|') as int) pipe,
               cast(text rlike '[0-9]' as int) dig, cast(contains(text, '\n') as int) nl, quality y from documents join labels using (doc_id)""",
        """select doc_id, lang, source, length(bin(n_chars + 1)) - 1 lc, toxic, contains(text, '.')::int dot, contains(text, '|')::int pipe,
               regexp_matches(text, '[0-9]')::int dig, contains(text, chr(10))::int nl, quality y from documents join labels using (doc_id)""",
    ),
    "price": (
        PRICE,
        """select cast(floor(l_quantity / 10) as int) q10, length(bin(cast(floor(l_extendedprice / l_quantity) as bigint))) ub, l_linestatus ls, l_returnflag rf, l_linenumber ln,
               cast(round(l_discount * 100) as int) disc, year(l_shipdate) yr, cast(floor(l_extendedprice / 15000) as int) y from lineitem""",
        """select floor(l_quantity / 10)::int q10, length(bin(floor(l_extendedprice / l_quantity)::bigint)) ub, l_linestatus ls, l_returnflag rf, l_linenumber ln,
               round(l_discount * 100)::int disc, year(l_shipdate)::int yr, floor(l_extendedprice / 15000)::int y from lineitem""",
    ),
    "region": (
        REGION,
        """select o_orderpriority op, year(o_orderdate) yr, quarter(o_orderdate) qq, month(o_orderdate) mm, c_mktsegment seg, c_nationkey nk, c_nationkey div 7 nk7, n_regionkey y
               from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
        """select o_orderpriority op, year(o_orderdate)::int yr, quarter(o_orderdate)::int qq, month(o_orderdate)::int mm, c_mktsegment seg, c_nationkey nk, c_nationkey // 7 nk7, n_regionkey y
               from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    ),
}
# with a constant before the others, so that features are dropped and indices move; region keys crossed: two exactly independent columns
FIXTURES["constant"] = (["one", *DOCS], f"select 'same' one, * from ({FIXTURES['docs'][1]}) r", f"select 'same' one, * from ({FIXTURES['docs'][2]}) r")
_CROSSED = "select a.r_regionkey a, b.r_regionkey b, a.r_regionkey y from region a cross join region b"
FIXTURES["crossed"] = (["a", "b"], _CROSSED, _CROSSED)
_TABLES = {"docs": ["documents", "labels"], "price": ["lineitem"], "region": ["orders", "customer", "nation"], "constant": ["documents", "labels"], "crossed": ["region"]}
PATIENCE = 5


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raw nominal columns of a fixture; tables are named per call, so concurrent calls don't meet."""
    sql = FIXTURES[name][1]
    frames = {t: read_any(spark, f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    for t in frames:
        sql = re.sub(rf"\b(from|join) {t}(?: ([ab])\b(?! *=))?", lambda m, t=t: f"{m[1]} {{{t}}} {m[2] or t}", sql)
    return spark.sql(sql, **frames)


def encoded(spark: SparkSession, sf_dir: str, name: str) -> Encoded:
    return encode(fixture(spark, sf_dir, name), FIXTURES[name][0], "y")


def rows_of(e: Encoded) -> DataFrame:
    return layout.horizontal(e.codes, [*e.features, "label"])


def _r(c: str) -> F.Column:
    return (F.round(c, 9) + F.lit(0.0)).alias(c)


# --- SQL building blocks -------------------------------------------------------------------------------------------


def _codes_sql(name: str, key: str = "") -> str:
    features, _, raw = FIXTURES[name]
    ranks = ", ".join(f"dense_rank() over (order by {c}) - 1 as f{i}" for i, c in enumerate([*features, "y"]))
    return f"raw as ({raw}), codes as (select {key + ', ' if key else ''}{ranks} from raw)"


def _cells_sql(name: str) -> str:
    """All pairs i < j, the label last."""
    p = len(FIXTURES[name][0])
    parts = [f"select {i} as i, {j} as j, f{i} as v, f{j} as w, count(*) as n from codes group by f{i}, f{j}" for i in range(p + 1) for j in range(i + 1, p + 1)]
    return f"{_codes_sql(name)}, cells as ({' union all '.join(parts)})"


def _su_sql(name: str) -> str:
    p = len(FIXTURES[name][0])
    margins = " union all ".join(f"select {i} as i, f{i} as v, count(*) as n from codes group by f{i}" for i in range(p + 1))
    return f"""{_cells_sql(name)}, margins as ({margins}),
h as (select i, ln(sum(n)) - list_sum(list(n * ln(n) order by n)) / sum(n) as h from margins group by i),
hj as (select i, j, ln(sum(n)) - list_sum(list(n * ln(n) order by n)) / sum(n) as h from cells group by i, j),
plain as (select hj.i, hj.j, case when a.h + b.h = 0 then 0 else 2 * (a.h + b.h - hj.h) / (a.h + b.h) end as su
          from hj join h a on a.i = hj.i join h b on b.i = hj.j),
su as (select i, j, case when abs(su) < 1e-6 then case when j = {p} then 0.0 else 1.0 end else su end::double as su from plain)"""


def _merit_sql(f: str, p: int) -> str:
    """Merit of the list f over the map m."""
    s = f"list_sort({f})"
    outer = f"list_sum(list_transform({s}, lambda x: m[x * 1000 + {p}]))"
    inner = f"coalesce(list_sum(flatten(list_transform({s}, lambda x: list_transform(list_filter({s}, lambda y: y > x), lambda y: m[x * 1000 + y])))), 0)"
    return f"abs(coalesce({outer} / nullif(sqrt(len({f}) + 2 * {inner}), 0), 0))"


def _trace_sql(name: str, patience: int = PATIENCE) -> str:
    p = len(FIXTURES[name][0])
    new = f"list_transform(list_filter(range(0, {p}), lambda f: not list_contains(queue[1].f, f)), lambda f: list_append(queue[1].f, f))"
    return f"""{_su_sql(name)}, sums as (select map(list(i * 1000 + j), list(su)) as m from su),
trace(it, queue, best, bm, nf, done, expanded, n_new, imp) as (
  select 0, [{{'k': 0.0::double, 'a': 0::bigint, 'f': []::bigint[]}}], []::bigint[], 0.0::double, 0, false, []::bigint[], 0::bigint, false
  union all
  select it + 1, q2, case when imp then q2[1].f else best end, case when imp then -q2[1].k else bm end,
         case when imp then 0 else nf + 1 end, len(q2) = 0 or (not imp and nf + 1 >= {patience}), queue[1].f, len(new), imp
  from (
    select *, coalesce(-q2[1].k - bm > 1e-5, false) as imp from (
      select it, queue, best, bm, nf, new,
             list_sort(list_concat(
               list_transform(queue[2:], lambda e, ix: {{'k': e.k, 'a': ix::bigint, 'f': e.f}}),
               list_transform(new, lambda f, ix: {{'k': -round({_merit_sql('f', p)}, 12), 'a': 100000 + ix::bigint, 'f': f}})))[1:{patience}] as q2
      from (select t.*, m, {new} as new from trace t, sums where not done)))
)"""


def _final_sql(name: str, patience: int = PATIENCE) -> str:
    """chosen(sel): best subset and locally predictive features, in order."""
    p = len(FIXTURES[name][0])
    pair = lambda a, b: f"m[least({a}, {b}) * 1000 + greatest({a}, {b})]"
    return f"""{_trace_sql(name, patience)},
last as (select best, bm, m from trace, sums order by it desc limit 1),
rest as (select list(i order by round(su, 12) desc, i) as c from su, last where j = {p} and not list_contains(best, i)),
pick(pos, sel) as (
  select 0::bigint, best from last
  union all
  select pos + 1, case when len(list_filter(sel, lambda g: round({pair('g', 'c[pos + 1]')}, 12) > round(m[c[pos + 1] * 1000 + {p}], 12))) = 0
                      then list_append(sel, c[pos + 1]) else sel end
  from pick, rest, last where pos < coalesce(len(c), 0)
),
chosen as (select sel from pick order by pos desc limit 1)"""


# --- queries -------------------------------------------------------------------------------------------------------


def nominal_encode(spark, sf_dir):
    raw = fixture(spark, sf_dir, "docs")
    columns = [*DOCS, "y"]
    coded = with_codes(raw, columns, categories(raw, columns), keep=["doc_id"])
    return coded.select(F.col("k0").alias("doc_id"), *[F.col(f"c{i}").alias(f"{c}_code") for i, c in enumerate(columns)])


NOMINAL_SQL = f"with {_codes_sql('docs', 'doc_id')} select doc_id, " + ", ".join(f"f{i}::int as {c}_code" for i, c in enumerate([*DOCS, "y"])) + " from codes"


def sample_fraction(spark, sf_dir):
    return sample_rows(read_any(spark, f"{sf_dir}/documents.parquet").select("doc_id"), 0.5, seed=7)


def sample_bounds(spark, sf_dir):
    """What holds of every sample of a half: its size within five standard deviations, no row twice, none from elsewhere."""
    docs = read_any(spark, f"{sf_dir}/documents.parquet").select("doc_id")
    taken = sample_rows(docs, 0.5, seed=7)
    n, ids = docs.agg(F.count(F.lit(1)).alias("n_rows")), taken.agg(F.count(F.lit(1)).alias("k"), F.count_distinct("doc_id").alias("d"))
    strange = taken.join(docs.distinct(), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("strange"))
    whole = n.join(ids).join(strange)  # one row each
    return whole.select("n_rows", (F.abs(F.col("k") - F.col("n_rows") / 2) <= 2.5 * F.sqrt("n_rows")).alias("within"), (F.col("k") == F.col("d")).alias("once"), "strange")


SAMPLE_SQL = "select count(*) as n_rows, true as within, count(*) = count(distinct doc_id) as once, 0::bigint as strange from documents"


def informative_filter(spark, sf_dir):
    e = encoded(spark, sf_dir, "constant")
    sizes = e.cardinalities[:-1]
    return spark.createDataFrame([(i, e.features[i], sizes[i]) for i in informative(sizes)], "feature int, name string, cardinality int")


INFORMATIVE_SQL = f"with {_codes_sql('constant')} select feature::int as feature, name, k::int as cardinality from (" + " union all ".join(f"select {i} as feature, '{c}' as name, count(distinct f{i}) as k from codes" for i, c in enumerate(["one", *DOCS])) + ") where k > 1"


def contingency_class(spark, sf_dir):
    e = encoded(spark, sf_dir, "docs")
    return count_against(rows_of(e), len(DOCS), list(range(len(DOCS))))


CLASS_CELLS_SQL = f"with {_cells_sql('docs')} select i, v::int as v, w::int as w, n from cells where j = {len(DOCS)}"


def contingency_vertical(spark, sf_dir):
    e = encoded(spark, sf_dir, "docs")
    names = [*e.features, "label"]
    numbered = e.codes.withColumn("rid", F.monotonically_increasing_id()).withColumn("block", F.shiftright("rid", 16))
    return count_against_vertical(layout.vertical(numbered, names), len(DOCS), list(range(len(DOCS))))


def contingency_pair(spark, sf_dir):
    e = encoded(spark, sf_dir, "price")
    p = len(PRICE)
    return count_pairs(e.codes, [*e.features, "label"], e.cardinalities, [(i, j) for i in range(p + 1) for j in range(i + 1, p + 1)])


PAIR_CELLS_SQL = f"with {_cells_sql('price')} select i, j, v::int as v, w::int as w, n from cells"
_BLOCKS = 7


def _blocked(spark, sf_dir):
    raw = fixture(spark, sf_dir, "docs")
    n = raw.count()
    return layout.assign_blocks(layout.number_rows(raw, "doc_id"), n, _BLOCKS)


def block_assign(spark, sf_dir):
    return _blocked(spark, sf_dir).select("doc_id", "rid", "block")


BLOCK_SQL = f"with raw as ({FIXTURES['docs'][2]}), k as (select *, row_number() over (order by doc_id) - 1 as rid, count(*) over () as n from raw)"
BLOCK_ASSIGN_SQL = f"{BLOCK_SQL} select doc_id, rid, (rid * {_BLOCKS} // n)::int as block from k"


def block_transpose(spark, sf_dir):
    blocks = layout.vertical(_blocked(spark, sf_dir), ["toxic", "dot", "y"])
    return blocks.select("feature", "block", F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals"))


BLOCK_TRANSPOSE_SQL = f"{BLOCK_SQL} select feature::int as feature, block::int as block, string_agg(v::varchar, ',' order by rid) as vals from (" + " union all ".join(f"select {i} as feature, rid * {_BLOCKS} // n as block, rid, {c} as v from k" for i, c in enumerate(["toxic", "dot", "y"])) + ") group by all"


def feature_entropy(spark, sf_dir):
    return measures.feature_entropies(rows_of(encoded(spark, sf_dir, "docs")), len(DOCS)).select("i", _r("h"))


def class_entropy(spark, sf_dir):
    h = measures.feature_entropies(rows_of(encoded(spark, sf_dir, "docs")), len(DOCS) + 1)
    return h.where(F.col("i") == len(DOCS)).select(_r("h"))


def _conditional(spark, sf_dir):
    e = encoded(spark, sf_dir, "docs")
    return measures.conditional_entropies(count_against(rows_of(e), len(DOCS), list(range(len(DOCS)))), ["i"])


def conditional_entropy(spark, sf_dir):
    return _conditional(spark, sf_dir).select("i", _r("h_v_given_w"))


def information_gain(spark, sf_dir):
    return _conditional(spark, sf_dir).select("i", _r("gain"))


def _su(spark, sf_dir, name: str, pairs: list[tuple[int, int]] | None = None):
    e = encoded(spark, sf_dir, name)
    p = len(e.features)
    cells = count_pairs(e.codes, [*e.features, "label"], e.cardinalities, pairs or [(i, j) for i in range(p + 1) for j in range(i + 1, p + 1)])
    return measures.correlations(cells, measures.feature_entropies(rows_of(e), p + 1), p)


def su_class_ranked(name: str) -> Callable:
    def query(spark, sf_dir):
        p = len(FIXTURES[name][0])
        su = _su(spark, sf_dir, name, [(i, p) for i in range(p)]).select(F.col("i").alias("feature"), _r("su"))
        return su.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("su"), "feature")))  # a row per feature

    return query


def _ranked_sql(name: str) -> str:
    return f"with {_su_sql(name)} select i as feature, round(su, 9) + 0.0 as su, row_number() over (order by round(su, 9) desc, i)::int as rank from su where j = {len(FIXTURES[name][0])}"


def su_matrix(spark, sf_dir):
    return _su(spark, sf_dir, "price").select("i", "j", _r("su"))


def su_zero_rule(spark, sf_dir):
    e = encoded(spark, sf_dir, "crossed")
    cells = count_pairs(e.codes, ["a", "b", "label"], e.cardinalities, [(0, 1), (0, 2), (1, 2)])
    return measures.correlations(cells, measures.feature_entropies(rows_of(e), 3), 2).select("i", "j", _r("su"))


def known_pairs_anti(spark, sf_dir):
    """Pairs of a nation and its region's number, as wanted; those with an even sum are known, the other way round."""
    nation = read_any(spark, f"{sf_dir}/nation.parquet")
    wanted = nation.select(F.col("n_nationkey").cast("int").alias("i"), F.col("n_regionkey").cast("int").alias("j"))
    return measures.unknown_pairs(wanted, wanted.where("(i + j) % 2 = 0").select(F.col("j").alias("i"), F.col("i").alias("j")))


KNOWN_SQL = "select distinct least(n_nationkey, n_regionkey)::int as i, greatest(n_nationkey, n_regionkey)::int as j from nation where (n_nationkey + n_regionkey) % 2 <> 0"
_SUBSETS = [[1], [5], [4, 1], [5, 4, 1], [0, 1, 2, 3, 4, 5, 6, 7]]


def subset_pairs(spark, sf_dir):
    rows = []
    for s, subset in enumerate(_SUBSETS):
        outer, inner = measures.subset_pairs(subset, len(DOCS))
        rows += [(s, i, j) for i, j in outer + inner]
    return spark.createDataFrame(rows, "subset int, i int, j int")


_SUBSET_VALUES = ", ".join(f"({s}, {subset}::bigint[])" for s, subset in enumerate(_SUBSETS))
SUBSET_PAIRS_SQL = f"with s(subset, f) as (values {_SUBSET_VALUES}), u as (select subset, unnest(f) as i from s) select subset, i::int as i, {len(DOCS)} as j from u union all select a.subset, a.i::int, b.i::int from u a join u b on a.subset = b.subset and a.i < b.i"


def _known(spark, sf_dir, name: str) -> dict:
    return {(r["i"], r["j"]): r["su"] for r in _su(spark, sf_dir, name).collect()}  # a row per pair of features


def subset_merit(spark, sf_dir):
    su = _known(spark, sf_dir, "docs")
    return spark.createDataFrame([(s, measures.merit(f, len(DOCS), su)) for s, f in enumerate(_SUBSETS)], "subset int, merit double").select("subset", _r("merit"))


SUBSET_MERIT_SQL = f"with {_su_sql('docs')}, sums as (select map(list(i * 1000 + j), list(su)) as m from su), s(subset, f) as (values {_SUBSET_VALUES}) select subset, round({_merit_sql('f', len(DOCS))}, 9) + 0.0 as merit from s, sums"


def expand_topk(spark, sf_dir):
    su = _known(spark, sf_dir, "docs")
    p = len(DOCS)
    new = [(measures.merit([5, f], p, su), (5, f)) for f in range(p) if f != 5]
    top = top_states([(measures.merit([f], p, su), (f,)) for f in (4, 7)], new, PATIENCE)
    return spark.createDataFrame([(k, ",".join(map(str, f)), m) for k, (m, f) in enumerate(top, 1)], "place int, subset string, merit double").select("place", "subset", _r("merit"))


EXPAND_SQL = f"""with {_su_sql('docs')}, sums as (select map(list(i * 1000 + j), list(su)) as m from su),
s(arrival, f) as (select x.a, x.f from (values (0, [4]::bigint[]), (1, [7]::bigint[])) x(a, f) union all select 100 + i, [5, i]::bigint[] from range(0, {len(DOCS)}) t(i) where i <> 5),
r as (select f, round({_merit_sql('f', len(DOCS))}, 12) as merit, arrival from s, sums)
select row_number() over (order by merit desc, arrival)::int as place, array_to_string(f, ',') as subset, round(merit, 9) + 0.0 as merit from r order by merit desc, arrival limit {PATIENCE}"""


def _fitted(spark, sf_dir, name: str, **options) -> tuple[Encoded, CorrelationFeatureSelectorModel]:
    e = encoded(spark, sf_dir, name)
    return e, CorrelationFeatureSelector(**{"searchTermination": PATIENCE, **options}).fit(assemble(e))


def best_first_trace(spark, sf_dir):
    _, model = _fitted(spark, sf_dir, "docs")
    return model.report.trace(spark).select("it", "expanded", "n_new", "head", _r("merit"), "improved", "fails")


TRACE_SQL = f"with recursive {_trace_sql('docs')} select it::int as it, array_to_string(expanded, ',') as expanded, n_new::int as n_new, array_to_string(queue[1].f, ',') as head, round(-queue[1].k, 9) + 0.0 as merit, imp as improved, nf::int as fails from trace where it > 0"


def best_subset(spark, sf_dir):
    _, model = _fitted(spark, sf_dir, "docs", locallyPredictive=False)
    found = model.report.found
    return spark.createDataFrame([(",".join(map(str, model.selected)), found.merit)], "subset string, merit double").select("subset", _r("merit"))


BEST_SQL = f"with recursive {_trace_sql('docs')} select array_to_string(best, ',') as subset, round(bm, 9) + 0.0 as merit from trace order by it desc limit 1"


def _moved_sql() -> str:
    """The choice among the docs features, one place further on: the constant is none."""
    return f"with recursive {_final_sql('docs')} select ix::int as place, (f + 1)::int as feature from (select unnest(sel) as f, generate_subscripts(sel, 1) as ix from chosen)"


def _order(spark, features: list[int]) -> DataFrame:
    return spark.createDataFrame([(k, f) for k, f in enumerate(features, 1)], "place int, feature int")


def locally_predictive(spark, sf_dir):
    _, model = _fitted(spark, sf_dir, "docs")
    return _order(spark, model.report.added)


LOCAL_SQL = f"with recursive {_final_sql('docs')} select row_number() over (order by ix)::int as place, f::int as feature from (select unnest(sel) as f, generate_subscripts(sel, 1) as ix from chosen) where ix > (select len(best) from last)"


def selected_features(name: str, **options) -> Callable:
    """The flagship: fit on a fixture, the selected features in order."""

    def query(spark, sf_dir):
        return _order(spark, _fitted(spark, sf_dir, name, **options)[1].selected)

    return query


def selected_plain(spark, sf_dir):
    """The fit on plain columns of codes without metadata: sizes come from the largest codes."""
    e = encoded(spark, sf_dir, "docs")
    model = CorrelationFeatureSelector(searchTermination=PATIENCE, inputCols=e.features).fit(e.codes)
    return _order(spark, model.selected)


def estimator_roundtrip(spark, sf_dir):
    """Save and load the estimator, then fit what was loaded."""
    path = f"{_folder(spark)}/selector-estimator"
    CorrelationFeatureSelector(searchTermination=PATIENCE, countPlan="layout", nPartitions=3).write().overwrite().save(path)
    return _order(spark, CorrelationFeatureSelector.load(path).fit(assemble(encoded(spark, sf_dir, "docs"))).selected)


def _selected_sql(name: str, patience: int = PATIENCE) -> str:
    return f"with recursive {_final_sql(name, patience)} select ix::int as place, f::int as feature from (select unnest(sel) as f, generate_subscripts(sel, 1) as ix from chosen)"


def slice_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    e, model = _fitted(spark, sf_dir, "docs")
    sliced = model.setOutputCol("chosen").transform(assemble(e)).select(vector_to_array("chosen").alias("v"))
    row = sliced.select(F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("codes"))
    return row.groupBy("codes").agg(F.count(F.lit(1)).alias("n"))


SLICE_SQL = f"with recursive {_final_sql('docs')}, r as (select [{', '.join(f'f{i}' for i in range(len(DOCS)))}] as v from codes) select array_to_string(list_transform(sel, lambda i: v[i + 1]), ',') as codes, count(*) as n from r, chosen group by all"


def _folder(spark) -> str:
    """The shared folder of the cluster; a folder of this machine on a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return top or tempfile.mkdtemp(prefix="sievework-model-")


def model_roundtrip(spark, sf_dir):
    _, model = _fitted(spark, sf_dir, "docs")
    path = f"{_folder(spark)}/selector-model"
    model.write().overwrite().save(path)
    return _order(spark, CorrelationFeatureSelectorModel.load(path).selected)


def fit_report(spark, sf_dir):
    _, model = _fitted(spark, sf_dir, "docs")
    r = model.report
    return spark.createDataFrame([(r.rows, r.pairs_requested, len(r.found.trace), r.found.evaluations, len(r.found.subset), len(r.added))], "n_rows long, pairs_requested int, expansions int, evaluations int, n_best int, n_added int")


REPORT_SQL = f"with recursive {_final_sql('docs')} select (select count(*) from codes) as n_rows, sum(n_new)::int as pairs_requested, count(*)::int as expansions, (1 + sum(n_new))::int as evaluations, (select len(best) from last)::int as n_best, (select len(sel) from chosen)::int - (select len(best) from last)::int as n_added from trace where it > 0"

_HS = f"with {_su_sql('docs')}"
_P = len(DOCS)

_REGISTERED: dict[str, tuple[Callable, str | None]] = {
    "nominal_encode": (nominal_encode, NOMINAL_SQL),
    "sample_fraction": (sample_fraction, None),
    "sample_bounds": (sample_bounds, SAMPLE_SQL),
    "informative_filter": (informative_filter, INFORMATIVE_SQL),
    "contingency_class": (contingency_class, CLASS_CELLS_SQL),
    "contingency_vertical": (contingency_vertical, CLASS_CELLS_SQL),
    "contingency_pair": (contingency_pair, PAIR_CELLS_SQL),
    "block_assign": (block_assign, BLOCK_ASSIGN_SQL),
    "block_transpose": (block_transpose, BLOCK_TRANSPOSE_SQL),
    "feature_entropy": (feature_entropy, f"{_HS} select i, round(h, 9) + 0.0 as h from h where i < {_P}"),
    "class_entropy": (class_entropy, f"{_HS} select round(h, 9) + 0.0 as h from h where i = {_P}"),
    "conditional_entropy": (conditional_entropy, f"{_HS} select hj.i, round(hj.h - h.h, 9) + 0.0 as h_v_given_w from hj join h on h.i = hj.j where hj.j = {_P}"),
    "information_gain": (information_gain, f"{_HS} select hj.i, round(a.h + b.h - hj.h, 9) + 0.0 as gain from hj join h a on a.i = hj.i join h b on b.i = hj.j where hj.j = {_P}"),
    "su_class_ranked": (su_class_ranked("docs"), _ranked_sql("docs")),
    "su_class_ranked_region": (su_class_ranked("region"), _ranked_sql("region")),
    "su_matrix": (su_matrix, f"with {_su_sql('price')} select i, j, round(su, 9) + 0.0 as su from su"),
    "su_zero_rule": (su_zero_rule, f"with {_su_sql('crossed')} select i, j, round(su, 9) + 0.0 as su from su"),
    "known_pairs_anti": (known_pairs_anti, KNOWN_SQL),
    "subset_pairs": (subset_pairs, SUBSET_PAIRS_SQL),
    "subset_merit": (subset_merit, SUBSET_MERIT_SQL),
    "expand_topk": (expand_topk, EXPAND_SQL),
    "best_first_trace": (best_first_trace, TRACE_SQL),
    "best_subset": (best_subset, BEST_SQL),
    "locally_predictive": (locally_predictive, LOCAL_SQL),
    "selected_features": (selected_features("docs"), _selected_sql("docs")),
    "selected_features_price": (selected_features("price"), _selected_sql("price")),
    "selected_features_region": (selected_features("region"), _selected_sql("region")),
    "selected_features_horizontal": (selected_features("docs", countPlan="layout", verticalPartitioning=False), _selected_sql("docs")),
    "selected_features_vertical": (selected_features("docs", countPlan="layout"), _selected_sql("docs")),
    "selected_features_partitions": (selected_features("region", countPlan="layout", nPartitions=2), _selected_sql("region")),
    "selected_features_patience_1": (selected_features("docs", searchTermination=1), _selected_sql("docs", 1)),
    "selected_features_constant": (selected_features("constant"), _moved_sql()),
    "selected_features_plain": (selected_plain, _selected_sql("docs")),
    "estimator_roundtrip": (estimator_roundtrip, _selected_sql("docs")),
    "slice_features": (slice_features, SLICE_SQL),
    "model_roundtrip": (model_roundtrip, _selected_sql("docs")),
    "fit_report": (fit_report, REPORT_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
