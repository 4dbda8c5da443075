"""Registered queries of the analytic and learning operators, and the DuckDB SQL that gives the same rows.

Numbers are rounded on both sides, so that sums in another order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import text as T
from .operators import preprocessing as P
from .operators.associations import AprioriAssociator
from .operators.clustering import DBSCANClusterer, LocalOutlierFactorDetector
from .operators.features import SCORES, InteractionFeaturesGenerator, MathematicalFeaturesGenerator, PolynomialFeaturesGenerator, VarianceThresholdSelector
from .operators.learners import LinearRegression, NaiveBayesClassifier, NaiveBayesMultinomialClassifier, OneRuleClassifier, SimpleLinearRegression, ZeroRuleClassifier
from .operators.neighbors import KNearestNeighborsClassifier, KNearestNeighborsRegressor, knn_join
from .operators.sampling import TomekLinksSampler
from .plans.splitting import GroupKFold, KFold, StratifiedKFold, TimeSeriesSplit, holdout

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, n=6):
    return F.round(c, n)


FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]


def _lines(spark, d, *extra):
    return t(spark, d, "lineitem").select(*KEYS, *FEATS, *extra)


def _rounded(df, cols, n=6):
    return df.withColumns({c: r(F.col(c), n) for c in cols})


def _one(spark, **values) -> DataFrame:
    """A row of numbers."""
    names = list(values)
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"`{c}` double" for c in names)).select(*[r(F.col(f"`{c}`")).alias(c) for c in names])


# ---------------------------------------------------------------- scaling and imputation

_Z = ", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in FEATS)


@query("standard_scale", f"select l_orderkey, l_linenumber, {_Z} from lineitem")
def standard_scale(spark, d):
    return _rounded(P.StandardScaler(columns=FEATS).fit_transform(_lines(spark, d)), FEATS)


@query("center_scale", "select l_orderkey, l_linenumber, " + ", ".join(f"round({c} - avg({c}) over (), 9) as {c}" for c in FEATS[2:]) + " from lineitem")
def center_scale(spark, d):
    return _rounded(P.CenterScaler(FEATS[2:]).fit_transform(_lines(spark, d)).select(*KEYS, *FEATS[2:]), FEATS[2:], 9)


@query("minmax_scale", "select l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) * 2 - 1, 6) as {c}" for c in FEATS) + " from lineitem")
def minmax_scale(spark, d):
    return _rounded(P.MinMaxScaler(2.0, -1.0, FEATS).fit_transform(_lines(spark, d)), FEATS)


def _gappy(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "value")
    return e.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


_GAPPY = "with e as (select event_id, user_id, case when event_id % 7 <> 0 then value end as value from events) "


@query("impute_mean", _GAPPY + "select event_id, round(coalesce(value, (select avg(value) from e)), 6) as value from e")
def impute_mean(spark, d):
    return _rounded(P.SimpleImputer("mean", columns=["value"]).fit_transform(_gappy(spark, d)).select("event_id", "value"), ["value"])


@query("impute_median", _GAPPY + "select event_id, round(coalesce(value, (select median(value) from e)), 6) as value from e")
def impute_median(spark, d):
    return _rounded(P.SimpleImputer("median", columns=["value"]).fit_transform(_gappy(spark, d)).select("event_id", "value"), ["value"])


@query("impute_mode", "with e as (select p_partkey, case when p_partkey % 7 <> 0 then p_size end as s from part), m as (select s from e where s is not null group by s order by count(*) desc, s limit 1) select p_partkey, cast(coalesce(s, (select s from m)) as double) as p_size from e")
def impute_mode(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"))
    return P.SimpleImputer("most_frequent", columns=["p_size"]).fit_transform(p)


@query("impute_constant", _GAPPY + "select event_id, round(coalesce(value, -1.0), 6) as value from e")
def impute_constant(spark, d):
    return _rounded(P.SimpleImputer("constant", -1.0, ["value"]).fit_transform(_gappy(spark, d)).select("event_id", "value"), ["value"])


# ---------------------------------------------------------------- encoding and discretization

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("ordinal_encode", "with s as (select c_mktsegment, dense_rank() over (order by c_mktsegment) - 1 as k from (select distinct c_mktsegment from customer)) select c_custkey, cast(k as double) as c_mktsegment from customer join s using (c_mktsegment)")
def ordinal_encode(spark, d):
    return P.OrdinalEncoder(columns=["c_mktsegment"]).fit_transform(t(spark, d, "customer").select("c_custkey", "c_mktsegment"))


@query("one_hot", "select c_custkey, c_mktsegment as seg, 1.0 as hot from customer")
def one_hot(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    enc = P.OneHotEncoder(columns=["c_mktsegment"]).fit(c)
    wide = enc.transform(c)
    pairs = F.array(*[F.struct(F.lit(v).alias("seg"), F.col(f"c_mktsegment_{v}").alias("hot")) for v in enc.seen["c_mktsegment"]])
    return wide.select("c_custkey", F.explode(pairs).alias("x")).select("c_custkey", "x.seg", "x.hot").where("hot = 1")


@query("rare_category", "select p_partkey, case when n >= 20 then p_type else '-1' end as p_type from (select p_partkey, p_type, count(*) over (partition by p_type) as n from part)")
def rare_category(spark, d):
    return P.RareCategoryEncoder(20, ["p_type"]).fit_transform(t(spark, d, "part").select("p_partkey", "p_type"))


@query("equal_width_bins", "with b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select o_orderkey, cast(" + " + ".join(f"(case when o_totalprice >= lo + (hi - lo) * {i} / 10 then 1 else 0 end)" for i in range(1, 10)) + " as double) as o_totalprice from orders, b")
def equal_width_bins(spark, d):
    return P.EqualWidthDiscretizer(10, ["o_totalprice"]).fit_transform(t(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@query("quantile_bins", "with b as (select " + ", ".join(f"quantile_cont(o_totalprice, 0.{i}) q{i}" for i in range(1, 10)) + " from orders) select o_orderkey, cast(" + " + ".join(f"(case when o_totalprice >= q{i} then 1 else 0 end)" for i in range(1, 10)) + " as double) as o_totalprice from orders, b")
def quantile_bins(spark, d):
    return P.QuantileDiscretizer(10, ["o_totalprice"]).fit_transform(t(spark, d, "orders").select("o_orderkey", "o_totalprice"))


_IQR = "with b as (select quantile_cont(c_acctbal, 0.25) q1, quantile_cont(c_acctbal, 0.75) q3 from customer) "


@query("iqr_clip", _IQR + "select c_custkey, round(least(greatest(c_acctbal, q1 - 0.3 * (q3 - q1)), q3 + 0.3 * (q3 - q1)), 6) as c_acctbal from customer, b")
def iqr_clip(spark, d):
    return _rounded(P.IQROutlierDetector(0.3, "clip", ["c_acctbal"]).fit_transform(t(spark, d, "customer").select("c_custkey", "c_acctbal")), ["c_acctbal"])


@query("iqr_remove", _IQR + "select c_custkey, c_acctbal from customer, b where c_acctbal between q1 - 0.3 * (q3 - q1) and q3 + 0.3 * (q3 - q1)")
def iqr_remove(spark, d):
    return P.IQROutlierDetector(0.3, "remove", ["c_acctbal"]).fit_transform(t(spark, d, "customer").select("c_custkey", "c_acctbal"))


@query("clip_percentile", "with b as (select quantile_cont(c_acctbal, 0.05) lo, quantile_cont(c_acctbal, 0.95) hi from customer) select c_custkey, round(least(greatest(c_acctbal, lo), hi), 6) as c_acctbal from customer, b")
def clip_percentile(spark, d):
    return _rounded(P.ValueClipper(percentile=(5, 95), columns=["c_acctbal"]).fit_transform(t(spark, d, "customer").select("c_custkey", "c_acctbal")), ["c_acctbal"])


# ---------------------------------------------------------------- lags


@query("lag_value", "select event_id, value, lag(value) over (partition by user_id order by ts, event_id) as value_lag from events")
def lag_value(spark, d):
    out = P.LagTransformer(-1, ["value"], order_by=["ts", "event_id"], partition_by="user_id").transform(t(spark, d, "events"))
    return out.select("event_id", "value", F.col("`value-1`").alias("value_lag"))


@query("delta_value", "select event_id, round(value - lag(value, 2) over (partition by user_id order by ts, event_id), 6) as value from events")
def delta_value(spark, d):
    out = P.DifferenceTransformer(-2, ["value"], order_by=["ts", "event_id"], partition_by="user_id").transform(t(spark, d, "events"))
    return _rounded(out.select("event_id", "value"), ["value"])


# ---------------------------------------------------------------- features


@query("math_features", "select l_orderkey, l_linenumber, round(ln(l_quantity), 6) as log_q, round(sqrt(l_quantity), 6) as sqrt_q, round(1 / (1 + exp(-l_tax)), 6) as sig_t from lineitem")
def math_features(spark, d):
    rows = _lines(spark, d).select(*KEYS, "l_quantity", "l_tax")
    out = MathematicalFeaturesGenerator(["log", "sqrt", "sigmoid"], columns=["l_quantity", "l_tax"]).transform(rows)
    return out.select(*KEYS, r(F.col("`log(l_quantity)`")).alias("log_q"), r(F.col("`sqrt(l_quantity)`")).alias("sqrt_q"), r(F.col("`sigmoid(l_tax)`")).alias("sig_t"))


@query("polynomial_features", "select l_orderkey, l_linenumber, 1.0 as bias, l_quantity as a, l_tax as b, round(l_quantity * l_quantity, 6) as aa, round(l_quantity * l_tax, 6) as ab, round(l_tax * l_tax, 6) as bb from lineitem")
def polynomial_features(spark, d):
    out = PolynomialFeaturesGenerator(2, columns=["l_quantity", "l_tax"]).transform(_lines(spark, d).select(*KEYS, "l_quantity", "l_tax"))
    return out.select(*KEYS, F.col("1").alias("bias"), F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), r(F.col("`l_quantity^2`")).alias("aa"), r(F.col("`l_quantity*l_tax`")).alias("ab"), r(F.col("`l_tax^2`")).alias("bb"))


@query("interaction_features", "select l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) as qp, round(l_quantity * l_discount, 6) as qd, round(l_extendedprice * l_discount, 4) as pd from lineitem")
def interaction_features(spark, d):
    out = InteractionFeaturesGenerator(columns=FEATS[:3]).transform(_lines(spark, d))
    return out.select(*KEYS, r(F.col("`l_quantity*l_extendedprice`"), 4).alias("qp"), r(F.col("`l_quantity*l_discount`")).alias("qd"), r(F.col("`l_extendedprice*l_discount`"), 4).alias("pd"))


@query("variance_threshold", "select count(*) as n, round(sum(l_quantity), 2) as q, round(sum(l_extendedprice), 2) as p from lineitem")
def variance_threshold(spark, d):
    out = VarianceThresholdSelector(1.0, FEATS).fit(_lines(spark, d)).transform(_lines(spark, d))
    assert [c for c in out.columns if c in FEATS] == FEATS[:2]
    return out.agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("q"), r(F.sum("l_extendedprice"), 2).alias("p"))


# ---------------------------------------------------------------- scores of features

_F_SQL = """with s as (select l_returnflag k, count(*) n, {aggs} from lineitem group by 1), g as (select sum(n) n, count(*) k, {means} from s)
select {out} from (select {sums}, max(g.n) n, max(g.k) k from s, g)"""


def _f_sql(cols):
    aggs = ", ".join(f"avg({c}) m{i}, var_pop({c}) v{i}" for i, c in enumerate(cols))
    means = ", ".join(f"sum(n * m{i}) / sum(n) a{i}" for i in range(len(cols)))
    sums = ", ".join(f"sum(s.n * (m{i} - a{i}) * (m{i} - a{i})) b{i}, sum(s.n * v{i}) w{i}" for i in range(len(cols)))
    out = ", ".join(f"round((b{i} / (k - 1)) / (w{i} / (n - k)), 6) as {c}" for i, c in enumerate(cols))
    return _F_SQL.format(aggs=aggs, means=means, sums=sums, out=out)


@query("anova_f", _f_sql(FEATS))
def anova_f(spark, d):
    return _one(spark, **SCORES["f_classif"](_lines(spark, d, "l_returnflag"), FEATS, "l_returnflag"))


@query("f_regression", "select " + ", ".join(f"round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 4) as {c}" for c in ("l_quantity", "l_discount", "l_tax")) + " from lineitem")
def f_regression(spark, d):
    s = SCORES["f_regression"](_lines(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return _one(spark, **{k: round(v, 4) for k, v in s.items()})


@query("correlation_scores", "select " + ", ".join(f"round(abs(corr({c}, l_extendedprice)), 6) as {c}" for c in ("l_quantity", "l_discount", "l_tax")) + " from lineitem")
def correlation_scores(spark, d):
    return _one(spark, **SCORES["correlation"](_lines(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


_TABLE = "with j as (select o_orderstatus a, o_orderpriority b, count(*) n from orders group by 1, 2), t as (select sum(n) n from j), pa as (select a, sum(n) n from j group by 1), pb as (select b, sum(n) n from j group by 1)"


@query("chi2_score", _TABLE + " select round(sum((coalesce(j.n, 0) - e) * (coalesce(j.n, 0) - e) / e), 6) as chi2 from (select a, b, pa.n * pb.n / t.n e from pa, pb, t) x left join j using (a, b)")
def chi2_score(spark, d):
    return _one(spark, chi2=M.chi2(t(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority")["o_orderstatus"])


@query("entropies", _TABLE + ", h as (select (select -sum(pa.n / t.n * ln(pa.n / t.n)) from pa, t) ha, (select -sum(pb.n / t.n * ln(pb.n / t.n)) from pb, t) hb, (select -sum(j.n / t.n * ln(j.n / t.n)) from j, t) hj) select round(ha, 6) as entropy, round(hj - hb, 6) as conditional, round(ha + hb - hj, 6) as mutual, round((ha + hb - hj) / hb, 6) as gain_ratio, round(2 * (ha + hb - hj) / (ha + hb), 6) as uncertainty from h")
def entropies(spark, d):
    o = t(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    a, b = "o_orderstatus", "o_orderpriority"
    return _one(spark, entropy=M.entropy(o, a), conditional=M.conditional_entropy(o, a, b), mutual=M.mutual_information(o, a, b), gain_ratio=M.gain_ratio(o, a, b), uncertainty=M.symmetrical_uncertainty(o, a, b))


@query("cluster_agreement", _TABLE + ", c as (select (select sum(n * (n - 1) / 2.0) from j) cj, (select sum(n * (n - 1) / 2.0) from pa) ca, (select sum(n * (n - 1) / 2.0) from pb) cb, (select n * (n - 1) / 2.0 from t) ct) select round((cj - ca * cb / ct) / ((ca + cb) / 2 - ca * cb / ct), 6) as ari, round((ct + 2 * cj - ca - cb) / ct, 6) as rand, round(cj / sqrt(ca * cb), 6) as fm from c")
def cluster_agreement(spark, d):
    o = t(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    a, b = "o_orderstatus", "o_orderpriority"
    return _one(spark, ari=M.adjusted_rand_score(o, a, b), rand=M.rand_score(o, a, b), fm=M.fowlkes_mallows_score(o, a, b))


# ---------------------------------------------------------------- metrics

_BIN = "with p as (select l_quantity > 25 and l_discount < 0.08 as yhat, l_returnflag = 'R' as y from lineitem), c as (select count(*) filter (y and yhat) tp, count(*) filter (not y and yhat) fp, count(*) filter (y and not yhat) fn, count(*) filter (not y and not yhat) tn, count(*) n from p) "


def _binary(spark, d):
    x = t(spark, d, "lineitem")
    return x.select(((F.col("l_quantity") > 25) & (F.col("l_discount") < 0.08)).cast("int").alias("yhat"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("binary_metrics", _BIN + "select round((tp + tn) / n, 6) as accuracy, round(tp / (tp + fp), 6) as prec, round(tp / (tp + fn), 6) as recall, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1, round(tn / (tn + fp), 6) as specificity, round((tp * tn - fp * fn) / (sqrt((tp + fp) * 1.0) * sqrt((tp + fn) * 1.0) * sqrt((tn + fp) * 1.0) * sqrt((tn + fn) * 1.0)), 6) as mcc, round(((tp + tn) / n - ((tp + fp) / n * ((tp + fn) / n) + (tn + fn) / n * ((tn + fp) / n))) / (1 - ((tp + fp) / n * ((tp + fn) / n) + (tn + fn) / n * ((tn + fp) / n))), 6) as kappa, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced from c")
def binary_metrics(spark, d):
    b = _binary(spark, d)
    return _one(spark, accuracy=M.accuracy_score(b, "y", "yhat"), prec=M.precision_score(b, "y", "yhat"), recall=M.recall_score(b, "y", "yhat"), f1=M.f1_score(b, "y", "yhat"), specificity=M.specificity_score(b, "y", "yhat"), mcc=M.matthews_corrcoef(b, "y", "yhat"), kappa=M.cohen_kappa_score(b, "y", "yhat"), balanced=M.balanced_accuracy_score(b, "y", "yhat"))


@query("confusion", "select l_returnflag as t, l_linestatus as p, count(*) as n from lineitem group by 1, 2")
def confusion(spark, d):
    return M.pair_counts(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.col("true").alias("t"), F.col("pred").alias("p"), "n")


@query("roc_auc", "with s as (select l_returnflag = 'R' y, l_discount s from lineitem), g as (select s, count(*) filter (y) p, count(*) filter (not y) n from s group by 1), c as (select *, sum(p) over (order by s desc) cp from g) select round(sum(n * (cp - p / 2.0)) / (sum(p) * sum(n)), 6) as auc from c")
def roc_auc(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_discount")
    return _one(spark, auc=M.roc_auc_score(x, "y", "l_discount"))


@query("roc_curve", "with s as (select l_returnflag = 'R' y, l_discount s from lineitem), g as (select s, count(*) filter (y) p, count(*) filter (not y) n from s group by 1) select s as threshold, round(sum(n) over (order by s desc) / sum(n) over (), 6) as fpr, round(sum(p) over (order by s desc) / sum(p) over (), 6) as tpr from g")
def roc_curve(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_discount")
    return _rounded(M.roc_curve(x, "y", "l_discount"), ["fpr", "tpr"])


@query("regression_metrics", "with p as (select l_extendedprice y, 1500.0 * l_quantity p from lineitem) select round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2, round(corr(y, p), 6) as corr, round(100 * sum(abs(y - p)) / sum(abs(y - m)), 4) as rae from p, (select avg(l_extendedprice) m from lineitem)")
def regression_metrics(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.lit(1500.0) * F.col("l_quantity")).alias("p"))
    return _one(spark, mae=round(M.mean_absolute_error(x, "y", "p"), 4), rmse=round(M.root_mean_squared_error(x, "y", "p"), 4), r2=M.r2_score(x, "y", "p"), corr=M.correlation_coefficient(x, "y", "p"), rae=round(M.relative_absolute_error(x, "y", "p"), 4))




# ---------------------------------------------------------------- text


@query("word_tokens", r"select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')) as n from documents")
def word_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(T.WordTokenizer()("text")).cast("long").alias("n"))


@query("stopword_counts", "with w as (select doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) w from documents where lang = 'en') select doc_id, count(*) as n from w where lower(w) not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ") group by 1")
def stopword_counts(spark, d):
    docs = t(spark, d, "documents").where("lang = 'en'").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    out = T.StopWordRemover(columns=["text"]).transform(docs)
    return out.where(F.length("text") > 0).select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')"


@query("bigrams_all", f"with w as (select {_WORDS} w from documents), g as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) b from w) select b as bigram, count(*) as n from g group by 1")
def bigrams_all(spark, d):
    """Every pair of neighbouring words of all documents, in any language."""
    grams = T.NGramTokenizer(n=2)("text")
    return t(spark, d, "documents").select(F.explode(grams).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query("tfidf_all", f"with w as (select doc_id, unnest({_WORDS}) t from documents), tf as (select doc_id, t, count(*) tf from w group by 1, 2), df as (select t, count(*) df from tf group by 1), n as (select count(*) n from documents), x as (select doc_id, t, tf * (ln((n + 1.0) / (df + 1)) + 1) v from tf join df using (t), n), s as (select doc_id, sqrt(sum(v * v)) s from x group by 1) select doc_id, t as token, round(v / s, 5) as weight from x join s using (doc_id)")
def tfidf_all(spark, d):
    """TF-IDF of every word of all documents, in any language."""
    docs = t(spark, d, "documents")
    return _rounded(T.TfidfVectorizer().fit(docs, "text").transform(docs, "doc_id"), ["weight"], 5)


@query("clean_text", r"select doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?:https?://|www\.)\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g')), '[0-9]+', ' ', 'g'), '\s+', ' ', 'g')) as text from documents")
def clean_text(spark, d):
    """Whole texts without markup, addresses and numbers."""
    return T.TextCleaner(remove_numbers=True, columns=["text"]).transform(t(spark, d, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- neighbours and clusters

_VEC = "e as (select vec_id, label, cast(embedding as double[]) v from embeddings)"


@query("knn_l2", f"with {_VEC}, q as (select * from e where vec_id % 50 = 0), p as (select q.vec_id q, e.vec_id n, list_distance(q.v, e.v) d from q, e where q.vec_id <> e.vec_id), k as (select *, row_number() over (partition by q order by d, n) r from p) select q as query, n as neighbor, cast(r as int) as rank, round(d, 6) as distance from k where r <= 5")
def knn_l2(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    near = knn_join(e.where("vec_id % 50 = 0"), e, 5, "embedding", "vec_id", exclude_self=True)
    return near.select("query", "neighbor", "rank", r(F.col("distance")).alias("distance"))


@query("knn_cosine", f"with {_VEC}, q as (select * from e where vec_id % 50 = 0), p as (select q.vec_id q, e.vec_id n, 1 - list_cosine_similarity(q.v, e.v) d from q, e where q.vec_id <> e.vec_id), k as (select *, row_number() over (partition by q order by d, n) r from p) select q as query, n as neighbor, cast(r as int) as rank, round(d, 6) as distance from k where r <= 5")
def knn_cosine(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    near = knn_join(e.where("vec_id % 50 = 0"), e, 5, "embedding", "vec_id", "cosine", exclude_self=True)
    return near.select("query", "neighbor", "rank", r(F.col("distance")).alias("distance"))




@query("nearest_manhattan", f"with {_VEC}, p as (select a.vec_id q, b.vec_id n, list_sum(list_transform(range(1, 65), lambda k: abs(a.v[k] - b.v[k]))) d from e a, e b where a.vec_id <> b.vec_id), k as (select *, row_number() over (partition by q order by d, n) r from p) select q as query, n as neighbor, round(d, 6) as distance from k where r = 1")
def nearest_manhattan(spark, d):
    """Each vector's nearest other one: all rows against all rows, with a result linear in rows."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    near = knn_join(e, e, 1, "embedding", "vec_id", "manhattan", exclude_self=True)
    return near.select("query", "neighbor", r(F.col("distance")).alias("distance"))


# ---------------------------------------------------------------- the same on whole vectors

_ALL = [f"x{i}" for i in range(64)]


def _vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_ALL)])


@query("calinski", f"with {_VEC}, u as (select label, unnest(v) x, unnest(range(1, 65)) k from e), c as (select label, k, count(*) n, avg(x) a from u group by 1, 2), m as (select k, avg(x) a from u group by 1), w as (select sum((x - a) * (x - a)) w from u join c using (label, k)), bt as (select sum(c.n * (c.a - m.a) * (c.a - m.a)) s from c join m using (k)), g as (select count(*) n, count(distinct label) k from e) select round((s / (k - 1)) / (w / (n - k)), 6) as score from bt, w, g")
def calinski(spark, d):
    return _one(spark, score=M.calinski_harabasz_score(_vectors(spark, d), _ALL, "label"))


@query("silhouette", f"with {_VEC}, p as (select a.vec_id i, a.label la, b.label lb, sum(list_distance(a.v, b.v)) s, count(*) n from e a, e b group by 1, 2, 3), q as (select i, max(case when la = lb and n > 1 then s / (n - 1) end) a, min(case when la <> lb then s / n end) b from p group by 1) select i as vec_id, round(coalesce((b - a) / greatest(a, b), 0), 5) as silhouette from q")
def silhouette(spark, d):
    return _rounded(M.silhouette_samples(_vectors(spark, d), _ALL, "label", "euclidean", "vec_id"), ["silhouette"], 5)


_KNN_ALL = f"with {_VEC}, p as (select a.vec_id q, b.label l, b.v[1] y, b.vec_id n, list_distance({{0}}) d from e a, e b where a.vec_id % 5 = 0 and b.vec_id % 5 <> 0), k as (select *, row_number() over (partition by q order by d, n) r from p) "


@query("knn_classify", _KNN_ALL.format("a.v, b.v") + ", v as (select q, l, count(*) c from k where r <= 7 group by 1, 2), w as (select q, l, row_number() over (partition by q order by c desc, l) r from v) select q as vec_id, l as prediction from w where r = 1")
def knn_classify(spark, d):
    e = _vectors(spark, d)
    m = KNearestNeighborsClassifier(7, id_col="vec_id").fit(e.where("vec_id % 5 <> 0"), "label", _ALL)
    return m.predict(e.where("vec_id % 5 = 0").drop("label")).select("vec_id", "prediction")


@query("knn_regress", _KNN_ALL.format("a.v[2:], b.v[2:]") + "select q as vec_id, round(sum(y / d) / sum(1 / d), 6) as prediction from k where r <= 7 group by 1")
def knn_regress(spark, d):
    """The first component from the 63 others."""
    e = _vectors(spark, d)
    m = KNearestNeighborsRegressor(7, "inverse", id_col="vec_id").fit(e.where("vec_id % 5 <> 0"), "x0", _ALL[1:])
    return _rounded(m.predict(e.where("vec_id % 5 = 0").drop("x0")).select("vec_id", "prediction"), ["prediction"])


@query("local_outlier_factor", f"with {_VEC}, p as (select a.vec_id q, b.vec_id n, list_distance(a.v, b.v) d from e a, e b where a.vec_id <> b.vec_id), k as (select * from (select *, row_number() over (partition by q order by d, n) r from p) where r <= 10), kd as (select q n, max(d) kd from k group by 1), lrd as (select q, 1 / greatest(avg(greatest(d, kd)), 1e-10) l from k join kd using (n) group by 1) select k.q as vec_id, round(avg(b.l) / max(a.l), 5) as score from k join lrd a on a.q = k.q join lrd b on b.q = k.n group by 1")
def local_outlier_factor(spark, d):
    e = _vectors(spark, d)
    s = LocalOutlierFactorDetector(10, id_col="vec_id").fit(e, None, _ALL).decision_function(e)
    return s.select("vec_id", r(F.col("score"), 5).alias("score"))


@query("dbscan", f"with recursive {_VEC}, p as (select a.vec_id a, b.vec_id b, list_distance(a.v, b.v) d from e a, e b), n as (select a, b, d from p where d <= 1.15), core as (select a from n group by 1 having count(*) >= 4), cl as (select a, b from n where a in (from core) and b in (from core)), reach as (select a, a as b from core union select r.a, cl.b from reach r join cl on cl.a = r.b), comp as (select a, min(b) c from reach group by 1), num as (select a, dense_rank() over (order by c) - 1 k from comp), near as (select n.a, k, row_number() over (partition by n.a order by d, k) r from n join num on num.a = n.b) select vec_id, cast(coalesce(k, -1) as int) as cluster from e left join (select * from near where r = 1) x on x.a = e.vec_id")
def dbscan(spark, d):
    e = _vectors(spark, d).drop("label")
    m = DBSCANClusterer(1.15, 4, id_col="vec_id").fit(e, None, _ALL)
    return m.predict(e).select("vec_id", F.col("prediction").cast("int").alias("cluster"))


@query("tomek_links", f"with {_VEC}, f as (select vec_id, cast(label = 0 as int) y, v from e), p as (select a.vec_id q, b.vec_id n, a.y ya, b.y yb, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) r from f a, f b where a.vec_id <> b.vec_id), k as (select * from p where r = 1), l as (select k.q from k join k m on k.n = m.q and m.n = k.q where k.ya <> k.yb and k.ya = 0) select vec_id, y from f where vec_id not in (select q from l)")
def tomek_links(spark, d):
    e = _vectors(spark, d).select("vec_id", (F.col("label") == 0).cast("int").alias("y"), *_ALL)
    return TomekLinksSampler(id_col="vec_id").fit(e, "y").transform(e).select("vec_id", "y")


# ---------------------------------------------------------------- association rules

_BASKETS = "b as (select distinct l_orderkey o, p_brand i from lineitem join part on p_partkey = l_partkey)"


def _baskets(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return x.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))


@query("frequent_pairs", f"with {_BASKETS}, n as (select count(distinct o) n from b), s as (select x.i a, y.i b, count(*) c from b x join b y on x.o = y.o and x.i < y.i group by 1, 2) select a as first, b as second, c as n, round(c / n.n, 6) as support from s, n where c >= ceil(0.01 * n.n)")
def frequent_pairs(spark, d):
    m = AprioriAssociator(0.01, 0.0, 2).fit(_baskets(spark, d))
    return m.itemsets.where(F.size("items") == 2).select(F.col("items")[0].alias("first"), F.col("items")[1].alias("second"), F.col("count").alias("n"), r(F.col("support")).alias("support"))


@query("association_rules", f"with {_BASKETS}, n as (select count(distinct o) n from b), s1 as (select i, count(*) c from b group by 1), s as (select x.i a, y.i b, count(*) c from b x join b y on x.o = y.o and x.i <> y.i group by 1, 2) select s.a as antecedent, s.b as consequent, round(s.c / ca.c, 6) as confidence, round(s.c / ca.c / (cb.c / n.n), 6) as lift, round(s.c / n.n - ca.c / n.n * (cb.c / n.n), 6) as leverage from s join s1 ca on ca.i = s.a join s1 cb on cb.i = s.b, n where s.c >= ceil(0.01 * n.n) and s.c / ca.c >= 0.1")
def association_rules(spark, d):
    m = AprioriAssociator(0.01, 0.1, 2).fit(_baskets(spark, d))
    return m.rules.select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), r(F.col("confidence")).alias("confidence"), r(F.col("lift")).alias("lift"), r(F.col("leverage")).alias("leverage"))


# ---------------------------------------------------------------- learners


@query("zero_rule", "select o_orderkey, (select o_orderpriority from orders group by 1 order by count(*) desc, 1 limit 1) as prediction from orders")
def zero_rule(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ZeroRuleClassifier().fit(o, "o_orderpriority").predict(o).select("o_orderkey", "prediction")


def _gnb_sql(cols, label, table, keys):
    aggs = ", ".join(f"avg({c}) m{i}, greatest(var_pop({c}), 1e-9) v{i}" for i, c in enumerate(cols))
    score = " + ".join(f"(-0.5 * ln(2 * pi() * v{i}) - ({c} - m{i}) * ({c} - m{i}) / (2 * v{i}))" for i, c in enumerate(cols))
    return f"with b as (select *, row_number() over () as rid from {table}), s as (select {label} k, count(*) n, {aggs} from b group by 1), t as (select sum(n) n, count(*) c from s), p as (select b.*, k, ln((s.n + 1.0) / (t.n + t.c)) + {score} sc from b, s, t), w as (select *, row_number() over (partition by rid order by sc desc, k) r from p) select {keys}, k as prediction from w where r = 1"


@query("gaussian_naive_bayes", _gnb_sql(FEATS, "l_returnflag", "lineitem", "l_orderkey, l_linenumber"))
def gaussian_naive_bayes(spark, d):
    x = _lines(spark, d, "l_returnflag")
    return NaiveBayesClassifier().fit(x, "l_returnflag", FEATS).predict(x).select(*KEYS, "prediction")


@query("multinomial_naive_bayes", "with s as (select l_returnflag k, count(*) n, sum(l_quantity) + 1 a, sum(l_linenumber) + 1 b from lineitem group by 1), l as (select *, row_number() over () as rid from lineitem), p as (select rid, l_orderkey, l_linenumber, k, ln(n / (select count(*) from lineitem)) + l_quantity * ln(a / (a + b)) + l_linenumber * ln(b / (a + b)) sc from l, s), w as (select l_orderkey, l_linenumber, k, row_number() over (partition by rid order by sc desc, k) r from p) select l_orderkey, l_linenumber, k as prediction from w where r = 1")
def multinomial_naive_bayes(spark, d):
    x = _lines(spark, d, "l_returnflag")
    return NaiveBayesMultinomialClassifier().fit(x, "l_returnflag", ["l_quantity", "l_linenumber"]).predict(x).select(*KEYS, "prediction")


@query("simple_regression", "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem")
def simple_regression(spark, d):
    m = SimpleLinearRegression(0).fit(_lines(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return _one(spark, slope=round(float(m.coef[0]), 4), intercept=round(m.intercept, 4))


@query("linear_regression", "with c as (select var_pop(l_quantity) a, var_pop(l_discount) b, covar_pop(l_quantity, l_discount) ab, covar_pop(l_quantity, l_extendedprice) ay, covar_pop(l_discount, l_extendedprice) cy from lineitem) select round((ay * b - cy * ab) / (a * b - ab * ab), 3) as quantity, round((cy * a - ay * ab) / (a * b - ab * ab), 3) as discount from c")
def linear_regression(spark, d):
    m = LinearRegression().fit(_lines(spark, d), "l_extendedprice", ["l_quantity", "l_discount"])
    return _one(spark, quantity=round(float(m.coef[0]), 3), discount=round(float(m.coef[1]), 3))


_BINS = ", ".join(f"l{i} as (select min({c}) lo, max({c}) hi from lineitem), b{i} as (select " + " + ".join(f"(case when {c} >= lo + (hi - lo) * {k} / 10 then 1 else 0 end)" for k in range(1, 10)) + f" b, l_returnflag y from lineitem, l{i}), r{i} as (select b, arg_max(y, (n, y)) k, sum(n) t, max(n) m from (select b, y, count(*) n from b{i} group by 1, 2) group by 1)" for i, c in enumerate(FEATS))
_RIGHT = " union all ".join(f"select {i} i, sum(m) s from r{i}" for i in range(len(FEATS)))
_GUESSED = " union all ".join(f"select {i} i, case when t >= 6 then k else (select l_returnflag from lineitem group by 1 order by count(*) desc, 1 limit 1) end prediction from b{i} join r{i} using (b)" for i in range(len(FEATS)))


@query("one_rule", f"with {_BINS}, s as ({_RIGHT}), best as (select i from s order by s desc, i limit 1), g as ({_GUESSED}) select prediction, count(*) as count from g join best using (i) group by 1")
def one_rule(spark, d):
    x = _lines(spark, d, "l_returnflag")
    return OneRuleClassifier().fit(x, "l_returnflag", FEATS).predict(x).groupBy("prediction").count()


# ---------------------------------------------------------------- splits


@query("kfold", "select o_orderkey, ntile(5) over (order by o_orderkey) - 1 as fold from orders")
def kfold(spark, d):
    return KFold(5, id_col="o_orderkey").folds(t(spark, d, "orders").select("o_orderkey"))


@query("stratified_kfold", "select o_orderkey, ntile(5) over (partition by o_orderstatus order by md5('0:' || o_orderkey), o_orderkey) - 1 as fold from orders")
def stratified_kfold(spark, d):
    return StratifiedKFold(5, True, 0, "o_orderkey").folds(t(spark, d, "orders"), "o_orderstatus").select("o_orderkey", "fold")


@query("group_kfold", "select o_orderkey, (dense_rank() over (order by o_custkey) - 1) % 4 as fold from orders")
def group_kfold(spark, d):
    return GroupKFold(4, "o_custkey").folds(t(spark, d, "orders")).select("o_orderkey", "fold")


@query("stratified_holdout", "select o_orderkey, row_number() over (partition by o_orderstatus order by md5('0:' || o_orderkey), o_orderkey) <= greatest(1, floor(count(*) over (partition by o_orderstatus) * 0.3)) as is_test from orders")
def stratified_holdout(spark, d):
    return holdout(t(spark, d, "orders"), 0.3, "o_orderstatus", "o_orderkey", 0).select("o_orderkey", "is_test")


@query("time_series_split", "with o as (select event_id, row_number() over (order by event_id) - 1 i, count(*) over () n from events) select event_id, cast(f as int) as split, i < n - (5 - f) * (n // 6) as train from o, range(5) t(f) where i < n - (5 - f) * (n // 6) + n // 6")
def time_series_split(spark, d):
    e = t(spark, d, "events").select("event_id")
    out = None
    for k, (a, b) in enumerate(TimeSeriesSplit(5, order_by="event_id").split(e)):
        part = a.select("event_id", F.lit(k).alias("split"), F.lit(True).alias("train")).unionByName(b.select("event_id", F.lit(k).alias("split"), F.lit(False).alias("train")))
        out = part if out is None else out.unionByName(part)
    return out


@query("flagship", _gnb_sql(["zq", "zp", "zd", "zt"], "l_returnflag", "(select l_orderkey, l_linenumber, l_returnflag, " + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as {n}" for c, n in zip(FEATS, ("zq", "zp", "zd", "zt"), strict=True)) + " from lineitem)", "l_returnflag").replace("prediction from w where r = 1", "prediction, count(*) as n from w where r = 1 group by 1, 2"))
def flagship(spark, d):
    """Z-scored Gaussian naive Bayes of return flags, as its confusion table."""
    x = P.StandardScaler(columns=FEATS).fit_transform(_lines(spark, d, "l_returnflag"))
    out = NaiveBayesClassifier().fit(x, "l_returnflag", FEATS).predict(x)
    return out.groupBy("l_returnflag", "prediction").agg(F.count(F.lit(1)).alias("n"))


from . import more_queries  # noqa: E402, F401 (registers its queries)
