"""Further registered queries: metrics, tests, distances, kernels, selectors, splitters, tokenizers, forecasters, files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from .functions import estimators as E
from .functions import kernels as K
from .functions import metrics as M
from .functions import stats as S
from .functions import text as T
from .operators import features as FE
from .operators import learners as L
from .operators import neighbors as N
from .operators import preprocessing as P
from .operators import timeseries as TS
from .operators.associations import AprioriAssociator, ECLATAssociator, FPGrowthAssociator
from .operators.sampling import ENNSampler, NearMissSampler
from .plans import splitting as SP
from .plans import workflow as W
from .plans.graph import ensure_checkpoint_dir
from .queries import _BIN, _TABLE, _binary, _one, _rounded, query, r, t
from .sources import files

# ---------------------------------------------------------------- metrics


@query("binary_rates", _BIN + "select round(tp / (tp + fn), 6) as tpr, round(fp / (fp + tn), 6) as fpr, round(tn / (fp + tn), 6) as tnr, round(fn / (tp + fn), 6) as fnr, round(tp / (tp + fn), 6) as sensitivity, cast(tp as double) as tp, cast(fp as double) as fp, cast(fn as double) as fn, cast(tn as double) as tn, round(5.0 * tp / (5.0 * tp + 4.0 * fn + fp), 6) as f2, round((fp + fn) / n, 6) as hamming, round((fp + fn) / n, 6) as zero_one from c")
def binary_rates(spark, d):
    b, y = _binary(spark, d).cache(), ("y", "yhat")
    return _one(
        spark, tpr=M.true_positive_rate(b, *y), fpr=M.false_positive_rate(b, *y), tnr=M.true_negative_rate(b, *y), fnr=M.false_negative_rate(b, *y), sensitivity=M.sensitivity_score(b, *y), tp=M.num_true_positives(b, *y), fp=M.num_false_positives(b, *y),
        fn=M.num_false_negatives(b, *y), tn=M.num_true_negatives(b, *y), f2=M.fbeta_score(b, *y, beta=2.0), hamming=M.hamming_loss(b, *y), zero_one=M.zero_one_loss(b, *y),
    )


_MULTI = "with p as (select l_returnflag y, case when l_discount < 0.03 then 'A' when l_discount < 0.07 then 'N' else 'R' end p from lineitem), j as (select y, p, count(*) n from p group by 1, 2), c as (select l, sum(n) filter (y = l and p = l) tp, sum(n) filter (p = l) np, sum(n) filter (y = l) ny from j, (values ('A'), ('N'), ('R')) v(l) group by 1)"


def _multi(spark, d):
    x = t(spark, d, "lineitem")
    return x.select(F.col("l_returnflag").alias("y"), F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R").alias("p"))


@query("precision_recall_by_class", _MULTI + " select l as label, round(tp / np, 6) as prec, round(tp / ny, 6) as recall, round(2 * tp / (np + ny), 6) as f1, cast(ny as bigint) as support from c")
def precision_recall_by_class(spark, d):
    p, rec, f, s = M.precision_recall_fscore_support(_multi(spark, d), "y", "p", labels=["A", "N", "R"])
    rows = [(k, float(a), float(b), float(c), int(n)) for k, a, b, c, n in zip("ANR", p, rec, f, s, strict=True)]
    return _rounded(spark.createDataFrame(rows, "label string, prec double, recall double, f1 double, support long"), ["prec", "recall", "f1"])


@query("confusion_shares", _MULTI + " select y as truth, p as guess, round(n / sum(n) over (partition by y), 6) as share from j")
def confusion_shares(spark, d):
    m = M.confusion_matrix(_multi(spark, d), "y", "p", labels=["A", "N", "R"], normalize="true")
    return _rounded(spark.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate("ANR") for j, b in enumerate("ANR")], "truth string, guess string, share double"), ["share"])


_SCORE = "with s as (select l_returnflag = 'R' y, l_discount s, 0.2 + 5 * l_discount q from lineitem), g as (select s, count(*) filter (y) p, count(*) filter (not y) n from s group by 1), c as (select *, sum(p) over (order by s desc) cp, sum(n) over (order by s desc) cn, sum(p) over () tp from g)"


def _scored(spark, d):
    return t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("s"), (0.2 + 5 * F.col("l_discount")).alias("q"))


@query("precision_recall_curve", _SCORE + " select s as threshold, round(cp / (cp + cn), 6) as prec, round(cp / tp, 6) as recall from c")
def precision_recall_curve(spark, d):
    return _rounded(M.precision_recall_curve(_scored(spark, d), "y", "s").withColumnRenamed("precision", "prec"), ["prec", "recall"])


@query("score_losses", _SCORE + " select round((select sum(p * cp / (cp + cn)) / max(tp) from c), 6) as average_precision, round((select avg(-ln(case when y then q else 1 - q end)) from s), 6) as log_loss")
def score_losses(spark, d):
    x = _scored(spark, d)
    return _one(spark, average_precision=M.average_precision_score(x, "y", "s"), log_loss=M.log_loss(x, "y", "q"))


@query("squared_errors", "with p as (select l_discount y, l_tax p from lineitem) select round(avg((y - p) * (y - p)), 9) as mse, round(100 * sqrt(avg((y - p) * (y - p)) / var_pop(y)), 6) as rrse from p")
def squared_errors(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_discount").alias("y"), F.col("l_tax").alias("p"))
    row = spark.createDataFrame([(M.mean_squared_error(x, "y", "p"), M.root_relative_squared_error(x, "y", "p"))], "mse double, rrse double")
    return row.select(r("mse", 9).alias("mse"), r("rrse").alias("rrse"))


@query("cluster_information", _TABLE + ", h as (select (select -sum(pa.n / t.n * ln(pa.n / t.n)) from pa, t) ha, (select -sum(pb.n / t.n * ln(pb.n / t.n)) from pb, t) hb, (select -sum(j.n / t.n * ln(j.n / t.n)) from j, t) hj) select round(ha + hb - hj, 6) as mi, round((ha + hb - hj) / ((ha + hb) / 2), 6) as nmi, round((ha + hb - hj) / ha, 6) as homogeneity, round((ha + hb - hj) / hb, 6) as completeness, round(2 * (ha + hb - hj) / (ha + hb), 6) as v, round((ha + hb - hj) / ln(2), 6) as gain, round(ha / ln(2), 6) as prior from h")
def cluster_information(spark, d):
    o, a, b = t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").cache(), "o_orderstatus", "o_orderpriority"
    return _one(spark, mi=M.mutual_info_score(o, a, b), nmi=M.normalized_mutual_info_score(o, a, b), homogeneity=M.homogeneity_score(o, a, b), completeness=M.completeness_score(o, a, b), v=M.v_measure_score(o, a, b), gain=M.information_gain(o, a, b), prior=M.prior_entropy(o, a))


_PQ = "with a as (select list_transform(cast(embedding as double[]), lambda x: abs(x) + 0.01) v from embeddings), z as (select list_transform(list_zip(v, list_reverse(v)), lambda x: [x[1], x[2]]) z from a)"


def _pq(spark, d):
    p = F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.01)
    return t(spark, d, "embeddings").select(p.alias("p"), F.reverse(p).alias("q"))


@query("divergences", _PQ + " select round(avg(list_sum(list_transform(z, lambda x: x[1] * ln(x[1] / x[2])))), 6) as kl, round(avg(list_sum(list_transform(z, lambda x: x[1] * ln(2 * x[1] / (x[1] + x[2])) / 2 + x[2] * ln(2 * x[2] / (x[1] + x[2])) / 2))), 6) as js, round(avg(list_sum(list_transform(z, lambda x: -x[1] * ln(x[2])))), 6) as cross_entropy from z")
def divergences(spark, d):
    x = _pq(spark, d)
    return _one(spark, kl=M.kullback_leibler_divergence(x, "p", "q"), js=M.jensen_shannon_divergence(x, "p", "q"), cross_entropy=M.cross_entropy(x, "p", "q"))


_KB = "with x as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end y, [0.2 + l_discount, 0.3, 0.5 - l_discount] p from lineitem), n as (select y, count(*) / sum(count(*)) over () share from x group by 1)"


@query("information_of_chances", _KB + ", h as (select -sum(share * log2(share)) h from n), s as (select avg(-(p[1] * log2(p[1]) + p[2] * log2(p[2]) + p[3] * log2(p[3]))) s from x) select round(s, 6) as scheme_entropy, round(h - s, 6) as entropy_gain, round((select avg(log2(p[x.y + 1] / share)) from x join n using (y)), 6) as kb from h, s")
def information_of_chances(spark, d):
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x = t(spark, d, "lineitem").select(y.alias("y"), F.array(F.lit(0.2) + F.col("l_discount"), F.lit(0.3), F.lit(0.5) - F.col("l_discount")).alias("p"))
    return _one(spark, scheme_entropy=M.scheme_entropy(x, "p"), entropy_gain=M.entropy_gain(x, "y", "p"), kb=M.mean_kb_information(x, "y", "p"))


def _components(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])


_ALL = [f"x{i}" for i in range(64)]


@query("davies_bouldin", "with e as (select vec_id, label, unnest(cast(embedding as double[])) x, unnest(range(64)) i from embeddings), m as (select label, i, avg(x) m from e group by 1, 2), s as (select label, avg(q) s from (select vec_id, e.label, sqrt(sum((x - m) * (x - m))) q from e join m on e.label = m.label and e.i = m.i group by 1, 2) group by 1), d as (select a.label a, b.label b, sqrt(sum((a.m - b.m) * (a.m - b.m))) d from m a join m b on a.i = b.i and a.label <> b.label group by 1, 2) select round(avg(w), 6) as score from (select d.a, max((x.s + y.s) / d) w from d join s x on x.label = d.a join s y on y.label = d.b group by 1)")
def davies_bouldin(spark, d):
    return _one(spark, score=M.davies_bouldin_score(_components(spark, d), _ALL, "label"))


@query("silhouette_score", "with e as (select vec_id, label, cast(embedding as double[]) v from embeddings), p as (select a.vec_id i, a.label la, b.label lb, sum(list_distance(a.v, b.v)) s, count(*) n from e a, e b group by 1, 2, 3), q as (select i, max(case when la = lb and n > 1 then s / (n - 1) end) a, min(case when la <> lb then s / n end) b from p group by 1) select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as score from q")
def silhouette_score(spark, d):
    return _one(spark, score=M.silhouette_score(_components(spark, d), _ALL, "label", id_col="vec_id"))


# ---------------------------------------------------------------- statistical tests

_PAIRS = "with m as (select month(l_shipdate) m, avg(l_quantity) filter (l_returnflag = 'A') x, avg(l_quantity) filter (l_returnflag = 'R') y, avg(l_quantity) filter (l_returnflag = 'N') z from lineitem group by 1)"


def _months(spark, d):
    """Twelve rows, one a month."""
    q = lambda k: F.avg(F.when(F.col("l_returnflag") == k, F.col("l_quantity")))
    return t(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("m")).agg(q("A").alias("x"), q("R").alias("y"), q("N").alias("z")).orderBy("m").toPandas()


@query("paired_tests", _PAIRS + ", d as (select x - y d from m), k as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 k from d where d <> 0) select cast((select count(*) from d) as double) as n, (select round(avg(d), 6) from d) as mean, (select round(avg(d) / (stddev_samp(d) * sqrt(1.0 / count(*))), 6) from d) as t, (select round(avg(d) / (stddev_samp(d) * sqrt(1.0 / count(*) + 0.25)), 6) from d) as corrected, (select least(sum(k) filter (d > 0), sum(k) filter (d < 0)) from k) as w")
def paired_tests(spark, d):
    p = _months(spark, d)
    a, c, w = S.paired_t_test(p["x"], p["y"]), S.corrected_paired_t_test(p["x"], p["y"], 400, 100), S.wilcoxon_signed_rank_test(p["x"], p["y"])
    return _one(spark, n=a.n, mean=a.mean_difference, t=a.statistic, corrected=c.statistic, w=w.statistic)


_RANKED = ", v as (select m, 'x' k, x v from m union all select m, 'y', y from m union all select m, 'z', z from m), rk as (select m, k, v, rank() over (partition by m order by v desc) + (count(*) over (partition by m, v) - 1) / 2.0 r from v)"


@query("rank_tests", _PAIRS + _RANKED + ", f as (select sum((a - 2) * (a - 2)) s from (select k, avg(r) a from rk group by 1)), g as (select m, max(v) - min(v) w from v group by 1), q as (select m, rank() over (order by w) + (count(*) over (partition by w) - 1) / 2.0 q from g), s as (select k, q * (r - 2) s from rk join q using (m)), ab as (select (select sum(s * s) from s) a, (select sum(t * t) / 12.0 from (select k, sum(s) t from s group by 1)) b), al as (select m, k, rank() over (order by v - a desc) r from (select m, k, v, avg(v) over (partition by m) a from v)), cr as (select sum(c * c) c from (select sum(r) c from al group by k)), rr as (select sum(c * c) c from (select sum(r) c from al group by m)) select round(12.0 * 12 / (3 * 4) * f.s, 6) as friedman, round(11 * b / (a - b), 6) as quade, round(2 * (cr.c - 3 * 144 / 4.0 * 37 * 37) / (3 * 12 * 37 * 73 / 6.0 - rr.c / 3), 6) as aligned, round(2.343 * sqrt(3 * 4 / (6.0 * 12)), 6) as difference from f, ab, cr, rr")
def rank_tests(spark, d):
    p = _months(spark, d)[["x", "y", "z"]].to_numpy()
    return _one(spark, friedman=S.friedman_test(p)["statistic"], quade=S.quade_test(p)["statistic"], aligned=S.friedman_aligned_ranks_test(p)["statistic"], difference=S.nemenyi_post_hoc(p).critical_difference)


@query("average_ranks", _PAIRS + _RANKED + " select m, k, cast(r as double) as r from rk")
def average_ranks(spark, d):
    p = _months(spark, d)
    ranks = S.compute_ranks(p[["x", "y", "z"]].to_numpy())
    return spark.createDataFrame([(int(m), k, float(ranks[i, j])) for i, m in enumerate(p["m"]) for j, k in enumerate("xyz")], "m int, k string, r double")


@query("one_way_anova", _PAIRS + ", v as (select 'x' k, x v from m union all select 'y', y from m union all select 'z', z from m), g as (select k, count(*) n, avg(v) a, sum(v * v) - count(*) * avg(v) * avg(v) w from v group by 1) select round((sum(n * (a - (select avg(v) from v)) ** 2) / 2) / (sum(w) / 33), 4) as f from g")
def one_way_anova(spark, d):
    p = _months(spark, d)
    return _one(spark, f=round(S.one_way_anova(p["x"], p["y"], p["z"])["statistic"], 4))


_P = "with p as (select n_nationkey i, (1 + (n_nationkey * 7) % 25) * (1 + (n_nationkey * 7) % 25) / 12000.0 p from nation), o as (select i, p, row_number() over (order by p, i) k, count(*) over () n from p)"


@query("corrections", _P + " select i, round(least(1, p * n), 9) as bonferroni, round(least(1, max(p * (n - k + 1)) over (order by k)), 9) as holm, round(least(1, min(p * (n - k + 1)) over (order by k desc)), 9) as hochberg, round(least(1, min(p * n / k) over (order by k desc)), 9) as bh from o")
def corrections(spark, d):
    rows = t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("i")).orderBy("i").collect()
    p = [(1 + (x["i"] * 7) % 25) ** 2 / 12000.0 for x in rows]
    of = [f(p)[0] for f in (S.bonferroni_correction, S.holm_correction, S.hochberg_correction, S.benjamini_hochberg)]
    out = spark.createDataFrame([(x["i"], *[float(v[n]) for v in of]) for n, x in enumerate(rows)], "i int, bonferroni double, holm double, hochberg double, bh double")
    return _rounded(out, ["bonferroni", "holm", "hochberg", "bh"], 9)


# ---------------------------------------------------------------- distances, kernels, searches

_NEXT = "with e as (select vec_id, cast(embedding as double[]) v from embeddings), p as (select a.vec_id, a.v a, b.v b, list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])) d from e a join e b on b.vec_id = a.vec_id + 1)"


def _next(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query("distances", _NEXT + " select vec_id, round(list_distance(a, b), 6) as euclidean, round(list_sum(d), 6) as manhattan, round(list_max(d), 6) as chebyshev, round(list_cosine_distance(a, b), 6) as cosine, round(pow(list_sum(list_transform(d, lambda x: x * x * x)), 1 / 3.0), 6) as minkowski from p")
def distances(spark, d):
    f = {"euclidean": N.euclidean_distance, "manhattan": N.manhattan_distance, "chebyshev": N.get_distance_function("chebyshev"), "cosine": N.cosine_distance, "minkowski": lambda a, b: N.minkowski_distance(a, b, 3)}
    return _next(spark, d).select("vec_id", *[r(g("a", "b")).alias(k) for k, g in f.items()])


@query("kernel_values", _NEXT + ", k as (select vec_id, list_dot_product(a, b) d, list_dot_product(a, a) aa, list_dot_product(b, b) bb, pow(list_distance(a, b), 2) q from p) select vec_id, round(d, 6) as linear, round(pow(0.5 * d + 1, 3), 6) as poly, round(pow(d + 1, 2) / sqrt(pow(aa + 1, 2) * pow(bb + 1, 2)), 6) as normalized, round(exp(-0.5 * q), 6) as rbf, round(tanh(0.5 * d + 0.1), 6) as sigmoid, round(1 / (1 + q * 4), 6) as pearson from k")
def kernel_values(spark, d):
    ks = {"linear": K.LinearKernel(), "poly": K.PolynomialKernel(3, 0.5), "normalized": K.NormalizedPolynomialKernel(2), "rbf": K.RBFKernel(0.5), "sigmoid": K.SigmoidKernel(0.5, 0.1), "pearson": K.PearsonUniversalKernel(1.0, 1.0)}
    return _next(spark, d).select("vec_id", *[r(k.evaluate("a", "b")).alias(n) for n, k in ks.items()])


@query("nation_distances", "with n as (select n_nationkey k, [n_nationkey, n_regionkey * 3]::double[] v from nation) select 'cdist' as kind, a.k as i, b.k as j, round(list_distance(a.v, b.v), 6) as distance from n a, n b union all select 'pdist', a.k, b.k, round(list_distance(a.v, b.v), 6) from n a, n b where a.k < b.k")
def nation_distances(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array(F.col("n_nationkey").cast("double"), (F.col("n_regionkey") * 3).cast("double")).alias("v"))
    a, b = N.cdist(n, n, "k", "v").withColumn("kind", F.lit("cdist")), N.pdist(n, "k", "v").withColumn("kind", F.lit("pdist"))
    return _rounded(a.unionByName(b).select("kind", "i", "j", "distance"), ["distance"])


_SEARCH = "with e as (select vec_id, cast(embedding as double[]) v from embeddings), d as (select a.vec_id q, b.vec_id n, round(list_distance(a.v, b.v), 6) d, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) k from e a, e b where a.vec_id % 50 = 0)"


def _search(kind):
    def run(spark, d):
        x = _components(spark, d).drop("label")
        out = kind(k=4, id_col="vec_id").build(x, _ALL).query(x.where("vec_id % 50 = 0"))
        return out.select("query", "neighbor", F.col("rank").cast("int").alias("rank"), r("distance").alias("distance"))

    return run


for _name, _kind in (("linear_search", N.LinearNNSearch), ("kd_tree_search", N.KDTree), ("ball_tree_search", N.BallTree)):
    query(_name, _SEARCH + " select q as query, n as neighbor, cast(k as int) as rank, d as distance from d where k <= 4")(_search(_kind))


# ---------------------------------------------------------------- selection of columns

_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_F = "with " + ", ".join(f"g{i} as (select count(*) n, avg({c}) m, var_pop({c}) v from lineitem group by l_returnflag)" for i, c in enumerate(_FOUR)) + ", f as (" + " union all ".join(f"select {i} i, '{c}' c, (sum(n * (m - (select avg({c}) from lineitem)) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) f from g{i}" for i, c in enumerate(_FOUR)) + "), o as (select *, row_number() over (order by f desc, i desc) k from f)"


@query("univariate_selection", _F + " select 'best' as kind, c as feature, round(f, 4) as score from o where k <= 2 union all select 'share', c, round(f, 4) from o where k <= 3 union all select 'above', c, round(f, 4) from o where f >= 0.5 union all select 'generic', c, round(f, 4) from o where k <= 1")
def univariate_selection(spark, d):
    x = t(spark, d, "lineitem").select(*_FOUR, "l_returnflag")
    kinds = {"best": FE.SelectKBestSelector("f_classif", 2), "share": FE.SelectPercentileSelector("f_classif", 75), "above": FE.SelectThresholdSelector("f_classif", 0.5), "generic": FE.GenericUnivariateSelector("f_classif", "k_best", 1)}
    rows = []
    for k, s in kinds.items():
        s.fit(x, "l_returnflag")
        rows += [(k, c, float(s.scores[c])) for c in s.get_support()]
    return _rounded(spark.createDataFrame(rows, "kind string, feature string, score double"), ["score"], 4)


@query("one_rule_scores", "with " + ", ".join(f"b{i} as (select least(9, floor(({c} - (select min({c}) from lineitem)) / ((select max({c}) - min({c}) from lineitem) / 10.0))) b, l_returnflag y from lineitem), s{i} as (select sum(n) / (select count(*) from lineitem) s from (select max(n) n from (select b, y, count(*) n from b{i} group by 1, 2) group by b))" for i, c in enumerate(("l_quantity", "l_extendedprice"))) + " select round(s0.s, 6) as quantity, round(s1.s, 6) as price from s0, s1")
def one_rule_scores(spark, d):
    s = M.oner_score(t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag"), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return _one(spark, quantity=s["l_quantity"], price=s["l_extendedprice"])


# ---------------------------------------------------------------- densities and impurities


@query("densities", "with m as (select avg(c_acctbal) m, var_pop(c_acctbal) v from customer), n as (select c_mktsegment s, (count(*) + 1.0) / (sum(count(*)) over () + count(*) over ()) p from customer group by 1) select c_custkey, round(10000 * exp(-(c_acctbal - m) * (c_acctbal - m) / (2 * v)) / sqrt(2 * pi() * v), 6) as normal, round(p, 6) as segment from customer join n on s = c_mktsegment, m")
def densities(spark, d):
    c = t(spark, d, "customer")
    a, b = E.NormalEstimator().fit(c, "c_acctbal"), E.DiscreteEstimator().fit(c, "c_mktsegment")
    return c.select("c_custkey", r(10000 * a.probability(F.col("c_acctbal"))).alias("normal"), r(b.probability(F.col("c_mktsegment"))).alias("segment"))


@query("impurities", "with n as (select o_custkey k, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'O') o, count(*) filter (o_orderstatus = 'P') p, count(*) n from orders group by 1) select k, round(1 - (f * f + o * o + p * p) / (n * n), 6) as gini, round(-(case when f > 0 then f / n * log2(f / n) else 0 end + case when o > 0 then o / n * log2(o / n) else 0 end + case when p > 0 then p / n * log2(p / n) else 0 end), 6) as entropy from n")
def impurities(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array(*[F.count_if(F.col("o_orderstatus") == s).cast("double") for s in "FOP"]).alias("c"))
    return n.select("k", r(E.gini_impurity(F.col("c"))).alias("gini"), (r(E.entropy_from_counts(F.col("c"))) + 0.0).alias("entropy"))


# ---------------------------------------------------------------- splits


def _folds(of, repeats=2):
    return reduce(lambda a, b: a.unionByName(b), [of(i).withColumn("repeat", F.lit(i)) for i in range(repeats)])


@query("repeated_kfold", "select o_orderkey, r as repeat, ntile(3) over (partition by r order by md5(r || ':' || o_orderkey), o_orderkey) - 1 as fold from orders, (values (0), (1)) v(r)")
def repeated_kfold(spark, d):
    parts = list(SP.RepeatedKFold(3, 2, 0, "o_orderkey").split(t(spark, d, "orders").select("o_orderkey")))
    return reduce(lambda a, b: a.unionByName(b), [test.withColumns({"repeat": F.lit(i // 3), "fold": F.lit(i % 3)}) for i, (_, test) in enumerate(parts)])


@query("repeated_stratified_kfold", "select o_orderkey, r as repeat, ntile(3) over (partition by r, o_orderstatus order by md5(r || ':' || o_orderkey), o_orderkey) - 1 as fold from orders, (values (0), (1)) v(r)")
def repeated_stratified_kfold(spark, d):
    parts = list(SP.RepeatedStratifiedKFold(3, 2, 0, "o_orderkey").split(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus"))
    return reduce(lambda a, b: a.unionByName(b), [test.select("o_orderkey", F.lit(i // 3).alias("repeat"), F.lit(i % 3).alias("fold")) for i, (_, test) in enumerate(parts)])


_DRAWN = "select o_orderkey, cast(r as int) as round, row_number() over (partition by r{by} order by md5(r || ':' || o_orderkey), o_orderkey) <= {n} as test from orders, (values (0), (1), (2)) v(r)"


def _drawn(kind, y=None):
    def run(spark, d):
        o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
        out = None
        for i, (a, b) in enumerate(kind(3, 0.2, None, 0, "o_orderkey").split(o, y)):
            part = a.select("o_orderkey", F.lit(i).alias("round"), F.lit(False).alias("test")).unionByName(b.select("o_orderkey", F.lit(i).alias("round"), F.lit(True).alias("test")))
            out = part if out is None else out.unionByName(part)
        return out

    return run


query("shuffle_split", _DRAWN.format(by="", n="floor(count(*) over (partition by r) * 0.2)"))(_drawn(SP.ShuffleSplit))
query("stratified_shuffle_split", _DRAWN.format(by=", o_orderstatus", n="greatest(1, floor(count(*) over (partition by r, o_orderstatus) * 0.2))"))(_drawn(SP.StratifiedShuffleSplit, "o_orderstatus"))


@query("holdout_split", "select o_orderkey, row_number() over (order by md5('5:' || o_orderkey), o_orderkey) <= floor(count(*) over () * 0.3) as test from orders")
def holdout_split(spark, d):
    ((a, b),) = SP.HoldoutSplit(0.3, True, 5, "o_orderkey").split(t(spark, d, "orders").select("o_orderkey"))
    return a.withColumn("test", F.lit(False)).unionByName(b.withColumn("test", F.lit(True)))


@query("train_test", "select o_orderkey, row_number() over (partition by o_orderstatus order by md5('3:' || o_orderkey), o_orderkey) <= greatest(1, floor(count(*) over (partition by o_orderstatus) * 0.25)) as test from orders")
def train_test(spark, d):
    a, b = SP.train_test_split(t(spark, d, "orders"), stratify="o_orderstatus", random_state=3, id_col="o_orderkey")
    return a.select("o_orderkey", F.lit(False).alias("test")).unionByName(b.select("o_orderkey", F.lit(True).alias("test")))


@query("leave_out", "select 'one' as kind, dense_rank() over (order by r_regionkey) - 1 as round, r_regionkey from region union all select 'two', k, unnest([a, b]) from (select row_number() over (order by x.r_regionkey, y.r_regionkey) - 1 k, x.r_regionkey a, y.r_regionkey b from region x join region y on x.r_regionkey < y.r_regionkey)")
def leave_out(spark, d):
    x = t(spark, d, "region").select("r_regionkey")
    parts = [("one", i, b) for i, (_, b) in enumerate(SP.LeaveOneOut("r_regionkey").split(x))] + [("two", i, b) for i, (_, b) in enumerate(SP.LeavePOut(2, "r_regionkey").split(x))]
    return reduce(lambda a, b: a.unionByName(b), [b.select(F.lit(k).alias("kind"), F.lit(i).cast("long").alias("round"), "r_regionkey") for k, i, b in parts])


@query("stratified_group_kfold", "with n as (select o_custkey g, o_orderstatus y, count(*) n from orders group by 1, 2), g as (select g, arg_max(y, (n, y)) y, sum(n) n from n group by 1), f as (select g, (row_number() over (partition by y order by n desc, g) - 1) % 4 fold from g) select o_orderkey, cast(fold as int) as fold from orders join f on g = o_custkey")
def stratified_group_kfold(spark, d):
    return SP.StratifiedGroupKFold(4, False, None, "o_custkey").folds(t(spark, d, "orders"), "o_orderstatus").select("o_orderkey", F.col("fold").cast("int").alias("fold"))


# ---------------------------------------------------------------- text


@query("token_counts", r"select doc_id, len(regexp_extract_all(text, '\S+')) as white, greatest(len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')) - 1, 0) as pairs, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) as gaps from documents")
def token_counts(spark, d):
    n = lambda c: F.size(c).cast("long")
    return t(spark, d, "documents").select("doc_id", n(T.WhitespaceTokenizer()("text")).alias("white"), n(T.NGramTokenizer(2)("text")).alias("pairs"), n(T.RegexTokenizer("[^a-z]+", True)("text")).alias("gaps"))


@query("vocabulary", r"with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents), d as (select w, count(distinct doc_id) d from w group by 1 having d >= 5), c as (select doc_id, w, count(*) n from w join d using (w) group by 1, 2) select doc_id, count(*) as terms, cast(sum(n) as bigint) as tokens, max(n) as most from c group by 1")
def vocabulary(spark, d):
    docs = t(spark, d, "documents")
    v = T.CountVectorizer(T.RegexTokenizer("[a-z]+"), min_df=5).fit(docs, "text")
    return v.terms(docs, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"))


@query("idf_weights", r"with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents), n as (select count(*) n from documents), d as (select w, count(distinct doc_id) d from w group by 1 having d >= 5), c as (select doc_id, w, d, count(*) n from w join d using (w) group by 1, 2, 3), x as (select doc_id, (1 + ln(c.n)) * (ln((n.n + 1.0) / (d + 1)) + 1) v from c, n) select doc_id, round(sum(v), 4) as total, round(max(v), 5) as largest from x group by 1")
def idf_weights(spark, d):
    docs = t(spark, d, "documents")
    v = T.CountVectorizer(T.RegexTokenizer("[a-z]+"), min_df=5).fit(docs, "text")
    w = T.TfidfTransformer(norm=None, sublinear_tf=True).weigh(v.terms(docs, "doc_id"), "doc_id", v.n_docs)
    return w.groupBy("doc_id").agg(r(F.sum("weight"), 4).alias("total"), r(F.max("weight"), 5).alias("largest"))


# ---------------------------------------------------------------- series

_SERIES = "with s as (select user_id u, sqrt(abs(value)) y, row_number() over (partition by user_id order by event_id) i, count(*) over (partition by user_id) n from events)"


def _forecast(spark, d, model, steps=3):
    e = t(spark, d, "events").select("user_id", "event_id", F.sqrt(F.abs("value")).alias("value"))
    return model.fit(e, "value", "event_id", "user_id").forecast(steps)


def _steps(df, n=5):
    return df.select(F.col("series").alias("user_id"), "step", r("prediction", n).alias("prediction"))


@query("ar_forecast", _SERIES + ", m as (select u, avg(y) m from s group by 1), z as (select s.u, i, n, y - m z, m from s join m on s.u = m.u), c as (select a.u, sum(a.z * b.z) c1 from z a join z b on a.u = b.u and b.i = a.i - 1 group by 1), c0 as (select u, sum(z * z) c0, max(m) m, arg_max(z, i) last from z group by 1) select u as user_id, cast(h as int) as step, round(m + pow(c1 / c0, h) * last, 5) as prediction from c0 join c using (u), range(1, 4) t(h)")
def ar_forecast(spark, d):
    return _steps(_forecast(spark, d, TS.AR(1)))


@query("smoothing_forecast", _SERIES + " select u as user_id, cast(h as int) as step, round(sum(case when i = 1 then pow(0.7, n - 1) * y else 0.3 * pow(0.7, n - i) * y end), 5) as prediction from s, range(1, 4) t(h) group by 1, 2")
def smoothing_forecast(spark, d):
    return _steps(_forecast(spark, d, TS.ExponentialSmoothing(smoothing_level=0.3)))


@query("drift_forecast", _SERIES + ", e as (select u, arg_min(y, i) a, arg_max(y, i) b, max(n) n from s group by 1) select u as user_id, cast(h as int) as step, round(b + h * (b - a) / (n - 1), 5) as prediction from e, range(1, 4) t(h)")
def drift_forecast(spark, d):
    return _steps(_forecast(spark, d, TS.ARIMA((0, 1, 0))))


@query("mean_forecast", _SERIES + " select u as user_id, cast(h as int) as step, round(avg(y), 5) as prediction from s, range(1, 4) t(h) group by 1, 2")
def mean_forecast(spark, d):
    return _steps(_forecast(spark, d, TS.ARMA((0, 0))))


# ---------------------------------------------------------------- item sets

_BASKET = "with b as (select distinct l_orderkey o, l_suppkey % 12 i from lineitem), n as (select count(distinct o) n from b), s as (select [x.i, y.i, z.i] i, count(*) c from b x join b y on x.o = y.o and x.i < y.i join b z on z.o = x.o and y.i < z.i group by 1) select array_to_string(i, ',') as items, c as n, round(c / n.n, 6) as support from s, n where c >= ceil(0.02 * n.n)"


def _triples(kind):
    def run(spark, d):
        b = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 12).alias("i")).groupBy("l_orderkey").agg(F.collect_set("i").alias("items"))
        m = kind(0.02, 0.1, 3).fit(b)
        return m.itemsets.where(F.size("items") == 3).select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.col("count").alias("n"), r("support").alias("support"))

    return run


for _name, _kind in (("apriori_triples", AprioriAssociator), ("eclat_triples", ECLATAssociator), ("fp_growth_triples", FPGrowthAssociator)):
    query(_name, _BASKET)(_triples(_kind))


# ---------------------------------------------------------------- rows near each other

_NEAR = "with e as (select vec_id, label % 2 y, cast(embedding as double[]) v from embeddings), c as (select y, count(*) n from e group by 1), low as (select arg_min(y, (n, cast(y as varchar))) y, min(n) n from c)"


def _halves(spark, d):
    return t(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])


@query("edited_neighbours", _NEAR + ", k as (select a.vec_id, a.y, b.y yn, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) k from e a join e b on a.vec_id <> b.vec_id), s as (select vec_id, y, avg(case when y = yn then 1.0 else 0 end) s from k where k <= 3 group by 1, 2) select vec_id from s, low where not (s < 1 and s.y <> low.y)")
def edited_neighbours(spark, d):
    return ENNSampler(id_col="vec_id").fit_transform(_halves(spark, d), "y").select("vec_id")


@query("near_miss", _NEAR + ", k as (select a.vec_id, list_distance(a.v, b.v) d, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) k from low, e a join e b on true where a.y <> low.y and b.y = low.y), s as (select vec_id, avg(d) d from k where k <= 3 group by 1), o as (select vec_id, row_number() over (order by d, vec_id) k from s) select vec_id from o, low where k <= low.n union all select vec_id from e, low where e.y = low.y")
def near_miss(spark, d):
    return NearMissSampler(id_col="vec_id").fit_transform(_halves(spark, d), "y").select("vec_id")


# ---------------------------------------------------------------- files


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


_PARTS = "select cast(p_partkey as double) as p_partkey, cast(p_size as double) as p_size, round(p_retailprice, 4) as p_retailprice from part"


def _round_trip(suffix):
    def run(spark, d):
        x = t(spark, d, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"), F.col("p_size").cast("double").alias("p_size"), r("p_retailprice", 4).alias("p_retailprice"))
        path = f"{_folder(spark)}/part.{suffix}"
        files.save(path, x)
        return files.load(spark, path).frame.select(*[F.col(c).cast("double").alias(c) for c in x.columns])

    return run


for _name in ("csv", "json", "jsonl", "parquet", "arff", "tsv"):
    query(f"load_{_name}", _PARTS)(_round_trip(_name))


@query("load_parquet_partitioned", "select cast(p_partkey as bigint) as p_partkey, p_size from part where p_size >= 40")
def load_parquet_partitioned(spark, d):
    path = _folder(spark)
    files.save_parquet(path, t(spark, d, "part").select("p_partkey", "p_size"), partition_by="p_size")
    out = files.load_parquet_partitioned(spark, path, filters=[("p_size", ">=", 40)]).frame
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))


@query("load_pandas", "select cast(dense_rank() over (order by n_name) - 1 as double) as n_name, n_regionkey from nation")
def load_pandas(spark, d):
    return files.load_pandas(spark, t(spark, d, "nation").select("n_name", "n_regionkey").toPandas(), "n_regionkey").frame.select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


# ---------------------------------------------------------------- further


@query("data_profile", "select c as name, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as std, min(x) as low, max(x) as high, count(*) - count(x) as missing from (select 'value' c, case when event_id % 7 <> 0 then value end x from events union all select 'user_id', cast(user_id as double) from events) group by 1")
def data_profile(spark, d):
    e = t(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "user_id")
    p = W.execute_data_profile(e)
    rows = [(c, *[float(p["statistics"][c][k]) for k in ("mean", "std", "min", "max")], int(p["missing"][c])) for c in ("value", "user_id")]
    return _rounded(spark.createDataFrame(rows, "name string, mean double, std double, low double, high double, missing long"), ["mean", "std"], 4)


@query("read_data", "select n_nationkey, n_name from nation where n_regionkey = 3")
def read_data(spark, d):
    rows = W.execute_read_data(t(spark, d, "nation"), 100, condition="n_regionkey = 3", columns=["n_nationkey", "n_name"])
    return spark.createDataFrame([tuple(x.values()) for x in rows], "n_nationkey int, n_name string")


@query("label_encode", "select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as double) as code from orders")
def label_encode(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return P.LabelEncoder(columns=["o_orderpriority"]).fit_transform(o).select("o_orderkey", F.col("o_orderpriority").cast("double").alias("code"))


@query("normalized_text", r"select doc_id, md5(trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g'))) as digest from documents")
def normalized_text(spark, d):
    out = T.TextNormalizer(form=None, columns=["text"]).fit_transform(t(spark, d, "documents"))
    return out.select("doc_id", F.md5("text").alias("digest"))


@query("stratified_holdout_split", "select o_orderkey, row_number() over (partition by o_orderstatus order by md5('2:' || o_orderkey), o_orderkey) <= greatest(1, floor(count(*) over (partition by o_orderstatus) * 0.3)) as test from orders")
def stratified_holdout_split(spark, d):
    ((a, b),) = SP.StratifiedHoldoutSplit(0.3, True, 2, "o_orderkey").split(t(spark, d, "orders"), "o_orderstatus")
    return a.select("o_orderkey", F.lit(False).alias("test")).unionByName(b.select("o_orderkey", F.lit(True).alias("test")))


_LINES = "with m as (select regr_slope(l_extendedprice, l_quantity) a, regr_intercept(l_extendedprice, l_quantity) b, regr_slope(l_extendedprice, l_tax) c, regr_intercept(l_extendedprice, l_tax) e from lineitem)"


@query("voting_regressor", _LINES + " select l_orderkey, l_linenumber, round((a * l_quantity + b + c * l_tax + e) / 2, 3) as prediction from lineitem, m")
def voting_regressor(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")

    class One(L.SimpleLinearRegression):
        """On one column only."""

        def fit(self, df, label=None, features=None):
            return super().fit(df, label, [self.column])

    a, b = One(), One()
    a.column, b.column = "l_quantity", "l_tax"
    m = L.VotingRegressor([a, b]).fit(x, "l_extendedprice", ["l_quantity", "l_tax"])
    return m.predict(x).select("l_orderkey", "l_linenumber", r("prediction", 3).alias("prediction"))


@query("kernel_density", "with m as (select min(s_acctbal) lo, max(s_acctbal) hi, stddev_pop(s_acctbal) * pow(count(*), -0.2) w, count(*) n from supplier), c as (select least(floor((s_acctbal - lo) / ((hi - lo) / 256)), 255) c, count(*) k, avg(s_acctbal) a from supplier, m group by 1) select s_suppkey, round(10000 * sum(k / n * exp(-(s_acctbal - a) * (s_acctbal - a) / (2 * w * w))) / max(w * sqrt(2 * pi())), 6) as density from supplier, c, m group by 1")
def kernel_density(spark, d):
    x = t(spark, d, "supplier")
    return x.select("s_suppkey", r(10000 * E.KernelEstimator().fit(x, "s_acctbal").probability(F.col("s_acctbal"))).alias("density"))


@query("seasonal_forecast", _SERIES + ", l as (select u, regr_slope(y, i - 1) a, regr_intercept(y, i - 1) b, max(n) n from s group by 1), r as (select s.u, (i - 1) % 4 k, avg(y - b - a * (i - 1)) m from s join l on s.u = l.u group by 1, 2) select l.u as user_id, cast(h as int) as step, round(b + a * (n + h - 1) + coalesce(m, 0), 5) as prediction from l cross join range(1, 4) t(h) left join r on r.u = l.u and r.k = (n + h - 1) % 4")
def seasonal_forecast(spark, d):
    return _steps(_forecast(spark, d, TS.Prophet(period=4)))
