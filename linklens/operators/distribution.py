"""Distribution, skew and concentration statistics.

Row-scale work is one partially-aggregated ``groupBy``; everything after it
runs on small aggregates. Ranks over domains (Gini, top-k shares) go through
the histogram of distinct count values, whose size is at most sqrt(2 * rows),
instead of an unpartitioned window over all domains.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.functions import urls as U
from linklens.operators.ranks import with_prefix_sum
from linklens.session import bounded_broadcast, broadcast_if_small, materialize


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _rows(weight: str | None) -> Column:
    """Rows of a group, or the sum of the counts that stand for them."""
    return F.sum(weight).alias("n") if weight else F.count(F.lit(1)).alias("n")


def log2(c: Column) -> Column:
    return F.log(2.0, c)


def value_counts(df: DataFrame, col: str, by=()) -> DataFrame:
    """A4: (by.., col, n, share); null keys dropped, share over non-null rows."""
    by = _keys(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    # totals per group are a small aggregate joined back (broadcast when the
    # check passes); an unpartitioned window would pull every key into one task
    tot = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    j = counts.join(broadcast_if_small(tot), by) if by else counts.crossJoin(bounded_broadcast(tot))
    return j.withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def entropy_of_counts(nlogn: Column, total: Column) -> Column:
    """Base-2 entropy from sum(n*log2 n) and the total: log2 N - sum(n log2 n)/N
    (clamped at 0: one category gives a rounding residue below 0)."""
    return F.greatest(log2(total) - nlogn / total, F.lit(0.0))


def category_summary(df: DataFrame, col: str = "category", by=(), weight: str | None = None) -> DataFrame:
    """A5: n_categories, most/least common (count desc, key asc), balance
    ratio, entropy (base 2), Gini impurity. ``weight`` here and below names the
    count column of pre-counted rows."""
    by = _keys(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(_rows(weight))
    total = F.sum("n")
    agg = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_categories"),
        total.alias("n_records"),
        F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias("most_common"),
        F.max_by(col, F.struct(-F.col("n"), F.col(col))).alias("least_common"),
        (F.min("n") / F.max("n")).alias("balance_ratio"),
        F.sum(F.col("n") * log2(F.col("n"))).alias("_nlogn"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("_n2"),
    )
    return agg.select(
        *by, "n_categories", F.col("n_records").cast("long").alias("n_records"), "most_common", "least_common", "balance_ratio",
        entropy_of_counts(F.col("_nlogn"), F.col("n_records")).alias("entropy"),
        (1 - F.col("_n2") / (F.col("n_records").cast("double") * F.col("n_records"))).alias("gini_impurity"))


def text_length_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: length stats of columns named text/title/content/body (any case):
    mean, median, sample std, min, max, q25, q75. Missing values are ignored.
    ``percentile`` is exact; its state is a value->frequency map, small for
    integer lengths."""
    if cols is None:
        cols = [c for c in df.columns if c.lower() in ("text", "title", "content", "body")]
    parts = []
    for c in cols:
        ln = F.length(c)
        q = F.percentile(ln, [0.25, 0.5, 0.75])
        parts.append(df.agg(
            F.lit(c).alias("column"),
            F.avg(ln).alias("mean"), F.stddev_samp(ln).alias("std"),
            F.min(ln).alias("min"), F.max(ln).alias("max"), q.alias("_q"))
            .select("column", "mean", F.col("_q")[1].alias("median"), "std",
                    F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"),
                    F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def domain_counts(df: DataFrame, domain: str = "publisher", by=(), weight: str | None = None) -> DataFrame:
    """(by.., domain, n) over non-null domains."""
    by = _keys(by)
    return df.where(F.col(domain).isNotNull()).groupBy(*by, domain).agg(_rows(weight))


def domain_distribution(df: DataFrame, domain: str = "publisher", by=(), weight: str | None = None) -> DataFrame:
    """Count of domains and mean/median/sample std/min/max/q25/q75 of
    per-domain record counts."""
    by = _keys(by)
    dc = domain_counts(df, domain, by, weight)
    q = F.percentile("n", [0.25, 0.5, 0.75])
    return dc.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_domains"), F.avg("n").alias("mean"), q.alias("_q"),
        F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"),
    ).select(*by, "n_domains", "mean", F.col("_q")[1].alias("median"), "std", "min", "max",
             F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"))


def domain_skew(df: DataFrame, domain: str = "publisher", by=(), weight: str | None = None) -> DataFrame:
    """Population skewness and excess kurtosis of domain counts, Gini
    coefficient, top-1 / top-5 % / top-10 % of domains share of all records,
    HHI, effective number of domains, small/large domain counts.

    Shares use all records (null domains included) as the denominator."""
    by = _keys(by)
    all_counts = df.groupBy(*by, domain).agg(_rows(weight))
    totals = all_counts.groupBy(*by).agg(F.sum("n").alias("total_records"))
    dc = all_counts.where(F.col(domain).isNotNull())
    moments = dc.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_domains"),
        F.skewness("n").alias("skewness"), F.kurtosis("n").alias("kurtosis"),
        F.sum(F.col("n").cast("double") ** 2).alias("_n2"),
        F.max("n").alias("_top1"),
        F.count_if(F.col("n") == 1).alias("domains_with_single_record"),
        F.count_if(F.col("n") < 10).alias("domains_with_lt_10_records"),
        F.count_if(F.col("n") > 100).alias("domains_with_gt_100_records"))
    # histogram of counts: m domains hold exactly n records each
    hist = dc.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("m"))
    h = with_prefix_sum(hist, "m", "n", by).select(
        *by, "n", "m", F.col("_before").alias("_below"), F.col("_total").alias("_d"))
    h = h.withColumn("_above", F.col("_d") - F.col("_below") - F.col("m"))
    k5 = F.greatest(F.lit(1), F.floor(F.col("_d") / 20))
    k10 = F.greatest(F.lit(1), F.floor(F.col("_d") / 10))

    def take(k):  # records of the domains ranked inside the top k
        return F.col("n") * F.least(F.greatest(k - F.col("_above"), F.lit(0)), F.col("m"))

    ranks = h.groupBy(*by).agg(
        F.sum(F.col("n") * (F.col("m") * F.col("_below") + F.col("m") * (F.col("m") + 1) / 2))
         .alias("_rank_sum"),
        F.sum(F.col("n") * F.col("m")).alias("_s"),
        F.sum(take(k5)).alias("_top5"), F.sum(take(k10)).alias("_top10"))
    j = moments.join(ranks, by, "inner") if by else moments.crossJoin(ranks)
    j = j.join(totals, by, "inner") if by else j.crossJoin(totals)
    nd = F.col("n_domains").cast("double")
    tot = F.col("total_records").cast("double")
    hhi = F.col("_n2") / (tot * tot)
    return j.select(
        *by, "n_domains", "total_records", "skewness", "kurtosis",
        (2 * F.col("_rank_sum") / (nd * F.col("_s")) - (nd + 1) / nd).alias("gini_coefficient"),
        (F.col("_top1") / tot).alias("top_1_domain_share"),
        (F.col("_top5") / tot).alias("top_5pct_domains_share"),
        (F.col("_top10") / tot).alias("top_10pct_domains_share"),
        hhi.alias("herfindahl_hirschman_index"),
        F.when(hhi > 0, 1 / hhi).otherwise(nd).alias("effective_number_domains"),
        "domains_with_single_record", "domains_with_lt_10_records",
        "domains_with_gt_100_records")


def category_per_domain(df: DataFrame, domain: str = "publisher", y: str = "category",
                        by=(), with_counts: bool = False, weight: str | None = None) -> DataFrame:
    """Per domain total, number of categories, dominant category (count
    desc, key asc) and its share, entropy, single-category flag. Null domains
    are excluded. ``with_counts`` adds the category -> count map."""
    by = _keys(by)
    cells = (df.where(F.col(domain).isNotNull() & F.col(y).isNotNull())
               .groupBy(*by, domain, y).agg(_rows(weight)))
    aggs = [F.sum("n").alias("total_records"), F.count(F.lit(1)).alias("n_categories"),
            F.min_by(y, F.struct(-F.col("n"), F.col(y))).alias("dominant_category"),
            F.max("n").alias("_top"), F.sum(F.col("n") * log2(F.col("n"))).alias("_nlogn")]
    if with_counts:
        aggs.append(F.map_from_entries(F.collect_list(F.struct(y, "n"))).alias("category_counts"))
    per = cells.groupBy(*by, domain).agg(*aggs)
    extra = ["category_counts"] if with_counts else []
    return per.select(
        *by, domain, "total_records", "n_categories", "dominant_category",
        (F.col("_top") / F.col("total_records")).alias("dominant_category_share"),
        entropy_of_counts(F.col("_nlogn"), F.col("total_records")).alias("entropy"),
        (F.col("n_categories") == 1).alias("is_single_category"), *extra)


def category_per_domain_summary(df: DataFrame, domain: str = "publisher",
                                y: str = "category", by=(), weight: str | None = None) -> DataFrame:
    """Mean and population std of per-domain entropy and dominant share;
    single-category domains and the records inside them (counts, shares)."""
    by = _keys(by)
    per = category_per_domain(df, domain, y, by, weight=weight)
    single = F.col("is_single_category")
    return per.groupBy(*by).agg(
        F.avg("entropy").alias("avg_entropy_per_domain"),
        F.stddev_pop("entropy").alias("std_entropy_per_domain"),
        F.avg("dominant_category_share").alias("avg_dominant_category_share"),
        F.stddev_pop("dominant_category_share").alias("std_dominant_category_share"),
        F.count_if(single).alias("single_category_domains"),
        F.avg(single.cast("double")).alias("single_category_domains_share"),
        F.sum(F.when(single, F.col("total_records")).otherwise(0))
         .alias("records_in_single_category_domains"),
        (F.sum(F.when(single, F.col("total_records")).otherwise(0)) /
         F.sum("total_records")).alias("records_in_single_category_domains_share"))


def domain_category_cube(df: DataFrame, domain: str = "publisher", y: str = "category") -> DataFrame:
    """Cross-tab with margins as a long table; grouping_id 0 = cell,
    1 = domain margin, 2 = category margin, 3 = grand total."""
    return (df.cube(domain, y)
              .agg(F.count(F.lit(1)).alias("n"), F.grouping_id(domain, y).alias("grouping_id")))


def crosstab_shares(df: DataFrame, domain: str = "publisher", y: str = "category",
                    percent: bool = False) -> DataFrame:
    """Row-normalised cross-tab, long form (domain, y, n, share)."""
    cells = (df.where(F.col(domain).isNotNull() & F.col(y).isNotNull())
               .groupBy(domain, y).agg(F.count(F.lit(1)).alias("n")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(domain))
    return cells.withColumn("share", share * 100 if percent else share)


# ---- chi-square p-value: regularised upper incomplete gamma -----------------

def _gammaincc(a: float, x: float) -> float:
    """Q(a, x) by series (x < a + 1) or Lentz continued fraction."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1:
        ap, s, d = a, 1.0 / a, 1.0 / a
        while True:
            ap += 1
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in itertools.count(1):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        de = d * c
        h *= de
        if abs(de - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(stat: float, dof: float) -> float:
    if stat is None or dof is None or math.isnan(stat) or math.isnan(dof) or dof <= 0:
        return float("nan")
    if math.isinf(stat) or math.isinf(dof):
        # no deviation is large against infinitely many degrees of freedom
        return float("nan") if stat == dof else 0.0 if stat > dof else 1.0
    if dof > 1e6:
        # Wilson-Hilferty: the cube root of chi2 / dof is nearly normal, the better the
        # larger dof; here it is within 1e-7, and the series would need many steps
        v = 2.0 / (9.0 * dof)
        return 0.5 * math.erfc((max(stat, 0.0) / dof) ** (1 / 3) / math.sqrt(2 * v) - (1 - v) / math.sqrt(2 * v))
    return _gammaincc(dof / 2.0, stat / 2.0)


@F.pandas_udf(T.DoubleType())
def _chi2_sf_udf(stat, dof):  # one row per call site: the p-value of a test
    return stat.combine(dof, lambda s, d: chi2_sf(float(s), float(d)))


def chi2_independence(df: DataFrame, domain: str = "publisher", y: str = "category",
                      with_p_value: bool = True) -> DataFrame:
    """Chi-square test of independence of domain and category over
    the non-empty cells: chi2 = N * (sum O^2 / (R C) - 1), dof = (r-1)(c-1),
    Cramer's V; Yates' correction when dof = 1 (2x2, all four cells).
    The p-value comes from a one-row Arrow UDF."""
    # every statistic below reads the cell counts: count them once
    cells = materialize(df.where(F.col(domain).isNotNull() & F.col(y).isNotNull())
                          .groupBy(domain, y).agg(F.count(F.lit(1)).alias("o")))
    rows = cells.groupBy(domain).agg(F.sum("o").alias("r_tot"))
    cols = cells.groupBy(y).agg(F.sum("o").alias("c_tot"))
    dims = rows.agg(F.count(F.lit(1)).alias("r"), F.sum("r_tot").alias("n")).crossJoin(
        cols.agg(F.count(F.lit(1)).alias("c")))
    # categories are few next to domains: broadcast the column margins if small
    j = cells.join(rows, domain).join(broadcast_if_small(cols), y)
    plain = j.agg(F.sum(F.col("o").cast("double") * F.col("o")
                         / (F.col("r_tot").cast("double") * F.col("c_tot"))).alias("_s"))
    # Yates (2x2 only): the dense 2x2 comes from the two row and two column margins
    # rows survive only when there are at most two of them, so the product
    # below has at most four rows
    small = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_r")).where(F.col("_r") <= 2))
    dense = (rows.crossJoin(small).drop("_r").crossJoin(bounded_broadcast(cols.limit(2)))
                 .join(cells, [domain, y], "left")
                 .select(F.coalesce("o", F.lit(0)).alias("o"), "r_tot", "c_tot"))
    e = F.col("r_tot").cast("double") * F.col("c_tot") / F.col("n")
    dev = F.greatest(F.abs(F.col("o") - e) - F.lit(0.5), F.lit(0.0))
    yates = (dense.crossJoin(bounded_broadcast(dims.select("n")))
                  .agg(F.sum(dev * dev / e).alias("_y")))
    out = dims.crossJoin(plain).crossJoin(yates)
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    stat = F.when(dof == 1, F.col("_y")).otherwise(F.col("n") * (F.col("_s") - 1))
    res = out.select(stat.alias("chi2_statistic"), dof.cast("long").alias("degrees_of_freedom"),
                     "n", "r", "c")
    res = res.withColumn("cramers_v", F.sqrt(F.col("chi2_statistic") /
                                             (F.col("n") * (F.least("r", "c") - 1))))
    if with_p_value:
        res = (res.withColumn("p_value", _chi2_sf_udf(F.col("chi2_statistic"),
                                                      F.col("degrees_of_freedom").cast("double")))
                  .withColumn("is_significant", F.col("p_value") < 0.05))
    return res.drop("n", "r", "c")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null) for every column."""
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    stack = "stack({}, {}) as (column, n_null)".format(
        len(df.columns), ", ".join(f"'{c}', `{c}`" for c in df.columns))
    return agg.selectExpr(stack)


def domain_concentration(df: DataFrame, url: str = "url", top: int = 10) -> DataFrame:
    """Host from the URL ('unknown' when absent; such rows dropped),
    totals, top-5 and top-10 shares by rank (percent), and the top list.
    One scan builds the per-domain counts; the rest reads that aggregate."""
    d = df.select(U.domain_or_unknown(url).alias("domain"))
    # dropping 'unknown'/'' keys after grouping equals dropping the rows
    # before it; applied to the written aggregate, the filter cannot be pushed
    # back onto (and re-evaluate) the URL expression per row
    dc = materialize(d.groupBy("domain").agg(F.count(F.lit(1)).alias("n")))
    dc = dc.where((F.col("domain") != "unknown") & (F.col("domain") != ""))
    k = max(top, 10)
    # the top list is a TakeOrdered of k rows; totals come from one small agg
    topk = dc.orderBy(F.col("n").desc(), F.col("domain")).limit(k)
    ranked = topk.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("n").desc(), F.col("domain"))).cast("long"))
    tot = dc.agg(F.sum("n").alias("total_articles"), F.count(F.lit(1)).alias("unique_domains"))
    shares = ranked.agg(F.sum(F.when(F.col("rank") <= 5, F.col("n"))).alias("_t5"),
                        F.sum(F.when(F.col("rank") <= 10, F.col("n"))).alias("_t10"))
    summ = tot.crossJoin(shares).select(
        "total_articles", "unique_domains",
        (F.col("_t5") / F.col("total_articles") * 100).alias("top5_share_pct"),
        (F.col("_t10") / F.col("total_articles") * 100).alias("top10_share_pct"))
    return (ranked.where(F.col("rank") <= top).crossJoin(bounded_broadcast(summ))
                  .withColumn("share_pct", F.col("n") / F.col("total_articles") * 100))


def _cells(df: DataFrame, domain: str, topic: str) -> DataFrame:
    """(domain, topic, n) counted once and materialised: every later step of
    the domain x topic reports reads this aggregate, not the rows."""
    return materialize(df.groupBy(domain, topic).agg(F.count(F.lit(1)).alias("n")))


def top_domain_topics(df: DataFrame, domain: str = "domain", topic: str = "category",
                      top: int = 5) -> DataFrame:
    """Number of topics and topic entropy of the top domains."""
    cells = _cells(df, domain, topic)
    dc = cells.groupBy(domain).agg(F.sum("n").alias("n"))
    topd = bounded_broadcast(dc.orderBy(F.col("n").desc(), F.col(domain)).limit(top)
                               .select(domain))
    sel = cells.join(topd, domain, "left_semi")
    return sel.groupBy(domain).agg(
        F.count(F.lit(1)).alias("n_topics"), F.sum("n").alias("n_articles"),
        F.sum(F.col("n") * log2(F.col("n"))).alias("_nlogn")).select(
        domain, "n_topics", "n_articles",
        entropy_of_counts(F.col("_nlogn"), F.col("n_articles")).alias("entropy"))


def domain_topic_matrix(df: DataFrame, domain: str = "domain", topic: str = "category",
                        top_domains: int = 10, top_topics: int = 10) -> DataFrame:
    """Percent of each top domain's articles per top topic (rows sum to
    100 over the kept topics), long form."""
    cells = _cells(df, domain, topic)
    dc = cells.groupBy(domain).agg(F.sum("n").alias("n"))
    tc = cells.groupBy(topic).agg(F.sum("n").alias("n"))
    td = bounded_broadcast(dc.orderBy(F.col("n").desc(), F.col(domain)).limit(top_domains)
                             .select(domain))
    tt = bounded_broadcast(tc.orderBy(F.col("n").desc(), F.col(topic)).limit(top_topics)
                             .select(topic))
    sel = cells.join(td, domain, "left_semi").join(tt, topic, "left_semi")
    return sel.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(domain)))


def mean_per_domain(df: DataFrame, domain: str = "publisher") -> DataFrame:
    """Records / distinct domains."""
    return df.agg((F.count(F.lit(1)) / F.countDistinct(domain)).alias("mean_articles_per_domain"))


def dataset_comparison(df: DataFrame, by: str = "dataset", domain: str = "publisher",
                       y: str = "category") -> DataFrame:
    """One row per dataset: records, categories, domains, Gini, top-1
    share, single-category domain share and records share."""
    # counted once; every part below rolls the cells up
    cells = materialize(df.groupBy(by, domain, y).agg(F.count(F.lit(1)).alias("n")))
    cs = category_summary(cells, y, by, "n").select(by, "n_records", "n_categories")
    sk = domain_skew(cells, domain, by, "n").select(by, "n_domains", "gini_coefficient",
                                                    "top_1_domain_share")
    pd_ = category_per_domain_summary(cells, domain, y, by, "n").select(
        by, "single_category_domains_share", "records_in_single_category_domains_share")
    # one row per dataset each
    return cs.join(sk, by).join(pd_, by)


def chi2_by(cells: DataFrame, by: str, domain: str = "publisher", y: str = "category") -> DataFrame:
    """A16 per group from counted cells (by, domain, y, n): statistic, degrees of freedom,
    Cramer's V and p-value. With one degree of freedom Yates' correction applies; there all
    four deviations are equal, so one of them and the margins give the sum."""
    o = cells.where(F.col(domain).isNotNull() & F.col(y).isNotNull()).groupBy(by, domain, y).agg(F.sum("n").alias("o"))
    rows = o.groupBy(by, domain).agg(F.sum("o").alias("r"))
    cols = o.groupBy(by, y).agg(F.sum("o").alias("c"))
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("nr"), F.sum("r").alias("all"), F.sum(1 / F.col("r")).alias("ir"))
    total = total.join(cols.groupBy(by).agg(F.count(F.lit(1)).alias("nc"), F.sum(1 / F.col("c")).alias("ic")), by)
    met = o.join(rows, [by, domain]).join(broadcast_if_small(cols), [by, y]).join(broadcast_if_small(total), by)
    e = F.col("r").cast("double") * F.col("c") / F.col("all")
    g = met.groupBy(by, "nr", "nc", "all", "ir", "ic").agg(
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"),
        F.max(F.abs(F.col("o") - e)).alias("dev"))
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    off = F.greatest(F.col("dev") - 0.5, F.lit(0.0))
    stat = F.when(dof == 1, off * off * F.col("all") * F.col("ir") * F.col("ic")).otherwise(F.col("all") * (F.col("s") - 1))
    out = g.select(by, stat.alias("chi2_statistic"), dof.alias("degrees_of_freedom"),
                   F.sqrt(stat / (F.col("all") * (F.least("nr", "nc") - 1))).alias("cramers_v"))
    return out.withColumn("p_value", _chi2_sf_udf(F.col("chi2_statistic"), F.col("degrees_of_freedom").cast("double")))


def basic_stats(df: DataFrame) -> DataFrame:
    """A2: rows, number of columns and the column names."""
    return df.agg(F.count(F.lit(1)).alias("n_records")).select(
        "n_records", F.lit(len(df.columns)).cast("long").alias("n_features"),
        F.lit(",".join(df.columns)).alias("column_names"))


def label_codes(df: DataFrame, col: str = "category") -> DataFrame:
    """P38/M14 (relational form): label -> code in alphabetical order
    (0-based), as LabelEncoder / StringIndexer(alphabetAsc) assign them.
    The window runs over the distinct labels only."""
    labels = df.where(F.col(col).isNotNull()).select(col).distinct()
    return labels.withColumn("code", (F.dense_rank().over(Window.orderBy(col)) - 1).cast("long"))
