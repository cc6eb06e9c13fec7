"""Generators of oracle CTE chains (DuckDB) for the metric and statistics
families, parameterised by grouping keys."""

from __future__ import annotations


def _kk(keys, prefix=""):
    return ", ".join(f"{prefix}{k}" for k in keys)


def macro_ctes(conf: str, keys: list[str], name: str = "macro") -> str:
    """CTEs ending in ``name``(keys.., accuracy, precision, recall, f1,
    n_samples, n_correct) from a confusion CTE (keys.., label, prediction, n)."""
    k = _kk(keys)
    kc = (k + ", ") if keys else ""
    on = " AND ".join([f"t.{x} = p.{x}" for x in keys] + ["t.label = p.label"])
    co = "".join(f"coalesce(t.{x}, p.{x}) AS {x}, " for x in keys)
    return f"""
{name}_t AS (SELECT {kc}label, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp
             FROM {conf} GROUP BY {kc}label),
{name}_p AS (SELECT {kc}prediction AS label, sum(n) AS predicted FROM {conf}
             WHERE prediction IS NOT NULL GROUP BY {kc}prediction),
{name}_ls AS (SELECT {co}coalesce(t.label, p.label) AS label, CAST(coalesce(tp, 0) AS BIGINT) AS tp,
                     CAST(coalesce(predicted, 0) - coalesce(tp, 0) AS BIGINT) AS fp,
                     CAST(coalesce(support, 0) - coalesce(tp, 0) AS BIGINT) AS fn,
                     CAST(coalesce(support, 0) AS BIGINT) AS support
              FROM {name}_t t FULL OUTER JOIN {name}_p p ON {on}),
{name}_pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
                        CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall
              FROM {name}_ls),
{name}_lab AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                             ELSE 0.0 END AS f1 FROM {name}_pr),
{name} AS (SELECT {kc}CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(precision) AS precision,
                  avg(recall) AS recall, avg(f1) AS f1, CAST(sum(support) AS BIGINT) AS n_samples,
                  CAST(sum(tp) AS BIGINT) AS n_correct
           FROM {name}_lab GROUP BY {k if keys else '()'})"""


def skew_ctes(src: str, domain: str, by: list[str], name: str = "skew") -> str:
    """CTEs ending in ``name`` with the A7-A11 columns per ``by`` group."""
    b = _kk(by)
    bc = (b + ", ") if by else ""
    part = f"PARTITION BY {b}" if by else ""
    g = f"GROUP BY {b}" if by else ""
    join_tot = ("JOIN " + f"{name}_tot USING ({b})") if by else f", {name}_tot"
    join_mu = ("JOIN " + f"{name}_mu USING ({b})") if by else f", {name}_mu"
    return f"""
{name}_all AS (SELECT {bc}{domain} AS d, count(*) AS n FROM {src} GROUP BY {bc}{domain}),
{name}_tot AS (SELECT {bc}CAST(sum(n) AS BIGINT) AS total_records FROM {name}_all {g}),
{name}_dc AS (SELECT {bc}d, n FROM {name}_all WHERE d IS NOT NULL),
{name}_mu AS (SELECT {bc}avg(n) AS mu FROM {name}_dc {g}),
{name}_r AS (SELECT {bc}n, row_number() OVER ({part} ORDER BY n) AS rk_asc,
                    row_number() OVER ({part} ORDER BY n DESC) AS rk_desc,
                    count(*) OVER ({part}) AS nd FROM {name}_dc),
{name}_m AS (SELECT {bc}count(*) AS n_domains,
                    avg(power(n - mu, 2)) AS m2, avg(power(n - mu, 3)) AS m3, avg(power(n - mu, 4)) AS m4,
                    CAST(max(n) AS DOUBLE) AS top1, sum(CAST(n AS DOUBLE) * n) AS n2,
                    count(*) FILTER (WHERE n = 1) AS domains_with_single_record,
                    count(*) FILTER (WHERE n < 10) AS domains_with_lt_10_records,
                    count(*) FILTER (WHERE n > 100) AS domains_with_gt_100_records
             FROM {name}_dc {join_mu} {g}),
{name}_k AS (SELECT {bc}sum(CAST(rk_asc AS DOUBLE) * n) AS rank_sum, sum(CAST(n AS DOUBLE)) AS s,
                    sum(CASE WHEN rk_desc <= greatest(1, nd // 20) THEN n ELSE 0 END) AS t5,
                    sum(CASE WHEN rk_desc <= greatest(1, nd // 10) THEN n ELSE 0 END) AS t10
             FROM {name}_r {g}),
{name} AS (SELECT {bc}n_domains, total_records, m3 / power(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis,
                  2 * rank_sum / (n_domains * s) - (n_domains + 1.0) / n_domains AS gini_coefficient,
                  top1 / total_records AS top_1_domain_share,
                  CAST(t5 AS DOUBLE) / total_records AS top_5pct_domains_share,
                  CAST(t10 AS DOUBLE) / total_records AS top_10pct_domains_share,
                  n2 / (CAST(total_records AS DOUBLE) * total_records) AS herfindahl_hirschman_index,
                  CASE WHEN n2 > 0 THEN (CAST(total_records AS DOUBLE) * total_records) / n2
                       ELSE n_domains END AS effective_number_domains,
                  domains_with_single_record, domains_with_lt_10_records, domains_with_gt_100_records
           FROM {name}_m {('JOIN ' + name + '_k USING (' + b + ')') if by else ', ' + name + '_k'} {join_tot})"""


def per_domain_ctes(src: str, domain: str, y: str, by: list[str], name: str = "pd") -> str:
    """CTEs: ``name`` = A12 rows, ``name``_sum = A13 per ``by`` group."""
    b = _kk(by)
    bc = (b + ", ") if by else ""
    g = f"GROUP BY {b}" if by else ""
    return f"""
{name}_cells AS (SELECT {bc}{domain} AS domain, {y} AS y, count(*) AS n FROM {src}
                 WHERE {domain} IS NOT NULL AND {y} IS NOT NULL GROUP BY {bc}{domain}, {y}),
{name} AS (SELECT {bc}domain, CAST(sum(n) AS BIGINT) AS total_records, count(*) AS n_categories,
                  arg_min(y, (-n, y)) AS dominant_category,
                  CAST(max(n) AS DOUBLE) / sum(n) AS dominant_category_share,
                  greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0) AS entropy,
                  count(*) = 1 AS is_single_category
           FROM {name}_cells GROUP BY {bc}domain),
{name}_sum AS (SELECT {bc}avg(entropy) AS avg_entropy_per_domain, stddev_pop(entropy) AS std_entropy_per_domain,
                      avg(dominant_category_share) AS avg_dominant_category_share,
                      stddev_pop(dominant_category_share) AS std_dominant_category_share,
                      count(*) FILTER (WHERE is_single_category) AS single_category_domains,
                      avg(CASE WHEN is_single_category THEN 1.0 ELSE 0.0 END) AS single_category_domains_share,
                      CAST(sum(CASE WHEN is_single_category THEN total_records ELSE 0 END) AS BIGINT)
                        AS records_in_single_category_domains,
                      CAST(sum(CASE WHEN is_single_category THEN total_records ELSE 0 END) AS DOUBLE)
                        / sum(total_records) AS records_in_single_category_domains_share
               FROM {name} {g})"""


def catsum_ctes(src: str, y: str, by: list[str], name: str = "cs") -> str:
    b = _kk(by)
    bc = (b + ", ") if by else ""
    g = f"GROUP BY {b}" if by else ""
    return f"""
{name}_c AS (SELECT {bc}{y} AS y, count(*) AS n FROM {src} WHERE {y} IS NOT NULL GROUP BY {bc}{y}),
{name} AS (SELECT {bc}count(*) AS n_categories, CAST(sum(n) AS BIGINT) AS n_records,
                  arg_min(y, (-n, y)) AS most_common, arg_max(y, (-n, y)) AS least_common,
                  CAST(min(n) AS DOUBLE) / max(n) AS balance_ratio,
                  greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0) AS entropy,
                  1 - sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n)) AS gini_impurity
           FROM {name}_c {g})"""


def domdist_ctes(src: str, domain: str, by: list[str], name: str = "dd") -> str:
    b = _kk(by)
    bc = (b + ", ") if by else ""
    g = f"GROUP BY {b}" if by else ""
    return f"""
{name}_c AS (SELECT {bc}{domain}, count(*) AS n FROM {src} WHERE {domain} IS NOT NULL GROUP BY {bc}{domain}),
{name} AS (SELECT {bc}count(*) AS n_domains, avg(n) AS mean, quantile_cont(n, 0.5) AS median,
                  stddev_samp(n) AS std, min(n) AS min, max(n) AS max,
                  quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.75) AS q75 FROM {name}_c {g})"""


TOKEN_SQL = "[\\pL\\pN_]{2,}"


def tf_cte(src: str, doc_id: str, text: str, name: str) -> str:
    return (f"{name} AS (SELECT {doc_id} AS doc_id, term, count(*) AS tf FROM "
            f"(SELECT {doc_id}, unnest(regexp_extract_all(lower({text}), '{TOKEN_SQL}')) AS term FROM {src}) "
            f"GROUP BY ALL)")


def nb_ctes(train: str, test: str, p: str = "nb") -> str:
    """train(doc_id, text, label), test(doc_id, text) -> {p}_tlp, {p}_cls, {p}_pred(doc_id, prediction)."""
    return ",\n".join([
        tf_cte(train, "doc_id", "text", f"{p}_tftr"),
        f"{p}_ct AS (SELECT label, term, sum(tf) AS count FROM {p}_tftr JOIN {train} USING (doc_id) GROUP BY ALL)",
        f"{p}_v AS (SELECT count(DISTINCT term) AS vs FROM {p}_tftr)",
        f"{p}_dp AS (SELECT label, count(*) AS n_docs FROM {train} GROUP BY 1)",
        f"{p}_tot AS (SELECT label, sum(count) AS total FROM {p}_ct GROUP BY 1)",
        f"{p}_cls AS (SELECT label, n_docs, ln(CAST(n_docs AS DOUBLE) / (SELECT sum(n_docs) FROM {p}_dp)) AS log_prior, "
        f"CAST(coalesce(total, 0) AS BIGINT) AS total, vs AS vocab_size, coalesce(total, 0) + 1.0 * vs AS den "
        f"FROM {p}_dp LEFT JOIN {p}_tot USING (label), {p}_v)",
        f"{p}_tlp AS (SELECT label, term, CAST(count AS BIGINT) AS count, ln((count + 1.0) / den) AS log_prob "
        f"FROM {p}_ct JOIN {p}_cls USING (label))",
        tf_cte(test, "doc_id", "text", f"{p}_tfte"),
        f"{p}_tfv AS (SELECT * FROM {p}_tfte WHERE term IN (SELECT term FROM {p}_tlp))",
        f"{p}_pairs AS (SELECT d.doc_id, c.label, c.log_prior, c.den FROM (SELECT DISTINCT doc_id FROM {test}) d, {p}_cls c)",
        f"{p}_contrib AS (SELECT pr.doc_id, pr.label, sum(t.tf * coalesce(tl.log_prob, ln(1.0 / pr.den))) AS s "
        f"FROM {p}_pairs pr JOIN {p}_tfv t ON t.doc_id = pr.doc_id "
        f"LEFT JOIN {p}_tlp tl ON tl.label = pr.label AND tl.term = t.term GROUP BY 1, 2)",
        f"{p}_score AS (SELECT pr.doc_id, pr.label, pr.log_prior + coalesce(c.s, 0) AS score "
        f"FROM {p}_pairs pr LEFT JOIN {p}_contrib c USING (doc_id, label))",
        f"{p}_pred AS (SELECT doc_id, arg_min(label, (-score, label)) AS prediction FROM {p}_score GROUP BY 1)",
    ])


def tfidf_nb_ctes(train: str, test: str, max_features: int, p: str = "tn") -> str:
    """train(doc_id, text, label), test(doc_id, text) -> {p}_pred(doc_id, prediction): naive Bayes
    on L2-normalised TF-IDF weights of the most frequent training terms; doc_id is unique."""
    return ",\n".join([
        tf_cte(train, "doc_id", "text", f"{p}_tr"),
        f"{p}_n AS (SELECT count(*) AS n FROM {train})",
        f"{p}_vocab AS (SELECT term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM {p}_tr, {p}_n "
        f"GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {max_features})",
        f"{p}_w AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w "
        f"FROM {p}_tr JOIN {p}_vocab USING (term))",
        f"{p}_dp AS (SELECT label, count(*) AS n_docs FROM {train} GROUP BY 1)",
        f"{p}_fc AS (SELECT label, term, sum(w) AS fc FROM {p}_w JOIN {train} USING (doc_id) GROUP BY ALL)",
        f"{p}_den AS (SELECT label, coalesce(sum(fc), 0) + (SELECT count(*) FROM {p}_vocab) AS den "
        f"FROM {p}_dp LEFT JOIN {p}_fc USING (label) GROUP BY 1)",
        f"{p}_lp AS (SELECT d.label, v.term, ln((coalesce(fc, 0) + 1.0) / den) AS lp FROM {p}_den d CROSS JOIN {p}_vocab v "
        f"LEFT JOIN {p}_fc f ON f.label = d.label AND f.term = v.term)",
        tf_cte(test, "doc_id", "text", f"{p}_te"),
        f"{p}_tw AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w "
        f"FROM {p}_te JOIN {p}_vocab USING (term))",
        f"{p}_s AS (SELECT doc_id, label, sum(w * lp) AS s FROM {p}_tw JOIN {p}_lp USING (term) GROUP BY ALL)",
        f"{p}_score AS (SELECT t.doc_id, d.label, ln(CAST(n_docs AS DOUBLE) / (SELECT n FROM {p}_n)) + coalesce(s, 0) AS score "
        f"FROM {test} t CROSS JOIN {p}_dp d LEFT JOIN {p}_s s ON s.doc_id = t.doc_id AND s.label = d.label)",
        f"{p}_pred AS (SELECT doc_id, arg_min(label, (-score, label)) AS prediction FROM {p}_score GROUP BY 1)",
    ])
