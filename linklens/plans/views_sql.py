"""SQL text of the test views, inlined as CTEs in oracle queries (the driver
registers only the base tables). Same semantics as linklens.sources.tables."""

ARTICLES = """
SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-',
              CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS article_id,
       concat(CASE WHEN l_orderkey % 97 = 0 THEN 'ftp' WHEN l_orderkey % 2 = 0 THEN 'https' ELSE 'http' END,
              '://www.', lower(replace(s_name, '#', '')), '.example.com',
         CASE l_orderkey % 8
           WHEN 0 THEN concat('/', CASE p_type WHEN 'PROMO' THEN 'business' WHEN 'LARGE' THEN 'sports'
                                   WHEN 'SMALL' THEN 'tech' WHEN 'ECONOMY' THEN 'politics' ELSE 'misc' END,
                              '/', replace(substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 10), '-', '/'),
                              '/', replace(lower(p_name), ' ', '-'), '-', CAST(l_partkey AS VARCHAR), '.html')
           WHEN 1 THEN concat('/news/', CAST(l_orderkey AS VARCHAR))
           WHEN 2 THEN concat('/article/', replace(lower(p_name), ' ', '-'))
           WHEN 3 THEN concat('/', CAST(1000000 + l_orderkey AS VARCHAR))
           WHEN 4 THEN concat('/', substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 4), '/', replace(lower(p_name), ' ', '_'))
           WHEN 5 THEN concat('/m/', substr(md5(CAST(l_partkey AS VARCHAR)), 1, 12), '/')
           WHEN 6 THEN concat('/tech/latest/', replace(lower(p_name), ' ', '-'), '?page=', CAST(l_linenumber AS VARCHAR))
           ELSE '/' END) AS url,
       p_name AS title, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE p_brand END AS subtitle,
       p_type AS category, s_name AS publisher,
       CASE l_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'pt' ELSE 'es' END AS language,
       (l_orderkey * 7 + l_partkey * 13 + l_linenumber) % 10 AS noise
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""

PREDICTIONS = """
SELECT article_id, publisher, category AS label,
       CASE WHEN noise < 7 THEN category WHEN noise = 7 THEN 'PROMO' WHEN noise = 8 THEN 'LARGE'
            ELSE 'UNSEEN' END AS prediction
FROM articles
"""

SLUG_MAP = """
SELECT * FROM (VALUES (0,'news',''),(1,'business','PROMO'),(2,'sports','LARGE'),(3,'tech','SMALL'),
  (4,'politics','ECONOMY'),(5,'latest','PROMO'),(6,'m','STANDARD'),(7,'Tech','MEDIUM')) AS t(slug_rank, slug, category)
"""

VIEWS = {"articles": ARTICLES, "predictions": PREDICTIONS, "slug_map": SLUG_MAP}
ORDER = ["articles", "predictions", "slug_map"]


def with_views(body: str, *extra: tuple[str, str], views=("articles",)) -> str:
    """Prefix ``body`` with CTEs for the named views (dependencies first) and
    any extra (name, sql) CTEs in the given order."""
    need = set(views)
    if "predictions" in need:
        need.add("articles")
    ctes = [f"{v} AS ({VIEWS[v]})" for v in ORDER if v in need]
    ctes += [f"{name} AS ({sql})" for name, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body
