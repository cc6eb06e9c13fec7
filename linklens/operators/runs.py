"""Evaluation runs: measured scoring, the four stamped metric tables
and the run table of many fitted models (M15, input of W*, E14, E15, R*)."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.functions import urls as U
from linklens.operators import metrics as M
from linklens.operators.slugs import mapped_category
from linklens.operators.textfeatures import HOT_SHARE, TOKEN_PATTERN, salted_terms
from linklens.session import bounded_broadcast, broadcast_if_small, materialize, table_path


def timed(pred: DataFrame) -> tuple[DataFrame, int, float]:
    """E5: the predictions written once, their number and the seconds that took. The rows are
    counted from the footers of the files. (An Observation on the session would keep the
    summaries of Spark ML models, which hold the session, from being serialized.)"""
    start = time.perf_counter()
    out = materialize(pred)
    seconds = time.perf_counter() - start
    return out, out.count(), seconds


def run_tables(pred: DataFrame, run_id: str, dataset: str, model: str, feature: str, rows: int | None = None,
               seconds: float | None = None, domain: str = "publisher") -> dict[str, DataFrame]:
    """Macro, topic, domain and domain_topic metrics of one run, each stamped with run_id,
    dataset, model and feature. Throughput (rows / second) is null where it was not measured.
    The domain tables are left out of a run without a domain column."""
    stamp = {"run_id": run_id, "dataset": dataset, "model": model, "feature": feature}
    conf = M.confusion(pred)
    speed = F.lit(rows / seconds if rows is not None and seconds else None).cast("double")
    out = {"macro": M.macro_metrics(conf).crossJoin(M.micro_metrics(conf)).withColumn("throughput", speed),
           "topic": M.per_topic_metrics(conf).withColumnRenamed("label", "topic")}
    if domain in pred.columns:
        out["domain"] = M.per_domain_metrics(pred, domain)
        out["domain_topic"] = M.per_domain_topic_metrics(pred, domain)
    return {name: M.stamp(df, **stamp) for name, df in out.items()}


# ---- one stacked evaluation of many fitted models (M15, W*, E14, R*) ----------

FEATURES = ["title", "url_raw", "url_path_raw"]
CONDITIONS = ["with_dates", "no_dates"]
ALPHAS = {"naive-bayes": 1.0, "naive-bayes-0.1": 0.1}
MODELS = [*ALPHAS, "mapping", "two-stage", "majority"]
RUN = ["dataset", "feature", "condition"]
RUNS = [(f, c) for f in FEATURES for c in CONDITIONS]      # of a dataset; a set of them is a number, bit by bit
ALL_RUNS = (1 << len(RUNS)) - 1

# Scheme and host of a lower-cased URL: what stands before its path.
_BEFORE_PATH = r"^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?#]*)?"


def _bits(feature: str, *conditions: str) -> int:
    return sum(1 << RUNS.index((feature, c)) for c in conditions or CONDITIONS)


_TEXTS = {"title": "title", "url_raw": "url", "url_path_raw": "_path"}


def _with_words(articles: DataFrame) -> DataFrame:
    """(_row, dataset, label, title, url, _path, words): ``words`` are (runs, text) of the
    lower-cased parts that hold the terms of an article's texts, each part once with the set of
    its runs. The path is a part of the URL; a text without a date has the terms of both
    conditions, as strip_dates drops '/' and '-' of it only, which are in no term.
    Rows are picked before: no filter passes below ``_row``."""
    rows = articles.select(F.monotonically_increasing_id().alias("_row"), F.col("language").alias("dataset"),
                           F.col("category").alias("label"), "title", "url", U.url_path("url").alias("_path"),
                           F.lower("title").alias("_l_title"), F.lower("url").alias("_l_url"),
                           U.maybe_date("title").alias("_dated_title"), U.maybe_date("url").alias("_dated_url"))
    rows = rows.select("*", F.lower("_path").alias("_l_path"), F.regexp_extract("_l_url", _BEFORE_PATH, 0).alias("_before"))
    start, size = F.length("_before") + 1, F.length("_l_path")
    rows = rows.withColumn("_after", F.substr("_l_url", start + size, F.lit(2**31 - 1)))
    rows = rows.withColumn("_part", F.coalesce(
        (F.substr("_l_url", start, size) == F.col("_l_path"))
        & F.substr("_after", F.lit(1), F.lit(1)).isin("", ";", "?", "#"), F.lit(False)))
    # a date that ends at the path's first '/' or starts there would need a digit before it, and what
    # strip_dates leaves of the path is a part of what it leaves of the URL
    rows = rows.withColumn("_s_path", F.when(F.col("_dated_url"), F.lower(U.strip_dates("_path"))))
    rows = rows.withColumn("_apart", F.col("_dated_url") & F.col("_part") & F.substr("_before", F.lit(-1)).between("a", "z")
                           & F.substr("_s_path", F.lit(1), F.lit(1)).isin("", "/") & F.substr("_l_path", F.lit(1), F.lit(1)).isin("", "/")
                           & ~U.maybe_date("_before") & ~U.maybe_date("_after"))
    title, url, part, apart = F.col("_dated_title"), F.col("_dated_url"), F.col("_part"), F.col("_apart")

    def group(runs: Column, text: Column) -> Column:
        return F.struct(runs.cast("int").alias("runs"), text.alias("text"))

    def of(dated: Column, *features: str) -> Column:
        return F.when(dated, F.lit(sum(_bits(f, "with_dates") for f in features))).otherwise(F.lit(sum(map(_bits, features))))

    path_only = F.lit(_bits("url_path_raw", "no_dates"))
    words = F.array(
        group(of(title, "title"), F.col("_l_title")),
        group(F.lit(_bits("title", "no_dates")), F.when(title, F.lower(U.strip_dates("title")))),
        group(of(url & ~apart, "url_raw"), F.when(part, F.concat("_before", F.lit(" "), "_after")).otherwise(F.col("_l_url"))),
        group(F.when(part, of(url, "url_raw", "url_path_raw")).otherwise(of(url, "url_path_raw")), F.col("_l_path")),
        group(F.when(apart, path_only + _bits("url_raw", "no_dates")).otherwise(path_only), F.col("_s_path")),
        group(F.lit(_bits("url_raw", "no_dates")), F.when(url & ~apart, F.lower(U.strip_dates("url")))))
    return rows.select("_row", "dataset", "label", "title", "url", "_path", words.alias("words"))


def stacked_texts(articles: DataFrame) -> DataFrame:
    """(_row, dataset, label, runs, text, words): every article's title, URL and path, with and
    without dates, once for each different text with the set of its runs; ``words`` with an
    article's first row."""
    rows = _with_words(articles).select("*", *[U.strip_dates(c).alias(f"_s_{f}") for f, c in _TEXTS.items()])
    kind, stack = "array<struct<runs:int,text:string>>", []
    for f, c in _TEXTS.items():
        same = F.col(c).eqNullSafe(F.col(f"_s_{f}"))
        own = F.lit(None) if stack else F.col("words")
        stack += [F.struct(F.when(same, F.lit(_bits(f))).otherwise(F.lit(_bits(f, "with_dates"))).alias("runs"),
                           F.col(c).alias("text"), own.cast(kind).alias("words")),
                  F.struct(F.when(~same, F.lit(_bits(f, "no_dates"))).alias("runs"), F.col(f"_s_{f}").alias("text"),
                           F.lit(None).cast(kind).alias("words"))]
    return (rows.select("_row", "dataset", "label", F.explode(F.array(*stack)).alias("s"))
            .select("_row", "dataset", "label", "s.*").where("runs IS NOT NULL"))


def labelled(articles: DataFrame, split: str) -> DataFrame:
    return articles.where((F.col("split") == split) & F.col("category").isNotNull())


def _terms(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep.., runs, term) of every occurrence of a term in ``words``, and each row's own runs with
    a null term; ``keep`` but the first two goes with the latter only."""
    none = F.array(F.struct(F.lit(None).cast("int").alias("runs"), F.lit(None).cast("string").alias("text")))
    parts = rows.select(*keep, F.col("runs").alias("_own"), F.explode(F.when(F.col("words").isNull(), none).otherwise(
        F.concat(none, F.filter("words", lambda w: w["text"].isNotNull())))).alias("_w"))
    found = F.when(F.col("_w.runs").isNull(), F.array(F.lit(None).cast("string"))).otherwise(
        F.regexp_extract_all("_w.text", F.lit(TOKEN_PATTERN), 0))
    own = F.col("_w.runs").isNull()
    return parts.select(*keep[:2], *[F.when(own, F.col(c)).alias(c) for c in keep[2:]],
                        F.coalesce("_w.runs", "_own").alias("runs"), F.explode(found).alias("term"))


@dataclass
class RunModels:
    """The fitted runs: sorted labels; per dataset (prior, total, vocabulary, majority), each by
    run and the first two by label; ``terms`` (dataset, term, counts, hot): how often each label
    had the term in which runs, and whether it is hot, at most 1 / HOT_SHARE of a dataset's."""
    labels: list
    datasets: dict
    terms: DataFrame
    path: str               # of the terms


def _count_code(label: Column, runs: Column, n: Column) -> Column:
    return F.shiftleft(label.cast("long") * (ALL_RUNS + 1) + runs, 40) + n


def run_models(train: DataFrame) -> RunModels:
    """The runs' models of the articles ``train``, from one pass over them."""
    words = F.concat(F.array(F.struct(F.lit(0).alias("runs"), F.lit(None).cast("string").alias("text"))),
                     F.filter("words", lambda w: w["text"].isNotNull()))
    rows = _with_words(train).select("dataset", "label", F.explode(words).alias("w")).select("dataset", "label", "w.*")
    # an article counts once, by a null term of no run
    found = F.when(F.col("text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(
        F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0))
    counts = materialize(rows.select("dataset", "label", "runs", F.explode(found).alias("term"))
                         .groupBy("dataset", "label", "runs", "term").agg(F.count(F.lit(1)).alias("n")))
    # a row per dataset, label and set of runs
    sums = [r for r in counts.groupBy("dataset", "label", "runs").agg(F.sum("n").alias("n")).collect()
            if r["dataset"] is not None]
    labels = sorted({r["label"] for r in sums})
    place = {c: i for i, c in enumerate(labels)}
    each = counts.sparkSession.createDataFrame([(c, i) for c, i in place.items()], "label string, _label int")
    whole = {d: sum(r["n"] for r in sums if r["dataset"] == d and r["runs"]) for d in {r["dataset"] for r in sums}}
    size = counts.sparkSession.createDataFrame(list(whole.items()), "dataset string, _whole long")
    terms = materialize(
        counts.where("term IS NOT NULL").join(bounded_broadcast(each), "label")
        .groupBy("dataset", "term").agg(
            F.collect_list(_count_code(F.col("_label"), F.col("runs"), F.col("n"))).alias("counts"),
            F.bit_or("runs").alias("runs"), F.sum("n").alias("_n"))
        .join(bounded_broadcast(size), "dataset")       # one row per dataset
        .select("dataset", "term", "counts", "runs", (F.col("_n") > HOT_SHARE * F.col("_whole")).alias("hot")))
    sizes = terms.groupBy("dataset", "runs").agg(F.count(F.lit(1)).alias("v")).collect()
    datasets = {}
    for d in whole:
        docs, total, v = np.zeros(len(labels)), np.zeros((len(RUNS), len(labels))), np.zeros(len(RUNS))
        for r in sums:
            if r["dataset"] == d and not r["runs"]:
                docs[place[r["label"]]] = r["n"]
        for k in range(len(RUNS)):
            for r in sums:
                if r["dataset"] == d and r["runs"] >> k & 1:
                    total[k, place[r["label"]]] += r["n"]
            v[k] = sum(r["v"] for r in sizes if r["dataset"] == d and r["runs"] >> k & 1)
        prior = np.where(docs > 0, np.log(np.maximum(docs, 1) / docs.sum()), -np.inf)
        datasets[d] = prior, total, v, int(docs.argmax())
    return RunModels(labels, datasets, terms.select("dataset", "term", "counts", "hot"), table_path(terms))


def _scores(rows: pa.RecordBatch, alphas: list[float], labels: list, datasets: dict) -> pa.RecordBatch:
    """(dataset, run, label, mapped, p0, p1, .., majority) of the whole articles in ``rows``
    (_row, dataset, label, mapped, runs, own, counts)."""
    row = rows.column(0).to_numpy()
    runs, own = rows.column(4).to_numpy(), rows.column(5).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    article = np.cumsum(np.append(False, row[1:] != row[:-1]).astype(np.int64))
    n, size = len(first), len(labels)
    name = rows.column(1).take(pa.array(first)).to_pylist()
    which = {d: i for i, d in enumerate(datasets)}
    of = np.array([which.get(d, -1) for d in name], dtype=np.int64)
    known = of >= 0
    at = np.flatnonzero(own)
    label = np.zeros(n, dtype=np.int64)
    label[article[at]] = at
    counts = rows.column(6)
    times = np.diff(counts.offsets.to_numpy()) * counts.is_valid().to_numpy(zero_copy_only=False)
    code = pc.list_flatten(counts).to_numpy()
    word = np.repeat(np.arange(len(row)), times)
    of_label, of_runs = code >> 40 >> len(RUNS), code >> 40 & ALL_RUNS
    count = (code & (1 << 40) - 1).astype(float)
    mapped, best = np.zeros((n, len(RUNS)), dtype=np.int64), np.full((len(alphas), n, len(RUNS)), -1, dtype=np.int64)
    for k in range(len(RUNS)):
        mine = at[runs[at] >> k & 1 == 1]
        mapped[article[mine], k] = mine
        if not size or not datasets:
            continue
        met = (runs[word] >> k & 1 == 1) & (of_runs >> k & 1 == 1)
        words, back = np.unique(word[met], return_inverse=True)     # those in the run's vocabulary
        seen = np.bincount(back * size + of_label[met], weights=count[met], minlength=len(words) * size).reshape(-1, size)
        models = list(datasets.values())
        prior = np.array([m[0] for m in models])[of]
        total, v = (np.array([m[i][k] for m in models]) for i in (1, 2))
        cut = np.searchsorted(article[words], np.arange(n))
        some = np.flatnonzero(np.diff(np.append(cut, len(words))))
        for i, a in enumerate(alphas):
            score = prior.copy()
            if len(words):
                score[some] += np.add.reduceat(np.log((seen + a) / (total + a * v[:, None])[of[article[words]]]), cut[some], axis=0)
            best[i, :, k] = np.where(known, score.argmax(axis=1), -1)
    names = pa.array(labels, pa.string())

    def named(places: np.ndarray) -> pa.Array:
        return names.take(pa.array(places.ravel(), mask=places.ravel() < 0))

    most = np.array([m[3] for m in datasets.values()] + [-1])[of]
    every = np.repeat(np.arange(n), len(RUNS))
    return pa.RecordBatch.from_arrays(
        [rows.column(1).take(pa.array(first[every])), pa.array(np.tile(np.arange(len(RUNS), dtype=np.int32), n)),
         rows.column(2).take(pa.array(label[every])), rows.column(3).take(pa.array(mapped.ravel())),
         *[named(b) for b in best], named(most[every])],
        names=["dataset", "run", "label", "mapped", *[f"p{i}" for i in range(len(alphas))], "majority"])


def _bayes(test: DataFrame, models: RunModels) -> DataFrame:
    """(run.., label, mapped, majority) of stacked texts with ``mapped``, a row for each article and
    run, with a prediction p0, p1, .. per smoothing; a label that the dataset never had has no
    prior and is not predicted, and a dataset without a model has no prediction."""
    words = _terms(test, "_row", "dataset", "label", "mapped")
    near, on = broadcast_if_small(models.terms), ["dataset", "term"]
    met = salted_terms(words, models.terms, on) if near is models.terms else words.join(near, on, "left")
    rows = (met.select("_row", "dataset", "label", "mapped", "runs", F.col("term").isNull().alias("own"), "counts")
            .repartition("_row").sortWithinPartitions("_row"))
    labels, datasets, alphas = models.labels, models.datasets, list(ALPHAS.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            row = b.column(0)
            last = int(np.searchsorted(row.to_numpy(), row[-1].as_py()))
            if last:                             # an article may go on in the next batch
                kept.append(b.slice(0, last))
                now = whole()
                yield _scores(now, alphas, labels, datasets)
                kept = [b.slice(last)]
            elif kept and kept[-1].column(0)[-1].as_py() != row[0].as_py():
                yield _scores(whole(), alphas, labels, datasets)
                kept = [b]
            else:
                kept.append(b)
        if kept:
            yield _scores(whole(), alphas, labels, datasets)

    found = rows.mapInArrow(run, "dataset string, run int, label string, mapped string, "
                            + "".join(f"p{i} string, " for i in range(len(alphas))) + "majority string")
    return found.select("dataset", *_run_names(F.col("run")), "label", "mapped", *[f"p{i}" for i in range(len(alphas))], "majority")


def _run_names(run: Column) -> list[Column]:
    return [F.get(F.array(*[F.lit(r[i]) for r in RUNS]), run).alias(c) for i, c in enumerate(RUN[1:])]


def run_confusion(articles: DataFrame, mapping: DataFrame, models: RunModels | None = None) -> DataFrame:
    """(dataset, feature, condition, model, label, prediction, n) of every fitted model on the
    test rows. All runs are fitted and scored together, keyed by (dataset, feature,
    condition): naive Bayes with two smoothings, the mapping match (J7; null without one), the
    mapping with naive Bayes behind it, and the most frequent training label."""
    models = models or run_models(labelled(articles, "train"))
    test = mapped_category(stacked_texts(labelled(articles, "test")), mapping, "text", "mapped")
    scored = _bayes(test, models)
    found = {**{m: F.col(f"p{k}") for k, m in enumerate(ALPHAS)}, "mapping": F.col("mapped"),
             "two-stage": F.coalesce("mapped", "p0"), "majority": F.col("majority")}
    stack = F.array(*[F.struct(F.lit(m).alias("model"), found[m].alias("prediction")) for m in MODELS])
    return materialize(M.confusion(scored.select(*RUN, "label", F.explode(stack).alias("s"))
                                   .select(*RUN, "s.model", "label", "s.prediction"), [*RUN, "model"]))


def evaluation_runs(conf: DataFrame) -> DataFrame:
    """Macro metrics of every (dataset, model, feature, condition) run, over the rows that got
    a prediction (F9), and the share that did. Metrics are fixed at 9 decimals, so that runs
    of equal quality tie and top-k falls to the key order."""
    keys = ["dataset", "model", "feature", "condition"]
    mac = M.macro_metrics(conf.where("prediction IS NOT NULL"), keys)
    ok = conf.groupBy(*keys).agg((F.sum(F.when(F.col("prediction").isNotNull(), F.col("n")).otherwise(0))
                                  / F.sum("n")).alias("success_rate"))
    return mac.join(ok, keys).select(*keys, *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                                     "n_samples", "success_rate")


def evaluation_topic_runs(conf: DataFrame) -> DataFrame:
    """Per-topic metrics of every (model, feature, condition) over all datasets."""
    keys = ["model", "feature", "condition"]
    cells = conf.where("prediction IS NOT NULL").groupBy(*keys, "label", "prediction").agg(F.sum("n").alias("n"))
    return M.per_topic_metrics(cells, keys).select(*keys, F.col("label").alias("topic"), F.round("f1", 9).alias("f1"),
                                                   "support")


def measured_throughput(articles: DataFrame, mapping: DataFrame, models: RunModels | None = None) -> DataFrame:
    """E5: (dataset, model, rows, seconds, throughput) of scoring each dataset's test rows, by
    the clock; two-stage scoring takes both of its parts' time."""
    models = models or run_models(labelled(articles, "train"))
    test = materialize(stacked_texts(labelled(articles, "test")))
    most = articles.sparkSession.createDataFrame([(d, models.labels[m[3]]) for d, m in models.datasets.items()],
                                                 "dataset string, majority string")
    out = []
    for dataset in sorted(models.datasets):
        mine = test.where(F.col("dataset") == dataset)
        _, n, bayes = timed(_bayes(mine.withColumn("mapped", F.lit(None).cast("string")), models).select("p0", "p1"))
        _, _, mapped = timed(mapped_category(mine.drop("words"), mapping, "text", "m").select("m"))
        each = F.explode(F.expr(f"filter(sequence(0, {len(RUNS) - 1}), k -> shiftright(runs, k) % 2 = 1)"))
        _, _, common = timed(mine.select("dataset", each).join(bounded_broadcast(most), "dataset").select("majority"))
        spent = {**dict.fromkeys(ALPHAS, bayes), "mapping": mapped, "two-stage": bayes + mapped, "majority": common}
        out += [(dataset, m, n, float(spent[m])) for m in MODELS]
    done = articles.sparkSession.createDataFrame(out, "dataset string, model string, rows long, seconds double")
    return done.withColumn("throughput", F.col("rows") / F.col("seconds"))
