"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path follows
up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and path, and is judged by
the trees like any other. A rule is a host and the path that it begins with; it holds for the host and its subdomains, and the
longest rule that fits wins. Names count as they are written; there is no percent decoding.

The trees are fitted on labelled URLs: a table of ``url`` and ``label`` (1 blocks). Where the caller has none, URLs
whose host holds one of a few telling names (``SEEDS``) are labelled 1 and all others 0, on a sample of about
``BOUND`` rows taken by the hash of the URL, each URL once. The names themselves are not features, so unlisted hosts
built alike are blocked too. With labels of one class only, everything gets that class (allow without any).
Repeated rows each get their own verdict. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.sources.tables import materialize

#: Verdict, host and path of the rules of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Parts of host names that label a URL as one to block.
SEEDS = ("ads", "adult", "bets", "casino", "cheap", "pills", "porn", "spam", "track", "xxx")
#: Labelled URLs that a fit reads, about.
BOUND = 20_000
#: Parts of the labelled URLs, by host, that learn from the suffix counts of the others.
FOLDS = 4
FEATURES = (
    "length host_length path_length depth labels digits host_digits entropy host_entropy hyphens host_hyphens "
    "parameters longest_label upper marks secure port suffix_share suffix_count name_share name_count"
).split()


def host_of(url: str) -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    out = None
    for verdict, name, begin in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        value = F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str]:
    parts = host.split(".")
    return parts[-1], ".".join(parts[-2:])


def features(url: str, host: str, path: str, known: dict[str, tuple[int, int]]) -> list[float]:
    """The values of ``FEATURES``; ``known`` has the labelled URLs and those to block of each suffix."""
    n = max(len(url), 1)
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".") if host else []
    out = [
        len(url), len(host), len(path), path.count("/"), len(labels), sum(map(str.isdigit, url)) / n,
        sum(map(str.isdigit, host)) / max(len(host), 1), _entropy(url), _entropy(host), url.count("-"), host.count("-"),
        query.count("&") + 1 if query else 0, max(map(len, labels), default=0), sum(map(str.isupper, url)) / n,
        sum(not c.isalnum() for c in url) / n, float(url.startswith("https:")), float(":" in host),
    ]
    for suffix in _suffixes(host):
        seen, bad = known.get(suffix, (0, 0))
        out += [(bad + 0.5) / (seen + 1), math.log1p(seen)]
    return [float(x) for x in out]


def _described(rows: DataFrame, known: dict[int, dict[str, tuple[int, int]]]) -> DataFrame:
    """Adds ``x``, the features, to rows of id, url, host and path; with a ``fold`` its own suffix counts are used."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, host, path = (batch.column(c).to_pylist() for c in ("url", "host", "path"))
            fold = batch.column("fold").to_pylist() if "fold" in names else [-1] * len(url)
            x = [features(u, h, p, shared.value[f]) for u, h, p, f in zip(url, host, path, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    return rows.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, x array<double>")


def label_by_names(urls: DataFrame, url_col: str = "url", bound: int = BOUND) -> DataFrame:
    """About ``bound`` of the URLs, taken by hash, labelled by the telling names in their hosts."""
    hosts = urls.select(F.col(url_col).cast("string").alias("url")).filter("url IS NOT NULL")
    # The share of distinct URLs, so that one URL on very many rows cannot crowd out the others.
    share = min(1.0, bound / max(1, hosts.agg(F.approx_count_distinct(F.xxhash64("url"), 0.02)).first()[0]))
    # Rows of one URL fall into the sample together; once is enough, and keeps the sample bounded.
    chosen = hosts.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    pattern = rf"(^|[.-])({'|'.join(map(re.escape, SEEDS))})([.-]|$)"
    return chosen.withColumn("label", host_of("url").rlike(pattern).cast("int"))


def _bounded(labelled: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` of the caller's distinct labelled URLs, taken by hash."""
    rows = labelled.select("url", "label").filter("label IS NOT NULL")
    share = min(1.0, bound / max(1, rows.agg(F.approx_count_distinct(F.xxhash64("url"), 0.02)).first()[0]))
    return rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share * (1 << 20)).distinct()


def _folds(train: DataFrame, ends: Column) -> dict[int, dict[str, tuple[int, int]]]:
    """Per fold of the labelled URLs the counts of every suffix in the other folds; -1 has those of all."""
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    counted = train.select("label", fold.alias("fold"), F.explode(ends).alias("suffix")).groupBy("fold", "suffix")
    # No more suffixes than twice the labelled URLs, whose number is bounded.
    rows = counted.agg(F.count("*").alias("seen"), F.sum("label").alias("bad")).collect()
    out: dict[int, dict[str, tuple[int, int]]] = {f: {} for f in range(-1, FOLDS)}
    for r in rows:
        for f in out:
            if f != r["fold"]:
                seen, bad = out[f].get(r["suffix"], (0, 0))
                out[f][r["suffix"]] = (seen + r["seen"], bad + int(r["bad"]))
    return out


def judge(
    urls: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None,
    bound: int = BOUND,
) -> DataFrame:
    """One row per row of ``urls``: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    known_urls = label_by_names(urls, url_col, bound) if labelled is None else _bounded(labelled, bound)
    train = materialize(
        known_urls.select(
            F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
            host_of("url").alias("host"),
            path_of("url").alias("path"),
            F.col("label").cast("double").alias("label"),
        ).filter("label IS NOT NULL"),
        "urls",
    )
    parts = F.split("host", r"\.")
    ends = F.array_distinct(F.array(F.element_at(parts, -1), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")))
    folds = _folds(train, ends)
    known = {-1: folds[-1]}
    classes = [r["label"] for r in train.select("label").distinct().collect()]
    rows = urls.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        host_of(url_col).alias("host"),
        path_of(url_col).alias("path"),
    )
    if len(classes) < 2:
        score = rows.withColumn("score", F.lit(float(classes[0]) if classes else 0.0))
    else:
        trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=12, maxDepth=3, maxBins=64, stepSize=0.3, seed=7)
        # A URL's own label must not be in the suffix shares that it teaches with.
        dealt = train.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
        sample = materialize(_described(dealt, folds).select("label", "x"), "features").coalesce(2)
        model = trees.fit(sample.select("label", array_to_vector("x").alias("v")))
        described = _described(rows, known).withColumn("v", array_to_vector("x"))

        score = model.transform(described).withColumn("score", vector_to_array("probability")[1])
    found = rule_of(F.col("host"), F.col("path"), rules)
    judged = score.withColumn("found", found)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("found").isNull(), F.col("score")).alias("score"),
    )
