"""The queries of this subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from retentia.llm import (
    bpe,
    clustering,
    decontaminate,
    exact_dedup,
    html_text,
    licenses,
    merkle,
    mixing,
    quality,
    secrets,
    simhash,
    urls,
    warc,
)
from retentia.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(table(spark, sf_dir, "documents"), words=4, bits=4, seed=42)
    return found.select("doc_id", "fingerprint", "component_id")


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, salt="2:")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, limit=2)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_bpe_codec,
        op3_simhash_groups,
        op4_quality_scores,
        op5_url_verdicts,
        op6_main_text,
        op7_secret_spans,
        op8_warc_archive,
        op9_license_notices,
        op10_benchmark_leaks,
        op11_centroid_clusters,
        op12_merkle_manifest,
        op13_source_mix,
    )
}

_LETTERS = " || ".join(
    f"substr('{warc.LETTERS}', CAST((CAST('0x' || substr(h, {10 * k + 1}, 10) AS BIGINT) >> {5 * i}) & 31 AS INT) + 1, 1)"
    for k in range(4)
    for i in range(7, -1, -1)
)

_CLUSTER_ROUNDS, _CLUSTERS = 5, 40
_SQUARE = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"


def _cluster_sql() -> str:
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(n - 1 AS INTEGER) AS c, v FROM (SELECT v,
        row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST) AS n FROM kept) WHERE n <= {_CLUSTERS})""",
    ]
    for i in range(_CLUSTER_ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT k.r, c.c, CAST({_SQUARE} AS BIGINT) AS d FROM kept k, c{i} c)
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < _CLUSTER_ROUNDS:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM (
            SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
            FROM a{i} JOIN kept USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    last = _CLUSTER_ROUNDS
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{last} JOIN kept USING (r) JOIN c{last} c USING (c)"""


#: Levels of the unrolled trees in SQL: for up to 2^20 leaves per language and 2^12 languages.
_LEAF_LEVELS, _TOP_LEVELS = 20, 12


def _crc_sql() -> str:
    """crc32 of the decimal id, bit by bit."""
    step = "xor(a, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda t: xor(t >> 1, 3988292384 * (t & 1)))[1]"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({digits}, lambda a, b: {step}, 4294967295), 4294967295)"


def _merkle_sql() -> str:
    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"

    def leaf(n_chars: str) -> str:
        parts = [field("doc_id"), field("source"), field("lang"), n_chars, field("text")]
        return f"sha256({' || '.join(parts)})"

    changed = "coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-')"
    steps = [
        f"""leaves AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS g, {leaf(field("n_chars"))} AS leaf,
        CASE WHEN coalesce({_crc_sql()} % 7 = 0, false) THEN {leaf(changed)} END AS other FROM documents)""",
        """t0 AS MATERIALIZED (SELECT r, g, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
        leaf, coalesce(other, leaf) AS f, '' AS s FROM leaves)""",
    ]
    # Every row carries the node above it, its place, the folded digest and the siblings so far.
    for k in range(_LEAF_LEVELS + _TOP_LEVELS):
        if k == _LEAF_LEVELS:
            steps.append(
                f"""u AS MATERIALIZED (SELECT DISTINCT g, h FROM t{k}),
        t{k}u AS MATERIALIZED (SELECT r, '' AS g, t.h, q.p, leaf, f, s, t.h AS sub FROM t{k} t
            JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS p FROM u) q USING (g))"""
            )
        now, sub = (f"t{k}u", ", sub") if k == _LEAF_LEVELS else (f"t{k}", ", sub" if k > _LEAF_LEVELS else "")
        steps.append(
            f"""n{k} AS MATERIALIZED (SELECT DISTINCT g, p, h FROM {now}),
        t{k + 1} AS MATERIALIZED (SELECT r, t.g, CASE WHEN m.c = 1 THEN t.h ELSE sha256(coalesce(b.h, '') || t.h || coalesce(a.h, '')) END AS h,
            CASE WHEN m.c = 1 THEN t.p ELSE t.p // 2 END AS p, leaf,
            CASE WHEN m.c = 1 THEN f ELSE sha256(coalesce(b.h, '') || f || coalesce(a.h, '')) END AS f,
            s || coalesce(b.h, '') || coalesce(a.h, '') AS s{sub}
        FROM {now} t JOIN (SELECT g, count(*) AS c FROM n{k} GROUP BY g) m ON m.g = t.g
            LEFT JOIN n{k} b ON b.g = t.g AND t.p % 2 = 1 AND b.p = t.p - 1
            LEFT JOIN n{k} a ON a.g = t.g AND t.p % 2 = 0 AND a.p = t.p + 1)"""
        )
    end = _LEAF_LEVELS + _TOP_LEVELS
    return f"""WITH {", ".join(steps)}
    SELECT doc_id, l.leaf, sub AS subroot, h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = h AS verified
    FROM t{end} t JOIN leaves l USING (r)"""


ORACLES = {
    "op11_centroid_clusters": _cluster_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents
), g AS (
  SELECT doc_id, s, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size
  FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM g
""",
    "op8_warc_archive": f"""
WITH t AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first
  FROM t
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""",
}
