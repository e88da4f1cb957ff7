"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from probelake.llm import bpe_chunks, decontaminate, divergence, filter_audit, licenses, packing, quality, secrets, simhash, token_counts, toxicity, transport_stream, url_filter
from probelake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file on this machine, as on every executor; TOKENIZER_DIR overrides the folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no path; source and language stand for directories."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return licenses.scan(docs)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels have two categories: poor (quality 0), then toxic, whose verdict is the result."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("poor"), "toxic")
    return toxicity.classify(table(spark, sf_dir, "documents"), labels, ["poor", "toxic"]).select("doc_id", "toxic", "p_toxic", "p_poor")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random-access points as text: packet:pid:pts, joined by commas."""
    point = lambda p: F.concat_ws(":", p.packet.cast("string"), p.pid.cast("string"), p.pts.cast("string"))
    read = transport_stream.read_media(transport_stream.write_media(table(spark, sf_dir, "documents")))
    return read.withColumn("entry_points", F.array_join(F.transform("entry_points", point), ","))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.query_rules(spark))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_transport_stream": op6_transport_stream,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_bpe_chunks": op13_bpe_chunks,
}

_NOTICES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES))
_LEAST = "[" + ", ".join(map(str, licenses.LEAST)) + "]"

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": f"""
        WITH t(k, name, text) AS (VALUES {_NOTICES}),
        tw AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM t) GROUP BY ALL),
        d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        total AS (SELECT count(*) AS docs FROM d),
        df AS (SELECT w, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM d) GROUP BY w),
        idf AS (SELECT w, ln(1 + (docs + 1) / (coalesce(c, 0) + 1)) AS v FROM (SELECT w FROM df UNION SELECT w FROM tw) LEFT JOIN df USING (w), total),
        norm AS (SELECT k, sqrt(sum(((1 + ln(n)) * v) ** 2)) AS norm FROM tw JOIN idf USING (w) GROUP BY k),
        weight AS (SELECT k, w, (1 + ln(n)) * v / norm AS x FROM tw JOIN idf USING (w) JOIN norm USING (k)),
        line AS (SELECT doc_id, unnest(lines) AS text, unnest(range(len(lines))) AS i FROM d),
        sort AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[A-Za-z0-9]') THEN 0 WHEN regexp_matches(text, '{licenses.COMMENT}') THEN 1 ELSE 2 END AS s FROM line),
        mark AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS m FROM sort),
        run AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM mark),
        unit AS (
          SELECT doc_id, 0 AS kind, s AS a, size AS b, array_to_string(lines[s:s + size - 1], ' ') AS text
          FROM (SELECT doc_id, lines, size, unnest(range(1, len(lines) - size + 2)) AS s FROM d, range(1, {licenses.WRAP + 1}) r(size))
          UNION ALL SELECT doc_id, 1, b, 0, string_agg(text, ' ' ORDER BY i) FROM run WHERE s > 0 GROUP BY doc_id, b HAVING count(*) > {licenses.WRAP}
          UNION ALL SELECT doc_id, 2, 0, 0, text FROM d),
        split AS (SELECT doc_id, kind, a, b, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM unit),
        near AS (SELECT * FROM split WHERE (kind > 0 OR len(ws) <= {licenses.MOST_WORDS}) AND list_has_any(ws, (SELECT list(DISTINCT w) FROM tw))),
        tf AS (SELECT doc_id, kind, a, b, w, count(*) AS n FROM (SELECT doc_id, kind, a, b, unnest(ws) AS w FROM near) GROUP BY ALL),
        sq AS (SELECT doc_id, kind, a, b, sum(((1 + ln(n)) * v) ** 2) AS q FROM tf JOIN idf USING (w) GROUP BY ALL),
        dot AS (SELECT doc_id, kind, a, b, k, sum((1 + ln(n)) * v * x) AS y FROM tf JOIN idf USING (w) JOIN weight USING (w) GROUP BY ALL),
        scored AS (SELECT doc_id, kind, a, b, k, round(y / sqrt(q), 6) AS score FROM dot JOIN sq USING (doc_id, kind, a, b)),
        best AS (SELECT doc_id, kind, max(score) AS score, arg_max(k, (score, -k)) AS k FROM scored GROUP BY doc_id, kind, a, b HAVING max(score) >= {_LEAST}[kind + 1]),
        named AS (SELECT best.*, name, round(score * norm, 6) AS evidence FROM best JOIN norm USING (k) JOIN t USING (k)),
        own AS (SELECT doc_id, arg_max(name, (evidence, -k, score)) AS license, arg_max(score, (evidence, -k, score)) AS score, max(name) FILTER (kind = 2) AS file,
                       string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind < 2) AS notices FROM named GROUP BY doc_id),
        dirs AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM d),
        held AS (SELECT dir AS directory, arg_min(file, (-n, file)) AS dir_license FROM (SELECT dir, file, count(*) AS n FROM own JOIN dirs USING (doc_id) WHERE file IS NOT NULL GROUP BY ALL) GROUP BY dir),
        up AS (SELECT DISTINCT dir, unnest(['', split_part(dir, '/', 1), dir]) AS directory FROM dirs),
        nearest AS (SELECT dir, arg_max(directory, length(directory)) AS directory, arg_max(dir_license, length(directory)) AS dir_license FROM up JOIN held USING (directory) GROUP BY dir)
        SELECT doc_id, path, coalesce(license, dir_license) AS license, score, CASE WHEN license IS NOT NULL THEN 'notice' WHEN dir_license IS NOT NULL THEN 'inherited' END AS origin,
               CASE WHEN license IS NULL THEN directory END AS directory, coalesce(notices, '') AS notices
        FROM dirs LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (dir)""",
    "op10_url_filter": r"""
        WITH u AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
          FROM pages),
        r(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        hit AS (
          SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
          FROM (SELECT DISTINCT host, path FROM u) d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
          GROUP BY host, path)
        SELECT page_id, u.host, u.path, rule, coalesce(action, 'allow') AS verdict
        FROM u LEFT JOIN hit ON u.host = hit.host AND u.path = hit.path""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        f AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
                 concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
                        CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                        CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
          FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id),
        n AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (SELECT concat(a.x, b.x, c.x, e.x, g.x) AS filter_order FROM l a, l b, l c, l e, l g
              WHERE a.x NOT IN (b.x, c.x, e.x, g.x) AND b.x NOT IN (c.x, e.x, g.x) AND c.x NOT IN (e.x, g.x) AND e.x <> g.x),
        s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
        w AS (
          SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS bad, fails = filter AS sole,
                 length(translate(fails, before, '')) < length(fails) AS gone
          FROM n, s),
        t AS (
          SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS removed,
                 sum(CASE WHEN gone AND bad THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END)::BIGINT AS unique_fails,
                 sum(CASE WHEN NOT gone AND bad THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND bad THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM w GROUP BY ALL)
        SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM t""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        x AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
        kept AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
        size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        all_c AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0)::HUGEINT AS n, v FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND kept.term = c.term),
        p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p FROM all_c),
        q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 5 * v) AS q FROM (SELECT lang, term, v, sum(n)::HUGEINT AS n FROM all_c GROUP BY ALL)),
        pair AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT y.lang, y.source AS s1, z.source AS s2, sum(abs(y.p - z.p)) AS s FROM p y JOIN p z ON y.lang = z.lang AND y.term = z.term GROUP BY ALL) f ON f.lang = a.lang AND s1 = a.source AND s2 = b.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
