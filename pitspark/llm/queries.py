"""One query per operator with production parameters, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm import bpe, decontamination, language_id, line_dedup, ngram_join, periodic_runs, pii, quality_classifier, quality_rules, source_divergence, substring_dedup, toxicity, url_filter
from pitspark.llm.batches import fold_is


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", fold_is(5, 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def toxicity_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    model = toxicity.fit(docs, _read(spark, sf, "labels"), ~fold_is(5, 0))
    return _predicted(toxicity.score(docs, model), 0.5)


def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf, "pages"))


def line_removals(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.remove_repeated_lines(_read(spark, sf, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def contamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    field = language_id.fit(docs, ~fold_is(4, 2))
    return language_id.predict(docs, field).select("doc_id", fold_is(4, 2).alias("held_out"), "lang_pred", "score")


def passage_removals(spark: SparkSession, sf: str) -> DataFrame:
    done = substring_dedup.remove_repeated_passages(_read(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _coded(docs: DataFrame) -> DataFrame:
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def token_digests(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(_coded(_read(spark, sf, "documents")))


def rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf, "documents")).drop("rejected_by")


def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    model = quality_classifier.fit(docs, _read(spark, sf, "labels"), ~fold_is(5, 0))
    return _predicted(quality_classifier.score(docs, model), 0.3)


def ngram_components(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.link_documents(_read(spark, sf, "documents"), 3, 90, 100).drop("class")


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth text by crc32 of its id, h, is periodic from word a on: a and the
    period p follow from g = h div 10 and the number of words n. One scan; the other texts have no words here."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.when(h % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.select("*", F.when(n > 0, n).alias("n"), g.alias("g")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def _run_digests(found: DataFrame) -> DataFrame:
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    start, length, period = longest["start"], -longest["less"], longest["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def word_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _run_digests(periodic_runs.find_runs(_with_periods(_read(spark, sf, "documents"))))


def personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.span_digests(pii.find_pii(_read(spark, sf, "documents")))


def divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence.audit(_read(spark, sf, "documents"))


QUERIES = {
    "op1_toxicity": toxicity_scores,
    "op2_url_filter": url_verdicts,
    "op3_line_dedup": line_removals,
    "op4_decontamination": contamination,
    "op5_language_id": languages,
    "op6_substring_dedup": passage_removals,
    "op7_byte_bpe": token_digests,
    "op8_quality_rules": rule_verdicts,
    "op9_quality_classifier": quality_scores,
    "op10_ngram_join": ngram_components,
    "op11_periodic_runs": word_runs,
    "op12_pii": personal_data,
    "op13_source_divergence": divergence,
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        w AS (SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS g FROM l, unnest(range(0, len(ls) - 2)) AS t(i)),
        n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM w WHERE regexp_matches(g, '[^\x20\x09-\x0D]')),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM n, unnest(range(0, 3)) AS t(k) WHERE rn > 1),
        e AS (SELECT doc_id, i, ls[i + 1] AS line FROM l, unnest(range(0, len(ls))) AS t(i)),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM l LEFT JOIN kept k USING (doc_id)""",
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        p AS (SELECT DISTINCT item_id, array_to_string(ws[i + 1 : i + 10], ' ') AS g, least(len(ws), 10) AS m FROM b, unnest(range(0, greatest(1, len(ws) - 9))) AS t(i) WHERE len(ws) > 0),
        sizes AS (SELECT DISTINCT m FROM p),
        w AS (SELECT doc_id, i, m, array_to_string(ws[i + 1 : i + m], ' ') AS g FROM d, sizes, unnest(range(0, len(ws) - m + 1)) AS t(i)),
        hit AS (SELECT doc_id, i, p.m, item_id FROM w JOIN p ON w.g = p.g AND w.m = p.m),
        words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, m)) AS t(k) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""".replace("LOWERED", _LOWERED),
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(WORDS, []) AS ws FROM documents),
        e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER win AS g, count(*) OVER win AS n FROM e WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
        w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(g), g ORDER BY doc_id, i) > 1 AS again FROM g WHERE n = 20),
        c AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM e LEFT JOIN w USING (doc_id, i)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM c WHERE NOT gone GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept k USING (doc_id)""".replace("WORDS", _WORDS),
    "op8_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(WORDS, []) AS ws,
                          [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
        e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        f5 AS (SELECT doc_id, i, string_agg(word, ' ') OVER win AS g, count(*) OVER win AS n FROM e WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM f5 WHERE n = 5),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, unnest(range(0, 5)) AS t(k) WHERE g.n > 1 GROUP BY doc_id),
        c AS (SELECT doc_id, text, len(ws) AS n, length(array_to_string(ws, '')) AS chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS symbols,
                     len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS dups, coalesce(r.n, 0) AS rep,
                     len(regexp_extract_all(text, '!')) AS bangs, len(regexp_extract_all(text, '[A-Z]')) AS up, len(regexp_extract_all(text, '[a-z]')) AS low,
                     len([x FOR x IN ws IF regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS lettered,
                     len([i FOR i IN range(1, len(ws)) IF ws[i] = ws[i + 1]]) AS stammer
              FROM d LEFT JOIN r USING (doc_id)),
        f AS (SELECT *, n < 10 OR 100 * rep > 20 * n AS failed FROM c)
        SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, failed AS base_failed,
               NOT (failed OR 10 * symbols > 3 * n OR 10 * bangs > 3 * n OR up > low OR 2 * dups > lines OR chars < 2 * n OR chars > 20 * n OR 2 * lettered < n OR 3 * stammer > n) AS kept
        FROM f""".replace("WORDS", _WORDS),
    "op10_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(LOWERED, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS g FROM d, unnest(range(0, greatest(1, len(ws) - 2))) AS t(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT r.a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""".replace("LOWERED", _LOWERED),
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(LOWERED, '') AS text FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
        l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(max(l.n), 0) AS lang_n, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS n
              FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS had,
                     1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * g.v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (g.lang_n + 5 * g.v)::HUGEINT AS q
              FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE had > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""".replace("LOWERED", _LOWERED),
}
