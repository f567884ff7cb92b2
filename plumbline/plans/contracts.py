"""Queries of the contracts around model calls, sampling and gates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import changes
from plumbline.operators import contracts as ct
from plumbline.operators import evaluation as ev
from plumbline.operators import retrieval as rt

from .base import Registry
from .comparables import CANON_SQL, HARD_SQL, canon
from .surrogates import AS_OF, table
from .texts import DENSE_SQL, rankings

R = Registry()


@R.query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 6 AS BIGINT) AS lot FROM documents")
def extraction_lots(spark, sf_dir):
    return ct.lots(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "lot")


@R.query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS round FROM documents")
def extraction_retries(spark, sf_dir):
    """What the lots left out is asked again, twice at most; unknown and later answers do not count."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    round_ = F.when(i % 5 == 0, 3).when(i % 3 == 0, 1).when(i % 7 == 0, 2).otherwise(0)
    answers = d.select("doc_id", round_.alias("round")).unionByName(d.select((i + 10_000_000).alias("doc_id"), F.lit(0).alias("round")))
    return ct.extraction_rounds(d, answers, "doc_id").select("doc_id", "round")


@R.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def omitted_references(spark, sf_dir):
    return ct.omitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@R.query("""WITH v AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'permuta_o_financiacion' WHEN 1 THEN 'tipologia_distinta' WHEN 2 THEN 'fea' END AS motive, CASE WHEN doc_id % 5 = 0 THEN 'zzzz zzzz' ELSE strip_accents(substring(text, 3, 12)) END AS cite FROM documents), n AS (SELECT *, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(lower(strip_accents(cite)), '\\s+', ' ', 'g')) AS c FROM v)
SELECT doc_id, CASE WHEN motive IN ('permuta_o_financiacion', 'en_pozo_o_construccion', 'precio_promocional', 'tipologia_distinta', 'descripcion_inconsistente') AND trim(cite) <> '' AND contains(t, c) THEN motive END AS verdict FROM n""")
def verdict_application(spark, sf_dir):
    i = F.col("doc_id")
    motive = F.when(i % 4 == 0, "permuta_o_financiacion").when(i % 4 == 1, "tipologia_distinta").when(i % 4 == 2, "fea")
    cite = F.when(i % 5 == 0, "zzzz zzzz").otherwise(tx.fold(F.substring("text", 3, 12)))
    return table(spark, sf_dir, "documents").select("doc_id", ct.verdict(motive, cite, F.col("text")).alias("verdict"))


@R.query(f"WITH {DENSE_SQL}, s AS (SELECT *, CASE WHEN d % 3 <> 0 THEN d % 17 END AS score FROM rankings WHERE system = 'dense') SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN pos <= 20 THEN 0 ELSE 1 END, CASE WHEN pos <= 20 THEN score END DESC NULLS LAST, pos) AS new_pos FROM s")
def rerank_with_given_scores(spark, sf_dir):
    r = rankings(spark, sf_dir)[0].where("system = 'dense'").withColumn("score", F.when(F.col("d") % 3 != 0, F.col("d") % 17))
    return ct.reranked(r, "q", "pos", "score", 20).select("q", "d", "new_pos")


@R.query(f"WITH {DENSE_SQL}, f AS (SELECT q, d, system, pos, row_number() OVER (PARTITION BY q, d ORDER BY system, pos) AS n FROM rankings WHERE pos <= 30) SELECT q, d, system, pos FROM f WHERE n = 1")
def pooled_union_first_seen(spark, sf_dir):
    return ct.pooled(rankings(spark, sf_dir)[0], "q", "d", "system", "pos")


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_discount * 100 > l_tax * 100 + 2 THEN 'low_over_mid' END, CASE WHEN l_tax * 100 + 2 > 6 THEN 'mid_over_high' END, CASE WHEN l_linenumber > l_quantity THEN 'used_over_found' END) AS broken FROM lineitem")
def structural_coherence(spark, sf_dir):
    broken = ct.incoherent(F.col("l_discount") * 100, F.col("l_tax") * 100 + 2, F.lit(6.0), F.col("l_linenumber"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", broken.alias("broken"))


@R.query("SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 'accepted' WHEN turn < 2 THEN 'retry' ELSE 'without_prose' END AS state FROM conversations")
def critic_reject_loop(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ct.next_state(F.col("turn"), F.length("text") > 300).alias("state"))


@R.query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) AS k FROM c) SELECT o_custkey, o_orderpriority AS mode FROM r WHERE k = 1")
def mode_first_seen_on_ties(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("seen"))
    return c.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", -F.col("seen"))).alias("mode"))


@R.query("SELECT o_custkey AS tenant, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS reports FROM orders GROUP BY ALL")
def monthly_reports_per_tenant(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tenant"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("reports"))


@R.query("WITH " + CANON_SQL + " SELECT DISTINCT source, currency FROM canon")
def distinct_sources(spark, sf_dir):
    return canon(spark, sf_dir).select("source", "currency").distinct()


@R.query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.escaped(F.col("html")).alias("escaped"))


@R.query("WITH " + CANON_SQL + f" SELECT listing_id, area_id, surface, rooms FROM canon WHERE {HARD_SQL} AND condition IS NOT NULL AND (canonical_id IS NULL OR canonical_id = listing_id) ORDER BY md5('5:' || listing_id), listing_id LIMIT 60")
def seeded_query_bank(spark, sf_dir):
    """The sampling operator: a fixed number of live listings with features, by a seeded hash, to be read as subjects."""
    rows = rt.hard_filter(canon(spark, sf_dir), AS_OF, 100_000).where("condition is not null")
    return rows.withColumn("h", F.md5(F.concat(F.lit("5:"), "listing_id").cast("binary"))).orderBy("h", "listing_id").limit(60).select("listing_id", "area_id", "surface", "rooms")


MDAPE_SQL = """WITH r AS (SELECT user_id, event_type, event_id, ts, round(value / 100, 4) AS mdape, lag(round(value / 100, 4)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous, event_id % 200 AS cases FROM events)
SELECT event_id, CASE WHEN cases < 50 THEN 'too_few' WHEN mdape > previous + 0.02::DOUBLE THEN 'worse' WHEN mdape >= 0.6::DOUBLE THEN 'worse_than_baseline' WHEN previous IS NULL THEN 'first' ELSE 'ok' END AS verdict FROM r"""


@R.query(MDAPE_SQL)
def mdape_gate_against_previous(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.round(F.col("value") / 100, 4).alias("mdape"), F.lit(0.6).alias("baseline"), (F.col("event_id") % 200).alias("cases"))
    return ev.mdape_gate(e, ["user_id", "event_type"], "ts", "event_id", "mdape", "baseline", "cases").select("event_id", "verdict")


@R.query("""WITH x AS (SELECT 'lang' AS field, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS e, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'xx' ELSE lang END AS g FROM documents UNION ALL SELECT 'source', source, source FROM documents WHERE doc_id % 9 <> 0)
SELECT field, count(*) AS n, count(*) FILTER (e = g) AS hit, count(*) FILTER (e IS NULL AND g IS NOT NULL) AS hallucination, count(*) FILTER (e IS NOT NULL AND g IS NULL) AS omission, count(*) FILTER (e <> g) AS error, count(*) FILTER (e IS NULL AND g IS NULL) AS both_absent FROM x GROUP BY field""")
def extraction_outcomes(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(i % 6 != 0, F.col("lang")).alias("expected_lang"), F.when(i % 4 == 1, "xx").when(i % 4 != 0, F.col("lang")).alias("got_lang"), F.col("source").alias("expected_source"), F.col("source").alias("got_source"), F.when(i % 9 == 0, F.array(F.lit("source"))).alias("skip"))
    return ev.field_outcomes(rows, ["lang", "source"])


@R.query("SELECT role, count(*) AS n, round(avg((turn % 2 = 0)::INT), 4) AS refused, round(avg(CASE WHEN turn > 1 THEN (length(text) > 100)::INT END), 4) AS cites_ok FROM conversations GROUP BY role")
def answer_rates(spark, sf_dir):
    """Rates over the turns of conversations in the role of evaluated answers."""
    rows = table(spark, sf_dir, "conversations").select("role", (F.col("turn") % 2 == 0).alias("refused"), F.when(F.col("turn") > 1, F.length("text") > 100).alias("cites_ok"))
    return ev.rates(rows, ["role"], ["refused", "cites_ok"])


@R.query(f"WITH {DENSE_SQL}, p AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY pos, d) AS place FROM rankings WHERE system = 'dense' AND d % 2 = 0) SELECT * FROM p WHERE place <= 5")
def comparables_in_ranking_order(spark, sf_dir):
    r = rankings(spark, sf_dir)[0].where("system = 'dense'")
    pool = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("d"))
    return ev.in_ranking_order(r, pool, "q", "d", 5).select("q", "d", "place")


@R.query("WITH " + CANON_SQL + """, rep AS (SELECT o_orderkey AS report_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' ELSE 'INSUFFICIENT_DATA' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 25 END AS area_id FROM orders),
c AS (SELECT order_id AS report_id, area_id, count(*) AS c, min(listing_id) AS seen FROM canon GROUP BY ALL), m AS (SELECT report_id, area_id AS mode, row_number() OVER (PARTITION BY report_id ORDER BY c DESC, seen) AS k FROM c), n AS (SELECT order_id AS report_id, count(*) AS n FROM canon GROUP BY ALL HAVING count(*) >= 5)
SELECT report_id, coalesce(area_id, mode) AS area_id, n FROM rep JOIN n USING (report_id) LEFT JOIN (SELECT report_id, mode FROM m WHERE k = 1) USING (report_id) WHERE status <> 'FAILED' AND coalesce(area_id, mode) IS NOT NULL""")
def past_reports_as_queries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "SUCCEEDED").otherwise("INSUFFICIENT_DATA")
    reports = o.select(F.col("o_orderkey").alias("report_id"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 25).alias("area_id"))
    judged = canon(spark, sf_dir).select(F.col("order_id").alias("report_id"), "listing_id", "area_id")
    return ev.past_queries(reports, judged)


@R.query(f"""WITH {DENSE_SQL}, pool AS (SELECT DISTINCT q, d FROM rankings), kept AS (SELECT q, d, 1 AS grade FROM pool WHERE d % 4 = 0)
SELECT q, d, grade FROM kept UNION ALL SELECT q, d, CASE WHEN d % 3 = 0 THEN 2 WHEN d % 3 = 1 THEN 1 ELSE 0 END FROM pool WHERE d % 4 <> 0 AND q % 60 <> 0""")
def judgements_of_unseen(spark, sf_dir):
    """Old grades stay, unseen documents get theirs from the pipeline's detail, a query with a failed batch gets none."""
    pool = rankings(spark, sf_dir)[0].select("q", "d").distinct()
    d = F.col("d")
    kept = pool.where(d % 4 == 0).select("q", "d", F.lit(1).alias("grade"))
    verdicts = pool.select("q", "d", (d % 3 == 0).alias("included"), F.when(d % 3 == 1, "recorte_p5_p95").when(d % 3 == 2, "aviso_vencido").alias("reason"))
    return ev.judge_unseen(pool, kept, ["q", "d"], verdicts, pool.where("q % 60 = 0").select("q"))


@R.query("SELECT o_orderkey + 1000000000 AS report_id, o_orderkey AS origin_id, 'QUEUED' AS status, o_custkey FROM orders WHERE o_orderkey % 10 = 1")
def regenerated_reports(spark, sf_dir):
    """A report is never changed: made again it is a new row."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return changes.regenerated(r, r.where("report_id % 10 = 1"), F.col("report_id") + 1_000_000_000).select("report_id", "origin_id", "status", "o_custkey")


@R.query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 4 >= 2 THEN upper(lang) END AS lang, doc_id % 4 = 0 AS needs_review, round_even((doc_id % 4 * 0.35::DOUBLE + 0.4) / 2, 2) AS mean_confidence FROM documents""")
def applied_extraction(spark, sf_dir):
    """The portal's fact wins, an extracted one counts if it is sure; a false cite asks for a review."""
    i = F.col("doc_id")
    sure = (i % 4) * 0.35
    return table(spark, sf_dir, "documents").select("doc_id", tx.applied(F.when(i % 3 == 0, F.col("lang")), F.upper("lang"), sure).alias("lang"), tx.needs_review(F.array(sure, F.lit(0.4))).alias("needs_review"), tx.mean_confidence(F.array(sure, F.lit(0.4), F.lit(None).cast("double"))).alias("mean_confidence"))


@R.query("WITH c AS (SELECT sha256(text) AS k, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY text) SELECT count(*) AS uniques, count(*) FILTER (n > 1) AS groups, count(*) FILTER (sources > 1) AS cross_source, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs_in_groups, CAST(sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2) AS BIGINT) AS pairs_saved FROM c")
def duplicate_report(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    inside = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return c.agg(F.count("*").alias("uniques"), F.count_if(F.col("n") > 1).alias("groups"), F.count_if(F.col("sources") > 1).alias("cross_source"), inside.cast("long").alias("pairs_in_groups"), (F.sum("n") * (F.sum("n") - 1) / 2 - inside).cast("long").alias("pairs_saved"))


QUERIES, ORACLES = R.queries, R.oracles
