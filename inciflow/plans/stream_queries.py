"""Streaming jobs over the given tables, with batch twins for the SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup as M
from ..operators import pages as PG
from ..operators import standardise as ST
from ..operators import store as KB
from ..sources import bindings as B
from ..sources.tables import event_time, file_stream
from ..streaming import jobs as J
from ..streaming import learning as LE
from . import duck as D
from . import page_queries as PQ
from . import sql_resolve as Q
from . import text_queries as TQ
from .registry import ctes, query

LIST_MIN = 5
_NAMES = "'Ingredients: red ring, small bolt, hot gear, blue bolt, old bolt, cold rod, ' || role || ' base'"
_TEXT = f"CASE turn % 3 WHEN 0 THEN {_NAMES} WHEN 1 THEN text ELSE CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'Ingredients: ' || text END END"
_SUB = {
    "submission_id": "CAST(conv_id * 1000 + turn AS STRING)", "fingerprint": "'p' || CAST(conv_id % 60 AS STRING)", "ord": "conv_id * 1000 + turn", "text": _TEXT,
}


def submissions(spark, sf):
    return B.table(spark, sf, "conversations").select(*[F.expr(v).alias(k) for k, v in _SUB.items()])


def known_products(spark, sf):
    """Products that are in the knowledge base before the first submission."""
    conv = B.table(spark, sf, "conversations").where("conv_id % 60 < 6")
    return conv.select(F.expr(_SUB["fingerprint"]).alias("fingerprint")).distinct()


SUBM = dict(
    dim=B.DIM_SQL, subm="SELECT " + ", ".join(f"{v} AS {k}" for k, v in _SUB.items()) + " FROM conversations",
    kb=f"SELECT DISTINCT {_SUB['fingerprint']} AS fingerprint FROM conversations WHERE conv_id % 60 < 6",
    sec=f"SELECT s.*, {D.label_section('text')} AS section, k.fingerprint IS NOT NULL AS known FROM subm s LEFT JOIN kb k USING (fingerprint)",
    lines=f"SELECT submission_id AS list_id, i - 1 AS position, a[i] AS raw_name FROM (SELECT submission_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT submission_id, {D.split_list('section')} AS a FROM sec WHERE NOT known AND section <> ''))",
    **Q.resolution(), cnt=Q.counters("res"), ver=Q.verified(LIST_MIN),
    chk=f"SELECT list_id AS submission_id, ingredient_count, verified, {Q.reason(LIST_MIN, D.q('Community Verified Formula'))} AS reason FROM ver",
    fst="SELECT fingerprint, min(ord) AS first_ord FROM sec JOIN chk USING (submission_id) WHERE verified GROUP BY 1",
    outc="SELECT s.submission_id, s.fingerprint, CASE WHEN known OR ord > first_ord THEN 'ALREADY_VERIFIED' WHEN section = '' THEN 'OCR_REQUIRED' WHEN verified THEN 'VERIFIED_AND_STORED' ELSE 'PENDING_REVIEW' END AS status, "
    "coalesce(reason, 'Ingredient list is too short to trust.') AS reason, ingredient_count FROM sec s LEFT JOIN chk USING (submission_id) LEFT JOIN fst f ON f.fingerprint = s.fingerprint",
)


@query(
    "j1_submissions",
    ctes("SELECT submission_id, fingerprint, status, CASE WHEN status = 'PENDING_REVIEW' THEN reason END AS review_notes, CASE WHEN status = 'VERIFIED_AND_STORED' THEN ingredient_count END AS ingredient_count FROM outc", **SUBM),
)
def j1_submissions(spark, sf):
    out = J.submit_batch(submissions(spark, sf), known_products(spark, sf), B.dimension(spark, sf), LIST_MIN)
    return out.select("submission_id", "fingerprint", "status", "review_notes", "ingredient_count")


def _stream(spark, sf, name):
    """The table as a stream, whether it is one file or a folder of part files: a path with a pattern may be either."""
    return spark.readStream.schema(B.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query(
    "j1_submissions_stream",
    ctes("SELECT submission_id, status FROM outc", **{**SUBM, "kb": "SELECT 'none' AS fingerprint"}),
)
def j1_submissions_stream(spark, sf):
    base = J.work_dir(spark, "submissions")
    source = _stream(spark, sf, "conversations").select(*[F.expr(v).alias(k) for k, v in _SUB.items()])
    J.submissions_stream(source, B.dimension(spark, sf), base, LIST_MIN)
    return spark.read.parquet(f"{base}/outcomes").select("submission_id", "status")


# ------------------------------------------------------------------ J2
_DEC = {"submission_id": "CASE WHEN doc_id % 7 = 0 THEN doc_id % 150 + 1000000000 ELSE doc_id % 150 END", "ord": "doc_id", "decision": "CASE WHEN quality = 1 THEN 'APPROVED' ELSE 'REJECTED' END", "notes": "CASE WHEN toxic = 1 THEN 'toxic wording' ELSE '' END"}


@query(
    "j2_review_decisions",
    "SELECT d.submission_id, CASE WHEN s.submission_id IS NULL THEN 'NOT_FOUND' ELSE decision END AS review_status, CASE WHEN s.submission_id IS NOT NULL THEN coalesce(nullif(notes, ''), CASE decision WHEN 'APPROVED' THEN 'Approved by reviewer.' ELSE 'Rejected by reviewer.' END) END AS review_notes FROM "
    "(SELECT * FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _DEC.items()) + " FROM labels) QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY ord DESC) = 1) d LEFT JOIN (SELECT DISTINCT doc_id AS submission_id FROM documents) s USING (submission_id)",
)
def j2_review_decisions(spark, sf):
    dec = B.table(spark, sf, "labels").select(*[F.expr(v).alias(k) for k, v in _DEC.items()])
    subs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("submission_id"))
    return J.review_batch(subs, dec)


_REVIEWS_SQL = (
    "SELECT d.submission_id, CASE WHEN s.submission_id IS NULL THEN 'NOT_FOUND' ELSE decision END AS review_status, CASE WHEN s.submission_id IS NOT NULL THEN coalesce(nullif(notes, ''), CASE decision WHEN 'APPROVED' THEN 'Approved by reviewer.' ELSE 'Rejected by reviewer.' END) END AS review_notes FROM "
    "(SELECT * FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _DEC.items()) + " FROM labels) QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY ord DESC) = 1) d LEFT JOIN (SELECT DISTINCT doc_id AS submission_id FROM documents) s USING (submission_id)"
)


def _in_parts(df, path, n):
    """The rows as a stream of n files, one for each micro-batch."""
    df.repartition(n).write.parquet(path)
    return file_stream(df.sparkSession, path, df.schema)


@query("j2_review_stream", _REVIEWS_SQL)
def j2_review_stream(spark, sf):
    """Submissions and decisions in several micro-batches, in any order; the last state of each decided id."""
    base = J.work_dir(spark, "reviews")
    moment = lambda c: F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col(c))
    decided = B.table(spark, sf, "labels").select(*[F.expr(v).alias(k) for k, v in _DEC.items()]).withColumn("ts", moment("ord"))
    sent = B.table(spark, sf, "documents").select(F.col("doc_id").alias("submission_id"), moment("doc_id").alias("ts"))
    # the clock strikes in the end, past the wait of the last decision, and once more so that timers end
    late = decided.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
    still = late.where("ts IS NULL")
    sources = [_in_parts(x, f"{base}/{n}", k) for x, n, k in ((sent, "sent", 3), (decided, "decided", 4), (still, "still", 1))]
    J.run_to_end(J.review_stream(*sources), f"{base}/checkpoint", path=f"{base}/states")
    for _ in range(2):
        late.write.mode("append").parquet(f"{base}/still")
    J.run_to_end(J.review_stream(*sources), f"{base}/checkpoint", path=f"{base}/states")
    states = spark.read.parquet(f"{base}/states")
    last = states.groupBy("submission_id").agg(F.max_by(F.struct("review_status", "review_notes"), F.struct("seen", "ord")).alias("l"))
    return last.select("submission_id", "l.*")


# ------------------------------------------------------------------ J3
_CACHE = "SELECT user_id AS key, event_id AS ord, ts, CASE event_type WHEN 'purchase' THEN 'write' ELSE 'read' END AS kind FROM events WHERE event_type IN ('purchase', 'view')"
_TTL = (
    "SELECT key, ord, strftime(w, '%Y-%m-%d %H:%M:%S') AS written_at, coalesce(w + INTERVAL 24 HOUR >= ts, false) AS hit FROM (SELECT *, max(CASE WHEN kind = 'write' THEN ts END) OVER (PARTITION BY key ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM c) WHERE kind = 'read'"
)


def cache_events(df):
    df = event_time(df).where(F.col("event_type").isin("purchase", "view"))
    return df.select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), "ts", F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"))


@query("j3_ttl_hits", ctes(_TTL, c=_CACHE))
def j3_ttl_hits(spark, sf):
    out = J.ttl_hits(cache_events(B.table(spark, sf, "events")))
    return out.select("key", "ord", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss").alias("written_at"), "hit")


@query("j3_ttl_stream", ctes("SELECT key, ord, hit FROM (" + _TTL + ")", c=_CACHE))
def j3_ttl_stream(spark, sf):
    base = J.work_dir(spark, "ttl")
    src = cache_events(_stream(spark, sf, "events")).withWatermark("ts", "1 hour")
    J.run_to_end(J.ttl_stream(src), f"{base}/checkpoint", path=f"{base}/hits")
    return spark.read.parquet(f"{base}/hits").select("key", "ord", "hit")


# ------------------------------------------------------------------ J4 / J5
_ATT = {
    "stage": "event_type", "url": "'u' || CAST(user_id % 40 AS STRING)", "website": "'site'", "method": "CASE WHEN user_id % 2 = 0 THEN 'dom' ELSE 'json' END",
    "status": "CASE WHEN value > 20 THEN 'VERIFIED' ELSE 'FAILED' END", "reason": "'r'", "ord": "event_id",
}


def _attempts(df):
    return event_time(df).select("ts", *[F.expr(v).alias(k) for k, v in _ATT.items()])


_KEY = ", ".join(J.ATTEMPT_KEY)


@query(
    "j4_dedupe_attempts",
    f"SELECT {_KEY}, ord FROM (SELECT ts, " + ", ".join(f"{v} AS {k}" for k, v in _ATT.items()) + f" FROM events) QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY ts, ord) = 1",
)
def j4_dedupe_attempts(spark, sf):
    return J.dedupe_attempts_batch(_attempts(B.table(spark, sf, "events"))).select(*J.ATTEMPT_KEY, "ord")


@query("j4_dedupe_stream", f"SELECT DISTINCT {_KEY} FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _ATT.items()) + " FROM events)")
def j4_dedupe_stream(spark, sf):
    base = J.work_dir(spark, "dedupe")
    J.run_to_end(J.dedupe_attempts(_attempts(_stream(spark, sf, "events")), "60 days"), f"{base}/checkpoint", path=f"{base}/rows")
    return spark.read.parquet(f"{base}/rows").select(*J.ATTEMPT_KEY)


def _stages(df):
    return event_time(df).select("ts", F.col("event_type").alias("stage"), (F.col("value") > 20).alias("verified"), F.col("value").alias("duration"), F.col("user_id").alias("fingerprint"))


_HOUR = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS stage, count(*) AS attempts, count(*) FILTER (WHERE value > 20) AS verified, max(value) AS max_duration FROM events GROUP BY 1, 2"
_start = lambda: F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start")


@query("j5_stage_metrics", _HOUR)
def j5_stage_metrics(spark, sf):
    return J.stage_metrics(_stages(B.table(spark, sf, "events"))).select(_start(), "stage", "attempts", "verified", "max_duration")


@query("j5_stage_metrics_stream", _HOUR)
def j5_stage_metrics_stream(spark, sf):
    """Every window of the stream: update mode, the last update of a window stays."""
    base = J.work_dir(spark, "metrics")
    metrics = J.stage_metrics(_stages(_stream(spark, sf, "events")).withWatermark("ts", "1 day"))

    def each(batch, batch_id):
        batch.withColumn("v", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/updates/batch={batch_id}")

    J.run_to_end(metrics, f"{base}/checkpoint", mode="update", each=each)
    rows = spark.read.parquet(f"{base}/updates")
    last = rows.groupBy("w", "stage").agg(F.max(F.struct("v", "attempts", "verified", "max_duration")).alias("m"))
    return last.select(_start(), "stage", "m.attempts", "m.verified", "m.max_duration")


@query(
    "j5_attempt_sessions",
    "SELECT fingerprint, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS attempts FROM (SELECT *, sum(n) OVER (PARTITION BY fingerprint ORDER BY ts, event_id) AS sid FROM (SELECT user_id AS fingerprint, ts, event_id, "
    "CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events)) GROUP BY fingerprint, sid",
)
def j5_attempt_sessions(spark, sf):
    s = J.stage_sessions(_stages(B.table(spark, sf, "events")))
    return s.select("fingerprint", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "attempts")


# ------------------------------------------------------------------ J6
# Every page is crawled twice, in two micro-batches; a third of the pages keeps its address. Some products are
# known before, in part under another fingerprint or name.
_CRAWL = {
    "request_id": "page_id * 2 + {b}", "ord": "page_id",
    "url": "CASE WHEN {b} = 0 OR page_id % 3 = 0 THEN url ELSE url || '?crawl=2' END",
}
_SEED = "page_id % 25 = 0"
_SEED_PRINT = "CASE WHEN page_id % 50 = 25 THEN 'old ' || fingerprint ELSE fingerprint END"
_SEED_NAME = "CASE WHEN page_id % 100 = 75 THEN 'Old ' || canonical_name ELSE canonical_name END"
_SEED_TIME = "-1 - page_id"


def _described(pages):
    # the article number tells products of a brand apart; without any, the brand alone would be an alias key
    ld = PG.jsonld_products(pages.withColumnRenamed("request_id", "page_id"))
    empty = F.lit("")
    return ld.select(
        F.col("page_id").alias("request_id"), "brand", "name", F.col("name").alias("canonical_name"),
        F.col("sku").alias("variant"), empty.alias("size"), empty.alias("category"), "sku",
    )


def _extracted(pages):
    pages = pages.withColumnRenamed("request_id", "page_id")
    dom = M.dom_candidates(pages).select("page_id", "method", "label", "raw_text")
    ld = PG.jsonld_products(pages).where("ingredients <> ''")
    ld = ld.select("page_id", F.lit("json-ld").alias("method"), F.lit("json-ld").alias("label"), F.col("ingredients").alias("raw_text"))
    return dom.unionByName(ld).withColumnRenamed("page_id", "request_id")


def _crawls(spark, sf, b):
    return B.product_pages(spark, sf).select(*[F.expr(v.format(b=b)).alias(k) for k, v in _CRAWL.items()], "html", "page_id")


def _learned_before(spark, sf):
    """A knowledge base from an earlier crawl."""
    pages = B.product_pages(spark, sf)
    own = pages.where(_SEED).withColumnRenamed("page_id", "request_id")
    products = ST.fingerprint(_described(own))
    keys = ST.alias_keys(products, "request_id").withColumnRenamed("request_id", "page_id")
    p = products.withColumnRenamed("request_id", "page_id").select("page_id", F.expr(_SEED_PRINT).alias("fingerprint"), "brand", F.expr(_SEED_NAME).alias("canonical_name"))
    time = F.expr(_SEED_TIME)
    return {
        "cache": pages.where("page_id % 7 = 0").select("url"),
        "product": p.select("fingerprint", "brand", "canonical_name", time.alias("updated_at")),
        "formula": p.select(
            "fingerprint", F.concat(F.lit("seed "), "page_id").alias("formula_id"), F.lit(0.9).alias("confidence"), time.alias("verified_at"),
            F.lit("").alias("ingredients_text"), F.lit(0).cast("bigint").alias("ingredient_count"),
        ),
        "alias": keys.join(p.select("page_id", "fingerprint"), "page_id").select("alias_key", "fingerprint", time.alias("registered_at")),
    }


def _cascade(b):
    """Outcomes of a crawl against the knowledge base before it, step by step."""
    before = f" UNION ALL SELECT * FROM {{}}{b - 1}" if b else ""
    url = _CRAWL["url"].format(b=b)
    return {
        f"rq{b}": f"SELECT page_id, {_CRAWL['request_id'].format(b=b)} AS request_id, page_id AS ord, {url} AS url, fingerprint, brand, canonical_name, keys FROM base",
        f"ca{b}": "SELECT url FROM pages WHERE page_id % 7 = 0" + (f" UNION SELECT url FROM ca{b - 1} UNION SELECT url FROM rq{b - 1} JOIN oc{b - 1} USING (request_id) WHERE verified" if b else ""),
        f"re{b}": f"SELECT * FROM rq{b} WHERE url NOT IN (SELECT url FROM ca{b})",
        f"pr{b}": "SELECT fingerprint, brand, canonical_name, updated_at FROM (SELECT fingerprint, brand, canonical_name, updated_at FROM sd" + before.format("np") + ") QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY updated_at DESC, brand DESC, canonical_name DESC) = 1",
        f"bf{b}": "SELECT fingerprint FROM sd" + (f" UNION SELECT fingerprint FROM np{b - 1}" if b else ""),
        f"al{b}": "SELECT alias_key, fingerprint FROM (SELECT alias_key, fingerprint, registered_at FROM sa" + before.format("na") + ") QUALIFY row_number() OVER (PARTITION BY alias_key ORDER BY registered_at, fingerprint) = 1",
        f"bn{b}": f"SELECT brand, canonical_name, fingerprint AS named FROM pr{b} WHERE brand <> '' AND canonical_name <> '' QUALIFY row_number() OVER (PARTITION BY brand, canonical_name ORDER BY updated_at DESC, fingerprint DESC) = 1",
        f"pk{b}": f"SELECT r.*, p.fingerprint IS NOT NULL AS st, coalesce(p.fingerprint, n.named) AS fpx FROM re{b} r LEFT JOIN pr{b} p ON p.fingerprint = r.fingerprint LEFT JOIN bn{b} n ON n.brand = r.brand AND n.canonical_name = r.canonical_name",
        f"lk{b}": f"SELECT request_id, CASE WHEN st THEN 'database' ELSE 'database-alias' END AS source, fpx AS fingerprint FROM pk{b} WHERE fpx IN (SELECT fingerprint FROM bf{b}) UNION ALL "
        f"SELECT request_id, 'memory-alias', a.fingerprint FROM (SELECT request_id, unnest(generate_series(1, len(keys))) AS i, keys FROM pk{b} WHERE fpx IS NULL OR fpx NOT IN (SELECT fingerprint FROM bf{b})) u "
        f"JOIN al{b} a ON a.alias_key = keys[i] QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY i) = 1",
        f"ms{b}": f"SELECT r.*, e.* EXCLUDE (page_id) FROM re{b} r LEFT JOIN ext e USING (page_id) WHERE request_id NOT IN (SELECT request_id FROM lk{b})",
        f"te{b}": f"SELECT fingerprint, min(ord) AS first_ord FROM ms{b} WHERE ok GROUP BY 1",
        f"oc{b}": "SELECT request_id, source, fingerprint, method, confidence, ingredient_count, CAST(attempts AS BIGINT) AS attempts, verified FROM ("
        f"SELECT request_id, 'cache' AS source, NULL AS fingerprint, NULL AS method, NULL AS confidence, NULL AS ingredient_count, 0 AS attempts, true AS verified FROM rq{b} WHERE url IN (SELECT url FROM ca{b}) "
        f"UNION ALL SELECT request_id, source, fingerprint, NULL, NULL, NULL, 0, true FROM lk{b} "
        f"UNION ALL SELECT request_id, 'memory', fingerprint, NULL, NULL, NULL, 0, true FROM ms{b} JOIN te{b} USING (fingerprint) WHERE ord > first_ord "
        f"UNION ALL SELECT request_id, CASE WHEN ok THEN 'extraction' ELSE 'none' END, CASE WHEN ok THEN fingerprint END, CASE WHEN ok THEN method END, CASE WHEN ok THEN confidence END, CASE WHEN ok THEN n END, coalesce(tries, 0), coalesce(ok, false) "
        f"FROM ms{b} LEFT JOIN te{b} USING (fingerprint) WHERE first_ord IS NULL OR ord <= first_ord)",
        f"np{b}": f"SELECT fingerprint, brand, canonical_name, ord AS updated_at FROM ms{b} JOIN te{b} USING (fingerprint) WHERE ord = first_ord",
        f"na{b}": f"SELECT unnest(keys) AS alias_key, fingerprint, ord AS registered_at FROM ms{b} JOIN te{b} USING (fingerprint) WHERE ord = first_ord",
    }


_SITE = PQ.host_key("url")
_LEARN = dict(
    dim=B.DIM_SQL, **PQ.PG, **PQ.LD, **PQ._DOM,
    enr="SELECT page_id AS p_partkey, brand, name, name AS canonical_name, sku AS variant, '' AS size, '' AS category, sku FROM ld", ident=TQ.IDENT,
    base=f"SELECT e.page_id, url, e.fingerprint, brand, canonical_name, keys FROM (SELECT p_partkey AS page_id, brand, canonical_name, {TQ.FP} AS fingerprint FROM enr) e "
    f"JOIN (SELECT p_partkey AS page_id, {Q.ordered_distinct('k')} AS keys FROM (SELECT p_partkey, {TQ.ALIAS_FORMS} AS k FROM ident)) a USING (page_id) JOIN pages USING (page_id)",
    sd=f"SELECT page_id, {_SEED_PRINT} AS fingerprint, brand, {_SEED_NAME} AS canonical_name, {_SEED_TIME} AS updated_at FROM base WHERE {_SEED}",
    sa=f"SELECT unnest(keys) AS alias_key, sd.fingerprint, {_SEED_TIME} AS registered_at FROM base JOIN sd USING (page_id)",
    cand="SELECT page_id, 'dom-heading' AS method, 'Ingredients' AS label, lst AS raw_text FROM pl UNION ALL "
    "SELECT page_id, 'dom-container', 'ingredient-list', 'Water, ' || p_name || ', Sodium oil, Glycerin' FROM pl UNION ALL "
    "SELECT page_id, 'dom-table', 'ingredient-table', 'Water extract, ' || p_name || ' oil, Sodium ' || lower(p_type) FROM pl UNION ALL "
    "SELECT page_id, 'json-ld', 'json-ld', ingredients FROM ld WHERE ingredients <> ''",
    lines=f"SELECT raw_text AS list_id, i - 1 AS position, a[i] AS raw_name FROM (SELECT raw_text, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT raw_text, {D.split_list('raw_text')} AS a FROM (SELECT DISTINCT raw_text FROM cand)))",
    **Q.resolution(), cnt=Q.counters("res"), ver=Q.verified(LIST_MIN),
    chk="SELECT c.*, b.brand, " + _SITE + " AS website, coalesce(v.ingredient_count, 0) AS ingredient_count, coalesce(v.verified, false) AS verified, v.* EXCLUDE (list_id, ingredient_count, verified) FROM cand c JOIN base b USING (page_id) LEFT JOIN ver v ON v.list_id = c.raw_text",
    rnk=f"SELECT *, {Q.verification_confidence('method', 'website', 'brand')} AS confidence, row_number() OVER (PARTITION BY page_id ORDER BY {PQ._PTS} DESC, method, label, raw_text) AS place FROM chk",
    ext="SELECT page_id, bool_or(verified) AS ok, coalesce(min(CASE WHEN verified THEN place END), count(*)) AS tries, arg_min(method, place) FILTER (WHERE verified) AS method, "
    "arg_min(confidence, place) FILTER (WHERE verified) AS confidence, arg_min(ingredient_count, place) FILTER (WHERE verified) AS n FROM rnk GROUP BY 1",
    **_cascade(0), **_cascade(1),
)


@query("j6_learning_loop", ctes("SELECT * FROM oc0 UNION ALL SELECT * FROM oc1", **_LEARN))
def j6_learning_loop(spark, sf):
    """Two crawls of the product pages in two micro-batches over a knowledge base from before."""
    base = J.work_dir(spark, "learning")
    first, second = (_crawls(spark, sf, b) for b in (0, 1))
    first.write.parquet(f"{base}/pages")
    seed = {}
    for name, df in (_learned_before(spark, sf) | {"dimension": B.dimension(spark, sf)}).items():
        df.write.parquet(f"{base}/before/{name}")
        seed[name] = spark.read.parquet(f"{base}/before/{name}")
    source = file_stream(spark, f"{base}/pages", first.schema, files_per_trigger=1 << 30)
    run = lambda: LE.learning_stream(source.drop("page_id"), _described, _extracted, seed["dimension"], seed, f"{base}/kb", LIST_MIN)
    run()
    second.write.mode("append").parquet(f"{base}/pages")
    run()
    return KB.committed(spark, f"{base}/kb", "outcome").select(*LE.OUTCOME)
