"""Comparisons, agreements, shares and samples over runs, labels and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import documents as doc, statistics as st
from ..operators import aggregates as agg, joins, sampling
from ..operators.windows import error_group
from ..sources.views import CELLS_SQL, MANIFEST_SQL, PAIRS_SQL, cells, manifest, pairs, table
from .registry import query
from .recovery import _GROUP


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    mid = f"(({k} / {n}) + 3.8416e0 / (2 * {n})) / (1 + 3.8416e0 / {n})"
    half = f"1.96e0 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 3.8416e0 / (4 * {n} * {n})) / (1 + 3.8416e0 / {n})"
    return f"({mid} - {half})", f"({mid} + {half})"


# --- projections


@query("SELECT submission, CASE WHEN organisation LIKE '%user%' THEN trim(split_part(organisation, 'user', -1)) ELSE trim(organisation) END AS submitter FROM manifest", MANIFEST_SQL)
def prj_submitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("organisation")
    return manifest(spark, sf_dir).select("submission", F.when(o.contains("user"), F.trim(F.element_at(F.split(o, "user"), -1))).otherwise(F.trim(o)).alias("submitter"))


_REASON = """CASE WHEN with_trace = 0 THEN 'no_trace' WHEN dup_of <> submission THEN 'duplicate' WHEN format = 'MACHINERY' THEN 'summary_only'
    WHEN format = 'FURNITURE' THEN 'parser_not_written' WHEN errors = 0 THEN 'no_error_signal' ELSE 'included' END"""


@query(
    f"""SELECT submission, dup_of, reason, reason IN ('included', 'no_error_signal') AS included
    FROM (SELECT *, {_REASON} AS reason FROM (SELECT *, min(submission) OVER (PARTITION BY trace_hash) AS dup_of FROM manifest))""",
    MANIFEST_SQL,
)
def prj_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copy of each trace hash is kept; the first reason that holds is given."""
    first = manifest(spark, sf_dir).groupBy("trace_hash").agg(F.min("submission").alias("dup_of"))
    rows = manifest(spark, sf_dir).join(first, "trace_hash")
    reason = (
        F.when(F.col("with_trace") == 0, "no_trace")
        .when(F.col("dup_of") != F.col("submission"), "duplicate")
        .when(F.col("format") == "MACHINERY", "summary_only")
        .when(F.col("format") == "FURNITURE", "parser_not_written")
        .when(F.col("errors") == 0, "no_error_signal")
        .otherwise("included")
    )
    return rows.select("submission", "dup_of", reason.alias("reason")).withColumn("included", F.col("reason").isin("included", "no_error_signal"))


@query(
    """SELECT doc_id, CASE WHEN contains(text, 'License') AND contains(text, 'Version') THEN 'versioned' WHEN contains(text, 'License') THEN 'licensed'
        WHEN contains(text, '@') THEN 'contact' WHEN strlen(text) > 4000 THEN 'long' ELSE 'other' END AS format FROM documents"""
)
def prj_format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    first = F.when(t.contains("License") & t.contains("Version"), "versioned").when(t.contains("License"), "licensed").when(t.contains("@"), "contact").when(F.octet_length(t) > 4000, "long").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("format"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN left(text, 20) || ' ... ' || right(text, 20) ELSE text END AS short FROM conversations")
def prj_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import head_tail

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", head_tail(F.col("text"), 40).alias("short"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity * 2.5e0 + l_extendedprice * 0.25e0 + l_tax * 10e0) / 1e6 AS cost FROM lineitem")
def prj_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = (F.col("l_quantity") * F.lit(2.5) + F.col("l_extendedprice") * F.lit(0.25) + F.col("l_tax") * F.lit(10.0)) / F.lit(1e6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cost.alias("cost"))


@query(
    """SELECT o_orderkey, o_totalprice * 0.97 < p AND p < o_totalprice * 1.03 AS correct
    FROM (SELECT *, CAST(round(o_totalprice, 0) * (1 + (o_orderkey % 9 - 4) / 1e2) AS DOUBLE) AS p FROM orders)"""
)
def prj_numeric_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer is right if it lies strictly within 3 % of the truth."""
    p = F.round("o_totalprice", 0) * (1 + (F.col("o_orderkey") % 9 - 4) / F.lit(1e2))
    truth = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", ((truth * F.lit(0.97) < p) & (p < truth * F.lit(1.03))).alias("correct"))


@query("SELECT unit, seed, arm, correct FROM pairs WHERE unit IN (SELECT unit FROM pairs GROUP BY unit HAVING count(*) >= 60)", PAIRS_SQL)
def prj_complete_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    full = rows.groupBy("unit").agg(F.count("*").alias("n")).where("n >= 60")
    return rows.join(full, "unit", "left_semi").select("unit", "seed", "arm", "correct")


@query(f"SELECT {_GROUP} AS error_group, CASE WHEN error_key IN ('k1', 'k3') THEN 'pos' WHEN value > 10 THEN 'neg-sus' ELSE 'neg-rest' END AS stratum, count(*) AS n FROM cells WHERE failed GROUP BY 1, 2", CELLS_SQL)
def prj_audit_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    stratum = F.when(F.col("error_key").isin("k1", "k3"), "pos").when(F.col("value") > 10, "neg-sus").otherwise("neg-rest")
    return cells(spark, sf_dir).where("failed").groupBy(error_group().alias("error_group"), stratum.alias("stratum")).agg(F.count("*").alias("n"))


# --- joins


@query(
    "SELECT trace, idx, format FROM cells JOIN (SELECT submission, format FROM manifest WHERE with_trace > 0) m ON trace = submission",
    CELLS_SQL, MANIFEST_SQL,
)
def join_cells_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).where("with_trace > 0").select(F.col("submission").alias("trace"), "format")
    return cells(spark, sf_dir).join(m, "trace").select("trace", "idx", "format")


@query("SELECT d.doc_id, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def join_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id").select("doc_id", "source", "quality", "toxic")


_OLD = "old AS (SELECT l_orderkey AS k, l_linenumber AS n, min(CASE WHEN l_discount > 0.05 THEN 'block' WHEN l_tax > 0.04 THEN 'unknown' ELSE 'run' END) AS outcome FROM lineitem WHERE l_quantity > 3 GROUP BY 1, 2)"
_NEW = "new AS (SELECT l_orderkey AS k, l_linenumber AS n, min(CASE WHEN l_discount > 0.06 THEN 'block' WHEN l_tax > 0.05 THEN 'unknown' ELSE 'run' END) AS outcome FROM lineitem WHERE l_quantity < 48 GROUP BY 1, 2)"


def _release(spark: SparkSession, sf_dir: str, discount: float, tax: float, which: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(which)
    outcome = F.when(F.col("l_discount") > discount, "block").when(F.col("l_tax") > tax, "unknown").otherwise("run")
    return rows.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min(outcome).alias("outcome"))


@query(
    """SELECT coalesce(o.outcome, '-') AS old, coalesce(w.outcome, '-') AS new,
        CASE WHEN o.k IS NULL THEN 'only_new' WHEN w.k IS NULL THEN 'only_old' ELSE 'both' END AS side, count(*) AS cells
    FROM old o FULL OUTER JOIN new w ON o.k = w.k AND o.n = w.n GROUP BY 1, 2, 3""",
    _OLD, _NEW,
)
def join_compare_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of outcomes between two versions of a rule, with the keys that one side lacks."""
    both = joins.compare(_release(spark, sf_dir, 0.05, 0.04, "l_quantity > 3"), _release(spark, sf_dir, 0.06, 0.05, "l_quantity < 48"), ["k", "n"], "outcome")
    return both.groupBy(F.coalesce("old", F.lit("-")).alias("old"), F.coalesce("new", F.lit("-")).alias("new"), "side").agg(F.count("*").alias("cells"))


@query("SELECT o.outcome AS old, w.outcome AS new, count(*) AS cells FROM old o JOIN new w ON o.k = w.k AND o.n = w.n GROUP BY 1, 2", _OLD, _NEW.replace("l_quantity < 48", "l_quantity > 3"))
def join_strict_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = joins.strict_compare(_release(spark, sf_dir, 0.05, 0.04, "l_quantity > 3"), _release(spark, sf_dir, 0.06, 0.05, "l_quantity > 3"), ["k", "n"], "outcome")
    return both.groupBy("old", "new").agg(F.count("*").alias("cells"))


_ARMS = "arms AS (SELECT unit, seed, max_by(correct, (line, part)) FILTER (arm = 'off') AS off, max_by(correct, (line, part)) FILTER (arm = 'on') AS on_ FROM pairs GROUP BY unit, seed)"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.paired(pairs(spark, sf_dir), ["unit", "seed"], "arm", "correct", ("off", "on"), ["line", "part"])


@query("SELECT unit, seed, off, on_ FROM arms WHERE off IS NOT NULL AND on_ IS NOT NULL", PAIRS_SQL, _ARMS)
def join_paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).withColumnRenamed("on", "on_")


@query("SELECT conv_id, q.turn AS question, a.turn AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') q JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') a USING (conv_id, k)")
def join_kth_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    q, a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("question")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"))
    return joins.kth_with_kth(q, a, "conv_id", ["question"], ["answer"]).select("conv_id", "question", "answer")


_PATH = r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/+$', '')"


@query(
    f"""SELECT a.p AS page, b.p AS other FROM (SELECT DISTINCT {_PATH} AS p FROM pages) a JOIN (SELECT DISTINCT {_PATH} AS p FROM pages) b
    ON a.p <> '' AND b.p <> '' AND (a.p = b.p OR a.p LIKE '%/' || b.p OR b.p LIKE '%/' || a.p)"""
)
def join_path_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different paths that may name the same file."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1), r"/+$", "")
    rows = table(spark, sf_dir, "pages").select(path.alias("page")).where("page <> ''").distinct()
    return joins.suffix_pairs(rows, rows.withColumnRenamed("page", "other"), "page", "other").select("page", "other")


@query(
    """SELECT c_custkey AS task, arm, seed FROM customer, (VALUES ('off'), ('on')) a(arm), (VALUES (1), (2), (3)) s(seed)
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (CASE WHEN o_orderkey % 2 = 0 THEN 'off' ELSE 'on' END) = arm AND o_orderkey % 3 + 1 = seed)"""
)
def join_jobs_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderkey") % 2 == 0, "off").otherwise("on").alias("arm"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("seed"))
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"))
    return joins.jobs_not_done(tasks, ["off", "on"], 3, done, "task")


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 25 AND (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM part WHERE p_size <= 25)")
def join_not_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return joins.not_in_domain(parts.where("p_size > 25").select("p_brand", "p_type").distinct(), parts.where("p_size <= 25"), ["p_brand", "p_type"])


@query("SELECT source, name, array_to_string(list_sort(list_filter(every, lambda x: x <> source)), ',') AS found_in FROM (SELECT DISTINCT p_brand AS source, p_size AS name FROM part) JOIN (SELECT p_size AS name, list(DISTINCT p_brand) AS every FROM part GROUP BY 1) USING (name)")
def join_found_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_size").alias("name"))
    return joins.elsewhere(names).withColumn("found_in", F.array_join("found_in", ","))


@query(
    """SELECT source, name, n - 1 AS others, CASE WHEN source <> low THEN low WHEN n > 1 THEN high END AS another, CASE n WHEN 1 THEN 'here only' WHEN 2 THEN 'one other' ELSE 'several others' END AS class
    FROM (SELECT DISTINCT l_suppkey AS source, l_partkey AS name FROM lineitem) JOIN (SELECT l_partkey AS name, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS low, max(l_suppkey) AS high FROM lineitem GROUP BY 1) USING (name)"""
)
def join_found_elsewhere_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts only one supplier ships, and who else ships the others."""
    return joins.found_elsewhere(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("name")))


# --- aggregates


@query(
    """SELECT CASE WHEN grouping(submitter) = 1 THEN 'ALL' ELSE CAST(submitter AS VARCHAR) END AS submitter, count(*) AS cells, count(*) FILTER (failed) AS failed,
        count(*) FILTER (error_type = 'SyntaxError') AS harness, count(*) FILTER (error_type IN ('KeyError', 'KeyError(wrapped)', 'FileNotFoundError')) AS data,
        count(*) FILTER (error_type IN ('KeyError', 'KeyError(wrapped)', 'FileNotFoundError'))::DOUBLE / greatest(count(*) FILTER (failed), 1) AS share_of_failed,
        count(*) FILTER (error_type IN ('KeyError', 'KeyError(wrapped)', 'FileNotFoundError'))::DOUBLE / greatest(count(*) FILTER (failed AND error_type <> 'SyntaxError'), 1) AS share_without_harness
    FROM cells GROUP BY ROLLUP (submitter)""",
    CELLS_SQL,
)
def agg_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter in one pass, by group and pooled, with two denominators."""
    data = F.count_if(F.col("error_type").isin("KeyError", "KeyError(wrapped)", "FileNotFoundError"))
    failed, harness = F.count_if(F.col("failed")), F.count_if(F.col("error_type") == "SyntaxError")
    return agg.with_total(
        cells(spark, sf_dir),
        "submitter",
        F.count("*").alias("cells"),
        failed.alias("failed"),
        harness.alias("harness"),
        data.alias("data"),
        agg.share(data, failed).alias("share_of_failed"),
        agg.share(data, failed - harness).alias("share_without_harness"),
    )


@query("SELECT error_key, n, n::DOUBLE / sum(n) OVER () AS share FROM (SELECT error_key, count(*) AS n FROM cells WHERE failed GROUP BY 1) ORDER BY n DESC, error_key LIMIT 4", CELLS_SQL)
def agg_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.top(cells(spark, sf_dir).where("failed"), "error_key", 4)


@query("SELECT submitter, arg_max(error_key, (n, error_key)) AS mode, max(n) AS n FROM (SELECT submitter, error_key, count(*) AS n FROM cells WHERE failed GROUP BY 1, 2) GROUP BY 1", CELLS_SQL)
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mode(cells(spark, sf_dir).where("failed"), "submitter", "error_key")


@query(
    """SELECT l_shipmode_ AS mode, avg(v) AS mean, median(v) AS median, min(v) AS least, max(v) AS most, list_sort(list(v))[CAST(floor(0.95e0 * count(v)) AS INT) + 1] AS index_p95, quantile_cont(v, 0.95) AS linear_p95, count(DISTINCT k) AS keys
    FROM (SELECT l_linestatus AS l_shipmode_, l_quantity AS v, l_suppkey AS k FROM lineitem) GROUP BY 1"""
)
def agg_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("mode"), F.col("l_quantity").alias("v"), F.col("l_suppkey").alias("k"))
    # counted by value first, and keys apart: beside a count of different keys each key of a mode would have percentiles of its own
    values = rows.groupBy("mode", "v").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    spread = values.groupBy("mode").agg(
        (F.sum("s") / F.sum("n")).alias("mean"),
        F.percentile("v", 0.5, F.col("n")).alias("median"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile("v", 0.95, F.col("n")).alias("linear_p95"),
    )
    keys = rows.select("mode", "k").distinct().groupBy("mode").agg(F.count("k").alias("keys"))
    return spread.join(keys, "mode").join(agg.index_percentile(rows, ["mode"], "v", 0.95).select("mode", F.col("value").alias("index_p95")), "mode")


@query("SELECT avg(m) AS pass_at_1 FROM (SELECT n, avg(m) AS m FROM (SELECT c_nationkey AS n, o_custkey, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1)")
def agg_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(spark, sf_dir, "orders").join(c, "o_custkey").withColumn("ok", (F.col("o_orderstatus") == "F").cast("double"))
    return agg.macro_mean(rows, ["c_nationkey", "o_custkey"], "ok", "pass_at_1")


@query("SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1")
def agg_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(agg.weighted_mean(None, "l_discount", "l_quantity").alias("mean"))


@query(
    """SELECT count(*) FILTER (off = 1 AND on_ = 1) AS a, count(*) FILTER (off = 1 AND on_ < 1) AS b, count(*) FILTER (off < 1 AND on_ = 1) AS c, count(*) FILTER (off < 1 AND on_ < 1) AS d,
        count(*) FILTER (on_ > off) AS more, count(*) FILTER (on_ < off) AS fewer, count(*) FILTER (on_ = off) AS equal FROM arms WHERE off IS NOT NULL AND on_ IS NOT NULL""",
    PAIRS_SQL, _ARMS,
)
def agg_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    off, on = F.col("off"), F.col("on")
    return _arms(spark, sf_dir).agg(
        F.count_if((off == 1) & (on == 1)).alias("a"),
        F.count_if((off == 1) & (on < 1)).alias("b"),
        F.count_if((off < 1) & (on == 1)).alias("c"),
        F.count_if((off < 1) & (on < 1)).alias("d"),
        F.count_if(on > off).alias("more"),
        F.count_if(on < off).alias("fewer"),
        F.count_if(on == off).alias("equal"),
    )


@query("SELECT n, count(*) AS traces FROM (SELECT trace, count(*) FILTER (failed) AS n FROM cells GROUP BY 1) GROUP BY 1", CELLS_SQL)
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("trace").agg(F.count_if(F.col("failed")).alias("n")).groupBy("n").agg(F.count("*").alias("traces"))


@query("SELECT source, sha256(string_agg(doc_id || text, '' ORDER BY doc_id)) AS hash FROM documents GROUP BY 1")
def agg_group_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_hash(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("SELECT trace, bool_or(failed) AS any_failed, bool_and(failed) AS all_failed, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM cells GROUP BY 1", CELLS_SQL)
def agg_any_all_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("trace").agg(F.bool_or("failed").alias("any_failed"), F.bool_and("failed").alias("all_failed"), F.array_join(F.array_sort(F.collect_set("name")).cast("array<string>"), ",").alias("names"))


@query("SELECT doc_id, source, quality FROM (SELECT doc_id, source, quality, min(quality) OVER (PARTITION BY source) <> max(quality) OVER (PARTITION BY source) AS d FROM documents JOIN labels USING (doc_id)) WHERE d")
def agg_varying_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return agg.varying(rows, "source", "quality").select("doc_id", "source", "quality")


@query("SELECT submitter, trace, idx, nth FROM (SELECT *, row_number() OVER (PARTITION BY submitter ORDER BY ts, trace) AS nth FROM cells WHERE error_type = 'KeyError') WHERE nth <= 3", CELLS_SQL)
def agg_first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.first_examples(cells(spark, sf_dir).where("error_type = 'KeyError'"), "submitter", ["ts", "trace"], 3).select("submitter", "trace", "idx", "nth")


@query("SELECT sum(c) AS tokens FROM (SELECT unit, seed, max(cost) AS c FROM pairs GROUP BY 1, 2)", PAIRS_SQL)
def agg_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's cost stands on each of its rows: count it once."""
    return pairs(spark, sf_dir).groupBy("unit", "seed").agg(F.max("cost").alias("c")).agg(F.sum("c").alias("tokens"))


@query("SELECT c_mktsegment, rank() OVER (ORDER BY m DESC) AS place FROM (SELECT c_mktsegment, round(avg(c_acctbal), 6) AS m FROM customer GROUP BY 1)")
def agg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("m"))
    return means.select("c_mktsegment", F.rank().over(W.orderBy(F.desc("m"))).cast("long").alias("place"))


@query("SELECT arm, avg(m) AS mean FROM (SELECT unit, arm, avg(s) AS m FROM (SELECT unit, seed, arm, avg(correct) AS s FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1", PAIRS_SQL)
def agg_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = pairs(spark, sf_dir).groupBy("unit", "seed", "arm").agg(F.avg("correct").alias("s"))
    return seeds.groupBy("unit", "arm").agg(F.avg("s").alias("m")).groupBy("arm").agg(F.avg("m").alias("mean"))


# --- sets and order


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS both_, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)) AS either")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both, left, either = n(o.intersect(c.where("c_acctbal > 0").select("k")), "both_"), n(c.select("k").subtract(o), "only_left"), n(o.union(c.select("k")).distinct(), "either")
    return both.crossJoin(left).crossJoin(either)  # three rows of one


@query("SELECT trace_hash, submission AS dup, dup_of FROM (SELECT *, min(submission) OVER (PARTITION BY trace_hash) AS dup_of FROM manifest) WHERE dup_of <> submission", MANIFEST_SQL)
def set_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).select("trace_hash", "submission")
    first = m.groupBy("trace_hash").agg(F.min("submission").alias("dup_of"))
    return m.join(first, "trace_hash").where("dup_of <> submission").select("trace_hash", F.col("submission").alias("dup"), "dup_of")


@query("SELECT submitter, ratio FROM (SELECT submitter, count(*) FILTER (failed)::DOUBLE / greatest(count(*), 1) AS ratio FROM cells GROUP BY 1) ORDER BY ratio DESC, submitter", CELLS_SQL)
def sort_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("submitter").agg(agg.share(F.count_if(F.col("failed")), F.count("*")).alias("ratio")).orderBy(F.desc("ratio"), "submitter")


# --- samples


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit|' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 12")
def sample_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.per_stratum(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 12, "audit").select("lang", "doc_id", "rank")


@query(
    """SELECT submitter, trace, idx, turn FROM (SELECT *, row_number() OVER (PARTITION BY submitter ORDER BY h, trace, idx) AS turn FROM (
        SELECT *, sha256(trace || '|' || idx) AS h FROM cells WHERE failed QUALIFY row_number() OVER (PARTITION BY trace ORDER BY sha256(trace || '|' || idx), trace, idx) = 1)) ORDER BY turn, submitter LIMIT 30""",
    CELLS_SQL,
)
def sample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(cells(spark, sf_dir).where("failed"), "submitter", "trace", ["trace", "idx"], 30).select("submitter", "trace", "idx", "turn")


@query(
    """SELECT submitter, trace, idx FROM (SELECT *, row_number() OVER (PARTITION BY submitter ORDER BY h, trace, idx) AS k FROM (
        SELECT *, sha256(trace || '|' || idx) AS h FROM cells WHERE failed QUALIFY row_number() OVER (PARTITION BY submitter, trace ORDER BY sha256(trace || '|' || idx), trace, idx) = 1)) WHERE k <= 5""",
    CELLS_SQL,
)
def sample_capped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped_share(cells(spark, sf_dir).where("failed"), "submitter", ["submitter", "trace"], ["trace", "idx"], 5).select("submitter", "trace", "idx")


# --- statistics

_LOW, _HIGH = _wilson_sql("k", "n")


@query(f"SELECT submitter, k, n, {_LOW} AS low, {_HIGH} AS high, 1 - pow(0.05e0, 1e0 / n) AS none_upper FROM (SELECT submitter, count(*) FILTER (failed) AS k, count(*) AS n FROM cells GROUP BY 1)", CELLS_SQL)
def stat_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).groupBy("submitter").agg(F.count_if(F.col("failed")).alias("k"), F.count("*").alias("n"))
    low, high = st.wilson("k", "n")
    return rows.select("submitter", "k", "n", low.alias("low"), high.alias("high"), st.rule_of_three("n").alias("none_upper"))


def _newcombe_sql() -> str:
    l1, u1 = _wilson_sql("a + b", "a + b + c + d")
    l2, u2 = _wilson_sql("a + c", "a + b + c + d")
    return f"""SELECT p1 - p2 AS diff, p1 - p2 - sqrt(greatest((p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2, 0)) AS low,
        p1 - p2 + sqrt(greatest((u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2, 0)) AS high
    FROM (SELECT *, CASE WHEN den > 0 THEN (CASE WHEN num > 0 THEN greatest(num - n / 2, 0) ELSE num END) / sqrt(den) ELSE 0 END AS phi FROM (
        SELECT (a + b)::DOUBLE / (a + b + c + d) AS p1, (a + c)::DOUBLE / (a + b + c + d) AS p2, {l1} AS l1, {u1} AS u1, {l2} AS l2, {u2} AS u2,
            (a + b + c + d)::DOUBLE AS n, (a * d - b * c)::DOUBLE AS num, (a + b)::DOUBLE * (c + d) * (a + c) * (b + d) AS den FROM t))"""


@query(
    _newcombe_sql(),
    PAIRS_SQL, _ARMS,
    """t AS (SELECT count(*) FILTER (off = 1 AND on_ = 1) AS a, count(*) FILTER (off = 1 AND on_ < 1) AS b, count(*) FILTER (off < 1 AND on_ = 1) AS c, count(*) FILTER (off < 1 AND on_ < 1) AS d FROM arms WHERE off IS NOT NULL AND on_ IS NOT NULL)""",
)
def stat_newcombe(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff, low, high = st.newcombe_paired("a", "b", "c", "d")
    return agg_contingency(spark, sf_dir).select(diff.alias("diff"), low.alias("low"), high.alias("high"))


@query(
    """SELECT source, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT source, (yy + nn)::DOUBLE / n AS po, ((yy + yn) * (yy + ny) + (nn + ny) * (nn + yn))::DOUBLE / (n * n) AS pe FROM (
        SELECT source, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS yy, count(*) FILTER (quality = 0 AND toxic = 0) AS nn, count(*) FILTER (quality = 1 AND toxic = 0) AS yn, count(*) FILTER (quality = 0 AND toxic = 1) AS ny
        FROM documents JOIN labels USING (doc_id) GROUP BY 1))"""
)
def stat_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    counts = rows.groupBy("source").agg(F.count_if(q & t).alias("yy"), F.count_if(~q & ~t).alias("nn"), F.count_if(q & ~t).alias("yn"), F.count_if(~q & t).alias("ny"))
    return counts.select("source", st.kappa("yy", "nn", "yn", "ny").alias("kappa"))


@query(
    """SELECT family, test, max(raw) OVER (PARTITION BY family ORDER BY p ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) * p) AS raw
        FROM (SELECT s_nationkey % 4 AS family, s_suppkey AS test, (s_suppkey * 37 % 101 + 1) / 2e3 AS p FROM supplier))"""
)
def stat_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).alias("family"), F.col("s_suppkey").alias("test"), ((F.col("s_suppkey") * 37 % 101 + 1) / F.lit(2e3)).alias("p"))
    return st.holm(rows, "p", ["family"]).select("family", "test", "p_holm")


@query(None)
def stat_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval and sign-flip test of the mean difference of arms over units."""
    units = _arms(spark, sf_dir).groupBy("unit").agg(F.avg(F.col("on") - F.col("off")).alias("d")).withColumn("comparison", F.lit("on-off"))
    return st.resampled(units, "comparison", "d", 1000)


@query(None)
def stat_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("one", F.lit(1)).withColumn("bad", F.col("failed").cast("int")).withColumn("all", F.lit("all"))
    return st.cluster_bootstrap(rows, "all", "trace", "bad", "one", 500)


@query(None)
def stat_poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = cells(spark, sf_dir).groupBy("submitter", "trace").agg(F.count_if(F.col("failed")).alias("bad"), F.count("*").alias("n"))
    reps = st.poisson_bootstrap(per, "submitter", "bad", "n", "trace", 200)
    return reps.groupBy("submitter").agg(F.percentile("ratio", F.lit(0.025)).alias("low"), F.percentile("ratio", F.lit(0.975)).alias("high"))


@query(None)
def stat_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return spark.createDataFrame([st.fixed_effects_logit(rows, "quality", "toxic", ["lang", "source"], "source")])


# --- documents

_FILTERS = {
    '{"k": {"$gte": 50}}': "k >= 50",
    '{"k": {"$in": [1, 2, 3]}, "tag": "click"}': "k IN (1, 2, 3) AND event_type = 'click'",
    '{"$or": [{"k": 7}, {"tag": {"$regex": "^err"}}]}': "k = 7 OR regexp_matches(event_type, '^err')",
    '{"$nor": [{"k": {"$lt": 90}}], "tag": {"$ne": "view"}}': "NOT (k < 90) AND event_type <> 'view'",
    '{"k": {"$exists": false}}': "k IS NULL",
    '{"tag": {"$gt": 5}}': "false",
}


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS filter, count(*) FILTER ({s}) AS n, count(*) FILTER ({s}) > 5 AS cut FROM e" for t, s in _FILTERS.items())
    + """ UNION ALL SELECT '{"$where": "x"}', NULL, NULL""",
    "e AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events)",
)
def doc_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each distinct filter, all in one pass, and whether the default limit would cut them."""
    docs = table(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k"), F.col("event_type").alias("tag"))
    return doc.match_counts(docs, [*_FILTERS, '{"$where": "x"}', *list(_FILTERS)[:2]])


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 10 AND 20")
def doc_schemaless_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = doc.matches({"k": {"$gte": 10, "$lte": 20}})
    return table(spark, sf_dir, "events").where(test(F.col("props"))).select("event_id")
