"""Recorded text to cells in all layouts, and reports over replayed runs and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import code as facts
from ..operators import replays
from ..sources import traces
from ..sources.views import CELLS_SQL, cells
from .registry import query

LAYOUTS = ("xml", "fences", "rounds", "console", "calls")
#: What a failed cell prints, by name; @k is a key of its own.
ERRORS = ("KeyError: '@k'", "NameError: name '@k' is not defined", "FileNotFoundError: [Errno 2] No such file or directory: 'data/@k.csv'", "ValueError: bad @k")


def _with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("k", F.concat(F.lit("c"), (F.col("trace") * 31 + F.col("idx")) % 97))
    message = F.replace(F.element_at(F.array(*map(F.lit, ERRORS)), F.col("name") % 4 + 1), F.lit("@k"), F.col("k"))
    return rows.withColumn("error", message)


_ERROR_SQL = f"""told AS (SELECT *, replace([{", ".join("'" + e.replace("'", "''") + "'" for e in ERRORS)}][name % 4 + 1], '@k', k) AS error FROM (SELECT *, 'c' || (trace * 31 + idx) % 97 AS k FROM cells))"""


def _written(code: Column, failed: Column, error: Column) -> dict[str, Column]:
    """A cell as each layout writes it."""
    traceback = F.concat(F.lit("Traceback (most recent call last)\n  File x\n"), error, F.lit("\n"))
    said = F.when(failed, traceback).otherwise("fine\n")
    cell = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    step = F.struct(F.array(F.struct(F.struct(F.lit("python_interpreter").alias("name"), code.alias("arguments")).alias("function"))).alias("tool_calls"), F.when(failed, "").otherwise("fine").alias("observations"), F.when(failed, cell("Code failed due to: ", error)).alias("error"))
    return {
        "xml": cell("thought <Code>", code, "</Code>\n<Execute>", said, "</Execute>\n"),
        "fences": cell("thought\n```py\n", code, "\n```\n", said),
        "rounds": cell("## Model round 7\n```py\n", code, "\n```\n### 代码块 1 执行结果 (exit=", F.when(failed, "1").otherwise("0"), ")\n", said),
        "console": cell("```py\n", code, "\n```\nExecuting this code\n", "─" * 30, "\n", F.when(failed, cell("Code execution failed at line 1 due to: ", error)).otherwise("Execution logs: 3"), "\n[Step 2]\n"),
        "calls": F.to_json(step),
    }


@query(
    f"""SELECT trace, idx - 1 AS cell_index, ({list(LAYOUTS)!r})[trace % 5 + 1] AS layout, 'x' || idx || ' = ' || name || chr(10) || 'print(x' || idx || ')' AS code, failed,
        CASE WHEN failed THEN ['KeyError', 'NameError', 'FileNotFoundError', 'ValueError'][name % 4 + 1] END AS error_type, CASE WHEN failed AND name % 4 = 0 THEN k END AS error_key FROM told""",
    CELLS_SQL, _ERROR_SQL,
)
def src_trace_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace is written as one text, in one of five layouts, and taken apart: its layout, its cells, and the class and key of each failure."""
    code = F.concat(F.lit("x"), "idx", F.lit(" = "), "name", F.lit("\nprint(x"), "idx", F.lit(")"))
    texts = _written(code, F.col("failed"), F.col("error"))
    at = F.col("trace") % len(LAYOUTS)
    step = F.coalesce(*[F.when(at == i, texts[name]) for i, name in enumerate(LAYOUTS)])
    steps = _with_error(spark, sf_dir).groupBy("trace").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", step.alias("step")))), lambda s: s["step"]).alias("s"))
    text = F.when(at == LAYOUTS.index("calls"), F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]"))).otherwise(F.array_join("s", ""))
    read = traces.trace_cells(steps.select("trace", text.alias("text")), ["trace"], "text")
    return read.select("trace", "cell_index", "layout", F.rtrim(F.col("code"), F.lit("\n")).alias("code"), "failed", "error_type", "error_key")


@query(
    """SELECT class, count(*) AS n FROM (SELECT *, CASE WHEN gone THEN 'not_replayed' WHEN NOT fails THEN 'no_error'
            WHEN name % 4 = 0 AND idx % 3 <> 2 AND idx % 2 = 0 OR name % 4 = 2 AND idx % 3 = 2 AND idx % 2 = 0 THEN 'confirmed' WHEN lost THEN 'not_replayed' ELSE 'other_error' END AS class
        FROM (SELECT *, coalesce(max(CAST(lost AND kind <> 'signup' AS INT)) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone
            FROM (SELECT *, (trace * 7 + idx * 13) % 89 = 0 AS lost, name < 9 AS fails FROM cells)) WHERE kind = 'signup') GROUP BY 1""",
    CELLS_SQL,
)
def mis_block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped cells run anew: was the error of the receipt met?"""
    rows = _with_error(spark, sf_dir)
    right = F.col("idx") % 2 == 0
    name = F.when(right, F.col("k")).otherwise(F.concat("k", F.lit("_")))
    fails = F.col("name") < 9
    rows = rows.select(
        "trace", "idx",
        (F.col("kind") == "signup").alias("blocked"),
        ((F.col("trace") * 7 + F.col("idx") * 13) % 89 == 0).alias("lost"),
        (~fails).alias("ok"),
        F.when(fails, F.col("error")).alias("error"),
        F.element_at(F.array(*map(F.lit, ("column", "key", "file"))), F.col("idx") % 3 + 1).alias("kind"),
        name.alias("missing"),
        F.concat(F.lit("./other/../data//"), name, F.lit(".csv")).alias("source"),
    )
    return replays.block_classes(rows, ["trace"]).groupBy("class").agg(F.count("*").alias("n"))


_WIDE = "CASE WHEN NOT failed AND kind <> 'view' THEN idx END", "CASE WHEN NOT failed AND kind NOT IN ('view', 'click') THEN idx END"


@query(
    """SELECT mode, sum(stopped)::BIGINT AS stopped, sum(lost)::BIGINT AS not_reproduced, sum(kept)::BIGINT AS kept, sum(pairs)::BIGINT AS pairs, count(mean) AS units, avg(mean) AS mean FROM (
        SELECT mode, episode, count(*) FILTER (NOT seen) AS stopped, count(*) FILTER (seen AND NOT again) AS lost, count(*) FILTER (use AND NOT done) AS kept, count(*) FILTER (use) AS pairs, avg(d) FILTER (use) AS mean FROM (
            SELECT m || ':' || k AS mode, episode, done, again, CASE WHEN m = 'stopped_kept' THEN true ELSE done END AS seen,
                again AND CASE m WHEN 'stopped_kept' THEN true WHEN 'primary' THEN done ELSE done AND matches END AS use, CASE k WHEN 'fix' THEN d1 ELSE d2 END AS d
            FROM pr, (SELECT unnest(['primary', 'stopped_kept', 'exact_prefix']) AS m), (SELECT unnest(['fix', 'wide']) AS k)) GROUP BY 1, 2) GROUP BY 1""",
    CELLS_SQL,
    f"r AS (SELECT trace, trace // 4 AS episode, trace // 2 % 2 AS seed, trace % 2 AS arm, coalesce(min({_WIDE[0]}), 7) AS f1, coalesce(min({_WIDE[1]}), 7) AS f2, trace % 11 <> 0 AS done, trace % 7 <> 0 AS again, trace % 3 <> 0 AS matches FROM cells GROUP BY trace)",
    "pr AS (SELECT a.episode, a.seed, a.done AND b.done AS done, a.again, a.matches AND b.matches AS matches, a.f1 - b.f1 AS d1, a.f2 - b.f2 AS d2 FROM r a JOIN r b ON a.episode = b.episode AND a.seed = b.seed AND a.arm = 0 AND b.arm = 1)",
)
def mis_receipt_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps to a fix after a traceback against after a receipt, in three modes of inclusion, and with clicks counted as looking only."""
    t = F.col("trace")
    first = lambda looks: F.coalesce(F.min(F.when(~F.col("failed") & ~F.col("kind").isin(*looks), F.col("idx"))), F.lit(7))
    runs = cells(spark, sf_dir).groupBy("trace").agg(first(["view"]).alias("fix"), first(["view", "click"]).alias("wide"))
    runs = runs.select(
        F.floor(t / 4).alias("episode"), (F.floor(t / 2) % 2).alias("seed"), F.when(t % 2 == 0, "traceback").otherwise("receipt").alias("arm"), "fix", "wide",
        (t % 11 != 0).alias("done"), (t % 7 != 0).alias("reproduced"), (t % 3 != 0).alias("matches"),
    )
    return replays.paired_replays(runs, "episode", "seed", "arm", ("traceback", "receipt"), {"fix": F.col("fix"), "wide": F.col("wide")})


_PROBES = """probe AS (SELECT probe, step, harness, n % 3 > 0 AS ok, repeat('x', (n * 23)::INT) || '[cut ' || harness % 2 || ']' AS text FROM (SELECT kind AS probe, name AS step, submitter AS harness, count(*) AS n FROM cells GROUP BY 1, 2, 3)),
    ways AS (SELECT probe, step, way, count(*) AS n, count(*) FILTER (ok) AS passed FROM (SELECT *, CASE WHEN ok THEN 'ok: ' ELSE 'failed: ' END || CASE WHEN length(text) <= 160 THEN text ELSE substr(text, 1, 160) || '...[' || length(text) || ' chars]' END AS way FROM probe) GROUP BY ALL)"""


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).groupBy(F.col("kind").alias("probe"), F.col("name").alias("step"), F.col("submitter").alias("harness")).agg(F.count("*").alias("n"))
    text = F.concat(F.repeat(F.lit("x"), (F.col("n") * 23).cast("int")), F.lit("[cut "), F.col("harness") % 2, F.lit("]"))
    return rows.select("probe", "step", "harness", (F.col("n") % 3 > 0).alias("ok"), text.alias("text"))


@query("SELECT probe, step, sum(n)::BIGINT AS harnesses, sum(passed)::BIGINT AS passed, count(*) AS ways, count(*) = 1 AS alike, first(way ORDER BY n DESC, way) AS usual, (sum(n) - max(n))::BIGINT AS others FROM ways GROUP BY 1, 2", CELLS_SQL, _PROBES)
def mis_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same program in each harness: do they agree, and how many give another outcome than most?"""
    return replays.compared(_probed(spark, sf_dir), ["probe", "step"], "harness")


@query("SELECT probe, step, harness, length(text)::INT AS returned_chars, (length(text) - 7)::INT AS letters, '[cut ' || harness % 2 || ']' AS marker FROM probe", CELLS_SQL, _PROBES)
def mis_probe_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a long output comes back, and with which marker."""
    return _probed(spark, sf_dir).select("probe", "step", "harness", *replays.returned(F.col("text")))


#: Programs by name, and whether they set or unset the answer's name.
_TOUCHES = {"final_answer = @k": 1, "import x@k as final_answer": 1, "def final_answer(a):\n    return '@k'": 1, "print('@k')": 0, "final_answer('@k')": 0, "x@k = 'final_answer'": 0, "final_answer(": 0}


@query(
    f"""SELECT trace, CASE WHEN none THEN CASE WHEN touched THEN 'no answer, name touched' ELSE 'no answer' END ELSE 'name touched' END AS why FROM (
        SELECT trace, trace % 4 = 0 AS none, bool_or({list(_TOUCHES.values())}[(name * 3 + idx // 20) % 7 + 1] = 1 AND kind = 'purchase' AND idx % 8 = 0) AS touched FROM cells GROUP BY trace) WHERE none OR touched""",
    CELLS_SQL,
)
def mis_runs_to_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without an answer, or in which a cell that ran touches its name. Equal programs are parsed once."""
    rows = cells(spark, sf_dir)
    code = F.replace(F.element_at(F.array(*map(F.lit, _TOUCHES)), ((F.col("name") * 3 + F.floor(F.col("idx") / 20)) % 7 + 1).cast("int")), F.lit("@k"), F.col("trace").cast("string"))
    rows = rows.select("trace", F.when(F.col("idx") % 8 == 0, code).alias("code"), (F.col("kind") != "purchase").alias("blocked"), F.when(F.col("trace") % 4 > 0, "a").alias("answer"))
    known = rows.where("code is not null").select("code").distinct().select("code", facts.facts("code")["answers"].alias("touches"))
    return replays.to_replay(rows.join(known, "code", "left"), ["trace"])
