"""The checker over recorded traces: a fold per trace, in order of the cells."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.existence import normal_path, same_path
from .interpreter import State, decide

PREDICTION = "trace long, idx int, failed boolean, outcome string, kind string, source string, missing array<string>, location string, found_in array<string>, near_matches array<string>, reads array<string>, written array<string>, ms double"


def alternative(result) -> str:
    """The outcome of any checker's result: a text, a dict, a tuple that begins with one, or an object with an attribute."""
    if isinstance(result, dict):
        result = next((result[k] for k in ("outcome", "decision", "result", "status") if k in result), result)
    elif isinstance(result, (tuple, list)) and result:
        result = result[0]
    elif not isinstance(result, str):
        result = next((getattr(result, k) for k in ("outcome", "decision", "result") if hasattr(result, k)), result)
    return str(result).lower()


class Decisions:
    """The decisions of a task, and the states they lead to, each made once while it is kept.

    States that hold the same are one object, which is not changed any more, so that
    traces that come to it by different ways share what follows. When
    more than `most` decisions or `room` characters of programs are kept, all are
    given up and it begins anew. Only `decide` is known to say the same again; another check is asked each time.
    """

    def __init__(self, schema: dict[str, list[str]], check: Callable, tolerant: bool, most: int = 20_000, room: int = 8_000_000):
        self.schema, self.check, self.tolerant, self.most, self.room = schema, check, tolerant, most, room
        self.clear()

    def clear(self) -> None:
        self.made, self.states, self.held = {}, {}, 0

    def first(self) -> State:
        return self.one(State()) if self.check is decide else State()

    def one(self, state: State) -> State:
        return self.states.setdefault(state.key(), state)

    def next(self, code: str, failed: bool, state: State | None, known: dict | None) -> tuple[State | None, tuple]:
        """The state after a cell, and what is said of it from the outcome on."""
        if self.check is not decide:
            return state, self.judge(code, failed, state, known)
        # a state kept in a key can't be given up, so its id stays its own
        key = (code, failed, state and id(state), None if known is None else tuple(sorted(known.items())))
        got = self.made.get(key)
        if got is None:
            after = State(dict(state.names)) if state is not None else None
            said = self.judge(code, failed, after, known)
            if len(self.made) >= self.most or self.held > self.room:
                self.clear()
            got = self.made[key] = (after and self.one(after), said, state)
            self.held += len(code)
        return got[:2]

    def judge(self, code: str, failed: bool, state: State | None, known: dict | None) -> tuple:
        """What is said of a cell, whose state goes on."""
        began = time.perf_counter()
        try:
            got = self.check(code, self.schema, state, known.get if known is not None else None, self.tolerant)
            outcome = alternative(got)
        except Exception as e:  # a defect of the checker is a result of its own
            got, outcome = {"reason": repr(e)}, "checker_error"
        ms = (time.perf_counter() - began) * 1000
        if state is not None:
            # a blocked cell would have failed
            state.commit(failed or outcome == "block")
        found = got.get("violations") or []
        return (outcome, got.get("kind"), got.get("source"), sorted({v["missing"] for v in found}), got.get("location"), got.get("found_in") or [], got.get("near_matches") or [], sorted({f["path"] for f in got.get("files") or () if not f["conditional"]}), got.get("written") or [], ms)


def replay(cells: DataFrame, schema: dict[str, list[str]], carry: bool = True, tolerant: bool = False, check: Callable = decide, existing: str | None = None) -> DataFrame:
    """A prediction for each cell (trace, idx, code, failed). `existing` names a map<string,boolean> column of paths that are known to exist or not.

    Cells are dealt by trace and sorted, and each partition is read as a stream:
    the state of one trace at a time is held, whatever its length. The number of
    partitions is kept as it is set, since the work is in Python and the rows
    are small. What `decide` says follows from the program, the state and the
    files that are known, so a task keeps its last decisions and does not make the
    same one again; a repeated cell has the ms of the decision it repeats.
    """
    columns = ["trace", "idx", "code", "failed", *([existing] if existing else [])]
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        kept = Decisions(schema, check, tolerant)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.trace != at:
                    at, state = r.trace, kept.first() if carry else None
                state, said = kept.next(r.code or "", bool(r.failed), state, dict(getattr(r, existing) or {}) if existing else None)
                out.append((r.trace, r.idx, bool(r.failed), *said))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PREDICTION.split(", ")])

    return cells.select(*columns).repartition(n, "trace").sortWithinPartitions("trace", "idx").mapInPandas(fold, PREDICTION)


def file_evidence(cells: DataFrame, first: DataFrame) -> DataFrame:
    """Adds `existing` (path to true or false) to cells (trace, idx, submitter, failed, missing_path), from a first pass without files.

    For each path that a cell surely reads: true if an earlier cell of its trace
    wrote it, or another cell of the submitter read it without failing; false if
    another one failed for want of it; else it is not in the map. A cell is never
    its own evidence. Paths are compared normalised, and a recorded one also by
    the end of a longer one.
    """
    who = cells.select("trace", "idx", "submitter", "missing_path")
    seen = first.select("trace", "idx", "failed", "reads", "written").join(who, ["trace", "idx"])
    reads = seen.select("trace", "idx", "submitter", "failed", "missing_path", F.explode("reads").alias("raw")).withColumn("path", normal_path("raw"))
    named = normal_path("missing_path")
    lost = F.col("failed") & F.col("missing_path").isNotNull() & F.coalesce(same_path(F.col("path"), named), F.lit(False))
    marks = reads.select("trace", "idx", "submitter", "raw", "path", (~F.col("failed")).alias("fine"), lost.alias("lost"))
    total = marks.groupBy("submitter", "path").agg(F.count_if(F.col("fine")).alias("n_fine"), F.count_if(F.col("lost")).alias("n_lost"))
    wrote = seen.select("trace", "idx", F.explode("written").alias("w")).groupBy("trace", normal_path("w").alias("path")).agg(F.min("idx").alias("wrote"))
    known = marks.join(total, ["submitter", "path"]).join(wrote, ["trace", "path"], "left")
    there = (
        F.when(F.col("wrote") < F.col("idx"), True)
        .when(F.col("n_fine") - F.col("fine").cast("int") > 0, True)
        .when(F.col("n_lost") - F.col("lost").cast("int") > 0, False)
    )
    maps = known.withColumn("there", there).where("there is not null").groupBy("trace", "idx").agg(F.map_from_entries(F.collect_set(F.struct("raw", "there"))).alias("existing"))
    return cells.join(maps, ["trace", "idx"], "left")


def cause_match(missing: str, error_key: str) -> Column:
    """A block names the key or path that the recorded error names."""
    return F.coalesce(F.array_contains(missing, F.col(error_key)), F.lit(False))


def named_cause(named: Column, error_type: Column, error_key: Column, path: Column) -> Column:
    """What a verdict names is what the recorded error names: a key, also in brackets and quotes, or a path, also by its end or its base name."""
    bare = F.btrim(named, F.lit("[]'\"` "))
    key = error_type.isin("KeyError", "KeyError(wrapped)", "index-error(wrapped)") & (bare == error_key)
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    file = (error_type == "FileNotFoundError") & (same_path(bare, path) | (base(bare) == base(path)))
    return F.coalesce(key, F.lit(False)) | F.coalesce(file, F.lit(False))


def scores(predictions: DataFrame) -> DataFrame:
    """caught (blocked with the right cause), blocks of cells that were fine, and shares of each."""
    data = F.col("failed") & F.col("data_reference")
    caught = F.count_if(data & (F.col("outcome") == "block") & F.col("cause"))
    wrong = F.count_if(~F.col("failed") & (F.col("outcome") == "block"))
    n_data, n_ok = F.count_if(data), F.count_if(~F.col("failed"))
    return predictions.agg(
        F.count("*").alias("cells"),
        n_data.alias("data_failures"),
        caught.alias("caught"),
        n_ok.alias("fine"),
        wrong.alias("blocked_fine"),
        (caught.cast("double") / F.greatest(n_data, F.lit(1))).alias("recall"),
        (wrong.cast("double") / F.greatest(n_ok, F.lit(1))).alias("false_block_rate"),
    )
