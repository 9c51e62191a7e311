import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as hs

from sparktrail.functions import code, documents as doc, statistics as st, text
from sparktrail.operators import existence
from pyspark.sql import functions as F


# --- statistics


def test_sign_test_and_bounds():
    assert st.sign_test(0, 0) is None
    assert st.sign_test(5, 5) == 1.0
    assert st.sign_test(10, 0) == pytest.approx(2 / 1024)
    assert st.upper_bound(0, 50) == pytest.approx(1 - 0.05 ** (1 / 50), abs=1e-9)
    assert st.upper_bound(3, 3) == 1.0 == st.upper_bound(0, 0)


def test_wilcoxon_exact_against_all_signs():
    rng = random.Random(1)
    for n in (3, 6, 9):
        d = [rng.choice([-1, 1]) * (i + rng.random() / 2) for i in range(1, n + 1)]
        rng.shuffle(d)
        ranks = {x: sorted(map(abs, d)).index(abs(x)) + 1 for x in d}
        w = sum(ranks[x] for x in d if x > 0)
        mean = n * (n + 1) / 4
        all_w = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        want = sum(abs(x - mean) >= abs(w - mean) - 1e-9 for x in all_w) / 2**n
        assert st.wilcoxon(np.array(d), np.zeros(n)) == pytest.approx(want)
    assert st.wilcoxon([1, 2], [1, 2]) is None
    assert 0 < st.wilcoxon(np.arange(60) % 7, np.arange(60) % 5) <= 1


def test_bootstrap_conventions_agree_with_theory():
    v = np.random.default_rng(0).normal(3, 2, 400)
    for convention in ("linear", "index", "cluster"):
        low, high = st.bootstrap_interval(v, 4000, 1, convention)
        half = 1.96 * v.std() / 20
        assert low == pytest.approx(v.mean() - half, abs=0.05) and high == pytest.approx(v.mean() + half, abs=0.05)
    assert st.bootstrap_interval(v, 500, 1) == st.bootstrap_interval(v[::-1], 500, 1)
    assert st.sign_flip(v - v.mean(), 2000) > 0.9
    assert st.sign_flip(v, 2000) == pytest.approx(1 / 2001)


def test_random_intercept_recovers_the_parts():
    rng = np.random.default_rng(4)
    group = np.repeat(np.arange(200), 10)
    y = 5 + rng.normal(0, 2, 200)[group] + rng.normal(0, 1, 2000)
    got = st.random_intercept(y, group)
    assert got["mean"] == pytest.approx(5, abs=0.4)
    assert got["group_variance"] == pytest.approx(4, rel=0.25) and got["residual_variance"] == pytest.approx(1, rel=0.1)


def test_fixed_effects_logit_on_counts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(6000):
        task, sub, x = int(rng.integers(8)), int(rng.integers(10)), int(rng.integers(2))
        p = 1 / (1 + math.exp(-(0.7 * x + 0.2 * task - 0.8 + 0.1 * (sub % 3))))
        rows.append((int(rng.random() < p), x, f"t{task}", f"s{sub}"))
    df = spark.createDataFrame(rows, "y int, x int, task string, sub string")
    got = st.fixed_effects_logit(df, "y", "x", ["sub", "task"], "sub")
    assert got["odds_ratio"] == pytest.approx(math.exp(0.7), rel=0.15) and got["low"] < got["odds_ratio"] < got["high"]


def test_poisson_bootstrap_centres_on_the_ratio(spark):
    df = spark.range(2000).select(F.lit("g").alias("by"), (F.col("id") % 3 == 0).cast("int").alias("num"), F.lit(1).alias("den"), F.col("id").alias("unit"))
    reps = [r["ratio"] for r in st.poisson_bootstrap(df, "by", "num", "den", "unit", 200).collect()]
    assert np.mean(reps) == pytest.approx(1 / 3, abs=0.01) and np.std(reps) == pytest.approx(math.sqrt(2 / 9 / 2000), rel=0.3)


def test_wilson_conventions(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "k int, n int")
    low, high = st.wilson("k", "n", clamp=True)
    assert [tuple(r) for r in df.select(low, high).collect()][0] == (0.0, 1.0)
    low, high = st.wilson("k", "n", empty=None)
    assert tuple(df.select(low, high).first()) == (None, None)


# --- document filters

def test_cut_previews(spark):
    df = spark.createDataFrame([('[{"a": 1, "b": 2}, {"a"',), ("[]",), (None,), ('[{"a"',)], "p string")
    assert [r[0] for r in df.select(doc.first_record_keys("p")).collect()] == [["a", "b"], None, None, None]
    df = spark.createDataFrame([('"full \\"x\\""',), ('"cut of',), ("{}",), (None,)], "p string")
    assert [r[0] for r in df.select(doc.preview_text("p")).collect()] == ['full "x"', "cut of", "{}", None]


# --- text rules


def test_error_rules(spark):
    cases = [
        ("KeyError: 'a b'", "KeyError", "a b"),
        ("InterpreterError: Could not index   x\n y with 'zz': KeyError: 'zz'", "index-error(wrapped)", "zz"),
        ("Code failed: KeyError: 'q'", "KeyError(wrapped)", "q"),
        ("Import of os is not allowed", "executor:forbidden", None),
        ("REACHED THE MAX number of operations", "executor:budget", None),
        ("The variable `x` is not defined", "NameError", None),
        ("IndentationError: x", "SyntaxError", None),
        ("ValueError: Usecols do not match columns", "ValueError:usecols", None),
        ("ZeroDivisionError: x", "ZeroDivisionError", None),
        ("no such thing", "other", None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "m string")
    got = [tuple(r) for r in df.select("m", text.error_type("m"), text.error_key("m")).collect()]
    assert got == cases


def test_text_parts(spark):
    one = lambda s, f: spark.createDataFrame([(s,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("\x1b[31mred\x1b[0m a\\nb \\'q\\'", text.plain) == "red a\nb 'q'"
    assert [tuple(x) for x in one("<Code>a</Code>\n<Execute>b</Execute> <Code>c\nd</Code><Execute></Execute>", text.xml_cells)] == [("a", "b"), ("c\nd", "")]
    assert [tuple(x) for x in one("x ```python\na=1\n``` then ```\nb\n``` end", text.fenced_blocks)] == [("a=1\n", " then "), ("b\n", " end")]
    assert one("a\nKeyError: 'x'\nb\nValueError: y\n", text.last_error_line) == "ValueError: y"
    assert one("@a[1] @b[2] @a[3]", text.answer_map) == {"a": "3", "b": "2"}
    assert [tuple(x) for x in one("""d[d['c'] == "v"]; d.k == 'w'; d['m'].isin(['z'])""", text.literal_filters)] == [("c", "v"), ("k", "w"), ("m", "z")]
    assert one("FM2 : Yes", lambda c: text.judge_label(c, 2)) == "yes"
    assert one("I say block now", text.verdict) == "BLOCK"
    assert one("[Errno 2] x 'p/q.csv'", text.missing_path) == "p/q.csv"
    assert one("/mnt/data/x", text.path_class) == "/mnt/data" and one("a/b", text.path_class) == "relative"
    assert one('{"a": ["x", {"b": "y"}], "c": 1}', text.json_leaves) == ["x", "y"] and one("zz", text.json_leaves) == ["zz"]
    assert one("None of [Index(['a', 'b'])] are in the [columns]", text.named_keys) == ["a", "b"] and one("'k'", text.named_keys) == ["k"]
    assert one("eur_amont", text.nearest(["eur_amount", "year"])) == ["eur_amount"]
    assert one("a/../b//c/", existence.normal_path) == "b/c"


def test_mounts(spark):
    df = spark.createDataFrame([("/data/x",), ("/data",), ("/",), ("/etc",)], "p string")
    assert [r[0] for r in df.select(existence.under_mounts(F.col("p"), ["/data"])).collect()] == [None, True, True, False]


# --- program facts


def test_code_facts():
    f = code.facts_of("import pandas as pd\ndf = pd.read_csv('x')\nprint(df.columns)")
    assert f["inspects"] and f["bound"] == ["df", "pd"] and "pd" in f["reads"] and f["undefined"] == []
    assert code.facts_of("print(y)\ndef g(a):\n    return a + zz")["undefined"] == ["y", "zz"]
    assert code.facts_of("open('a', 'w').write('x')")["writes"] == 1 and code.facts_of("open('a', mode='rb')")["writes"] == 0
    assert code.facts_of("final_answer('n/a')")["gave_up"] and not code.facts_of("final_answer(f())")["gave_up"]
    looks = lambda c: code.facts_of(c)["inspects"]
    assert looks("import os\nprint(os.listdir('/x'))") and looks("df = pd.read_csv('x')\nlist(df.columns)\nrepr(df)") and looks("try:\n    df.info()\nexcept Exception:\n    pass")
    assert looks("with open('x') as f:\n    d = f.read()\nd.keys()") and looks("x = df.shape\nfor c in df.columns:\n    print(c)")
    assert not looks("df.value_counts()") and not looks("print(df.x.nunique())") and not looks("x = df.columns\ny = df.sum()") and not looks("print(1)")
    assert not looks("df.columns = ['a']\nz = f(df)") and not looks("while True:\n    df.head()")
    assert not code.facts_of("x = (")["compiles"]
    assert code.facts_of("def final_answer(x): pass")["answers"] and code.facts_of("import os\nos.listdir('.')")["lists_files"]


def test_wrapper_and_environment():
    assert code.wrapped("x = 1") == (True, "same", "x = 1")
    assert code.wrapped("print('a\\\\nb')")[1] == "changed"
    assert code.wrapped("x = 'a\\nb'")[:2] == (True, "inner_syntax")
    assert code.wrapped('y = 1 """\nz = """')[1] != "same"
    assert code.environment_as_names("v = locals()['a'] + globals().get('b-c')", {"a", "b-c"}) == ("v = a + _var_b_c", 2)
    many = "x = locals()['a'] # as \u00e9\ny = [globals()['a'], globals().get('b', locals()['a'])]\nlocals()['a'] = 1\nz = locals()['c']"
    assert code.environment_as_names(many, {"a", "b"}) == ("x = a # as \u00e9\ny = [a, b]\nlocals()['a'] = 1\nz = locals()['c']", 3)
    assert code.environment_as_names("class A:\n    v = globals()['a']\n    w = locals()['a']\nh = lambda: globals().get('a')", {"a"}) == ("class A:\n    v = a\n    w = locals()['a']\nh = lambda: a", 2)
    assert code.environment_as_names("def f():\n    return locals()['a']", {"a"})[1] == 0


def test_answers(spark):
    from sparktrail.functions import answers as ans

    df = spark.createDataFrame([("about 1,200.5 EUR",), ("12 %",), ("-3e2",), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(ans.number(F.col("t"))).collect()] == [1200.5, 0.12, -300.0, None, None]
    assert [r[0] for r in spark.createDataFrame([(101.0, 100.0), (103.0, 100.0), (-101.0, -100.0), (None, 1.0)], "a double, b double").select(ans.close(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    assert ans.protected("final_answer = 3\nfinal_answer(4)") == ("_own_final_answer = 3\nfinal_answer(4)", 1)
    assert ans.protected("def final_answer(x):\n    return x")[1] == 1 and ans.protected("print(1)")[1] == 0 and ans.protected("x (")[1] == 0


def test_runs():
    from sparktrail.operators import runs

    assert runs.answer_code("text ```python\nx = 1\n``` more") == "x = 1\n"
    assert runs.answer_code("final_answer(3)") == "final_answer(3)" and runs.answer_code("x = 3") is None and runs.answer_code("no code") is None


def test_miss_classes(spark):
    from sparktrail.operators import runs

    traces = {
        1: (["df = pd.read_csv('x')", "for i, r in df.iterrows():\n    pass", "df['k']"], "x['key'], x = frame from a reader"),
        2: (["df = pd.read_csv('x')", "for i, r in df.iterrows():\n    pass", "r['k']"], "x['key'], x = row of a DataFrame loop"),
        3: (["df.sort_values('k')"], "key as a method argument (.sort_values)"),
        4: (["f()['k']"], "expr['key'] (derived expression)"),
        5: (["x = 'k'"], "key in another position"),
        6: (["x"], "key not written in this cell"),
        7: (["x ("], "invalid Python"),
        8: (["d['k']"], "x['key'], x = not bound in the trace"),
        9: (["d = json.load(f)", "d = {}", "d = d['k']"], "x['key'], x = subscript or attribute of another object"),
        10: (["def g(d):\n    return d['k']"], "x['key'], x = function argument"),
        11: (["d = load(f)", "x = [d for d in y]", "d = (1, 2)", "d['k']"], "x['key'], x = other"),
        12: (["d['k']", "d = 1"], "x['key'], x = not bound in the trace"),
    }
    rows = [(t, i, c, (c == "d['k']") if t == 12 else i == len(p) - 1, "k", None) for t, (p, _) in traces.items() for i, c in enumerate(p)]
    rows += [(20, 1, "x", True, "", None), (21, 1, "x", True, None, "FileNotFoundError"), (22, 1, "x", True, None, None)]
    df = spark.createDataFrame(rows, "trace long, idx int, code string, failed boolean, key string, error_type string").repartition(5)
    got = {r["trace"]: r["miss"] for r in runs.miss_classes(df).collect()}
    assert got == {t: want for t, (_, want) in traces.items()} | {20: "error text without a key", 21: "missing file"}


def test_after_blocked(spark):
    from sparktrail.operators import runs

    cells = [
        (1, 1, "x = 1", True, False, None, None),
        (1, 2, "x = 2\ny = 3\nprint(df['nope'])", False, True, 3, None),
        (1, 3, "print(x)", True, False, None, None),
        (1, 4, "print(y)", False, False, None, "name 'y' is not defined"),
    ]
    df = spark.createDataFrame(cells, "trace long, idx int, code string, ok boolean, blocked boolean, line int, error string")
    assert [tuple(r) for r in runs.after_blocked(df).collect()] == [(1, 2, True, True, True)]


def test_records_written_as_python_or_as_json():
    assert text.lenient_record("{'a': None, 'b': 1}") == {"a": None, "b": 1}
    assert text.lenient_record('{"a": null, "b": true}') == {"a": None, "b": True}
    assert text.lenient_record("[1]") is None and text.lenient_record(None) is None and text.lenient_record("{") is None


def test_error_events_are_once_a_log(spark):
    fail = "Code execution failed at line 'x' due to: KeyError: 'a'\n"
    log = fail + "." * 3100 + fail + "." * 3100 + "Code execution failed because of the following error:\nValueError: bad\n"
    tail = "Traceback (most recent call last)\nTypeError: no\nTypeError: no\n"
    df = spark.createDataFrame([(1, log), (2, tail), (3, "Code execution failed"), (4, None)], "k int, log string")
    got = sorted((r["k"], r["error_type"], r["error_key"]) for r in text.error_events(df, ["k"], "log").collect())
    assert [g[:2] for g in got] == [(1, "KeyError"), (1, "ValueError"), (2, "TypeError")] and got[0][2] == "a"


def test_wrapped_errors_need_their_key(spark):
    said = ["InterpreterError: Could not index the thing; KeyError: 'abc'", "x" * 195 + " Could not index a with 'k': KeyError: 'k'", "Could not index " + "z\n" * 2000 + " with 'k': KeyError: 'k'", "InterpreterError: Could not index a with 'q'", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, m string")
    got = [tuple(r) for r in df.orderBy("i").select(text.error_type("m"), text.error_key("m")).collect()]
    assert got == [("KeyError(wrapped)", "abc"), ("KeyError(wrapped)", "k"), ("index-error(wrapped)", "k"), ("index-error(wrapped)", "q"), (None, None)]


def test_joins_by_measure_and_by_order(spark):
    from sparktrail.operators import joins

    wide = spark.createDataFrame([(1, "x" * 1000)], "k int, t string")
    assert joins.small(wide)._jdf.queryExecution().logical().toString().lower().count("broadcast") == 1
    assert "broadcast" not in joins.small(wide, size=500)._jdf.queryExecution().logical().toString().lower()
    runs = spark.createDataFrame([(1, "a", 0, 1), (1, "a", 1, 2), (1, "b", 1, 3), (1, "b", 0, 4), (2, "a", 1, 5)], "u int, arm string, v int, line int")
    assert [tuple(r) for r in joins.paired(runs, ["u"], "arm", "v", ("a", "b"), ["line"]).collect()] == [(1, 1, 0)]
    assert [tuple(r) for r in joins.paired(runs, ["u"], "arm", "v", ("a", "b")).collect()] == [(1, 0.5, 0.5)]
    reads = spark.createDataFrame([(1, 1, "x"), (1, 3, "x"), (1, 9, "x"), (2, 5, "x"), (1, 4, None)], "t int, i int, n string")
    made = spark.createDataFrame([(1, 2, "x"), (1, 3, "x"), (1, 2, "x"), (2, 7, "x")], "t int, i int, v string")
    assert sorted((r["t"], r["i"], r["made_by"]) for r in joins.made_before(reads, made, "t", "i", "n", "v").collect()) == [(1, 1, None), (1, 3, 2), (1, 4, None), (1, 9, 3), (2, 5, None)]


def plain_stale(cells):
    """A walk over each stopped cell's later cells."""
    for t, i, sets in [(c[0], c[1], c[2]) for c in cells if c[5]]:
        mine = sorted((c for c in cells if c[0] == t), key=lambda c: c[1])
        known = {n for c in mine if c[1] < i and c[4] for n in c[2]} & sets
        open_, old, said = set(sets), set(known), [t, i, bool(known), False, False]
        for _, j, bound, read, ran, stopped, lost in mine:
            if j <= i or stopped:
                continue
            if ran:
                said[4] |= bool(read & (old - bound))
                open_, old = open_ - bound, old - bound
            else:
                said[3] |= lost in open_
        if sets:
            yield tuple(said)


def test_stale_names_against_a_plain_walk(spark):
    from sparktrail.operators import runs

    rng, some = random.Random(8), lambda: {n for n in "abcd" if rng.random() < 0.3}
    cells = []
    for t in range(40):
        for i in range(rng.randrange(1, 14)):
            kind = rng.choice(["ran", "ran", "stopped", "failed"])
            cells.append((t, i, some() if kind != "failed" else set(), some() if kind == "ran" else set(), kind == "ran", kind == "stopped", rng.choice("abcd") if kind == "failed" else None))
    uses = [(t, i, n, n in b, n in r) for t, i, b, r, ran, _, _ in cells if ran for n in b | r]
    skipped = [(t, i, n) for t, i, b, _, _, stopped, _ in cells if stopped for n in b]
    lost = [(c[0], c[1], c[6]) for c in cells if c[6]]
    frame = lambda rows, more="": spark.createDataFrame(rows, "trace long, idx int, name string" + more)
    got = runs.stale_names(frame(uses, ", bound boolean, read boolean"), frame(skipped), frame(lost))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_stale(cells))
