"""The checker: small programs, and random ones run with pandas."""

import json
import random

import pandas as pd
import pytest

from sparktrail.checker.interpreter import State, decide
from sparktrail.checker.replay import alternative, replay

SCHEMA = {"payments.csv": ["merchant", "year", "eur_amount"], "merchants.csv": ["merchant", "account"], "fees.json": ["ID", "rate"]}
READ = "import pandas as pd\ndf = pd.read_csv('data/payments.csv')\n"
FEES = "import json\nfees = json.load(open('fees.json'))\n"

BLOCKED = [
    READ + "df['amount']",
    READ + "df[['year', 'x']]",
    READ + "df[df['yeer'] > 1]",
    READ + "d = df[df['year'] > 1]\nd['z']",
    READ + "d = df.rename(columns={'year': 'y'})\nd['year']",
    READ + "d = df.drop(columns=['year'])\nd['year']",
    READ + "df.drop(columns=['nope'])",
    READ + "df.sort_values('nope')",
    READ + "df.groupby('nope')",
    READ + "df.groupby('year')['nope'].sum()",
    READ + "df.set_index('nope')",
    READ + "df.merge(pd.read_csv('merchants.csv'), on='account')",
    READ + "c = 'nope'\ndf[c]",
    READ + "pd.concat([df, df])['nope']",
    "import pandas as pd\npd.read_csv('payments.csv', usecols=['nope'])",
    "import pandas as pd\nbase = 'data/'\npd.read_csv(base + 'payments.csv')['nope']",
    "import pandas as pd, os\npd.read_csv(os.path.join('data', 'payments.csv'))['nope']",
    FEES + "fees[0]['nope']",
    FEES + "for f in fees:\n    print(f['nope'])",
    "import json\nwith open('fees.json') as h:\n    fees = json.load(h)\nfees[0]['nope']",
    READ + "e = df\ne['new'] = 1\ndf['newer']",
    READ + "df.to_dict('records')[0]['nope']",
    "import pandas as pd\ndef load(name):\n    d = pd.read_csv(name)\n    return d[['year']]\nx = load('payments.csv')\nx['merchant']",
    READ + "def add(t, c):\n    t[c] = 1\n    return t\ne = add(df, 'new')\ndf['newer']",
    READ + "def get(c):\n    return df[c]\nget('nope')",
]
RUN = [
    READ + "df['year']",
    READ + "if x:\n    df['amount']",
    READ + "try:\n    df['amount']\nexcept KeyError:\n    pass",
    READ + "df['amount'] = 1\ndf['amount']",
    READ + "e = df\ne['new'] = 1\ndf['new']",
    READ + "change(df)\ndf['amount']",
    READ + "df.columns = list('abc')\ndf['a']",
    READ + "df.rename(columns={'year': 'y'}, inplace=True)\ndf['y']",
    READ + "def f():\n    df['amount'] = 1\nf()\ndf['amount']",
    READ + "x = lambda: df['amount']",
    READ + "exit()\ndf['amount']",
    READ + "df.loc[:, 'q'] = 1\ndf['q']",
    READ + "d = df.assign(z=1)\nd['z']",
    READ + "df.drop(columns=['nope'], errors='ignore')",
    READ + "for c in ['amount']:\n    df[c] = 1\ndf['amount']",
    READ + "while True:\n    break\ndf = other()\ndf['amount']",
    READ + "raise SystemExit\ndf['amount']",
    "import pandas as pd\npd.read_csv('payments.csv', sep=';')['amount']",
    "import pandas as pd\npd.read_csv('unknown.csv')['amount']",
    "import pandas as pd\npd = mine\npd.read_csv('payments.csv')['amount']",
    READ + "m = df.merge(pd.read_csv('merchants.csv'), on='merchant')\nm['account']",
    READ + "df and df['amount']",
    READ + "[r['amount'] for r in rows]",
    READ + "df.reset_index()['index']",
    FEES + "for f in fees:\n    if 'nope' in f:\n        f['nope']",
    FEES + "fees[0].get('nope')",
    FEES + "fees.append({'nope': 1})\nfees[0]['nope']",
    READ + "del df\ndf = make()\ndf['amount']",
    READ + "def add(t, c):\n    t[c] = 1\n    return t\ne = add(df, 'new')\ndf['new']\ne['new']",
    READ + "def add(t):\n    df['new'] = 1\n    return t\nmap(add, x)\nadd(1)\ndf['new']",
    READ + "def load(name):\n    d = pd.read_csv(name)\n    return d\nload = other\nx = load('payments.csv')\nx['nope']",
    READ + "def load(name):\n    return pd.read_csv(name)\nif q:\n    def load(name):\n        return other(name)\nload('payments.csv')['nope']",
    READ + "def load(name, n=1):\n    return pd.read_csv(name)\nload('payments.csv')['nope']",
]


@pytest.mark.parametrize("code", BLOCKED)
def test_blocked(code):
    assert decide(code, SCHEMA)["outcome"] == "block"


@pytest.mark.parametrize("code", RUN)
def test_not_blocked(code):
    assert decide(code, SCHEMA)["outcome"] == "run"


def test_receipt():
    got = decide(READ + "print(df['eur_amont'])\ndf['account']", SCHEMA)
    assert (got["kind"], got["source"], got["missing"], got["location"]) == ("column", "payments.csv", "eur_amont", "line 3")
    assert got["near_matches"] == ["eur_amount"] and got["violations"][1]["found_in"] == ["merchants.csv"]
    assert decide("x = (", SCHEMA)["outcome"] == "unknown"
    got = decide(FEES + "fees[0]['nope']", SCHEMA, tolerant=True)
    assert got["outcome"] == "run" and got["substitutions"][0]["missing"] == "nope"


def test_files():
    known = {"data/payments.csv": True, "gone.csv": False}.get
    assert decide("import pandas as pd\npd.read_csv('gone.csv')", SCHEMA, exists=known)["kind"] == "file"
    assert decide("import pandas as pd\npd.read_csv('else.csv')", SCHEMA, exists=known)["outcome"] == "run"
    assert decide("open('gone.csv', 'w')\nopen('gone.csv')", SCHEMA, exists=known)["outcome"] == "run"
    assert decide("if a:\n    open('gone.csv')", SCHEMA, exists=known)["outcome"] == "run"
    assert decide("import os\nos.listdir('gone.csv')", SCHEMA, exists=known)["outcome"] == "block"
    assert decide("import os\nopen('gone.csv/x', 'w')\nos.listdir('gone.csv')", SCHEMA, exists=known)["outcome"] == "run"
    got = decide("import os\nos.listdir('d')\nopen('x')", SCHEMA)
    assert got["dirs"][0]["path"] == "d" and got["files"][0]["path"] == "x"


def outcomes(*cells):
    state, out = State(), []
    for code, failed in cells:
        out.append(decide(code, SCHEMA, state)["outcome"])
        state.commit(failed)
    return out


def test_state():
    assert outcomes((READ, False), ("df['nope']", False)) == ["run", "block"]
    assert outcomes((READ, True), ("df['nope']", False)) == ["run", "run"]
    assert outcomes((READ, False), ("df['new'] = 1\nboom()", True), ("df['new']", False)) == ["run", "run", "run"]
    assert outcomes((READ, False), ("e = df", True), ("df['nope']", False)) == ["run", "run", "block"]
    assert outcomes((READ, False), ("df = other()", False), ("df['nope']", False)) == ["run", "run", "run"]


def test_any_shape_of_result():
    class R:
        outcome = "BLOCK"

    assert [alternative(x) for x in ("Run", {"decision": "block"}, ("unknown", 1), R())] == ["run", "block", "unknown", "block"]


def test_replay(spark):
    cells = [(1, 2, "df['nope']", True), (1, 1, READ, False), (2, 1, "df['nope']", True), (1, 3, "pd.read_csv('x.csv')\nx = (", True)]
    df = spark.createDataFrame(cells, "trace long, idx int, code string, failed boolean")
    got = {(r["trace"], r["idx"]): r for r in replay(df, SCHEMA).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {(1, 1): "run", (1, 2): "block", (1, 3): "unknown", (2, 1): "run"}
    assert got[1, 2]["missing"] == ["nope"] and got[1, 1]["reads"] == ["data/payments.csv"]
    assert {r["outcome"] for r in replay(df, SCHEMA, carry=False).collect()} == {"run", "unknown"}


def test_random_programs_that_are_blocked_fail(tmp_path, monkeypatch):
    """A blocked program must fail when it is run; most are not blocked."""
    monkeypatch.chdir(tmp_path)
    pd.DataFrame({"merchant": ["a", "b", "a"], "year": [1, 2, 3], "eur_amount": [1.0, 2.0, 3.0]}).to_csv("payments.csv", index=False)
    pd.DataFrame({"merchant": ["a", "b"], "account": ["x", "y"]}).to_csv("merchants.csv", index=False)
    (tmp_path / "fees.json").write_text(json.dumps([{"ID": 1, "rate": 2}, {"ID": 2, "rate": 3}]))
    rng = random.Random(7)
    col = lambda: rng.choice(["merchant", "year", "eur_amount", "account", "nope", "new"])
    var = lambda: rng.choice(["df", "d", "e"])
    steps = [
        lambda: f"{var()} = {var()}[{[col(), col()]!r}]", lambda: f"{var()} = {var()}", lambda: f"{var()}['{col()}'] = 1", lambda: f"print({var()}['{col()}'])",
        lambda: f"{var()} = {var()}.rename(columns={{'{col()}': '{col()}'}})", lambda: f"{var()} = {var()}.drop(columns=['{col()}'])", lambda: f"{var()} = {var()}[{var()}['year'] > 1]",
        lambda: f"if rate > {rng.randint(0, 3)}:\n    {var()}['{col()}'] = 2", lambda: f"try:\n    {var()}['{col()}']\nexcept KeyError:\n    {var()} = d", lambda: f"{var()} = {var()}.merge(m, on='{col()}')",
        lambda: f"{var()} = {var()}.assign({col()}=3)", lambda: f"{var()} = {var()}.sort_values('{col()}').head(2)", lambda: f"{var()}.groupby('{col()}')['{col()}'].count()", lambda: f"{var()} = pd.concat([{var()}, {var()}])",
        lambda: f"def g(t):\n    t['{col()}'] = 1\n    return t\n{var()} = g({var()})", lambda: f"def h(c):\n    x = {var()}[[c, 'year']]\n    return x\n{var()} = h('{col()}')", lambda: f"def k():\n    {var()}['{col()}'] = 1\n    return 1\nk()", lambda: f"fees[0]['{rng.choice(['ID', 'rate', 'nope'])}']", lambda: f"for f in fees:\n    f['{col()}'] = 1", lambda: f"{var()}.drop(columns='{col()}', inplace=True, errors='ignore')",
        lambda: f"{var()} = {var()}.reset_index()", lambda: f"{var()} = {var()}.set_index('{col()}')", lambda: f"del {var()}['{col()}']", lambda: f"{var()}.loc[:, '{col()}'] = 0",
    ]
    head = "import pandas as pd, json\nrate = 1\ndf = pd.read_csv('payments.csv')\nd = df.copy()\ne = pd.read_csv('payments.csv', usecols=['merchant', 'year'])\nm = pd.read_csv('merchants.csv')\nfees = json.load(open('fees.json'))\n"
    blocked = 0
    for _ in range(1500):
        program = head + "\n".join(rng.choice(steps)() for _ in range(rng.randint(1, 6)))
        if decide(program, SCHEMA)["outcome"] != "block":
            continue
        blocked += 1
        with pytest.raises(Exception):
            exec(compile(program.replace("print(", "repr("), "<p>", "exec"), {})  # noqa: S102
    assert blocked > 200


def test_file_evidence(spark):
    from sparktrail.checker.replay import file_evidence

    read = "import pandas as pd\npd.read_csv('{}')"
    cells = [
        (1, 1, read.format("a.csv"), False, None),  # read well here
        (2, 1, read.format("./a.csv"), True, None),  # so it exists for others
        (2, 2, read.format("gone.csv"), True, "/data/gone.csv"),
        (3, 1, read.format("gone.csv"), True, "gone.csv"),
        (4, 1, read.format("alone.csv"), True, "alone.csv"),  # no evidence but its own
        (5, 1, "import pandas as pd\nd = pd.read_csv('a.csv')\nd.to_csv('made.csv')", False, None),
        (5, 2, read.format("made.csv"), True, None),
    ]
    df = spark.createDataFrame([(*c, "s") for c in cells], "trace long, idx int, code string, failed boolean, missing_path string, submitter string")
    schema = {"a.csv": ["x"]}
    got = {(r["trace"], r["idx"]): r["existing"] for r in file_evidence(df, replay(df, schema)).collect()}
    assert got == {(1, 1): {"a.csv": True}, (2, 1): {"./a.csv": True}, (2, 2): {"gone.csv": False}, (3, 1): {"gone.csv": False}, (4, 1): None, (5, 1): {"a.csv": True}, (5, 2): {"made.csv": True}}
    said = {(r["trace"], r["idx"]): r["outcome"] for r in replay(file_evidence(df, replay(df, schema)), schema, existing="existing").collect()}
    assert said[2, 2] == said[3, 1] == "block" and said[4, 1] == said[5, 2] == "run"


def test_a_task_decides_once_for_cells_in_the_same_state():
    from sparktrail.checker import replay as chk
    from sparktrail.checker.interpreter import decide

    codes = ["import pandas as pd\ndf = pd.read_csv('a.csv')", "print(df['y'])", "df['y'] = 1", "other = df", "other['z'] = df['x']", "print(df['z'])", "def f(:", "q = df.rename(columns={'x': 'w'})\nprint(q['x'])"]
    rng, made = random.Random(3), 0
    kept = chk.Decisions({"a.csv": ["x"]}, decide, False, most=50)
    plain = chk.Decisions({"a.csv": ["x"]}, lambda *a: decide(*a), False)
    judge = kept.judge

    def counted(*a):
        nonlocal made
        made += 1
        return judge(*a)

    kept.judge = counted
    for _ in range(60):
        one, two = kept.first(), plain.first()
        for _ in range(20):
            code, failed, known = rng.choice(codes), rng.random() < 0.2, rng.choice([None, {}, {"a.csv": False}])
            one, said = kept.next(code, failed, one, known)
            two, want = plain.next(code, failed, two, known)
            assert said[:-1] == want[:-1] and one.key() == two.key()
        assert len(kept.made) <= 50
    assert made < 1200
    again = [kept.next(codes[0], False, kept.first(), None)[1] for _ in range(2)]
    assert again[0] is again[1]
