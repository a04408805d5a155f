"""Units, instants, durations, complex numbers, patterns, SQL text, documents."""

import json
import random
import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleloom.functions import regex as rx
from ruleloom.operators import complexnum as cx
from ruleloom.operators import values as val
from ruleloom.plans import build as B
from ruleloom.plans import nodes
from ruleloom.plans import rules as R
from ruleloom.plans import schemas
from ruleloom.plans import sqltext
from ruleloom.sources import cli
from ruleloom.sources.bindings import ColumnBinding, Scope
from ruleloom.sources.document import evaluate_document

INSTANTS = [
    "2020", "2020-02", "2020-02-29", "2021-02-29", "2020-01-01T00:00Z", "2020-01-01T24:00:00Z", "2020-01-01T24:00:01Z", "2020-01-01T10:20:30.1239+01:30", "2020-01-01T10:20", "now", "",
    "+275760-09-13T00:00:00.000Z", "+275760-09-13T00:00:00.001Z", "-000000", "-000001-12-31T23:59:59.999Z", "2020-13-01", "2020-01-01T10:60Z", " 2020", "2020-01-01T10:20:30+0100", "0000-02-29", "1900-02-29",
]


def test_instants_of_columns_agree_with_the_parser(spark):
    got = spark.createDataFrame([(x,) for x in INSTANTS], "t string").select("t", val.instant_of_text(F.col("t")).alias("ms")).collect()
    assert {r.t: r.ms for r in got} == {x: val.parse_instant(x) for x in INSTANTS}


@given(st.integers(-val.INSTANT_LIMIT, val.INSTANT_LIMIT))
@settings(max_examples=200, deadline=None)
def test_instants_round_trip(ms):
    assert val.parse_instant(val.format_instant(ms)) == ms


def test_durations_compare_exactly(spark):
    cases = [(0.1, "h", 6.0, "min"), (1 / 3, "d", 8.0, "h"), (0.3, "s", 300.0, "ms"), (5e-324, "d", 0.0, "ms"), (1e300, "d", 1e300, "ms"), (24.0, "h", 1.0, "d"), (-0.7, "min", -42.0, "s")]
    for a, ua, b, ub in cases:
        exact = Fraction(a) * val.MILLIS[ua] - Fraction(b) * val.MILLIS[ub]
        got = spark.range(1).select(val.duration_order(F.lit(a), ua, F.lit(b), ub)).first()[0]
        assert got == (exact > 0) - (exact < 0), (a, ua, b, ub)


def test_complex_numbers_agree_with_python(spark):
    pairs = [(1 + 2j, 3 - 4j), (1e200 + 1e200j, 1e200 - 1e200j), (-1e-200j, 2e-200 + 0j), (5 + 0j, -2 + 1j)]
    df = spark.createDataFrame([(x.real, x.imag, y.real, y.imag) for x, y in pairs], "a double, b double, c double, d double")
    z, w = cx.make(F.col("a"), F.col("b")), cx.make(F.col("c"), F.col("d"))
    for r, (x, y) in zip(df.select(cx.divide(z, w).alias("q"), cx.square_root(z).alias("s"), cx.magnitude(z).alias("m")).collect(), pairs):
        assert abs(complex(r.q.re, r.q.im) - x / y) < 1e-14 * abs(x / y)
        assert abs(complex(r.s.re, r.s.im) ** 2 - x) < 1e-13 * abs(x)
        assert abs(r.m - abs(x)) < 1e-14 * abs(x)
    powers = R.with_value(spark.range(1), "v", B.arith("power", B.lit(1 + 2j), B.lit(-5)), ).first().v
    assert abs(complex(powers.re, powers.im) - (1 + 2j) ** -5) < 1e-15


ATOMS = ["a", "b", ".", "\\d", "[ab]", "[^a]", "(?:a|bc)", "\\n", "\\.", "(?:x{2})"]


@given(st.lists(st.tuples(st.sampled_from(ATOMS), st.sampled_from(["", "", "*", "+", "?", "{1,2}"])), max_size=5), st.booleans(), st.booleans(), st.text("abcx1.\n", max_size=8))
@settings(max_examples=400, deadline=None)
def test_matcher_agrees_with_a_backtracking_one(parts, start, end, text):
    body = "".join(a + q for a, q in parts)
    pattern = "^" * start + body + "$" * end
    ours = rx.test_pattern(pattern, text)
    theirs = re.search("\\A" * start + body.replace(".", "[\\s\\S]").replace("\\[\\s\\S]", "\\.") + "\\Z" * end, text, re.ASCII)
    assert ours == bool(theirs)


def test_patterns_in_spark_agree_with_the_matcher(spark):
    texts = ["", "a", "ab", "a\nb", "😀", "x😀y", "aaaa", "b1", "A.b"]
    patterns = ["^.$", "^..$", "a.b", "^a*$", "[^a]", "\\d$", "^(?:a|b)+$", "(?:a+)+$", "^x", "b$", "a", "^$", "\\.", "[^\\s\\S]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = R.with_values(df, {f"p{i}": B.text_compare("portableMatches", B.ref("t"), B.lit(p)) for i, p in enumerate(patterns)})
    for r in out.collect():
        for i, p in enumerate(patterns):
            assert r[f"p{i}"] == rx.test_pattern(p, r.t), (p, r.t)
    dyn = spark.createDataFrame([("ab", "^a"), ("ab", "("), (None, "a")], "t string, p string")
    got = R.with_verdict(dyn, "v", B.text_compare("matches", B.ref("t"), B.ref("p"))).collect()
    assert [(r.v.value, r.v.code) for r in got] == [(True, None), (None, "wrong-type"), (None, "not-found")]


def test_work_is_bounded():
    machine = rx.compile_pattern("^(?:a+)+$")
    assert not machine.test("a" * 3000 + "b")
    with pytest.raises(rx.InputTooLarge):
        machine.test("a" * 1_000_001)


def test_derived_patterns(spark):
    df = spark.createDataFrame([("ls",), ("ls -la",), ("lsof",), ("a/b/c",), ("a/b",), ("x*y",)], "t string")
    t = B.ref("t")
    out = R.with_values(df, {"p": B.prefix_pattern(t, "ls"), "w": B.wildcard_pattern(t, "ls *"), "g": B.glob_pattern(t, "a/*"), "gg": B.glob_pattern(t, "a/**"), "e": B.wildcard_pattern(t, "x\\*y")}).collect()
    assert {k: [r.t for r in out if r[k]] for k in ("p", "w", "g", "gg", "e")} == {"p": ["ls", "ls -la"], "w": ["ls", "ls -la"], "g": ["a/b"], "gg": ["a/b/c", "a/b"], "e": ["x*y"]}


def test_sql_text_agrees_with_columns(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, float("nan"), None), (4, -1.0, "ab")], "id int, x double, s string")
    kids = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0), (4, 0.0)], "pid int, w double")
    df.createOrReplaceTempView("sql_rows")
    kids.createOrReplaceTempView("sql_kids")
    from ruleloom.sources.bindings import ChildTable, Scope

    scope = Scope(collections={"kids": ChildTable(kids, ["id"], ["pid"])})
    columns = {"x": sqltext.SqlColumn("o.x", "number"), "s": sqltext.SqlColumn("o.s", "text")}
    held = {"kids": sqltext.SqlCollection("sql_kids", "pid = o.id", {"w": sqltext.SqlColumn("w", "number")})}
    w = B.ref("w")
    trees = [
        B.compare("gt", B.ref("x"), B.lit(0)), B.compare("neq", B.ref("x"), B.lit(5)), B.member_of("in", B.ref("s"), [B.lit("a"), B.lit(1)]), B.member_of("notIn", B.ref("x"), []),
        B.text_compare("portableMatches", B.ref("s"), B.lit("^a")), B.text_compare("portableNotMatches", B.ref("s"), B.lit("^a")), B.exists(B.ref("x")), B.some("kids", B.compare("gt", w, B.lit(2))),
        B.every("kids", B.compare("gt", w, B.lit(0)), B.exists(w)), B.compare("gt", B.fold("kids", "max", w), B.lit(0)), B.compare("gt", B.ref("s"), B.lit(1)), B.all_of(), B.any_of(),
    ]
    for tree in trees:
        for t in (tree, B.not_(tree)):
            text, params = sqltext.compile_sql(t, columns, held)
            got = sorted(r.id for r in spark.sql(f"SELECT id FROM sql_rows o WHERE {text}", args=params).collect())
            assert got == sorted(r.id for r in R.filter_rows(df, t, scope).select("id").collect()), (t, text)


def test_sql_text_with_many_parameters(spark):
    """Random trees of more than twenty literals, against the column form; NaN and NULL among the values."""
    rng = random.Random(4)
    nan = float("nan")
    data = [(i, rng.choice([None, nan, 0.0, 1.0, 2.5, -3.0]), rng.choice([None, nan, 1.0, 2.5]), rng.choice([None, "", "a", "ab", "b"])) for i in range(60)]
    df = spark.createDataFrame(data, "id int, x double, y double, s string")
    df.createOrReplaceTempView("sql_random")
    columns = {"x": sqltext.SqlColumn("x", "number"), "y": sqltext.SqlColumn("y", "number"), "s": sqltext.SqlColumn("s", "text")}

    def leaf():
        number = lambda: rng.choice([B.ref("x"), B.ref("y"), B.lit(rng.choice([0, 1, 2.5, -3]))])
        kind = rng.randrange(5)
        if kind == 0:
            return B.compare(rng.choice(["gt", "gte", "lt", "lte", "eq", "neq"]), number(), number())
        if kind == 1:
            return B.member_of(rng.choice(["in", "notIn"]), number(), [number() for _ in range(3)] + [B.lit("a")] * rng.randrange(2))
        if kind == 2:
            return B.member_of(rng.choice(["in", "notIn"]), B.ref("s"), [B.lit(c) for c in rng.sample(["", "a", "b", "q"], 3)])
        if kind == 3:
            return B.text_compare(rng.choice(["equals", "notEquals", "portableMatches", "portableNotMatches"]), B.ref("s"), B.lit(rng.choice(["a", "b", "q"])))
        return B.exists(B.ref(rng.choice("xys")))

    trees = {}
    for k in range(25):
        parts = [leaf() for _ in range(14)]
        while len(parts) > 1:
            a, b = parts.pop(), parts.pop()
            parts.insert(0, rng.choice([B.and_, B.or_])(a, B.not_(b) if rng.random() < 0.3 else b))
        trees[f"t{k}"] = parts[0]
    want = R.with_values(df, trees).collect()
    most = 0
    for name, tree in trees.items():
        text, params = sqltext.compile_sql(tree, columns)
        most = max(most, len(params))
        got = {r.id: r.v for r in spark.sql(f"SELECT id, {text} AS v FROM sql_random", args=params).collect()}
        assert got == {r.id: r[name] for r in want}, text
    assert most > 20


def test_numbers_against_nothing_are_unknown(spark):
    df = spark.createDataFrame([(float("nan"), None), (float("nan"), 1.0)], "x double, y double")
    trees = {op: B.compare(op, B.ref("x"), B.ref("y")) for op in ("gt", "eq", "neq")}
    scope = Scope({"x": ColumnBinding("x", "duration", "s"), "y": ColumnBinding("y", "duration", "min")})
    for s in (None, scope):
        got = R.with_values(df, trees, s).select(*trees).collect()
        assert [tuple(r) for r in got] == [(None, None, None), (False, False, True)]


def test_number_texts_and_canonical_json(spark):
    cases = {1.0: "1", -0.0: "0", 0.1: "0.1", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 5e-324: "5e-324", -1234.5: "-1234.5", float("inf"): "Infinity"}
    assert {x: val.number_text(x) for x in cases} == cases and val.number_text(float("nan")) == "NaN"
    df = spark.createDataFrame([(x,) for x in [*cases, None]], "x double")
    assert [r.t for r in df.select(val.text_of_number(F.col("x")).alias("t")).collect()] == [*cases.values(), None]
    assert nodes.canonical({"b": 1.0, "a": [1e30, True, None, "é\n"]}) == '{"a":[1e+30,true,null,"é\\n"],"b":1}' == nodes.canonical({"a": [10**30, True, None, "é\n"], "b": 1})
    assert nodes.canonical({"\ufb33": 1, "\U0001f600": 2}) == '{"\U0001f600":2,"\ufb33":1}'
    assert val.units_equal({"m": 1, "s": 0}, {"m": 1.0}) and val.divided({"m": 1}, {"m": 1, "s": 1}) == {"s": -1}


def test_verdict_helpers(spark):
    df = spark.range(2).select(R.definite(F.lit(1.5)).alias("a"), R.indeterminate("domain-error", "no", "number").alias("b"), R.definite(F.col("id")).alias("c"))
    r = df.select("a", "b", R.first_indeterminate(F.col("a"), F.col("b"), F.col("b")).alias("f"), R.first_indeterminate(F.col("a"), F.col("c")).alias("none")).first()
    assert (r.a.value, r.a.code, r.b.value, tuple(r.f), r.none) == (1.5, None, None, ("domain-error", "no"), None)
    with pytest.raises(ValueError):
        R.indeterminate("other", "")
    z = spark.range(1).select(cx.from_polar(F.lit(2.0), F.lit(0.5)).alias("z")).select(cx.magnitude(F.col("z")).alias("m"), cx.phase(F.col("z")).alias("p")).first()
    assert (z.m, z.p) == (pytest.approx(2.0), pytest.approx(0.5))


def test_named_schemas():
    assert len(schemas.NAMES) == 43
    eq = B.compare("eq", B.ref("a"), B.lit(1))
    good = {
        "CompareNodeSchema": eq, "NotNodeSchema": B.not_(eq), "PredicateNodeSchema": eq, "ExpressionNodeSchema": B.lit(2), "TreeReferenceNodeSchema": B.tree("k"), "UnitSchema": {"m": 2, "s": 0},
        "ComputedValueSchema": {"kind": "duration", "value": 2, "unit": "h", "more": 1}, "IndeterminateReasonSchema": {"code": "not-found", "message": ""}, "HitPolicySchema": "unique",
        "ComplexPolarLiteralNodeSchema": {"kind": "complexLiteral", "magnitude": 1, "phase": 2}, "ComplexRectangularLiteralNodeSchema": {"kind": "complexLiteral", "re": 1, "im": 2},
        "ConditionalCaseSchema": {"when": eq, "then": B.lit(1)}, "FoldCombinerSchema": {"mode": "max", "item": B.ref("x")}, "JsonValueSchema": [None, {"a": 1}], "ArithmeticOperatorSchema": "add",
    }
    for name, value in good.items():
        assert schemas.validate(name, value)["ok"], name
        assert not schemas.validate(name, {"kind": "zzz"} if name != "JsonValueSchema" else float("nan"))["ok"], name
    assert schemas.read("UnitSchema", {"m": 2, "s": 0}) == {"m": 2.0} and "more" not in schemas.read("ComputedValueSchema", good["ComputedValueSchema"])
    bad = schemas.validate("CompareNodeSchema", {"kind": "compare", "op": "gt", "left": B.lit(1), "right": {"kind": "reference"}})
    assert bad["issues"] == [("right.key", "is missing")]
    for name in schemas.NAMES:
        assert {"PredicateNode", "ExpressionNode"} <= set(schemas.json_schema(name)["$defs"])
    with pytest.raises(KeyError):
        schemas.read("OtherSchema", 1)


def test_limits_count_referenced_trees(spark):
    trees = {"t0": B.compare("gt", B.ref("id"), B.lit(0))} | {f"t{k}": B.and_(B.tree(f"t{k - 1}"), B.tree(f"t{k - 1}")) for k in range(1, 30)}
    with pytest.raises(nodes.InvalidTree):
        R.with_truth(spark.range(1), "v", B.tree("t29"), Scope(trees=trees))
    assert R.with_truth(spark.range(3), "v", B.tree("t3"), Scope(trees=trees)).where("v").count() == 2


def test_powers_by_columns_and_long_texts(spark):
    df = spark.createDataFrame([(3.0, "a" * 3000), (-2.0, "b"), (0.5, "a"), (0.0, None)], "n double, s string").withColumn("p", F.lit("^(?:a?){200}(?:b{300}){200}$"))
    rows = R.with_verdict(df, "v", B.arith("power", B.lit(1 + 2j), B.ref("n")), "expression").collect()
    for r in rows:
        if r.n == int(r.n):
            assert abs(complex(r.v.value.re, r.v.value.im) - (1 + 2j) ** int(r.n)) < 1e-12
        else:
            assert r.v.code == "wrong-type"
    assert R.with_verdict(df, "v", B.arith("power", B.lit(1j), B.lit(float("inf"))), "expression").first().v.code == "wrong-type"
    codes = [r.v.code for r in R.with_verdict(df, "v", B.text_compare("matches", B.ref("s"), B.ref("p"))).collect()]
    assert codes == ["domain-error", None, None, "not-found"]


def test_sql_refusals():
    assert sqltext.unpushable(B.text_compare("portableMatches", B.ref("a"), B.lit("^.$")))[0] == "textCompare"
    assert sqltext.unpushable(B.compare("eq", B.ref("a"), B.lit("\ud800"))) is not None
    with pytest.raises(sqltext.InvalidTable):
        sqltext.compile_sql(B.some("k", B.all_of()), {}, {"k": sqltext.SqlCollection("a.b.c", "TRUE")})
    with pytest.raises(sqltext.UnknownDialect):
        sqltext.compile_sql(B.all_of(), dialect="other")
    asked = []
    sqltext.compile_sql(B.and_(B.exists(B.ref("a")), B.exists(B.ref("a"))), lambda key: asked.append(key))
    assert asked == ["a"]
    assert sqltext.unpushable(B.compare("gt", B.arith("add", B.ref("a"), B.lit(1)), B.lit(1)))[:2] == ("arithmetic", "left")
    assert sqltext.unpushable(B.compare("gt", B.ref("a"), B.lit(1, {"m": 1})))[1] == "right"
    assert sqltext.unpushable(B.compare("gt", B.ref("a"), B.lit(1))) is None
    with pytest.raises(sqltext.InvalidColumn):
        sqltext.compile_sql(B.exists(B.ref("a.b.c.d")))
    assert sqltext.quoted("a`b.c", 2) == "`a``b`.`c`"


def test_documents_and_command_line(spark, tmp_path, capsys):
    tree = B.all_of(B.compare("gt", B.ref("x"), B.lit(1)), B.some("items", B.compare("gt", B.ref("amount"), B.lit(10))))
    assert evaluate_document(spark, tree, {"x": 2, "items": [{"amount": 5}, {"amount": 11}]}) == {"outcome": "evaluated", "as": "predicate", "status": "definite", "value": True}
    assert evaluate_document(spark, tree, {"items": [{"amount": 11}]})["reason"] == {"code": "not-found", "message": 'no value found for reference key "x"'}
    assert evaluate_document(spark, B.tree("k"), {})["reason"] == "ambiguous-tree-kind"
    assert evaluate_document(spark, tree, {"x": None, "items": []})["issues"][0][0] == "inputs.x"
    later = B.arith("add", B.ref("at"), B.duration(1, "d"))
    got = evaluate_document(spark, later, {"at": {"kind": "instant", "value": "2020-02-28T12:00Z"}})
    assert got["value"] == {"kind": "instant", "value": "2020-02-29T12:00:00.000Z"}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    (tmp_path / "i.json").write_text(json.dumps({"x": 0, "items": []}))
    args = ["evaluate", str(tmp_path / "t.json"), "--inputs", str(tmp_path / "i.json")]
    assert cli.main(args, spark) == 0 and json.loads(capsys.readouterr().out)["value"] is False
    assert cli.main([*args, "--max-nodes", "2"], spark) == 1
    # 5 nodes beside the items, 3 for each of them
    assert evaluate_document(spark, tree, {"x": 2, "items": [{"amount": 5}] * 4}, max_nodes=16)["reason"]["code"] == "domain-error"
    assert evaluate_document(spark, tree, {"x": 2, "items": [{"amount": 5}] * 4}, max_nodes=17)["value"] is False
    assert cli.main(["evaluate", str(tmp_path / "none.json")], spark) == 2
    assert cli.main(["evaluate", "-", "--inputs", "-"], spark) == 2
