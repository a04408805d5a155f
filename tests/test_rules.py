"""The lowering against the independent evaluator, and hand cases for what random trees don't reach."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.plans import build as B
from ruleloom.plans import nodes
from ruleloom.plans import rules as R
from ruleloom.plans.lower import UnsupportedTree
from ruleloom.sources.bindings import ChildTable, ColumnBinding, LookupTable, Scope
from tests import evaluator as E

ITEM = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("w", T.StringType())])
SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("c", T.DoubleType()), T.StructField("p", T.BooleanType()), T.StructField("s", T.StringType()), T.StructField("items", T.ArrayType(ITEM))]
)


def rows(n=60):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    out = []
    for i in range(n):
        items = [{"x": pick(None, 0.0, 1.0, 2.0, -3.0), "b": pick(None, True, False), "w": pick(None, "t")} for _ in range(pick(0, 0, 1, 2, 4))]
        out.append({"id": i, "a": pick(None, 0.0, 1.0, -2.0, 7.5), "c": pick(None, 0.0, 2.0, 3.0), "p": pick(None, True, False), "s": pick(None, "", "t", "u"), "items": items})
    return out


class Trees:
    """Random trees whose branches agree in kind."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def number(self, depth, item=False, acc=False):
        r = self.r
        if depth <= 0 or r.random() < 0.25:
            leaves = [B.lit(r.choice([0, 1, 2, -1.5])), B.ref("x") if item else B.ref(r.choice("ac")), B.ref("gone"), B.lit(1, {"m": 1})]
            return r.choice([*leaves[:2], *leaves[:2], *leaves, *([B.accumulator()] * 4 if acc else [])])
        go = lambda: self.number(depth - 1, item, acc)
        kind = r.choice(["arith"] * 4 + ["negate", "first", "unique"] + ([] if item else ["max", "min", "reduce"]))
        if kind == "arith":
            return B.arith(r.choice(nodes.ARITHMETIC), go(), go())
        if kind == "negate":
            return B.negate(go())
        if kind in ("first", "unique"):
            return B.conditional([(self.truth(depth - 1, item), self.plain(item)) for _ in range(2)], self.plain(item), kind)
        f = self.truth(depth - 2, True) if r.random() < 0.5 else None
        if kind == "reduce":
            return B.fold("items", "reduce", filter=f, initial=self.plain(False), combine=B.arith(r.choice(["add", "subtract", "multiply"]), B.accumulator(), self.plain(True)))
        return B.fold("items", kind, self.plain(True), f)

    def plain(self, item):
        return self.r.choice([B.lit(3), B.ref("x") if item else B.ref("a"), B.arith("divide", B.lit(1), B.ref("x") if item else B.ref("c"))])

    def truth(self, depth, item=False):
        r = self.r
        if depth <= 0 or r.random() < 0.2:
            s = B.ref("w") if item else B.ref("s")
            p = B.ref("b") if item else B.ref("p")
            return r.choice([B.text_compare("equals", s, B.lit("t")), B.compare("eq", p, B.lit(True)), B.text_compare("notEquals", s, B.lit("")), B.compare("gt", p, B.lit(False)), B.compare("eq", s, s)])
        go = lambda: self.truth(depth - 1, item)
        kind = r.choice(["not", "and", "or", "all", "any", "compare", "compare", "member", "exists"] + ([] if item else ["some", "every"]))
        if kind == "not":
            return B.not_(go())
        if kind in ("and", "or"):
            return (B.and_ if kind == "and" else B.or_)(go(), go())
        if kind in ("all", "any"):
            return (B.all_of if kind == "all" else B.any_of)(*[go() for _ in range(r.choice([0, 1, 3]))])
        if kind == "compare":
            return B.compare(r.choice(nodes.COMPARISONS), self.number(depth - 1, item), self.number(depth - 1, item))
        if kind == "member":
            return B.member_of(r.choice(nodes.MEMBERSHIPS), self.number(depth - 1, item), [r.choice([self.number(0, item), B.lit("t")]) for _ in range(r.choice([0, 1, 3]))])
        if kind == "exists":
            return B.exists(self.number(depth - 1, item))
        f = self.truth(depth - 2, True) if r.random() < 0.6 else None
        return (B.some if kind == "some" else B.every)("items", self.truth(depth - 2, True), f)


def same(got, want):
    if isinstance(got, float) and isinstance(want, (int, float)) and not isinstance(want, bool):
        return abs(got - want) <= 1e-9 * max(1, abs(want))
    return got == want


def check(spark, trees, of):
    data = rows()
    df = spark.createDataFrame([tuple([r[f] for f in SCHEMA.names[:-1]] + [[(i["x"], i["b"], i["w"]) for i in r["items"]]]) for r in data], SCHEMA)
    values = R.with_values(df, {f"t{i}": t for i, t in enumerate(trees)}, of=of)
    for i, t in enumerate(trees):
        values = R.with_verdict(values, f"v{i}", t, of)
    got = {r.id: r for r in values.collect()}
    judge = E.predicate if of == "predicate" else E.value
    for row in data:
        for i, tree in enumerate(trees):
            want = judge(tree, row)
            truth = None if want[0] != "ok" else want[1] if of == "predicate" else want[1][1]
            r = got[row["id"]]
            assert same(r[f"t{i}"], truth), (tree, row, r[f"t{i}"], want)
            assert same(r[f"v{i}"].value, truth), (tree, row, r[f"v{i}"], want)
            assert r[f"v{i}"].code == (None if want[0] == "ok" else want[0]), (tree, row, r[f"v{i}"], want)
            assert (r[f"v{i}"].message is None) == (want[0] == "ok")


@pytest.mark.parametrize("seed", range(6))
def test_random_predicates(spark, seed):
    trees = Trees(seed)
    check(spark, [trees.truth(3) for _ in range(6)], "predicate")


@pytest.mark.parametrize("seed", range(4))
def test_random_expressions(spark, seed):
    trees = Trees(100 + seed)
    check(spark, [trees.number(3) for _ in range(6)], "expression")


def test_child_tables_agree_with_arrays(spark):
    data = rows()
    parents = spark.createDataFrame([(r["id"], r["a"]) for r in data], "id long, a double")
    items = [(r["id"], k, i["x"], i["b"], i["w"]) for r in data for k, i in enumerate(r["items"])]
    child = spark.createDataFrame(items, "parent long, k int, x double, b boolean, w string")
    scope = Scope(collections={"items": ChildTable(child, ["id"], ["parent"], ["k"])})
    yes = B.compare("eq", B.ref("b"), B.lit(True))
    big = B.compare("gt", B.ref("x"), B.lit(0))
    truths = {"t0": B.some("items", big, yes), "t1": B.every("items", big, yes), "t2": B.none("items", big), "t3": B.every("items", yes)}
    numbers = {
        "n0": B.fold("items", "max", B.ref("x"), yes), "n1": B.sum_("items", B.ref("x"), yes), "n2": B.count("items"), "n3": B.count("items", yes, B.ref("x")), "n4": B.average("items", B.ref("x"), yes),
        "n5": B.fold("items", "reduce", initial=B.lit(1), combine=B.arith("subtract", B.ref("x"), B.accumulator())), "n6": B.fold("items", "min", B.ref("x")),
    }
    df = R.with_values(R.with_values(parents, truths, scope), numbers, scope, "expression")
    for name, tree in {**truths, **numbers}.items():
        df = R.with_verdict(df, "v" + name, tree, "predicate" if name[0] == "t" else "expression", scope)
    for r in df.collect():
        row = data[r.id]
        for name, tree in {**truths, **numbers}.items():
            want = (E.predicate if name[0] == "t" else E.value)(tree, row)
            v = None if want[0] != "ok" else want[1] if name[0] == "t" else want[1][1]
            assert same(r[name], v), (name, row, r[name], want)
            assert same(r["v" + name].value, v) and r["v" + name].code == (None if want[0] == "ok" else want[0]), (name, row, r["v" + name], want)


def test_simple_conjuncts_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) x", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    df = R.filter_rows(spark.read.parquet(str(tmp_path / "t")), B.all_of(B.compare("gt", B.ref("x"), B.lit(3)), B.text_compare("equals", B.ref("s"), B.lit("5"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3.0)" in plan and "EqualTo(s,5)" in plan
    assert [r.id for r in df.collect()] == [5]


def test_deep_verdicts_grow_with_the_tree(spark):
    tree = B.compare("gt", B.ref("id"), B.lit(2))
    for k in range(12):
        tree = B.and_(tree, B.compare("neq", B.ref("id"), B.lit(k + 100)))
    got = R.with_verdict(spark.range(5), "v", tree).select("id", "v.value").collect()
    assert [r.value for r in got] == [False, False, False, True, True]


def test_pending_reasons_come_first(spark):
    df = spark.createDataFrame([(None, None, True), (None, None, False)], "a double, b double, later boolean")
    scope = Scope({"b": ColumnBinding("b", pending="later")})
    tree = B.and_(B.compare("gt", B.ref("a"), B.lit(0)), B.compare("gt", B.ref("b"), B.lit(0)))
    assert [r.v.code for r in R.with_verdict(df, "v", tree, scope=scope).collect()] == ["not-yet-known", "not-found"]


def test_lookups(spark):
    df = spark.createDataFrame([(1, [(1,), (9,)]), (2, []), (None, [(2,)])], "k int, items array<struct<j:int>>")
    dim = spark.createDataFrame([(1, "one"), (2, "two"), (2, "two")], "k int, name string")
    scope = Scope(lookups={"names": LookupTable(dim, ["k"], ColumnBinding("name"))})
    got = R.with_verdict(df, "v", B.lookup("names", B.arith("add", B.ref("k"), B.lit(0))), "expression", scope).collect()
    assert sorted((str(r.v.value), str(r.v.code)) for r in got) == [("None", "not-found"), ("one", "None"), ("two", "None")]


def test_references_to_trees(spark):
    trees = {"a": B.compare("gt", B.ref("id"), B.lit(1)), "loop": B.tree("loop"), "bad": {"kind": "nothing"}}
    code = lambda key, scope=Scope(trees=trees): R.with_verdict(spark.range(1), "v", B.tree(key), scope=scope).first().v.code
    assert [code("a"), code("loop"), code("bad"), code("none"), code("a", Scope())] == [None, "domain-error", "wrong-type", "not-found", "wrong-type"]


def test_branches_of_different_kinds_are_refused(spark):
    with pytest.raises(UnsupportedTree):
        R.with_value(spark.range(1), "v", B.conditional([(B.compare("gt", B.ref("id"), B.lit(0)), B.lit("x"))], B.lit(1)))


def test_limits_and_issues():
    assert nodes.issues({"kind": "and", "left": {"kind": "exists"}, "right": 3}) == [
        ("left.operand", "is missing"), ("right", f"expected a node; its kind is one of {', '.join(nodes.PREDICATES)}"),
    ]
    deep = B.compare("eq", B.lit(1), B.lit(1))
    for _ in range(600):
        deep = B.not_(deep)
    assert nodes.issues(deep)
    assert nodes.issues({"kind": "complexLiteral", "re": 1, "phase": 2}, "expression")
    assert nodes.read_expression({"kind": "complexLiteral", "magnitude": 2, "phase": 0})["re"] == 2
    assert nodes.tree_kinds(B.tree("k")) == ["predicate", "expression"]
    assert nodes.canonical({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'
    assert set(nodes.json_schema()["$defs"]) >= {"PredicateNode", "ExpressionNode"}


def test_streams(spark, tmp_path):
    from ruleloom.streaming import judged_stream

    spark.range(6).selectExpr("id", "cast(nullif(id, 2) as double) x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, x double").parquet(str(tmp_path / "in"))
    q = judged_stream(stream, "ok", B.compare("gt", B.ref("x"), B.lit(3))).writeStream.format("memory").queryName("judged").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.ok for r in spark.table("judged").collect()} == {0: False, 1: False, 2: None, 3: False, 4: True, 5: True}


def test_number_functions(spark):
    df = spark.createDataFrame([(-4.0, 2.5, 1.005)], "a double, h double, r double")
    call = lambda *x: R.with_verdict(df, "v", B.call(*x), "expression").first().v
    assert call("squareRoot", B.ref("a")).code == "domain-error"
    assert (call("squareRoot", B.lit(-4 + 0j)).value.re, call("squareRoot", B.lit(-4 + 0j)).value.im) == (0.0, 2.0)
    assert call("round", B.ref("h")).value == 3.0 and call("round", B.ref("r"), B.lit(2)).value == 1.01
    assert call("round", B.ref("h"), B.ref("h")).code == "domain-error"
    assert call("logarithm", B.lit(1000), B.lit(10)).value == 3.0 and call("logarithm", B.lit(0)).code == "domain-error"
    assert call("minimum").code == "wrong-type" and call("minimum", B.lit(3), B.ref("a")).value == -4.0
    assert call("unheardOf", B.lit(1)).code == "wrong-type" and call("arcSine", B.lit(2)).code == "domain-error"
    assert call("exponential", B.lit(1000)).code == "domain-error"
    assert R.with_verdict(df, "v", B.lit(2), "expression").select(F.col("v.value")).first()[0] == 2.0
