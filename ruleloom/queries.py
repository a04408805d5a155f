"""Registered queries of the rule engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.plans import build as B
from ruleloom.plans import rules as R
from ruleloom.plans.sqltext import SqlCollection, SqlColumn, compile_sql
from ruleloom.sources.bindings import ArrayBinding, ChildTable, ColumnBinding, Delegate, Function, LookupTable, Scope

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Orders with a hidden price where the customer key is a multiple of 3, and a hidden status where it is one of 4.
def hidden(spark, d):
    o = t(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderstatus")).alias("status"),
        (F.col("o_custkey") % 6 == 0).alias("later"),
    )


_HIDDEN = """h AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END AS price,
 CASE WHEN o_custkey % 4 <> 0 THEN o_orderstatus END AS status, o_custkey % 6 = 0 AS later FROM orders)"""
_P, _S = B.compare("gt", B.ref("price"), B.lit(150000)), B.text_compare("equals", B.ref("status"), B.lit("F"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_rule(spark, d):
    tree = B.all_of(B.compare("gt", B.ref("o_totalprice"), B.lit(100000)), B.text_compare("equals", B.ref("o_orderstatus"), B.lit("F")))
    return R.filter_rows(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), tree).select("o_orderkey", "o_totalprice")


@query(f"""WITH {_HIDDEN} SELECT o_orderkey, NOT (price > 150000) AS r_not, price > 150000 AND status = 'F' AS r_and, price > 150000 OR status = 'F' AS r_or,
 TRUE AS r_all_none, FALSE AS r_any_none, price > 150000 AND status = 'F' AND o_custkey > 50 AS r_all, price > 150000 OR status = 'F' OR o_custkey > 1400 AS r_any FROM h""")
def connectives(spark, d):
    big = lambda n: B.compare("gt", B.ref("o_custkey"), B.lit(n))
    trees = {"r_not": B.not_(_P), "r_and": B.and_(_P, _S), "r_or": B.or_(_P, _S), "r_all_none": B.all_of(), "r_any_none": B.any_of(), "r_all": B.all_of(_P, _S, big(50)), "r_any": B.any_of(_P, _S, big(1400))}
    return R.with_values(hidden(spark, d), trees).select("o_orderkey", *trees)


@query(f"""WITH {_HIDDEN}, p AS (SELECT o_orderkey, price > 150000 AS a, status = 'F' AS b FROM h)
SELECT o_orderkey, (a AND NOT b) OR (NOT a AND b) AS r_xor, NOT (a AND b) AS r_nand, NOT (a OR b) AS r_nor, NOT a OR b AS r_implies, NOT ((a AND NOT b) OR (NOT a AND b)) AS r_iff FROM p""")
def derived_connectives(spark, d):
    trees = {"r_xor": B.xor(_P, _S), "r_nand": B.nand(_P, _S), "r_nor": B.nor(_P, _S), "r_implies": B.implies(_P, _S), "r_iff": B.iff(_P, _S)}
    return R.with_values(hidden(spark, d), trees).select("o_orderkey", *trees)


@query("""SELECT l_orderkey, l_linenumber, l_quantity > 25 AS gt, l_quantity >= 25 AS gte, l_quantity < l_linenumber * 10 AS lt, l_quantity <= 25 AS lte,
 l_quantity = 25 AS eq, l_quantity <> 25 AS neq FROM lineitem""")
def compare_number(spark, d):
    q = B.ref("l_quantity")
    trees = {op: B.compare(op, q, B.lit(25)) for op in ("gt", "gte", "lte", "eq", "neq")} | {"lt": B.compare("lt", q, B.arith("multiply", B.ref("l_linenumber"), B.lit(10)))}
    return R.with_values(t(spark, d, "lineitem"), trees).select("l_orderkey", "l_linenumber", *trees)


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE ELSE l_quantity END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, NOT isnan(x) AND x > 25 AS gt, NOT isnan(x) AND x < 25 AS lt, FALSE AS eq_self_nan, isnan(x) OR x <> 25 AS neq FROM n WHERE isnan(x) OR x > 30""")
def compare_nan(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"))
    x = B.ref("x")
    df = df.where("isnan(x) or x > 30")
    trees = {"gt": B.compare("gt", x, B.lit(25)), "lt": B.compare("lt", x, B.lit(25)), "eq_self_nan": B.and_(B.compare("eq", x, x), B.compare("neq", x, x)), "neq": B.compare("neq", x, B.lit(25))}
    return R.with_values(df, trees).select("l_orderkey", "l_linenumber", *trees)


@query("""SELECT o_orderkey, o_orderdate >= TIMESTAMP '1997-01-01' AS since, o_orderdate < TIMESTAMP '1999-06-30 22:30:00' AS before,
 CAST(NULL AS BOOLEAN) AS unreadable FROM orders""")
def compare_instant(spark, d):
    at = B.ref("o_orderdate")
    trees = {"since": B.compare("gte", at, B.instant("1997-01-01")), "before": B.compare("lt", at, B.instant("1999-07-01T00:00+01:30")), "unreadable": B.compare("lt", at, B.instant("now"))}
    return R.with_values(t(spark, d, "orders"), trees).select("o_orderkey", *trees)


@query(f"""WITH {_HIDDEN} SELECT o_orderkey, later = TRUE AS eq, later <> TRUE AS neq, CAST(NULL AS BOOLEAN) AS ordered, CAST(NULL AS BOOLEAN) AS across FROM h""")
def compare_boolean(spark, d):
    x = B.ref("later")
    trees = {"eq": B.compare("eq", x, B.lit(True)), "neq": B.compare("neq", x, B.lit(True)), "ordered": B.compare("gt", x, B.lit(False)), "across": B.compare("eq", x, B.lit(1))}
    return R.with_values(hidden(spark, d), trees).select("o_orderkey", *trees)


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 60 > l_linenumber * 300 AS longer, l_quantity = l_linenumber AS same_unit, l_quantity * 1000 = 24000 AS exact FROM lineitem""")
def compare_duration(spark, d):
    trees = {
        "longer": B.compare("gt", B.ref("q"), B.ref("fives")), "same_unit": B.compare("eq", B.ref("q"), B.ref("n")), "exact": B.compare("eq", B.ref("s"), B.duration(24000, "ms")),
    }
    df = t(spark, d, "lineitem").withColumn("f", F.col("l_linenumber") * 300.0)
    scope = Scope({"q": ColumnBinding("l_quantity", "duration", "min"), "n": ColumnBinding("l_linenumber", "duration", "min"), "s": ColumnBinding("l_quantity", "duration", "s"), "fives": ColumnBinding("f", "duration", "s")})
    return R.with_values(df, trees, scope).select("l_orderkey", "l_linenumber", *trees)


@query(f"WITH {_HIDDEN} SELECT o_orderkey, status = 'O' AS eq, status <> 'O' AS neq, CAST(NULL AS BOOLEAN) AS number_text FROM h")
def text_equals(spark, d):
    s = B.ref("status")
    trees = {"eq": B.text_compare("equals", s, B.lit("O")), "neq": B.text_compare("notEquals", s, B.lit("O")), "number_text": B.text_compare("equals", B.ref("price"), B.lit("O"))}
    return R.with_values(hidden(spark, d), trees).select("o_orderkey", *trees)


@query("""SELECT p_partkey, regexp_matches(p_name, '[aeiou][0-9]+') AS found, NOT regexp_matches(p_name, '[aeiou][0-9]+') AS missing,
 starts_with(p_type, 'STANDARD') AS starts, ends_with(p_brand, '3') AS ends, contains(p_type, 'AN') AS holds, p_brand = 'Brand#13' AS is, regexp_matches(p_name, '^(ab|cd|part)*.[0-9]{1,3}$') AS repeated FROM part""")
def portable_matches(spark, d):
    m = lambda key, p, op="portableMatches": B.text_compare(op, B.ref(key), B.lit(p))
    trees = {
        "found": m("p_name", "[aeiou]\\d+"), "missing": m("p_name", "[aeiou]\\d+", "portableNotMatches"), "starts": m("p_type", "^STANDARD", "matches"), "ends": m("p_brand", "3$", "matches"),
        "holds": m("p_type", "AN"), "is": m("p_brand", "^Brand#13$"), "repeated": m("p_name", "^(?:ab|cd|part)*.\\d{1,3}$", "matches"),
    }
    return R.with_values(t(spark, d, "part"), trees).select("p_partkey", *trees)


@query("""SELECT page_id, url = 'https:' OR starts_with(url, 'https: ') AS prefixed, regexp_matches(url, '^http.*://www\\..*$') AS wild, regexp_matches(url, '^https?://[^/]*/en/.*$') AND starts_with(url, 'http://') AS globbed FROM pages""")
def patterns(spark, d):
    u = B.ref("url")
    trees = {"prefixed": B.prefix_pattern(u, "https:"), "wild": B.wildcard_pattern(u, " http*://www.* "), "globbed": B.glob_pattern(u, "http://*/en/**")}
    return R.with_values(t(spark, d, "pages").select("page_id", "url"), trees).select("page_id", *trees)


@query(f"""WITH {_HIDDEN} SELECT o_orderkey, status IN ('F', 'P') AS texts, status NOT IN ('F', 'P') AS not_texts, o_custkey IN (1, 2, 3.5) AS numbers,
 CASE WHEN o_custkey = 7 THEN TRUE WHEN price = 0 THEN TRUE WHEN price IS NULL THEN NULL ELSE FALSE END AS absorbed, CASE WHEN o_custkey = 5 THEN TRUE END AS across FROM h""")
def member_of(spark, d):
    s, k = B.ref("status"), B.ref("o_custkey")
    trees = {
        "texts": B.member_of("in", s, [B.lit("F"), B.lit("P")]), "not_texts": B.member_of("notIn", s, [B.lit("F"), B.lit("P")]), "numbers": B.member_of("in", k, [B.lit(1), B.lit(2), B.lit(3.5)]),
        "absorbed": B.any_of(B.member_of("in", k, [B.lit(7)]), B.member_of("in", B.lit(0), [B.ref("price")])), "across": B.member_of("in", k, [B.lit("x"), B.lit(5)]),
    }
    return R.with_values(hidden(spark, d), trees).select("o_orderkey", *trees)


@query(f"WITH {_HIDDEN} SELECT o_orderkey, CASE WHEN status IS NOT NULL THEN FALSE END AS r_in, CASE WHEN status IS NOT NULL THEN TRUE END AS r_not_in FROM h")
def member_of_empty(spark, d):
    trees = {"r_in": B.member_of("in", B.ref("status"), []), "r_not_in": B.member_of("notIn", B.ref("status"), [])}
    return R.with_values(hidden(spark, d), trees).select("o_orderkey", *trees)


@query(f"""WITH {_HIDDEN} SELECT o_orderkey, status IS NOT NULL AS plain, CASE WHEN price IS NOT NULL THEN TRUE WHEN NOT later THEN FALSE END AS pending,
 TRUE AS wrong, price IS NOT NULL AS computed FROM h""")
def exists_rule(spark, d):
    scope = Scope({"slow": ColumnBinding("price", pending="later")})
    trees = {
        "plain": B.exists(B.ref("status")), "pending": B.exists(B.ref("slow")), "wrong": B.exists(B.arith("divide", B.ref("o_custkey"), B.lit(0))),
        "computed": B.exists(B.arith("add", B.ref("price"), B.lit(1))),
    }
    return R.with_values(hidden(spark, d), trees, scope).select("o_orderkey", *trees)


@query("""SELECT event_id, CAST(props->>'$.k' AS DOUBLE) IS NOT NULL AS has_k, props->>'$.missing' IS NOT NULL AS has_missing,
 coalesce(props->>'$.missing', event_type) AS text FROM events""")
def json_missing(spark, d):
    e = t(spark, d, "events")
    df = e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("double").alias("k"), F.get_json_object("props", "$.missing").alias("m"))
    out = R.with_values(df, {"has_k": B.exists(B.ref("k")), "has_missing": B.exists(B.ref("m"))})
    return R.with_value(out, "text", B.coalesce(B.ref("m"), B.ref("event_type"))).select("event_id", "has_k", "has_missing", "text")


@query(f"""WITH {_HIDDEN} SELECT o_orderkey, coalesce(price, o_custkey, 0) AS first_known, CASE WHEN o_custkey % 3 <> 0 AND o_custkey <> 1 THEN price / (o_custkey - 1) WHEN o_custkey % 3 = 0 THEN -1.0 END AS no_fall FROM h""")
def coalesce_values(spark, d):
    trees = {
        "first_known": B.coalesce(B.ref("price"), B.ref("o_custkey"), B.lit(0)),
        "no_fall": B.coalesce(B.arith("divide", B.ref("price"), B.arith("subtract", B.ref("o_custkey"), B.lit(1))), B.lit(-1)),
    }
    return R.with_values(hidden(spark, d), trees, of="expression").select("o_orderkey", *trees)


@query("""SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * l_tax AS m, l_quantity / nullif(l_linenumber - 2, 0) AS d,
 l_quantity % nullif(CAST(l_linenumber AS DOUBLE) - 2, 0) AS r, -l_quantity AS n, CAST(NULL AS DOUBLE) AS big, l_quantity * l_quantity AS sq,
 CASE WHEN l_linenumber <> 2 THEN CASE WHEN l_linenumber < 2 THEN CAST(NULL AS DOUBLE) ELSE sqrt(l_linenumber - 2) END ELSE 0.0 END AS root FROM lineitem""")
def arithmetic(spark, d):
    q, x, n = B.ref("l_quantity"), B.ref("l_tax"), B.ref("l_linenumber")
    less = B.arith("subtract", n, B.lit(2))
    trees = {
        "a": B.arith("add", q, x), "s": B.arith("subtract", q, x), "m": B.arith("multiply", q, x), "d": B.arith("divide", q, less), "r": B.arith("modulo", q, less), "n": B.negate(q),
        "big": B.arith("multiply", B.arith("add", q, B.lit(1e308)), B.lit(10)), "sq": B.arith("power", q, B.lit(2)), "root": B.arith("power", less, B.lit(0.5)),
    }
    return R.with_values(t(spark, d, "lineitem"), trees, of="expression").select("l_orderkey", "l_linenumber", *trees)


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS size,
 CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size > 25 THEN 1.0 ELSE 0.0 END AS stops FROM part""")
def conditional_first(spark, d):
    df = t(spark, d, "part").withColumn("maybe", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    big = lambda n, k="p_size": B.compare("gt", B.ref(k), B.lit(n))
    trees = {"size": B.conditional([(big(40), B.lit("large")), (big(20), B.lit("medium"))], B.lit("small")), "stops": B.conditional([(big(25, "maybe"), B.lit(1))], B.lit(0))}
    return R.with_values(df, trees, of="expression").select("p_partkey", *trees)


@query("""SELECT p_partkey, CASE WHEN p_size > 30 AND p_size % 2 = 0 THEN NULL WHEN p_size > 30 THEN 1.0 WHEN p_size % 2 = 0 THEN 2.0 ELSE 0.0 END AS choice FROM part""")
def conditional_unique(spark, d):
    even = B.compare("eq", B.arith("modulo", B.ref("p_size"), B.lit(2)), B.lit(0))
    tree = B.conditional([(B.compare("gt", B.ref("p_size"), B.lit(30)), B.lit(1)), (even, B.lit(2))], B.lit(0), "unique")
    return R.with_value(t(spark, d, "part"), "choice", tree).select("p_partkey", "choice")


@query("""SELECT c_custkey, n_name AS nation, CASE WHEN c_nationkey < 20 THEN n_name END AS shifted FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def lookup_nation(spark, d):
    nation = t(spark, d, "nation")
    scope = Scope(lookups={"nations": LookupTable(nation, ["n_nationkey"], ColumnBinding("n_name")), "low": LookupTable(nation.where("n_nationkey < 20"), ["n_nationkey"], ColumnBinding("n_name"))})
    trees = {"nation": B.lookup("nations", B.ref("c_nationkey")), "shifted": B.lookup("low", B.arith("add", B.ref("c_nationkey"), B.lit(0)))}
    return R.with_values(t(spark, d, "customer"), trees, scope, "expression").select("c_custkey", *trees)


def _lines(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.when(F.col("l_tax") > 0.02, F.col("l_discount") > 0.03).alias("f"))
    return Scope(collections={"lines": ChildTable(lines, ["o_orderkey"], ["l_orderkey"], ["l_linenumber"])})


_BIG = B.compare("gt", B.ref("l_quantity"), B.lit(45))
_MAYBE = B.compare("eq", B.ref("f"), B.lit(True))
_VOTES = """v AS (SELECT l_orderkey, l_quantity > 45 AS p, CASE WHEN l_tax > 0.02 THEN l_discount > 0.03 END AS f FROM lineitem),
w AS (SELECT o_orderkey, count(l_orderkey) AS n, coalesce(bool_or(p), FALSE) AS some_plain, coalesce(bool_and(p), TRUE) AS every_plain,
 CASE WHEN bool_or(f AND p) THEN TRUE WHEN bool_or(l_orderkey IS NOT NULL AND (f IS NULL OR (f AND p IS NULL))) THEN NULL ELSE FALSE END AS some_filtered,
 CASE WHEN bool_or(f AND NOT p) THEN FALSE WHEN bool_or(l_orderkey IS NOT NULL AND f IS NULL) THEN NULL ELSE TRUE END AS every_filtered
 FROM orders LEFT JOIN v ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


@query(f"WITH {_VOTES} SELECT o_orderkey, some_plain, every_plain, some_filtered, every_filtered, NOT some_filtered AS none_filtered FROM w")
def quantifiers(spark, d):
    trees = {
        "some_plain": B.some("lines", _BIG), "every_plain": B.every("lines", _BIG), "some_filtered": B.some("lines", _BIG, _MAYBE), "every_filtered": B.every("lines", _BIG, _MAYBE),
        "none_filtered": B.none("lines", _BIG, _MAYBE),
    }
    return R.with_values(t(spark, d, "orders"), trees, _lines(spark, d)).select("o_orderkey", *trees)


@query(f"WITH {_VOTES} SELECT o_orderkey, some_filtered, every_filtered FROM w")
def quantifiers_nested(spark, d):
    """The same votes over nested arrays, by higher-order functions."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_quantity", F.when(F.col("l_tax") > 0.02, F.col("l_discount") > 0.03).alias("f"))).alias("lines")
    )
    o = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.expr("array()").cast(lines.schema["lines"].dataType)))
    trees = {"some_filtered": B.some("lines", _BIG, _MAYBE), "every_filtered": B.every("lines", _BIG, _MAYBE)}
    return R.with_values(o, trees, Scope(collections={"lines": ArrayBinding("lines")})).select("o_orderkey", *trees)


def _orders(spark, d):
    o = t(spark, d, "orders").withColumn("f", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") == "F"))
    return Scope(collections={"orders": ChildTable(o, ["c_custkey"], ["o_custkey"], ["o_orderdate", "o_orderkey"])})


_BY = "FROM customer LEFT JOIN (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus = 'F' END AS f FROM orders) o ON c_custkey = o_custkey GROUP BY c_custkey"


@query(f"""SELECT c_custkey, max(o_totalprice) AS most, min(o_totalprice) AS least, CASE WHEN bool_or(o_orderkey IS NOT NULL AND f IS NULL) THEN NULL ELSE max(CASE WHEN f THEN o_totalprice END) END AS most_f {_BY}""")
def fold_extremes(spark, d):
    p = B.ref("o_totalprice")
    trees = {"most": B.fold("orders", "max", p), "least": B.fold("orders", "min", p), "most_f": B.fold("orders", "max", p, _MAYBE)}
    return R.with_values(t(spark, d, "customer"), trees, _orders(spark, d), "expression").select("c_custkey", *trees)


@query(f"""SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total, CAST(count(o_orderkey) AS DOUBLE) AS n, round(avg(o_totalprice), 4) AS mean,
 CASE WHEN bool_or(o_orderkey IS NOT NULL AND f IS NULL) THEN NULL ELSE CAST(count(CASE WHEN f THEN 1 END) AS DOUBLE) END AS n_f,
 CASE WHEN bool_or(o_orderkey IS NOT NULL AND f IS NULL) THEN NULL ELSE CAST(count(o_orderkey) AS DOUBLE) END AS probed {_BY}""")
def sums_and_counts(spark, d):
    p = B.ref("o_totalprice")
    trees = {"total": B.sum_("orders", p), "n": B.count("orders"), "mean": B.average("orders", p), "n_f": B.count("orders", _MAYBE), "probed": B.count("orders", probe=B.ref("f"))}
    out = R.with_values(t(spark, d, "customer"), trees, _orders(spark, d), "expression").select("c_custkey", *trees)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("""WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT c_custkey, round(coalesce(sum(CASE WHEN k % 2 = 1 THEN o_totalprice ELSE -o_totalprice END), 0), 2) AS balance FROM customer LEFT JOIN r ON c_custkey = o_custkey GROUP BY c_custkey""")
def reduce_ordered(spark, d):
    """An alternating balance: each order less what came before it."""
    tree = B.fold("orders", "reduce", initial=B.lit(0), combine=B.arith("subtract", B.ref("o_totalprice"), B.accumulator()))
    return R.with_value(t(spark, d, "customer"), "balance", tree, _orders(spark, d)).select("c_custkey", F.round("balance", 2).alias("balance"))


@query("""WITH x AS (SELECT o_orderkey, o_custkey, coalesce(bool_and(l_quantity > 5), TRUE) AS p FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT c_custkey, coalesce(bool_or(p), FALSE) AS any_order, CAST(count(CASE WHEN p THEN 1 END) AS DOUBLE) AS n FROM customer LEFT JOIN x ON c_custkey = o_custkey GROUP BY c_custkey""")
def nested_collections(spark, d):
    inner = Scope(collections={"lines": ChildTable(t(spark, d, "lineitem").select("l_orderkey", "l_quantity"), ["o_orderkey"], ["l_orderkey"])})
    scope = Scope(collections={"orders": ChildTable(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["c_custkey"], ["o_custkey"], scope=inner)})
    whole = B.every("lines", B.compare("gt", B.ref("l_quantity"), B.lit(5)))
    trees = {"any_order": B.some("orders", whole), "n": B.count("orders", whole)}
    return R.with_values(t(spark, d, "customer"), trees, scope, {"any_order": "predicate", "n": "expression"}).select("c_custkey", "any_order", "n")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS one, round(l_extendedprice, -2) AS hundreds, CASE WHEN l_tax < l_discount THEN NULL ELSE round(sqrt(l_tax - l_discount), 10) END AS root,
 round(ln(l_quantity), 10) AS natural, round(log10(l_quantity), 10) AS ten, round(log2(l_quantity), 10) AS two, round(exp(l_tax), 10) AS e, abs(l_tax - l_discount) AS size, least(l_tax, l_discount) AS low, greatest(l_tax, l_discount) AS high FROM lineitem""")
def functions_numeric(spark, d):
    diff = B.arith("subtract", B.ref("l_tax"), B.ref("l_discount"))
    q, both = B.ref("l_quantity"), (B.ref("l_tax"), B.ref("l_discount"))
    trees = {
        "one": B.call("round", B.ref("l_extendedprice"), B.lit(1)), "hundreds": B.call("round", B.ref("l_extendedprice"), B.lit(-2)), "root": B.call("squareRoot", diff),
        "natural": B.call("logarithm", q), "ten": B.call("logarithm", q, B.lit(10)), "two": B.call("logarithm", q, B.lit(2)), "e": B.call("exponential", B.ref("l_tax")),
        "size": B.call("absoluteValue", diff), "low": B.call("minimum", *both), "high": B.call("maximum", *both),
    }
    out = R.with_values(t(spark, d, "lineitem"), trees, of="expression").select("l_orderkey", "l_linenumber", *trees)
    return out.withColumns({c: F.round(c, 10) for c in ("root", "natural", "ten", "two", "e")})


@query("""SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 10) AS s, round(cos(l_quantity), 10) AS c, round(tan(l_tax), 10) AS t, round(asin(l_tax), 10) AS a_s,
 CASE WHEN l_quantity <= 1 THEN round(acos(least(l_quantity, 1)), 10) END AS a_c, round(atan(l_quantity), 10) AS a_t, round(atan2(l_tax, l_discount), 10) AS a_2 FROM lineitem""")
def functions_trigonometric(spark, d):
    q, x = B.ref("l_quantity"), B.ref("l_tax")
    trees = {
        "s": B.call("sine", q), "c": B.call("cosine", q), "t": B.call("tangent", x), "a_s": B.call("arcSine", x), "a_c": B.call("arcCosine", q), "a_t": B.call("arcTangent", q),
        "a_2": B.call("arcTangent2", x, B.ref("l_discount")),
    }
    out = R.with_values(t(spark, d, "lineitem"), trees, of="expression").select("l_orderkey", "l_linenumber", *trees)
    return out.withColumns({k: F.round(k, 10) for k in trees})


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax - l_linenumber * l_discount, 8) AS re, round(l_quantity * l_discount + l_linenumber * l_tax, 8) AS im,
 round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 8) AS size, round(atan2(l_linenumber, l_quantity), 8) AS angle, l_quantity = l_linenumber AS same,
 round(l_quantity * l_quantity - l_linenumber * l_linenumber, 6) AS square, round(l_quantity / (l_quantity * l_quantity + l_linenumber * l_linenumber), 8) AS inverse FROM lineitem""")
def complex_numbers(spark, d):
    z = F.struct(F.col("l_quantity").alias("re"), F.col("l_linenumber").cast("double").alias("im"))
    w = F.struct(F.col("l_tax").alias("re"), F.col("l_discount").alias("im"))
    df = t(spark, d, "lineitem").withColumns({"z": z, "w": w, "y": F.struct(F.col("l_linenumber").cast("double").alias("re"), F.col("l_linenumber").cast("double").alias("im"))})
    trees = {
        "product": B.arith("multiply", B.ref("z"), B.ref("w")), "size": B.call("magnitude", B.ref("z")), "angle": B.call("phase", B.ref("z")), "squared": B.arith("power", B.ref("z"), B.lit(2)),
        "inverted": B.arith("divide", B.lit(1), B.ref("z")),
    }
    out = R.with_values(df, trees, of="expression")
    out = R.with_truth(out, "same", B.compare("eq", B.ref("z"), B.ref("y")))
    r = F.round
    return out.select("l_orderkey", "l_linenumber", r("product.re", 8).alias("re"), r("product.im", 8).alias("im"), r("size", 8).alias("size"), r("angle", 8).alias("angle"), "same", r("squared.re", 6).alias("square"), r("inverted.re", 8).alias("inverse"))


@query("""SELECT o_orderkey, CAST(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') AS DOUBLE) AS since, epoch_ms(o_orderdate) + 129600000 AS later,
 CAST(NULL AS BIGINT) AS no_minus, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') > 86400000::BIGINT * 1000 AS long FROM orders""")
def instants(spark, d):
    at = B.ref("o_orderdate")
    since = B.arith("subtract", at, B.instant("1995-01-01T00:00:00Z"))
    trees = {"since": since, "later": B.arith("add", at, B.duration(1.5, "d")), "no_minus": B.arith("subtract", at, B.duration(1, "d"))}
    out = R.with_values(t(spark, d, "orders"), trees, of="expression")
    return R.with_truth(out, "long", B.compare("gt", since, B.duration(1000, "d")), Scope()).select("o_orderkey", "since", "later", F.col("no_minus").cast("long").alias("no_minus"), "long")


@query("""SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 3 <> 0 THEN epoch_us(date_trunc('second', ts)) // 1000 END AS parsed FROM events""")
def instant_texts(spark, d):
    """Instants in text columns: offsets, cut fractions, and texts that are none."""
    e = t(spark, d, "events").withColumn("text", F.when(F.col("event_id") % 3 == 0, F.lit("now")).otherwise(F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".0009+01:30"))))
    scope = Scope({"text": ColumnBinding("text", "instant")})
    return R.with_values(e, {"ms": B.ref("ts"), "parsed": B.ref("text")}, scope, "expression").select("event_id", "ms", "parsed")


@query("""SELECT p_partkey, p_retailprice * p_size AS area, CAST(NULL AS DOUBLE) AS mixed, p_size > 10 AS enough, CAST(NULL AS BOOLEAN) AS unlike FROM part""")
def units_checked(spark, d):
    scope = Scope({"a": ColumnBinding("p_retailprice", unit={"m": 1}), "b": ColumnBinding("p_size", unit={"m": 1, "s": 0})})
    a, b = B.ref("a"), B.ref("b", {"m": 1})
    out = R.with_values(t(spark, d, "part"), {"area": B.arith("multiply", a, b), "mixed": B.arith("add", a, B.lit(1))}, scope, "expression")
    trees = {"enough": B.compare("gt", B.arith("divide", B.arith("multiply", b, b), b), B.lit(10, {"m": 1})), "unlike": B.compare("gt", B.ref("a", {"kg": 1}), B.lit(10, {"kg": 1}))}
    return R.with_values(out, trees, scope).select("p_partkey", "area", F.col("mixed").cast("double").alias("mixed"), *trees)


_TREES = {"rich": B.compare("gt", B.ref("o_totalprice"), B.ref("o_limit")), "done": B.text_compare("equals", B.ref("o_orderstatus"), B.lit("F")), "both": B.and_(B.tree("rich"), B.tree("done")), "loop": B.not_(B.tree("loop"))}


@query("""SELECT o_orderkey, rule, verdict FROM (SELECT o_orderkey, o_totalprice > 200000 AS rich, o_orderstatus = 'F' AS done, o_totalprice > 200000 AND o_orderstatus = 'F' AS both_rules,
 CAST(NULL AS BOOLEAN) AS loop FROM orders) UNPIVOT INCLUDE NULLS (verdict FOR rule IN (rich, done, both_rules, loop))""")
def rules_batch(spark, d):
    o = t(spark, d, "orders").withColumn("o_limit", F.lit(200000.0))
    rules = {"rich": B.tree("rich"), "done": B.tree("done"), "both_rules": B.tree("both"), "loop": B.tree("loop")}
    return R.rules_batch(o, ["o_orderkey"], rules, Scope(trees=_TREES))


@query(f"""WITH {_HIDDEN} SELECT o_orderkey, CASE WHEN price IS NULL THEN CASE WHEN status IS NULL OR status = 'F' THEN CASE WHEN later THEN 'not-yet-known' ELSE 'not-found' END END
 WHEN price <= 150000 THEN NULL WHEN status IS NULL THEN 'not-found' END AS code,
 CASE WHEN price IS NULL THEN CASE WHEN status <> 'F' THEN FALSE END WHEN price <= 150000 THEN FALSE ELSE status = 'F' END AS truth FROM h""")
def verdict_reasons(spark, d):
    scope = Scope({"price": ColumnBinding("price", pending="later")})
    out = R.with_verdict(hidden(spark, d), "v", B.and_(_S, _P), scope=scope)
    return out.select("o_orderkey", F.col("v.code").alias("code"), F.col("v.value").alias("truth"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'division by zero' END AS message, l_quantity / nullif(l_linenumber - 3, 0) AS value FROM lineitem""")
def verdict_domain(spark, d):
    tree = B.arith("divide", B.ref("l_quantity"), B.arith("subtract", B.ref("l_linenumber"), B.lit(3)))
    out = R.with_verdict(t(spark, d, "lineitem"), "v", tree, "expression")
    return out.select("l_orderkey", "l_linenumber", F.col("v.message").alias("message"), F.col("v.value").alias("value"))


@query(f"WITH {_VOTES} SELECT o_orderkey, some_filtered AS truth, CASE WHEN some_filtered IS NULL THEN 'not-found' END AS code FROM w")
def verdict_collection(spark, d):
    out = R.with_verdict(t(spark, d, "orders"), "v", B.some("lines", _BIG, _MAYBE), scope=_lines(spark, d))
    return out.select("o_orderkey", F.col("v.value").alias("truth"), F.col("v.code").alias("code"))


@query("SELECT p_partkey, p_retailprice * 2 + 1 AS called, CAST(p_size * 3 AS DOUBLE) AS delegated FROM part")
def user_functions(spark, d):
    scope = Scope(functions={"twice_and_one": Function(lambda x: x * 2 + 1, "number", ("number",))}, delegates={"remote": Delegate(lambda payload: F.col(payload["of"]).cast("double") * 3)})
    trees = {"called": B.call("twice_and_one", B.ref("p_retailprice")), "delegated": B.delegate("remote", {"of": "p_size"})}
    return R.with_values(t(spark, d, "part"), trees, scope, "expression").select("p_partkey", *trees)


@query("""SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 OR o_orderstatus IN ('F', 'P')) AND NOT o_orderdate < TIMESTAMP '1996-01-01'
 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.01 AND l_quantity > 40)""")
def compiled_sql(spark, d):
    """The SQL text form, run with its parameters."""
    t(spark, d, "orders").createOrReplaceTempView("rl_orders")
    t(spark, d, "lineitem").createOrReplaceTempView("rl_lines")
    tree = B.all_of(
        B.or_(B.compare("gt", B.ref("o_totalprice"), B.lit(100000)), B.member_of("in", B.ref("o_orderstatus"), [B.lit("F"), B.lit("P")])),
        B.not_(B.compare("lt", B.ref("o_orderdate"), B.instant("1996-01-01"))),
        B.some("lines", B.compare("gt", B.ref("l_quantity"), B.lit(40)), B.compare("gt", B.ref("l_tax"), B.lit(0.01))),
    )
    columns = {"o_totalprice": SqlColumn("o.o_totalprice", "number"), "o_orderstatus": SqlColumn("o.o_orderstatus", "text"), "o_orderdate": SqlColumn("o.o_orderdate", "timestamp")}
    lines = SqlCollection("rl_lines", "l_orderkey = o.o_orderkey", {"l_quantity": SqlColumn("l_quantity", "number"), "l_tax": SqlColumn("l_tax", "number")})
    text, params = compile_sql(tree, columns, {"lines": lines})
    return spark.sql(f"SELECT o_orderkey FROM (SELECT * EXCEPT (o_orderdate), CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM rl_orders) o WHERE {text}", args=params)


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 60000 + l_linenumber * 1000 AS added, l_quantity * 60000 - l_linenumber * 1000 AS less, CAST(NULL AS DOUBLE) AS product, CAST(NULL AS DOUBLE) AS scaled,
 CAST(NULL AS DOUBLE) AS mixed, epoch_us(l_shipdate) // 1000 + CAST(l_quantity AS BIGINT) * 60000 AS shifted, epoch_us(l_shipdate) // 1000 + CAST(l_quantity AS BIGINT) * 60000 AS turned,
 'wrong-type' AS code FROM lineitem""")
def temporal_arithmetic(spark, d):
    """Durations with durations, numbers and instants; multiplying and scaling are wrong types."""
    scope = Scope({"q": ColumnBinding("l_quantity", "duration", "min"), "n": ColumnBinding("l_linenumber", "duration", "s")})
    q, n, at = B.ref("q"), B.ref("n"), B.ref("l_shipdate")
    trees = {
        "added": B.arith("add", q, n), "less": B.arith("subtract", q, n), "product": B.arith("multiply", q, n), "scaled": B.arith("multiply", q, B.lit(2)), "mixed": B.arith("add", B.lit(1j), n),
        "shifted": B.arith("add", at, q), "turned": B.arith("add", q, at),
    }
    out = R.with_verdict(R.with_values(t(spark, d, "lineitem"), trees, scope, "expression"), "v", trees["scaled"], "expression", scope)
    nothing = {c: F.col(c).cast("double").alias(c) for c in ("product", "scaled", "mixed")}
    return out.select("l_orderkey", "l_linenumber", "added", "less", *nothing.values(), "shifted", "turned", F.col("v.code").alias("code"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS sum_re, l_linenumber + l_discount AS sum_im, l_quantity - 2 AS less_re, CAST(l_linenumber AS DOUBLE) AS less_im, 'domain-error' AS modulo,
 CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN l_quantity ELSE l_quantity * l_quantity - l_linenumber * l_linenumber END AS power_re,
 CASE l_linenumber % 3 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(l_linenumber AS DOUBLE) ELSE 2 * l_quantity * l_linenumber END AS power_im, 'wrong-type' AS fraction FROM lineitem""")
def complex_arithmetic(spark, d):
    """Sums, differences with reals, the refused modulo, and powers by a computed exponent."""
    z = F.struct(F.col("l_quantity").alias("re"), F.col("l_linenumber").cast("double").alias("im"))
    df = t(spark, d, "lineitem").withColumns({"z": z, "w": F.struct(F.col("l_tax").alias("re"), F.col("l_discount").alias("im"))})
    z, w = B.ref("z"), B.ref("w")
    trees = {"s": B.arith("add", z, w), "m": B.arith("subtract", z, B.lit(2)), "p": B.arith("power", z, B.arith("modulo", B.ref("l_linenumber"), B.lit(3)))}
    out = R.with_verdict(R.with_values(df, trees, of="expression"), "a", B.arith("modulo", z, w), "expression")
    out = R.with_verdict(out, "b", B.arith("power", z, B.arith("add", B.ref("l_linenumber"), B.lit(0.5))), "expression")
    f = lambda c, name: F.col(c).alias(name)
    return out.select("l_orderkey", "l_linenumber", f("s.re", "sum_re"), f("s.im", "sum_im"), f("m.re", "less_re"), f("m.im", "less_im"), f("a.code", "modulo"), f("p.re", "power_re"), f("p.im", "power_im"), f("b.code", "fraction"))


@query("""SELECT o_orderkey, o_totalprice * 2 + 1 AS value, CAST(NULL AS DOUBLE) AS looped, CAST(NULL AS DOUBLE) AS missing, 'not-found' AS code FROM orders""")
def expression_references(spark, d):
    """Expressions that refer to other trees, through two references, to themselves, and to none."""
    trees = {"twice": B.arith("multiply", B.ref("o_totalprice"), B.lit(2)), "more": B.arith("add", B.tree("twice"), B.lit(1)), "self": B.negate(B.tree("self"))}
    scope = Scope(trees=trees)
    out = R.with_values(t(spark, d, "orders"), {"value": B.tree("more"), "looped": B.tree("self"), "missing": B.tree("nowhere")}, scope, "expression")
    out = R.with_verdict(out, "v", B.tree("nowhere"), "expression", scope)
    return out.select("o_orderkey", "value", F.col("looped").cast("double").alias("looped"), F.col("missing").cast("double").alias("missing"), F.col("v.code").alias("code"))


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 1 THEN max(o_orderstatus) END AS status, CASE count(o_orderkey) WHEN 0 THEN 'domain-error' WHEN 1 THEN NULL ELSE 'wrong-type' END AS code,
 max(o_totalprice) AS longest, max(epoch_us(o_orderdate) // 1000) AS latest, min(epoch_us(o_orderdate) // 1000) AS first FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 5 = 0 GROUP BY c_custkey""")
def fold_kinds(spark, d):
    """Extremes of texts (one item or a wrong type), durations and instants."""
    o = t(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    scope = Scope(collections={"orders": ChildTable(o, ["c_custkey"], ["o_custkey"], ["o_orderkey"], Scope({"p": ColumnBinding("o_totalprice", "duration", "min")}))})
    trees = {"longest": B.fold("orders", "max", B.ref("p")), "latest": B.fold("orders", "max", B.ref("o_orderdate")), "first": B.fold("orders", "min", B.ref("o_orderdate"))}
    out = R.with_verdict(R.with_values(t(spark, d, "customer").select("c_custkey"), trees, scope, "expression"), "v", B.fold("orders", "max", B.ref("o_orderstatus")), "expression", scope)
    return out.select("c_custkey", F.col("v.value").alias("status"), F.col("v.code").alias("code"), *trees)


@query("""WITH k AS (SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 4 <> 1 THEN o_totalprice END AS x FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 4 <> 1)
SELECT c_custkey, CASE WHEN isnan(arg_min(x, o_orderkey)) THEN 'NaN'::DOUBLE ELSE max(CASE WHEN NOT isnan(x) THEN x END) END AS most,
 CASE WHEN isnan(arg_min(x, o_orderkey)) THEN 'NaN'::DOUBLE ELSE min(CASE WHEN NOT isnan(x) THEN x END) END AS least FROM k GROUP BY c_custkey""")
def fold_nan(spark, d):
    """NaN takes no other value's place, and stays if it comes first."""
    o = t(spark, d, "orders").where("o_orderkey % 4 <> 1").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"))
    scope = Scope(collections={"orders": ChildTable(o, ["c_custkey"], ["o_custkey"], ["o_orderkey"])})
    trees = {"most": B.fold("orders", "max", B.ref("x")), "least": B.fold("orders", "min", B.ref("x"))}
    return R.with_values(t(spark, d, "customer"), trees, scope, "expression").select("c_custkey", *trees)


@query(f"""WITH {_HIDDEN} SELECT o_orderkey, CASE WHEN price IS NULL THEN 0.0 ELSE 1.0 END AS known, CASE WHEN price IS NULL THEN 'not-found' END AS code FROM h""")
def presence(spark, d):
    """1 where a value is known; an absent one is indeterminate inside the probe, so its reason stays with the verdict."""
    df = hidden(spark, d)
    out = R.with_value(df, "known", B.coalesce(B.presence_of(B.ref("price")), B.lit(0)))
    return R.with_verdict(out, "v", B.presence_of(B.ref("price")), "expression").select("o_orderkey", "known", F.col("v.code").alias("code"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < l_discount THEN 'domain-error' END AS root, 'wrong-type' AS count, 'wrong-type' AS kind, CASE WHEN l_quantity > 1 THEN 'domain-error' END AS arc,
 'domain-error' AS huge, 'wrong-type' AS unit FROM lineitem""")
def function_failures(spark, d):
    """Bad counts, kinds and units are wrong types; values outside a domain, and results that aren't finite, domain errors."""
    diff = B.arith("subtract", B.ref("l_tax"), B.ref("l_discount"))
    calls = {
        "root": B.call("squareRoot", diff), "count": B.call("squareRoot", diff, diff), "kind": B.call("sine", B.ref("l_returnflag")), "arc": B.call("arcSine", B.ref("l_quantity")),
        "huge": B.call("exponential", B.arith("add", B.ref("l_quantity"), B.lit(1000))), "unit": B.call("sine", B.lit(1, {"m": 1})),
    }
    out = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount", "l_returnflag", "l_quantity")
    for name, tree in calls.items():
        out = R.with_verdict(out, f"v_{name}", tree, "expression")
    return out.select("l_orderkey", "l_linenumber", *[F.col(f"v_{n}.code").alias(n) for n in calls])


#: Patterns that the portable grammar refuses.
_REFUSED = {"capture": "(a)", "back": "a\\1", "ahead": "(?=a)", "lazy": "a+?", "possessive": "a++", "flag": "(?i)a"}


@query("SELECT p_partkey, " + ", ".join(f"'wrong-type' AS {n}" for n in _REFUSED) + ", regexp_matches(p_name, '^[a-z ]*[0-9]+$') AS nested FROM part")
def refused_patterns(spark, d):
    """Captures, back references, lookaround, lazy and possessive repetition and flags; and a pattern that would backtrack without end."""
    out = t(spark, d, "part").select("p_partkey", "p_name")
    for name, pattern in _REFUSED.items():
        out = R.with_verdict(out, f"v_{name}", B.text_compare("portableMatches", B.ref("p_name"), B.lit(pattern)))
    out = R.with_truth(out, "nested", B.text_compare("portableMatches", B.ref("p_name"), B.lit("^(?:[a-z ]+)*\\d+$")))
    return out.select("p_partkey", *[F.col(f"v_{n}.code").alias(n) for n in _REFUSED], "nested")


_WIDE = "(?:ab?){4000}"


def _longest() -> int:
    from ruleloom.functions import regex as rx

    return min(rx.nfa.MAX_INPUT, rx.nfa.MAX_WORK // len(rx.Automaton(rx.parse(_WIDE)).code) - 1)


@query(f"SELECT doc_id, CASE WHEN length(text) > {_longest()} THEN 'domain-error' END AS code, CASE WHEN length(text) <= {_longest()} THEN FALSE END AS found FROM documents")
def pattern_limits(spark, d):
    """States times text length are bounded: longer texts are outside the domain."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    return R.with_verdict(docs, "v", B.text_compare("portableMatches", B.ref("text"), B.lit(_WIDE))).select("doc_id", F.col("v.code").alias("code"), F.col("v.value").alias("found"))


@query("""SELECT event_id, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS plain, CAST(event_id AS VARCHAR) AS whole, CASE WHEN event_id = 0 THEN '0' ELSE CAST(event_id AS VARCHAR) || 'e+21' END AS large FROM events WHERE event_id % 10 <> 0 AND event_id < 10""")
def number_texts(spark, d):
    """Numbers as JSON writes them."""
    from ruleloom.operators.values import text_of_number

    e = t(spark, d, "events").where("event_id % 10 <> 0 and event_id < 10")
    large = F.concat(F.col("event_id").cast("string"), F.lit("e21")).cast("double")
    return e.select("event_id", text_of_number(F.col("value")).alias("plain"), text_of_number(F.col("event_id").cast("double")).alias("whole"), text_of_number(large).alias("large"))


@query("""SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) > 400000
 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND c_acctbal > 5000""")
def compiled_sql_folds(spark, d):
    """exists, notIn and max over a child table as SQL text, with seven parameters."""
    t(spark, d, "customer").createOrReplaceTempView("rl_customers")
    t(spark, d, "orders").createOrReplaceTempView("rl_customer_orders")
    best = B.fold("orders", "max", B.ref("o_totalprice"), B.compare("gte", B.ref("o_totalprice"), B.lit(0)))
    tree = B.or_(
        B.and_(B.exists(B.ref("c_acctbal")), B.compare("gt", best, B.lit(400000))),
        B.and_(B.member_of("notIn", B.ref("c_mktsegment"), [B.lit(x) for x in ("BUILDING", "MACHINERY", "FURNITURE")]), B.compare("gt", B.ref("c_acctbal"), B.lit(5000))),
    )
    columns = {"c_acctbal": SqlColumn("c.c_acctbal", "number"), "c_mktsegment": SqlColumn("c.c_mktsegment", "text")}
    orders = SqlCollection("rl_customer_orders", "o_custkey = c.c_custkey", {"o_totalprice": SqlColumn("o_totalprice", "number")})
    text, params = compile_sql(tree, columns, {"orders": orders})
    return spark.sql(f"SELECT c_custkey FROM rl_customers c WHERE {text}", args=params)


ENTRY = quantifiers
