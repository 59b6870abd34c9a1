"""Routes whose conditions hold always or never, on small tables."""

from gristmill.operators import route_checks as rk

ENTRIES = "workflow string, flow string, position int, pointer string, operator string, operands array<string>"


def test_problems(spark):
    rows = [
        ("w", "a", 0, "/k", "equals", ['"x"']), ("w", "a", 1, "/k", "in", ['"x"', '"q"']), ("w", "a", 2, "/k", "equals", ['"none"']), ("w", "a", 3, "/k", "not_equals", ['"x"']), ("w", "a", 4, "/k", "in", ['"y"', '"z"']), ("w", "a", 5, None, None, None),
        ("w", "b", 0, "/n", "gt", ["0"]), ("w", "b", 1, "/n", "lt", ["2"]), ("w", "b", 2, "/n", "gt", ["5"]), ("w", "b", 3, None, None, None),
        ("w", "c", 0, "/k", "not_equals", ['"none"']), ("w", "c", 1, "/n", "gt", ["2"]), ("w", "c", 2, None, None, None),
        ("w", "d", 0, "/unknown", "equals", ["1"]), ("w", "d", 1, "/unknown", "equals", ["1"]), ("w", "d", 2, None, None, None),
        ("w", "e", 0, "/m", "equals", ["1.0"]), ("w", "e", 1, "/m", "equals", ["1"]), ("w", "e", 2, "/m", "in", ['{"b": 1, "a": 2}']),
    ]
    values = [("w", "/k", f'"{x}"') for x in "xyz"] + [("w", "/m", x) for x in ("1", '{"a":2,"b":1}')]
    got = rk.route_problems(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame(values, "workflow string, pointer string, value string"), spark.createDataFrame([("w", "/n", 1, 4)], "workflow string, pointer string, low int, high int"))
    assert sorted((r["flow"], r["position"], r["problem"]) for r in got.collect()) == [
        ("a", 1, "route_unreachable_entry"), ("a", 2, "condition_always_false"), ("a", 2, "route_unreachable_entry"), ("a", 4, "route_unreachable_entry"),
        ("b", 0, "condition_always_true"), ("b", 1, "route_unreachable_entry"), ("b", 2, "condition_always_false"), ("b", 2, "route_unreachable_entry"),
        ("c", 0, "condition_always_true"), ("c", 1, "route_unreachable_entry"), ("c", 2, "route_unreachable_entry"),
        ("e", 1, "route_unreachable_entry"),
    ]


def test_conditions_meet_elements_in_one_row(spark):
    """No row for each condition and element: two joins by workflow, of tables that are read once; texts in odd forms too."""
    rows = [
        ("w", "a", 0, "/k", "in", ['"\\u0078"', " 1"]), ("w", "a", 1, "/k", "equals", ['"x"']), ("w", "a", 2, "/k", "equals", ["1.0"]), ("w", "a", 3, "/k", "equals", ["-0"]), ("w", "a", 4, None, None, None),
        ("w", "b", 0, "/k", "not_in", ['"é"', '{"b":1, "a":2}']), ("w", "b", 1, "/k", "equals", ['{"a":2,"b":1}']), ("w", "b", 2, "/k", "equals", ["nonsense"]), ("w", "b", 3, None, None, None),
        ("w", None, 0, "/k", "equals", ['"x"']), ("w", "c", None, "/k", "equals", ['"none"']), (None, "a", 0, "/k", "equals", ['"none"']), ("v", "a", 0, "/k", "equals", ['"x"']),
    ]
    values = [("w", "/k", v) for v in ('"x"', "1", "0", '{"a": 2, "b": 1}', '"\\u00e9"')]
    got = rk.route_problems(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame(values, "workflow string, pointer string, value string"), spark.createDataFrame([], "workflow string, pointer string, low int, high int"))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sum(line.strip(" +-:*(0123456789)").startswith(("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) for line in plan.splitlines()) <= 2
    assert sorted((r["flow"], r["position"], r["problem"]) for r in got.collect()) == [
        ("a", 1, "route_unreachable_entry"), ("a", 2, "route_unreachable_entry"),
        ("b", 2, "condition_always_false"), ("b", 2, "route_unreachable_entry"),
    ]


def test_cases(spark):
    cases = spark.createDataFrame([("w", "f", "/k", "x"), ("w", "f", "/k", "no"), ("w", "g", "/u", "x"), ("w", "g", "/u", "y")], "workflow string, flow string, pointer string, key string")
    values = spark.createDataFrame([("w", "/k", '"x"'), ("w", "/k", '"y"'), ("w", "/k", "3"), ("w", "/k", "null")], "workflow string, pointer string, value string")
    got = sorted(map(str, (tuple(r) for r in rk.case_problems(cases, values).collect())))
    assert got == sorted(map(str, [("w", "f", "no", "unmatched_case"), ("w", "f", "y", "uncovered_value"), ("w", "g", None, "case_on_unknown_type")]))
