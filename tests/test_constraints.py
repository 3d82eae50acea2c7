from tessera.operators.constraints import Reference, Rules, beyond, empty, one_of, unlike, violations


def test_each_kind_of_rule(spark):
    people = spark.createDataFrame([(1, "a", 10, "ok-1", 0.5, " x"), (2, "a", 11, "bad", 1.5, ""), (3, "b", 99, None, None, None), (4, None, None, "ok-2", -0.1, "y"), (5, "b", 10, "ok-3", 0.0, "z"), (6, None, 11, "ok-4", 1.0, "z")], "id int, team string, office int, code string, share double, note string")
    offices = spark.createDataFrame([(10, "north"), (11, "south"), (11, "south"), (None, "nowhere")], "id int, name string")
    rules = [
        Rules(
            "people",
            "id",
            (Reference(("office",), "offices", ("id",), {"where": "name"}),),
            {"office": [("missing", "office IS NOT NULL AND where IS NULL"), ("southern", "where = 'south' AND id < 5")], "code": [("pattern", unlike("code", "^ok-[0-9]$"))], "share": [("range", beyond("share", 0, 1))], "team": [("unknown", one_of("team", ("a", "b")))], "note": [("empty", empty("note"))]},
            {"one_a_team": (("team",), "share >= 0"), "code_twice": (("code",), "true")},
        )
    ]
    got = {(r.row_id, r.guard, r.code) for r in violations(rules, {"people": people, "offices": offices}).collect()}
    assert got == {
        ("2", "office", "southern"), ("3", "office", "missing"), ("2", "code", "pattern"), ("3", "code", "pattern"), ("2", "share", "range"), ("4", "share", "range"),
        ("4", "team", "unknown"), ("6", "team", "unknown"), ("2", "note", "empty"), ("3", "note", "empty"), ("1", "one_a_team", "not_unique"), ("2", "one_a_team", "not_unique"),
    }


def test_empty_tables(spark):
    people = spark.createDataFrame([], "id int, office int")
    rules = [Rules("people", "id", (Reference(("office",), "offices", ("id",), {"w": "id"}),), {"office": [("missing", "w IS NULL")]}, {"twice": (("id",), "true")})]
    assert violations(rules, {"people": people, "offices": people}).count() == 0
    one = spark.createDataFrame([(1, 2)], "id int, office int")
    assert [tuple(r) for r in violations(rules, {"people": one, "offices": people}).collect()] == [("people", "1", "office", "missing")]
