from fathomline.operators.reports import build_context, build_prompts, format_results, lookup_report

RANKED = "query_id int, rank int, name string, content string"


def ranked(spark):
    return spark.createDataFrame(
        [(1, n, f"n{n}", f"c{n}") for n in range(12, 0, -1)] + [(2, 1, None, None)], RANKED
    ).repartition(3)


def queries(spark):
    return spark.createDataFrame([(1, "first"), (2, "second"), (3, "third")], "query_id int, query string")


def test_tool_style(spark):
    got = {r.query_id: (r.n_results, r.report) for r in format_results(ranked(spark), queries(spark)).collect()}
    lines = ["Top 12 results for: first", ""]
    for n in range(1, 13):
        lines += [f"{n}. n{n}", f"   c{n}", ""]
    assert got[1] == (12, "\n".join(lines))
    assert got[2] == (1, "Top 1 results for: second\n\n1. None\n   None\n")
    assert got[3] == (0, "No cards found matching your query.")


def test_cli_style(spark):
    got = {r.query_id: r.report for r in format_results(ranked(spark), queries(spark), "cli").collect()}
    assert got[2] == "Top 1 Results:\n\n1. None\n   None\n" + "-" * 60
    assert got[3] == "Top 0 Results:\n"


def test_context_and_prompts(spark):
    context = build_context(ranked(spark))
    got = {r.query_id: r.context for r in context.collect()}
    assert got[1].split("\n")[:2] == ["- n1: c1", "- n2: c2"] and got[1].count("\n") == 11
    prompts = {r.query_id: r.prompt for r in build_prompts(queries(spark), context).collect()}
    assert "Question: first\n" in prompts[1] and prompts[1].endswith("- n12: c12\n")
    assert prompts[3].endswith("Items:\n\n")


def test_lookup(spark):
    index = spark.createDataFrame(
        [(7, "A", "text", 4, 0, None, "fire", ["x", "y"]), (8, None, None, None, None, None, None, None)],
        "item_key int, name string, content string, level int, atk int, def_ int, english_attribute string, "
        "properties array<string>",
    )
    keys = spark.createDataFrame([(7,), (8,), (9,)], "item_key int")
    got = {r.item_key: r.report for r in lookup_report(keys, index).collect()}
    assert got[7] == (
        "Name: A\nContent: text\nLevel: 4 | ATK: 0 | DEF: None\nAttribute: fire\nProperties: ['x', 'y']"
    )
    assert got[8].startswith("Name: None\n") and got[9] == "Card with ID 9 not found."
