"""Line and paragraph hashing on small cases."""

from joblattice.llm import substring_dedup as dedup

A, B, C = "one two three four five six", "Seven eight nine ten eleven twelve", "x y z"


def run(spark, rows, **kwargs):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, removed int, kept string")
    found = dedup.dedup(docs, **{"stretch": 6, **kwargs}).collect()
    assert {(r.row.removed, r.row.kept) for r in found} <= {(1, "s")}
    return sorted(((r.row.doc_id, r.kept, [tuple(s) for s in r.removed]) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_earliest_stays(spark):
    rows = [(2, f"{A}\n{C}\n{B}"), (1, f"{C}\n  {A.upper()} "), (3, f"{B}\n{B}\nend"), (4, f"{A}")]
    assert run(spark, rows) == [
        (1, f"{C}\n  {A.upper()} ", []),
        (2, B, [(0, 28), (28, 34)]),
        (3, "end", [(0, 35), (35, 70)]),
        (4, "", [(0, 27)]),
    ]


def test_passages_inside_long_lines(spark):
    """Sentences have digests of their own; a stretch of them goes, a lone one stays."""
    first, second = "The one and only first sentence here. ", "A second one follows it! "
    rows = [
        (1, f"Some text before. {first}{second}And an end"), (2, f"Other words. {first}{second}More of it"),
        (3, f"Lone, though. {first}Nothing else."), (4, f"x {first}{second}"), (5, "THE one\tand only first  sentence here. a second one follows it! z"),
    ]
    found = {d: (text, removed) for d, text, removed in run(spark, rows, stretch=12)}
    assert found[1] == (rows[0][1], [])
    assert found[2] == ("Other words. More of it", [(13, 51), (51, 76)])
    assert found[3] == (rows[2][1], [])
    assert found[4] == (rows[3][1], [])  # "x the one ..." is another sentence, the rest is short
    assert found[5][0] == "z"


def test_stretches():
    unit = lambda place, n: (place, 10 * place, 10 * place + 9, n)
    again = [unit(0, 3), unit(1, 3), unit(3, 5), unit(6, 2), unit(5, 2), unit(4, 1)]
    assert dedup.passages(again, 6) == [(0, 9), (10, 19), (30, 39), (40, 49), (50, 59), (60, 69)]
    assert dedup.passages(again, 7) == [(30, 39), (40, 49), (50, 59), (60, 69)]
    assert dedup.passages(again, 11) == dedup.passages([], 1) == []


def test_short_lines_stay(spark):
    assert run(spark, [(1, C), (2, C), (3, f"{C}\n{C}")], stretch=7)[2][1] == f"{C}\n{C}"
    assert run(spark, [(1, C), (2, C), (3, f"{C}\n{C}")])[1:] == [(2, C, []), (3, "", [(0, 6), (6, 11)])]


def test_paragraphs(spark):
    rows = [(1, f"{A}\n{B}\n\n{C}"), (2, f"{A}\n\n\n{A}\n{B}\n \n{C}\n")]
    start = len(A) + 3
    end = start + len(A) + len(B) + 2
    assert run(spark, rows, unit="paragraph")[1] == (2, f"{A}\n\n\n \n", [(start, end), (end + 2, end + 8)])


def test_odd_rows(spark):
    rows = [(None, A), (None, None), (1, ""), (1, ""), (5, A), (5, A), (6, "é" * 40_000 + f"\n{A}\r"), (7, "\n\n")]
    found = run(spark, rows)
    assert found[:6] == [(1, "", []), (1, "", []), (5, A, []), (5, A, []), (6, "é" * 40_000 + "\n", [(40_001, 40_029)]), (7, "\n\n", [])]
    assert found[6:] == [(None, None, []), (None, "", [(0, 27)])]
    assert run(spark, []) == []
