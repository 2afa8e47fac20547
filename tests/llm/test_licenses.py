"""License scans on small texts; the whole tables are compared with SQL."""

from joblattice.llm import licenses

MIT = licenses.TEMPLATES[7][1]


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, words int")
    return sorted(((r.id, r.label, r.first, r.last, round(r.coverage, 3)) for r in licenses.spans(docs).collect()), key=str)


def test_whole_template(spark):
    n = len(MIT.split())
    assert found(spark, [(1, f"Notice: {MIT.upper()}!")]) == [(1, "mit", 1, n, 1.0)]


def test_inserted_and_dropped_words_stay_one_span(spark):
    words = MIT.split()
    changed = words[:8] + ["new"] + words[8:15] + words[16:]
    (row,) = found(spark, [(1, " ".join(changed))])
    assert row[:4] == (1, "mit", 0, len(words) - 1) and 0.6 <= row[4] < 1


def test_two_copies_are_two_spans(spark):
    text = f"{MIT} {'filler ' * 50} {MIT}"
    assert len(found(spark, [(1, text)])) == 2


def test_scattered_runs_are_no_license(spark):
    words = MIT.split()
    text = " ".join(f"{' '.join(words[i : i + 3])} {'z ' * (i + 9)}" for i in range(0, 24, 3))
    assert found(spark, [(1, text)]) == []


def test_odd_rows(spark):
    rows = [(None, MIT), (1, None), (2, ""), (3, "a b"), (4, MIT), (4, MIT), (5, "é " * 60_000 + MIT)]
    assert [r[:2] for r in found(spark, rows)] == [(4, "mit"), (5, "mit"), (None, "mit")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.n_words for r in licenses.base_scan(docs).collect())[:3] == [0, 0, 2]
    assert licenses.base_scan(docs.limit(0)).count() == licenses.spans(docs.limit(0)).count() == 0
