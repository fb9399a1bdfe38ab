"""Line dedup where rows share an id, or have none, but not a text."""

from lapwing.llm import line_dedup


def test_rows_without_an_own_id(spark):
    shared, twice = "A line that the first document has.", "A line of two rows without an id."
    rows = [
        (1, shared + "\nx"),
        (None, shared + "\nown words of one"),
        (None, "Unique text at the same number.\nown words of two"),
        (None, twice),
        (None, twice + "\nz"),
        (7, shared),
        (7, "The other text of seven stays."),
    ]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.text) for r in out)
    ends = [[(0, ""), (0, twice + "\nz")], [(0, twice), (0, "z")]]
    rest = [(1, shared + "\nx"), (0, "own words of one"), (0, "Unique text at the same number.\nown words of two"), (7, ""), (7, "The other text of seven stays.")]
    assert got in [sorted(rest + e) for e in ends]
    assert sum(r.n_exact for r in out) == 3 and sum(r.n_near for r in out) == 0
