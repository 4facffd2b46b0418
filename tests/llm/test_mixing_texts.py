"""The mixture's texts: dealt evenly, each row with its own, whatever the order of sizes."""

from collections import Counter

from siftline.llm import mixing


def test_texts_are_not_ordered_by_size(spark, messy, monkeypatch):
    """The longest texts of a source would stand in one task."""
    made, copy = {}, mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, name: made.setdefault(name, copy(df, name)))
    got = Counter((r["doc_id"], r["text"]) for r in mixing.emit(messy).select("doc_id", "text").collect())
    assert "i" in made["mix"].columns and not {"row", "text"} & set(made["mix"].columns)
    monkeypatch.undo()
    copies = Counter()
    for r in mixing.mix(messy).select("doc_id", "copies").collect():
        copies[r["doc_id"]] += r["copies"]
    by_id = Counter()
    for (i, _), n in got.items():
        by_id[i] += n
    assert by_id == +copies
    texts = {(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()}
    assert got.keys() <= texts


def test_rows_differ_in_other_columns_alone(spark):
    """Rows of one id and text stay apart: the mixture takes as many as of any rows, and no row oftener than another by more than one."""
    d = spark.createDataFrame([(7, "a b c", "s", i) for i in range(40)], "doc_id long, text string, source string, n int")
    got = Counter(r["n"] for r in mixing.emit(d, share=1.0).collect())
    assert sum(got.values()) == mixing.mix(d, share=1.0).agg({"copies": "sum"}).first()[0] == 40
    assert all(got[i] == 1 for i in range(40))
