import pytest

SF = "/root/testdata/sf0.001"
PUBLIC = " ".join(f"public{i}" for i in range(70))


@pytest.fixture(scope="session")
def docs(spark):
    """The small table with awkward rows: nulls, empty and long texts, ties, repeated rows and clashing column names."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = [
        (9001, None, "en", None), (9002, "", None, "src1"), (9003, " \n\t ", "en", "src1"), (9004, "...!?", "en", "srcx"), (9005, "one", "en", "src0"),
        (9006, "a " * 3000, "en", "src0"), (9007, PUBLIC, "en", "src0"), (9008, "x y " + PUBLIC + " z", "en", "src2"), (9009, PUBLIC + " " + PUBLIC, "en", None),
        (9010, "Größe straße ñandú   é x idiot", "de", "src1"), (9010, "Größe straße ñandú   é x idiot", "de", "src1"), (9011, "same", "en", "src0"), (9012, "same", "en", "src0"),
    ]
    return base.unionByName(spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def messy(docs):
    """The same with names that operators use inside, and a row with a null id."""
    from pyspark.sql import functions as F

    null = docs.where("doc_id = 9005").withColumn("doc_id", F.lit(None).cast("long"))
    d = docs.unionByName(null)
    for c in ("size", "fp", "rid", "i", "h", "n", "part", "row", "score", "label", "copies", "first", "target", "start"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]
