from provloom.plans import casework as plans

DATA = "/root/testdata/sf0.001"


def test_every_row_is_scored(spark):
    want = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    got = plans.queries()["calibrated_residuals"](spark, DATA).cache()
    assert got.where("score is not null and q between 0 and 1").count() == want.count()
    assert want.exceptAll(got.select("l_orderkey", "l_linenumber")).isEmpty()
    print("rows", got.count(), "of even orders", got.where("l_orderkey % 2 = 0").count())
