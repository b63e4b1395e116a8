from lectern.operators import extraction


def test_markscheme_rows_go_beyond_two_digits(spark):
    said = ["99. last of two", "on", "100. first of three", "1219538112535716 is no row", "(b) part", "123. (a) both", "99999999999. no number"]
    d = spark.createDataFrame([(1, k, t) for k, t in enumerate(said)], "doc long, k int, t string")
    got = {(r["number"], r["letter"]): r["content"] for r in extraction.markscheme_rows(d, ["doc"], "k", "t").collect()}
    assert got == {(99, None): "\n".join(said[:2]), (100, None): "\n".join(said[2:4]), (100, "b"): said[4], (123, "a"): "\n".join(said[5:])}
    d = spark.createDataFrame([(1, 0, "7. ", "7. x"), (1, 1, "", "8. y")], "doc long, k int, opens string, t string")
    assert [r["content"] for r in extraction.markscheme_rows(d, ["doc"], "k", "t", "opens").collect()] == ["7. x\n8. y"]
