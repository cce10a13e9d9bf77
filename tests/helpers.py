"""What several test modules share."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark_df, duck_df) -> None:
    """Equal columns and rows in any order, floats to six digits.

    A column of integers with nulls may come as floats or as nullable integers.
    """
    a, b = (df[sorted(df.columns)].copy() for df in (spark_df, duck_df))
    assert list(a.columns) == list(b.columns)

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or isinstance(v, float) and v != v or str(v) in ("NaT", "<NA>"):
            return "NULL"
        if isinstance(v, float):
            return str(int(v) if v.is_integer() else round(v, 6))
        return str(v)

    rows = [sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False)) for df in (a, b)]
    assert rows[0] == rows[1]
