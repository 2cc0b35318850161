"""Shared by the tests of the corpus operators."""


def rows_by_id(df, *columns):
    rows = df.collect()
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows}
