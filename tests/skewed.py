"""Tables in which one key, user, source and text hold a third of all rows.

    python -m tests.skewed SOURCE_DIR TARGET_DIR

Made from the given tables with DuckDB; used to compare every query with its SQL
on data that would overload one task if a group were not split.
"""

from __future__ import annotations

import os
import sys

from tests.oracle import connect

HOT = {
    "lineitem": """SELECT CASE WHEN n % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN n % 3 = 1 THEN 11 ELSE l_partkey END AS l_partkey,
        CASE WHEN n % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey,
        (CASE WHEN n % 3 = 0 THEN n ELSE l_linenumber END)::INTEGER AS l_linenumber,
        * EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_linenumber, n)
        FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)""",
    "events": """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE ts END AS ts,
        CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id, event_type, value, props FROM events""",
    "documents": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM documents ORDER BY n_chars DESC LIMIT 1 OFFSET 40)
          ELSE text END AS text, lang, CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE source END AS source,
        CASE WHEN doc_id % 3 = 0 THEN (SELECT n_chars FROM documents ORDER BY n_chars DESC LIMIT 1 OFFSET 40) ELSE n_chars END AS n_chars
        FROM documents""",
}


def build(source: str, target: str) -> str:
    os.makedirs(target, exist_ok=True)
    con = connect(source)
    for path in os.listdir(source):
        name = path.removesuffix(".parquet")
        body = HOT.get(name, f"SELECT * FROM {name}")
        con.execute(f"COPY ({body}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return target


if __name__ == "__main__":
    print(build(sys.argv[1], sys.argv[2]))
