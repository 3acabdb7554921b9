"""Run registered queries next to their SQL: python -m checks.run [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb


def rows_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    return sorted(columns), sorted("|".join(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    from checks.queries import ORACLE, QUERIES
    from factsieve.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        try:
            t0 = time.time()
            df = QUERIES[name](spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            verdict = f"rows only {len(got[1])}"
            if name in ORACLE:
                cur = con.execute(ORACLE[name])
                want = rows_of([d[0] for d in cur.description], cur.fetchall())
                verdict = f"ok {len(got[1])}" if got == want else f"DIFFERS spark {len(got[1])} sql {len(want[1])}"
                if got != want:
                    bad += 1
                    if got[0] != want[0]:
                        verdict += f" columns {got[0]} vs {want[0]}"
                    a, b = set(got[1]), set(want[1])
                    verdict += f"\n   spark only: {sorted(a - b)[:3]}\n   sql only:   {sorted(b - a)[:3]}"
            print(f"{name:28s} {t1 - t0:6.2f}s sql {time.time() - t1:5.2f}s {verdict}", flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"{name:28s} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
