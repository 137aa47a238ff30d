"""Strict variant of the oracle compare: no rounding by the harness, so every double the
oracle SQL returns must already be rounded like the Spark side (the registry rounds to 6)."""
import math, os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from oracle import duck
from cohortlens.session import local_session

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = local_session()
con = duck(SF)
qs, sql = E.queries(), E.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    return "NULL" if v is None else str(v)


bad = []
for name in sorted(sql):
    s = qs[name](spark, SF)
    cols = sorted(s.columns)
    srows = sorted("|".join(norm(r[c]) for c in cols) for r in s.collect())
    d = con.execute(sql[name])
    dcols = [x[0] for x in d.description]
    idx = [dcols.index(c) for c in cols]
    drows = sorted("|".join(norm(r[i]) for i in idx) for r in d.fetchall())
    if srows != drows:
        diff = sorted(set(srows) - set(drows))[:1], sorted(set(drows) - set(srows))[:1]
        bad.append(name)
        print("DIFF", name, diff)
print("strict mismatches:", len(bad), bad)
