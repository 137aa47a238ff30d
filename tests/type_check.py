"""List queries whose Spark column types differ from their DuckDB oracle's types."""
import os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from oracle import duck
from cohortlens.session import local_session

MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
       "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE",
       "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = local_session()
con = duck(SF)
qs, sql = E.queries(), E.oracle_sql()
bad = 0
for name in sorted(sql):
    s_types = dict(qs[name](spark, SF).dtypes)
    rel = con.sql(sql[name])
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diffs = [(c, s_types.get(c), d_types.get(c)) for c in sorted(set(s_types) | set(d_types))
             if MAP.get(s_types.get(c), s_types.get(c)) != d_types.get(c)]
    if diffs:
        bad += 1
        print(name, diffs)
print("queries with type differences:", bad)
