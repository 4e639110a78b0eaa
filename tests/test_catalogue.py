"""Every catalogued query beside its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tidemark.catalogue import DAY, START
from tidemark.run_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(([one(v) for v in r] for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_means_at_a_bound_do_not_hang_on_files(spark, tmp_path):
    """Three values whose mean is 100 or just less, by the order in which they are added; each day's rows come in another order of files."""
    values = [5.09, 108.28, 186.63]
    assert (values[0] + values[1] + values[2]) / 3 / 100 == 1 and (values[2] + values[1] + values[0]) / 3 / 100 < 1
    rows = pd.DataFrame([(day * 3 + i, START + day * DAY + i, 0, "view", v, '{"k": 1}') for day in range(60) for i, v in enumerate(values)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    rows["ts"] = pd.to_datetime(rows["ts"], unit="ms").astype("datetime64[us]")
    (tmp_path / "events.parquet").mkdir()
    for n in range(3):
        rows[(rows["event_id"] // 3 + rows["event_id"] % 3) % 3 == n].to_parquet(tmp_path / "events.parquet" / f"{n}.parquet", index=False)
    found = QUERIES["q_joint_transitions"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(0, "v,u", "elevated,stable", "elevated,stable", 59)]


@pytest.mark.parametrize("name", ["q_joint_transitions", "q_transitions", "q_domain_bouts"])
@pytest.mark.parametrize("odd", ["no k", "no value", "NaN", "repeated", "no id", "early"])
def test_odd_days_beside_sql(spark, tmp_path, name, odd):
    rows = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id").reset_index(drop=True)
    third = rows.index % 3 == 0
    if odd == "no k":
        rows.loc[third, "props"] = None
    elif odd == "no value":
        rows.loc[third, "value"] = None
    elif odd == "NaN":
        rows.loc[third, "value"] = float("nan")
    elif odd == "repeated":
        rows = pd.concat([rows] * 7)
    elif odd == "no id":
        rows["event_id"] = rows["event_id"].astype("Int64").mask(third)
    else:
        rows["ts"] -= pd.Timedelta(days=12)
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    table = pa.Table.from_pandas(rows, preserve_index=False)
    if odd == "NaN":
        table = table.set_column(table.column_names.index("value"), "value", pa.array(rows["value"].to_numpy(), from_pandas=False))
    pq.write_table(table, tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert normal(QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(con.execute(ORACLES[name]).df())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
