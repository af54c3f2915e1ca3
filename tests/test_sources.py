import tempfile

from conftest import SF
from vintage.sources import TXN_SCHEMA, read_transactions, transactions_from_tables, write_transactions


def test_mapping_counts(spark):
    t = transactions_from_tables(spark, SF)
    assert [(f.name, f.dataType) for f in t.schema] == [(f.name, f.dataType) for f in TXN_SCHEMA]
    # FIXTURES.md §3, sf 0.001
    assert t.count() == 6000
    assert t.where("customer_id is not null").count() == 5933
    assert t.where("transaction_date is not null").count() == 5939
    assert t.where("transaction_amount is not null").count() == 5895


def test_parquet_and_csv_round_trip(spark, golden):
    base = tempfile.mkdtemp(prefix="vintage-src-")
    for fmt in ("parquet", "csv"):
        path = f"{base}/{fmt}"
        write_transactions(golden, path, fmt=fmt)
        back = read_transactions(spark, path, fmt=fmt)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in TXN_SCHEMA]
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, golden.collect()), key=str)


def test_csv_bad_values_become_missing(spark):
    base = tempfile.mkdtemp(prefix="vintage-csv-")
    header = ("transaction_id,customer_id,transaction_date,first_transaction_month,transaction_amount,"
              "quantity,frequency_of_payment,product_type,country,transaction_item_code,"
              "transaction_item_description\n")
    with open(f"{base}/t.csv", "w") as fh:
        fh.write(header)
        fh.write("t1,c1,2010-01-05,2010-01-01,12.50,2,monthly,fast_moving_consumer_goods,United Kingdom,i1,d1\n")
        fh.write("t2,c2,not-a-date,2010-01-01,abc,1,monthly,durables,France,i2,d2\n")
    rows = {r.transaction_id: r for r in read_transactions(spark, base, fmt="csv").collect()}
    assert len(rows) == 2
    assert str(rows["t1"].transaction_amount) == "12.50" and rows["t1"].transaction_date.isoformat() == "2010-01-05"
    assert rows["t2"].transaction_date is None and rows["t2"].transaction_amount is None
    assert rows["t2"].customer_id == "c2"
