import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.operators.badrows import diagnose, parse_batch, separate

U = "https://a.example/x"
CASES = [
    ("TextNodes.csv", f"{U},5,plain", None),
    ("TextNodes.csv", f'{U},5,"a ""b"", c\nd"\r', None),
    ("TextNodes.csv", f"{U},5,", None),
    ("TextNodes.csv", f"{U},5,\n", None),
    ("TextNodes.csv", f"{U},5,a\n\nb", None),
    ("TextNodes.csv", f'{U},5,a "b"', "quoting"),
    ("TextNodes.csv", f'{U},5,"a"b', "quoting"),
    ("TextNodes.csv", f'{U},5,"open', "quoting"),
    ("TextNodes.csv", f"{U},5,a,b", "columns"),
    ("TextNodes.csv", "", "columns"),
    ("TextNodes.csv", f"{U},-5,a", "value"),
    ("TextNodes.csv", f"{U},2147483648,a", "value"),
    ("TextNodes.csv", f"{U},0002147483647,a", None),
    ("TextNodes.csv", f"{U},１２,a", "value"),
    ("TextNodes.csv", "ftp://a.example,5,a", "value"),
    ("TextNodes.csv", "HTTP://A:80,5,a", None),
    ("TextNodes.csv", "https://,5,a", "value"),
    ("TextNodes.csv", "https:///x,5,a", "value"),
    ("TextNodes.csv", "https://a.example/x y,5,a", "value"),
    ("TextNodes.csv", "https://a.example/x y,5,a", "value"),
    ("GoldLabels.csv", f"{U},5,a,TRUE", None),
    ("GoldLabels.csv", f"{U},5,a,1", "value"),
    ("GoldLabels.csv", f"{U},5,a", "columns"),
    ("inference_test.tsv", f'{U}\t5\tPrimary', None),
    ("inference_test.tsv", f'{U}\t5\tprimary', "value"),
    ("inference_test.tsv", f'{U}\t5\t"Primary"', "value"),
    ("inference_test.tsv", f"{U},5,Primary", "columns"),
    ("inference_test.tsv", None, "columns"),
    ("other.csv", f"{U},5,a", "columns"),
    (None, f"{U},5,a", "columns"),
]


@pytest.mark.parametrize("name,raw,reason", CASES)
def test_reason(name, raw, reason):
    assert diagnose(raw, name)[0] == reason


def test_blocks_agree_with_single_records():
    cases = CASES * 40
    batch = pa.record_batch({"row_id": list(range(len(cases))), "file_name": pa.array([c[0] for c in cases], pa.string()), "raw": pa.array([c[1] for c in cases], pa.string())})
    got = {r["row_id"]: r["reason"] for b in parse_batch(batch) for r in b.to_pylist()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["TextNodes.csv", "GoldLabels.csv", "inference_test.tsv"]), st.text(alphabet='a,"\t\n\r1hps:/. true', max_size=30)), max_size=30))
def test_any_records(rows):
    rows = [(n, f"{U},7," + t if i % 2 else t) for i, (n, t) in enumerate(rows)]
    batch = pa.record_batch({"row_id": pa.array(range(len(rows)), pa.int64()), "file_name": pa.array([r[0] for r in rows], pa.string()), "raw": pa.array([r[1] for r in rows], pa.string())})
    got = {r["row_id"]: (r["reason"], r["text"]) for b in parse_batch(batch, 8) for r in b.to_pylist()}
    want = {}
    for i, (n, t) in enumerate(rows):
        reason, typed = diagnose(t, n)
        want[i] = (reason, typed.get("text"))
    assert got == want


def test_line_breaks_outside_quotes_are_kept():
    rows = ["", f"{U},7,\n", f"{U},8,a\nb", f"{U},9,x"]
    batch = pa.record_batch({"row_id": list(range(4)), "file_name": ["TextNodes.csv"] * 4, "raw": rows})
    assert {r["row_id"]: r["text"] for b in parse_batch(batch) for r in b.to_pylist()} == {0: None, 1: "\n", 2: "a\nb", 3: "x"}


def test_table(spark):
    rows = [(i, n, r, "x") for i, (n, r, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id LONG, file_name STRING, raw STRING, reason STRING")
    sound, faulty = separate(df)
    assert {r.row_id: r.reason for r in faulty.collect()} == {i: c[2] for i, c in enumerate(CASES) if c[2]}
    assert sound.count() == sum(c[2] is None for c in CASES)
    assert separate(df.limit(0))[0].count() == 0
    long = spark.createDataFrame([(1, "TextNodes.csv", f"{U},1," + "y" * 3_000_000)], "row_id LONG, file_name STRING, raw STRING")
    assert separate(long)[0].first().text == "y" * 3_000_000


@pytest.mark.parametrize("file_name,record,reason", [("inference_test.tsv", f"{U}\t5\tPrimary\r\r", "value"), ("GoldLabels.csv", f"{U},5,a,true\r\r", "value"), ("TextNodes.csv", f"{U},5,a\r\r", None)])
def test_one_final_carriage_return(file_name, record, reason):
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array([file_name]), pa.array([record])], ["row_id", "file_name", "raw"])
    (row,) = pa.Table.from_batches(parse_batch(batch)).to_pylist()
    assert row["reason"] == reason == diagnose(record, file_name)[0]
    assert row["text"] == ("a\r" if reason is None else None)
