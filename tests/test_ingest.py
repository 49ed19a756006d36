import csv
import pathlib
import random
import uuid
from contextlib import contextmanager
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loanscope.operators import clean, export
from loanscope.sources import csv_ingest, csv_records
from loanscope.streaming.ingest import run_csv_append, start_csv_append

HEADER = ("id,loan_amnt,term,int_rate,installment,grade,annual_inc,purpose,issue_d,dti,addr_state,"
          "loan_status,total_pymnt,total_rec_prncp,total_rec_int,recoveries,audit_note\n")


def _write(path, body):
    path.write_text(HEADER + body)


def test_csv_quoted_newlines_na_tokens_and_bad_numbers(spark, tmp_path):
    f = tmp_path / "in" / "loans.csv"
    f.parent.mkdir()
    _write(f, '1,1000,"36 months",13.5%,30.5,A,50000,car,Dec-2018,1.5,CA,Fully Paid,1,1,0,0,"a ""quoted""\nnote"\n'
              '2,NA,"36 months",12.5abc,N/A,B,,debt,Foo-2018,nan,NY,Current,1,1,0,0,  \n'
              '3,2500,"60 months",7,40,C,-5,home,Jan-2017,2,TX,NULL,1,1,0,0,\n')
    rows = {r.id: r for r in csv_ingest.read_raw_csv(spark, str(f.parent), multiline=True).collect()}
    assert rows["1"].loan_amnt == Decimal("1000.00") and rows["1"].audit_note == 'a "quoted"\nnote'
    assert rows["2"].loan_amnt is None and rows["2"].installment is None and rows["2"].annual_inc is None
    assert rows["2"].dti is None and rows["2"].audit_note == "  "  # blanks are text, not NA
    assert rows["3"].loan_status is None and rows["3"].audit_note is None
    ids = [r.loan_id for r in sorted(rows.values(), key=lambda r: r.id)]
    assert ids == sorted(ids)  # ingest order


def test_missing_input_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_ingest.read_raw_csv(spark, str(tmp_path / "nope.csv"))


def test_ingest_counts_and_stream_append_match(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    for i in range(3):
        _write(d / f"part{i}.csv", "".join(
            f"{i}-{j},{1000 + j},36 months,10%,30,A,{40000 + j},car,Jan-2017,1,CA,Fully Paid,1,1,0,0,x\n"
            for j in range(5)))
    n = csv_ingest.ingest_csv(spark, str(d), str(tmp_path / "raw"))
    assert n == 15
    out = run_csv_append(spark, str(d), str(tmp_path / "raw_stream"), str(tmp_path / "ckpt"))
    assert out.count() == 15 and out.select("loan_id").distinct().count() == 15
    # A second run over the same folder appends nothing (files already committed).
    out2 = run_csv_append(spark, str(d), str(tmp_path / "raw_stream"), str(tmp_path / "ckpt"))
    assert out2.count() == 15


def test_stream_lists_files_without_their_lines(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    for i in range(3):
        _write(tmp_path / "in put" / f"p {i}.csv", "".join(f"{i}-{j},1,36 months,10%,3,A,4,car,Jan-2017,1,CA,Fully Paid,1,1,0,0,x\n" for j in range(50)))
    (tmp_path / "in put" / "a.csv").write_text("")  # not counted: it has no header
    q = start_csv_append(spark, str(tmp_path / "in put"), str(tmp_path / "t"), str(tmp_path / "c"), max_files_per_trigger=2)
    q.awaitTermination()
    assert 0 < sum(p["numInputRows"] for p in q.recentProgress) <= 4  # files, not lines
    rows = spark.read.parquet(str(tmp_path / "t")).select("id", "loan_id").collect()
    assert len(rows) == 150 and sorted({r.loan_id >> csv_ingest.PLACE_BITS for r in rows}) == [0, 1, 2]


def test_summary_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("B", 2), ("A", 1)], "grade string, n long")
    export.write_csv(df, str(tmp_path / "out"), "grade")
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert [tuple(r) for r in back] == [("A", "1"), ("B", "2")]


ROW = {"id": "1", "loan_amnt": "1000", "term": "36 months", "int_rate": "13.5%", "installment": "30.5", "grade": "A", "annual_inc": "50000",
       "purpose": "car", "issue_d": "Dec-2018", "dti": "1.5", "addr_state": "CA", "loan_status": "Fully Paid", "total_pymnt": "111",
       "total_rec_prncp": "1", "total_rec_int": "0", "recoveries": "0"}


def _file(path, names, *rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join([",".join(names), *[",".join((ROW | r).get(n, "") for n in names) for r in rows]]) + "\n")


def test_columns_are_bound_by_name(spark, tmp_path):
    names = list(ROW)
    _file(tmp_path / "in/a.csv", ["id", "member_id", *names[1:], "url"], {"member_id": "777", "url": "u"})
    _file(tmp_path / "in/b.csv", names[::-1], {"id": "2", "loan_amnt": "2000"})
    rows = {r.id: r for r in csv_ingest.read_raw_csv(spark, str(tmp_path / "in")).collect()}
    assert rows["1"].loan_amnt == Decimal("1000.00") and rows["1"].grade == "A" and rows["1"].annual_inc == Decimal("50000.00")
    assert (rows["1"].member_id, rows["1"].url, rows["2"].member_id) == ("777", "u", None)
    assert rows["2"].loan_amnt == Decimal("2000.00") and rows["2"].total_pymnt == Decimal("111.00")
    _file(tmp_path / "bad/a.csv", [n for n in names if n != "grade"], {})
    with pytest.raises(ValueError, match="grade"):
        csv_ingest.read_raw_csv(spark, str(tmp_path / "bad"))
    _file(tmp_path / "in2/a.csv", ["url", *names], {"url": "v"})
    out = run_csv_append(spark, str(tmp_path / "in2"), str(tmp_path / "t"), str(tmp_path / "c")).first()
    assert (out.grade, out.url) == ("A", "v")


def test_ids_follow_file_name_and_place(spark, tmp_path):
    names = list(ROW)
    _file(tmp_path / "in/part0.csv", names, {"total_pymnt": "111"})
    _file(tmp_path / "in/part1.csv", names, *[{"id": str(i + 5), "loan_amnt": str(2000 + i)} for i in range(400)], {"total_pymnt": "222"})
    for multiline in (True, False):
        raw = csv_ingest.read_raw_csv(spark, str(tmp_path / "in"), multiline)
        ids = [r.loan_id for r in raw.orderBy("loan_id").collect()]
        assert len(set(ids)) == 402 and raw.orderBy("loan_id").first().total_pymnt == Decimal("111.00")
        kept = clean.build_clean(raw)  # the first ingested of two equal loans stays
        assert kept.where("loan_amount = 1000").first().total_payment_received == Decimal("111.00") and kept.count() == 401


def test_duplicates_are_told_by_values_as_read(spark, tmp_path):
    _file(tmp_path / "in/a.csv", list(ROW), {"annual_inc": "50000.001"}, {"annual_inc": "50000.004"}, {"annual_inc": "50000.0010"},
          {"dti": "abc"}, {"dti": "xyz"}, {"dti": "abc"})
    assert clean.build_clean(csv_ingest.read_raw_csv(spark, str(tmp_path / "in"))).count() == 4


@contextmanager
def splits_of(spark, size):
    """Scans in splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, (size, "0", "1")):
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def jobs_of(spark, act):
    """What ``act`` returns, and how many jobs it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    out = act()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def _cell(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice('ab ,"\n') for _ in range(rng.randint(0, 12)))
    if kind < 0.35:
        return '"\n\n"' + "x" * rng.randint(0, 80) + "\n"
    return rng.choice(["x", "1", "foo bar", "é", ""])


@pytest.mark.parametrize("end, size", [("\n", "97"), ("\r\n", "97"), ("\n", "3k"), ("\n", "1m")])
def test_records_by_split_equal_the_multiline_reader(spark, tmp_path, end, size):
    rng = random.Random(size)
    b = "b\nq" if end == "\n" else "b"  # the reader takes the first line end it sees for all
    for f in range(2):
        with open(tmp_path / f"f {f}.csv", "w", newline="") as h:
            w = csv.writer(h, lineterminator=end)
            w.writerow(["i", "a", b, "c"])
            w.writerows([f"{f}-{i}", _cell(rng), _cell(rng), _cell(rng)] for i in range(300))
            h.write(f's1,a"b,"c"d,{end}{end}s2,,"",x""{end}')  # quotes inside values, a blank line
    schema = "i string, a string, b string, c string"
    whole = spark.read.schema(schema).options(header=True, multiLine=True, **csv_ingest._OPTIONS).csv(str(tmp_path))
    with splits_of(spark, size):
        cut = csv_records.records(spark, str(tmp_path))
        parsed = cut.select("file", "start", "at", F.from_csv("record", schema, csv_ingest._OPTIONS | {"multiLine": "true"}).alias("r")).collect()
        tasks = csv_records.lines(spark, str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 50 or size != "97"
    got = [tuple(x.r) for x in parsed if x.r.i != "i"]
    assert sorted(got, key=str) == sorted((tuple(r) for r in whole.collect()), key=str)
    order = [x.r.i for x in sorted(parsed, key=lambda x: (x.file, x.start, x.at))]
    assert order == [x for f in range(2) for x in ("i", *[f"{f}-{i}" for i in range(300)], "s1", "s2")]


def test_a_file_with_quoted_newlines_is_read_by_many_tasks(spark, tmp_path):
    names = [*ROW, "audit_note"]
    rows = [ROW | {"id": str(i), "loan_amnt": str(1000 + i), "audit_note": f'line "{i}"\nof, two' if i % 3 else "plain"} for i in range(900)]
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "one.csv", "w", newline="") as h:
        w = csv.writer(h)
        w.writerow(names)
        w.writerows([r[n] for n in names] for r in rows)
    want = spark.read.options(header=True, multiLine=True, **csv_ingest._OPTIONS).csv(str(tmp_path / "in"))
    with splits_of(spark, "4k"):
        raw, jobs = jobs_of(spark, lambda: csv_ingest.read_raw_csv(spark, str(tmp_path / "in")))
        got = raw.orderBy("loan_id").collect()
        assert csv_records.lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 20
    assert [(r.id, r.audit_note) for r in got] == [(r["id"], r["audit_note"]) for r in rows] == [(r.id, r.audit_note) for r in want.collect()]
    assert len({r.loan_id for r in got}) == 900 and jobs < 30  # none of them by split or by record
    broken = csv_records.surveyed(spark, str(tmp_path / "in")).first()
    assert broken.broken and broken.head.rstrip("\r") == ",".join(names)


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    names = list(ROW)
    for i in range(400):
        _file(tmp_path / f"in/{i:03}.csv", names if i % 2 else names[::-1], {"id": str(i), "loan_amnt": str(1000 + i)})
    (found, _), jobs = jobs_of(spark, lambda: csv_ingest.sources(spark, str(tmp_path / "in")))
    assert len(found) == 400 and jobs <= 2  # the scan, and its shuffle where it is a job of its own
    raw = csv_ingest.read_raw_csv(spark, str(tmp_path / "in"))
    assert [(r.id, r.loan_amnt) for r in raw.orderBy("loan_id").collect()] == [(str(i), Decimal(1000 + i)) for i in range(400)]


def test_stream_restarted_with_other_batches_keeps_ids_apart(spark, tmp_path):
    for i in range(4):
        _file(tmp_path / f"in/{i}.csv", list(ROW), {"id": str(i)})
    run_csv_append(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), max_files_per_trigger=4)
    for i in range(4, 9):
        _file(tmp_path / f"in/{i}.csv", list(ROW), {"id": str(i)})
    out = run_csv_append(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), max_files_per_trigger=2)
    assert out.count() == 9 == out.select("loan_id").distinct().count()


def test_ingest_summary_tells_every_column_by_a_checksum(spark):
    """Values that change places between records change no total of their column, other values do."""
    from loanscope.plans.registry import _ingest_summary
    from loanscope.schema import RAW_SCHEMA
    names = [f.name for f in RAW_SCHEMA.fields if f.name not in ("id", "purpose")] + ["audit_note"]
    sums = lambda rows: {r.column: r.checksum for r in _ingest_summary(spark.createDataFrame(rows, "loan_id long, id string, purpose string").selectExpr(
        "*", *[f"cast(null as string) as {c}" for c in names])).collect()}
    a, b, c = sums([(1, "x", "car"), (2, "y", None)]), sums([(1, "y", "car"), (2, "x", None)]), sums([(1, "x", "house"), (2, "y", None)])
    assert a["id"] == b["id"] > 0 and a["loan_id"] != b["loan_id"]
    assert a["purpose"] != c["purpose"] and a["id"] == c["id"] and a["purpose"] > 0 == a["grade"]


def _tables(folder, n=3000):
    """The tables under the loan records, of rows made here: every tenth lineitem without a tax."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq
    k = range(n)
    made = {
        "nation": {"n_nationkey": [0, 1], "n_name": ["N 0", "N \"1\""]},
        "customer": {"c_custkey": [*range(50)], "c_nationkey": [i % 2 for i in range(50)], "c_acctbal": [100.25 * i - 300 for i in range(50)],
                     "c_mktsegment": ["AUTO" if i % 3 else "BUILDING" for i in range(50)]},
        "part": {"p_partkey": [*range(70)], "p_size": pa.array([1 + i % 50 for i in range(70)], pa.int32())},
        "orders": {"o_orderkey": [*range(n // 4)], "o_custkey": [i % 50 for i in range(n // 4)], "o_orderstatus": ["FOP"[i % 3] for i in range(n // 4)],
                   "o_orderdate": pa.array([datetime.datetime(1992 + i % 7, 1 + i % 12, 3) for i in range(n // 4)], pa.timestamp("us"))},
        "lineitem": {"l_orderkey": [i // 4 for i in k], "l_partkey": [i * 7 % 70 for i in k], "l_suppkey": [i * 3 % 41 for i in k],
                     "l_linenumber": pa.array([1 + i % 4 for i in k], pa.int32()), "l_quantity": [float(1 + i % 50) for i in k],
                     "l_extendedprice": [900.0 + 13.25 * (i * 31 % 4001) for i in k], "l_discount": [i % 11 / 100 for i in k],
                     "l_tax": [i % 9 / 100 if i % 10 else None for i in k], "l_returnflag": ["NRA"[i % 3] for i in k], "l_linestatus": ["OF"[i % 2] for i in k]},
    }
    for name, columns in made.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


def _bytes(folder):
    return sum(f.stat().st_size for f in pathlib.Path(folder).glob("part-*"))


def test_csv_ingest_takes_a_fraction_of_its_text_on_disk(spark, tmp_path):
    """The text is staged compressed and straight from the build: no copy of the raw table beside it."""
    from loanscope.plans import registry
    from loanscope.sources import tables
    d = _tables(tmp_path)
    stored = lambda: {k[1] for k in tables._MATERIALISED if k[2] == d}
    staged = lambda: [p for k, p in registry._STAGED.items() if k[1] == d]
    got = sorted(registry.QUERIES["csv_ingest"](spark, d).collect())
    own, = staged()
    assert "loans_raw" not in stored()
    plain = sorted(registry.QUERIES["stream_ingest"](spark, d).collect())  # its text stays plain: files that can be split
    text, = set(staged()) - {own}
    path = lambda p: p.removeprefix("file:")
    assert 0 < 3 * _bytes(path(own)) < _bytes(path(text))
    raw = tables.raw_loans(spark, d)
    assert got == plain == sorted(registry._ingest_summary(raw).collect()) and got[0].n_rows == raw.count() > 3000
    with tables.raw_loans_once(spark, d) as again:  # now there is a stored table: it is read
        assert again.inputFiles() and all("loans_raw" in f for f in again.inputFiles())


def test_compressed_files_hold_few_records_and_give_the_same_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_ingest, "COMPRESSED_RECORDS", 100)
    rows = [ROW | {"id": f"{i:04}", "loan_amnt": str(1000 + i), "purpose": None if i % 5 == 0 else 'a "b"\nc' if i > 700 else "car", "audit_note": "  "} for i in range(950)]
    raw = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{n} string" for n in rows[0])).coalesce(1)
    back = {}
    for compressed in (False, True):
        csv_ingest.write_raw_csv(raw, str(tmp_path / f"{compressed}"), compressed)
        back[compressed] = csv_ingest.read_raw_csv(spark, str(tmp_path / f"{compressed}")).orderBy("loan_id").collect()
    files = list((tmp_path / "True").glob("part-*"))
    assert len(files) == 10 and all(f.name.endswith(".csv.gz") for f in files)
    assert [r.asDict() | {"loan_id": 0} for r in back[True]] == [r.asDict() | {"loan_id": 0} for r in back[False]]
    assert [r.id for r in back[True]] == [r["id"] for r in rows] and len({r.loan_id for r in back[True]}) == 950


def test_ingested_table_is_stored_by_zstd(spark, tmp_path):
    import pyarrow.parquet as pq
    _file(tmp_path / "in/a.csv", list(ROW), {}, {"id": "2"})
    assert csv_ingest.ingest_csv(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 2
    found = [pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in (tmp_path / "out").glob("part-*")]
    assert found and set(found) == {"ZSTD"}


@pytest.mark.parametrize("quotes", [True, False])
def test_survey_keeps_one_line_a_file_and_sorts_none(spark, tmp_path, quotes, capsys):
    _file(tmp_path / "in/a.csv", list(ROW), {}, {"id": "2"})
    (tmp_path / "in/b.csv").write_text('\n \nx,y\n1,"2\n3"\n')
    found = csv_records.surveyed(spark, str(tmp_path / "in"), quotes)
    assert sorted((r.file[-5:], r.head, r.broken) for r in found.collect()) == [("a.csv", ",".join(ROW), False), ("b.csv", "x,y", quotes)]
    found.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "Sort" not in plan


def test_ids_are_counted_by_words_of_bits(spark, capsys):
    from loanscope.plans.registry import _ingest_summary
    from loanscope.schema import RAW_SCHEMA
    names = [f.name for f in RAW_SCHEMA.fields] + ["audit_note"]
    of = lambda ids: _ingest_summary(spark.createDataFrame([(i,) for i in ids], "loan_id long").selectExpr(
        "loan_id", *[f"cast(null as string) as {c}" for c in names]))
    for ids in ([], [None], [5, 5, None], [0, 63, 64, -1, -64, -65, (1 << 63) - 1, -(1 << 63), 63, -65], [*range(-200, 300), *range(100)]):
        r = next(r for r in of(ids).collect() if r.column == "loan_id")
        assert (r.n_rows, r.n_null) == (len(ids), len(ids) - len(set(ids) - {None}))
    of([1]).explain()
    moved = [x for x in capsys.readouterr().out.split("\n") if "Exchange hashpartitioning" in x]
    assert moved and not any("loan_id" in x for x in moved)


def test_shuffles_of_the_staging_are_freed_and_the_setting_left(spark, tmp_path):
    from loanscope.sources import tables
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with tables.raw_loans_once(spark, _tables(tmp_path, 400)) as raw:
        assert spark.conf.get(name) == "true" and raw.count() > 400
    assert spark.conf.get(name) == before
