import pytest

from surveyloom import census
from surveyloom.sources import readers, runs, writers


def _csv(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture()
def files(tmp_path):
    return [
        _csv(tmp_path / "a.csv", "SERIALNO,STATE,N\n1,01,5\n2,06,6\n"),
        _csv(tmp_path / "b.csv", "N,SERIALNO,EXTRA\n7.5,3,x\n"),
        _csv(tmp_path / "c.csv", "SERIALNO,STATE,N\n4,11,8\n"),
    ]


def test_columns_are_matched_by_name(spark, files, rows):
    df = readers.read_csv_by_name(spark, files, text_columns=["STATE"])
    assert rows(df.select("SERIALNO", "STATE", "N", "EXTRA")) == [
        (1, "01", 5.0, None), (2, "06", 6.0, None), (3, None, 7.5, "x"), (4, "11", 8.0, None),
    ]


def test_declared_schema(spark, files, rows):
    df = readers.read_csv_by_name(spark, files, schema=_schema("STATE string, N double, GONE int"))
    assert df.columns == ["STATE", "N", "GONE"]
    assert rows(df) == [("01", 5.0, None), ("06", 6.0, None), ("11", 8.0, None), (None, 7.5, None)]


def _schema(ddl):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def test_types_are_merged_over_files(spark, tmp_path):
    values = {"whole": ("7", "123456789012345678901"), "number": ("12345678901234567890", "0.5"), "day": ("2024-01-31", "2024-01-31 10:20:30"),
              "long": ("5", "5000000000"), "mixed": ("2024-01-31", "6"), "gap": ("", "4")}
    paths = [_csv(tmp_path / f"{i}.csv", ",".join([*values, f"own{i}"]) + "\n" + ",".join([v[i] for v in values.values()] + ["1"]) + "\n") for i in (0, 1)]
    types = dict(readers.read_csv_by_name(spark, paths).dtypes)
    assert types == {"whole": "decimal(21,0)", "number": "double", "day": "timestamp", "long": "bigint", "mixed": "string", "gap": "int",
                     "own0": "int", "own1": "int"}


def test_jobs_go_by_layouts_not_by_files(spark, tmp_path):
    names, jobs = ["id", "b", "c", "d", "e"], []
    for size in (200, 400):  # each layout has more paths than Spark lists without a job
        folder = tmp_path / str(size)
        folder.mkdir()
        for i in range(size):
            header = names[i % 5 :] + names[: i % 5]
            _csv(folder / f"part-{i:04}.csv", ",".join(header) + "\n" + ",".join(str(i) if n == "id" else f"{n}{i}" for n in header) + "\n")
        (folder / "empty.csv").write_text("")
        paths, group = [str(f) for f in sorted(folder.glob("*.csv"))], f"csv-{size}"
        spark.sparkContext.setJobGroup(group, group)
        df = readers.read_csv_by_name(spark, paths)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert df.columns == names
        assert df.where("b = concat('b', id) AND e = concat('e', id)").agg({"id": "sum"}).first()[0] == sum(range(size))
    assert jobs[0] == jobs[1] < 100


def test_first_lines(spark, tmp_path):
    import gzip

    from surveyloom.sources import headers

    with gzip.open(tmp_path / "a b.csv.gz", "wt") as f:
        f.write("x,y\n1,2\n")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfx,y\r\n3,4\r\n")
    (tmp_path / "long.csv").write_text("n" * 200_000 + "\n1\n")
    (tmp_path / "none.csv").write_text("")
    uris = spark.read.text(str(tmp_path)).inputFiles()
    got = {r["path"].rsplit("/", 1)[1]: r["line"] for r in headers.first_lines(spark, [*uris, (tmp_path / "none.csv").as_uri()]).collect()}
    assert got == {"a%20b.csv.gz": "x,y", "bom.csv": "x,y", "long.csv": "n" * 200_000, "none.csv": None}
    with pytest.raises(ValueError, match="no CSV file"):
        readers.read_csv_by_name(spark, [str(tmp_path / "none.csv")])


def test_types_that_differ_between_files_become_text(spark, tmp_path, rows):
    paths = [_csv(tmp_path / "a.csv", "k,v\n1,10\n"), _csv(tmp_path / "b.csv", "v,k\nN/A,2\n")]
    assert rows(readers.read_csv_by_name(spark, paths)) == [(1, "10"), (2, "N/A")]


def test_strict_parse_fails_on_a_bad_row(spark, tmp_path):
    path = _csv(tmp_path / "a.csv", "k,v\n1,10\n2,oops\n")
    df = readers.read_csv_by_name(spark, [path], schema=_schema("k int, v int"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        df.collect()
    lenient = readers.read_csv_by_name(spark, [path], schema=_schema("k int, v int"), strict=False)
    assert [r["v"] for r in lenient.collect()] == [10, None]


def test_one_scan_per_layout(spark, files):
    plan = readers.read_csv_by_name(spark, files, text_columns=["STATE"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2


def test_state_paths():
    assert readers.state_paths("/d/psam_p{fips}.csv", ["WY", "AL"], census.STATES) == ["/d/psam_p56.csv", "/d/psam_p01.csv"]
    assert len(readers.state_paths("/d/csv_p{usps}.csv", ["ALL"], census.STATES)) == 50
    with pytest.raises(ValueError, match="ZZ"):
        readers.state_paths("/d/{fips}", ["ZZ"], census.STATES)


def test_partitioned_write_keeps_codes(spark, tmp_path, rows):
    df = spark.createDataFrame([("06", 1), ("06", 2), ("11", 3)], "ST string, n int")
    back = writers.write_by_group(df, str(tmp_path / "t"), "ST")
    assert rows(back.select("ST", "n")) == [("06", 1), ("06", 2), ("11", 3)]
    plan = back.where("ST = '06'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ST" in plan
    assert sorted(p.name for p in (tmp_path / "t").glob("ST=*")) == ["ST=06", "ST=11"]


@pytest.mark.parametrize("codec, named", [("zstd", "ZSTD"), ("snappy", "SNAPPY"), ("lz4_raw", "LZ4")])
def test_codecs(spark, tmp_path, codec, named):
    import pyarrow.parquet as pq

    writers.write_parquet(spark.range(10).toDF("a (b.c), d"), str(tmp_path / codec), codec)
    part = next((tmp_path / codec).glob("*.parquet"))
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == named


def test_group_values_json(spark, tmp_path):
    df = spark.createDataFrame([("10", 5), ("01", 7)], "ST string, state_population bigint")
    back = writers.write_group_values(df, str(tmp_path / "p"), "ST")
    assert [tuple(r) for r in back.orderBy("ST").collect()] == [("01", 7), ("10", 5)]


def test_cache_key_is_the_hash_of_canonical_json(spark):
    import hashlib

    from pyspark.sql import functions as F

    from surveyloom.functions.columns import extract_key

    text = '{"horizon": "5-Year", "states": ["AL", "WY"], "year": 2023}'
    want = hashlib.sha256(text.encode()).hexdigest()[:16]
    assert runs.extract_cache_key(2023, "5-Year", ["WY", "AL"]) == want
    column = extract_key(F.lit(2023), F.lit("5-Year"), F.array(F.lit("WY"), F.lit("AL")))
    assert spark.range(1).select(column).first()[0] == want


def test_extract_is_built_once(spark, tmp_path):
    layout, calls = runs.RunLayout(str(tmp_path), "r1"), []

    def build():
        calls.append(1)
        return spark.range(3)

    first = runs.cached_extract(spark, layout, "k", build)
    second = runs.cached_extract(spark, layout, "k", build)
    assert (first[1], second[1], len(calls)) == ("built", "cache", 1)
    assert second[0].count() == 3
    row = runs.run_metadata(spark, layout).first()
    assert (row["step"], row["rows"], row["cols"], row["columns"]) == ("extract_cache", 3, 1, ["id"])


def test_cache_key_of_no_states_and_of_quotes(spark):
    import hashlib
    import json

    for states in ([], ['A"B', "A\\C", "A\tD"], ["WY"] * 2):
        text = json.dumps({"horizon": 'one "year"', "states": sorted(states), "year": 2022})
        assert runs.extract_cache_key(2022, 'one "year"', states) == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_two_builders_at_once_publish_one_extract(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    layout, together = runs.RunLayout(str(tmp_path), "r1"), Barrier(4)

    def build():
        together.wait(60)  # every builder has found nothing committed
        return spark.range(1000)

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: runs.cached_extract(spark, layout, "k", build), range(4)))
    assert sorted(source for _, source in got) == ["built", "cache", "cache", "cache"]
    assert len({t.inputFiles()[0].rsplit("/", 1)[0] for t, _ in got}) == 1 and {t.count() for t, _ in got} == {1000}
    assert len(list((tmp_path / "_extract_cache" / "k").glob("*v-*"))) == 1
    assert runs.run_metadata(spark, layout).where("step = 'extract_cache'").count() == 1


def test_failed_builder_leaves_no_version(spark, tmp_path):
    from surveyloom.sources import commits

    layout = runs.RunLayout(str(tmp_path), "r1")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        runs.cached_extract(spark, layout, "k", lambda: spark.sql("SELECT 1 / (id - 5) AS x FROM range(10)"))
    assert commits.committed(spark, f"{layout.cache}/k") is None
    assert runs.cached_extract(spark, layout, "k", lambda: spark.range(2))[1] == "built"


def test_sweep_keeps_the_committed_version(spark, tmp_path):
    from surveyloom.sources import commits

    folder = str(tmp_path / "t")
    path, won = commits.publish(spark, folder, lambda p: spark.range(3).write.parquet(p))
    spark.range(4).write.parquet(f"{folder}/v-abandoned")
    assert won and commits.sweep(spark, folder, 1) == 0 and commits.sweep(spark, folder, 0) == 1
    assert commits.committed(spark, folder) == path and spark.read.parquet(path).count() == 3


def test_jobs_append_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    layout = runs.RunLayout(str(tmp_path), "r1")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: runs.register_model(spark, layout, f"m{i}", "boosted_trees", f"u{i}"), range(16)))
    assert all(runs.latest_model(spark, layout, f"m{i}", "boosted_trees") == f"u{i}" for i in range(16))


def test_latest_model(spark, tmp_path):
    layout = runs.RunLayout(str(tmp_path), "r1")
    with pytest.raises(LookupError):
        runs.latest_model(spark, layout, "standard", "boosted_trees")
    for uri in ("m1", "m2"):
        runs.register_model(spark, layout, "standard", "boosted_trees", uri)
    runs.register_model(spark, layout, "standard", "logistic_regression", "m3")
    assert runs.latest_model(spark, layout, "standard", "boosted_trees") == "m2"
