"""Record numbering, MARC files, clusters."""

import pytest
from pyspark.sql import functions as F

from stackline.operators import convert, detect, number, parse
from stackline.sources import marc


def linked(spark, rows, merge=True):
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(rows)], "rec long, pos int, stmt string")
    done = df.join(convert.convert_statements(parse.parse_distinct(df)), "stmt")
    out = (number.merged if merge else number.numbered)(done, ["pos"])
    return [(r["link"], r["first_seq"]) for r in out.orderBy("pos").collect()], out


def test_runs(spark):
    months, season = "v. 1 no. 2 (Feb 1990)", "v. 1 no. 3 (Fall 1990)"
    for merge in (True, False):
        assert linked(spark, [months, season, months.replace("Feb", "Mar")], merge)[0] == [(1, 1), (2, 1), (3, 1)]
    assert linked(spark, ["v. 1 (1990)", "77", "v. 2 (1991)"])[0] == [(1, 1), (1, 2)]
    links, out = linked(spark, ["v.5(1994)", "v.6:no.1(1995)"])
    assert links == [(1, 1), (1, 2)]
    rows = out.collect()
    assert all(r["merged"] and [x["code"] for x in r["run_853"]] == ["a", "b", "i"] for r in rows)
    assert linked(spark, ["v.5(1994)", "v.6:no.1(1995)"], False)[0] == [(1, 1), (2, 1)]
    assert linked(spark, ["v. 7 nos. 1, 3 (1990)", "v. 8 no. 1 (1991)"])[0] == [(1, 1), (1, 3)]


def test_conforming_statements(spark):
    stmts = ["v. 1 (1990)", "v. 2 no. 1 (Feb 1991)", "v. 3 (1992)", "v. 4 (1993)"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(stmts)], "rec long, pos int, stmt string")
    done = df.join(convert.convert_statements(parse.parse_distinct(df)), "stmt")
    sub = lambda *x: [(c, v) for c, v in x]
    had = spark.createDataFrame([(1, [(0, "853", sub(("8", "3"), ("b", "v."), ("a", "(year)"))), (1, "853", sub(("8", "1"), ("a", "v."), ("b", "no.")))])], "rec long, fields array<struct<pos int,tag string,subfields array<struct<code string,value string>>>>")
    out = number.conformed(done, number.existing(had), ["pos"], convert.STANDARD.enum, convert.STANDARD.chron)
    rows = number.merged(out, ["pos"]).orderBy("pos").collect()
    assert [(r["link"], r["first_seq"], r["conformed"]) for r in rows] == [(3, 1, True), (1, 1, False), (3, 2, True), (3, 3, True)]
    assert [x["code"] + x["value"] for x in rows[0]["f863"][0]] == ["b1", "a1990"] and rows[0]["run_853"] is None


FIELDS = [("001", "x1", None), ("245", "00", [("a", "A title :"), ("b", "é sub /")]), ("022", "  ", [("a", "1234-5678")]), ("852", "8 ", [("b", "Main"), ("c", "Stacks")]), ("866", " 0", [("a", " v.1(1990)-v.4(1993) ")]), ("866", " 0", [("a", "v. 5 no. 1 (1994)"), ("a", "second")])]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    rows = []
    for i in range(30):
        fields = [(k, t, d if s is None else None, None if s is None else d[0], None if s is None else d[1], s or []) for k, (t, d, s) in enumerate(FIELDS)]
        rows.append((i, "00000nas a2200000 a 4500", fields[: 2 if i == 7 else 6]))
    df = spark.createDataFrame(rows, "rec_idx long, leader string, fields array<struct<pos int,tag string,data string,ind1 string,ind2 string,subfields array<struct<code string,value string>>>>")
    path = str(tmp_path_factory.mktemp("marc") / "out")
    marc.write_marc(df.repartition(2), path)
    return df, path


def test_round_trip(spark, records):
    df, path = records
    back = marc.with_index(marc.read_marc(spark, path))
    assert back.where("unreadable").count() == 0 and back.count() == 30
    same = lambda d: sorted(str(r["fields"]) for r in d.select("fields").collect())
    assert same(back) == same(df)
    one = marc.summary(back).where("has_866").first()
    assert (one["title"], one["issn"], one["location"], one["has_853"]) == ("A title : é sub", "1234-5678", "Main > Stacks", False)
    assert marc.statements(back).where("stmt = 'second'").count() == 0 and marc.statements(back).count() == 58


def test_damaged_record_keeps_its_place(spark, tmp_path, records):
    df, _ = records
    raw = [r[0].encode() + b"\x1d" for r in df.orderBy("rec_idx").limit(3).select(marc.to_raw(F.col("fields"), F.col("leader"))).collect()]
    bad = raw[0][:12] + b"9" + raw[0][13:]
    path = tmp_path / "bad.mrc"
    path.write_bytes(raw[1] + bad + raw[2].replace(b"sub", b"\xffub"))
    back = marc.with_index(marc.read_marc(spark, str(path))).orderBy("rec_idx").collect()
    assert [r["unreadable"] for r in back] == [False, True, False] and "�" in str(back[2]["fields"])
    with pytest.raises(ValueError, match="by place: 2"):
        marc.refuse_unreadable(marc.with_index(marc.read_marc(spark, str(path))))


def test_applying_twice_changes_nothing(spark, records):
    df, _ = records
    st = marc.statements(df).withColumnRenamed("rec_idx", "rec")
    done = number.merged(st.join(convert.convert_statements(parse.parse_distinct(st)), "stmt"), ["pos"])
    f853 = done.groupBy(F.col("rec").alias("rec_idx"), "link").agg(F.max("run_853").alias("fields"))
    f863 = number.fields(done).select(F.col("rec").alias("rec_idx"), "link", "seq", F.col("field").alias("fields"))
    once = marc.apply_conversion(df, f853, f863)
    show = lambda d: {r["rec_idx"]: str(r["fields"]) for r in d.collect()}
    assert show(once) == show(marc.apply_conversion(once, f853, f863)) and show(once)[7] == show(df)[7]
    assert "value='1.1'" in show(once)[0] and "value='1.2'" in show(once)[0]


def test_clusters_match_their_patterns(spark):
    df = spark.createDataFrame([(x,) for x in ["v. 1 no. 2 (Feb 1990)", "vol. 10 no. 2-3 (March 1991)", "v.1(1990)-v.4(1993)", "v. 1 (1990)- v. 2 (1991)", "innov stuff 12", "other words 3", None, " "]], "stmt string")
    out = {r["signature"]: r["statements"] for r in detect.clusters(df).collect()}
    assert sum(out.values()) == 6 and out["UNKNOWN|NUMBER"] == 2
    assert all(r["match_rate"] == 1.0 for r in detect.match_rates(df).collect())


def test_order_columns_of_any_name(spark):
    names = ["s", "k", "n", "all", "free", "fold", "run", "seq"]
    rows = [(1, *([0] * (len(names) - 1)), k, x) for k, x in enumerate(["v.5(1994)", "v.6:no.1(1995)", "77", "v. 1 no. 2 (Feb 1990)"])]
    df = spark.createDataFrame(rows, f"rec long, {', '.join(f'{n} int' for n in names)}, stmt string")
    done = df.join(convert.convert_statements(parse.parse_distinct(df)), "stmt")
    out = number.merged(done, names).orderBy("seq").collect()
    assert [(r["seq"], r["link"], r["first_seq"], r["merged"]) for r in out] == [(0, 1, 1, True), (1, 1, 2, True), (3, 1, 3, True)]


def test_two_files_keep_their_records_apart(spark, tmp_path, records):
    df, _ = records
    path = tmp_path / "in"
    path.mkdir()
    for name, stmt in (("a", "v.1(1990)"), ("b", "v. 2 no. 1 (Feb 1991)")):
        said = F.array(F.struct(F.lit("a").alias("code"), F.lit(stmt).alias("value")))
        one = df.where("rec_idx = 0").withColumn("fields", F.transform("fields", lambda f: f.withField("subfields", F.when(f["tag"] == "866", said).otherwise(f["subfields"]))))
        raw = one.select(marc.to_raw(F.col("fields"), F.col("leader"))).first()[0]
        (path / f"{name}.mrc").write_bytes(raw.encode() + b"\x1d")
    back = marc.with_index(marc.read_marc(spark, str(path)))
    st = marc.statements(back)
    assert st.columns == ["file", "rec_idx", "pos", "stmt"] and st.select("file", "rec_idx").distinct().count() == 2
    keyed = st.withColumn("rec", F.struct("file", "rec_idx"))
    done = number.merged(keyed.join(convert.convert_statements(parse.parse_distinct(st)), "stmt"), ["pos"])
    f853 = done.groupBy("rec", "link").agg(F.max("run_853").alias("fields")).select("rec.*", "link", "fields")
    f863 = number.fields(done).select("rec.*", "link", "seq", F.col("field").alias("fields"))
    out = marc.apply_conversion(back, f853, f863)
    said = {r["file"].rsplit("/", 1)[-1]: str(r["fields"]) for r in out.collect()}
    assert said["a.mrc"].count("tag='863'") == 2 and "value='1990'" in said["a.mrc"] and "value='1991'" not in said["a.mrc"] and "value='1991'" in said["b.mrc"]
    marc.write_marc(out, str(tmp_path / "out"))
    again = marc.with_index(marc.read_marc(spark, str(tmp_path / "out")))
    assert again.count() == 2 and again.where("unreadable").count() == 0
    bad = marc.with_index(marc.read_marc(spark, str(path))).withColumn("unreadable", F.lit(True))
    with pytest.raises(ValueError, match="a.mrc:1, b.mrc:1"):
        marc.refuse_unreadable(bad)


def test_statements_find_their_fields_and_converted_ones_go(spark, records):
    df, _ = records
    two = df.where("rec_idx in (0, 1)").withColumn("fields", F.concat("fields", F.transform(F.slice("fields", 6, 1), lambda f: f.withField("pos", F.lit(6)))))
    texts = spark.createDataFrame([(0, 0, "v. 5 no. 1 (1994)"), (0, 1, " v. 5 no. 1 (1994) "), (0, 2, "v. 5 no. 1 (1994)"), (0, 3, "edited"), (1, 0, "v.1(1990)-v.4(1993)")], "rec_idx long, nth int, text string")
    out = {(r["rec_idx"], r["nth"]): r["pos"] for r in marc.matched_sources(two, texts).collect()}
    assert out == {(0, 0): 5, (0, 1): 6, (0, 2): None, (0, 3): None, (1, 0): 4}
    got = spark.createDataFrame([(0, 5, ["x"]), (0, 4, []), (0, None, ["x"])], "rec_idx long, pos int, f863 array<string>")
    left = {r["rec_idx"]: [(f["pos"], f["tag"]) for f in r["fields"]] for r in marc.without_converted(two, got).collect()}
    assert [t for _, t in left[0]] == ["001", "245", "022", "852", "866", "866"] and [p for p, _ in left[0]] == list(range(6)) and len(left[1]) == 7
    first = marc.origins(marc.statements(two).withColumnRenamed("stmt", "piece"), ["rec_idx", "pos"]).collect()
    assert {(r["piece"], r["times"], r["rec_idx"], r["pos"]) for r in first} == {("v.1(1990)-v.4(1993)", 2, 0, 4), ("v. 5 no. 1 (1994)", 4, 0, 5)}


def test_corpus_lines_have_sections_over_splits(spark, tmp_path):
    from stackline.sources import corpus

    rows = [f"v. {k} ({1900 + k % 100})" for k in range(400)]
    text = "v. 0 (1890)\n# comment\n\n[section: one]\n" + "\n".join(rows) + "\n[section: two ]\nv. 1 (1990)  # [x12] warn:D3 odd\n  # note\nv. 2 (1991)\n"
    (tmp_path / "c.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        out = [tuple(r)[1:] for r in corpus.read_corpus(spark, str(tmp_path)).orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(1, None, "v. 0 (1890)", 1, None, None), *((5 + k, "one", x, 1, None, None) for k, x in enumerate(rows)), (406, "two", "v. 1 (1990)", 12, "warn", "D3"), (408, "two", "v. 2 (1991)", 1, None, None)]
    assert out == want


def test_records_chosen_by_place(spark):
    from stackline.sources import marc

    records = spark.createDataFrame([(f, k) for f in "ab" for k in range(4)], "file string, rec_idx long")
    places = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9)], "file string, rec_idx long")
    assert [tuple(r) for r in marc.chosen(records, places).collect()] == [("a", 1)] and marc.chosen(records, places, kept=False).count() == 7
    assert [tuple(r) for r in marc.page(records, 3, 2).collect()] == [("a", 3), ("b", 0)] and marc.page(records, -5, 0).count() == 1


def test_a_record_of_many_fields_takes_linear_time(spark, tmp_path):
    import time

    sub = lambda value: [("a", value)]
    rows = [(0, "00000nas a2200000 a 4500", [(0, "001", "x", None, None, [])] + [(k, "866", None, " ", "0", sub(f"v. {k}")) for k in range(1, 400)])]
    df = spark.createDataFrame(rows, f"rec_idx long, leader string, fields array<struct<pos:int,tag:string,data:string,ind1:string,ind2:string,subfields:{marc.SUBFIELDS}>>")
    began = time.perf_counter()
    marc.write_marc(df, str(tmp_path / "long"))
    back = marc.with_index(marc.read_marc(spark, str(tmp_path / "long")))
    assert [r["stmt"] for r in marc.statements(back).orderBy("pos").collect()] == [f"v. {k}" for k in range(1, 400)]
    assert time.perf_counter() - began < 30
    assert "rowNumber" not in back._jdf.queryExecution().analyzed().toString() and "row_number" not in back._jdf.queryExecution().analyzed().toString()
    assert marc.summary(back).first()["control"] == "x"


def test_rows_are_numbered_without_their_fields(spark):
    texts = ["v. 1 (1990)", "v. 2 no. 3 (1991)", "1 ?", "v. 3 (Jan 1992)", "v. 4 (1993)-"]
    rows = spark.createDataFrame([(k % 4, k, texts[k * k % 5]) for k in range(40)], "rec int, pos int, stmt string")
    fields = convert.convert_statements(parse.parse_distinct(rows)).select("stmt", "f853", "f863").localCheckpoint()
    for f in (number.numbered, number.merged):
        whole, slim = f(rows.join(fields, "stmt"), ["pos"]), f(rows, ["pos"], fields=fields)
        assert {*whole.columns} == {*slim.columns}
        shown = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert shown(whole) == shown(slim) and len(shown(slim)) > 20
