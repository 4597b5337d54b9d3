"""Operators on small frames, and every query against DuckDB."""

import datetime as dt
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cf, dedup, graph, hybrid, metrics, profiling, quality, relational, retrieval, scoring, silver, upsert
from tessera.plans import queries as plans
from tessera.sources import pages, raw, sinks
from tessera.streaming import events as streams

SF = "/root/testdata/sf0.01"
RECORD = {
    "detail_id": "t_1", "source": "topcv", "source_job_id": "1", "job_url": "https://topcv.vn/1", "title_raw": "Python Dev", "company_name_raw": "A", "overview_raw": "", "responsibilities_raw": "x" * 120,
    "requirements_raw": "", "benefits_raw": "", "salary_raw": "15 - 20 triệu", "published_at_raw": "2026-09-28", "deadline_raw": "2026-10-30", "crawled_at": "2026-10-01",
}


def records(spark, *changes):
    names = list(RECORD)
    return spark.createDataFrame([tuple((RECORD | c)[n] for n in names) for c in changes], ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize(
    "change, status, code",
    [
        ({}, "valid", None), ({"job_url": ""}, "invalid", "ERR_MISSING_JOB_URL"), ({"title_raw": "   "}, "invalid", "ERR_MISSING_TITLE"), ({"source": "unknown_portal"}, "invalid", "ERR_MISSING_SOURCE"),
        ({"source_job_id": "", "detail_id": ""}, "invalid", "ERR_MISSING_JOB_ID"), ({"responsibilities_raw": "short"}, "invalid", "ERR_CONTENT_TOO_SHORT"), ({"salary_raw": "40 - 20 triệu"}, "quarantine", "ERR_SALARY_INVERTED"),
        ({"salary_raw": "-15 - 20 triệu"}, "quarantine", "ERR_SALARY_NEGATIVE"), ({"salary_raw": "1,000 - 80,000 USD"}, "quarantine", "ERR_SALARY_OUTLIER"), ({"deadline_raw": "2026-09-01"}, "quarantine", "ERR_DATE_DEADLINE_BEFORE_PUBLISHED"),
        ({"published_at_raw": "2018-05-10"}, "quarantine", "ERR_DATE_FAR_PAST"), ({"deadline_raw": "soon"}, "quarantine", "ERR_DATE_MALFORMED"),
    ],
)
def test_router(spark, change, status, code):
    [row] = quality.route(records(spark, change)).collect()
    assert row.dq_status == status and (not code or code in row.dq_errors) and (code or row.dq_errors == [])


def test_router_summary(spark):
    routed = quality.route(records(spark, {}, {"job_url": ""}, {"salary_raw": "40 - 20 triệu"}, {}))
    row = quality.summary(routed).first()
    assert (row.total, row.valid, row.quarantine, row.invalid, row.valid_rate) == (4, 2, 1, 1, 50.0)
    assert quality.summary(routed.limit(0)).first().valid_rate == 0.0


def test_masters(spark):
    schema = "key string, title string, pos int, crawled_at string, dq_status string"
    old = spark.createDataFrame([("a", "old", 0, "1", "valid"), ("b", "keep", 0, "1", "valid")], schema)
    new = spark.createDataFrame([("a", "first", 1, "2", "valid"), ("a", "second", 2, "2", "valid"), ("c", "new", 3, "2", "valid")], schema)
    merged, counts = upsert.save_master(old, new, "key", "pos")
    assert {r.key: r.title for r in merged.collect()} == {"a": "second", "b": "keep", "c": "new"} and counts.first() == (1, 3)
    moved = spark.createDataFrame([("b", "bad", 1, "3", "invalid"), ("b", "fine", 2, "3", "valid")], schema)
    out = upsert.exclusive_masters({"valid": old, "invalid": old.limit(0)}, moved, "key", "pos")
    assert {r.key for r in out["valid"].collect()} == {"a"} and {r.key for r in out["invalid"].collect()} == {"b"}


def test_profile(spark):
    listings = spark.createDataFrame([("topcv", "1", "u1", "success"), ("topcv", "1", "u1", "success"), ("topcv", "2", "u2", "failed")], "source string, source_job_id string, job_url string, detail_status string")
    details = records(spark, {"salary_raw": "20 - 30 triệu", "deadline_raw": "2026-11-30"}, {"salary_raw": "Thỏa thuận", "deadline_raw": "", "responsibilities_raw": ""})
    table = profiling.profile_sources(listings, details)
    row = table.first()
    assert (row.total_listings, row.duplicate_urls, row.duplicate_job_ids, row.success, row.failed) == (3, 1, 1, 2, 1)
    assert (row.salary_numeric, row.salary_negotiable, row.deadline_valid, row.deadline_missing, row.missing_responsibilities_raw) == (1, 1, 1, 1, 1)
    assert "total_listings" in profiling.report(table) and profiling.overall(table).first().total_listings == 3
    raws = spark.createDataFrame([("a", '{"x":1,"y":2}'), ("b", '{"x":1}')], "source string, json string")
    assert {r.key: r.uniform for r in profiling.schema_comparison(raws).collect()} == {"x": True, "y": False}


def _posting(job_id, company, title, description, deadline="2026-12-01"):
    return (job_id, company, title, description, deadline, "Hà Nội", 1.0)


POSTING = "job_id string, company_name string, title string, description_clean string, deadline string, city string, experience_min double"


def test_deduplication(spark):
    own, other = "xay dung api backend python django postgresql " * 20, "thiet ke do hoa photoshop illustrator branding " * 20
    frame = spark.createDataFrame([
        _posting("a", "MBBANK", "Backend Developer", own, "2026-01-01"), _posting("b", "NGÂN HÀNG TMCP QUÂN ĐỘI – MBBANK", "Backend Developer", own, "2026-06-01"),
        _posting("c", "Công ty ABC", "Backend Developer", other), _posting("d", "Công ty ABC", "Graphic Designer", other), _posting("e", "Công ty ABC", "Graphic  Designer", other, "2026-11-01"),
    ], POSTING)
    kept, report = dedup.deduplicate(frame)
    assert {r.job_id for r in kept.collect()} == {"b", "c", "d"}
    assert {(r.job_id, r.kept_job_id, r.reason) for r in report.collect()} == {("a", "b", "company_name_variant"), ("e", "d", "exact")}
    boiler = "gioi thieu cong ty phuc loi bao hiem thuong nghi mat " * 30
    frame = spark.createDataFrame([_posting("x", "Acme", "Business Analyst", boiler + " phan tich nghiep vu"), _posting("y", "Acme", "Cloud Engineer", boiler + " ha tang cloud")], POSTING)
    assert dedup.deduplicate(frame)[0].count() == 2


def test_scores(spark):
    groups = [["PostgreSQL", "MySQL"], ["Vue", "React"]]
    schema = "a array<string>, b array<string>"

    def skill(user, job, **kw):
        return spark.createDataFrame([(user, job)], schema).select(scoring.skill_score(F.col("a"), F.col("b"), **kw).alias("v")).first().v

    assert skill(["Python", "SQL", "Redis"], ["Python", "Redis", "Kubernetes"]) == 0.444 and skill(["Python", "SQL", "Redis"], ["Python", "Redis", "Kubernetes"], mode="v1") == 0.667
    assert skill(["SQL"], ["SQL"]) == 0.5 and skill(["SQL"], []) is None and skill(["SQL"], [], mode="v1") == 0.5
    assert skill(["PostgreSQL", "Vue"], ["MySQL", "React", "Docker"], groups=groups) == 0.167

    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    lit = lambda v, kind="double": F.lit(v).cast(kind)
    assert [value(scoring.experience_score(lit(y), lit(1.0), lit(3.0))) for y in (2.0, 0.5, 7.0)] == [1.0, 0.7, 0.85]
    assert value(scoring.salary_score(lit(20e6), lit(None), lit(None))) is None and value(scoring.salary_score(lit(30e6), lit(10e6), lit(20e6))) == 0.667
    modes = F.array(F.lit("Remote"))
    assert value(scoring.place_score(lit("Hà Nội", "string"), modes, lit("Hà Nội", "string"), lit("Onsite", "string"))) == 0.6
    parts = {k: lit(1.0) for k in scoring.WEIGHTS}
    assert value(scoring.combine(parts)) == 1.0 and value(scoring.combine(parts | {"sal": lit(None)})) == 1.0


def test_recommendation(spark):
    profiles = spark.createDataFrame([(1, ["python"], 2.0, "Tất cả", None, 0.0)], "profile_id int, skills array<string>, years double, city string, modes array<string>, min_salary double")
    schema = "job_id int, required_skills array<string>, experience_min double, experience_max double, city string, work_mode string, salary_min double, salary_max double, is_active boolean"
    jobs = spark.createDataFrame([(1, ["python"], 1.0, None, "x", "Remote", None, None, True), (2, ["java"], 5.0, None, "x", "Onsite", None, 1.0, True), (3, ["python"], 1.0, None, "x", "Remote", None, None, False)], schema)
    near = spark.createDataFrame([(1, 1, 0.8), (1, 3, 0.8)], "profile_id int, job_id int, similarity double")
    got = scoring.recommend(profiles, jobs, near).orderBy("rank").collect()
    assert [r.job_id for r in got] == [1, 2, 3] and got[2].score == -1.0


def clusters(spark):
    rows = [(u, ("a" if u < 10 else "b") + str(j), 3.0) for u in range(20) for j in range(5) if (u + j) % 3]
    return spark.createDataFrame(rows, "user_id int, job_id string, weight double")


def test_als_and_fold_in(spark):
    pairs = clusters(spark)
    users, jobs = cf.als(pairs, k=4, rounds=5)
    asked = spark.createDataFrame([(0, j) for j in ("a0", "a1", "b0", "b1", "new")], "user_id int, job_id string")
    got = {r.job_id: r.score for r in cf.cf_scores(asked, users, jobs).collect()}
    assert got["new"] is None and min(got["a0"], got["a1"]) > max(got["b0"], got["b1"])
    fresh = spark.createDataFrame([(99, "b2", 5.0), (99, "b3", 3.0)], "user_id int, job_id string, weight double")
    vector = cf.fold_in(fresh, jobs, k=4)
    got = {r.job_id: r.score for r in cf.cf_scores(spark.createDataFrame([(99, j) for j in ("a0", "b4")], "user_id int, job_id string"), vector, jobs).collect()}
    assert got["b4"] > got["a0"]
    assert np.allclose(cf._solve(np.eye(3), np.eye(3)[:1], np.array([3.0]), 1.0, 0.0), [1, 0, 0])
    with pytest.raises(Exception, match="unknown event"):
        cf.checked_events(spark.createDataFrame([("like",)], "event string")).collect()


def test_als_query_runs_all_rounds(spark, monkeypatch):
    ran, step = [], cf._half_step
    monkeypatch.setattr(cf, "_half_step", lambda pairs, solve_for, *rest: ran.append(solve_for) or step(pairs, solve_for, *rest))
    assert sorted(plans.QUERIES["als_scores"](spark, SF).columns) == ["job_id", "score", "user_id"]
    assert ran == ["user_id", "job_id"] * 12


def test_hybrid(spark):
    rows = [(1, i, c, f, a) for i, (c, f, a) in enumerate(zip((0.9, 0.5, 0.4, 0.3, 0.8), (None, 0.0, 0.0, 5.0, 0.0), (True, True, True, True, False)))]
    frame = spark.createDataFrame(rows, "user_id int, job_id int, cbf double, cf double, is_active boolean")
    got = {r.job_id: r.hybrid for r in hybrid.hybrid_scores(frame, ["user_id"]).collect()}
    alone = {r.job_id: r.hybrid for r in hybrid.hybrid_scores(frame.withColumn("cf", F.lit(None).cast("double")), ["user_id"]).collect()}
    assert got[4] == float("-inf") and got[0] == alone[0] and got[3] > alone[3]
    assert [j for j, _ in sorted(alone.items(), key=lambda x: -x[1])][:4] == [0, 1, 2, 3]
    best = hybrid.recommend(frame, spark.createDataFrame([(1, 0)], "user_id int, job_id int"), 2).collect()
    assert 0 not in {r.job_id for r in best} and len(best) == 2


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 0), (1, "c", 3, 1)], "query_id int, item_id string, rank int, gain int")
    assert metrics.precision_at(ranked, 2, relevant="gain").first().precision == 0.5
    assert abs(metrics.ndcg_at(ranked, ranked, 3).first().ndcg - 1.5 / (1 + 1 / np.log2(3))) < 1e-12
    assert metrics.coverage(ranked, ranked, 1).first().coverage == pytest.approx(1 / 3)
    near = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, similarity double")
    assert metrics.diversity_at(ranked, near, 3).first().diversity == pytest.approx(1 - 0.5 / 3)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a int, b int")
    assert {r.id: r.root for r in graph.components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_star_builders(spark):
    more = {"company_url": "https://www.mb.com", "company_logo_url": "", "company_size_raw": "100-499", "company_location_raw": "", "industry_raw": "", "location_raw": "Hà Nội", "experience_raw": "2 năm", "work_mode_raw": "", "education_raw": ""}
    frame = records(spark, {"company_name_raw": "Công ty TNHH MB"}, {"source_job_id": "2", "company_name_raw": "MB"}, {"source_job_id": "3", "company_name_raw": "Khác biệt"})
    frame = frame.withColumns({k: F.lit(v) for k, v in more.items()})
    companies = silver.companies(frame)
    assert {(r.company_name_normalized, r.company_size_max, r.website_domain) for r in companies.collect()} == {("MB", 499, "mb.com"), ("Khác biệt", 499, "mb.com")}
    jobs = silver.jobs(frame, companies, F.lit(dt.date(2026, 10, 1))).orderBy("job_id").collect()
    assert [r.job_id for r in jobs] == [1, 2, 3] and [r.canonical_job_id for r in jobs] == [None, 1, None]
    assert jobs[0].is_active and jobs[0].city == "Hà Nội" and jobs[0].salary_type == "range"
    numbered = silver.numbered(spark.range(1000).withColumn("k", -F.col("id")).repartition(7), "n", ["k"]).collect()
    assert all(r.n == 1000 - r.id for r in numbered)


def test_sources(spark, tmp_path):
    (tmp_path / "topcv/listings/2026-10-11").mkdir(parents=True)
    (tmp_path / "topcv/listings/2026-10-11/p.json").write_text(json.dumps([{"source": "topcv", "source_job_id": "1"}, {"source": "topcv", "source_job_id": "2"}]))
    (tmp_path / "topcv/listings/2026-10-11/q.json").write_text(json.dumps({"source": "topcv", "source_job_id": "3"}))
    frame = raw.read_raw(spark, str(tmp_path), "listings")
    assert {(r.source_job_id, r.raw_date, r.raw_file_name) for r in frame.collect()} == {("1", "2026-10-11", "p.json"), ("2", "2026-10-11", "p.json"), ("3", "2026-10-11", "q.json")}
    assert raw.latest_date(frame).first()[0] == "2026-10-11" and raw.read_log(spark, str(tmp_path / "none.csv")).count() == 0
    card = '<div class="job" data-job-id="7"><a href="https://x.vn/j?ta=1">Dev</a><span class="company">ACME</span><span class="tag">A</span><span class="tag">A</span><span class="tag">b…</span></div>'
    stream = "<script>self.__next_f.push([1," + json.dumps('x:[{"id":12345,"title":"Dev \\"A\\""}]') + "])</script>"
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "ACME"}, "experienceRequirements": {"monthsOfExperience": 24}}</script>'
    frame = spark.createDataFrame([(1, card), (2, stream), (3, ld), (4, None)], "page_id int, html string")
    [c] = pages.listing_cards(frame).collect()
    assert (c.page_id, c.source_job_id, c.job_url, c.title_raw, c.company_name_raw, c.tags_raw) == (1, "7", "https://x.vn/j", "Dev", "ACME", ["A"])
    assert [json.loads(r.json)["id"] for r in pages.streamed_objects(frame).collect()] == [12345]
    posting = {r.page_id: r for r in pages.posting_details(frame).collect()}[3]
    assert (posting.title_raw, posting.company_name_raw, posting.experience_raw) == ("Dev", "ACME", "2.0 năm")
    item = {"jobId": 5, "jobTitle": "Dev", "yearsOfExperience": 2, "skills": [{"skillName": "SQL"}, {"skillName": "SQL"}], "workingLocations": [{"address": "", "cityNameVI": "Hà Nội"}], "benefits": [{"benefitValue": "x"}, {"benefitValue": "y"}], "jobDescription": "<p>d</p>"}
    [got] = pages.api_items(spark.createDataFrame([(json.dumps(item),)], "json string")).collect()
    assert (got.source_job_id, got.skills_raw, got.location_raw, got.benefits_raw, got.experience_raw, got.responsibilities_raw) == ("5", "SQL", "Hà Nội", "x\ny", "2 năm", "d")
    sinks.write_clean(spark.createDataFrame([(1, ["a", "b"])], "i int, s array<string>"), str(tmp_path / "clean"))
    assert spark.read.option("header", True).csv(str(tmp_path / "clean/csv")).first().s == "a, b"
    s = sinks.signature(frame, ["page_id"])
    assert s.first() == sinks.signature(frame.repartition(3), ["page_id"]).first()


def test_relational(spark):
    frame = spark.createDataFrame([(i, float(i % 3 + 1)) for i in range(30)], "id int, w double")
    assert relational.weighted_sample(frame, 5, "id", "w").count() == 5 and relational.seeded_sample(frame, 4, "id").count() == 4
    assert relational.page_count(0, 10) == 1 and relational.page_count(21, 10) == 3
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "b")], "g int, s string")
    assert relational.pair_counts(pairs, "s", "g").first() == ("a", "b", 2)


def test_streams(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    streams.upsert_batches(stream, str(tmp_path / "out"), ["user_id"], "event_id", str(tmp_path / "check")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out/v2"))
    expected = {r[0]: r[1] for r in duckdb.sql(f"select user_id, max(event_id) from '{SF}/events.parquet' group by 1").fetchall()}
    assert {r.user_id for r in last.collect()} == set(expected) and last.count() == len(expected)
    query = streams.windowed_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()


def test_dense_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    got = retrieval.dense_top_k(frame.where("vec_id = 0"), frame, 1).first()
    assert got.vec_id == 1 and got.similarity == pytest.approx(2 / np.sqrt(4.01))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    if name not in plans.ORACLES:
        assert got
        return
    expected = duck.sql(plans.ORACLES[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]

    def key(row):
        return tuple((x is None, str(x)) for x in row)

    assert sorted(got, key=key) == sorted((tuple(r[i] for i in places) for r in expected.fetchall()), key=key)


def test_many_pairs_take_little_room(spark, tmp_path):
    """All customers ask here, and all but a few have one set: their rows are dealt out, in runs and repeated sequences."""
    keys = "(range - 1000) * 20"
    orders = f"SELECT {keys} AS o_custkey, 'high' AS o_orderpriority FROM range(2600) UNION ALL SELECT {keys}, 'low' FROM range(7) UNION ALL SELECT NULL, 'high'"
    duckdb.sql(f"COPY ({orders}) TO '{tmp_path}/orders.parquet'")
    plans.QUERIES["jaccard_pairs"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    for t in "region nation customer supplier part lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    con.sql(f"CREATE TABLE want AS {plans.ORACLES['jaccard_pairs']}")
    con.sql(f"CREATE TABLE got AS SELECT a, b, jaccard FROM '{tmp_path}/out/*.parquet'")
    rows = con.sql("SELECT count(*) FROM want").fetchall()[0][0]
    assert rows == 2600 * 2599 == con.sql("SELECT count(*) FROM got").fetchall()[0][0]
    assert not con.sql("FROM want EXCEPT ALL FROM got").fetchall()
    files = list((tmp_path / "out").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < rows / 4
    assert max(con.sql(f"SELECT count(*) FROM '{f}'").fetchall()[0][0] for f in files) < rows / 2


def test_pairs_have_no_nulls(spark):
    """Parquet spares the levels of columns that can't be null; pairs are many, and most of their time goes into writing."""
    frame = plans.QUERIES["jaccard_pairs"](spark, SF)
    assert [f.name for f in frame.schema if f.nullable] == []


def test_blocks(spark):
    frame = spark.createDataFrame([(i, "x" if i % 10 else "y") for i in range(100)] + [(None, "x"), (None, "z")], "id int, g string")
    got = relational.blocks(frame, "id", "g", 4).collect()
    assert sorted((i, r.g) for r in got for i in r[1]) == [(i, "x" if i % 10 else "y") for i in range(100)]
    assert all(0 < len(r[1]) <= 4 for r in got) and sum(len(r[1]) < 4 for r in got) <= 3
    pairs = spark.createDataFrame([(0.5, [1, 2], [3, 4]), (1.0, [5], [])], "v double, p array<int>, q array<int>")
    assert [tuple(r) for r in relational.spread_pairs(pairs, "p", "q").select("v", "p", "q").collect()] == [(0.5, 1, 3), (0.5, 1, 4), (0.5, 2, 3), (0.5, 2, 4)]
