"""Operators and functions that no query runs, on small frames."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import categorize, formats, parse, skills, text
from tessera.operators import cf, dedup, dq, gold, hybrid, insights, metrics, profiling, relational, retrieval, scoring, silver, upsert
from tessera.sources import pages, raw, sinks

C = F.col


def table(spark, expression, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.v for r in frame.orderBy("i").select(expression.alias("v")).collect()]


def test_joins_and_codes(spark):
    details = spark.createDataFrame([(1, "a", None, "d1"), (2, "b", "x", "d2"), (9, "z", "z", "z")], "id int, title string, city string, own string")
    listings = spark.createDataFrame([(1, "A", "hn", 5), (2, "B", "hcm", 6), (2, "B", "hcm", 6)], "id int, title string, city string, other int")
    got = relational.coalesced_join(details, listings, ["id"], ["title", "city"], dedupe_right=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "hn", "d1", 5), (2, "b", "x", "d2", 6)]
    assert table(spark, relational.lookup_codes(C("c"), {"a": 1, "b": 2}, 7), ["a", "b", "c", None]) == [1, 2, 7, 7]
    tree = spark.createDataFrame([(1, None, "root"), (2, 1, "leaf")], "id int, parent int, name string")
    assert {r.name: r.parent_name for r in relational.parent_names(tree, "id", "parent", "name").collect()} == {"root": None, "leaf": "root"}
    assert table(spark, relational.first_seen(C("c")), [["B", "a", "b", "A"], [], None], "array<string>") == [["B", "a"], [], []]
    found, missing = insights.reindexed(details, spark.createDataFrame([(1,), (5,)], "id int"), "id")
    assert found.count() == 1 and missing.first().id == 5
    fresh = upsert.update_column(details, spark.createDataFrame([(2, "new")], "id int, city string"), "id", "city")
    assert {r.id: r.city for r in fresh.collect()} == {1: None, 2: "new", 9: "z"}


def test_raw_states(spark, tmp_path):
    frame = spark.createDataFrame([(404, 0), (200, 2), (500, 2), (500, 0), (None, None)], "detail_http_status int, detail_attempts int")
    assert [(r.detail_status, r.detail_attempts) for r in raw.next_status(frame).collect()] == [("expired", 1), ("success", 3), ("failed", 3), ("pending", 1), ("pending", 1)]
    ids = spark.createDataFrame([("1",), (" ",), (None,), ("1",)], "source_job_id string")
    assert [r.source_job_id for r in raw.crawled_ids(ids).collect()] == ["1"]
    days = spark.createDataFrame([("2026-10-02",), ("2026-10-01",), ("",), ("x",)], "raw_date string")
    assert [r.raw_date for r in raw.dates(days).collect()] == ["2026-10-01", "2026-10-02"]
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    assert raw.first_existing(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.parquet")]).count() == 3
    with pytest.raises(FileNotFoundError):
        raw.first_existing(spark, [str(tmp_path / "none")])


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([("TopCV", "2026-10-01", ["a", "b"])], "source string, raw_date string, tags array<string>")
    sinks.write_batch(frame, str(tmp_path / "batch"))
    assert (tmp_path / "batch/source=topcv/raw_date=2026-10-01").is_dir()
    slates = spark.createDataFrame([("u", ["j1", "j2"])], "user_id string, job_ids array<string>")
    sinks.append_impressions(slates, str(tmp_path / "shown"))
    sinks.append_impressions(slates, str(tmp_path / "shown"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "shown")).collect()
    assert sorted((r.position, r.job_id) for r in rows) == [("0", "j1"), ("0", "j1"), ("1", "j2"), ("1", "j2")]
    events = spark.createDataFrame([("t", "u", "j", "click", 1, "s"), ("t", "u", "j", "dance", 1, "s")], raw.EVENT)
    sinks.append_events(events.where("event = 'click'"), str(tmp_path / "events"))
    assert raw.read_log(spark, str(tmp_path / "events")).count() == 1
    sinks.append_metrics(spark.range(2), str(tmp_path / "metrics"), "2026-10-01")
    sinks.write_model({"factors": spark.range(4)}, sinks.signature(frame, ["source"]), str(tmp_path / "model"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2 and spark.read.parquet(str(tmp_path / "model/factors")).count() == 4


def test_text_functions(spark):
    assert table(spark, text.match_key(C("c")), ["  FPT  Software, JSC. ", None]) == ["fpt software jsc", ""]
    assert table(spark, text.squeeze(C("c")), ["a \t b\n\nc"]) == ["a b c"]
    assert table(spark, text.unwrap_logo(C("c")), ["https://cdn-new.topcv.vn/unsafe/https://x/l.png", "https://y/l.png"]) == ["https://x/l.png", "https://y/l.png"]
    assert table(spark, text.word_count(C("c")), ["a b  c", "", None]) == [3, 0, 0]
    assert table(spark, text.clean_job_title_star(C("c")), ["[HCM] Tuyển gấp Java Dev (Hà Nội)"]) == ["Java Dev"]
    assert table(spark, text.profile_soup(F.lit("Dev"), F.array(F.lit("SQL"), F.lit("Go")), C("c")), ["cv", "", None]) == ["Dev Dev Dev SQL Go SQL Go SQL Go SQL Go cv"] + ["Dev Dev Dev SQL Go SQL Go SQL Go SQL Go"] * 2
    assert table(spark, text.content_soup(F.lit("T"), F.lit("S"), F.lit("g"), C("c")), ["d"])[0].split().count("T") == 3
    assert table(spark, formats.embedding_text(C("c"), F.lit("A"), F.lit("Undetermined"), F.lit("SQL"), F.lit("r"), F.lit("d")), ["Dev"]) == ["Vị trí: Dev. Công ty: A. Kỹ năng: SQL. Yêu cầu: r. Mô tả: d"]


def test_parsing_functions(spark):
    got = table(spark, parse.salary_from_title(C("c")), ["Backend Dev 15 - 20M", "Dev 3 - 5 Mobile"])
    assert (got[0].min, got[0].max) == (15_000_000, 20_000_000) and got[1].min is None
    assert table(spark, parse.clean_date(C("c")), [" 2026-10-01 ", "soon", None]) == ["2026-10-01", None, None]
    assert table(spark, parse.batch_id(C("c"), F.lit("2026-01-02")), ["2026-10-01T08:00", "x", None]) == ["batch_20261001", "batch_20260102", "batch_20260102"]
    got = table(spark, parse.parse_experience_star(C("c")), ["2 - 3 năm", "Không yêu cầu", "6 tháng"])
    assert [(g.min, g.max) for g in got] == [(2, 3), (0, 0), (None, None)]
    money = [table(spark, parse.json_ld_salary(*(F.lit(v).cast("double") for v in vs), C("c")), ["USD", None]) for vs in ((1000, 2000, None), (1000, None, None), (None, 2000, None), (None, None, 5), (None, None, None))]
    assert money == [["1,000 - 2,000 USD", "1,000 - 2,000 VND"], ["Từ 1,000 USD", "Từ 1,000 VND"], ["Tới 2,000 USD", "Tới 2,000 VND"], ["5 USD", "5 VND"], [None, None]]
    domains = (("Data", r"\bdata\b|du lieu"), ("Web", "frontend|web"))
    assert table(spark, categorize.first_pattern(C("c"), domains, "Khác"), ["Kỹ sư Dữ liệu", "Web dev", None]) == ["Data", "Web", "Khác"]


def test_skill_functions(spark):
    names = {"c++": "C++", "python": "Python", "py": "Python"}
    assert table(spark, skills.normalize_names(C("c"), names), [["PY", " go ", ""], None], "array<string>") == [["Python", "go"], []]
    assert table(spark, skills.normalize_skill_name(C("c"), names, "thưởng"), ["PYTHON", "tiền thưởng", "some tool", "", "công cụ"]) == ["Python", None, "Some Tool", None, None]
    wanted = skills.preferred_skills(F.lit(None).cast("string"), C("c"), F.array(F.lit("Python")), names)
    assert table(spark, wanted, ["Ưu tiên: C++ và Python. Khác", "C++"]) == [["C++"], []]
    assert table(spark, skills.is_preferred(C("c")), ["Là một LỢI THẾ", "must", None]) == [True, False, False]
    people = {"Data": (["Python", "SQL"], ["data"]), "Web": (["React"], ["web", "frontend"])}
    assert table(spark, insights.infer_persona(F.array(F.lit("python")), C("c"), people), ["x", "Web frontend", "web"]) == ["Data", "Web", "Web"]
    assert table(spark, insights.infer_persona(F.array(F.lit("none")), C("c"), people), ["x", "data web"]) == [None, "Data"]


def test_blends_and_factors(spark):
    assert table(spark, hybrid.three_way(F.lit(0.8), F.lit(0.5), C("c")), [0.4, None, 9.0], "double") == [61.0, 68.0, 100.0]
    scores = spark.createDataFrame([(1, 1, 0.2, 3.0), (1, 2, 0.6, 1.0), (1, 3, 1.0, None)], "user_id int, job_id int, cbf double, cf double")
    blend = {r.job_id: r.blend for r in hybrid.linear_blend(scores, ["user_id"], 0.5, ranks=False).collect()}
    assert blend == pytest.approx({1: 0.5, 2: 0.25, 3: 0.5})
    pairs = spark.createDataFrame([(u, j) for u in range(12) for j in range(8) if (u * j) % 3], "user_id int, job_id int")
    index, values, right = cf.truncated_svd(pairs, 3)
    places = {r.job_id: r["at"] for r in index.collect()}
    matrix = np.zeros((12, len(places)))
    for r in pairs.collect():
        matrix[r.user_id, places[r.job_id]] = 1
    assert sorted(places.values()) == list(range(len(places))) and np.allclose(values.toArray(), np.linalg.svd(matrix)[1][: len(values)], atol=1e-6)
    vectors = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], "vec_id int, embedding array<double>")
    assert len(cf.pca(vectors).first().components) == 2
    spread = retrieval.pairwise_distribution(vectors.where("vec_id > 0")).first()
    assert spread.mean == pytest.approx(1) and spread["median"] == pytest.approx(1)
    near = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.01)], "job_a int, job_b int, similarity double")
    jobs = spark.createDataFrame([(1, "S"), (2, "S"), (4, "S"), (5, "J")], "job_id int, seniority string")
    links = spark.createDataFrame([(1, 7), (4, 7), (5, 7), (2, 7)], "job_id int, skill_id int")
    assert [(r.job_id, r.match) for r in cf.similar_jobs(near, jobs, links, 1).collect()] == [(2, 90.0), (4, 53.0), (5, 52.0)]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 1)], "query_id string, item_id string, rank int")
    own = spark.createDataFrame([("q", ["X", "y"])], "query_id string, skills array<string>")
    wanted = spark.createDataFrame([("a", ["x", "z"]), ("b", ["Y"])], "item_id string, skills array<string>")
    assert {r.query_id: r.skill_coverage for r in metrics.skill_coverage_at(ranked, own, wanted, 2).collect()} == {"q": 0.75, "r": 0.0}
    oracle = spark.createDataFrame([("q", "b", 1), ("q", "z", 2)], "query_id string, item_id string, rank int")
    assert {r.query_id: r.oracle_precision for r in metrics.oracle_precision_at(ranked, oracle, 2).collect()} == {"q": 0.5, "r": 0.0}
    relevant = ranked.select("query_id", "item_id").unionByName(spark.createDataFrame([("q", "n")], "query_id string, item_id string"))
    warm = spark.createDataFrame([("a",), ("c",)], "item_id string")
    assert metrics.cold_start_recall(ranked, relevant, warm, 2).first()[0] == 0.5 and metrics.cold_start_recall(ranked, relevant.limit(0), warm, 2).first()[0] is None
    one, two = metrics.random_split(spark.range(5000), "id")
    assert one.count() + two.count() == 5000 and abs(one.count() - 4000) < 150 and one.join(two, "id").count() == 0
    assert {r.id for r in one.collect()} == {r.id for r in metrics.random_split(spark.range(5000).repartition(9), "id")[0].collect()}


def test_profiles_and_rules(spark):
    records = spark.createDataFrame([("a", "FPT, JSC", "Dev"), ("b", "fpt jsc", "dev!"), ("b", "x", "y"), ("b", "", "")], "source string, company_name_raw string, title_raw string")
    groups, few = profiling.cross_portal(records)
    assert [(r.company, r.title, r.source_list) for r in groups.collect()] == [("fpt jsc", "dev", ["a", "b"])] and few.count() == 1
    results = spark.createDataFrame([(1, "R", "ERROR", 10, 5, 50.0, "FAILED"), (2, "R", "ERROR", 10, 10, 100.0, "PASSED")], "source_id int, rule_name string, severity string, total int, passed int, pass_rate double, status string")
    sources = spark.createDataFrame([(1, "one")], "source_id int, source_name string")
    assert {(r.source_name, r.failed) for r in dq.breakdown(results, sources).collect()} == {("one", 1), (None, 0)}
    assert [tuple(r) for r in dq.rollup(results, "severity").collect()] == [("ERROR", 2, 20, 15, 75.0)]
    profile = spark.createDataFrame([("a", 2, 2, 1, 0), ("b", 0, 0, 0, 3)], "source string, language_vi int, language_en int, language_mixed int, language_unknown int")
    assert {r.source: r.dominant_language for r in profiling.dominant_language(profile).collect()} == {"a": "vi", "b": "unknown"}


def test_snapshot_and_windows(spark):
    jobs = spark.createDataFrame([("2026-09-30", False), ("2026-09-10", False), ("2026-11-01", True), ("bad", True), (None, None)], "deadline string, is_active boolean")
    assert insights.snapshot_date(jobs).first().snapshot == dt.date(2026, 10, 1)
    assert insights.snapshot_date(jobs.where("is_active")).first().snapshot == dt.date(2026, 11, 1) and insights.snapshot_date(jobs.limit(0)).first().snapshot is None
    assert table(spark, insights.binned(C("c"), [0, 10, 20], ["low", "high"]), [0, 1, 10, 11, 20, 21, None], "int") == [None, "low", "low", "high", "high", None, None]
    frame = spark.createDataFrame([(1, "a, b,,a"), (2, None), (3, " b")], "id int, s string")
    assert [tuple(r) for r in insights.skill_frequency(frame, "s").collect()] == [("b", 2, 66.67), ("a", 1, 33.33)]
    assert gold.filter_options(spark.createDataFrame([("Khác", True), ("A", True), ("B", False)], "c string, is_active boolean"), "c").count() == 3


def test_embedded_pages(spark):
    job = {"id": 5, "title": "Dev", "x": {"y": "}"}}
    html = "<script>self.__next_f.push([1," + json.dumps("a:" + json.dumps(job, separators=(",", ":")) + "tail") + "])</script>"
    decoded = pages.decode_stream(html)
    assert [json.loads(o) for o in pages.embedded_objects(decoded)] == [job] and pages.decode_stream(None) == "" and pages.parse_cards(None) == []
    builder = silver.source_records(spark.createDataFrame([(1, "TopCV", "9", "u", "2026-10-01"), (1, "topcv", "9", "u", "2026-10-01")], "job_id int, source string, source_job_id string, job_url string, crawled_at string"), F.lit(dt.date(2026, 1, 1)))
    assert [(r.source_record_id, r.source_id, r.batch_id) for r in builder.collect()] == [(1, 1, "batch_20261001")]


def test_fit_report_ranks(spark):
    """Ranks of equal, expired and repeated jobs."""
    n = 4_000
    profiles = spark.createDataFrame([(1, ["python"], 2.0, "", [], 100.0), (2, [], 9.0, "Huế", [], 0.0)], "profile_id int, skills array<string>, years double, city string, modes array<string>, min_salary double")
    jobs = spark.range(n).select(
        F.col("id").alias("job_id"), F.array().cast("array<string>").alias("required_skills"), (F.col("id") % 7).cast("double").alias("experience_min"), (F.col("id") % 7 + 2).cast("double").alias("experience_max"),
        F.lit("Hà Nội").alias("city"), F.lit("Onsite").alias("work_mode"), F.lit(None).cast("double").alias("salary_min"), (F.col("id") % 100).cast("double").alias("salary_max"), (F.col("id") % 3 != 0).alias("is_active"),
    )
    jobs = jobs.unionByName(jobs.where("job_id = 4"))
    similarity = spark.createDataFrame([(1, 5, 0.5), (1, 7, 0.25)], "profile_id int, job_id long, similarity double")
    wanted = profiles.crossJoin(jobs.select("job_id").distinct()).select("profile_id", "job_id")
    report = scoring.fit_report(profiles, jobs, similarity, wanted)
    got = report.select("profile_id", "job_id", "score", "rank", "active_jobs").collect()
    assert len(got) == 2 * (n + 1)
    assert {r.score for r in got if r.job_id % 3 == 0} == {-1.0}
    for profile in (1, 2):
        own = [r for r in got if r.profile_id == profile]
        active = sorted((r.score for r in own if r.job_id % 3), reverse=True)
        first = {}
        for i, score in enumerate(active):
            first.setdefault(score, i + 1)
        first.setdefault(-1.0, len(active) + 1)
        assert all((r.rank, r.active_jobs) == (first[r.score], len(active)) for r in own)
    assert next(r for r in got if (r.profile_id, r.job_id) == (1, 5)).rank == 1


def test_peaks_of_null_and_repeated_groups(spark):
    rows = spark.createDataFrame([(None, 2.0), (None, 1.0), (1, 4.0), (1, 0.0), (2, 0.0)], "g int, v double")
    got = retrieval.normalise_peak(rows, "g", "v")
    assert got.columns == ["g", "v"]
    assert sorted(((r.g or 0, r.v) for r in got.collect())) == [(0, 0.5), (0, 1.0), (1, 0.0), (1, 1.0), (2, 0.0)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_deduplication_candidates_against_brute_force(spark):
    """Titles and companies are compared once each, with the pairs that comparing all rows gives."""
    import random

    rng, rows = random.Random(3), []
    for i in range(300):
        words = rng.sample("abcdefghij", rng.randrange(1, 9))
        if i % 3 and rows:  # one word more or fewer than an earlier title
            words = (rows[rng.randrange(len(rows))][2].split() + ["k"])[i % 2 :]
        company = sorted(set(rng.choices(["fpt", "soft", "viet"], k=rng.randrange(0, 4))))
        rows.append((" ".join(company), company, " ".join(words), rng.choice(["hn", "hcm", None]), rng.choice([1.0, None]), i))
    frame = spark.createDataFrame(rows, "_ck string, _ct array<string>, _tk string, _city string, _exp double, _id int")
    same, similar = set(), set()
    for x in rows:
        for y in rows:
            if x[5] < y[5]:
                if x[2] == y[2] and len(x[2]) >= 3 and x[0] != y[0] and x[1] and y[1] and (set(x[1]) <= set(y[1]) or set(y[1]) <= set(x[1])):
                    same.add((x[5], y[5]))
                a, b = set(x[2].split(" ")), set(y[2].split(" "))
                if x[0] == y[0] and x[3] is not None and x[3:5] == y[3:5] and x[2] != y[2] and len(a & b) / len(a | b) >= 0.85:
                    similar.add((x[5], y[5]))
    assert sorted(map(tuple, dedup._same_titles(frame).collect())) == sorted(same) and same
    assert sorted(map(tuple, dedup._similar_titles(frame, 0.85).collect())) == sorted(similar) and similar


def test_deduplication_weighs_as_tfidf(spark):
    """Cosines near the threshold come from frequencies over all texts, though few are weighed."""
    texts = ["alpha beta gamma delta " * 5, "alpha beta gamma delta " * 5 + "epsilon", "other words here", "epsilon zeta", "alpha eta"]
    rows = [(f"j{i}", "Acme" if i else "Acme Soft", "Backend Developer", t, "", "hn", 1.0) for i, t in enumerate(texts)]
    jobs = spark.createDataFrame(rows, "job_id string, company_name string, title string, description_clean string, deadline string, city string, experience_min double")
    weights = {}
    for r in retrieval.tfidf(jobs, "job_id", "description_clean", sublinear=True, bigrams=False).collect():
        weights.setdefault(r.doc_id, {})[r.term] = r.weight
    cosine = sum(w * weights["j1"].get(t, 0.0) for t, w in weights["j0"].items())
    for least, linked in ((cosine - 1e-6, True), (cosine + 1e-6, False)):
        report = dedup.deduplicate(jobs, title_similarity=least)[1].collect()
        assert ("j0" in {r.job_id for r in report} | {r.kept_job_id for r in report}) == linked
