"""A whole run over raw drops, a second batch on top of it, and single tables."""

import datetime as dt
import json

from tessera.functions import dom
from tessera.operators import relational, simulate
from tessera.plans import run as runs

LONG = "Phát triển hệ thống với Python và SQL. " * 6


def posting(i, **other):
    return {
        "detail_id": f"t_{i}", "source": "topcv", "source_job_id": str(i), "job_url": f"https://topcv.vn/{i}", "title_raw": f"Lập trình viên {i}", "company_name_raw": f"Công ty TNHH ABC{i % 3}", "location_raw": "Hà Nội",
        "salary_raw": "15 - 20 triệu", "experience_raw": "2 năm", "skills_raw": "Python, SQL", "overview_raw": "", "responsibilities_raw": f"{LONG} {i}", "requirements_raw": "Ưu tiên biết Docker", "benefits_raw": "",
        "published_at_raw": "2026-09-28", "deadline_raw": "2026-10-30", "crawled_at": "2026-10-01T08:00:00",
    } | other


def drop(base, kind, day, records):
    folder = base / "topcv" / kind / day
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps(records, ensure_ascii=False))


def test_two_batches(spark, tmp_path):
    first, second, out = tmp_path / "one", tmp_path / "two", str(tmp_path / "out")
    details = [posting(i) for i in range(6)] + [posting(6, job_url=""), posting(7, salary_raw="40 - 20 triệu")]
    drop(first, "details", "2026-10-01", details)
    drop(first, "listings", "2026-10-01", [{k: d[k] for k in ("source", "source_job_id", "job_url", "title_raw", "company_name_raw")} | {"company_logo_url": "https://x/l.png"} for d in details])
    names = {"python": "Python", "sql": "SQL", "docker": "Docker"}
    run = runs.Run(spark, str(first), out, "b1", dt.date(2026, 10, 2), names)
    assert runs.refresh(run) == list(runs.TABLES)
    assert {s: run.table(f"master_{s}").count() for s in runs.STATUSES} == {"valid": 6, "quarantine": 1, "invalid": 1}
    assert run.table("summary").first().total == 8
    clean = run.table("clean").collect()
    assert len(clean) + run.table("duplicates").count() == 6 and all(r.is_it and r.is_active and r.city == "Hà Nội" and set(r.required_skills) >= {"Python", "SQL"} for r in clean)
    assert [run.table(n).count() for n in ("records", "companies", "jobs", "job_descriptions", "source_records", "snapshots")] == [6, 3, 6, 6, 6, 6]
    kinds = {(r.job_id, r.skill_name): r.skill_type for r in run.table("job_skills").join(run.table("skills"), "skill_id").collect()}
    assert len(kinds) == 18 and {v for (_, n), v in kinds.items() if n == "Docker"} == {"preferred"}
    [kpis] = run.table("market_kpis").collect()
    assert (kpis.total_jobs, kpis.total_companies, kpis.distinct_skills, kpis.avg_salary_max) == (6, 3, 3, 20_000_000)
    assert {r.skill_name: r.demand for r in run.table("skill_demand").collect()} == {"Python": 6, "SQL": 6, "Docker": 6}

    # the next day one posting is mended, one breaks, and one is new
    drop(second, "details", "2026-10-02", [posting(7, crawled_at="2026-10-02T08:00:00"), posting(0, title_raw="", crawled_at="2026-10-02T08:00:00"), posting(9, crawled_at="2026-10-02T08:00:00")])
    drop(second, "listings", "2026-10-02", [posting(7)])
    after = runs.Run(spark, str(second), out, "b2", dt.date(2026, 10, 3), names, previous="b1")
    for name in ("listings", "routed", *(f"master_{s}" for s in runs.STATUSES)):
        runs.build(after, name)
    found = {s: sorted(r.source_job_id for r in after.table(f"master_{s}").collect()) for s in runs.STATUSES}
    assert found == {"valid": ["1", "2", "3", "4", "5", "7", "9"], "quarantine": [], "invalid": ["0", "6"]}
    # one table by itself, twice
    assert runs.build(after, "master_valid").count() == runs.build(after, "master_valid").count() == 7
    assert runs.refresh(run, "tech_stack") == ["tech_stack"]


def test_lines_of_elements(spark):
    source = "<div><p>Hello <b>World</b></p>a<br>b<br/>c<ul><li> Item&nbsp;1 <li>Item 2</ul></div><script>no()</script><style>p{}</style><h2>T &amp; U</h2><span>x</span> y<h5>z</h5></p><!-- no -->"
    expected = "Hello World\na\nb\nc Item\xa01 Item 2\nT & U\nx yz"  # an li that no end tag closes ends with its list
    assert dom.lines_of(source) == expected
    assert [dom.lines_of(s) for s in (None, "", "plain", "<p>open", "</div>x")] == ["", "", "plain", "open", "x"]
    frame = spark.createDataFrame([(source,), (None,)], "c string")
    assert [r.v for r in frame.select(dom.clean_html_dom(frame.c).alias("v")).collect()] == [expected, ""]


def test_pairs_of_hot_groups(spark):
    rows = [(g, i) for g, n in ((1, 40), (2, 3), (3, 1), (None, 9)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g int, i int")
    expected = sorted([(a, b) for n in (40, 3) for a in range(n) for b in range(a + 1, n)])
    for block in (4, 7, 512):
        assert sorted(map(tuple, relational.pairs_within(frame, "g", "i", block).collect())) == expected
    counts = {(r.a, r.b): r.n for r in relational.pair_counts(frame, "i", "g").collect()}
    assert counts[(0, 1)] == 2 and counts[(0, 39)] == 1 and len(counts) == 780


def test_head_share(spark):
    shown = spark.createDataFrame([(1, i) for i in range(40)], "user_id int, job_id int")
    events = spark.createDataFrame([(1, i, "click") for i in range(21) for _ in range(30 if i < 2 else 1)], "user_id int, job_id int, event string")
    [row] = simulate.realism(shown, events).collect()
    assert abs(row.head_share - 60 / 79) < 1e-9 and row.clicks == 79
