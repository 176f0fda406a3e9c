from siftline.functions import html as H


def page(body):
    return f"<html><head><style>a{{}}</style></head><body>{body}</body></html>"


def run(spark, *bodies):
    df = spark.createDataFrame([(i, "https://acme.example/careers/", page(b)) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    jobs, summary = H.extract(df)
    return [r for r in jobs.orderBy("page_id", "title").collect()], {r.page_id: r for r in summary.collect()}


def test_anchors_with_roles(spark):
    body = "".join(f'<a href="/careers/{i}">{t}</a>' for i, t in enumerate(("Backend Engineer", "Frontend Developer", "Data Scientist")))
    jobs, summary = run(spark, body)
    assert [j.title for j in jobs] == ["Backend Engineer", "Data Scientist", "Frontend Developer"]
    assert summary[0].confidence >= 60 and summary[0].strong == 3
    assert jobs[0].job_url == "https://acme.example/careers/0" and jobs[0].external_id.startswith("careerpage-")


def test_no_jobs_on_other_pages(spark):
    certs = '<a href="/c">Certified Scrum Developer Training</a><a href="/d">AWS Certification Exam Engineer</a>'
    nav = '<a href="/about">About us</a><a href="/jobs">View all jobs</a><a href="/x">Engineering</a>'
    jobs, summary = run(spark, certs, nav)
    assert jobs == [] and summary[0].jobs == summary[1].jobs == 0


def test_list_item_evidence(spark):
    jobs, _ = run(spark, '<ul><li><a href="/apply/1">Software Engineer</a> | Pune | 3-5 years | Full-time</li></ul>')
    best = max(jobs, key=lambda j: j.score)
    assert {"location", "experience", "employment-type"} <= set(best.evidence) and best.score >= 70 and best.country == "IN"


def test_script_pages(spark):
    _, summary = run(spark, '<div id="root"></div>', "<p>" + "text " * 400 + "</p>")
    assert summary[0].needs_render and not summary[1].needs_render
