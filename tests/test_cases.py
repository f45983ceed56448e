"""Rules on hand-made cases whose answers are written out."""

from pyspark.sql import functions as F

from lodestone import fixtures as fx
from lodestone.functions import html, postings, scoring, skills, urls
from lodestone.operators import matching, robots
from lodestone.sources import web


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_career_links(spark):
    s, c, x, a = (F.col(n) for n in ("seed", "cur", "candidate", "anchor"))
    got = fx.CAREER_LINKS.frame(spark).select("id", urls.career_follow(s, c, x, a), urls.career_redirect(s, x))
    assert rows(got) == sorted(((r[0], r[5], r[6]) for r in fx.CAREER_LINKS.rows), key=repr)


def test_addresses(spark):
    got = fx.ADDRESSES.frame(spark).select("id", urls.private_address(F.col("ip")), urls.private_address(F.col("ip"), strict=True)).collect()
    assert {r[0] for r in got if r[1]} == {1, 2, 4, 5, 6, 8, 9, 10, 16, 17, 18, 19, 20, 23}
    assert {r[0] for r in got if r[2]} == {1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 23}
    assert [r[0] for r in got if r[1] is None] == [25]


def test_robots_files(spark):
    files = fx.ROBOTS_FILES.frame(spark)
    rules = robots.rules_of(files.select("origin", "body"), fx.AGENT).select("origin", "allow", "path", "specificity")
    assert rows(rules) == sorted(map(tuple, fx.ROBOTS_RULES.rows), key=repr)
    assert rows(robots.delays_of(files.select("origin", "body"), fx.AGENT)) == sorted(fx.ROBOTS_DELAYS.rows, key=repr)
    p = robots.policies_of(files, fx.AGENT).withColumnRenamed("origin", "o")
    j = fx.ROBOTS_REQUESTS.frame(spark).select("id", "url").join(p, urls.origin(F.col("url")) == F.col("o"), "left")
    got = j.select("id", robots.allows(F.col("block_all"), F.col("rules"), urls.robots_target(F.col("url"))))
    assert rows(got) == sorted(((r[0], r[2]) for r in fx.ROBOTS_REQUESTS.rows), key=repr)


def test_relative_urls_in_spark(spark):
    got = fx.RELATIVE.frame(spark).select("id", urls.canonicalize("base", "raw"))
    assert rows(got) == sorted(((r[0], r[3]) for r in fx.RELATIVE.rows), key=repr)


def test_html_texts(spark):
    got = fx.HTML_TEXTS.frame(spark).select("id", html.page_parts("html").alias("p")).select("id", "p.title", "p.h1", "p.text")
    assert rows(got) == sorted(((r[0], *r[2:]) for r in fx.HTML_TEXTS.rows), key=repr)


def test_selectors_ignore_case():
    page = html.Page('<body><div ID="The-Job-Description">text here</div><p CLASS="Location">Oslo</p></body>')
    assert page.first(html.DESCRIPTION_PLACES) == "text here" and page.first(html.LOCATION_PLACES) == "Oslo"


def test_postings(spark):
    p = fx.POSTING_PAGES.frame(spark).select("id", postings.posting(F.col("url"), F.col("html")).alias("p")).where("p is not null")
    got = p.select("id", "p.title", "p.company", "p.location", F.array_join("p.skills", ","), "p.experience", "p.employment_type", "p.extraction_method")
    assert rows(got) == sorted(map(tuple, fx.POSTINGS.rows), key=repr)


def test_experience(spark):
    got = {r[0]: r[1] for r in fx.TEXTS.frame(spark).select("id", scoring.experience(F.col("text"))).collect()}
    assert {k: v for k, v in got.items() if v} == {5: "6+ years of hands-on harbour engineering experience", 7: "3 to 5 years experience", 12: "10-12 years of data experience"}


def test_patterns_keep_their_texts():
    assert skills.literals(r"\bgit\b|github") == ["git", "github"]
    assert skills.literals("retrieval.augmented generation") == ["augmented generation"]
    assert skills.literals(r"c\+\+") == ["c++"] and skills.literals(r"\|") == ["|"]


def test_skills_with_and_without_repair(spark):
    text = spark.createDataFrame([("go and k8s, github; sparks fly",)], "t string")
    assert text.select(skills.detect(F.col("t"))).first()[0] == ["Kubernetes", "Git"]
    assert "Go" in text.select(skills.detect(F.col("t"), skills.catalog(fix_go=True))).first()[0]


def test_answers_of_the_matcher(spark):
    text = '{"matches":[{"jobId":"job-01","score":140,"matchedSkills":["Java"],"missingSkills":[],"summary":"good"},{"jobId":"nobody","score":50}]}'
    out = matching.parsed_answer(spark.createDataFrame([(text,)], "text string"), fx.JOBS.frame(spark))
    assert rows(out.select("id", "score", "summary")) == [("job-01", 100, "good")]


def test_body_cap_is_an_error(spark):
    site = spark.createDataFrame([("http://a.example/", None, 200, "text/html", "x" * 30, None, None, None)], web.WEB)
    ask = spark.createDataFrame([("http://a.example/", 1)], "url string, attempt int")
    row = web.answers(ask, site, cap=20).first()
    assert (row["error"], row["body"], row["status"]) == ("io", None, 200)
    assert web.answers(ask, site, cap=30).first()["error"] is None
